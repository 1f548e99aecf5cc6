"""Quality classifier by importance resampling.

Two generative models over hashed token unigrams and bigrams, one of the target
(labelled good rows) and one of the whole raw corpus, give every document a log
importance weight: the sum over its n-grams of the log ratio. Adding Gumbel
noise and taking the top k samples k documents without replacement in
proportion to their weights.

A few words make a document toxic, and a sum over all n-grams drowns them. So
n-grams that are in significantly more of the labelled toxic documents than of
the good ones have a second log ratio, and documents that sum up to more of it
than nearly all good ones (half of what ``target_kept`` lets go) come last.
Beside words and pairs of words, these n-grams are the first 4, 5 and 6 bytes of
words that a document has twice, three or five times: inflected and compound
words share their stems.

k is a number, a share, or by default the count of documents whose weight
reaches the one that ``target_kept`` of the labelled good rows reach; the model
is then fitted on half of them and k is chosen by the other half, so that the
sample is as large as the part of the corpus that looks like the target. With
the default, 99.5 %, nearly all that looks like the target stays, whatever the
noise: then it acts as a filter rather than as a small sample.
The k-th largest key is found exactly by a radix search over 64-bit keys: four
counts over 65,536 ranges each, so no sort and no task holds more than the
ranges. The raw model counts every document; the target is a bounded sample of
labelled rows (``max_target``).

Defined cases: null and empty texts weigh 0 (no evidence); without labelled
target rows every weight is 0 and all are kept; equal keys at the border go in
the order of doc_id; rows that repeat a doc_id at the border stay or go together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _shared, _words

BUCKETS = 1 << 14
#: Buckets of the toxic n-grams are finer: common n-grams must not share one with them.
MARKS = 1 << 20
#: Bytes of a word's start, and how often a document must have it, each with MARKS buckets of its own.
STARTS, TIMES = (4, 5, 6), (2, 3, 5)
#: Standard deviations from which on an n-gram tells toxic documents from good ones.
SIGNIFICANT = 6.0
#: What a toxic document's key loses; more than any weight.
LAST = 1e9
_SHIFT = np.uint64(50)


def _buckets(part: _words.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    hashed = part.hashes()
    pairs, of = _words.windows(hashed, part.of, 2)
    return [((hashed >> _SHIFT).astype(np.int64), part.of), ((pairs >> _SHIFT).astype(np.int64), of)]


def _starts(part: _words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each start of each word that is longer than it."""
    padded = np.concatenate([part.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(part.data) + 1,), "<u8", padded, strides=(1,))
    doc, n, docs, buckets = part.doc_of_word(), part.ends - part.starts, [], []
    for size in STARTS:
        at = np.flatnonzero(n > size)
        first = eight[part.starts[at]] & np.uint64((1 << (8 * size)) - 1)
        docs.append(doc[at])
        buckets.append((_words.mix(first + np.uint64(size) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(buckets)


def _marks(part: _words.Words, chosen: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Document and bucket of each distinct mark of a document, by level: unigrams and bigrams first, then starts of words at the most TIMES they reach.

    chosen: which buckets of words and which of starts are wanted.
    """
    hashed = part.hashes()
    pairs, of = _words.windows(hashed, part.of, 2)
    doc = np.concatenate([np.repeat(np.arange(part.n_docs), np.diff(x)) for x in (part.of, of)])
    bucket = (np.concatenate([hashed, pairs]) >> np.uint64(44)).astype(np.int64)
    if chosen is not None:
        doc, bucket = doc[chosen[0][bucket]], bucket[chosen[0][bucket]]
    out = [np.divmod(np.unique(doc * MARKS + bucket), MARKS)]
    doc, bucket = _starts(part)
    if chosen is not None:
        doc, bucket = doc[chosen[1][bucket]], bucket[chosen[1][bucket]]
    own, n = np.unique(doc * MARKS + bucket, return_counts=True)
    doc, bucket = np.divmod(own, MARKS)
    level = np.searchsorted(TIMES, n, "right")
    return out + [(doc[level == i], bucket[level == i]) for i in range(1, len(TIMES) + 1)]


@dataclass(frozen=True)
class Toxic:
    """Log ratios of the significant buckets (level * MARKS + bucket, ascending), and the sum that good documents don't exceed."""

    buckets: np.ndarray
    ratio: np.ndarray
    limit: float = float("inf")

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A start of words counts once, by the highest ratio of the levels that it reaches."""
        ratio = np.zeros((1 + len(TIMES), MARKS), np.float32)
        ratio.ravel()[self.buckets] = self.ratio
        ratio[1:] = np.maximum.accumulate(ratio[1:], axis=0) / len(STARTS)
        chosen, out = np.stack([ratio[0] > 0, ratio[-1] > 0]), []
        for part in _words.slices(texts, _words.PUNCT):
            own = np.zeros(part.n_docs)
            for level, (doc, bucket) in enumerate(_marks(part, chosen)):
                own += np.bincount(doc, weights=ratio[level, bucket], minlength=part.n_docs)
            out.append(own)
        return np.concatenate(out) if out else np.zeros(0)


@dataclass(frozen=True)
class Model:
    """log(target / raw) by bucket, and what marks toxic documents."""

    ratio: np.ndarray
    toxic: Toxic = Toxic(np.zeros(0, np.int64), np.zeros(0))

    def keys(self, ids: np.ndarray, texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights, whether toxic, and weights plus noise, by which toxic documents come last."""
        weight = self.weights(texts)
        toxic = self.toxic.scores(texts) > self.toxic.limit if len(self.toxic.buckets) else np.zeros(len(weight), bool)
        return weight, toxic, weight + _gumbel(ids, seed) - np.where(toxic, LAST, 0.0)

    def weights(self, texts: pa.Array) -> np.ndarray:
        out = []
        for part in _words.slices(texts, _words.PUNCT):
            own = np.zeros(part.n_docs)
            for buckets, of in _buckets(part):
                own += _words.over(of, self.ratio[buckets], np.add, 0.0)
            out.append(own)
        return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, *, max_target: int = 20_000, smoothing: float = 1.0) -> Model:
    """Bucket counts of all documents and of the labelled good ones, in one pass."""
    good = _good(labels, max_target)
    target = np.sort(np.array([r[0] for r in good.collect()], np.int64))  # max_target numbers at most

    def count(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            ids = _words.column(batch, "doc_id")
            chosen = np.isin(ids.fill_null(-1).to_numpy(zero_copy_only=False), target)
            for part in _words.slices(_words.column(batch, "text"), _words.PUNCT):
                here = chosen[part.first : part.first + part.n_docs]
                for buckets, of in _buckets(part):
                    counts[0] += np.bincount(buckets, minlength=BUCKETS)
                    if here.any():
                        counts[1] += np.bincount(buckets[np.repeat(here, np.diff(of))], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(counts[0]), pa.array(counts[1])], names=["bucket", "raw", "target"])

    sums = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, wanted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # a row for each bucket
        raw[r[0]], wanted[r[0]] = r[1], r[2]
    if not wanted.sum():
        return Model(np.zeros(BUCKETS))
    # Smoothing draws the target to the raw model, so that buckets without evidence say nothing.
    share = (raw + smoothing) / (raw + smoothing).sum()
    target_share = (wanted + smoothing * BUCKETS * share) / (wanted.sum() + smoothing * BUCKETS)
    return Model(np.log(target_share / share))


def _good(labels: DataFrame, most: int) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    return good.select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit_toxic(docs: DataFrame, seen: DataFrame, unseen: DataFrame, *, kept: float, most: int = 20_000) -> Toxic:
    """Ratios by the ``seen`` labels; the limit that ``kept`` of the good documents of the ``unseen`` ones hold."""
    toxic = seen.where("toxic = 1").select("doc_id").dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = toxic.withColumn("bad", F.lit(1)).unionByName(_good(seen, most).withColumn("bad", F.lit(0)))

    def count(batches):
        for batch in batches:
            bad = _words.column(batch, "bad").to_numpy(zero_copy_only=False)
            for part in _words.slices(_words.column(batch, "text"), _words.PUNCT):
                own = bad[part.first : part.first + part.n_docs]
                levels = _marks(part)
                # What reaches a level reaches those below it.
                levels = [levels[0]] + [tuple(np.concatenate(x) for x in zip(*levels[i:], strict=True)) for i in range(1, len(levels))]
                doc = np.concatenate([x for x, _ in levels])
                bucket = np.concatenate([i * MARKS + x for i, (_, x) in enumerate(levels)])
                has, at = np.unique(bucket, return_inverse=True)
                n_bad = np.bincount(at, weights=own[doc], minlength=len(has)).astype(np.int64)
                n = np.bincount(at, minlength=len(has))
                # Bucket -1 counts the documents.
                columns = [np.append(has, -1), np.append(n_bad, own.sum()), np.append(n - n_bad, part.n_docs - own.sum())]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["bucket", "bad", "good"])

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    # Both broadcasts are of 2 * most rows of two integers at most.
    sums = _shared.written(texts.join(F.broadcast(chosen), "doc_id").mapInArrow(count, "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxic-ngrams")
    total = sums.where("bucket = -1").collect()
    if not total or not total[0]["bad"] or not total[0]["good"]:
        return Toxic(np.zeros(0, np.int64), np.zeros(0))
    n_bad, n_good = total[0]["bad"], total[0]["good"]
    share = (F.col("bad") + F.col("good")) / (n_bad + n_good)
    z = (F.col("bad") / n_bad - F.col("good") / n_good) / F.sqrt(share * (1 - share) * (1 / n_bad + 1 / n_good))
    rows = sums.where((F.col("bucket") >= 0) & (share < 1) & (z > SIGNIFICANT)).orderBy("bucket").collect()  # of the marks' buckets at most
    found = Toxic(np.array([r["bucket"] for r in rows], np.int64), np.array([np.log((r["bad"] + 0.5) / (n_bad + 1)) - np.log((r["good"] + 0.5) / (n_good + 1)) for r in rows]))
    if not rows:
        return found

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(found.scores(_words.column(batch, "text")))], names=["score"])

    limit = texts.join(F.broadcast(_good(unseen, most)), "doc_id").mapInArrow(score, "score double").agg(F.percentile("score", F.lit(kept)).alias("x")).collect()[0]["x"]
    return found if limit is None else Toxic(found.buckets, found.ratio, limit)


def _gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    bits = _words.mix(_words.mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed))
    return -np.log(-np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53))


def _sortable(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit integers in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def scored(docs: DataFrame, model: Model, seed: int = 17) -> DataFrame:
    """doc_id, log_weight, gumbel_key (weight plus noise), the key as an integer in the same order and whether toxic."""

    def run(batches):
        for batch in batches:
            ids = _words.column(batch, "doc_id")
            weight, toxic, key = model.keys(ids.fill_null(-1).to_numpy(zero_copy_only=False), _words.column(batch, "text"), seed)
            yield pa.RecordBatch.from_arrays([ids, pa.array(weight), pa.array(key), pa.array(_sortable(key)), pa.array(toxic)], names=["doc_id", "log_weight", "gumbel_key", "key_bits", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, log_weight double, gumbel_key double, key_bits long, toxic boolean")


def kth_largest(df: DataFrame, column: str, k: int) -> tuple[int, int] | None:
    """The k-th largest 64-bit integer, and how many of those equal to it belong to the top k."""
    if k <= 0:
        return None
    low, width, left = -(2**63), 64, k
    while width:
        width -= 16
        counts = (
            df.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(low + 2 ** (width + 16) - 1)))
            .groupBy(F.shiftright(F.col(column) - F.lit(low) if width < 48 else F.col(column), width).alias("range")).count().collect()
        )  # fmt: skip  # 65,536 rows at most
        shift = 2**15 if width == 48 else 0
        for r in sorted(counts, key=lambda r: -r["range"]):
            if r["count"] >= left:
                low += (r["range"] + shift) << width
                break
            left -= r["count"]
        else:
            return None
    return low, left


@dataclass(frozen=True)
class Cut:
    """Kept are keys over ``key``, and those equal to it up to ``doc_id``."""

    key: int
    doc_id: int | None


def choose_k(scores: DataFrame, labels: DataFrame, *, target_kept: float = 0.995, most: int = 20_000) -> int:
    """Documents, toxic ones aside, whose weight reaches that of ``target_kept`` of the labelled good rows."""
    own = scores.join(F.broadcast(_good(labels, most)), "doc_id")  # of ``most`` rows at most
    n, left = own.agg(F.count("*"), F.count(F.when(~F.col("toxic"), 1))).collect()[0]
    if not left:
        return scores.count()
    least = own.where("not toxic").agg(F.percentile("log_weight", F.lit(max(0.0, 1 - target_kept * n / left))).alias("w")).collect()[0]["w"]
    return scores.where((F.col("log_weight") >= least) & ~F.col("toxic")).count()


def cut(scores: DataFrame, k: int) -> Cut | None:
    """Where the top k by key end; None: all are kept."""
    found = kth_largest(scores, "key_bits", k)
    if found is None:
        return None
    key, among = found
    tied = scores.where(F.col("key_bits") == key)
    last = None
    if tied.count() > among:
        # The smallest doc_ids among equal keys: the largest of their negatives.
        ids = kth_largest(tied.select((-F.coalesce(F.col("doc_id"), F.lit(-1))).alias("negative")), "negative", among)
        last = -ids[0] if ids else None
    return Cut(key, last)


def _kept(found: Cut | None):
    if found is None:
        return F.lit(True)
    over = F.col("key_bits") > found.key
    same = F.col("key_bits") == found.key
    return over | (same if found.doc_id is None else same & (F.coalesce(F.col("doc_id"), F.lit(-1)) <= found.doc_id))


def importance_sample(docs: DataFrame, labels: DataFrame, *, k: int | float | None = None, seed: int = 17, max_target: int = 20_000, target_kept: float = 0.995) -> tuple[DataFrame, Model, Cut | None]:
    """One row per row of ``docs`` with its weight, key and whether the sample has it; the model and the cut."""
    # The model has not seen the rows that k is chosen by: those it was fitted on weigh too much.
    seen = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)) == 0
    model = fit(docs, labels.where(seen) if k is None else labels, max_target=max_target)
    toxic = fit_toxic(docs, labels.where(seen), labels.where(~seen), kept=(1 + target_kept) / 2, most=max_target)
    model = Model(model.ratio, toxic)
    scores = _shared.written(scored(docs, model, seed), "importance")
    if isinstance(k, float):
        k = round(k * scores.count())
    k = choose_k(scores, labels.where(~seen), target_kept=target_kept, most=max_target) if k is None else k
    found = cut(scores, k)
    kept = F.lit(False) if k <= 0 else _kept(found)
    return scores.select("doc_id", "log_weight", "gumbel_key", kept.alias("kept")), model, found


def keep_sampled(docs: DataFrame, labels: DataFrame, *, seed: int = 17, **options) -> DataFrame:
    """The rows of ``docs`` in the sample, with all their columns; weights are computed anew rather than joined."""
    _, model, found = importance_sample(docs, labels, seed=seed, **options)
    if found is None:
        return docs

    def run(batches):
        for batch in batches:
            ids = _words.column(batch, "doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            key = _sortable(model.keys(ids, _words.column(batch, "text"), seed)[2])
            same = key == found.key
            yield batch.filter(pa.array((key > found.key) | (same if found.doc_id is None else same & (ids <= found.doc_id))))

    return docs.mapInArrow(run, docs.schema)
