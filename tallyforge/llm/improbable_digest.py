"""Document fingerprints by improbable features: rare byte windows in chained Bloom filters.

1. Every window of WINDOW bytes has an entropy. One pass over all texts counts
   how often each of BINS entropies occurs; the rarer its entropy, the earlier a
   window ranks. Windows of under WEAK bits (rules, padding) rank last.
2. A window is a feature if it is the leftmost of the first rank in at least
   POPULAR of the NEAR neighbourhoods of consecutive windows that hold it. That
   depends on the bytes around it only, so an edit changes features near it and
   no others; every text of WINDOW bytes or more has a feature.
3. Features, each once, go into Bloom filters of FILTER_BITS bits, HASHES bits a
   feature; after PER_FILTER features the next filter of the chain begins.
4. Likeness: each filter of the digest with fewer features takes its best
   overlap with the other's filters, that is common bits over the smaller
   filter's, both without what chance makes common. Overlaps within four
   deviations of chance count as none. The mean weighs filters by features.

Entropies are exact sliding sums: a byte that enters or leaves a window changes
the sum by its count, and counts come from comparing the text with itself moved
by 1 to WINDOW - 1 bytes. All in numpy, in blocks that fit a core's cache.

Neighbours in the order of ids meet without a global sort: ids are cut into
ranges, texts are shuffled once to the range that has their id, and the first
document of a range is also sent to the range before, so that each task streams
through its documents in order.

Defined cases: a null text is empty and has an empty fingerprint; a text of
under WINDOW bytes is one feature; equal fingerprints are alike (1), an empty
one and another are not (0); documents without an id come first, those of one id
in the order of a hash of their texts; a lone document is its own next; other
columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _words

WINDOW, NEAR, POPULAR = 32, 64, 16
BINS, WEAK = 1024, 1.0
FILTER_BITS, PER_FILTER, HASHES = 2048, 160, 5
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_BLOCK, _SLICE = 1 << 15, 1 << 21
_FULL = (BINS - 1) << 10
_LOG = np.log2(WINDOW)
_COUNTS = np.arange(WINDOW + 1)
_SUM = np.round(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) / (WINDOW * _LOG) * _FULL).astype(np.int64)
#: What the n-th equal byte adds to a window's sum.
_STEP = np.concatenate([[0], np.diff(_SUM)]).astype(np.int32)
_NO_RANK = np.uint32(0xFFFFFFFF)
_GAP = bytes(NEAR)


@dataclass
class Slice:
    """Texts with NEAR bytes of padding before, between and after them."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _slices(texts: pa.Array):
    """Some whole texts at a time, in their order."""
    raw, at = _words.buffers(texts)
    first, n, whole = 0, len(at) - 1, raw.tobytes()
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + _SLICE, "right")) - 1)
        own = at[first : last + 1]
        padded = _GAP + _GAP.join([whole[a:b] for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]) + _GAP
        starts = own[:-1] - own[0] + NEAR * np.arange(1, last - first + 1)
        yield Slice(np.frombuffer(padded, np.uint8), starts, starts + np.diff(own))
        first = last


def _entropies(data: np.ndarray) -> np.ndarray:
    """The bin of the entropy of the window at every place, from 0 (one byte value) to BINS - 1 (all differ)."""
    after, before = np.ones(len(data), np.uint8), np.ones(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[:-d] == data[d:]).view(np.uint8)
        after[:-d] += same
        before[d:] += same
    entered, left = np.cumsum(_STEP[before], dtype=np.int32), np.cumsum(_STEP[after], dtype=np.int32)  # wraps alike on both sides
    sums = entered[WINDOW - 1 :].copy()
    sums[1:] -= left[: len(sums) - 1]
    return np.clip((_FULL - sums) >> 10, 0, BINS - 1)


def _blocks(part: Slice):
    """First place, places and the entropy bins of windows from there, with NEAR - 1 places more on both sides; bins below 0 are no windows."""
    inside = np.zeros(len(part.data) + 1, np.int8)
    long = part.ends - part.starts >= WINDOW
    inside[part.starts[long]] = 1
    inside[part.ends[long] - WINDOW + 1] = -1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    size = len(part.data) - NEAR + 1  # the last places are padding
    for first in range(NEAR - 1, size, _BLOCK):
        n = min(_BLOCK, size - first)
        low, high = first - NEAR + 1, min(first + n + NEAR - 1, len(part.data) - WINDOW + 1)
        bins = _entropies(part.data[low : high + WINDOW - 1])
        bins[~inside[low:high]] = -1
        yield first, n, bins


def _popular(bins: np.ndarray, n: int, ranks: np.ndarray) -> np.ndarray:
    """Which of the n places after the first NEAR - 1 are features."""
    keys = (ranks[bins].astype(np.uint32) << np.uint32(17)) | np.arange(len(bins), dtype=np.uint32)
    keys[bins < 0] = _NO_RANK
    keys = np.concatenate([keys, np.full(max(0, n + 2 * NEAR - 2 - len(keys)), _NO_RANK)])
    wide = 1
    while wide < NEAR:
        keys = np.minimum(keys[:-wide], keys[wide:])
        wide *= 2
    chosen = np.bincount((keys[keys != _NO_RANK] & np.uint32((1 << 17) - 1)).astype(np.int64), minlength=n + NEAR - 1)
    return chosen[NEAR - 1 : NEAR - 1 + n] >= POPULAR


def _hashes(part: Slice, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of the bytes of each feature."""
    eight = np.ndarray((len(part.data) - 7,), "<u8", part.data, strides=(1,))
    out = _words.mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for at in range(0, WINDOW, 8):  # the padding after a short text is zeros
        out = _words.mix(out * np.uint64(0x9E3779B97F4A7C15) + eight[places + at])
    return out


@dataclass
class Digests:
    """Filters of some documents. ``of`` has a document's first filter at its index and its end at the next one."""

    filters: np.ndarray
    features: np.ndarray
    of: np.ndarray

    def take(self, first: int, last: int) -> Digests:
        a, b = self.of[first], self.of[last]
        return Digests(self.filters[a:b], self.features[a:b], self.of[first : last + 1] - a)

    def texts(self) -> list[str]:
        """Each filter as its number of features and its bits."""
        rows = np.concatenate([self.features.astype(np.uint8)[:, None], self.filters.view(np.uint8)], axis=1)
        return [base64.b64encode(rows[a:b].tobytes()).decode() for a, b in zip(self.of[:-1].tolist(), self.of[1:].tolist(), strict=True)]

    @staticmethod
    def read(texts: list[str]) -> Digests:
        raw = [np.frombuffer(base64.b64decode(x or ""), np.uint8).reshape(-1, 1 + FILTER_BITS // 8) for x in texts]
        rows = np.concatenate([*raw, np.zeros((0, 1 + FILTER_BITS // 8), np.uint8)])
        return Digests(np.ascontiguousarray(rows[:, 1:]).view(np.uint64), rows[:, 0].astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


def _chain(doc: np.ndarray, hashes: np.ndarray, n_docs: int) -> Digests:
    """Filters of features that are given in the order of their documents and places."""
    order = np.lexsort((hashes, doc))
    again = (doc[order[1:]] == doc[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    once = np.ones(len(doc), bool)
    once[order[1:][again]] = False  # the sort is stable, so the first of equals stays
    doc, hashes = doc[once], hashes[once]
    many = np.bincount(doc, minlength=n_docs)
    chained = -(-many // PER_FILTER)
    of = np.concatenate([[0], np.cumsum(chained)])
    own = np.arange(len(doc)) - (np.cumsum(many) - many)[doc]
    row = of[doc] + own // PER_FILTER
    bits = np.zeros((int(of[-1]), FILTER_BITS), bool)
    for j in range(HASHES):
        bits[row, ((hashes >> np.uint64(11 * j)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return Digests(np.packbits(bits, axis=1, bitorder="little").view(np.uint64), np.bincount(row, minlength=int(of[-1])), of)


def digests(texts: pa.Array, ranks: np.ndarray) -> Digests:
    parts = []
    for part in _slices(texts):
        places = [first + np.flatnonzero(_popular(bins, n, ranks)) for first, n, bins in _blocks(part)]
        size = part.ends - part.starts
        short = np.flatnonzero((size > 0) & (size < WINDOW))
        at = np.concatenate([*places, part.starts[short]])
        doc = np.searchsorted(part.starts, at, "right") - 1
        order = np.argsort(at, kind="stable")
        at, doc = at[order], doc[order]
        parts.append(_chain(doc, _hashes(part, at, np.minimum(size[doc], WINDOW)), len(size)))
    if not parts:
        return Digests(np.zeros((0, FILTER_BITS // 64), np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64))
    of = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.of) for p in parts]))])
    return Digests(np.concatenate([p.filters for p in parts]), np.concatenate([p.features for p in parts]), of)


def _best_overlaps(a: Digests, b: Digests) -> np.ndarray:
    """For each document, the mean over its filters in a of the best overlap with its filters in b."""
    ones_a, ones_b = (np.bitwise_count(x.filters).sum(axis=1, dtype=np.int64) for x in (a, b))
    doc = np.repeat(np.arange(len(a.of) - 1), np.diff(a.of))
    many = np.diff(b.of)[doc]  # filters that each filter of a meets
    best, total, first = np.zeros(len(doc)), np.cumsum(many), 0
    while first < len(doc):
        last = max(first + 1, int(np.searchsorted(total, total[first] - many[first] + (1 << 15), "right")))
        m = many[first:last]
        i = np.repeat(np.arange(first, last), m)
        j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(b.of[doc[first:last]], m)
        common = np.bitwise_count(a.filters[i] & b.filters[j]).sum(axis=1, dtype=np.int64)
        chance = ones_a[i] * ones_b[j] / FILTER_BITS
        noise = 4 * np.sqrt(chance * (1 - np.maximum(ones_a[i], ones_b[j]) / FILTER_BITS))
        over = np.where(common > chance + noise, (common - chance) / np.maximum(np.minimum(ones_a[i], ones_b[j]) - chance, 1e-9), 0.0)
        np.maximum.at(best, i, over)
        first = last
    weight = a.features.astype(np.float64)
    return np.bincount(doc, best * weight, len(a.of) - 1) / np.maximum(np.bincount(doc, weight, len(a.of) - 1), 1)


def likeness_of(a: Digests, b: Digests) -> np.ndarray:
    """From 0 to 1, for the documents of a and b in their order."""
    n_a, n_b = (np.diff(np.concatenate([[0], np.cumsum(x.features)])[x.of]) for x in (a, b))
    ab, ba = _best_overlaps(a, b), _best_overlaps(b, a)
    out = np.where(n_a < n_b, ab, np.where(n_b < n_a, ba, (ab + ba) / 2))
    same = np.diff(a.of) == np.diff(b.of)
    for d in np.flatnonzero(same & (n_a == n_b)):
        if np.array_equal(a.filters[a.of[d] : a.of[d + 1]], b.filters[b.of[d] : b.of[d + 1]]):
            out[d] = 1.0
    return np.clip(out, 0.0, 1.0)


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two columns of fingerprints, from 0 to 1; null counts as empty."""

    @F.pandas_udf("double")
    def compared(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(likeness_of(Digests.read(left.tolist()), Digests.read(right.tolist())))

    return compared(a, b)


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy bin, by how many windows of all texts have it: a table of BINS rows whatever the input."""

    def count(batches):
        for batch in batches:
            seen = np.zeros(BINS, np.int64)
            for part in _slices(_words.column(batch, "text")):
                for _, n, bins in _blocks(part):
                    own = bins[NEAR - 1 : NEAR - 1 + n]
                    seen += np.bincount(own[own >= 0], minlength=BINS)
            has = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(seen[has])], names=["bin", "n"])

    seen = np.zeros(BINS, np.int64)
    for row in docs.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        seen[row["bin"]] = row["n"]
    weak = np.arange(BINS) < WEAK / _LOG * (BINS - 1)
    ranks = np.empty(BINS, np.uint16)
    ranks[np.lexsort((np.arange(BINS), seen, weak))] = np.arange(BINS)
    return ranks


def fingerprints(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features and fingerprint."""

    def run(batches):
        for batch in batches:
            found = digests(_words.column(batch, "text"), ranks)
            many = np.diff(np.concatenate([[0], np.cumsum(found.features)])[found.of])
            yield pa.RecordBatch.from_arrays([_words.column(batch, "doc_id"), pa.array(many, pa.int64()), pa.array(found.texts(), pa.string())], names=["doc_id", "n_features", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_features long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``tail``: each partition has a range of documents by id and then the first one of the next range.

    Only one key for each partition reaches the driver.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ranges = keyed.select("doc_id", "h").repartitionByRange(parts, "doc_id", "h").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "h")).alias("least"))
    bounds = sorted((r["least"]["has"], r["least"]["doc_id"] or 0, r["least"]["h"]) for r in ranges.collect())

    @F.arrow_udf("long")
    def placed(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """Twice the range, and one more where its first document is."""
        out = []
        for i, h in zip(ids.to_pylist(), hashes.to_pylist(), strict=True):
            key = (i is not None, i or 0, h)
            part = max(0, bisect_right(bounds, key) - 1)
            out.append(2 * part + (key == bounds[part]))
        return pa.array(out, pa.int64())

    n = max(1, len(bounds))
    place = F.expr("place div 2").cast("int")
    own = F.struct(place.alias("part"), F.lit(False).alias("tail"))
    before = F.struct(((place + n - 1) % n).cast("int").alias("part"), F.lit(True).alias("tail"))
    sent = keyed.withColumn("place", placed("doc_id", "h")).withColumn("to", F.explode(F.when(F.col("place") % 2 == 1, F.array(own, before)).otherwise(F.array(own))))
    return sent.select("doc_id", "text", "h", "to.part", "to.tail").repartitionById(n, F.col("part")).sortWithinPartitions("tail", F.col("doc_id").asc_nulls_first(), "h").select("doc_id", "text", "tail")


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first ones of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def against_edits(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """One row per row of ``docs``: fingerprints of the text and of its edited text, and likeness to that and to the next document's."""

    def run(batches):
        ids, texts, tail = [], [], []
        for batch in batches:
            ids += _words.column(batch, "doc_id").to_pylist()
            texts += [x or "" for x in _words.column(batch, "text").to_pylist()]
            tail += _words.column(batch, "tail").to_pylist()
            n = len(texts) - 1  # the last one waits for its next
            if n > 0:
                found = digests(pa.array(texts, pa.large_string()), ranks)
                changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
                other = digests(pa.array(changed, pa.large_string()), ranks)
                own, following = found.take(0, n), found.take(1, n + 1)
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[:-1], pa.int64()), pa.array([len(x) for x in texts[:-1]], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]), pa.array(own.texts()), pa.array(other.texts()),
                        pa.array(likeness_of(own, other)), pa.array(likeness_of(own, following)),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                yield out.filter(pa.array([not x for x in tail[:-1]]))
            ids, texts, tail = ids[-1:], texts[-1:], tail[-1:]

    return in_order(docs).mapInArrow(run, SCHEMA)
