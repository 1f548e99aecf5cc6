"""Quality rules: hashed n-gram logistic regression, calibrated, against fixed thresholds.

Features are the shares of hashed token unigrams, token bigrams (tokens are runs
of letters and digits or of signs, case kept) and byte 4-grams. The model is
fitted on a bounded sample of labelled rows (``max_rows``, half of each class,
in the order of a hash of the id), its probabilities are calibrated by Platt's
method on a fifth of them that it has not seen. Scoring is one pass over the
texts in Arrow batches with no shuffle; the weights are some 12,000 numbers.

Defined cases: a null text is empty and fails the base rules; without labelled
rows of both classes only the base rules decide; repeated rows get repeated
results; other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _words

BUCKETS = 4096
FAMILIES = 3
SCALE = 20.0
#: Kept from this calibrated probability of good quality on.
THRESHOLD = 0.3
MIN_WORDS = 10
#: Percent of words in repeated 5-word windows.
MAX_REPEATED = 20

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_NEW = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def _families(part: _words.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family, bucket indexes and where each document's begin. part: of PUNCT tokens."""
    hashed = part.hashes()
    pairs, of_pairs = _words.windows(hashed, part.of, 2)
    padded = np.concatenate([part.data, np.zeros(4, np.uint8)])
    four = np.ndarray((len(part.data),), "<u4", padded, strides=(1,)) * np.uint32(2654435761) >> np.uint32(20)
    keep = np.ones(len(four), bool)
    for back in (1, 2, 3):
        ends = part.bounds[1:] - back
        keep[ends[ends >= part.bounds[:-1]]] = False
    grams = np.maximum(np.diff(part.bounds) - 3, 0)
    shift = np.uint64(52)
    return [(hashed >> shift, part.of), (pairs >> shift, of_pairs), (four[keep], np.concatenate([[0], np.cumsum(grams)]))]


def _features(batches):
    """Sparse features of each row, as (doc_id, quality, indexes, values)."""
    for batch in batches:
        at, values = [], []
        for part in _words.slices(_words.column(batch, "text"), _words.PUNCT):
            families = _families(part)
            for d in range(part.n_docs):
                index, value = [], []
                for f, (buckets, of) in enumerate(families):
                    own = buckets[of[d] : of[d + 1]]
                    if len(own):
                        counts = np.bincount(own.astype(np.int64), minlength=BUCKETS)
                        has = np.flatnonzero(counts)
                        index.append(has + f * BUCKETS)
                        value.append(counts[has] * (SCALE / len(own)))
                at.append(np.concatenate(index).astype(np.int32) if index else np.zeros(0, np.int32))
                values.append(np.concatenate(value).astype(np.float32) if value else np.zeros(0, np.float32))
        yield pa.RecordBatch.from_arrays(
            [_words.column(batch, "doc_id"), _words.column(batch, "quality"), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in values], pa.binary())],
            names=["doc_id", "quality", "at", "value"],
        )


@dataclass(frozen=True)
class Model:
    """Weights by family and bucket, and Platt's slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -500, 500)))


#: Numbers of the sparse matrix that are looked at together, so that what is worked out beside it stays small.
BLOCK = 1 << 18


@dataclass(frozen=True)
class _Sparse:
    """Sparse rows as they arrived: row i has the indexes and values from ``of[i]`` to ``of[i + 1]``."""

    of: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def blocks(self):
        """(first row, number of rows, rows from 0, indexes, values) of as many whole rows as fit a block, at least one."""
        begin, n = 0, len(self.of) - 1
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(self.of, self.of[begin] + BLOCK, "right")) - 1)
            a, b = self.of[begin], self.of[end]
            yield begin, end - begin, np.repeat(np.arange(end - begin), np.diff(self.of[begin : end + 1])), self.at[a:b], self.value[a:b].astype(np.float64)
            begin = end

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        parts = [np.bincount(rows, weights=value * w[at], minlength=n) for _, n, rows, at, value in self.blocks()]
        return np.concatenate(parts) + b


def _fit_logistic(x: _Sparse, good: np.ndarray, used: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over the used rows, all in each step, block by block."""
    w, b = np.zeros(FAMILIES * BUCKETS), 0.0
    yes = (good * used).sum()
    balance = used * np.where(good == 1, 0.5 / max(1, yes), 0.5 / max(1, used.sum() - yes))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        gradient = np.append(penalty * w, 0.0)
        for begin, n, rows, at, value in x.blocks():
            raw = np.bincount(rows, weights=value * w[at], minlength=n) + b
            off = (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - good[begin : begin + n]) * balance[begin : begin + n]
            gradient[:-1] += np.bincount(at, weights=value * off[rows], minlength=len(w))
            gradient[-1] += off.sum()
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _platt(raw: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make raw scores probabilities, by Newton's method with Platt's targets."""
    yes, no = good.sum(), (1 - good).sum()
    target = np.where(good == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x, slope, shift = raw / max(1e-9, np.abs(raw).std() + np.abs(raw).mean()), 1.0, 0.0
    unit = max(1e-9, np.abs(raw).std() + np.abs(raw).mean())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -500, 500)))
        s = p * (1 - p)
        g = np.array([((p - target) * x).sum() + 1e-3 * slope, (p - target).sum()])
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(h, g)
    return float(slope / unit), float(shift)


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 3000, penalty: float = 1e-5, steps: int = 150) -> Model | None:
    """The model from at most ``max_rows`` labelled rows; None if a class is missing."""
    chosen = None
    for quality in (0, 1):
        one = (
            labels.where(F.col("quality") == quality).select("doc_id", "quality").dropna().distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2)
        )
        chosen = one if chosen is None else chosen.union(one)
    # max_rows rows of two integers at most: the broadcast is bounded by the parameter.
    # One row for each of them, whatever repeats, so the driver gets as many.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = texts.mapInArrow(_features, "doc_id long, quality int, at binary, value binary").toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    good = found["quality"].to_numpy().astype(np.float64)
    if set(good) != {0, 1}:
        return None
    at, value = (found[c].combine_chunks() for c in ("at", "value"))
    of = np.frombuffer(at.buffers()[1], np.int32)[at.offset : at.offset + len(at) + 1].astype(np.int64) // 4
    x = _Sparse(of - of[0], *(np.frombuffer(c.buffers()[2], kind)[of[0] : of[-1]] for c, kind in ((at, np.int32), (value, np.float32))))
    held = found["doc_id"].to_numpy() % 5 == 0
    if min(good[~held].sum(), (1 - good)[~held].sum(), held.sum()) == 0:
        held[:] = False
    w, b = _fit_logistic(x, good, ~held, penalty, steps)
    raw = x.scores(w, b)
    slope, shift = _platt(raw[held], good[held]) if held.any() else (1.0, 0.0)
    return Model(w, b, slope, shift)


def raw_scores(part: _words.Words, model: Model) -> np.ndarray:
    out = np.full(part.n_docs, model.bias)
    for f, (buckets, of) in enumerate(_families(part)):
        each = model.weights[f * BUCKETS : (f + 1) * BUCKETS][buckets.astype(np.int64)]
        out += _words.over(of, each, np.add, 0.0) * (SCALE / np.maximum(np.diff(of), 1))
    return out


def _repeated(part: _words.Words) -> np.ndarray:
    """Words of each document that stand in a 5-word window found twice or more in it."""
    grams, of = _words.windows(part.hashes(), part.of, 5)
    n = np.diff(of)
    doc = np.repeat(np.arange(part.n_docs), n)
    order = np.lexsort((grams, doc))
    same = (grams[order[1:]] == grams[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    first = part.of[doc[at]] + at - of[doc[at]]  # the window's first word
    mark = np.zeros(len(part.starts) + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + 5, -1)
    return _words.over(part.of, (np.cumsum(mark[:-1]) > 0).astype(np.int64), np.add, 0)


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _judge(texts: pa.Array, model: Model | None) -> dict[str, np.ndarray]:
    parts = []
    for part, tokens in zip(_words.slices(texts, _words.SPACED), _words.slices(texts, _words.PUNCT), strict=True):
        words = np.diff(part.of)
        new = _words.over(part.bounds, (_NEW & _words.SPACED)[part.data].astype(np.int64), np.add, 0)
        symbols = _words.over(part.bounds, _SYMBOL[part.data].astype(np.int64), np.add, 0)
        whole = part.data.tobytes()
        lines = np.array([_dup_lines(whole[a:b]) for a, b in zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist(), strict=True)], np.int64)
        repeated = _repeated(part)
        failed = (words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * words)
        p = model.probability(raw_scores(tokens, model)) if model else np.where(failed, 0.0, 1.0)
        parts.append((words, new, symbols, lines, repeated, failed, ~failed & (p >= THRESHOLD), p))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
    return {k: np.concatenate(x) if x else np.zeros(0) for k, x in zip(names, zip(*parts, strict=True) if parts else [()] * len(names), strict=True)}


def quality_rules(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, the base rules and the verdict."""

    def run(batches):
        for batch in batches:
            found = _judge(_words.column(batch, "text"), model)
            kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "probability": pa.float64()}
            yield pa.RecordBatch.from_arrays([_words.column(batch, "doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items())], names=["doc_id", *found])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with all their columns."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pc.fill_null(pa.array(_judge(_words.column(batch, "text"), model)["kept"], pa.bool_()), False))

    return docs.mapInArrow(run, docs.schema)
