"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item of n words, windows of n words slide over every text.
A window is a 64-bit SimHash of its words; a multi-index of ``BLOCKS`` blocks of
the fingerprint, each looked up with up to one changed bit, finds every item of
that size within ``RADIUS`` bits (with 19 changed bits over 10 blocks, one block
has one at most). Candidates are verified by the exact weighted similarity of
their word shingles: sum of minima over sum of maxima of counts, a shingle
weighing its length in bytes.

A window's similarity to any item is at most the share of its weight in
shingles that some item has. Windows under the threshold by that bound are not
hashed; this is exact. The benchmark is taken in blocks of at most
``max_block_bytes``, each in memory once per worker; documents never shuffle.

Words are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased, so
punctuation and line breaks don't hide a passage. An item of fewer words than a
shingle has its whole sequence as one. Defined cases: null and empty texts and
items match nothing; repeated rows get repeated results; an empty benchmark
leaves every document clean; equal similarities name the smallest item and then
the first window.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _words

BITS, BLOCKS, RADIUS = 64, 10, 19
SCHEMA = "doc_id long, item_ids array<long>, similarities array<double>, first_words array<long>, contaminated boolean, kept boolean"
_ENDS = np.linspace(0, BITS, BLOCKS + 1).astype(int)


def simhash(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` words at ``starts``."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    low = starts.min()  # only the words that a window has
    hashes, starts = hashes[low : starts.max() + size], starts - low
    for bit in range(BITS):
        ones = np.concatenate([[0], np.cumsum((hashes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        out |= (2 * (ones[starts + size] - ones[starts]) > size).astype(np.uint64) << np.uint64(bit)
    return out


def _blocks(fingerprint: int) -> list[int]:
    return [(fingerprint >> int(a)) & ((1 << int(b - a)) - 1) for a, b in zip(_ENDS[:-1], _ENDS[1:], strict=True)]


def _shingles(part: _words.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and weight of each shingle, and where each document's begin."""
    found, of = _words.windows(part.hashes(), part.of, size, short=True)
    doc = np.repeat(np.arange(part.n_docs), np.diff(of))
    at = part.of[doc] + np.arange(len(found)) - of[doc]
    # Bytes of the shingle's words.
    length = np.concatenate([[0], np.cumsum(part.ends - part.starts)])
    return found, (length[np.minimum(at + size, part.of[doc + 1])] - length[at]).astype(np.float64), of


class Index:
    """Items of a benchmark: their shingles, and fingerprints by size and block."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.size, self.items, self.by_block, self.sizes_of = size, [], {}, {}
        part = _words.words(*_words.buffers(pa.array([t for _, t in items], pa.string())), _words.ALNUM, lower=True)
        hashes = part.hashes()
        found, weight, of = _shingles(part, size)
        for d, (item_id, _) in enumerate(items):
            n = int(part.of[d + 1] - part.of[d])
            if not n:
                continue
            print_ = int(simhash(hashes[part.of[d] : part.of[d + 1]], np.array([0]), n)[0])
            own, first, counts = np.unique(found[of[d] : of[d + 1]], return_index=True, return_counts=True)
            self.items.append((item_id, n, print_, dict(zip(own.tolist(), counts.tolist(), strict=True)), float(weight[of[d] : of[d + 1]].sum())))
            for s in own.tolist():
                self.sizes_of.setdefault(s, set()).add(n)
            for block, value in enumerate(_blocks(print_)):
                self.by_block.setdefault((n, block, value), []).append(len(self.items) - 1)
        self.sizes = sorted({x[1] for x in self.items})
        self.known = np.unique(found)
        self.first = np.zeros(1 << 16, bool)
        self.first[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def has(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingles some item has."""
        out = self.first[(shingles & np.uint64(0xFFFF)).astype(np.int64)]
        at = np.flatnonzero(out)
        out[at] = np.isin(shingles[at], self.known)
        return out

    def near(self, n: int, fingerprint: int) -> set[int]:
        """All items of n words within the radius."""
        found: set[int] = set()
        for block, value in enumerate(_blocks(fingerprint)):
            width = int(_ENDS[block + 1] - _ENDS[block])
            for probe in (value, *(value ^ (1 << b) for b in range(width))):
                found.update(self.by_block.get((n, block, probe), ()))
        return {i for i in found if (self.items[i][2] ^ fingerprint).bit_count() <= RADIUS}

    def matches(self, words: np.ndarray, shingles: np.ndarray, weight: np.ndarray, hit: np.ndarray, threshold: float) -> dict[int, tuple[float, int]]:
        """item_id: (similarity, first word) of the best window of one text."""
        best: dict[int, tuple[float, int]] = {}
        all_, ours = np.concatenate([[0], np.cumsum(weight)]), np.concatenate([[0], np.cumsum(weight * hit)])
        # Only sizes of items that have one of the text's shingles, and all sizes under a shingle's.
        sizes = set().union(*(self.sizes_of[s] for s in set(shingles[hit].tolist()))) | {n for n in self.sizes if n < self.size}
        for n in sorted(x for x in sizes if x <= len(words)):
            runs = max(1, n - self.size + 1)
            starts = np.arange(len(words) - n + 1)
            if n < self.size:  # items of fewer words are one shingle; the text's windows of that size are not among its shingles
                starts, own = self._short(words, n, starts)
            else:
                total = all_[starts + runs] - all_[starts]
                starts = starts[(ours[starts + runs] - ours[starts]) >= threshold * total - 1e-9]
                own = None
            for s, fingerprint in zip(starts.tolist(), simhash(words, starts, n).tolist(), strict=True):
                for i in self.near(n, fingerprint):
                    item_id, _, _, counts, mass = self.items[i]
                    if own is None:
                        same = self._similarity(shingles[s : s + runs], weight[s : s + runs], counts, mass)
                    else:
                        same = float(own[s] in counts)
                    if same >= threshold - 1e-12 and (-same, s) < (-best.get(item_id, (0.0, 0))[0], best.get(item_id, (0.0, 0))[1]):
                        best[item_id] = (same, s)
        return best

    def _short(self, words: np.ndarray, n: int, starts: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        bounds = np.arange(len(starts) + 1) * n
        whole, _ = _words.windows(words[(starts[:, None] + np.arange(n)).ravel()], bounds, self.size, short=True)
        hit = np.flatnonzero(self.has(whole))
        return starts[hit], dict(zip(starts[hit].tolist(), whole[hit].tolist(), strict=True))

    @staticmethod
    def _similarity(shingles: np.ndarray, weight: np.ndarray, counts: dict[int, int], mass: float) -> float:
        """Sum of minima over sum of maxima; weights follow the shingle's text."""
        left, common = dict(counts), 0.0
        for s, w in zip(shingles.tolist(), weight.tolist(), strict=True):
            if left.get(s, 0):
                left[s] -= 1
                common += w
        return float(common / (weight.sum() + mass - common))


class Block:
    """Some items, and their index, which a worker builds once for all its tasks."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.items, self.size = items, size

    @functools.cached_property
    def index(self) -> Index:
        return Index(self.items, self.size)


def item_blocks(benchmark: DataFrame, max_bytes: int, size: int) -> Iterator[Block]:
    """The benchmark's items, as many at a time as ``max_bytes`` of text hold; a larger item is a block of its own."""
    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    held, n_bytes = [], 0
    for item_id, text in items.orderBy("item_id", "text").toLocalIterator():  # a partition at a time
        own = len(text.encode("utf-8", "surrogatepass"))
        if held and n_bytes + own > max_bytes:
            yield Block(held, size)
            held, n_bytes = [], 0
        held.append((int(item_id), text))
        n_bytes += own
    yield Block(held, size)


def _found(batch: pa.RecordBatch, index: Index, threshold: float) -> list[dict[int, tuple[float, int]]]:
    out = []
    for part in _words.slices(_words.column(batch, "text"), _words.ALNUM, lower=True):
        hashes = part.hashes()
        shingles, weight, of = _shingles(part, index.size)
        hit = index.has(shingles)
        some = _words.over(of, hit, np.logical_or, False)
        short = bool(index.sizes) and index.sizes[0] < index.size
        for d in range(part.n_docs):
            a, b = of[d], of[d + 1]
            out.append(index.matches(hashes[part.of[d] : part.of[d + 1]], shingles[a:b], weight[a:b], hit[a:b], threshold) if some[d] or short else {})
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, size: int = 5, threshold: float = 0.8, max_block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the items that it contains, how alike and where, and whether it is kept."""
    spark = docs.sparkSession
    out = docs.select(F.col("doc_id").cast("long"), "text", F.expr("array() :: array<struct<i: long, s: double, w: long>>").alias("found"))
    for block in item_blocks(benchmark, max_block_bytes, size):
        shared = spark.sparkContext.broadcast(block)  # max_block_bytes, or one item

        def run(batches, shared=shared):
            index = shared.value.index
            for batch in batches:
                new = [[{"i": i, "s": s, "w": w} for i, (s, w) in sorted(x.items())] for x in _found(batch, index, threshold)]
                column = _words.column(batch, "found")
                both = new if not pc.sum(pc.list_value_length(column)).as_py() else [(a or []) + b for a, b in zip(column.to_pylist(), new, strict=True)]
                yield pa.RecordBatch.from_arrays([_words.column(batch, "doc_id"), _words.column(batch, "text"), pa.array(both, column.type)], names=["doc_id", "text", "found"])

        out = out.mapInArrow(run, out.schema)
    found = F.array_sort("found")
    return out.select(
        "doc_id", F.transform(found, lambda x: x["i"]).alias("item_ids"), F.transform(found, lambda x: x["s"]).alias("similarities"),
        F.transform(found, lambda x: x["w"]).alias("first_words"), (F.size("found") > 0).alias("contaminated"), (F.size("found") == 0).alias("kept"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, size: int = 5, threshold: float = 0.8, max_block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    spark = docs.sparkSession
    for block in item_blocks(benchmark, max_block_bytes, size):
        shared = spark.sparkContext.broadcast(block)  # max_block_bytes, or one item

        def run(batches, shared=shared):
            index = shared.value.index
            for batch in batches:
                yield batch.filter(pa.array([not x for x in _found(batch, index, threshold)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
