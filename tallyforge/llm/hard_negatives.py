"""Hard negatives by segment summary filtering: bounds on inner products from means and deviations of segments.

Vectors become integers; each is stored with the mean and the deviation of its
segments, for segments of SEGMENTS components (coarse first). For two vectors
the inner product lies within

    sum of n * mean * mean' +- sum of n * deviation * deviation'

over segments of n components. A pair is refined from coarse to fine segments
for as long as its bounds allow a result, and only what is left is scored
exactly. Bounds are widened by what rounding could change, so no result is lost.

The anchors are a stated query set, met with all rows in blocks: rows and
anchors are written as blocks of bounded size to the shared folder, and a task
takes one block of anchors and every n-th block of rows, one at a time. Its own
best so far raise the floor for the rows to come, so it returns at most
``positives`` (or ``negatives``) rows for an anchor, and a window ranks those of
all tasks. No vector is shuffled but once, to make blocks even, and none passes
through the driver. There are two rounds: positives, whose scores are then the
limits for negatives.

Defined cases: rows with a null id, label or vector or with a null or non-finite
component take no part; components that a vector lacks count as zero; every row
is a candidate of its own, so an id on two rows can be listed twice; repeated
anchor rows are mined once; a positive without negatives has no rows; inner
products are 64-bit integers. Other columns are left out.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import _files, _shared

#: Components of a segment at each level.
SEGMENTS = (16, 4, 2)
BLOCK_BYTES = 4 << 20
ANCHORS_A_BLOCK = 1024

_AT_ONCE = 128  # anchors
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "block long, anchor int, anchor_id long, target int, target_id long, target_score long, id long, score long"


@dataclass
class Block:
    """Vectors, in the order of their labels, with scaled means and deviations of their segments by level."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    means: list[np.ndarray]
    deviations: list[np.ndarray]

    def rows(self, at) -> Block:
        return Block(self.ids[at], self.labels[at], self.vectors[at], [m[at] for m in self.means], [d[at] for d in self.deviations])

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, labels=self.labels, vectors=self.vectors, **{f"m{k}": m for k, m in enumerate(self.means)}, **{f"d{k}": d for k, d in enumerate(self.deviations)})
        return out.getvalue()

    @staticmethod
    def load(url: str) -> Block:
        with np.load(io.BytesIO(_files.read(url))) as found:
            return Block(found["ids"], found["labels"], found["vectors"], [found[f"m{k}"] for k in range(len(SEGMENTS))], [found[f"d{k}"] for k in range(len(SEGMENTS))])


def summarized(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Block:
    """A block of integer vectors. Means and deviations are scaled by the root of the segment's length."""
    order = np.lexsort((ids, labels))
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    means, deviations = [], []
    for n in SEGMENTS:
        parts = vectors.astype(np.float64).reshape(len(vectors), vectors.shape[1] // n, n)
        mean = parts.mean(axis=2)
        means.append(mean * np.sqrt(n))
        deviations.append(np.sqrt(((parts - mean[:, :, None]) ** 2).sum(axis=2)))
    return Block(ids, labels, vectors, means, deviations)


def _exact(a: Block, r: Block, i: np.ndarray | None = None, j: np.ndarray | None = None) -> np.ndarray:
    """Inner products of all pairs, or of the pairs (i, j)."""
    most = max(int(np.abs(x.vectors).max(initial=0)) for x in (a, r))
    kind = np.float64 if most * most * a.vectors.shape[1] < 1 << 53 else np.int64  # floats are exact below that
    x, y = a.vectors.astype(kind), r.vectors.astype(kind)
    if i is None:
        return (x @ y.T).astype(np.int64)
    out = [np.einsum("ij,ij->i", x[i[k : k + 16384]], y[j[k : k + 16384]]) for k in range(0, len(i), 16384)]
    return np.concatenate([*out, np.zeros(0, kind)]).astype(np.int64)


def possible(a: Block, r: Block, floor: np.ndarray, ceiling: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) that are allowed and whose score is from floor[i] to ceiling[i], with their scores."""
    norms = [np.sqrt((x.means[0] ** 2 + x.deviations[0] ** 2).sum(axis=1)) for x in (a, r)]
    slack = 1e-9 * norms[0] * norms[1].max(initial=0) + 1e-6
    low, high = floor - slack, ceiling + slack
    i = j = None
    for mean_a, dev_a, mean_r, dev_r in zip(a.means, a.deviations, r.means, r.deviations, strict=True):
        if i is None:  # most pairs are left: all at once
            middle, spread = mean_a @ mean_r.T, dev_a @ dev_r.T
            allowed &= (middle + spread >= low[:, None]) & (middle - spread <= high[:, None])
            if np.count_nonzero(allowed) * 16 < allowed.size:
                i, j = np.nonzero(allowed)
        else:
            keep = []
            for k in range(0, len(i), 16384):
                u, v = i[k : k + 16384], j[k : k + 16384]
                middle, spread = np.einsum("ij,ij->i", mean_a[u], mean_r[v]), np.einsum("ij,ij->i", dev_a[u], dev_r[v])
                keep.append((middle + spread >= low[u]) & (middle - spread <= high[u]))
            keep = np.concatenate([*keep, np.zeros(0, bool)])
            i, j = i[keep], j[keep]
    if i is None:
        scores = _exact(a, r)
        i, j = np.nonzero(allowed)
        scores = scores[i, j]
    else:
        scores = _exact(a, r, i, j)
    keep = (scores >= floor[i]) & (scores <= ceiling[i])
    return i[keep], j[keep], scores[keep]


class Best:
    """The first ``most`` of each key, by score and then by id."""

    def __init__(self, keys: int, most: int):
        self.most, self.floors = most, np.full(keys, -np.inf)
        self.key, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = (np.concatenate(x) for x in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate([first, [len(key)]])))
        keep = rank < self.most
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]
        full = rank == self.most - 1
        self.floors[key[full]] = score[full]  # a tie may still win by its id


def _found(block: int, anchors: Block, best: Best, targets: int, target_ids: np.ndarray, target_scores: np.ndarray) -> pa.RecordBatch:
    """target_ids, target_scores: by key, that is ``targets`` for each anchor."""
    anchor = best.key // targets
    columns = [np.full(len(anchor), block), anchor.astype(np.int32), anchors.ids[anchor], (best.key % targets).astype(np.int32), target_ids[best.key], target_scores[best.key], best.id, best.score]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in _FOUND.split(", ")])


def same_label(anchors: Block, rows: Iterator[Block], most: int) -> Best:
    """For each anchor, the ``most`` best other rows of its label."""
    best = Best(len(anchors.ids), most)
    for r in rows:
        for label in np.unique(anchors.labels):
            first, last = np.searchsorted(r.labels, label, "left"), np.searchsorted(r.labels, label, "right")
            chunk = np.flatnonzero(anchors.labels == label) if last > first else np.zeros(0, np.int64)
            s = r.rows(slice(first, last))
            for k in range(0, len(chunk), _AT_ONCE):
                at = chunk[k : k + _AT_ONCE]
                a = anchors.rows(at)
                i, j, scores = possible(a, s, best.floors[at], np.full(len(at), np.inf), a.ids[:, None] != s.ids[None, :])
                best.add(at[i], scores, s.ids[j])
    return best


def other_labels(anchors: Block, rows: Iterator[Block], limits: np.ndarray, has: np.ndarray, most: int, least: int, whole: int) -> Best:
    """For each anchor and each of its limits, the ``most`` best rows of other labels that score from least / whole of the limit up to it.

    limits: a row of scores for each anchor; has: where there is one.
    """
    targets = limits.shape[1]
    best = Best(limits.size, most)
    ceiling = np.where(has, limits, -np.inf).max(axis=1)
    lowest = np.where(has, limits * (least / whole), np.inf)
    for r in rows:
        for k in range(0, len(anchors.ids), _AT_ONCE):
            at = np.arange(k, min(k + _AT_ONCE, len(anchors.ids)))
            at = at[has[at].any(axis=1)]
            a = anchors.rows(at)
            floor = np.maximum(lowest[at], best.floors.reshape(limits.shape)[at]).min(axis=1)
            i, j, scores = possible(a, r, np.floor(floor), ceiling[at], a.labels[:, None] != r.labels[None, :])
            for t in range(targets):
                limit = limits[at[i], t]
                own = has[at[i], t] & (scores <= limit) & (whole * scores >= least * limit) & (scores >= best.floors[at[i] * targets + t])
                best.add(at[i[own]] * targets + t, scores[own], r.ids[j[own]])
    return best


def _integers(rows: DataFrame, scale: int) -> DataFrame:
    """id, label and the integer components of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("vector")
    )


def _write_blocks(rows: DataFrame, folder: str, width: int) -> int:
    """Each partition of ``rows`` as a block named by its number; how many vectors there are."""

    def run(batches):
        ids, labels, vectors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, width), np.int64)]
        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            labels.append(batch.column(1).to_numpy(zero_copy_only=False))
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            padded = np.zeros((batch.num_rows, width), np.int64)
            padded[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
            vectors.append(padded)
        block = summarized(np.concatenate(ids), np.concatenate(labels), np.concatenate(vectors))
        _files.write(f"{folder}/{TaskContext.get().partitionId()}", block.saved())
        yield pa.RecordBatch.from_arrays([pa.array([len(block.ids)])], names=["n"])

    _files.make_folder(folder)
    return rows.select("id", "label", "vector").mapInArrow(run, "n long").agg(F.sum("n")).first()[0]


def mine(rows: DataFrame, is_anchor: Column, *, scale: int = 256, positives: int = 5, negatives: int = 5, least: int = 80, whole: int = 100) -> DataFrame:
    """For each anchor row of ``rows`` (vec_id, label, embedding) and each of its positives, its hard negatives in order.

    A positive is one of the first ``positives`` other rows of the anchor's
    label; a hard negative is one of the first ``negatives`` rows of other labels
    that score from least / whole of the positive's score up to that score.
    """
    spark = rows.sparkSession
    folder = _shared.new_folder(spark, "hard-negatives")
    n, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = -(-max(width or 0, 1) // SEGMENTS[0]) * SEGMENTS[0]
    n_blocks = max(1, -(-n * width * 8 // BLOCK_BYTES))
    # copies of an anchor row are one; their ids spread over the blocks
    anchors = _integers(rows.where(is_anchor), scale).distinct()
    n_anchors = anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    _write_blocks(_integers(rows, scale).repartition(n_blocks), f"{folder}/rows", width)
    n_anchor_blocks = max(1, -(-n_anchors * max(1, width // 64) // ANCHORS_A_BLOCK))
    _write_blocks(anchors.repartitionById(n_anchor_blocks, F.pmod(F.xxhash64("id", "label", "vector"), F.lit(n_anchor_blocks)).cast("int")), f"{folder}/anchors", width)
    # With few anchor blocks several tasks share one, each with its share of the rows.
    pieces = min(n_blocks, max(1, -(-2 * spark.sparkContext.defaultParallelism // n_anchor_blocks)))

    def read(piece: int) -> Iterator[Block]:
        return (Block.load(f"{folder}/rows/{k}") for k in range(piece, n_blocks, pieces))

    def find_positives(batches):
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                block, piece = divmod(unit, pieces)
                own = Block.load(f"{folder}/anchors/{block}")
                none = np.zeros(len(own.ids), np.int64)
                yield _found(block, own, same_label(own, read(piece), positives), 1, none, none)

    def find_negatives(batches):
        for batch in batches:
            for one in batch.to_pylist():
                own = Block.load(f"{folder}/anchors/{one['block']}")
                limits, has, ids = np.zeros((len(own.ids), positives), np.int64), np.zeros((len(own.ids), positives), bool), np.zeros((len(own.ids), positives), np.int64)
                for x in one["targets"]:
                    at = x["anchor"], x["place"] - 1
                    limits[at], ids[at], has[at] = x["score"], x["id"], True
                yield _found(one["block"], own, other_labels(own, read(one["piece"]), limits, has, negatives, least, whole), positives, ids.ravel(), limits.ravel())

    def placed(found: DataFrame, keys: list[str], most: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)

    units = spark.range(0, n_anchor_blocks * pieces, numPartitions=n_anchor_blocks * pieces)
    first = placed(units.mapInArrow(find_positives, _FOUND), ["block", "anchor"], positives)
    # a block has at most ANCHORS_A_BLOCK anchors or so, so its targets are bounded
    targets = first.groupBy("block").agg(F.collect_list(F.struct("anchor", "place", "id", "score")).alias("targets"))
    shared = targets.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).repartitionById(n_anchor_blocks * pieces, (F.col("block") * pieces + F.col("piece")).cast("int"))
    second = placed(shared.mapInArrow(find_negatives, _FOUND), ["block", "anchor", "target"], negatives)
    result = second.select(
        "anchor_id", F.col("target_id").alias("positive_id"), F.col("place").alias("rank"), F.col("id").alias("negative_id"),
        F.col("target_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
    result = _shared.written(result, "hard-negatives-found")
    _shared.drop(spark, folder)
    return result


def with_moved_labels(rows: DataFrame, *, every: int = 7, labels: int = 10) -> DataFrame:
    """The rows, where those whose id ``every`` divides have the next label."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
