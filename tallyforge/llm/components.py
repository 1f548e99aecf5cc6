"""Connected components by alternating large and small stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b), a > b after it: neighbours move to the smallest of them and the node."""
    if large:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
    else:
        both = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w"))
    low = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
    met = both.join(low, "v")
    if large:
        moved = met.where("w > v").select(F.col("w").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.where("w != m").select(F.col("w").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def _checksum(edges: DataFrame) -> tuple:
    """Count and two checksums, in any order, of distinct edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).collect()[0])


def connected_components(links: DataFrame, scratch: _shared.Scratch | None = None) -> DataFrame:
    """(id, component) for each vertex of links (a, b); the component is its smallest vertex.

    Each round is two group-and-join steps over all edges, written to the shared
    folder; it ends when a round changes nothing, after about log(n) rounds.
    The minimum is aggregated before rows move, and the join with it can be split.
    """
    scratch = scratch or _shared.Scratch(links.sparkSession, "components")
    edges = scratch.written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _checksum(edges)
    while True:
        edges = scratch.written(_star(_star(edges, True), False), "edges")
        now = _checksum(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
