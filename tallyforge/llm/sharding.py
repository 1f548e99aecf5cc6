"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

The ring has ``slots`` places; each shard owns the arcs that end in its virtual
nodes. A row's place is a hash of its text, so equal texts stand together. Each
shard takes at most its bound; what overflows a full shard continues clockwise
to the next owner with room. The bounds add up to the number of rows and differ
by one at most, so counts do too (law ``rows``), whatever the keys are.

No row is moved one by one. Rows are counted by place (``slots`` counts at
most); the walk around the ring over these counts gives ranges of ranks within
a place for each shard, a table bounded by slots + shards; a row's rank within
its place then says its shard and its slot. A place is ranked in ``parts``
pieces, dealt by a hash of the id, with their counts added up before it, so one
hot text doesn't meet in one task.

With one more shard, virtual nodes of the others stay where they are: rows move
to the new shard, or where a bound that shrinks by a shard's share pushes them.

Defined cases: a null text has 16 bytes, the checksum of an empty one and a
place of its own; a null id is a value like others; repeated rows are rows of
their own, in any order among themselves; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import _shared

SHARDS, SLOTS, VIRTUAL, PARTS = 40, 4096, 64, 64


def ring(shards: int, slots: int = SLOTS, virtual: int = VIRTUAL) -> list[int]:
    """The shard that owns each place: that of the next virtual node clockwise."""
    nodes: dict[int, int] = {}
    for shard in range(shards):
        for v in range(virtual):
            place = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") % slots
            nodes.setdefault(place, shard)  # the earlier shard keeps a place, so more shards change nothing else
    places = sorted(nodes)
    return [nodes[places[bisect.bisect_left(places, s) % len(places)]] for s in range(slots)]


def walk(counts: dict[int, int], owner: list[int], bounds: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, rows that the shard has before) around the ring.

    First each place fills its owner's room, in the ring's order; then the
    overflow of each continues clockwise from it.
    """
    slots, room, used, out, over = len(owner), list(bounds), [0] * len(bounds), [], []

    def put(place: int, start: int, n: int, shard: int) -> int:
        taken = min(n, room[shard])
        if taken:
            out.append((place, start, start + taken, shard, used[shard]))
            room[shard] -= taken
            used[shard] += taken
        return taken

    for place in sorted(counts):
        n = counts[place]
        taken = put(place, 0, n, owner[place])
        if taken < n:
            over.append((place, taken, n - taken))
    # Owners with room in the ring's order, so that a walk doesn't pass full ones again and again.
    for place, start, n in over:
        at = place
        while n:
            at = (at + 1) % slots
            taken = put(place, start, n, owner[at]) if room[owner[at]] else 0
            start, n = start + taken, n - taken
    return out


def _local(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table in the plan itself."""
    names = [x.split()[0] for x in schema.split(", ")]
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in schema.split(", ")))
    columns = [F.from_json(F.lit(str([r[i] for r in rows])), "array<long>").alias(n) for i, n in enumerate(names)]
    return spark.range(1).select(F.arrays_zip(*columns).alias("z")).select(F.explode("z").alias("z")).select(*(F.col(f"z.{x.split()[0]}").cast(x.split()[1]).alias(x.split()[0]) for x in schema.split(", ")))


def shard(docs: DataFrame, *, shards: int = SHARDS, slots: int = SLOTS, virtual: int = VIRTUAL, parts: int = PARTS, key: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.col("text")
    place = F.pmod(F.xxhash64(text if key is None else key), F.lit(slots))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        place.cast("int").alias("place"),
    ).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(parts)).cast("int"))
    pieces = _shared.written(rows.groupBy("place", "part").agg(F.count("*").alias("n")), "ring-pieces")  # slots * parts rows at most
    counts = {r["place"]: r["n"] for r in pieces.groupBy("place").agg(F.sum("n").alias("n")).collect()}  # slots rows at most
    n = sum(counts.values())
    bounds = [n // shards + (s < n % shards) for s in range(shards)]
    ranges = _local(spark, walk(counts, ring(shards, slots, virtual), bounds), "place int, low long, high long, shard int, before long")
    ahead = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("place", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    # Both tables are bounded by the parameters (slots * parts, slots + shards), so broadcasting them is safe.
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("place", "part").orderBy("doc_id", "size", "text_crc32")) - 1)
    ranked = ranked.join(F.broadcast(pieces), ["place", "part"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    placed = ranked.alias("r").join(F.broadcast(ranges).alias("g"), (F.col("r.place") == F.col("g.place")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("before") + F.col("rank") - F.col("low")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
