"""MinHash near-duplicates by tensored banding, verified, as connected components.

Signatures: ``collections`` small collections of ``rows`` minhashes each. Every
pair of collections forms one table's key, so collections * rows minhashes
serve collections * (collections - 1) / 2 tables. A pair of similarity s is
missed only if at most one collection agrees, with p = s ** rows: at 0.8, with
the defaults, about once in 10,000 pairs exactly at the threshold, and about
once in 100,000 at 0.85.

1. One pass computes each document's distinct shingles, their fingerprint and
   the minhashes. Documents with equal sets are one vertex from here on, so
   copies cost nothing more.
2. Table keys that two or more vertices share are kept. An exact bound drops
   vertices and pairs that can't reach the threshold: a shingle that no other
   candidate has can't be common.
3. In each key the vertex with the fewest shingles of its own, so the most
   central one, is compared with the others (a star, not all pairs); similarity
   is confirmed on the full sets; links make components.
4. Vertices of keys that still hold several components are met once more, so
   that no link is lost: by an exact prefix filter over their shingles, rarest
   first. Two sets with a common part of the needed size share one of their
   first n - needed + 1 shingles, so pairs come from rare shingles, not from the
   key's whole membership; within a shingle, the largest component is not
   compared with itself.

Sets travel only for candidates. Hot keys are pre-aggregated (minimum, count)
and met in plain joins that can be split. Lineage is cut by written tables in
the shared folder.

Defined cases: null and empty texts have no shingles, n_shingles 0, are linked
with nothing and are kept; a text of fewer words than a shingle has its whole
sequence as one; rows that repeat a doc_id with the same text share the outcome;
a null doc_id never represents a group that has another id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm import _shared, _words
from tallyforge.llm.components import connected_components

COLLECTIONS = 12
ROWS = 2
#: Sets with more than this share of all rows are broadcast in the last join.
MOST_HELD = 2048


def _sets(texts: pa.Array, size: int):
    """For some documents at a time: the slice, hashes of all shingles and where each document's begin."""
    for part in _words.slices(texts, _words.SPACED, lower=True):
        yield part, *_words.windows(part.hashes(), part.of, size, short=True)


def _keys(collections: int, rows: int) -> np.ndarray:
    """Odd factors and shifts of the minhash functions."""
    n = np.arange(1, 2 * collections * rows + 1, dtype=np.uint64)
    found = _words.mix(n * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([found[::2] | np.uint64(1), found[1::2]])


def _print(own: np.ndarray) -> np.uint64:
    """What a fingerprint is mixed from, of distinct shingle hashes."""
    return (_words.mix(own) * np.uint64(0xD6E8FEB86659FD93)).sum() + np.uint64(len(own))


def signatures(docs: DataFrame, size: int, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, fp (fingerprint of the set; null if empty) and a hash for each collection."""

    def run(batches):
        factors, shifts = _keys(collections, rows)
        for batch in batches:
            counts, prints, sketches = [], [], []
            for part, shingles, of in _sets(_words.column(batch, "text"), size):
                n, fp = np.zeros(part.n_docs, np.int64), np.zeros(part.n_docs, np.uint64)
                for d in np.flatnonzero(np.diff(of)).tolist():
                    own = np.unique(shingles[of[d] : of[d + 1]])
                    n[d] = len(own)
                    fp[d] = _print(own)
                sketch = np.zeros((part.n_docs, collections), np.uint64)
                for c in range(collections):
                    for r in range(rows):
                        low = _words.over(of, shingles * factors[c * rows + r] + shifts[c * rows + r], np.minimum, 0)
                        sketch[:, c] = _words.mix(sketch[:, c] * np.uint64(0x9E3779B97F4A7C15) + low)
                counts.append(n)
                prints.append(_words.mix(fp))
                sketches.append(sketch)
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            fp = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
            flat = np.concatenate(sketches).view(np.int64).ravel() if sketches else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [_words.column(batch, "doc_id"), _words.column(batch, "row"), pa.array(n), pa.array(fp.view(np.int64), mask=n == 0), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * collections), pa.array(flat))],
                names=["doc_id", "row", "n_shingles", "fp", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, n_shingles long, fp long, sketch array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """The fingerprint as id and the sorted distinct shingle hashes of each row of ``docs`` (text)."""

    def run(batches):
        for batch in batches:
            found = [np.unique(shingles[of[d] : of[d + 1]]).view(np.int64) for part, shingles, of in _sets(_words.column(batch, "text"), size) for d in range(part.n_docs)]
            prints = _words.mix(np.array([_print(x.view(np.uint64)) for x in found], np.uint64)).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(prints), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))], names=["id", "shingles"])

    return docs.select("text").mapInArrow(run, "id long, shingles array<long>")


def table_keys(vertices: DataFrame, collections: int = COLLECTIONS) -> DataFrame:
    """(key, id) for each pair of collections of each vertex (id, sketch)."""
    pairs = [(i, j) for i in range(collections) for j in range(i + 1, collections)]
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("sketch")[i], F.col("sketch")[j]) for t, (i, j) in enumerate(pairs)])
    return vertices.select("id", F.explode(keys).alias("key"))


def _most(a: str, b: str, threshold: int):
    """Whether two sets can reach the threshold: n shingles, of which u are in no other candidate."""
    common = F.least(F.col(f"{a}.n") - F.col(f"{a}.u"), F.col(f"{b}.n") - F.col(f"{b}.u"))
    return 100 * common >= threshold * (F.col(f"{a}.n") + F.col(f"{b}.n") - common)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold."""
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
    return both.where(100 * F.col("common") >= threshold * (F.col("total") - F.col("common"))).select("a", "b")


def _across(still: DataFrame, sets: DataFrame, threshold: int, scratch: _shared.Scratch) -> DataFrame:
    """Pairs (a, b) of different components among ``still`` (id, n, u, component) that may reach the threshold."""
    tokens = sets.join(still, "id").select("id", "n", "u", "component", F.explode("shingles").alias("s"))
    # Counts are written before they are joined, so that a join that meets a very frequent shingle can be split.
    spread = scratch.written(tokens.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "spread")
    # Rarest first; only the longest prefix that any partner can ask for.
    order = Window.partitionBy("id").orderBy("df", "s")
    counted = tokens.join(spread, "s", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    prefix = counted.withColumn("at", F.row_number().over(order)).where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1) & (F.col("df") > 1))
    prefix = scratch.written(prefix.drop("df"), "prefix")
    # The largest component of each shingle.
    largest = prefix.groupBy("s", "component").agg(F.count("*").alias("many")).groupBy("s").agg(F.max(F.struct("many", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("s", F.col("top.component").alias("top"))
    left = scratch.written(prefix.join(scratch.written(largest, "largest"), "s").where("component != top"), "left")
    x, y = left.alias("x"), prefix.alias("y")
    needed = F.ceil((F.col("x.n") + F.col("y.n")) * threshold / (100 + threshold))
    fits = (F.col("x.at") <= F.col("x.n") - needed + 1) & (F.col("y.at") <= F.col("y.n") - needed + 1) & _most("x", "y", threshold)
    once = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("x.top")) | (F.col("x.id") < F.col("y.id")))
    return x.join(y, (F.col("x.s") == F.col("y.s")) & once & fits).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _told(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows with the component_id of their set (fp, copies, component_id), null for rows without one.

    A set of more than a MOST_HELD-th of all rows is broadcast: there are fewer than
    MOST_HELD of them. The others are joined by shuffle, rows without a set are not joined.
    """
    total = named.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") * MOST_HELD > total
    often_named, others = (named.where(w).select("fp", "component_id") for w in (often, ~often))
    some = rows.where(F.col("fp").isNotNull())
    bare = rows.where(F.col("fp").isNull()).withColumn("component_id", F.lit(None).cast("long"))
    columns = ["doc_id", "row", "n_shingles", "fp", "component_id"]
    rest = some.join(F.broadcast(often_named.select("fp")), "fp", "left_anti").join(others, "fp", "left")
    return bare.select(columns).unionByName(some.join(F.broadcast(often_named), "fp").select(columns)).unionByName(rest.select(columns))


def _placed(docs: DataFrame, size: int, threshold: int, collections: int, rows: int) -> DataFrame:
    """doc_id, row, n_shingles, component_id and kept of each row of ``docs``, written; what led to it is deleted."""
    scratch = _shared.Scratch(docs.sparkSession, "minhash")
    signed = scratch.written(signatures(docs, size, collections, rows), "signatures")
    # Vertices: one for each distinct set, named by its fingerprint.
    vertices = signed.where(F.col("fp").isNotNull()).groupBy(F.col("fp").alias("id")).agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    vertices = scratch.written(vertices, "vertices")

    keyed = table_keys(vertices, collections)
    shared = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    members = scratch.written(keyed.join(shared, "key", "left_semi"), "members")

    candidates = members.select("id").distinct().join(vertices.select("id", "doc"), "id")
    of = candidates.select(F.col("doc").alias("_doc")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(of, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi")
    # By the fingerprint, not the doc_id: that may be null or stand on several texts.
    sets = shingle_sets(texts, size).join(candidates.select("id"), "id").select("id", "shingles")
    sets = scratch.written(sets.dropDuplicates(["id"]), "sets")

    # How many of a set's shingles no other candidate has.
    lonely = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("df"), F.min("id").alias("id")).where("df = 1").groupBy("id").agg(F.count("*").alias("u"))
    bounds = sets.select("id", F.size("shingles").cast("long").alias("n")).join(lonely, "id", "left").select("id", "n", F.coalesce("u", F.lit(0)).alias("u"))
    bounds = bounds.where(100 * (F.col("n") - F.col("u")) >= threshold * F.col("n"))
    members = scratch.written(members.join(bounds, "id").select("key", "id", "n", "u"), "bounded")

    hubs = members.groupBy("key").agg(F.min(F.struct("u", "id", "n")).alias("hub"), F.count("*").alias("many")).where("many > 1").select("key", "hub.*")
    star = members.alias("x").join(hubs.alias("h"), "key").where((F.col("h.id") != F.col("x.id")) & _most("h", "x", threshold))
    tried = scratch.written(star.select(F.least("h.id", "x.id").alias("a"), F.greatest("h.id", "x.id").alias("b")).distinct(), "star")
    links = scratch.written(_verified(tried, sets, threshold), "links")
    grouped = connected_components(links, scratch)

    # What a star leaves open: pairs across components within a key.
    placed = members.join(grouped, "id", "left").select("key", "id", "n", "u", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    still = scratch.written(placed.join(mixed, "key", "left_semi").select("id", "n", "u", "component").distinct(), "open")
    across = _across(still, sets, threshold, scratch).join(tried, ["a", "b"], "left_anti")
    more = scratch.written(_verified(across, sets, threshold), "more")
    if not more.isEmpty():
        grouped = connected_components(links.unionByName(more), scratch)

    linked = vertices.select("id", "doc").join(grouped, "id")
    smallest = scratch.written(linked.groupBy("component").agg(F.min("doc").alias("component_id")), "smallest")
    linked = linked.join(smallest, "component").select("id", "component_id")
    named = vertices.select("id", "doc", "copies").join(linked, "id", "left").select(F.col("id").alias("fp"), "copies", F.coalesce("component_id", "doc").alias("component_id"))
    out = _told(signed.select("doc_id", "row", "n_shingles", "fp"), scratch.written(named, "named"))
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    out = _shared.written(out, "near-duplicates")
    scratch.drop()
    return out


def near_duplicates(docs: DataFrame, *, size: int = 5, threshold: int = 80, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept.

    ``threshold`` is the least similarity in percent.
    """
    return _placed(docs, size, threshold, collections, rows).drop("row")


def keep_one(docs: DataFrame, *, size: int = 5, threshold: int = 80, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that represent their group, with all their columns: by id and text, as an id may stand on several texts."""
    kept = _placed(docs, size, threshold, collections, rows).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("row").alias("_kept_row")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept_id"]) & (F.xxhash64(docs["text"]) == kept["_kept_row"]), "left_semi")
