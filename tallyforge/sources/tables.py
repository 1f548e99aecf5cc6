"""Readers and writers: document stores, nested JSON, catalogs in CSV, flat exports, snapshots and incremental imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tallyforge.functions import text as T


def read_document_store(spark: SparkSession, path: str, *, recursive: bool = True, glob: str = "*") -> DataFrame:
    """(path, slug, sha, n_bytes, modified) of the files under a path; contents are hashed where they are read and not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select("path", T.slug(name).alias("slug"), F.sha2("content", 256).alias("sha"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))


def content_hashes(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, sha) of a table's texts; null counts as empty."""
    return docs.select(key, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("sha"))


def duplicate_sources(hashes: DataFrame, key: str) -> DataFrame:
    """Adds ``duplicate_of``: the smallest key with the same hash, null for that one itself.

    The smallest keys are pre-aggregated, so a hash that many rows share is one row when it is joined back.
    """
    first = hashes.groupBy("sha").agg(F.min(key).alias("first"))
    met = hashes.join(first, "sha")
    return met.select(key, "sha", F.when(F.col("first") != F.col(key), F.col("first")).alias("duplicate_of"))


def version_slugs(sources: DataFrame, name: Column, key: str, width: int = 65_536) -> DataFrame:
    """(key, version_slug): later sources of one slug get -v2, -v3 ... in the order of their keys, which are whole numbers. Take copies out first.

    A slug is numbered in ranges of ``width`` keys, the counts of those before added up, so a hot one is not one task.
    """
    rows = sources.select(key, T.slug(name).alias("slug")).withColumn("range", F.floor(F.col(key) / width))
    counts = rows.groupBy("slug", "range").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("slug").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("slug", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("slug", "range").orderBy(key))).join(counts, ["slug", "range"]).withColumn("n", F.col("r") + F.col("ahead"))
    return numbered.select(key, F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-v"), F.col("n").cast("string"))).alias("version_slug"))


def nest(items: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per document with its items as a sorted array of structs."""
    names = [*order, *(f for f in fields if f not in order)]
    return items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("items"))


def write_nested(nested: DataFrame, path: str) -> None:
    nested.write.mode("overwrite").json(path)


def read_estimates(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Nested documents under a fixed schema; a document that breaks it ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def unnest(nested: DataFrame, key: str) -> DataFrame:
    """The child table: one row per item; documents without items have none."""
    return nested.select(key, F.inline("items"))


def read_catalog_csv(spark: SparkSession, path: str, schema: StructType, *, required: Sequence[str], identity: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of a CSV whose header must match the schema.

    Texts are trimmed. A row with a blank required field, or one whose identity stands more than once, is a
    violation: (identity, reason, n).
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    rows = raw.select(*(F.trim(f.name).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name) for f in schema))
    blank = F.lit(False)
    for c in required:
        blank = blank | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    named = rows.withColumns({"identity": F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity)), "blank": blank})
    counts = named.groupBy("identity", "blank").agg(F.count("*").alias("n")).where("blank or n > 1")
    violations = counts.select("identity", F.when(F.col("blank"), "blank field").otherwise("duplicate identity").alias("reason"), "n")
    repeated = counts.where("not blank").select("identity")
    return named.where("not blank").join(repeated, "identity", "left_anti").select(*rows.columns), violations


def flat_items(items: DataFrame, sections: DataFrame, areas: DataFrame, *, section: str, area: str, lists: Sequence[str] = ()) -> DataFrame:
    """One row per item with what its section and area say; array columns are joined by "; "."""
    met = items.join(sections, section, "left").join(areas, area, "left")
    return met.withColumns({c: F.concat_ws("; ", c) for c in lists}) if lists else met


def write_flat(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def incremental_import(source: DataFrame, manifest: DataFrame, key: str, failure: Column, *, force: bool = False) -> DataFrame:
    """(key, status, reason) of every source: skipped if the manifest has it processed, failed with the reason that ``failure`` gives, else processed."""
    done = manifest.where("status = 'processed'").select(key).distinct().withColumn("done", F.lit(True))
    met = source.join(done, key, "left")
    skipped = F.lit(False) if force else F.coalesce("done", F.lit(False))
    status = F.when(skipped, "skipped").when(failure.isNotNull(), "failed").otherwise("processed")
    return met.select(key, status.alias("status"), F.when(skipped, "already processed").otherwise(failure).alias("reason"))


def replace_table(df: DataFrame, path: str, *, partition: str | None = None) -> None:
    """The whole table anew, or with ``partition`` only the partitions that ``df`` has rows of."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    writer.parquet(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Existing output is left alone."""
    df.write.mode("ignore").parquet(path)


def snapshot(df: DataFrame, root: str, at: int) -> None:
    """A copy under a number that grows with time; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{root}/snapshot={at}")


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest copy; the others are pruned as partitions."""
    every = spark.read.parquet(root)
    newest = every.agg(F.max("snapshot")).collect()[0][0]
    return every.where(F.col("snapshot") == F.lit(newest)).drop("snapshot")


def partitioned_report(nested: DataFrame, stated: DataFrame, key: str, amount: str) -> DataFrame:
    """One row per document over all nested outputs: items, their sum, a status and whether the stated total (key, stated) is met."""
    total = F.aggregate("items", F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + x[amount].cast("decimal(18,2)")).cast("decimal(28,2)"))
    own = nested.select(key, F.size("items").alias("n_items"), total.alias("total"))
    met = stated.join(own, key, "left").withColumns({"n_items": F.coalesce("n_items", F.lit(0)), "total": F.coalesce("total", F.lit(0).cast("decimal(28,2)"))})
    label = F.when(F.col("n_items") == 0, "empty").when(F.abs(F.col("total") - F.col("stated")) <= F.lit("0.05").cast("decimal(4,2)"), "reconciled").otherwise("open")
    return met.select(key, "n_items", "total", label.alias("label"))
