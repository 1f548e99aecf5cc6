"""Priced rows, totals, coverages and candidates derived from the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.plans._register import read

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


#: Rows of lineitem in a partition where each becomes a dozen lines of text that are sorted: some hundred megabytes.
ROWS = 50_000


def by_document(spark, sf_dir, rows):
    """``rows`` of lineitem, a document's in one partition, in as many partitions as their number asks for."""
    n = read(spark, sf_dir, "lineitem").count()  # from the footers
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)), "l_orderkey")


def line_items(spark, sf_dir, source=None, *more):
    """lineitem (or ``source``, which has columns ``more``) as priced rows; those with line number 7 are off by more than the tolerance."""
    money = "decimal(18,2)"
    ext = F.col("l_extendedprice").cast(money)
    cents, qty = (F.col("ext") * 100).cast("long"), F.col("l_quantity").cast("long")
    rows = (read(spark, sf_dir, "lineitem") if source is None else source).select(
        *more, F.col("l_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)).alias("item_id"),
        F.col("l_linenumber").alias("line_no"), F.col("l_linestatus").alias("section"), F.col("l_partkey").alias("part_id"), "l_quantity",
        ext.alias("ext"), F.col("l_discount").cast("decimal(4,2)").alias("discount"), F.round(ext * F.col("l_tax").cast("decimal(4,2)"), 2).cast(money).alias("tax"),
        (F.col("l_returnflag") == "R").alias("code_upgrade"), F.lit(0).cast(money).alias("oap"),
    )
    # A quotient to the cent, half up, in whole numbers.
    rows = rows.withColumn("unit_price", (F.floor((cents * 2 + qty) / (qty * 2)).cast("decimal(18,0)") / 100).cast(money))
    plain = (F.col("ext") + F.col("tax")).cast(money)
    off = F.round(F.lit("0.002").cast("decimal(6,3)") * plain, 2).cast(money) + 1
    rows = rows.withColumn("rcv", F.when(F.col("line_no") == 7, plain + off).otherwise(plain).cast(money))
    rows = rows.withColumn("dep", F.round(F.col("rcv") * F.col("discount"), 2).cast(money))
    return rows.withColumn("acv", (F.col("rcv") - F.col("dep")).cast(money)).withColumn("quantity", F.col("l_quantity").cast("decimal(18,4)")).drop("l_quantity", "discount")


ITEMS = """
r0 AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) AS item_id,
    l_linenumber AS line_no, l_linestatus AS section, l_partkey AS part_id, CAST(l_quantity AS DECIMAL(18,4)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS ext,
    CAST(l_discount AS DECIMAL(4,2)) AS discount, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2)) AS tax, l_returnflag = 'R' AS code_upgrade,
    CAST(CAST(round(l_extendedprice * 100) * 2 + l_quantity AS BIGINT) // CAST(l_quantity * 2 AS BIGINT) AS DECIMAL(18,2)) / 100 AS unit_price0
  FROM lineitem
), r1 AS (
  SELECT *, CAST(unit_price0 AS DECIMAL(18,2)) AS unit_price, CAST(CASE WHEN line_no = 7 THEN ext + tax + round(CAST(0.002 AS DECIMAL(6,3)) * (ext + tax), 2) + 1 ELSE ext + tax END AS DECIMAL(18,2)) AS rcv FROM r0
), r2 AS (
  SELECT *, CAST(round(rcv * discount, 2) AS DECIMAL(18,2)) AS dep FROM r1
), items AS (
  SELECT *, CAST(rcv - dep AS DECIMAL(18,2)) AS acv FROM r2
)
"""


def balanced_totals(spark, sf_dir):
    """Section totals that agree with the rows, and line-item totals of two documents in three (of those, each fifth is off by 10)."""
    rows = line_items(spark, sf_dir).groupBy("doc_id", "section").agg(F.sum("rcv").cast("decimal(18,2)").alias("rcv"))
    sections = rows.select("doc_id", F.lit("section").alias("type"), "section", F.lit(1).alias("ord"), "rcv")
    own = line_items(spark, sf_dir).where("not code_upgrade").groupBy("doc_id").agg(F.sum("rcv").cast("decimal(18,2)").alias("rcv")).where("doc_id % 3 > 0")
    whole = own.select("doc_id", F.lit("line_items").alias("type"), F.lit(None).cast("string").alias("section"), F.lit(2).alias("ord"), F.when(F.col("doc_id") % 5 == 0, F.col("rcv") + 10).otherwise(F.col("rcv")).cast("decimal(18,2)").alias("rcv"))
    return sections.unionByName(whole)


def coverages(spark, sf_dir):
    """Sums of a document's rows by section, for odd documents."""
    rows = line_items(spark, sf_dir).where("doc_id % 2 = 1").groupBy("doc_id", "section").agg(F.sum("rcv").cast("decimal(18,2)").alias("rcv"))
    return rows.select("doc_id", F.col("section").alias("coverage_id"), "rcv")


def field_candidates(spark, sf_dir):
    """Values of a field seen by several sources: a user's events; each eleventh has none, each thirteenth a blank."""
    raw = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, "  ").otherwise(F.concat(F.when(F.col("event_id") % 2 == 0, " ").otherwise(""), F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type"))))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit("kind").alias("field"), raw.alias("raw"), F.col("event_type").alias("source"), F.col("event_id").alias("ord"))


CANDIDATES = """
cand AS (
  SELECT user_id AS doc_id, 'kind' AS field, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '  ' ELSE CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END END AS raw, event_type AS source, event_id AS ord FROM events
)
"""
