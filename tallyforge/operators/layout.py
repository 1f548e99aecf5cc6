"""Words with boxes: lines, columns and grids of a page. All are group-and-sort aggregates within a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def words_to_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, block, line, text, x0, y0, x1, y1): the words of a line joined in their order, and the box round them."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("word", "x0", "text"))), lambda w: w["text"])
    return words.groupBy("doc_id", "page", "block", "line").agg(F.array_join(listed, " ").alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def assign_columns(words: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page, block, line, selector, description, confidence, y): table rows of an image from its words.

    regions: (doc_id, page, header_bottom, selector_left, selector_right,
    description_left, description_right), one for each image. A word belongs to
    the column that its centre is in; selector words need a letter or digit;
    words above the header's bottom are left out. A selector is the words joined
    without blanks; one that is no plausible code is blank, and rows without
    either are none.
    """
    met = words.join(regions, ["doc_id", "page"]).where(F.col("y0") >= F.col("header_bottom") - 2)
    center = (F.col("x0") + F.col("x1")) / 2
    own = (center >= F.col("selector_left")) & (center < F.col("selector_right")) & F.col("text").rlike(r"[\p{L}\p{N}]")
    described = (center >= F.col("description_left")) & (center < F.col("description_right"))
    joined = lambda c, glue: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("x0", "word", "text")))), lambda w: w["text"]), glue)
    rows = met.groupBy("doc_id", "page", "block", "line").agg(joined(own, "").alias("raw"), joined(described, " ").alias("description"), F.avg(F.when(own | described, F.col("confidence"))).alias("confidence"), F.min("y0").alias("y"))
    selector = F.when(F.col("raw").rlike(r"^[A-Za-z0-9][A-Za-z0-9+\-<>/.]{0,20}$"), F.col("raw")).otherwise("")
    return rows.withColumn("selector", selector).where("selector != '' or description != ''").select("doc_id", "page", "block", "line", "selector", "description", "confidence", "y")


def repeating_row_shapes(spans: DataFrame, min_repeats: int = 3, bucket: float = 3.0) -> DataFrame:
    """(doc_id, page, text): texts in rows of a grid: rows of two spans or more at places that recur on ``min_repeats`` rows of the page.

    spans: (doc_id, page, y, x0, text); a row is the spans of one rounded y, its
    shape their sorted x0 in buckets.
    """
    text = F.trim("text")
    rows = spans.where(text != "").groupBy("doc_id", "page", F.round("y").cast("long").alias("row")).agg(F.array_sort(F.collect_list(F.struct("x0", text.alias("text")))).alias("own")).where(F.size("own") >= 2)
    shaped = rows.withColumn("shape", F.transform("own", lambda s: F.round(s["x0"] / bucket).cast("long")))
    often = shaped.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page", "shape"))).where(F.col("n") >= min_repeats)
    return often.select("doc_id", "page", F.explode(F.transform("own", lambda s: s["text"])).alias("text")).distinct()
