"""Arithmetic checks of priced rows against each other and against stated totals.

Money is decimal throughout. Tables are keyed by (doc_id, item_id); ``ord`` is
the reading order. Each function is one aggregation or join on doc_id, so a
table partitioned by it once keeps that layout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T

MONEY = "decimal(18,2)"


def within_tolerance(expected: Column, actual: Column, absolute: str = "0.05", relative: str = "0.001") -> Column:
    """Differs by ``absolute`` at most, or by that share of a nonzero expected amount."""
    difference = F.abs(expected - actual)
    return (difference <= F.lit(absolute).cast("decimal(9,4)")) | ((expected != 0) & (difference <= F.abs(expected) * F.lit(relative).cast("decimal(9,4)")))


def line_arithmetic_issues(items: DataFrame) -> DataFrame:
    """(doc_id, item_id, code): one row per check that a row fails; a null tax or O&P is 0, checks with another null input are skipped."""
    none = F.lit(0).cast(MONEY)
    built = (F.col("quantity") * F.col("unit_price") + F.coalesce("tax", none) + F.coalesce("oap", none)).cast("decimal(20,2)")
    slack = F.lit("0.05").cast("decimal(9,4)")
    checks = [
        ("rcv_mismatch", ~within_tolerance(built, F.col("rcv"))), ("acv_mismatch", ~within_tolerance(F.col("rcv") - F.col("dep"), F.col("acv"))),
        ("acv_over_rcv", F.col("acv") > F.col("rcv") + slack), ("dep_over_rcv", F.col("dep") > F.col("rcv") + slack),
    ]
    codes = F.filter(F.array(*(F.when(failed, code) for code, failed in checks)), lambda x: x.isNotNull())
    return items.select("doc_id", "item_id", F.explode(codes).alias("code"))


def section_total_check(items: DataFrame, totals: DataFrame) -> DataFrame:
    """Sums of rows per section against the section totals, where both exist."""
    sums = items.groupBy("doc_id", "section").agg(F.sum("rcv").cast(MONEY).alias("calculated"))
    stated = totals.where("type = 'section'").select("doc_id", "section", F.col("rcv").alias("stated"))
    return sums.join(stated, ["doc_id", "section"]).withColumn("ok", within_tolerance(F.col("stated"), F.col("calculated")))


def reconcile_documents(items: DataFrame, totals: DataFrame, coverages: DataFrame) -> DataFrame:
    """One row per document with rows: calculated, incurred, reported, difference, ok and a note.

    Calculated leaves code upgrades out. Reported is the first line-item total by
    ord, else the sum of the coverages if positive. ok is null if nothing is reported.
    """
    rows = items.groupBy("doc_id").agg(
        F.sum(F.when(~F.col("code_upgrade"), F.col("rcv"))).cast(MONEY).alias("calculated"), F.sum(F.when(F.col("code_upgrade"), F.col("rcv"))).cast(MONEY).alias("incurred")
    )
    first = totals.where("type = 'line_items'").groupBy("doc_id").agg(F.min_by("rcv", "ord").alias("stated"))
    covered = coverages.groupBy("doc_id").agg(F.sum("rcv").cast(MONEY).alias("covered"))
    met = rows.join(first, "doc_id", "left").join(covered, "doc_id", "left")
    reported = F.coalesce("stated", F.when(F.col("covered") > 0, F.col("covered")))
    out = met.select("doc_id", F.coalesce("calculated", F.lit(0).cast(MONEY)).alias("calculated"), F.coalesce("incurred", F.lit(0).cast(MONEY)).alias("incurred"), reported.cast(MONEY).alias("reported"))
    out = out.withColumn("difference", (F.col("reported") - F.col("calculated")).cast(MONEY)).withColumn("ok", within_tolerance(F.col("reported"), F.col("calculated")))
    explained = within_tolerance(F.col("reported"), F.col("calculated") + F.col("incurred"))
    return out.withColumn("note", F.when(F.col("ok").isNull(), "nothing reported").when(F.col("ok"), "reconciled").when(explained, "reported includes incurred items").otherwise("unexplained difference"))


def duplicate_keys(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return items.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def sequence_gaps(items: DataFrame, number: str = "line_no", listed: int = 5) -> DataFrame:
    """Documents whose sorted distinct numbers skip some: count of gaps and the first few as (after, before)."""
    order = Window.partitionBy("doc_id").orderBy(number)
    gaps = items.select("doc_id", number).distinct().withColumn("next", F.lead(number).over(order)).where(F.col("next") - F.col(number) > 1)
    found = F.slice(F.array_sort(F.collect_list(F.struct(F.col(number).alias("after"), F.col("next").alias("before")))), 1, listed)
    return gaps.groupBy("doc_id").agg(F.count("*").alias("gaps"), found.alias("first_gaps"))


def document_ids(df: DataFrame, prefix: str, order: Sequence[str], width: int = 4) -> DataFrame:
    """Adds ``local_id``: a counter per document in reading order, such as line_0001."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return df.withColumn("local_id", F.concat(F.lit(f"{prefix}_"), F.lpad(number.cast("string"), width, "0")))


def union_issues(*checks: DataFrame) -> DataFrame:
    """Issues (doc_id, item_id, code) of several checks in their order, with ids per document."""
    marked = [c.select("doc_id", "item_id", "code").withColumn("check_no", F.lit(i)) for i, c in enumerate(checks)]
    out = marked[0]
    for m in marked[1:]:
        out = out.unionByName(m)
    return document_ids(out, "issue", ["check_no", "item_id", "code"])


def document_status(items: DataFrame, issues: DataFrame, reconciled: DataFrame, severities: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Severity counts and status per document: failed, needs_review or success; rows of confidence .80 or more.

    Failed with a fatal issue or without rows; to be reviewed with an error, totals
    that don't agree, a row that needs review (items' needs_review, where given) or,
    where ``claims`` (doc_id, value) are given, no value at all.
    """
    severity = issues.join(severities, "code").groupBy("doc_id").pivot("severity", ["fatal", "error", "warning"]).agg(F.count("code"))
    review = F.count_if(F.col("needs_review")) if "needs_review" in items.columns else F.lit(0).cast("long")
    rows = items.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("confidence") >= 0.8).alias("high_confidence"), review.alias("to_review"))
    met = reconciled.select("doc_id", "ok").join(rows, "doc_id", "left").join(severity, "doc_id", "left").fillna(0, ["n_items", "high_confidence", "to_review", "fatal", "error", "warning"])
    bare = F.lit(False)
    if claims is not None:
        told = claims.where("trim(value) <> ''").select("doc_id").distinct().withColumn("told", F.lit(True))
        met, bare = met.join(told, "doc_id", "left"), F.col("told").isNull()
    status = F.when((F.col("fatal") > 0) | (F.col("n_items") == 0), "failed").when((F.col("error") > 0) | (F.col("to_review") > 0) | ~F.coalesce("ok", F.lit(True)) | bare, "needs_review").otherwise("success")
    return met.select("doc_id", "n_items", "high_confidence", "fatal", "error", "warning", status.alias("status"))


def propagate_issues(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Adds needs_review and appends the issues' codes to ``reasons``, without duplicates and sorted."""
    codes = issues.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    met = items.join(codes, ["doc_id", "item_id"], "left")
    none = F.array().cast("array<string>")
    return met.select(*(c for c in items.columns if c != "reasons"), F.array_union(F.coalesce("reasons", none), F.coalesce("codes", none)).alias("reasons"), F.col("codes").isNotNull().alias("needs_review"))


SEVERITIES = ("fatal", "error", "warning", "info")


def issue_rollup(issues: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Counts by code per document, a column for each, and by severity where the issues tell it (a column of that name)."""
    told = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES] if "severity" in issues.columns else []
    return issues.groupBy("doc_id").agg(*(F.count_if(F.col("code") == c).alias(c) for c in codes), *told)


def conflicting_values(candidates: DataFrame) -> DataFrame:
    """(doc_id, field) with more than one distinct trimmed lower-case value, blank ones aside: how many, and the raw values sorted."""
    said = F.lower(F.nullif(F.trim("raw"), F.lit("")))
    return candidates.groupBy("doc_id", "field").agg(F.countDistinct(said).alias("n_values"), F.sort_array(F.collect_set("raw")).alias("raw_values")).where("n_values > 1")


def field_issues(docs: DataFrame, candidates: DataFrame, values: DataFrame, required: Sequence[tuple[str, str]], exempt: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(doc_id, field, code, severity): fields with conflicting raw values, and required ones without a value.

    docs: (doc_id, profile); candidates: (doc_id, field, raw); values: the selected
    (doc_id, field, value); required: (field, severity). Conflicts are warnings.
    A missing field has the severity that ``required`` gives it, or 'info' where
    ``exempt`` (profile, field) says that a profile's documents don't state it;
    profiles meet trimmed and in lower case, a null one is exempt from nothing.
    """
    conflicts = conflicting_values(candidates).select("doc_id", "field", F.lit("conflicting_value").alias("code"), F.lit("warning").alias("severity"))
    profile = F.lower(F.trim("profile"))
    rules = []
    for field, severity in required:
        free = [p.strip().lower() for p, f in exempt if f == field]
        rules.append(F.struct(F.lit(field).alias("field"), F.when(profile.isin(free), "info").otherwise(severity).alias("severity")))
    due = docs.select("doc_id", F.explode(F.array(*rules)).alias("r")).select("doc_id", "r.field", F.lit("missing_value").alias("code"), "r.severity")
    there = values.where(F.trim("value") != "").select("doc_id", "field").distinct()
    return conflicts.unionByName(due.join(there, ["doc_id", "field"], "left_anti").select(*conflicts.columns))


def coverage_gaps(expected: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Expected keys that the manifest lacks, and its rows with a bad status, a failure without error or a skip without reason."""
    missing = expected.select(key).distinct().join(manifest, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    problem = (
        F.when(~F.col("status").isin("processed", "failed", "skipped"), "invalid status").when((F.col("status") == "failed") & F.col("error").isNull(), "failed without error")
        .when((F.col("status") == "skipped") & F.col("reason").isNull(), "skipped without reason")
    )
    return missing.unionByName(manifest.select(key, problem.alias("problem")).where("problem is not null"))


def majority_value(candidates: DataFrame, authority: DataFrame, value: Column | None = None, sure: float = 0.98) -> DataFrame:
    """The most frequent value per (doc_id, field), by default of the raw text with white space normalized; its case stays.

    Values that normalize to nothing don't count: if none is left, the value is
    null with confidence .3. Ties go to the value with the best source authority
    (lowest rank), then to the first seen. Confidence is ``sure`` if unanimous,
    else the share times it and .6 at least.
    """
    value = T.norm_ws(F.col("raw")) if value is None else value
    ranked = candidates.join(authority, "source", "left").withColumns({"rank": F.coalesce("rank", F.lit(99)), "value": F.nullif(value, F.lit(""))})
    counts = ranked.groupBy("doc_id", "field", "value").agg(F.count("*").alias("n"), F.min("rank").alias("rank"), F.min("ord").alias("ord"))
    has = F.col("value").isNotNull()
    best = F.max_by(F.struct("value", "n"), F.when(has, F.struct("n", -F.col("rank"), -F.col("ord"))))
    out = counts.groupBy("doc_id", "field").agg(best.alias("best"), F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("total"))
    share = F.col("best.n") / F.col("total")
    confidence = F.when(F.col("total") == 0, 0.3).when(F.col("best.n") == F.col("total"), sure).otherwise(F.greatest(F.lit(0.6), share * sure))
    return out.select("doc_id", "field", F.col("best.value").alias("value"), F.coalesce("best.n", F.lit(0).cast("long")).alias("n"), "total", confidence.alias("confidence"))


def last_event_per_key(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest row of each key, by an order that ends in a unique column."""
    newest = events.groupBy(key).agg(F.max(F.struct(*order, *[c for c in events.columns if c not in (*order, key)])).alias("e"))
    return newest.select(key, "e.*").select(*events.columns)


def attach_context(items: DataFrame, *lookups: tuple[DataFrame, str]) -> DataFrame:
    """Optional lookups, each (table, key); what is missing stays null."""
    for table, key in lookups:
        items = items.join(table, key, "left")
    return items
