"""Queries of the catalog and review operators; orders stand for reviewed rows, parts for a catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import catalog as C
from tallyforge.operators import review as V
from tallyforge.plans._register import query, read

#: The same expressions for Spark and for the SQL.
_ITEM = [
    "o_custkey AS doc_id", "o_orderkey AS item_id", "o_orderkey AS ord", "o_orderpriority AS section", "o_orderpriority AS group_name",
    "CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'O' THEN 'unreviewed' ELSE 'rejected' END AS status",
    "CASE WHEN o_custkey % 9 <> 0 THEN o_orderpriority END AS category", "CASE WHEN o_orderkey % 11 <> 0 THEN concat('S', CAST(o_orderkey % 40 AS VARCHAR(10))) END AS selector",
    "CASE WHEN o_orderkey % 3 <> 0 THEN '+' END AS activity", "o_custkey % 2 = 0 AS activity_waived", "CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice ELSE 0 END AS quantity",
    "CASE WHEN o_orderkey % 17 <> 0 THEN 'EA' END AS unit", "o_orderkey % 19 = 0 AS has_fatal", "o_orderkey % 5 = 0 AS mapped", "o_orderkey % 7 = 0 AS skipped",
    "CASE WHEN o_orderkey % 23 = 0 THEN ' ' ELSE o_orderpriority END AS description",
]
_BLOCKS = """concat_ws('; ', CASE WHEN category IS NULL THEN 'no category' END, CASE WHEN selector IS NULL THEN 'no selector' END, CASE WHEN activity IS NULL AND NOT activity_waived THEN 'no activity' END,
  CASE WHEN quantity <= 0 THEN 'no quantity' END, CASE WHEN unit IS NULL THEN 'no unit' END, CASE WHEN has_fatal THEN 'fatal error' END)"""
_ITEMS = "WITH i0 AS (SELECT " + ", ".join(_ITEM) + " FROM orders), items AS (SELECT *, " + _BLOCKS + " AS blocks FROM i0) "
_RECORD = [
    "p_partkey AS key", "p_brand AS category", "CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN lower(p_type) ELSE p_type END AS selector",
    "CASE p_partkey % 19 WHEN 0 THEN concat(substr(p_name, 1, 5), '...') WHEN 1 THEN concat(p_name, ' SF') WHEN 2 THEN ' ' ELSE p_name END AS description", "p_size % 7 = 0 AS needs_review", "p_size % 5 = 0 AS uncertain",
    "CASE WHEN p_size % 4 = 0 THEN 0.5 ELSE 0.9 END AS confidence",
]
_CATALOG = "WITH catalog AS (SELECT " + ", ".join(_RECORD) + " FROM part) "


def _items(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr(*_ITEM)
    return V.approval_block_reasons(rows.withColumnRenamed("group_name", "group"))


def _catalog(spark, sf_dir):
    return read(spark, sf_dir, "part").selectExpr(*_RECORD)


@query("p5_eligible_records", _CATALOG + "SELECT key, category, selector FROM catalog WHERE NOT needs_review AND NOT uncertain")
def p5(spark, sf_dir):
    return C.eligible_records(_catalog(spark, sf_dir)).select("key", "category", "selector")


@query("p6_search_catalog", _CATALOG + "SELECT key, category, description FROM catalog WHERE NOT needs_review AND (contains(description, 'widget') OR contains(upper(category), 'WIDGET') OR contains(upper(selector), 'WIDGET'))")
def p6(spark, sf_dir):
    rows = _catalog(spark, sf_dir).withColumn("aliases", F.array().cast("array<string>"))
    return C.search_catalog(rows, query="widget", needs_review=False).select("key", "category", "description")


@query(
    "p7_bucket_unmapped",
    _ITEMS + """SELECT item_id, CASE WHEN mapped THEN 'mapped' WHEN skipped THEN 'skipped' WHEN trim(description) = '' THEN 'missing description' WHEN quantity <= 0 THEN 'bad quantity'
    WHEN unit IS NULL THEN 'missing unit' WHEN group_name IS NULL THEN 'unresolved group' ELSE 'eligible' END AS bucket FROM items""",
)
def p7(spark, sf_dir):
    return V.bucket_unmapped(_items(spark, sf_dir)).select("item_id", "bucket")


@query("p8_approval_block_reasons", _ITEMS + "SELECT item_id, blocks FROM items")
def p8(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", F.concat_ws("; ", "block_reasons").alias("blocks"))


@query(
    "p13_quality_flags",
    _CATALOG + """SELECT key, concat_ws('; ', CASE WHEN description LIKE '%...' THEN 'truncated' END, CASE WHEN confidence < 0.85 THEN 'low confidence' END, CASE WHEN regexp_matches(selector, '[a-z]') THEN 'lower case in key' END, CASE WHEN description LIKE '% SF' THEN 'trailing unit' END,
    CASE WHEN selector = '' OR trim(description) = '' THEN 'empty' END) AS flags, selector = '' OR trim(description) = '' AS review_only FROM catalog""",
)
def p13(spark, sf_dir):
    return C.quality_flags(_catalog(spark, sf_dir)).select("key", F.concat_ws("; ", "flags").alias("flags"), "review_only")


@query(
    "a12_catalog_stats",
    _CATALOG + """SELECT 'category' AS kind, category AS value, count(*) AS n, count(*) FILTER (needs_review) AS n_review FROM catalog GROUP BY category
    UNION ALL SELECT 'selector', selector, count(*), count(*) FILTER (needs_review) FROM catalog GROUP BY selector UNION ALL SELECT 'all', NULL, count(*), count(*) FILTER (needs_review) FROM catalog""",
)
def a12(spark, sf_dir):
    return C.catalog_stats(_catalog(spark, sf_dir), "category", "selector")


@query("a14_recommendation_stats", "SELECT event_type AS action, count(*) AS n, count(DISTINCT user_id) AS items, (sum(event_id % 7) * 1000 // count(*))::BIGINT AS mean_candidates FROM events GROUP BY 1")
def a14(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("action"), F.col("user_id").alias("item_id"), (F.col("event_id") % 7).alias("candidates"))
    return V.recommendation_stats(events)


@query("a21_prior_uses", _ITEMS + "SELECT category, selector, count(*) AS uses FROM items WHERE status = 'approved' GROUP BY ALL")
def a21(spark, sf_dir):
    return C.prior_uses(_items(spark, sf_dir))


_CENTS = "CAST(round(value * 100) AS BIGINT)"


@query("a24_timing_summary", "SELECT event_type, count(v) AS n, sum(v)::BIGINT AS total, avg(v) AS mean, quantile_cont(v, 0.5)::DOUBLE AS median, min(v) AS least, max(v) AS most FROM (SELECT event_type, " + _CENTS + " AS v FROM events) GROUP BY 1")
def a24(spark, sf_dir):
    return V.timing_summary(read(spark, sf_dir, "events").selectExpr("event_type", f"{_CENTS} AS v"), "event_type", "v")


_EDITS = "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS new_status, CASE WHEN item_id % 10 = 0 THEN ' ' ELSE 'checked' END AS reason FROM items WHERE item_id % 3 = 0"


def _bulk(spark, sf_dir):
    items = _items(spark, sf_dir)
    edits = items.where("item_id % 3 = 0").selectExpr("item_id", "CASE WHEN item_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS new_status", "CASE WHEN item_id % 10 = 0 THEN ' ' ELSE 'checked' END AS reason")
    return V.bulk_apply(items, edits)


@query("b1_bulk_applied", _ITEMS + ", edits AS (" + _EDITS + ") SELECT item_id, new_status AS status, reason FROM edits JOIN items USING (item_id) WHERE trim(reason) <> '' AND (new_status <> 'approved' OR blocks = '')")
def b1(spark, sf_dir):
    return _bulk(spark, sf_dir)[0]


@query("b1_bulk_blocked", _ITEMS + ", edits AS (" + _EDITS + ") SELECT item_id, new_status, CASE WHEN trim(reason) = '' THEN 'no reason' ELSE blocks END AS blocked_by FROM edits JOIN items USING (item_id) WHERE trim(reason) = '' OR (new_status = 'approved' AND blocks <> '')")
def b1_blocked(spark, sf_dir):
    return _bulk(spark, sf_dir)[1].withColumn("blocked_by", F.concat_ws("; ", "blocked_by"))


_FIELD_EDITS = [
    "event_id AS edit_id", "ts AS at", "user_id AS item_id", "CASE event_id % 4 WHEN 0 THEN 'category' WHEN 1 THEN 'selector' WHEN 2 THEN 'unit' ELSE 'description' END AS field",
    "CASE WHEN event_id % 6 <> 0 THEN event_type END AS value", "'r' AS reviewer", "CASE WHEN event_id % 10 = 0 THEN ' ' WHEN event_id % 15 <> 0 THEN 'seen' END AS reason",
]
_HELD = "SELECT item_id, 'unit' AS field, unit AS original, 'LF' AS value, 'q' AS reviewer, 'before' AS reason FROM items WHERE item_id % 2 = 0"
_FIELDS = _ITEMS + ", e AS (SELECT " + ", ".join(_FIELD_EDITS) + " FROM events), h AS (" + _HELD + """),
m AS (SELECT e.*, CASE field WHEN 'category' THEN i.category WHEN 'selector' THEN i.selector ELSE i.unit END AS original, i.item_id IS NOT NULL AS there FROM e LEFT JOIN items i USING (item_id)),
t AS (SELECT m.*, row_number() OVER w AS n, lag(m.value) OVER w AS earlier, row_number() OVER (PARTITION BY m.item_id, m.field ORDER BY m.at DESC, m.edit_id DESC) AS last, h.item_id IS NOT NULL AS has, h.value AS held
  FROM m LEFT JOIN h ON h.item_id = m.item_id AND h.field = m.field WHERE m.field <> 'description' AND trim(m.reason) <> '' AND there WINDOW w AS (PARTITION BY m.item_id, m.field ORDER BY m.at, m.edit_id))
"""


def _field_edits(spark, sf_dir):
    """Events as edits of orders: a fourth of a field that can't be edited, some without reason or without an order; each second order has an edit from before."""
    items = _items(spark, sf_dir)
    held = items.where("item_id % 2 = 0").selectExpr("item_id", "'unit' AS field", "unit AS original", "'LF' AS value", "'q' AS reviewer", "'before' AS reason", "TIMESTAMP'2000-01-01' AS at")
    return V.edit_fields(items, held, read(spark, sf_dir, "events").selectExpr(*_FIELD_EDITS), ["category", "selector", "unit"])


@query("b1_field_overrides", _FIELDS + "SELECT item_id, field, original, value, reviewer, reason FROM t WHERE last = 1 UNION ALL SELECT item_id, field, original, value, reviewer, reason FROM h WHERE (item_id, field) NOT IN (SELECT (item_id, field) FROM t)")
def b1_overrides(spark, sf_dir):
    return _field_edits(spark, sf_dir)[0].drop("at")


@query("b1_field_history", _FIELDS + "SELECT edit_id, item_id, field, CASE WHEN n > 1 THEN earlier WHEN has THEN held ELSE original END AS before, value AS after, reason FROM t")
def b1_history(spark, sf_dir):
    return _field_edits(spark, sf_dir)[1].drop("at", "reviewer")


@query("b1_field_refused", _FIELDS + "SELECT edit_id, CASE WHEN field = 'description' THEN 'field is not editable' WHEN coalesce(trim(reason), '') = '' THEN 'no reason' ELSE 'unknown item' END AS why FROM m WHERE field = 'description' OR coalesce(trim(reason), '') = '' OR NOT there")
def b1_refused(spark, sf_dir):
    return _field_edits(spark, sf_dir)[2]


_TASKS = [
    "o_orderkey AS task_id", "o_custkey AS ord", "CASE WHEN o_orderkey % 3 <> 0 THEN 'review_required' ELSE 'done' END AS state", "CASE o_orderkey % 4 WHEN 0 THEN 'committed' WHEN 1 THEN 'open' END AS commit_state",
    "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 2 = 0 END AS has_row", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 11 = 0 END AS uncertain",
    "CASE WHEN o_custkey % 2 = 0 THEN 'chosen' END AS selected_category", "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'seen' END AS observed_category", "o_orderpriority AS category",
    "CASE WHEN o_custkey % 5 = 0 THEN 'S1' END AS selected_selector", "CASE WHEN o_custkey % 7 = 0 THEN 'S2' END AS observed_selector", "o_orderstatus AS selector",
    "CASE WHEN o_custkey % 4 = 0 THEN 'low' END AS review_reason", "CASE WHEN o_custkey % 6 = 0 THEN 'stopped' END AS stop_detail", "'unverified' AS trust_state",
]


@query(
    "u2_committed_queue",
    "WITH t AS (SELECT " + ", ".join(_TASKS) + """ FROM orders) SELECT task_id, ord, coalesce(nullif(selected_category, ''), nullif(observed_category, ''), nullif(category, '')) AS category, coalesce(selected_selector, observed_selector, selector) AS selector, coalesce(review_reason, stop_detail, trust_state) AS reason, trust_state
    FROM t WHERE state = 'review_required' AND NOT coalesce(uncertain, false) AND (commit_state = 'committed' OR (commit_state IS NULL AND coalesce(has_row, false)))""",
)
def u2_committed(spark, sf_dir):
    return C.committed_queue(read(spark, sf_dir, "orders").selectExpr(*_TASKS))


@query("b6_export_approved", _ITEMS + "SELECT doc_id, section, string_agg(item_id::VARCHAR, ';' ORDER BY ord, item_id) AS item_ids, count(*) AS n FROM items WHERE status = 'approved' AND blocks = '' GROUP BY ALL")
def b6(spark, sf_dir):
    return V.export_approved(_items(spark, sf_dir))[0].withColumn("item_ids", F.concat_ws(";", F.transform("item_ids", lambda x: x.cast("string"))))


@query("b6_export_excluded", _ITEMS + "SELECT doc_id, item_id, CASE WHEN status = 'approved' THEN blocks ELSE status END AS reason FROM items WHERE NOT (status = 'approved' AND blocks = '') AND status <> 'unreviewed'")
def b6_excluded(spark, sf_dir):
    return V.export_approved(_items(spark, sf_dir))[1]


@query(
    "b8_coverage_of_sources",
    "WITH s AS (SELECT l_partkey AS item_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT p_partkey AS item_id, coalesce(n, 0) AS n FROM part LEFT JOIN s ON item_id = p_partkey WHERE coalesce(n, 0) <> 1",
)
def b8(spark, sf_dir):
    outputs = read(spark, sf_dir, "lineitem").select(F.array("l_partkey").alias("sources"))
    return V.coverage_of_sources(outputs, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id")))


@query(
    "b9_learn_from_outcomes",
    "SELECT user_id AS item_id, 'K' || (event_id % 50) AS key, event_type = 'purchase' AS reusable FROM events WHERE event_type IN ('purchase', 'error') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def b9(spark, sf_dir):
    outcomes = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), F.concat(F.lit("K"), (F.col("event_id") % 50).cast("string")).alias("key"), (F.col("event_type") == "purchase").alias("verified"),
        F.col("event_type").isin("purchase", "error").alias("committed"), F.lit(True).alias("began_unmapped"), "ts", F.col("event_id").alias("outcome_id"),
    )
    return V.learn_from_outcomes(outcomes)


@query(
    "j9_apply_overrides",
    """SELECT o_orderkey AS item_id, o_orderstatus AS machine_status, o_orderpriority AS machine_priority, CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 8 <> 0 THEN 'reviewed' END ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 6 = 0 THEN 'first' ELSE o_orderpriority END AS priority FROM orders""",
)
def j9(spark, sf_dir):
    items = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    one = items.where("item_id % 4 = 0").select("item_id", F.lit("status").alias("field"), F.when(F.col("item_id") % 8 != 0, "reviewed").alias("value"))
    two = items.where("item_id % 6 = 0").select("item_id", F.lit("priority").alias("field"), F.lit("first").alias("value"))
    return V.apply_overrides(items, one.unionByName(two), ["status", "priority"])


@query("j19_unit_conflicts", "WITH v AS (SELECT DISTINCT p_brand AS b, p_type AS t, p_size % 3 AS u FROM part WHERE p_partkey % 4 = 0) SELECT p_partkey AS item_id FROM part WHERE EXISTS (SELECT 1 FROM v WHERE b = p_brand AND t = p_type AND u <> p_size % 3)")
def j19(spark, sf_dir):
    items = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("trade"), F.col("p_type").alias("component"), (F.col("p_size") % 3).alias("unit"))
    return C.unit_conflicts(items, items.where("item_id % 4 = 0")).select("item_id")


@query(
    "a18_import_report",
    """WITH m AS (SELECT source AS category, count(*) AS sources, count(*) FILTER (doc_id % 97 = 0) AS failed FROM documents GROUP BY 1),
    r AS (SELECT source AS category, count(*) AS raw_rows, count(DISTINCT lang) AS unique_keys, count(*) FILTER (n_chars < 200) AS review_rows FROM documents GROUP BY 1)
    SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN raw_rows = 0 THEN 'empty' WHEN review_rows > 0 THEN 'needs_review' ELSE 'complete' END AS status FROM m JOIN r USING (category)""",
)
def a18(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    manifest = docs.select(F.col("source").alias("category"), F.when(F.col("doc_id") % 97 == 0, "failed").otherwise("processed").alias("status"))
    return C.import_report(manifest, docs.select(F.col("source").alias("category"), F.col("lang").alias("key"), (F.col("n_chars") < 200).alias("needs_review")))
