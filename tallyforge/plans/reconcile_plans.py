"""Queries of the arithmetic checks and of the aggregates around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import reconcile as R
from tallyforge.plans import fixtures as X
from tallyforge.plans._register import query, read

_W = "WITH " + X.ITEMS
_TOL = "(abs({e} - {a}) <= 0.05 OR ({e} <> 0 AND abs({e} - {a}) <= abs({e}) * 0.001))"
_ISSUES = (
    ", issues AS (SELECT doc_id, item_id, unnest(list_filter([CASE WHEN NOT " + _TOL.format(e="CAST(round(quantity * unit_price + tax, 2) AS DECIMAL(20,2))", a="rcv") + " THEN 'rcv_mismatch' END, CASE WHEN NOT "
    + _TOL.format(e="(rcv - dep)", a="acv") + " THEN 'acv_mismatch' END, CASE WHEN acv > rcv + 0.05 THEN 'acv_over_rcv' END, CASE WHEN dep > rcv + 0.05 THEN 'dep_over_rcv' END], lambda x: x IS NOT NULL)) AS code FROM items)"
)
_RECON = (
    """, tot AS (SELECT doc_id, CAST(sum(rcv) AS DECIMAL(18,2)) + CASE WHEN doc_id % 5 = 0 THEN 10 ELSE 0 END AS stated FROM items WHERE NOT code_upgrade AND doc_id % 3 > 0 GROUP BY doc_id),
cov AS (SELECT doc_id, sum(rcv) AS covered FROM items WHERE doc_id % 2 = 1 GROUP BY doc_id),
rec0 AS (SELECT i.doc_id, coalesce(sum(rcv) FILTER (NOT code_upgrade), 0) AS calculated, coalesce(sum(rcv) FILTER (code_upgrade), 0) AS incurred FROM items i GROUP BY i.doc_id),
rec AS (SELECT doc_id, calculated, incurred, coalesce(stated, CASE WHEN covered > 0 THEN covered END) AS reported FROM rec0 LEFT JOIN tot USING (doc_id) LEFT JOIN cov USING (doc_id)),
recon AS (SELECT *, reported - calculated AS difference, """ + _TOL.format(e="reported", a="calculated") + """ AS ok,
  CASE WHEN reported IS NULL THEN 'nothing reported' WHEN """ + _TOL.format(e="reported", a="calculated") + " THEN 'reconciled' WHEN " + _TOL.format(e="reported", a="(calculated + incurred)") + """ THEN 'reported includes incurred items' ELSE 'unexplained difference' END AS note FROM rec)"""
)


def _double(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query(
    "a3_section_total_check",
    _W + ", s0 AS (SELECT doc_id, section, sum(rcv) AS calculated FROM items GROUP BY ALL), s AS (SELECT *, calculated + [0, 0.05, 0.06, 20][(doc_id % 4 + 1)::INT]::DECIMAL(18,2) AS stated FROM s0) SELECT doc_id, section, calculated::DOUBLE AS calculated, stated::DOUBLE AS stated, " + _TOL.format(e="stated", a="calculated") + " AS ok FROM s WHERE doc_id % 5 > 0",
)
def a3(spark, sf_dir):
    """Sections of four documents in five have a stated total, off by nothing, the tolerance, a cent more or 20."""
    off = F.element_at(F.array(*(F.lit(x).cast("decimal(18,2)") for x in ("0", "0.05", "0.06", "20"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    totals = X.balanced_totals(spark, sf_dir).where("doc_id % 5 > 0").withColumn("rcv", (F.col("rcv") + off).cast("decimal(18,2)"))
    return _double(R.section_total_check(X.line_items(spark, sf_dir), totals), "calculated", "stated")


@query("a4_reconcile_documents", _W + _RECON + "SELECT doc_id, calculated::DOUBLE AS calculated, incurred::DOUBLE AS incurred, reported::DOUBLE AS reported, difference::DOUBLE AS difference, ok, note FROM recon")
def a4(spark, sf_dir):
    return _double(R.reconcile_documents(X.line_items(spark, sf_dir), X.balanced_totals(spark, sf_dir), X.coverages(spark, sf_dir)), "calculated", "incurred", "reported", "difference")


@query("a5_line_arithmetic_issues", _W + _ISSUES + "SELECT doc_id, item_id, code FROM issues")
def a5(spark, sf_dir):
    return R.line_arithmetic_issues(X.line_items(spark, sf_dir))


@query(
    "a6_within_tolerance",
    """WITH t AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS e, [0, 0.05, -0.05, 1, 5, -7, 100][(o_orderkey % 7 + 1)::INT]::DECIMAL(18,2) AS off FROM orders),
    s AS (SELECT *, e + CASE WHEN abs(off) >= 5 THEN round(e * 0.01::DECIMAL(4,2), 2) + off ELSE off END AS a FROM t) SELECT o_orderkey, """ + _TOL.format(e="e", a="a") + " AS ok FROM s",
)
def a6(spark, sf_dir):
    total = F.col("o_totalprice").cast("decimal(18,2)")
    off = F.element_at(F.array(*(F.lit(x).cast("decimal(18,2)") for x in ("0", "0.05", "-0.05", "1.00", "5", "-7", "100"))), (F.pmod("o_orderkey", F.lit(7)) + 1).cast("int"))
    scaled = F.when(F.abs(off) >= 5, F.round(total * F.lit("0.01").cast("decimal(4,2)"), 2) + off).otherwise(off)
    return read(spark, sf_dir, "orders").select("o_orderkey", R.within_tolerance(total, total + scaled).alias("ok"))


@query("a7_duplicate_keys", "SELECT l_orderkey AS doc_id, l_linenumber AS line_no, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a7(spark, sf_dir):
    return R.duplicate_keys(X.line_items(spark, sf_dir), ["doc_id", "line_no"])


@query(
    "a8_document_status",
    _W + _ISSUES + _RECON + """, sev AS (SELECT doc_id, count(*) FILTER (code IN ('acv_over_rcv', 'dep_over_rcv')) AS fatal, count(*) FILTER (code = 'acv_mismatch') AS error, count(*) FILTER (code = 'rcv_mismatch') AS warning FROM issues GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_items, count(*) FILTER (line_no % 2 = 0) AS high_confidence FROM items GROUP BY doc_id)
    SELECT doc_id, n_items, high_confidence, coalesce(fatal, 0) AS fatal, coalesce(error, 0) AS error, coalesce(warning, 0) AS warning,
      CASE WHEN coalesce(fatal, 0) > 0 THEN 'failed' WHEN coalesce(error, 0) > 0 OR NOT coalesce(ok, true) THEN 'needs_review' ELSE 'success' END AS status
    FROM recon LEFT JOIN n USING (doc_id) LEFT JOIN sev USING (doc_id)""",
)
def a8(spark, sf_dir):
    items = X.line_items(spark, sf_dir).withColumn("confidence", F.when(F.col("line_no") % 2 == 0, 0.9).otherwise(0.5))
    severities = spark.createDataFrame([("rcv_mismatch", "warning"), ("acv_mismatch", "error"), ("acv_over_rcv", "fatal"), ("dep_over_rcv", "fatal")], "code string, severity string")
    recon = R.reconcile_documents(items, X.balanced_totals(spark, sf_dir), X.coverages(spark, sf_dir))
    return R.document_status(items, R.line_arithmetic_issues(items), recon, severities)


@query(
    "a8_status_with_claims",
    _W + _ISSUES + _RECON + """, sev AS (SELECT doc_id, count(*) FILTER (code IN ('acv_over_rcv', 'dep_over_rcv')) AS fatal, count(*) FILTER (code = 'acv_mismatch') AS error FROM issues GROUP BY doc_id), n AS (SELECT doc_id, count(*) FILTER (item_id = 6) AS to_review FROM items GROUP BY doc_id)
    SELECT doc_id, CASE WHEN coalesce(fatal, 0) > 0 THEN 'failed' WHEN coalesce(error, 0) > 0 OR NOT coalesce(ok, true) OR to_review > 0 OR doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 'needs_review' ELSE 'success' END AS status FROM recon LEFT JOIN n USING (doc_id) LEFT JOIN sev USING (doc_id)""",
)
def a8_claims(spark, sf_dir):
    """Rows that need review, and documents without a claim value, beside what a8 looks at."""
    items = X.line_items(spark, sf_dir).withColumns({"confidence": F.lit(0.9), "needs_review": F.col("item_id") == 6})
    severities = spark.createDataFrame([("rcv_mismatch", "warning"), ("acv_mismatch", "error"), ("acv_over_rcv", "fatal"), ("dep_over_rcv", "fatal")], "code string, severity string")
    recon = R.reconcile_documents(items, X.balanced_totals(spark, sf_dir), X.coverages(spark, sf_dir))
    claims = read(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 5 > 0, "C1").otherwise("  ").alias("value"))
    return R.document_status(items, R.line_arithmetic_issues(items), recon, severities, claims).select("doc_id", "status")


@query("a29_propagate_issues", _W + _ISSUES + ", c AS (SELECT doc_id, item_id, list_sort(list(DISTINCT code)) AS codes FROM issues GROUP BY ALL) SELECT doc_id, item_id, coalesce(codes, []::VARCHAR[]) AS reasons, codes IS NOT NULL AS needs_review FROM items LEFT JOIN c USING (doc_id, item_id)")
def a29(spark, sf_dir):
    items = X.line_items(spark, sf_dir).withColumn("reasons", F.array().cast("array<string>"))
    return R.propagate_issues(items, R.line_arithmetic_issues(items)).select("doc_id", "item_id", "reasons", "needs_review")


@query("a31_issue_rollup", _W + _ISSUES + "SELECT doc_id, count(*) FILTER (code = 'rcv_mismatch') AS rcv_mismatch, count(*) FILTER (code = 'acv_mismatch') AS acv_mismatch FROM issues GROUP BY doc_id")
def a31(spark, sf_dir):
    return R.issue_rollup(R.line_arithmetic_issues(X.line_items(spark, sf_dir)), ["rcv_mismatch", "acv_mismatch"])


@query(
    "a31_issue_severities",
    _W + _ISSUES + """, s AS (SELECT *, CASE code WHEN 'rcv_mismatch' THEN 'warning' WHEN 'acv_mismatch' THEN 'error' WHEN 'acv_over_rcv' THEN 'fatal' ELSE 'info' END AS severity FROM issues)
    SELECT doc_id, count(*) FILTER (code = 'rcv_mismatch') AS rcv_mismatch, count(*) FILTER (code = 'acv_mismatch') AS acv_mismatch, count(*) FILTER (code = 'acv_over_rcv') AS acv_over_rcv, count(*) FILTER (code = 'dep_over_rcv') AS dep_over_rcv,
      count(*) FILTER (severity = 'fatal') AS fatal, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM s GROUP BY doc_id""",
)
def a31_severities(spark, sf_dir):
    severity = F.when(F.col("code") == "rcv_mismatch", "warning").when(F.col("code") == "acv_mismatch", "error").when(F.col("code") == "acv_over_rcv", "fatal").otherwise("info")
    issues = R.line_arithmetic_issues(X.line_items(spark, sf_dir)).withColumn("severity", severity)
    return R.issue_rollup(issues, ["rcv_mismatch", "acv_mismatch", "acv_over_rcv", "dep_over_rcv"])


@query(
    "a32_field_issues",
    "WITH " + X.CANDIDATES + """, d AS (SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN ' Bare ' WHEN 1 THEN 'plain' END AS profile FROM customer), v AS (SELECT DISTINCT doc_id, field FROM cand WHERE trim(raw) <> '' UNION SELECT doc_id, 'list' FROM d WHERE doc_id % 5 > 0 AND doc_id % 4 > 0),
    r(field, severity) AS (VALUES ('kind', 'warning'), ('list', 'info'), ('number', 'error'))
    SELECT doc_id, field, 'conflicting_value' AS code, 'warning' AS severity FROM cand GROUP BY doc_id, field HAVING count(DISTINCT nullif(lower(trim(raw)), '')) > 1
    UNION ALL SELECT doc_id, field, 'missing_value', CASE WHEN profile = ' Bare ' AND field <> 'list' THEN 'info' ELSE severity END FROM d, r WHERE (doc_id, field) NOT IN (SELECT (doc_id, field) FROM v)""",
)
def a32_fields(spark, sf_dir):
    """Customers as documents: their kinds are those of their events, each fifth has no list, each fourth a blank one, none a number."""
    key = F.col("c_custkey")
    docs = read(spark, sf_dir, "customer").select(key.alias("doc_id"), F.when(key % 3 == 0, " Bare ").when(key % 3 == 1, "plain").alias("profile"))
    cand = X.field_candidates(spark, sf_dir)
    lists = docs.where("doc_id % 5 > 0").select("doc_id", F.lit("list").alias("field"), F.when(F.col("doc_id") % 4 == 0, "  ").otherwise("L").alias("value"))
    values = cand.select("doc_id", "field", F.col("raw").alias("value")).unionByName(lists)
    return R.field_issues(docs, cand, values, [("kind", "warning"), ("list", "info"), ("number", "error")], [("bare", "kind"), ("BARE ", "number")])


@query("a32_conflicting_values", "WITH " + X.CANDIDATES + "SELECT doc_id, field, count(DISTINCT nullif(lower(trim(raw)), '')) AS n_values, list_sort(list(DISTINCT raw) FILTER (raw IS NOT NULL)) AS raw_values FROM cand GROUP BY doc_id, field HAVING count(DISTINCT nullif(lower(trim(raw)), '')) > 1")
def a32(spark, sf_dir):
    return R.conflicting_values(X.field_candidates(spark, sf_dir))


@query(
    "a1_majority_value",
    "WITH " + X.CANDIDATES + r""", c AS (SELECT doc_id, field, nullif(trim(regexp_replace(raw, '[ \t\n\r\f\x0b]+', ' ', 'g')), '') AS value, count(*) AS n, min(CASE source WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 99 END) AS rank, min(ord) AS ord FROM cand GROUP BY ALL),
    t AS (SELECT *, sum(n) FILTER (value IS NOT NULL) OVER (PARTITION BY doc_id, field) AS total, row_number() OVER (PARTITION BY doc_id, field ORDER BY value IS NULL, n DESC, rank, ord) AS r FROM c)
    SELECT doc_id, field, value, CASE WHEN value IS NULL THEN 0 ELSE n END AS n, coalesce(total, 0)::BIGINT AS total, CASE WHEN value IS NULL THEN 0.3 WHEN n = total THEN 0.98 ELSE greatest(0.6, n / total * 0.98) END::DOUBLE AS confidence FROM t WHERE r = 1""",
)
def a1(spark, sf_dir):
    authority = spark.createDataFrame([("purchase", 1), ("click", 2), ("view", 3)], "source string, rank int")
    return R.majority_value(X.field_candidates(spark, sf_dir), authority)


@query(
    "w6_sequence_gaps",
    """WITH d AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS a FROM lineitem), g AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM d)
    SELECT doc_id, count(*) AS gaps, list_sort(list(a::VARCHAR || '-' || b))[1:5] AS first_gaps FROM g WHERE b - a > 1 GROUP BY doc_id""",
)
def w6(spark, sf_dir):
    gaps = R.sequence_gaps(X.line_items(spark, sf_dir))
    return gaps.withColumn("first_gaps", F.transform("first_gaps", lambda g: F.concat_ws("-", g["after"].cast("string"), g["before"].cast("string"))))


@query("w5_document_ids", _W + "SELECT doc_id, item_id, 'line_' || lpad(item_id::VARCHAR, 4, '0') AS local_id FROM items")
def w5(spark, sf_dir):
    return R.document_ids(X.line_items(spark, sf_dir), "line", ["item_id"]).select("doc_id", "item_id", "local_id")


@query(
    "u1_union_issues",
    _W + _ISSUES + """, dup AS (SELECT doc_id, item_id, 'duplicate_line' AS code FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM items) WHERE n > 1),
    u AS (SELECT doc_id, item_id, code, 0 AS check_no FROM issues UNION ALL SELECT doc_id, item_id, code, 1 FROM dup)
    SELECT *, 'issue_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY check_no, item_id, code))::VARCHAR, 4, '0') AS local_id FROM u""",
)
def u1(spark, sf_dir):
    items = X.line_items(spark, sf_dir)
    repeated = items.join(R.duplicate_keys(items, ["doc_id", "line_no"]), ["doc_id", "line_no"]).select("doc_id", "item_id", F.lit("duplicate_line").alias("code"))
    return R.union_issues(R.line_arithmetic_issues(items), repeated)


@query("w10_last_event_per_key", "SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def w10(spark, sf_dir):
    return R.last_event_per_key(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


@query("j1_attach_context", "SELECT l_orderkey, l_partkey, l_linenumber, o_orderdate, c_name, n_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def j1(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").withColumn("o_orderkey", F.col("l_orderkey"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("c_custkey"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    out = R.attach_context(rows, (orders, "o_orderkey"), (customers, "c_custkey"), (read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey"))
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "o_orderdate", "c_name", "n_name")


@query(
    "j14_coverage_gaps",
    """WITH m AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem), s AS (SELECT o_orderkey, ['processed', 'failed', 'failed', 'skipped', 'lost'][(o_orderkey % 5 + 1)::INT] AS status, o_orderkey % 2 = 0 AS told FROM m)
    SELECT o_orderkey, 'missing' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM m) UNION ALL
    SELECT o_orderkey, CASE WHEN status = 'lost' THEN 'invalid status' WHEN status = 'failed' THEN 'failed without error' ELSE 'skipped without reason' END FROM s WHERE status = 'lost' OR (status IN ('failed', 'skipped') AND NOT told)""",
)
def j14(spark, sf_dir):
    k = F.col("o_orderkey")
    told = F.when(k % 2 == 0, "told")
    status = F.element_at(F.array(*map(F.lit, ("processed", "failed", "failed", "skipped", "lost"))), (k % 5 + 1).cast("int"))
    manifest = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().select(k, status.alias("status"), told.alias("error"), told.alias("reason"))
    return R.coverage_gaps(read(spark, sf_dir, "orders"), manifest, "o_orderkey")
