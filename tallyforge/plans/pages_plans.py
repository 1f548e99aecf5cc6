"""Queries of pages: their class and source, contacts, coverages, notes, layout and rule files, over texts rendered from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import coverage as C
from tallyforge.operators import layout as Y
from tallyforge.operators import pages as G
from tallyforge.plans import fixtures as X
from tallyforge.plans._register import query, read
from tallyforge.sources import rules as S
from tallyforge.sources._folder import new_folder

#: One page of each class: text, class, whether it is included, confidence.
_PAGES = [
    (" \n\t ", "blank", False, 0.99), ("Insured: Jo Placeholder\nQUANTITY\n1. Row", "instructional_sample", False, 0.95), ("A sample estimate as a guide", "instructional_sample", False, 0.85),
    ("Quantity\n*1. Roof\nCONTINUED - Roof", "estimate_detail_continuation", True, 0.97), ("QUANTITY\n 12. Wall", "estimate_detail", True, 0.97), ("Recap by Room", "recap_by_room", True, 0.9),
    ("Recap of Taxes, Overhead and Profit", "overhead_profit_recap", True, 0.9), ("Recap of taxes", "tax_recap", True, 0.9), ("Explanation of Building Replacement Cost Benefits", "replacement_cost_explanation", False, 0.92),
    ("What is depreciation?", "depreciation_guide", False, 0.75), ("Frequently Asked Questions", "faq", False, 0.85), ("We are settling your claim", "settlement_notice", False, 0.85),
    ("Summary for Dwelling\nLine Item Total\nNet Claim", "coverage_summary", True, 0.9), ("1' 2\" 3' 4\" 5' 6\" 7' 8\" 9' 1\" 2' 3\"", "roof_diagram", True, 0.85), ("Surface Area and Number of Squares", "measurement_summary", True, 0.8),
    ("Claim Number: 1\nPolicy Number: 2", "claim_metadata", True, 0.85), ("Dear customer, member number 5", "carrier_letter", True, 0.75), ("Dear customer", "carrier_letter", False, 0.75), ("Nothing of the kind", "unknown", False, 0.3),
]
_PHRASES = G.Phrases(placeholders=("jo placeholder",))


def _classified(spark, sf_dir):
    """A page for each order, its class by its key; a customer's orders are one document."""
    k = F.col("o_orderkey")
    text = F.element_at(F.array(*(F.lit(p[0]) for p in _PAGES)), (k % len(_PAGES) + 1).cast("int"))
    pages = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), k.alias("page"), text.alias("text"))
    return G.classify_pages(pages, _PHRASES)


_CLASSES = "WITH v(i, c, inc, conf) AS (VALUES " + ", ".join(f"({i}, '{c}', {str(inc).lower()}, {conf}::DOUBLE)" for i, (_, c, inc, conf) in enumerate(_PAGES)) + f"), pg AS (SELECT o_custkey AS doc_id, o_orderkey AS page, c AS page_class, inc AS include, conf AS confidence FROM orders JOIN v ON i = o_orderkey % {len(_PAGES)}) "


@query("p1_classify_pages", _CLASSES + "SELECT doc_id, page, page_class, include, confidence FROM pg")
def p1(spark, sf_dir):
    return _classified(spark, sf_dir).select("doc_id", "page", "page_class", "include", "confidence")


#: Lines that pages are put together from: most phrases of the classes, near misses and plain text.
_LINES = [
    "", " \t ", "QUANTITY", "quantity", " 12. Wall paint", "*3. Ridge", "12.Wall", "1234. Too long a number", "CONTINUED - Roof", "continued -", "Sample Estimate", "A guide", "For example", "Anywhere, IL",
    "Recap by Category", "Recap of Taxes", "Overhead and Profit", "Replacement cost benefits pays the actual and necessary cost", "Recoverable depreciation is paid", "Commonly Asked Questions",
    "Enclosed is our settlement", "Summary for Dwelling", "Line Item Total 5.00", "Actual Cash Value 7.00", "Net Claim", "1' 2\" 3' 4\" 5'", "6' 7' 8' 9\"", "Surface Area 10", "Number of Squares 2", "SF Walls 7",
    "Claim Number: 1", "Policy Number 2", "Insured: Jo", "L/R Number 3", "Dear customer", "Claims department", "Claim representative", "We have prepared this estimate", "Nothing of the kind", "Paint the wall twice",
]
_LIST = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _LINES) + "]"
_N = len(_LINES)
#: Four lines of a page, by its keys.
_PICKS = [f"o_orderkey % {_N}", f"(o_orderkey * 7 + o_custkey) % {_N}", f"(o_custkey * 11 + 3) % {_N}", f"(o_orderkey * 3 + o_custkey * 5 + 1) % {_N}"]
_HAS = lambda words: "(" + " + ".join(f"contains(l, '{w}')::INT" for w in words) + ")"


def _composed(spark, sf_dir):
    lines = F.array(*map(F.lit, _LINES))
    text = F.concat_ws("\n", *(F.element_at(lines, (F.expr(i) + 1).cast("int")) for i in _PICKS))
    return G.classify_pages(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), text.alias("text")))


_COMPOSED = "WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS page, " + " || chr(10) || ".join(f"{_LIST}[({i} + 1)::INT]" for i in _PICKS) + r""" AS text FROM orders), u AS (SELECT *, lower(text) AS l FROM t),
w AS (SELECT *, contains(l, 'quantity') AND regexp_matches(text, '(?m)^\*?[ \t]*[0-9]{1,3}\.[ \t]+[^ \t\r\n]') AS detail, regexp_matches(l, 'continued *- *[^ \n]') AS more, len(regexp_extract_all(text, '[0-9]+''[ ]*[0-9]*"?')) AS feet,
""" + f"{_HAS(G.CLAIM_LABELS)} AS labelled, {_HAS(G.Phrases().measures)} AS measured, {_HAS(G.Phrases().summary)} AS summed, {_HAS(G.SAMPLES)} > 0 AS sample, {_HAS(G.PLACEHOLDERS[:3])} > 0 AS marker" + " FROM u), pg AS (SELECT *, " + f"""
CASE WHEN regexp_matches(text, '^[ \t\n]*$') THEN 'blank' WHEN marker THEN 'instructional_sample' WHEN sample AND (contains(l, 'guide') OR contains(l, 'example')) THEN 'instructional_sample' WHEN detail AND more THEN 'estimate_detail_continuation' WHEN detail THEN 'estimate_detail'
WHEN contains(l, 'recap by category') THEN 'recap_by_room' WHEN contains(l, 'overhead and profit') AND contains(l, 'recap of taxes') THEN 'overhead_profit_recap' WHEN contains(l, 'recap of taxes') THEN 'tax_recap' WHEN {_HAS(G.REPLACEMENT)} > 0 THEN 'replacement_cost_explanation'
WHEN {_HAS(G.DEPRECIATION)} > 0 THEN 'depreciation_guide' WHEN contains(l, 'asked questions') THEN 'faq' WHEN {_HAS(G.SETTLEMENT)} > 0 THEN 'settlement_notice' WHEN contains(l, 'summary for') AND summed >= 2 THEN 'coverage_summary' WHEN feet >= 6 THEN 'roof_diagram'
WHEN measured >= 2 THEN 'measurement_summary' WHEN labelled >= 2 THEN 'claim_metadata' WHEN {_HAS(G.Phrases().letter)} > 0 THEN 'carrier_letter' ELSE 'unknown' END AS page_class FROM w) """


@query("p1_composed_pages", _COMPOSED + "SELECT doc_id, page, page_class, CASE WHEN page_class = 'carrier_letter' THEN labelled >= 1 ELSE page_class NOT IN ('blank', 'instructional_sample', 'replacement_cost_explanation', 'depreciation_guide', 'faq', 'settlement_notice', 'unknown') END AS include FROM pg")
def p1_composed(spark, sf_dir):
    """Pages of four lines each, so that several tests can hold at once."""
    return _composed(spark, sf_dir).select("doc_id", "page", "page_class", "include")


@query("p2_composed_sets", _COMPOSED + "SELECT doc_id, count(*) FILTER (page_class NOT IN ('instructional_sample', 'blank', 'unknown')) AS metadata_pages, count(*) FILTER (page_class LIKE 'estimate%') AS estimate_pages FROM pg GROUP BY doc_id HAVING metadata_pages > 0")
def p2_composed(spark, sf_dir):
    pages = _composed(spark, sf_dir)
    rows = G.estimate_pages(pages).groupBy("doc_id").agg(F.count("*").alias("estimate_pages"))
    return G.metadata_eligible(pages).groupBy("doc_id").agg(F.count("*").alias("metadata_pages")).join(rows, "doc_id", "left").fillna(0, ["estimate_pages"])


@query("p2_page_sets", _CLASSES + "SELECT doc_id, count(*) FILTER (page_class NOT IN ('instructional_sample', 'blank', 'unknown')) AS metadata_pages, count(*) FILTER (page_class LIKE 'estimate%') AS estimate_pages FROM pg GROUP BY doc_id")
def p2(spark, sf_dir):
    pages = _classified(spark, sf_dir)
    one, two = (x.groupBy("doc_id").agg(F.count("*").alias(n)) for x, n in ((G.metadata_eligible(pages), "metadata_pages"), (G.estimate_pages(pages), "estimate_pages")))
    return pages.select("doc_id").distinct().join(one, "doc_id", "left").join(two, "doc_id", "left").fillna(0)


_PROFILES = [("english", ["the ", "and ", " of ", "with "]), ("french", ["les ", "eau", " ou"]), ("german", ["ein", "sch", "ung", "der ", " das "])]
_DETECTED = "WITH s AS (SELECT doc_id, " + ", ".join("least(1.0::DOUBLE, (" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in words) + f")::DOUBLE / {len(words)} * 1.4::DOUBLE) AS s{i}" for i, (_, words) in enumerate(_PROFILES)) + " FROM documents), b AS (SELECT *, greatest(s0, s1, s2) AS score FROM s) SELECT doc_id, CASE WHEN score < 0.7 THEN 'generic' WHEN s0 = score THEN 'english' WHEN s1 = score THEN 'french' ELSE 'german' END AS profile, score AS profile_score FROM b"


@query("p3_detect_source_profile", _DETECTED)
def p3(spark, sf_dir):
    return G.detect_source_profile(read(spark, sf_dir, "documents"), _PROFILES).select("doc_id", "profile", "profile_score")


def _rule_file(spark, rows, name):
    """Writes a rule file; its folder."""
    path = new_folder(spark, name)
    rows.coalesce(1).write.json(path)
    return path


@query("x3_source_profile", _DETECTED)
def x3(spark, sf_dir):
    """Profiles that are rows of a rule file."""
    rules = [{"kind": "profiles", "rules": [{"value": n, "patterns": list(w)} for n, w in _PROFILES]}]
    path = _rule_file(spark, spark.createDataFrame(rules, S.SCHEMA), "profiles")
    return G.detect_source_profile(read(spark, sf_dir, "documents"), S.rule_list(S.load_rules(spark, path), "profiles")).select("doc_id", "profile", "profile_score")


@query(
    "s5_load_rules",
    "WITH t AS (SELECT p_type AS value, list_sort(list(DISTINCT p_name)) AS patterns FROM part GROUP BY p_type), o AS (SELECT value, patterns, row_number() OVER (ORDER BY value) - 1 AS ord FROM t) SELECT 'types' AS kind, ord::INT AS ord, value, (unnest(range(len(patterns))))::INT AS pattern_ord, unnest(patterns) AS pattern FROM o",
)
def s5(spark, sf_dir):
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("value")).agg(F.array_sort(F.collect_set("p_name")).alias("patterns"))
    rules = rows.agg(F.array_sort(F.collect_list(F.struct("value", "patterns"))).alias("rules")).select(F.lit("types").alias("kind"), "rules")
    return S.load_rules(spark, _rule_file(spark, rules, "rules"))


@query(
    "s5_typed_rules",
    """WITH t AS (SELECT p_brand AS kind, lower(p_type) AS trade, list_sort(list(DISTINCT p_name)) AS patterns, min(split_part(p_name, ' ', 2)) AS component FROM part GROUP BY ALL),
    o AS (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY trade) - 1)::INT AS ord FROM t), c AS (SELECT kind, ord, 'trade' AS concept, trade AS value, patterns FROM o UNION ALL SELECT kind, ord, 'component', component, patterns FROM o WHERE component <> 'ring')
    SELECT kind, ord, concept, value, unnest(range(len(patterns)))::INT AS pattern_ord, unnest(patterns) AS pattern FROM c""",
)
def s5_typed(spark, sf_dir):
    """A rule file for each brand, with a rule for each type: its names, in upper case, and two concepts, or one for rings."""
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("kind"), F.lower("p_type").alias("trade")).agg(F.array_sort(F.collect_set("p_name")).alias("names"), F.min(F.split("p_name", " ")[1]).alias("component"))
    rule = F.struct("trade", F.transform("names", F.upper).alias("patterns"), F.when(F.col("component") != "ring", F.col("component")).alias("component"))
    files = rows.groupBy("kind").agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    path = new_folder(spark, "typed-rules")
    files.write.option("maxRecordsPerFile", 1).json(path)
    return S.load_typed_rules(spark, path)["concepts"]


_NOTES = [
    ("Required by current building code here", "code_upgrade_note", False), ("Priced by the warehouse", "pricing_note", False), ("Per code R903.1", "code_note", True), ("Options: none", "waste_note", True), ("Accounted for above", "measurement_note", True),
    ("The rest", "general_note", True), (" rake only ", "measurement_note", True), ("Windows", "general_note", False),
]


@query("p10_classify_notes", "WITH v(i, t, l) AS (VALUES " + ", ".join(f"({i}, '{t}', {str(like).lower()})" for i, (_, t, like) in enumerate(_NOTES)) + f") SELECT l_orderkey, l_partkey, l_linenumber, t AS note_type, l AS note_like FROM lineitem JOIN v ON i = l_partkey % {len(_NOTES)}")
def p10(spark, sf_dir):
    n = G.classify_notes(F.element_at(F.array(*(F.lit(x[0]) for x in _NOTES)), (F.col("l_partkey") % len(_NOTES) + 1).cast("int")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", n["note_type"].alias("note_type"), n["note_like"].alias("note_like"))


_SAID = ["ITEL match", "Priced by the yard", "an allowance of $5", "per code R903.2", "building code", "auto calculated waste", "bundle rounding", "rake only", "allotted to the ridge", "code upgrade", "did not previously exist", "plain words", "Starter course", "Windows"]
_SAID_SQL = "[" + ", ".join(f"'{x}'" for x in _SAID) + "]"
_NOTE = ["(l_partkey + l_suppkey) % 14", "(l_orderkey * 3 + l_linenumber) % 14"]


@query(
    "p10_composed_notes",
    "WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, lower(" + " || ' ' || ".join(f"{_SAID_SQL}[({i} + 1)::INT]" for i in _NOTE) + """) AS l FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN contains(l, 'code upgrade') OR contains(l, 'did not previously exist') THEN 'code_upgrade_note' WHEN contains(l, 'itel') OR contains(l, 'priced by') OR contains(l, 'allowance of $') THEN 'pricing_note'
      WHEN contains(l, 'r903.') OR contains(l, 'building code') THEN 'code_note' WHEN contains(l, 'auto calculated waste') OR contains(l, 'bundle rounding') THEN 'waste_note' WHEN contains(l, 'rake only') OR contains(l, 'allotted to') THEN 'measurement_note' ELSE 'general_note' END AS note_type,
      l LIKE 'starter%' OR l LIKE 'auto calculated%' OR l LIKE 'per code%' OR l LIKE 'allotted to%' AS note_like FROM t""",
)
def p10_composed(spark, sf_dir):
    """Notes of two parts each, so that the order of the kinds decides."""
    said = F.array(*map(F.lit, _SAID))
    n = G.classify_notes(F.concat_ws(" ", *(F.element_at(said, (F.expr(i) + 1).cast("int")) for i in _NOTE)))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", n["note_type"].alias("note_type"), n["note_like"].alias("note_like"))


_VERBS = ["R&R ", "Detach and reset ", "Remove ", "Replace ", "Tear off ", "D&R ", "", "Labor minimum "]


@query(
    "p11_verb_flags",
    "SELECT p_partkey, p_partkey % 8 IN (2, 4) AS remove_only, p_partkey % 8 = 3 AS replace_only, p_partkey % 8 = 0 AS remove_and_replace, p_partkey % 8 IN (1, 5) AS detach_and_reset, p_partkey % 8 = 7 AS labor_minimum FROM part",
)
def p11(spark, sf_dir):
    verb = F.element_at(F.array(*map(F.lit, _VERBS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", G.verb_flags(F.concat(verb, F.col("p_name"))).alias("f")).select("p_partkey", "f.*")


@query("p15_exclude_placeholders", "SELECT c_custkey AS doc_id, 'insured' AS field, 'sample_value' AS code FROM customer WHERE c_custkey % 97 = 0")
def p15(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    claims = c.select(F.col("c_custkey").alias("doc_id"), F.lit("insured").alias("field"), F.concat(F.lit(" "), F.upper("c_name")).alias("value"))
    return G.exclude_placeholders(claims, c.where("c_custkey % 97 = 0").select(F.col("c_name").alias("marker")))


@query("p16_extraction_wanted", r"SELECT doc_id FROM documents WHERE length(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0b]+', ' ', 'g'))) < 200")
def p16(spark, sf_dir):
    return G.extraction_wanted(read(spark, sf_dir, "documents"), 200).select("doc_id")


@query(
    "p17_presence_issues",
    "WITH " + X.ITEMS + """, i AS (SELECT doc_id, item_id, line_no FROM items)
    SELECT doc_id, item_id, 'missing_description' AS code, 'error' AS severity, 1 AS n FROM i WHERE item_id % 7 = 0 UNION ALL SELECT doc_id, item_id, 'missing_quantity', 'warning', 1 FROM i WHERE line_no = 3 UNION ALL SELECT doc_id, item_id, 'missing_unit', 'warning', 1 FROM i WHERE line_no = 5
    UNION ALL SELECT doc_id, item_id, 'malformed_money', 'info', 1 FROM i WHERE line_no = 2 UNION ALL SELECT doc_id, item_id, 'missing_quantity', 'warning', 1 FROM i WHERE line_no = 3
    UNION ALL SELECT doc_id, NULL, 'orphan_rows', 'warning', count(*) FROM i WHERE line_no = 6 GROUP BY doc_id UNION ALL SELECT o_orderkey, NULL, 'page_unknown', 'warning', 1 FROM orders WHERE o_orderkey % 6 = 0
    UNION ALL SELECT o_orderkey, NULL, 'no_metadata', 'error', 1 FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, NULL, 'low_profile_confidence', 'info', 1 FROM orders WHERE o_orderkey % 3 = 0""",
)
def p17(spark, sf_dir):
    line, item = F.col("line_no"), F.col("item_id")
    reasons = F.when(line == 2, F.array(F.lit("missing tax"), F.lit("unheard of"))).when(line == 3, F.array(F.lit("missing quantity")))
    items = X.line_items(spark, sf_dir, X.by_document(spark, sf_dir, read(spark, sf_dir, "lineitem"))).select("doc_id", "item_id", F.when(item % 7 > 0, "text").when(item % 2 == 0, " ").alias("description"), F.when(line != 3, F.col("quantity")).alias("quantity"), F.when(line != 5, "EA").alias("unit"), F.when(line == 6, "Unlabeled (1)").otherwise("Roof").alias("section"), reasons.alias("reasons"))
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders")
    pages = orders.select(k.alias("doc_id"), F.when(k % 6 == 0, "unknown").otherwise("faq").alias("page_class"))
    claims = orders.where("o_orderkey % 4 > 0").select(k.alias("doc_id"), F.when(k % 5 > 0, "C1").otherwise("  ").alias("value"))
    return G.presence_issues(items, pages, claims, orders.select(k.alias("doc_id"), F.when(k % 3 == 0, 0.5).otherwise(0.7).alias("profile_score")))


def _lines(df, doc_id, *lines):
    """(doc_id, page, line, text): a document of lines, null ones left out, three to a page."""
    at = df.select(doc_id.alias("doc_id"), F.posexplode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("i", "text"))
    return at.select("doc_id", F.floor(F.col("i") / 3).cast("int").alias("page"), (F.col("i") % 3).alias("line"), "text")


#: Orders in a partition where each becomes some twenty lines that are sorted.
_ORDERS = 25_000


def _orders(spark, sf_dir):
    """Orders dealt out before they become lines, in as many partitions as they ask for, so that a document's lines stay where they are."""
    orders = read(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_totalprice").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders.count() // _ORDERS)), "o_orderkey")


@query(
    "a27_extract_contacts",
    """SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'claim_representative' WHEN 1 THEN 'estimator' ELSE 'adjuster' END AS role, CASE c_custkey % 4 WHEN 0 THEN 'Ann ' WHEN 1 THEN 'Bob ' ELSE 'Cy ' END || c_custkey AS name,
    CASE c_custkey % 4 WHEN 0 THEN '(555) 123-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 1 THEN '5551234567' END AS phone, CASE WHEN c_custkey % 4 = 0 THEN 'a' || c_custkey || '@x.org' END AS email FROM customer WHERE c_custkey % 4 < 3""",
)
def a27(spark, sf_dir):
    k, n = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    say = lambda i, *parts: F.when(k == i, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    lines = _lines(
        read(spark, sf_dir, "customer"), F.col("c_custkey"),
        say(0, "Claim Rep.: Ann ", n), say(0, "Cellular: call (555) 123-", F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")), say(0, " "), say(0, "E-mail:"), say(0, "a", n, "@x.org"), say(0, "Thank you"), say(0, "Cell: 555-999-0000"),
        say(1, "Estimator:"), say(1, "Bob ", n), say(1, "Business: 5551234567"), say(1, "Estimator: Bob ", n), say(2, "Adjuster: Cy ", n), say(2, "no label here"), say(2, "Cell: 555-123-4567"), say(3, "Insured: Someone"),
    )
    roles = [("claim rep.", "claim_representative"), ("estimator", "estimator"), ("adjuster", "adjuster")]
    return G.extract_contacts(lines, roles).drop("page")


@query(
    "a28_coverage_blocks",
    """WITH o AS (SELECT o_orderkey AS doc_id, CAST(o_totalprice AS DECIMAL(18,2)) AS t FROM orders), b AS (
    SELECT doc_id, 1 AS ord, 'A' AS code, 'Dwelling' AS name, 'Wind' AS sub, false AS incurred, unnest(['line_item_total', 'rcv', 'deductible']) AS field, unnest([t, t + 1, 500.00]) AS amount FROM o
    UNION ALL SELECT doc_id, 2, 'AA', 'Other', NULL, false, 'subtotal', 10.00 FROM o WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 2 + (doc_id % 2 = 0)::INT, NULL, 'Roof', NULL, true, 'rcv', 20.00 FROM o
    UNION ALL SELECT doc_id, 3 + (doc_id % 2 = 0)::INT, NULL, 'Nothing', NULL, false, NULL, NULL FROM o WHERE doc_id % 3 = 0)
    SELECT doc_id, ord::INT AS ord, code, name, sub, incurred, field, amount::DOUBLE AS amount FROM b""",
)
def a28(spark, sf_dir):
    k, money = F.col("o_orderkey"), lambda c: F.format_number(c, 2)
    even, third = (lambda t: F.when(k % 2 == 0, t)), (lambda t: F.when(k % 3 == 0, t))
    lines = _lines(
        _orders(spark, sf_dir), k,
        F.lit("Cover page"), F.lit("Summary for Coverage A - Dwelling - Wind"), F.lit("Line Item Total"), money("o_totalprice"), F.lit("some words"), F.concat(F.lit("Replacement Cost Value: $"), money(F.col("o_totalprice") + 1)), F.lit("Less Deductible:"), F.lit("(500.00)"),
        F.lit("Line Item Total: 1.00"), F.lit("one"), F.lit("two"), F.lit(" "), F.lit("three"), F.lit("four"), F.lit("Net Claim: 7.00"), even("Summary for"), even("AA-Other"), even("Subtotal: 10.00"),
        F.lit("Roof - paid when incurred"), F.lit("Replacement Cost Value"), F.lit("<20.00>"), F.lit("Summary for All Items"), third("Summary for Nothing"),
    )
    return C.coverage_blocks(lines).withColumn("amount", F.col("amount").cast("double")).drop("pages")


@query(
    "a28_wrapped_and_unread_coverages",
    """WITH o AS (SELECT o_orderkey AS doc_id, CAST(o_totalprice AS DECIMAL(18,2)) AS t, o_orderkey % 5 AS k FROM orders), b AS (
    SELECT doc_id, 1 AS ord, 'A' AS code, 'Dwelling' AS name, '35 Windstorm and Hail' AS sub, false AS incurred, unnest(['net_claim', 'rcv', 'cleaning_sales_tax', 'net_claim_recovered']) AS field, unnest([t, 5.00, 1.00, t + 2]) AS amount,
      CASE k WHEN 0 THEN [1, 2, 3] WHEN 3 THEN [0, 1, 2, 3] ELSE [0, 1, 2] END AS pages FROM o
    UNION ALL SELECT doc_id, 2, NULL, 'Total', NULL, true, NULL, NULL, CASE WHEN k = 0 THEN [4] ELSE [3] END FROM o WHERE k < 2 UNION ALL SELECT doc_id, 2, 'B', 'Contents', 'Loss of', false, 'deductible', 3.00, [3, 4] FROM o WHERE k = 2)
    SELECT doc_id, ord::INT AS ord, code, name, sub, incurred, field, amount::DOUBLE AS amount, pages::INT[] AS pages FROM b""",
)
def a28_cases(spark, sf_dir):
    """Amounts that can't be read at first, names that go on in the next line, and labels with the words of an opening."""
    k, money = F.col("o_orderkey") % 5, lambda c: F.format_number(c, 2)
    on = lambda i, text: F.when(k == i, text)
    cover = [on(0, "Cover page"), on(0, "Summary for All Items"), on(0, "Net Claim: 9.00")]
    lines = _lines(
        _orders(spark, sf_dir), F.col("o_orderkey"), *cover,
        F.lit("Summary for"), F.lit("Coverage A - Dwelling - 35 Windstorm and"), F.lit("Hail"), F.lit("Net Claim: see below"), F.concat(F.lit("Net Claim: "), money("o_totalprice")), F.lit("Total paid when incurred: 5.00"), F.lit("Cleaning Sales Tax"), F.lit("$1.00"),
        F.concat(F.lit("Total Amount of Claim If Incurred: "), money(F.col("o_totalprice") + 2)), F.when(k < 2, "Total Paid When Incurred"), on(2, "Summary for Cov B - Contents - Loss of"), on(2, "Summary for All Items"), on(2, "Less Deductible"), on(2, "3.00"), on(3, "Overhead"), on(3, "Summary for taken by the label before"),
    )
    return C.coverage_blocks(lines).withColumn("amount", F.col("amount").cast("double"))


@query(
    "a30_cascade_coverages",
    "WITH " + X.ITEMS + """, s AS (SELECT doc_id, line_no, CASE WHEN line_no = 1 THEN 'inside' WHEN line_no % 2 = 0 THEN 'outside' ELSE 'mixed' END AS area, CASE WHEN line_no = 2 THEN sum(rcv) + 1 ELSE sum(rcv) END AS total FROM items GROUP BY doc_id, line_no),
    p AS (SELECT doc_id, list(line_no ORDER BY line_no) AS names, list(total ORDER BY line_no) AS parts, count(*) AS n, coalesce(sum(total) FILTER (line_no <= 3), 0) AS t0, coalesce(sum(total) FILTER (line_no > 3), 0) AS t1 FROM s GROUP BY doc_id),
    m AS (SELECT *, unnest(range(0, 1 << n::INT)) AS mask FROM p WHERE t0 > 0 AND t1 > 0 AND t0 <> t1), u AS (SELECT *, list_sum(list_transform(range(n), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN parts[i + 1] ELSE 0 END)) AS s1, list_sum(parts) AS whole FROM m),
    f AS (SELECT doc_id, count(*) AS answers, max(mask) AS mask FROM u WHERE abs(s1 - t1) <= 0.05 AND abs(whole - s1 - t0) <= 0.05 GROUP BY doc_id),
    g AS (SELECT doc_id, unnest(names) AS line_no, unnest(list_transform(range(n), lambda i: CASE WHEN answers = 1 THEN CASE WHEN (mask >> i) & 1 = 1 THEN 'late' ELSE 'early' END END)) AS coverage_id FROM p LEFT JOIN f USING (doc_id)),
    a AS (SELECT doc_id, area, CASE WHEN count(coverage_id) = count(*) AND min(coverage_id) = max(coverage_id) THEN min(coverage_id) END AS coverage_id FROM s JOIN g USING (doc_id, line_no) GROUP BY ALL)
    SELECT doc_id, 'section' AS level, line_no::VARCHAR AS id, coverage_id FROM g UNION ALL SELECT doc_id, 'item', item_id::VARCHAR, coverage_id FROM items JOIN g USING (doc_id, line_no) UNION ALL SELECT doc_id, 'area', area, coverage_id FROM a""",
)
def a30_cascade(spark, sf_dir):
    """Sections are line numbers, of which the second has a printed total; coverages are those up to the third and those after."""
    items = X.line_items(spark, sf_dir).withColumn("section", F.col("line_no"))
    line = F.col("section")
    printed = items.where("section = 2").groupBy("doc_id", "section").agg((F.sum("rcv") + 1).alias("total")).withColumn("ord", F.lit(1))
    totals = C.section_totals(items, printed)
    covered = totals.groupBy("doc_id", F.when(line <= 3, "early").otherwise("late").alias("coverage_id")).agg(F.sum("total").alias("rcv"))
    sections = totals.select("doc_id", "section", F.when(line == 1, "inside").when(line % 2 == 0, "outside").otherwise("mixed").alias("area"))
    return C.cascade_coverages(C.attribute_by_unique_split(totals, covered), sections, items)


_SPLIT = "WITH " + X.ITEMS + """, s AS (SELECT doc_id, line_no, sum(rcv) AS total FROM items GROUP BY ALL), p AS (SELECT doc_id, list(line_no ORDER BY line_no) AS names, list(total ORDER BY line_no) AS parts, count(*) AS n, coalesce(sum(total) FILTER (line_no % 2 = 0), 0) AS t0, coalesce(sum(total) FILTER (line_no % 2 = 1), 0) AS t1 FROM s GROUP BY doc_id),
m AS (SELECT *, unnest(range(0, 1 << n::INT)) AS mask FROM p WHERE t0 > 0 AND t1 > 0 AND t0 <> t1), u AS (SELECT *, list_sum(list_transform(range(n), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN parts[i + 1] ELSE 0 END)) AS s1, list_sum(parts) AS whole FROM m),
f AS (SELECT doc_id, count(*) AS answers, max(mask) AS mask FROM u WHERE abs(s1 - t1) <= 0.05 AND abs(whole - s1 - t0) <= 0.05 GROUP BY doc_id)
"""


@query(
    "a30_attribute_by_unique_split",
    _SPLIT + """SELECT doc_id, unnest(names) AS section, CASE WHEN answers = 1 THEN unnest(list_transform(range(n), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN 'odd' ELSE 'even' END)) END AS coverage_id,
    CASE WHEN t0 = 0 OR t1 = 0 THEN 'fewer than two coverages' WHEN t0 = t1 THEN 'coverages of equal amounts' WHEN coalesce(answers, 0) <> 1 THEN 'no single assignment' END AS note FROM p LEFT JOIN f USING (doc_id)""",
)
def a30(spark, sf_dir):
    """Totals of line numbers against the sums of even and odd ones."""
    items = X.line_items(spark, sf_dir)
    sections = items.groupBy("doc_id", F.col("line_no").alias("section")).agg(F.sum("rcv").alias("total"))
    sums = items.groupBy("doc_id", F.when(F.col("line_no") % 2 == 0, "even").otherwise("odd").alias("coverage_id")).agg(F.sum("rcv").alias("rcv"))
    return C.attribute_by_unique_split(sections, sums)


@query(
    "x4_split_among_three",
    "WITH " + X.ITEMS + """, s AS (SELECT doc_id, line_no, sum(rcv) AS total FROM items GROUP BY ALL), p AS (SELECT doc_id, list(line_no ORDER BY line_no) AS names, list(total ORDER BY line_no) AS parts, count(*)::INT AS n, [coalesce(sum(total) FILTER (line_no % 3 = i), 0) FOR i IN [0, 1, 2]] AS t FROM s GROUP BY doc_id),
    w AS (SELECT *, list_filter([0, 1, 2], lambda i: t[i + 1] > 0 AND len(list_filter(t, lambda y: y = t[i + 1])) = 1) AS ids, len(list_filter(t, lambda y: y > 0)) > len(list_distinct(list_filter(t, lambda y: y > 0))) AS same FROM p),
    m AS (SELECT *, unnest(range(0, (len(ids) ** n)::BIGINT)) AS mask FROM w WHERE len(ids) >= 2), d AS (SELECT *, list_transform(range(n), lambda i: ((mask // (len(ids) ** i)::BIGINT) % len(ids))::INT) AS to_ FROM m),
    f AS (SELECT doc_id, count(*) AS answers, max(to_) AS to_ FROM d WHERE len(list_filter(range(len(ids)), lambda b: abs(coalesce(list_sum(list_transform(list_filter(range(n), lambda i: to_[i + 1] = b), lambda i: parts[i + 1])), 0) - t[ids[b + 1] + 1]) > 0.05)) = 0 GROUP BY doc_id)
    SELECT doc_id, unnest(names) AS section, CASE WHEN answers = 1 THEN unnest(list_transform(f.to_, lambda b: ids[b + 1])) END AS coverage_id, CASE WHEN len(ids) < 2 THEN CASE WHEN same THEN 'coverages of equal amounts' ELSE 'fewer than two coverages' END WHEN coalesce(answers, 0) <> 1 THEN 'no single assignment' END AS note FROM w LEFT JOIN f USING (doc_id)""".replace("[coalesce(sum(total) FILTER (line_no % 3 = i), 0) FOR i IN [0, 1, 2]]", "[" + ", ".join(f"coalesce(sum(total) FILTER (line_no % 3 = {i}), 0)" for i in range(3)) + "]"),
)
def x4(spark, sf_dir):
    """A search that no join can say, grouped by document: totals of line numbers against the sums by their rest of three."""
    items = X.line_items(spark, sf_dir)
    sections = items.groupBy("doc_id", F.col("line_no").alias("section")).agg(F.sum("rcv").alias("total"))
    sums = items.groupBy("doc_id", (F.col("line_no") % 3).cast("int").alias("coverage_id")).agg(F.sum("rcv").alias("rcv"))
    return C.attribute_by_unique_split(sections, sums)


#: Texts in a partition where each becomes some hundred words with boxes that are sorted.
_TEXTS = 2_000


@query(
    "a26_words_to_lines",
    """WITH w AS (SELECT doc_id, string_split(text, ' ') AS t FROM documents), l AS (SELECT doc_id, unnest(range((len(t) + 9) // 10)) AS line, t FROM w)
    SELECT doc_id, line::INT AS line, array_to_string(t[line * 10 + 1:line * 10 + 10], ' ') AS text, 10.0::DOUBLE AS x0, (20 * line)::DOUBLE AS y0, (60.0 * least(len(t) - line * 10, 10))::DOUBLE AS x1, (20 * line + 12)::DOUBLE AS y1 FROM l""",
)
def a26(spark, sf_dir):
    """Ten words of a text to a line. Texts are dealt out whole, in as many partitions as they ask for, so that their words stay where they are."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    documents = documents.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // _TEXTS)), "doc_id")
    words = documents.select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "text"))
    n, line = F.col("i") % 10, F.floor(F.col("i") / 10).cast("int")
    boxed = words.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("block"), line.alias("line"), n.alias("word"), "text", (n * 60.0 + 10).alias("x0"), (line * 20.0).alias("y0"), (n * 60.0 + 60).alias("x1"), (line * 20.0 + 12).alias("y1"))
    return Y.words_to_lines(boxed).drop("page", "block")


@query(
    "j12_assign_columns",
    """SELECT p_brand AS doc_id, p_partkey AS line, CASE WHEN p_partkey % 10 = 0 OR p_partkey % 15 = 5 THEN '' ELSE 'S' || p_partkey END AS selector, CASE WHEN p_partkey % 20 = 0 THEN '' ELSE p_name END AS description, 0.5::DOUBLE AS confidence, (50 + p_partkey)::DOUBLE AS y
    FROM part WHERE NOT (p_partkey % 20 = 0)""",
)
def j12(spark, sf_dir):
    """Each part is a row of its brand's image: a code in two words, its name, a stray sign, a unit at the border and a header above."""
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    box = lambda text, x0, x1, on=F.lit(True), up=False: F.when(on, F.struct(text.alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"), (F.lit(5.0) if up else k + 50.0).alias("y0")))
    plain = (k % 10 > 0) & (k % 15 != 5)
    boxes = F.array(
        box(F.lit("S"), 10, 20, plain), box(k.cast("string"), 22, 40, plain), box(F.lit("A_B"), 10, 40, (k % 10 > 0) & (k % 15 == 5)), box(F.lit("|"), 15, 17), box(w[0], 100, 140, k % 20 > 0), box(w[1], 150, 190, k % 20 > 0), box(F.lit("EA"), 388, 418), box(F.lit("Selector"), 10, 40, up=True),
    )
    words = read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("block"), k.alias("line"), F.posexplode(F.filter(boxes, lambda b: b.isNotNull())).alias("word", "b"))
    words = words.select("doc_id", "page", "block", "line", "word", "b.*", F.lit(0.5).alias("confidence"))
    regions = read(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.lit(1).alias("page")).distinct().withColumns({n: F.lit(float(v)) for n, v in (("header_bottom", 40), ("selector_left", 5), ("selector_right", 60), ("description_left", 90), ("description_right", 392))})
    return Y.assign_columns(words, regions).drop("page", "block")


@query(
    "a25_repeating_row_shapes",
    """WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS row, unnest(CASE WHEN l_linenumber % 3 > 0 THEN [{'x': 10.0, 't': 'a' || l_partkey}, {'x': 100.4, 't': 'b' || l_suppkey}] ELSE [{'x': 10.0, 't': 'solo'}] END) AS b FROM lineitem),
    r AS (SELECT doc_id, row, list_sort(list({'x': b.x, 't': b.t})) AS own FROM s GROUP BY ALL HAVING count(*) >= 2), h AS (SELECT *, list_transform(own, lambda e: round(e.x / 3)) AS shape FROM r),
    o AS (SELECT *, count(*) OVER (PARTITION BY doc_id, shape) AS n FROM h) SELECT DISTINCT doc_id, 1 AS page, unnest(list_transform(own, lambda e: e.t)) AS text FROM o WHERE n >= 3""",
)
def a25(spark, sf_dir):
    """Two spans for the rows of an order, one for each third."""
    one = lambda x, t: F.struct(F.lit(x).alias("x0"), t.alias("text"))
    grid = F.array(one(10.0, F.concat(F.lit("a"), F.col("l_partkey").cast("string"))), one(100.4, F.concat(F.lit("b"), F.col("l_suppkey").cast("string"))))
    spans = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (F.col("l_linenumber") * 1.0 + 0.2).alias("y"), F.explode(F.when(F.col("l_linenumber") % 3 > 0, grid).otherwise(F.array(one(10.0, F.lit("solo"))))).alias("s"))
    return Y.repeating_row_shapes(spans.select("doc_id", "page", "y", "s.*"))


