"""Queries of rules, candidates, scores and decisions, over parts as items and as catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import linkage as L
from tallyforge.plans._register import query, read

_ACTIONS, _UNITS = ("remove", "install", "replace", "unknown"), ("EA", "SF", "LF")


def _pick(values, n):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def items(spark, sf_dir):
    """Parts as items; each seventh has no unit, each 29th an unknown trade, each eleventh no material, each third no attributes."""
    words = F.split("p_name", " ")
    k = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(
        k.alias("item_id"), F.col("p_name").alias("description"), F.when(k % 29 == 0, "unknown").otherwise(F.lower("p_type")).alias("trade"), words[1].alias("component"), F.when(k % 11 > 0, words[0]).alias("material"),
        _pick(_ACTIONS, F.col("p_size")).alias("action"), F.when(k % 7 != 0, _pick(_UNITS, F.col("p_size"))).alias("unit"), F.col("p_brand").alias("category"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
        F.when(k % 3 > 0, F.create_map(F.lit("grade"), F.lower("p_type"))).alias("attributes"),
    )
    return rows.withColumn("tokens", T.tokens(F.concat_ws(" ", "description", "trade")))


def catalog(spark, sf_dir):
    """An entry for each type and noun: its smallest material as its term, two or three actions, one or two units; each third without selector, each fourth for one grade."""
    words = F.split("p_name", " ")
    rows = read(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("trade"), words[1].alias("component")).agg(F.min("p_partkey").alias("mapping_id"), F.min(words[0]).alias("material"), F.min("p_size").alias("s"))
    return rows.select(
        "mapping_id", "trade", "component", F.array("material").alias("terms"), F.when(F.col("s") % 2 == 0, F.array(F.lit("remove"), F.lit("install"))).otherwise(F.array(*map(F.lit, ("remove", "install", "replace")))).alias("actions"),
        F.when(F.col("mapping_id") % 2 == 0, F.array(F.lit("EA"))).otherwise(F.array(F.lit("SF"), F.lit("LF"))).alias("units"), F.when(F.col("mapping_id") % 3 > 0, F.concat(F.lit("S"), F.col("mapping_id").cast("string"))).alias("selector"),
        F.when(F.col("mapping_id") % 4 == 0, F.create_map(F.lit("grade"), F.lit("economy"))).alias("required"),
    )


_ITEMS = """
it AS (SELECT p_partkey AS item_id, p_name AS description, CASE WHEN p_partkey % 29 = 0 THEN 'unknown' ELSE lower(p_type) END AS trade, split_part(p_name, ' ', 2) AS component, CASE WHEN p_partkey % 11 > 0 THEN split_part(p_name, ' ', 1) END AS material,
  ['remove', 'install', 'replace', 'unknown'][p_size % 4 + 1] AS action, CASE WHEN p_partkey % 7 <> 0 THEN ['EA', 'SF', 'LF'][p_size % 3 + 1] END AS unit, p_brand AS category, p_size AS size, CASE WHEN p_partkey % 3 > 0 THEN lower(p_type) END AS grade FROM part),
cat0 AS (SELECT lower(p_type) AS e_trade, split_part(p_name, ' ', 2) AS e_component, min(p_partkey) AS mapping_id, min(split_part(p_name, ' ', 1)) AS e_material, min(p_size) AS s FROM part GROUP BY ALL),
cat AS (SELECT *, s % 2 = 0 AS strict, mapping_id % 2 = 0 AS even, mapping_id % 3 > 0 AS has_selector FROM cat0)
"""
_SCORED = """, sc0 AS (SELECT it.*, cat.*, component = e_component AS c1, trade = e_trade AS c2, action IN ('remove', 'install') OR (NOT strict AND action = 'replace') AS c3, (unit IS NULL OR (even AND unit = 'EA') OR (NOT even AND unit IN ('SF', 'LF'))) AS c4, NOT (mapping_id % 4 = 0 AND coalesce(grade, 'economy') <> 'economy') AS c5,
  CASE WHEN material IS NULL THEN 0.3 WHEN contains(material, e_material) OR contains(e_material, material) THEN 1.0 ELSE 1 - levenshtein(material, e_material)::DOUBLE / greatest(length(material), length(e_material)) END::DOUBLE AS ms
  FROM it JOIN cat ON component = e_component OR trade = e_trade),
sc AS (SELECT *, least(25 + 350 * c1::INT + 200 * c2::INT + 150 * c3::INT + 150 * c4::INT + floor(CASE WHEN material IS NULL OR ms >= 0.55 THEN ms ELSE 0 END * 100)::INT, CASE WHEN c2 THEN 1000 ELSE 400 END, CASE WHEN c1 AND c3 AND c4 AND c5 THEN 1000 ELSE 500 END)::INT AS score FROM sc0)
"""
_DECIDED = _SCORED + """, rk AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM sc WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, mapping_id)),
lst AS (SELECT item_id, list(mapping_id ORDER BY rank) FILTER (rank <= 3 AND score >= 1) AS top3, coalesce(list(mapping_id ORDER BY rank) FILTER (rank BETWEEN 2 AND 4 AND score >= 600), []::BIGINT[]) AS alt FROM rk GROUP BY item_id),
dec AS (SELECT it.item_id, CASE WHEN trade = 'unknown' THEN 'unmapped' WHEN coalesce(b.score, 0) < 600 THEN 'unmapped' WHEN b.score - b.second <= 30 THEN 'review' WHEN b.score >= 920 AND has_selector THEN 'mapped' WHEN b.score >= 800 THEN 'partial' ELSE 'review' END AS status,
  mapping_id, CASE WHEN it.trade <> 'unknown' THEN b.score END AS score, CASE WHEN it.trade = 'unknown' THEN []::BIGINT[] WHEN coalesce(b.score, 0) < 600 THEN coalesce(top3, []::BIGINT[]) ELSE coalesce(alt, []::BIGINT[]) END AS alternatives
  FROM it LEFT JOIN (SELECT item_id, score, second, mapping_id, has_selector FROM rk WHERE rank = 1) b USING (item_id) LEFT JOIN lst USING (item_id))
"""
_W = "WITH " + _ITEMS


def _scored(spark, sf_dir):
    return L.score_mapping(L.mapping_pairs(items(spark, sf_dir), catalog(spark, sf_dir))).withColumn("mapping_id", F.col("e_mapping_id"))


def _decided(spark, sf_dir):
    return L.decide_mapping(items(spark, sf_dir), _scored(spark, sf_dir), "item_id", "mapping_id")


_RULES = [("fasten", ("bolt", "screw")), ("paint", ("red", "blue")), ("frame", ("widget", "gadget", "small ring"))]


@query(
    "j2_first_rule_match",
    """SELECT p_partkey, CASE WHEN r > 0 THEN ['fasten', 'paint', 'frame'][r] ELSE 'unknown' END AS concept, CASE WHEN r = 0 THEN 0.3 WHEN r = 3 THEN 0.95 ELSE 0.85 END::DOUBLE AS concept_confidence
    FROM (SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'bolt|screw') THEN 1 WHEN regexp_matches(p_name, 'red|blue') THEN 2 WHEN regexp_matches(p_name, 'widget|gadget|small ring') THEN 3 ELSE 0 END AS r FROM part)""",
)
def j2(spark, sf_dir):
    return L.first_rule_match(read(spark, sf_dir, "part"), _RULES, F.col("p_name"), "concept").select("p_partkey", "concept", "concept_confidence")


_ATTRIBUTES = [("size", r"size ([0-9]+)", None), ("color", r"\b(red|blue)\b", None), ("grade", r"^large", "high"), ("color", r"^cold", "white")]


@query(
    "j3_extract_attributes",
    r"""SELECT p_partkey, p_size::VARCHAR AS size, CASE WHEN p_name LIKE 'cold%' THEN 'white' ELSE nullif(regexp_extract(p_name, '\b(red|blue)\b', 1), '') END AS color, CASE WHEN p_name LIKE 'large%' THEN 'high' END AS grade FROM part""",
)
def j3(spark, sf_dir):
    rows = read(spark, sf_dir, "part").withColumn("t", F.concat("p_name", F.lit(" size "), F.col("p_size").cast("string")))
    a = F.col("attributes")
    return L.extract_attributes(rows, _ATTRIBUTES, F.col("t")).select("p_partkey", a["size"].alias("size"), a["color"].alias("color"), a["grade"].alias("grade"))


@query(
    "f22_normalize_items",
    """SELECT *, least(a_c, c_c)::DOUBLE AS confidence, least(a_c, c_c) < 0.6 AS needs_review FROM (SELECT p_partkey, CASE WHEN p_name LIKE '%bolt%' OR p_name LIKE '%screw%' THEN 'fasten' WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' THEN 'paint' WHEN p_name LIKE '%widget%' OR p_name LIKE '%gadget%' OR p_name LIKE '%small ring%' THEN 'frame' ELSE 'unknown' END AS action,
    CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%gear%' THEN 'gear' ELSE 'unknown' END AS component FROM part)
    JOIN (SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'bolt|screw|red|blue') THEN 0.85 WHEN regexp_matches(p_name, 'widget|gadget|small ring') THEN 0.95 ELSE 0.3 END AS a_c, CASE WHEN regexp_matches(p_name, 'ring|gear') THEN 0.85 ELSE 0.3 END AS c_c FROM part) USING (p_partkey)""".replace("SELECT *,", "SELECT p_partkey, action, component,", 1),
)
def f22(spark, sf_dir):
    out = L.normalize_items(read(spark, sf_dir, "part"), {"action": _RULES, "component": [("ring", ("ring",)), ("gear", ("gear",))]}, _ATTRIBUTES, "p_name")
    return out.select("p_partkey", "action", "component", "confidence", "needs_review")


@query("r1_score_mapping", _W + _SCORED + "SELECT item_id, mapping_id, score, list_filter([CASE WHEN NOT c1 THEN 'component conflict' END, CASE WHEN NOT c2 THEN 'trade conflict' END, CASE WHEN NOT c3 THEN 'action conflict' END, CASE WHEN NOT c4 THEN 'unit conflict' END, CASE WHEN NOT c5 THEN 'attribute conflict' END], lambda x: x IS NOT NULL) AS reasons FROM sc")
def r1(spark, sf_dir):
    return _scored(spark, sf_dir).select("item_id", "mapping_id", "score", "reasons")


@query("j4_score_pairs", _W + _SCORED + "SELECT item_id, count(*) AS pairs, max(score) AS best FROM sc GROUP BY item_id")
def j4(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("pairs"), F.max("score").alias("best"))


@query("t1_top_k", _W + _SCORED + "SELECT item_id, mapping_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, mapping_id)::INT AS rank FROM sc WHERE score >= 400) WHERE rank <= 3")
def t1(spark, sf_dir):
    return L.top_k(_scored(spark, sf_dir), "item_id", 3, 400, ["mapping_id"]).select("item_id", "mapping_id", "score", "rank")


@query("w7_top_margin", _W + _DECIDED + "SELECT item_id, mapping_id, score, second, score - coalesce(second, 0) AS margin, coalesce(score - second <= 30, false) AS tied FROM rk WHERE rank = 1")
def w7(spark, sf_dir):
    return L.top_margin(_scored(spark, sf_dir), "item_id", ["mapping_id"]).select("item_id", "mapping_id", "score", "second", "margin", "tied")


@query("r2_decide_mapping", _W + _DECIDED + "SELECT item_id, status, CASE WHEN status <> 'unmapped' THEN mapping_id END AS best, score, alternatives FROM dec")
def r2(spark, sf_dir):
    return _decided(spark, sf_dir)


@query(
    "r3_mapping_issues",
    _W + _DECIDED + """, bs AS (SELECT dec.item_id, dec.score, CASE WHEN status <> 'unmapped' THEN dec.mapping_id END AS best, c1, c2, c3, c4, c5, has_selector, coalesce(b.score - b.second <= 30, false) AS tied FROM dec LEFT JOIN rk b ON b.item_id = dec.item_id AND b.rank = 1),
    l AS (SELECT item_id, unnest(list_filter([CASE WHEN best IS NULL THEN 'no_match:warning' END, CASE WHEN best IS NOT NULL AND NOT c1 THEN 'component_mismatch:info' END, CASE WHEN best IS NOT NULL AND NOT c2 THEN 'trade_mismatch:warning' END,
      CASE WHEN best IS NOT NULL AND NOT c3 THEN 'unsupported_action:warning' END, CASE WHEN best IS NOT NULL AND NOT c4 THEN 'incompatible_unit:warning' END, CASE WHEN best IS NOT NULL AND NOT c5 THEN 'attribute_conflict:warning' END,
      CASE WHEN best IS NOT NULL AND tied THEN 'close_candidates:warning' END, CASE WHEN best IS NOT NULL AND NOT has_selector THEN 'missing_selector:warning' END, CASE WHEN best % 5 = 0 THEN 'missing_category:warning' END,
      CASE WHEN best IS NOT NULL AND score / 1000 * 0.7::DOUBLE < 0.6 THEN 'low_confidence:warning' END, CASE WHEN item_id % 11 = 0 THEN 'unresolved_coverage:info' END, CASE WHEN item_id % 13 = 0 THEN 'upstream_review:info' END,
      CASE WHEN item_id % 5 = 0 THEN 'ambiguous_text:info' END], lambda x: x IS NOT NULL)) AS i FROM bs)
    SELECT item_id, split_part(i, ':', 1) AS code, split_part(i, ':', 2) AS severity FROM l""",
)
def r3(spark, sf_dir):
    """Each fifth entry has no category; each fifth text is unclear, each seventh without an action, each eleventh without a coverage, each thirteenth flagged before."""
    k = F.col("item_id")
    unclear = F.filter(F.array(F.when(k % 5 == 0, "odd text"), F.when(k % 7 == 0, "action unknown")), lambda x: x.isNotNull())
    rows = items(spark, sf_dir).withColumns({"coverage": F.when(k % 11 > 0, "c"), "upstream_review": k % 13 == 0, "normal_reasons": unclear})
    decided = L.with_reasons(_decided(spark, sf_dir), _scored(spark, sf_dir), "item_id", "mapping_id")
    decided = decided.withColumns({"category": F.when(F.col("best") % 5 > 0, "c"), "confidence": F.col("score") / 1000 * F.lit(0.7)})
    return L.mapping_issues(rows, decided, "item_id")


@query(
    "a9_mapping_summary",
    _W + _DECIDED + """SELECT item_id % 50 AS doc, count(*) FILTER (status = 'mapped') AS mapped, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'unmapped') AS unmapped,
    sum(score) FILTER (status <> 'unmapped')::BIGINT AS points, count(*) FILTER (status <> 'unmapped') AS n_best, count(*) FILTER (status IN ('review', 'unmapped')) AS unresolved, CASE WHEN count(*) FILTER (status IN ('review', 'unmapped')) > 0 THEN 'needs_review' ELSE 'complete' END AS overall FROM dec GROUP BY 1""",
)
def a9(spark, sf_dir):
    return L.mapping_summary(_decided(spark, sf_dir).withColumn("doc", F.col("item_id") % 50), "doc")


def _records(spark, sf_dir):
    """A catalog: each distinct name, type and brand of part is a record."""
    rows = read(spark, sf_dir, "part").groupBy("p_name", "p_type", "p_brand").agg(F.min("p_partkey").alias("rec_id"))
    rows = rows.select("rec_id", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text"), F.col("p_brand").alias("category"))
    return rows.withColumn("tokens", T.tokens(F.col("text")))


_REC = "rec AS (SELECT min(p_partkey) AS rec_id, p_name || ' ' || lower(p_type) AS b, p_brand AS category FROM part GROUP BY p_name, p_type, p_brand)"


def _hints(spark):
    rows = [("trade", "small", "Brand#1", 1), ("trade", "small", "Brand#2", 2), ("trade", "economy", "Brand#3", 1), ("component", "ring", "Brand#4", 1), ("component", "bolt", "Brand#5", 1), ("component", "gear", "Brand#5", 2)]
    return spark.createDataFrame(rows, "kind string, value string, category string, ord int")


def _pools(spark, sf_dir):
    return L.candidates_by_hint(items(spark, sf_dir), _hints(spark))


def _best(spark, rows, records):
    """Of each row's pools the 200 records that share most words."""
    pools = L.candidates_by_hint(rows, _hints(spark))
    return pools, L.prefilter_by_overlap(pools.join(rows.select("item_id", "tokens"), "item_id"), records, "rec_id")


_POOLS = _W + ", " + _REC + """, h(kind, value, category) AS (VALUES ('trade', 'small', 'Brand#1'), ('trade', 'small', 'Brand#2'), ('trade', 'economy', 'Brand#3'), ('component', 'ring', 'Brand#4'), ('component', 'bolt', 'Brand#5'), ('component', 'gear', 'Brand#5')),
a AS (SELECT item_id, h.category, h.kind FROM it JOIN h ON (h.kind = 'trade' AND h.value = it.trade) OR (h.kind = 'component' AND h.value = it.component)),
f AS (SELECT item_id, category FROM a WHERE kind = 'trade' OR item_id NOT IN (SELECT item_id FROM a WHERE kind = 'trade')),
pools AS (SELECT item_id, category FROM f UNION ALL SELECT item_id, NULL FROM it WHERE item_id NOT IN (SELECT item_id FROM f))
"""


@query(
    "j5_candidates_by_hint",
    _POOLS + """, s AS (SELECT category, count(*) AS n, min(rec_id) AS first FROM rec GROUP BY category UNION ALL SELECT NULL, count(*), min(rec_id) FROM rec)
    SELECT item_id, sum(n)::BIGINT AS n, min(first) AS first, bool_and(p.category IS NOT NULL) AS hinted FROM pools p JOIN s ON p.category IS NOT DISTINCT FROM s.category GROUP BY item_id""",
)
def j5(spark, sf_dir):
    """The size and first record of each item's pools."""
    sizes = _records(spark, sf_dir).groupingSets([[F.col("category")], []], "category").agg(F.count("*").alias("n"), F.min("rec_id").alias("first"))
    pools = _pools(spark, sf_dir)
    met = pools.join(sizes.withColumnRenamed("category", "of"), F.col("category").eqNullSafe(F.col("of")))
    return met.groupBy("item_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min("hinted").alias("hinted"))


_BEST = _POOLS + """, tx AS (SELECT DISTINCT p.category, description, trade FROM pools p JOIN it USING (item_id)),
t AS (SELECT tx.category, description, trade, rec_id, len(list_intersect(list_distinct(string_split(description || ' ' || trade, ' ')), list_distinct(string_split(b, ' ')))) AS shared FROM tx JOIN rec ON tx.category IS NULL OR tx.category = rec.category),
r AS (SELECT *, row_number() OVER (PARTITION BY category, description, trade ORDER BY shared DESC, rec_id)::INT AS rank FROM t QUALIFY rank <= 200),
best AS (SELECT p.item_id, rec_id, shared::BIGINT AS shared, rank FROM pools p JOIN it USING (item_id) JOIN r ON r.description = it.description AND r.trade = it.trade AND r.category IS NOT DISTINCT FROM p.category)
"""


@query("t2_prefilter_by_overlap", _BEST + "SELECT item_id, rec_id, shared, rank FROM best")
def t2(spark, sf_dir):
    pools = _pools(spark, sf_dir).join(items(spark, sf_dir).select("item_id", "tokens"), "item_id")
    return L.prefilter_by_overlap(pools, _records(spark, sf_dir), "rec_id")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOK = ", bt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(" + _LOWER + ", '[a-z0-9]+')) AS token FROM benchmark), dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(" + _LOWER + ", '[a-z0-9]+')) AS token FROM documents)"


def _tokenized(spark, sf_dir):
    return (read(spark, sf_dir, n).select(k, T.tokens(F.col("text")).alias("tokens")) for n, k in (("benchmark", "item_id"), ("documents", "doc_id")))


@query("j6_candidates_by_token", "WITH x AS (SELECT 1)" + _TOK + ", s AS (SELECT item_id, doc_id, count(*) AS shared FROM bt JOIN dt USING (token) GROUP BY ALL) SELECT * FROM s UNION ALL SELECT item_id, NULL, 0 FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM s)")
def j6(spark, sf_dir):
    return L.candidates_by_token(*_tokenized(spark, sf_dir), "item_id", "doc_id")


@query("a19_idf", "WITH x AS (SELECT 1)" + _TOK + ", n AS (SELECT count(DISTINCT doc_id) AS n FROM dt) SELECT token, count(*) AS df, round(ln((n + 1) / (count(*) + 1)) + 1, 6) AS idf FROM dt, n GROUP BY token, n")
def a19(spark, sf_dir):
    _, docs = _tokenized(spark, sf_dir)
    return L.idf(docs.where(F.size("tokens") > 0), "doc_id").withColumn("idf", F.round("idf", 6))


_LOW = ("small", "large")
_LEX = ", " + _REC + """, tk AS (SELECT rec_id, unnest(list_distinct(string_split(b, ' '))) AS token FROM rec), nn AS (SELECT count(*) AS n FROM rec),
w AS (SELECT token, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM tk, nn GROUP BY token, n),
qa AS (SELECT DISTINCT description || ' ' || trade AS a FROM it), qb AS (SELECT DISTINCT b FROM rec),
x AS (SELECT *, list_sort(list_distinct(string_split(a, ' '))) AS ta, list_sort(list_distinct(string_split(b, ' '))) AS tb FROM qa, qb),
e AS (SELECT a, b, ta, tb, unnest(list_distinct(list_concat(ta, tb))) AS token FROM x),
s AS (SELECT a, b, sum(coalesce(idf, 1)) AS u, sum(CASE WHEN list_contains(ta, token) AND list_contains(tb, token) THEN coalesce(idf, 1) ELSE 0 END) AS c, count(*) FILTER (list_contains(ta, token) AND token NOT IN ('small', 'large')) AS na, count(*) FILTER (list_contains(ta, token) AND list_contains(tb, token) AND token NOT IN ('small', 'large')) AS has,
  count(*) FILTER (list_contains(ta, token) AND list_contains(tb, token)) AS k FROM e LEFT JOIN w USING (token) GROUP BY ALL),
lx AS (SELECT a, b, round(CASE WHEN a = b THEN 1.0 ELSE 0.34 * c / u + 0.25 * CASE WHEN na > 0 THEN has / na ELSE c / u END + 0.21 * (1 - levenshtein(a, b) / greatest(length(a), length(b))) + 0.12 * (1 - levenshtein(array_to_string(ta, ' '), array_to_string(tb, ' ')) / greatest(length(array_to_string(ta, ' ')), length(array_to_string(tb, ' '))))
 + 0.08 * CASE WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE 0 END END, 6)::DOUBLE AS lexical FROM x JOIN s USING (a, b) WHERE k > 0),
cx AS (SELECT item_id, rec_id, round(greatest(0, lexical + CASE WHEN lexical >= 0.85 THEN 0.08 ELSE 0.02 END * CASE WHEN it.category = rec.category THEN 1.0 ELSE -0.2 END + 0.55 * CASE WHEN action = 'install' THEN CASE WHEN b LIKE '%new%' THEN 1.0 ELSE -0.15 END ELSE 0 END
 + 0.015 * CASE WHEN unit = 'EA' AND b LIKE '%ring%' THEN 0.5 ELSE 0 END), 6)::DOUBLE AS score FROM it JOIN lx ON a = description || ' ' || trade JOIN rec USING (b)),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rec_id)::INT AS rank FROM cx)
"""


def _context():
    """Signs of the item's category, action and unit in a record and its text."""
    installs = F.col("action") == "install"
    action = F.when(installs, F.when(F.col("b").contains("new"), 1.0).otherwise(-0.15)).otherwise(0.0)
    unit = F.when((F.col("unit") == "EA") & F.col("b").contains("ring"), 0.5).otherwise(0.0)
    most = F.when(installs, 0.55).otherwise(0.0) + F.when(F.col("unit") == "EA", 0.0075).otherwise(0.0)
    return L.Context(F.when(F.col("category") == F.col("e_category"), 1.0).otherwise(-0.2), action, unit, ("category", "action", "unit"), ("action", "unit"), ("e_category",), (-0.2, 1.0), most)


def _lexical(spark, sf_dir, method="levenshtein"):
    """The ten best records of each item with its category, action and unit."""
    rows = items(spark, sf_dir).select("item_id", F.concat_ws(" ", "description", "trade").alias("text"), "category", "action", "unit")
    records = _records(spark, sf_dir).select("rec_id", "text", F.col("category").alias("e_category"))
    return L.retrieve(rows, records, "item_id", "rec_id", _context(), low_information=_LOW, k=10, method=method)


@query("r7_score_lexical", _W + _LEX + "SELECT item_id, rec_id, score, rank FROM rk WHERE rank <= 10")
def r7(spark, sf_dir):
    return _lexical(spark, sf_dir)


@query(
    "r8_resolve",
    _W + _LEX + """, o AS (SELECT *, lead(score) OVER (PARTITION BY item_id ORDER BY rank) AS second FROM rk),
    q AS (SELECT *, CASE WHEN (score >= 1 AND coalesce(second, 0) < 1) OR (score >= 0.77 AND score - coalesce(second, 0) >= 0.01) THEN 'resolved' WHEN score >= 0.48 THEN 'ambiguous' ELSE 'fallback' END AS resolution FROM o WHERE rank = 1)
    SELECT item_id, CASE WHEN resolution <> 'fallback' THEN rec_id END AS rec_id, resolution FROM q""",
)
def r8(spark, sf_dir):
    return L.resolve(_lexical(spark, sf_dir), "item_id", "rec_id")


_SAID = {"remove": ["old", "hot"], "install": ["new"], "replace": ["red", "blue"]}
_MEASURED = {"EA": [" ring ", " bolt "], "SF": [" plate "], "LF": [" gear "]}
_GRADES = ["economy", "standard", "promo"]
_APART = [["small", "large"], ["hot", "cold"], ["red", "blue"]]


def _recommended(spark, sf_dir):
    """Items against the 200 records of their pools that share most words, with similarities, signals, scores and phrases, and what the rows of items stand for.

    Only description, trade, component, material, action, unit and attributes
    count, so one item of each kind is scored for all.
    """
    rows = items(spark, sf_dir).withColumn("grades", F.map_entries("attributes"))
    rows, of = L.representatives(rows, "item_id", ["description", "trade", "component", "material", "action", "unit", "grades", "tokens"])
    rows = rows.withColumn("attributes", F.map_from_entries("grades")).drop("grades")
    records = _records(spark, sf_dir)
    pools, best = _best(spark, rows, records)
    hints = pools.groupBy("item_id").agg(F.array_sort(F.collect_set("category")).alias("hints"))
    entries = records.select("rec_id", F.col("text").alias("e_description"), F.col("category").alias("e_category"))
    pairs = best.select("item_id", "rec_id").distinct().join(rows.drop("tokens"), "item_id").join(hints, "item_id").join(entries, "rec_id")
    pairs, k = L.shared_out(pairs, "item_id", "rec_id"), F.col("rec_id")
    pairs = pairs.withColumns({"verified": k % 9 == 0, "ocr_confidence": F.when(k % 6 == 0, 0.5).when(k % 7 > 0, 0.9), "uncertain": k % 8 == 0})
    return L.explain(L.score_recommendation(L.compatibility(L.similarities(pairs), actions=_SAID, units=_MEASURED, grades=_GRADES, groups=_APART))), of


_HAS = "list_filter({words}, lambda w: contains({text}, w))"
_CLASH = """CASE WHEN len(list_filter([{w}], lambda w: contains(sp, w))) > 0 AND len(list_filter([{w}], lambda w: contains(t, w))) > 0 AND NOT list_has_any(list_filter([{w}], lambda w: contains(sp, w)), list_filter([{w}], lambda w: contains(t, w)))
  THEN array_to_string(list_sort(list_filter([{w}], lambda w: contains(sp, w))), '/') || ' against ' || array_to_string(list_sort(list_filter([{w}], lambda w: contains(t, w))), '/') END"""
_RECOMMENDED = _BEST + """, hs AS (SELECT item_id, list_sort(list(category) FILTER (category IS NOT NULL)) AS hints FROM pools GROUP BY item_id),
p0 AS (SELECT it.*, hints, rec_id, b AS t, rec.category AS e_category, concat_ws(' ', description, action, material) AS sp, concat_ws(' ', description, material) AS im,
  list_filter([CASE WHEN contains(b, 'old') OR contains(b, 'hot') THEN 'remove' END, CASE WHEN contains(b, 'new') THEN 'install' END, CASE WHEN contains(b, 'red') OR contains(b, 'blue') THEN 'replace' END], lambda x: x IS NOT NULL) AS said,
  list_filter([CASE WHEN contains(' ' || b || ' ', ' ring ') OR contains(' ' || b || ' ', ' bolt ') THEN 'EA' END, CASE WHEN contains(' ' || b || ' ', ' plate ') THEN 'SF' END, CASE WHEN contains(' ' || b || ' ', ' gear ') THEN 'LF' END], lambda x: x IS NOT NULL) AS named
  FROM (SELECT DISTINCT item_id, rec_id FROM best) JOIN it USING (item_id) JOIN hs USING (item_id) JOIN rec USING (rec_id)),
p1 AS (SELECT *, hints IS NULL OR list_contains(hints, e_category) AS hinted, CASE WHEN len(said) = 0 THEN 'none' WHEN list_contains(said, action) THEN 'match' ELSE 'conflict' END AS action_state,
  CASE WHEN unit IS NULL THEN 'unknown' WHEN list_contains(named, unit) THEN 'true' WHEN len(named) > 0 THEN 'false' ELSE 'unknown' END AS unit_state,
  len(list_filter(['economy', 'standard', 'promo'], lambda w: contains(im, w))) > 0 AND len(list_filter(['economy', 'standard', 'promo'], lambda w: contains(t, w))) > 0 AND NOT list_has_any(list_filter(['economy', 'standard', 'promo'], lambda w: contains(im, w)), list_filter(['economy', 'standard', 'promo'], lambda w: contains(t, w))) AS grade_conflict,
  list_filter([""" + ", ".join(_CLASH.format(w=w) for w in ("'small', 'large'", "'hot', 'cold'", "'red', 'blue'")) + """], lambda x: x IS NOT NULL) AS distinctions,
  CASE WHEN contains(t, description) OR contains(description, t) THEN 1.0 ELSE 1 - levenshtein(description, t)::DOUBLE / greatest(length(description), length(t)) END::DOUBLE AS ds, CASE WHEN list_contains(string_split(t, ' '), component) THEN 1 ELSE 0 END AS cs,
  CASE WHEN material IS NULL THEN 0.3 WHEN contains(material, t) OR contains(t, material) THEN 1.0 WHEN 1 - levenshtein(material, t)::DOUBLE / greatest(length(material), length(t)) >= 0.35 THEN 1 - levenshtein(material, t)::DOUBLE / greatest(length(material), length(t)) ELSE 0 END::DOUBLE AS ms,
  CASE WHEN grade IS NULL THEN 0.3 WHEN contains(t, grade) THEN 1.0 ELSE 0.4 END::DOUBLE AS gs, rec_id % 9 = 0 AS verified, CASE WHEN rec_id % 6 = 0 THEN 0.5 WHEN rec_id % 7 > 0 THEN 0.9 END::DOUBLE AS ocr, rec_id % 8 = 0 AS uncertain FROM p0),
p2 AS (SELECT *, floor(ds * 300 * 10)::INT + CASE WHEN hinted THEN 2000 ELSE 0 END + cs * 1500 + floor(ms * 100 * 10)::INT + CASE action_state WHEN 'match' THEN 1000 WHEN 'conflict' THEN 0 ELSE 500 END + floor(gs * 50 * 10)::INT + CASE WHEN verified THEN 500 ELSE 0 END + CASE unit_state WHEN 'true' THEN 500 WHEN 'false' THEN 0 ELSE 250 END AS points FROM p1),
rc AS (SELECT *, least(10000, greatest(0, greatest(0, least(points, CASE WHEN hinted THEN 10000 ELSE 5000 END, CASE WHEN action_state = 'conflict' THEN 4500 ELSE 10000 END, CASE WHEN unit_state = 'false' THEN 5500 ELSE 10000 END, CASE WHEN grade_conflict OR len(distinctions) > 0 THEN 4500 ELSE 10000 END)
  - CASE WHEN ocr < 0.85 THEN floor(least(0.1::DOUBLE, (0.85::DOUBLE - ocr) * 0.1::DOUBLE) * 10000)::INT ELSE 0 END) - CASE WHEN uncertain THEN 1500 ELSE 0 END))::INT AS score FROM p2)
"""


@query("r4_compatibility", _RECOMMENDED + "SELECT item_id, rec_id, hinted AS category_hinted, action_state, unit_state, grade_conflict, distinctions FROM rc")
def r4(spark, sf_dir):
    scored, of = _recommended(spark, sf_dir)
    return L.spread(of, scored.select("item_id", "rec_id", "category_hinted", "action_state", "unit_state", "grade_conflict", "distinctions"), "item_id")


@query("r5_score_recommendation", _RECOMMENDED + "SELECT item_id, rec_id, score FROM rc")
def r5(spark, sf_dir):
    scored, of = _recommended(spark, sf_dir)
    return L.spread(of, scored.select("item_id", "rec_id", "score"), "item_id")


@query(
    "r6_explain",
    _RECOMMENDED + """SELECT item_id, rec_id, list_filter([CASE WHEN ds >= 0.85 THEN 'description matches closely' WHEN ds >= 0.55 THEN 'description shares much wording' END, CASE WHEN hints IS NOT NULL AND hinted THEN 'category expected' END, CASE WHEN cs >= 0.5 THEN 'component in the entry''s text' END,
      CASE WHEN ms >= 0.99 THEN 'material in the entry''s text' WHEN ms >= 0.55 THEN 'material similar' END, CASE WHEN action_state = 'match' THEN 'action matches' END, CASE WHEN gs >= 0.99 THEN 'attribute in the entry''s text' END, CASE WHEN unit_state = 'true' THEN 'unit matches' END, CASE WHEN verified THEN 'verified entry' END], lambda x: x IS NOT NULL) AS match_reasons,
    list_concat(list_concat(list_filter([CASE WHEN hints IS NOT NULL AND NOT hinted THEN 'category unexpected' END, CASE WHEN action_state = 'conflict' THEN 'action conflicts' END, CASE WHEN unit_state = 'false' THEN 'unit conflicts' END, CASE WHEN grade_conflict THEN 'grade conflicts' END], lambda x: x IS NOT NULL), distinctions),
      list_filter([CASE WHEN ocr < 0.85 THEN 'poorly read entry' END, CASE WHEN uncertain THEN 'uncertain entry' END], lambda x: x IS NOT NULL)) AS penalties FROM rc""",
)
def r6(spark, sf_dir):
    scored, of = _recommended(spark, sf_dir)
    return L.spread(of, scored.select("item_id", "rec_id", "match_reasons", "penalties"), "item_id")


@query(
    "t4_merge_candidates",
    _RECOMMENDED + """, ms1 AS (SELECT item_id, rec_id, score, 0 AS source_no FROM rc WHERE verified UNION ALL SELECT item_id, rec_id, score, 1 FROM rc), f1 AS (SELECT *, row_number() OVER (PARTITION BY item_id, rec_id ORDER BY source_no, score DESC) AS first FROM ms1)
    SELECT item_id, rec_id, score, source_no, row_number() OVER (PARTITION BY item_id ORDER BY source_no, score DESC, rec_id)::INT AS rank FROM f1 WHERE first = 1""",
)
def t4(spark, sf_dir):
    scored, of = _recommended(spark, sf_dir)
    scored = scored.select("item_id", "rec_id", "score", "verified")
    return L.spread(of, L.merge_candidates("item_id", "rec_id", scored.where("verified"), scored), "item_id")


@query(
    "r11_break_exact_ties",
    """WITH s AS (SELECT p_partkey // 4 AS item_id, p_partkey AS key, p_type AS category, CASE WHEN p_partkey % 4 < 2 + p_partkey // 4 % 2 THEN 90 ELSE 50 END AS score, CASE WHEN p_partkey // 4 % 5 = 0 THEN p_name ELSE 'same' END AS text FROM part), m AS (SELECT *, max(score) OVER (PARTITION BY item_id) AS most FROM s),
    t AS (SELECT *, category IN ('ECONOMY', 'SMALL', 'PROMO') AS hinted FROM m WHERE score = most), g AS (SELECT item_id, count(*) AS n, count(DISTINCT text) AS x, count(DISTINCT category) AS c, count(*) FILTER (hinted) AS h, max(key) FILTER (hinted) AS w FROM t GROUP BY item_id)
    SELECT item_id, CASE WHEN n = 2 AND x = 1 AND c = 2 AND h = 1 THEN w END AS winner, CASE WHEN n = 1 THEN 'no tie' WHEN x > 1 THEN 'texts differ' WHEN n > 2 THEN 'more than two' WHEN c = 1 THEN 'one category' WHEN h = 0 THEN 'no hint' WHEN h = 2 THEN 'both hinted' ELSE 'decided' END AS reason FROM g""",
)
def r11(spark, sf_dir):
    k = F.col("p_partkey")
    item = F.floor(k / 4)
    text = F.when(item % 5 == 0, F.col("p_name")).otherwise("same")
    scored = read(spark, sf_dir, "part").select(item.alias("item_id"), k.alias("key"), F.col("p_type").alias("category"), F.when(k % 4 < 2 + item % 2, 90).otherwise(50).alias("score"), text.alias("text"))
    hints = scored.select("item_id", F.explode(F.array(*map(F.lit, ("ECONOMY", "SMALL", "PROMO")))).alias("category")).distinct()
    return L.break_exact_ties(scored, hints, "item_id", "key")


def _verified(spark, sf_dir):
    """Verified records: one for each name and type of part; some of any component, some of any component and trade."""
    rows = read(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("key"), F.min("p_size").alias("p_size"))
    words, k, n = F.split("p_name", " "), F.col("key"), F.col("p_size")
    none = F.array().cast("array<string>")
    return rows.select(
        "key", F.upper(words[1]).alias("description"), F.array("p_name").alias("aliases"), F.when(k % 50 == 0, None).otherwise(F.lower("p_type")).alias("trade"), F.when(k % 25 == 0, "unknown").otherwise(words[1]).alias("component"),
        F.when(n % 2 == 0, F.lower(_pick(_UNITS, n))).alias("unit"), F.when(n % 3 == 0, F.array(F.lit("remove"), F.lit("install"))).otherwise(none).alias("actions"), F.when(n % 5 == 0, F.array(F.lit("Red"))).otherwise(none).alias("negatives"),
    )


_VER = """, ve AS (SELECT min(p_partkey) AS key, split_part(p_name, ' ', 2) AS d, p_name AS al, lower(p_type) AS vt, min(p_size) AS vs FROM part GROUP BY p_name, p_type),
vf AS (SELECT *, CASE WHEN vs % 2 = 0 THEN ['EA', 'SF', 'LF'][vs % 3 + 1] END AS vu FROM ve),
vm AS (SELECT item_id, key FROM it JOIN vf ON (key % 25 = 0 OR component = d) AND (key % 50 = 0 OR trade = vt) AND (unit IS NULL OR vu IS NULL OR unit = vu) AND (vs % 3 <> 0 OR action IN ('remove', 'install')) AND NOT (vs % 5 = 0 AND contains(description, 'red')) AND (contains(description, d) OR contains(d, description) OR contains(description, al) OR contains(al, description)))
"""


@query("j7_verified_matches", _W + _VER + "SELECT item_id, key FROM vm")
def j7(spark, sf_dir):
    return L.verified_matches(items(spark, sf_dir), _verified(spark, sf_dir))


@query(
    "j8_resolve_or_search",
    _W + _VER + """, rg AS (SELECT trade || '|' || component || '|' || coalesce(material, '-') AS signature, min(item_id) AS key FROM it WHERE item_id % 3 = 0 AND item_id % 2 = 0 GROUP BY 1), v AS (SELECT item_id, min(key) AS v_key FROM vm GROUP BY item_id)
    SELECT item_id, CASE WHEN rg.key IS NOT NULL THEN 'registry' WHEN v_key IS NOT NULL THEN 'verified' ELSE 'search' END AS path, coalesce(rg.key, v_key) AS key FROM it LEFT JOIN rg ON signature = trade || '|' || component || '|' || coalesce(material, '-') LEFT JOIN v USING (item_id)""",
)
def j8(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("signature", F.concat_ws("|", "trade", "component", F.coalesce("material", F.lit("-"))))
    registry = rows.where("item_id % 3 = 0").select("signature", F.col("item_id").alias("key"), (F.col("item_id") % 2 == 0).alias("reusable"))
    return L.resolve_or_search(rows, registry, L.verified_matches(items(spark, sf_dir), _verified(spark, sf_dir)))


@query(
    "j17_semantic_rerank",
    """WITH c AS (SELECT a.vec_id AS item_id, b.vec_id AS entry, ((a.vec_id * 7 + b.vec_id) % 100) / 100.0::DOUBLE AS score, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0),
    d AS (SELECT item_id, entry, 0.82 * score + 0.18 * least(1, greatest(0, s)) AS combined FROM c) SELECT item_id, entry, round(combined, 6) AS combined, row_number() OVER (PARTITION BY item_id ORDER BY combined DESC, entry)::INT AS rank FROM d""",
)
def j17(spark, sf_dir):
    """Queries are the vectors whose id is divisible by 100, candidates all vectors of their label."""
    v = read(spark, sf_dir, "embeddings")
    a, b = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("item_id"), "embedding", "label"), v.select(F.col("vec_id").alias("entry"), "embedding", "label")
    pairs = a.select("item_id", "label").join(b.select("entry", "label"), "label").select("item_id", "entry", ((F.col("item_id") * 7 + F.col("entry")) % 100 / 100.0).alias("score"))
    return L.semantic_rerank(pairs, a, b, "item_id", "entry").withColumn("combined", F.round("combined", 6))


_TASKS = "t AS (SELECT user_id AS group_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id AS task_id, CASE event_type WHEN 'click' THEN 'remove' WHEN 'purchase' THEN 'install' ELSE 'other' END AS action, event_id % 2 AS component FROM events)"


@query(
    "j10_detected_pairs",
    """WITH t AS (SELECT l_orderkey AS doc_id, l_linestatus AS group_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord, CASE l_returnflag WHEN 'R' THEN 'remove' WHEN 'A' THEN 'install' ELSE 'unknown' END AS action,
      CASE WHEN l_partkey % 7 > 0 THEN 'roof' ELSE 'unknown' END AS trade, CASE WHEN l_suppkey % 4 = 0 THEN 'vent' ELSE 'tile' END AS component, [NULL, 'a', 'b'][l_partkey % 3 + 1] AS material, ['EA', 'ea', 'EA', NULL, 'SF'][l_quantity::INT % 5 + 1] AS unit FROM lineitem),
    k AS (SELECT *, doc_id * 100 + ord AS task_id FROM t), x AS (SELECT a.doc_id, a.task_id AS a, b.task_id AS b, CASE WHEN a.group_id <> b.group_id THEN 'group' WHEN a.trade = 'unknown' OR b.trade <> a.trade THEN 'trade' WHEN a.component <> b.component THEN 'component'
      WHEN a.material <> b.material THEN 'material' WHEN a.unit IS NULL OR b.unit IS NULL OR upper(a.unit) <> upper(b.unit) THEN 'unit' WHEN abs(a.ord - b.ord) > 1 THEN 'far' ELSE 'fits' END AS test FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.action = 'remove' AND b.action <> 'remove'),
    p AS (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM x WHERE test = 'fits'), s AS (SELECT a, max(na) AS na, max(nb) AS nb, min(b) AS b FROM p GROUP BY a), c AS (SELECT a, test, count(*) AS n FROM x WHERE test NOT IN ('fits', 'far') GROUP BY ALL),
    l AS (SELECT a, string_agg(test || ':' || n, ',' ORDER BY test) AS near FROM c GROUP BY a)
    SELECT doc_id, task_id AS a, CASE WHEN na = 1 AND nb = 1 THEN b END AS b, CASE WHEN b IS NULL THEN 'no_candidates' WHEN na > 1 THEN 'ambiguous' WHEN nb > 1 THEN 'not mutually unique' ELSE 'confirmed' END AS reason, coalesce(near, '') AS near FROM k LEFT JOIN s ON s.a = task_id LEFT JOIN l ON l.a = task_id WHERE action = 'remove'""",
)
def j10_detected(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    tasks = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("group_id"), F.row_number().over(order).alias("ord"), F.when(F.col("l_returnflag") == "R", "remove").when(F.col("l_returnflag") == "A", "install").otherwise("unknown").alias("action"),
        F.when(F.col("l_partkey") % 7 > 0, "roof").otherwise("unknown").alias("trade"), F.when(F.col("l_suppkey") % 4 == 0, "vent").otherwise("tile").alias("component"), F.get(F.array(F.lit(None), F.lit("a"), F.lit("b")), F.col("l_partkey") % 3).alias("material"),
        F.get(F.array(*map(F.lit, ("EA", "ea", "EA", None, "SF"))), F.col("l_quantity").cast("int") % 5).alias("unit"),
    ).withColumn("task_id", F.col("doc_id") * 100 + F.col("ord"))
    counts = F.transform(F.array_sort(F.map_entries("near")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return L.detect_pairs(tasks).withColumn("near", F.array_join(counts, ","))


@query(
    "j10_pair_complements",
    "WITH " + _TASKS + """, p AS (SELECT a.task_id AS a, b.task_id AS b FROM t a JOIN t b ON a.group_id = b.group_id AND a.component = b.component AND a.action = 'remove' AND b.action = 'install' AND abs(a.ord - b.ord) = 1),
    n AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM p)
    SELECT DISTINCT t.group_id, t.task_id AS a, CASE WHEN na = 1 AND nb = 1 THEN n.b END AS b, CASE WHEN n.b IS NULL THEN 'no_candidates' WHEN na > 1 THEN 'ambiguous' WHEN nb > 1 THEN 'not mutually unique' ELSE 'confirmed' END AS reason FROM t LEFT JOIN n ON n.a = t.task_id WHERE action = 'remove'""",
)
def j10(spark, sf_dir):
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "click", "remove").when(F.col("event_type") == "purchase", "install").otherwise("other")
    tasks = e.select(F.col("user_id").alias("group_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"), F.col("event_id").alias("task_id"), action.alias("action"), (F.col("event_id") % 2).alias("component"), F.lit("EA").alias("unit"))
    return L.pair_complements(tasks)
