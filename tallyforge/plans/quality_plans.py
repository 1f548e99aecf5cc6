"""Queries of survivorship, validation, evaluation, registries and work lists; orders stand for reviewed rows, parts for a catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import catalog as C
from tallyforge.operators import linkage as L
from tallyforge.operators import review as V
from tallyforge.plans import linkage_plans as LP
from tallyforge.plans._register import query, read
from tallyforge.plans.review_plans import _ITEMS, _items


def _case(n, *values):
    """The n-th of the values, a null where one is None."""
    out = F.lit(None)
    for i, v in enumerate(values):
        if v is not None:
            out = F.when(n == i, v).otherwise(out)
    return out


# --- ready rows -------------------------------------------------------------


def _ready(spark, sf_dir):
    items = _items(spark, sf_dir)
    orders = read(spark, sf_dir, "orders")
    verified = orders.select(F.col("o_orderpriority").alias("category"), F.concat(F.lit("S"), (F.col("o_orderkey") % 40).cast("string")).alias("selector"), (F.col("o_orderkey") % 40 % 3 == 0).alias("verified")).distinct()
    own = orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderpriority").alias("category"), F.concat(F.lit("S"), (F.col("o_orderkey") % 40).cast("string")).alias("selector"))
    groups = orders.where("o_orderpriority in ('1-URGENT', '5-LOW')").select(F.col("o_orderpriority").alias("group"))
    return V.automation_ready(items, verified, own, groups)


_READY = _ITEMS + ", rd AS (SELECT *, status = 'approved' AND blocks = '' AND (item_id % 40 % 3 = 0 OR item_id % 4 = 0) AND group_name IN ('1-URGENT', '5-LOW') AS ready FROM items) "


@query("p9_automation_ready", _READY + "SELECT item_id, ready FROM rd")
def p9(spark, sf_dir):
    return _ready(spark, sf_dir).select("item_id", "ready")


@query("a13_coverage_stats", _READY + "SELECT count(*) AS items, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (selector IS NULL) AS no_selector, count(*) FILTER (blocks <> '') AS blocked, count(*) FILTER (status = 'approved' AND NOT ready) AS awaiting, count(*) FILTER (ready) AS ready FROM rd")
def a13(spark, sf_dir):
    return V.coverage_stats(_ready(spark, sf_dir))


# --- catalogs ---------------------------------------------------------------


@query(
    "j16_real_ground_truth",
    """WITH s AS (SELECT doc_id AS item_id FROM labels WHERE quality = 1 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0)
    SELECT doc_id AS item_id FROM documents WHERE doc_id IN (SELECT item_id FROM s) AND doc_id % 13 <> 0 AND doc_id % 5 <> 0""",
)
def j16(spark, sf_dir):
    k = F.col("doc_id")
    states = read(spark, sf_dir, "labels").select(k.alias("item_id"), F.when(F.col("quality") == 1, "approved").otherwise("rejected").alias("status"), F.when(k % 7 == 0, "Synthetic user").otherwise("ann").alias("reviewer"), F.when(k % 11 == 0, "from a demo run").alias("note"))
    items = read(spark, sf_dir, "documents").select(k.alias("item_id"), F.col("source").alias("category"), F.when(k % 5 > 0, F.col("lang")).alias("selector"))
    overrides = read(spark, sf_dir, "documents").where("doc_id % 13 = 0").select(k.alias("item_id"), F.lit("Demo value").alias("reason"))
    return V.real_ground_truth(states, items, overrides, ["synthetic", "demo"]).select("item_id")


@query(
    "j18_resolve_malformed",
    """WITH c AS (SELECT p_partkey AS key, p_name AS d, p_brand AS b, p_size % 3 AS s, p_partkey % 5 > 0 AS ok FROM part)
    SELECT x.key, min(y.key) FILTER (y.s <> x.s) AS into, CASE WHEN min(y.key) FILTER (y.s <> x.s) IS NULL THEN 'open' ELSE 'resolved' END AS state FROM c x LEFT JOIN c y ON y.ok AND y.d = x.d AND y.b = x.b WHERE NOT x.ok GROUP BY x.key""",
)
def j18(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("description_normalized"), F.col("p_brand").alias("category"), F.array(F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))).alias("sources"), (F.col("p_partkey") % 5 > 0).alias("well_formed"))
    return C.resolve_malformed(rows)


@query(
    "j20_catalog_fix_from_reparse",
    "SELECT p_partkey AS key, ['legitimate', 'fixed', 'flagged', 'flagged'][p_size % 4 + 1] AS state, CASE p_size % 4 WHEN 2 THEN p_name || ' XX' WHEN 3 THEN 'lost' ELSE p_name END AS description FROM part",
)
def j20(spark, sf_dir):
    n, name = F.col("p_size") % 4, F.col("p_name")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), _case(n, name, F.concat(name, F.lit(" SF")), F.concat(name, F.lit(" XX")), F.lit("lost")).alias("description"))
    return C.catalog_fix(rows, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), name.alias("description")))


_HARVESTED = """WITH h AS (SELECT p_name || '/' || p_brand AS key, p_partkey AS seq, CASE p_partkey % 5 WHEN 1 THEN substr(full_, 1, 9) || '...' WHEN 2 THEN full_ || ' x' WHEN 3 THEN full_ || 's' ELSE full_ END AS description, CASE WHEN p_size % 6 > 0 THEN (p_size % 4) * 0.25 END::DOUBLE AS confidence,
  CASE WHEN p_size % 3 = 0 THEN 'T' || p_size END AS title, 's' || p_size % 4 AS source FROM (SELECT *, p_name || ' ' || lower(p_type) AS full_ FROM part)) """


def _harvested(spark, sf_dir):
    k, n, full = F.col("p_partkey"), F.col("p_size"), F.concat_ws(" ", "p_name", F.lower("p_type"))
    description = _case(k % 5, full, F.concat(F.substring(full, 1, 9), F.lit("...")), F.concat(full, F.lit(" x")), F.concat(full, F.lit("s")), full)
    return read(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_name", "p_brand").alias("key"), k.alias("seq"), description.alias("description"), F.when(n % 6 > 0, (n % 4) * 0.25).alias("confidence"), F.when(n % 3 == 0, F.concat(F.lit("T"), n.cast("string"))).alias("title"), F.concat(F.lit("s"), (n % 4).cast("string")).alias("source"),
    )


@query(
    "a10_merge_records",
    _HARVESTED + """, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY description LIKE '%...', coalesce(confidence, 0) DESC, length(description) DESC, seq) AS r FROM h),
    b AS (SELECT key, max(description) FILTER (r = 1) AS kept, max(confidence) FILTER (r = 1) AS confidence, arg_min(title, seq) FILTER (title IS NOT NULL) AS title, list_sort(list(DISTINCT source)) AS sources, count(*) AS n FROM r GROUP BY key),
    o AS (SELECT key, list_sort(list(DISTINCT description)) AS conflicts FROM r JOIN b USING (key) WHERE description <> kept AND 1 - levenshtein(description, kept)::DOUBLE / greatest(length(description), length(kept)) < 0.9
      AND NOT (starts_with(kept, regexp_replace(description, '\\.{2,}$', '')) AND length(regexp_replace(description, '\\.{2,}$', '')) < length(kept)) GROUP BY key)
    SELECT key, kept AS description, confidence, title, sources, n, coalesce(conflicts, []::VARCHAR[]) AS conflicts, conflicts IS NOT NULL AS conflicting FROM b LEFT JOIN o USING (key)""",
)
def a10(spark, sf_dir):
    return C.merge_records(_harvested(spark, sf_dir), "key")


@query(
    "a11_corroborated_label",
    """WITH v AS (SELECT source AS g, CASE WHEN length(source) % 2 = 0 THEN 'en' ELSE 'other' END AS own, doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS label FROM documents),
    c AS (SELECT g, own, label, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT g, sum(n)::BIGINT AS total, max(n) AS n FROM c GROUP BY g)
    SELECT c.g AS "group", own, label, c.n, total FROM c JOIN t ON t.g = c.g AND t.n = c.n WHERE label <> own AND c.n >= 2 AND c.n * 2 > total""",
)
def a11(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    votes = d.select(F.col("source").alias("group"), F.when(F.length("source") % 2 == 0, "en").otherwise("other").alias("own"), F.col("doc_id").alias("source"), F.when(F.col("lang") == "en", "en").otherwise("other").alias("label"))
    return C.corroborated_label(votes)


@query(
    "a22_validate_catalog",
    """WITH c AS (SELECT p_partkey // 2 * 2 + CASE WHEN p_partkey % 50 = 1 THEN 0 ELSE p_partkey % 2 END AS id, lower(p_type) AS trade, p_name || p_size AS component, p_size % 4 AS a, p_partkey % 9 = 0 AS bad_unit, p_partkey AS k FROM part),
    s AS (SELECT trade, component, a, bad_unit FROM c GROUP BY ALL HAVING count(DISTINCT id) > 1)
    SELECT id AS mapping_id, 'repeated id' AS problem FROM c GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'overlapping shape' FROM c JOIN s USING (trade, component, a, bad_unit)
    UNION ALL SELECT id, unnest(list_filter([CASE WHEN bad_unit THEN 'unknown unit' END, CASE WHEN a = 3 THEN 'unknown action' END, CASE WHEN trade = 'promo' THEN 'unknown trade' END, CASE WHEN k % 31 = 0 THEN 'unknown status' END, CASE WHEN k % 31 > 0 AND k % 3 = 0 THEN 'verified by nobody' END,
      CASE WHEN k % 17 = 0 THEN 'empty key' END, CASE WHEN k % 19 = 0 THEN 'empty description' END, CASE WHEN k % 23 = 0 THEN 'no provenance' END], lambda x: x IS NOT NULL)) FROM c""",
)
def a22(spark, sf_dir):
    k = F.col("p_partkey")
    action = _case(F.col("p_size") % 4, F.array(F.lit("install"), F.lit("remove")), F.array(F.lit("remove")), F.array().cast("array<string>"), F.array(F.lit("vanish")))
    rows = read(spark, sf_dir, "part").select(
        (k - k % 2 + F.when(k % 50 == 1, 0).otherwise(k % 2)).alias("mapping_id"), F.lower("p_type").alias("trade"), F.concat("p_name", F.col("p_size").cast("string")).alias("component"), action.alias("actions"), F.when(k % 9 == 0, F.array(F.lit("EA"), F.lit("QQ"))).otherwise(F.array(F.lit("EA"))).alias("units"),
        F.when(k % 31 == 0, "odd").otherwise("verified").alias("status"), F.when(k % 3 > 0, "ann").alias("verified_by"), F.when(k % 17 > 0, "S").alias("selector"), F.when(k % 19 > 0, "text").otherwise("  ").alias("description"), F.when(k % 23 > 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("sources"),
    )
    return C.validate_catalog(rows, T.UNITS, ["install", "remove"], ["economy", "small", "medium", "standard", "large"], ["verified", "proposed"])


@query(
    "a22_overlapping_shapes",
    """WITH c AS (SELECT p_partkey AS id, p_type AS trade, p_brand || p_size AS component, [['install', 'remove'], ['remove', 'detach'], [], ['paint'], ['detach']][p_partkey % 5 + 1] AS a, [['EA', 'SF'], ['LF'], [], ['SF', 'LF']][p_partkey % 4 + 1] AS u FROM part)
    SELECT x.id AS mapping_id, min(y.id) AS other FROM c x JOIN c y ON x.trade = y.trade AND x.component = y.component AND x.id <> y.id AND (len(x.a) = 0 OR len(y.a) = 0 OR list_has_any(x.a, y.a)) AND (len(x.u) = 0 OR len(y.u) = 0 OR list_has_any(x.u, y.u)) GROUP BY x.id""",
)
def a22_overlaps(spark, sf_dir):
    """Lists that only overlap, and lists for all."""
    k = F.col("p_partkey")
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    rows = read(spark, sf_dir, "part").select(
        k.alias("mapping_id"), F.col("p_type").alias("trade"), F.concat("p_brand", F.col("p_size").cast("string")).alias("component"), _case(k % 5, strings("install", "remove"), strings("remove", "detach"), strings(), strings("paint"), strings("detach")).alias("actions"),
        _case(k % 4, strings("EA", "SF"), strings("LF"), strings(), strings("SF", "LF")).alias("units"),
    )
    return C.overlapping_shapes(rows)


@query(
    "a23_price_observations",
    """SELECT l_partkey AS key, l_returnflag AS price_list, l_extendedprice AS unit_price, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_shipdate, l_extendedprice)::INT AS observation_no,
    row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_shipdate DESC, l_extendedprice DESC) = 1 AS is_latest FROM lineitem""",
)
def a23(spark, sf_dir):
    nested = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("price_list"), F.col("l_extendedprice").alias("unit_price"), F.col("l_shipdate").alias("observed_at"))).alias("observations"))
    return C.price_observations(nested).select("key", "price_list", "unit_price", "observation_no", "is_latest")


@query(
    "a23_price_lists",
    """SELECT l_partkey AS key, l_returnflag AS price_list, count(*) AS n, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at, arg_max(l_extendedprice, {'d': l_shipdate, 'p': l_extendedprice}) AS latest_price FROM lineitem GROUP BY ALL""",
)
def a23_lists(spark, sf_dir):
    nested = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("price_list"), F.col("l_extendedprice").alias("unit_price"), F.col("l_shipdate").alias("observed_at"))).alias("observations"))
    return C.price_lists(nested)


@query("t3_fuzzy_search", "SELECT p_partkey AS key, p_name AS description, 1 - levenshtein(p_name, 'small rings')::DOUBLE / greatest(length(p_name), 11) AS similarity FROM part WHERE p_brand = 'Brand#2' ORDER BY similarity DESC, key LIMIT 10")
def t3(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("description"), F.col("p_brand").alias("category"))
    return C.fuzzy_search(rows, "small rings", "Brand#2")


_GROUPS, _ALIASES = ["Red Ring", "small bolts", "gizmo", "plate"], {"hot gear": "Gears", "old anvil": "Anvils"}
_GROUP_SQL = ", ".join(f"{{'tier': CASE WHEN n = '{g.lower()}' THEN 4 WHEN contains(n, '{g.lower()}') OR contains('{g.lower()}', n) THEN 2 WHEN s{i} >= 0.6 THEN 1 ELSE 0 END, 'points': CASE WHEN n = '{g.lower()}' THEN 1000 WHEN contains(n, '{g.lower()}') OR contains('{g.lower()}', n) THEN 750 + floor(least(0.2::DOUBLE, least(length(n), {len(g)})::DOUBLE / greatest(length(n), {len(g)})) * 1000)::INT ELSE floor(s{i} * 1000)::INT END, 'ord': {-i}, 'g': '{g}', 'how': CASE WHEN n = '{g.lower()}' THEN 'exact' WHEN contains(n, '{g.lower()}') OR contains('{g.lower()}', n) THEN 'substring' ELSE 'fuzzy' END}}" for i, g in enumerate(_GROUPS))


def _suggestions(spark, sf_dir):
    return C.suggest_group(read(spark, sf_dir, "part").select(F.col("p_name").alias("name")), _GROUPS, _ALIASES)


_SUGGESTED = "WITH d AS (SELECT DISTINCT p_name AS name, lower(p_name) AS n FROM part), e AS (SELECT *, " + ", ".join(f"1 - levenshtein(n, '{g.lower()}')::DOUBLE / greatest(length(n), {len(g)}) AS s{i}" for i, g in enumerate(_GROUPS)) + " FROM d), f AS (SELECT name, n, list_filter([" + _GROUP_SQL + """], lambda x: x.tier > 0) AS o FROM e),
sg AS (SELECT name, CASE WHEN n = 'hot gear' AND coalesce(list_max(list_transform(o, lambda x: x.tier)), 0) < 3 THEN {'tier': 3, 'points': 950, 'ord': 0, 'g': 'Gears', 'how': 'alias'} WHEN n = 'old anvil' AND coalesce(list_max(list_transform(o, lambda x: x.tier)), 0) < 3 THEN {'tier': 3, 'points': 950, 'ord': -1, 'g': 'Anvils', 'how': 'alias'} ELSE list_sort(o, 'DESC')[1] END AS b FROM f)
"""


@query("t5_suggest_group", _SUGGESTED + "SELECT name, b.g AS suggestion, coalesce(b.how, 'none') AS how, coalesce(b.points, 0) AS points FROM sg")
def t5(spark, sf_dir):
    return _suggestions(spark, sf_dir)


@query("u2_review_queue", _HARVESTED + "SELECT seq AS key, 'poorly read' AS reason FROM h WHERE confidence < 0.5 UNION ALL SELECT seq, 'cut off' FROM h WHERE description LIKE '%...' UNION ALL SELECT seq, 'no title' FROM h WHERE title IS NULL")
def u2(spark, sf_dir):
    rows = _harvested(spark, sf_dir).drop("key").withColumnRenamed("seq", "key")
    return C.review_queue(("poorly read", rows.where("confidence < 0.5")), ("cut off", rows.where(F.col("description").endswith("..."))), ("no title", rows.where("title is null")))


# --- evaluation -------------------------------------------------------------


@query(
    "a15_evaluate_ranking",
    """WITH r AS (SELECT p_partkey // 10 AS q, p_partkey AS key, p_partkey % 10 + 1 AS rank, p_partkey // 10 % 3 = 0 AS resolved FROM part), t AS (SELECT DISTINCT q, q * 10 + q % 12 AS key, CASE WHEN q % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM r),
    m AS (SELECT t.q, t.key, kind, h.rank, coalesce(top.resolved, false) AS auto, top.key AS top_key FROM t LEFT JOIN r h ON h.q = t.q AND h.key = t.key LEFT JOIN r top ON top.q = t.q AND top.rank = 1)
    SELECT kind, count(*) AS cases, round(avg((coalesce(rank, 99) <= 1)::INT), 6) AS top_1, round(avg((coalesce(rank, 99) <= 3)::INT), 6) AS top_3, round(avg((coalesce(rank, 99) <= 5)::INT), 6) AS top_5, round(avg((coalesce(rank, 99) <= 10)::INT), 6) AS top_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr,
      round(avg(auto::INT), 6) AS coverage, count(*) FILTER (auto AND top_key <> key) AS wrong_but_resolved FROM m GROUP BY GROUPING SETS ((kind), ())""",
)
def a15(spark, sf_dir):
    k, q = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    ranked = read(spark, sf_dir, "part").select(q.alias("query_id"), k.alias("key"), (k % 10 + 1).alias("rank"), (q % 3 == 0).alias("resolved"))
    truth = ranked.select("query_id").distinct().select("query_id", (F.col("query_id") * 10 + F.col("query_id") % 12).alias("key"), F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    out = V.evaluate_ranking(ranked, truth, (1, 3, 5, 10), "kind")
    return out.withColumns({c: F.round(c, 6) for c in ("top_1", "top_3", "top_5", "top_10", "mrr", "coverage")})


def _states(spark, sf_dir):
    """Parts in tens: some have verified records, scores of several levels, a placeholder or nothing."""
    k, part = F.col("p_partkey"), read(spark, sf_dir, "part")
    rows = part.select(F.floor(k / 10).alias("item_id"), k.alias("key"), (k * 37 % 101 - F.floor(k / 10) % 9 * 10).alias("score"))
    verified = rows.where("item_id % 7 = 0 and key % 10 = 3")
    scored = rows.where("item_id % 5 > 0")
    placeholders = rows.where("item_id % 3 = 0 and key % 10 = 9").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("key")).alias("key"), F.lit(0).cast("bigint").alias("score"))
    return L.candidate_states(rows, "item_id", "key", verified, scored, placeholders, strong=85, possible=65, weak=40)


_STATES = """WITH r AS (SELECT p_partkey // 10 AS item_id, p_partkey AS key, p_partkey * 37 % 101 - p_partkey // 10 % 9 * 10 AS score FROM part),
u AS (SELECT *, 0 AS src FROM r WHERE item_id % 7 = 0 AND key % 10 = 3 UNION ALL SELECT *, 1 FROM r WHERE item_id % 5 > 0 AND score >= 40 UNION ALL SELECT item_id, key, 0, 2 FROM r WHERE item_id % 3 = 0 AND key % 10 = 9 AND item_id % 2 = 0),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY item_id, key ORDER BY src, score DESC) = 1), o AS (SELECT item_id, count(*) AS candidates, arg_min(key, [src, -score, key]) AS first FROM d GROUP BY item_id),
b AS (SELECT item_id, max(score) FILTER (item_id % 5 > 0 AND score >= 40) AS best, bool_or(item_id % 7 = 0 AND key % 10 = 3) AS sure, bool_or(item_id % 3 = 0 AND key % 10 = 9) AS stand_in FROM r GROUP BY item_id),
states AS (SELECT item_id, CASE WHEN sure THEN 'strong' WHEN best >= 85 THEN 'strong' WHEN best >= 65 THEN 'possible' WHEN best >= 40 THEN 'weak' WHEN stand_in THEN 'weak' ELSE 'none' END AS state, coalesce(candidates, 0) AS candidates, first FROM b LEFT JOIN o USING (item_id)) """


@query("t4_candidate_states", _STATES + "SELECT item_id, state, candidates, first FROM states")
def t4_states(spark, sf_dir):
    return _states(spark, sf_dir)


@query("a14_state_stats", _STATES + "SELECT state, count(*) AS n, round(avg(candidates), 3) AS mean_candidates FROM states GROUP BY GROUPING SETS ((state), ())")
def a14_states(spark, sf_dir):
    return V.state_stats(_states(spark, sf_dir))


@query(
    "a13_mapping_coverage",
    """SELECT count(*) AS items, count(*) FILTER (p_partkey % 4 > 0 OR p_partkey % 6 > 0) AS normalized, count(*) FILTER (p_partkey % 5 = 0) AS verified, count(*) FILTER (p_partkey % 5 > 0 AND p_partkey % 3 < 2) AS placeholder_only, count(*) FILTER (p_partkey % 5 > 0 AND p_partkey % 3 = 2) AS no_match,
    count(*) FILTER (p_partkey % 11 = 0) AS unit_conflict, count(*) FILTER (p_size % 2 = 0) AS awaiting, count(*) FILTER (p_partkey % 10 = 0) AS ready FROM part""",
)
def a13_coverage(spark, sf_dir):
    k = F.col("p_partkey")
    items = read(spark, sf_dir, "part").select(
        k.alias("item_id"), F.when(k % 4 > 0, F.lower("p_type")).otherwise("unknown").alias("trade"), F.when(k % 6 > 0, F.col("p_name")).alias("component"), _case(k % 3, F.lit("mapped"), F.lit("partial"), F.lit("unmapped")).alias("mapping_status"),
        F.when(F.col("p_size") % 2 == 0, "unreviewed").otherwise("approved").alias("status"),
    )
    return V.mapping_coverage(items, items.where("item_id % 5 = 0"), items.where("item_id % 11 = 0"), items.where("item_id % 10 = 0"))


@query(
    "a15_compare_rankings",
    """WITH r AS (SELECT p_partkey // 10 AS q, p_partkey AS key, p_partkey % 10 + 1 AS rank, p_partkey // 10 % 3 = 0 AS resolved FROM part), t AS (SELECT DISTINCT q, q * 10 + CASE WHEN q % 4 = 0 THEN 0 ELSE q % 12 END AS key FROM r),
    m AS (SELECT t.q, t.key, h.rank AS now, CASE WHEN h.key % 3 = 0 THEN 11 - h.rank WHEN h.key % 3 = 1 THEN h.rank END AS before, coalesce(top.resolved, false) AS auto, top.key AS top_key FROM t LEFT JOIN r h ON h.q = t.q AND h.key = t.key LEFT JOIN r top ON top.q = t.q AND top.rank = 1)
    SELECT count(*) AS cases, count(*) FILTER (auto) AS resolved, count(*) FILTER (auto AND top_key = key) AS "right", count(*) FILTER (auto AND top_key = key) / nullif(count(*) FILTER (auto), 0) AS accuracy,
      count(*) FILTER (before > now) AS improved, count(*) FILTER (before < now) AS worsened, count(*) FILTER (before = now) AS unchanged, avg(before - now) AS mean_gain FROM m""",
)
def a15_compare(spark, sf_dir):
    k, q = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    ranked = read(spark, sf_dir, "part").select(q.alias("query_id"), k.alias("key"), (k % 10 + 1).alias("rank"), (q % 3 == 0).alias("resolved"))
    baseline = ranked.where("key % 3 < 2").select("query_id", "key", F.when(F.col("key") % 3 == 0, 11 - F.col("rank")).otherwise(F.col("rank")).alias("rank"))
    truth = ranked.select("query_id").distinct().select("query_id", (F.col("query_id") * 10 + F.when(F.col("query_id") % 4 == 0, 0).otherwise(F.col("query_id") % 12)).alias("key"))
    return V.compare_rankings(ranked, baseline, truth)


@query(
    "a16_sweep_policy",
    """WITH o AS (SELECT o_orderkey % 101 AS score, o_custkey % 31 AS margin, NOT (o_orderkey % 101 < 85 OR (o_custkey % 31 < 4 AND o_orderkey % 2 = 0)) AS correct FROM orders), g AS (SELECT s, m FROM range(77, 101) a(s), range(1, 31) b(m)),
    c AS (SELECT s, m, count(score) AS accepted, count(*) FILTER (NOT correct) AS errors FROM g LEFT JOIN o ON score >= s AND margin >= m GROUP BY s, m)
    SELECT accepted, s::INT AS least_score, m::INT AS least_margin FROM c WHERE errors = 0 ORDER BY accepted DESC, s, m LIMIT 1""",
)
def a16(spark, sf_dir):
    score, margin = F.col("o_orderkey") % 101, F.col("o_custkey") % 31
    wrong = (score < 85) | ((margin < 4) & (F.col("o_orderkey") % 2 == 0))
    return V.sweep_policy(read(spark, sf_dir, "orders").select(score.alias("score"), margin.alias("margin"), (~wrong).alias("correct")), range(77, 101), range(1, 31))


@query("a17_reuse_stats", "SELECT count(*) AS items, count(*) FILTER (o_orderkey % 3 = 0) AS by_registry, count(*) FILTER (o_orderkey % 3 = 2) AS searched, count(*) FILTER (o_orderkey % 7 = o_orderkey % 5) AS agree FROM orders")
def a17(spark, sf_dir):
    k = F.col("o_orderkey")
    return V.reuse_stats(read(spark, sf_dir, "orders").select(_case(k % 3, F.lit("registry"), F.lit("verified"), F.lit("search")).alias("path"), (k % 7).alias("key"), (k % 5).alias("truth")))


@query(
    "a20_run_rollup",
    """WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS task_id, ['completed', 'review', 'no_match', 'failed', 'skipped', 'pending'][(o_orderkey % 6 + 1)::INT] AS state, ['registry', 'verified', 'search'][(o_orderkey % 3 + 1)::INT] AS route, o_orderdate AS touched, CASE WHEN o_orderkey % 6 = 3 THEN 'stopped at ' || o_orderkey END AS cause FROM orders)
    SELECT doc_id, count(*) AS tasks, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'review') AS review, count(*) FILTER (state = 'no_match') AS no_match, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state = 'pending') AS pending,
      count(*) FILTER (route = 'registry') AS by_registry, count(*) FILTER (route = 'verified') AS by_verified, count(*) FILTER (route = 'search') AS by_search, list(task_id ORDER BY touched DESC, task_id DESC)[1] AS last_touched, (list(cause ORDER BY touched, task_id) FILTER (cause IS NOT NULL))[1] AS first_cause FROM t GROUP BY doc_id""",
)
def a20(spark, sf_dir):
    k = F.col("o_orderkey")
    tasks = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), k.alias("task_id"), _case(k % 6, *map(F.lit, V.STATES)).alias("state"), _case(k % 3, F.lit("registry"), F.lit("verified"), F.lit("search")).alias("route"), F.col("o_orderdate").alias("touched"),
        F.when(k % 6 == 3, F.concat(F.lit("stopped at "), k.cast("string"))).alias("cause"),
    )
    return V.run_rollup(tasks, "doc_id")


@query(
    "r10_decide_evidence",
    """WITH s AS (SELECT p_partkey // 4 AS item_id, p_partkey AS key, p_type AS category, CASE WHEN p_partkey % 40 < 4 THEN 7500 - (p_partkey % 4) * 2000 WHEN p_partkey % 60 < 4 THEN 10000 - p_partkey % 4 * 20 WHEN p_partkey % 28 < 4 THEN CASE WHEN p_partkey % 4 < 2 THEN 9000 ELSE 100 END ELSE p_partkey * 37 % 50 * 100 + p_partkey // 4 * 13 % 51 * 100 END AS score,
      CASE WHEN p_partkey // 4 % 5 = 0 THEN p_name ELSE 'same' END AS text, p_partkey % 9 = 0 AS conflict, p_partkey % 3 > 0 AS act, CASE WHEN p_partkey % 14 = 0 THEN 0.3 ELSE 0.9 END AS confidence FROM part WHERE p_partkey // 4 % 11 > 0),
    r AS (SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, 0) AS second, max(score) OVER (PARTITION BY item_id) AS most FROM s WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, key)),
    t AS (SELECT item_id, CASE WHEN count(*) = 2 AND count(DISTINCT text) = 1 AND count(DISTINCT category) = 2 AND count(*) FILTER (category IN ('ECONOMY', 'SMALL', 'PROMO')) = 1 THEN max(key) FILTER (category IN ('ECONOMY', 'SMALL', 'PROMO')) END AS winner FROM r WHERE score = most GROUP BY item_id),
    i AS (SELECT DISTINCT p_partkey // 4 AS item_id FROM part), g AS (SELECT i.item_id, key, score, second, score - second AS margin, winner, conflict, confidence, score >= 7000 AND NOT conflict AND confidence >= 0.8 AND act AND score - second >= 2000 AND second < 6000 AS dominant FROM i LEFT JOIN r ON r.item_id = i.item_id AND r = 1 LEFT JOIN t ON t.item_id = i.item_id),
    d AS (SELECT *, CASE WHEN score IS NULL THEN 'no candidates' WHEN score < 5500 THEN 'below review floor' WHEN score < 8800 AND dominant THEN 'dominant below floor' WHEN score < 8800 THEN 'below accept floor' WHEN conflict THEN 'conflict' WHEN confidence < 0.8 THEN 'low confidence' WHEN margin >= 800 THEN 'clear margin' WHEN score >= 9990 AND second < 9990 THEN 'exact best'
      WHEN margin > 0 THEN 'thin margin' WHEN winner IS NOT NULL THEN 'tie decided by hint' ELSE 'tie, first taken' END AS gate FROM g),
    e AS (SELECT *, CASE WHEN gate IN ('no candidates', 'below review floor') THEN 'no_match' WHEN gate IN ('below accept floor', 'conflict', 'low confidence', 'thin margin') THEN 'review' ELSE 'accepted' END AS decision FROM d)
    SELECT item_id, decision, gate, CASE WHEN decision = 'accepted' THEN CASE WHEN gate = 'tie decided by hint' THEN winner ELSE key END END AS key, score, second, margin FROM e""",
)
def r10(spark, sf_dir):
    k = F.col("p_partkey")
    item = F.floor(k / 4)
    score = F.when(k % 40 < 4, 7500 - (k % 4) * 2000).when(k % 60 < 4, 10000 - k % 4 * 20).when(k % 28 < 4, F.when(k % 4 < 2, 9000).otherwise(100)).otherwise(k * 37 % 50 * 100 + item * 13 % 51 * 100)
    rows = read(spark, sf_dir, "part").select(
        item.alias("item_id"), k.alias("key"), F.col("p_type").alias("category"), score.alias("score"), F.when(item % 5 == 0, F.col("p_name")).otherwise("same").alias("text"), (k % 9 == 0).alias("conflict"), (k % 3 > 0).alias("action_confirmed"), F.when(k % 14 == 0, 0.3).otherwise(0.9).alias("confidence"),
    )
    hints = rows.select("item_id", F.explode(F.array(*map(F.lit, ("ECONOMY", "SMALL", "PROMO")))).alias("category")).distinct()
    return V.decide_evidence(rows.select("item_id"), rows.where("item_id % 11 > 0"), hints, "item_id", "key")  # some items have no candidates


@query(
    "r12_relaxed_queries",
    """WITH a AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'no such thing' END AS t0, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CASE WHEN p_partkey % 5 = 0 THEN 'neither' ELSE split_part(p_name, ' ', 2) END END AS t1, p_brand AS t2 FROM part),
    x AS (SELECT p_name AS text FROM part UNION ALL SELECT split_part(p_name, ' ', 2) FROM part WHERE p_size < 40), n AS (SELECT text, count(*) AS hits FROM x GROUP BY text),
    h AS (SELECT item_id, 0 AS attempt, hits FROM a JOIN n ON text = t0 UNION ALL SELECT item_id, 1, hits FROM a JOIN n ON text = t1 UNION ALL SELECT item_id, 2, hits FROM a JOIN n ON text = t2)
    SELECT item_id, attempt, hits FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY attempt) = 1""",
)
def r12(spark, sf_dir):
    k, second = F.col("p_partkey"), F.split("p_name", " ")[1]
    part = read(spark, sf_dir, "part")
    rows = part.select(k.alias("item_id"), F.when(k % 3 == 0, F.col("p_name")).otherwise("no such thing").alias("exact"), F.when(k % 4 != 0, F.when(k % 5 == 0, "neither").otherwise(second)).alias("compact"), F.col("p_brand").alias("generic"))
    index = part.select(F.col("p_name").alias("text")).unionByName(part.where("p_size < 40").select(second.alias("text")))
    return V.relaxed_queries(rows, ["exact", "compact", "generic"], index)


@query(
    "r12_staged_search",
    """WITH a AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' || lower(p_type) ELSE p_name || ' absent' END AS t0, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'neither' ELSE split_part(p_name, ' ', 2) || ' brand ' || p_size END AS t1, split_part(p_name, ' ', 1) AS t2 FROM part),
    r AS (SELECT p_partkey AS rec_id, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size), '[a-z0-9]+')) AS tk FROM part),
    q AS (SELECT item_id, unnest([0, 1, 2]) AS attempt, unnest([t0, t1, t2]) AS text FROM a), d AS (SELECT text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS own FROM (SELECT DISTINCT text FROM q WHERE text IS NOT NULL)),
    h AS (SELECT text, count(*) AS hits, min(rec_id) AS first FROM d JOIN r ON list_has_all(tk, own) GROUP BY text)
    SELECT item_id, attempt, hits, first FROM q JOIN h USING (text) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY attempt) = 1""",
)
def r12_staged(spark, sf_dir):
    k, part = F.col("p_partkey"), read(spark, sf_dir, "part")
    words, kind = F.split("p_name", " "), F.lower("p_type")
    rows = part.select(
        k.alias("item_id"), F.concat_ws(" ", "p_name", F.when(k % 3 == 0, kind).otherwise("absent")).alias("exact"),
        F.when(k % 4 != 0, F.when(k % 5 == 0, "neither").otherwise(F.concat_ws(" ", words[1], F.lit("brand"), F.col("p_size").cast("string")))).alias("compact"), words[0].alias("generic"),
    )
    records = part.select(k.alias("rec_id"), T.tokens(F.concat_ws(" ", "p_name", "p_type", "p_brand", F.col("p_size").cast("string"))).alias("tokens"))
    return V.staged_search(rows, ["exact", "compact", "generic"], records, "rec_id")


# --- registries and work lists ----------------------------------------------


def _registry(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders")
    registry = orders.where("o_orderkey % 3 > 0").select(k.alias("signature"), (k % 5).alias("key"), (k % 4 > 0).alias("approved"), (k % 7).alias("uses"))
    new = orders.where("o_orderkey % 2 = 0").select(k.alias("signature"), F.when(k % 8 == 0, k % 5).otherwise(9).alias("key"), F.when(k % 11 > 0, "ann").otherwise("").alias("reviewer"), F.when(k % 13 > 0, "seen").alias("reason"), (k % 10 == 0).alias("override"))
    return V.upsert_registry(registry, new)


_REGISTRY = """WITH m AS (SELECT o_orderkey AS k, o_orderkey % 3 > 0 AS here, o_orderkey % 5 AS old, o_orderkey % 4 > 0 AS ok, o_orderkey % 7 AS uses, o_orderkey % 2 = 0 AND o_orderkey % 11 > 0 AND o_orderkey % 13 > 0 AS told, CASE WHEN o_orderkey % 8 = 0 THEN o_orderkey % 5 ELSE 9 END AS new, o_orderkey % 10 = 0 AS override FROM orders),
c AS (SELECT *, here AND told AND ok AND old <> new AND NOT override AS conflict FROM m) """


@query("b2_registry_merged", _REGISTRY + "SELECT k AS signature, CASE WHEN conflict OR NOT told THEN old ELSE new END AS key, (here AND ok) OR (told AND NOT conflict) AS approved, (CASE WHEN here THEN uses ELSE 0 END + CASE WHEN told AND NOT conflict THEN 1 ELSE 0 END) AS uses FROM c WHERE here OR told")
def b2(spark, sf_dir):
    return _registry(spark, sf_dir)[0]


@query("b2_registry_conflicts", _REGISTRY + "SELECT k AS signature, old, new FROM c WHERE conflict")
def b2_conflicts(spark, sf_dir):
    return _registry(spark, sf_dir)[1]


@query(
    "b2_registry_history",
    _REGISTRY + """, s AS (SELECT *, CASE WHEN here OR told THEN CASE WHEN (here AND ok) OR (told AND NOT conflict) THEN 'approved' ELSE 'proposed' END END AS before FROM c)
    SELECT k AS signature, CASE WHEN conflict OR NOT told THEN old ELSE new END AS key, CASE WHEN k % 6 = 0 THEN 'disabled' ELSE before END AS status, (CASE WHEN here THEN uses ELSE 0 END + CASE WHEN told AND NOT conflict THEN 1 ELSE 0 END)::BIGINT AS uses,
    list_filter([CASE WHEN here THEN 'none -> ' || CASE WHEN ok THEN 'approved' ELSE 'proposed' END END, CASE WHEN told AND NOT conflict AND NOT (here AND ok) THEN CASE WHEN here THEN 'proposed' ELSE 'none' END || ' -> approved' END, CASE WHEN k % 6 = 0 THEN before || ' -> disabled' END], lambda x: x IS NOT NULL) AS events
    FROM s WHERE here OR told""",
)
def b2_history(spark, sf_dir):
    """A log of imports, resolutions and disablings, the last two of which are appended twice; its fold is the registry."""
    k, orders = F.col("o_orderkey"), read(spark, sf_dir, "orders")
    log_of = lambda df, n, action, **values: df.select(
        (k * 10 + n).alias("event_id"), k.alias("signature"), F.lit(n).alias("at"), F.lit(action).alias("action"),
        *(values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in (("key", "long"), ("status", "string"), ("uses", "long"), ("reviewer", "string"), ("reason", "string"), ("override", "boolean"))),
    )
    log = log_of(orders.where("o_orderkey % 3 > 0"), 1, "import", key=k % 5, status=F.when(k % 4 > 0, "approved").otherwise("proposed"), uses=k % 7)
    new = log_of(orders.where("o_orderkey % 2 = 0"), 2, "record", key=F.when(k % 8 == 0, k % 5).otherwise(9), reviewer=F.when(k % 11 > 0, "ann").otherwise(""), reason=F.when(k % 13 > 0, "seen"), override=k % 10 == 0)
    new = new.unionByName(log_of(orders.where("o_orderkey % 6 = 0"), 3, "disable", reviewer=F.lit("bob"), reason=F.lit("old")))
    for _ in range(2):
        log = log.unionByName(V.append_events(log, new))
    return V.fold_registry(log)[0]


def _added(spark, sf_dir):
    part, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    records = part.select(k.alias("key"), F.when(k % 6 > 0, F.col("p_name")).otherwise(" ").alias("description"), F.when(k % 7 > 0, "EA").otherwise("QQ").alias("unit"), F.when(k % 2 == 0, "verified").otherwise("proposed").alias("status"), (k % 5).alias("confirmations"), F.when(k % 9 > 0, "ann").alias("reviewer"))
    return V.add_verified(part.where("p_size = 1").select(k.alias("key")), records, T.UNITS)


_ADDED = """WITH a AS (SELECT p_partkey AS key, concat_ws('; ', CASE WHEN p_partkey % 6 = 0 THEN 'no description' END, CASE WHEN p_size = 1 THEN 'key exists' END, CASE WHEN p_partkey % 7 = 0 THEN 'unknown unit' END, CASE WHEN p_partkey % 2 = 0 AND (p_partkey % 5 < 3 OR p_partkey % 9 = 0) THEN 'not confirmed' END) AS reasons FROM part) """


@query("b3_added", _ADDED + "SELECT key FROM a WHERE reasons = ''")
def b3(spark, sf_dir):
    return _added(spark, sf_dir)[0].select("key")


@query("b3_rejected", _ADDED + "SELECT key, reasons FROM a WHERE reasons <> ''")
def b3_rejected(spark, sf_dir):
    return _added(spark, sf_dir)[1].withColumn("reasons", F.concat_ws("; ", "reasons"))


@query(
    "b7_reset_unfinished",
    """WITH t AS (SELECT o_orderkey AS k, ['done', 'committed', 'active', 'failed', 'pending', 'skipped', 'failed'][(o_orderkey % 7 + 1)::INT] AS state FROM orders), p AS (SELECT x.k AS a, y.k AS b, x.state AS sa, y.state AS sb FROM t x JOIN t y ON y.k = x.k + 1 WHERE x.k % 4 = 0),
    h AS (SELECT unnest([a, b]) AS k FROM p WHERE sa IN ('done', 'committed', 'active') OR sb IN ('done', 'committed', 'active'))
    SELECT k AS task_id, state, CASE WHEN state IN ('done', 'committed') OR k IN (SELECT k FROM h) THEN state ELSE 'pending' END AS new_state FROM t""",
)
def b7(spark, sf_dir):
    k = F.col("o_orderkey")
    tasks = read(spark, sf_dir, "orders").select(k.alias("task_id"), _case(k % 7, *map(F.lit, ("done", "committed", "active", "failed", "pending", "skipped", "failed"))).alias("state"))
    pairs = tasks.where("task_id % 4 = 0").select(F.col("task_id").alias("pair_id"), F.col("task_id").alias("a"), (F.col("task_id") + 1).alias("b"))
    pairs = pairs.join(tasks.select(F.col("task_id").alias("b")), "b")
    return V.reset_unfinished(tasks, pairs)


@query(
    "b7_reset_transitions",
    """WITH t AS (SELECT ['done', 'committed', 'active', 'failed', 'pending', 'skipped', 'failed'][(o_orderkey % 7 + 1)::INT] AS state FROM orders)
    SELECT state, 'pending' AS new_state, count(*) AS n, state <> 'pending' AS changed FROM t GROUP BY state""",
)
def b7_full(spark, sf_dir):
    """A full reset, counted."""
    k = F.col("o_orderkey")
    tasks = read(spark, sf_dir, "orders").select(k.alias("task_id"), _case(k % 7, *map(F.lit, ("done", "committed", "active", "failed", "pending", "skipped", "failed"))).alias("state"))
    return V.reset_transitions(V.reset_unfinished(tasks, tasks.select(F.col("task_id").alias("pair_id"), F.col("task_id").alias("a"), F.col("task_id").alias("b")), full=True))


_WORK = _ITEMS + """, w AS (SELECT *, CASE WHEN mapped THEN 'mapped' WHEN skipped THEN 'skipped' WHEN trim(description) = '' THEN 'missing description' WHEN quantity <= 0 THEN 'bad quantity' WHEN unit IS NULL THEN 'missing unit' WHEN group_name IS NULL THEN 'unresolved group' ELSE 'eligible' END AS bucket, category IS NOT NULL AND selector IS NOT NULL AS keyed,
  CASE WHEN group_name LIKE '1%' THEN 'Urgent' ELSE group_name END AS group_id FROM items), x AS (SELECT * FROM w WHERE status = 'approved' OR (NOT keyed AND status <> 'rejected' AND bucket = 'eligible')), y AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, group_id) AS first FROM x)
"""


@query("b4_build_work_list", _WORK + "SELECT doc_id, group_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY first, group_id)::INT AS group_no, row_number() OVER (PARTITION BY doc_id, group_id ORDER BY ord, item_id)::INT AS task_no, item_id, CASE WHEN keyed THEN 'key' ELSE 'search' END AS mode, CASE WHEN status = 'approved' AND NOT keyed THEN 'approved without a key' END AS problem FROM y")
def b4(spark, sf_dir):
    items = V.bucket_unmapped(_items(spark, sf_dir))
    names = items.select(F.col("group").alias("name")).distinct()
    suggestions = C.suggest_group(names, ["1-URGENT"], {}).where("how = 'exact'").withColumn("suggestion", F.lit("Urgent"))
    return V.build_work_list(items, suggestions, include_unmapped=True)


@query(
    "b5_shadow_plan",
    LP._W + LP._LEX + """, o AS (SELECT *, lead(score) OVER (PARTITION BY item_id ORDER BY rank) AS second FROM rk),
    q AS (SELECT item_id, CASE WHEN (score >= 1 AND coalesce(second, 0) < 1) OR (score >= 0.77 AND score - coalesce(second, 0) >= 0.01) THEN 'resolved' WHEN score >= 0.48 THEN 'ambiguous' ELSE 'fallback' END AS resolution FROM o WHERE rank = 1)
    SELECT size AS doc_id, coalesce(resolution, 'fallback') AS resolution, count(*) AS n, count(*) FILTER (coalesce(resolution, 'fallback') <> 'resolved') AS n_fallback FROM it LEFT JOIN q USING (item_id) GROUP BY ALL""",
)
def b5(spark, sf_dir):
    resolved = L.resolve(LP._lexical(spark, sf_dir), "item_id", "rec_id")
    return V.shadow_plan(resolved, LP.items(spark, sf_dir).select(F.col("size").alias("doc_id"), "item_id"), "none")
