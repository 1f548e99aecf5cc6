"""Queries of one-to-one matching, of capped and custom candidates and of evidence scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import evidence as E
from tallyforge.operators import linkage as L
from tallyforge.operators import pairing as M
from tallyforge.plans import linkage_plans as LP
from tallyforge.plans._register import query, read


@query(
    "j11_collapse_pairs_fifo",
    """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, event_id AS item_id, event_type = 'click' AS rm, CASE WHEN event_type IN ('click', 'purchase') THEN 'part ' ELSE event_type || ' ' END || event_id % 3 AS text, event_id % 4 AS q, event_id % 7 > 0 AS ok FROM events),
    c AS (SELECT *, sum((ok AND rm)::INT) OVER w AS r, sum((ok AND NOT rm)::INT) OVER w AS b FROM e WINDOW w AS (PARTITION BY user_id, text ORDER BY ord)), t AS (SELECT *, b + least(0, min(r - b) OVER (PARTITION BY user_id, text ORDER BY ord)) AS taken FROM c),
    k AS (SELECT *, ok AND NOT rm AND taken > coalesce(lag(taken) OVER (PARTITION BY user_id, text ORDER BY ord), 0) AS claimed FROM t)
    SELECT x.user_id, x.ord::INT AS ord, x.item_id, y.item_id AS base_id, y.item_id IS NOT NULL AND x.q <> y.q AS quantity_differs FROM k x LEFT JOIN k y ON y.claimed AND x.ok AND x.rm AND y.user_id = x.user_id AND y.text = x.text AND y.taken = x.r WHERE NOT x.claimed""",
)
def j11(spark, sf_dir):
    """A user's clicks remove a part, purchases are the part."""
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "Remove  part ").when(F.col("event_type") == "purchase", "Part ").otherwise(F.concat("event_type", F.lit(" ")))
    rows = read(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"), k.alias("item_id"), F.concat(kind, (k % 3).cast("string")).alias("description"), (k % 4).alias("quantity"), (k % 7 > 0).alias("resolved"))
    return M.collapse_pairs_fifo(rows, ["user_id"])


@query(
    "j13_one_to_one_reconcile",
    """WITH p AS (SELECT c_nationkey AS g, c_name AS name FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_nationkey, c_name FROM customer WHERE c_custkey % 13 = 0 UNION ALL SELECT c_nationkey, '#' FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT c_nationkey, substr(c_name, 10) FROM customer WHERE c_custkey % 17 = 0),
    o AS (SELECT c_nationkey AS g, c_custkey AS row_id, '* ' || c_name || ' (seen)' AS text FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT c_nationkey, -c_custkey, c_name FROM customer WHERE c_custkey % 7 = 0),
    n AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS n, count(*) OVER (PARTITION BY g, regexp_replace(lower(name), '[^a-z0-9]', '', 'g')) > 1 AS same FROM p), r AS (SELECT *, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t FROM o),
    m AS (SELECT DISTINCT n.g, name, row_id FROM n JOIN r ON r.g = n.g AND contains(t, n) WHERE n <> '' AND NOT same), c AS (SELECT g, name, count(*) AS k, min(row_id) AS row_id FROM m GROUP BY ALL), s AS (SELECT g, name, count(*) OVER (PARTITION BY g, row_id) AS names FROM c WHERE k = 1),
    d AS (SELECT n.g, n.name, row_id, CASE WHEN n = '' THEN 'empty name' WHEN same THEN 'repeated name' WHEN k IS NULL THEN 'no row' WHEN k > 1 THEN 'several rows' WHEN names > 1 THEN 'row of two names' END AS problem FROM n LEFT JOIN c ON c.g = n.g AND c.name = n.name LEFT JOIN s ON s.g = n.g AND s.name = n.name)
    SELECT g AS group_id, name, CASE WHEN problem IS NULL THEN row_id END AS row_id, problem FROM d""",
)
def j13(spark, sf_dir):
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    of = lambda name, when: c.where(when).select(F.col("c_nationkey").alias("group_id"), name.alias("name"))
    planned = of(F.col("c_name"), k % 3 > 0).unionByName(of(F.col("c_name"), k % 13 == 0)).unionByName(of(F.lit("#"), k % 11 == 0)).unionByName(of(F.substr("c_name", F.lit(10)), k % 17 == 0))
    seen = lambda row, text, when: c.where(when).select(F.col("c_nationkey").alias("group_id"), row.alias("row_id"), text.alias("text"))
    observed = seen(k, F.concat(F.lit("* "), F.col("c_name"), F.lit(" (seen)")), k % 5 > 0).unionByName(seen(-k, F.col("c_name"), k % 7 == 0))
    return M.one_to_one_reconcile(planned, observed)


@query(
    "j15_preview_rule_effect",
    LP._W + LP._VER + """, w AS (SELECT p_partkey AS item_id, ['approved', 'unreviewed', 'rejected'][p_size % 3 + 1] AS status, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS c, CASE WHEN p_partkey % 4 > 0 THEN 'S' || p_size % 2 END AS s FROM part),
    m AS (SELECT key, item_id, 'Brand#' || (key % 5 + 1) AS kc, 'S' || key % 2 AS ks, status, c, s FROM vm JOIN w USING (item_id))
    SELECT key, item_id, CASE WHEN status = 'approved' THEN 'conflict' WHEN c IS NOT NULL OR s IS NOT NULL THEN 'changed' ELSE 'new' END AS effect FROM m WHERE NOT (c IS NOT DISTINCT FROM kc AND s IS NOT DISTINCT FROM ks)""",
)
def j15(spark, sf_dir):
    records = LP._verified(spark, sf_dir).withColumns({"category": F.concat(F.lit("Brand#"), (F.col("key") % 5 + 1).cast("string")), "selector": F.concat(F.lit("S"), (F.col("key") % 2).cast("string"))})
    has = F.col("item_id") % 4 > 0
    reviewed = {"status": F.element_at(F.array(*map(F.lit, ("approved", "unreviewed", "rejected"))), (F.col("size") % 3 + 1).cast("int")), "row_category": F.when(has, F.col("category")), "row_selector": F.when(has, F.concat(F.lit("S"), (F.col("size") % 2).cast("string")))}
    return M.preview_rule_effect(records, LP.items(spark, sf_dir).withColumns(reviewed))


@query("t6_first_n_per_query", "SELECT user_id AS query_id, event_id AS position, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 15")
def t6(spark, sf_dir):
    return M.first_n_per_query(read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("position"), "value"))


@query("u4_set_difference", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def u4(spark, sf_dir):
    return M.set_difference(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])


@query(
    "u4_token_sets",
    "WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS a, [lower(p_type), split_part(p_name, ' ', 2), 'x'] AS b FROM part) SELECT p_partkey, list_sort(list_intersect(a, b)) AS common, list_sort(list_distinct(list_concat(a, b))) AS either, list_filter(a, lambda w: NOT list_contains(b, w)) AS only_a FROM t",
)
def u4_tokens(spark, sf_dir):
    a, b = T.tokens(F.col("p_name")), F.array(F.lower("p_type"), F.split("p_name", " ")[1], F.lit("x"))
    out = M.token_sets(read(spark, sf_dir, "part").withColumns({"a": a, "b": b}), "a", "b")
    return out.select("p_partkey", F.array_sort("common").alias("common"), F.array_sort("either").alias("either"), "only_a")


_WORDS = E.Vocabulary(materials=[("red", "red paint"), ("blue", "blue paint"), ("hot", "hot metal")], styles=[("economy", "economy"), ("standard", "standard")], actions={"remove": "old", "install": "new"}, structures=["plate"])


@query(
    "r9_score_evidence",
    LP._BEST + """, q0 AS (SELECT DISTINCT item_id, rec_id, description || ' ' || trade AS i, b AS t, component, material AS m0, action, CASE WHEN size % 4 = 0 THEN '5' END AS s, CASE WHEN item_id % 3 > 0 THEN trade END AS g, rec_id % 9 = 0 AS verified FROM best JOIN it USING (item_id) JOIN rec USING (rec_id)),
    q1 AS (SELECT *, CASE action WHEN 'remove' THEN 'old' WHEN 'install' THEN 'new' END AS said, list_filter([CASE WHEN contains(t, 'red') THEN 'red paint' END, CASE WHEN contains(t, 'blue') THEN 'blue paint' END, CASE WHEN contains(t, 'hot') THEN 'hot metal' END], lambda x: x IS NOT NULL) AS named,
      coalesce(m0, CASE WHEN contains(i, 'red') THEN 'red paint' WHEN contains(i, 'blue') THEN 'blue paint' WHEN contains(i, 'hot') THEN 'hot metal' END) AS m, list_filter([CASE WHEN contains(t, 'economy') THEN 'economy' END, CASE WHEN contains(t, 'standard') THEN 'standard' END], lambda x: x IS NOT NULL) AS grades FROM q0),
    q2 AS (SELECT *, CASE WHEN m IS NULL THEN NULL WHEN contains(t, m) OR contains(m, t) OR list_has_any(string_split(m, ' '), string_split(t, ' ')) OR list_contains(named, m) THEN 'MATCH' WHEN len(named) > 0 THEN 'CONFLICT' ELSE 'UNSPECIFIED' END AS material_state, CASE WHEN s IS NOT NULL THEN 'UNSPECIFIED' END AS size_state,
      CASE WHEN (contains(t, 'economy') AND NOT contains(i, 'economy')) OR (contains(t, 'standard') AND NOT contains(i, 'standard')) THEN 'CONFLICT' WHEN g IS NULL THEN NULL WHEN contains(t, g) THEN 'MATCH' WHEN len(grades) > 0 AND NOT list_contains(grades, g) THEN 'CONFLICT' ELSE 'UNSPECIFIED' END AS grade_state,
      CASE WHEN said IS NULL THEN NULL WHEN contains(t, said) THEN 'MATCH' ELSE 'CONFLICT' END AS action_state, list_contains(string_split(t, ' '), component) AND NOT (list_contains(string_split(t, ' '), 'plate') AND component <> 'plate' AND NOT contains(i, 'plate')) AS component_ok,
      CASE WHEN i = t THEN 1.0 WHEN contains(t, i) THEN length(i)::DOUBLE / length(t) WHEN contains(i, t) AND NOT coalesce(contains(replace(i, t, ''), said) AND NOT contains(t, said), false) THEN 1.0 ELSE 1 - levenshtein(i, t)::DOUBLE / greatest(length(i), length(t)) END::DOUBLE AS d FROM q1),
    q3 AS (SELECT *, 25 * d + CASE WHEN component_ok THEN 25.0 ELSE 0 END + CASE material_state WHEN 'MATCH' THEN 15.0 WHEN 'UNSPECIFIED' THEN 7.5 ELSE 0 END + CASE WHEN s IS NOT NULL THEN 5.0 ELSE 0 END + CASE WHEN said IS NULL THEN 0 WHEN action_state = 'MATCH' THEN 10.0 ELSE 5.0 END + CASE WHEN g IS NULL THEN 0 WHEN grade_state = 'MATCH' THEN 5.0 WHEN grade_state = 'UNSPECIFIED' THEN 2.5 ELSE 0 END + CASE WHEN verified THEN 5.0 ELSE 0 END AS total,
      50 + CASE WHEN m IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN s IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN said IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN g IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN verified THEN 5 ELSE 0 END AS share FROM q2)
    SELECT item_id, rec_id, material_state, size_state, grade_state, action_state, component_ok, floor(least(total / share * 10000 + 1e-6, CASE WHEN component_ok THEN 10000 ELSE 4500 END, CASE WHEN material_state = 'CONFLICT' THEN 5500 ELSE 10000 END, CASE WHEN grade_state = 'CONFLICT' THEN 5500 ELSE 10000 END, CASE WHEN action_state = 'CONFLICT' THEN 5000 ELSE 10000 END))::INT AS score FROM q3""",
)
def r9(spark, sf_dir):
    """Only the texts, the keys and the pools' trade and component count, so one item of each kind is scored for all."""
    rows = LP.items(spark, sf_dir).withColumns({"size_key": F.when(F.col("size") % 4 == 0, "5"), "grade_key": F.when(F.col("item_id") % 3 > 0, F.col("trade"))})
    rows, of = L.representatives(rows, "item_id", ["description", "trade", "component", "material", "action", "size_key", "grade_key", "tokens"])
    records = LP._records(spark, sf_dir)
    _, best = LP._best(spark, rows, records)
    rows = rows.select("item_id", F.concat_ws(" ", "description", "trade").alias("description"), "component", "material", "action", "size_key", "grade_key")
    pairs = best.select("item_id", "rec_id").distinct().join(rows, "item_id").join(records.select("rec_id", F.col("text").alias("candidate")), "rec_id")
    pairs = L.shared_out(pairs, "item_id", "rec_id").withColumn("verified", F.col("rec_id") % 9 == 0)
    return L.spread(of, E.score_evidence(pairs, _WORDS).select("item_id", "rec_id", "material_state", "size_state", "grade_state", "action_state", "component_ok", "score"), "item_id")


def _offered(spark, sf_dir, **more):
    """The 200 records of a pool that share most words, with a score by their rank, for one item of each description, trade and component (and ``more``), and the items that it stands for."""
    rows, of = L.representatives(LP.items(spark, sf_dir).withColumns(more), "item_id", ["description", "trade", "component", "tokens", *more])
    records = LP._records(spark, sf_dir)
    _, best = LP._best(spark, rows, records)
    best = best.groupBy("item_id", "rec_id").agg(F.min("rank").alias("r"))
    return best.join(rows.select("item_id", F.col("description").alias("a")), "item_id").join(records.select("rec_id", F.col("text").alias("b")), "rec_id").withColumn("score", 1 / F.col("r")), rows, of


_OFFERED = LP._BEST + ", off AS (SELECT item_id, rec_id, min(rank) AS r FROM best GROUP BY ALL), ofx AS (SELECT off.*, it.description AS a, b, 1.0::DOUBLE / r AS score FROM off JOIN it USING (item_id) JOIN rec USING (rec_id))"


def _length_ratio(a, b):
    return np.minimum(a.str.len(), b.str.len()) / np.maximum(a.str.len(), b.str.len())


@query(
    "x1_custom_reranker",
    _OFFERED + ", c AS (SELECT *, round(0.82::DOUBLE * score + 0.18::DOUBLE * (least(length(a), length(b))::DOUBLE / greatest(length(a), length(b))), 9) AS combined FROM ofx) SELECT item_id, rec_id, combined, true AS applied, row_number() OVER (PARTITION BY item_id ORDER BY combined DESC, rec_id)::INT AS rank FROM c",
)
def x1(spark, sf_dir):
    offered, _, of = _offered(spark, sf_dir)
    return L.spread(of, M.rerank_custom(offered, "item_id", "rec_id", _length_ratio), "item_id")


@query(
    "x2_candidate_chooser",
    _OFFERED + """, k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY r, rec_id) AS rank, count(*) OVER (PARTITION BY item_id) AS n FROM off), ch AS (SELECT item_id, max(n) AS n, CASE item_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 99 END AS choice FROM k GROUP BY item_id)
    SELECT ch.item_id, rec_id, CASE WHEN choice IS NULL THEN 'abstained' WHEN choice >= ch.n THEN 'error' ELSE 'chosen' END AS state FROM ch LEFT JOIN k ON k.item_id = ch.item_id AND k.rank = choice + 1""",
)
def x2(spark, sf_dir):
    k = F.col("item_id")
    offered, rows, of = _offered(spark, sf_dir, choice=F.when(k % 4 == 0, 0).when(k % 4 == 1, 2).when(k % 4 == 2, 99))
    ranked = offered.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("r", "rec_id")))
    return L.spread(of, M.choose_candidate(ranked, "item_id", "rec_id", rows.select("item_id", "choice")), "item_id")
