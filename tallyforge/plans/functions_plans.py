"""Queries of the column functions, over columns rendered from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.plans._register import query, read

_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"


def _money(spark, sf_dir):
    """lineitem with amounts as text, in twelve styles."""
    plain, whole = F.format_number("l_extendedprice", 2), F.floor("l_extendedprice").cast("string")
    k = F.pmod(F.col("l_partkey"), F.lit(12))
    raw = (
        F.when(k == 0, plain).when(k == 1, F.concat(F.lit("$"), plain)).when(k == 2, F.concat(F.lit("("), plain, F.lit(")")))
        .when(k == 3, F.concat(F.lit("<"), plain, F.lit(">"))).when(k == 4, F.lit("NA")).when(k == 5, F.concat(F.lit(" -"), plain, F.lit("* ")))
        .when(k == 6, F.lit("(0.00)")).when(k == 7, F.lit("12.x")).when(k == 8, F.concat(F.lit("USD "), plain)).when(k == 9, whole).when(k == 10, F.lit("none")).otherwise("--")
    )  # fmt: skip
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", raw.alias("raw"))


_MONEY = """
WITH m AS (
  SELECT l_orderkey, l_partkey, l_partkey % 12 AS k, CASE l_partkey % 12 WHEN 0 THEN p WHEN 1 THEN '$' || p WHEN 2 THEN '(' || p || ')' WHEN 3 THEN '<' || p || '>'
    WHEN 4 THEN 'NA' WHEN 5 THEN ' -' || p || '* ' WHEN 6 THEN '(0.00)' WHEN 7 THEN '12.x' WHEN 8 THEN 'USD ' || p WHEN 9 THEN floor(l_extendedprice)::BIGINT::VARCHAR WHEN 10 THEN 'none' ELSE '--' END AS raw,
    CASE WHEN l_partkey % 12 IN (0, 1, 2, 3, 5, 8) THEN CAST(l_extendedprice AS DECIMAL(18,2)) WHEN l_partkey % 12 = 6 THEN 0.00 WHEN l_partkey % 12 = 7 THEN 12.00 WHEN l_partkey % 12 = 9 THEN floor(l_extendedprice)::DECIMAL(18,2) END AS amount
  FROM (SELECT *, format('{:,.2f}', l_extendedprice) AS p FROM lineitem)
)
"""


@query("f1_norm_ws", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS normalized FROM documents")
def f1(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.norm_ws(F.col("text")).alias("normalized"))


@query("f2_parse_money", _MONEY + "SELECT l_orderkey, l_partkey, raw, amount::DOUBLE AS amount FROM m")
def f2(spark, sf_dir):
    return _money(spark, sf_dir).withColumn("amount", T.parse_money(F.col("raw")).cast("double"))


@query("f3_parse_percent", "SELECT l_orderkey, l_partkey, l_linenumber, round(l_discount * 100)::DOUBLE AS percent FROM lineitem")
def f3(spark, sf_dir):
    whole = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    raw = F.when(F.pmod("l_partkey", F.lit(2)) == 0, F.concat(whole, F.lit("%"))).otherwise(F.concat(whole, F.lit(" % [M]")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", T.parse_percent(raw).cast("double").alias("percent"))


@query(
    "f4_depreciation_class",
    _MONEY + """SELECT l_orderkey, l_partkey, amount::DOUBLE AS amount, CASE WHEN k = 6 THEN 'none' WHEN k = 2 THEN 'recoverable' WHEN k = 3 THEN 'nonrecoverable' ELSE 'unknown' END AS kind FROM m""",
)
def f4(spark, sf_dir):
    c = T.depreciation_class(F.col("raw"))
    return _money(spark, sf_dir).select("l_orderkey", "l_partkey", c["amount"].cast("double").alias("amount"), c["kind"].alias("kind"))


@query(
    "f5_is_money",
    _MONEY + """SELECT k AS style, k IN (0, 1, 2, 3, 5, 6, 9) AS money, CASE WHEN k IN (2, 6) THEN 'paren' WHEN k = 3 THEN 'angle' ELSE 'plain' END AS brackets, count(*) AS n FROM m GROUP BY ALL""",
)
def f5(spark, sf_dir):
    rows = _money(spark, sf_dir).select(F.pmod("l_partkey", F.lit(12)).alias("style"), T.is_money(F.col("raw")).alias("money"), T.bracket_style(F.col("raw")).alias("brackets"))
    return rows.groupBy("style", "money", "brackets").agg(F.count("*").alias("n"))


@query(
    "f6_parse_date",
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 4 THEN NULL WHEN 5 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T09:57:00' WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T15:00:00' WHEN 7 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T23:05:07' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""",
)
def f6(spark, sf_dir):
    k, d = F.pmod("o_orderkey", F.lit(8)), F.col("o_orderdate")
    day = F.date_format(d, "M/d/yyyy")
    raw = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, day).when(k == 2, F.date_format(d, "MMM d, yyyy")).when(k == 3, F.date_format(d, "M-d-yyyy")).when(k == 4, "NA")
        .when(k == 5, F.concat(day, F.lit("  9:57 AM"))).when(k == 6, F.concat(day, F.lit(" 3:00 pm"))).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T23:05:07")))
    )  # fmt: skip
    return read(spark, sf_dir, "orders").select("o_orderkey", T.parse_date(raw).alias("iso"))


@query("f7_norm_unit", "SELECT p_partkey, nullif(upper(['ea', 'SF', 'lf', 'box', 'gal', ''][(p_size % 6 + 1)::INT]), '') AS unit, p_size % 6 IN (0, 1, 2, 4) AS known FROM part")
def f7(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, (" ea", "SF ", "lf", "box", "gal", "  "))), (F.pmod("p_size", F.lit(6)) + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", T.norm_unit(raw)["unit"].alias("unit"), T.norm_unit(raw)["known"].alias("known"))


@query(
    "f8_norm_description",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(translate(text, '‘’“”–—' || chr(160), '''''""-- '), '…', '...')), '\.{2,}', '.', 'g'), '-{2,}', '-', 'g'), '[ 	

]+', ' ', 'g')) AS normalized
    FROM documents""",
)
def f8(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.norm_description(F.col("text")).alias("normalized"))


@query(
    "f9_norm_catalog",
    """SELECT p_partkey, array_to_string(list_transform(list_transform(regexp_extract_all(lower(p_name || ' ' || p_type || ' GLASSES'), '[a-z0-9]+'),
    lambda w: CASE w WHEN 'lg' THEN 'large' WHEN 'std' THEN 'standard' ELSE w END), lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END), ' ') AS normalized FROM part""",
)
def f9(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", "p_type", F.lit("GLASSES"))
    return read(spark, sf_dir, "part").select("p_partkey", T.norm_catalog(text, {"lg": "large", "std": "standard"}).alias("normalized"))


_VERBS = {"remove": "remove", "r&r": "replace", "detach": "detach", "install": "install", "detach and reset": "reset"}


@query(
    "f10_split_leading_action",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'remove' WHEN 1 THEN 'reset' WHEN 2 THEN 'detach' END AS action, lower(p_name) AS rest FROM part""",
)
def f10(spark, sf_dir):
    verb = F.element_at(F.array(F.lit("Remove "), F.lit("Detach and  reset "), F.lit("DETACH "), F.lit("")), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    c = T.split_leading_action(F.concat(verb, F.col("p_name")), _VERBS)
    return read(spark, sf_dir, "part").select("p_partkey", c["action"].alias("action"), c["rest"].alias("rest"))


@query("f11_tokens", "SELECT doc_id, len(t)::INT AS n_tokens, list_sort(t)[1] AS first_token, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS t FROM documents)")
def f11(spark, sf_dir):
    t = F.array_sort(T.tokens(F.col("text")))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.try_element_at(t, F.lit(1)).alias("first_token"), F.md5(F.array_join(t, " ")).alias("digest"))


@query(
    "f12_size_terms",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'up to ' || p_size WHEN 1 THEN p_size || '-' || (p_size + 5) WHEN 2 THEN p_size || '-' || (p_size + 1) WHEN 3 THEN p_size::VARCHAR END AS size,
    CASE WHEN p_partkey % 5 = 4 THEN p_size || 'x' || (p_size + 2) END AS pair FROM part""",
)
def f12(spark, sf_dir):
    n, k = F.col("p_size").cast("string"), F.pmod("p_partkey", F.lit(5))
    plus = lambda d: (F.col("p_size") + d).cast("string")  # noqa: E731
    raw = (
        F.when(k == 0, F.concat(F.lit("Pipe up to "), n, F.lit("in"))).when(k == 1, F.concat(F.lit("Pipe "), n, F.lit(" - "), plus(5), F.lit(" gal")))
        .when(k == 2, F.concat(n, F.lit(" to "), plus(1), F.lit(" amp"))).when(k == 3, F.concat(n, F.lit(" FT pipe"))).otherwise(F.concat(F.lit("Board "), n, F.lit(" X "), plus(2)))
    )  # fmt: skip
    return read(spark, sf_dir, "part").select("p_partkey", T.size_term(raw).alias("size"), T.dimension_pair(raw).alias("pair"))


_MATERIALS = [("steel", "metal"), ("bolt", "fastener"), ("ring", "round"), ("red", "painted"), ("blue", "painted")]


@query(
    "f13_keyword_term",
    r"""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\bsteel\b') THEN 'metal' WHEN regexp_matches(p_name, '\bbolt\b') THEN 'fastener' WHEN regexp_matches(p_name, '\bring\b') THEN 'round'
    WHEN regexp_matches(p_name, '\b(red|blue)\b') THEN 'painted' END AS term FROM part""",
)
def f13(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.keyword_term(F.col("p_name"), _MATERIALS).alias("term"))


@query(
    "f14_item_signature",
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE p_brand END || '|' || split_part(p_name, ' ', 2) || '|' || split_part(p_name, ' ', 1) || '|' || p_size || '|-|unknown|' || CASE WHEN p_size % 2 = 0 THEN 'EA' ELSE '-' END AS signature FROM part""",
)
def f14(spark, sf_dir):
    words = F.split("p_name", " ")
    signature = T.item_signature(F.when(F.col("p_size") % 3 != 0, F.col("p_brand")), words[1], words[0], F.col("p_size").cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit("ea")))
    return read(spark, sf_dir, "part").select("p_partkey", signature.alias("signature"))


@query("f16_similarity", "SELECT p_partkey, 1 - levenshtein(p_name, lower(p_type))::DOUBLE / greatest(length(p_name), length(p_type)) AS similarity FROM part")
def f16(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.similarity(F.col("p_name"), F.lower("p_type")).alias("similarity"))


@query(
    "f17_material_similarity",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.3 WHEN contains(p_name, a) OR contains(a, p_name) OR contains(p_name, b) OR contains(b, p_name) THEN 1.0 WHEN greatest(s, t) >= 0.55 THEN greatest(s, t) ELSE 0.0 END::DOUBLE AS similarity
    FROM (SELECT *, 1 - levenshtein(p_name, a)::DOUBLE / greatest(length(p_name), length(a)) AS s, 1 - levenshtein(p_name, b)::DOUBLE / greatest(length(p_name), length(b)) AS t
    FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN substr(p_name, 1, 4) ELSE reverse(substr(p_name, 1, 3)) || substr(p_name, 4) END AS a, lower(p_type) AS b FROM part))""",
)
def f17(spark, sf_dir):
    other = F.when(F.col("p_size") % 3 == 0, F.substring("p_name", 1, 4)).otherwise(F.concat(F.reverse(F.substring("p_name", 1, 3)), F.expr("substring(p_name, 4)")))
    terms = F.when(F.col("p_size") % 4 != 0, F.array(other, F.lower("p_type")))
    return read(spark, sf_dir, "part").select("p_partkey", T.material_similarity(F.upper("p_name"), terms).alias("similarity"))


@query(
    "f18_near_duplicates",
    """SELECT p_partkey, (1 - levenshtein(p_name || ' number', p_name || CASE WHEN p_size % 2 = 0 THEN ' numbr' ELSE ' n' END)::DOUBLE / (length(p_name) + 7)) >= 0.9 AS near, p_size % 3 > 0 AS truncated FROM part""",
)
def f18(spark, sf_dir):
    a = F.concat("p_name", F.lit(" number"))
    b = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, " numbr").otherwise(" n"))
    cut = F.when(F.col("p_size") % 3 > 0, F.concat(F.substring("p_name", 1, 5), F.lit("..."))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", T.near_duplicate(a, b).alias("near"), T.truncation_of(cut, F.col("p_name")).alias("truncated"))


@query(
    "f19_word_match",
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN length(w) >= 4 WHEN 3 THEN false WHEN 4 THEN length(w) - 1 >= 4 ELSE split_part(p_name, ' ', 1) = w END AS matches FROM (SELECT p_partkey, p_size, p_name, split_part(p_name, ' ', 2) AS w FROM part)""",
)
def f19(spark, sf_dir):
    w, k = F.split("p_name", " ")[1], F.col("p_size") % 6
    other = F.when(k == 0, w).when(k == 1, F.concat(w, F.lit("s"))).when(k == 2, F.concat(w, F.lit("ing"))).when(k == 3, "zz").when(k == 4, F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(F.split("p_name", " ")[0])
    return read(spark, sf_dir, "part").select("p_partkey", T.word_match(w, other).alias("matches"))


@query(
    "f20_splitters",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS age, CASE WHEN p_size % 2 = 0 THEN p_size + 10 END AS life, CASE WHEN p_size % 3 > 0 THEN p_retailprice END AS value, CASE WHEN p_size % 3 > 0 THEN 'SF' END AS unit,
    CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AB' END AS code, p_name AS name, CASE WHEN p_size % 3 = 0 THEN p_type || ' - x' END AS sub, 'BRAND' AS title, CASE WHEN p_size % 5 > 0 THEN p_size ELSE 0 END AS sequence FROM part""",
)
def f20(spark, sf_dir):
    n = F.col("p_size")
    a = T.age_life(F.when(n % 2 == 0, F.concat(n, F.lit("/"), n + 10, F.lit(" yrs"))).otherwise("n/a"))
    m = T.measurement(F.when(n % 3 > 0, F.concat(F.format_number("p_retailprice", 2), F.lit(" SF Walls"))).otherwise("Walls"))
    c = T.coverage_name(F.when(n % 3 == 0, F.concat(F.lit("Coverage A - "), F.col("p_name"), F.lit(" - "), F.col("p_type"), F.lit(" - x"))).when(n % 3 == 1, F.concat(F.lit("AB-"), F.col("p_name"))).otherwise(F.col("p_name")))
    file = F.when(n % 5 > 0, F.concat(F.lit("A_B_"), n.cast("string"), F.lit("_x.png"))).otherwise("A_B_x.png")
    return read(spark, sf_dir, "part").select(
        "p_partkey", a["age"].alias("age"), a["life"].alias("life"), m["value"].cast("double").alias("value"), m["unit"].alias("unit"), c["code"].alias("code"), c["name"].alias("name"), c["sub"].alias("sub"),
        T.title_category(F.concat(F.lit("The Selectors for "), F.substring("p_brand", 1, 5), F.lit(" now"))).alias("title"), T.sequence_no(F.lit("A_B"), file).alias("sequence"),
    )  # fmt: skip


_STYLES = {
    "fillers": ["for the "], "leading": [("small", "compact")], "modifiers": [("hot", "heated"), ("cold", "cooled")], "components": [("ring", "o-ring"), ("bolt", "bolt"), ("gear", "gear wheel")],
    "materials": [("red", "red 3-tab")], "grades": [("economy", "economy grade"), ("standard", "standard grade")], "actions": {"remove": "removal", "install": "install wheel"},
}  # fmt: skip


@query(
    "f15_search_phrase",
    """WITH t AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, lower(p_type) AS g, p_size AS n FROM part),
    u AS (SELECT p_partkey, n, CASE WHEN a = 'small' OR g = 'small' THEN 'compact' END AS l, CASE WHEN a = 'hot' THEN 'heated' WHEN a = 'cold' THEN 'cooled' END AS m, CASE b WHEN 'ring' THEN 'o ring' WHEN 'bolt' THEN 'bolt' WHEN 'gear' THEN 'gear wheel' ELSE CASE WHEN n % 2 = 0 THEN 'steel plate' END END AS c,
      CASE WHEN a = 'red' THEN 'red 3 tab' END AS x, CASE WHEN n % 3 = 0 THEN n || '-' || (n + 2) END AS s, CASE WHEN g IN ('economy', 'standard') THEN g || ' grade' END AS q,
      CASE n % 4 WHEN 0 THEN 'removal' WHEN 1 THEN CASE WHEN b = 'gear' THEN 'install' ELSE 'install wheel' END END AS v, a, b, g FROM t),
    w AS (SELECT *, list_filter([l, m, c, x, s, q, v], lambda z: z IS NOT NULL)[1:6] AS terms FROM u)
    SELECT p_partkey, CASE WHEN len(terms) > 0 THEN array_to_string(terms, ' ') ELSE array_to_string(list_distinct_ordered, ' ') END AS phrase, concat_ws(',', CASE WHEN l IS NULL THEN 'leading' END, CASE WHEN m IS NULL THEN 'modifier' END, CASE WHEN c IS NULL THEN 'component' END, CASE WHEN x IS NULL THEN 'material' END, CASE WHEN s IS NULL THEN 'size' END, CASE WHEN q IS NULL THEN 'grade' END, CASE WHEN v IS NULL THEN 'action' END) AS dropped
    FROM (SELECT *, CASE WHEN a = g THEN [a, b] ELSE [a, b, g] END AS list_distinct_ordered FROM w)""",
)
def f15(spark, sf_dir):
    n = F.col("p_size")
    text = F.concat(F.col("p_name"), F.lit(" for the "), F.col("p_type"), F.when(n % 3 == 0, F.concat(F.lit(" "), n.cast("string"), F.lit(" to "), (n + 2).cast("string"))).otherwise(""))
    component = F.when(n % 2 == 0, "steel_plate").otherwise("unknown")
    action = F.when(n % 4 == 0, "remove").when(n % 4 == 1, "install").when(n % 4 == 2, "paint")
    p = T.search_phrase(text, component, F.lit(None).cast("string"), action, **_STYLES)
    return read(spark, sf_dir, "part").select("p_partkey", p["phrase"].alias("phrase"), F.array_join(p["dropped"], ",").alias("dropped"))


@query("f21_row_confidence", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.3 WHEN p_size % 3 = 0 THEN 0.4 WHEN p_size % 2 = 0 THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence FROM part")
def f21(spark, sf_dir):
    n = F.col("p_size")
    c = T.row_confidence(F.col("p_name"), F.when(n % 3 != 0, n), F.when(n % 2 != 0, F.lit("EA")), F.when(n % 5 != 0, F.col("p_retailprice")))
    return read(spark, sf_dir, "part").select("p_partkey", c.alias("confidence"))


@query("f23_slug", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages")
def f23(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query(
    "p14_redact",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+', '[REDACTED_EMAIL]', 'g'), '\(?[0-9]{3}\)?[-. \t\n\r\f]?[0-9]{3}[-. \t\n\r\f]?[0-9]{4}', '[REDACTED_PHONE]', 'g'), '\b[0-9]{5}(?:-[0-9]{4})?\b', '[REDACTED_ZIP]', 'g') AS redacted FROM documents""",
)
def p14(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


@query("f23_ids", "SELECT p_partkey, 'part_' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') || '_' || regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS record_id, 'pair_' || p_partkey || '_' || p_size AS pair_id FROM part")
def f23_ids(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.record_id("part", F.col("p_brand"), F.col("p_name")).alias("record_id"), T.pair_id(F.col("p_partkey"), F.col("p_size")).alias("pair_id"))


@query(
    "f14_readable_description",
    "SELECT p_partkey, trim(concat_ws(' ', replace(p_name, '_', ' '), CASE WHEN p_partkey % 3 > 0 THEN lower(p_type) END, CASE WHEN p_partkey % 5 > 0 THEN 'tear off' END)) AS readable FROM part WHERE p_partkey % 7 > 0 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN lower(p_type) ELSE lower(p_brand) END FROM part WHERE p_partkey % 7 = 0",
)
def f14_readable(spark, sf_dir):
    k = F.col("p_partkey")
    component, material = F.when(k % 7 > 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).otherwise("unknown"), F.when(k % 3 > 0, F.lower("p_type"))
    action = F.when((k % 5 > 0) & (k % 7 > 0), "tear_off").otherwise("unknown")
    return read(spark, sf_dir, "part").select("p_partkey", T.readable_description(F.lower("p_brand"), component, material, action).alias("readable"))


@query("f12_slope_conflict", "SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 < 2 AND p_size % 12 + 1 NOT IN (7, 9) AS conflict FROM part")
def f12_slope(spark, sf_dir):
    k, limit = F.col("p_partkey"), F.concat((F.col("p_size") % 12 + 1).cast("string"), F.lit("/12"))
    size = F.when(k % 2 == 0, "7/12 to 9/12").otherwise("4")
    text = F.concat(F.col("p_name"), F.when(k % 3 == 0, ", Greater than ").when(k % 3 == 1, " over ").otherwise(" under "), limit, F.lit(" slope"))
    return read(spark, sf_dir, "part").select("p_partkey", T.slope_conflict(size, text).alias("conflict"))
