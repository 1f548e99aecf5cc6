"""Queries of readers, writers and streams: the tables go through files and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans._register import query, read
from tallyforge.sources import tables as S
from tallyforge.sources._folder import new_folder
from tallyforge.streaming import events as E
from tallyforge.streaming import stateful as ST

_SLUG = "regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_NESTED = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("s1_content_hashes", "SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def s1(spark, sf_dir):
    return S.content_hashes(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "s2_duplicate_sources",
    "WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents), m AS (SELECT *, min(doc_id) OVER (PARTITION BY sha) AS first FROM h) SELECT doc_id, sha, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM m",
)
def s2(spark, sf_dir):
    return S.duplicate_sources(S.content_hashes(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(
    "s2_version_slugs",
    "WITH h AS (SELECT min(page_id) AS page_id FROM pages GROUP BY sha256(coalesce(html, ''))), s AS (SELECT page_id, " + _SLUG.format(c="url") + """ AS slug FROM pages SEMI JOIN h USING (page_id)),
    n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM s) SELECT page_id, CASE WHEN n = 1 THEN slug ELSE slug || '-v' || n END AS version_slug FROM n""",
)
def s2_versions(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    first = S.duplicate_sources(S.content_hashes(pages, "page_id", "html"), "page_id").where("duplicate_of is null").select("page_id")
    return S.version_slugs(pages.select("page_id", "url").join(first, "page_id", "left_semi"), F.col("url"), "page_id")


def _written(spark, sf_dir):
    nested = S.nest(read(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"], _NESTED)
    path = new_folder(spark, "nested")
    S.write_nested(nested, path)
    return S.read_estimates(spark, path, nested.schema)


@query("s3_read_estimates", "SELECT l_orderkey, " + ", ".join(_NESTED) + " FROM lineitem")
def s3(spark, sf_dir):
    return S.unnest(_written(spark, sf_dir), "l_orderkey")


@query("s7_write_nested", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ';' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS parts, count(*) AS n FROM lineitem GROUP BY 1")
def s7(spark, sf_dir):
    return _written(spark, sf_dir).select("l_orderkey", F.concat_ws(";", F.transform("items", lambda x: x["l_partkey"].cast("string"))).alias("parts"), F.size("items").cast("long").alias("n"))


_CATALOG = "SELECT CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name END AS name, p_brand AS brand, p_type AS type, p_size AS size FROM part"


@query("s4_catalog_violations", "WITH c AS (" + _CATALOG + ") SELECT concat_ws('|', name, brand, type) AS identity, CASE WHEN name = '' THEN 'blank field' ELSE 'duplicate identity' END AS reason, count(*) AS n FROM c GROUP BY ALL HAVING reason = 'blank field' OR count(*) > 1")
def s4(spark, sf_dir):
    return _catalog(spark, sf_dir)[1]


@query("s4_catalog_records", "WITH c AS (" + _CATALOG + ") SELECT name, brand, type, any_value(size) AS size FROM c WHERE name <> '' GROUP BY ALL HAVING count(*) = 1")
def s4_records(spark, sf_dir):
    return _catalog(spark, sf_dir)[0]


def _catalog(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 50 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name")))
    rows = part.select(name.alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    path = new_folder(spark, "catalog")
    S.write_flat(rows, path)
    return S.read_catalog_csv(spark, path, rows.schema, required=["name", "brand"], identity=["name", "brand", "type"])


@query(
    "s6_flat_items",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_name, o_orderpriority, concat_ws('; ', CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_linestatus = 'O' THEN 'open' END) AS notes
    FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN orders ON o_orderkey = l_orderkey""",
)
def s6(spark, sf_dir):
    notes = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "returned"), F.when(F.col("l_linestatus") == "O", "open")))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", notes.alias("notes"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    flat = S.flat_items(items, orders, parts, section="l_orderkey", area="l_partkey", lists=["notes"])
    path = new_folder(spark, "flat")
    S.write_flat(flat, path)
    return spark.read.option("header", True).option("emptyValue", "").schema(flat.schema).csv(path).fillna({"notes": ""})


@query(
    "s8_incremental_import",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'skipped' WHEN n_chars < 200 THEN 'failed' ELSE 'processed' END AS status,
    CASE WHEN doc_id % 2 = 0 THEN 'already processed' WHEN n_chars < 200 THEN 'too short' END AS reason FROM documents""",
)
def s8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    manifest = docs.where("doc_id % 2 = 0 or doc_id % 10 = 1").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "processed").otherwise("failed").alias("status"))
    return S.incremental_import(docs, manifest, "doc_id", F.when(F.col("n_chars") < 200, "too short"))


@query("s9_replace_table", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 100000")
def s9(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = new_folder(spark, "table")
    S.replace_table(orders, path, partition="o_orderstatus")
    S.replace_table(orders.where("o_orderstatus = 'F' and o_totalprice > 100000"), path, partition="o_orderstatus")
    return spark.read.schema(orders.schema).parquet(path)


@query("s10_latest_snapshot", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 3 = 0")
def s10(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    root = new_folder(spark, "snapshots")
    S.snapshot(orders, root, 20240101)
    S.snapshot(orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), root, 20240102)
    return S.latest_snapshot(spark, root)


@query(
    "s11_partitioned_report",
    """WITH t AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS l_orderkey, coalesce(n, 0)::INT AS n_items, coalesce(total, 0)::DOUBLE AS total, CASE WHEN n IS NULL THEN 'empty' WHEN abs(total - CAST(o_totalprice AS DECIMAL(18,2))) <= 0.05 THEN 'reconciled' ELSE 'open' END AS label
    FROM orders LEFT JOIN t ON l_orderkey = o_orderkey""",
)
def s11(spark, sf_dir):
    stated = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("stated"))
    return S.partitioned_report(_written(spark, sf_dir), stated, "l_orderkey", "l_extendedprice").withColumn("total", F.col("total").cast("double"))


def _events(spark, sf_dir):
    return E.read_stream(spark, f"{sf_dir}/events.parquet")


_LAST = "SELECT user_id, event_type, value, ts AS last_ts, count(*) OVER (PARTITION BY user_id) AS n_events FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def _last(spark, sf_dir):
    folder = new_folder(spark, "stream")
    E.run(E.latest_state(_events(spark, sf_dir), "user_id", ["event_type", "value"]), folder)
    return E.newest(spark, folder, ["user_id"])


@query("st1_latest_state", "SELECT user_id, event_type, value, n_events FROM (" + _LAST + ")")
def st1(spark, sf_dir):
    return _last(spark, sf_dir).select("user_id", "event_type", "value", "n_events")


@query("st2_tumbling_counts", "SELECT epoch(date_trunc('day', ts))::BIGINT AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st2(spark, sf_dir):
    folder = new_folder(spark, "stream")
    E.run(E.event_counts(_events(spark, sf_dir), "event_type", size="1 day"), folder)
    return E.newest(spark, folder, ["window_start", "event_type"]).withColumn("window_start", F.unix_timestamp("window_start"))


@query(
    "st2_sliding_counts",
    "WITH w AS (SELECT unnest([h, h - 3600]) AS window_start, event_type FROM (SELECT epoch(date_trunc('hour', ts))::BIGINT AS h, event_type FROM events)) SELECT window_start, event_type, count(*) AS n FROM w GROUP BY ALL",
)
def st2_sliding(spark, sf_dir):
    folder = new_folder(spark, "stream")
    E.run(E.event_counts(_events(spark, sf_dir), "event_type", size="2 hours", slide="1 hour"), folder)
    return E.newest(spark, folder, ["window_start", "event_type"]).withColumn("window_start", F.unix_timestamp("window_start"))


@query(
    "st2_session_counts",
    """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def st2_sessions(spark, sf_dir):
    """An event after all others ends every session."""
    folder = new_folder(spark, "stream")
    closing = E.closing_event(spark, f"{sf_dir}/events.parquet", f"{folder}/closing", after="8 hours")
    E.run(E.session_counts(_events(spark, sf_dir).unionByName(closing), "user_id", gap="6 hours"), folder, mode="append")
    return E.appended(spark, folder).withColumn("session_start", F.unix_micros("session_start"))


@query(
    "st2_closed_sessions",
    """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, true)::INT AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR""",
)
def st2_closed(spark, sf_dir):
    """Those whose end the watermark has passed; the others stay open."""
    folder = new_folder(spark, "stream")
    E.run(E.session_counts(_events(spark, sf_dir), "user_id", gap="2 hours", late="3 hours"), folder, mode="append")
    return E.appended(spark, folder).withColumn("session_start", F.unix_micros("session_start"))


@query("st3_stream_import", "SELECT doc_id, CASE WHEN n_chars < 200 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN n_chars < 200 THEN 'too short' END AS reason FROM documents")
def st3(spark, sf_dir):
    folder = new_folder(spark, "stream")
    for _ in range(2):  # the second run finds nothing new
        docs = E.read_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
        E.run(E.import_status(docs, "doc_id", F.when(F.col("n_chars") < 200, "too short")), folder, mode="append")
    return E.appended(spark, folder)


@query("st4_usage_counters", "SELECT user_id, count(*) AS uses, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def st4(spark, sf_dir):
    folder = new_folder(spark, "stream")
    E.run(E.usage_counters(_events(spark, sf_dir), "user_id", ["purchase", "error"], "event_type"), folder)
    return E.newest(spark, folder, ["user_id"])


@query(
    "st5_lifecycle_latest",
    "WITH l AS (" + _LAST + ") SELECT user_id, event_type, event_type = 'purchase' AS finished, event_type <> 'purchase' AND last_ts < (SELECT max(last_ts) FROM l) - INTERVAL 12 HOUR AS timed_out FROM l",
)
def st5(spark, sf_dir):
    return E.unfinished(_last(spark, sf_dir), "event_type", ["purchase"], "12 HOURS").select("user_id", "event_type", "finished", "timed_out")


@query(
    "st1_folded_reviews",
    """WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'status' WHEN 'error' THEN 'note' ELSE 'override:' || event_type END AS field, CASE event_type WHEN 'purchase' THEN 'approved' ELSE event_id::VARCHAR END AS value FROM events),
    l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY ts DESC, event_id DESC) = 1), n AS (SELECT user_id, count(*) AS n_events FROM e GROUP BY 1)
    SELECT user_id, field, value, n_events FROM l JOIN n USING (user_id)""",
)
def st1_folded(spark, sf_dir):
    """Each event sets a status, a note or an override. All come twice, once in each of two runs; the second changes nothing."""
    folder, kind = new_folder(spark, "stream"), F.col("event_type")
    field = F.when(kind == "purchase", "status").when(kind == "error", "note").otherwise(F.concat(F.lit("override:"), kind))
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", field.alias("field"), F.when(kind == "purchase", "approved").otherwise(F.col("event_id").cast("string")).alias("value"))
    for run in (1, 2):
        rows.write.parquet(f"{folder}/reviews/run={run}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/reviews/run=*")
        E.run(ST.folded_reviews(stream, "user_id", "field", "value", late="60 days"), folder)
    return E.newest(spark, folder, ["user_id"]).select("user_id", F.explode("fields").alias("field", "value"), "n_events")


@query(
    "st5_stream_timeouts",
    "WITH l AS (" + _LAST + ") SELECT user_id, event_type, event_type = 'purchase' AS finished, event_type <> 'purchase' AND epoch_ms(last_ts) + 6 * 3600000 <= (SELECT epoch_ms(max(last_ts)) FROM l) - 3600000 AS timed_out FROM l",
)
def st5_timeouts(spark, sf_dir):
    """Timers of the stream itself say what has timed out."""
    folder = new_folder(spark, "stream")
    E.run(ST.lifecycles(_events(spark, sf_dir), "user_id", "event_type", ["purchase"], "6 hours"), folder)
    return E.newest(spark, folder, ["user_id"]).select("user_id", "event_type", "finished", "timed_out")
