"""Work that grows with what is different, and orders that don't hang on the last bits."""

from pyspark.sql import functions as F

from tallyforge.operators import linkage as L
from tallyforge.operators import pairing as M


def test_scores_equal_to_nine_places_are_ties(spark):
    rows = spark.createDataFrame([(1, 7, 0.5 + 1e-12, "a", "a"), (1, 3, 0.5, "a", "a"), (1, 9, 0.9, "a", "a")], "item_id long, rec_id long, score double, a string, b string")
    out = {r["rec_id"]: r["rank"] for r in M.rerank_custom(rows, "item_id", "rec_id", lambda a, b: a.str.len() * 0.0).collect()}
    assert out == {9: 1, 3: 2, 7: 3}


def test_one_item_stands_for_all_that_are_alike(spark):
    rows = spark.createDataFrame([(i, ["x", None][i % 2], [["a"], []][i % 3 == 0]) for i in range(60)], "item_id long, text string, tokens array<string>")
    first, of = L.representatives(rows, "item_id", ["text", "tokens"])
    assert sorted(r["item_id"] for r in first.collect()) == [0, 1, 2, 3]
    scored = first.select("item_id", F.concat_ws("-", "text", F.size("tokens").cast("string")).alias("score"))
    out = {r["item_id"]: r["score"] for r in L.spread(of, scored, "item_id").collect()}
    assert out == {i: "-".join([x for x in ["x", None][i % 2 :][:1] if x] + ["0" if i % 3 == 0 else "1"]) for i in range(60)}


def test_scored_pairs_grow_with_kinds_of_items(spark, tmp_path):
    from tallyforge.plans import linkage_plans as LP

    part = spark.createDataFrame([(i * 9240, "red ring", f"Brand#{i % 2}", "SMALL", 1, 1.0) for i in range(1, 29)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    scored, of = LP._recommended(spark, str(tmp_path))
    n = scored.select("item_id").distinct().count()
    assert n < 10 and L.spread(of, scored.select("item_id", "rec_id", "score"), "item_id").select("item_id").distinct().count() == 28


def test_lines_stay_with_their_document(spark):
    """Pages to rows in one exchange of lines, that of their pages: dropping boilerplate moves no line."""
    from tallyforge.operators import parsing as P

    pages = spark.createDataFrame([(1, 1, "Head\nRoof\n head \nx"), (1, 2, "HEAD\ny"), (2, 1, "Head\n")], "doc_id long, page int, text string").repartition(5, "doc_id")
    phrases = spark.createDataFrame([(1, "head"), (1, " X ")], "doc_id long, text string")
    lines = P.own_lines(pages, phrases)
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "page", "line", "text").collect())
    assert rows(lines) == rows(P.drop_boilerplate(P.split_lines(pages), phrases)) == [(1, 1, 2, "Roof"), (1, 2, 2, "y"), (2, 1, 1, "Head"), (2, 1, 2, "")]
    tokens = P.carry_open_section(P.tokenize_lines(lines), F.col("text") == "Roof")
    plan = tokens._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # of the pages and of the documents of phrases


def test_partitions_grow_with_rows(spark, monkeypatch):
    from tallyforge.plans import fixtures as X
    from tallyforge.plans._register import read

    monkeypatch.setattr(X, "ROWS", 500)
    rows = read(spark, "/root/testdata/sf0.001", "lineitem")
    dealt = X.by_document(spark, "/root/testdata/sf0.001", rows)
    assert dealt.rdd.getNumPartitions() == -(-rows.count() // 500)
    places = dealt.select("l_orderkey", F.spark_partition_id().alias("p")).distinct()
    assert places.count() == places.select("l_orderkey").distinct().count()
