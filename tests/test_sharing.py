"""Operators whose steps once grew faster than their input, against brute force and by their plans."""

import random
import re
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from tallyforge.operators import body as B
from tallyforge.operators import catalog as K
from tallyforge.operators import coverage as C
from tallyforge.operators import linkage as L
from tallyforge.operators import pairing as M
from tallyforge.operators import parsing as P
from tallyforge.operators import review as V
from tallyforge.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlapping_shapes_broadcast_nothing(spark):
    """what lists are spread to was broadcast, as a catalog's size doesn't tell it."""
    rng = random.Random(1)
    some = lambda xs: rng.choice([None, [], rng.sample(xs, 1), rng.sample(xs, 2), rng.choices(xs, k=3)])
    rows = [(rng.randrange(150), rng.choice(["t", "u", None]), rng.choice(["c", "d", None]), some("ijk"), some("EFG")) for _ in range(200)]
    share = lambda a, b: not a or not b or set(a) & set(b)
    want = {}
    for x in rows:
        others = [y[0] for y in rows if y[1:3] == x[1:3] and y[0] != x[0] and share(x[3], y[3]) and share(x[4], y[4])]
        if others:
            want[x[0]] = min([*others, *([want[x[0]]] if x[0] in want else [])])
    found = K.overlapping_shapes(spark.createDataFrame(rows, "mapping_id int, trade string, component string, actions array<string>, units array<string>"))
    assert dict(map(tuple, found.collect())) == want
    assert "Broadcast" not in plan(found)


def test_splits_of_a_batch_equal_one_by_one():
    """documents of few sections are tried side by side."""
    rng = np.random.default_rng(2)
    values, targets = [], []
    for i in range(300):
        n, k = int(rng.integers(0, 9)), int(rng.integers(0, 4))
        own = rng.integers(-3 if i % 5 == 0 else 1, 12, n) * 100 + rng.integers(0, 4, n)
        sums = [int(own[rng.integers(0, max(k, 1), n) == b].sum()) for b in range(k)]
        targets.append(sorted({x for x in sums if x > 0}) if i % 3 else [int(x) for x in rng.integers(1, 4000, k)])
        values.append(own.tolist())
    values.append([3 ** (i % 17) * 100 + i for i in range(20)])  # too many to try
    targets.append([sum(values[-1][::2]), sum(values[-1][1::2])])
    flat = lambda xs: np.array([x for own in xs for x in own], np.int64)
    sizes = lambda xs: np.array([len(own) for own in xs], np.int64)
    for most in (1 << 20, 20):
        note, chosen = C._splits(flat(values), sizes(values), flat(targets), sizes(targets), 5, most)
        at = first = 0
        exact = lambda xs: [Decimal(int(x)).scaleb(-2) for x in xs]
        for i, (own, wanted) in enumerate(zip(values, targets, strict=True)):
            way, want = None, C._FEWER
            if len(wanted) > 1:
                try:
                    way = C.unique_split(exact(own), exact(wanted), Decimal("0.05"), most)
                    want = C._OPEN if way is None else 0
                except OverflowError:
                    want = C._TOO_MANY
            assert note[i] == want, (own, wanted)
            assert chosen[at : at + len(own)].tolist() == ([-1] * len(own) if way is None else [first + x for x in way])
            at, first = at + len(own), first + len(wanted)
        assert {0, C._FEWER, C._OPEN} <= set(note.tolist())


def test_pairs_of_tokens_stay_with_their_record(spark):
    """pairs and distinct words were each shuffled, and the pairs made twice."""
    items = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, ["q"]), (4, [])], "item int, tokens array<string>")
    records = spark.createDataFrame([(7, ["a", "b", "b"]), (7, ["b", "c"]), (8, ["z"]), (9, None)], "rec int, tokens array<string>")
    found = L.candidates_by_token(items, records, "item", "rec")
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 7, 2), (2, 7, 2), (3, None, 0), (4, None, 0)]
    few = plan(registry.queries()["j6_candidates_by_token"](spark, "/root/testdata/sf0.001"))
    assert not re.search(r"hashpartitioning\(item_id#\w+, doc_id#", few)


def test_searched_records_of_the_same_tokens_meet_once(spark):
    """each record was tested for each text that shares its rarest token."""
    rng = random.Random(3)
    records = [(i, rng.choices("abcd", k=rng.randrange(1, 4))) for i in range(200)]
    items = [(i, " ".join(rng.choices("abcx", k=3)), rng.choice("abx")) for i in range(60)]
    found = V.staged_search(spark.createDataFrame(items, "item_id int, one string, two string"), ["one", "two"], spark.createDataFrame(records, "rec int, tokens array<string>"), "rec")
    want = set()
    for item, *texts in items:
        for i, text in enumerate(texts):
            hits = [k for k, t in records if set(text.split()) <= set(t)]
            if hits:
                want.add((item, i, len(hits), min(hits)))
                break
    assert set(map(tuple, found.collect())) == want
    assert "n_alike" in plan(found)


def test_names_of_one_beginning_meet_their_rows_only(spark):
    """all names that begin alike met all rows of their group."""
    names = [(1, f"Customer#{i:05d}") for i in range(3000)] + [(2, "ab"), (2, "A-B"), (2, "bcd"), (2, "cd"), (2, "--"), (None, "ab")]
    rows = [(1, i, f"* Customer#{i:05d} (seen)") for i in range(0, 3000, 2)] + [(1, -1, "customer00004, customer00006"), (2, 1, "ABCD"), (2, 2, "b c d e"), (None, 3, "ab")]
    found = M.one_to_one_reconcile(spark.createDataFrame(names, "group_id int, name string"), spark.createDataFrame(rows, "group_id int, row_id int, text string"))
    got = {(g, n): (r, p) for g, n, r, p in map(tuple, found.collect())}
    for i in range(3000):
        assert got[1, f"Customer#{i:05d}"] == ((None, "several rows") if i in (4, 6) else (i, None) if i % 2 == 0 else (None, "no row"))
    assert got[2, "bcd"] == got[2, "cd"] == (None, "several rows") and got[2, "ab"] == got[2, "A-B"] == (None, "repeated name")
    assert got[2, "--"] == (None, "empty name") and got[None, "ab"] == (None, "no row")
    assert "contains" not in plan(found).lower()  # no pairs to be tested: they meet by the whole name


def test_words_of_a_text_are_not_shuffled(spark):
    """each word went to its line with its box."""
    found = plan(registry.queries()["a26_words_to_lines"](spark, "/root/testdata/sf0.001"))
    assert 0 <= found.index("Generate posexplode") < found.index("Exchange")  # spread after they were dealt out


def test_items_of_a_kind_are_matched_once(spark):
    """all items of a component met its records in one task."""
    items = [(i, ["Roof vent", "roof VENT", "gutter", None][i % 4], "roofing", ["vent", "vent", "gutter", "vent"][i % 4], "replace", [None, "EA"][i // 4 % 2]) for i in range(400)]
    records = [(1, "VENT", [], "roofing", "vent", "ea", [], []), (2, "vent", [], "", None, "sf", ["replace"], []), (3, "gut", ["gutters"], None, None, None, [], ["cap"])]
    found = L.verified_matches(spark.createDataFrame(items, "item_id int, description string, trade string, component string, action string, unit string"), spark.createDataFrame(records, "key int, description string, aliases array<string>, trade string, component string, unit string, actions array<string>, negatives array<string>"))
    want = {(i, 1) for i in range(400) if i % 4 < 2} | {(i, 2) for i in range(400) if i % 4 < 2 and i // 4 % 2 == 0} | {(i, 3) for i in range(400) if i % 4 == 2}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert re.search(r"min\(item_id#\w+\)", plan(found))


def test_lines_of_a_document_are_not_shuffled(spark):
    """an order's lines went to its document, and each line's text was made ready for each start."""
    for name in ("a28_wrapped_and_unread_coverages", "a28_coverage_blocks"):
        found = plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert found.count("Exchange") == 1 and found.count("rtrim(") <= 2


def longest_method(spark, name):
    """Bytes of the longest method that Spark writes for a query; the JVM compiles none of over 8,000."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        package = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
        stages = getattr(package, "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan())
        return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


SAID = [
    "Roof", "roof", "Main Level", "Garage", "QUANTITY", "1. Shingles - w/", "2. Wall", "* 3. Gutter", "5.00 SQ", "2,801.13 SF Walls", "5.00", "1,234.50", "(5.00)", "<2.00>", "2/25 yrs", "7/30 yrs Avg.", "Avg.", "8.00%", "", "Totals: Roof", "Totals: Main Level",
    "Grand Total Areas:", "Line Item Totals:", "CONTINUED - Roof", "continued - Nowhere", "**Doors**", "Rake Only", "This one is a note", "felt", "Felt and more", "a line of more than a few words", "Page 1", "Missing Wall",
]


def said(spark):
    rng = random.Random(4)
    rows = [(d, p, i, rng.choice(SAID)) for d in range(150) for p in range(1, rng.randrange(2, 6)) for i in range(rng.randrange(1, 14))]
    return B.row_lines(spark.createDataFrame(rows, "doc_id int, page int, line int, text string")).cache()


def test_sections_look_ahead_once(spark):
    """each line searched all lines after it, and a step's method was too long to be compiled."""
    assert "RowFrame, 1, unboundedfollowing" not in plan(registry.queries()["w1_found_sections"](spark, "/root/testdata/sf0.001"))
    assert longest_method(spark, "w1_found_sections") < 8000


def test_rows_read_at_once_are_those_of_all_sections(spark):
    """only heads and what opens or closes a section are placed."""
    lines = said(spark)
    found = B.find_sections(lines).cache()
    plain = lambda df: sorted(str(r) for r in df.drop("amounts").collect())
    want = plain(B.assemble_rows(found))
    assert len(want) > 60 and plain(B.read_rows(lines)) == want
    labels = B.find_labels(lines)
    assert plain(labels) == plain(found.where("label_kind is not null").select(labels.columns)) != []


def test_rows_in_any_order_are_placed_from_heads(spark):
    """sections were worked out for each line, in methods too long to be compiled."""
    found = plan(registry.queries()["w2_rows_in_any_order"](spark, "/root/testdata/sf0.001"))
    assert "RowFrame, 1, unboundedfollowing" not in found and "piece#" in found
    assert longest_method(spark, "w2_rows_in_any_order") < 8000


def test_labels_are_placed_from_what_opens_sections(spark):
    """sections were worked out for each line."""
    found = plan(registry.queries()["w4_found_labels"](spark, "/root/testdata/sf0.001"))
    assert "RowFrame, 1, unboundedfollowing" not in found and re.search(r"Filter .*role#\w+ = head", found)


def test_totals_read_lines_once(spark):
    """labels and amounts were read from all lines each, and joined."""
    lines = [(1, 1, 1, "Totals: Roof"), (1, 1, 2, "1.00"), (1, 1, 3, "2.00"), (1, 2, 1, "(3.00)"), (1, 2, 2, "4.00"), (1, 2, 3, "x"), (1, 2, 4, "5.00"), (1, 2, 5, "Total:"), (1, 2, 6, "Totals: Wall"), (1, 2, 7, "6.00"), (2, 1, 1, "7.00"), (2, 1, 2, "Line Item Totals:")]
    found = P.assemble_totals(P.tokenize_lines(spark.createDataFrame(lines, "doc_id int, page int, line int, text string")))
    money = lambda *xs: tuple(None if x is None else Decimal(x) for x in xs)
    want = [(1, "Roof", *money(1, 2, 3, 4), 1), (1, "", *money(None, None, None, None), 2), (1, "Wall", *money(None, None, None, 6), 3), (2, "Line Item Totals:", *money(None, None, None, None), 1)]
    assert sorted(map(tuple, found.collect()), key=lambda r: (r[0], r[-1])) == want
    assert plan(registry.queries()["w3_assemble_totals"](spark, "/root/testdata/sf0.001")).count("Generate posexplode") == 1


def test_repeated_lines_of_pages_are_read_once(spark):
    """all lines were read for the pages and once more for the texts, those of short documents, too."""
    rng = random.Random(5)
    rows = [(d, p, None if rng.random() < 0.05 else "\n".join(rng.choice(["Head", " head ", "x", "Foot", "5.00", "1. Row", "", "QUANTITY", "y" * 61]) for _ in range(rng.randrange(4)))) for d in range(120) for p in range(rng.randrange(1, 7)) for _ in range(rng.choice([1, 1, 2]))]
    pages = spark.createDataFrame(rows, "doc_id int, page int, text string")
    want = sorted(map(tuple, P.repeated_lines(P.split_lines(pages)).collect()))
    assert want and sorted(map(tuple, P.repeated_in_pages(pages).collect())) == want
    found = plan(registry.queries()["a2_repeated_lines"](spark, "/root/testdata/sf0.001"))
    assert found.count("Generate") == 1 and re.search(r"Filter \(size\(.*>= 3\)", found[found.index("Generate") :])  # counted before they are split


def test_kinds_of_lines_are_worked_out_once(spark):
    """blank lines were left out by a filter that worked out each line's kind once more, in a method too long to be compiled."""
    found = plan(registry.queries()["w4_label_kinds"](spark, "/root/testdata/sf0.001"))
    assert "THEN blank" not in "".join(x for x in found.split("\n") if "Filter" in x)
    assert longest_method(spark, "w4_label_kinds") < 8000
    lines = [(1, 1, 1, "Main"), (1, 1, 2, " "), (1, 1, 3, "Roof"), (1, 1, 4, ""), (1, 1, 5, "Roof"), (1, 2, 1, "\t"), (1, 2, 2, "QUANTITY"), (1, 2, 3, "Fixtures"), (1, 2, 4, "1. Row"), (1, 2, 5, "End")]
    tokens = P.tokenize_lines(spark.createDataFrame(lines, "doc_id int, page int, line int, text string"))
    kinds = P.label_kinds(tokens.withColumn("is_section", F.trim("text").isin("Main", "Roof", "Fixtures", "End"))).orderBy("page", "line")
    assert [r[2:] for r in map(tuple, kinds.collect())] == [(1, "Main", "area"), (3, "Roof", "section"), (3, "Fixtures", "category"), (5, "End", "ignored")]


def test_lines_of_items_are_sorted_once(spark):
    """lines were sorted by their part for what their item had before them, and those of no item met, too."""
    found = plan(registry.queries()["w2_assemble_line_items"](spark, "/root/testdata/sf0.001"))
    assert not re.search(r"Sort \[doc_id#\w+ ASC NULLS FIRST, part#", found)
    assert longest_method(spark, "w2_assemble_line_items") < 8000
    lines = ["5.00", "1. Row of", "felt", "2.00 EA", "3.00", "Nailed", "Roof", "loose", "2. Next", "on", "4.00", "on it goes", "Totals: Roof", "9.00", "3. Last", "x"]
    tokens = P.tokenize_lines(spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(lines)], "doc_id int, page int, line int, text string")).withColumns({"is_section": F.col("text") == "Roof", "section": F.lit("s")})
    rows = P.assemble_line_items(tokens, spark.createDataFrame([(1, ["rcv"])], "doc_id int, fields array<string>"), ["rcv"]).orderBy("item_no")
    assert [(r["item_no"], r["description"], r["quantity"], r["rcv"], r["notes"]) for r in rows.collect()] == [(1, "Row of felt", Decimal(2), Decimal(3), "Nailed"), (2, "Next on", None, Decimal(4), "on it goes"), (3, "Last x", None, None, None)]
