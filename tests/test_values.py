"""Single operators on rows written out, and against brute force."""

import datetime
import json
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators import catalog as K
from tallyforge.operators import coverage as C
from tallyforge.operators import evidence as E
from tallyforge.operators import linkage as L
from tallyforge.operators import pages as G
from tallyforge.operators import pairing as M
from tallyforge.operators import parsing as P
from tallyforge.operators import reconcile as R
from tallyforge.operators import review as V
from tallyforge.sources import _folder
from tallyforge.sources import rules as S


def column(spark, values, f, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(f(F.col("c"))).collect()]


def test_money(spark):
    given = {"$14,582.40": "14582.40", "(9,981.19)": "9981.19", "<409.84>": "409.84", "USD 12.50": "12.50", "12.x": "12.00", "12": "12.00", "-3.50*": "3.50", "NA": None, "--": None, "none": None, "": None, "x": None, "1.2.3": None, None: None}
    assert column(spark, given, T.parse_money) == [None if v is None else Decimal(v) for v in given.values()]
    shapes = {"12": True, "1,234": True, "23.5": True, "(0.00)": True, "<1.00>*": True, "$5": True, "-7.25": True, "12.x": False, "": False, "-": False, "1.": False, "a 1": False}
    assert column(spark, shapes, T.is_money) == list(shapes.values())
    kinds = {"(5.00)": "recoverable", "<5.00>": "nonrecoverable", "5.00": "unknown", "(0.00)": "none", "0": "none", "NA": "unknown", "bad": "unknown", None: "unknown"}
    assert column(spark, kinds, lambda c: T.depreciation_class(c)["kind"]) == list(kinds.values())


def test_dates_units_and_redaction(spark):
    dates = {"6/4/2026 9:57 AM": "2026-06-04T09:57:00", "10/10/2011 3:00 PM": "2011-10-10T15:00:00", "4/27/2026": "2026-04-27", "2024-02-29": "2024-02-29", "Mar 5, 2020": "2020-03-05", "n/a": None, "soon": None, None: None}
    assert column(spark, dates, T.parse_date) == list(dates.values())
    assert column(spark, ["gal", " ls ", "TON", "mi", "lb", "zz", " ", None], lambda c: T.norm_unit(c)["known"]) == [True] * 5 + [False] * 3
    texts = ["call 5551234567 now", "(555) 123-4567", "a.b+c@x-y.org", "in 12345-6789", "no 123"]
    assert column(spark, texts, T.redact) == ["call [REDACTED_PHONE] now", "[REDACTED_PHONE]", "[REDACTED_EMAIL]", "in [REDACTED_ZIP]", "no 123"]
    assert column(spark, ["ﬁne — “A”…", None, "Plain  --  x"], T.norm_description) == ['fine - "a".', None, "plain - x"]


def test_line_kinds(spark):
    kinds = {
        "25.00 square feet": "quantity_unit", "12.50 SF*": "quantity_unit", "Area Totals: Roof": "totals_label", "Grand Total Areas:": "totals_label", "DEPRECIATION": "header_word", "Fair": "condition", "avg.": "condition", "12/NA": "age_life",
        "10/30": "age_life", "10/30 yrs Avg.": "age_condition", "NA": "dep_percent", "33.3% [M]": "dep_percent", "* 12. Roof": "item_start", "1234. Roof": "text", "(5.00)": "money_paren", "<5>": "money_angle", "7": "money_plain", "  ": "blank", "Windows": "text",
    }
    assert column(spark, kinds, P.kind_of) == list(kinds.values())


def test_majority_keeps_case_and_drops_blanks(spark):
    rows = [(1, "claim", "AB-1 ", "detail", 2), (1, "claim", "AB-2", "letter", 1), (1, "claim", None, "letter", 3), (1, "claim", " ", "letter", 4), (2, "claim", None, "letter", 1), (3, "claim", "X", "letter", 1), (3, "claim", "x", "letter", 2), (3, "claim", "X", "letter", 3)]
    found = R.majority_value(spark.createDataFrame(rows, "doc_id int, field string, raw string, source string, ord int"), spark.createDataFrame([("detail", 1), ("letter", 9)], "source string, rank int"))
    got = {r["doc_id"]: (r["value"], r["n"], r["total"], round(r["confidence"], 4)) for r in found.collect()}
    assert got == {1: ("AB-1", 1, 2, 0.6), 2: (None, 0, 0, 0.3), 3: ("X", 2, 3, 0.6533)}


def test_null_tax_is_nothing(spark):
    rows = spark.createDataFrame([(1, 1, Decimal(2), Decimal(10), None, None, Decimal(99), None, None), (1, 2, None, Decimal(10), None, None, Decimal(99), None, None)], "doc_id int, item_id int, quantity decimal(18,4), unit_price decimal(18,2), tax decimal(18,2), oap decimal(18,2), rcv decimal(18,2), dep decimal(18,2), acv decimal(18,2)")
    assert [(r["item_id"], r["code"]) for r in R.line_arithmetic_issues(rows).collect()] == [(1, "rcv_mismatch")]


def test_split_is_single_or_none():
    one = [Decimal(x) for x in ("10", "20", "35")]
    assert C.unique_split(one, [Decimal("30"), Decimal("35")], Decimal("0.05")) == [0, 0, 1]
    assert C.unique_split([Decimal(5), Decimal(5), Decimal(10)], [Decimal(10), Decimal(10)], Decimal("0.05")) is None
    assert C.unique_split(one, [Decimal("31"), Decimal("34")], Decimal("0.05")) is None


def test_split_notes(spark):
    sections = spark.createDataFrame([(d, f"s{i}", Decimal(v)) for d in (1, 2, 3, 4) for i, v in enumerate((5, 5, 10))] + [(5, f"s{i:02}", Decimal(i + 1)) for i in range(17)], "doc_id int, section string, total decimal(18,2)")
    covered = {1: (10, 10), 2: (20,), 3: (5, 15), 4: (10, 11), 5: (100, 53)}
    coverages = spark.createDataFrame([(d, f"c{i}", Decimal(v)) for d, vs in covered.items() for i, v in enumerate(vs)], "doc_id int, coverage_id string, rcv decimal(18,2)")
    notes = {r["doc_id"]: r["note"] for r in C.attribute_by_unique_split(sections, coverages).collect()}
    assert notes == {1: "coverages of equal amounts", 2: "fewer than two coverages", 3: "no single assignment", 4: "no single assignment", 5: "no single assignment"}


def brute_fifo(rows):
    taken, out = set(), []
    for i, (item, text, ok) in enumerate(rows):
        if item in taken:
            continue
        base = None
        if ok and text.startswith("remove "):
            base = next((b for b, t, o in rows[i + 1 :] if b not in taken and o and f"remove {t}" == text), None)
            taken.add(base)
        out.append((item, base))
    return out


def test_queues_equal_brute_force(spark):
    rng, rows, want = random.Random(2), [], []
    for g in range(30):
        own = [(100 * g + i, rng.choice(["remove a", "a", "remove b", "b", "c"]), rng.random() < 0.8) for i in range(rng.randrange(1, 40))]
        rows += [(g, i, item, text, item % 3, ok) for i, (item, text, ok) in enumerate(own)]
        want += brute_fifo(own)
    found = M.collapse_pairs_fifo(spark.createDataFrame(rows, "g int, ord int, item_id int, description string, quantity int, resolved boolean"), ["g"]).collect()
    assert sorted((r["item_id"], r["base_id"]) for r in found) == sorted(want)
    assert all(r["quantity_differs"] == (r["base_id"] is not None and r["item_id"] % 3 != r["base_id"] % 3) for r in found)


@pytest.mark.parametrize("limit", [2, 5])
def test_prefilter_equals_brute_force(spark, limit):
    rng = random.Random(limit)
    words = [f"w{i}" for i in range(8)]
    some = lambda n: rng.sample(words, rng.randrange(0, n))
    catalog = [(i, rng.choice("xyz"), some(4)) for i in range(40)]
    items = [(i, rng.choice(["x", "y", "z", None]), some(4)) for i in range(60)]
    schema = "category string, tokens array<string>"
    found = L.prefilter_by_overlap(spark.createDataFrame(items, f"item_id int, {schema}"), spark.createDataFrame(catalog, f"rec int, {schema}"), "rec", limit).collect()
    want = set()
    for item, category, tokens in items:
        pool = sorted(((-len(set(tokens) & set(t)), k) for k, c, t in catalog if category is None or c == category))
        want |= {(item, k, -s) for s, k in (pool if not tokens else pool[:limit])}
    assert {(r["item_id"], r["rec"], r["shared"]) for r in found} == want


def test_verified_records_of_any_kind(spark):
    items = [(1, "Roof vent cover", "roofing", "vent", "replace", "EA"), (2, "gutter", "unknown", "gutter", "remove", None), (3, "Red roof", "roofing", "roof", "replace", "SF"), (4, "oo", None, None, None, None), (5, None, "roofing", "vent", None, None)]
    verified = [
        (10, "VENT", [], "roofing", "vent", "ea", [], []), (11, "roof vent cover with screen", [], None, "unknown", None, [], []), (12, "roof", None, "", "", "", None, ["RED"]), (13, "gut", ["gutters"], "unknown", None, None, ["remove"], []),
        (14, "vent", [], "siding", "vent", None, [], []), (15, "x", ["VENT C"], "roofing", "unknown", "sf", [], []), (16, "vent", [], "roofing", "vent", None, ["install"], []),
    ]
    found = L.verified_matches(spark.createDataFrame(items, "item_id int, description string, trade string, component string, action string, unit string"), spark.createDataFrame(verified, "key int, description string, aliases array<string>, trade string, component string, unit string, actions array<string>, negatives array<string>"))
    assert sorted((r["item_id"], r["key"]) for r in found.collect()) == [(1, 10), (1, 11), (1, 12), (2, 13), (4, 11), (4, 12)]


def test_items_without_a_shared_token_may_be_any_record(spark):
    a, b = spark.createDataFrame([(1, ["x"]), (2, ["q"]), (3, [])], "item int, tokens array<string>"), spark.createDataFrame([(7, ["x", "y"]), (8, ["x"])], "rec int, tokens array<string>")
    assert sorted(((r["item"], r["rec"] or 0, r["shared"]) for r in L.candidates_by_token(a, b, "item", "rec").collect())) == [(1, 7, 1), (1, 8, 1), (2, 0, 0), (3, 0, 0)]


EVIDENCE = E.Vocabulary(materials=[("metal", "metal"), ("plastic", "plastic")], styles=[("half round", "half round")], actions={"reset": "detach & reset"}, structures=["sheathing"])


def test_evidence_states(spark):
    schema = "description string, component string, material string, action string, size_key string, grade_key string, verified boolean, candidate string"
    rows = [
        ("roof vent - plastic", "roof_vent", None, None, None, None, False, "roof vent - plastic"), ("roof vent - plastic", "roof_vent", None, None, None, None, False, "roof vent - metal"), ("roof vent", "roof_vent", "aluminum", None, None, None, False, "roof vents"),
        ("gutter 5 inch", "gutter", None, None, "5", None, False, "gutter 6 inch"), ("gutter", "gutter", None, None, None, None, False, "gutter half round"), ("door 16x7", "door", None, None, None, None, False, "door 16x8"),
        ("steep roof charge", "roof_surcharge", None, None, None, None, False, "sheathing steep roof charge"), ("detach & reset vent", "vent", None, "reset", None, None, False, "vent"), ("vent", "unknown", None, None, None, None, True, "fan"),
    ]
    found = [(r["material_state"], r["size_state"], r["grade_state"], r["action_state"], r["component_ok"], r["score"]) for r in E.score_evidence(spark.createDataFrame(rows, schema), EVIDENCE).collect()]
    assert found[0] == ("MATCH", None, None, None, True, 10000)
    assert found[1][0] == "CONFLICT" and found[1][5] <= 5500
    assert found[2][0] == "UNSPECIFIED" and found[2][4]
    assert found[3][1] == "CONFLICT" and found[3][5] <= 6000
    assert found[4][2] == "CONFLICT" and found[4][5] <= 5500
    assert found[5][1] == "CONFLICT"
    assert not found[6][4] and found[6][5] <= 4500
    assert found[7][3] == "CONFLICT" and found[7][5] <= 5000
    assert found[8][4] and found[8][3] is None


def test_a_failing_reranker_changes_nothing(spark):
    rows = spark.createDataFrame([(1, k, 1 - k / 10, "a", "b") for k in range(4)], "item int, rec int, score double, a string, b string")

    def fails(a, b):
        raise ValueError("no model")

    for score in (fails, lambda a, b: pd.Series([1.0])[:0], lambda a, b: [None] * len(a)):
        out = M.rerank_custom(rows, "item", "rec", score).orderBy("rank").collect()
        assert [(r["rec"], r["combined"], r["applied"]) for r in out] == [(k, 1 - k / 10, False) for k in range(4)]
    turned = M.rerank_custom(rows, "item", "rec", lambda a, b: pd.Series([5.0] * len(a))).orderBy("rank").collect()
    assert [r["rec"] for r in turned] == [0, 1, 2, 3] and turned[0]["combined"] == pytest.approx(1.0)


def test_gates_of_decisions(spark):
    one = lambda score, conflict=False, act=True, sure=0.9, category="a", text="t": (score, conflict, act, sure, category, text)
    cases = {
        "below review floor": [one(5000)], "below accept floor": [one(7500), one(6000)], "dominant below floor": [one(7500), one(5000)], "conflict": [one(9000, conflict=True)], "low confidence": [one(9000, sure=0.7)], "clear margin": [one(9000), one(8200)],
        "exact best": [one(10000), one(9980)], "thin margin": [one(9200), one(9000)], "tie decided by hint": [one(9200), one(9200, category="b")], "tie, first taken": [one(9200), one(9200, text="u", category="b")],
    }
    rows = [(gate, k, *c) for gate, cs in cases.items() for k, c in enumerate(cs)]
    ranked = spark.createDataFrame(rows, "item string, key int, score int, conflict boolean, action_confirmed boolean, confidence double, category string, text string")
    items = spark.createDataFrame([(g,) for g in [*cases, "no candidates"]], "item string")
    hints = items.withColumn("category", F.lit("b"))
    found = {r["item"]: r for r in V.decide_evidence(items, ranked, hints, "item", "key").collect()}
    assert {i: r["gate"] for i, r in found.items()} == {g: g for g in [*cases, "no candidates"]}
    assert found["tie decided by hint"]["key"] == 1 and found["tie, first taken"]["key"] == 0 and found["thin margin"]["key"] is None


def test_rule_files_keep_their_order(spark):
    rules = [{"kind": "actions", "rules": [{"value": "b", "patterns": ["tear", "haul"]}, {"value": "a", "patterns": []}, {"value": "c", "patterns": ["x"]}]}]
    path = _folder.new_folder(spark, "rules")
    spark.createDataFrame(rules, S.SCHEMA).coalesce(1).write.json(path)
    assert S.rule_list(S.load_rules(spark, path), "actions") == [("b", ["tear", "haul"]), ("a", []), ("c", ["x"])]


def test_profiles_tie_to_the_first(spark):
    docs = spark.createDataFrame([(1, "Alpha and beta"), (2, "gamma"), (3, None)], "doc_id int, text string")
    profiles = [("one", ["alpha", "beta"]), ("two", ["BETA"]), ("three", ["gamma", "delta", "eps"])]
    found = {r["doc_id"]: (r["profile"], round(r["profile_score"], 3)) for r in G.detect_source_profile(docs, profiles).collect()}
    assert found == {1: ("one", 1.0), 2: ("generic", 0.467), 3: ("generic", 0.0)}
    assert {r["profile"] for r in G.detect_source_profile(docs, profiles, forced="two").collect()} == {"two"}
    assert {(r["profile"], r["profile_score"]) for r in G.detect_source_profile(docs, []).collect()} == {("generic", 1.0)}


def test_a_cluster_needs_a_shared_folder():
    class Far:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://far:7077"})  # noqa: N815

    with pytest.raises(ValueError):
        _folder.shared_folder(Far)
    Far.conf = {"spark.checkpoint.dir": "hdfs://far/shared/"}
    assert _folder.shared_folder(Far) == "hdfs://far/shared"


def test_notes_and_verbs(spark):
    assert column(spark, ["Code upgrade: per code", "per code", "x"], lambda c: G.classify_notes(c)["note_type"]) == ["code_upgrade_note", "code_note", "general_note"]
    found = column(spark, ["R&R door", "remove door, labor minimum", "door", None], G.verb_flags)
    assert [(f["remove_and_replace"], f["remove_only"], f["labor_minimum"]) for f in found] == [(True, False, False), (False, True, True), (False, False, False), (False, False, False)]


def test_search_phrase(spark):
    rules = {"fillers": ["up to code"], "leading": [("laminated", "laminated")], "modifiers": [("wet", "wet")], "components": [("shingle", "comp. shingle"), ("shingles", "comp. shingle")], "materials": [("3 tab", "3-tab")], "grades": [("high grade", "high grade")], "actions": {"remove": "tear off"}}
    rows = [("3 tab shingles - up to code - 20-25", "roofing", None, "remove"), ("The plain one and a thing", None, None, None), ("odd", "gutter_guard", "copper", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "d string, c string, m string, a string")
    found = [r[0] for r in df.select(T.search_phrase(F.col("d"), F.col("c"), F.col("m"), F.col("a"), **rules)["phrase"]).collect()]
    assert found == ["comp. shingle 3 tab 20-25 tear off", "plain one thing", "gutter guard copper", ""]


def test_times_of_events_have_no_zone(spark):
    assert column(spark, [datetime.date(2024, 3, 1)], lambda c: T.parse_date(F.date_format(c, "M/d/yyyy")), "c date") == ["2024-03-01"]


def test_page_classes_know_all_phrases(spark):
    pages = {
        "Enclosed is our settlement": "settlement_notice", "L/R Number: 1\nPolicy Number: 2": "claim_metadata", "For Smith, Joe & Jane\nQUANTITY\n1. Row": "instructional_sample", "Provided for reference only, as an example": "instructional_sample",
        "Provided for reference only": "unknown", "Using this guide": "depreciation_guide", "Replacement cost benefits pays the actual and necessary cost": "replacement_cost_explanation", "Your estimate summary in this guide": "instructional_sample",
    }
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(pages)], "doc_id int, page int, text string")
    assert {r["text"]: r["page_class"] for r in G.classify_pages(rows).collect()} == pages


def test_note_types_know_all_keywords(spark):
    kinds = {"ITEL report": "pricing_note", "Material Metrix says": "pricing_note", "see code R9": "code_note", "Required by current building codes": "code_upgrade_note", "Rake only": "measurement_note", "else": "general_note"}
    assert column(spark, kinds, lambda c: G.classify_notes(c)["note_type"]) == list(kinds.values())


def test_slopes_and_readable_descriptions(spark):
    rows = [("7/12 to 9/12", "steep, greater than 12/12 slope"), ("7/12 to 9/12", "steep, over 9/12 slope"), ("4", "over 12/12 slope"), ("7/12", "7/12 slope"), (None, "over 1/2 slope")]
    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(T.slope_conflict(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]
    parts = [("roof", "comp_shingles", "felt", "tear_off", "comp shingles felt tear off"), ("roof", "unknown", None, None, "roof"), ("unknown", None, "", "unknown", ""), (None, "vent", None, "remove", "vent remove")]
    found = spark.createDataFrame([p[:4] for p in parts], "t string, c string, m string, a string").select(T.readable_description(*map(F.col, "tcma"))).collect()
    assert [r[0] for r in found] == [p[4] for p in parts]


def test_repeated_lines_of_pages_that_count(spark):
    rows = [(1, p, i, t) for p in range(1, 6) for i, t in enumerate(["Head", f"own {p}", "Foot" if p != 3 else "none"])]
    lines = spark.createDataFrame(rows, "doc_id int, page int, line int, text string")
    among = spark.createDataFrame([(1, p) for p in (1, 2, 4)], "doc_id int, page int")
    texts = lambda df: sorted(r["text"] for r in df.collect())
    assert texts(P.repeated_lines(lines)) == ["foot", "head"] and texts(P.repeated_lines(lines, among=among)) == ["foot", "head"]
    assert texts(P.repeated_lines(lines.where("page < 3"))) == [] and texts(P.repeated_lines(lines, among=among.where("page < 4"))) == []


def test_registry_folds_in_any_order_and_once(spark):
    schema = "event_id long, signature string, at int, action string, key string, status string, uses long, reviewer string, reason string, override boolean"
    rows = [
        (1, "a", 1, "import", "k1", "approved", 3, None, None, None), (2, "a", 2, "record", "k2", None, None, "ann", "seen", None), (3, "a", 3, "record", "k2", None, None, "ann", "seen", True), (4, "a", 4, "reject", None, None, None, "bob", "bad", None),
        (5, "a", 5, "record", "k3", None, None, "ann", "again", None), (6, "b", 1, "record", "k9", None, None, "ann", " ", None), (7, "c", 1, "disable", None, None, None, "bob", "old", None), (8, "d", 1, "record", None, None, None, "ann", "r", None),
    ]
    random.Random(1).shuffle(rows)
    log = spark.createDataFrame([], schema)
    for part in (rows[:5], rows, rows[2:]):
        log = log.unionByName(V.append_events(log, spark.createDataFrame(part, schema)))
    assert log.count() == len(rows)
    registry, conflicts = V.fold_registry(log)
    assert {r["signature"]: (r["key"], r["status"], r["uses"], r["events"]) for r in registry.collect()} == {"a": ("k3", "approved", 5, ["none -> approved", "approved -> rejected", "rejected -> approved"]), "d": (None, "approved", 1, ["none -> approved"])}
    assert [tuple(r) for r in conflicts.collect()] == [(2, "a", "k1", "k2")]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_required_fields_by_profile(spark):
    docs = spark.createDataFrame([(1, " Usual "), (2, "BARE"), (3, None)], "doc_id int, profile string")
    cand = spark.createDataFrame([(1, "number", "A1"), (1, "number", " a1 "), (1, "number", "  "), (2, "name", "Jo"), (2, "name", "Flo"), (3, "name", None)], "doc_id int, field string, raw string")
    values = spark.createDataFrame([(1, "number", "A1"), (2, "name", "Jo"), (3, "name", " "), (3, "number", None)], "doc_id int, field string, value string")
    out = R.field_issues(docs, cand, values, [("number", "warning"), ("list", "info")], [("bare", "number")])
    assert rows(out, "doc_id", "field") == [
        (1, "list", "missing_value", "info"), (2, "list", "missing_value", "info"), (2, "name", "conflicting_value", "warning"), (2, "number", "missing_value", "info"),
        (3, "list", "missing_value", "info"), (3, "number", "missing_value", "warning"),
    ]
    assert R.field_issues(docs.limit(0), cand.limit(0), values, [("number", "warning")]).isEmpty()


def test_issues_by_severity(spark):
    issues = spark.createDataFrame([(1, "a", "error"), (1, "a", "error"), (1, "b", "info"), (2, "c", "fatal")], "doc_id int, code string, severity string")
    assert rows(R.issue_rollup(issues, ["a", "b"]), "doc_id") == [(1, 2, 1, 0, 2, 0, 1), (2, 0, 0, 1, 0, 0, 0)]
    assert rows(R.issue_rollup(issues.drop("severity"), ["a"]), "doc_id") == [(1, 2), (2, 0)]


def test_mapping_issues_by_reason(spark):
    items = spark.createDataFrame([(1, "c1", False, []), (2, None, True, ["trade unknown", "odd"]), (3, "c", None, None)], "item_id int, coverage string, upstream_review boolean, normal_reasons array<string>")
    decided = spark.createDataFrame(
        [(1, ["action conflict", "action unknown", "tied", "no selector"], 7, "R", 0.9), (2, ["no match"], None, None, None), (3, ["component conflict", "something else"], 8, None, 0.5)],
        "item_id int, reasons array<string>, best int, category string, confidence double",
    )
    assert rows(L.mapping_issues(items, decided, "item_id"), "item_id", "code") == [
        (1, "close_candidates", "warning"), (1, "missing_selector", "warning"), (1, "unsupported_action", "warning"), (2, "ambiguous_text", "info"), (2, "no_match", "warning"),
        (2, "unresolved_coverage", "info"), (2, "upstream_review", "info"), (3, "component_mismatch", "info"), (3, "low_confidence", "warning"), (3, "missing_category", "warning"),
    ]


def test_field_edits_keep_what_the_machine_found(spark):
    items = spark.createDataFrame([(1, "R", "EA"), (2, None, "SF")], "item_id int, category string, unit string")
    held = spark.createDataFrame([(1, "unit", "EA", "LF", "q", "old", 0), (2, "unit", "SF", "SQ", "q", "old", 0)], "item_id int, field string, original string, value string, reviewer string, reason string, at int")
    edits = [(4, 9, 1, "unit", "HR", "r", "x"), (3, 5, 1, "unit", None, "r", "x"), (5, 9, 2, "category", "D", "r", "x"), (6, 1, 1, "price", "1", "r", "x"), (7, 1, 1, "unit", "1", "r", " "), (8, 1, 1, "unit", "1", "r", None), (9, 1, 3, "unit", "1", "r", "x"), (10, 1, 1, None, "1", "r", "x")]
    edits = spark.createDataFrame(edits, "edit_id int, at int, item_id int, field string, value string, reviewer string, reason string")
    overrides, history, refused = V.edit_fields(items, held, edits, ["category", "unit"])
    assert rows(overrides.drop("at", "reviewer", "reason"), "item_id", "field") == [(1, "unit", "EA", "HR"), (2, "category", None, "D"), (2, "unit", "SF", "SQ")]
    assert rows(history.select("edit_id", "before", "after"), "edit_id") == [(3, "LF", None), (4, None, "HR"), (5, None, "D")]
    assert rows(refused, "edit_id") == [(6, "field is not editable"), (7, "no reason"), (8, "no reason"), (9, "unknown item"), (10, "field is not editable")]


def test_queue_of_committed_tasks(spark):
    fields = ("state", "commit_state", "uncertain", "selected_category", "observed_category", "category", "selected_selector", "observed_selector", "selector", "review_reason", "stop_detail", "trust_state")
    schema = "task_id int, ord int, has_row boolean, " + ", ".join(f"{f} {'boolean' if f == 'uncertain' else 'string'}" for f in fields)
    r = "review_required"
    tasks = [
        (1, 3, None, r, "committed", None, "", "seen", "own", None, None, "S", "", "stopped", "t"), (2, 1, True, r, None, False, None, None, "own", "S", None, None, None, None, "t"), (3, 2, False, r, None, False, *[None] * 9),
        (4, 2, True, "done", "committed", False, *[None] * 9), (5, 2, True, r, "committed", True, *[None] * 9), (6, 2, True, r, "open", False, *[None] * 9),
    ]
    assert [tuple(x) for x in K.committed_queue(spark.createDataFrame(tasks, schema)).collect()] == [(2, 1, "own", "S", "t", "t"), (1, 3, "seen", "S", "stopped", "t")]


def test_typed_rule_files(spark, tmp_path):
    rules = {
        "kind": "k", "rules": [{"patterns": ["Tear", "HAUL"], "action": "remove"}, {"patterns": [], "trade": "x"}, {"patterns": ["felt"], "trade": "roofing", "component": "felt"}],
        "attribute_patterns": [{"name": "n", "pattern": "([0-9]+) in", "attribute": "inches", "type": "int"}, {"name": "m", "pattern": "steep", "attribute": "steep", "value_if_matched": "true"}],
        "hints": [{"kind": "trade", "value": "roofing", "categories": ["R", "S"]}], "groups": ["B", "A"], "aliases": {"rf": "Roof"},
    }
    (tmp_path / "a.json").write_text(json.dumps(rules, indent=1))
    (tmp_path / "b.json").write_text('{"kind": "empty"}')
    t = S.load_typed_rules(spark, str(tmp_path))
    assert rows(t["concepts"], "ord", "concept", "pattern_ord") == [("k", 0, "action", "remove", 0, "tear"), ("k", 0, "action", "remove", 1, "haul"), ("k", 2, "component", "felt", 0, "felt"), ("k", 2, "trade", "roofing", 0, "felt")]
    assert rows(t["attributes"], "ord") == [("k", 0, "inches", "(?i)([0-9]+) in", "int", None), ("k", 1, "steep", "(?i)steep", "str", "true")]
    assert rows(t["hints"], "ord") == [("k", "trade", "roofing", "R", 0), ("k", "trade", "roofing", "S", 1)]
    assert rows(t["groups"], "ord") == [("k", 0, "B"), ("k", 1, "A")] and rows(t["aliases"], "alias") == [("k", "rf", "Roof")]
    (tmp_path / "c.json").write_text('{"kind": ["not", "a", "string"')
    with pytest.raises(Exception):
        S.load_typed_rules(spark, str(tmp_path))["groups"].collect()
