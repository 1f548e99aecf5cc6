"""Coverage blocks against a reader of one line after the other, splits against trying every assignment."""

import itertools
import random
import re
from decimal import Decimal

import pytest

from tallyforge.operators import coverage as C


def amount(text):
    """All digits, points and minus signs of the text, if they are a number."""
    try:
        return abs(Decimal(re.sub("[^0-9.-]", "", text)))
    except ArithmeticError:
        return None


def read_blocks(lines):
    """(name, incurred, {field: amount}) of each block, by taking lines from the front."""
    left, out, block, missed = list(lines), [], None, 0

    def field_of(t):
        return next((f for s, f in C.AMOUNTS if t.lower().rstrip(":").startswith(s)), None)

    while left:
        t = left.pop(0)
        low = t.lower()
        if low.startswith("summary for") and low != "summary for all items" and not (low == "summary for" and (not left or left[0].lower() == "all items")):
            name = t[11:].strip() or left.pop(0)
            if left and name.split()[-1].lower() in C.DANGLING and len(left[0].split()) <= 3:
                f = left[0].lower()
                if not f.startswith("summary for") and not f.endswith("paid when incurred") and field_of(f) is None:
                    name += " " + left.pop(0)
            if left and left[0].lower() == "summary for all items":
                left.pop(0)
            block, missed = (name, False, {}), 0
            out.append(block)
        elif low.endswith("paid when incurred") and len(t) < 90 and t[:-18].strip(" -") and not low.startswith("summary for"):
            block, missed = (t[:-18].strip(" -"), True, {}), 0
            out.append(block)
        elif block is not None and (field := field_of(t)):
            value = t.partition(":")[2].strip() or (left.pop(0) if left else "")
            if amount(value) is not None:
                block[2].setdefault(field, amount(value))
            missed = 0
        elif block is not None:
            missed += 1
            block = None if missed == 4 else block
    return out


PIECES = [
    "Summary for Dwelling", "Summary for", "Summary for All Items", "All Items", "Summary for Wind and", "Coverage B - Other - of", "Roof - Paid When Incurred", "Paid when incurred", "Total paid when incurred", "Total paid when incurred: 5.00",
    "Net Claim: see below", "Net Claim: 12.00", "Net Claim", "Overhead", "Less Deductible:", "(500.00)", "7.00", "some words", "more", "Hail", "a line of many words indeed", "Cleaning Mtl Tax: 1.00", "Subtotal",
]


def test_blocks_equal_reading_line_by_line(spark):
    rng = random.Random(7)
    docs = {d: [rng.choice(PIECES if rng.random() < 0.6 else PIECES[13:]) for _ in range(rng.randint(0, 40))] + ["words"] * rng.choice([0, 12]) + [rng.choice(PIECES) for _ in range(12)] for d in range(250)}
    rows = [(d, i // 5 + 1, i % 5, t if i % 7 else f"  {t} ") for d, own in docs.items() for i, t in enumerate(own)] + [(d, 50, i, " ") for d in docs for i in range(2)]
    found = C.coverage_blocks(spark.createDataFrame(rows, "doc_id int, page int, line int, text string")).collect()
    got = {}
    for r in found:
        fields = got.setdefault(r["doc_id"], {}).setdefault(r["ord"], (" - ".join(x for x in (r["name"], r["sub"]) if x), r["incurred"], {}))[2]
        if r["field"] is not None:
            fields[r["field"]] = r["amount"]
    for d, own in docs.items():
        expected = [(n.removeprefix("Coverage B - "), i, f) for n, i, f in read_blocks(own)]
        assert [x for _, x in sorted(got.get(d, {}).items())] == expected, own


def test_pages_of_a_block(spark):
    lines = [(1, 1, 1, "Summary for Coverage A - Dwelling"), (1, 1, 2, "Net Claim"), (1, 2, 1, " "), (1, 2, 2, "5.00"), (1, 3, 1, "no label"), (1, 4, 1, "Profit: 1.00"), (2, 1, 1, "nothing")]
    found = C.coverage_blocks(spark.createDataFrame(lines, "doc_id int, page int, line int, text string")).collect()
    assert {(r["doc_id"], r["code"], r["name"], r["field"], r["amount"], tuple(r["pages"])) for r in found} == {(1, "A", "Dwelling", f, Decimal(a), (1, 2, 4)) for f, a in (("net_claim", "5.00"), ("profit", "1.00"))}


def every_split(values, targets, tolerance):
    fits = []
    for way in itertools.product(range(len(targets)), repeat=len(values)):
        sums = [sum((v for v, b in zip(values, way, strict=True) if b == t), Decimal(0)) for t in range(len(targets))]
        if all(abs(s - t) <= tolerance for s, t in zip(sums, targets, strict=True)):
            fits.append(list(way))
    return fits[0] if len(fits) == 1 else None


@pytest.mark.parametrize("seed", range(5))
def test_split_equals_trying_every_one(seed):
    rng, single = random.Random(seed), 0
    for _ in range(120):
        k = rng.randint(2, 4)
        values = [Decimal(rng.choice([rng.randint(1, 40), rng.randint(1, 90000), -3, 0] if rng.random() < 0.3 else [rng.randint(100, 90000)])) / 100 for _ in range(rng.randint(1, 7))]
        way = [rng.randrange(k) for _ in values]
        targets = [sum((v for v, b in zip(values, way, strict=True) if b == t), Decimal(0)) + Decimal(rng.choice([0, 0, 0, 4, 5, 6, -5])) / 100 for t in range(k)]
        expected = every_split(values, targets, Decimal("0.05"))
        assert C.unique_split(values, targets, Decimal("0.05")) == expected
        single += expected is not None
    assert single > 15


def test_many_sections_are_split():
    rng = random.Random(3)
    for k, n in ((2, 36), (3, 22), (5, 14)):
        values = [Decimal(rng.randint(10**6, 10**11)) / 100 for _ in range(n)]
        way = [rng.randrange(k) for _ in values]
        targets = [sum((v for v, b in zip(values, way, strict=True) if b == t), Decimal(0)) for t in range(k)]
        assert C.unique_split(values, targets, Decimal(0)) == way
    alike = [Decimal(100)] * 60 + [Decimal(7)]  # few different sums, whatever the number of ways
    assert C.unique_split(alike, [Decimal(3007), Decimal(3000)], Decimal("0.05")) is None
    with pytest.raises(OverflowError):
        C.unique_split([Decimal(2) ** i for i in range(30)], [Decimal(2) ** 29, Decimal(2) ** 29], Decimal(0), most=100)


def test_cascade_of_the_reference_cases(spark):
    """Two coverages of 300 and 150 over three sections; an area whose sections differ stays open, one whose sections agree is covered."""
    covered = [(1, "c1", 300), (1, "c2", 150), (2, "c1", 100), (2, "c2", 100), (3, "c1", 999), (3, "c2", 888), (4, "c1", 1000)]
    items = [(1, 1, "roof", 200), (1, 2, "siding", 100), (1, 3, "fence", 150), (2, 1, "a", 100), (2, 2, "b", 100), (3, 1, "roof", 123), (4, 1, "roof", 1000)]
    sections = [(1, "roof", "house"), (1, "siding", "house"), (1, "fence", "yard"), (1, "empty", "yard"), (2, "a", "x"), (2, "b", "x"), (3, "roof", None), (4, "roof", None)]
    money = "decimal(18,2)"
    items = spark.createDataFrame([(d, i, s, Decimal(v)) for d, i, s, v in items], f"doc_id int, item_id int, section string, rcv {money}")
    printed = spark.createDataFrame([(1, "fence", Decimal(1), 1), (1, "fence", Decimal(150), 2)], f"doc_id int, section string, total {money}, ord int")
    coverages = spark.createDataFrame([(d, c, Decimal(v)) for d, c, v in covered], f"doc_id int, coverage_id string, rcv {money}")
    assigned = C.attribute_by_unique_split(C.section_totals(items, printed), coverages)
    got = {(r["doc_id"], r["level"], r["id"]): r["coverage_id"] for r in C.cascade_coverages(assigned, spark.createDataFrame(sections, "doc_id int, section string, area string"), items).collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == 1} == {
        ("section", "roof"): "c1", ("section", "siding"): "c1", ("section", "fence"): "c2", ("section", "empty"): None, ("item", "1"): "c1", ("item", "2"): "c1", ("item", "3"): "c2", ("area", "house"): "c1", ("area", "yard"): None,
    }
    assert all(v is None for k, v in got.items() if k[0] > 1) and len(got) == 9 + 5 + 2 + 2
