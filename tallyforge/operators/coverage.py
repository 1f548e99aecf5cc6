"""Coverages of a document: blocks of amounts found in its lines, and which coverage each section belongs to.

Blocks are found by classes of lines (lookups of a line and the next ones), a
small automaton over them and running counts; nothing but columns. Attribution
meets in the middle: the sums that each half of a document's sections can give
the coverages are listed once, sorted, and matched.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions.automaton import Automaton

#: Label starts of a coverage's amounts and the field of each, most specific first.
AMOUNTS = [
    ("total recoverable depreciation", "recoverable_depreciation"),
    ("less non - recoverable depreciation", "nonrecoverable_depreciation"),
    ("less non-recoverable depreciation", "nonrecoverable_depreciation"),
    ("total line item depreciation", "depreciation"),
    ("total depreciation", "depreciation"),
    ("less depreciation", "depreciation"),
    ("net claim if depreciation is recovered", "net_claim_recovered"),
    ("total amount of claim if incurred", "net_claim_recovered"),
    ("net actual cash value payment", "net_claim"),
    ("net claim", "net_claim"),
    ("less deductible", "deductible"),
    ("material sales tax", "tax"),
    ("comm repr/remod tax", "tax"),
    ("cleaning mtl tax", "cleaning_material_tax"),
    ("cleaning sales tax", "cleaning_sales_tax"),
    ("total paid when incurred", "rcv"),
    ("replacement cost value", "rcv"),
    ("actual cash value", "acv"),
    ("line item total", "line_item_total"),
    ("subtotal", "subtotal"),
    ("overhead", "overhead"),
    ("profit", "profit"),
]
#: Words that a coverage's name doesn't end with, so that it goes on in the next line.
DANGLING = ["and", "or", "the", "of", "for", "a", "an", "&", "-"]
#: What opens a block, before or after its name, the name that is none, and the longest line that can end so.
OPENS, INCURRED, ALL_ITEMS, LONGEST = "summary for", "paid when incurred", "all items", 90

#: States: outside of blocks; in one, by labels missed in a row; after a block's opening; on the next line stand a value, a name, a name and its rest, or the rest of a name.
_IN = ["in_0", "in_1", "in_2", "in_3"]
_TAKEN = {"value": "in_0", "name": "opened", "name_and_rest": "rest", "rest": "opened"}
_FREE = ["outside", "opened", *_IN]


def _moves(to: str) -> dict[str, str]:
    """A class of lines that leads to one state, unless an earlier line takes the line."""
    return {**dict.fromkeys(_FREE, to), **_TAKEN}


_BLOCKS = Automaton(
    ["outside", "opened", *_IN, *_TAKEN],
    {
        "other": {**_TAKEN, "opened": "in_1", "in_0": "in_1", "in_1": "in_2", "in_2": "in_3", "in_3": "outside"},
        "all_items": {**_TAKEN, "opened": "in_0", "in_0": "in_1", "in_1": "in_2", "in_2": "in_3", "in_3": "outside"},
        "named": _moves("opened"), "named_on": _moves("rest"), "bare": _moves("name"), "bare_on": _moves("name_and_rest"), "incurred": _moves("in_0"),
        "amount": {**_moves("in_0"), "outside": "outside"}, "label": {**_moves("value"), "outside": "outside"},
    },
)


def _field(low: Column, amounts: Sequence[tuple[str, str]]) -> Column:
    """The field of the first start that the text has."""
    return F.coalesce(*(F.when(low.startswith(start), name) for start, name in amounts))


def coverage_lines(lines: DataFrame, amounts: Sequence[tuple[str, str]] = AMOUNTS) -> DataFrame:
    """(doc_id, page, line, text, kind, field, inline, next, next_page, name, state) of each line that isn't blank: its class and the state it meets."""
    order = Window.partitionBy("doc_id").orderBy("page", "line")
    rows = lines.select("doc_id", "page", "line", F.trim(F.regexp_replace("text", T.BLANKS, " ")).alias("text")).where("text <> ''")
    # each a column before it is compared with two dozen starts, or it would be worked out as often
    rows = rows.withColumn("low", F.lower("text")).withColumn("label", F.rtrim("low", F.lit(":")))
    rows = rows.withColumn("field", _field(F.col("label"), amounts)).drop("label")
    rows = rows.withColumns({f"next{i}": F.lead(F.struct("text", "low", "page", "field"), i).over(order) for i in (1, 2)})

    def goes_on(name: Column, following: Column) -> Column:
        """Whether a name lacks its end and the following short line can be it."""
        low = following["low"]
        short = F.size(F.split(following["text"], " +")) <= 3
        return F.coalesce(F.lower(F.element_at(F.split(name, " +"), -1)).isin(DANGLING) & short & ~low.startswith(OPENS) & ~low.endswith(INCURRED) & following["field"].isNull(), F.lit(False))

    inline_name = F.trim(F.substr("text", F.lit(len(OPENS) + 1)))
    next1, next2 = F.col("next1"), F.col("next2")
    before = F.regexp_replace(F.left("text", F.length("text") - len(INCURRED)), "^[ -]+|[ -]+$", "")
    opens = F.col("low").startswith(OPENS)
    bare = opens & (inline_name == "") & F.coalesce(next1["low"] != ALL_ITEMS, F.lit(False))
    after_colon = F.when(F.contains("text", F.lit(":")), F.trim(F.regexp_extract("text", "^[^:]*:(.*)$", 1))).otherwise("")
    kind = (
        F.when(opens & (F.lower(inline_name) == ALL_ITEMS), "all_items").when(opens & (inline_name != ""), F.when(goes_on(inline_name, next1), "named_on").otherwise("named"))
        .when(bare, F.when(goes_on(next1["text"], next2), "bare_on").otherwise("bare")).when(~opens & F.col("low").endswith(INCURRED) & (F.length("text") < LONGEST) & (before != ""), "incurred")
        .when(F.col("field").isNotNull(), F.when(after_colon != "", "amount").otherwise("label")).otherwise("other")
    )
    rows = rows.withColumn("kind", kind).withColumn(
        "name",
        F.when(F.col("kind") == "named", inline_name).when(F.col("kind") == "named_on", F.concat_ws(" ", inline_name, next1["text"])).when(F.col("kind") == "bare", next1["text"])
        .when(F.col("kind") == "bare_on", F.concat_ws(" ", next1["text"], next2["text"])).when(F.col("kind") == "incurred", before),
    )
    rows = rows.select("doc_id", "page", "line", "text", "kind", "field", after_colon.alias("inline"), next1["text"].alias("next"), next1["page"].alias("next_page"), "name")
    # one taken line and four that are no labels lead outside from anywhere; names take two lines at most
    return _BLOCKS.run(rows, ["doc_id"], ["page", "line"], "kind", 8, "other")


def coverage_blocks(lines: DataFrame, amounts: Sequence[tuple[str, str]] = AMOUNTS) -> DataFrame:
    """(doc_id, ord, code, name, sub, incurred, field, amount, pages): amounts of each coverage, in long form.

    'Summary for X' (X inline or on the next line, all items aside, its end on
    one more line if the name lacks it) or 'X paid when incurred' opens a block,
    across page breaks. A label's amount is inline or on the next line; the first
    one of a field that is an amount counts. The block ends at the next opening or
    after four lines in a row that are no labels. Blank lines count nowhere; a
    block without amounts has one row without a field.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "line")
    free = F.col("state").isin(_FREE)
    opening = free & F.col("kind").isin("named", "named_on", "bare", "bare_on", "incurred")
    label = free & (F.col("state") != "outside") & F.col("kind").isin("amount", "label")
    rows = coverage_lines(lines, amounts).withColumns({"ord": F.sum(opening.cast("int")).over(order).cast("int"), "opening": opening})
    rows = rows.where(opening | label).withColumn("amount", F.when(~F.col("opening"), T.parse_money(F.when(F.col("kind") == "amount", F.col("inline")).otherwise(F.col("next")))))
    own_pages = F.when(F.col("kind") == "label", F.array("page", "next_page")).otherwise(F.array("page"))
    blocks = rows.groupBy("doc_id", "ord").agg(
        F.max(F.when(F.col("opening"), F.col("name"))).alias("raw"), F.max(F.when(F.col("opening"), F.col("kind") == "incurred")).alias("incurred"),
        F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_list(own_pages))))).alias("pages"),
        F.collect_list(F.when(F.col("amount").isNotNull(), F.struct("page", "line", "field", "amount"))).alias("found"),
    )
    each = blocks.select("doc_id", "ord", "raw", "incurred", "pages", F.explode_outer("found").alias("one"))
    first = each.groupBy("doc_id", "ord", "one.field").agg(F.first("raw").alias("raw"), F.first("incurred").alias("incurred"), F.first("pages").alias("pages"), F.min_by("one.amount", F.struct("one.page", "one.line")).alias("amount"))
    name = T.coverage_name(F.col("raw"))
    return first.select("doc_id", "ord", name["code"].alias("code"), name["name"].alias("name"), name["sub"].alias("sub"), "incurred", "field", "amount", "pages")


# ---- which coverage a section belongs to


def _joined(sums: np.ndarray, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row of sums once, how many ways lead there (two stand for more), and the first row that was equal."""
    order = np.lexsort(sums.T) if sums.shape[1] else np.arange(len(sums))
    ordered = sums[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)]) if len(sums) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    return ordered[new], np.minimum(np.bincount(group, ways[order], int(new.sum())), 2).astype(np.int64), order[new]


class _Half:
    """What the sections of one half can give all coverages but the last, and one way to it."""

    def __init__(self, values: np.ndarray, targets: np.ndarray, slack: int, most: int, bounded: bool):
        k = len(targets)
        self.sums, self.ways, self.came = np.zeros((1, k - 1), np.int64), np.ones(1, np.int64), []
        total = 0
        for value in values.tolist():
            total += value
            sums = np.repeat(self.sums, k, axis=0)
            target = np.tile(np.arange(k), len(self.sums))
            for b in range(k - 1):
                sums[target == b, b] += value
            keep = np.ones(len(sums), bool)
            if bounded:  # no value is negative: sums only grow
                keep = (sums <= targets[:-1] + slack).all(axis=1) & (total - sums.sum(axis=1) <= targets[-1] + slack)
            at = np.flatnonzero(keep)
            self.sums, self.ways, first = _joined(sums[at], self.ways[at // k])
            self.came.append((at[first] // k, target[at[first]]))
            if len(self.sums) > most:
                raise OverflowError
        self.total = total

    def way_to(self, at: int) -> list[int]:
        out = []
        for parent, target in reversed(self.came):
            out.append(int(target[at]))
            at = int(parent[at])
        return out[::-1]


def unique_split(values: Sequence[Decimal], targets: Sequence[Decimal], tolerance: Decimal, most: int = 1 << 20) -> list[int] | None:
    """The target of each value if exactly one assignment brings every target's sum within the tolerance; else None.

    The values are cut in halves. Each half's possible sums are listed, equal
    ones once with their number of ways, the other half's are sorted into cells
    as wide as the tolerance, and each sum looks up the two cells by target in
    which its complement can lie. Negative values are allowed. More than ``most``
    different sums of a half raise OverflowError.
    """
    scale = max([2, *(-x.as_tuple().exponent for x in (*values, *targets, tolerance))])
    cents = lambda xs: np.array([int(x.scaleb(scale)) for x in xs], np.int64)
    own, wanted, slack = cents(values), cents(targets), int(tolerance.scaleb(scale))
    rank = np.argsort(-own, kind="stable")  # halves of like sizes prune alike
    left, right = (_Half(own[rank[i::2]], wanted, slack, most, bool((own >= 0).all())) for i in (0, 1))
    k = len(targets)
    width = 2 * slack + 1
    weights = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(k - 1)], np.uint64)
    key_of = lambda cells: (cells.astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    keys = key_of(right.sums // width)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    low = wanted[:-1] - slack - left.sums  # of what the other half has to give
    answers, found = 0, None
    for corner in range(1 << (k - 1)):
        cell = low // width + np.array([(corner >> b) & 1 for b in range(k - 1)], np.int64)
        first, last = np.searchsorted(keys, key_of(cell), "left"), np.searchsorted(keys, key_of(cell), "right")
        i = np.repeat(np.arange(len(first)), last - first)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[i]]
        # the cell itself, as unequal cells can share a key; then all sums, the last target's included
        right_cell = (right.sums[j] // width == cell[i]).all(axis=1)
        sums = left.sums[i] + right.sums[j]
        rest = left.total + right.total - sums.sum(axis=1)
        fits = right_cell & (np.abs(sums - wanted[:-1]) <= slack).all(axis=1) & (np.abs(rest - wanted[-1]) <= slack)
        for a, b in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
            answers += int(left.ways[a] * right.ways[b])
            found = (a, b)
            if answers > 1:
                return None
    if found is None:
        return None
    out = np.empty(len(own), np.int64)
    out[rank[0::2]], out[rank[1::2]] = left.way_to(found[0]), right.way_to(found[1])
    return out.tolist()


#: Notes of documents, and their places here; the first is none.
_NOTES = [None, "fewer than two coverages", "coverages of equal amounts", "no single assignment", "too many possible sums"]
_FEWER, _EQUAL, _OPEN, _TOO_MANY = 1, 2, 3, 4
#: Documents with at most so many assignments are tried side by side, in blocks of so many sums.
_TRIED, _BLOCK = 1 << 12, 1 << 20


def _tried(values: np.ndarray, targets: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """unique_split of documents with equal numbers of values and targets, one a row, by all assignments: whether there is one only, and it."""
    m, n = values.shape
    k = targets.shape[1]
    sums = [np.zeros((m, 1), np.int64) for _ in range(k - 1)]
    for j in range(n):  # the first value's target is the highest digit of an assignment's number
        for b in range(k - 1):
            add = np.zeros((m, 1, k), np.int64)
            add[:, 0, b] = values[:, j]
            sums[b] = (sums[b][:, :, None] + add).reshape(m, -1)
    fits = np.abs(values.sum(axis=1)[:, None] - sum(sums) - targets[:, -1:]) <= slack
    for b in range(k - 1):
        fits &= np.abs(sums[b] - targets[:, b : b + 1]) <= slack
    return fits.sum(axis=1) == 1, fits.argmax(axis=1)[:, None] // k ** np.arange(n - 1, -1, -1) % k


def _splits(values: np.ndarray, sizes: np.ndarray, targets: np.ndarray, found: np.ndarray, slack: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A note for each document and a place in ``targets`` (or -1) for each value; documents have ``sizes`` values and ``found`` targets in cents."""
    starts, firsts = np.cumsum(sizes) - sizes, np.cumsum(found) - found
    note, chosen = np.where(found < 2, _FEWER, 0), np.full(len(values), -1, np.int64)
    whole = np.bincount(np.repeat(np.arange(len(sizes)), sizes), np.abs(values.astype(float)), len(sizes)) + np.bincount(np.repeat(np.arange(len(found)), found), targets.astype(float), len(found))
    few = (sizes * np.log(np.maximum(found, 1)) <= np.log(_TRIED) + 1e-9) & ((sizes + 1) // 2 * np.log(np.maximum(found, 1)) <= np.log(max(most, 1)) + 1e-9) & (whole < 2.0**61)
    few &= found >= 2
    for n, k in np.unique(np.stack([sizes[few], found[few]], axis=1), axis=0).tolist():
        alike = np.flatnonzero(few & (sizes == n) & (found == k))
        step = max(1, _BLOCK // k**n)
        for at in (alike[i : i + step] for i in range(0, len(alike), step)):
            places = starts[at][:, None] + np.arange(n)
            one, way = _tried(values[places], targets[firsts[at][:, None] + np.arange(k)], slack)
            note[at[~one]] = _OPEN
            chosen[places[one]] = way[one] + firsts[at[one]][:, None]
    exact = lambda xs: [Decimal(int(x)).scaleb(-2) for x in xs]
    for i in np.flatnonzero((found >= 2) & ~few).tolist():
        own = slice(starts[i], starts[i] + sizes[i])
        try:
            way = unique_split(exact(values[own]), exact(targets[firsts[i] : firsts[i] + found[i]]), Decimal(slack).scaleb(-2), most)
        except OverflowError:
            note[i] = _TOO_MANY
            continue
        if way is None:
            note[i] = _OPEN
        else:
            chosen[own] = np.array(way, np.int64) + firsts[i]
    return note, chosen


def section_totals(items: DataFrame, printed: DataFrame) -> DataFrame:
    """(doc_id, section, total): the last printed total (doc_id, section, total, ord) of a section, else the sum of its items' rcv (doc_id, section, rcv)."""
    own = items.where("section is not null and rcv is not null").groupBy("doc_id", "section").agg(F.sum(F.col("rcv").cast("decimal(18,2)")).cast("decimal(18,2)").alias("summed"))
    said = printed.where("section is not null and total is not null").groupBy("doc_id", "section").agg(F.max_by(F.col("total").cast("decimal(18,2)"), "ord").alias("printed"))
    return own.join(said, ["doc_id", "section"], "full").select("doc_id", "section", F.coalesce("printed", "summed").alias("total"))


def attribute_by_unique_split(sections: DataFrame, coverages: DataFrame, tolerance: str = "0.05", most: int = 1 << 20) -> DataFrame:
    """(doc_id, section, coverage_id, note): which coverage each section's total belongs to, if the amounts allow one answer only.

    sections (doc_id, section, total), coverages (doc_id, coverage_id, rcv).
    Targets are positive and differ; with fewer than two of them, without a single
    solution, or where half of the sections can give more than ``most`` different
    sums (40 sections between two coverages, or 24 among three, never do) the
    section stays open with a note. A document's two short lists meet in one row;
    documents of few sections are tried side by side, whole batches at once.
    """
    cents = lambda c: (F.col(c).cast("decimal(18,2)") * 100).cast("long")
    totals = sections.where("total is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", cents("total").alias("total")))).alias("parts"))
    own = coverages.where("rcv > 0").groupBy("doc_id", cents("rcv").alias("rcv")).agg(F.min("coverage_id").alias("coverage_id"), F.count("*").alias("n"))
    wanted = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") == 1, F.struct("coverage_id", "rcv")))).alias("targets"), F.max(F.col("n") > 1).alias("same"))
    key, kind, coverage = (df.schema[c].dataType.simpleString() for df, c in ((sections, "doc_id"), (sections, "section"), (coverages, "coverage_id")))
    slack, notes = int(Decimal(tolerance) * 100), pa.array(_NOTES, pa.string())

    def run(batches):
        for batch in batches:
            parts, targets = batch.column("parts"), batch.column("targets")
            sizes, found = (pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (parts, targets))
            parts, targets = parts.flatten(), targets.flatten()
            values, wanted = (pc.struct_field(c, [1]).to_numpy(zero_copy_only=False).astype(np.int64) for c in (parts, targets))
            note, chosen = _splits(values, sizes, wanted, found, slack, most)
            note[(note == _FEWER) & pc.fill_null(batch.column("same"), False).to_numpy(zero_copy_only=False)] = _EQUAL
            of = np.repeat(np.arange(len(sizes)), sizes)
            coverage_id = pc.struct_field(targets, [0]).take(pa.array(chosen, mask=chosen < 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), pc.struct_field(parts, [0]), coverage_id, notes.take(pa.array(note[of]))], ["doc_id", "section", "coverage_id", "note"])

    return totals.join(wanted, "doc_id", "left").mapInArrow(run, f"doc_id {key}, section {kind}, coverage_id {coverage}, note string")


def cascade_coverages(assigned: DataFrame, sections: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, level, id, coverage_id): coverages of sections, of their items, and of areas whose sections all have the same one.

    assigned as attribute_by_unique_split returns it, sections (doc_id, section,
    area), items (doc_id, item_id, section). What stays open has a null coverage.
    """
    given = assigned.select("doc_id", "section", "coverage_id")
    known = sections.join(given, ["doc_id", "section"], "left")
    of_items = items.select("doc_id", "section", "item_id").join(given, ["doc_id", "section"], "left")
    agreed = F.when((F.count("coverage_id") == F.count("*")) & (F.min("coverage_id") == F.max("coverage_id")), F.min("coverage_id"))
    areas = known.where("area is not null").groupBy("doc_id", "area").agg(agreed.alias("coverage_id"))
    level = lambda df, name, c: df.select("doc_id", F.lit(name).alias("level"), F.col(c).cast("string").alias("id"), "coverage_id")
    return level(known, "section", "section").unionByName(level(of_items, "item", "item_id")).unionByName(level(areas, "area", "area"))
