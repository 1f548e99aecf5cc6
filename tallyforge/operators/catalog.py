"""Catalogs: quality flags, survivorship, corroboration, search and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T


def _present(*entries: Column) -> Column:
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def eligible_records(catalog: DataFrame, include_uncertain: bool = False) -> DataFrame:
    """Records that need no review; uncertain ones only on request."""
    out = catalog.where(~F.col("needs_review"))
    return out if include_uncertain else out.where(~F.col("uncertain"))


def search_catalog(catalog: DataFrame, *, query: str | None = None, category: str | None = None, selector: str | None = None, needs_review: bool | None = None, limit: int | None = None) -> DataFrame:
    """AND of exact filters; the query is a substring of the description, an alias or the upper-case key parts. Ordered by key."""
    out = catalog
    if category is not None:
        out = out.where(F.col("category") == category)
    if selector is not None:
        out = out.where(F.col("selector") == selector)
    if needs_review is not None:
        out = out.where(F.col("needs_review") == needs_review)
    if query is not None:
        low, up = query.lower(), query.upper()
        out = out.where(F.lower("description").contains(low) | F.upper("category").contains(up) | F.upper("selector").contains(up) | F.exists("aliases", lambda a: F.lower(a).contains(low)))
    out = out.orderBy("category", "selector")
    return out if limit is None else out.limit(limit)


def quality_flags(rows: DataFrame, least: float = 0.85, units: Sequence[str] = T.UNITS) -> DataFrame:
    """Adds ``flags`` and ``review_only`` (an empty key or description)."""
    description = F.trim("description")
    empty = (F.coalesce(F.trim("selector"), F.lit("")) == "") | (F.coalesce(description, F.lit("")) == "")
    flags = _present(
        F.when(description.rlike(r"(\.{2,}|…)$"), "truncated"), F.when(F.col("confidence") < least, "low confidence"), F.when(F.col("selector").rlike("[a-z]"), "lower case in key"),
        F.when(F.element_at(F.split(description, " "), -1).isin(list(units)), "trailing unit"), F.when(empty, "empty"),
    )
    return rows.withColumns({"flags": flags, "review_only": empty})


def merge_records(rows: DataFrame, key: str) -> DataFrame:
    """One survivor per key: not truncated, then most confident, then longest, then first.

    Provenance is united; a conflict is any other description that is neither
    equal, nor a truncation of the survivor, nor similar by .90. The survivor is
    found by one pre-aggregated maximum and joined back, so a hot key is not gathered.
    """
    truncated = F.trim("description").rlike(r"(\.{2,}|…)$")
    rank = F.struct((~truncated).cast("int"), F.coalesce("confidence", F.lit(0.0)), F.length("description"), -F.col("seq"))
    best = rows.groupBy(key).agg(F.max_by(F.struct("description", "confidence", "title"), rank).alias("best"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("first_title"), F.sort_array(F.collect_set("source")).alias("sources"), F.count("*").alias("n"))
    met = rows.select(key, "description").join(best.select(key, F.col("best.description").alias("kept")), key)
    odd = ~((F.col("description") == F.col("kept")) | T.truncation_of(F.col("description"), F.col("kept")) | (T.similarity(F.col("description"), F.col("kept")) >= 0.9))
    conflicts = met.groupBy(key).agg(F.sort_array(F.collect_set(F.when(odd, F.col("description")))).alias("conflicts"))
    return best.join(conflicts, key).select(key, F.col("best.description").alias("description"), F.col("best.confidence").alias("confidence"), F.col("first_title").alias("title"), "sources", "n", "conflicts", (F.size("conflicts") > 0).alias("conflicting"))


def corroborated_label(votes: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """(group, label, n): the top alternate label of a group if it differs from its own and has enough of the votes, one vote per source."""
    each = votes.select("group", "own", "source", "label").distinct()
    counts = each.groupBy("group", "own", "label").agg(F.count("*").alias("n"))
    total = counts.groupBy("group").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("top"))
    own = counts.select("group", "own").distinct()
    met = total.join(own, "group").select("group", "own", F.col("top.label").alias("label"), F.col("top.n").alias("n"), "total")
    return met.where((F.col("label") != F.col("own")) & (F.col("n") >= least) & (F.col("n") > F.col("total") * share))


def catalog_stats(catalog: DataFrame, *groups: str) -> DataFrame:
    """Counts and needs-review counts by each group and overall, by grouping sets: (kind, value, n, n_review)."""
    sets = [[F.col(g)] for g in groups] + [[]]
    out = catalog.groupingSets(sets, *(F.col(g) for g in groups)).agg(F.count("*").alias("n"), F.count_if("needs_review").alias("n_review"), F.grouping_id(*groups).alias("gid"))
    full = 2 ** len(groups) - 1
    kind, value = F.lit("all"), F.lit(None).cast("string")
    for i, g in enumerate(groups):
        own = F.col("gid") == full - 2 ** (len(groups) - 1 - i)
        kind, value = F.when(own, g).otherwise(kind), F.when(own, F.col(g).cast("string")).otherwise(value)
    return out.select(kind.alias("kind"), value.alias("value"), "n", "n_review")


def validate_catalog(catalog: DataFrame, units: Sequence[str], actions: Sequence[str], trades: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """(mapping_id, problem): repeated ids, equal shapes (trade, component, actions, units), unknown words, missing texts, key, provenance or verifier."""
    shape = F.concat_ws("|", "trade", "component", F.array_join(F.array_sort("actions"), ","), F.array_join(F.array_sort("units"), ","))
    ids = catalog.groupBy("mapping_id").agg(F.count("*").alias("n")).where("n > 1").select("mapping_id", F.lit("repeated id").alias("problem"))
    shapes = catalog.withColumn("shape", shape)
    hot = shapes.groupBy("shape").agg(F.countDistinct("mapping_id").alias("n")).where("n > 1").select("shape")
    same = shapes.join(hot, "shape", "left_semi").select("mapping_id", F.lit("overlapping shape").alias("problem")).distinct()
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    beyond = lambda c, known: F.size(F.array_except(c, F.array(*map(F.lit, known)))) > 0
    problems = _present(
        F.when(beyond("units", units), "unknown unit"), F.when(beyond("actions", actions), "unknown action"), F.when(~F.col("trade").isin(list(trades)), "unknown trade"), F.when(~F.col("status").isin(list(statuses)), "unknown status"),
        F.when((F.col("status") == "verified") & blank("verified_by"), "verified by nobody"), F.when(blank("selector"), "empty key"), F.when(blank("description"), "empty description"), F.when(F.size("sources") == 0, "no provenance"),
    )
    return ids.unionByName(same).unionByName(catalog.select("mapping_id", F.explode(problems).alias("problem")))


def _two_smallest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, low, high): the two smallest ids of each group; high is low where there is one only."""
    nth = F.dense_rank().over(Window.partitionBy(*keys).orderBy("mapping_id"))
    return rows.withColumn("nth", nth).where("nth <= 2").groupBy(*keys).agg(F.min("mapping_id").alias("low"), F.max("mapping_id").alias("high"))


def overlapping_shapes(catalog: DataFrame) -> DataFrame:
    """(mapping_id, other): entries that another entry of the same trade and component overlaps, with the smallest such id.

    Two entries overlap if they share an action and a unit; a missing or empty list
    stands for all. Entries of the same lists are one shape. Each shape is spread
    over its cells of action and unit and looks up the at most four groups of cells
    that can hold another one; shapes and groups know their two smallest ids, so
    entries of a trade never meet in pairs. The joins are by sorting on both sides:
    what lists are spread to can't be told from a catalog's size, and would be sent
    to the driver for a broadcast.
    """
    every = F.lit("*")
    listed = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_sort(F.array_distinct(c))).otherwise(F.array(every))
    of_shape, of_cell = ["trade", "component", "actions", "units"], ["trade", "component", "action", "unit"]
    entries = catalog.select("mapping_id", "trade", "component", listed("actions").alias("actions"), listed("units").alias("units"))
    cells = _two_smallest(entries, of_shape).withColumn("action", F.explode("actions")).withColumn("unit", F.explode("units"))
    # a cell in the four views: with or without looking at its action and its unit
    either = lambda c: F.array(F.col(c), F.lit(None).cast("string"))
    views = cells.withColumn("action", F.explode(either("action"))).withColumn("unit", F.explode(either("unit")))
    ids = F.explode(F.array_distinct(F.array("low", "high"))).alias("mapping_id")
    groups = _two_smallest(views.select(*of_cell, ids), of_cell)
    # a shape for all actions looks at no action; any other looks at its own and at those for all
    asked = lambda c: F.when(F.col(c) == "*", F.array(F.lit(None).cast("string"))).otherwise(F.array(F.col(c), every))
    looks = cells.drop("low", "high").withColumn("action", F.explode(asked("action"))).withColumn("unit", F.explode(asked("unit")))
    met = _null_safe(looks, groups.hint("merge"), of_cell)
    found = _two_smallest(met.select(*(looks[c] for c in of_shape), ids), of_shape)
    own = _null_safe(entries, found.hint("merge"), of_shape)
    other = F.when(F.col("low") != F.col("mapping_id"), F.col("low")).when(F.col("high") != F.col("mapping_id"), F.col("high"))
    return own.select("mapping_id", other.alias("other")).where("other is not null").groupBy("mapping_id").agg(F.min("other").alias("other"))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that agree in all keys, two nulls included."""
    same = F.lit(True)
    for c in keys:
        same = same & left[c].eqNullSafe(right[c])
    return left.join(right, same)


def resolve_malformed(catalog: DataFrame) -> DataFrame:
    """Malformed keys folded into the first well-formed record of the same category and description that has another source; else flagged."""
    # Records of one text and one set of sources are one, so that copies don't multiply.
    good = catalog.where("well_formed").groupBy("category", "description_normalized", F.array_sort("sources").alias("g_sources")).agg(F.min("key").alias("g_key"))
    bad = catalog.where("not well_formed")
    met = bad.join(good, ["category", "description_normalized"], "left").withColumn("fits", F.coalesce(F.size(F.array_except("g_sources", "sources")) > 0, F.lit(False)))
    return met.groupBy("key").agg(F.min(F.when(F.col("fits"), F.col("g_key"))).alias("into")).withColumn("state", F.when(F.col("into").isNotNull(), "resolved").otherwise("open"))


def catalog_fix(catalog: DataFrame, fresh: DataFrame, units: Sequence[str] = T.UNITS) -> DataFrame:
    """A reparsed description is accepted if the old one is it plus a trailing unit; equal ones are legitimate; else flagged."""
    met = catalog.join(fresh.select("key", F.col("description").alias("new")), "key")
    suffix = F.element_at(F.split("description", " "), -1)
    state = F.when(F.col("description") == F.col("new"), "legitimate").when((F.col("description") == F.concat_ws(" ", "new", suffix)) & suffix.isin(list(units)), "fixed").otherwise("flagged")
    return met.select("key", state.alias("state"), F.when(state == "fixed", F.col("new")).otherwise(F.col("description")).alias("description"))


def unit_conflicts(items: DataFrame, verified: DataFrame) -> DataFrame:
    """Items whose trade and component are verified with another unit."""
    v = verified.select(F.col("trade").alias("v_trade"), F.col("component").alias("v_component"), F.col("unit").alias("v_unit")).distinct()
    return items.join(v, (F.col("trade") == F.col("v_trade")) & (F.col("component") == F.col("v_component")) & (F.col("unit") != F.col("v_unit")), "left_semi")


def fuzzy_search(catalog: DataFrame, query: str, category: str | None = None, k: int = 10) -> DataFrame:
    """The k descriptions most similar to a query, of one category if wanted, then by key."""
    rows = catalog if category is None else catalog.where(F.col("category") == category)
    return rows.select("key", "description", T.similarity(F.col("description"), F.lit(query)).alias("similarity")).orderBy(F.desc("similarity"), "key").limit(k)


def suggest_group(names: DataFrame, groups: Sequence[str], aliases: dict[str, str]) -> DataFrame:
    """(name, suggestion, how, points): exact 1000, alias 950, containment 750 and up to 200 by length, similarity of .60 or more; the first group on ties.

    Groups and aliases are a short rule list, so each distinct name meets them in
    one expression.
    """
    low = F.lower("name")
    ratio = lambda g: F.least(F.length("name"), F.length(g)) / F.greatest(F.length("name"), F.length(g))
    inside = lambda g: F.contains(low, F.lower(g)) | F.contains(F.lower(g), low)
    options = []
    for i, name in enumerate(groups):
        g = F.lit(name)
        similar = T.similarity(low, F.lower(g))
        scored = F.when(low == F.lower(g), F.struct(F.lit(4).alias("tier"), F.lit(1000).alias("points"), F.lit(-i).alias("ord"), g.alias("group"), F.lit("exact").alias("how")))
        scored = scored.when(inside(g), F.struct(F.lit(2).alias("tier"), (750 + F.floor(F.least(F.lit(0.2), ratio(g)) * 1000)).cast("int").alias("points"), F.lit(-i).alias("ord"), g.alias("group"), F.lit("substring").alias("how")))
        options.append(scored.when(similar >= 0.6, F.struct(F.lit(1).alias("tier"), F.floor(similar * 1000).cast("int").alias("points"), F.lit(-i).alias("ord"), g.alias("group"), F.lit("fuzzy").alias("how"))))
    for i, (alias, target) in enumerate(aliases.items()):
        options.append(F.when(low == alias.lower(), F.struct(F.lit(3).alias("tier"), F.lit(950).alias("points"), F.lit(-i).alias("ord"), F.lit(target).alias("group"), F.lit("alias").alias("how"))))
    best = names.select("name").distinct().withColumn("b", F.array_max(F.array(*options)))
    return best.select("name", F.col("b.group").alias("suggestion"), F.coalesce("b.how", F.lit("none")).alias("how"), F.coalesce("b.points", F.lit(0)).alias("points"))


def committed_queue(tasks: DataFrame) -> DataFrame:
    """Committed tasks that someone must look at, in the order of their source (``ord``, then task_id).

    tasks: task_id, ord, state, commit_state, has_row, uncertain, the chosen and
    the observed category and selector beside the task's own, review_reason,
    stop_detail and trust_state. A task stands in the queue if its state is
    'review_required', nothing about its row is uncertain (null: nothing), and it
    is committed, or, where no commit state is told, it has a row.
    """
    committed = F.when(F.col("commit_state").isNull(), F.coalesce("has_row", F.lit(False))).otherwise(F.col("commit_state") == "committed")
    due = tasks.where((F.col("state") == "review_required") & ~F.coalesce("uncertain", F.lit(False)) & committed)
    filled = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))
    return due.select(
        "task_id", "ord", filled("selected_category", "observed_category", "category").alias("category"), filled("selected_selector", "observed_selector", "selector").alias("selector"),
        filled("review_reason", "stop_detail", "trust_state").alias("reason"), "trust_state",
    ).orderBy("ord", "task_id")


def review_queue(*flagged: tuple[str, DataFrame]) -> DataFrame:
    """(key, reason) of rows that several checks flagged."""
    out = None
    for reason, rows in flagged:
        one = rows.select("key", F.lit(reason).alias("reason"))
        out = one if out is None else out.unionByName(one)
    return out


def price_observations(verified: DataFrame) -> DataFrame:
    """Nested observations flattened: a running number per key and price list, and whether it is the list's latest."""
    rows = verified.select("key", F.explode("observations").alias("o")).select("key", "o.*")
    order = Window.partitionBy("key", "price_list").orderBy("observed_at", "unit_price")
    latest = Window.partitionBy("key", "price_list").orderBy(F.desc("observed_at"), F.desc("unit_price"))
    return rows.withColumns({"observation_no": F.row_number().over(order), "is_latest": F.row_number().over(latest) == 1})


def price_lists(verified: DataFrame) -> DataFrame:
    """(key, price_list, n, first_at, last_at, latest_price): the observations of each list, counted."""
    rows = verified.select("key", F.explode("observations").alias("o")).select("key", "o.*")
    return rows.groupBy("key", "price_list").agg(
        F.count("*").alias("n"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.max_by("unit_price", F.struct("observed_at", "unit_price")).alias("latest_price"),
    )


def prior_uses(items: DataFrame) -> DataFrame:
    """Approved uses per category and selector over all documents."""
    return items.where("status = 'approved'").groupBy("category", "selector").agg(F.count("*").alias("uses"))


def import_report(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Per category: sources, raw rows, unique keys, review rows and a status."""
    a = manifest.groupBy("category").agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "failed").alias("failed"))
    b = records.groupBy("category").agg(F.count("*").alias("raw_rows"), F.countDistinct("key").alias("unique_keys"), F.count_if("needs_review").alias("review_rows"))
    out = a.join(b, "category", "full_outer").fillna(0)
    return out.withColumn("status", F.when(F.col("failed") > 0, "failed").when(F.col("raw_rows") == 0, "empty").when(F.col("review_rows") > 0, "needs_review").otherwise("complete"))
