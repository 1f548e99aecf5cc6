"""Review: overrides, approval rules, bulk edits, registries, exports and evaluation of rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T

from tallyforge.operators.linkage import break_exact_ties


def _present(*entries: Column) -> Column:
    return F.filter(F.array(*entries), lambda x: x.isNotNull())


def apply_overrides(items: DataFrame, overrides: DataFrame, fields: Sequence[str], key: str = "item_id") -> DataFrame:
    """The reviewed value replaces the machine value even if it is null: presence decides. Machine values stay as machine_<field>.

    overrides: (key, field, value), one row for each key and field.
    """
    aggregates = []
    for f in fields:
        here = F.col("field") == f
        aggregates += [F.max(here).alias(f"has_{f}"), F.max(F.when(here, F.col("value"))).alias(f"new_{f}")]
    wide = overrides.groupBy(key).agg(*aggregates)
    met = items.join(wide, key, "left")
    new = {f: F.when(F.coalesce(f"has_{f}", F.lit(False)), F.col(f"new_{f}")).otherwise(F.col(f).cast("string")) for f in fields}
    kept = [c for c in items.columns if c not in fields]
    return met.select(*kept, *(F.col(f).alias(f"machine_{f}") for f in fields), *(new[f].alias(f) for f in fields))


def bucket_unmapped(items: DataFrame) -> DataFrame:
    """Adds ``bucket``: the first reason that holds."""
    bucket = (
        F.when(F.col("mapped"), "mapped").when(F.col("skipped"), "skipped").when(F.coalesce(F.trim("description"), F.lit("")) == "", "missing description")
        .when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "bad quantity").when(F.col("unit").isNull(), "missing unit").when(F.col("group").isNull(), "unresolved group").otherwise("eligible")
    )
    return items.withColumn("bucket", bucket)


def approval_block_reasons(items: DataFrame) -> DataFrame:
    """Adds ``block_reasons``: every requirement that a row fails."""
    reasons = _present(
        F.when(F.col("category").isNull(), "no category"), F.when(F.col("selector").isNull(), "no selector"), F.when(F.col("activity").isNull() & ~F.col("activity_waived"), "no activity"),
        F.when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "no quantity"), F.when(F.col("unit").isNull(), "no unit"), F.when(F.col("has_fatal"), "fatal error"),
    )
    return items.withColumn("block_reasons", reasons)


def automation_ready(items: DataFrame, verified: DataFrame, verifications: DataFrame, reviewed_groups: DataFrame) -> DataFrame:
    """Adds ``ready``: approved, nothing blocks, the key is human-verified (or the row is, with that key), and the group is reviewed."""
    keys = verified.where("verified").select("category", "selector").distinct().withColumn("key_ok", F.lit(True))
    rows = verifications.select("item_id", F.col("category").alias("i_category"), F.col("selector").alias("i_selector")).dropDuplicates(["item_id"])
    groups = reviewed_groups.select("group").distinct().withColumn("group_ok", F.lit(True))
    met = items.join(keys, ["category", "selector"], "left").join(rows, "item_id", "left").join(groups, "group", "left")
    own = (F.col("i_category") == F.col("category")) & (F.col("i_selector") == F.col("selector"))
    ready = (F.col("status") == "approved") & (F.size("block_reasons") == 0) & (F.coalesce("key_ok", F.lit(False)) | F.coalesce(own, F.lit(False))) & F.coalesce("group_ok", F.lit(False))
    return met.select(*items.columns, F.coalesce(ready, F.lit(False)).alias("ready"))


def coverage_stats(items: DataFrame) -> DataFrame:
    """Conditional counts of a work list: matched, placeholders, none, conflicts, waiting and ready."""
    n = lambda c, name: F.count_if(c).alias(name)
    return items.agg(F.count("*").alias("items"), n(F.col("status") == "approved", "approved"), n(F.col("selector").isNull(), "no_selector"), n(F.size("block_reasons") > 0, "blocked"), n((F.col("status") == "approved") & ~F.col("ready"), "awaiting"), n(F.col("ready"), "ready"))


def mapping_coverage(items: DataFrame, verified: DataFrame, conflicts: DataFrame, ready: DataFrame) -> DataFrame:
    """One row of eight counts: extracted, normalized (trade or component known), verified match, only a placeholder, none, another unit verified, unreviewed, ready.

    items: (item_id, trade, component, mapping_status, status); verified, conflicts
    and ready hold the item_id of those items, as ``verified_matches``,
    ``unit_conflicts`` and ``automation_ready`` find them.
    """
    met = items
    for name, found in (("_verified", verified), ("_conflict", conflicts), ("_ready", ready)):
        met = met.join(found.select("item_id").distinct().withColumn(name, F.lit(True)), "item_id", "left")
    known = lambda c: F.coalesce(F.col(c), F.lit("unknown")) != "unknown"
    sure, has = F.coalesce("_verified", F.lit(False)), F.col("mapping_status").isin("mapped", "partial")
    n = lambda c, name: F.count_if(c).alias(name)
    return met.agg(
        F.count("*").alias("items"), n(known("trade") | known("component"), "normalized"), n(sure, "verified"), n(~sure & has, "placeholder_only"), n(~sure & (F.col("mapping_status") == "unmapped"), "no_match"),
        n(F.coalesce("_conflict", F.lit(False)), "unit_conflict"), n(F.col("status") == "unreviewed", "awaiting"), n(F.coalesce("_ready", F.lit(False)), "ready"),
    )


def bulk_apply(items: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status edits with a reason: (applied, blocked). Approval needs a row that nothing blocks; an edit without reason is blocked."""
    met = items.join(edits.select("item_id", "new_status", "reason"), "item_id")
    blocked = F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", F.array(F.lit("no reason"))).when(F.col("new_status") == "approved", F.col("block_reasons")).otherwise(F.array().cast("array<string>"))
    met = met.withColumn("blocked_by", blocked)
    return met.where(F.size("blocked_by") == 0).select("item_id", F.col("new_status").alias("status"), "reason"), met.where(F.size("blocked_by") > 0).select("item_id", "new_status", "blocked_by")


def edit_fields(items: DataFrame, overrides: DataFrame, edits: DataFrame, editable: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(overrides, history, refused): edits of single fields, one after the other.

    items: item_id and the ``editable`` columns, what the machine found; overrides:
    (item_id, field, original, value, reviewer, reason, at) of the edits before, one
    per field; edits: (edit_id, at, item_id, field, value, reviewer, reason), each
    edit_id once. They count in the order of time and then id. What an edit finds
    is the value of the edit before it, of the override, or the machine's; the last
    one stays beside the machine's value, which no edit changes. history: (edit_id,
    at, item_id, field, before, after, reviewer, reason); refused: (edit_id, why),
    the first of 'field is not editable', 'no reason', 'unknown item'. Values are
    strings; an edit to null is one.
    """
    machine = F.map_from_arrays(F.array(*map(F.lit, editable)), F.array(*(F.col(c).cast("string") for c in editable)))
    asked = edits.join(items.select("item_id", machine.alias("machine")), "item_id", "left")
    why = F.when(~F.coalesce(F.col("field").isin(*editable), F.lit(False)), "field is not editable").when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no reason").when(F.col("machine").isNull(), "unknown item")
    asked = asked.withColumn("why", why)
    held = overrides.select("item_id", "field", F.col("value").alias("held"), F.lit(True).alias("has"))
    found = asked.where("why is null").join(held, ["item_id", "field"], "left")
    order = Window.partitionBy("item_id", "field").orderBy("at", "edit_id")
    first = F.row_number().over(order) == 1
    original = F.col("machine")[F.col("field")]
    told = found.withColumns({"original": original, "before": F.when(~first, F.lag("value").over(order)).when(F.col("has"), F.col("held")).otherwise(original)})
    history = told.select("edit_id", "at", "item_id", "field", "before", F.col("value").alias("after"), "reviewer", "reason")
    last = told.groupBy("item_id", "field").agg(F.max(F.struct("at", "edit_id", "original", "value", "reviewer", "reason")).alias("e"))
    last = last.select("item_id", "field", "e.original", "e.value", "e.reviewer", "e.reason", "e.at")
    kept = overrides.join(last.select("item_id", "field"), ["item_id", "field"], "left_anti").select(*last.columns)
    return kept.unionByName(last), history, asked.where("why is not null").select("edit_id", "why")


def upsert_registry(registry: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts) by signature: another approved key is a conflict unless overridden; the same key is refreshed; reviewer and reason are needed."""
    ok = resolutions.where((F.coalesce("reviewer", F.lit("")) != "") & (F.coalesce("reason", F.lit("")) != ""))
    met = registry.select("signature", F.col("key").alias("old"), "approved", "uses").join(ok.select("signature", F.col("key").alias("new"), "override"), "signature", "full_outer")
    conflict = F.col("approved") & (F.col("old") != F.col("new")) & ~F.coalesce("override", F.lit(False))
    conflict = F.coalesce(conflict, F.lit(False))
    merged = met.select("signature", F.when(conflict | F.col("new").isNull(), F.col("old")).otherwise(F.col("new")).alias("key"), (F.coalesce("approved", F.lit(False)) | (F.col("new").isNotNull() & ~conflict)).alias("approved"), (F.coalesce("uses", F.lit(0)) + F.when(F.col("new").isNotNull() & ~conflict, 1).otherwise(0)).alias("uses"))
    return merged, met.where(conflict).select("signature", "old", "new")


def append_events(log: DataFrame, new: DataFrame) -> DataFrame:
    """The new events (event_id, ...) that the log doesn't have, each once: what a retry adds is nothing."""
    return new.dropDuplicates(["event_id"]).join(log.select("event_id"), "event_id", "left_anti").select(*new.columns)


def fold_registry(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, conflicts) that an append-only log of events gives.

    Events (event_id, signature, at, action, key, status, uses, reviewer, reason,
    override) count in the order of time and then id. 'import' states a mapping
    as it was; 'record' resolves one, as ``upsert_registry`` does; 'disable' and
    'reject' change the status of one that is there. All but imports need reviewer
    and reason. registry: signature, key, status, uses, events (its history as
    'old -> new' of each change of status); conflicts: event_id, signature, old, new.
    A signature's events are few, so they are folded in one row.
    """
    told = (F.coalesce(F.trim("reviewer"), F.lit("")) != "") & (F.coalesce(F.trim("reason"), F.lit("")) != "")
    rows = log.where((F.col("action") == "import") | told)
    fields = ("at", "event_id", "action", "key", "status", "uses", "override")
    ordered = rows.groupBy("signature").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("told"))
    key, number = log.schema["key"].dataType, log.schema["event_id"].dataType
    conflict = f"array<struct<event_id:{number.simpleString()},old:{key.simpleString()},new:{key.simpleString()}>>"
    none = F.struct(
        F.lit(None).cast(key).alias("key"), F.lit("none").alias("status"), F.lit(0).cast("long").alias("uses"), F.array().cast("array<string>").alias("events"), F.array().cast(conflict).alias("conflicts"),
    )

    def step(s: Column, e: Column) -> Column:
        here = s["status"] != "none"
        records, imports = e["action"] == "record", e["action"] == "import"
        clash = records & (s["status"] == "approved") & ~s["key"].eqNullSafe(e["key"]) & ~F.coalesce(e["override"], F.lit(False))
        changes = e["action"].isin("disable", "reject") & here
        status = F.when(imports, e["status"]).when(records & ~clash, "approved").when(changes, F.when(e["action"] == "disable", "disabled").otherwise("rejected")).otherwise(s["status"])
        moved = F.when(status != s["status"], F.array(F.concat(s["status"], F.lit(" -> "), status))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.when(imports | (records & ~clash), e["key"]).otherwise(s["key"]).alias("key"), status.alias("status"),
            (F.when(imports, F.coalesce(e["uses"], F.lit(0))).otherwise(s["uses"]) + F.when(records & ~clash, 1).otherwise(0)).cast("long").alias("uses"), F.concat(s["events"], moved).alias("events"),
            F.concat(s["conflicts"], F.when(clash, F.array(F.struct(e["event_id"].alias("event_id"), s["key"].alias("old"), e["key"].alias("new")))).otherwise(F.array().cast(conflict))).alias("conflicts"),
        )

    folded = ordered.select("signature", F.aggregate("told", none, step).alias("s"))
    return folded.where("s.status <> 'none'").select("signature", "s.key", "s.status", "s.uses", "s.events"), folded.select("signature", F.explode("s.conflicts").alias("c")).select("c.event_id", "signature", "c.old", "c.new")


def add_verified(catalog: DataFrame, records: DataFrame, units: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reasons): required fields, a new key, a known unit, three confirmations for verified ones."""
    met = records.join(catalog.select("key", F.lit(True).alias("exists")).distinct(), "key", "left")
    reasons = _present(
        F.when(F.coalesce(F.trim("description"), F.lit("")) == "", "no description"), F.when(F.col("exists"), "key exists"), F.when(~F.col("unit").isin(list(units)), "unknown unit"),
        F.when((F.col("status") == "verified") & ((F.col("confirmations") < 3) | F.col("reviewer").isNull()), "not confirmed"),
    )
    met = met.withColumn("reasons", reasons)
    return met.where(F.size("reasons") == 0).select(*records.columns), met.where(F.size("reasons") > 0).select("key", "reasons")


def export_approved(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections with their rows, excluded with a reason): approved rows that still pass; unreviewed rows are left out of both."""
    ok = (F.col("status") == "approved") & (F.size("block_reasons") == 0)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "item_id"))), lambda x: x["item_id"])
    sections = items.where(ok).groupBy("doc_id", "section").agg(listed.alias("item_ids"), F.count("*").alias("n"))
    excluded = items.where(~ok & (F.col("status") != "unreviewed")).select("doc_id", "item_id", F.when(F.col("status") == "approved", F.concat_ws("; ", "block_reasons")).otherwise(F.col("status")).alias("reason"))
    return sections, excluded


def reset_unfinished(tasks: DataFrame, pairs: DataFrame, full: bool = False) -> DataFrame:
    """Tasks back to pending except finished ones; both sides of a pair stay if either has activity. With ``full`` all go back."""
    if full:
        return tasks.select("task_id", "state", F.lit("pending").alias("new_state"))
    active = tasks.where("state in ('done', 'committed', 'active')").select("task_id").distinct()
    both = pairs.select("pair_id", F.explode(F.array("a", "b")).alias("task_id"))
    hot = both.join(active, "task_id", "left_semi").select("pair_id").distinct()
    kept = both.join(hot, "pair_id", "left_semi").select("task_id").distinct().withColumn("protected", F.lit(True))
    met = tasks.join(kept, "task_id", "left")
    stays = F.col("state").isin("done", "committed") | F.coalesce("protected", F.lit(False))
    return met.select("task_id", "state", F.when(stays, F.col("state")).otherwise("pending").alias("new_state"))


def reset_transitions(reset: DataFrame) -> DataFrame:
    """(state, new_state, n, changed): how many tasks of ``reset_unfinished`` went from each state to which."""
    return reset.groupBy("state", "new_state").agg(F.count("*").alias("n")).withColumn("changed", F.col("state") != F.col("new_state"))


def coverage_of_sources(outputs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, n) of source rows that aren't in exactly one output's provenance."""
    n = outputs.select(F.explode("sources").alias("item_id")).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n")).where("n != 1")


def learn_from_outcomes(outcomes: DataFrame) -> DataFrame:
    """Latest committed result per item that began unmapped; reusable if verified independently."""
    rows = outcomes.where("committed and began_unmapped")
    return rows.groupBy("item_id").agg(F.max_by(F.struct("key", "verified"), F.struct("ts", "outcome_id")).alias("last")).select("item_id", F.col("last.key").alias("key"), F.col("last.verified").alias("reusable"))


STATES = ["completed", "review", "no_match", "failed", "skipped", "pending"]


def run_rollup(tasks: DataFrame, group: str) -> DataFrame:
    """Per group: tasks by state and by route, the last touched one and the first cause of a stop."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    route = lambda r: F.count_if(F.col("route") == r).alias(f"by_{r}")
    return tasks.groupBy(group).agg(
        F.count("*").alias("tasks"), *(n(s) for s in STATES), *(route(r) for r in ("registry", "verified", "search")), F.max_by("task_id", F.struct("touched", "task_id")).alias("last_touched"),
        F.min_by("cause", F.when(F.col("cause").isNotNull(), F.struct("touched", "task_id"))).alias("first_cause"),
    )


def real_ground_truth(states: DataFrame, items: DataFrame, overrides: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Approved rows with a complete key and no marker of synthetic data in reviewer, note or an override's reason (item_id, reason)."""
    pattern = "|".join(markers)
    odd = F.lower(F.concat_ws(" ", "reviewer", "note")).rlike(pattern)
    marked = overrides.where(F.lower("reason").rlike(pattern)).select("item_id")
    ok = states.where((F.col("status") == "approved") & ~odd).select("item_id").join(marked, "item_id", "left_anti")
    return items.join(ok, "item_id", "left_semi").where(F.col("category").isNotNull() & F.col("selector").isNotNull())


def evaluate_ranking(ranked: DataFrame, truth: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), *flags: str) -> DataFrame:
    """Per value of each flag and overall: cases, top-k shares, mean reciprocal rank, resolved share and wrong but resolved.

    ranked: (query_id, key, rank, resolved); truth: (query_id, key, flags).
    """
    hit = truth.join(ranked.select("query_id", "key", "rank", "resolved"), ["query_id", "key"], "left")
    top = ranked.where("rank = 1").select("query_id", F.col("resolved").alias("auto"), F.col("key").alias("top_key"))
    met = hit.join(top, "query_id", "left")
    measures = [F.count("*").alias("cases"), *(F.avg((F.coalesce("rank", F.lit(10**9)) <= k).cast("double")).alias(f"top_{k}") for k in ks), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce("auto", F.lit(False)).cast("double")).alias("coverage"), F.count_if(F.coalesce("auto", F.lit(False)) & (F.col("top_key") != F.col("key"))).alias("wrong_but_resolved")]
    out = met.groupingSets([[F.col(f)] for f in flags] + [[]], *(F.col(f) for f in flags)).agg(*measures) if flags else met.agg(*measures)
    return out


def compare_rankings(ranked: DataFrame, baseline: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: cases, resolved ones, how many of those are right and their share (null without any), and how the right answer's rank changed.

    ranked: (query_id, key, rank, resolved), baseline: (query_id, key, rank), truth:
    (query_id, key). A change counts where both lists have the answer; the mean is
    of places gained.
    """
    top = ranked.where("rank = 1").select("query_id", F.col("key").alias("top_key"), "resolved")
    now, before = (df.select("query_id", "key", F.col("rank").alias(name)) for df, name in ((ranked, "now"), (baseline, "before")))
    met = truth.select("query_id", "key").join(top, "query_id", "left").join(now, ["query_id", "key"], "left").join(before, ["query_id", "key"], "left")
    sure, gained = F.coalesce("resolved", F.lit(False)), F.col("before") - F.col("now")
    right = sure & (F.col("top_key") == F.col("key"))
    return met.agg(
        F.count("*").alias("cases"), F.count_if(sure).alias("resolved"), F.count_if(right).alias("right"), (F.count_if(right) / F.nullif(F.count_if(sure), F.lit(0))).alias("accuracy"),
        F.count_if(gained > 0).alias("improved"), F.count_if(gained < 0).alias("worsened"), F.count_if(gained == 0).alias("unchanged"), F.avg(gained).alias("mean_gain"),
    )


def sweep_policy(observations: DataFrame, scores: Sequence[int], margins: Sequence[int]) -> DataFrame:
    """The grid cell (score, margin; in hundredths) without an error that accepts most, then the lowest score and margin.

    Observations are counted by score and margin first, so the grid meets a bounded table.
    """
    counts = observations.groupBy("score", "margin").agg(F.count("*").alias("n"), F.count_if(~F.col("correct")).alias("errors"))
    grid = observations.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, scores))).alias("least_score")).select("least_score", F.explode(F.array(*map(F.lit, margins))).alias("least_margin"))
    cells = grid.join(counts, (F.col("score") >= F.col("least_score")) & (F.col("margin") >= F.col("least_margin")), "left")
    sums = cells.groupBy("least_score", "least_margin").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("accepted"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors")).where("errors = 0")
    best = sums.agg(F.max(F.struct("accepted", -F.col("least_score"), -F.col("least_margin"))).alias("b"))
    return best.select(F.col("b.accepted").alias("accepted"), (-F.col("b.col2")).alias("least_score"), (-F.col("b.col3")).alias("least_margin"))


def recommendation_stats(events: DataFrame, item: str = "item_id") -> DataFrame:
    """Counts by action and the mean of candidates per item (in thousandths)."""
    return events.groupBy("action").agg(F.count("*").alias("n"), F.countDistinct(item).alias("items"), F.floor(F.sum("candidates") * 1000 / F.count("*")).cast("long").alias("mean_candidates"))


def state_stats(states: DataFrame) -> DataFrame:
    """(state, n, mean_candidates): items by the state of their candidates, a null state for all of them; means to three places."""
    return states.groupingSets([[F.col("state")], []], "state").agg(F.count("*").alias("n"), F.round(F.avg("candidates"), 3).alias("mean_candidates"))


def reuse_stats(plans: DataFrame) -> DataFrame:
    """Items, those resolved by the registry, those to be searched, and agreement with the truth."""
    return plans.agg(F.count("*").alias("items"), F.count_if(F.col("path") == "registry").alias("by_registry"), F.count_if(F.col("path") == "search").alias("searched"), F.count_if(F.col("key") == F.col("truth")).alias("agree"))


def timing_summary(events: DataFrame, group: str, value: str) -> DataFrame:
    """n, total, mean, median, least and most per group."""
    return events.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def decide_evidence(items: DataFrame, ranked: DataFrame, hints: DataFrame, item: str, key: str) -> DataFrame:
    """(item, decision, gate, key, score, second, margin): ordered gates over an item's best candidates; each gate says what decided.

    ranked: (item, key, score in ten-thousandths, category, text, conflict,
    confidence, action_confirmed); hints: (item, category). Without candidates or
    under 5500 there is no match. Under 8800 the best is accepted only if it
    dominates: 7000 or more, no conflict, sure, its action confirmed, 2000 ahead
    of a second under 6000. Then a conflict, low confidence and a margin under 800
    ask for review, but for an exact best before an inexact second and for exact
    ties, which the hints decide if they name one of two, else the first takes.
    """
    best = Window.partitionBy(item).orderBy(F.desc("score"), key)
    rows = ranked.withColumns({"rank": F.row_number().over(best), "second": F.coalesce(F.lead("score").over(best), F.lit(0))}).where("rank = 1")
    winners = break_exact_ties(ranked, hints, item, key).select(item, "winner")
    met = items.select(item).distinct().join(rows, item, "left").join(winners, item, "left")
    score, second = F.col("score"), F.col("second")
    margin = score - second
    sure = F.col("confidence") >= 0.8
    dominant = (score >= 7000) & ~F.col("conflict") & sure & F.col("action_confirmed") & (margin >= 2000) & (second < 6000)
    gate = (
        F.when(score.isNull(), "no candidates").when(score < 5500, "below review floor").when((score < 8800) & dominant, "dominant below floor").when(score < 8800, "below accept floor").when(F.col("conflict"), "conflict")
        .when(~sure, "low confidence").when(margin >= 800, "clear margin").when((score >= 9990) & (second < 9990), "exact best").when(margin > 0, "thin margin").when(F.col("winner").isNotNull(), "tie decided by hint").otherwise("tie, first taken")
    )
    decision = F.when(gate.isin("no candidates", "below review floor"), "no_match").when(gate.isin("below accept floor", "conflict", "low confidence", "thin margin"), "review").otherwise("accepted")
    chosen = F.when(decision == "accepted", F.when(gate == "tie decided by hint", F.col("winner")).otherwise(F.col(key)))
    return met.select(item, decision.alias("decision"), gate.alias("gate"), chosen.alias(key), "score", "second", margin.alias("margin"))


def relaxed_queries(items: DataFrame, attempts: Sequence[str], index: DataFrame) -> DataFrame:
    """(item_id, attempt, hits): the first of the ordered query texts that finds anything by exact text in ``index`` (text, key)."""
    tried = items.select("item_id", F.posexplode(F.array(*(F.col(a) for a in attempts))).alias("attempt", "text")).where("text is not null")
    found = tried.join(index.groupBy("text").agg(F.count("*").alias("hits")), "text")
    return found.groupBy("item_id").agg(F.min(F.struct("attempt", "hits")).alias("f")).select("item_id", "f.attempt", "f.hits")


def staged_search(items: DataFrame, attempts: Sequence[str], records: DataFrame, key: str) -> DataFrame:
    """(item_id, attempt, hits, first): the first of the ordered query texts that finds records (key, tokens), how many, and the smallest key.

    A text finds the records that have all its tokens. Each attempt searches for
    the items that the ones before left. Records of the same tokens are one, with
    their number and smallest key. Distinct texts meet them by their rarest token
    only; the others are tested on those that have it.
    """
    alike = records.select(key, F.array_sort(F.array_distinct("tokens")).alias("tokens")).groupBy("tokens").agg(F.count("*").alias("n_alike"), F.min(key).alias("first"))
    words = alike.select("tokens", "n_alike", "first", F.explode("tokens").alias("token"))
    often = words.groupBy("token").agg(F.sum("n_alike").alias("n"))
    left, found = items.select("item_id", *attempts), None
    for i, attempt in enumerate(attempts):
        texts = left.select(F.col(attempt).alias("text")).where("text is not null").distinct().withColumn("own", T.tokens(F.col("text")))
        rarest = texts.select("text", "own", F.explode("own").alias("token")).join(often, "token", "left").groupBy("text", "own").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
        met = rarest.join(words, "token").where(F.size(F.array_except("own", "tokens")) == 0)
        hits = met.groupBy("text").agg(F.sum("n_alike").alias("hits"), F.min("first").alias("first"))
        one = left.select("item_id", F.col(attempt).alias("text")).join(hits, "text").select("item_id", F.lit(i).alias("attempt"), "hits", "first")
        found = one if found is None else found.unionByName(one)
        left = left.join(one.select("item_id"), "item_id", "left_anti")
    return found


def build_work_list(items: DataFrame, suggestions: DataFrame, include_unmapped: bool = False) -> DataFrame:
    """(doc_id, group_id, group_no, task_no, item_id, mode, problem): approved rows as ordered tasks of ordered groups.

    items have doc_id, item_id, ord, group (a section's name), status, category,
    selector and bucket; suggestions (name, suggestion) give a group's own name.
    With ``include_unmapped`` eligible rows without a key are tasks to search. An
    approved row without a key is a problem, never a silent task.
    """
    keyed = F.col("category").isNotNull() & F.col("selector").isNotNull()
    approved = F.col("status") == "approved"
    wanted = approved | (F.lit(include_unmapped) & ~keyed & (F.col("status") != "rejected") & (F.col("bucket") == "eligible"))
    named = items.where(wanted).join(suggestions.select(F.col("name").alias("group"), "suggestion"), "group", "left")
    rows = named.withColumn("group_id", F.coalesce("suggestion", "group", F.lit("ungrouped")))
    first = F.min("ord").over(Window.partitionBy("doc_id", "group_id"))
    rows = rows.withColumn("_first", first).withColumn("group_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_first", "group_id")))
    task = F.row_number().over(Window.partitionBy("doc_id", "group_id").orderBy("ord", "item_id"))
    return rows.select("doc_id", "group_id", "group_no", task.alias("task_no"), "item_id", F.when(keyed, "key").otherwise("search").alias("mode"), F.when(approved & ~keyed, "approved without a key").alias("problem"))


def shadow_plan(resolved: DataFrame, items: DataFrame, fallback: str) -> DataFrame:
    """(doc_id, resolution, n, n_fallback): what each document's rows would resolve to; unresolved rows take the fallback key.

    resolved (item_id, rec_id, resolution) as ``linkage.resolve`` gives it; rows without candidates fall back too.
    """
    met = items.select("doc_id", "item_id").join(resolved, "item_id", "left")
    state = F.coalesce("resolution", F.lit("fallback"))
    key = F.when(state == "resolved", F.col("rec_id").cast("string")).otherwise(F.lit(fallback))
    return met.groupBy("doc_id", state.alias("resolution")).agg(F.count("*").alias("n"), F.count_if(key == fallback).alias("n_fallback"))
