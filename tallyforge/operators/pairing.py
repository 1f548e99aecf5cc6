"""Rows matched one to one: queues of pairs, names against observed rows, effects of a new rule; capped and custom candidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.operators.linkage import verified_matches


def collapse_pairs_fifo(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ord, item_id, base_id, quantity_differs): rows left after each removal has taken its base.

    rows: (keys, ord, item_id, description, quantity, resolved). 'remove X' takes the
    first later resolved row 'X' of the same keys that no earlier removal has
    taken, so matching is a queue: with running counts of removals and bases, the
    k-th base that finds a removal waiting belongs to the k-th removal. Bases that
    are taken are no rows of their own; a removal without base stays alone.
    """
    text = T.norm_ws(F.lower("description"))
    removal = text.startswith("remove ")
    marked = rows.withColumns({"_removal": removal, "_text": F.when(removal, F.regexp_replace(text, "^remove ", "")).otherwise(text)})
    own = Window.partitionBy(*keys, "_text").orderBy("ord", "item_id")
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    able = F.col("resolved")
    counted = marked.withColumns({"_r": F.sum((able & F.col("_removal")).cast("int")).over(so_far), "_b": F.sum((able & ~F.col("_removal")).cast("int")).over(so_far)})
    counted = counted.withColumn("_taken", F.col("_b") + F.least(F.lit(0), F.min(F.col("_r") - F.col("_b")).over(so_far)))
    counted = counted.withColumn("_claimed", able & ~F.col("_removal") & (F.col("_taken") > F.coalesce(F.lag("_taken").over(own), F.lit(0))))
    bases = counted.where("_claimed").select(*keys, "_text", F.col("_taken").alias("_no"), F.col("item_id").alias("base_id"), F.col("quantity").alias("_q"))
    left = counted.where("not _claimed").withColumn("_no", F.when(able & F.col("_removal"), F.col("_r")))
    met = left.join(bases, [*keys, "_text", "_no"], "left")
    differs = F.col("base_id").isNotNull() & ~F.coalesce(F.col("quantity") == F.col("_q"), F.lit(False))
    return met.select(*keys, "ord", "item_id", "base_id", differs.alias("quantity_differs"))


def one_to_one_reconcile(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """(group_id, name, row_id, problem): each planned name (group_id, name) must stand in exactly one observed row (group_id, row_id, text), and no row in two.

    Names and rows are compared by their letters and digits only. Rows are spread
    over their substrings of the lengths that names have, so that a name meets the
    rows that it stands in and no others, whatever beginning names share.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    names = planned.select("group_id", "name", bare("name").alias("n"))
    repeated = F.count("*").over(Window.partitionBy("group_id", "n"))
    names = names.withColumn("_same", repeated > 1)
    wanted = names.where("n != '' and not _same")
    lengths = planned.select(F.length(bare("name")).alias("k")).where("k > 0").agg(F.collect_set("k").alias("lengths"))  # one row
    rows = observed.select("group_id", "row_id", bare("text").alias("t")).join(F.broadcast(lengths))
    parts = F.transform(F.filter("lengths", lambda k: k <= F.length("t")), lambda k: F.transform(F.sequence(F.lit(1), F.length("t") - k + 1), lambda i: F.substr("t", i, k)))
    rows = rows.select("group_id", "row_id", F.explode(F.array_distinct(F.flatten(parts))).alias("n"))
    met = wanted.join(rows, ["group_id", "n"]).select("group_id", "name", "row_id").distinct()
    counts = met.groupBy("group_id", "name").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("row_id"))
    shared = counts.where("n_rows = 1").withColumn("n_names", F.count("*").over(Window.partitionBy("group_id", "row_id"))).select("group_id", "name", "n_names")
    out = names.join(counts, ["group_id", "name"], "left").join(shared, ["group_id", "name"], "left")
    problem = F.when(F.col("n") == "", "empty name").when(F.col("_same"), "repeated name").when(F.col("n_rows").isNull(), "no row").when(F.col("n_rows") > 1, "several rows").when(F.col("n_names") > 1, "row of two names")
    return out.select("group_id", "name", F.when(problem.isNull(), F.col("row_id")).alias("row_id"), problem.alias("problem"))


def preview_rule_effect(records: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id, effect) of adding verified records (with category and selector) to rows (with status, category and selector as reviewed).

    'conflict' for an approved row of another key, 'changed' for an unapproved one,
    'new' for a row without a key; rows that have the key already are left out.
    """
    met = verified_matches(items, records).join(records.select("key", F.col("category").alias("k_category"), F.col("selector").alias("k_selector")), "key")
    met = met.join(items.select("item_id", "status", F.col("row_category").alias("c"), F.col("row_selector").alias("s")), "item_id")
    same = F.col("c").eqNullSafe(F.col("k_category")) & F.col("s").eqNullSafe(F.col("k_selector"))
    effect = F.when(same, None).when(F.col("status") == "approved", "conflict").when(F.col("c").isNotNull() | F.col("s").isNotNull(), "changed").otherwise("new")
    return met.select("key", "item_id", effect.alias("effect")).where("effect is not null")


def first_n_per_query(rows: DataFrame, query: str = "query_id", position: str = "position", n: int = 15) -> DataFrame:
    """The first ``n`` rows of each query by position, before they are scored."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(position))).where(F.col("_r") <= n).drop("_r")


def set_difference(expected: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct expected keys that were not seen; null keys count as values."""
    return expected.select(*keys).distinct().exceptAll(seen.select(*keys).distinct())


def token_sets(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds common, either and only_a of two arrays of tokens."""
    return pairs.withColumns({"common": F.array_intersect(a, b), "either": F.array_union(a, b), "only_a": F.array_except(a, b)})


def rerank_custom(candidates: DataFrame, item: str, key: str, score: Callable, weight: float = 0.18) -> DataFrame:
    """(item, key, combined, rank, applied): candidates (item, key, score, a, b) re-ranked by a scalar pandas function of the texts a and b.

    The function gets the supplied candidates only, in Arrow batches, and returns
    as many numbers, cut to 0 to 1. A batch that it fails on, or returns another
    count for, makes its items fall back to their order: ``applied`` is False for
    all candidates of an item unless all of them were scored.
    """

    @F.pandas_udf("double")
    def guarded(a: pd.Series, b: pd.Series) -> pd.Series:
        try:
            found = pd.Series(score(a, b), dtype="float64")
        except (ValueError, RuntimeError, TypeError):
            found = pd.Series(dtype="float64")
        return found.reset_index(drop=True) if len(found) == len(a) else pd.Series([None] * len(a), dtype="float64")

    own = Window.partitionBy(item)
    scored = candidates.withColumn("_s", guarded("a", "b"))
    scored = scored.withColumn("applied", F.min(F.col("_s").isNotNull() & ~F.isnan("_s")).over(own))
    combined = F.when(F.col("applied"), (1 - weight) * F.col("score") + weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_s")))).otherwise(F.col("score"))
    # Equal to nine places is a tie, which the key decides.
    out = scored.select(item, key, F.round(combined, 9).alias("combined"), "applied")
    return out.withColumn("rank", F.row_number().over(own.orderBy(F.desc("combined"), key)))


def choose_candidate(ranked: DataFrame, item: str, key: str, choices: DataFrame) -> DataFrame:
    """(item, key, state) by a chooser's index into an item's ranked list, from 0; null abstains, an index outside the list is an error.

    ranked: (item, key, rank); choices: (item, choice).
    """
    n = ranked.groupBy(item).agg(F.count("*").alias("n"))
    met = n.join(choices.select(item, "choice"), item, "left").join(ranked.select(item, key, (F.col("rank") - 1).alias("choice")), [item, "choice"], "left")
    state = F.when(F.col("choice").isNull(), "abstained").when((F.col("choice") < 0) | (F.col("choice") >= F.col("n")), "error").otherwise("chosen")
    return met.select(item, key, state.alias("state"))


