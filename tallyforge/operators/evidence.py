"""Evidence scores of a row against the entries found for it: only dimensions that apply count, and absence contradicts nothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T


@dataclass(frozen=True)
class Vocabulary:
    """(keyword, canonical) of materials and styles, the words an action has in entries, and words of other structures."""

    materials: Sequence[tuple[str, str]] = ()
    styles: Sequence[tuple[str, str]] = ()
    actions: dict[str, str] = field(default_factory=dict)
    structures: Sequence[str] = ()


@dataclass(frozen=True)
class Weights:
    """Weights of the dimensions and caps of their conflicts, in hundredths."""

    description: int = 25
    component: int = 25
    material: int = 15
    size: int = 10
    action: int = 10
    grade: int = 5
    verified: int = 5
    wrong_component: int = 45
    wrong_material: int = 55
    wrong_size: int = 60
    wrong_action: int = 50
    wrong_grade: int = 55


def _stated(text: Column, words: Sequence[tuple[str, str]]) -> Column:
    """Canonical terms whose keyword stands in the text."""
    return F.filter(F.array(*(F.when(F.contains(text, F.lit(k)), F.lit(c)) for k, c in words), F.lit(None).cast("string")), lambda x: x.isNotNull())


def _state(asked: Column, same: Column, other: Column) -> Column:
    """MATCH, CONFLICT (another value is stated) or UNSPECIFIED; null if nothing is asked for."""
    return F.when(asked.isNull(), None).when(same, "MATCH").when(other, "CONFLICT").otherwise("UNSPECIFIED")


def score_evidence(pairs: DataFrame, vocabulary: Vocabulary, weights: Weights = Weights()) -> DataFrame:
    """Adds material_state, size_state, grade_state, action_state, component_ok and ``score`` (ten-thousandths) to pairs.

    Pairs have description, component, material, action, size_key, grade_key and
    verified of the row and candidate, the entry's text. The score is the weighted
    average over the dimensions that apply: MATCH 1, UNSPECIFIED .5, CONFLICT 0
    with a cap. An entry longer than the row's text scores their length ratio, one
    inside it 1 unless it drops the words of the action. A style or structural
    word that the row doesn't ask for is a conflict; so is an action without its
    words in the entry.
    """
    v, w = vocabulary, weights
    own_columns = pairs.columns
    # what is said of a pair more than once is a column, so that it is worked out once
    pairs = pairs.withColumns({"_item": T.norm_description(F.col("description"), False), "_text": T.norm_description(F.col("candidate"), False)})
    item, text = F.col("_item"), F.col("_text")
    pairs = pairs.withColumns({
        "_words": T.tokens(F.replace(F.when(F.col("component") != "unknown", F.col("component")).otherwise(""), F.lit("_"), F.lit(" "))), "_theirs": T.tokens(text), "_named": _stated(text, v.materials), "_grades": _stated(text, v.styles),
        "_material": F.coalesce(F.nullif(F.lower("material"), F.lit("")), F.try_element_at(_stated(item, v.materials), F.lit(1))), "_their_size": T.size_term(text), "_pair": T.dimension_pair(item), "_their_pair": T.dimension_pair(text),
    })
    said = F.create_map(*[F.lit(x) for p in v.actions.items() for x in p])[F.col("action")] if v.actions else F.lit(None).cast("string")
    fuzzy = F.when((item == "") | (text == ""), 0.0).otherwise(T.similarity(item, text))
    omitted = F.regexp_replace(item, F.concat(F.lit("\\Q"), text, F.lit("\\E")), F.lit(""))
    drops = F.coalesce(F.contains(omitted, said) & ~F.contains(text, said), F.lit(False))
    description = F.when((F.coalesce(item, F.lit("")) == "") | (F.coalesce(text, F.lit("")) == ""), 0.0).when(item == text, 1.0).when(F.contains(text, item), F.length(item) / F.length(text)).when(F.contains(item, text), F.when(drops, fuzzy).otherwise(1.0)).otherwise(fuzzy)
    words, theirs = F.col("_words"), F.col("_theirs")
    met = F.exists(words, lambda a: F.exists(theirs, lambda b: T.word_match(a, b)))
    stray = F.exists(F.array(*map(F.lit, v.structures)), lambda m: F.array_contains(theirs, m) & ~F.array_contains(words, m) & ~F.contains(item, m)) if v.structures else F.lit(False)
    component_ok = (F.size(words) == 0) | (met & ~stray)
    material, named = F.col("_material"), F.col("_named")
    own = F.contains(text, material) | F.contains(material, text) | F.arrays_overlap(T.tokens(material), theirs) | F.array_contains(named, material)
    material_state = _state(material, F.coalesce(own, F.lit(False)), F.size(named) > 0)
    size, their_size = F.lower("size_key"), F.col("_their_size")
    size_state = _state(size, F.coalesce(F.contains(text, size), F.lit(False)), F.coalesce(their_size != size, F.lit(False)))
    pair, their_pair = F.col("_pair"), F.col("_their_pair")
    size_state = F.when(F.coalesce(pair != their_pair, F.lit(False)), "CONFLICT").otherwise(size_state)
    grade, grades = F.lower("grade_key"), F.col("_grades")
    grade_state = _state(grade, F.coalesce(F.contains(text, grade), F.lit(False)), (F.size(grades) > 0) & ~F.coalesce(F.array_contains(grades, grade), F.lit(False)))
    unasked = F.lit(False)
    for k, _ in v.styles:
        unasked = unasked | (F.contains(text, F.lit(k)) & ~F.contains(item, F.lit(k)))
    grade_state = F.when(unasked, "CONFLICT").otherwise(grade_state)
    action_state = F.when(said.isNull(), None).when(F.contains(text, said), "MATCH").otherwise("CONFLICT")
    pairs = pairs.withColumns({"material_state": material_state, "size_state": size_state, "grade_state": grade_state, "action_state": action_state, "component_ok": component_ok, "_description": description})
    material_state, size_state, grade_state, action_state, component_ok, description = (F.col(c) for c in ("material_state", "size_state", "grade_state", "action_state", "component_ok", "_description"))
    value = lambda s: F.when(s == "MATCH", 1.0).when(s == "UNSPECIFIED", 0.5).otherwise(0.0)
    dims = [
        (F.lit(True), w.description, description), (F.lit(True), w.component, F.when(component_ok, 1.0).otherwise(0.0)), (material.isNotNull(), w.material, value(material_state)), (size.isNotNull(), w.size, value(size_state)),
        (said.isNotNull(), w.action, F.when(action_state == "MATCH", 1.0).otherwise(0.5)), (grade.isNotNull(), w.grade, value(F.when(grade.isNotNull(), grade_state))), (F.coalesce("verified", F.lit(False)), w.verified, F.lit(1.0)),
    ]
    total = sum((F.when(on, n * s).otherwise(0.0) for on, n, s in dims), F.lit(0.0))
    share = sum((F.when(on, n).otherwise(0) for on, n, _ in dims), F.lit(0))
    caps = [(~component_ok, w.wrong_component), (material_state == "CONFLICT", w.wrong_material), (size_state == "CONFLICT", w.wrong_size), (grade_state == "CONFLICT", w.wrong_grade), (action_state == "CONFLICT", w.wrong_action)]
    score = F.floor(F.least(total / share * 10000 + 1e-6, *(F.when(c, n * 100).otherwise(10000) for c, n in caps))).cast("int")
    return pairs.withColumn("score", score).select(*own_columns, "material_state", "size_state", "grade_state", "action_state", "component_ok", "score")
