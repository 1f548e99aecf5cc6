"""Rule files: ordered lists of rules as JSON, read as typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, rules array<struct<value: string, patterns: array<string>>>"


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """(kind, ord, value, pattern_ord, pattern) of the files under ``path``, each an object {kind, rules: [{value, patterns}]}.

    The order in the file is the order of the rules. A file of another shape
    fails; a rule without patterns has one row with a null pattern.
    """
    files = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rules = files.select("kind", F.posexplode("rules").alias("ord", "r"))
    return rules.select("kind", "ord", F.col("r.value").alias("value"), F.posexplode_outer("r.patterns").alias("pattern_ord", "pattern"))


#: A file of typed rules: concepts with their patterns, attributes with a regex, hints by kind, words that are short for others.
TYPED = (
    "kind string, rules array<struct<patterns:array<string>,action:string,trade:string,component:string,material:string>>, "
    "attribute_patterns array<struct<name:string,pattern:string,attribute:string,type:string,value_if_matched:string>>, "
    "hints array<struct<kind:string,value:string,categories:array<string>>>, groups array<string>, aliases map<string,string>"
)


def load_typed_rules(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the typed rule files under ``path``, in the order that each file has them; ``kind`` is the file's own.

    concepts (kind, ord, concept, value, pattern_ord, pattern), a row for each of
    action, trade, component and material that a rule names and each of its
    patterns, in lower case; attributes (kind, ord, attribute, pattern, type,
    value), patterns without regard to case, of type str unless told; hints (kind,
    on, value, category, ord); groups (kind, ord, value); aliases (kind, alias,
    value). Rules without patterns are left out, parts that a file lacks are empty,
    and a file of another shape fails.
    """
    files = spark.read.schema(TYPED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rules = files.select("kind", F.posexplode("rules").alias("ord", "r"))
    names = ("action", "trade", "component", "material")
    told = F.filter(F.array(*(F.struct(F.lit(n).alias("concept"), F.col(f"r.{n}").alias("value")) for n in names)), lambda x: x["value"].isNotNull())
    concepts = rules.select("kind", "ord", "r", F.explode(told).alias("t")).select("kind", "ord", "t.*", F.posexplode("r.patterns").alias("pattern_ord", "pattern")).withColumn("pattern", F.lower("pattern"))
    attributes = files.select("kind", F.posexplode("attribute_patterns").alias("ord", "a")).select("kind", "ord", "a.attribute", F.concat(F.lit("(?i)"), F.col("a.pattern")).alias("pattern"), F.coalesce("a.type", F.lit("str")).alias("type"), F.col("a.value_if_matched").alias("value"))
    hints = files.select("kind", F.explode("hints").alias("h")).select("kind", F.col("h.kind").alias("on"), "h.value", F.posexplode("h.categories").alias("ord", "category")).select("kind", "on", "value", "category", "ord")
    groups = files.select("kind", F.posexplode("groups").alias("ord", "value"))
    aliases = files.select("kind", F.explode("aliases").alias("alias", "value"))
    return {"concepts": concepts, "attributes": attributes, "hints": hints, "groups": groups, "aliases": aliases}


def rule_list(rules: DataFrame, kind: str) -> list[tuple[str, list[str]]]:
    """The rules of a kind as (value, patterns) in order: a file's content, which is small."""
    rows = rules.where(F.col("kind") == kind).orderBy("ord", "pattern_ord").collect()
    out: dict[int, tuple[str, list[str]]] = {}
    for r in rows:
        _, patterns = out.setdefault(r["ord"], (r["value"], []))
        if r["pattern"] is not None:
            patterns.append(r["pattern"])
    return list(out.values())
