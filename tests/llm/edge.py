"""Small tables of the cases that every operator defines."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PROSE = "the river bends twice before the old mill and then it runs on to the sea past fields of barley"
TEXTS = [
    None, "", "   \n\t ", "one", "One two\nTWO three", PROSE, PROSE, PROSE.upper(), f"{PROSE} today", f"{PROSE}\n{PROSE}\n\nshort line\nshort line",
    "naïve café £5 déjà-vu", "All Rights\nReserved. Licensed CC-BY 4.0 and the GNU General Public License", "cc by cc by all rights reserved", "it's <|endoftext|> we'll x\x00y 東京 1234",
    "# * $ % & | < >\r\n# * $ % & | < >", LONG, LONG + " tail", "a b c\x1cd e", "repeat me now again please " * 12,
]

#: Names that operators use inside, on columns that they must leave alone.
EXTRA = ["id", "n", "fp", "sketch", "key", "component", "place", "rank", "shard", "found", "kept", "quality"]


def documents(spark, texts=TEXTS, first=0):
    """doc_id, text and clashing extra columns; one row has a null id, one row stands twice."""
    rows = [(first + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.select("doc_id", "text", *(F.lit(f"extra-{c}").alias(c) for c in EXTRA))


def odd_documents(spark):
    df = documents(spark)
    twice = df.where("doc_id = 5")
    nameless = df.where("doc_id in (0, 4)").withColumn("doc_id", F.lit(None).cast("long"))
    return df.unionByName(twice).unionByName(nameless)


def empty_documents(spark):
    return documents(spark).where("false")
