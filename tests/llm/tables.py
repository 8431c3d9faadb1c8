"""Small tables with the odd cases: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
BASE = " ".join(f"word{k}" for k in range(120))
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (2, BASE, "en", "a"), (3, None, "en", None), (4, "", "de", "b"),
    (5, " \t\n\r ", None, "b"), (6, LONG, "en", "a"), (7, BASE.replace("word60", "other"), "fr", "c"), (None, BASE, "en", "c"),
    (8, "one", "en", ""), (9, "x" * 300, "en", "a"), (10, "naïve é ß 日本語 \x1c end <|endoftext|> a  b\n\n c", "es", "b"),
    (11, "start " + BASE + " finish", "en", "a"), (2, "same id, other text " + BASE[:200], "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"
CLASHES = ["size", "target", "copies", "part", "print", "key", "block", "h", "t", "i", "_r", "label"]


def documents(spark, rows=ROWS):
    """The rows, with extra columns whose names the operators might use themselves."""
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint"))
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(3)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
