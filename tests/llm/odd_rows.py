"""Small documents with every odd case, and tables with clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 900} and{i % 7}" for i in range(6000))
ROWS = [
    (1, "Hello world, this is a text.\nHello world, this is a text.\nIt goes on and on.", "en", "a", 1),
    (2, None, "en", "a", 0),
    (3, "", None, None, 0),
    (4, " \t\n ", "de", "b", 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, LONG + " ", "en", None, len(LONG)),
    (7, "Hello world, this  is a text. Hello world, this is a text. It goes on and on.", "en", "c", 1),
    (7, "Hello world, this  is a text. Hello world, this is a text. It goes on and on.", "en", "c", 1),
    (None, "no id here but enough words to count as a text of its own kind", "en", "b", None),
    (9, "éèüß 𝒳𝒴 " * 40, "fr", "b", 3),
    (10, "x", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["key", "size", "fp", "rid", "anchor", "norm", "recipe", "base", "target", "taken", "first", "kept", "score", "n", "node", "root", "label", "hex", "spans", "words", "__text", "__kept", "__size", "__taken", "__id", "__own", "__place", "c0", "c1", "k_id", "row", "a.b", "with space"]


def table(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING)) if extra else df
