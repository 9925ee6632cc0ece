"""Small tables with every awkward row: nulls, blanks, ties, repeats, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def table(spark, rows, extra=()):
    """Documents from (doc_id, text[, lang, source]); ``extra`` adds columns named like an operator's own."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"'x' as {name}")
    return df


def prose(n, seed=0, words=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))
