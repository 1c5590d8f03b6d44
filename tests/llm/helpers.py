"""Rows for the tests of the language-model operators."""

import random

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def docs(spark, texts, start=0):
    """Documents with these texts; an item may also be (id, text)."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))
