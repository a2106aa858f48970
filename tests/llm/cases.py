"""Rows that every operator must take: nulls, empty, long, tied and repeated
ones, and columns whose names clash with those of results."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["row", "kept", "score", "spans", "ids", "n_words", "component_id", "shard_id", "verdict", "_text", "a.b",
           "fingerprint", "key", "rank", "lang_pred"]

LONG = "wort " * 30_000 + "x" * 50_000


def edge_rows():
    rows = [(1, "", "en", "s"), (2, None, "en", "s"), (3, " \n\t ", None, None), (4, "solo", "de", None),
            (5, LONG, "en", "s"), (6, "Ünïcode 日本語 текст 😀 \x00 é", "fr", "t"), (None, "no id here at all", "en", "s"),
            (None, None, None, None), (7, "same same words over and over again", "en", "s"),
            (7, "same same words over and over again", "en", "s"), (8, "same same words over and over again", "en", "t"),
            (9, "1234 !!! ... ###", "en", "s")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def edge_docs(spark, extra=True):
    df = spark.createDataFrame(edge_rows(), DOCS)
    for c in CLASHES if extra else []:
        df = df.withColumn(c, F.lit("clash"))
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def some_docs(spark, n=200):
    """The first documents of the smallest table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n)
