"""Small documents with the hard cases: nulls, empty and very long texts, ties, repeated rows, further columns."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
EXTRA = ["n", "h", "host", "TKEY", "bucket_", "length", "count", "row", "key", "node", "root", "rep_", "k_", "bad_", "source_", "shift", "lang_"]


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *("en", "s0")[len(r) - 2 :]) if len(r) < 4 else r
        full.append((doc_id, text, lang, source, None if text is None else len(text)))
    return spark.createDataFrame(full, SCHEMA)


def hard(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "null id text here"), (5, long), (6, "a b c a b c a b c d"), (7, "same text twice\nsame text twice"), (7, "same text twice\nsame text twice"), (8, "no source", None, None), (9, "Ünïcödé — “quotes” 中文 🙂 " * 3)]
    return docs(spark, rows)


def with_extra(df):
    from pyspark.sql import functions as F

    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df
