"""Small tables for the operators' tests."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: Extra columns whose names the operators use inside.
CLASH = ["row", "key", "n", "grp", "h", "token", "words", "count", "digest", "spans", "doc", "length", "label", "score"]

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in CLASH]])


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = []
    for r in rows:
        d, t, lang, source = (*r, "en", "src0")[:4] if len(r) == 2 else r
        full.append((d, t, lang, source, len(t) if t is not None else None, *["x"] * len(CLASH)))
    return spark.createDataFrame(full, SCHEMA)


LONG = " ".join(f"word{i % 977} other{i % 313}" for i in range(20_000))
EDGE = [(1, "the quick brown fox jumps over the lazy dog and then some more words follow here."),
        (2, None), (3, ""), (None, "a text without an id that has quite a few words in it to be scored"), (None, None),
        (5, " \t\n "), (6, LONG), (7, "tie tie tie tie tie"), (8, "tie tie tie tie tie"),
        (9, "repeated row"), (9, "repeated row"), (9, "same id but another text"),
        (10, "ümläut 漢字 😀 ñandú", None, None), (11, "x", "de", None)]


def edge(spark):
    return documents(spark, EDGE)


def empty(spark):
    return documents(spark, [])


def python_nodes(df):
    """Python, pandas or Arrow operators in the plan that ran."""
    import re

    return re.findall(r"\w*(?:Python|Pandas|Arrow)\w*", df._jdf.queryExecution().optimizedPlan().toString())
