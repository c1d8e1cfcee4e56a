"""Quality of landed JSON files: every file is a row, readable or not.

Files are listed and read as bytes (``binaryFile``), so one that is no text
or no JSON is judged like any other instead of ending the read. A file is
one row of at most 2 GB (the format's limit); contents are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A source starts at 80; what each fault of a file costs, the
# age in days that is free, the most that age costs, and the least score of
# a source that counts as present.
START, NO_METADATA, NO_DATA, BROKEN, UNREADABLE = 80, 5, 10, 15, 10
FREE_DAYS, MOST_FOR_AGE, PRESENT = 30, 20, 50

_SCALAR = r'^(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|"(?:[^"\\\x00-\x1F]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")$'


def _is_json(text: Column, first: Column) -> Column:
    """Whether ``text`` is one JSON value (what follows a whole object or
    list is not looked at)."""
    bad = F.from_json(text, "_whole string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_whole"})
    items = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    return (F.when(first == "{", bad.isNotNull() & bad["_whole"].isNull())
            .when(first == "[", items.isNotNull()).otherwise(text.rlike(_SCALAR)))


def landed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, time of the last write and content of every file below ``path``.
    A file of no bytes is no row: Spark's file scans pass over it."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
            .select("path", F.col("modificationTime").alias("written_at"), "content"))


def judged(files: DataFrame, as_of: Column) -> DataFrame:
    """One row a file: all columns but ``content``, ``age_days``, ``penalty``
    and ``issues``. Bytes that are no UTF-8 are unreadable; of unreadable and
    broken files nothing else is judged. Lists and single values have no keys
    to look for."""
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), F.regexp_replace(raw, r"\A[ \t\r\n]+|[ \t\r\n]+\z", ""))
    keep = [c for c in files.columns if c != "content"]
    f = files.select(*keep, F.datediff(as_of, "written_at").alias("age_days"), text.alias("_text"))
    first = F.substring("_text", 1, 1)
    f = (f.withColumn("_json", F.coalesce(_is_json(F.col("_text"), first), F.lit(False)))
         .withColumn("_keys", F.when(F.col("_json") & (first == "{"), F.coalesce(F.json_object_keys("_text"), F.array().cast("array<string>")))))
    lacks = lambda *names: F.col("_keys").isNotNull() & ~F.arrays_overlap("_keys", F.array(*[F.lit(n) for n in names]))
    old = F.col("_json") & (F.col("age_days") > FREE_DAYS)
    faults = [
        (F.col("_text").isNull(), F.lit(UNREADABLE), F.lit("unreadable")),
        (F.col("_text").isNotNull() & ~F.col("_json"), F.lit(BROKEN), F.lit("invalid JSON")),
        (lacks("metadata"), F.lit(NO_METADATA), F.lit("no metadata")),
        (lacks("data", "features"), F.lit(NO_DATA), F.lit("no data or features")),
        (old, F.least(F.lit(MOST_FOR_AGE), F.col("age_days") - FREE_DAYS), F.concat(F.col("age_days").cast("string"), F.lit(" days old"))),
    ]
    penalty = sum((F.when(c, p).otherwise(0) for c, p, _ in faults), F.lit(0))
    issues = F.array_compact(F.array(*[F.when(c, t) for c, _, t in faults]))
    return f.select(*keep, "age_days", penalty.cast("long").alias("penalty"), issues.alias("issues"))


def source_quality(files: DataFrame, expected: DataFrame) -> DataFrame:
    """One row a source of ``expected`` (source): status (missing, poor,
    present), file_count, n_faulty, worst_penalty, quality_score (0 to 100).
    ``files`` are judged ones with their ``source``; a source's penalties are
    summed before the shuffle."""
    g = files.groupBy("source").agg(F.count(F.lit(1)).alias("file_count"), F.count_if(F.col("penalty") > 0).alias("n_faulty"),
                                    F.max("penalty").alias("worst_penalty"), F.sum("penalty").alias("_p"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(START) - F.col("_p")))
    none = F.col("file_count").isNull()
    return expected.select("source").distinct().join(g, "source", "left").select(
        "source", F.when(none, "missing").when(score >= PRESENT, "present").otherwise("poor").alias("status"),
        F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("n_faulty", F.lit(0)).alias("n_faulty"),
        F.coalesce("worst_penalty", F.lit(0)).alias("worst_penalty"),
        F.when(none, 0).otherwise(score).cast("long").alias("quality_score"))


def overall(quality: DataFrame) -> DataFrame:
    """Sources with and without files, and the mean score of those with."""
    has = F.col("status") != "missing"
    return quality.agg(F.count_if(has).alias("n_sources"), F.count_if(~has).alias("n_missing"),
                       F.round(F.avg(F.when(has, F.col("quality_score"))), 1).alias("overall_quality_score"))
