"""Quality of landed files (D18): one JSON file a source and day, judged as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.landing import judged, landed, overall, source_quality
from ..session import scratch_path
from ..sources.tables import table
from .registry import query

NEVER_LANDED = "sensor"          # expected, but the log has nothing of it
# Faults by (day of the month + 3 * letters of the source) % 40.
CUT, NO_META, NO_DATA, NOT_TEXT = 3, 11, 19, 27


def land(spark, sf) -> str:
    """Writes each source's days as a JSON file of at most 24 hourly counts,
    some with a fault; gives their folder."""
    ev = table(spark, sf, "events", "event_type", "ts").filter("event_type IS NOT NULL AND ts IS NOT NULL")
    hours = ev.groupBy("event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    days = hours.groupBy("event_type", "day").agg(F.array_sort(F.collect_list(F.struct("hour", "n"))).alias("hours"))
    fault = (F.dayofmonth("day") + 3 * F.length("event_type")) % 40
    meta = F.struct(F.col("event_type").alias("source"), F.col("day").cast("string").alias("day"))
    body = (F.when(fault == NO_META, F.to_json(F.struct(F.col("hours").alias("data"))))
            .when(fault == NO_DATA, F.to_json(F.struct(meta.alias("metadata"), F.col("hours").alias("rows"))))
            .otherwise(F.to_json(F.struct(meta.alias("metadata"), F.col("hours").alias("data")))))
    body = (F.when(fault == CUT, F.substring(body, 1, 40))
            .when(fault == NOT_TEXT, F.concat(F.lit(b"\xff\xfe").cast("string"), body)).otherwise(body))
    path = scratch_path(spark, "landed_files")
    days.select(F.col("event_type").alias("source"), F.col("day").cast("string").alias("file"), body.alias("value")) \
        .write.partitionBy("source", "file").text(path)
    return path


def landed_quality(spark, sf):
    files = landed(spark, land(spark, sf), "*.txt").withColumn("source", F.regexp_extract("path", "/source=([^/]+)/", 1))
    known = table(spark, sf, "events", "event_type").filter("event_type IS NOT NULL").select(F.col("event_type").alias("source"))
    expected = known.distinct().unionByName(spark.range(1).select(F.lit(NEVER_LANDED).alias("source")))
    return source_quality(judged(files, F.current_timestamp()), expected)


_SQL = f"""WITH f AS (SELECT DISTINCT event_type AS source, CAST(ts AS DATE) AS day FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT source, CASE (day(day) + 3 * length(source)) % 40 WHEN {CUT} THEN 15 WHEN {NO_META} THEN 5 WHEN {NO_DATA} THEN 10 WHEN {NOT_TEXT} THEN 10 ELSE 0 END AS pen FROM f),
s AS (SELECT source, count(*) AS file_count, count_if(pen > 0) AS n_faulty, max(pen) AS worst_penalty, greatest(0, 80 - sum(pen)) AS quality_score FROM p GROUP BY source),
q AS (SELECT source, CASE WHEN quality_score >= 50 THEN 'present' ELSE 'poor' END AS status, file_count, CAST(n_faulty AS BIGINT) AS n_faulty,
  CAST(worst_penalty AS BIGINT) AS worst_penalty, CAST(quality_score AS BIGINT) AS quality_score FROM s
  UNION ALL SELECT '{NEVER_LANDED}', 'missing', 0, 0, 0, 0)
"""


@query("landed_file_quality", _SQL + "SELECT * FROM q")
def landed_file_quality(spark, sf):
    """Every landed file judged, summed by source."""
    return landed_quality(spark, sf)


@query("landed_overall", _SQL + """SELECT count_if(status <> 'missing') AS n_sources, count_if(status = 'missing') AS n_missing,
  round(avg(quality_score) FILTER (status <> 'missing'), 1) AS overall_quality_score FROM q""")
def landed_overall(spark, sf):
    """The report's summary over all sources."""
    return overall(landed_quality(spark, sf))
