"""Monitoring, alerting and incremental-load queries over the event log
(X1–X3, S16, A11, A13, T7, D23, D24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import num
from ..sources.tables import table
from ..streaming.alerts import alert_key, cooldown_batch, run_cooldown_stream
from ..session import scratch_path
from ..streaming.incremental import current_rows, incremental_filter, run_upsert_stream, upsert
from .registry import query

COOLDOWN_S = 3600
MAX_PER_RUN = 200
STREAM_DELAY_S = 86400
SLICES = 4                   # files, and micro-batches, that the event log arrives in


def severity(event_type, value):
    return (F.when((event_type == "error") & (value > 30), "CRITICAL").when(event_type == "error", "ERROR")
            .when(event_type.isin("click", "view"), "WARNING").otherwise("INFO"))


def alerts(df: DataFrame) -> DataFrame:
    """Events seen as alerts: id, key (stage:title:message[:80]), ts, severity."""
    return df.select(F.col("event_id").alias("alert_id"),
                     alert_key(F.col("event_type"), F.lit("event"), F.col("event_type")).alias("key"),
                     "ts", severity(F.col("event_type"), F.col("value")).alias("severity"))


_AL = """al AS (SELECT event_id AS alert_id, event_type || ':event:' || substr(event_type, 1, 80) AS key, ts,
  CASE WHEN event_type = 'error' AND value > 30 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR'
       WHEN event_type IN ('click', 'view') THEN 'WARNING' ELSE 'INFO' END AS severity FROM events)"""
_REC = f"""WITH RECURSIVE {_AL},
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, alert_id) AS rn FROM al),
r AS (SELECT key, rn, alert_id, true AS sent, epoch_us(ts) AS last FROM a WHERE rn = 1
      UNION ALL
      SELECT a.key, a.rn, a.alert_id,
             (a.severity = 'CRITICAL' OR epoch_us(a.ts) - r.last >= {COOLDOWN_S * 1_000_000}) AS sent,
             CASE WHEN a.severity = 'CRITICAL' OR epoch_us(a.ts) - r.last >= {COOLDOWN_S * 1_000_000}
                  THEN epoch_us(a.ts) ELSE r.last END
      FROM r JOIN a ON a.key = r.key AND a.rn = r.rn + 1),
cap AS (SELECT r.alert_id FROM r JOIN al ON al.alert_id = r.alert_id WHERE r.sent ORDER BY al.ts, r.alert_id LIMIT {MAX_PER_RUN})"""


def _alert_cooldown(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events", "event_id", "event_type", "ts", "value")
    return cooldown_batch(alerts(ev), COOLDOWN_S, MAX_PER_RUN)


@query("alert_cooldown", _REC + "\nSELECT al.alert_id, al.key, al.severity, al.alert_id IN (SELECT alert_id FROM cap) AS dispatched FROM al")
def alert_cooldown(spark, sf):
    """X1 batch: per-key cooldown fold, CRITICAL always passes, run cap."""
    return _alert_cooldown(spark, sf).select("alert_id", "key", "severity", "dispatched")


@query("alert_counts", _REC + """, d AS (SELECT al.severity, r.sent, al.alert_id IN (SELECT alert_id FROM cap) AS dispatched FROM al JOIN r ON r.alert_id = al.alert_id)
SELECT severity, count_if(dispatched) AS n_dispatched, count_if(NOT sent) AS n_suppressed, count_if(sent AND NOT dispatched) AS n_over_cap FROM d GROUP BY severity""")
def alert_counts(spark, sf):
    """Dispatched, suppressed (by the cooldown) and over-cap counts by
    severity."""
    a = _alert_cooldown(spark, sf)
    return a.groupBy("severity").agg(F.count_if("dispatched").alias("n_dispatched"),
                                     F.count_if(~F.col("dispatched") & ~F.col("over_cap")).alias("n_suppressed"),
                                     F.count_if("over_cap").alias("n_over_cap"))


def event_stream(spark, sf) -> DataFrame:
    """The event table as a file stream, one file a micro-batch; the table
    may be one file or a folder of part files."""
    ev = table(spark, sf, "events")
    first = ev.select("_metadata.file_name").first()
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
    if first is not None and first[0] == "events.parquet":     # a file stream wants a folder
        return stream.option("pathGlobFilter", "events.parquet").parquet(sf.rstrip("/"))
    return stream.parquet(f"{sf.rstrip('/')}/events.parquet")


def landed_log(spark, sf, *cols: str) -> str:
    """The event log as it arrives: slices of time, one after the other, each
    in any order inside. Returns the folder."""
    ev = table(spark, sf, "events", "event_id", "ts", *cols)
    path = scratch_path(spark, "event-log")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = ev.agg(F.min(t), F.max(t)).first()
    if lo is None:
        ev.write.parquet(path)
        return path
    part = F.least(F.floor((t - lo) * SLICES / F.lit(max(1, hi - lo))), F.lit(SLICES - 1))
    for i in range(SLICES):
        ev.filter(part == i).repartition(F.xxhash64("event_id")).write.mode("append").parquet(path)
    return path


@query("alert_cooldown_stream", _REC + "\nSELECT r.alert_id, al.key, al.severity, r.sent AS dispatched FROM r JOIN al ON al.alert_id = r.alert_id")
def alert_cooldown_stream(spark, sf):
    """X1 streaming: the event log, landed in slices of time with any order
    inside, read file by file and decided by keyed state with event-time
    timers (no run cap: a stream has no run). The delay is a day, so all but
    the log's last day is decided while the stream runs."""
    path = landed_log(spark, sf, "event_type", "value")
    schema = spark.read.parquet(path).schema

    def source():
        return alerts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path))

    return run_cooldown_stream(spark, source, COOLDOWN_S, STREAM_DELAY_S).select("alert_id", "key", "severity", "dispatched")


@query("latest_alerts", f"""WITH {_AL} SELECT alert_id, key, severity FROM al ORDER BY ts DESC, alert_id DESC LIMIT 10""")
def latest_alerts(spark, sf):
    """The ten most recently recorded alerts, dispatched or not
    (distributed top-k)."""
    a = alerts(table(spark, sf, "events", "event_id", "event_type", "ts", "value"))
    return a.orderBy(F.desc("ts"), F.desc("alert_id")).limit(10).select("alert_id", "key", "severity")


@query("metric_rollup", """SELECT event_type AS name, count(*) AS n, min(value) AS min_value, max(value) AS max_value,
  CAST(ROUND(CAST(avg(value) AS DECIMAL(38,6)), 6) AS DOUBLE) AS mean_value, arg_max(value, (ts, event_id)) AS latest_value,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tag_k_sum
FROM events GROUP BY event_type""")
def metric_rollup(spark, sf):
    """Metric points (name, value, ts, tags map from JSON) rolled up
    by name: count, min, max, mean, latest (max_by on time)."""
    ev = table(spark, sf, "events", "event_id", "event_type", "value", "ts", "props")
    m = ev.select(F.col("event_type").alias("name"), "value", "ts", "event_id",
                  F.from_json("props", "map<string,bigint>").alias("tags"))
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"),
                                 F.max("value").alias("max_value"), num(F.avg("value"), 6).alias("mean_value"),
                                 F.max_by("value", F.struct("ts", "event_id")).alias("latest_value"),
                                 F.sum(F.col("tags")["k"]).cast("bigint").alias("tag_k_sum"))


@query("stage_metrics", """WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS run_date, event_type AS stage,
  date_diff('microsecond', min(ts), max(ts)) / 1e6 AS duration_seconds, count(*) AS records,
  count_if(event_type = 'error' AND value > 300) > 0 AS failed FROM events GROUP BY 1, 2)
SELECT run_date, stage, 'duration_seconds' AS metric, CAST(ROUND(CAST(duration_seconds AS DECIMAL(38,6)), 3) AS DOUBLE) AS value, failed FROM s
UNION ALL SELECT run_date, stage, 'records', CAST(records AS DOUBLE), failed FROM s""")
def stage_metrics(spark, sf):
    """Per run (day) and stage: duration and record count as metric
    points (stacked), with a failure flag that raises an alert downstream."""
    ev = table(spark, sf, "events", "event_type", "ts", "value")
    s = ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_date"), F.col("event_type").alias("stage")).agg(
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6)
        .alias("duration_seconds"),
        F.count(F.lit(1)).alias("records"),
        (F.count_if((F.col("event_type") == "error") & (F.col("value") > 300)) > 0).alias("failed"))
    return s.select("run_date", "stage", "failed", F.inline(F.array(
        F.struct(F.lit("duration_seconds").alias("metric"), num("duration_seconds", 3).alias("value")),
        F.struct(F.lit("records").alias("metric"), F.col("records").cast("double").alias("value")))))


# Stage deadlines in minutes (ours, mapped onto the event streams) and the run limit.
DEADLINE_MIN = {"signup": 15, "error": 15, "click": 15, "view": 10, "purchase": 5}
TOTAL_LIMIT_MIN = 60


@query("sla_report", f"""WITH s AS (SELECT strftime(ts, '%Y-%m-%d %H') AS run, event_type AS stage,
   date_diff('microsecond', min(ts), max(ts)) / 6e7 AS elapsed_min FROM events GROUP BY 1, 2),
d AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in DEADLINE_MIN.items())}) AS t(stage, deadline_min)),
per AS (SELECT s.run, s.stage, s.elapsed_min, CAST(d.deadline_min AS DOUBLE) AS deadline_min, s.elapsed_min <= d.deadline_min AS within_sla
        FROM s JOIN d ON d.stage = s.stage)
SELECT run, stage, {"CAST(ROUND(CAST(elapsed_min AS DECIMAL(38,6)), 4) AS DOUBLE)"} AS elapsed_min, deadline_min, within_sla FROM per
UNION ALL
SELECT run, 'TOTAL', CAST(ROUND(CAST(total_min AS DECIMAL(38,6)), 4) AS DOUBLE), {float(TOTAL_LIMIT_MIN)}, ok AND total_min <= {TOTAL_LIMIT_MIN}
FROM (SELECT run, bool_and(within_sla) AS ok FROM per GROUP BY run) JOIN (SELECT strftime(ts, '%Y-%m-%d %H') AS run,
   date_diff('microsecond', min(ts), max(ts)) / 6e7 AS total_min FROM events GROUP BY 1) USING (run)""")
def sla_report(spark, sf):
    """Per run (hour) and stage, elapsed time from the stage's first
    to last event vs its deadline; the run's total duration vs the total
    limit, within SLA only if every stage is too."""
    ev = table(spark, sf, "events", "event_type", "ts")
    dl = spark.createDataFrame([(k, float(v)) for k, v in DEADLINE_MIN.items()], "stage string, deadline_min double")
    ends = (ev.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("run"), F.col("event_type").alias("stage"))
            .agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("a"), F.unix_micros(F.max("ts").cast("timestamp")).alias("b")))
    per = (ends.withColumn("elapsed_min", (F.col("b") - F.col("a")) / 6e7).join(F.broadcast(dl), "stage")
           .withColumn("within_sla", F.col("elapsed_min") <= F.col("deadline_min")))
    total = ends.groupBy("run").agg(((F.max("b") - F.min("a")) / 6e7).alias("total_min"))
    tot = per.groupBy("run").agg(F.bool_and("within_sla").alias("ok")).join(total, "run").select(
        "run", F.lit("TOTAL").alias("stage"), num("total_min", 4).alias("elapsed_min"),
        F.lit(float(TOTAL_LIMIT_MIN)).alias("deadline_min"), (F.col("ok") & (F.col("total_min") <= TOTAL_LIMIT_MIN)).alias("within_sla"))
    return per.select("run", "stage", num("elapsed_min", 4).alias("elapsed_min"), "deadline_min", "within_sla") \
        .unionByName(tot)


# Cache TTL in hours per source (ours) and the forced list.
TTL_HOURS = {"signup": 24, "error": 1, "click": 6, "view": 12, "purchase": 48}
FORCED = ["view"]
RUN_AS_OF = "2024-01-31 00:00:00"


@query("due_sources", f"""SELECT event_type AS source, {"CAST(ROUND(CAST(date_diff('second', max(ts), TIMESTAMP '" + RUN_AS_OF + "') / 3600.0 AS DECIMAL(38,6)), 4) AS DOUBLE)"} AS age_hours,
  CAST(t.ttl AS BIGINT) AS ttl_hours,
  date_diff('second', max(ts), TIMESTAMP '{RUN_AS_OF}') / 3600.0 > t.ttl OR event_type IN ({", ".join(f"'{x}'" for x in FORCED)}) AS due
FROM events JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in TTL_HOURS.items())}) AS t(src, ttl) ON t.src = event_type
GROUP BY event_type, t.ttl""")
def due_sources(spark, sf):
    """A source is due when its last ingest is older than its TTL, or
    when it is forced."""
    ev = table(spark, sf, "events", "event_type", "ts")
    ttl = spark.createDataFrame(list(TTL_HOURS.items()), "source string, ttl_hours bigint")
    last = ev.groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last"))
    age = (F.unix_timestamp(F.lit(RUN_AS_OF).cast("timestamp_ntz")) - F.unix_timestamp("last")) / 3600.0
    j = last.join(F.broadcast(ttl), "source")
    return j.select("source", num(age, 4).alias("age_hours"), "ttl_hours",
                    ((age > F.col("ttl_hours")) | F.col("source").isin(*FORCED)).alias("due"))


PRIOR_LOAD_END = "2024-01-20 00:00:00"


@query("incremental_lookback", f"""SELECT event_id FROM events
WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '{PRIOR_LOAD_END}') - INTERVAL 1 DAY""")
def incremental_lookback(spark, sf):
    """New rows above the target's high-water mark minus a one-day
    lookback (late rows inside the lookback are reprocessed)."""
    ev = table(spark, sf, "events", "event_id", "ts")
    target = ev.filter(F.col("ts") < F.lit(PRIOR_LOAD_END).cast("timestamp_ntz"))
    return incremental_filter(ev, target, "ts", F.expr("INTERVAL 1 DAY")).select("event_id")


NEW_FROM = "2024-01-15 00:00:00"


def _latest_per_user(ev: DataFrame, cols: list[str]) -> DataFrame:
    s = F.struct(*[F.col(c) for c in cols])
    return (ev.groupBy("user_id").agg(F.max_by(s, F.struct("ts", "event_id")).alias("_l"))
            .select("user_id", "_l.*"))


@query("upsert_key", f"""WITH old AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value,
    CAST(NULL AS VARCHAR) AS props FROM events WHERE ts < TIMESTAMP '{PRIOR_LOAD_END}' GROUP BY user_id),
new AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value,
    arg_max(props, (ts, event_id)) AS props FROM events WHERE ts >= TIMESTAMP '{NEW_FROM}' GROUP BY user_id)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)""")
def upsert_key(spark, sf):
    """Incremental model with a unique key — new batch wins, columns
    synced (the old batch has no ``props``). Each batch is reduced to one
    row per key with ``max_by`` first, so the merge window sees ≤ 2 rows
    per key."""
    ev = table(spark, sf, "events", "event_id", "user_id", "event_type", "value", "ts", "props")
    old = _latest_per_user(ev.filter(F.col("ts") < F.lit(PRIOR_LOAD_END).cast("timestamp_ntz")),
                           ["event_type", "value"])
    new = _latest_per_user(ev.filter(F.col("ts") >= F.lit(NEW_FROM).cast("timestamp_ntz")),
                           ["event_type", "value", "props"])
    return upsert(old, new, ["user_id"]).select("user_id", "event_type", "value", "props")


@query("upsert_stream", """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type,
  arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""")
def upsert_stream(spark, sf):
    """X3 + S16 streaming: the event log read as a file stream; the newest
    event of each user is kept by a streaming aggregation, and each
    micro-batch writes the users that have changed."""
    target, checkpoint = scratch_path(spark, "upsert-target"), scratch_path(spark, "upsert-ckpt")
    stream = event_stream(spark, sf).select("user_id", "event_type", "value", "ts", "event_id")
    run_upsert_stream(stream, ["user_id"], ["ts", "event_id"], target, checkpoint)
    schema = stream.schema.add("epoch", "long")
    return current_rows(spark, target, schema, ["user_id"]).select("user_id", "event_type", "value")
