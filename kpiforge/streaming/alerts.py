"""Alert deduplication with a cooldown (X1), batch and streaming.

Rule (per key = stage:title:message[:80], in event-time order): an alert
is dispatched when it is CRITICAL or when at least ``cooldown`` seconds
have passed since the key's last *dispatched* alert; a dispatched alert
stamps the key's clock, a suppressed one does not. At most ``max_per_run``
alerts are dispatched per run (earliest first; a distributed top-k).

A decision depends on all earlier ones of its key, yet no task reads a
whole key. Time is cut into chunks of ``CHUNK`` cooldowns, and only the
first cooldown of a chunk can be reached from outside:

1. every (key, chunk) is read once in time order and yields, for each
   alert that could be the chunk's first dispatch, the last dispatch that
   follows from it (chains that meet are followed as one);
2. these few rows are walked per key and give the clock at the start of
   every chunk;
3. every (key, chunk) is read again in time order with that clock, and
   each alert is decided.

Rows come sorted (and spilled) by Spark, tasks hold one clock or the
alerts of one cooldown, and the work is linear in the alerts.

Streaming: a stateful processor on Spark's state store, see ``Cooldown``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import scratch_path

CHUNK = 64                   # cooldowns in a chunk
ALWAYS = (1 << 63) - 1       # later than any time


def alert_key(stage, title, message):
    return F.concat_ws(":", stage, title, F.substring(message, 1, 80))


class _Chains:
    """Dispatch chains through one chunk, from every alert that can be its
    first dispatch."""

    def __init__(self, first: int, cooldown: int):
        # The clock before is at most the chunk's first alert, so nothing later than this needs it.
        self.reachable, self.cooldown = first + cooldown, cooldown
        self.open = True                                   # may a chain still start here
        self.live: deque[tuple[int, list[int]]] = deque()  # (last dispatch, first dispatches), by last

    def add(self, t: int, critical: bool) -> None:
        met: list[int] = []
        while self.live and (critical or self.live[0][0] <= t - self.cooldown):
            other = self.live.popleft()[1]
            met, other = (met, other) if len(met) >= len(other) else (other, met)
            met.extend(other)
        if self.open and (critical or t >= self.reachable):
            met.append(ALWAYS)       # dispatched whatever came before the chunk
            self.open = False
        elif self.open:
            met.append(t)
        if met:
            self.live.append((t, met))

    def exits(self) -> list[tuple[int, int]]:
        """(first dispatch, last dispatch), neighbours with one last merged."""
        out: list[tuple[int, int]] = []
        for first, last in sorted((f, last) for last, firsts in self.live for f in firsts):
            if out and out[-1][1] == last:
                out[-1] = (first, last)
            else:
                out.append((first, last))
        return out


def _exits(cooldown: int):
    def run(batches):
        at, chains, out = None, None, []

        def done():
            if chains is not None:
                out.extend((*at, first, last) for first, last in chains.exits())

        def send():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["key", "chunk", "first", "last"])

        for b in batches:
            for key, chunk, t, critical in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (key, chunk) != at:
                    done()
                    at, chains = (key, chunk), _Chains(t, cooldown)
                chains.add(t, critical)
            if len(out) > 50_000:
                yield send()
        done()
        if out:
            yield send()
    return run


def _clocks(cooldown: int):
    """Sorted (key, chunk, first, last) to (key, chunk, clock before it)."""
    def run(batches):
        key, clock, at, settled = object(), None, None, False
        for b in batches:
            out = []
            for k, chunk, first, last in zip(*(b.column(i).to_pylist() for i in range(4))):
                if k != key:
                    key, clock, at = k, None, None
                if chunk != at:
                    at, settled = chunk, False
                    out.append((k, chunk, clock))
                if not settled and (clock is None or first == ALWAYS or first >= clock + cooldown):
                    clock, settled = last, True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], names=["key", "chunk", "clock"])
    return run


def _decide(cooldown: int, names: list[str]):
    """Sorted rows with their chunk's clock to rows with ``dispatched``."""
    def run(batches):
        at, clock = None, None
        for b in batches:
            key, chunk, t, critical, before = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_key", "_chunk", "_t", "_crit", "_clock"))
            flags = []
            for i in range(b.num_rows):
                if (key[i], chunk[i]) != at:
                    at, clock = (key[i], chunk[i]), before[i]
                ok = critical[i] or clock is None or t[i] - clock >= cooldown
                if ok:
                    clock = t[i]
                flags.append(ok)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(flags, pa.bool_())], names=[*names, "dispatched"])
    return run


def decide(alerts: DataFrame, cooldown_s: int) -> DataFrame:
    """alerts (alert_id, key, ts, severity, ...) plus ``dispatched``."""
    cooldown = cooldown_s * 1_000_000
    span = max(CHUNK * cooldown, 1_000_000)
    names = alerts.columns
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = alerts.withColumns({"_key": F.col("key"), "_t": t, "_chunk": F.floor(t / F.lit(span)).cast("long"),
                               "_crit": F.coalesce(F.col("severity") == "CRITICAL", F.lit(False))})
    short = rows.select("_key", "_chunk", "_t", "_crit").repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", "_t")
    exits = short.mapInArrow(_exits(cooldown), "key string, chunk long, first long, last long")
    walked = exits.repartition("key").sortWithinPartitions("key", "chunk", "first")
    clock = walked.mapInArrow(_clocks(cooldown), "key string, chunk long, clock long")
    clock = clock.select(F.col("key").alias("_k"), F.col("chunk").alias("_c"), F.col("clock").alias("_clock"))
    joined = rows.join(clock, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_chunk") == F.col("_c")), "left")
    order = joined.repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", "_t", "alert_id")
    schema = T.StructType([*alerts.schema.fields, T.StructField("dispatched", T.BooleanType())])
    return order.select(*names, "_key", "_chunk", "_t", "_crit", "_clock").mapInArrow(_decide(cooldown, names), schema)


def cooldown_batch(alerts: DataFrame, cooldown_s: int, max_per_run: int | None = None) -> DataFrame:
    """alerts (alert_id, key, ts, severity) plus ``dispatched`` and
    ``over_cap`` (passed the cooldown, but beyond the run's cap). Ids are
    unique."""
    out = decide(alerts, cooldown_s)
    if max_per_run is None:
        return out.withColumn("over_cap", F.lit(False))
    first = (out.filter("dispatched").orderBy("ts", "alert_id").limit(max_per_run)   # the cap bounds the broadcast
             .select("alert_id", F.lit(True).alias("_in_cap")))
    out = out.join(F.broadcast(first), "alert_id", "left").withColumn("_in_cap", F.coalesce("_in_cap", F.lit(False)))
    return (out.withColumn("over_cap", F.col("dispatched") & ~F.col("_in_cap"))
            .withColumn("dispatched", F.col("_in_cap")).drop("_in_cap"))


WAITING = "ids array<long>, times array<long>, severities array<string>"
DECIDED = "alert_id long, key string, ts timestamp, severity string, dispatched boolean"


class Cooldown(StatefulProcessor):
    """Keyed state of a stream of alerts: the time of the key's last
    dispatch, and the alerts that wait, by slot of event time. A slot's
    event-time timer goes off when the watermark is past the slot's end:
    its alerts are then complete and are decided in event-time order."""

    def __init__(self, cooldown_s: int, slot_s: int):
        self.cooldown, self.slot = cooldown_s * 1_000_000, slot_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "last long")
        self.waiting = handle.getMapState("waiting", "slot long", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch[~batch["closing"]]
            for slot, some in batch.groupby(batch["t"] // self.slot):
                at = (int(slot),)
                new = [[None if pd.isna(x) else x for x in some[c].tolist()] for c in ("alert_id", "t", "severity")]
                new[0] = [None if x is None else int(x) for x in new[0]]
                if self.waiting.containsKey(at):
                    new = [[*old, *more] for old, more in zip(self.waiting.getValue(at), new)]
                else:
                    self.handle.registerTimer((at[0] + 1) * self.slot // 1000)
                self.waiting.updateValue(at, tuple(new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = (expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.slot - 1,)
        alerts = sorted(zip(*self.waiting.getValue(at)), key=lambda x: (x[1], x[0] is None, x[0]))
        self.waiting.removeKey(at)
        last = self.clock.get()[0] if self.clock.exists() else None
        sent = []
        for _, t, severity in alerts:
            sent.append(severity == "CRITICAL" or last is None or t - last >= self.cooldown)
            if sent[-1]:
                last = t
        self.clock.update((last,))
        ids, times, severities = zip(*alerts)
        yield pd.DataFrame({"alert_id": pd.array(ids, "Int64"), "key": [key[0]] * len(ids), "ts": pd.to_datetime(list(times), unit="us", utc=True), "severity": severities, "dispatched": sent})

    def close(self) -> None:
        pass


def decide_stream(alerts: DataFrame, cooldown_s: int, delay_s: int, slot_s: int = 3600) -> DataFrame:
    """A stream of alerts (alert_id, key, ts, severity, and ``closing``,
    which marks rows that only move the watermark) to decided alerts.

    State is Spark's own (RocksDB state store, checkpointed with the query):
    a restarted query goes on where it was. Alerts may be out of order by
    ``delay_s``; Spark drops later ones and counts them in the progress of
    the query (numRowsDroppedByWatermark). A key's alerts wait for at most
    the delay and one slot."""
    t = F.col("ts").cast("timestamp")
    rows = (alerts.select("alert_id", "key", t.alias("ts"), "severity", "closing", F.unix_micros(t).alias("t"))
            .withWatermark("ts", f"{delay_s} seconds"))
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Cooldown(cooldown_s, slot_s), outputStructType=DECIDED, outputMode="Append", timeMode="EventTime")


class CooldownStream:
    """A cooldown query over a file stream with its checkpoint and its
    output, both folders; ``run`` takes what has come so far. ``close``
    ends a bounded log: one row from a second source moves the watermark
    past everything, so all alerts that still wait are decided."""

    def __init__(self, spark, source, cooldown_s: int, delay_s: int):
        self.spark, self.source, self.cooldown_s, self.delay_s = spark, source, cooldown_s, delay_s
        self.out, self.checkpoint, self.ends = (scratch_path(spark, f"alert-{x}") for x in ("decided", "checkpoint", "ends"))
        self._end(None)

    def _end(self, ts: str | None) -> None:
        row = self.spark.range(1).select(F.lit(ts).cast("timestamp").alias("ts"))
        row.filter(F.col("ts").isNotNull()).write.mode("append").parquet(self.ends)

    def run(self) -> None:
        spark = self.spark
        ends = spark.readStream.schema("ts timestamp").parquet(self.ends)
        ends = ends.select(F.lit(None).cast("long").alias("alert_id"), F.lit(None).cast("string").alias("key"), "ts", F.lit(None).cast("string").alias("severity"), F.lit(True).alias("closing"))
        rows = self.source().select("alert_id", "key", F.col("ts").cast("timestamp").alias("ts"), "severity", F.lit(False).alias("closing"))
        decided = decide_stream(rows.unionByName(ends), self.cooldown_s, self.delay_s)
        provider = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(provider)
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")   # timers need it
        try:
            query = decided.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            spark.conf.set(provider, before)

    def close(self) -> None:
        self._end("2200-01-01 00:00:00")      # pandas ends in 2262
        self.run()

    def result(self) -> DataFrame:
        """All alerts decided so far."""
        return self.spark.read.schema(DECIDED).parquet(self.out)


def run_cooldown_stream(spark, source, cooldown_s: int, delay_s: int = 0) -> DataFrame:
    """Runs a bounded stream of alerts to its end; ``source()`` makes it
    (alert_id, key, ts, severity). All alerts with ``dispatched``."""
    stream = CooldownStream(spark, source, cooldown_s, delay_s)
    stream.run()
    stream.close()
    return stream.result()
