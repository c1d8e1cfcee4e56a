"""Incremental loads (P16/X3) and keyed upserts (S16), batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def incremental_filter(source: DataFrame, target: DataFrame | None, col: str, lookback) -> DataFrame:
    """Rows of ``source`` newer than max(target.col) − lookback; an empty
    or missing target means no filter. ``lookback`` is a Column interval or
    a number for numeric columns. The high-water mark is a scalar subquery."""
    if target is None:
        return source
    hwm = target.select(F.max(col)).scalar()
    return source.filter(F.coalesce(F.col(col) > hwm - lookback, F.lit(True)))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order_col: str | None = None) -> DataFrame:
    """Keyed upsert with schema sync: the union of both (missing columns
    filled with NULL), newest batch wins per key (then ``order_col``)."""
    u = (old.withColumn("_batch", F.lit(0))
         .unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True))
    order = [F.desc("_batch")] + ([F.desc(order_col)] if order_col else [])
    w = Window.partitionBy(*key).orderBy(*order)
    return u.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_batch")


def latest_stream(stream: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key (greatest ``order`` columns), as Spark's
    streaming aggregation keeps it in the state store. In update mode every
    micro-batch yields the keys that have changed."""
    row = F.struct(*[c for c in stream.columns if c not in key])
    return stream.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(*key, "_row.*")


def run_upsert_stream(stream: DataFrame, key: list[str], order: list[str], target: str, checkpoint: str) -> None:
    """Runs the stream over what has come so far. Each epoch's changed keys
    are one partition of ``target``, overwritten when an epoch is repeated
    (dynamic partition overwrite), so every change is there once."""
    def put(batch: DataFrame, epoch: int) -> None:
        (batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(target))

    query = (latest_stream(stream, key, order).writeStream.outputMode("update").foreachBatch(put)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def current_rows(spark, target: str, schema, key: list[str]) -> DataFrame:
    """The upserted table: of each key the row of its last epoch."""
    rows = spark.read.schema(schema).parquet(target)
    last = F.struct(*[c for c in rows.columns if c not in (*key, "epoch")])
    return rows.groupBy(*key).agg(F.max_by(last, "epoch").alias("_row")).select(*key, "_row.*")
