"""Health of the layers and the report over their contracts.

Both work on small tables that Spark derives first: ``assets`` (layer,
asset, n_rows, latest) and ``contracts`` (layer, artifact, source, quality,
confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layer_health(assets: DataFrame, contracts: DataFrame, layers: list[str]) -> DataFrame:
    """One row for each of ``layers``: missing (no asset), empty (no rows),
    warning (rows but no contract), else healthy; and one row ``overall``:
    critical (no rows anywhere), degraded (a layer is not healthy), else
    healthy."""
    spark = assets.sparkSession
    a = assets.groupBy("layer").agg(F.count_if(F.col("n_rows") > 0).alias("n_assets"), F.sum("n_rows").alias("n_rows"),
                                    F.max(F.when(F.col("n_rows") > 0, F.col("latest"))).alias("latest"))
    c = contracts.groupBy("layer").agg(F.count(F.lit(1)).alias("n_contracts"))
    known = spark.createDataFrame([(x,) for x in layers], "layer string")
    j = known.join(a, "layer", "left").join(c, "layer", "left").na.fill(0, ["n_contracts"])
    j = j.withColumn("status", F.when(F.col("n_rows").isNull(), "missing").when(F.col("n_rows") == 0, "empty")
                     .when(F.col("n_contracts") == 0, "warning").otherwise("healthy")).na.fill(0, ["n_assets", "n_rows"])
    every = j.agg(F.lit("overall").alias("layer"),
                  F.when(F.sum("n_rows") == 0, "critical").when(F.bool_and(F.col("status") == "healthy"), "healthy")
                  .otherwise("degraded").alias("status"),
                  F.sum("n_assets").alias("n_assets"), F.sum("n_contracts").alias("n_contracts"),
                  F.sum("n_rows").alias("n_rows"), F.max("latest").alias("latest"))
    return j.select(*every.columns).unionByName(every)


def contract_report(contracts: DataFrame) -> DataFrame:
    """Grouping sets over (layer, source, quality): totals of all layers, of
    each layer, and of each source and quality class in a layer. ``part``
    names what a row counts. No contracts give no rows."""
    g = contracts.groupingSets([[], ["layer"], ["layer", "source"], ["layer", "quality"]], "layer", "source", "quality").agg(
        F.count(F.lit(1)).alias("n_artifacts"), F.avg("confidence").alias("avg"), F.grouping_id().alias("gid"))
    part = F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, "layer").when(F.col("gid") == 1, "source").otherwise("quality")
    return g.select(part.alias("part"), "layer", "source", "quality", "n_artifacts", "avg")
