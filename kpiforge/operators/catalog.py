"""Catalog of stored tables, from what their files say.

Row counts, sizes and times come from a scan of file metadata alone: no
data column is read, so Parquet footers answer it, file by file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "name string, layer string, format string, columns array<string>"


def scan(tables: list[tuple[str, str, DataFrame]], fmt: str = "parquet") -> DataFrame:
    """name, layer, format, columns (sorted), column_count, row_count,
    n_files (with rows), size_bytes and updated_at of each (layer, name,
    table as read from files). A table without rows has no files and a
    null time."""
    spark = tables[0][2].sparkSession
    known = spark.createDataFrame([(n, layer, fmt, sorted(d.columns)) for layer, n, d in tables], SCHEMA)
    files = reduce(DataFrame.unionByName, [
        d.select(F.lit(n).alias("name"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
                 F.col("_metadata.file_modification_time").alias("time")) for _, n, d in tables])
    each = files.groupBy("name", "path").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("time").alias("time"))
    total = each.groupBy("name").agg(F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("size_bytes"),
                                     F.max("time").alias("updated_at"))
    return (known.join(total, "name", "left").na.fill(0, ["row_count", "n_files", "size_bytes"])
            .withColumn("column_count", F.size("columns").cast("long")))


def enriched(entries: DataFrame, contracts: DataFrame) -> DataFrame:
    """Adds source, confidence, parents, tags and description from
    ``contracts`` (name, source, confidence, parents, notes); an entry
    without a contract is of unknown source, confidence 0 and no parents."""
    j = entries.join(contracts, "name", "left")
    source = F.coalesce("source", F.lit("unknown"))
    words = F.filter(F.split("name", "_"), lambda w: w != "")
    return (j.withColumn("source", source).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
            .withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
            .withColumn("description", F.coalesce("notes", F.concat("layer", F.lit(" table of "), F.array_join("columns", ", "))))
            .withColumn("tags", F.array_distinct(F.concat(F.array("layer", "source"), words))).drop("notes"))


def search(catalog: DataFrame, text: str, layer: str | None = None) -> DataFrame:
    """Entries that have ``text`` in name, description or a tag, in any case;
    of one ``layer`` if given."""
    t = F.lit(text.lower())
    hit = F.lower("name").contains(t) | F.lower("description").contains(t) | F.exists("tags", lambda x: F.lower(x).contains(t))
    return catalog.filter(hit if layer is None else hit & (F.col("layer") == layer))


def lineage(catalog: DataFrame) -> DataFrame:
    """name, direction, related, layer and confidence of the related entry:
    the parents that are in the catalog (others are left out), and the
    entries that name it as a parent."""
    edges = catalog.select(F.col("name").alias("child"), F.explode(F.array_distinct("parents")).alias("parent"))
    far = catalog.select(F.col("name").alias("related"), "layer", "confidence")
    up = edges.select(F.col("child").alias("name"), F.lit("upstream").alias("direction"), F.col("parent").alias("related"))
    down = edges.select(F.col("parent").alias("name"), F.lit("downstream").alias("direction"), F.col("child").alias("related"))
    down = down.join(catalog.select("name"), "name", "left_semi")
    return up.unionByName(down).join(far, "related").select("name", "direction", "related", "layer", "confidence")
