"""Record schemas over landed records (D11): every row of six tables lands
as one JSON record of a source, and is read back and validated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import summary, union, validate
from ..session import scratch_path
from ..sources.tables import table
from .registry import query

# source: (table, id, fields as Spark SQL). Fields go beyond the schemas' bounds here and there.
RECORDS = {
    "world_bank": ("orders", "o_orderkey", {"year": "1950 + o_custkey % 90", "value": "IF(o_orderstatus = 'P', 'n/a', CAST(o_totalprice AS STRING))", "indicator": "o_orderpriority"}),
    "rbnz": ("events", "event_id", {"date": "CASE event_type WHEN 'error' THEN '13/2024' WHEN 'view' THEN '2024-02-31' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END", "value": "IF(value < 1, NULL, value)"}),
    "stats_nz": ("customer", "c_custkey", {"region": "IF(c_custkey % 11 = 0, '', c_mktsegment)", "year": "1985 + c_custkey % 50", "population": "c_custkey"}),
    "mbie_tourism": ("supplier", "s_suppkey", {"region": "s_name", "year": "2000 + s_suppkey % 40", "visitors": "s_acctbal"}),
    "linz": ("part", "p_partkey", {"region": "p_brand", "year": "IF(p_partkey % 7 = 0, NULL, 1980 + p_size)", "property_count": "p_partkey", "median_price": "p_retailprice"}),
    "reinz": ("lineitem", "l_orderkey * 10 + l_linenumber", {"region": "l_returnflag", "year": "year(l_shipdate)", "month": "month(l_shipdate) + IF(l_linenumber = 7, 6, 0)", "median_price": "l_extendedprice"}),
}


def landed_records(spark, sf) -> DataFrame:
    """(source, id, payload): the records as they lie in the shared folder."""
    path = scratch_path(spark, "bronze-records")
    frames = []
    for source, (name, key, fields) in RECORDS.items():
        record = F.to_json(F.struct(*[F.expr(e).alias(f) for f, e in fields.items()]))
        frames.append(table(spark, sf, name).select(F.lit(source).alias("source"), F.expr(key).cast("long").alias("id"), record.alias("payload")))
    rows = union(frames)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


_SQL = """
WITH y AS (
  SELECT 'world_bank' AS source, o_orderkey AS id, concat_ws('; ', CASE WHEN 1950 + o_custkey % 90 < 1960 THEN 'year: below 1960' WHEN 1950 + o_custkey % 90 > 2030 THEN 'year: above 2030' END,
    CASE WHEN o_orderstatus = 'P' THEN 'value: not a number' WHEN o_totalprice IS NULL THEN 'value: required' END) AS e FROM orders
  UNION ALL
  SELECT 'rbnz', event_id, concat_ws('; ', CASE WHEN event_type IN ('error', 'view') THEN 'date: not a date' WHEN ts IS NULL THEN 'date: required' END,
    CASE WHEN value IS NULL OR value < 1 THEN 'value: required' END) FROM events
  UNION ALL
  SELECT 'stats_nz', c_custkey, concat_ws('; ', CASE WHEN c_custkey % 11 = 0 OR c_mktsegment = '' THEN 'region: too short' WHEN c_mktsegment IS NULL THEN 'region: required' END,
    CASE WHEN c_custkey % 50 < 5 THEN 'year: below 1990' WHEN c_custkey % 50 > 45 THEN 'year: above 2030' END) FROM customer
  UNION ALL
  SELECT 'mbie_tourism', s_suppkey, concat_ws('; ', CASE WHEN s_name IS NULL THEN 'region: required' WHEN s_name = '' THEN 'region: too short' END,
    CASE WHEN s_suppkey % 40 > 30 THEN 'year: above 2030' END, CASE WHEN s_acctbal <> floor(s_acctbal) THEN 'visitors: not a whole number' END) FROM supplier
  UNION ALL
  SELECT 'linz', p_partkey, concat_ws('; ', CASE WHEN p_brand IS NULL THEN 'region: required' WHEN p_brand = '' THEN 'region: too short' END,
    CASE WHEN p_partkey % 7 = 0 OR p_size IS NULL THEN 'year: required' WHEN p_size < 10 THEN 'year: below 1990' WHEN p_size > 50 THEN 'year: above 2030' END) FROM part
  UNION ALL
  SELECT 'reinz', l_orderkey * 10 + l_linenumber, concat_ws('; ', CASE WHEN l_returnflag IS NULL THEN 'region: required' WHEN l_returnflag = '' THEN 'region: too short' END,
    CASE WHEN l_shipdate IS NULL THEN 'year: required' WHEN year(l_shipdate) < 1990 THEN 'year: below 1990' WHEN year(l_shipdate) > 2030 THEN 'year: above 2030' END,
    CASE WHEN l_linenumber = 7 AND month(l_shipdate) > 6 THEN 'month: above 12' END) FROM lineitem),
r AS (SELECT source, e, 'Record ' || CAST(id AS VARCHAR) || ': ' || e AS message, row_number() OVER (PARTITION BY source, e = '' ORDER BY id, 'Record ' || CAST(id AS VARCHAR) || ': ' || e) AS place FROM y)
"""


@query("record_schemas", _SQL + """SELECT source, count(*) FILTER (e <> '') = 0 AS valid, count(*) FILTER (e = '') AS valid_count, count(*) FILTER (e <> '') AS invalid_count,
  coalesce(list(message ORDER BY place) FILTER (e <> '' AND place <= 10), []) AS errors FROM r GROUP BY source""")
def record_schemas(spark, sf):
    """The six record schemas over landed records: counts of valid and
    invalid records of each source and its first ten errors."""
    path = scratch_path(spark, "checked-records")
    checked = validate(landed_records(spark, sf)).drop("payload")
    checked.write.parquet(path)         # counts and first errors both read it: records are parsed once
    return summary(spark.read.schema(checked.schema).parquet(path))


@query("record_errors", _SQL + "SELECT source, e AS error, count(*) AS n FROM (SELECT source, unnest(string_split(e, '; ')) AS e FROM r WHERE e <> '') GROUP BY source, e")
def record_errors(spark, sf):
    """How often each error occurs, by source."""
    return validate(landed_records(spark, sf)).select("source", F.explode("errors").alias("error")).groupBy("source", "error").agg(F.count("*").alias("n"))
