"""Bronze, silver and gold judged alike.

Bronze assets are the landed event streams (one asset a type, one
validation run a month of landing); silver assets the feature tables; gold
assets the dashboards of the KPI table. Each suite file is one grouped
aggregate over its layer.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import num
from ..operators.expectations import load_suite, run_suite
from ..operators.health import contract_report, layer_health
from ..oracle.gold import with_kpis
from ..oracle.silver import N
from ..sources.tables import table
from .features import silver
from .q_display import kpis
from .q_quality import ARTIFACTS, BRONZE_SOURCE, CONTRACT_CTE, bronze_contract, contract_scores_df
from .registry import query
from .store import materialized

SUITES = Path(__file__).parent.parent / "suites"
LAYERS = ["bronze", "silver", "gold"]
# Provider of each landed event stream (ours); other types have none that is known.
PROVIDER = {"purchase": "Stats NZ", "signup": "MBIE tourism", "view": "World Bank"}


def bronze_rows(spark, sf) -> DataFrame:
    """Landed records: asset, month, metadata, source, date_fetched, ts."""
    source = F.col("event_type")
    for k, v in PROVIDER.items():
        source = F.when(F.col("event_type") == k, v).otherwise(source)
    return table(spark, sf, "events", "event_type", "ts", "props").select(
        F.col("event_type").alias("asset"), F.date_format("ts", "yyyy-MM").alias("month"), F.col("props").alias("metadata"),
        source.alias("source"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date_fetched"), "ts")


def gold_rows(spark, sf) -> DataFrame:
    return kpis(spark, sf).select(F.concat(F.lit("gold_"), "dashboard").alias("asset"), F.col("kpi_name").alias("name"),
                                  F.col("kpi_value").alias("value"), "unit", "category")


def build_results(spark, sf) -> DataFrame:
    """layer, suite, asset, run_at, idx, expectation_type, column, success,
    observed. Silver and gold are validated when the last record landed."""
    parts = []
    for name in ("bronze_raw_data", "bronze_data_freshness"):
        r = run_suite(bronze_rows(spark, sf), load_suite(SUITES / f"{name}.json"), ("asset", "month"), [F.max("ts").alias("run_at")])
        parts.append(r.drop("month").withColumns({"layer": F.lit("bronze"), "suite": F.lit(name)}))
    last = table(spark, sf, "events", "ts").agg(F.max("ts").alias("run_at"))
    frames = {a: silver(spark, sf, a) for a in ARTIFACTS}
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(a).alias("asset"), "year", "region") for a, d in frames.items()])
    gold = gold_rows(spark, sf)
    for layer, name, df, schemas in (("silver", "silver_features", rows, {a: d.schema for a, d in frames.items()}), ("gold", "gold_kpis", gold, None)):
        r = run_suite(df, load_suite(SUITES / f"{name}.json"), ("asset",), schemas=schemas)
        parts.append(r.crossJoin(F.broadcast(last)).withColumns({"layer": F.lit(layer), "suite": F.lit(name)}))   # one row
    return reduce(DataFrame.unionByName, parts).select("layer", "suite", "asset", "run_at", "idx", "expectation_type", "column", "success", "observed")


def results(spark, sf) -> DataFrame:
    return materialized(spark, sf, "layer_results", build_results)


def _sql() -> str:
    bronze = f"""br AS (SELECT event_type AS asset, date_trunc('month', ts) AS month, props AS metadata, ts,
  CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PROVIDER.items())} ELSE event_type END AS source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS date_fetched FROM events)"""
    group = "FROM br GROUP BY asset, month"
    regex = "^(World Bank|RBNZ|Stats NZ|MBIE|LINZ|REINZ|Tenancy Services)"
    out = []

    def add(layer, suite, idx, kind, column, ok, observed, source, run="max(ts)", asset="asset"):
        out.append(f"SELECT '{layer}' AS layer, '{suite}' AS suite, {asset} AS asset, {run} AS run_at, {idx} AS idx, '{kind}' AS expectation_type, {column} AS \"column\", "
                   f"{ok} AS success, CAST({observed} AS DOUBLE) AS observed {source}")
    for suite in ("bronze_raw_data", "bronze_data_freshness"):
        add("bronze", suite, 0, "expect_table_row_count_to_be_between", "NULL", "count(*) >= 1", "count(*)", group)
    add("bronze", "bronze_raw_data", 1, "expect_table_columns_to_match_set", "NULL", "bool_and(list_has_all(json_keys(to_json(br)), ['metadata']))", "NULL", group)
    add("bronze", "bronze_raw_data", 2, "expect_column_values_to_not_be_null", "'metadata'", "count(metadata) = count(*)", "count(metadata) / count(*)", group)
    add("bronze", "bronze_data_freshness", 1, "expect_column_values_to_be_of_type", "'date_fetched'", "bool_and(typeof(date_fetched) = 'VARCHAR')", "NULL", group)
    add("bronze", "bronze_data_freshness", 2, "expect_column_values_to_match_regex", "'source'", f"count_if(NOT regexp_matches(source, '{regex}')) = 0", f"count_if(NOT regexp_matches(source, '{regex}'))", group)
    last = "(SELECT max(ts) FROM events)"
    for a, (_, view) in ARTIFACTS.items():
        put = lambda *x: add("silver", "silver_features", *x, f"FROM {view} v", last, f"'{a}'")  # noqa: E731, B023
        put(0, "expect_table_row_count_to_be_between", "NULL", "count(*) >= 1", "count(*)")
        put(1, "expect_table_columns_to_match_set", "NULL", "bool_and(list_has_all(json_keys(to_json(v)), ['year', 'region']))", "NULL")
        put(2, "expect_column_values_to_not_be_null", "'year'", "count(year) = count(*)", "count(year) / count(*)")
        put(3, "expect_column_values_to_be_between", "'year'", "count_if(year < 1970 OR year > 2030) = 0", "count_if(year < 1970 OR year > 2030)")
        put(4, "expect_column_values_to_not_be_null", "'region'", "count(region) = count(*)", "count(region) / count(*)")
    put = lambda *x: add("gold", "gold_kpis", *x, "FROM gr GROUP BY asset", last)
    put(0, "expect_table_row_count_to_be_between", "NULL", "count(*) >= 1", "count(*)")
    put(1, "expect_table_columns_to_match_set", "NULL", "bool_and(list_has_all(json_keys(to_json(gr)), ['name', 'value', 'unit', 'category']))", "NULL")
    put(2, "expect_column_values_to_not_be_null", "'name'", "count(name) = count(*)", "count(name) / count(*)")
    put(3, "expect_column_values_to_not_be_null", "'value'", "count(value) / count(*) >= 0.5", "count(value) / count(*)")
    put(4, "expect_column_values_to_be_of_type", "'value'", "bool_and(typeof(value) = 'DOUBLE')", "NULL")
    put(5, "expect_column_max_to_be_between", "'value'", "coalesce(max(value) BETWEEN -1000000 AND 1000000000, true)", "max(value)")
    return (f", {bronze},\ngr AS (SELECT 'gold_' || dashboard AS asset, kpi_name AS name, kpi_value AS value, unit, category FROM kpis),\nvr AS ("
            + "\nUNION ALL ".join(out) + ")\n")


@query("layer_suites", with_kpis(_sql() + "SELECT * FROM vr"))
def layer_suites(spark, sf):
    """The suite files over every asset of the three layers."""
    return results(spark, sf)


@query("layer_rollup", with_kpis(_sql() + """SELECT coalesce(layer, 'ALL') AS layer, count(DISTINCT asset) AS n_assets, count(*) AS total, count_if(success) AS passed,
  count_if(NOT success) AS failed, """ + N("count_if(success) * 100.0 / count(*)", 2) + """ AS success_rate, bool_and(success) AS all_passed, max(run_at) AS latest_run
FROM vr GROUP BY ROLLUP (layer)"""))
def layer_rollup(spark, sf):
    """Totals, passes and the latest run of each layer and overall."""
    g = results(spark, sf).rollup("layer").agg(
        F.count_distinct("asset").alias("n_assets"), F.count(F.lit(1)).alias("total"), F.count_if("success").alias("passed"),
        F.count_if(~F.col("success")).alias("failed"), num(F.count_if("success") * 100.0 / F.count(F.lit(1)), 2).alias("success_rate"),
        F.bool_and("success").alias("all_passed"), F.max("run_at").alias("latest_run"))
    return g.withColumn("layer", F.coalesce("layer", F.lit("ALL")))


def _quality(c, source):
    return (F.when((c >= 85) & (source == "real"), "excellent").when((c >= 70) & source.isin("real", "proxy"), "good")
            .when(c >= 50, "fair").when(c >= 25, "poor").otherwise("unknown"))


def contracts(spark, sf) -> DataFrame:
    """layer, artifact, source, quality, confidence of every artifact. A
    dashboard's confidence is 100 less its share of empty values; it is
    synthetic if one of its sources is, a proxy if one is or is estimated."""
    b = bronze_contract(spark, sf)
    s = contract_scores_df(spark, sf)
    has = lambda t: F.bool_or(F.col("source").contains(t))
    g = kpis(spark, sf).groupBy("dashboard").agg(
        F.when(has("Synthetic"), "synthetic").when(has("Proxy") | has("Estimated"), "proxy").otherwise("real").alias("source"),
        num(F.count("kpi_value") * 100.0 / F.count(F.lit(1)), 4).alias("confidence"))
    return (b.select(F.lit("bronze").alias("layer"), "artifact", "source", _quality(F.col("confidence"), F.col("source")).alias("quality"), "confidence")
            .unionByName(s.select(F.lit("silver").alias("layer"), "artifact", "source", "quality", "confidence"))
            .unionByName(g.select(F.lit("gold").alias("layer"), F.concat(F.lit("gold_"), "dashboard").alias("artifact"), "source",
                                  _quality(F.col("confidence"), F.col("source")).alias("quality"), "confidence")))


_CLASS = """CASE WHEN confidence >= 85 AND source = 'real' THEN 'excellent' WHEN confidence >= 70 AND source IN ('real', 'proxy') THEN 'good'
  WHEN confidence >= 50 THEN 'fair' WHEN confidence >= 25 THEN 'poor' ELSE 'unknown' END"""
_CONTRACTS = CONTRACT_CTE + f""", bst AS (SELECT event_type AS artifact, count(*) AS n,
  (count_if(ts IS NULL) + count_if(user_id IS NULL) + count_if(value IS NULL) + count_if(props IS NULL)) * 100.0 / (count(*) * 4) AS np,
  CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BRONZE_SOURCE.items())} ELSE 'unknown' END AS source FROM events GROUP BY event_type),
bsc AS (SELECT *, LEAST(100.0, CASE source WHEN 'real' THEN 50.0 WHEN 'fallback' THEN 10.0 ELSE 15.0 END
    + CASE WHEN np < 5 THEN 30 WHEN np < 15 THEN 20 WHEN np < 30 THEN 10 ELSE 0 END
    + CASE WHEN n >= 100 THEN 5 WHEN n >= 50 THEN 3 WHEN n >= 20 THEN 1 ELSE 0 END) AS score FROM bst),
bco AS (SELECT artifact, source, CAST(CASE source WHEN 'real' THEN LEAST(100.0, score + 20) WHEN 'fallback' THEN GREATEST(10.0, score - 30) ELSE score END AS DOUBLE) AS confidence FROM bsc),
gco AS (SELECT 'gold_' || dashboard AS artifact, CASE WHEN bool_or(contains(source, 'Synthetic')) THEN 'synthetic'
    WHEN bool_or(contains(source, 'Proxy') OR contains(source, 'Estimated')) THEN 'proxy' ELSE 'real' END AS source,
  {N('count(kpi_value) * 100.0 / count(*)', 4)} AS confidence FROM kpis GROUP BY dashboard),
con AS (SELECT 'bronze' AS layer, artifact, source, {_CLASS} AS quality, confidence FROM bco
  UNION ALL SELECT 'silver', artifact, source, quality, confidence FROM contract_scores
  UNION ALL SELECT 'gold', artifact, source, {_CLASS}, confidence FROM gco)
"""


@query("layer_report", with_kpis(_CONTRACTS + f"""SELECT CASE grouping(layer, source, quality) WHEN 7 THEN 'all' WHEN 3 THEN 'layer' WHEN 1 THEN 'source' ELSE 'quality' END AS part,
  layer, source, quality, count(*) AS n_artifacts, {N('avg(confidence)', 2)} AS avg_confidence
FROM con GROUP BY GROUPING SETS ((), (layer), (layer, source), (layer, quality))"""))
def layer_report(spark, sf):
    """Artifacts and mean confidence over all layers, by layer, and by
    source and quality class in a layer."""
    return contract_report(contracts(spark, sf)).select("part", "layer", "source", "quality", "n_artifacts", num("avg", 2).alias("avg_confidence"))


@query("layer_health", with_kpis(_CONTRACTS + ", ass AS (SELECT 'bronze' AS layer, event_type AS asset, count(*) AS n FROM events GROUP BY event_type"
                                 + "".join(f" UNION ALL SELECT 'silver', '{a}', count(*) FROM {v}" for a, (_, v) in ARTIFACTS.items())
                                 + """ UNION ALL SELECT 'gold', dashboard, count(*) FROM kpis GROUP BY dashboard),
lay AS (SELECT l.layer, coalesce(a.n_assets, 0) AS n_assets, coalesce(c.n, 0) AS n_contracts, coalesce(a.n, 0) AS n_rows,
  CASE WHEN a.n IS NULL THEN 'missing' WHEN a.n = 0 THEN 'empty' WHEN c.n IS NULL THEN 'warning' ELSE 'healthy' END AS status
  FROM (VALUES ('bronze'), ('silver'), ('gold')) l(layer)
  LEFT JOIN (SELECT layer, count_if(n > 0) AS n_assets, sum(n) AS n FROM ass GROUP BY layer) a USING (layer)
  LEFT JOIN (SELECT layer, count(*) AS n FROM con GROUP BY layer) c USING (layer))
SELECT layer, status, n_assets, n_contracts, CAST(n_rows AS BIGINT) AS n_rows, (SELECT max(ts) FROM events) AS latest FROM lay
UNION ALL SELECT 'overall', CASE WHEN sum(n_rows) = 0 THEN 'critical' WHEN bool_and(status = 'healthy') THEN 'healthy' ELSE 'degraded' END,
  CAST(sum(n_assets) AS BIGINT), CAST(sum(n_contracts) AS BIGINT), CAST(sum(n_rows) AS BIGINT), (SELECT max(ts) FROM events) FROM lay"""))
def layer_health_query(spark, sf):
    """Health of bronze, silver and gold from their assets and
    contracts, and overall."""
    last = table(spark, sf, "events", "ts").agg(F.max("ts").alias("latest"))
    parts = [bronze_rows(spark, sf).groupBy("asset").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("layer", F.lit("bronze"))]
    parts += [silver(spark, sf, a).agg(F.count(F.lit(1)).alias("n_rows")).withColumns({"layer": F.lit("silver"), "asset": F.lit(a)}) for a in ARTIFACTS]
    parts.append(gold_rows(spark, sf).groupBy("asset").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("layer", F.lit("gold")))
    assets = reduce(DataFrame.unionByName, parts).crossJoin(F.broadcast(last))   # one row
    return layer_health(assets, contracts(spark, sf), LAYERS)
