"""The catalog of every stored table of the three layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import enriched, lineage, scan, search
from ..oracle.gold import with_kpis
from ..sources.tables import TABLES, table
from .features import silver
from .q_display import kpis
from .q_quality import ARTIFACTS, CONTRACT_CTE, contract_scores_df
from .registry import query
from .stages import silver_tables
from .store import materialized

# Parents as contracts name them (ours); the catalog holds no "rates_feed" and no "survey".
PARENTS = {
    "affordability": ["orders", "customer", "lineitem"], "interest_rate": ["lineitem", "rates_feed"],
    "tourism_pressure": ["lineitem", "supplier", "orders", "survey"], "supply_deficit": ["orders", "customer", "nation"],
    "rent_income": ["lineitem", "orders", "supplier"], "macro_volatility": ["lineitem", "rates_feed"],
    "kpis": ["affordability", "interest_rate", "tourism_pressure", "supply_deficit", "rent_income", "macro_volatility"],
}
FIND, LAYER = "Rent", "silver"


def build_scan(spark, sf) -> DataFrame:
    silver_tables(spark, sf, ARTIFACTS)
    stored = [("bronze", t, table(spark, sf, t)) for t in TABLES]
    stored += [("silver", a, silver(spark, sf, a)) for a in ARTIFACTS] + [("gold", "kpis", kpis(spark, sf))]
    return scan(stored)


def entries(spark, sf) -> DataFrame:
    return materialized(spark, sf, "catalog_entries", build_scan)


def catalog(spark, sf) -> DataFrame:
    parents = spark.createDataFrame(list(PARENTS.items()), "name string, parents array<string>")
    scored = contract_scores_df(spark, sf).select(F.col("artifact").alias("name"), "source", "confidence",
                                                  F.concat(F.col("n_rows").cast("string"), F.lit(" rows of "), "source_name").alias("notes"))
    return enriched(entries(spark, sf), parents.join(scored, "name", "left"))


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _sql() -> str:
    stored = [("bronze", t, t) for t in TABLES] + [("silver", a, v) for a, (_, v) in ARTIFACTS.items()] + [("gold", "kpis", "kpis")]
    rows = " UNION ALL ".join(f"SELECT '{n}' AS name, '{layer}' AS layer, (SELECT count(*) FROM {v}) AS row_count, "
                              f"(SELECT list_sort(json_keys(to_json(t))) FROM {v} t LIMIT 1) AS columns" for layer, n, v in stored)
    par = ", ".join(f"('{n}', {_list(p)})" for n, p in PARENTS.items())
    return CONTRACT_CTE + f""", ent AS ({rows}), par AS (SELECT * FROM (VALUES {par}) t(name, parents)),
cat0 AS (SELECT e.name, e.layer, 'parquet' AS format, e.row_count, CAST(len(e.columns) AS BIGINT) AS column_count, e.columns, coalesce(c.source, 'unknown') AS source,
  coalesce(c.confidence, 0.0) AS confidence, coalesce(p.parents, CAST([] AS VARCHAR[])) AS parents,
  coalesce(c.n_rows || ' rows of ' || c.source_name, e.layer || ' table of ' || array_to_string(e.columns, ', ')) AS description
  FROM ent e LEFT JOIN contract_scores c ON c.artifact = e.name LEFT JOIN par p ON p.name = e.name),
cat AS (SELECT *, [layer, source] || list_filter(string_split(name, '_'), lambda w: w <> '' AND w <> layer AND w <> source) AS tags FROM cat0)
"""


_FIELDS = ["name", "layer", "format", "row_count", "column_count", "columns", "source", "confidence", "parents", "description", "tags"]


@query("catalog_scan", with_kpis(_sql() + f"SELECT {', '.join(_FIELDS)} FROM cat"))
def catalog_scan(spark, sf):
    """D26 + J18: every stored table with what its files and its contract say."""
    return catalog(spark, sf).select(*_FIELDS)


@query("catalog_files")
def catalog_files(spark, sf):
    """Files, bytes and time of the last write of every stored table."""
    return entries(spark, sf).select("name", "layer", "n_files", "size_bytes", "updated_at",
                                     F.round((F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("updated_at")) / 86400, 1).alias("freshness_days"))


@query("catalog_find", with_kpis(_sql() + f"""SELECT name, layer, description FROM cat WHERE layer = '{LAYER}' AND (contains(lower(name), lower('{FIND}'))
  OR contains(lower(description), lower('{FIND}')) OR len(list_filter(tags, lambda t: contains(lower(t), lower('{FIND}')))) > 0)"""))
def catalog_find(spark, sf):
    """Search by name, description and tags within a layer."""
    return search(catalog(spark, sf), FIND, LAYER).select("name", "layer", "description")


@query("catalog_lineage", with_kpis(_sql() + """, ed AS (SELECT name AS child, unnest(parents) AS parent FROM cat)
SELECT e.child AS name, 'upstream' AS direction, p.name AS related, p.layer, p.confidence FROM ed e JOIN cat p ON p.name = e.parent
UNION ALL SELECT e.parent, 'downstream', c.name, c.layer, c.confidence FROM ed e JOIN cat c ON c.name = e.child JOIN cat p ON p.name = e.parent"""))
def catalog_lineage(spark, sf):
    """Both directions, with layer and confidence; unknown parents left out."""
    return lineage(catalog(spark, sf))
