"""Registered queries: panel views, silver features, unified base."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import num
from ..oracle.silver import SILVER_SQL
from . import features, panel
from .registry import query


def _q(name):
    return query(name, SILVER_SQL[name])


@_q("panel_orders")
def panel_orders(spark, sf):
    op = panel.order_panel(spark, sf)
    return op.select("region", F.col("year").cast("bigint").alias("year"), "n_orders",
                     F.col("order_value").cast("double").alias("order_value"),
                     "population", "consents", num("income", 4).alias("income"))


@_q("panel_macro")
def panel_macro(spark, sf):
    m = panel.macro_panel(spark, sf)
    return m.select(F.col("year").cast("bigint").alias("year"), num("gdp", 2).alias("gdp"),
                    num("inflation", 6).alias("inflation"),
                    num("unemployment", 6).alias("unemployment"),
                    num("interest", 6).alias("interest"))


@_q("panel_rent_median")
def panel_rent_median(spark, sf):
    r = panel.rent_panel(spark, sf)
    return r.select("region", F.col("year").cast("bigint").alias("year"),
                    F.col("quarter").cast("bigint").alias("quarter"), num("rent", 4).alias("rent"))


_q("feat_affordability")(features.affordability)
_q("feat_affordability_national")(features.affordability_national)
_q("feat_interest_rate")(features.interest_rate)
_q("feat_tourism_pressure")(features.tourism_pressure)
_q("region_shares")(features.population_shares)
_q("feat_supply_deficit")(features.supply_deficit)
_q("feat_rent_income")(features.rent_income)
_q("feat_rent_income_proxy")(features.rent_income_proxy)
_q("feat_macro_volatility")(features.macro_volatility)
_q("kpi_unified_base")(features.unified_base)
