"""Panel views: the driver tables seen as regional and national series.

Binding (see README): nation = region, year of the order / ship date =
year. Orders are aggregated to (customer, year) *before* they meet the
customers, which may be many, so a customer holding a third of all rows
becomes a handful of rows before the shuffle. Lines meet their supplier's
nation row by row, as (supplier, month) would hardly be fewer rows than
lines, and are summed in each task by nation and month. Money is summed
exactly, in integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import exact_sum, exact_sum_parts, exact_sum_value, hundredths, money
from ..operators.aggregates import exact_median
from ..sources.tables import bounded_broadcast, nation_dim, table
from .store import materialized

URGENT = ("1-URGENT", "2-HIGH")


def build_order_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(region, year): orders, order value, distinct customers, urgent orders.

    Stands for income (mean order value), population (customers) and
    building consents (urgent orders).
    """
    o = table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    per_cust = (o.groupBy("o_custkey", F.year("o_orderdate").alias("year"))
                .agg(F.count(F.lit(1)).alias("n_orders"),
                     *exact_sum("o_totalprice", "value"),
                     F.count_if(F.col("o_orderpriority").isin(*URGENT)).alias("n_urgent")))
    cust = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    j = (per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
         .join(nation_dim(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")))
    # Each (customer, year) row is unique and a customer has one nation, so
    # count(*) here is the distinct-customer count of the (region, year).
    g = (j.groupBy(F.col("n_name").alias("region"), "year")
         .agg(F.sum("n_orders").alias("n_orders"), *exact_sum_parts("value"),
              F.count(F.lit(1)).alias("population"),
              F.sum("n_urgent").alias("consents")))
    return (g.select("region", "year", "n_orders", exact_sum_value("value").alias("order_value"),
                     "population", "consents")
            .withColumn("income", F.col("order_value").cast("double") / F.col("n_orders")))


def _revenue_expr():
    return F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))


def _revenue():
    return money(_revenue_expr())


#: Suppliers (two numbers each) that are sent to every executor: some 40 MB there. More are joined by shuffle.
SUPPLIERS = 1_000_000


def supplier_nations(spark: SparkSession, sf: str) -> DataFrame:
    """(s_suppkey, s_nationkey), broadcast by its number of rows and not by
    the size of its files, so that lines stay where they are read."""
    return bounded_broadcast(table(spark, sf, "supplier", "s_suppkey", "s_nationkey"), f"{sf}/supplier/{SUPPLIERS}", SUPPLIERS)


def build_region_sums(spark: SparkSession, sf: str) -> DataFrame:
    """(region, year, month): exact partial sums of line revenue, shared by
    the tourism and region-month panels. Lines meet their supplier's nation
    in one narrow scan (see ``supplier_nations``) and are summed in each task, so a supplier's size and the number of suppliers do not
    matter to what is shuffled."""
    li = table(spark, sf, "lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount")
    supp = supplier_nations(spark, sf)
    g = (li.join(supp, li.l_suppkey == supp.s_suppkey)
         .groupBy("s_nationkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
         .agg(*exact_sum(_revenue_expr(), "revenue")))
    return (g.join(nation_dim(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy(F.col("n_name").alias("region"), "year", "month").agg(*exact_sum_parts("revenue")))


def build_tourism_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(region, year of ship date): line revenue (tourism expenditure)."""
    g = region_sums(spark, sf).groupBy("region", "year").agg(*exact_sum_parts("revenue"))
    return g.select("region", "year", exact_sum_value("revenue").alias("spend"))


def line_regions(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Line rows tagged with their supplier's region (row-level join)."""
    li = table(spark, sf, "lineitem", "l_suppkey", *cols)
    supp = supplier_nations(spark, sf)
    return (li.join(supp, li.l_suppkey == supp.s_suppkey)
            .join(nation_dim(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumnRenamed("n_name", "region"))


def build_rent_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(region, year, quarter): exact median unit price (weekly rent).

    Lines meet their supplier's region (see ``supplier_nations``) in two
    narrow scans; counts are all that moves on from there."""
    lines = line_regions(spark, sf, "l_shipdate", "l_extendedprice", "l_quantity")
    rows = lines.select("region", F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"),
                        F.try_divide(F.col("l_extendedprice"), F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("unit_price"))
    return exact_median(rows, ["region", "year", "quarter"], "unit_price", "rent")


def build_month_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(year, month) sums over all lines, whatever their supplier; the macro
    (year) and rate (month) series derive from it."""
    li = table(spark, sf, "lineitem", "l_shipdate", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return (li.groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
            .agg(*exact_sum(_revenue_expr(), "revenue"),
                 F.count(F.lit(1)).alias("n_lines"),
                 F.sum(hundredths("l_discount")).alias("disc_h"),
                 F.sum(hundredths("l_tax")).alias("tax_h"),
                 F.count_if(F.col("l_returnflag") == "R").alias("n_returns")))


def macro_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(year): GDP (revenue), inflation, unemployment, interest series."""
    g = (month_panel(spark, sf).groupBy("year")
         .agg(*exact_sum_parts("revenue"), F.sum("n_lines").alias("n_lines"),
              F.sum("disc_h").alias("disc_h"), F.sum("tax_h").alias("tax_h"),
              F.sum("n_returns").alias("n_returns")))
    n = F.col("n_lines")
    return g.select(
        "year",
        exact_sum_value("revenue").cast("double").alias("gdp"),
        (F.col("disc_h").cast("double") / n).alias("inflation"),
        (F.col("n_returns") * 100.0 / n).alias("unemployment"),
        (F.col("tax_h").cast("double") / n).alias("interest"))


def rate_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(year, month): mean discount·100 (monthly policy-rate series)."""
    return month_panel(spark, sf).select(
        "year", "month", (F.col("disc_h").cast("double") / F.col("n_lines")).alias("rate"))


def national_population(order_p: DataFrame) -> DataFrame:
    return order_p.groupBy("year").agg(F.sum("population").alias("population"))


def order_panel(spark: SparkSession, sf: str) -> DataFrame:
    return materialized(spark, sf, "order_panel", build_order_panel)


def tourism_panel(spark: SparkSession, sf: str) -> DataFrame:
    return materialized(spark, sf, "tourism_panel", build_tourism_panel)


def rent_panel(spark: SparkSession, sf: str) -> DataFrame:
    return materialized(spark, sf, "rent_panel", build_rent_panel)


def month_panel(spark: SparkSession, sf: str) -> DataFrame:
    return materialized(spark, sf, "month_panel", build_month_panel)


def region_sums(spark: SparkSession, sf: str) -> DataFrame:
    return materialized(spark, sf, "region_sums", build_region_sums)
