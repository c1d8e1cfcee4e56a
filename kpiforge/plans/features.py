"""Silver feature tables (K1–K6) and the unified KPI base (K7).

Each function takes (spark, sf_dir) and returns a DataFrame with one row
per (year, region) — or per (year, quarter, region) for rent. Stored
values are rounded where the feature definition rounds, and downstream
steps read the rounded values, as a written silver table would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import num, positive_or_null, safe_div
from ..operators.joins import asof_backward, full_outer_chain
from ..operators.windows import (cumulative_change, minmax_scale, pct_change, rolling_avg,
                                 rolling_std, scale_by_max, series_window, yoy_change, yoy_pct)
from ..sources.tables import nation_dim
from . import panel
from .store import materialized

NATIONAL = "NATIONAL"
# Default regional share of national population, default
# national population, rent share of income for the proxy path, weeks/year.
DEFAULT_SHARE = 0.01
DEFAULT_NZ_POP = 5_200_000
RENT_INCOME_SHARE = 0.30
WEEKS = 52


def _national_gdp_pc(spark, sf):
    macro = panel.macro_panel(spark, sf).select("year", "gdp")
    pop = panel.national_population(panel.order_panel(spark, sf))
    j = macro.join(pop, "year", "full_outer")
    return (j.withColumn("gdp_pc", safe_div(F.col("gdp"), F.col("population")))
            .filter(F.col("gdp_pc") > 0)
            .select("year", "gdp_pc"))


def _present(df: DataFrame | None) -> bool:
    return df is not None and not df.isEmpty()


def affordability_from(nat: DataFrame, income: DataFrame | None, regions: DataFrame | None) -> DataFrame:
    """K1 from what is there. ``nat``: (year, gdp_pc). With regional incomes
    (region, year, income): gdp per capita vs income on the year × region
    scaffold. Without: the national index alone."""
    if not _present(income) or not _present(regions):
        nat = nat.withColumn("gdp_per_capita", num("gdp_pc", 0))
        out = minmax_scale(nat, "gdp_pc", "affordability_index", eps=1.0, digits=1)
        return out.select(F.col("year").cast("bigint").alias("year"), F.lit(NATIONAL).alias("region"),
                          "gdp_per_capita", "affordability_index")
    j = nat.crossJoin(regions).join(income, ["year", "region"], "left")     # years × regions: the scaffold
    inc = positive_or_null(F.col("income"))
    return j.select(
        F.col("year").cast("bigint").alias("year"), "region",
        num("gdp_pc", 0).alias("gdp_per_capita"),
        num("income", 2).alias("median_income"),
        num(F.col("gdp_pc") / inc * 50.0, 1).alias("affordability_index"),
        num(F.col("gdp_pc") / inc, 4).alias("price_to_income_ratio"))


def affordability(spark: SparkSession, sf: str) -> DataFrame:
    """K1: gdp per capita vs regional income on a year × region scaffold."""
    regions = nation_dim(spark, sf).select(F.col("n_name").alias("region"))
    return affordability_from(_national_gdp_pc(spark, sf), panel.order_panel(spark, sf).select("region", "year", "income"), regions)


def affordability_national(spark: SparkSession, sf: str) -> DataFrame:
    """K1 fallback: national min–max index of gdp per capita (ε = 1)."""
    return affordability_from(_national_gdp_pc(spark, sf), None, None)


def interest_rate_from(rates: DataFrame | None, lending: DataFrame | None) -> DataFrame | None:
    """K2 from the policy rate (year, rate; any number of rows a year) or,
    where there is none, the lending rate (year, value); None without
    both."""
    if _present(rates):
        yearly = rates.groupBy("year").agg(F.avg("rate").alias("r"))
    elif _present(lending):
        yearly = lending.select("year", F.col("value").alias("r"))
    else:
        return None
    yearly = yearly.select("year", F.lit(NATIONAL).alias("region"), num("r", 4).alias("ocr_value"))
    w = series_window("region", "year")
    feats = (yearly
             .withColumn("mortgage_rate_2yr", F.col("ocr_value"))
             .withColumn("ocr_change_bps", num(yoy_change("ocr_value", w) * 100.0, 2))
             .withColumn("rate_volatility", num(rolling_std("ocr_value", w), 4)))
    out = scale_by_max(feats, "rate_volatility", "interest_rate_impact_score", eps=0.01, digits=1)
    return out.select(F.col("year").cast("bigint").alias("year"), "region", "ocr_value",
                      "mortgage_rate_2yr", "ocr_change_bps", "rate_volatility",
                      "interest_rate_impact_score")


def interest_rate(spark: SparkSession, sf: str) -> DataFrame:
    """K2: yearly mean rate, 3-year volatility, change in bps, impact score."""
    lending = panel.macro_panel(spark, sf).select("year", F.col("interest").alias("value"))
    return interest_rate_from(panel.rate_panel(spark, sf).select("year", "rate"), lending)


def population_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Each region's share of the latest year's total population."""
    op = panel.order_panel(spark, sf).select("region", "year", "population")
    latest = op.agg(F.max("year").alias("year"))
    cur = op.join(latest, "year")
    tot = cur.agg(F.sum("population").alias("_tot"))
    return (cur.crossJoin(tot)
            .select(F.col("year").cast("bigint").alias("year"), "region",
                    F.col("population").cast("bigint").alias("population"),
                    num(F.col("population") / F.col("_tot"), 6).alias("share")))


def tourism_pressure(spark: SparkSession, sf: str) -> DataFrame:
    """K3: expenditure per capita ·10 with share/population lookups (defaults)."""
    t = panel.tourism_panel(spark, sf).select(
        "region", "year", num(F.col("spend").cast("double") / 1e6, 4).alias("tourism_expenditure"))
    shares = population_shares(spark, sf).select("region", "share")
    natpop = panel.national_population(panel.order_panel(spark, sf)).withColumnRenamed(
        "population", "nz_pop")
    unemp = panel.macro_panel(spark, sf).select("year", num("unemployment", 4).alias("unemployment_rate"))
    j = (t.join(shares, "region", "left").join(natpop, "year", "left").join(unemp, "year", "left"))
    denom = F.greatest(F.lit(1.0), F.coalesce(F.col("share"), F.lit(DEFAULT_SHARE))
                       * F.coalesce(F.col("nz_pop").cast("double"), F.lit(float(DEFAULT_NZ_POP))))
    w = series_window("region", "year")
    return j.select(
        F.col("year").cast("bigint").alias("year"), "region", "tourism_expenditure",
        F.col("tourism_expenditure").alias("visitor_arrivals"),
        num(F.col("tourism_expenditure") * 1e6 / denom * 10.0, 1).alias("tourism_pressure_index"),
        "unemployment_rate",
        num(pct_change("tourism_expenditure", w), 2).alias("tourism_growth_yoy"))


def supply_deficit(spark: SparkSession, sf: str) -> DataFrame:
    """K4: consents vs population growth (as-of), per-1000 rate, score, gap."""
    op = panel.order_panel(spark, sf)
    consents = op.select("region", "year", F.col("consents").alias("building_consents"))
    pop = op.select("region", "year", "population")
    wp = series_window("region", "year")
    prev = F.lag("population").over(wp)
    growth = pop.select("region", F.col("year").alias("pyear"),
                        num(F.when(prev > 0, (F.col("population") - prev) / prev * 100.0), 2)
                        .alias("population_growth"))
    j = consents.join(pop, ["region", "year"], "left")          # J6
    j = asof_backward(j, growth, ["region"], "year", "pyear", ["population_growth"])  # J7
    per1000 = num(F.col("building_consents") / F.greatest(F.lit(1), F.coalesce("population", F.lit(0)))
                  * 1000.0, 2)
    j = j.withColumn("consents_per_1000_people", per1000)
    j = minmax_scale(j, "consents_per_1000_people", "supply_deficit_score", eps=0.01, digits=1)
    gap = num(F.coalesce("population_growth", F.lit(0.0)) - F.coalesce("consents_per_1000_people", F.lit(0.0)), 2)
    return j.select(F.col("year").cast("bigint").alias("year"), "region",
                    F.col("building_consents").cast("bigint").alias("building_consents"),
                    F.col("population").cast("bigint").alias("population"),
                    "population_growth", "consents_per_1000_people", "supply_deficit_score",
                    gap.alias("housing_supply_gap"))


def rent_income_from(rent: DataFrame | None, income: DataFrame | None, infl: DataFrame) -> DataFrame | None:
    """K5 from the rent series (region, year, quarter, median_weekly_rent)
    or, without one, rent as a share of income (region, year,
    median_income); None without both."""
    if _present(rent):
        j = rent.join(income, ["region", "year"], "left") if income is not None else rent.withColumn("median_income", F.lit(None).cast("double"))
        return _rent_metrics(j.join(infl, "year", "left"))              # J8
    if not _present(income):
        return None
    j = (income.join(infl, "year", "left").withColumn("quarter", F.lit(4))
         .withColumn("median_weekly_rent", num(F.greatest(F.col("median_income"), F.lit(0.0)) * RENT_INCOME_SHARE / WEEKS, 0)))
    return _rent_metrics(j)


def _rent_inputs(spark: SparkSession, sf: str):
    rent = panel.rent_panel(spark, sf).select("region", "year", "quarter",
                                              num("rent", 2).alias("median_weekly_rent"))
    income = panel.order_panel(spark, sf).select("region", "year", num("income", 2).alias("median_income"))
    infl = panel.macro_panel(spark, sf).select("year", num("inflation", 4).alias("general_inflation"))
    return rent, income, infl


def rent_income(spark: SparkSession, sf: str) -> DataFrame:
    """K5: quarterly rent vs income; inflation, erosion, cumulative pressure."""
    return rent_income_from(*_rent_inputs(spark, sf))


def _rent_metrics(j: DataFrame) -> DataFrame:
    w = series_window("region", ["year", "quarter"])
    j = (j.withColumn("annual_rent", num(F.col("median_weekly_rent") * WEEKS, 2))
         .withColumn("rent_to_income_ratio",
                     num(F.col("annual_rent") / positive_or_null(F.col("median_income")) * 100.0, 1))
         .withColumn("rent_inflation_rate", num(pct_change("median_weekly_rent", w), 2))
         .withColumn("affordability_erosion",
                     num(F.coalesce("rent_inflation_rate", F.lit(0.0))
                         - F.coalesce("general_inflation", F.lit(0.0)), 1))
         .withColumn("cumulative_rent_pressure", num(cumulative_change("median_weekly_rent", w), 1)))
    return j.select(F.col("year").cast("bigint").alias("year"),
                    F.col("quarter").cast("bigint").alias("quarter"), "region",
                    "median_weekly_rent", "annual_rent", "median_income", "rent_to_income_ratio",
                    "general_inflation", "rent_inflation_rate", "affordability_erosion",
                    "cumulative_rent_pressure")


def rent_income_proxy(spark: SparkSession, sf: str) -> DataFrame:
    """K5 proxy path: weekly rent = 30% of income / 52 when no rent series."""
    return rent_income_from(None, *_rent_inputs(spark, sf)[1:])


#: Indicators of K6 and their weights; at least three must be there.
VOLATILITY = {"gdp": 0.4, "inflation": 0.3, "unemployment": 0.2, "interest": 0.1}


def macro_volatility_from(indicators: dict[str, DataFrame]) -> DataFrame | None:
    """K6 from the indicator series (year, value) that are there, brought
    together by an outer join on the year; None with fewer than three. A
    missing indicator has a NULL volatility and no weight."""
    there = {k: df for k, df in indicators.items() if k in VOLATILITY and _present(df)}
    if len(there) < 3:
        return None
    m = reduce(lambda a, b: a.join(b, "year", "full_outer"), [df.select("year", F.col("value").alias(k)) for k, df in there.items()])
    m = m.withColumn("region", F.lit(NATIONAL))
    w = series_window("region", "year")
    if "gdp" in there:
        m = m.withColumn("gdp", pct_change("gdp", w))
    names = {"gdp": "gdp_volatility", "inflation": "inflation_volatility", "unemployment": "unemployment_volatility", "interest": "interest_rate_volatility"}
    vols = m.select("year", "region", *[
        (num(rolling_std(k, w), 4) if k in there else F.lit(None).cast("double")).alias(n) for k, n in names.items()])
    raw = reduce(lambda a, b: a + b, [F.lit(VOLATILITY[k]) * F.col(names[k]) for k in there])
    out = minmax_scale(vols.withColumn("_raw", raw), "_raw", "macroeconomic_volatility_index", eps=0.01, digits=1)
    return out.select("region", F.col("year").cast("bigint").alias("year"),
                      "macroeconomic_volatility_index", *names.values())


def macro_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """K6: weighted 3-year volatility of four national indicators, 0–100."""
    m = panel.macro_panel(spark, sf)
    return macro_volatility_from({k: m.select("year", F.col(k).alias("value")) for k in VOLATILITY})


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(x).alias(f"{p}_{x}") for x in df.columns])


SILVER = {}


def silver(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A silver feature table, written once per application and re-read."""
    return materialized(spark, sf, f"silver_{name}", SILVER[name])


def unified_base_inputs(spark: SparkSession, sf: str):
    a = silver(spark, sf, "affordability").select("year", "region", "gdp_per_capita",
                                        "price_to_income_ratio", "affordability_index")
    ir = silver(spark, sf, "interest_rate").select("year", "ocr_value", "mortgage_rate_2yr",
                                         "ocr_change_bps", "rate_volatility")
    # Tourism and rent are brought to the join grain first (tourism: year;
    # rent: year × region) so the year-keyed joins do not fan out.
    t = (silver(spark, sf, "tourism_pressure").groupBy("year")
         .agg(num(F.sum("visitor_arrivals"), 4).alias("visitor_arrivals"),
              num(F.sum("tourism_expenditure"), 4).alias("tourism_expenditure"),
              num(F.avg("tourism_pressure_index"), 2).alias("tourism_pressure_index")))
    s = silver(spark, sf, "supply_deficit").select("year", "region", "building_consents",
                                         "population_growth", "supply_deficit_score")
    ri = (silver(spark, sf, "rent_income").groupBy("year", "region")
          .agg(num(F.avg("median_weekly_rent"), 2).alias("median_weekly_rent"),
               num(F.avg("rent_to_income_ratio"), 1).alias("rent_to_income_ratio"),
               num(F.avg("rent_inflation_rate"), 2).alias("rent_inflation_rate")))
    return a, ir, t, s, ri


METRICS = ["gdp_per_capita", "price_to_income_ratio", "affordability_index", "ocr_value",
           "mortgage_rate_2yr", "ocr_change_bps", "rate_volatility", "visitor_arrivals",
           "tourism_expenditure", "tourism_pressure_index", "building_consents",
           "population_growth", "supply_deficit_score", "median_weekly_rent",
           "rent_to_income_ratio", "rent_inflation_rate"]


def unified_base(spark: SparkSession, sf: str) -> DataFrame:
    """K7 (flagship): five-way FULL OUTER panel + YoY, 3-year averages, rank."""
    a, ir, t, s, ri = unified_base_inputs(spark, sf)
    joined = full_outer_chain(
        _prefixed(a, "a"),
        [(_prefixed(ir, "ir"), ["year"]), (_prefixed(t, "t"), ["year"]),
         (_prefixed(s, "s"), ["year", "region"]), (_prefixed(ri, "ri"), ["year", "region"])],
        ["year", "region"])
    src = {"a": a, "ir": ir, "t": t, "s": s, "ri": ri}
    cols = []
    for m in METRICS:
        p = next(p for p, df in src.items() if m in df.columns)
        cols.append(F.col(f"{p}_{m}").alias(m))
    base = joined.select(
        F.coalesce("a_year", "ir_year", "t_year", "s_year", "ri_year").alias("year"),
        F.coalesce("a_region", "s_region", "ri_region").alias("region"), *cols)
    w = series_window("region", "year")
    wy = series_window("year", []).orderBy(F.col("affordability_index").desc_nulls_last())
    return base.select(
        "year", "region", *METRICS,
        num(yoy_pct("gdp_per_capita", w), 2).alias("gdp_per_capita_yoy_pct"),
        num(yoy_change("affordability_index", w), 2).alias("affordability_index_yoy_change"),
        num(yoy_pct("building_consents", w), 2).alias("building_consents_yoy_pct"),
        num(yoy_pct("median_weekly_rent", w), 2).alias("rent_yoy_pct"),
        num(rolling_avg("gdp_per_capita", w), 0).alias("gdp_per_capita_3yr_avg"),
        num(rolling_avg("affordability_index", w), 2).alias("affordability_index_3yr_avg"),
        num(rolling_avg("tourism_pressure_index", w), 2).alias("tourism_pressure_3yr_avg"),
        F.rank().over(wy).cast("bigint").alias("affordability_rank"))


SILVER.update({
    "affordability": affordability,
    "affordability_national": affordability_national,
    "interest_rate": interest_rate,
    "tourism_pressure": tourism_pressure,
    "supply_deficit": supply_deficit,
    "rent_income": rent_income,
    "rent_income_proxy": rent_income_proxy,
    "macro_volatility": macro_volatility,
    "unified_base": unified_base,
})
