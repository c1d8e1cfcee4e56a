"""Gold KPIs, calculator form (K8–K13 second form), fill-missing
and reconciliation with the SQL form (J19).

All inputs are latest-period national figures taken from the silver
tables in one row (small aggregates cross-joined), each with the
accessor default used when the input is missing. Regional prices are one
row per region; their national value is an exact median over regions.
Shape: name, value, unit, description, category, source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import annuity_payment, clamp, num, safe_div
from ..oracle.gold import with_kpis
from ..oracle.silver import N, with_silver
from . import panel
from .features import silver
from .gold import latest, latest_period, with_latest_year
from .registry import query
from ..sources.tables import bounded_broadcast

# Accessor defaults.
D_OCR, D_INFL, D_UNEMP, D_GDP_PC, D_GDP_YOY, D_SUPPLY = 5.50, 4.0, 4.0, 48000.0, 2.0, 50.0
D_EROSION, D_MACRO_VOL, D_IMPACT, D_CORR, D_PRESSURE = 0.0, 30.0, 50.0, 0.0, 50.0
D_INCOME, D_POP, D_PRICE, D_WEEKLY, D_LAG_YOY, D_SEASON = 65000.0, 100000.0, 650000.0, 550.0, 0.0, 1.5
NZ_POP = 5_200_000.0


def price_factor(pop):
    """Price-to-income multiple by population tier (9 / 8 / 7.5 / 6.5)."""
    return F.when(pop > 1_000_000, 9.0).when(pop > 500_000, 8.0).when(pop > 200_000, 7.5).otherwise(6.5)


def region_prices(spark, sf) -> DataFrame:
    a = latest(silver(spark, sf, "affordability")).select("region", "median_income")
    s = latest(silver(spark, sf, "supply_deficit")).select("region", "population")
    r = latest_period(silver(spark, sf, "rent_income")).select("region", "median_weekly_rent")
    j = a.join(s, "region", "left").join(r, "region", "left")
    inc = F.coalesce("median_income", F.lit(D_INCOME))
    pop = F.coalesce(F.col("population").cast("double"), F.lit(D_POP))
    return j.select("region", inc.alias("income"), num(inc * price_factor(pop), 0).alias("price"),
                    F.coalesce("median_weekly_rent", F.lit(D_WEEKLY)).alias("weekly"))


def calc_inputs(spark, sf) -> DataFrame:
    ir = latest(silver(spark, sf, "interest_rate")).agg(F.avg("ocr_value").alias("ocr"),
                                                        F.avg("interest_rate_impact_score").alias("impact"))
    mv = latest(silver(spark, sf, "macro_volatility")).agg(F.avg("macroeconomic_volatility_index").alias("mvol"))
    mp = latest(panel.macro_panel(spark, sf)).agg(F.avg("inflation").alias("infl"), F.avg("unemployment").alias("unemp"))
    aff = silver(spark, sf, "affordability")
    ax = with_latest_year(aff)
    mx = F.col("_mx")
    g = ax.filter(F.col("year") >= mx - 1).agg(F.avg(F.when(F.col("year") == mx, F.col("gdp_per_capita"))).alias("gdp_pc"),
                                               F.avg(F.when(F.col("year") == mx - 1, F.col("gdp_per_capita"))).alias("_gp"))
    sup = latest(silver(spark, sf, "supply_deficit")).agg(F.avg("supply_deficit_score").alias("supply"),
                                                          F.avg("population_growth").alias("pop_growth"),
                                                          F.sum("building_consents").alias("consents"))
    ri = latest_period(silver(spark, sf, "rent_income")).agg(F.avg("affordability_erosion").alias("erosion"),
                                                             F.avg("median_weekly_rent").alias("weekly"))
    t = latest(silver(spark, sf, "tourism_pressure"))
    ta = t.agg(F.avg("tourism_pressure_index").alias("pressure"), F.avg("tourism_growth_yoy").alias("t_yoy"),
               F.count(F.lit(1)).alias("_tn"), F.max("visitor_arrivals").alias("_tmx"), F.min("visitor_arrivals").alias("_tmn"))
    a_l = latest(aff).select("region", "affordability_index")
    corr = (t.select("region", "tourism_pressure_index").join(a_l, "region")
            .agg(safe_div(F.covar_pop("tourism_pressure_index", "affordability_index"),
                          F.stddev_pop("tourism_pressure_index") * F.stddev_pop("affordability_index")).alias("corr")))
    rp = region_prices(spark, sf).agg(F.median("price").alias("m_price"), F.avg("income").alias("income"))
    one = reduce(DataFrame.crossJoin, [ir, mv, mp, g, sup, ri, ta, corr, rp])
    d = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    season = F.when((F.col("_tn") >= 2) & (F.col("_tmn") > 0), F.col("_tmx") / F.col("_tmn")).otherwise(D_SEASON)
    return one.select(d("ocr", D_OCR), d("impact", D_IMPACT), d("mvol", D_MACRO_VOL), d("infl", D_INFL),
                      d("unemp", D_UNEMP), d("gdp_pc", D_GDP_PC),
                      F.coalesce(safe_div(F.col("gdp_pc") - F.col("_gp"), F.col("_gp")) * 100.0, F.lit(D_GDP_YOY)).alias("gdp_yoy"),
                      d("supply", D_SUPPLY), F.coalesce("pop_growth", F.lit(0.0)).alias("pop_growth"),
                      F.coalesce("consents", F.lit(0)).alias("consents"), d("erosion", D_EROSION), d("weekly", D_WEEKLY),
                      d("pressure", D_PRESSURE), d("t_yoy", D_LAG_YOY), season.alias("season"), d("corr", D_CORR),
                      d("m_price", D_PRICE), d("income", D_INCOME))


def rows(df: DataFrame, specs, category: str, region=None) -> DataFrame:
    def lab(t):
        if "{region}" not in t:
            return F.lit(t)
        return F.concat(F.lit(t.split("{region}")[0]), region)
    structs = [F.struct(lab(n).alias("name"), v.cast("double").alias("value"), F.lit(u).alias("unit"),
                        lab(dsc).alias("description"), F.lit(category).alias("category"),
                        F.lit("calculator").alias("source")) for n, v, u, dsc in specs]
    return df.select(F.inline(F.array(*structs)))


c = F.col


def calc_executive(spark, sf):
    i = calc_inputs(spark, sf)
    stab = F.lit(100.0) - F.least(F.lit(100.0), c("impact"))
    return rows(i, [
        ("Habitat Intelligence Score", num(stab * 0.30 + c("supply") * 0.35 + F.least(F.lit(100.0), c("gdp_pc") / 600.0) * 0.35, 1), "pts", "Overall habitat quality (0-100)"),
        ("GDP per Capita YoY", num("gdp_yoy", 1), "%", "Economic growth per person"),
        ("Interest Rate Stability", num(stab, 1), "pts", "Monetary policy stability (0-100)"),
        ("Tourism-Economy Link", num(F.abs(c("corr")) * 100.0, 1), "pts", "Tourism and affordability co-movement"),
        ("Housing Supply Pressure", num("supply", 1), "pts", "Supply deficit score"),
        ("Rent Affordability Gap", num("erosion", 1), "%-pts", "Rent inflation minus wage growth"),
        ("Current OCR", num("ocr", 2), "%", "Official cash rate"),
        ("Inflation (CPI)", num("infl", 1), "%", "Consumer price inflation"),
    ], "Executive")


def calc_housing(spark, sf):
    i = calc_inputs(spark, sf)
    dom = clamp(F.lit(55.0) - c("supply") * 0.3, 20, 80)
    listings = clamp(F.lit(3200.0) - (c("ocr") - 4) * 300, 1500, 4000)
    nat = rows(i, [
        ("Median House Price (National)", num("m_price", 0), "NZD", "Median of regional price estimates"),
        ("Average Days on Market", num(dom, 0), "days", "From supply pressure"),
        ("New Listings per Week (National)", num(listings, 0), "count", "From the cash rate"),
        ("Price per m2 (3 bed)", num(c("m_price") / 150.0, 0), "NZD", "Median price per square metre"),
        ("Housing Supply Deficit Score", num("supply", 1), "pts", "Supply deficit score"),
    ], "Housing")
    mix = rows(i.filter(c("consents") > 0), [
        ("Property Type - Houses", F.lit(68.0), "%", "Share of consents"),
        ("Property Type - Apartments", F.lit(17.0), "%", "Share of consents"),
        ("Property Type - Townhouses", F.lit(15.0), "%", "Share of consents"),
    ], "Housing")
    reg = rows(region_prices(spark, sf), [("Median Price - {region}", c("price"), "NZD", "Price estimate for {region}")],
               "Housing", region=c("region"))
    return nat.unionByName(mix).unionByName(reg)


def calc_tourism(spark, sf):
    i = calc_inputs(spark, sf)
    return rows(i, [
        ("Tourism Pressure Index", num("pressure", 1), "pts", "Tourism pressure"),
        ("Airbnb Share of Rentals", num(F.least(F.lit(30.0), c("pressure") * 0.25 + 5), 1), "%", "Short-stay share"),
        ("Tourism to Rent Lag", num(clamp(F.lit(4.0) + c("t_yoy") * 0.5, 1, 8), 0), "months", "Lag from tourism to rents"),
        ("Visitor Seasonality Strength", num("season", 1), "ratio", "Peak to low ratio"),
        ("Visitors x DOM Correlation", num(F.lit(-0.3) - F.abs(c("pressure") / 100.0) * 0.3, 2), "r", "Visitors vs days on market"),
    ], "Tourism")


def calc_macro(spark, sf):
    i = calc_inputs(spark, sf)
    return rows(i, [
        ("Current OCR", num("ocr", 2), "%", "Official cash rate"),
        ("OCR vs 10y Average", num(c("ocr") - 3.44, 2), "pp", "Cash rate minus 10-year average"),
        ("Mortgage Rate 1Y Fixed", num(c("ocr") + 2.0, 2), "%", "Cash rate + 2.0"),
        ("Mortgage Rate 2Y Fixed", num(c("ocr") + 1.7, 2), "%", "Cash rate + 1.7"),
        ("Mortgage Rate 5Y Fixed", num(c("ocr") + 2.3, 2), "%", "Cash rate + 2.3"),
        ("Monthly Mortgage Cost ($750k)", num(annuity_payment(F.lit(750000.0), c("ocr") + 1.7, 360), 0), "NZD", "Annuity at the 2Y rate"),
        ("Construction Employment", num(clamp(F.lit(12.0) - c("unemp") * 0.8, 5, 12), 1), "%", "From unemployment"),
        ("OCR x Listings Correlation", num(F.lit(-0.4) - (c("ocr") - 3) * 0.08, 2), "r", "Cash rate vs listings"),
        ("GDP Growth YoY", num("gdp_yoy", 1), "%", "GDP per capita growth"),
        ("Inflation (CPI)", num("infl", 1), "%", "Consumer price inflation"),
    ], "Macro")


def calc_affordability(spark, sf):
    i = calc_inputs(spark, sf)
    rp = region_prices(spark, sf).withColumn("years", num(safe_div(c("price"), c("income")), 1))
    mean_years = rp.agg(num(F.avg(safe_div(c("price"), c("income"))), 1).alias("mean_years"))
    nat = rows(i.crossJoin(mean_years), [
        ("Years to Buy (National Avg)", c("mean_years"), "years", "Mean of regional price / income"),
        ("Rent Burden (National)", num(c("weekly") * 52 / c("income") * 100.0, 0), "%", "Annual rent / income"),
        ("Demographic vs Supply Gap", num("supply", 1), "pts", "Supply deficit score"),
        ("Net Migration (National)", num(c("pop_growth") / 100.0 * NZ_POP, 0), "people", "Population growth x 5.2M"),
    ], "Affordability")
    rk = rp.withColumn("rank", F.row_number().over(Window.orderBy(F.col("years").asc_nulls_last(), "region")))
    reg = rows(rk, [("Rent Burden - {region}", num(safe_div(c("weekly") * 52, c("income")) * 100.0, 0), "%", "Annual rent as % of median income in {region}"),
                    ("Years to Buy - {region}", c("years"), "years", "Price / income in {region}"),
                    ("Affordability Rank - {region}", c("rank"), "rank", "Rank of {region} (1 = most affordable)")],
               "Affordability", region=c("region"))
    return nat.unionByName(reg)


def calc_forecast(spark, sf):
    i = calc_inputs(spark, sf)
    f = c("m_price") * (F.lit(1.0) + c("gdp_yoy") / 100.0)
    w = F.greatest(F.lit(0.02), c("mvol") / 100.0 * 0.15)
    dom = clamp(F.lit(55.0) - c("supply") * 0.3, 20, 80)
    gap = F.abs(c("gdp_yoy") - 2)
    return rows(i, [
        ("12-Month Price Forecast", num(f, 0), "NZD", "Median price x (1 + growth)"),
        ("Current Median Price", num("m_price", 0), "NZD", "Median of regional prices"),
        ("Forecast Growth", num("gdp_yoy", 1), "%", "Growth used"),
        ("Confidence 80% Lower", num(f * (F.lit(1.0) - w * 1.28), 0), "NZD", "80% band"),
        ("Confidence 80% Upper", num(f * (F.lit(1.0) + w * 1.28), 0), "NZD", "80% band"),
        ("Confidence 95% Lower", num(f * (F.lit(1.0) - w * 1.96), 0), "NZD", "95% band"),
        ("Confidence 95% Upper", num(f * (F.lit(1.0) + w * 1.96), 0), "NZD", "95% band"),
        ("OCR +0.5% Price Impact", num(F.lit(-1.2) * 0.5 * (c("ocr") / 5.0), 1), "%", "Price change if rates rise"),
        ("Tourism +20% DOM Impact", num(dom * (1 - 0.15 * 0.20), 0), "days", "Days on market if tourism rises"),
        ("Trend Component", num("gdp_yoy", 1), "%", "Trend"),
        ("Seasonal Component", F.lit(1.5), "%", "Seasonal"),
        ("Divergence Alert Score", num(gap * 3 + c("mvol") * 0.1, 1), "pts", "Divergence from 2% trend"),
        ("Model Confidence Score", num(clamp(F.lit(80.0) - c("mvol") * 0.3 - gap * 5, 40, 90), 0), "pts", "Model confidence"),
    ], "Forecast")


CALC = {"executive": calc_executive, "housing": calc_housing, "tourism": calc_tourism, "macro": calc_macro,
        "affordability": calc_affordability, "forecast": calc_forecast}

# ---------------------------------------------------------------- SQL forms
_CI = f""", ci0 AS (SELECT
  (SELECT avg(ocr_value) FROM interest_rate WHERE year = (SELECT max(year) FROM interest_rate)) AS ocr,
  (SELECT avg(interest_rate_impact_score) FROM interest_rate WHERE year = (SELECT max(year) FROM interest_rate)) AS impact,
  (SELECT avg(macroeconomic_volatility_index) FROM macro_volatility WHERE year = (SELECT max(year) FROM macro_volatility)) AS mvol,
  (SELECT avg(inflation) FROM macro_panel WHERE year = (SELECT max(year) FROM macro_panel)) AS infl,
  (SELECT avg(unemployment) FROM macro_panel WHERE year = (SELECT max(year) FROM macro_panel)) AS unemp,
  (SELECT avg(gdp_per_capita) FROM affordability WHERE year = (SELECT max(year) FROM affordability)) AS gdp_pc,
  (SELECT avg(gdp_per_capita) FROM affordability WHERE year = (SELECT max(year) - 1 FROM affordability)) AS gp,
  (SELECT avg(supply_deficit_score) FROM supply WHERE year = (SELECT max(year) FROM supply)) AS supply,
  (SELECT avg(population_growth) FROM supply WHERE year = (SELECT max(year) FROM supply)) AS pop_growth,
  (SELECT sum(building_consents) FROM supply WHERE year = (SELECT max(year) FROM supply)) AS consents,
  (SELECT avg(affordability_erosion) FROM rent_income WHERE year * 10 + quarter = (SELECT max(year * 10 + quarter) FROM rent_income)) AS erosion,
  (SELECT avg(median_weekly_rent) FROM rent_income WHERE year * 10 + quarter = (SELECT max(year * 10 + quarter) FROM rent_income)) AS weekly,
  (SELECT avg(tourism_pressure_index) FROM tourism WHERE year = (SELECT max(year) FROM tourism)) AS pressure,
  (SELECT avg(tourism_growth_yoy) FROM tourism WHERE year = (SELECT max(year) FROM tourism)) AS t_yoy,
  (SELECT CASE WHEN count(*) >= 2 AND min(visitor_arrivals) > 0 THEN max(visitor_arrivals) / min(visitor_arrivals) ELSE {D_SEASON} END
     FROM tourism WHERE year = (SELECT max(year) FROM tourism)) AS season,
  (SELECT covar_pop(t.tourism_pressure_index, a.affordability_index) / NULLIF(stddev_pop(t.tourism_pressure_index) * stddev_pop(a.affordability_index), 0)
     FROM tourism t JOIN affordability a ON a.region = t.region AND a.year = (SELECT max(year) FROM affordability)
     WHERE t.year = (SELECT max(year) FROM tourism)) AS corr),
rp AS (SELECT a.region, COALESCE(a.median_income, {D_INCOME}) AS income,
  {N(f"COALESCE(a.median_income, {D_INCOME}) * CASE WHEN COALESCE(CAST(s.population AS DOUBLE), {D_POP}) > 1000000 THEN 9.0 WHEN COALESCE(CAST(s.population AS DOUBLE), {D_POP}) > 500000 THEN 8.0 WHEN COALESCE(CAST(s.population AS DOUBLE), {D_POP}) > 200000 THEN 7.5 ELSE 6.5 END", 0)} AS price, COALESCE(w.median_weekly_rent, {D_WEEKLY}) AS weekly
  FROM (SELECT * FROM affordability WHERE year = (SELECT max(year) FROM affordability)) a
  LEFT JOIN (SELECT * FROM supply WHERE year = (SELECT max(year) FROM supply)) s ON s.region = a.region
  LEFT JOIN (SELECT region, median_weekly_rent FROM rent_income WHERE year * 10 + quarter = (SELECT max(year * 10 + quarter) FROM rent_income)) w ON w.region = a.region),
ci AS (SELECT COALESCE(ocr, {D_OCR}) AS ocr, COALESCE(impact, {D_IMPACT}) AS impact, COALESCE(mvol, {D_MACRO_VOL}) AS mvol,
  COALESCE(infl, {D_INFL}) AS infl, COALESCE(unemp, {D_UNEMP}) AS unemp, COALESCE(gdp_pc, {D_GDP_PC}) AS gdp_pc,
  COALESCE((gdp_pc - gp) / NULLIF(gp, 0) * 100, {D_GDP_YOY}) AS gdp_yoy, COALESCE(supply, {D_SUPPLY}) AS supply,
  COALESCE(pop_growth, 0.0) AS pop_growth, COALESCE(consents, 0) AS consents, COALESCE(erosion, {D_EROSION}) AS erosion,
  COALESCE(weekly, {D_WEEKLY}) AS weekly, COALESCE(pressure, {D_PRESSURE}) AS pressure, COALESCE(t_yoy, {D_LAG_YOY}) AS t_yoy,
  season, COALESCE(corr, {D_CORR}) AS corr,
  COALESCE((SELECT median(price) FROM rp), {D_PRICE}) AS m_price, COALESCE((SELECT avg(income) FROM rp), {D_INCOME}) AS income FROM ci0)"""


def _row(name, value, unit, desc, cat, src="ci"):
    lab = lambda t: ("'" + t.split("{region}")[0] + "' || region") if "{region}" in t else "'" + t + "'"
    return (f"SELECT {lab(name)} AS name, CAST(({value}) AS DOUBLE) AS value, '{unit}' AS unit, {lab(desc)} AS description, "
            f"'{cat}' AS category, 'calculator' AS source FROM {src}")


def _ann(rate):
    r = f"(({rate}) / 100.0 / 12.0)"
    return f"CASE WHEN {r} = 0 THEN 750000.0 / 360 ELSE 750000.0 * {r} * pow(1 + {r}, 360) / (pow(1 + {r}, 360) - 1) END"


_STAB = "(100.0 - LEAST(100.0, impact))"
_DOM = "GREATEST(20, LEAST(80, 55.0 - supply * 0.3))"
_F = "(m_price * (1.0 + gdp_yoy / 100.0))"
_W = "GREATEST(0.02, mvol / 100.0 * 0.15)"
_GAP = "abs(gdp_yoy - 2)"
CALC_SQL = {
    "executive": [
        _row("Habitat Intelligence Score", N(f"{_STAB} * 0.30 + supply * 0.35 + LEAST(100.0, gdp_pc / 600.0) * 0.35", 1), "pts", "Overall habitat quality (0-100)", "Executive"),
        _row("GDP per Capita YoY", N("gdp_yoy", 1), "%", "Economic growth per person", "Executive"),
        _row("Interest Rate Stability", N(_STAB, 1), "pts", "Monetary policy stability (0-100)", "Executive"),
        _row("Tourism-Economy Link", N("abs(corr) * 100.0", 1), "pts", "Tourism and affordability co-movement", "Executive"),
        _row("Housing Supply Pressure", N("supply", 1), "pts", "Supply deficit score", "Executive"),
        _row("Rent Affordability Gap", N("erosion", 1), "%-pts", "Rent inflation minus wage growth", "Executive"),
        _row("Current OCR", N("ocr", 2), "%", "Official cash rate", "Executive"),
        _row("Inflation (CPI)", N("infl", 1), "%", "Consumer price inflation", "Executive")],
    "housing": [
        _row("Median House Price (National)", N("m_price", 0), "NZD", "Median of regional price estimates", "Housing"),
        _row("Average Days on Market", N(_DOM, 0), "days", "From supply pressure", "Housing"),
        _row("New Listings per Week (National)", N("GREATEST(1500, LEAST(4000, 3200.0 - (ocr - 4) * 300))", 0), "count", "From the cash rate", "Housing"),
        _row("Price per m2 (3 bed)", N("m_price / 150.0", 0), "NZD", "Median price per square metre", "Housing"),
        _row("Housing Supply Deficit Score", N("supply", 1), "pts", "Supply deficit score", "Housing"),
        _row("Property Type - Houses", "68.0", "%", "Share of consents", "Housing", "ci WHERE consents > 0"),
        _row("Property Type - Apartments", "17.0", "%", "Share of consents", "Housing", "ci WHERE consents > 0"),
        _row("Property Type - Townhouses", "15.0", "%", "Share of consents", "Housing", "ci WHERE consents > 0"),
        _row("Median Price - {region}", "price", "NZD", "Price estimate for {region}", "Housing", "rp")],
    "tourism": [
        _row("Tourism Pressure Index", N("pressure", 1), "pts", "Tourism pressure", "Tourism"),
        _row("Airbnb Share of Rentals", N("LEAST(30.0, pressure * 0.25 + 5)", 1), "%", "Short-stay share", "Tourism"),
        _row("Tourism to Rent Lag", N("GREATEST(1, LEAST(8, 4.0 + t_yoy * 0.5))", 0), "months", "Lag from tourism to rents", "Tourism"),
        _row("Visitor Seasonality Strength", N("season", 1), "ratio", "Peak to low ratio", "Tourism"),
        _row("Visitors x DOM Correlation", N("-0.3 - abs(pressure / 100.0) * 0.3", 2), "r", "Visitors vs days on market", "Tourism")],
    "macro": [
        _row("Current OCR", N("ocr", 2), "%", "Official cash rate", "Macro"),
        _row("OCR vs 10y Average", N("ocr - 3.44", 2), "pp", "Cash rate minus 10-year average", "Macro"),
        _row("Mortgage Rate 1Y Fixed", N("ocr + 2.0", 2), "%", "Cash rate + 2.0", "Macro"),
        _row("Mortgage Rate 2Y Fixed", N("ocr + 1.7", 2), "%", "Cash rate + 1.7", "Macro"),
        _row("Mortgage Rate 5Y Fixed", N("ocr + 2.3", 2), "%", "Cash rate + 2.3", "Macro"),
        _row("Monthly Mortgage Cost ($750k)", N(_ann("ocr + 1.7"), 0), "NZD", "Annuity at the 2Y rate", "Macro"),
        _row("Construction Employment", N("GREATEST(5, LEAST(12, 12.0 - unemp * 0.8))", 1), "%", "From unemployment", "Macro"),
        _row("OCR x Listings Correlation", N("-0.4 - (ocr - 3) * 0.08", 2), "r", "Cash rate vs listings", "Macro"),
        _row("GDP Growth YoY", N("gdp_yoy", 1), "%", "GDP per capita growth", "Macro"),
        _row("Inflation (CPI)", N("infl", 1), "%", "Consumer price inflation", "Macro")],
    "affordability": [
        _row("Years to Buy (National Avg)", N("(SELECT avg(price / NULLIF(income, 0)) FROM rp)", 1), "years", "Mean of regional price / income", "Affordability"),
        _row("Rent Burden (National)", N("weekly * 52 / income * 100.0", 0), "%", "Annual rent / income", "Affordability"),
        _row("Demographic vs Supply Gap", N("supply", 1), "pts", "Supply deficit score", "Affordability"),
        _row("Net Migration (National)", N(f"pop_growth / 100.0 * {NZ_POP}", 0), "people", "Population growth x 5.2M", "Affordability"),
        _row("Rent Burden - {region}", N("weekly * 52 / NULLIF(income, 0) * 100.0", 0), "%", "Annual rent as % of median income in {region}", "Affordability", "rp"),
        _row("Years to Buy - {region}", N("price / NULLIF(income, 0)", 1), "years", "Price / income in {region}", "Affordability", "rp"),
        _row("Affordability Rank - {region}", "row_number() OVER (ORDER BY " + N("price / NULLIF(income, 0)", 1) + " ASC NULLS LAST, region)",
             "rank", "Rank of {region} (1 = most affordable)", "Affordability", "rp")],
    "forecast": [
        _row("12-Month Price Forecast", N(_F, 0), "NZD", "Median price x (1 + growth)", "Forecast"),
        _row("Current Median Price", N("m_price", 0), "NZD", "Median of regional prices", "Forecast"),
        _row("Forecast Growth", N("gdp_yoy", 1), "%", "Growth used", "Forecast"),
        _row("Confidence 80% Lower", N(f"{_F} * (1.0 - {_W} * 1.28)", 0), "NZD", "80% band", "Forecast"),
        _row("Confidence 80% Upper", N(f"{_F} * (1.0 + {_W} * 1.28)", 0), "NZD", "80% band", "Forecast"),
        _row("Confidence 95% Lower", N(f"{_F} * (1.0 - {_W} * 1.96)", 0), "NZD", "95% band", "Forecast"),
        _row("Confidence 95% Upper", N(f"{_F} * (1.0 + {_W} * 1.96)", 0), "NZD", "95% band", "Forecast"),
        _row("OCR +0.5% Price Impact", N("-1.2 * 0.5 * (ocr / 5.0)", 1), "%", "Price change if rates rise", "Forecast"),
        _row("Tourism +20% DOM Impact", N(f"{_DOM} * (1 - 0.15 * 0.20)", 0), "days", "Days on market if tourism rises", "Forecast"),
        _row("Trend Component", N("gdp_yoy", 1), "%", "Trend", "Forecast"),
        _row("Seasonal Component", "1.5", "%", "Seasonal", "Forecast"),
        _row("Divergence Alert Score", N(f"{_GAP} * 3 + mvol * 0.1", 1), "pts", "Divergence from 2% trend", "Forecast"),
        _row("Model Confidence Score", N(f"GREATEST(40, LEAST(90, 80.0 - mvol * 0.3 - {_GAP} * 5))", 0), "pts", "Model confidence", "Forecast")],
}

for _d, _fn in CALC.items():
    query(f"calc_{_d}", with_silver(_CI + "\n" + "\nUNION ALL\n".join(CALC_SQL[_d])))(_fn)


def calc_all(spark, sf) -> DataFrame:
    return reduce(DataFrame.unionByName, [fn(spark, sf).withColumn("dashboard", F.lit(d)) for d, fn in CALC.items()])


_CALC_ALL_SQL = "\nUNION ALL\n".join(f"SELECT *, '{d}' AS dashboard FROM ({' UNION ALL '.join(CALC_SQL[d])})" for d in CALC)

@query("kpi_fill_missing", with_kpis(_CI + f""", calc AS ({_CALC_ALL_SQL}),
good AS (SELECT DISTINCT dashboard FROM kpis WHERE kpi_value IS NOT NULL)
SELECT kpi_name AS name, kpi_value AS value, unit, description, category, source, dashboard, 'sql' AS form FROM kpis WHERE dashboard IN (SELECT dashboard FROM good)
UNION ALL
SELECT name, value, unit, description, category, source, dashboard, 'calculator' FROM calc WHERE dashboard NOT IN (SELECT dashboard FROM good)"""))
def kpi_fill_missing(spark, sf):
    """SQL-form dashboards first; see :func:`fill_missing`."""
    from .q_display import kpis
    return fill_missing(kpis(spark, sf), calc_all(spark, sf))


def fill_missing(k: DataFrame, calc: DataFrame) -> DataFrame:
    """A dashboard of the calculator form is taken only where the SQL form
    is missing or empty (has no value at all), however few rows it has
    (left_anti on the dashboard key + union)."""
    good = k.filter(F.col("kpi_value").isNotNull()).select("dashboard").distinct()
    sql_part = (k.join(good, "dashboard", "left_semi")
                .select(F.col("kpi_name").alias("name"), F.col("kpi_value").alias("value"), "unit", "description",
                        "category", "source", "dashboard", F.lit("sql").alias("form")))
    calc = calc.join(good, "dashboard", "left_anti").withColumn("form", F.lit("calculator"))
    return sql_part.unionByName(calc.select(*sql_part.columns))


@query("kpi_reconcile", with_kpis(_CI + f""", calc AS ({_CALC_ALL_SQL})
SELECT COALESCE(k.dashboard, c.dashboard) AS dashboard, COALESCE(k.kpi_name, c.name) AS name, k.kpi_value AS sql_value, c.value AS calc_value,
  CASE WHEN k.kpi_name IS NULL THEN 'calculator_only' WHEN c.name IS NULL THEN 'sql_only'
       WHEN abs(k.kpi_value - c.value) / NULLIF(abs(k.kpi_value), 0) > 0.01 THEN 'differs' ELSE 'match' END AS status
FROM kpis k FULL OUTER JOIN calc c ON k.dashboard = c.dashboard AND k.kpi_name = c.name"""))
def kpi_reconcile(spark, sf):
    """Reconcile the two KPI forms on (dashboard, name): relative
    difference > 1 % flagged, one-sided names reported."""
    from .q_display import kpis
    k = kpis(spark, sf).select("dashboard", F.col("kpi_name").alias("name"), F.col("kpi_value").alias("sql_value"))
    cl = calc_all(spark, sf).select("dashboard", "name", F.col("value").alias("calc_value"))
    j = k.join(cl, ["dashboard", "name"], "full_outer")
    rel = safe_div(F.abs(F.col("sql_value") - F.col("calc_value")), F.abs(F.col("sql_value")))
    st = (F.when(F.col("sql_value").isNull() & F.col("calc_value").isNotNull(), "calculator_only")
          .when(F.col("calc_value").isNull() & F.col("sql_value").isNotNull(), "sql_only")
          .when(rel > 0.01, "differs").otherwise("match"))
    return j.select("dashboard", "name", "sql_value", "calc_value", st.alias("status"))


# ---------------------------------------------------------------- F32 / F11 / K15
PROXY_BASE_PRICE = 600000.0


@query("regional_proxies", with_silver(_CI + f"""
SELECT region, price, {N('GREATEST(20, LEAST(100, price / NULLIF(income, 0) * 5.5))', 1)} AS pressure,
  {N(f'(price / {PROXY_BASE_PRICE} - 1) * 1.5', 4)} AS momentum FROM rp"""))
def regional_proxies(spark, sf):
    """F32: regional proxies — pressure = clamp(20, 100, price/income·5.5),
    momentum = (price / 600000 − 1)·1.5."""
    rp = region_prices(spark, sf)
    return rp.select("region", "price",
                     num(clamp(safe_div(c("price"), c("income")) * 5.5, 20, 100), 1).alias("pressure"),
                     num((c("price") / PROXY_BASE_PRICE - 1) * 1.5, 4).alias("momentum"))


# Forecast scenarios (name, multiplier).
SCENARIOS = [("base", 1.0), ("optimistic", 1.1), ("stress", 0.85)]


@query("scenario_forecast", with_silver(_CI + ", sc AS (SELECT * FROM (VALUES "
                                        + ", ".join(f"('{n}', {m})" for n, m in SCENARIOS) + ") AS t(scenario, multiplier))\n"
                                        + f"SELECT sc.scenario, {N('m_price * (1.0 + gdp_yoy / 100.0) * sc.multiplier', 0)} AS price_12m FROM ci CROSS JOIN sc"))
def scenario_forecast(spark, sf):
    """scenario multipliers as a literal scenario table cross-joined
    with the one-row forecast input."""
    sc = bounded_broadcast(spark.createDataFrame(SCENARIOS, "scenario string, multiplier double"))
    i = calc_inputs(spark, sf)
    return i.crossJoin(sc).select("scenario", num(c("m_price") * (F.lit(1.0) + c("gdp_yoy") / 100.0) * c("multiplier"), 0)
                                  .alias("price_12m"))
