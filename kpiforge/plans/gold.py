"""Gold KPI tables (K8–K13), long format.

Shape: kpi_name, kpi_value (DOUBLE), unit, description, dashboard,
category [, kpi_id]. ``calculated_at`` is left to the writer (a run
timestamp is not part of the result).

Each dashboard reads its silver tables once: the latest period is a
scalar-subquery filter (pushed into the scan), all national figures come
from one conditional aggregate (latest and previous year side by side
instead of one subquery per KPI), and the one-row result becomes KPI rows
with ``inline(array(struct…))`` — no UNION of re-scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import annuity_payment, clamp, num, safe_div
from . import gold_meta as M
from . import panel
from ..oracle.gold import GOLD_SQL
from ..operators.windows import series_window, yoy_pct
from .features import silver
from .registry import query


def latest(df: DataFrame, year: str = "year", back: int = 0) -> DataFrame:
    """Rows whose year = max(year) − back (scalar subquery)."""
    mx = df.select(F.max(year)).scalar()
    return df.filter(F.col(year) == mx - F.lit(back))


def with_latest_year(df: DataFrame, year: str = "year") -> DataFrame:
    """Attach max(year) as column ``_mx`` via a one-row aggregate (cross
    join with a single row; one scalar computation however often ``_mx``
    is referenced, unlike repeated scalar subqueries)."""
    return df.crossJoin(df.agg(F.max(year).alias("_mx")))


def latest_period(df: DataFrame) -> DataFrame:
    """Rows of the latest (year, quarter) period."""
    key = F.col("year") * 10 + F.col("quarter")
    mx = df.select(F.max(key)).scalar()
    return df.filter(key == mx)


def _label(template: str, region: Column | None) -> Column:
    if "{region}" not in template:
        return F.lit(template)
    pre, post = template.split("{region}")
    return F.concat(F.lit(pre), region, F.lit(post)) if post else F.concat(F.lit(pre), region)


def kpi_rows(df: DataFrame, specs: list[tuple[tuple, Column]], dashboard: str,
             region: Column | None = None, key_year: Column | None = None) -> DataFrame:
    """Turn each input row into one KPI row per spec ((meta), value)."""
    structs = []
    for meta, value in specs:
        if len(meta) == 5:
            key, name, unit, desc, cat = meta
        else:
            key, (name, unit, desc, cat) = None, meta
        fields = [_label(name, region).alias("kpi_name"),
                  value.cast("double").alias("kpi_value"),
                  F.lit(unit).alias("unit"),
                  _label(desc, region).alias("description"),
                  F.lit(dashboard).alias("dashboard"),
                  F.lit(cat).alias("category")]
        if key_year is not None:
            fields.append(F.md5(F.concat(F.lit(key), F.lit("-"), key_year.cast("string"))).alias("kpi_id"))
        structs.append(F.struct(*fields))
    return df.select(F.inline(F.array(*structs)))


def z(x) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0.0))


# ---------------------------------------------------------------- executive
def executive(spark: SparkSession, sf: str) -> DataFrame:
    l = latest(silver(spark, sf, "unified_base"))
    agg = l.groupBy("year").agg(
        F.avg("ocr_value").alias("ocr"), F.avg("supply_deficit_score").alias("supply"),
        F.avg("gdp_per_capita").alias("gdp_pc"), F.avg("gdp_per_capita_yoy_pct").alias("gdp_yoy"),
        F.avg("rate_volatility").alias("vol"), F.avg("tourism_pressure_index").alias("pressure"),
        F.avg("rent_to_income_ratio").alias("rent_ratio"), F.sum("building_consents").alias("consents"))
    infl = panel.macro_panel(spark, sf).select("year", "inflation")
    agg = agg.join(infl, "year", "left")
    vals = [
        num(z("ocr") * 0.30 + z("supply") * 0.35 + z("gdp_pc") * 0.35, 2),
        num("gdp_yoy", 2),
        num(F.lit(100.0) - z("vol"), 2),
        num(z("pressure"), 2),
        num(z("supply"), 2),
        num(z("rent_ratio"), 2),
        num(z("ocr"), 2),
        num(z("inflation"), 2),
        z("consents"),
    ]
    return kpi_rows(agg, list(zip(M.EXECUTIVE, vals)), "executive", key_year=F.col("year"))


# ---------------------------------------------------------------- housing
def housing(spark: SparkSession, sf: str) -> DataFrame:
    ls = latest(silver(spark, sf, "supply_deficit"))
    lr = latest_period(silver(spark, sf, "rent_income"))
    h = M.HOUSING
    regional = kpi_rows(ls, [
        (h[0], num(F.col("building_consents") * M.PRICE_PER_CONSENT, 0)),
        (h[2], z("building_consents")),
        (h[3], z("population_growth")),
    ], "housing", region=F.col("region"))
    s = ls.agg(F.avg("supply_deficit_score").alias("score"))
    r = lr.agg(F.avg("median_weekly_rent").alias("rent"), F.avg("rent_to_income_ratio").alias("ratio"))
    national = kpi_rows(s.crossJoin(r), [
        (h[1], num(z("score"), 2)),
        (h[4], num("rent", 0)),
        (h[5], num(z("ratio"), 1)),
        (h[6], num(clamp(F.lit(55.0) - z("score") * 0.3, 20, 80), 0)),
    ], "housing")
    return regional.unionByName(national)


# ---------------------------------------------------------------- tourism
def tourism(spark: SparkSession, sf: str) -> DataFrame:
    t = with_latest_year(silver(spark, sf, "tourism_pressure"))
    cur = F.col("year") == F.col("_mx")
    prev = F.col("year") == F.col("_mx") - 1
    a = t.filter(F.col("year") >= F.col("_mx") - 1).agg(
        F.avg(F.when(cur, F.col("tourism_pressure_index"))).alias("p_l"),
        F.avg(F.when(prev, F.col("tourism_pressure_index"))).alias("p_p"),
        F.sum(F.when(cur, F.col("visitor_arrivals"))).alias("arr"),
        F.sum(F.when(cur, F.col("tourism_expenditure"))).alias("exp"),
        F.max(F.when(cur, F.col("visitor_arrivals"))).alias("mx_arr"),
        F.min(F.when(cur, F.col("visitor_arrivals"))).alias("mn_arr"))
    lag = silver(spark, sf, "macro_volatility").agg(F.avg("interest_rate_volatility").alias("lag"))
    tm = M.TOURISM
    return kpi_rows(a.crossJoin(lag), [
        (tm[0], num("p_l", 2)),
        (tm[1], num("arr", 4)),
        (tm[2], num("exp", 4)),
        (tm[3], num(z("lag"), 4)),
        (tm[4], num(safe_div(F.col("mx_arr"), F.col("mn_arr")), 2)),
        (tm[5], num(safe_div(F.col("p_l") - z("p_p"), F.col("p_p")) * 100.0, 2)),
    ], "tourism")


# ---------------------------------------------------------------- macro
def macro(spark: SparkSession, sf: str) -> DataFrame:
    lir = latest(silver(spark, sf, "interest_rate"))
    aff = silver(spark, sf, "affordability")
    aff = aff.withColumn("gdp_yoy", yoy_pct("gdp_per_capita", series_window("region", "year")))
    laf = latest(aff)
    arr = latest(silver(spark, sf, "tourism_pressure")).agg(F.sum("visitor_arrivals").alias("arr"))
    mm = M.MACRO
    single = kpi_rows(lir.crossJoin(arr), [
        (mm[0], num(z("ocr_value"), 2)),
        (mm[1], num(F.col("ocr_value") - M.OCR_LONG_RUN, 2)),
        (mm[2], num(z("mortgage_rate_2yr"), 2)),
        (mm[3], num(annuity_payment(F.lit(float(M.LOAN)),
                                    F.coalesce("mortgage_rate_2yr", F.lit(5.0)), M.LOAN_MONTHS), 0)),
        (mm[6], z("ocr_change_bps")),
        (mm[7], num(z("rate_volatility"), 2)),
        (mm[9], num(z("arr"), 4)),
    ], "macro")
    per_region = kpi_rows(laf.crossJoin(lir.select("rate_volatility")), [
        (mm[4], num(z("gdp_yoy"), 2)),
        (mm[5], num(z("gdp_per_capita"), 0)),
        (mm[8], num(F.lit(100.0) - z("rate_volatility") * 5
                    - F.abs(z("gdp_per_capita") - M.GDP_PC_ANCHOR) / 1000.0, 1)),
    ], "macro")
    return single.unionByName(per_region)


# ---------------------------------------------------------------- affordability
def affordability(spark: SparkSession, sf: str) -> DataFrame:
    laf = latest(silver(spark, sf, "affordability"))
    lri = latest_period(silver(spark, sf, "rent_income"))
    am = M.AFFORDABILITY
    r1 = kpi_rows(laf, [(am[0], num(z("price_to_income_ratio"), 1))], "affordability",
                  region=F.col("region"))
    r2 = kpi_rows(lri, [(am[1], num(z("rent_to_income_ratio"), 1)),
                        (am[2], z("median_weekly_rent"))], "affordability", region=F.col("region"))
    a = laf.agg(F.avg("affordability_index").alias("idx"), F.avg("price_to_income_ratio").alias("pti"))
    b = lri.agg(F.avg("rent_to_income_ratio").alias("burden"),
                F.avg(z("rent_inflation_rate")).alias("erosion"))
    nat = kpi_rows(a.crossJoin(b), [
        (am[3], num(z("idx"), 2)),
        (am[4], num(z("pti"), 1)),
        (am[5], num(z("burden"), 1)),
        (am[6], num("erosion", 1)),
    ], "affordability")
    return r1.unionByName(r2).unionByName(nat)


# ---------------------------------------------------------------- forecast
def forecast(spark: SparkSession, sf: str) -> DataFrame:
    u = with_latest_year(silver(spark, sf, "unified_base"))
    cur = F.col("year") == F.col("_mx")
    prev = F.col("year") == F.col("_mx") - 1
    a = u.filter(F.col("year") >= F.col("_mx") - 1).agg(
        F.avg(F.when(cur, F.col("gdp_per_capita"))).alias("g"),
        F.avg(F.when(prev, F.col("gdp_per_capita"))).alias("p"),
        F.avg(F.when(cur, F.col("rate_volatility"))).alias("v"),
        F.avg(F.when(cur, F.col("tourism_pressure_index"))).alias("t"))
    g, p = F.col("g"), F.col("p")
    growth = safe_div(g - p, p)
    fm = M.FORECAST
    return kpi_rows(a, [
        (fm[0], num(z(g) * M.FORECAST_GROWTH, 0)),
        (fm[1], num(F.coalesce(growth * 100.0, F.lit(0.0)), 2)),
        (fm[2], num(z(g) * M.BAND_80[0], 0)),
        (fm[3], num(z(g) * M.BAND_80[1], 0)),
        (fm[4], num(z(g) * M.BAND_95[0], 0)),
        (fm[5], num(z(g) * M.BAND_95[1], 0)),
        (fm[6], num(clamp(F.lit(80.0) - z("v") * 10.0, 40, 90), 1)),
        (fm[7], num(z(g) * M.OCR_SHOCK, 0)),
        (fm[8], num(z("t") * M.TOURISM_SHOCK, 2)),
        (fm[9], num(safe_div(F.abs(z(g) - z(p)), p) * 100.0, 2)),
        (fm[10], F.when(g > p, F.lit(1.0)).otherwise(F.lit(-1.0))),
        (fm[11], num(F.coalesce(F.lit(100.0) - F.abs(growth) * 100.0, F.lit(75.0)), 1)),
    ], "forecast")


GOLD = {"executive": executive, "housing": housing, "tourism": tourism, "macro": macro,
        "affordability": affordability, "forecast": forecast}

for _name, _fn in GOLD.items():
    query(f"gold_{_name}", GOLD_SQL[f"gold_{_name}"])(_fn)

