"""KPI table processing for dashboards (K16, F16, F24–F27, T2–T4, A12,
P6–P15, K17, U2) — queries over the combined KPI table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ladders as L
from ..functions.scalar import num
from ..oracle import ladders as SQ
from ..oracle.gold import DASHBOARD_SOURCE, with_kpis
from ..oracle.silver import N, with_silver
from ..sources.tables import bounded_broadcast, table
from .gold import GOLD
from .registry import query
from .store import materialized

KPI_COLS = ["kpi_name", "kpi_value", "unit", "description", "dashboard", "category"]


def build_kpis(spark: SparkSession, sf: str) -> DataFrame:
    parts = [GOLD[d](spark, sf).select(*KPI_COLS).withColumn("source", F.lit(DASHBOARD_SOURCE[d]))
             for d in GOLD]
    return reduce(DataFrame.unionByName, parts)


def kpis(spark: SparkSession, sf: str) -> DataFrame:
    """All six dashboards as one tagged KPI table (written once)."""
    return materialized(spark, sf, "kpis", build_kpis)


def processed(spark: SparkSession, sf: str) -> DataFrame:
    k = kpis(spark, sf)
    k = k.select(*k.columns,
                 L.format_value("kpi_value", "unit").alias("formatted_value"),
                 L.kpi_status("kpi_name", "kpi_value", "category").alias("status"),
                 L.kpi_color("kpi_name", "kpi_value", "category").alias("color"),
                 L.kpi_trend("kpi_name", "kpi_value").alias("trend"),
                 L.kpi_confidence("description", "unit", "category", "source").alias("confidence"))
    return k.withColumn("importance", num(L.kpi_importance("kpi_name", "confidence"), 4))


_PROC_SQL = (f"kp0 AS (SELECT *, {SQ.fmt()} AS formatted_value, {SQ.status()} AS status, {SQ.color()} AS color, {SQ.trend()} AS trend,"
             f" CAST({SQ.confidence()} AS DOUBLE) AS confidence FROM kpis),\n"
             f"kp AS (SELECT *, {N(SQ.importance(), 4)} AS importance FROM kp0)")


def with_proc(select: str) -> str:
    return with_kpis(", " + _PROC_SQL + "\n" + select)


@query("kpi_all_dashboards", with_kpis("SELECT * FROM kpis"))
def kpi_all_dashboards(spark, sf):
    return kpis(spark, sf)


@query("kpi_process", with_proc("SELECT * FROM kp"))
def kpi_process(spark, sf):
    """K16 + T2: format → status → trend → confidence → importance, sorted."""
    return processed(spark, sf).orderBy(F.desc("importance"), "kpi_name", "dashboard")


@query("kpi_status", with_proc("SELECT kpi_name, dashboard, kpi_value, status, color FROM kp"))
def kpi_status(spark, sf):
    return processed(spark, sf).select("kpi_name", "dashboard", "kpi_value", "status", "color")


@query("kpi_trend", with_proc("SELECT kpi_name, dashboard, kpi_value, trend FROM kp"))
def kpi_trend(spark, sf):
    return processed(spark, sf).select("kpi_name", "dashboard", "kpi_value", "trend")


@query("kpi_display", with_proc("SELECT kpi_name, dashboard, unit, kpi_value, formatted_value FROM kp"))
def kpi_display(spark, sf):
    return processed(spark, sf).select("kpi_name", "dashboard", "unit", "kpi_value", "formatted_value")


@query("kpi_importance", with_proc("SELECT kpi_name, dashboard, confidence, importance FROM kp"))
def kpi_importance(spark, sf):
    return processed(spark, sf).select("kpi_name", "dashboard", "confidence", "importance")


@query("kpi_summary", with_proc(f"""SELECT
  (SELECT count(*) FROM kp) AS total_kpis,
  (SELECT min(kpi_value) FROM kp) AS value_min, (SELECT max(kpi_value) FROM kp) AS value_max,
  (SELECT {N('avg(kpi_value)', 6)} FROM kp) AS value_mean, (SELECT {N('median(kpi_value)', 6)} FROM kp) AS value_median,
  (SELECT {N('avg(confidence)', 6)} FROM kp) AS confidence_avg,
  (SELECT min(confidence) FROM kp) AS confidence_min, (SELECT max(confidence) FROM kp) AS confidence_max,
  (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT category || ':' || count(*) AS c FROM kp GROUP BY category)) AS categories,
  (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT status || ':' || count(*) AS c FROM kp GROUP BY status)) AS status_counts"""))
def kpi_summary(spark, sf):
    """One row of totals, value/confidence stats and class counts."""
    p = processed(spark, sf)
    stats = p.agg(F.count(F.lit(1)).alias("total_kpis"),
                  F.min("kpi_value").alias("value_min"), F.max("kpi_value").alias("value_max"),
                  num(F.avg("kpi_value"), 6).alias("value_mean"),
                  num(F.median("kpi_value"), 6).alias("value_median"),
                  num(F.avg("confidence"), 6).alias("confidence_avg"),
                  F.min("confidence").alias("confidence_min"), F.max("confidence").alias("confidence_max"))

    def counts(col, out):
        g = p.groupBy(col).count()
        return g.agg(F.concat_ws(",", F.array_sort(F.collect_list(
            F.concat(F.col(col), F.lit(":"), F.col("count").cast("string"))))).alias(out))
    return stats.crossJoin(counts("category", "categories")).crossJoin(counts("status", "status_counts"))


# Parameters: preferred hero / stats terms per dashboard (ours, stated plainly).
HERO_TERMS = {"executive": ["habitat"], "housing": ["price"], "tourism": ["pressure"],
              "macro": ["ocr"], "affordability": ["affordability"], "forecast": ["forecast"]}
STATS_TERMS = {"executive": ["score", "rate"], "housing": ["national"], "tourism": ["visitor"],
               "macro": ["ocr", "mortgage"], "affordability": ["national"], "forecast": ["confidence"]}


def _match(terms: dict) -> F.Column:
    e = F.lit(False)
    for d, ts in terms.items():
        m = reduce(lambda a, b: a | b, [F.lower("kpi_name").contains(t) for t in ts])
        e = F.when(F.col("dashboard") == d, m).otherwise(e)
    return e


def _match_sql(terms: dict) -> str:
    parts = " ".join(f"WHEN dashboard = '{d}' THEN (" + " OR ".join(f"contains(lower(kpi_name), '{t}')" for t in ts) + ")"
                     for d, ts in terms.items())
    return f"CASE {parts} ELSE false END"


@query("hero_kpi", with_proc(f"""SELECT dashboard, kpi_name, kpi_value FROM (
  SELECT *, row_number() OVER (PARTITION BY dashboard ORDER BY CASE WHEN {_match_sql(HERO_TERMS)} THEN 0 ELSE 1 END, kpi_name) AS rn FROM kp)
WHERE rn = 1"""))
def hero_kpi(spark, sf):
    """First KPI whose name matches the dashboard's terms, else the first."""
    p = processed(spark, sf)
    w = Window.partitionBy("dashboard").orderBy(F.when(_match(HERO_TERMS), 0).otherwise(1), "kpi_name")
    return (p.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .select("dashboard", "kpi_name", "kpi_value"))


@query("stats_pick", with_proc(f"""SELECT dashboard, title, kpi_value, unit FROM (
  SELECT dashboard, CASE WHEN length(kpi_name) > 20 THEN substr(kpi_name, 1, 20) || '...' ELSE kpi_name END AS title,
         kpi_value, unit, row_number() OVER (PARTITION BY dashboard ORDER BY kpi_name) AS rn
  FROM (SELECT *, {_match_sql(STATS_TERMS)} AS m, max(CASE WHEN {_match_sql(STATS_TERMS)} THEN 1 ELSE 0 END) OVER (PARTITION BY dashboard) AS any_m FROM kp)
  WHERE m OR any_m = 0) WHERE rn <= 4"""))
def stats_pick(spark, sf):
    """T4: up to four KPIs matching terms (else the first four), titles cut at 20."""
    p = processed(spark, sf).withColumn("_m", _match(STATS_TERMS))
    p = p.withColumn("_any", F.max(F.col("_m").cast("int")).over(Window.partitionBy("dashboard")))
    c = p.filter(F.col("_m") | (F.col("_any") == 0))
    w = Window.partitionBy("dashboard").orderBy("kpi_name")
    return (c.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 4")
            .select("dashboard", L.truncate_title("kpi_name").alias("title"), "kpi_value", "unit"))


# Technical KPI name → executive label.
LABELS = [
    ("Habitat Intelligence Score", "Habitat Score"),
    ("GDP per Capita YoY", "GDP per Capita Growth"),
    ("Interest Rate Stability", "Rate Stability"),
    ("Tourism-Economy Link", "Tourism-Economy Correlation"),
    ("Housing Supply Pressure", "Housing Supply Stress"),
    ("Rent Inflation Premium", "Rent vs CPI Premium"),
    ("Median House Price Estimate", "Median House Price"),
    ("Average Days on Market", "Days on Market"),
    ("Annual New Listings", "New Listings (Annual)"),
    ("Houses as % of Listings", "House Listing Share"),
    ("Average Price per m²", "Price per m2"),
    ("Housing Supply Gap", "Housing Deficit"),
    ("Tourism Pressure Index", "Tourism Pressure"),
    ("Airbnb Share of Rentals", "Airbnb Rental Share"),
    ("Tourism to Rent Price Lag", "Tourism-to-Rent Lag"),
    ("Visitor Seasonality Strength", "Seasonality Strength"),
    ("Tourism-Housing Market Link", "Tourism-Housing Link"),
    ("Current OCR vs 10y Avg", "OCR vs 10Y Average"),
    ("5yr Mortgage Rate Estimate", "5Y Mortgage Rate"),
    ("Construction Sector Stability", "Construction Stability"),
    ("Home Price to Income Ratio", "Price-to-Income Ratio"),
    ("Rent Burden Benchmark", "Rent Burden"),
    ("Regional Affordability Spread", "Regional Affordability Gap"),
    ("Net Internal Migration", "Net Internal Migration"),
    ("12-Month Price Change Forecast", "12M Price Forecast"),
    ("Forecast Confidence Range", "Forecast Confidence Range"),
    ("Regions with High Forecast Risk", "High-Risk Regions"),
    ("Overall Model Confidence", "Model Confidence"),
]
_LABEL_VALUES = ", ".join("('" + a.replace("'", "''") + "', '" + b.replace("'", "''") + "')" for a, b in LABELS)


@query("label_map", with_kpis(f"""SELECT k.kpi_name, k.dashboard, COALESCE(l.label, k.kpi_name) AS executive_label
FROM kpis k LEFT JOIN (VALUES {_LABEL_VALUES}) AS l(name, label) ON k.kpi_name = l.name"""))
def label_map(spark, sf):
    """Broadcast lookup of executive labels; unknown names kept."""
    labels = bounded_broadcast(spark.createDataFrame(LABELS, "name string, label string"))
    k = kpis(spark, sf)
    return (k.join(labels, k.kpi_name == labels.name, "left")
            .select("kpi_name", "dashboard", F.coalesce("label", "kpi_name").alias("executive_label")))


CATEGORY = "Economic"   # parameter of the category filter


@query("category_filter", with_kpis(f"SELECT * FROM kpis WHERE lower(category) = lower('{CATEGORY}')"))
def category_filter(spark, sf):
    """Case-insensitive category filter."""
    return kpis(spark, sf).filter(F.lower("category") == CATEGORY.lower())


MIN_CONFIDENCE = 70.0


@query("trusted_only", with_proc(f"""SELECT kpi_name, dashboard, source, confidence FROM kp
WHERE confidence >= {MIN_CONFIDENCE} AND NOT {SQ._any("source", L.SOURCE_SYNTHETIC)}"""))
def trusted_only(spark, sf):
    """P10: keep KPIs from trusted sources (confidence ≥ 70, not synthetic)."""
    p = processed(spark, sf)
    from ..functions.scalar import any_term
    return (p.filter((F.col("confidence") >= MIN_CONFIDENCE) & ~any_term("source", L.SOURCE_SYNTHETIC))
            .select("kpi_name", "dashboard", "source", "confidence"))


@query("rename_shape", with_kpis("SELECT kpi_name AS name, kpi_value AS value, unit, description, category, source FROM kpis"))
def rename_shape(spark, sf):
    """SQL gold shape → calculator shape."""
    return (kpis(spark, sf).withColumnsRenamed({"kpi_name": "name", "kpi_value": "value"})
            .select("name", "value", "unit", "description", "category", "source"))


@query("schema_normalize", with_kpis("""SELECT trim(kpi_name) AS name, TRY_CAST(kpi_value AS DOUBLE) AS value,
  COALESCE(trim(unit), '') AS unit, COALESCE(trim(description), '') AS description,
  COALESCE(trim(category), 'general') AS category, COALESCE(trim(source), 'Unknown') AS source,
  'quality' AS detected_schema FROM kpis"""))
def schema_normalize(spark, sf):
    """Canonical KPI shape: trimmed text, numeric value, literals for
    missing fields, tagged with the detected input schema."""
    k = kpis(spark, sf)
    schema = "quality" if "kpi_name" in k.columns and "source" in k.columns else "legacy"
    return k.select(F.trim("kpi_name").alias("name"), F.col("kpi_value").try_cast("double").alias("value"),
                    F.coalesce(F.trim("unit"), F.lit("")).alias("unit"),
                    F.coalesce(F.trim("description"), F.lit("")).alias("description"),
                    F.coalesce(F.trim("category"), F.lit("general")).alias("category"),
                    F.coalesce(F.trim("source"), F.lit("Unknown")).alias("source"),
                    F.lit(schema).alias("detected_schema"))


@query("drop_helper", with_kpis("""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY kpi_name ORDER BY dashboard, kpi_value) AS rn FROM kpis) WHERE rn = 1"""))
def drop_helper(spark, sf):
    """P15 + W5: dedup by name (first by dashboard, value), helper column dropped."""
    k = kpis(spark, sf)
    w = Window.partitionBy("kpi_name").orderBy("dashboard", "kpi_value")
    return k.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


KPI_SQL = ("SELECT dashboard, count(*) AS n_kpis, CAST(ROUND(CAST(avg(kpi_value) AS DECIMAL(38,6)), 2) AS DOUBLE) AS avg_value "
           "FROM kpis GROUP BY dashboard")


@query("kpi_sql", with_kpis(KPI_SQL))
def kpi_sql(spark, sf):
    """Ad-hoc SQL over the KPI table registered as view ``kpis``."""
    kpis(spark, sf).createOrReplaceTempView("kpis")
    return spark.sql(KPI_SQL)


# ------------------------------------------------------------ filters
TIMEFRAME_DAYS = {"3M": 90, "6M": 180, "12M": 360, "1Y": 365, "5Y": 1825}
AS_OF = "2001-08-01"


def timeframe_filter_df(df: DataFrame, ts_col: str, timeframe: str, as_of: str) -> DataFrame:
    """Rows within N·30 days (or the year form) before ``as_of``."""
    days = TIMEFRAME_DAYS[timeframe]
    return df.filter(F.col(ts_col) >= F.date_sub(F.to_date(F.lit(as_of)), days))


@query("timeframe_filter", f"""SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_totalprice
FROM orders WHERE o_orderdate >= DATE '{AS_OF}' - INTERVAL 360 DAY""")
def timeframe_filter(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return (timeframe_filter_df(o, "o_orderdate", "12M", AS_OF)
            .select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
                    "o_totalprice"))


REGION = "NATION_3"


def region_filter_df(df: DataFrame, region: str) -> DataFrame:
    """Region filter with the 'All Regions' passthrough."""
    return df if region == "All Regions" else df.filter(F.col("region") == region)


@query("region_filter", with_silver(f"SELECT * FROM affordability WHERE region = '{REGION}'"))
def region_filter(spark, sf):
    from .features import silver
    return region_filter_df(silver(spark, sf, "affordability"), REGION)


@query("lastn_series", with_silver("""SELECT region, year, quarter, median_weekly_rent FROM (
  SELECT *, row_number() OVER (PARTITION BY region ORDER BY year DESC, quarter DESC) AS rn FROM rent_income) WHERE rn <= 12"""))
def lastn_series(spark, sf):
    """The last 12 points of each region's rent series."""
    from .features import silver
    w = Window.partitionBy("region").orderBy(F.desc("year"), F.desc("quarter"))
    r = silver(spark, sf, "rent_income")
    return (r.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 12")
            .select("region", "year", "quarter", "median_weekly_rent"))


@query("dashboard_filter", with_silver(f"""SELECT u.region, u.year, u.affordability_index,
  COALESCE(r.hero, n.hero) AS hero_value FROM (
    SELECT region, year, affordability_index, row_number() OVER (PARTITION BY region ORDER BY year DESC) AS rn
    FROM unified WHERE region = '{REGION}') u
  CROSS JOIN (SELECT {N('avg(affordability_index)', 2)} AS hero FROM unified WHERE year = (SELECT max(year) FROM unified)) n
  LEFT JOIN (SELECT region, {N('affordability_index', 2)} AS hero FROM unified WHERE year = (SELECT max(year) FROM unified)) r
    ON r.region = u.region
  WHERE u.rn <= 3"""))
def dashboard_filter(spark, sf):
    """Trim the series to the last 3 points, keep one region, and
    replace the national hero value by the region's own latest value."""
    from .features import silver
    from .gold import latest
    u = silver(spark, sf, "unified_base")
    lat = latest(u)
    nat = lat.agg(num(F.avg("affordability_index"), 2).alias("nat_hero"))
    reg = lat.select(F.col("region").alias("_r"), num("affordability_index", 2).alias("reg_hero"))
    w = Window.partitionBy("region").orderBy(F.desc("year"))
    s = region_filter_df(u, REGION).withColumn("_rn", F.row_number().over(w)).filter("_rn <= 3")
    j = s.crossJoin(nat).join(reg, s.region == reg._r, "left")
    return j.select("region", "year", "affordability_index",
                    F.coalesce("reg_hero", "nat_hero").alias("hero_value"))


SPARK_POINTS = 12


@query("dashboard_payload", with_kpis(f""", pl_map AS (
  SELECT dashboard, count(*) AS n_kpis,
         string_agg(kpi_name || '=' || COALESCE(printf('%.2f', {N('kpi_value', 2)}), 'NA'), ';' ORDER BY kpi_name || '=' || COALESCE(printf('%.2f', {N('kpi_value', 2)}), 'NA')) AS kpi_map
  FROM kpis GROUP BY dashboard),
pl_spark AS (SELECT list(v ORDER BY year) AS sparkline FROM (
  SELECT year, {N('avg(affordability_index)', 2)} AS v FROM unified GROUP BY year ORDER BY year DESC LIMIT {SPARK_POINTS})),
pl_top AS (SELECT string_agg(region, ',' ORDER BY tourism_pressure_index DESC, region) AS top3 FROM (
  SELECT region, tourism_pressure_index FROM tourism WHERE year = (SELECT max(year) FROM tourism)
  ORDER BY tourism_pressure_index DESC, region LIMIT 3)),
pl_reg AS (SELECT string_agg(region || '=' || COALESCE(printf('%.1f', {N('affordability_index', 1)}), 'NA'), ';' ORDER BY region || '=' || COALESCE(printf('%.1f', {N('affordability_index', 1)}), 'NA')) AS regional_map
  FROM affordability WHERE year = (SELECT max(year) FROM affordability))
SELECT m.dashboard, m.n_kpis, m.kpi_map,
  CASE WHEN m.dashboard = 'executive' THEN s.sparkline END AS sparkline,
  CASE WHEN m.dashboard = 'executive' THEN t.top3 END AS top3,
  CASE WHEN m.dashboard = 'executive' THEN r.regional_map END AS regional_map
FROM pl_map m CROSS JOIN pl_spark s CROSS JOIN pl_top t CROSS JOIN pl_reg r"""))
def dashboard_payload(spark, sf):
    """The data a dashboard page loads — KPI map by name, and for the
    executive page a national sparkline (last 12 points), the top three
    regions and a regional map. Every list is bounded (KPIs per dashboard,
    years, regions)."""
    from .features import silver
    from .gold import latest
    k = kpis(spark, sf)
    def fmt(col, digits):
        return F.when(F.col(col).isNull(), "NA").otherwise(F.format_string(f"%.{digits}f", num(col, digits)))
    entry = F.concat(F.col("kpi_name"), F.lit("="), fmt("kpi_value", 2))
    m = k.groupBy("dashboard").agg(F.count(F.lit(1)).alias("n_kpis"),
                                   F.concat_ws(";", F.array_sort(F.collect_list(entry))).alias("kpi_map"))
    yearly = (silver(spark, sf, "unified_base").groupBy("year")
              .agg(num(F.avg("affordability_index"), 2).alias("v")))
    last = yearly.orderBy(F.desc("year")).limit(SPARK_POINTS)
    spark_line = last.agg(F.transform(F.array_sort(F.collect_list(F.struct("year", "v"))), lambda s: s["v"])
                          .alias("sparkline"))
    t = latest(silver(spark, sf, "tourism_pressure"))
    top = (t.orderBy(F.desc("tourism_pressure_index"), "region").limit(3)
           .agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("tourism_pressure_index"), F.col("region")))),
                            lambda s: s["region"]).alias("_t"))
           .select(F.concat_ws(",", "_t").alias("top3")))
    a = latest(silver(spark, sf, "affordability"))
    reg = a.agg(F.concat_ws(";", F.array_sort(F.collect_list(
        F.concat(F.col("region"), F.lit("="), fmt("affordability_index", 1))))).alias("regional_map"))
    j = m.crossJoin(spark_line).crossJoin(top).crossJoin(reg)
    ex = F.col("dashboard") == "executive"
    return j.select("dashboard", "n_kpis", "kpi_map", F.when(ex, F.col("sparkline")).alias("sparkline"),
                    F.when(ex, F.col("top3")).alias("top3"), F.when(ex, F.col("regional_map")).alias("regional_map"))


LAST_ROWS = 12


def last_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """P6 without a date column: the last ``n`` rows by the given order
    (distributed top-k; the limit is the feature)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


@query("timeframe_rows", with_silver(f"\nSELECT year, month, {N('rate', 6)} AS rate FROM rate_panel ORDER BY year DESC, month DESC LIMIT {LAST_ROWS}"))
def timeframe_rows(spark, sf):
    """P6 (no date column): the last 12 points of the monthly series."""
    from . import panel
    r = last_rows(panel.rate_panel(spark, sf), LAST_ROWS, ["year", "month"])
    return r.select("year", "month", num("rate", 6).alias("rate"))
