"""Join, window, aggregate, sort and set operators as named queries
(J7 J12–J16, W5 W12–W17, A7–A11 A17 A21 A22, T1 T5 T6 T8 T9, U4–U6,
F28 F33 F34, M9, K19, S10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import annuity_payment, num, safe_div
from ..operators.aggregates import safe_corr
from ..operators.joins import asof_backward_bucketed
from ..operators.windows import series_window
from ..oracle.gold import with_kpis
from ..oracle.silver import N, with_silver
from ..sources.tables import bounded_broadcast, nation_dim, table
from . import panel
from .features import silver
from .gold import latest, latest_period
from .registry import query


# ------------------------------------------------------------------ J7 as-of
@query("asof_growth", """SELECT e.event_id, e.user_id, e.event_type, p.value AS last_purchase_value,
  p.event_id AS last_purchase_id
FROM events e ASOF LEFT JOIN (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'purchase') p
  ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_growth(spark, sf):
    """For every event, the user's latest purchase at or before it."""
    ev = table(spark, sf, "events", "event_id", "user_id", "event_type", "ts", "value")
    left = ev.select("event_id", "user_id", "event_type", "ts")
    right = (ev.filter(F.col("event_type") == "purchase")
             .select("user_id", F.col("ts").alias("pts"), F.col("value").alias("last_purchase_value"),
                     F.col("event_id").alias("last_purchase_id")))
    out = asof_backward_bucketed(left, right, ["user_id"], "ts", "pts",
                                 ["last_purchase_value", "last_purchase_id"],
                                 bucket=lambda c: F.date_trunc("hour", c))
    return out.select("event_id", "user_id", "event_type", "last_purchase_value", "last_purchase_id")


# ------------------------------------------------------------------ windows
@query("centered_band", with_silver(f"""SELECT year, month, {N('rate', 6)} AS rate,
  {N('avg(rate) OVER w', 6)} AS band_mid,
  {N('avg(rate) OVER w + COALESCE(stddev_samp(rate) OVER w, 0)', 6)} AS band_hi,
  {N('avg(rate) OVER w - COALESCE(stddev_samp(rate) OVER w, 0)', 6)} AS band_lo
FROM rate_panel WINDOW w AS (ORDER BY year, month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"""))
def centered_band(spark, sf):
    """Centred 3-point mean ± sample std (std NULL → 0) of the rate series."""
    r = panel.rate_panel(spark, sf).withColumn("_s", F.lit("rate"))
    w = series_window("_s", ["year", "month"]).rowsBetween(-1, 1)
    mid = F.avg("rate").over(w)
    sd = F.coalesce(F.stddev_samp("rate").over(w), F.lit(0.0))
    return r.select("year", "month", num("rate", 6).alias("rate"), num(mid, 6).alias("band_mid"),
                    num(mid + sd, 6).alias("band_hi"), num(mid - sd, 6).alias("band_lo"))


@query("trend_direction", with_silver(f"""SELECT region,
  CASE WHEN l > f THEN 'up' WHEN l < f THEN 'down' ELSE 'flat' END AS direction,
  {N('(l - f) / NULLIF(f, 0) * 100', 2)} AS change_pct
FROM (SELECT region, arg_min(median_weekly_rent, year * 10 + quarter) AS f,
             arg_max(median_weekly_rent, year * 10 + quarter) AS l FROM rent_income GROUP BY region)"""))
def trend_direction(spark, sf):
    """Sign of last − first point of each region's series, and change %."""
    r = silver(spark, sf, "rent_income")
    t = F.col("year") * 10 + F.col("quarter")
    g = r.groupBy("region").agg(F.min_by("median_weekly_rent", t).alias("f"),
                                F.max_by("median_weekly_rent", t).alias("l"))
    return g.select("region",
                    F.when(F.col("l") > F.col("f"), "up").when(F.col("l") < F.col("f"), "down")
                    .otherwise("flat").alias("direction"),
                    num(safe_div(F.col("l") - F.col("f"), F.col("f")) * 100.0, 2).alias("change_pct"))


@query("spark_scale", with_silver(f"""SELECT region, year, quarter,
  {N('(median_weekly_rent - min(median_weekly_rent) OVER s) / COALESCE(NULLIF(max(median_weekly_rent) OVER s - min(median_weekly_rent) OVER s, 0), 1)', 6)} AS bar
FROM rent_income WINDOW s AS (PARTITION BY region)"""))
def spark_scale(spark, sf):
    """Per-series min–max scaling of points to 0..1 (range 1 when flat)."""
    r = silver(spark, sf, "rent_income")
    s = Window.partitionBy("region")
    mn, mx = F.min("median_weekly_rent").over(s), F.max("median_weekly_rent").over(s)
    rng = F.coalesce(F.nullif(mx - mn, F.lit(0.0)), F.lit(1.0))
    return r.select("region", "year", "quarter", num((F.col("median_weekly_rent") - mn) / rng, 6).alias("bar"))


@query("expanding_growth", with_silver(f"""SELECT region, year, tourism_growth_yoy,
  {N('avg(tourism_growth_yoy) OVER (PARTITION BY region ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 4)} AS mean_growth_to_date
FROM tourism"""))
def expanding_growth(spark, sf):
    """Expanding-window mean of growth per region."""
    t = silver(spark, sf, "tourism_pressure")
    w = series_window("region", "year").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("region", "year", "tourism_growth_yoy",
                    num(F.avg("tourism_growth_yoy").over(w), 4).alias("mean_growth_to_date"))


@query("latest_nonnull", with_silver(f"""SELECT region,
  arg_max(population_growth, year) FILTER (WHERE population_growth IS NOT NULL) AS latest_value,
  max(year) FILTER (WHERE population_growth IS NOT NULL) AS latest_year,
  {N('arg_max(population_growth, year) FILTER (WHERE population_growth IS NOT NULL) - arg_max(prev_growth, year) FILTER (WHERE population_growth IS NOT NULL)', 2)} AS change
FROM (SELECT *, lag(population_growth) OVER (PARTITION BY region ORDER BY year) AS prev_growth FROM supply)
GROUP BY region"""))
def latest_nonnull(spark, sf):
    """Latest non-NULL value of each series, its year, and the change
    from the previous point (``max_by`` over non-NULL rows + ``lag``)."""
    s = silver(spark, sf, "supply_deficit")
    s = s.withColumn("prev_growth", F.lag("population_growth").over(series_window("region", "year")))
    nn = s.filter(F.col("population_growth").isNotNull())
    g = nn.groupBy("region").agg(F.max_by("population_growth", "year").alias("latest_value"),
                                 F.max("year").alias("latest_year"),
                                 F.max_by("prev_growth", "year").alias("_p"))
    return g.select("region", "latest_value", "latest_year",
                    num(F.col("latest_value") - F.col("_p"), 2).alias("change"))


@query("rank_regions", with_silver("""SELECT region, price_to_income_ratio,
  row_number() OVER (ORDER BY price_to_income_ratio ASC NULLS LAST, region) AS rank
FROM affordability WHERE year = (SELECT max(year) FROM affordability)"""))
def rank_regions(spark, sf):
    """Rank 1..n of the latest regions by one measure (ties by name).
    One row per region of the latest year — the frame is bounded by the
    number of regions, so a global ordering window is acceptable here."""
    a = latest(silver(spark, sf, "affordability"))
    w = Window.orderBy(F.col("price_to_income_ratio").asc_nulls_last(), "region")
    return a.select("region", "price_to_income_ratio", F.row_number().over(w).cast("bigint").alias("rank"))


@query("ranking_table", with_silver("""SELECT region, price_to_income_ratio, rank,
  CASE WHEN rank <= 4 THEN 'green' WHEN rank <= 10 THEN 'amber' ELSE 'red' END AS band
FROM (SELECT region, price_to_income_ratio,
        row_number() OVER (ORDER BY price_to_income_ratio ASC NULLS LAST, region) AS rank
      FROM affordability WHERE year = (SELECT max(year) FROM affordability))"""))
def ranking_table(spark, sf):
    """Ordered ranking table with colour bands (rank ≤ 4, ≤ 10)."""
    r = rank_regions(spark, sf)
    return r.withColumn("band", F.when(F.col("rank") <= 4, "green").when(F.col("rank") <= 10, "amber")
                        .otherwise("red")).orderBy("rank")


@query("risk_bands", with_silver("""SELECT band, count(*) AS n_regions,
  array_to_string(list_slice(list(region ORDER BY region), 1, 4), ', ')
    || CASE WHEN count(*) > 4 THEN ' +' || CAST(count(*) - 4 AS VARCHAR) || ' more' ELSE '' END AS label
FROM (SELECT region, CASE WHEN rank <= 4 THEN 'High' WHEN rank <= 10 THEN 'Medium' ELSE 'Low' END AS band
      FROM (SELECT region, row_number() OVER (ORDER BY price_to_income_ratio DESC NULLS LAST, region) AS rank
            FROM affordability WHERE year = (SELECT max(year) FROM affordability)))
GROUP BY band"""))
def risk_bands(spark, sf):
    """T5: regions banded by risk rank; first four names + "+k more"."""
    a = latest(silver(spark, sf, "affordability"))
    w = Window.orderBy(F.col("price_to_income_ratio").desc_nulls_last(), "region")
    r = a.select("region", F.row_number().over(w).alias("rank"))
    b = r.withColumn("band", F.when(F.col("rank") <= 4, "High").when(F.col("rank") <= 10, "Medium")
                     .otherwise("Low"))
    g = b.groupBy("band").agg(F.count(F.lit(1)).alias("n_regions"),
                              F.array_sort(F.collect_list("region")).alias("_names"))
    more = F.when(F.col("n_regions") > 4,
                  F.concat(F.lit(" +"), (F.col("n_regions") - 4).cast("string"), F.lit(" more"))).otherwise("")
    return g.select("band", "n_regions",
                    F.concat(F.concat_ws(", ", F.slice("_names", 1, 4)), more).alias("label"))


# ------------------------------------------------------------------ top-k
@query("top3_pressure", with_silver("""SELECT region, tourism_pressure_index FROM tourism
WHERE year = (SELECT max(year) FROM tourism) ORDER BY tourism_pressure_index DESC, region LIMIT 3"""))
def top3_pressure(spark, sf):
    """Top three regions by pressure (TakeOrderedAndProject)."""
    t = latest(silver(spark, sf, "tourism_pressure"))
    return t.orderBy(F.desc("tourism_pressure_index"), "region").limit(3).select(
        "region", "tourism_pressure_index")


@query("top5_cost", with_silver("""SELECT region, median_weekly_rent,
  row_number() OVER (ORDER BY median_weekly_rent DESC, region) = 1 AS headline
FROM (SELECT * FROM rent_income WHERE year * 10 + quarter = (SELECT max(year * 10 + quarter) FROM rent_income)
      ORDER BY median_weekly_rent DESC, region LIMIT 5)"""))
def top5_cost(spark, sf):
    """Five most expensive regions; the first is the headline."""
    r = latest_period(silver(spark, sf, "rent_income"))
    top = r.orderBy(F.desc("median_weekly_rent"), "region").limit(5)
    w = Window.orderBy(F.desc("median_weekly_rent"), "region")
    return top.select("region", "median_weekly_rent", (F.row_number().over(w) == 1).alias("headline"))


@query("argmax_region", with_silver("""SELECT arg_max(region, (tourism_pressure_index, region)) AS region,
  max(tourism_pressure_index) AS tourism_pressure_index
FROM tourism WHERE year = (SELECT max(year) FROM tourism)"""))
def argmax_region(spark, sf):
    """Region with the highest measure (max_by, ties by name)."""
    t = latest(silver(spark, sf, "tourism_pressure"))
    return t.agg(F.max_by("region", F.struct("tourism_pressure_index", "region")).alias("region"),
                 F.max("tourism_pressure_index").alias("tourism_pressure_index"))


# ------------------------------------------------------------------ aggregates
MACRO_VARS = ["gdp", "inflation", "unemployment", "interest"]


def _band(c):
    return (F.when(c >= 0.7, "strong positive").when(c >= 0.4, "moderate positive")
            .when(c >= 0.1, "weak positive").when(c >= -0.1, "none").when(c >= -0.4, "weak negative")
            .otherwise("strong negative"))


def _pairs():
    return [(a, b) for i, a in enumerate(MACRO_VARS) for b in MACRO_VARS[i + 1:]]


_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, {N(f'covar_pop({a}, {b}) / NULLIF(stddev_pop({a}) * stddev_pop({b}), 0)', 4)} AS corr FROM macro_panel"
    for a, b in _pairs())


@query("corr_matrix", with_silver(f"""SELECT var_a, var_b, corr,
  CASE WHEN corr >= 0.7 THEN 'strong positive' WHEN corr >= 0.4 THEN 'moderate positive'
       WHEN corr >= 0.1 THEN 'weak positive' WHEN corr >= -0.1 THEN 'none'
       WHEN corr >= -0.4 THEN 'weak negative' ELSE 'strong negative' END AS strength
FROM ({_CORR_SQL})"""))
def corr_matrix(spark, sf):
    """All pairwise correlations of the four national indicators in
    one aggregate, stacked to rows and labelled by strength band."""
    m = panel.macro_panel(spark, sf)
    pairs = _pairs()
    one = m.agg(*[num(safe_corr(a, b), 4).alias(f"{a}__{b}") for a, b in pairs])
    stacked = one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(f"{a}__{b}").alias("corr"))
        for a, b in pairs])))
    return stacked.withColumn("strength", _band(F.col("corr")))


@query("cov_seasonality", with_silver(f"""SELECT region, year, count(*) AS n_points,
  {N('stddev_samp(median_weekly_rent) / NULLIF(avg(median_weekly_rent), 0)', 6)} AS cv,
  CASE WHEN count(*) >= 2 AND min(median_weekly_rent) > 0 THEN {N('max(median_weekly_rent) / min(median_weekly_rent)', 4)} END AS peak_to_trough
FROM rent_income GROUP BY region, year"""))
def cov_seasonality(spark, sf):
    """Seasonality per region-year: coefficient of variation
    (std/mean) and peak-to-trough ratio (needs ≥2 points and a positive low)."""
    r = silver(spark, sf, "rent_income")
    g = r.groupBy("region", "year").agg(
        F.count(F.lit(1)).alias("n_points"),
        num(safe_div(F.stddev_samp("median_weekly_rent"), F.avg("median_weekly_rent")), 6).alias("cv"),
        F.min("median_weekly_rent").alias("_mn"), F.max("median_weekly_rent").alias("_mx"))
    ok = (F.col("n_points") >= 2) & (F.col("_mn") > 0)
    return g.select("region", "year", "n_points", "cv",
                    F.when(ok, num(F.col("_mx") / F.col("_mn"), 4)).alias("peak_to_trough"))


@query("value_counts", """SELECT event_type, count(*) AS n FROM events GROUP BY event_type""")
def value_counts(spark, sf):
    """Counts by key."""
    return table(spark, sf, "events", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("distinct_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM orders" for c in ORDER_COLS))
def distinct_counts(spark, sf):
    """A10: exact distinct count per column. The table is unpivoted to
    (column, value) text pairs and counted with one distinct aggregate, so
    wide tables cost one shuffle instead of one job per column."""
    o = table(spark, sf, "orders", *ORDER_COLS)
    pairs = o.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in ORDER_COLS]))
        .alias("p")).select("p.*")
    return pairs.groupBy("column_name").agg(F.count_distinct("v").alias("n_distinct"))


LINE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("null_dup_score", f"""SELECT n_rows, n_duplicates, null_cells,
  {N('1 - null_penalty - CASE WHEN n_duplicates > 0 THEN 0.05 ELSE 0 END', 6)} AS quality_score
FROM (SELECT count(*) AS n_rows,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS n_duplicates,
        {' + '.join(f'count_if({c} IS NULL)' for c in LINE_COLS)} AS null_cells,
        ({' + '.join(f'count_if({c} IS NULL)' for c in LINE_COLS)}) / count(*) * 0.1 AS null_penalty
      FROM lineitem)""")
def null_dup_score(spark, sf):
    """Duplicate rows and a null-based quality score
    1 − Σ(nulls/n · 0.1) − 0.05 if any duplicate."""
    li = table(spark, sf, "lineitem", *LINE_COLS)
    stats = li.agg(F.count(F.lit(1)).alias("n_rows"),
                   reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in LINE_COLS]).alias("null_cells"))
    dups = (li.groupBy(*LINE_COLS).agg(F.count(F.lit(1)).alias("_c"))
            .agg(F.sum(F.col("_c") - 1).alias("n_duplicates")))
    j = stats.crossJoin(dups)
    pen = F.col("null_cells") / F.col("n_rows") * 0.1
    return j.select("n_rows", F.coalesce("n_duplicates", F.lit(0)).cast("bigint").alias("n_duplicates"), "null_cells",
                    num(F.lit(1.0) - pen - F.when(F.col("n_duplicates") > 0, 0.05).otherwise(0.0), 6)
                    .alias("quality_score"))


@query("latest_year", with_silver("""SELECT max(year) AS latest_year FROM (
  SELECT year FROM affordability UNION ALL SELECT year FROM interest_rate UNION ALL SELECT year FROM tourism
  UNION ALL SELECT year FROM supply UNION ALL SELECT year FROM rent_income UNION ALL SELECT year FROM macro_volatility)"""))
def latest_year(spark, sf):
    """Latest year over all feature tables."""
    names = ["affordability", "interest_rate", "tourism_pressure", "supply_deficit", "rent_income",
             "macro_volatility"]
    u = reduce(DataFrame.unionByName, [silver(spark, sf, n).select("year") for n in names])
    return u.agg(F.max("year").alias("latest_year"))


_ART = ["affordability", "interest_rate", "tourism_pressure", "supply_deficit", "rent_income", "macro_volatility"]
_ART_SQL = {"affordability": "affordability", "interest_rate": "interest_rate", "tourism_pressure": "tourism",
            "supply_deficit": "supply", "rent_income": "rent_income", "macro_volatility": "macro_volatility"}


@query("artifact_counts", with_silver("SELECT COALESCE(artifact, 'TOTAL') AS artifact, count(*) AS n_rows FROM ("
                                      + " UNION ALL ".join(f"SELECT '{a}' AS artifact FROM {_ART_SQL[a]}" for a in _ART)
                                      + ") GROUP BY ROLLUP (artifact)"))
def artifact_counts(spark, sf):
    """Rows per feature table plus the total (ROLLUP)."""
    u = reduce(DataFrame.unionByName, [silver(spark, sf, a).select(F.lit(a).alias("artifact")) for a in _ART])
    return (u.rollup("artifact").agg(F.count(F.lit(1)).alias("n_rows"))
            .select(F.coalesce("artifact", F.lit("TOTAL")).alias("artifact"), "n_rows"))


# ------------------------------------------------------------------ joins
@query("common_year_ratio", with_silver(f"""SELECT m.year,
  CASE WHEN c.n >= 10 THEN {N('m.gdp / NULLIF(p.population, 0)', 4)} ELSE {N('m.gdp', 4)} END AS value,
  c.n >= 10 AS is_ratio
FROM macro_panel m JOIN nat_pop p ON m.year = p.year CROSS JOIN
  (SELECT count(*) AS n FROM macro_panel m2 JOIN nat_pop p2 ON m2.year = p2.year) c"""))
def common_year_ratio(spark, sf):
    """Ratio of two series over their common years, only when there
    are at least 10 of them; otherwise the numerator alone."""
    return common_ratio(panel.macro_panel(spark, sf).select("year", "gdp"),
                        panel.national_population(panel.order_panel(spark, sf)), "gdp", "population")


def common_ratio(m: DataFrame, p: DataFrame, over: str, under: str, min_common: int = 10) -> DataFrame:
    """(year, value, is_ratio) of the common years of two series."""
    j = m.join(p, "year")
    j = j.crossJoin(j.agg(F.count(F.lit(1)).alias("_n")))                # one row
    ok = F.col("_n") >= min_common
    return j.select("year", F.when(ok, num(safe_div(F.col(over), F.col(under)), 4))
                    .otherwise(num(over, 4)).alias("value"), ok.alias("is_ratio"))


def _raw_feature_names(spark, sf):
    """Feature names as a map layer would label them ("Nation 3 Region")."""
    n = nation_dim(spark, sf)
    return n.select(F.concat(F.initcap(F.regexp_replace("n_name", "_", " ")), F.lit(" Region")).alias("raw_name"))


def _normalize(c):
    return F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"\s+REGION$", ""), r"\s+", "_")


@query("name_normalize", """WITH raw AS (SELECT upper(substr(n_name, 1, 1)) || lower(substr(replace(n_name, '_', ' '), 2)) || ' Region' AS raw_name FROM nation),
canon AS (SELECT DISTINCT n_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT raw_name, region, true AS known FROM raw JOIN canon ON regexp_replace(regexp_replace(upper(trim(raw_name)), '\\s+REGION$', ''), '\\s+', '_', 'g') = region
UNION ALL
SELECT raw_name, NULL AS region, false AS known FROM raw WHERE regexp_replace(regexp_replace(upper(trim(raw_name)), '\\s+REGION$', ''), '\\s+', '_', 'g') NOT IN (SELECT region FROM canon)""")
def name_normalize(spark, sf):
    """Raw feature name → canonical region; unknown names reported
    (left_anti), not kept."""
    raw = _raw_feature_names(spark, sf).withColumn("_k", _normalize(F.col("raw_name")))
    canon = bounded_broadcast(panel.order_panel(spark, sf).select("region").distinct())
    kept = raw.join(canon, raw._k == canon.region).select("raw_name", "region", F.lit(True).alias("known"))
    unknown = (raw.join(canon, raw._k == canon.region, "left_anti")
               .select("raw_name", F.lit(None).cast("string").alias("region"), F.lit(False).alias("known")))
    return kept.unionByName(unknown)


@query("key_coverage", """WITH ds AS (SELECT DISTINCT n_name AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE year(l_shipdate) = (SELECT max(year(l_shipdate)) FROM lineitem)),
geo AS (SELECT n_name AS region FROM nation)
SELECT 'missing_in_geo' AS issue, region FROM ds WHERE region NOT IN (SELECT region FROM geo)
UNION ALL SELECT 'missing_in_data', region FROM geo WHERE region NOT IN (SELECT region FROM ds)
UNION ALL SELECT 'duplicate_in_geo', region FROM geo GROUP BY region HAVING count(*) > 1""")
def key_coverage(spark, sf):
    """Two-way key coverage (left_anti both ways) and duplicates."""
    t = latest(panel.tourism_panel(spark, sf))
    return coverage_issues(t.select("region"), nation_dim(spark, sf).select(F.col("n_name").alias("region")))


def coverage_issues(data: DataFrame, geo: DataFrame) -> DataFrame:
    """(issue, region): regions of one side that the other lacks, and
    regions that the map has twice."""
    ds = data.distinct()
    a = ds.join(geo, "region", "left_anti").select(F.lit("missing_in_geo").alias("issue"), "region")
    b = geo.distinct().join(ds, "region", "left_anti").select(F.lit("missing_in_data").alias("issue"), "region")
    d = (geo.groupBy("region").count().filter("count > 1")
         .select(F.lit("duplicate_in_geo").alias("issue"), "region"))
    return a.unionByName(b).unionByName(d)


# Per-metric defaults for regions with no KPI row.
GEO_DEFAULTS = {"affordability_index": 50.0, "price_to_income_ratio": 8.0, "building_consents": 0.0}


@query("geo_join", with_silver("""SELECT n.n_name AS region,
  COALESCE(a.affordability_index, 50.0) AS affordability_index,
  COALESCE(a.price_to_income_ratio, 8.0) AS price_to_income_ratio,
  CAST(COALESCE(s.building_consents, 0) AS DOUBLE) AS building_consents
FROM nation n
LEFT JOIN (SELECT * FROM affordability WHERE year = (SELECT max(year) FROM affordability)) a ON a.region = n.n_name
LEFT JOIN (SELECT * FROM supply WHERE year = (SELECT max(year) FROM supply)) s ON s.region = n.n_name"""))
def geo_join(spark, sf):
    """Every map feature gets its KPI values, with per-metric defaults."""
    geo = nation_dim(spark, sf).select(F.col("n_name").alias("region"))
    a = latest(silver(spark, sf, "affordability")).select("region", "affordability_index", "price_to_income_ratio")
    s = latest(silver(spark, sf, "supply_deficit")).select("region", "building_consents")
    j = geo.join(a, "region", "left").join(s, "region", "left")
    return j.select("region", *[F.coalesce(F.col(k).cast("double"), F.lit(v)).alias(k) for k, v in GEO_DEFAULTS.items()])


_LON = "(166.0 + 0.4 * n_nationkey)"
_LAT = "(-47.0 + 0.5 * n_regionkey)"


def _pt(dx, dy):
    return f"[{N(f'{_LON} + ({dx})', 6)}, {N(f'{_LAT} + ({dy})', 6)}]"


@query("bbox_polygons", f"""SELECT n_nationkey, n_name,
  substr(replace(replace(upper(n_name), chr(39), ''), '-', '_'), 1, 10) AS region_code,
  {N(_LON, 6)} AS lon, {N(_LAT, 6)} AS lat,
  [{_pt(-0.5, -0.3)}, {_pt(0.5, -0.3)}, {_pt(0.5, 0.3)}, {_pt(-0.5, 0.3)}, {_pt(-0.5, -0.3)}] AS ring
FROM nation""")
def bbox_polygons(spark, sf):
    """Fallback geometry — a closed 5-point box (±0.5 lon, ±0.3 lat)
    around a centroid, and a region code (upper, drop "'", '-'→'_', 10 chars).
    The centroid here is a rule over the nation and region keys."""
    n = nation_dim(spark, sf)
    lon = F.lit(166.0) + F.lit(0.4) * F.col("n_nationkey")
    lat = F.lit(-47.0) + F.lit(0.5) * F.col("n_regionkey")
    pt = lambda dx, dy: F.array(num(lon + F.lit(dx), 6), num(lat + F.lit(dy), 6))
    ring = F.array(pt(-0.5, -0.3), pt(0.5, -0.3), pt(0.5, 0.3), pt(-0.5, 0.3), pt(-0.5, -0.3))
    code = F.substring(F.regexp_replace(F.regexp_replace(F.upper("n_name"), "'", ""), "-", "_"), 1, 10)
    return n.select("n_nationkey", "n_name", code.alias("region_code"), num(lon, 6).alias("lon"),
                    num(lat, 6).alias("lat"),
                    ring.alias("ring"))


# Price defaults and per-segment multipliers (ours).
DEFAULT_PRICE = 600000.0
SEGMENT_FACTOR = [("AUTOMOBILE", 1.05), ("BUILDING", 1.10), ("FURNITURE", 0.95), ("HOUSEHOLD", 1.0),
                  ("MACHINERY", 0.90)]


@query("suburb_prices", with_silver(f"""SELECT c.c_custkey,
  {N('COALESCE(r.income * 9, 600000.0) * COALESCE(f.factor, 1.0)', 0)} AS price
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT region, income FROM order_panel WHERE year = (SELECT max(year) FROM order_panel)) r ON r.region = n.n_name
LEFT JOIN (VALUES {", ".join(f"('{s}', {f})" for s, f in SEGMENT_FACTOR)}) AS f(segment, factor) ON f.segment = c.c_mktsegment"""))
def suburb_prices(spark, sf):
    """Unit (customer) → group (segment) → region price × factor, with
    default price 600000 and factor 1.0; both lookups are small broadcasts."""
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    n = nation_dim(spark, sf)
    op = panel.order_panel(spark, sf)
    price = latest(op).select("region", (F.col("income") * 9).alias("rprice"))
    fac = bounded_broadcast(spark.createDataFrame(SEGMENT_FACTOR, "segment string, factor double"))
    j = (c.join(n, c.c_nationkey == n.n_nationkey)
         .join(bounded_broadcast(price), F.col("n_name") == price.region, "left")
         .join(fac, c.c_mktsegment == fac.segment, "left"))
    return j.select("c_custkey", num(F.coalesce("rprice", F.lit(DEFAULT_PRICE)) * F.coalesce("factor", F.lit(1.0)), 0)
                    .alias("price"))


# ------------------------------------------------------------------ sets / dedup
@query("set_compare", """WITH expected AS (SELECT n_name AS region FROM nation),
actual AS (SELECT DISTINCT n_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders))
SELECT 'missing' AS kind, region FROM (SELECT region FROM expected EXCEPT SELECT region FROM actual)
UNION ALL SELECT 'unexpected', region FROM (SELECT region FROM actual EXCEPT SELECT region FROM expected)
UNION ALL SELECT 'both', region FROM (SELECT region FROM expected INTERSECT SELECT region FROM actual)""")
def set_compare(spark, sf):
    """U4: set difference and intersection of expected vs present keys."""
    exp = nation_dim(spark, sf).select(F.col("n_name").alias("region"))
    act = latest(panel.order_panel(spark, sf)).select("region").distinct()
    return (exp.exceptAll(act).distinct().select(F.lit("missing").alias("kind"), "region")
            .unionByName(act.subtract(exp).select(F.lit("unexpected").alias("kind"), "region"))
            .unionByName(exp.intersect(act).select(F.lit("both").alias("kind"), "region")))


@query("distinct_subset", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def distinct_subset(spark, sf):
    """Distinct on a key subset (no order needed → dropDuplicates)."""
    return table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").dropDuplicates()


@query("dedup_latest", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate, l_extendedprice
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_latest(spark, sf):
    """Keep the latest row per (order, line) with a unique tiebreak."""
    from ..operators.windows import dedup_latest as dd
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
               "l_extendedprice", "l_quantity")
    out = dd(li, ["l_orderkey", "l_linenumber"],
             [F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"), "l_extendedprice")


def content_hash(cols: list[str]) -> F.Column:
    """sha256 (hex) over the key-sorted JSON of the record (NULL fields
    kept, so records differing by a NULL field differ). Show its first 16
    characters; group on all of it."""
    s = F.struct(*[F.col(c) for c in sorted(cols)])
    return F.sha2(F.to_json(s, {"ignoreNullFields": "false"}), 256)


@query("dedup_content_hash", """SELECT min(doc_id) AS doc_id, count(*) - 1 AS n_removed
FROM documents GROUP BY text, lang, source""")
def dedup_content_hash(spark, sf):
    """Content-hash dedup over whole records: keep the first (lowest id)
    record of each hash, report how many copies were removed. The grouping
    is on the whole 256-bit hash (as 32 bytes), so the shuffle moves that
    instead of the text and no distinct record is taken for a copy."""
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    h = d.select("doc_id", F.unhex(content_hash(["text", "lang", "source"])).alias("h"))
    return h.groupBy("h").agg(F.min("doc_id").alias("doc_id"), (F.count(F.lit(1)) - 1).alias("n_removed")).drop("h")


# ------------------------------------------------------------------ bands / progress
@query("value_bands", with_silver("""SELECT region, price_to_income_ratio,
  CASE WHEN price_to_income_ratio < 5 THEN 'affordable' WHEN price_to_income_ratio < 8 THEN 'moderate' ELSE 'severe' END AS affordability_band,
  CASE WHEN t.tourism_pressure_index < 40 THEN 'low' WHEN t.tourism_pressure_index < 60 THEN 'moderate'
       WHEN t.tourism_pressure_index < 80 THEN 'high' ELSE 'very high' END AS pressure_band
FROM (SELECT * FROM affordability WHERE year = (SELECT max(year) FROM affordability)) a
JOIN (SELECT region AS r2, tourism_pressure_index FROM tourism WHERE year = (SELECT max(year) FROM tourism)) t ON a.region = t.r2"""))
def value_bands(spark, sf):
    """value bands — affordability (<5, <8) and pressure (<40, <60, <80)."""
    a = latest(silver(spark, sf, "affordability")).select("region", "price_to_income_ratio")
    t = latest(silver(spark, sf, "tourism_pressure")).select("region", "tourism_pressure_index")
    j = a.join(t, "region")
    r, p = F.col("price_to_income_ratio"), F.col("tourism_pressure_index")
    return j.select("region", "price_to_income_ratio",
                    F.when(r < 5, "affordable").when(r < 8, "moderate").otherwise("severe").alias("affordability_band"),
                    F.when(p < 40, "low").when(p < 60, "moderate").when(p < 80, "high").otherwise("very high")
                    .alias("pressure_band"))


@query("progress_pct", with_kpis(f"""SELECT kpi_name, dashboard,
  {N('''CASE WHEN contains(lower(kpi_name), 'rate') THEN LEAST(100, COALESCE(TRY_CAST(kpi_value AS DOUBLE), 0))
       WHEN contains(lower(kpi_name), 'score') OR contains(lower(kpi_name), 'index') THEN GREATEST(0, LEAST(100, COALESCE(TRY_CAST(kpi_value AS DOUBLE), 0)))
       WHEN contains(lower(kpi_name), 'deficit') OR contains(lower(kpi_name), 'gap') THEN LEAST(100, COALESCE(TRY_CAST(kpi_value AS DOUBLE), 0) * 10)
       ELSE GREATEST(0, LEAST(100, COALESCE(TRY_CAST(kpi_value AS DOUBLE), 0))) END''', 2)} AS progress
FROM kpis"""))
def progress_pct(spark, sf):
    """progress-bar percentage by KPI name class (rate cap 100;
    score/index clamp 0–100; deficit/gap ×10 cap 100; bad value → 0)."""
    from .q_display import kpis
    k = kpis(spark, sf)
    v = F.coalesce(F.col("kpi_value").try_cast("double"), F.lit(0.0))
    n = F.lower("kpi_name")
    p = (F.when(n.contains("rate"), F.least(F.lit(100.0), v))
         .when(n.contains("score") | n.contains("index"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)))
         .when(n.contains("deficit") | n.contains("gap"), F.least(F.lit(100.0), v * 10))
         .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), v))))
    return k.select("kpi_name", "dashboard", num(p, 2).alias("progress"))


@query("fast_slow_split", with_silver("""SELECT
  COALESCE(array_to_string(list_sort(list(region) FILTER (WHERE tourism_growth_yoy <= 4)), ','), '') AS fast,
  COALESCE(array_to_string(list_sort(list(region) FILTER (WHERE tourism_growth_yoy > 6)), ','), '') AS slow
FROM tourism WHERE year = (SELECT max(year) FROM tourism)"""))
def fast_slow_split(spark, sf):
    """regions split into fast (≤ 4) and slow (> 6) lists."""
    t = latest(silver(spark, sf, "tourism_pressure"))
    g = F.col("tourism_growth_yoy")
    return t.agg(F.concat_ws(",", F.array_sort(F.collect_list(F.when(g <= 4, F.col("region"))))).alias("fast"),
                 F.concat_ws(",", F.array_sort(F.collect_list(F.when(g > 6, F.col("region"))))).alias("slow"))


# ------------------------------------------------------------------ M9 trend line
@query("trend_line_grid", with_silver(f""", s AS (SELECT (year - 1995) * 12 + month AS t, rate FROM rate_panel),
fit AS (SELECT regr_slope(rate, t) AS b, regr_intercept(rate, t) AS a, min(t) AS lo, max(t) AS hi FROM s)
SELECT i AS point, {N('lo + i * (hi - lo) / 49.0', 6)} AS x, {N('a + b * (lo + i * (hi - lo) / 49.0)', 6)} AS y
FROM fit, range(0, 50) AS g(i)"""))
def trend_line_grid(spark, sf):
    """M9: least-squares trend line over the rate series, on 50 grid points."""
    r = panel.rate_panel(spark, sf).select(((F.col("year") - 1995) * 12 + F.col("month")).alias("t"), "rate")
    fit = r.agg(F.regr_slope("rate", "t").alias("b"), F.regr_intercept("rate", "t").alias("a"),
                F.min("t").alias("lo"), F.max("t").alias("hi"))
    g = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("point"))
    x = F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / 49.0
    return g.select(F.col("point").cast("bigint").alias("point"), num(x, 6).alias("x"),
                    num(F.col("a") + F.col("b") * x, 6).alias("y"))


# ------------------------------------------------------------------ K19 documented KPIs
@query("kpi_documented", with_silver(f""", s AS (
  SELECT region, year, building_consents, population, population - lag(population) OVER (PARTITION BY region ORDER BY year) AS formation
  FROM supply),
r AS (SELECT region, year, avg(median_weekly_rent) AS rent, stddev_samp(median_weekly_rent) / NULLIF(avg(median_weekly_rent), 0) AS cv
      FROM rent_income GROUP BY region, year),
ir AS (SELECT year, mortgage_rate_2yr FROM interest_rate)
SELECT a.region, a.year,
  {N('s.building_consents / NULLIF(s.formation, 0)', 4)} AS housing_supply_ratio,
  {N('a.gdp_per_capita / NULLIF(r.rent * 52, 0)', 4)} AS price_to_rent_ratio,
  {N('r.rent * 52 / NULLIF(a.gdp_per_capita, 0) * 100', 4)} AS rental_yield_pct,
  {N('(CASE WHEN ir.mortgage_rate_2yr / 100 / 12 = 0 THEN a.gdp_per_capita / 360 ELSE a.gdp_per_capita * (ir.mortgage_rate_2yr / 100 / 12) * POW(1 + ir.mortgage_rate_2yr / 100 / 12, 360) / (POW(1 + ir.mortgage_rate_2yr / 100 / 12, 360) - 1) END) / NULLIF(a.median_income / 12, 0) * 100', 2)} AS debt_service_pct,
  {N('r.cv', 6)} AS rent_seasonality_cv
FROM affordability a
LEFT JOIN s ON s.region = a.region AND s.year = a.year
LEFT JOIN r ON r.region = a.region AND r.year = a.year
LEFT JOIN ir ON ir.year = a.year
WHERE a.year = (SELECT max(year) FROM affordability)"""))
def kpi_documented(spark, sf):
    """The documented formulas — supply ratio (consents / household
    formation), price-to-rent, rental yield, debt service (annuity / monthly
    income), rent seasonality (std/mean) — per region, latest year."""
    wp = series_window("region", "year")
    s = silver(spark, sf, "supply_deficit").select(
        "region", "year", "building_consents", (F.col("population") - F.lag("population").over(wp)).alias("formation"))
    r = (silver(spark, sf, "rent_income").groupBy("region", "year")
         .agg(F.avg("median_weekly_rent").alias("rent"),
              safe_div(F.stddev_samp("median_weekly_rent"), F.avg("median_weekly_rent")).alias("cv")))
    ir = silver(spark, sf, "interest_rate").select("year", "mortgage_rate_2yr")
    a = latest(silver(spark, sf, "affordability"))
    j = a.join(s, ["region", "year"], "left").join(r, ["region", "year"], "left").join(ir, "year", "left")
    pay = annuity_payment(F.col("gdp_per_capita"), F.col("mortgage_rate_2yr"), 360)
    return j.select("region", "year",
                    num(safe_div(F.col("building_consents"), F.col("formation")), 4).alias("housing_supply_ratio"),
                    num(safe_div(F.col("gdp_per_capita"), F.col("rent") * 52), 4).alias("price_to_rent_ratio"),
                    num(safe_div(F.col("rent") * 52, F.col("gdp_per_capita")) * 100.0, 4).alias("rental_yield_pct"),
                    num(safe_div(pay, F.col("median_income") / 12) * 100.0, 2).alias("debt_service_pct"),
                    num("cv", 6).alias("rent_seasonality_cv"))





# ------------------------------------------------------------------ J11 regional latest
@query("regional_latest", with_silver("""SELECT COALESCE(a.region, t.region, s.region, r.region, k.region) AS region,
  a.affordability_index, a.price_to_income_ratio, t.tourism_pressure_index, s.supply_deficit_score,
  r.median_weekly_rent, k.rent_inflation_rate, ir.ocr_value
FROM (SELECT region, affordability_index, price_to_income_ratio FROM affordability WHERE year = (SELECT max(year) FROM affordability)) a
FULL OUTER JOIN (SELECT region, tourism_pressure_index FROM tourism WHERE year = (SELECT max(year) FROM tourism)) t ON t.region = a.region
FULL OUTER JOIN (SELECT region, supply_deficit_score FROM supply WHERE year = (SELECT max(year) FROM supply)) s ON s.region = COALESCE(a.region, t.region)
FULL OUTER JOIN (SELECT region, median_weekly_rent FROM rent_income WHERE year * 10 + quarter = (SELECT max(year * 10 + quarter) FROM rent_income)) r
  ON r.region = COALESCE(a.region, t.region, s.region)
FULL OUTER JOIN (SELECT region, avg(rent_inflation_rate) AS rent_inflation_rate FROM rent_income WHERE year = (SELECT max(year) FROM rent_income) GROUP BY region) k
  ON k.region = COALESCE(a.region, t.region, s.region, r.region)
CROSS JOIN (SELECT avg(ocr_value) AS ocr_value FROM interest_rate WHERE year = (SELECT max(year) FROM interest_rate)) ir"""))
def regional_latest(spark, sf):
    """One row per region from five latest tables whose keys may be
    missing in any of them (FULL OUTER fold on region; the national rate
    is a one-row cross join)."""
    a = latest(silver(spark, sf, "affordability")).select("region", "affordability_index", "price_to_income_ratio")
    t = latest(silver(spark, sf, "tourism_pressure")).select("region", "tourism_pressure_index")
    s = latest(silver(spark, sf, "supply_deficit")).select("region", "supply_deficit_score")
    r = latest_period(silver(spark, sf, "rent_income")).select("region", "median_weekly_rent")
    k = (latest(silver(spark, sf, "rent_income")).groupBy("region")
         .agg(F.avg("rent_inflation_rate").alias("rent_inflation_rate")))
    ir = latest(silver(spark, sf, "interest_rate")).agg(F.avg("ocr_value").alias("ocr_value"))
    out = reduce(lambda x, y: x.join(y, "region", "full_outer"), [a, t, s, r, k])
    return out.crossJoin(ir).select("region", "affordability_index", "price_to_income_ratio",
                                    "tourism_pressure_index", "supply_deficit_score", "median_weekly_rent",
                                    "rent_inflation_rate", "ocr_value")
