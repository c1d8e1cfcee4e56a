"""DuckDB reference SQL for the panel views, silver features and K7.

Written directly against the base tables, independently of the Spark
plans (plain joins + ``count(distinct)``, DuckDB ``median`` and
``ASOF JOIN``), so agreement is a real check of the Spark rewrites
(pre-aggregation, bracketed median, union-based as-of join).
"""

from __future__ import annotations


def N(expr: str, k: int) -> str:
    """Same normalisation as ``functions.scalar.num``."""
    return f"ROUND(CAST(({expr}) AS DECIMAL(38,6)), {k})::DOUBLE"


REV = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"

PANEL = f"""
order_panel AS (
  SELECT n_name AS region, year(o_orderdate) AS year,
         COUNT(*) AS n_orders,
         SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS order_value,
         COUNT(DISTINCT o_custkey) AS population,
         COUNT_IF(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS consents,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / COUNT(*) AS income
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2),
nat_pop AS (SELECT year, SUM(population) AS population FROM order_panel GROUP BY 1),
tourism_panel AS (
  SELECT n_name AS region, year(l_shipdate) AS year, SUM({REV}) AS spend
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2),
rent_panel AS (
  SELECT n_name AS region, year(l_shipdate) AS year, quarter(l_shipdate) AS quarter,
         median(l_extendedprice / NULLIF(l_quantity, 0)) AS rent
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2, 3),
macro_panel AS (
  SELECT year(l_shipdate) AS year,
         CAST(SUM({REV}) AS DOUBLE) AS gdp,
         CAST(SUM(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) * 100 / COUNT(*) AS inflation,
         CAST(COUNT_IF(l_returnflag = 'R') AS DOUBLE) * 100 / COUNT(*) AS unemployment,
         CAST(SUM(CAST(l_tax AS DECIMAL(18,4))) AS DOUBLE) * 100 / COUNT(*) AS interest
  FROM lineitem GROUP BY 1),
rate_panel AS (
  SELECT year(l_shipdate) AS year, month(l_shipdate) AS month,
         CAST(SUM(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) * 100 / COUNT(*) AS rate
  FROM lineitem GROUP BY 1, 2)"""

AFFORD = f"""
nat_gdp AS (
  SELECT COALESCE(m.year, p.year) AS year, m.gdp / NULLIF(p.population, 0) AS gdp_pc
  FROM macro_panel m FULL OUTER JOIN nat_pop p ON m.year = p.year),
affordability AS (
  SELECT g.year, n.n_name AS region,
         {N('g.gdp_pc', 0)} AS gdp_per_capita,
         {N('i.income', 2)} AS median_income,
         {N('g.gdp_pc / (CASE WHEN i.income > 0 THEN i.income END) * 50.0', 1)} AS affordability_index,
         {N('g.gdp_pc / (CASE WHEN i.income > 0 THEN i.income END)', 4)} AS price_to_income_ratio
  FROM nat_gdp g CROSS JOIN nation n
  LEFT JOIN order_panel i ON i.year = g.year AND i.region = n.n_name
  WHERE g.gdp_pc > 0)"""

AFFORD_NATIONAL = f"""
affordability_national AS (
  SELECT g.year, 'NATIONAL' AS region, {N('g.gdp_pc', 0)} AS gdp_per_capita,
         {N('(g.gdp_pc - s.mn) / (s.mx - s.mn + 1.0) * 100', 1)} AS affordability_index
  FROM nat_gdp g CROSS JOIN (SELECT min(gdp_pc) AS mn, max(gdp_pc) AS mx FROM nat_gdp WHERE gdp_pc > 0) s
  WHERE g.gdp_pc > 0)"""

INTEREST = f"""
ir0 AS (SELECT year, 'NATIONAL' AS region, {N('avg(rate)', 4)} AS ocr_value FROM rate_panel GROUP BY 1),
ir1 AS (
  SELECT year, region, ocr_value, ocr_value AS mortgage_rate_2yr,
         {N('(ocr_value - lag(ocr_value) OVER (PARTITION BY region ORDER BY year)) * 100', 2)} AS ocr_change_bps,
         {N('stddev_samp(ocr_value) OVER (PARTITION BY region ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 4)} AS rate_volatility
  FROM ir0),
interest_rate AS (
  SELECT year, region, ocr_value, mortgage_rate_2yr, ocr_change_bps, rate_volatility,
         {N('rate_volatility / (mx + 0.01) * 100', 1)} AS interest_rate_impact_score
  FROM ir1 CROSS JOIN (SELECT max(rate_volatility) AS mx FROM ir1))"""

SHARES = f"""
shares AS (
  SELECT year, region, population,
         {N('population / SUM(population) OVER ()', 6)} AS share
  FROM order_panel WHERE year = (SELECT max(year) FROM order_panel))"""

TOURISM = f"""
t0 AS (
  SELECT t.region, t.year, {N('CAST(t.spend AS DOUBLE) / 1e6', 4)} AS tourism_expenditure,
         s.share, p.population AS nz_pop, {N('m.unemployment', 4)} AS unemployment_rate
  FROM tourism_panel t LEFT JOIN shares s ON t.region = s.region
  LEFT JOIN nat_pop p ON t.year = p.year LEFT JOIN macro_panel m ON t.year = m.year),
tourism AS (
  SELECT year, region, tourism_expenditure, tourism_expenditure AS visitor_arrivals,
         {N('tourism_expenditure * 1e6 / GREATEST(1.0, COALESCE(share, 0.01) * COALESCE(CAST(nz_pop AS DOUBLE), 5200000.0)) * 10.0', 1)} AS tourism_pressure_index,
         unemployment_rate,
         {N('(tourism_expenditure / NULLIF(lag(tourism_expenditure) OVER (PARTITION BY region ORDER BY year), 0) - 1) * 100', 2)} AS tourism_growth_yoy
  FROM t0)"""

SUPPLY = f"""
pop_growth AS (
  SELECT region, year AS pyear,
         {N('CASE WHEN lag(population) OVER w > 0 THEN (population - lag(population) OVER w) / lag(population) OVER w * 100.0 END', 2)} AS population_growth
  FROM order_panel WINDOW w AS (PARTITION BY region ORDER BY year)),
s0 AS (
  SELECT c.region, c.year, c.consents AS building_consents, p.population, g.population_growth,
         {N('c.consents / GREATEST(1, COALESCE(p.population, 0)) * 1000.0', 2)} AS consents_per_1000_people
  FROM order_panel c
  LEFT JOIN order_panel p ON c.region = p.region AND c.year = p.year
  ASOF LEFT JOIN pop_growth g ON c.region = g.region AND c.year >= g.pyear),
supply AS (
  SELECT year, region, building_consents, population, population_growth, consents_per_1000_people,
         {N('(consents_per_1000_people - mn) / (mx - mn + 0.01) * 100', 1)} AS supply_deficit_score,
         {N('COALESCE(population_growth, 0) - COALESCE(consents_per_1000_people, 0)', 2)} AS housing_supply_gap
  FROM s0 CROSS JOIN (SELECT min(consents_per_1000_people) AS mn, max(consents_per_1000_people) AS mx FROM s0))"""


def _rent_tail(src: str, name: str) -> str:
    return f"""
{name}_1 AS (
  SELECT *, {N('median_weekly_rent * 52', 2)} AS annual_rent,
         {N('(median_weekly_rent / NULLIF(lag(median_weekly_rent) OVER w, 0) - 1) * 100', 2)} AS rent_inflation_rate,
         {N('CASE WHEN first_value(median_weekly_rent) OVER w <= 0 THEN 0 ELSE (median_weekly_rent / NULLIF(first_value(median_weekly_rent) OVER w, 0) - 1) * 100 END', 1)} AS cumulative_rent_pressure
  FROM {src} WINDOW w AS (PARTITION BY region ORDER BY year, quarter)),
{name} AS (
  SELECT year, quarter, region, median_weekly_rent, annual_rent, median_income,
         {N('annual_rent / (CASE WHEN median_income > 0 THEN median_income END) * 100', 1)} AS rent_to_income_ratio,
         general_inflation, rent_inflation_rate,
         {N('COALESCE(rent_inflation_rate, 0) - COALESCE(general_inflation, 0)', 1)} AS affordability_erosion,
         cumulative_rent_pressure
  FROM {name}_1)"""


RENT = f"""
rent_0 AS (
  SELECT r.region, r.year, r.quarter, {N('r.rent', 2)} AS median_weekly_rent,
         {N('i.income', 2)} AS median_income, {N('m.inflation', 4)} AS general_inflation
  FROM rent_panel r LEFT JOIN order_panel i ON r.region = i.region AND r.year = i.year
  LEFT JOIN macro_panel m ON r.year = m.year),""" + _rent_tail("rent_0", "rent_income")

RENT_PROXY = f"""
rentp_0 AS (
  SELECT i.region, i.year, 4 AS quarter, {N('i.income', 2)} AS median_income,
         {N('m.inflation', 4)} AS general_inflation,
         {N(N('i.income', 2) + ' * 0.30 / 52', 0)} AS median_weekly_rent
  FROM order_panel i LEFT JOIN macro_panel m ON i.year = m.year),""" + _rent_tail("rentp_0", "rent_income_proxy")

MACRO_VOL = f"""
mv0 AS (
  SELECT year, 'NATIONAL' AS region, inflation, unemployment, interest,
         (gdp / NULLIF(lag(gdp) OVER (ORDER BY year), 0) - 1) * 100 AS gdp_growth
  FROM macro_panel),
mv1 AS (
  SELECT region, year,
         {N('stddev_samp(gdp_growth) OVER w3', 4)} AS gdp_volatility,
         {N('stddev_samp(inflation) OVER w3', 4)} AS inflation_volatility,
         {N('stddev_samp(unemployment) OVER w3', 4)} AS unemployment_volatility,
         {N('stddev_samp(interest) OVER w3', 4)} AS interest_rate_volatility
  FROM mv0 WINDOW w3 AS (PARTITION BY region ORDER BY year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
mv2 AS (
  SELECT *, 0.4 * gdp_volatility + 0.3 * inflation_volatility + 0.2 * unemployment_volatility
            + 0.1 * interest_rate_volatility AS raw FROM mv1),
macro_volatility AS (
  SELECT region, year, {N('(raw - mn) / (mx - mn + 0.01) * 100', 1)} AS macroeconomic_volatility_index,
         gdp_volatility, inflation_volatility, unemployment_volatility, interest_rate_volatility
  FROM mv2 CROSS JOIN (SELECT min(raw) AS mn, max(raw) AS mx FROM mv2))"""

FEATURES = ",".join([PANEL, AFFORD, INTEREST, SHARES, TOURISM, SUPPLY, RENT.rstrip(), MACRO_VOL])

UNIFIED = f"""
k_t AS (
  SELECT year, {N('SUM(visitor_arrivals)', 4)} AS visitor_arrivals,
         {N('SUM(tourism_expenditure)', 4)} AS tourism_expenditure,
         {N('AVG(tourism_pressure_index)', 2)} AS tourism_pressure_index
  FROM tourism GROUP BY 1),
k_ri AS (
  SELECT year, region, {N('AVG(median_weekly_rent)', 2)} AS median_weekly_rent,
         {N('AVG(rent_to_income_ratio)', 1)} AS rent_to_income_ratio,
         {N('AVG(rent_inflation_rate)', 2)} AS rent_inflation_rate
  FROM rent_income GROUP BY 1, 2),
k_base AS (
  SELECT COALESCE(a.year, ir.year, t.year, s.year, ri.year) AS year,
         COALESCE(a.region, s.region, ri.region) AS region,
         a.gdp_per_capita, a.price_to_income_ratio, a.affordability_index,
         ir.ocr_value, ir.mortgage_rate_2yr, ir.ocr_change_bps, ir.rate_volatility,
         t.visitor_arrivals, t.tourism_expenditure, t.tourism_pressure_index,
         s.building_consents, s.population_growth, s.supply_deficit_score,
         ri.median_weekly_rent, ri.rent_to_income_ratio, ri.rent_inflation_rate
  FROM affordability a
  FULL OUTER JOIN interest_rate ir ON a.year = ir.year
  FULL OUTER JOIN k_t t ON a.year = t.year
  FULL OUTER JOIN supply s ON a.year = s.year AND a.region = s.region
  FULL OUTER JOIN k_ri ri ON a.year = ri.year AND a.region = ri.region),
unified AS (
  SELECT *,
    {N('(gdp_per_capita - lag(gdp_per_capita) OVER w) / NULLIF(lag(gdp_per_capita) OVER w, 0) * 100', 2)} AS gdp_per_capita_yoy_pct,
    {N('affordability_index - lag(affordability_index) OVER w', 2)} AS affordability_index_yoy_change,
    {N('(building_consents - lag(building_consents) OVER w) / NULLIF(lag(building_consents) OVER w, 0) * 100', 2)} AS building_consents_yoy_pct,
    {N('(median_weekly_rent - lag(median_weekly_rent) OVER w) / NULLIF(lag(median_weekly_rent) OVER w, 0) * 100', 2)} AS rent_yoy_pct,
    {N('avg(gdp_per_capita) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 0)} AS gdp_per_capita_3yr_avg,
    {N('avg(affordability_index) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 2)} AS affordability_index_3yr_avg,
    {N('avg(tourism_pressure_index) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 2)} AS tourism_pressure_3yr_avg,
    rank() OVER (PARTITION BY year ORDER BY affordability_index DESC NULLS LAST) AS affordability_rank
  FROM k_base WINDOW w AS (PARTITION BY region ORDER BY year NULLS LAST))"""

ALL_SILVER = FEATURES + "," + AFFORD_NATIONAL + "," + RENT_PROXY.rstrip() + "," + UNIFIED


def with_silver(select: str) -> str:
    """``WITH <all silver CTEs> <select>``; DuckDB drops unused CTEs."""
    return f"WITH {ALL_SILVER}\n{select}"


SILVER_SQL = {
    "panel_orders": "WITH" + PANEL + "\nSELECT region, year, n_orders, CAST(order_value AS DOUBLE) AS order_value, population, consents, "
                    + N("income", 4) + " AS income FROM order_panel",
    "panel_macro": "WITH" + PANEL + f"\nSELECT year, {N('gdp', 2)} AS gdp, {N('inflation', 6)} AS inflation, {N('unemployment', 6)} AS unemployment, {N('interest', 6)} AS interest FROM macro_panel",
    "panel_rent_median": "WITH" + PANEL + f"\nSELECT region, year, quarter, {N('rent', 4)} AS rent FROM rent_panel",
    "feat_affordability": with_silver("SELECT * FROM affordability"),
    "feat_affordability_national": with_silver("SELECT * FROM affordability_national"),
    "feat_interest_rate": with_silver("SELECT * FROM interest_rate"),
    "feat_tourism_pressure": with_silver("SELECT * FROM tourism"),
    "region_shares": with_silver("SELECT * FROM shares"),
    "feat_supply_deficit": with_silver("SELECT * FROM supply"),
    "feat_rent_income": with_silver("SELECT * FROM rent_income"),
    "feat_rent_income_proxy": with_silver("SELECT * FROM rent_income_proxy"),
    "feat_macro_volatility": with_silver("SELECT * FROM macro_volatility"),
    "kpi_unified_base": with_silver("SELECT * FROM unified"),
}
