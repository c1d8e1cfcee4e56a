"""DuckDB reference SQL for the gold KPI tables (UNION ALL of branches,
scalar subqueries — the plain SQL formulation)."""

from __future__ import annotations

from ..plans import gold_meta as M
from .silver import N, with_silver


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lab(t: str, region: str = "region") -> str:
    if "{region}" not in t:
        return _q(t)
    pre, post = t.split("{region}")
    return f"{_q(pre)} || {region}" + (f" || {_q(post)}" if post else "")


def branch(meta, value: str, dashboard: str, src: str, key_year: str | None = None) -> str:
    if len(meta) == 5:
        key, name, unit, desc, cat = meta
    else:
        key, (name, unit, desc, cat) = None, meta
    kid = f", md5(concat({_q(key)}, '-', {key_year})) AS kpi_id" if key_year else ""
    return (f"SELECT {_lab(name)} AS kpi_name, CAST(({value}) AS DOUBLE) AS kpi_value, {_q(unit)} AS unit, "
            f"{_lab(desc)} AS description, {_q(dashboard)} AS dashboard, {_q(cat)} AS category{kid} FROM {src}")


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


EXECUTIVE = (", ex_l AS (SELECT * FROM unified WHERE year = (SELECT max(year) FROM unified)),\n"
    "ex_a AS (SELECT year, avg(ocr_value) AS ocr, avg(supply_deficit_score) AS supply, avg(gdp_per_capita) AS gdp_pc,\n"
    " avg(gdp_per_capita_yoy_pct) AS gdp_yoy, avg(rate_volatility) AS vol, avg(tourism_pressure_index) AS pressure,\n"
    " avg(rent_to_income_ratio) AS rent_ratio, sum(building_consents) AS consents FROM ex_l GROUP BY year),\n"
    "ex_b AS (SELECT ex_a.*, m.inflation FROM ex_a LEFT JOIN macro_panel m ON ex_a.year = m.year)\n",
    union([branch(m, v, "executive", "ex_b", "year") for m, v in zip(M.EXECUTIVE, [
        N("COALESCE(ocr, 0) * 0.30 + COALESCE(supply, 0) * 0.35 + COALESCE(gdp_pc, 0) * 0.35", 2),
        N("gdp_yoy", 2),
        N("100 - COALESCE(vol, 0)", 2),
        N("COALESCE(pressure, 0)", 2),
        N("COALESCE(supply, 0)", 2),
        N("COALESCE(rent_ratio, 0)", 2),
        N("COALESCE(ocr, 0)", 2),
        N("COALESCE(inflation, 0)", 2),
        "COALESCE(consents, 0)",
    ])]))

_H = M.HOUSING
HOUSING = (", h_ls AS (SELECT * FROM supply WHERE year = (SELECT max(year) FROM supply)),\n"
    "h_lr AS (SELECT * FROM rent_income WHERE year * 10 + quarter = (SELECT max(year * 10 + quarter) FROM rent_income))\n",
    union([
        branch(_H[0], N("building_consents * 150.0", 0), "housing", "h_ls"),
        branch(_H[2], "COALESCE(building_consents, 0)", "housing", "h_ls"),
        branch(_H[3], "COALESCE(population_growth, 0)", "housing", "h_ls"),
        branch(_H[1], N("COALESCE(avg(supply_deficit_score), 0)", 2), "housing", "h_ls"),
        branch(_H[4], N("avg(median_weekly_rent)", 0), "housing", "h_lr"),
        branch(_H[5], N("COALESCE(avg(rent_to_income_ratio), 0)", 1), "housing", "h_lr"),
        branch(_H[6], N("GREATEST(20, LEAST(80, 55 - COALESCE(avg(supply_deficit_score), 0) * 0.3))", 0),
               "housing", "h_ls"),
    ]))

_T = M.TOURISM
TOURISM = (", t_l AS (SELECT * FROM tourism WHERE year = (SELECT max(year) FROM tourism)),\n"
    "t_p AS (SELECT * FROM tourism WHERE year = (SELECT max(year) - 1 FROM tourism))\n",
    union([
        branch(_T[0], N("avg(tourism_pressure_index)", 2), "tourism", "t_l"),
        branch(_T[1], N("sum(visitor_arrivals)", 4), "tourism", "t_l"),
        branch(_T[2], N("sum(tourism_expenditure)", 4), "tourism", "t_l"),
        branch(_T[3], N("COALESCE((SELECT avg(interest_rate_volatility) FROM macro_volatility), 0)", 4),
               "tourism", "(SELECT 1) AS one"),
        branch(_T[4], N("(SELECT max(visitor_arrivals) FROM t_l) / NULLIF((SELECT min(visitor_arrivals) FROM t_l), 0)", 2),
               "tourism", "(SELECT 1) AS one"),
        branch(_T[5], N("((SELECT avg(tourism_pressure_index) FROM t_l) - COALESCE((SELECT avg(tourism_pressure_index) FROM t_p), 0))"
                        " / NULLIF((SELECT avg(tourism_pressure_index) FROM t_p), 0) * 100", 2),
               "tourism", "(SELECT 1) AS one"),
    ]))

_M = M.MACRO
_R = "(COALESCE(mortgage_rate_2yr, 5.0) / 100 / 12)"
_ANN = (f"CASE WHEN {_R} = 0 THEN 750000.0 / 360 ELSE 750000.0 * {_R} * POW(1 + {_R}, 360) "
        f"/ (POW(1 + {_R}, 360) - 1) END")
MACRO = (", m_ir AS (SELECT * FROM interest_rate WHERE year = (SELECT max(year) FROM interest_rate)),\n"
    "m_aff0 AS (SELECT *, (gdp_per_capita - lag(gdp_per_capita) OVER w) / NULLIF(lag(gdp_per_capita) OVER w, 0) * 100 AS gdp_yoy\n"
    "  FROM affordability WINDOW w AS (PARTITION BY region ORDER BY year)),\n"
    "m_aff AS (SELECT * FROM m_aff0 WHERE year = (SELECT max(year) FROM m_aff0)),\n"
    "m_t AS (SELECT * FROM tourism WHERE year = (SELECT max(year) FROM tourism))\n",
    union([
        branch(_M[0], N("COALESCE(ocr_value, 0)", 2), "macro", "m_ir"),
        branch(_M[1], N("ocr_value - 3.5", 2), "macro", "m_ir"),
        branch(_M[2], N("COALESCE(mortgage_rate_2yr, 0)", 2), "macro", "m_ir"),
        branch(_M[3], N(_ANN, 0), "macro", "m_ir"),
        branch(_M[4], N("COALESCE(gdp_yoy, 0)", 2), "macro", "m_aff"),
        branch(_M[5], N("COALESCE(gdp_per_capita, 0)", 0), "macro", "m_aff"),
        branch(_M[6], "COALESCE(ocr_change_bps, 0)", "macro", "m_ir"),
        branch(_M[7], N("COALESCE(rate_volatility, 0)", 2), "macro", "m_ir"),
        branch(_M[8], N("100 - COALESCE(m_ir.rate_volatility, 0) * 5 - ABS(COALESCE(m_aff.gdp_per_capita, 0) - 50000) / 1000.0", 1),
               "macro", "m_ir CROSS JOIN m_aff"),
        branch(_M[9], N("COALESCE(sum(visitor_arrivals), 0)", 4), "macro", "m_t"),
    ]))

_A = M.AFFORDABILITY
AFFORDABILITY = (", a_ri AS (SELECT * FROM rent_income WHERE year * 10 + quarter = (SELECT max(year * 10 + quarter) FROM rent_income)),\n"
    "a_af AS (SELECT * FROM affordability WHERE year = (SELECT max(year) FROM affordability))\n",
    union([
        branch(_A[0], N("COALESCE(price_to_income_ratio, 0)", 1), "affordability", "a_af"),
        branch(_A[1], N("COALESCE(rent_to_income_ratio, 0)", 1), "affordability", "a_ri"),
        branch(_A[2], "COALESCE(median_weekly_rent, 0)", "affordability", "a_ri"),
        branch(_A[3], N("COALESCE(avg(affordability_index), 0)", 2), "affordability", "a_af"),
        branch(_A[4], N("COALESCE(avg(price_to_income_ratio), 0)", 1), "affordability", "a_af"),
        branch(_A[5], N("COALESCE(avg(rent_to_income_ratio), 0)", 1), "affordability", "a_ri"),
        branch(_A[6], N("avg(COALESCE(rent_inflation_rate, 0))", 1), "affordability", "a_ri"),
    ]))

_F = M.FORECAST
_G = "(SELECT avg(gdp_per_capita) FROM unified WHERE year = (SELECT max(year) FROM unified))"
_P = "(SELECT avg(gdp_per_capita) FROM unified WHERE year = (SELECT max(year) - 1 FROM unified))"
_V = "(SELECT avg(rate_volatility) FROM unified WHERE year = (SELECT max(year) FROM unified))"
_TT = "(SELECT avg(tourism_pressure_index) FROM unified WHERE year = (SELECT max(year) FROM unified))"
_ONE = "(SELECT 1) AS one"
FORECAST = ("", union([
    branch(_F[0], N(f"COALESCE({_G}, 0) * 1.03", 0), "forecast", _ONE),
    branch(_F[1], N(f"COALESCE(({_G} - {_P}) / NULLIF({_P}, 0) * 100, 0)", 2), "forecast", _ONE),
    branch(_F[2], N(f"COALESCE({_G}, 0) * 1.08", 0), "forecast", _ONE),
    branch(_F[3], N(f"COALESCE({_G}, 0) * 0.95", 0), "forecast", _ONE),
    branch(_F[4], N(f"COALESCE({_G}, 0) * 1.12", 0), "forecast", _ONE),
    branch(_F[5], N(f"COALESCE({_G}, 0) * 0.90", 0), "forecast", _ONE),
    branch(_F[6], N(f"GREATEST(40, LEAST(90, 80 - COALESCE({_V}, 0) * 10))", 1), "forecast", _ONE),
    branch(_F[7], N(f"COALESCE({_G}, 0) * 0.97", 0), "forecast", _ONE),
    branch(_F[8], N(f"COALESCE({_TT}, 0) * 1.2", 2), "forecast", _ONE),
    branch(_F[9], N(f"ABS(COALESCE({_G}, 0) - COALESCE({_P}, 0)) / NULLIF({_P}, 0) * 100", 2), "forecast", _ONE),
    branch(_F[10], f"CASE WHEN {_G} > {_P} THEN 1 ELSE -1 END", "forecast", _ONE),
    branch(_F[11], N(f"COALESCE(100 - ABS(({_G} - {_P}) / NULLIF({_P}, 0)) * 100, 75)", 1), "forecast", _ONE),
]))

GOLD_PARTS = {
    "gold_executive": EXECUTIVE,
    "gold_housing": HOUSING,
    "gold_tourism": TOURISM,
    "gold_macro": MACRO,
    "gold_affordability": AFFORDABILITY,
    "gold_forecast": FORECAST,
}

GOLD_SQL = {k: with_silver(h + "\n" + body) for k, (h, body) in GOLD_PARTS.items()}

# Source tag per dashboard for the combined KPI table (fixed mapping of ours).
DASHBOARD_SOURCE = {"executive": "Derived", "housing": "Stats NZ", "tourism": "MBIE",
                    "macro": "RBNZ", "affordability": "Stats NZ", "forecast": "Synthetic"}

KPI_CTES = ("".join(h for h, _ in GOLD_PARTS.values())
            + "".join(f",\n{k} AS (\n{body}\n)" for k, (_, body) in GOLD_PARTS.items())
            + ",\nkpis AS (\n" + "\nUNION ALL\n".join(
                f"SELECT kpi_name, kpi_value, unit, description, dashboard, category, "
                f"{_q(DASHBOARD_SOURCE[k[5:]])} AS source FROM {k}" for k in GOLD_PARTS) + ")")


def with_kpis(select: str) -> str:
    """``WITH <silver>, <gold>, kpis <select>``."""
    return with_silver(KPI_CTES + "\n" + select)
