"""DuckDB CASE forms of the KPI ladders, with term lists of their own."""

from __future__ import annotations

from .silver import N

# Fixed values, written out once more so that a slip in the Spark lists shows.
STATUS_SCORE = ["score", "index"]
STATUS_GROWTH = ["growth", "increase", "rate", "yield", "return"]
STATUS_RISK = ["deficit", "gap", "risk", "volatility", "uncertainty"]
STATUS_RATIO = ["ratio", "penetration", "share"]
STATUS_MONEY = ["price", "cost", "value", "housing", "rent"]
TREND_HIGH = ["growth", "increase", "rate of return", "score", "index", "performance"]
TREND_LOW = ["deficit", "gap", "risk", "volatility", "uncertainty", "pressure"]
SOURCE_REAL = ["world bank", "stats nz", "real"]
SOURCE_SYNTHETIC = ["synthetic", "proxy", "estimated"]
IMPORTANCE_HIGH = ["habitat", "intelligence", "score", "growth", "gdp", "inflation", "unemployment", "housing"]
IMPORTANCE_MEDIUM = ["rate", "index", "pressure", "deficit", "gap", "affordability"]
MONEY_UNITS = ["$", "USD", "NZD"]
PLAIN_UNITS = ["pts", "score", "index"]


def _any(col: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{t.lower()}')" for t in terms) + ")"


def status(name="kpi_name", value="kpi_value", category="category") -> str:
    v = f"COALESCE({value}, 0)"
    return f"""CASE
 WHEN {_any(name, STATUS_SCORE)} THEN CASE WHEN {v} >= 80 THEN 'Excellent' WHEN {v} >= 60 THEN 'Good' WHEN {v} >= 40 THEN 'Moderate' ELSE 'Needs Attention' END
 WHEN {_any(name, STATUS_GROWTH)} THEN CASE WHEN {v} > 5 THEN 'Strong Growth' WHEN {v} > 0 THEN 'Positive' WHEN {v} = 0 THEN 'Stable' ELSE 'Declining' END
 WHEN {_any(name, STATUS_RISK)} THEN CASE WHEN {v} < 10 THEN 'Low' WHEN {v} < 25 THEN 'Moderate' ELSE 'High' END
 WHEN {_any(name, STATUS_RATIO)} THEN CASE WHEN {v} < 10 THEN 'Low' WHEN {v} < 30 THEN 'Moderate' ELSE 'High' END
 WHEN {_any(name, STATUS_MONEY)} THEN 'Measured'
 WHEN {category} IN ('economic', 'growth') THEN CASE WHEN {v} > 0 THEN 'Positive' ELSE 'Challenging' END
 WHEN {category} IN ('risk', 'volatility') THEN CASE WHEN {v} > 50 THEN 'High Risk' WHEN {v} > 25 THEN 'Moderate Risk' ELSE 'Low Risk' END
 WHEN {v} > 80 THEN 'High' WHEN {v} > 50 THEN 'Moderate' WHEN {v} > 20 THEN 'Low' ELSE 'Very Low' END"""


def color(name="kpi_name", value="kpi_value", category="category") -> str:
    v = f"COALESCE({value}, 0)"
    g, y, o, r, n = "'#28a745'", "'#ffc107'", "'#fd7e14'", "'#dc3545'", "'#6c757d'"
    return f"""CASE
 WHEN {_any(name, STATUS_SCORE)} THEN CASE WHEN {v} >= 80 THEN {g} WHEN {v} >= 60 THEN {y} WHEN {v} >= 40 THEN {o} ELSE {r} END
 WHEN {_any(name, STATUS_GROWTH)} THEN CASE WHEN {v} > 5 THEN {g} WHEN {v} > 0 THEN {y} WHEN {v} = 0 THEN {n} ELSE {r} END
 WHEN {_any(name, STATUS_RISK)} THEN CASE WHEN {v} < 10 THEN {g} WHEN {v} < 25 THEN {y} ELSE {r} END
 WHEN {_any(name, STATUS_RATIO)} THEN CASE WHEN {v} < 10 THEN {g} WHEN {v} < 30 THEN {y} ELSE {r} END
 WHEN {_any(name, STATUS_MONEY)} THEN {n}
 WHEN {category} IN ('economic', 'growth') THEN CASE WHEN {v} > 0 THEN {g} ELSE {r} END
 WHEN {category} IN ('risk', 'volatility') THEN CASE WHEN {v} > 50 THEN {r} WHEN {v} > 25 THEN {y} ELSE {g} END
 WHEN {v} > 80 THEN {r} WHEN {v} > 50 THEN {y} WHEN {v} > 20 THEN {g} ELSE {n} END"""


def trend(name="kpi_name", value="kpi_value") -> str:
    v = f"COALESCE({value}, 0)"
    return f"""CASE
 WHEN {_any(name, TREND_HIGH)} THEN CASE WHEN {v} > 10 THEN 'up' WHEN {v} > 0 THEN 'slightly up' WHEN {v} < -5 THEN 'down' ELSE 'neutral' END
 WHEN {_any(name, TREND_LOW)} THEN CASE WHEN {v} < 5 THEN 'up' WHEN {v} < 15 THEN 'neutral' ELSE 'down' END
 ELSE 'neutral' END"""


def confidence(description="description", unit="unit", category="category", source="source") -> str:
    nb = lambda x: f"COALESCE(length(trim({x})) > 0, false)"
    src = f"COALESCE({source}, '')"
    return (f"GREATEST(0.0, LEAST(100.0, 50.0"
            f" + CASE WHEN {nb(description)} THEN 10 ELSE 0 END"
            f" + CASE WHEN {nb(unit)} THEN 10 ELSE 0 END"
            f" + CASE WHEN {nb(category)} AND COALESCE({category} <> 'general', false) THEN 5 ELSE 0 END"
            f" + CASE WHEN {_any(src, SOURCE_REAL)} THEN 15 ELSE 0 END"
            f" - CASE WHEN {_any(src, SOURCE_SYNTHETIC)} THEN 10 ELSE 0 END))")


def importance(name="kpi_name", conf="confidence") -> str:
    return (f"(CASE WHEN {_any(name, IMPORTANCE_HIGH)} THEN 30.0 ELSE 0.0 END"
            f" + CASE WHEN {_any(name, IMPORTANCE_MEDIUM)} THEN 15.0 ELSE 0.0 END"
            f" + COALESCE({conf}, 50.0) * 0.2)")


def fmt(value="kpi_value", unit="unit") -> str:
    u = f"COALESCE({unit}, '')"
    money = " OR ".join(f"contains({u}, '{t}')" for t in MONEY_UNITS)
    plain = " OR ".join(f"contains({u}, '{t}')" for t in PLAIN_UNITS)
    return f"""CASE WHEN {value} IS NULL THEN 'N/A'
 WHEN contains({u}, '%') THEN printf('%.1f%%', {N(value, 1)})
 WHEN {money} THEN CASE WHEN abs({value}) >= 1000000 THEN printf('$%.1fM', {N(f'{value} / 1000000.0', 1)})
                        WHEN abs({value}) >= 1000 THEN printf('$%.1fK', {N(f'{value} / 1000.0', 1)})
                        ELSE printf('$%.0f', {N(value, 0)}) END
 WHEN {plain} THEN printf('%.1f', {N(value, 1)})
 ELSE printf('%.2f', {N(value, 2)}) END"""
