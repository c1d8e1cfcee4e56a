"""KPI classification ladders (F16, F24–F28, F33) as Column expressions.

First matching rule wins, as in the reference; everything is a nested
CASE, evaluated inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import any_term, c, num

# Name terms that drive the status ladder, in rule order.
STATUS_SCORE = ["score", "index"]
STATUS_GROWTH = ["growth", "increase", "rate", "yield", "return"]
STATUS_RISK = ["deficit", "gap", "risk", "volatility", "uncertainty"]
STATUS_RATIO = ["ratio", "penetration", "share"]
STATUS_MONEY = ["price", "cost", "value", "housing", "rent"]
# Trend classes.
TREND_HIGH = ["growth", "increase", "rate of return", "score", "index", "performance"]
TREND_LOW = ["deficit", "gap", "risk", "volatility", "uncertainty", "pressure"]
# Confidence source classes.
SOURCE_REAL = ["world bank", "stats nz", "real"]
SOURCE_SYNTHETIC = ["synthetic", "proxy", "estimated"]
# Importance classes.
IMPORTANCE_HIGH = ["habitat", "intelligence", "score", "growth", "gdp", "inflation", "unemployment",
                   "housing"]
IMPORTANCE_MEDIUM = ["rate", "index", "pressure", "deficit", "gap", "affordability"]
MONEY_UNITS = ["$", "USD", "NZD"]
PLAIN_UNITS = ["pts", "score", "index"]


# Status colours.
GREEN, YELLOW, ORANGE, RED, GREY = "#28a745", "#ffc107", "#fd7e14", "#dc3545", "#6c757d"


def status_and_color(name, value, category, text=None) -> tuple[Column, Column]:
    """(status, colour) of a KPI; thresholds are fixed values.

    ``text``: the value as it came, where that is text: one that is no
    number gives "No Data" before any rule, and one with a "%" takes the
    ratio rule."""
    v = F.coalesce(c(value), F.lit(0.0))
    cat = c(category)
    ratio = any_term(name, STATUS_RATIO)
    broken = F.lit(False)
    if text is not None:
        ratio = ratio | F.coalesce(c(text).contains("%"), F.lit(False))
        broken = c(text).isNotNull() & c(text).try_cast("double").isNull()
    rules = [
        (any_term(name, STATUS_SCORE), [(v >= 80, "Excellent", GREEN), (v >= 60, "Good", YELLOW), (v >= 40, "Moderate", ORANGE), (None, "Needs Attention", RED)]),
        (any_term(name, STATUS_GROWTH), [(v > 5, "Strong Growth", GREEN), (v > 0, "Positive", YELLOW), (v == 0, "Stable", GREY), (None, "Declining", RED)]),
        (any_term(name, STATUS_RISK), [(v < 10, "Low", GREEN), (v < 25, "Moderate", YELLOW), (None, "High", RED)]),
        (ratio, [(v < 10, "Low", GREEN), (v < 30, "Moderate", YELLOW), (None, "High", RED)]),
        (any_term(name, STATUS_MONEY), [(None, "Measured", GREY)]),
        (cat.isin("economic", "growth"), [(v > 0, "Positive", GREEN), (None, "Challenging", RED)]),
        (cat.isin("risk", "volatility"), [(v > 50, "High Risk", RED), (v > 25, "Moderate Risk", YELLOW), (None, "Low Risk", GREEN)]),
        (F.lit(True), [(v > 80, "High", RED), (v > 50, "Moderate", YELLOW), (v > 20, "Low", GREEN), (None, "Very Low", GREY)]),
    ]

    def ladder(i, first):
        out = F.when(broken, first)
        for test, steps in rules:
            inner = F.lit(steps[-1][i])
            for step in reversed(steps[:-1]):
                inner = F.when(step[0], step[i]).otherwise(inner)
            out = out.when(test, inner)
        return out

    return ladder(1, "No Data"), ladder(2, GREY)


def kpi_status(name, value, category, text=None) -> Column:
    return status_and_color(name, value, category, text)[0]


def kpi_color(name, value, category, text=None) -> Column:
    return status_and_color(name, value, category, text)[1]


def kpi_trend(name, value) -> Column:
    v = F.coalesce(c(value), F.lit(0.0))
    high = any_term(name, TREND_HIGH)
    low = any_term(name, TREND_LOW)
    return (F.when(high, F.when(v > 10, "up").when(v > 0, "slightly up").when(v < -5, "down")
                   .otherwise("neutral"))
            .when(low, F.when(v < 5, "up").when(v < 15, "neutral").otherwise("down"))
            .otherwise("neutral"))


def _nonblank(x) -> Column:
    return F.coalesce(F.length(F.trim(c(x))) > 0, F.lit(False))


def kpi_confidence(description, unit, category, source) -> Column:
    cat = c(category)
    has_cat = _nonblank(cat) & F.coalesce(cat != "general", F.lit(False))
    src = F.coalesce(c(source), F.lit(""))
    score = (F.lit(50.0)
             + F.when(_nonblank(description), 10).otherwise(0)
             + F.when(_nonblank(unit), 10).otherwise(0)
             + F.when(has_cat, 5).otherwise(0)
             + F.when(any_term(src, SOURCE_REAL), 15).otherwise(0)
             - F.when(any_term(src, SOURCE_SYNTHETIC), 10).otherwise(0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def kpi_importance(name, confidence) -> Column:
    return (F.when(any_term(name, IMPORTANCE_HIGH), 30.0).otherwise(0.0)
            + F.when(any_term(name, IMPORTANCE_MEDIUM), 15.0).otherwise(0.0)
            + F.coalesce(c(confidence), F.lit(50.0)) * 0.2)


def format_value(value, unit) -> Column:
    """Display text by unit; values are rounded (HALF_UP) before printing."""
    v, u = c(value), F.coalesce(c(unit), F.lit(""))
    has = lambda terms: F.greatest(*[F.lit(False)] + [u.contains(t) for t in terms])
    return (F.when(v.isNull(), "N/A")
            .when(u.contains("%"), F.format_string("%.1f%%", num(v, 1)))
            .when(has(MONEY_UNITS),
                  F.when(F.abs(v) >= 1_000_000, F.format_string("$%.1fM", num(v / 1_000_000.0, 1)))
                  .when(F.abs(v) >= 1000, F.format_string("$%.1fK", num(v / 1000.0, 1)))
                  .otherwise(F.format_string("$%.0f", num(v, 0))))
            .when(has(PLAIN_UNITS), F.format_string("%.1f", num(v, 1)))
            .otherwise(F.format_string("%.2f", num(v, 2))))


def truncate_title(x, n: int = 20) -> Column:
    return F.when(F.length(c(x)) > n, F.concat(F.substring(c(x), 1, n), F.lit("..."))).otherwise(c(x))
