"""Column-level helpers (all JVM-side expressions, no Python per row).

Numeric results are normalised with ``num``: the value is cast to
``DECIMAL(38,6)`` and then rounded HALF_UP to the requested digits. This
matches the documented KPI rounding (round-half-up to n digits) and makes
ties such as 1.005 behave the same in every engine, because the rounding
happens on a decimal, not on the binary double.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(38,6)"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x, digits: int = 6) -> Column:
    """Round half-up on a DECIMAL(38,6) copy and return DOUBLE."""
    return F.round(c(x).cast(DEC), digits).cast("double")


def money(x) -> Column:
    """2/4-decimal money as an exact DECIMAL before summing."""
    return c(x).cast("decimal(18,4)")


def whole(x) -> Column:
    """A double rounded half away from zero, as BIGINT: what ``round`` gives,
    without its BigDecimal for every row. ``rint`` takes ties to the even
    number; the distance to it is exact, so the other ties are seen."""
    x = c(x)
    r = F.rint(x)
    return (F.when((x > 0) & (x - r == 0.5), r + 1.0).when((x < 0) & (x - r == -0.5), r - 1.0).otherwise(r)).cast("bigint")


_SPLIT = 1_000_000


def exact_sum(x, name: str, scale: int = 4) -> list[Column]:
    """Exact sum of a fixed-point value (≤ ``scale`` decimals) as two BIGINT
    sums — long aggregation stays on Spark's fast path, unlike a
    DECIMAL(p>18) buffer. The value in units of 10^-scale is split into
    high (÷10^6) and low (mod 10^6) parts: per-row parts are < 10^3 and
    < 10^6 for values below 10^5, so neither sum can overflow below ~10^12
    rows per group. Recombine with ``exact_sum_value``."""
    u = whole(c(x) * F.lit(float(10 ** scale)))
    hi = F.floor(u / F.lit(float(_SPLIT))).cast("bigint")
    lo = u - hi * F.lit(_SPLIT)
    return [F.sum(hi).alias(f"{name}__hi"), F.sum(lo).alias(f"{name}__lo")]


def exact_sum_parts(name: str) -> list[Column]:
    """Re-aggregation of already summed parts (e.g. months → year)."""
    return [F.sum(f"{name}__hi").alias(f"{name}__hi"), F.sum(f"{name}__lo").alias(f"{name}__lo")]


def exact_sum_value(name: str, scale: int = 4) -> Column:
    """DECIMAL(38, scale) total of an ``exact_sum`` pair."""
    total = F.col(f"{name}__hi").cast("decimal(38,0)") * F.lit(_SPLIT) + F.col(f"{name}__lo").cast("decimal(38,0)")
    return (total / F.lit(10 ** scale)).cast(f"decimal(38,{scale})")


def hundredths(x) -> Column:
    """A 2-decimal value as exact integer hundredths (BIGINT)."""
    return whole(c(x) * F.lit(100.0))


def safe_div(n, d) -> Column:
    """n / d, NULL when d is NULL or 0 (``nullif`` guard, no ANSI error)."""
    return F.try_divide(c(n), F.nullif(c(d), F.lit(0)))


def positive_or_null(x) -> Column:
    x = c(x)
    return F.when(x > 0, x)


def clamp(x, lo, hi) -> Column:
    """greatest(lo, least(hi, x)); NULL input gives NULL."""
    x = c(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def finite_or(x, default) -> Column:
    """NaN / ±inf / NULL → default."""
    x = c(x)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(x)


def nan_to_null(x) -> Column:
    x = c(x)
    return F.when(~F.isnan(x), x)


def surrogate_key(*cols) -> Column:
    """md5 of the parts cast to text, NULL → '' and joined by '|'."""
    parts = [F.coalesce(c(x).cast("string"), F.lit("")) for x in cols]
    return F.md5(F.concat_ws("|", *parts))


def snake_case(x) -> Column:
    """lower, trim, [space - .]→_, strip non [a-z0-9_], collapse _ runs, trim _."""
    s = F.lower(F.trim(c(x)))
    s = F.regexp_replace(s, r"[\s\-.]", "_")
    s = F.regexp_replace(s, r"[^a-z0-9_]", "")
    s = F.regexp_replace(s, r"_+", "_")
    return F.regexp_replace(s, r"^_|_$", "")


def snake_name(name: str) -> str:
    """The same normaliser for column *names* (plain Python, no job)."""
    s = re.sub(r"[\s\-.]", "_", name.strip().lower())
    s = re.sub(r"[^a-z0-9_]", "", s)
    s = re.sub(r"_+", "_", s)
    return re.sub(r"^_|_$", "", s)


def any_term(x, terms) -> Column:
    """Case-insensitive 'contains any of' test."""
    lx = F.lower(c(x))
    return reduce(lambda a, b: a | b, [lx.contains(t.lower()) for t in terms])


def annuity_payment(principal, annual_rate_pct, months: int) -> Column:
    """P·r(1+r)^n / ((1+r)^n − 1) with r = annual%/100/12; r = 0 → P/n."""
    r = c(annual_rate_pct) / F.lit(100.0) / F.lit(12.0)
    g = F.pow(F.lit(1.0) + r, F.lit(float(months)))
    return F.when(r == 0, c(principal) / F.lit(float(months))).otherwise(
        c(principal) * r * g / (g - F.lit(1.0)))
