"""Column-expression helpers shared by the operators.

All of them are plain Catalyst expressions (code-generated, no Python at run
time).  NULL replaces the reference's NaN everywhere: zero denominators and
infinite ratios become NULL, and ANSI mode stays on (``try_divide``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["col_", "rnd", "dsum", "ratio", "pct_change", "cagr", "strip_ws", "clip",
           "fmt_magnitude", "r2", "r4", "r6"]

#: 26 digits before and 12 after the point; sums of it don't depend on order.
MONEY = "decimal(38,12)"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dsum(c) -> Column:
    """Sum in decimal arithmetic (12 places), returned as double.

    Summing decimals makes the result independent of partitioning and of the
    order in which partial sums are combined.
    """
    return F.sum(col_(c).cast(MONEY)).cast("double")


def ratio(num, den) -> Column:
    """num / den with NULL for a zero or NULL denominator."""
    return F.try_divide(col_(num), F.nullif(col_(den), F.lit(0)))


def pct_change(cur, prev) -> Column:
    """(cur / prev - 1) * 100; NULL when prev is 0 (the reference's ±inf)."""
    return (ratio(cur, prev) - 1) * 100


def cagr(end, start, periods) -> Column:
    """Compound growth in % per period; zero endpoints give NULL."""
    q = ratio(F.nullif(col_(end), F.lit(0)), start)
    return (F.pow(q, F.lit(1.0) / col_(periods) if not isinstance(periods, (int, float))
                  else F.lit(1.0 / periods)) - 1) * 100


def strip_ws(c) -> Column:
    """Python ``str.strip()``: leading/trailing white space of any kind."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def clip(c, lo, hi) -> Column:
    """Null-preserving clip (``least``/``greatest`` alone would skip NULLs)."""
    x = col_(c)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def fmt_magnitude(c) -> Column:
    """Human number: 1.2B, 35M, 7K, 12 (P10)."""
    x = col_(c)
    a = F.abs(x)
    return (F.when(a >= 1e9, F.concat(F.format_string("%.1f", x / 1e9), F.lit("B")))
            .when(a >= 1e6, F.concat(F.format_string("%.0f", x / 1e6), F.lit("M")))
            .when(a >= 1e3, F.concat(F.format_string("%.0f", x / 1e3), F.lit("K")))
            .otherwise(F.format_string("%.0f", x)))


def rnd(c, p: int) -> Column:
    """Round half away from zero on the binary value: round(x * 10^p) / 10^p.

    Reports are rounded with this rule rather than Spark's decimal-string
    HALF_UP so that a value such as 129.045 (stored as 129.04499...) rounds
    the same way in every engine that reads the same double.  Magnitudes at
    or above 2^52 / 10^p are already integral at that scale and pass through.
    """
    x = col_(c)
    s = float(10 ** p)
    y = F.abs(x) * s
    return F.when(x.isNull(), F.lit(None).cast("double")) \
        .when(y < 4.5e15, F.signum(x) * F.floor(y + 0.5) / s) \
        .otherwise(x * s / s)


def r2(c) -> Column:
    return rnd(c, 2)


def r4(c) -> Column:
    return rnd(c, 4)


def r6(c) -> Column:
    return rnd(c, 6)


