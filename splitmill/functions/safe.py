"""Division and comparison helpers with explicit NaN / Inf semantics.

Spark 4 runs in ANSI mode, where ``x / 0.0`` raises even for doubles.  The tests
need the IEEE behaviour (``+Inf``, ``-Inf``, ``NaN``) in some places and a fixed
fill value in others, so every quotient goes through one of these helpers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def NAN() -> Column:
    return F.lit(float("nan"))


def POS_INF() -> Column:
    return F.lit(float("inf"))


def NEG_INF() -> Column:
    return F.lit(float("-inf"))


def dbl(c) -> Column:
    """Column or literal as DOUBLE; NULL becomes NaN (the statistics treat a
    missing moment as an undefined number)."""
    col = c if isinstance(c, Column) else F.lit(c)
    return F.coalesce(col.cast("double"), NAN())


def div_fill(num: Column, den: Column, fill) -> Column:
    """``num / den`` where ``den != 0``, else ``fill``."""
    fill_col = fill if isinstance(fill, Column) else F.lit(float(fill))
    return F.when(den != 0, num / den).otherwise(fill_col)


def ieee_div(num: Column, den: Column) -> Column:
    """IEEE-754 quotient: ``a/0`` is ``+Inf`` / ``-Inf`` by the sign of ``a``, ``0/0`` is NaN."""
    return (
        F.when(den != 0, num / den)
        .when(F.isnan(num) | F.isnan(den), NAN())
        .when(num > 0, POS_INF())
        .when(num < 0, NEG_INF())
        .otherwise(NAN())
    )


def is_nan(c: Column) -> Column:
    return F.coalesce(F.isnan(c), F.lit(True))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != POS_INF())


def near_zero(c: Column, atol: float = 1e-12) -> Column:
    """``isclose(c, 0, atol)``: NaN is never close."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) <= F.lit(atol)), F.lit(False))


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def signed_inf(c: Column) -> Column:
    return F.when(c > 0, POS_INF()).when(c < 0, NEG_INF()).otherwise(NAN())


def nan_to_null(c: Column) -> Column:
    """JSON export form: NaN and +-Inf become NULL."""
    return F.when(is_finite(c), c)
