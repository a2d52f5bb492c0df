"""Distribution tails as Column expressions.

The special functions come from Apache Commons Math 3 (shipped with Spark) through
``reflect``; they run JVM-side on the small (analysis x metric x group) tables the
tests produce, never on event rows.  ``reflect`` returns strings, hence the casts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .safe import NAN, POS_INF

_ERF = "org.apache.commons.math3.special.Erf"
_BETA = "org.apache.commons.math3.special.Beta"
_GAMMA = "org.apache.commons.math3.special.Gamma"

# Two-sided normal critical values by alpha, one-sided by beta.
NORM_PPF_ALPHA_TWO_SIDED = {0.1: 1.6448536269514722, 0.05: 1.959963984540054, 0.01: 2.5758293035489004, 0.001: 3.2905267314919255}
NORM_PPF_BETA = {0.05: 1.6448536269514722, 0.1: 1.2815515655446004, 0.2: 0.8416212335729142}
# Welch CI switches from the t to the normal quantile above this many degrees of freedom.
NORMAL_DF_CUTOFF = 100000.0


def _reflect(cls: str, method: str, *args: Column) -> Column:
    return F.call_function("reflect", F.lit(cls), F.lit(method), *[a.cast("double") for a in args]).cast("double")


def _reflect_sql(cls: str, method: str, *args: str) -> str:
    inner = ", ".join(f"CAST({a} AS DOUBLE)" for a in args)
    return f"CAST(reflect('{cls}', '{method}', {inner}) AS DOUBLE)"


def normal_two_sided_p(z: Column) -> Column:
    """``2 * (1 - Phi(|z|))`` computed as ``erfc(|z| / sqrt 2)`` (no cancellation)."""
    return F.when(F.isnan(z), NAN()).otherwise(_reflect(_ERF, "erfc", F.abs(z) / F.lit(math.sqrt(2.0))))


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * _reflect(_ERF, "erfc", -z / F.lit(math.sqrt(2.0)))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """``2 * (1 - T_df(|t|)) = I_{df/(df+t^2)}(df/2, 1/2)``."""
    x = df / (df + t * t)
    return (
        F.when(F.isnan(t) | F.isnan(df) | (df <= 0), NAN())
        .when(F.abs(t) == POS_INF(), F.lit(0.0))
        .otherwise(_reflect(_BETA, "regularizedBeta", x, df / 2.0, F.lit(0.5)))
    )


def t_cdf(t: Column, df: Column) -> Column:
    half_tail = F.lit(0.5) * t_two_sided_p(t, df)
    return F.when(t >= 0, F.lit(1.0) - half_tail).otherwise(half_tail)


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-square: ``Q(df/2, x/2)``."""
    return F.when(F.isnan(x) | (df <= 0), NAN()).otherwise(_reflect(_GAMMA, "regularizedGammaQ", df / 2.0, x / 2.0))


# Upper normal quantiles used as Cornish-Fisher starting points.
NORMAL_UPPER_QUANTILES = {0.9: 1.2815515655446004, 0.95: 1.6448536269514722, 0.975: 1.959963984540054,
                          0.995: 2.5758293035489004, 0.9995: 3.2905267314919255}
NEWTON_MIN_DF = 3.0


def _cornish_fisher_sql(z: float, d: str) -> str:
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return f"({z!r}D + {g1!r}D / {d} + {g2!r}D / pow({d}, 2) + {g3!r}D / pow({d}, 3) + {g4!r}D / pow({d}, 4))"


def t_ppf(p: float, df: Column | str, iterations: int = 100, upper: float = 1e7, newton_steps: int = 6) -> Column:
    """Student-t quantile for ``0.5 < p < 1``; NaN df gives NaN.

    ``df`` as a column name (the form the tests use): for ``df >= 3`` a
    Cornish-Fisher start refined by Newton steps on the exact CDF (about
    ``newton_steps + 2`` special-function calls per row); below that, and for
    levels without a tabulated normal quantile, bisection on the two-sided tail
    (100 halvings of ``[0, 1e7]``).  Both reach double precision."""
    if not 0.5 < p < 1.0:
        raise ValueError("t_ppf supports 0.5 < p < 1")
    tail = 2.0 * (1.0 - p)
    if isinstance(df, str):
        d = f"CAST(`{df}` AS DOUBLE)"
        mid = "((acc.lo + acc.hi) / 2)"
        two_sided = _reflect_sql(_BETA, "regularizedBeta", f"{d} / ({d} + {mid} * {mid})", f"{d} / 2", "0.5")
        bisect = (
            f"aggregate(sequence(1, {iterations}), named_struct('lo', CAST(0 AS DOUBLE), 'hi', CAST({upper!r} AS DOUBLE)), "
            f"(acc, i) -> IF({two_sided} > {tail!r}, named_struct('lo', {mid}, 'hi', acc.hi), named_struct('lo', acc.lo, 'hi', {mid})), "
            f"acc -> (acc.lo + acc.hi) / 2)"
        )
        z = NORMAL_UPPER_QUANTILES.get(p)
        if z is None:
            return F.expr(f"CASE WHEN isnan({d}) OR {d} <= 0 THEN CAST('NaN' AS DOUBLE) ELSE {bisect} END")
        log_c = (
            f"{_reflect_sql(_GAMMA, 'logGamma', f'({d} + 1) / 2')} - {_reflect_sql(_GAMMA, 'logGamma', f'{d} / 2')}"
            f" - 0.5 * ln({d} * pi())"
        )
        cdf = f"(1 - 0.5 * {_reflect_sql(_BETA, 'regularizedBeta', f'{d} / ({d} + acc.q * acc.q)', f'{d} / 2', '0.5')})"
        pdf = f"exp(acc.c - ({d} + 1) / 2 * ln(1 + acc.q * acc.q / {d}))"
        newton = (
            f"aggregate(sequence(1, {newton_steps}), named_struct('q', {_cornish_fisher_sql(z, d)}, 'c', {log_c}), "
            f"(acc, i) -> named_struct('q', greatest(acc.q - ({cdf} - {p!r}) / {pdf}, acc.q / 2), 'c', acc.c), acc -> acc.q)"
        )
        return F.expr(
            f"CASE WHEN isnan({d}) OR {d} <= 0 THEN CAST('NaN' AS DOUBLE) "
            f"WHEN {d} >= {NEWTON_MIN_DF!r} THEN {newton} ELSE {bisect} END"
        )
    lit_tail = F.lit(tail)
    dcol = df.cast("double")

    def step(acc: Column, _i: Column) -> Column:
        m = (acc["lo"] + acc["hi"]) / 2.0
        ts = _reflect(_BETA, "regularizedBeta", dcol / (dcol + m * m), dcol / 2.0, F.lit(0.5))
        return F.when(ts > lit_tail, F.struct(m.alias("lo"), acc["hi"].alias("hi"))).otherwise(
            F.struct(acc["lo"].alias("lo"), m.alias("hi"))
        )

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float(upper)).alias("hi"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step, lambda acc: (acc["lo"] + acc["hi"]) / 2.0)
    return F.when(F.isnan(dcol) | (dcol <= 0), NAN()).otherwise(root)
