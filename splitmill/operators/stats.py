"""Two-sample tests on sufficient statistics, as Column expressions.

Every test takes a DataFrame plus the Columns (or numbers) holding the moments
and returns the DataFrame with the ``TEST_FIELDS`` columns added.  The work is
a short chain of projections (no shuffle), each step referring to the previous
step's columns, so a table of thousands of (analysis, metric, group) rows is
tested in one narrow stage with compact generated code.

NaN / Inf rules follow the reference behaviour:

* Welch: statistic NaN when the standard error is 0; degrees of freedom NaN when
  undefined; relative difference +Inf when the control mean is 0.
* z-test: statistic 0 when the pooled standard error is 0 (so p = 1); relative
  difference +Inf when the control proportion is 0.
* ratio test: "zero" means ``|x| <= 1e-12``; zero standard error gives statistic
  0 (equal values) or signed Inf; zero control value gives relative difference 0
  or signed Inf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.safe import NAN, POS_INF, dbl, div_fill, ieee_div, near_zero, signed_inf

TEST_FIELDS = ("statistic", "p_value", "ci_lower", "ci_upper", "diff_abs", "diff_ratio")
Z_975 = dist.NORM_PPF_ALPHA_TWO_SIDED[0.05]
ZERO_ATOL = 1e-12
NEGATIVE_VARIANCE_TOLERANCE = 1e-9


# SQL-text building blocks (one JVM call per output column instead of dozens)
NAN_SQL = "CAST('NaN' AS DOUBLE)"
INF_SQL = "CAST('Infinity' AS DOUBLE)"
NEG_INF_SQL = "CAST('-Infinity' AS DOUBLE)"


def _ieee_div_sql(a: str, b: str) -> str:
    a, b = f"({a})", f"({b})"
    return (
        f"CASE WHEN {b} <> 0 THEN {a} / {b} WHEN isnan({a}) OR isnan({b}) THEN {NAN_SQL} "
        f"WHEN {a} > 0 THEN {INF_SQL} WHEN {a} < 0 THEN {NEG_INF_SQL} ELSE {NAN_SQL} END"
    )


def _div_fill_sql(a: str, b: str, fill: str) -> str:
    a, b = f"({a})", f"({b})"
    return f"CASE WHEN {b} <> 0 THEN {a} / {b} ELSE {fill} END"


def _near_zero_sql(x: str) -> str:
    return f"coalesce(NOT isnan(({x})) AND abs(({x})) <= {ZERO_ATOL!r}D, false)"


def _signed_inf_sql(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {INF_SQL} WHEN {x} < 0 THEN {NEG_INF_SQL} ELSE {NAN_SQL} END"


def _normal_p_sql(z: str) -> str:
    return f"CASE WHEN isnan({z}) THEN {NAN_SQL} ELSE {dist._reflect_sql(dist._ERF, 'erfc', f'abs(({z})) / sqrt(2D)')} END"


def _t_p_sql(t: str, d: str) -> str:
    return (
        f"CASE WHEN isnan({t}) OR isnan({d}) OR {d} <= 0 THEN {NAN_SQL} WHEN abs({t}) = {INF_SQL} THEN 0D "
        f"ELSE {dist._reflect_sql(dist._BETA, 'regularizedBeta', f'({d}) / (({d}) + ({t}) * ({t}))', f'({d}) / 2', '0.5')} END"
    )


def _stage(df: DataFrame, cols: dict) -> DataFrame:
    """One projection step; values are SQL strings (or Columns).  Later steps refer
    to these columns by name, so the optimizer keeps the step instead of inlining
    a copy of an expensive expression into every consumer."""
    return df.withColumns({k: (F.expr(v) if isinstance(v, str) else v) for k, v in cols.items()})


def apply_stages(df: DataFrame, stages: list[dict], temps: list[str]) -> DataFrame:
    for st in stages:
        if st:
            df = _stage(df, st)
    return df.drop(*temps)


def merge_stages(*plans: tuple[list[dict], list[str]]) -> tuple[list[dict], list[str]]:
    """Run independent tests side by side: stage i of every plan in one projection."""
    depth = max(len(p[0]) for p in plans)
    stages = [{k: v for p in plans if i < len(p[0]) for k, v in p[0][i].items()} for i in range(depth)]
    return stages, [t for p in plans for t in p[1]]


def _guard(mask: str | None, value_sql: str) -> str:
    """Evaluate ``value_sql`` only on rows selected by the mask column (NULL elsewhere)."""
    return value_sql if mask is None else f"CASE WHEN {mask} THEN {value_sql} END"


def _inputs(tag: str, mask: Column | None, **cols) -> tuple[dict, str | None]:
    stage = {f"_{tag}{k}": dbl(v) for k, v in cols.items()}
    mk = None
    if mask is not None:
        mk = f"_{tag}mask"
        stage[mk] = F.coalesce(mask, F.lit(False))
    return stage, mk


def welch_stages(mean_1, var_1, n_1, mean_2, var_2, n_2, mask: Column | None = None, prefix: str = "", tag: str = "w"):
    o = {f: prefix + f for f in TEST_FIELDS}
    t = lambda n: f"_{tag}{n}"
    first, mk = _inputs(tag, mask, m1=mean_1, v1=var_1, n1=n_1, m2=mean_2, v2=var_2, n2=n_2)
    m1, v1, n1, m2, v2, n2 = (t(x) for x in ("m1", "v1", "n1", "m2", "v2", "n2"))
    s1, s2, q1, q2, se, dof, crit = (t(x) for x in ("s1", "s2", "q1", "q2", "se", "dof", "crit"))
    diff, stat = f"`{o['diff_abs']}`", f"`{o['statistic']}`"
    crit_sql = f"CASE WHEN isnan({dof}) THEN {NAN_SQL} WHEN {dof} > {dist.NORMAL_DF_CUTOFF!r}D THEN {Z_975!r}D ELSE {crit} END"
    stages = [
        first,
        {
            s1: _ieee_div_sql(v1, n1), s2: _ieee_div_sql(v2, n2),
            q1: _ieee_div_sql(f"{v1} * {v1}", f"{n1} * {n1} * ({n1} - 1)"),
            q2: _ieee_div_sql(f"{v2} * {v2}", f"{n2} * {n2} * ({n2} - 1)"),
            o["diff_abs"]: f"{m2} - {m1}",
        },
        {se: f"sqrt({s2} + {s1})", dof: _div_fill_sql(f"pow({s2} + {s1}, 2)", f"{q2} + {q1}", NAN_SQL)},
        {o["statistic"]: _div_fill_sql(diff, se, NAN_SQL), crit: dist.t_ppf(0.975, dof)},
        {o["p_value"]: _guard(mk, _t_p_sql(stat, dof)), crit: _guard(mk, crit_sql), o["diff_ratio"]: _div_fill_sql(diff, m1, INF_SQL)},
        {o["ci_lower"]: f"{diff} - {se} * {crit}", o["ci_upper"]: f"{diff} + {se} * {crit}"},
    ]
    return stages, [m1, v1, n1, m2, v2, n2, s1, s2, q1, q2, se, dof, crit] + ([mk] if mk else [])


def welch_ttest(df: DataFrame, mean_1, var_1, n_1, mean_2, var_2, n_2, mask: Column | None = None, prefix: str = "") -> DataFrame:
    """Adds the Welch test columns (``prefix`` + ``TEST_FIELDS``) for group 2 against group 1."""
    return apply_stages(df, *welch_stages(mean_1, var_1, n_1, mean_2, var_2, n_2, mask, prefix))


def ztest_stages(p_1, n_1, p_2, n_2, mask: Column | None = None, prefix: str = "", tag: str = "z"):
    o = {f: prefix + f for f in TEST_FIELDS}
    t = lambda n: f"_{tag}{n}"
    first, mk = _inputs(tag, mask, a=p_1, k1=n_1, b=p_2, k2=n_2)
    a, k1, b, k2, pool, den, se = (t(x) for x in ("a", "k1", "b", "k2", "pool", "den", "se"))
    d = f"`{o['diff_abs']}`"
    stages = [
        first,
        {o["diff_abs"]: f"{b} - {a}", pool: f"({a} * {k1} + {b} * {k2}) / ({k1} + {k2})"},
        {
            den: f"sqrt({pool} * (1 - {pool}) * (1D / {k1} + 1D / {k2}))",
            se: f"sqrt({a} * (1 - {a}) / {k1} + {b} * (1 - {b}) / {k2})",
            o["diff_ratio"]: _div_fill_sql(d, a, INF_SQL),
        },
        {o["statistic"]: _div_fill_sql(d, den, "0D")},
        {
            o["p_value"]: _guard(mk, _normal_p_sql(f"`{o['statistic']}`")),
            o["ci_lower"]: f"{d} - {se} * {Z_975!r}D",
            o["ci_upper"]: f"{d} + {se} * {Z_975!r}D",
        },
    ]
    return stages, [a, k1, b, k2, pool, den, se] + ([mk] if mk else [])


def ztest_proportion(df: DataFrame, p_1, n_1, p_2, n_2, mask: Column | None = None, prefix: str = "") -> DataFrame:
    """Two-proportion z-test: pooled statistic, unpooled confidence interval."""
    return apply_stages(df, *ztest_stages(p_1, n_1, p_2, n_2, mask, prefix))


def delta_ratio_variance(mean_n, var_n, mean_d, var_d, cov) -> Column:
    """Delta-method variance of ``mean_n / mean_d`` (per unit, not divided by n).

    NaN when the denominator mean is 0; tiny negative values from rounding become 0."""
    mn, vn, md, vd, c = (dbl(x) for x in (mean_n, var_n, mean_d, var_d, cov))
    raw = vn / (md * md) + mn * mn * vd / F.pow(md, 4.0) - 2.0 * mn * c / F.pow(md, 3.0)
    raw = F.when(md == 0, NAN()).otherwise(raw)
    return F.when((raw > -NEGATIVE_VARIANCE_TOLERANCE) & (raw < 0), F.lit(0.0)).otherwise(raw)


def ratio_stages(value_1, variance_1, value_2, variance_2, mask: Column | None = None, prefix: str = "", tag: str = "r"):
    o = {f: prefix + f for f in TEST_FIELDS}
    t = lambda n: f"_{tag}{n}"
    first, mk = _inputs(tag, mask, r1=value_1, w1=variance_1, r2=value_2, w2=variance_2)
    r1, w1, r2, w2, se = (t(x) for x in ("r1", "w1", "r2", "w2", "se"))
    d = f"`{o['diff_abs']}`"
    stat = (
        f"CASE WHEN isnan({se}) THEN {NAN_SQL} WHEN NOT {_near_zero_sql(se)} THEN {d} / {se} "
        f"WHEN {_near_zero_sql(d)} THEN 0D ELSE {_signed_inf_sql(d)} END"
    )
    ratio = (
        f"CASE WHEN isnan({r1}) THEN {NAN_SQL} WHEN NOT {_near_zero_sql(r1)} THEN {d} / {r1} "
        f"WHEN {_near_zero_sql(d)} THEN 0D ELSE {_signed_inf_sql(d)} END"
    )
    stages = [
        first,
        {o["diff_abs"]: f"{r2} - {r1}", se: f"sqrt({w1} + {w2})"},
        {o["statistic"]: stat, o["diff_ratio"]: ratio},
        {
            o["p_value"]: _guard(mk, _normal_p_sql(f"`{o['statistic']}`")),
            o["ci_lower"]: f"{d} - {se} * {Z_975!r}D",
            o["ci_upper"]: f"{d} + {se} * {Z_975!r}D",
        },
    ]
    return stages, [r1, w1, r2, w2, se] + ([mk] if mk else [])


def ratio_ztest(df: DataFrame, value_1, variance_1, value_2, variance_2, mask: Column | None = None, prefix: str = "") -> DataFrame:
    """z-test of two ratio values with given variances of the estimates."""
    return apply_stages(df, *ratio_stages(value_1, variance_1, value_2, variance_2, mask, prefix))


def delta_stages(
    value_1, mean_n_1, var_n_1, mean_d_1, var_d_1, cov_1, n_1,
    value_2, mean_n_2, var_n_2, mean_d_2, var_d_2, cov_2, n_2,
    mask: Column | None = None, prefix: str = "", tag: str = "d",
):
    """Delta-method variances per group (first stage), then the ratio z-test."""
    v1, v2 = f"_{tag}dv1", f"_{tag}dv2"
    variances = {
        v1: delta_ratio_variance(mean_n_1, var_n_1, mean_d_1, var_d_1, cov_1) / dbl(n_1),
        v2: delta_ratio_variance(mean_n_2, var_n_2, mean_d_2, var_d_2, cov_2) / dbl(n_2),
    }
    stages, temps = ratio_stages(value_1, F.col(v1), value_2, F.col(v2), mask, prefix, tag)
    return [variances] + stages, temps + [v1, v2]


def delta_ratio_test(
    df: DataFrame,
    value_1, mean_n_1, var_n_1, mean_d_1, var_d_1, cov_1, n_1,
    value_2, mean_n_2, var_n_2, mean_d_2, var_d_2, cov_2, n_2,
    mask: Column | None = None, prefix: str = "",
) -> DataFrame:
    """Delta-method test of two ratio metrics from their unit-level moments."""
    return apply_stages(df, *delta_stages(
        value_1, mean_n_1, var_n_1, mean_d_1, var_d_1, cov_1, n_1,
        value_2, mean_n_2, var_n_2, mean_d_2, var_d_2, cov_2, n_2, mask, prefix,
    ))


def input_violations(metric_type: Column, cols: dict) -> Column:
    """Array of rule codes a (control, compared) row breaks; empty when valid.

    The reference raises for the whole batch; here a bad row is marked and the
    other rows are still tested (``strict`` callers turn this into an error)."""
    checks = [
        ((cols["observation_cnt_control"] <= 0) | (cols["observation_cnt_compared"] <= 0), "non_positive_count"),
        ((metric_type == "avg") & ((cols["numerator_var_control"] < 0) | (cols["numerator_var_compared"] < 0)), "negative_variance"),
        (
            (metric_type == "proportion")
            & (
                (cols["metric_value_control"] < 0) | (cols["metric_value_control"] > 1)
                | (cols["metric_value_compared"] < 0) | (cols["metric_value_compared"] > 1)
            ),
            "proportion_out_of_range",
        ),
        (
            (metric_type == "ratio")
            & (
                (cols["numerator_var_control"] < 0) | (cols["numerator_var_compared"] < 0)
                | (cols["denominator_var_control"] < 0) | (cols["denominator_var_compared"] < 0)
            ),
            "negative_variance",
        ),
    ]
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in checks])))
