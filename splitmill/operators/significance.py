"""Control choice, control-vs-compared join and per-type tests (T-6, T-7, J-5, R-2, P-28).

Input: a precompute table (optionally with analysis keys such as ``job_id``).
Output: one row per (keys, metric, compared group).  Many analyses are tested in
the same job by passing their key columns; nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stats

MOMENTS = ["observation_cnt", "metric_value", "numerator_avg", "numerator_var", "denominator_avg", "denominator_var", "covariance"]
METRIC_KEYS = ["metric_name", "metric_type", "metric_display_name"]
DEFAULT_PIVOT_COLUMNS = ["metric_value_control", "metric_value_compared", "ci_lower", "ci_upper", "diff_abs", "diff_ratio", "p_value", "statistic"]


NUMERIC_INPUTS = ["observation_cnt", "metric_value", "numerator_avg", "denominator_avg", "numerator_var", "denominator_var", "covariance"]
TEXT_INPUTS = ["group_name", "metric_name", "metric_display_name", "metric_type"]


def validate_input(precomputed: DataFrame) -> DataFrame:
    """Schema checks before testing (P-26): required columns present, moments numeric.

    Emptiness and the two-group rule are data properties; they are enforced per
    analysis inside ``significance_table`` (no extra job here)."""
    from pyspark.sql import types as T

    missing = [c for c in NUMERIC_INPUTS + TEXT_INPUTS if c not in precomputed.columns]
    if missing:
        raise ValueError(f"precomputed metrics are missing required columns: {missing}")
    for c in NUMERIC_INPUTS:
        if not isinstance(precomputed.schema[c].dataType, T.NumericType):
            raise TypeError(f"Column {c} must be numeric")
    return precomputed


def control_groups(precomputed: DataFrame, control_group: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """``keys..., control_group, n_groups``.

    The explicit group wins if present; else the alphabetically first group whose
    name contains "control" (any case); else the alphabetically first group.
    (The reference takes "first" in row order, which a distributed table lacks.)"""
    keys = list(keys or [])
    g = precomputed.select(*keys, "group_name").distinct()
    explicit = F.lit(False) if control_group is None else (F.col("group_name") == F.lit(control_group))
    priority = F.when(explicit, 0).when(F.lower("group_name").contains("control"), 1).otherwise(2)
    pick = F.min(F.struct(priority.alias("p"), F.col("group_name").alias("g")))
    return g.groupBy(*keys).agg(pick["g"].alias("control_group"), F.count("*").alias("n_groups"))


def _suffixed(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    return df.select(
        *keys, *METRIC_KEYS, F.col("group_name").alias(f"group_name_{suffix}"),
        *[F.col(m).alias(f"{m}_{suffix}") for m in MOMENTS],
    )


def significance_table(
    precomputed: DataFrame,
    control_group: str | None = None,
    keys: list[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Control vs every other group, per (keys, metric), with the test of the metric's type.

    A small aggregate per analysis picks the control group and is joined back, a window per (analysis, metric) puts the control moments on every
    compared row (the reference's left join, NULL-safe on the display name).
    Metrics only in a compared group drop out; metrics only in control keep one
    row with NULL compared values.  Analyses with fewer than two groups yield no
    rows (``strict`` raises).  Invalid inputs (negative variance, proportion
    outside [0, 1], non-positive count) get NULL test columns and are named in
    ``input_errors`` (``strict`` raises)."""
    keys = list(keys or [])
    validate_input(precomputed)
    c = F.col
    w_m = Window.partitionBy(*keys, *METRIC_KEYS)
    chosen = control_groups(precomputed, control_group, keys).select(*[c(k).alias(f"__k_{k}") for k in keys], c("control_group").alias("group_name_control"), c("n_groups").alias("__n_groups"))
    # a row per analysis; without keys one row in all
    same = [c(k).eqNullSafe(c(f"__k_{k}")) for k in keys]
    df = (precomputed.join(chosen, on=same) if keys else precomputed.crossJoin(F.broadcast(chosen))).drop(*[f"__k_{k}" for k in keys])
    is_ctl = c("group_name") == c("group_name_control")
    df = df.withColumns({
        **{f"{m}_control": F.max(F.when(is_ctl, c(m))).over(w_m) for m in MOMENTS},
        "__has_ctl": F.max(is_ctl.cast("int")).over(w_m),
        "__rows": F.count(F.lit(1)).over(w_m),
    })
    if strict:
        df = df.withColumn("__n_groups", F.when(c("__n_groups") >= 2, c("__n_groups")).otherwise(F.raise_error(F.lit("fewer than two groups"))))
    keep = (c("__has_ctl") == 1) & (c("__n_groups") >= 2) & (~is_ctl | (c("__rows") == 1))
    df = df.where(keep)
    joined = df.select(
        *keys, *METRIC_KEYS, "group_name_control",
        F.when(~is_ctl, c("group_name")).alias("group_name_compared"),
        *[c(f"{m}_control") for m in MOMENTS],
        *[F.when(~is_ctl, c(m)).alias(f"{m}_compared") for m in MOMENTS],
    )
    t = c("metric_type")
    errors = stats.input_violations(t, {name: c(name) for name in joined.columns})
    joined = joined.withColumn("input_errors", errors)
    if strict:
        joined = joined.withColumn(
            "input_errors",
            F.when(F.size("input_errors") == 0, c("input_errors")).otherwise(
                F.raise_error(F.concat(F.lit("invalid test input: "), F.array_join("input_errors", ",")))
            ),
        )
    valid = (F.size("input_errors") == 0) & c("group_name_compared").isNotNull()
    is_avg, is_ratio, is_prop = valid & (t == "avg"), valid & (t == "ratio"), valid & (t == "proportion")
    # the three tests side by side: stage i of each in one projection
    plan = stats.merge_stages(
        stats.welch_stages(
            c("metric_value_control"), c("numerator_var_control"), c("observation_cnt_control"),
            c("metric_value_compared"), c("numerator_var_compared"), c("observation_cnt_compared"),
            mask=is_avg, prefix="__w_",
        ),
        stats.delta_stages(
            c("metric_value_control"), c("numerator_avg_control"), c("numerator_var_control"),
            c("denominator_avg_control"), c("denominator_var_control"), c("covariance_control"), c("observation_cnt_control"),
            c("metric_value_compared"), c("numerator_avg_compared"), c("numerator_var_compared"),
            c("denominator_avg_compared"), c("denominator_var_compared"), c("covariance_compared"), c("observation_cnt_compared"),
            mask=is_ratio, prefix="__r_",
        ),
        stats.ztest_stages(
            c("metric_value_control"), c("observation_cnt_control"), c("metric_value_compared"), c("observation_cnt_compared"),
            mask=is_prop, prefix="__z_",
        ),
    )
    out = stats.apply_stages(joined, *plan)
    pick = {
        f: F.when(is_avg, c(f"__w_{f}")).when(is_ratio, c(f"__r_{f}")).when(is_prop, c(f"__z_{f}")).alias(f)
        for f in stats.TEST_FIELDS
    }
    return out.select(*joined.columns[:-1], *pick.values(), "input_errors")


def significance_pivot(
    table: DataFrame,
    groups: list[str],
    columns: list[str] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Long -> wide: one block of ``columns`` per compared group, named
    ``<group>__<column>``, blocks in the given group order, then the metric keys.

    The group list is explicit, so the pivot needs no extra job to find values."""
    keys = list(keys or [])
    columns = list(columns or DEFAULT_PIVOT_COLUMNS)
    src = table.where(F.col("group_name_compared").isin(groups))
    piv = src.groupBy(*keys, *METRIC_KEYS).pivot("group_name_compared", groups).agg(*[F.first(c).alias(c) for c in columns])
    if len(columns) == 1:  # Spark names a single-aggregate pivot column by the value only
        piv = piv.select(*keys, *METRIC_KEYS, *[F.col(f"`{g}`").alias(f"{g}__{columns[0]}") for g in groups])
    else:
        piv = piv.select(*keys, *METRIC_KEYS, *[F.col(f"`{g}_{c}`").alias(f"{g}__{c}") for g in groups for c in columns])
    return piv.select(*keys, *[f"{g}__{c}" for g in groups for c in columns], *METRIC_KEYS)


def significance_flag(p_value: Column, threshold: float | None = 0.05) -> Column:
    """``p < threshold``; NaN / NULL p is never significant; no threshold = 0."""
    thr = 0.0 if threshold is None else float(threshold)
    return F.coalesce(~F.isnan(p_value) & (p_value < F.lit(thr)), F.lit(False))
