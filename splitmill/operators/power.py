"""Sample-size planning (T-8..T-13, P-27, A-25, J-6).

Input: precompute rows of a planning run (one group).  Each metric row is
expanded over the effect grid with ``explode`` (a generate, no join), then sized
by a per-type column formula; means use the Arrow UDF of the t-test solver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import noncentral
from ..functions.dist import NORM_PPF_ALPHA_TWO_SIDED, NORM_PPF_BETA
from ..functions.safe import NAN, dbl
from .stats import delta_ratio_variance

DEFAULT_EFFECTS = [0.005 + i * 0.005 for i in range(21)]  # 0.005 .. 0.105, as numpy.arange(0.005, 0.11, 0.005)


def _check(alpha: float, beta: float):
    if alpha not in NORM_PPF_ALPHA_TWO_SIDED:
        raise ValueError(f"alpha must be one of {list(NORM_PPF_ALPHA_TWO_SIDED)}")
    if beta not in NORM_PPF_BETA:
        raise ValueError(f"beta must be one of {list(NORM_PPF_BETA)}")
    return NORM_PPF_ALPHA_TWO_SIDED[alpha], NORM_PPF_BETA[beta]


def slider_effects(low_pct: float, high_pct: float) -> list[float]:
    """Effect grid of the planner form: ``range(int(10 lo), int(10 hi)) / 1000`` (end excluded)."""
    return [i / 1000 for i in range(int(10 * low_pct), int(10 * high_pct))]


def sample_size_proportion(p1, effect, alpha: float = 0.05, beta: float = 0.2) -> Column:
    """``ceil((z_a + z_b)^2 (p1 (1-p1) + p2 (1-p2)) / (p1 - p2)^2)``, ``p2 = p1 (1 + e)``;
    NULL unless both proportions lie strictly inside (0, 1)."""
    za, zb = _check(alpha, beta)
    p1, e = dbl(p1), dbl(effect)
    p2 = p1 + p1 * e
    n = F.pow(F.lit(za + zb), 2.0) * (p1 * (1.0 - p1) + p2 * (1.0 - p2)) / F.pow(p1 - p2, 2.0)
    valid = (p1 > 0) & (p1 < 1) & (p2 > 0) & (p2 < 1) & (p1 != p2)
    return F.when(valid, F.ceil(n).cast("double"))


def sample_size_ratio(mean_n, var_n, mean_d, var_d, cov, effect, alpha: float = 0.05, beta: float = 0.2) -> Column:
    """``ceil(2 (z_a + z_b)^2 Var_delta / (ratio e)^2)``, ``ratio = mean_n / mean_d``;
    NULL for a zero effect or zero denominator mean."""
    za, zb = _check(alpha, beta)
    mn, md, e = dbl(mean_n), dbl(mean_d), dbl(effect)
    var = delta_ratio_variance(mean_n, var_n, mean_d, var_d, cov)
    ratio = F.when(md != 0, mn / md)
    diff = ratio * (1.0 + e) - ratio
    n = F.lit(2.0 * (za + zb) ** 2) * var / (diff * diff)
    return F.when((e != 0) & (md != 0) & (diff != 0), F.ceil(n).cast("double"))


def sample_size_mean_udf(alpha: float = 0.05, beta: float = 0.2):
    """Arrow UDF ``(avg, var, effect) -> units per group`` (vectorised bisection per batch)."""
    za, zb = _check(alpha, beta)

    @F.pandas_udf("double")
    def _size(avg: pd.Series, var: pd.Series, effect: pd.Series) -> pd.Series:
        out = noncentral.t_test_sample_size(avg.to_numpy(float), var.to_numpy(float), effect.to_numpy(float), alpha, beta, za, zb)
        return pd.Series(out)

    return _size


def plan_sample_sizes(
    precomputed: DataFrame,
    effects: list[float] | None = None,
    reference_days: int = 14,
    alpha: float = 0.05,
    beta: float = 0.2,
    keys: list[str] | None = None,
    n_groups: int = 1,
) -> DataFrame:
    """One row per (keys, metric, effect): ``sample_size`` per group, observations
    per day (units / reference days) and ``days`` = size x n_groups / daily units.

    Proportion rows whose target leaves (0, 1) are dropped (P-27); effect 0 gives NULL."""
    if reference_days is None or reference_days <= 0:
        raise ValueError("reference_days must be a positive integer")
    _check(alpha, beta)
    keys = list(keys or [])
    grid = list(effects) if effects else DEFAULT_EFFECTS
    from ..session import ensure_worker_path

    ensure_worker_path(precomputed.sparkSession)
    rows = precomputed.withColumn("effect_size", F.explode(F.array(*[F.lit(float(e)) for e in grid])))
    t = F.col("metric_type")
    size = (
        F.when(t == "proportion", sample_size_proportion(F.col("metric_value"), F.col("effect_size"), alpha, beta))
        .when(t == "ratio", sample_size_ratio(F.col("numerator_avg"), F.col("numerator_var"), F.col("denominator_avg"),
                                              F.col("denominator_var"), F.col("covariance"), F.col("effect_size"), alpha, beta))
    )
    p2 = F.col("metric_value") * (1.0 + F.col("effect_size"))
    rows = rows.where((t != "proportion") | ((p2 > 0) & (p2 < 1)))
    # the Arrow UDF sees only mean rows (a UDF inside when() would run on every row)
    size_avg = sample_size_mean_udf(alpha, beta)(F.col("metric_value"), F.col("numerator_var"), F.col("effect_size"))
    means = rows.where(t == "avg").withColumn("sample_size", size_avg)
    others = rows.where(t != "avg").withColumn("sample_size", size)
    rows = means.unionByName(others)
    per_day = F.col("observation_cnt").cast("double") / F.lit(float(reference_days))
    return rows.select(
        *keys, "metric_name", "metric_type", "group_name", "effect_size", "sample_size",
        per_day.alias("observations_per_day"),
        (F.col("sample_size") * F.lit(float(n_groups)) / per_day).alias("days"),
    )


def metrics_without_effects(precomputed: DataFrame, plan: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Metrics of the planning run for which no effect size is usable (e.g. a
    proportion whose target leaves (0, 1) for every effect); the reference
    raises for these, here they are reported as rows."""
    keys = list(keys or [])
    on = keys + ["metric_name"]
    return precomputed.select(*on, "metric_type").distinct().join(plan.select(*on).distinct(), on=on, how="left_anti")
