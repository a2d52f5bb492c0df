"""Sufficient statistics per (group, metric) in one pass (A-9..A-20, R-1).

All metrics of all groups come from ONE hash aggregate over the unit table; the
wide row per group is turned long with ``inline(array(struct ...))`` (a narrow
generate, no second pass and no UNION of per-metric scans)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import MetricSpec

PRECOMPUTE_COLUMNS = [
    "group_name", "metric_name", "metric_display_name", "metric_type", "observation_cnt", "metric_value",
    "numerator_avg", "numerator_var", "denominator_avg", "denominator_var", "covariance",
]
PRECOMPUTE_SCHEMA = T.StructType(
    [
        T.StructField("group_name", T.StringType(), False),
        T.StructField("metric_name", T.StringType(), False),
        T.StructField("metric_display_name", T.StringType(), True),
        T.StructField("metric_type", T.StringType(), False),
        T.StructField("observation_cnt", T.LongType(), False),
        T.StructField("metric_value", T.DoubleType(), False),
        T.StructField("numerator_avg", T.DoubleType(), True),
        T.StructField("numerator_var", T.DoubleType(), True),
        T.StructField("denominator_avg", T.DoubleType(), True),
        T.StructField("denominator_var", T.DoubleType(), True),
        T.StructField("covariance", T.DoubleType(), True),
    ]
)


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _str_lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def precompute(unit_df: DataFrame, metrics: list[MetricSpec], split_id: str, keys: list[str] | None = None) -> DataFrame:
    """Long table: one row per (keys..., group, metric) with the 11 contract columns.

    ``observation_cnt`` counts units; the unit table has one row per (unit, group),
    so a plain count replaces ``COUNT(DISTINCT)`` (which would add two aggregation
    levels).  Moments not defined for a metric type are typed NULLs.  The
    aggregate list and the wide -> long projection are generated as SQL text (one
    call to the JVM each), so catalogs with hundreds of metrics plan quickly."""
    keys = list(keys or [])
    if not metrics:
        raise ValueError("no metrics to compute")
    aggs = [f"count({_ident(split_id)}) AS __n"]
    entries = []
    null = "CAST(NULL AS DOUBLE)"
    for i, m in enumerate(metrics):
        n = f"CAST({_ident(m.numerator.alias)} AS DOUBLE)"
        aggs.append(f"CAST({m.value_sql()} AS DOUBLE) AS __v{i}")
        if m.type == "avg":
            aggs.append(f"var_samp({n}) AS __nv{i}")
            moments = [null, f"__nv{i}", null, null, null]
        elif m.type == "ratio":
            d = f"CAST({_ident(m.denominator.alias)} AS DOUBLE)"
            aggs += [f"avg({n}) AS __na{i}", f"var_samp({n}) AS __nv{i}", f"avg({d}) AS __da{i}",
                     f"var_samp({d}) AS __dv{i}", f"covar_samp({n}, {d}) AS __cv{i}"]
            moments = [f"__na{i}", f"__nv{i}", f"__da{i}", f"__dv{i}", f"__cv{i}"]
        else:  # proportion
            moments = [null] * 5
        fields = [
            ("metric_name", _str_lit(m.alias)), ("metric_display_name", _str_lit(m.label)), ("metric_type", _str_lit(m.type)),
            ("metric_value", f"__v{i}"), ("numerator_avg", moments[0]), ("numerator_var", moments[1]),
            ("denominator_avg", moments[2]), ("denominator_var", moments[3]), ("covariance", moments[4]),
        ]
        entries.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields) + ")")
    wide = unit_df.groupBy(*keys, "group_name").agg(*[F.expr(a) for a in aggs])
    long = wide.select(*keys, "group_name", F.col("__n").alias("observation_cnt"), F.expr(f"inline(array({', '.join(entries)}))"))
    return long.select(*keys, *PRECOMPUTE_COLUMNS)


def group_sizes(precomputed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Units per group for display / SRM: max ``observation_cnt`` per group."""
    keys = list(keys or [])
    return precomputed.groupBy(*keys, "group_name").agg(F.max("observation_cnt").alias("observation_cnt"))
