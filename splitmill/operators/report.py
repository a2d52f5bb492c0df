"""Result presentation as DataFrame steps (J-7, P-19, P-21, P-28, P-29, R-3, R-4, K-5, K-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.safe import nan_to_null
from .significance import significance_flag

OTHER_GROUP = "Other"
ISO_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def with_metric_group(table: DataFrame, catalog: DataFrame) -> DataFrame:
    """Left join of the metric catalog (Spark broadcasts it if its measured size allows);
    unknown metrics get group ``"Other"``."""
    cat = catalog.select(
        F.col("metric_name").alias("__m"), F.col("metric_group").alias("__group"), F.col("tags").alias("__tags")
    )
    out = table.join(cat, table["metric_name"] == cat["__m"], "left")
    return out.withColumn("metric_group", F.coalesce(F.col("__group"), F.lit(OTHER_GROUP))).withColumn(
        "metric_tags", F.coalesce(F.col("__tags"), F.array().cast("array<string>"))
    ).withColumn("__known", F.col("__m").isNotNull()).drop("__m", "__group", "__tags")


def metric_filter(groups: list[str] | None = None, tags: list[str] | None = None) -> Column:
    """Group OR any-tag; unknown metrics always pass; no filter passes everything."""
    if not groups and not tags:
        return F.lit(True)
    cond = F.lit(False)
    if groups:
        cond = cond | F.col("metric_group").isin(list(groups))
    if tags:
        cond = cond | F.arrays_overlap(F.col("metric_tags"), F.array(*[F.lit(t) for t in tags]))
    return cond | ~F.col("__known")


def present(
    table: DataFrame,
    catalog: DataFrame,
    threshold: float | None = 0.05,
    groups: list[str] | None = None,
    tags: list[str] | None = None,
    compared_groups: list[str] | None = None,
) -> DataFrame:
    """Label, filter and flag a significance table, ordered by metric group."""
    out = with_metric_group(table, catalog)
    out = out.withColumn("metric_display_name", F.coalesce(F.col("metric_display_name"), F.col("metric_name")))
    out = out.where(metric_filter(groups, tags))
    if compared_groups is not None:
        out = out.where(F.col("group_name_compared").isin(list(compared_groups)))
    out = out.withColumn("is_significant", significance_flag(F.col("p_value"), threshold))
    return out.drop("__known")


def per_compared_group(table: DataFrame, group: str) -> DataFrame:
    """One table per compared group (R-3)."""
    return table.where(F.col("group_name_compared") == F.lit(group))


def per_metric_group(table: DataFrame, metric_group: str) -> DataFrame:
    """Sub-table of one metric group (R-4)."""
    return table.where(F.col("metric_group") == F.lit(metric_group))


def rounded(table: DataFrame, digits: int = 5) -> DataFrame:
    """Export form: every double rounded to ``digits`` places (K-5)."""
    return table.select(
        *[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in table.schema.fields]
    )


def json_lines(table: DataFrame) -> DataFrame:
    """One JSON document per row; NaN and +-Inf become null, timestamps ISO (K-6)."""
    cols = []
    for f in table.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        cols.append(c.alias(f.name))
    return table.select(F.to_json(F.struct(*cols), {"timestampFormat": ISO_TS, "timestampNTZFormat": ISO_TS, "ignoreNullFields": "false"}).alias("json"))


def significant_digits(table: DataFrame, digits: int = 10, columns: list[str] | None = None) -> DataFrame:
    """Doubles (all, or ``columns``) printed with ``digits`` significant digits and read back."""
    names = columns if columns is not None else [f.name for f in table.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return comparable(table, sig_digits={c: digits for c in names})


def fixed_decimals(table: DataFrame, decimals: int = 6, columns: list[str] | None = None) -> DataFrame:
    """Doubles (all, or ``columns``) printed with ``decimals`` places and read back."""
    names = columns if columns is not None else [f.name for f in table.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return comparable(table, decimals={c: decimals for c in names})


def comparable(table: DataFrame, sig_digits: dict[str, int] | None = None, decimals: dict[str, int] | None = None) -> DataFrame:
    """One projection printing chosen doubles to fixed significant digits or decimals
    (stable across engines whose sums differ in the last bits)."""
    sig_digits, decimals = dict(sig_digits or {}), dict(decimals or {})
    out = []
    for f in table.schema.fields:
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, T.DoubleType):
            pass
        elif f.name in sig_digits:
            c = F.when(c.isNotNull(), F.format_string(f"%.{sig_digits[f.name] - 1}e", c).cast("double"))
        elif f.name in decimals:
            c = F.when(c.isNotNull(), F.format_string(f"%.{decimals[f.name]}f", c).cast("double"))
        out.append(c.alias(f.name))
    return table.select(*out)
