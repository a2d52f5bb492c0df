"""Assignment (test-id) sources: one row per unit and its group (S-4..S-7, W-1, W-2).

The first assignment per unit is found with ``min(struct(record_timestamp, ...))``
grouped by unit.  Spark runs it as a sort-based aggregate (struct buffers are
not hash-aggregate buffers) with a map-side partial step, so a unit with
millions of assignment rows costs one row per map task in the shuffle; it spills
rather than fails, and ties are deterministic because later struct fields
break them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import ts_lit

PLANNING_GROUP = "planning"


def first_per_unit(
    records: DataFrame,
    split_id: str,
    order_by: str = "record_timestamp",
    tie_break: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Earliest record per unit; returns ``split_id, first_split_timestamp, group_name, <keep>``.

    A NULL ``order_by`` sorts last.  Ties on it are broken by ``tie_break`` columns, then by the kept values."""
    tie_break = list(tie_break or [])
    keep = [c for c in (keep if keep is not None else [c for c in records.columns]) if c not in (split_id, order_by)]
    payload = [order_by] + [c for c in tie_break if c not in keep] + ["group_name"] + [c for c in keep if c != "group_name"]
    # a record without a time comes after all others, as in an ascending sort with NULLs last
    first = F.min(F.struct(F.col(order_by).isNull().alias("__timeless"), *[F.col(c) for c in payload])).alias("__first")
    out = records.groupBy(split_id).agg(first)
    cols = [F.col(split_id), F.col(f"__first.{order_by}").alias("first_split_timestamp"), F.col("__first.group_name").alias("group_name")]
    cols += [F.col(f"__first.{c}").alias(c) for c in keep if c not in ("group_name",)]
    return out.select(*cols)


def experiment_assignment(
    testids: DataFrame,
    split_id: str,
    experiment_name: str,
    tie_break: list[str] | None = None,
    attributes: list[str] | None = None,
) -> DataFrame:
    """Regular assignment: rows of one experiment, first per unit, no time bound."""
    rows = testids.where(F.col("experiment_name") == F.lit(experiment_name))
    keep = ["group_name"] + list(attributes or [])
    return first_per_unit(rows, split_id, tie_break=tie_break, keep=keep)


def planning_assignment(
    testids: DataFrame,
    split_id: str,
    start,
    end,
    tie_break: list[str] | None = None,
    attributes: list[str] | None = None,
) -> DataFrame:
    """Planning pseudo-assignment: every unit recorded in ``[start, end]`` (any
    experiment) in one group ``'planning'``."""
    rows = testids.where(F.col("record_timestamp").between(ts_lit(start), ts_lit(end)))
    rows = rows.withColumn("group_name", F.lit(PLANNING_GROUP))
    keep = ["group_name"] + list(attributes or [])
    return first_per_unit(rows, split_id, tie_break=tie_break, keep=keep)


def custom_assignment(spark: SparkSession, source, split_id: str) -> DataFrame:
    """User-supplied assignment: a DataFrame, or read-only SQL checked by the guard."""
    from ..operators.guard import audited_query

    df = source if isinstance(source, DataFrame) else audited_query(source, spark)
    df = df.toDF(*[c.lower() for c in df.columns])
    need = {split_id, "group_name", "record_timestamp"}
    missing = need - set(df.columns)
    if missing:
        raise ValueError(f"custom assignment is missing columns {sorted(missing)}")
    return first_per_unit(df, split_id, keep=[c for c in df.columns if c not in (split_id, "record_timestamp", "experiment_name")])
