"""Unit aggregation (A-1..A-8, P-14..P-17): one row per (unit, group), one column per formula."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import FormulaSpec
from ..sources.events import ts_lit
from .guard import audited_expression


def row_filter(filters) -> Column | None:
    """AND of user predicates, each audited and parenthesised so an ``OR`` inside cannot leak."""
    parts = [audited_expression(f"({f})") for f in (filters or []) if f and f.strip()]
    return reduce(lambda a, b: a & b, parts) if parts else None


def calc_window(start, end, keep_inactive: bool = False) -> Column:
    cond = F.col("event_timestamp").between(ts_lit(start), ts_lit(end))
    return cond | F.col("event_timestamp").isNull() if keep_inactive else cond


def formula_columns(formulas: list[FormulaSpec]) -> list[Column]:
    return [audited_expression(f.sql).alias(f.alias) for f in formulas]


def unit_aggregate(events_joined: DataFrame, split_id: str, formulas: list[FormulaSpec]) -> DataFrame:
    """``GROUP BY split_id, group_name`` with every formula in one hash aggregate.

    After a sort-merge event join (large unit tables) the rows are already
    hash-partitioned by the unit id and this adds no shuffle; after a broadcast
    join the partial aggregate runs first and only its output is shuffled."""
    if not formulas:
        raise ValueError("no unit formulas to compute")
    return events_joined.groupBy(split_id, "group_name").agg(*formula_columns(formulas))


def references_row_number(formulas: list[FormulaSpec], filters) -> bool:
    texts = [f.sql for f in formulas] + list(filters or [])
    return any("event_row_number" in t for t in texts)
