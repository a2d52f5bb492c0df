"""Event sources (S-1..S-3) and their union (U-1).

An event source is any DataFrame with ``<split_id>, event_name, event_value,
event_timestamp`` (+ optional attribute columns).  Bounds become parquet
predicates; only the referenced columns are read."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_COLUMNS = ("event_name", "event_value", "event_timestamp")


def ts_lit(value) -> Column:
    """Wall-clock literal as TIMESTAMP_NTZ (no session or Python time-zone shift);
    it folds to a constant, so comparisons with a column still reach the scan."""
    if isinstance(value, datetime):
        return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    if isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    return value if isinstance(value, Column) else F.lit(value)


def bounded(events: DataFrame, start, end, ts_col: str = "event_timestamp", date_col: str | None = None) -> DataFrame:
    """Rows with ``start <= ts <= end`` (closed interval).

    ``date_col``: a DATE partition column of the event table (``partitionBy``
    on write); the same bounds on it prune whole directories before any file
    is opened."""
    out = events.where(F.col(ts_col).between(ts_lit(start), ts_lit(end)))
    if date_col is not None and isinstance(start, datetime) and isinstance(end, datetime):
        out = out.where(F.col(date_col).between(F.lit(start.date()), F.lit(end.date())))
    return out


def union_sources(*sources: DataFrame) -> DataFrame:
    """UNION ALL by column name; every source must have the same columns."""
    if not sources:
        raise ValueError("at least one event source is required")
    return reduce(lambda a, b: a.unionByName(b), sources)


def visible_events(sources: list[DataFrame] | DataFrame, start, end, date_col: str | None = None) -> DataFrame:
    """All sources, each bounded to ``[start, end]`` before the union so every scan prunes."""
    if isinstance(sources, DataFrame):
        sources = [sources]
    bounded_sources = [bounded(s, start, end, date_col=date_col if date_col in s.columns else None) for s in sources]
    out = union_sources(*bounded_sources)
    return out.drop(date_col) if date_col is not None and date_col in out.columns else out
