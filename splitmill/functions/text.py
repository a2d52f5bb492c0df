"""Scalar helpers: text, dates, JSON fields (F-12..F-14, F-18, F-19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT = 2000
TRUNCATION_MARK = " …[truncated]"  # fixed value


def truncate(c: Column, limit: int = MAX_TEXT, mark: str = TRUNCATION_MARK) -> Column:
    """Texts longer than ``limit`` are cut and marked (F-12)."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def split_lines(c: Column) -> Column:
    """Lines of a text, stripped of white space (tabs too), blanks dropped (F-19): one filter per line."""
    return F.filter(F.transform(F.split(c, "\\r?\\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end`` (F-13)."""
    return F.date_diff(F.to_date(end), F.to_date(start))


def utc_midnight(ts: Column | None = None) -> Column:
    """Start of the (UTC) day; the session time zone is UTC (F-14)."""
    return F.date_trunc("day", ts if ts is not None else F.current_timestamp())


def json_list(c: Column) -> Column:
    """JSON text list -> ARRAY<STRING> (F-18)."""
    return F.from_json(c, "array<string>")


def json_map(c: Column) -> Column:
    """JSON object text -> MAP<STRING,STRING> (F-18)."""
    return F.from_json(c, "map<string,string>")
