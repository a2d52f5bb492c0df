"""Exposure and the unit/event join (W-3, A-24, J-1, J-2, F-2, P-2, W-4).

Plan shape (all keyed on the unit id, so one hash partitioning serves every step):

    assignment (1 row/unit) --inner--> first exposure (1 row/unit)       unit-level, small
          |  exposure window filter, audiences (semi)                    unit-level
          v
    events (visible window) --inner, ts >= split--> exposed units        the one event shuffle

Events are the streamed side of an inner join, so adaptive execution can split a
hot unit's partition; the unit side is broadcast only when its runtime size is
under the adaptive broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.events import ts_lit


def first_exposure(events: DataFrame, split_id: str, exposure_event: str) -> DataFrame:
    """``split_id, exposure_timestamp``: first event named ``exposure_event`` per unit.

    The name predicate reaches the scan; ``min`` aggregates partially per task."""
    return (
        events.where(F.col("event_name") == F.lit(exposure_event))
        .groupBy(split_id)
        .agg(F.min("event_timestamp").alias("exposure_timestamp"))
    )


def first_exposure_after_split(events: DataFrame, units: DataFrame, split_id: str, exposure_event: str) -> DataFrame:
    """Alternative rule: first exposure at or after the unit's split time."""
    exp = events.where(F.col("event_name") == F.lit(exposure_event)).select(split_id, "event_timestamp")
    joined = exp.join(units.select(split_id, "first_split_timestamp"), on=split_id, how="inner")
    joined = joined.where(F.col("event_timestamp") >= F.col("first_split_timestamp"))
    return joined.groupBy(split_id).agg(F.min("event_timestamp").alias("exposure_timestamp"))


def exposed_units(
    units: DataFrame,
    events: DataFrame,
    split_id: str,
    exposure_event: str | None,
    exposure_start,
    exposure_end,
    rule: str = "first",
) -> DataFrame:
    """Units with their exposure time, restricted to the exposure window.

    No exposure event: exposure = split time.  With one: units whose first
    exposure precedes the split are dropped (``rule='first'``), or the first
    exposure at/after the split is used (``rule='first_after_split'``)."""
    if exposure_event is None:
        out = units.withColumn("exposure_timestamp", F.col("first_split_timestamp"))
    else:
        if rule == "first":
            exp = first_exposure(events, split_id, exposure_event)
        else:
            exp = first_exposure_after_split(events, units, split_id, exposure_event)
        out = units.join(exp, on=split_id, how="inner").where(F.col("exposure_timestamp") >= F.col("first_split_timestamp"))
    return out.where(F.col("exposure_timestamp").between(ts_lit(exposure_start), ts_lit(exposure_end)))


def restrict_to_audiences(units: DataFrame, audiences: list[DataFrame], split_id: str, how: str = "semi") -> DataFrame:
    """Intersect units with every audience table.

    ``semi``: membership only (ids deduplicated first so a repeated hot id cannot
    skew the join).  ``inner``: the literal join, a unit repeated k times in an
    audience is counted k times downstream."""
    for aud in audiences:
        ids = aud.select(split_id)
        if how == "semi":
            units = units.join(ids.distinct(), on=split_id, how="left_semi")
        else:
            units = units.join(ids, on=split_id, how="inner")
    return units


def attach_events(units: DataFrame, events: DataFrame, split_id: str, keep_inactive: bool = False) -> DataFrame:
    """Event rows of each unit from its split time on (``ts >= first_split_timestamp``).

    ``keep_inactive``: units with no such event keep one row with NULL event
    columns (the reference's LEFT JOIN).  They are found from each unit's last event, so
    events are joined once, as the streamed side of an inner join."""
    ev_cols = [c for c in events.columns if c != split_id]
    clash = [c for c in ev_cols if c in units.columns]
    if clash:
        raise ValueError(f"event and unit columns overlap: {clash}")
    joined = events.join(units, on=split_id, how="inner").where(F.col("event_timestamp") >= F.col("first_split_timestamp"))
    if not keep_inactive:
        return joined
    # a unit has an event from its split on if its last one is: a maximum, which combines in tasks
    last = events.groupBy(split_id).agg(F.max("event_timestamp").alias("__last"))
    inactive = units.join(last, on=split_id, how="left").where(F.col("__last").isNull() | (F.col("__last") < F.col("first_split_timestamp"))).drop("__last")
    schema = {f.name: f.dataType for f in events.schema.fields}
    for c in ev_cols:
        inactive = inactive.withColumn(c, F.lit(None).cast(schema[c]))
    return joined.unionByName(inactive)


ROWS_PER_RANGE = 2_000_000  # rows of one (unit, event name) that are numbered together, about


def hot_ranges(events: DataFrame, split_id: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``split_id, event_name, cuts``: for each (unit, event name) of more than
    ``rows_per_range`` rows the times that cut its rows into ranges of about that many.

    Counts combine in tasks; quantiles are taken of hot keys only, and their sketches
    combine in tasks too.  Written to the checkpoint folder, so that every reader and
    every rerun of a task sees the same cuts."""
    keys = [split_id, "event_name"]
    rows = events.select(*keys, F.unix_micros(F.col("event_timestamp").cast("timestamp")).alias("__t"))
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_range)
    hot = hot.withColumn("__wanted", F.ceil(F.col("__n") / rows_per_range)).withColumnsRenamed({k: f"__h_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys]
    found = rows.join(hot, on=same, how="inner").groupBy(*keys, "__wanted").agg(F.percentile_approx("__t", [k / MOST_RANGES for k in range(1, MOST_RANGES)], 20 * MOST_RANGES).alias("__q"))
    # every so many-th quantile is a cut
    step = F.greatest(F.lit(1), F.floor(F.lit(MOST_RANGES) / F.col("__wanted")).cast("int"))
    cuts = F.array_distinct(F.filter("__q", lambda x, k: (k + 1) % step == 0))
    return materialize(found.select(*keys, cuts.alias("cuts")))


def hot_events(events: DataFrame, cuts: DataFrame, split_id: str) -> DataFrame:
    """Events of the keys of ``cuts``: unit, name and time."""
    keys = [split_id, "event_name"]
    hot = cuts.select(*[F.col(k).alias(f"__h_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys]
    return events.select(*keys, "event_timestamp").join(hot, on=same, how="left_semi")


MOST_RANGES = 200  # cuts of the hottest key


def with_event_row_number(
    df: DataFrame,
    split_id: str,
    tie_break: list[str] | None = None,
    strategy: str = "ranges",
    rows_per_range: int = ROWS_PER_RANGE,
    cuts: DataFrame | None = None,
    hot_rows: DataFrame | None = None,
) -> DataFrame:
    """``event_row_number``: 1, 2, ... per (unit, event_name) in time order.

    Added only when a formula or filter refers to it.  Extra ``tie_break`` columns
    make equal timestamps deterministic.

    ``strategy="window"``: one window per (unit, event_name); it reuses the unit
    partitioning of the event join (no extra shuffle) but a unit with a huge
    share of all events is numbered by one task.

    ``strategy="ranges"`` (default, skew-safe, exact): the rows of a hot (unit, event_name)
    are cut into time ranges of about equal counts and numbered range by range; running
    sums over the counts of ranges (a small table) shift the numbers.  ``cuts`` is the
    table of ``hot_ranges`` and ``hot_rows`` the rows of its keys (unit, name and time are
    read), so that the joined rows themselves are gone through once; both come from
    ``df`` if not given.  Without hot keys this is the window.  Events of one unit, name
    and microsecond stay together."""
    keys = [split_id, "event_name"]
    order = [F.col("event_timestamp").asc_nulls_first()] + [F.col(c) for c in (tie_break or [])]
    if strategy not in ("ranges", "window"):
        raise ValueError("strategy must be 'ranges' or 'window'")
    if strategy == "ranges" and cuts is None:
        cuts, hot_rows = hot_ranges(df, split_id, rows_per_range), df
    if strategy == "window" or cuts.isEmpty():
        return df.withColumn("event_row_number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    hot = cuts.withColumnsRenamed({k: f"__h_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys]
    place = F.size(F.filter("cuts", lambda x: x < F.unix_micros(F.col("event_timestamp").cast("timestamp"))))
    # one key that is never NULL, for nameless events too: the last join then needs no exchange of the rows
    dealt = lambda rows, how: rows.join(hot, on=same, how=how).withColumns({"__key": F.struct(*keys), "__range": F.coalesce(place, F.lit(0))})
    counts = dealt(hot_rows, "inner").groupBy("__key", "__range").agg(F.count(F.lit(1)).alias("__n"))
    prior = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__key", "__range", F.coalesce(F.sum("__n").over(prior), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__key", "__range").orderBy(*order)
    numbered = dealt(df, "left").withColumn("__local", F.row_number().over(inside))
    out = numbered.join(offsets, on=["__key", "__range"], how="left")
    number = (F.col("__local") + F.coalesce(F.col("__offset"), F.lit(0))).cast("int")
    return out.select(*df.columns, number.alias("event_row_number"))
