"""One observation, end to end: events + assignments -> unit table -> precompute.

Everything here only builds a lazy DataFrame; the caller decides where it goes
(write, report, test).  The scenario registry (X-3) maps a scenario name to a
builder with the same signature, so a site can plug in its own data layout."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exposure as X
from ..operators import unit_agg as U
from ..operators.precompute import precompute
from ..sources import assignment as A
from ..sources.catalog import MetricSpec, filter_metrics, required_formulas
from ..sources.events import ts_lit, visible_events
from .observation import PLANNING, Observation


@dataclass
class Inputs:
    """Tables an observation reads.

    ``events``: one DataFrame or a list of sources with identical columns.
    ``testids``: assignment log (``split_id, experiment_name, group_name, record_timestamp, ...``).
    ``audiences``: DataFrames holding the unit id column.
    ``custom_assignment``: optional DataFrame or read-only SQL replacing ``testids``."""

    events: DataFrame | list[DataFrame]
    testids: DataFrame | None = None
    audiences: list[DataFrame] = field(default_factory=list)
    custom_assignment: DataFrame | str | None = None
    assignment_tie_break: list[str] = field(default_factory=list)
    assignment_attributes: list[str] = field(default_factory=list)
    event_tie_break: list[str] = field(default_factory=list)
    event_date_col: str | None = None  # DATE partition column of the event tables, for pruning
    row_number_strategy: str = "ranges"
    rows_per_range: int = X.ROWS_PER_RANGE


def assigned_units(spark: SparkSession, inputs: Inputs, obs: Observation) -> DataFrame:
    if inputs.custom_assignment is not None:
        return A.custom_assignment(spark, inputs.custom_assignment, obs.split_id)
    if obs.purpose == PLANNING:
        return A.planning_assignment(
            inputs.testids, obs.split_id, obs.exposure_start, obs.calc_end,
            tie_break=inputs.assignment_tie_break, attributes=inputs.assignment_attributes,
        )
    if obs.experiment_name is None:
        raise ValueError("a regular observation needs experiment_name")
    return A.experiment_assignment(
        inputs.testids, obs.split_id, obs.experiment_name,
        tie_break=inputs.assignment_tie_break, attributes=inputs.assignment_attributes,
    )


def reduced_events(inputs: Inputs, obs: Observation, events: DataFrame) -> DataFrame:
    """Events of units that the assignment log names for this observation, before anything is
    shuffled: a semi join, which Spark runs as a broadcast if the ids are few, and else below a
    runtime filter made of them (``session.cluster_conf``); the event join that follows
    reuses its exchange."""
    if inputs.custom_assignment is not None or inputs.testids is None:
        return events
    if obs.purpose == PLANNING:
        rows = inputs.testids.where(F.col("record_timestamp").between(ts_lit(obs.exposure_start), ts_lit(obs.calc_end)))
    else:
        rows = inputs.testids.where(F.col("experiment_name") == F.lit(obs.experiment_name))
    return events.join(rows.select(obs.split_id), on=obs.split_id, how="left_semi")


def joined_events(spark: SparkSession, inputs: Inputs, obs: Observation, formulas=()) -> DataFrame:
    """Event rows of exposed, assigned units (before the calculation window)."""
    events = visible_events(inputs.events, obs.exposure_start, obs.calc_end, inputs.event_date_col)
    units = assigned_units(spark, inputs, obs)
    units = X.exposed_units(units, events, obs.split_id, obs.exposure_event, obs.exposure_start, obs.exposure_end, obs.exposure_rule)
    if inputs.audiences:
        units = X.restrict_to_audiences(units, inputs.audiences, obs.split_id, obs.audience_join)
    joined = X.attach_events(units, reduced_events(inputs, obs, events), obs.split_id, keep_inactive=obs.keep_inactive_units)
    if U.references_row_number(list(formulas), obs.filters):
        cuts = hot_rows = None
        if inputs.row_number_strategy == "ranges":
            cuts = X.hot_ranges(events, obs.split_id, inputs.rows_per_range)
            hot_rows = X.attach_events(units, X.hot_events(events, cuts, obs.split_id), obs.split_id)
        joined = X.with_event_row_number(joined, obs.split_id, inputs.event_tie_break, inputs.row_number_strategy, inputs.rows_per_range, cuts, hot_rows)
        if obs.keep_inactive_units:
            joined = joined.withColumn(
                "event_row_number", F.when(F.col("event_timestamp").isNull(), F.lit(1)).otherwise(F.col("event_row_number"))
            )
    return joined


def unit_table(spark: SparkSession, inputs: Inputs, obs: Observation, metrics: list[MetricSpec]) -> DataFrame:
    """One row per (unit, group) with every formula the metrics need."""
    formulas = required_formulas(metrics)
    rows = joined_events(spark, inputs, obs, formulas)
    rows = rows.where(U.calc_window(obs.calc_start, obs.calc_end, obs.keep_inactive_units))
    cond = U.row_filter(obs.filters)
    if cond is not None:
        rows = rows.where(cond)
    return U.unit_aggregate(rows, obs.split_id, formulas)


def observation_metrics(obs: Observation, metrics: list[MetricSpec]) -> list[MetricSpec]:
    """Metric selection stored on the observation (tags / groups); unset or empty = all."""
    return filter_metrics(metrics, tags=obs.metric_tags, group_names=obs.metric_groups)


def run_observation(spark: SparkSession, inputs: Inputs, obs: Observation, metrics: list[MetricSpec]) -> DataFrame:
    """Precompute table (11 contract columns) of one observation."""
    metrics = observation_metrics(obs, metrics)
    units = unit_table(spark, inputs, obs, metrics)
    return precompute(units, metrics, obs.split_id)


Scenario = Callable[[SparkSession, Inputs, Observation, list], DataFrame]
SCENARIOS: dict[str, Scenario] = {"base": run_observation}


def register_scenario(name: str, fn: Scenario) -> None:
    SCENARIOS[name] = fn


def run_scenario(name: str, spark: SparkSession, inputs: Inputs, obs: Observation, metrics: list[MetricSpec]) -> DataFrame:
    if name not in SCENARIOS:
        raise KeyError(f"unknown calculation scenario {name!r}; known: {sorted(SCENARIOS)}")
    return SCENARIOS[name](spark, inputs, obs, metrics)
