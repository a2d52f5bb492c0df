"""Bookkeeping tables: experiments, observations, jobs (schemas and row helpers).

The tables are ordinary DataFrames (parquet on the shared file system): updates
append versions, deletes append tombstones (see ``operators/entities.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.observation import Observation

_TS = T.TimestampNTZType()
_STRS = T.ArrayType(T.StringType())

EXPERIMENT_STATUSES = ("planned", "running", "completed", "cancelled")
EXPERIMENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("status", T.StringType(), True),
        T.StructField("description", T.StringType(), True),
        T.StructField("hypotheses", T.StringType(), True),
        T.StructField("design", T.StringType(), True),
        T.StructField("conclusion", T.StringType(), True),
        T.StructField("key_metrics", _STRS, True),
        T.StructField("start_datetime", _TS, True),
        T.StructField("end_datetime", _TS, True),
        T.StructField("_created_at", _TS, True),
        T.StructField("_updated_at", _TS, True),
    ]
)
OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("experiment_id", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("db_experiment_name", T.StringType(), True),
        T.StructField("split_id", T.StringType(), False),
        T.StructField("calculation_scenario", T.StringType(), True),
        T.StructField("exposure_start_datetime", _TS, False),
        T.StructField("exposure_end_datetime", _TS, False),
        T.StructField("calc_start_datetime", _TS, False),
        T.StructField("calc_end_datetime", _TS, False),
        T.StructField("exposure_event", T.StringType(), True),
        T.StructField("audience_tables", _STRS, True),
        T.StructField("filters", _STRS, True),
        T.StructField("custom_test_ids_query", T.StringType(), True),
        T.StructField("metric_tags", _STRS, True),
        T.StructField("metric_groups", _STRS, True),
        T.StructField("_created_at", _TS, True),
        T.StructField("_updated_at", _TS, True),
    ]
)
JOB_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("observation_id", T.LongType(), True),
        T.StructField("query", T.StringType(), True),
        T.StructField("status", T.StringType(), False),
        T.StructField("error_message", T.StringType(), True),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("_created_at", _TS, True),
    ]
)


def observation_from_row(row, purpose: str = "regular") -> Observation:
    """A stored observation row -> the settings object the analysis runs with.

    Audience table names and the custom assignment query stay on the row; the
    caller resolves them to DataFrames (``spark.table``, guarded ``spark.sql``)."""
    r = row.asDict() if hasattr(row, "asDict") else dict(row)
    return Observation(
        name=r["name"],
        split_id=r["split_id"],
        experiment_name=r.get("db_experiment_name"),
        exposure_event=r.get("exposure_event") or None,
        exposure_start=r["exposure_start_datetime"],
        exposure_end=r["exposure_end_datetime"],
        calc_start=r["calc_start_datetime"],
        calc_end=r["calc_end_datetime"],
        filters=tuple(r.get("filters") or ()),
        purpose=purpose,
        observation_id=r.get("id"),
        experiment_id=r.get("experiment_id"),
        metric_tags=tuple(r["metric_tags"]) if r.get("metric_tags") else None,
        metric_groups=tuple(r["metric_groups"]) if r.get("metric_groups") else None,
    )


def job_context(jobs: DataFrame, observations: DataFrame, experiments: DataFrame) -> DataFrame:
    """Job -> observation -> experiment (J-9): one row per job with the names above it."""
    o = observations.select(
        F.col("id").alias("observation_id"), F.col("experiment_id"), F.col("name").alias("observation_name"),
    )
    e = experiments.select(F.col("id").alias("experiment_id"), F.col("name").alias("experiment_name"))
    return jobs.join(o, on="observation_id", how="inner").join(e, on="experiment_id", how="inner")


def inputs_from_row(spark, row, events, testids, **kw):
    """Inputs of a stored observation: audience tables resolved by name
    (``spark.table``), the custom assignment query kept for the read-only guard."""
    from ..plans.analysis import Inputs

    r = row.asDict() if hasattr(row, "asDict") else dict(row)
    audiences = [spark.table(name) for name in (r.get("audience_tables") or [])]
    return Inputs(events=events, testids=testids, audiences=audiences, custom_assignment=r.get("custom_test_ids_query") or None, **kw)


def run_stored_observation(spark, row, events, testids, metrics, purpose: str = "regular", **kw):
    """Precompute of a stored observation row through its calculation scenario."""
    from ..plans.analysis import run_scenario

    r = row.asDict() if hasattr(row, "asDict") else dict(row)
    obs = observation_from_row(r, purpose)
    return run_scenario(r.get("calculation_scenario") or "base", spark, inputs_from_row(spark, r, events, testids, **kw), obs, metrics)
