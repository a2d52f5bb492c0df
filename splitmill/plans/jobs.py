"""Analysis job: build -> run -> validate -> store -> record status (M-6, K-3, K-4).

The job log is append-only (one row per status change); the current state of a
job is its latest row.  Failures become a FAILED row whose message starts with
the stage that failed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import contract_violations
from ..session import materialize
from ..sources.sinks import append_job_event, append_precompute, as_precompute, job_event
from .analysis import Inputs, run_scenario
from .observation import REGULAR, Observation

STAGE_PREFIX = {
    "create": "Job create failed",
    "render": "Render error",
    "execute": "Execution error",
    "validate": "Validation error",
    "store": "Store error",
}


@dataclass
class JobResult:
    job_id: int
    status: str
    precompute: DataFrame | None
    error_message: str | None
    log: DataFrame


def violation_rows(typed: DataFrame, job_id: int) -> DataFrame:
    """``job_id, metric_name, group_name, code``: every broken rule of every row."""
    return typed.select(F.lit(int(job_id)).cast("long").alias("job_id"), "metric_name", "group_name", F.explode(contract_violations()).alias("code"))


def run_job(
    spark: SparkSession,
    job_id: int,
    inputs: Inputs,
    obs: Observation,
    metrics: list,
    precompute_path: str | None = None,
    job_log_path: str | None = None,
    scenario: str = "base",
    violations_path: str | None = None,
) -> JobResult:
    """Run one observation as a job.  Only a REGULAR run is stored; a planning run
    returns its rows.  Validation runs on the executors.

    Each status row is on storage before the work that it announces begins, so a job
    whose driver dies stays PENDING or RUNNING in the log until ``sinks.lost_jobs`` closes
    it.  If the first row can't be written the job fails with a creation error.  All
    violations go to ``violations_path``; the error message counts them by rule."""
    events: list[DataFrame] = []

    def say(status: str, **more) -> None:
        event = job_event(spark, job_id, status, len(events), obs.observation_id, **more)
        if job_log_path is not None:
            append_job_event(event, job_log_path)
        events.append(event)

    stage = "create"
    result = None
    try:
        say("pending")
        stage = "render"
        plan = run_scenario(scenario, spark, inputs, obs, metrics)
        say("running", query=scenario)
        stage = "execute"
        # one pass over the events: the small result is checkpointed to the
        # cluster's shared checkpoint folder, then validated and stored from there
        typed = materialize(as_precompute(plan))
        stage = "validate"
        bad = violation_rows(typed, job_id)
        counts = bad.groupBy("code").count().orderBy("code").collect()  # a row for each rule
        if counts:
            if violations_path is not None:
                bad.write.mode("append").parquet(violations_path)
            raise ValueError(", ".join(f"{r['count']} x {r.code}" for r in counts))
        if obs.purpose == REGULAR and precompute_path is not None:
            stage = "store"
            append_precompute(typed, precompute_path, job_id)
        result = typed
        say("completed", query=scenario)
        status, message = "completed", None
    except Exception as exc:  # the failure is recorded, not raised
        status, message, result = "failed", f"{STAGE_PREFIX[stage]}: {exc}", None
        event = job_event(spark, job_id, "failed", len(events), obs.observation_id, query=scenario, error_message=message)
        if job_log_path is not None and stage != "create":
            append_job_event(event, job_log_path)
        events.append(event)
    return JobResult(job_id, status, result, message, reduce(DataFrame.unionByName, events))
