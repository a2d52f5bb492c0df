"""Result tables on storage (S-9..S-11, K-1..K-6).

Precompute rows are appended to a parquet table partitioned by ``job_id`` and run, so a
report reads the last committed run of one job by partition pruning.  Job status is an append-only log."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import MAX_TEXT, TRUNCATION_MARK, truncate
from ..operators.entities import latest_per_key
from ..operators.precompute import PRECOMPUTE_COLUMNS, PRECOMPUTE_SCHEMA
from .events import ts_lit

JOB_STATUSES = ("pending", "running", "completed", "failed")
JOB_LOG_SCHEMA = T.StructType(
    [
        T.StructField("job_id", T.LongType(), False),
        T.StructField("observation_id", T.LongType(), True),
        T.StructField("status", T.StringType(), False),
        T.StructField("query", T.StringType(), True),
        T.StructField("error_message", T.StringType(), True),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType()), True),
        T.StructField("_created_at", T.TimestampNTZType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)
MAX_ERROR_CHARS = MAX_TEXT


def lower_columns(df: DataFrame) -> DataFrame:
    """Result columns are matched case-insensitively: lower-case all names (S-9)."""
    return df.toDF(*[c.lower() for c in df.columns])


def as_precompute(df: DataFrame) -> DataFrame:
    """Typed precompute rows; error naming every missing contract column (S-10)."""
    df = lower_columns(df)
    missing = [c for c in PRECOMPUTE_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"query result is missing required columns: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PRECOMPUTE_SCHEMA.fields])


COMMITS = "_commits"  # hidden from readers of the table's folder


def append_precompute(df: DataFrame, path: str, job_id: int) -> str | None:
    """Stores the rows of one run of a job (K-1) and then commits the run: readers take the
    last committed run of a job only, so a rerun replaces what was there and a run that
    was killed half-way is never seen.  Returns the run's name; an empty input writes
    nothing."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    out = df.withColumns({"job_id": F.lit(int(job_id)).cast("long"), "run": F.lit(run)})
    if out.isEmpty():
        return None
    out.write.mode("append").partitionBy("job_id", "run").parquet(path)
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(int(job_id), run, now)], "job_id long, run string, _created_at timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{path}/{COMMITS}")
    return run


def read_precompute(spark: SparkSession, path: str, job_id: int) -> DataFrame:
    """Rows of the last committed run of one job; its two predicates prune partitions (S-11).
    A job without a committed run has no rows."""
    rows = spark.read.schema(T.StructType([*PRECOMPUTE_SCHEMA.fields, T.StructField("job_id", T.LongType()), T.StructField("run", T.StringType())])).parquet(path)
    commits = spark.read.parquet(f"{path}/{COMMITS}").where(F.col("job_id") == F.lit(int(job_id)))
    last = commits.agg(F.max_by("run", F.struct("_created_at", "run")).alias("run")).first()  # one row
    return rows.where((F.col("job_id") == F.lit(int(job_id))) & (F.col("run") == F.lit(last.run))).drop("run")


def truncate_text(c, limit: int = MAX_ERROR_CHARS):
    """Long texts for a log line, cut to ``limit`` characters plus a marker (F-12)."""
    return truncate(c, limit)


def job_event(spark: SparkSession, job_id: int, status: str, seq: int, observation_id=None, query=None,
              error_message=None, extra=None) -> DataFrame:
    if status not in JOB_STATUSES:
        raise ValueError(f"status must be one of {JOB_STATUSES}")
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    row = [(int(job_id), observation_id, status, query, error_message, extra, now, int(seq))]
    return spark.createDataFrame(row, JOB_LOG_SCHEMA)  # the stored error text is whole


def append_job_event(event: DataFrame, path: str) -> None:
    """One status row on storage before the work that it announces goes on."""
    event.coalesce(1).write.mode("append").parquet(path)


def current_jobs(job_log: DataFrame) -> DataFrame:
    """Current state of every job = its latest log row (K-3); a rerun's rows are later."""
    return latest_per_key(job_log, "job_id", ["_created_at", "seq"])


LOST = "Execution error: the run was lost"


def lost_jobs(job_log: DataFrame, now, hours: float = 24) -> DataFrame:
    """A FAILED log row for each job whose last word, at least ``hours`` ago, is pending or
    running: its driver is gone.  Append them to the log."""
    open_ = current_jobs(job_log).where(F.col("status").isin("pending", "running"))
    stale = open_.where(F.col("_created_at") <= ts_lit(now) - F.make_dt_interval(hours=F.lit(0), mins=F.lit(0), secs=F.lit(float(hours) * 3600)))
    return stale.withColumns({"status": F.lit("failed"), "error_message": F.lit(LOST), "_created_at": ts_lit(now), "seq": F.col("seq") + 1}).select(*job_log.columns)


def guarded_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Ad-hoc read-only SQL over registered result tables (S-17), after the audit of its
    parsed and analysed plans."""
    from ..operators.guard import audited_query

    return lower_columns(audited_query(sql, spark))
