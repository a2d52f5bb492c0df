"""Mapping of the driver's parquet tables onto the experiment data model.

light: ``events`` -> (user_id, event_type, value, ts); assignment log = the same
rows under experiment ``'exp_' || event_type``, group from ``(user_id + day) % 3``.
heavy: ``lineitem JOIN orders`` -> customer-level events; assignment log = orders
(group = order priority), attributes from ``customer``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LIGHT_GROUPS = ["control", "treatment1", "treatment2"]


_READERS: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table reader, reused per session and path (file listing and footer
    reads happen once; identical scans also let Spark reuse exchanges)."""
    path = f"{sf_dir}/{name}.parquet"
    key = (id(spark), path)
    df = _READERS.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _READERS[key] = df
    return df


def light_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id"),
        F.col("event_id"),
        F.col("event_type").alias("event_name"),
        F.col("value").alias("event_value"),
        F.col("ts").alias("event_timestamp"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def light_event_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three sources of one shape (app / backend / transaction events)."""
    ev = light_events(spark, sf_dir)
    return [
        ev.where(F.col("event_name").isin("view", "click")),
        ev.where(F.col("event_name") == "error"),
        ev.where(F.col("event_name").isin("signup", "purchase")),
    ]


def light_group(user_id: str = "user_id", ts: str = "ts"):
    idx = F.pmod(F.col(user_id) + F.dayofmonth(F.col(ts)), F.lit(3))
    return F.element_at(F.array(*[F.lit(g) for g in LIGHT_GROUPS]), (idx + 1).cast("int"))


def light_testids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id"),
        F.concat(F.lit("exp_"), F.col("event_type")).alias("experiment_name"),
        light_group().alias("group_name"),
        F.col("ts").alias("record_timestamp"),
        F.col("event_id").alias("record_id"),
        F.get_json_object("props", "$.k").cast("int").alias("segment_k"),
    )


def heavy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey, "inner").select(
        F.col("o_custkey").alias("custkey"),
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_returnflag").alias("event_name"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("event_value"),
        F.col("l_shipdate").alias("event_timestamp"),
        F.col("l_quantity"),
        F.col("l_linestatus"),
    )


def heavy_testids(spark: SparkSession, sf_dir: str) -> DataFrame:
    od = table(spark, sf_dir, "orders")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    rows = od.select(
        F.col("o_custkey").alias("custkey"),
        F.lit("priority_test").alias("experiment_name"),
        F.col("o_orderpriority").alias("group_name"),
        F.col("o_orderdate").alias("record_timestamp"),
        F.col("o_orderkey"),
    )
    return rows.join(cu, rows.custkey == cu.c_custkey, "left").drop("c_custkey")


# Observation windows used by the registered queries.
LIGHT_WINDOWS = dict(
    exposure_start=datetime(2024, 1, 1), exposure_end=datetime(2024, 1, 20, 23, 59, 59),
    calc_start=datetime(2024, 1, 1), calc_end=datetime(2024, 1, 30, 23, 59, 59),
)
HEAVY_WINDOWS = dict(
    exposure_start=datetime(1995, 1, 1), exposure_end=datetime(2000, 12, 31),
    calc_start=datetime(1995, 6, 1), calc_end=datetime(2001, 12, 31),
)
