"""Session helpers.

The library never builds its own cluster session: callers pass a ``SparkSession``.
``local_session`` exists for tests and the bench script only.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the engine relies on: UTC wall clock for TIMESTAMP_NTZ literals and
# adaptive execution for runtime join choice, partition coalescing and skew splits.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a hot unit's join partition is split even if the unit aggregate then needs a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Context-level: checkpoint files are removed once their DataFrame is garbage collected.
CONTEXT_CONF = {"spark.cleaner.referenceTracking.cleanCheckpoints": "true"}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "splitmill", extra_conf: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SPLITMILL_DRIVER_MEMORY", "8g"))
    )
    for k, v in {**RECOMMENDED_CONF, **CONTEXT_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints (``spark.checkpoint.dir``),
    or the folder already set on the SparkContext."""
    sc = spark.sparkContext
    value = sc.getCheckpointDir()
    if not value:
        value = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    return value or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured checkpoint folder.  Only a session on one machine (``local``)
    that has none gets a scratch folder; on a cluster that is an error, as no other
    machine could read it.  The folder is set on the SparkContext
    (``spark.checkpoint.dir`` itself cannot change at run time)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    value = checkpoint_dir(spark)
    if not value:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        value = tempfile.mkdtemp(prefix="splitmill-ckpt-")
    sc.setCheckpointDir(value)
    return sc.getCheckpointDir() or value


def cluster_conf(input_bytes: float, executors: int, cores_per_executor: int = 4, target_partition_mb: int = 256) -> dict:
    """Settings for a large run, sized from the event bytes read.

    * scan splits of ``target_partition_mb`` (fewer, larger tasks on 100 TB);
    * initial shuffle partitions ~ input / 256 MB, at least 3 waves of the cluster's
      cores, then coalesced by adaptive execution to ~128 MB each;
    * adaptive skew handling on, so a hot unit's join partition is split;
    * broadcast only what adaptive execution measured under 64 MB at run time."""
    cores = executors * cores_per_executor
    parts = max(int(input_bytes / (target_partition_mb * 2**20)), 3 * cores, 200)
    return {
        **RECOMMENDED_CONF,
        "spark.sql.files.maxPartitionBytes": f"{target_partition_mb}m",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        # events of units that no one has assigned are dropped before the exchange, by a filter
        # of at most 64 MB that is made of the assigned units
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1g",
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
        "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": str(64 << 20),
        "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(64 << 23),
    }


def apply_conf(spark: SparkSession, conf: dict) -> None:
    for k, v in conf.items():
        spark.conf.set(k, v)


def materialize(df):
    """Reliable checkpoint of a small intermediate result (a precompute table) into
    the cluster's checkpoint folder: the lineage is cut, later steps plan over a
    tiny relation, and a lost executor cannot force the event pipeline to re-run."""
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    # persisted first: the checkpoint write then reads the cached rows instead of
    # running the whole plan a second time
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist()


def ensure_worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package: its parent folder is added to the
    PYTHONPATH that Spark passes to Python workers (captured when a Python
    function is created).  On a cluster ship the package with ``--py-files`` or
    install it on the executors; this then changes nothing."""
    import splitmill

    root = os.path.dirname(os.path.dirname(os.path.abspath(splitmill.__file__)))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
