"""Stored state of an entity table (K-2, M-2, M-3, W-7): a snapshot in key buckets and a log.

Changes are appended to the log in numbered batches; the state is the snapshot with the
batches on top of it.  Compaction writes a new snapshot of the buckets that the log touches
and of no others, so its cost follows the changes, and so does the part of a read that is
merged.  Data is written first and committed by one row afterwards: readers only follow
committed names, so a writer that is lost half-way leaves the state as it was.  One writer
at a time; files are never changed, and those of replaced snapshots stay until
the owner clears them.

A change is a row with the key, ``op`` and fields:

* ``create`` makes the row, all fields given (an existing row is replaced);
* ``set`` sets the fields that are not NULL and those named in the array column
  ``set_fields``, if there is one; without a row it does nothing;
* ``delete`` removes the row; without a row it does nothing.

Changes of a key apply by batch, then by the ``order`` columns (the caller makes them
unique per key).  Columns that the table lacks are ignored, missing ones are NULL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("create", "set", "delete")
_COMMIT = "seq long, kind string, run string, buckets array<int>, n_buckets int, key string, fields string"


def _commit(spark: SparkSession, path: str, *row) -> None:
    spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _commits(spark: SparkSession, path: str) -> list:
    """Commits in order: one row for each batch or compaction, which the driver plans with."""
    return spark.read.schema(_COMMIT).parquet(f"{path}/commits").orderBy("seq").collect()


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("bucket")


def _write(rows: DataFrame, path: str) -> list[int]:
    """Rows by bucket; the buckets that got any, at most as many as the table has."""
    # several tasks may hold a bucket: a large one isn't put into one task
    rows.write.partitionBy("bucket").parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return sorted(r[0] for r in stored.select("bucket").distinct().collect())


def create_state(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A new stored table with the rows of ``df``, whose key is unique and not NULL.
    ``buckets`` stays; choose it so that a bucket of the final table is some GB."""
    run = uuid.uuid4().hex
    held = _write(df.withColumn("bucket", _bucket(_present(key), buckets)), f"{path}/snapshot/{run}")
    _commit(df.sparkSession, path, 0, "snapshot", run, held, buckets, key, df.schema.json())


def _present(key: str) -> Column:
    return F.coalesce(F.col(key), F.raise_error(F.lit(f"a row has no {key}")))


def append_changes(changes: DataFrame, path: str, order: list[str], op: str = "op", set_fields: str | None = None) -> int:
    """Adds one batch to the log and returns its number.  An unknown operation, or a row
    without a key, is an error, and nothing of the batch counts."""
    spark = changes.sparkSession
    log = _commits(spark, path)
    first, run = log[0], uuid.uuid4().hex
    fields = T.StructType.fromJson(json.loads(first.fields)).fields
    known = F.when(F.col(op).isin(*OPS), F.col(op)).otherwise(F.raise_error(F.lit(f"{op} must be one of {OPS}")))
    given = [F.col(f.name) if f.name in changes.columns else F.lit(None) for f in fields]
    named = F.col(set_fields) if set_fields else F.lit(None)
    rows = changes.select(
        *[(_present(f.name) if f.name == first.key else c).cast(f.dataType).alias(f.name) for c, f in zip(given, fields)],
        known.alias("_op"), F.struct(*order).alias("_order"), named.cast("array<string>").alias("_named"), _bucket(F.col(first.key).cast(_type(fields, first.key)), first.n_buckets),
    )
    held = _write(rows, f"{path}/log/{run}")
    _commit(spark, path, log[-1].seq + 1, "batch", run, held, first.n_buckets, first.key, first.fields)
    return log[-1].seq + 1


def _type(fields: list, name: str) -> T.DataType:
    return next(f.dataType for f in fields if f.name == name)


class _Layout:
    """Which committed files make up the state now."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, log = spark, path, _commits(spark, path)
        self.key, self.n, self.last = log[0].key, log[0].n_buckets, log[-1].seq
        self.schema = T.StructType.fromJson(json.loads(log[0].fields))
        self.snapshot: dict[int, str] = {}  # bucket: run
        since: dict[int, int] = {}
        for c in log:
            if c.kind == "snapshot":
                self.snapshot |= {b: c.run for b in c.buckets}
                since |= {b: c.seq for b in c.buckets}
        self.open = [(c.seq, c.run, [b for b in c.buckets if since.get(b, -1) < c.seq]) for c in log if c.kind == "batch"]
        self.touched = sorted({b for _, _, held in self.open for b in held})

    def rows(self, buckets: list[int]) -> DataFrame:
        """Snapshot rows of these buckets."""
        runs = sorted({(self.snapshot[b], b) for b in buckets if b in self.snapshot})
        return self._read("snapshot", runs, self.schema.fields)

    def _read(self, kind: str, places: list[tuple[str, int]], fields: list) -> DataFrame:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
        if not places:
            return self.spark.createDataFrame([], schema)
        found = [f"{self.path}/{kind}/{run}/bucket={b}" for run, b in places]
        found = [x for x in found if self._exists(x)]  # a compacted bucket may have lost all its rows
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def _exists(self, place: str) -> bool:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path)

    def merged(self) -> DataFrame:
        """Rows of the touched buckets, with the open batches applied."""
        names = [f.name for f in self.schema.fields if f.name != self.key]
        batches = []
        for seq, run, held in self.open:
            if held:
                places = [f"{self.path}/log/{run}/bucket={b}" for b in held]
                batches.append(self.spark.read.parquet(*places).withColumn("_at", F.struct(F.lit(seq).alias("batch"), F.col("_order"))))
        log = batches[0]
        for b in batches[1:]:
            log = log.unionByName(b)
        created, at = F.col("_op") == "create", F.col("_at")
        sets = lambda c: created | ((F.col("_op") == "set") & (F.col(c).isNotNull() | F.coalesce(F.array_contains("_named", c), F.lit(False))))
        # a key's changes combine in the tasks: one row of a key and task is shuffled
        ends = F.when(F.col("_op").isin("create", "delete"), at)
        changed = log.groupBy(F.col(self.key).alias("_key")).agg(
            F.max(ends).alias("_end"), F.max_by("_op", ends).alias("_last"),
            *[F.max(F.when(sets(c), F.struct(at.alias("at"), F.col(f"`{c}`").alias("v")))).alias(f"_new_{k}") for k, c in enumerate(names)],
        )
        old = self.rows(self.touched).withColumn("_old", F.lit(True))
        both = old.join(changed, F.col(self.key) == F.col("_key"), "full_outer")
        both = both.where(F.coalesce(F.col("_last") == "create", F.col("_old")))

        def field(c: str, k: int) -> Column:
            new = F.col(f"_new_{k}")
            fresh = new.isNotNull() & (F.col("_end").isNull() | (new["at"] >= F.col("_end")))
            return F.when(fresh, new["v"]).otherwise(F.col(c))  # after a create, every field is fresh

        values = {c: field(c, k) for k, c in enumerate(names)} | {self.key: F.coalesce(self.key, "_key")}
        return both.select(*[values[f.name].alias(f.name) for f in self.schema.fields])


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state after all committed batches.  Buckets without open changes are plain scans."""
    now = _Layout(spark, path)
    still = now.rows([b for b in now.snapshot if b not in now.touched])
    return still.unionByName(now.merged()) if now.touched else still


def compact_state(spark: SparkSession, path: str) -> list[int]:
    """Writes the touched buckets anew and commits them; the numbers of these buckets."""
    now = _Layout(spark, path)
    if now.touched:
        run = uuid.uuid4().hex
        _write(now.merged().withColumn("bucket", _bucket(F.col(now.key), now.n)), f"{path}/snapshot/{run}")
        _commit(spark, path, now.last + 1, "snapshot", run, now.touched, now.n, now.key, now.schema.json())
    return now.touched
