"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ensure_worker_path

# Java regular expressions for the white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for one run of one operator."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage is cut,
    and a lost executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class HashTable:
    """Rows that every task looks up by hash in constant time, without a join: an array of
    buckets, put together by Spark and held by a session variable, whose value travels as
    one literal with the plan (packed bytes, printed by its address).

    ``entries`` must have a column ``hash`` and a checked size: the rows pass through one
    task and the driver, and each running task holds a copy."""

    def __init__(self, entries: DataFrame, n: int):
        spark, kind = entries.sparkSession, entries.schema.simpleString()
        self.size = 1 << max(4, n.bit_length())
        filed = entries.groupBy(F.pmod("hash", F.lit(self.size)).alias("bucket")).agg(F.collect_list(F.struct(*entries.columns)).alias("rows"))
        rows = F.coalesce("rows", F.expr(f"cast(array() as array<{kind}>)"))
        buckets = spark.range(self.size).select(F.col("id").alias("bucket")).join(filed, "bucket", "left").select(F.struct("bucket", rows.alias("rows")).alias("b"))
        made = buckets.agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["rows"]).alias("made"))
        self.spark, self.name = spark, f"table_{uuid.uuid4().hex}"
        spark.sql(f"DECLARE VARIABLE {self.name} array<array<{kind}>>")
        spark.sql(f"SET VARIABLE {self.name} = (SELECT made FROM {{made}})", made=made)
        self.buckets = F.expr(f"session.{self.name}")

    def bucket(self, value: Column) -> Column:
        """The entries that may have this hash, as an array."""
        return F.element_at(self.buckets, (F.pmod(value, F.lit(self.size)) + 1).cast("int"))

    def drop(self) -> None:
        """Ends the variable; DataFrames made with the table keep its value."""
        self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {self.name}")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it (a plain
    alias may be copied into a function that runs for each element of an array)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(c: Column) -> Column:
    """Words of a text, in order; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACE, -1), "")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, prefixed with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name (dots and quotes in names included)."""
    return df[f"`{name.replace('`', '``')}`"]


def with_arrow(df: DataFrame, inputs: list[Column], fields: str, make: Callable[[], Callable]) -> DataFrame:
    """``inputs`` sent to Python in Arrow batches; ``make()`` runs once in each task and
    gives a function from the batch's arrays to the arrays of ``fields``."""
    ensure_worker_path(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            arrays = work(*batch.columns)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [x.split(" ", 1)[0] for x in _split_ddl(fields)]
    return df.select(*inputs).mapInArrow(run, fields)


def _split_ddl(ddl: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def utf8(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string array; null gives empty bytes."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]
