"""Exact top-k vector retrieval (O-4) and cross-query de-duplication (U-6).

Queries and corpus are packed into blocks of bounded bytes on the executors, and each
query block meets each corpus block once (a join of the two block tables; Spark
broadcasts the query blocks if their measured size allows it, else it reads the written
table of them in each task).  A pair of blocks is scored with one matrix product.  The
product's distances carry an error that is bounded from the vectors' lengths; every row
that may be among the ``k`` nearest within that bound is then measured from its own
differences, so close vectors of large norm rank right.  A pair gives ``k`` rows for each
query; Spark keeps ``k`` of a task's rows per query before it shuffles them, and ``k`` of
all after.  No vector reaches the driver and no table of pairs is built."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_worker_path, materialize

BLOCK_BYTES = 1 << 20  # of a packed block; at least one vector
SLICE = 1 << 22  # numbers in the arrays of exact differences
METRICS = ("l2", "cosine")


# ---------------------------------------------------------------- one pair of blocks


def _unit(mat: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN."""
    size = np.abs(mat).max(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        mat = mat / size  # so that squares neither overflow nor vanish
        return mat / np.linalg.norm(mat, axis=1, keepdims=True)


def _exact(q: np.ndarray, d: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (q[rows], d[cols]) from their differences."""
    step = max(1, SLICE // max(q.shape[1], 1))
    return np.concatenate([((q[rows[k : k + step]] - d[cols[k : k + step]]) ** 2).sum(axis=1) for k in range(0, len(rows), step)] or [np.zeros(0)])


def nearest(q: np.ndarray, d: np.ndarray, order: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, corpus row, distance) of the ``k`` nearest rows of ``d`` for each row of
    ``q``; equal distances by ``order``, the rank of each corpus row's id."""
    if metric == "cosine":
        q, d = _unit(q), _unit(d)
    with np.errstate(over="ignore", invalid="ignore"):
        qq, dd = (q * q).sum(axis=1), (d * d).sum(axis=1)
        about = qq[:, None] + dd[None, :] - 2.0 * (q @ d.T)
        # rounding of sums of dim products, of lengths up to |q| and |d|
        error = 4 * (q.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(qq)[:, None] + np.sqrt(dd)[None, :]) ** 2
        low, high = about - error, about + error
    lost = ~np.isfinite(low) | ~np.isfinite(high)
    low[lost], high[lost] = -np.inf, np.inf
    if d.shape[0] > k:
        limit = np.partition(high, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(low <= limit[:, None])
    else:
        rows, cols = np.divmod(np.arange(len(q) * len(d)), max(len(d), 1))
    with np.errstate(over="ignore", invalid="ignore"):
        far = _exact(q, d, rows, cols)
        far = far / 2 if metric == "cosine" else np.sqrt(far)
    by = np.lexsort((order[cols], far, rows))  # NaN (a zero vector's cosine) comes last
    rows, cols, far = rows[by], cols[by], far[by]
    first = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - first < k
    return rows[kept], cols[kept], far[kept]


# ---------------------------------------------------------------- on Spark


def _vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, v) of the rows that have a vector: not NULL, not empty, without NULL or NaN."""
    v = F.col(vec).cast("array<double>")
    whole = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.coalesce(whole, F.lit(False)))


def _packed(df: DataFrame, id_col: str, vec: str, block_bytes: int) -> DataFrame:
    """(ids, dim, mat): blocks of rows of one dimension, as bytes of doubles."""
    rows = _vectors(df, id_col, vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            dims = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                step = max(1, block_bytes // (8 * dim))
                for k in range(0, len(at), step):
                    own = pa.array(at[k : k + step])
                    mat = vectors.take(own).flatten().to_numpy(zero_copy_only=False).tobytes()
                    names = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids.take(own))
                    yield pa.RecordBatch.from_arrays([names, pa.array([dim], pa.int32()), pa.array([mat], pa.binary())], names=["ids", "dim", "mat"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"ids array<{kind}>, dim int, mat binary")


def topk_similar(
    spark: SparkSession,
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 3,
    doc_id: str = "vec_id",
    query_id: str = "query_id",
    vec: str = "embedding",
    metric: str = "l2",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``query_id, rank, doc_id, distance`` for the ``k`` nearest corpus rows of every query,
    equal distances by id.  Ids may be of any type that Spark can sort.

    Exact: every query is compared with every corpus row of its dimension.  Rows whose
    vector is NULL, empty, or holds a NULL or NaN take no part on either side; a zero
    vector has no cosine (NaN, ranked last).  An id that several rows have counts for
    each of them; queries of one id share their ``k`` rows.  Queries without a comparable row give no rows."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k <= 0:
        raise ValueError("k must be positive")
    ensure_worker_path(spark)
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, query_id), (corpus, doc_id))]
    blocks = materialize(_packed(queries, query_id, vec, block_bytes).withColumnsRenamed({"ids": "q_ids", "dim": "q_dim", "mat": "q_mat"}))
    met = _packed(corpus, doc_id, vec, block_bytes).crossJoin(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                ids, dim, mat, q_ids, q_dim, q_mat = (c[n] for c in batch.columns)
                if dim.as_py() != q_dim.as_py():
                    continue
                d, q = (np.frombuffer(m.as_py(), np.float64).reshape(-1, dim.as_py()) for m in (mat, q_mat))
                order = np.empty(len(d), np.int64)
                order[pa.compute.sort_indices(ids.values, null_placement="at_start").to_numpy()] = np.arange(len(d))
                rows, cols, far = nearest(q, d, order, k, metric)
                yield pa.RecordBatch.from_arrays([q_ids.values.take(pa.array(rows)), ids.values.take(pa.array(cols)), pa.array(far)], names=["query_id", "doc_id", "distance"])

    cand = met.mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, distance double")
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc(), F.col("doc_id").asc())
    ranked = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "doc_id", "distance")


def dedupe_across_queries(hits: DataFrame, query_order: str = "query_id", rank: str = "rank") -> DataFrame:
    """A document found by several queries is kept for the first query only (U-6)."""
    w = Window.partitionBy("doc_id").orderBy(F.col(query_order).asc(), F.col(rank).asc())
    return hits.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def label_centroids(embeddings: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Mean vector per label (partial aggregation per (label, position))."""
    exploded = embeddings.select(F.col(label), F.posexplode(F.col(vec)).alias("pos", "x"))
    per_pos = exploded.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    agg = per_pos.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("__v"))
    return agg.select(F.col(label).cast("long").alias("query_id"), F.transform("__v", lambda s: s["x"]).alias(vec))
