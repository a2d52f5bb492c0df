"""Entity tables: filter DSL, versions, deletes, hierarchy (P-1..P-13, O-1..O-3, M-1..M-5, J-9, J-10, W-6, W-7).

Result tables (experiments, observations, jobs, precomputes) are append-only
DataFrames.  An update appends a new version and the current state is the
latest version per key; a delete appends a tombstone.  The same functions work
on any table with a key, so they are exercised here on the TPC-H hierarchy
region > nation > customer > orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("eq", "ilike", "in", "gte", "lte", "gt", "lt", "contains")


def _clause(df: DataFrame, field: str, op: str, value) -> Column:
    col = F.col(field)
    if op == "eq":
        return col.isNull() if value is None else col == F.lit(value)
    if op == "ilike":
        return col.ilike(value)
    if op == "in":
        return col.isin(list(value))
    if op == "gte":
        return col >= F.lit(value)
    if op == "lte":
        return col <= F.lit(value)
    if op == "gt":
        return col > F.lit(value)
    if op == "lt":
        return col < F.lit(value)
    if op == "contains":
        if isinstance(df.schema[field].dataType, T.ArrayType):
            return F.array_contains(col, F.lit(value))
        return col.contains(F.lit(value))
    raise ValueError(f"unknown operator {op!r}; known: {OPERATORS}")


def filter_condition(df: DataFrame, filters: dict | None) -> Column | None:
    """AND of ``field[__op][__or]=value`` clauses.

    ``__or`` takes a list and ORs the clause over its values (empty list: no
    condition).  Array columns match ``contains`` by element; text by substring."""
    parts = []
    for key, value in (filters or {}).items():
        bits = key.split("__")
        is_or = bits[-1] == "or"
        if is_or:
            bits = bits[:-1]
        field = bits[0]
        op = bits[1] if len(bits) > 1 else "eq"
        if field not in df.columns:
            raise ValueError(f"unknown field {field!r}")
        if is_or:
            ors = [_clause(df, field, op, v) for v in value]
            if ors:
                parts.append(reduce(lambda a, b: a | b, ors))
        else:
            parts.append(_clause(df, field, op, value))
    return reduce(lambda a, b: a & b, parts) if parts else None


def select_where(
    df: DataFrame,
    filters: dict | None = None,
    columns: list[str] | None = None,
    sort_by: str | None = None,
    sort_order: str = "asc",
    limit: int | None = None,
) -> DataFrame:
    """Filter, sort (``"desc"`` = descending, anything else ascending), limit (0/None = none), project."""
    cond = filter_condition(df, filters)
    out = df.where(cond) if cond is not None else df
    if sort_by is not None:
        key = F.col(sort_by)
        out = out.orderBy(key.desc_nulls_last() if sort_order == "desc" else key.asc_nulls_first())
    if limit:
        out = out.limit(int(limit))
    if columns:
        out = out.select(*columns)
    return out


def get_by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def latest_per_key(df: DataFrame, keys: list[str] | str, order_desc: list[str] | str) -> DataFrame:
    """Row with the greatest ``order_desc`` values per key (latest version / job).

    ``row_number() = 1`` lets Spark insert a partial per-task group limit before
    the shuffle, so a key with many versions ships one row per task."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order_desc] if isinstance(order_desc, str) else list(order_desc)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def apply_updates(
    current: DataFrame, updates: DataFrame, key: str, version_col: str = "_updated_at",
    tie_break: list[str] | None = None, set_fields: str | None = None,
) -> DataFrame:
    """``current`` after partial updates: each field takes the value of the latest update
    that sets it, among those not older than the current row.

    A NULL does not set a field, unless the update's array column ``set_fields`` names it.
    Unknown fields are ignored and keys absent from ``current`` are not created.
    ``tie_break`` columns of ``updates`` order versions with equal timestamps."""
    known = [c for c in updates.columns if c in current.columns and c not in (key, version_col)]
    since = current.select(F.col(key), F.col(version_col).alias("__since"))
    fresh = updates.join(since, on=key).where(F.col("__since").isNull() | (F.col(version_col) >= F.col("__since")))
    order = F.struct(version_col, *(tie_break or []))

    def latest(c: str):
        is_set = F.col(c).isNotNull()
        if set_fields:
            is_set = is_set | F.coalesce(F.array_contains(set_fields, c), F.lit(False))
        # the value is wrapped, so that a NULL that was set differs from none
        return F.max_by(F.struct(F.col(c).alias("v")), F.when(is_set, order)).alias(f"__new_{c}")

    new = fresh.groupBy(key).agg(F.max(version_col).alias("__new_version"), *[latest(c) for c in known])
    merged = current.join(new, on=key, how="left")

    def field(c: str):
        if c == version_col:
            return F.coalesce("__new_version", version_col).alias(c)
        if c in known:
            return F.when(F.col(f"__new_{c}").isNotNull(), F.col(f"__new_{c}.v")).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return merged.select(*[field(c) for c in current.columns])


def delete_keys(df: DataFrame, tombstones: DataFrame, key: str, tomb_key: str | None = None) -> DataFrame:
    """Rows whose key has no tombstone (anti join)."""
    tk = tomb_key or key
    return df.join(tombstones.select(F.col(tk).alias(key)).distinct(), on=key, how="left_anti")


def cascade_delete(levels: list[tuple[DataFrame, str, str | None]], deleted_root: DataFrame, root_key: str) -> list[DataFrame]:
    """Delete down a hierarchy.

    ``levels`` = [(table, own_key, parent_fk), ...] from the root down (root's
    parent_fk is None).  ``deleted_root`` holds the root keys to delete.  Returns
    the surviving rows of every level; a child survives only if its parent does."""
    out = []
    doomed = deleted_root.select(F.col(root_key).alias("__k")).distinct()
    for i, (table, own_key, parent_fk) in enumerate(levels):
        if i > 0:  # children of deleted parents are deleted too
            doomed = table.join(doomed, F.col(parent_fk) == F.col("__k"), "left_semi").select(F.col(own_key).alias("__k")).distinct()
        out.append(table.join(doomed, F.col(own_key) == F.col("__k"), "left_anti"))
    return out


def copy_row(df: DataFrame, key: str, source_id, new_id, overrides: dict | None = None) -> DataFrame:
    """One row copied as a template: new key, given fields replaced."""
    row = df.where(F.col(key) == F.lit(source_id)).withColumn(key, F.lit(new_id).cast(df.schema[key].dataType))
    for c, v in (overrides or {}).items():
        row = row.withColumn(c, F.lit(v).cast(df.schema[c].dataType))
    return row.select(*df.columns)


def list_filter(
    df: DataFrame,
    created_from=None,
    created_to=None,
    statuses: list[str] | None = None,
    name_like: str | None = None,
    limit: int | None = None,
    created_col: str = "_created_at",
    sort_desc: bool = True,
    status_col: str = "status",
    name_col: str = "name",
) -> DataFrame:
    """List screen filter (P-11, P-12): created in ``[from, to)``, status any-of,
    name ILIKE, newest first, optional limit."""
    filters: dict = {}
    if created_from is not None:
        filters[f"{created_col}__gte"] = created_from
    if created_to is not None:
        filters[f"{created_col}__lt"] = created_to
    if statuses:
        filters[f"{status_col}__in"] = list(statuses)
    if name_like:
        filters[f"{name_col}__ilike"] = f"%{name_like}%"
    return select_where(df, filters, sort_by=created_col, sort_order="desc" if sort_desc else "asc", limit=limit)


def append_row(df: DataFrame, spark, values: dict) -> DataFrame:
    """Single-row create (K-2): the row is typed by the table schema; missing fields are NULL."""
    row = [tuple(values.get(f.name) for f in df.schema.fields)]
    return df.unionByName(spark.createDataFrame(row, df.schema))


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows as a preview (O-5; the limit is the feature)."""
    return df.limit(int(n))


def known_key_metrics(experiments: DataFrame, catalog: DataFrame, col: str = "key_metrics") -> DataFrame:
    """Requested key metrics that exist in the catalog, per experiment (J-11).

    The catalog is exploded and joined (no driver-side list), so it may be large."""
    req = experiments.select("id", F.posexplode_outer(col).alias("__pos", "metric_name"))
    hit = req.join(catalog.select("metric_name").distinct(), on="metric_name", how="left_semi")
    kept = hit.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("__pos", "metric_name"))).alias("__k"))
    kept = kept.select("id", F.transform("__k", lambda x: x["metric_name"]).alias(f"{col}_known"))
    return experiments.join(kept, on="id", how="left").withColumn(
        f"{col}_known", F.coalesce(F.col(f"{col}_known"), F.array().cast("array<string>"))
    )
