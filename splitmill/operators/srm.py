"""Sample-ratio mismatch: Pearson chi-square of observed group sizes (T-14, W-5, A-26).

Works per analysis key on a (keys, group_name, observed) table; expected shares
are uniform or joined by group name.  Arrays (observed, expected, allocation)
are ordered by group name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist

SRM_ALPHA = 1e-3
SHARE_RTOL = 1e-6


def srm_test(
    counts: DataFrame,
    expected_shares: DataFrame | None = None,
    alpha: float = SRM_ALPHA,
    keys: list[str] | None = None,
    count_col: str = "observation_cnt",
) -> DataFrame:
    """``keys..., statistic, p_value, df, observed, expected, allocation, is_srm, error``.

    ``error`` names the first broken rule (then the test columns are NULL):
    fewer than 2 groups, negative count, non-positive total, a group without a
    share or a share without a group, non-positive share, shares not summing to 1."""
    keys = list(keys or [])
    obs = counts.select(*keys, "group_name", F.col(count_col).cast("double").alias("observed"))
    if expected_shares is None:
        rows = obs.withColumns({"share": F.lit(None).cast("double"), "__orphan": F.lit(False)})
    else:
        shares = expected_shares.select(*keys, "group_name", F.col("share").cast("double").alias("share"))
        rows = obs.join(shares, on=keys + ["group_name"], how="full").withColumn(
            "__orphan", F.col("observed").isNull() | F.col("share").isNull()
        )
    # one row per analysis, its groups in a list; sums combine in tasks
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("k"),
        F.sum("observed").alias("total"),
        F.min("observed").alias("min_observed"),
        F.max(F.col("__orphan").cast("int")).alias("orphan"),
        F.sort_array(F.collect_list(F.struct("group_name", "observed", "share"))).alias("__groups"),
    ).where("k > 0")
    share = (lambda g: F.lit(1.0) / F.col("k")) if expected_shares is None else (lambda g: g["share"])
    each = lambda g: F.struct(g["observed"].alias("observed"), (F.col("total") * share(g)).alias("expected"), share(g).alias("share"))
    agg = agg.withColumn("__arr", F.transform("__groups", each))
    term = lambda g: F.when(g["expected"] > 0, F.pow(g["observed"] - g["expected"], F.lit(2.0)) / g["expected"])
    total = lambda value: F.aggregate(F.filter(F.transform("__arr", value), lambda x: x.isNotNull()), F.lit(0.0), lambda acc, x: acc + x)
    agg = agg.withColumns({"statistic": total(term), "share_sum": total(lambda g: g["share"]), "min_share": F.array_min(F.transform("__arr", lambda g: g["share"]))})
    error = (
        F.when(F.col("k") < 2, F.lit("fewer_than_two_groups"))
        .when(F.col("orphan") == 1, F.lit("shares_do_not_match_groups"))
        .when(F.col("min_observed") < 0, F.lit("negative_count"))
        .when(F.col("total") <= 0, F.lit("non_positive_total"))
        .when(F.col("min_share") <= 0, F.lit("non_positive_share"))
        .when(F.abs(F.col("share_sum") - 1.0) > F.lit(1e-12) + F.lit(SHARE_RTOL), F.lit("shares_do_not_sum_to_one"))
    )
    ok = error.isNull()
    dof = (F.col("k") - 1).cast("int")
    p = dist.chi2_sf(F.col("statistic"), dof.cast("double"))
    return agg.select(
        *keys,
        F.when(ok, F.col("statistic")).alias("statistic"),
        F.when(ok, p).alias("p_value"),
        F.when(ok, dof).alias("df"),
        F.transform("__arr", lambda s: s["observed"].cast("long")).alias("observed"),
        F.transform("__arr", lambda s: s["expected"]).alias("expected"),
        F.transform("__arr", lambda s: s["share"]).alias("allocation"),
        F.when(ok, p < F.lit(alpha)).alias("is_srm"),
        error.alias("error"),
    )


def group_shares(counts: DataFrame, keys: list[str] | None = None, count_col: str = "observation_cnt") -> DataFrame:
    """Observed share of total and the uniform expected share per group (W-5)."""
    keys = list(keys or [])
    totals = counts.groupBy(*keys).agg(F.sum(count_col).alias("__total"), F.count("*").alias("__k"))
    # one row per analysis; without keys one row in all
    rows = counts.join(totals, on=keys) if keys else counts.crossJoin(F.broadcast(totals))
    return rows.select(
        *keys, "group_name", F.col(count_col),
        (F.col(count_col) / F.col("__total")).alias("share"),
        (F.lit(1.0) / F.col("__k")).alias("expected_share"),
    )
