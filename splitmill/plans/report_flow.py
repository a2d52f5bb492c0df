"""Entry B: the results report of one stored job.

Stored precompute (partition-pruned on ``job_id``) -> group sizes and SRM ->
control vs compared tests -> catalog labels, metric filter, significance flag.
Everything stays a DataFrame; the caller shows or writes it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import report as R
from ..operators import significance as S
from ..operators import srm as SRM
from ..operators.precompute import group_sizes
from ..session import materialize
from ..sources.catalog import MetricSpec, catalog_frame
from ..sources.sinks import read_precompute


@dataclass
class Report:
    precompute: DataFrame
    group_sizes: DataFrame
    srm: DataFrame
    significance: DataFrame


def job_report(
    spark: SparkSession,
    precompute_path: str,
    job_id: int,
    metrics: list[MetricSpec],
    control_group: str | None = None,
    compared_groups: list[str] | None = None,
    threshold: float | None = 0.05,
    metric_groups: list[str] | None = None,
    metric_tags: list[str] | None = None,
    expected_shares: DataFrame | None = None,
) -> Report:
    pre = materialize(read_precompute(spark, precompute_path, job_id).drop("job_id"))
    sizes = group_sizes(pre)
    srm = SRM.srm_test(sizes, expected_shares)
    table = S.significance_table(pre, control_group)
    shown = R.present(
        table, catalog_frame(spark, metrics), threshold=threshold,
        groups=metric_groups, tags=metric_tags, compared_groups=compared_groups,
    )
    return Report(pre, sizes, srm, shown)
