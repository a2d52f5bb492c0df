"""Entry C: sample-size planning for an observation (planning purpose, one group)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.power import plan_sample_sizes
from .analysis import Inputs, run_observation
from ..session import materialize
from .observation import Observation


def plan(
    spark: SparkSession,
    inputs: Inputs,
    obs: Observation,
    metrics: list,
    effects: list[float] | None = None,
    alpha: float = 0.05,
    beta: float = 0.2,
    n_groups: int = 1,
) -> DataFrame:
    """Planning run (not stored) -> sample size and duration per (metric, effect)."""
    pre = materialize(run_observation(spark, inputs, obs.as_planning(), metrics))
    return plan_sample_sizes(pre, effects, obs.reference_days, alpha, beta, n_groups=n_groups)
