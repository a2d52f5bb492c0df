"""Significance and planning on the reference's fixture shapes, checked row by row
against independent NumPy computations."""

import math

import numpy as np
import pytest

from splitmill.functions import noncentral as N
from splitmill.operators import power as PW
from splitmill.operators import significance as S
from splitmill.operators.precompute import PRECOMPUTE_SCHEMA

Z975 = 1.959963984540054


def random_precompute(seed=42):
    """3 groups x 3 types x 2 metrics, moments drawn as in the reference's generator."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in ["control", "treatment1", "treatment2"]:
        shift = 0 if g == "control" else 10
        for k in range(2):
            n = int(rng.integers(1000, 2000))
            rows.append((g, f"avg_{k}", f"Avg {k}", "avg", n, float(rng.normal(100 + shift, 10)), None, float(rng.uniform(50, 100)), None, None, None))
            num, den = float(rng.normal(100 + shift, 10)), float(rng.normal(200, 20))
            rows.append((g, f"ratio_{k}", f"Ratio {k}", "ratio", n, num / den, num, float(rng.uniform(50, 100)), den,
                         float(rng.uniform(100, 200)), float(rng.uniform(-50, 50))))
            n2 = int(rng.integers(10000, 20000))
            p = float(rng.uniform(0.1, 0.3) if g == "control" else rng.uniform(0.2, 0.4))
            rows.append((g, f"prop_{k}", f"Prop {k}", "proportion", n2, p, None, None, None, None, None))
    return rows


def expected(c, k):
    t = c[3]
    if t == "avg":
        m1, v1, n1, m2, v2, n2 = c[5], c[7], c[4], k[5], k[7], k[4]
        se = math.sqrt(v1 / n1 + v2 / n2)
        stat = (m2 - m1) / se
        dof = (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
        p = 2 * (1 - float(N.t_cdf(abs(stat), dof)))
        q = float(N.t_ppf(0.975, dof))
        return stat, p, (m2 - m1) - se * q, (m2 - m1) + se * q, (m2 - m1) / m1
    if t == "proportion":
        p1, n1, p2, n2 = c[5], c[4], k[5], k[4]
        pool = (p1 * n1 + p2 * n2) / (n1 + n2)
        stat = (p2 - p1) / math.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
        se = math.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
        return stat, math.erfc(abs(stat) / math.sqrt(2)), (p2 - p1) - Z975 * se, (p2 - p1) + Z975 * se, (p2 - p1) / p1

    def dvar(r):
        mn, vn, md, vd, cv, n = r[6], r[7], r[8], r[9], r[10], r[4]
        return (vn / md**2 + mn**2 * vd / md**4 - 2 * mn * cv / md**3) / n

    se = math.sqrt(dvar(c) + dvar(k))
    diff = k[5] - c[5]
    stat = diff / se
    return stat, math.erfc(abs(stat) / math.sqrt(2)), diff - Z975 * se, diff + Z975 * se, diff / c[5]


def test_random_precompute_table(spark):
    rows = random_precompute()
    pre = spark.createDataFrame(rows, PRECOMPUTE_SCHEMA)
    got = {(r.metric_name, r.group_name_compared): r for r in S.significance_table(pre).collect()}
    by = {(r[0], r[1]): r for r in rows}
    assert len(got) == 12
    for (metric, grp), r in got.items():
        assert r.group_name_control == "control"
        stat, p, lo, hi, ratio = expected(by[("control", metric)], by[(grp, metric)])
        assert r.statistic == pytest.approx(stat, rel=1e-9)
        assert r.p_value == pytest.approx(p, abs=1e-9)
        assert r.ci_lower == pytest.approx(lo, rel=1e-7, abs=1e-9)
        assert r.ci_upper == pytest.approx(hi, rel=1e-7, abs=1e-9)
        assert r.diff_ratio == pytest.approx(ratio, rel=1e-12)


def test_empty_table_gives_no_rows(spark):
    pre = spark.createDataFrame([], PRECOMPUTE_SCHEMA)
    assert S.significance_table(pre).count() == 0


def test_planning_fixture_rows(spark):
    rows = [
        ("planning", "conv", "Conv", "proportion", 10000, 0.15, None, None, None, None, None),
        ("planning", "rev", "Rev", "avg", 5000, 50.0, None, 625.0, None, None, None),
        ("planning", "rpu", "RPU", "ratio", 8000, 25.0, 100.0, 10000.0, 4.0, 6.0, 100.0),
    ]
    pre = spark.createDataFrame(rows, PRECOMPUTE_SCHEMA)
    effects = [0.05, 0.1, 0.15]
    out = {(r.metric_name, r.effect_size): r for r in PW.plan_sample_sizes(pre, effects, reference_days=14).collect()}
    zz = (1.959963984540054 + 0.8416212335729142) ** 2
    for e in effects:
        p1, p2 = 0.15, 0.15 + 0.15 * e
        assert out[("conv", e)].sample_size == math.ceil(zz * (p1 * (1 - p1) + p2 * (1 - p2)) / (p1 - p2) ** 2)
        var_ratio = 10000 / 16 + 100**2 * 6 / 4**4 - 2 * 100 * 100 / 4**3
        ratio = 100 / 4
        assert out[("rpu", e)].sample_size == math.ceil(2 * zz * var_ratio / (ratio * (1 + e) - ratio) ** 2)
        n0 = 2 * zz * 625 / (50 * e) ** 2
        assert abs(out[("rev", e)].sample_size - n0) <= max(3, 0.02 * n0)
        assert out[("rev", e)].observations_per_day == pytest.approx(5000 / 14)


def test_many_analyses_in_one_table(spark):
    from pyspark.sql import functions as F

    rows = random_precompute(1)
    other = [(("base" if r[0] == "control" else r[0]),) + r[1:] for r in random_precompute(2)]  # no "control" group here
    a = spark.createDataFrame(rows, PRECOMPUTE_SCHEMA).withColumn("job_id", F.lit(1))
    b = spark.createDataFrame(other, PRECOMPUTE_SCHEMA).withColumn("job_id", F.lit(2))
    both = S.significance_table(a.unionByName(b), keys=["job_id"])
    got = {(r.job_id, r.metric_name, r.group_name_compared): r for r in both.collect()}
    ctl = {r.job_id: r.group_name_control for r in both.select("job_id", "group_name_control").distinct().collect()}
    assert ctl == {1: "control", 2: "base"}  # "base" sorts before the treatments
    for job, df in ((1, a), (2, b)):
        for r in S.significance_table(df.drop("job_id")).collect():
            g = got[(job, r.metric_name, r.group_name_compared)]
            assert g.p_value == pytest.approx(r.p_value, abs=1e-15) and g.statistic == pytest.approx(r.statistic, rel=1e-15)
    piv = S.significance_pivot(both, ["treatment1", "treatment2"], ["p_value"], keys=["job_id"])
    assert piv.count() == 12 and piv.columns[:3] == ["job_id", "treatment1__p_value", "treatment2__p_value"]
