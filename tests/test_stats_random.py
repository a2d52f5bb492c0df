"""Randomised cross-check of the tests against NumPy formulas (one Spark job per test type)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitmill.functions import noncentral as N
from splitmill.operators import stats

Z975 = 1.959963984540054
N_ROWS = 300


def _frame(spark, cols):
    rows = list(zip(*[c.tolist() for c in cols.values()]))
    return spark.createDataFrame(rows, ", ".join(f"{k} double" for k in cols))


def test_welch_random(spark):
    rng = np.random.default_rng(101)
    cols = {
        "m1": rng.normal(0, 50, N_ROWS), "v1": rng.uniform(0, 400, N_ROWS), "n1": rng.integers(2, 5000, N_ROWS).astype(float),
        "m2": rng.normal(0, 50, N_ROWS), "v2": rng.uniform(0, 400, N_ROWS), "n2": rng.integers(2, 5000, N_ROWS).astype(float),
    }
    cols["v1"][:10] = 0.0  # some zero variances
    import time

    t0 = time.time()
    out = stats.welch_ttest(_frame(spark, cols), *[F.col(c) for c in cols]).collect()
    assert time.time() - t0 < 60
    got = {(r.m1, r.m2, r.n1): r for r in out}
    m1, v1, n1, m2, v2, n2 = (cols[c] for c in cols)
    se = np.sqrt(v1 / n1 + v2 / n2)
    stat = (m2 - m1) / se
    dof = (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    p = 2 * (1 - N.t_cdf(np.abs(stat), dof))
    q = np.where(dof > 100000, Z975, N.t_ppf(0.975, dof))
    for i in range(N_ROWS):
        r = got[(m1[i], m2[i], n1[i])]
        assert r.statistic == pytest.approx(stat[i], rel=1e-9)
        assert r.p_value == pytest.approx(p[i], abs=1e-8)
        assert r.ci_lower == pytest.approx((m2[i] - m1[i]) - se[i] * q[i], rel=1e-7, abs=1e-7)
        assert r.diff_ratio == pytest.approx((m2[i] - m1[i]) / m1[i], rel=1e-12)


def test_ztest_random(spark):
    rng = np.random.default_rng(202)
    cols = {
        "p1": rng.uniform(0, 1, N_ROWS), "n1": rng.integers(1, 100000, N_ROWS).astype(float),
        "p2": rng.uniform(0, 1, N_ROWS), "n2": rng.integers(1, 100000, N_ROWS).astype(float),
    }
    cols["p1"][:5] = 0.0
    cols["p2"][:5] = 0.0
    out = {(r.p1, r.n1, r.p2): r for r in stats.ztest_proportion(_frame(spark, cols), *[F.col(c) for c in cols]).collect()}
    for i in range(N_ROWS):
        p1, n1, p2, n2 = (cols[c][i] for c in cols)
        r = out[(p1, n1, p2)]
        pool = (p1 * n1 + p2 * n2) / (n1 + n2)
        den = math.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
        stat = (p2 - p1) / den if den != 0 else 0.0
        assert r.statistic == pytest.approx(stat, rel=1e-9, abs=1e-12)
        assert r.p_value == pytest.approx(math.erfc(abs(stat) / math.sqrt(2)), rel=1e-9, abs=1e-300)
        assert r.diff_ratio == (math.inf if p1 == 0 else pytest.approx((p2 - p1) / p1, rel=1e-12))


def test_delta_random(spark):
    rng = np.random.default_rng(303)
    cols = {}
    for s in ("1", "2"):
        cols[f"mn{s}"] = rng.uniform(50, 150, N_ROWS)
        cols[f"vn{s}"] = rng.uniform(10, 500, N_ROWS)
        cols[f"md{s}"] = rng.uniform(20, 80, N_ROWS)
        cols[f"vd{s}"] = rng.uniform(10, 300, N_ROWS)
        cols[f"cv{s}"] = rng.uniform(-20, 20, N_ROWS)
        cols[f"n{s}"] = rng.integers(100, 10000, N_ROWS).astype(float)
    cols["r1"] = cols["mn1"] / cols["md1"]
    cols["r2"] = cols["mn2"] / cols["md2"]
    df = _frame(spark, cols)
    c = F.col
    out = stats.delta_ratio_test(
        df, c("r1"), c("mn1"), c("vn1"), c("md1"), c("vd1"), c("cv1"), c("n1"),
        c("r2"), c("mn2"), c("vn2"), c("md2"), c("vd2"), c("cv2"), c("n2"),
    ).collect()
    got = {(r.mn1, r.mn2): r for r in out}

    def dv(mn, vn, md, vd, cv):
        raw = vn / md**2 + mn**2 * vd / md**4 - 2 * mn * cv / md**3
        return 0.0 if -1e-9 < raw < 0 else raw

    for i in range(N_ROWS):
        g = {k: v[i] for k, v in cols.items()}
        r = got[(g["mn1"], g["mn2"])]
        se = math.sqrt(dv(g["mn1"], g["vn1"], g["md1"], g["vd1"], g["cv1"]) / g["n1"] + dv(g["mn2"], g["vn2"], g["md2"], g["vd2"], g["cv2"]) / g["n2"])
        stat = (g["r2"] - g["r1"]) / se
        assert r.statistic == pytest.approx(stat, rel=1e-9)
        assert r.p_value == pytest.approx(math.erfc(abs(stat) / math.sqrt(2)), rel=1e-9, abs=1e-300)
        assert r.ci_upper == pytest.approx((g["r2"] - g["r1"]) + Z975 * se, rel=1e-9)
