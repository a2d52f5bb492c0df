"""Statistical tests: closed-form expectations, edge rules, independent NumPy checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitmill.functions import noncentral as N
from splitmill.operators import stats


def one(spark, fn, *args):
    df = spark.range(1)
    return fn(df, *[F.lit(float(a)) for a in args]).collect()[0].asDict()


def welch(spark, *a):
    return one(spark, stats.welch_ttest, *a)


def ztest(spark, *a):
    return one(spark, stats.ztest_proportion, *a)


def test_welch_identical_groups(spark):
    r = welch(spark, 5, 2, 10, 5, 2, 10)
    assert r["p_value"] == pytest.approx(1.0)
    assert r["statistic"] == 0.0


def test_welch_detects_difference(spark):
    assert welch(spark, 2, 1, 50, 3, 2, 40)["p_value"] < 0.05


@pytest.mark.parametrize(
    "spec",
    [((4.5, 1.2, 17), (4.5, 6.1, 23)), ((-2.0, 0.3, 400), (-1.9, 0.9, 12)), ((130.0, 45.0, 2500), (128.0, 40.0, 7100))],
)
def test_welch_matches_independent_numpy(spark, spec):
    rng = np.random.default_rng(7)
    (mu1, sd1, n1), (mu2, sd2, n2) = spec
    a, b = rng.normal(mu1, sd1, n1), rng.normal(mu2, sd2, n2)
    m1, v1, m2, v2 = a.mean(), a.var(ddof=1), b.mean(), b.var(ddof=1)
    r = welch(spark, m1, v1, n1, m2, v2, n2)
    se = math.sqrt(v1 / n1 + v2 / n2)
    t = (m2 - m1) / se
    dof = (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    p = 2 * (1 - N.t_cdf(abs(t), dof))
    q = N.t_ppf(0.975, dof) if dof <= 100000 else 1.959963984540054
    assert r["statistic"] == pytest.approx(t, rel=1e-12)
    assert r["p_value"] == pytest.approx(float(p), abs=1e-9)
    assert r["ci_lower"] == pytest.approx((m2 - m1) - se * float(q), abs=1e-8)
    assert r["ci_upper"] == pytest.approx((m2 - m1) + se * float(q), abs=1e-8)


def test_welch_zero_variance_gives_nan(spark):
    r = welch(spark, 3, 0, 10, 3, 0, 10)
    assert math.isnan(r["statistic"]) and math.isnan(r["p_value"])


def test_welch_relative_difference(spark):
    assert welch(spark, 10, 1, 10, 12, 1, 10)["diff_ratio"] == pytest.approx(0.2)
    assert welch(spark, 0, 1, 10, 0, 1, 10)["diff_ratio"] == math.inf


def test_welch_symmetry(spark):
    a = welch(spark, 2, 1.5, 40, 2.4, 2.5, 45)
    b = welch(spark, 2.4, 2.5, 45, 2, 1.5, 40)
    assert a["statistic"] == pytest.approx(-b["statistic"])
    assert a["p_value"] == pytest.approx(b["p_value"])


def test_ztest_cases(spark):
    assert ztest(spark, 0.5, 1000, 0.5, 1000)["p_value"] == pytest.approx(1.0)
    assert ztest(spark, 0.5, 1000, 0.6, 1000)["p_value"] < 0.05
    zero = ztest(spark, 0, 100, 0, 100)
    assert zero["diff_ratio"] == math.inf and zero["p_value"] == pytest.approx(1.0) and zero["statistic"] == 0.0
    assert ztest(spark, 0, 100, 0.1, 100)["p_value"] < 0.01


def test_ztest_matches_closed_form(spark):
    p1, n1, p2, n2 = 0.3, 400, 0.36, 500
    pooled = (p1 * n1 + p2 * n2) / (n1 + n2)
    z = (p2 - p1) / math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2))
    r = ztest(spark, p1, n1, p2, n2)
    assert r["statistic"] == pytest.approx(z, rel=1e-12)
    assert r["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-12)


def _delta(spark, *a):
    return one(spark, stats.delta_ratio_test, *a)


def _ratio_moments(rng, mn, sdn, md, sdd, rho, n):
    cov = [[sdn**2, rho * sdn * sdd], [rho * sdn * sdd, sdd**2]]
    x = rng.multivariate_normal([mn, md], cov, n)
    num, den = x[:, 0], x[:, 1]
    return (num.sum() / den.sum(), num.mean(), num.var(ddof=1), den.mean(), den.var(ddof=1), np.cov(num, den, ddof=1)[0, 1], n)


def test_delta_method_same_and_shifted(spark):
    rng = np.random.default_rng(11)
    a = _ratio_moments(rng, 100, 20, 50, 30, 0.5, 5000)
    b = _ratio_moments(rng, 100, 20, 50, 30, 0.5, 5000)
    c = _ratio_moments(rng, 120, 20, 50, 30, 0.5, 5000)
    assert _delta(spark, *a, *b)["p_value"] > 0.05
    assert _delta(spark, *a, *c)["p_value"] < 0.01


def test_delta_variance_zero_denominator_is_nan(spark):
    v = spark.range(1).select(stats.delta_ratio_variance(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("v")).collect()[0].v
    assert math.isnan(v)


def test_ratio_test_zero_variance_rules(spark):
    r = one(spark, stats.ratio_ztest, 10, 0, 10, 0)
    assert r["p_value"] == pytest.approx(1.0) and r["diff_ratio"] == 0.0 and r["statistic"] == 0.0
    r = one(spark, stats.ratio_ztest, 0, 5, 10, 5)
    assert r["p_value"] < 0.01 and r["diff_ratio"] == math.inf
    r = one(spark, stats.ratio_ztest, 1, 0, 3, 0)
    assert r["statistic"] == math.inf and r["p_value"] == 0.0


def test_delta_variance_formula(spark):
    mn, vn, md, vd, cv = 3.0, 2.0, 1.5, 0.5, 0.2
    want = vn / md**2 + mn**2 * vd / md**4 - 2 * mn * cv / md**3
    got = spark.range(1).select(stats.delta_ratio_variance(F.lit(mn), F.lit(vn), F.lit(md), F.lit(vd), F.lit(cv)).alias("v")).collect()[0].v
    assert got == pytest.approx(want, rel=1e-14)
