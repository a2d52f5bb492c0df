"""SRM chi-square cases and sample-size planning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitmill.functions import noncentral as N
from splitmill.operators import power as PW
from splitmill.operators import srm as SRM
from splitmill.operators import stats


def run_srm(spark, counts, shares=None):
    df = spark.createDataFrame([(f"g{i}", int(c)) for i, c in enumerate(counts)], "group_name string, observation_cnt long")
    sh = None
    if shares is not None:
        sh = spark.createDataFrame([(f"g{i}", float(s)) for i, s in enumerate(shares)], "group_name string, share double")
    return SRM.srm_test(df, sh).collect()[0].asDict()


# Group sizes a given distance from the plan: n units, shares a and 1 - a, first group off by
# k: the statistic is k^2 / (n a (1 - a)), the tail with one degree of freedom erfc(sqrt(x / 2)).
@pytest.mark.parametrize("n,a", [(4000, 0.5), (900, 0.2), (50_000, 0.36)])
@pytest.mark.parametrize("sigmas", [0.0, 1.5, 3.1, 6.0])
def test_two_groups_off_by_some_sigmas(spark, n, a, sigmas):
    off = round(sigmas * math.sqrt(n * a * (1 - a)))
    first = round(n * a) + off
    r = run_srm(spark, [first, n - first], None if a == 0.5 else [a, 1 - a])
    x = off**2 / (n * a * (1 - a))
    p = math.erfc(math.sqrt(x / 2))
    assert r["error"] is None and r["df"] == 1 and r["observed"] == [first, n - first]
    assert r["statistic"] == pytest.approx(x, abs=1e-9)
    assert r["p_value"] == pytest.approx(p, rel=1e-9)
    assert r["is_srm"] is (p < SRM.SRM_ALPHA)


def shares_table(spark, shares):
    return spark.createDataFrame([(f"g{i}", float(s)) for i, s in enumerate(shares)], "group_name string, share double")


def counts_table(spark, counts):
    return spark.createDataFrame([(f"g{i}", int(c)) for i, c in enumerate(counts)], "group_name string, observation_cnt long")


@pytest.mark.parametrize("counts", [[7], [40, -1, 30], [0, 0, 0]])
def test_counts_that_allow_no_test(spark, counts):
    r = run_srm(spark, counts)
    assert r["error"] is not None and r["p_value"] is None


@pytest.mark.parametrize("shares", [[0.25] * 4, [0.7, 0.2, 0.2], [0.5, 0.4, 0.05]])
def test_shares_that_do_not_fit(spark, shares):
    r = SRM.srm_test(counts_table(spark, [31, 29, 30]), shares_table(spark, shares)).collect()[0].asDict()
    assert r["error"] is not None and r["p_value"] is None


def test_chi2_tail_closed_form(spark):
    r = run_srm(spark, [100, 130, 110])
    x = r["statistic"]
    assert r["p_value"] == pytest.approx(math.exp(-x / 2), rel=1e-10)


def test_default_effect_grid():
    assert len(PW.DEFAULT_EFFECTS) == 21
    assert PW.DEFAULT_EFFECTS[0] == pytest.approx(0.005) and PW.DEFAULT_EFFECTS[-1] == pytest.approx(0.105)
    assert PW.slider_effects(0.5, 2.0) == [i / 1000 for i in range(5, 20)]


Z = {0.1: 1.6448536269514722, 0.05: 1.959963984540054, 0.01: 2.5758293035489004}
ZB = {0.05: 1.6448536269514722, 0.1: 1.2815515655446004, 0.2: 0.8416212335729142}


@pytest.mark.parametrize(
    "avg,var,effect,alpha,beta",
    # standardised differences of 0.4 to 2, at every pair of the tabulated levels
    [(20.0, (20.0 * 0.1 / d) ** 2, 0.1, alpha, beta) for d, alpha, beta in ((0.4, 0.1, 0.2), (0.6, 0.05, 0.1), (1.1, 0.01, 0.2), (2.0, 0.05, 0.05))],
)
def test_t_sample_size_matches_exact_power(spark, avg, var, effect, alpha, beta):
    df = spark.createDataFrame([(float(avg), float(var), float(effect))], "a double, v double, e double")
    got = df.select(PW.sample_size_mean_udf(alpha, beta)("a", "v", "e").alias("n")).collect()[0].n
    d = abs(avg * effect) / math.sqrt(var)
    ns = np.arange(2, 5000)
    exact = ns[np.argmax(N.two_sample_t_power(ns, d, alpha, Z[alpha]) >= 1 - beta)]
    assert abs(got - exact) <= max(3, 0.05 * exact)


def test_t_sample_size_large_branch(spark):
    # n0 >= 150: the t-based equation; close to the normal approximation
    avg, var, e = 10.0, 25.0, 0.05
    df = spark.createDataFrame([(avg, var, e)], "a double, v double, e double")
    got = df.select(PW.sample_size_mean_udf(0.05, 0.2)("a", "v", "e").alias("n")).collect()[0].n
    n0 = 2 * (Z[0.05] + ZB[0.2]) ** 2 * var / (avg * e) ** 2
    assert n0 >= 150
    assert abs(got - n0) <= max(3, 0.01 * n0)


@pytest.mark.parametrize("p,e,alpha,beta", [(0.25, 0.04, 0.05, 0.1), (0.6, 0.15, 0.01, 0.2), (0.02, 1.0, 0.1, 0.05), (0.9, 0.03, 0.05, 0.2)])
def test_proportion_sample_size_gives_power(spark, p, e, alpha, beta):
    n = spark.range(1).select(PW.sample_size_proportion(F.lit(p), F.lit(e), alpha, beta).alias("n")).collect()[0].n
    p2 = p * (1 + e)
    power = 0.5 * math.erfc(-(abs(p2 - p) * math.sqrt(n) / math.sqrt(p * (1 - p) + p2 * (1 - p2)) - Z[alpha]) / math.sqrt(2))
    assert power >= 1 - beta - 1e-9
    assert n == math.ceil((Z[alpha] + ZB[beta]) ** 2 * (p * (1 - p) + p2 * (1 - p2)) / (p - p2) ** 2)


@pytest.mark.parametrize(
    "mn,vn,md,vd,cov,e,beta", [(30, 45, 6, 9, 4.0, 0.08, 0.1), (7, 3, 14, 5, -1.5, 0.2, 0.2), (250, 900, 50, 60, 0.0, 0.03, 0.05)]
)
@pytest.mark.parametrize("alpha", [0.05, 0.01])
def test_ratio_sample_size_round_trip(spark, mn, vn, md, vd, cov, e, beta, alpha):
    lit = F.lit
    n = spark.range(1).select(PW.sample_size_ratio(lit(mn), lit(vn), lit(md), lit(vd), lit(cov), lit(e), alpha, beta).alias("n")).collect()[0].n
    r = (mn / md)
    args1 = (r, mn, vn, md, vd, cov, n)
    args2 = (r * (1 + e), mn * (1 + e), vn, md, vd, cov, n)
    p = spark.range(1).transform(lambda d: stats.delta_ratio_test(d, *[F.lit(float(a)) for a in args1 + args2])).collect()[0].p_value
    assert p < alpha


def test_ratio_sample_size_rejects_zero_effect_and_zero_denominator(spark):
    lit = F.lit
    r = spark.range(1).select(
        PW.sample_size_ratio(lit(1.0), lit(1.0), lit(1.0), lit(1.0), lit(0.0), lit(0.0)).alias("a"),
        PW.sample_size_ratio(lit(1.0), lit(1.0), lit(0.0), lit(1.0), lit(0.0), lit(0.1)).alias("b"),
    ).collect()[0]
    assert r.a is None and r.b is None


def test_plan_drops_out_of_range_proportions(spark):
    from splitmill.operators.precompute import PRECOMPUTE_SCHEMA

    rows = [
        ("planning", "conv", "Conv", "proportion", 10000, 0.96, None, None, None, None, None),
        ("planning", "rev", "Rev", "avg", 5000, 50.0, None, 625.0, None, None, None),
        ("planning", "rpu", "RPU", "ratio", 8000, 25.0, 100.0, 10000.0, 4.0, 6.0, 100.0),
    ]
    pre = spark.createDataFrame(rows, PRECOMPUTE_SCHEMA)
    out = PW.plan_sample_sizes(pre, [0.05, 0.1], reference_days=14).collect()
    names = {(r.metric_name, r.effect_size) for r in out}
    assert ("conv", 0.1) not in names and ("conv", 0.05) not in names  # 0.96 * 1.05 >= 1
    assert ("rev", 0.05) in names and ("rpu", 0.1) in names
    for r in out:
        assert r.observations_per_day == pytest.approx({"rev": 5000, "rpu": 8000}[r.metric_name] / 14)
        assert r.days == pytest.approx(r.sample_size / r.observations_per_day)


def test_alpha_beta_must_be_tabulated(spark):
    from splitmill.functions.dist import NORM_PPF_ALPHA_TWO_SIDED, NORM_PPF_BETA

    assert sorted(NORM_PPF_ALPHA_TWO_SIDED) == [0.001, 0.01, 0.05, 0.1] and sorted(NORM_PPF_BETA) == [0.05, 0.1, 0.2]
    with pytest.raises(ValueError):
        PW.sample_size_proportion(F.lit(0.1), F.lit(0.1), alpha=0.03)
    with pytest.raises(ValueError):
        PW.sample_size_mean_udf(0.05, 0.3)
    with pytest.raises(ValueError):
        PW.plan_sample_sizes(spark.range(1), [0.1], reference_days=0)
