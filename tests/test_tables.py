"""Bookkeeping tables: schemas, observation rows, job context, planner gaps."""

from datetime import datetime as dt

from splitmill.operators import power as PW
from splitmill.operators.precompute import PRECOMPUTE_SCHEMA
from splitmill.sources import tables as TB


def _obs_rows():
    base = dict(
        calculation_scenario="base", exposure_start_datetime=dt(2024, 1, 1), exposure_end_datetime=dt(2024, 1, 14),
        calc_start_datetime=dt(2024, 1, 1), calc_end_datetime=dt(2024, 1, 21), audience_tables=None,
        custom_test_ids_query=None, metric_tags=None, metric_groups=None, _created_at=dt(2024, 1, 1), _updated_at=dt(2024, 1, 1),
    )
    rows = [
        dict(id=1, experiment_id=1, name="web", db_experiment_name="exp_a", split_id="user_id", exposure_event="view",
             filters=["platform='web'"], **base),
        dict(id=2, experiment_id=1, name="devices", db_experiment_name="exp_a", split_id="device_id", exposure_event=None,
             filters=["country in ('USA', 'FR')"], **base),
        dict(id=3, experiment_id=2, name="all", db_experiment_name="exp_b", split_id="user_id", exposure_event=None, filters=None, **base),
    ]
    return [tuple(r[f.name] for f in TB.OBSERVATION_SCHEMA.fields) for r in rows]


def test_observation_rows_and_context(spark):
    obs = spark.createDataFrame(_obs_rows(), TB.OBSERVATION_SCHEMA)
    exps = spark.createDataFrame(
        [(1, "Checkout", "running", None, None, None, None, ["ctr"], None, None, None, None),
         (2, "Pricing", "completed", None, None, None, None, None, None, None, None, None)],
        TB.EXPERIMENT_SCHEMA,
    )
    jobs = spark.createDataFrame(
        [(10, 1, "q", "completed", None, {"rows": "2000"}, dt(2024, 1, 2)), (11, 2, "q", "failed", "Render error: x", None, dt(2024, 1, 2)),
         (12, 3, "q", "completed", None, None, dt(2024, 1, 3)), (13, 3, "q", "running", None, None, dt(2024, 1, 4))],
        TB.JOB_SCHEMA,
    )
    first = TB.observation_from_row(obs.where("id = 1").collect()[0])
    assert first.split_id == "user_id" and first.filters == ("platform='web'",) and first.exposure_event == "view"
    assert TB.observation_from_row(obs.where("id = 2").collect()[0]).split_id == "device_id"
    ctx = {r.id: (r.observation_name, r.experiment_name) for r in TB.job_context(jobs, obs, exps).collect()}
    assert ctx == {10: ("web", "Checkout"), 11: ("devices", "Checkout"), 12: ("all", "Pricing"), 13: ("all", "Pricing")}


def test_metrics_without_effects(spark):
    pre = spark.createDataFrame(
        [("planning", "sat", "Sat", "proportion", 100, 0.99, None, None, None, None, None),
         ("planning", "ok", "Ok", "proportion", 100, 0.2, None, None, None, None, None)],
        PRECOMPUTE_SCHEMA,
    )
    plan = PW.plan_sample_sizes(pre, [0.05, 0.1], reference_days=7)
    assert [r.metric_name for r in PW.metrics_without_effects(pre, plan).collect()] == ["sat"]


def test_run_stored_observation(spark):
    from splitmill.plans import registry as RG

    d = "/root/testdata/sf0.001"
    RG.audience_big_buyers(spark, d).createOrReplaceTempView("sm_aud_buyers")
    row = dict(
        id=7, experiment_id=1, name="stored", db_experiment_name="exp_signup", split_id="user_id", calculation_scenario="base",
        exposure_start_datetime=dt(2024, 1, 1), exposure_end_datetime=dt(2024, 1, 20, 23, 59, 59),
        calc_start_datetime=dt(2024, 1, 1), calc_end_datetime=dt(2024, 1, 30, 23, 59, 59), exposure_event="view",
        audience_tables=["sm_aud_buyers"], filters=None, custom_test_ids_query=None, metric_tags=None, metric_groups=None,
    )
    inp = RG.light_inputs(spark, d)
    got = TB.run_stored_observation(spark, row, inp.events, inp.testids, RG.LIGHT_METRICS, assignment_tie_break=["record_id"])
    want = RG.unit_table(spark, RG.light_inputs(spark, d, audiences=[RG.audience_big_buyers(spark, d)]), RG.light_obs(), RG.LIGHT_METRICS)
    from splitmill.operators.precompute import precompute

    a = sorted((r.group_name, r.metric_name, r.observation_cnt) for r in got.collect())
    b = sorted((r.group_name, r.metric_name, r.observation_cnt) for r in precompute(want, RG.LIGHT_METRICS, "user_id").collect())
    assert a == b and a
