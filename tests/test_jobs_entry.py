"""Job runner, sinks, and the driver contract (entry, queries, oracle SQL)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from splitmill.plans import registry as RG
from splitmill.plans.jobs import run_job
from splitmill.sources import sinks
from splitmill.sources.catalog import FormulaSpec, MetricSpec
from splitmill.sources.testdata import TABLES

from .conftest import SF_SMALL


def _inputs(spark):
    return RG.light_inputs(spark, SF_SMALL)


def test_job_completed_and_stored(spark, tmp_path):
    res = run_job(spark, 7, _inputs(spark), RG.light_obs(observation_id=3), RG.LIGHT_METRICS, str(tmp_path / "pre"), str(tmp_path / "log"))
    assert res.status == "completed" and res.error_message is None
    stored = sinks.read_precompute(spark, str(tmp_path / "pre"), 7)
    assert stored.count() == res.precompute.count() > 0
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(job_id" in plan or "job_id" in plan
    cur = sinks.current_jobs(spark.read.parquet(str(tmp_path / "log"))).collect()
    assert [(r.job_id, r.status) for r in cur] == [(7, "completed")]


def test_job_failure_recorded(spark, tmp_path):
    bad = [MetricSpec("broken", "avg", FormulaSpec("broken", "SUM(no_such_column)"))]
    res = run_job(spark, 8, _inputs(spark), RG.light_obs(), bad, str(tmp_path / "pre"), str(tmp_path / "log"))
    assert res.status == "failed" and res.error_message.startswith(("Render error", "Execution error"))
    statuses = [r.status for r in res.log.orderBy("seq").collect()]
    assert statuses[0] == "pending" and statuses[-1] == "failed"


def test_planning_job_not_stored(spark, tmp_path):
    res = run_job(spark, 9, _inputs(spark), RG.light_obs(purpose="planning"), RG.LIGHT_METRICS, str(tmp_path / "pre"))
    assert res.status == "completed" and {r.group_name for r in res.precompute.collect()} == {"planning"}
    assert not (tmp_path / "pre").exists()


def test_a_rerun_and_a_killed_run_leave_one_set_of_rows(spark, tmp_path):
    path = str(tmp_path / "pre")
    rows = RG.light_precompute(spark, SF_SMALL)
    sinks.append_precompute(rows.limit(3), path, 7)
    sinks.append_precompute(rows, path, 8)
    sinks.append_precompute(rows, path, 7)  # the rerun
    from pyspark.sql import functions as F

    rows.withColumns({"job_id": F.lit(7).cast("long"), "run": F.lit("killed")}).write.mode("append").partitionBy("job_id", "run").parquet(path)  # no commit
    assert sinks.read_precompute(spark, path, 7).count() == sinks.read_precompute(spark, path, 8).count() == rows.count()
    assert sinks.read_precompute(spark, path, 9).count() == 0


def test_job_log_is_written_as_the_job_goes(spark, tmp_path, monkeypatch):
    from datetime import datetime, timedelta, timezone

    from splitmill.plans import jobs

    log, seen = str(tmp_path / "log"), {}

    def look(*a, **k):
        seen["at start"] = [r.status for r in spark.read.parquet(log).collect()]
        raise KeyboardInterrupt  # the driver dies

    monkeypatch.setattr(jobs, "run_scenario", look)
    with pytest.raises(KeyboardInterrupt):
        run_job(spark, 41, _inputs(spark), RG.light_obs(), RG.LIGHT_METRICS, None, log)
    assert seen["at start"] == ["pending"]
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    stored = spark.read.parquet(log)
    assert sinks.lost_jobs(stored, now, hours=1).count() == 0
    (lost,) = sinks.lost_jobs(stored, now + timedelta(hours=2), hours=1).collect()
    assert (lost.job_id, lost.status, lost.error_message) == (41, "failed", sinks.LOST)


def test_job_that_cannot_be_created(spark, tmp_path):
    blocker = tmp_path / "log"
    blocker.write_text("a file where the log should be")
    res = run_job(spark, 42, _inputs(spark), RG.light_obs(), RG.LIGHT_METRICS, str(tmp_path / "pre"), str(blocker))
    assert res.status == "failed" and res.error_message.startswith("Job create failed") and not (tmp_path / "pre").exists()


def test_every_violation_is_stored(spark, tmp_path):
    bad = [MetricSpec(f"not_a_share_{k}", "proportion", FormulaSpec(f"n_events_{k}", "COUNT(*)")) for k in range(4)]
    res = run_job(spark, 43, _inputs(spark), RG.light_obs(), bad, str(tmp_path / "pre"), violations_path=str(tmp_path / "bad"))
    rows = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert len(rows) == 12 and {r.code for r in rows} == {"proportion_out_of_range"} and "12 x proportion_out_of_range" in res.error_message


def test_contract_missing_columns(spark):
    df = spark.createDataFrame([("a", 1)], "GROUP_NAME string, Metric_Name int")
    with pytest.raises(ValueError, match="missing required columns"):
        sinks.as_precompute(df)


def test_error_text_is_stored_whole(spark):
    df = sinks.job_event(spark, 1, "failed", 1, error_message="x" * 5000)
    assert df.collect()[0].error_message == "x" * 5000


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    own = {q for q in E.queries() if q.startswith("q_")}  # the text operators have tests of their own
    assert own - set(E.oracle_sql()) == {"q_sample_size_avg", "q_sample_rows", "q_json_export"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


@pytest.mark.parametrize(
    "name", ["q_precompute_long", "q_unit_agg_keep_inactive", "q_audience_inner", "q_welch", "q_ztest", "q_ratio_test", "q_srm_expected", "q_guarded_sql", "q_topk_similar"]
)
def test_oracle_small(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in cur.fetchall()), key=repr)
    assert got == want


def test_job_validation_failure(spark, tmp_path):
    # a "proportion" whose unit values exceed 1 breaks the result contract
    bad = [MetricSpec("not_a_share", "proportion", FormulaSpec("n_events", "COUNT(*)"))]
    res = run_job(spark, 21, _inputs(spark), RG.light_obs(), bad, str(tmp_path / "pre"))
    assert res.status == "failed" and res.error_message.startswith("Validation error")
    assert "proportion_out_of_range" in res.error_message
    assert not (tmp_path / "pre").exists()


def test_job_store_failure(spark, tmp_path):
    blocker = tmp_path / "pre"
    blocker.write_text("a file where the table folder should be")
    res = run_job(spark, 22, _inputs(spark), RG.light_obs(), RG.LIGHT_METRICS, str(blocker))
    assert res.status == "failed" and res.error_message.startswith("Store error")


def test_scenario_registry(spark):
    from splitmill.plans.analysis import SCENARIOS, register_scenario, run_scenario

    register_scenario("first_two_metrics", lambda s, i, o, m: SCENARIOS["base"](s, i, o, m[:2]))
    out = run_scenario("first_two_metrics", spark, _inputs(spark), RG.light_obs(), RG.LIGHT_METRICS)
    assert {r.metric_name for r in out.collect()} == {m.alias for m in RG.LIGHT_METRICS[:2]}
    with pytest.raises(KeyError):
        run_scenario("missing", spark, _inputs(spark), RG.light_obs(), RG.LIGHT_METRICS)


def test_job_report_flow(spark, tmp_path):
    from splitmill.plans.report_flow import job_report

    res = run_job(spark, 31, _inputs(spark), RG.light_obs(), RG.LIGHT_METRICS, str(tmp_path / "pre"))
    assert res.status == "completed"
    rep = job_report(spark, str(tmp_path / "pre"), 31, RG.LIGHT_METRICS, metric_groups=["money"], compared_groups=["treatment1"])
    sizes = {r.group_name: r.observation_cnt for r in rep.group_sizes.collect()}
    assert set(sizes) == {"control", "treatment1", "treatment2"}
    srm = rep.srm.collect()[0]
    assert srm.error is None and srm.df == 2 and srm.observed == [sizes[g] for g in sorted(sizes)]
    rows = rep.significance.collect()
    assert rows and {r.group_name_compared for r in rows} == {"treatment1"}
    assert {r.metric_group for r in rows} == {"money"} and all(isinstance(r.is_significant, bool) for r in rows)


def test_checkpoint_folder_fallback_in_bare_session(tmp_path):
    """Without spark.checkpoint.dir (no spark-defaults), checkpointing queries still run."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "import __spark_entry__ as E\n"
        "print('rows', E.queries()['q_ztest'](spark, %r).count())\n"
    ) % (root, SF_SMALL)
    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path))
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "rows 4" in out.stdout


def test_python_workers_find_the_package_from_any_folder(tmp_path):
    """mapInPandas / pandas UDF workers import splitmill even when the driver runs elsewhere."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('rows', E.queries()['q_topk_similar'](spark, %r).count())\n"
    ) % (root, SF_SMALL)
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "rows 30" in out.stdout
