"""Small helpers: text/date/JSON functions, list filters, single-row create, formula table."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from splitmill.functions import text as TX
from splitmill.operators import entities as E
from splitmill.operators import significance as S
from splitmill.sources import catalog as C
from splitmill.sources import sinks

from .test_tables_similarity import EXP_SCHEMA, experiments  # noqa: F401


def test_text_helpers(spark):
    df = spark.createDataFrame([("x" * 2500, " a = 1 \n\n \tb IN (2)\t\r\n\t\n ", '["a","b"]', '{"k":"v"}', dt(2024, 1, 3, 5), dt(2024, 1, 10))],
                               "t string, f string, jl string, jm string, s timestamp, e timestamp")
    r = df.select(
        F.length(TX.truncate(F.col("t"))).alias("n"), TX.split_lines(F.col("f")).alias("lines"),
        TX.json_list(F.col("jl")).alias("jl"), TX.json_map(F.col("jm")).alias("jm"),
        TX.days_between(F.col("s"), F.col("e")).alias("days"), TX.utc_midnight(F.col("s")).alias("mid"),
    ).collect()[0]
    assert r.n == 2000 + len(TX.TRUNCATION_MARK)
    assert r.lines == ["a = 1", "b IN (2)"]
    assert r.jl == ["a", "b"] and r.jm == {"k": "v"} and r.days == 7 and r.mid == dt(2024, 1, 3)


def test_list_filter_and_rows(spark, experiments):  # noqa: F811
    out = E.list_filter(experiments, created_from=dt(2024, 1, 1), created_to=dt(2024, 2, 10), statuses=["running", "planned"], name_like="check")
    assert [r.id for r in out.collect()] == [3, 1]
    assert E.list_filter(experiments, limit=1).collect()[0].id == 4
    added = E.append_row(experiments, spark, {"id": 9, "name": "New", "status": "planned"})
    assert added.count() == 5 and added.where("id = 9").collect()[0].key_metrics is None
    assert E.sample_rows(experiments, 2).count() == 2


def test_known_key_metrics(spark, experiments):  # noqa: F811
    cat = spark.createDataFrame([("revenue",), ("conversion",)], "metric_name string")
    got = {r.id: r.key_metrics_known for r in E.known_key_metrics(experiments, cat).collect()}
    assert got == {1: ["revenue"], 2: ["conversion"], 3: [], 4: []}


def test_validate_input(spark):
    bad = spark.createDataFrame([("g", "m")], "group_name string, metric_name string")
    with pytest.raises(ValueError, match="missing required columns"):
        S.validate_input(bad)


def test_formula_table(spark):
    from splitmill.plans.testdata_metrics import LIGHT_METRICS

    ft = {r.alias: r.sql for r in C.formula_table(C.catalog_frame(spark, LIGHT_METRICS)).collect()}
    want = {f.alias: f.sql for f in C.required_formulas(LIGHT_METRICS)}
    assert ft == want


def test_guarded_sql(spark):
    spark.range(3).createOrReplaceTempView("sm_numbers")
    assert sinks.guarded_sql(spark, "SELECT COUNT(*) AS N FROM sm_numbers").columns == ["n"]
    with pytest.raises(ValueError):
        sinks.guarded_sql(spark, "DROP VIEW sm_numbers")


def test_read_files_and_index_filter(spark, tmp_path):
    from splitmill.sources import corpus

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.md").write_text("# Title\nline two\n")
    (tmp_path / "src" / "b.py").write_text("print(1)\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "c.md").write_text("skip me")
    (tmp_path / "d.txt").write_text("not indexed by extension")
    files = corpus.read_files(spark, str(tmp_path), [".md", ".py"])
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in corpus.indexable(files).collect()}
    assert got == {"a.md": "# Title\nline two\n", "b.py": "print(1)\n"}
    long = spark.createDataFrame([("x/y.md", "a" * 100_001), ("x/z.md", "ok")], "path string, text string")
    assert [r.path for r in corpus.indexable(long, max_chars=100_000).collect()] == ["x/z.md"]
    assert corpus.indexable(long).count() == 2


def test_report_splits(spark):
    from splitmill.operators import report as R

    t = spark.createDataFrame(
        [("m1", "t1", "money"), ("m1", "t2", "money"), ("m2", "t1", "ux")], "metric_name string, group_name_compared string, metric_group string"
    )
    assert R.per_compared_group(t, "t1").count() == 2
    assert [r.metric_name for r in R.per_metric_group(t, "ux").collect()] == ["m2"]


def test_cluster_conf_sizing():
    from splitmill.session import cluster_conf

    big = cluster_conf(100 * 2**40, executors=1000, cores_per_executor=4)
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 2**40 // (256 * 2**20)  # ~ input / 256 MB
    assert big["spark.sql.adaptive.enabled"] == "true" and big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert big["spark.sql.autoBroadcastJoinThreshold"] == "-1"  # only run-time (measured) broadcasts
    small = cluster_conf(10 * 2**20, executors=10)
    assert int(small["spark.sql.shuffle.partitions"]) == 200  # floor of at least 3 waves / 200


def test_get_by_id(experiments):  # noqa: F811
    assert [r.name for r in E.get_by_id(experiments, "id", 2).collect()] == ["New onboarding"]
    assert E.get_by_id(experiments, "id", 99).count() == 0
