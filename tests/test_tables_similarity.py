"""Entity tables (filter DSL, versions, deletes), reporting, similarity, jobs and sinks."""

import math
from datetime import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitmill.operators import entities as E
from splitmill.operators import report as R
from splitmill.operators import significance as S
from splitmill.operators import similarity as SIM
from splitmill.operators.precompute import PRECOMPUTE_SCHEMA

EXP_SCHEMA = "id long, name string, status string, key_metrics array<string>, _created_at timestamp_ntz, _updated_at timestamp_ntz"


@pytest.fixture(scope="module")
def experiments(spark):
    rows = [
        (1, "Checkout button", "running", ["ctr", "revenue"], dt(2024, 1, 1), dt(2024, 1, 1)),
        (2, "New onboarding", "completed", ["conversion"], dt(2024, 1, 5), dt(2024, 1, 5)),
        (3, "checkout copy", "planned", None, dt(2024, 2, 1), dt(2024, 2, 1)),
        (4, "Pricing", "completed", ["revenue_per_user"], dt(2024, 2, 10), dt(2024, 2, 10)),
    ]
    return spark.createDataFrame(rows, EXP_SCHEMA)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_filter_dsl(experiments):
    assert ids(E.select_where(experiments, {"status": "completed"})) == [2, 4]
    assert ids(E.select_where(experiments, {"name__ilike": "%checkout%"})) == [1, 3]
    assert ids(E.select_where(experiments, {"status__in": ["planned", "running"]})) == [1, 3]
    assert ids(E.select_where(experiments, {"_created_at__gte": dt(2024, 1, 5), "_created_at__lt": dt(2024, 2, 10)})) == [2, 3]
    assert ids(E.select_where(experiments, {"key_metrics__contains": "revenue"})) == [1]  # element match, not substring
    assert ids(E.select_where(experiments, {"key_metrics__contains__or": ["ctr", "conversion"]})) == [1, 2]
    assert ids(E.select_where(experiments, {"name__contains": "Pric"})) == [4]
    assert ids(E.select_where(experiments, {"status__eq__or": []})) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        E.select_where(experiments, {"nope": 1})


def test_sort_limit_columns(experiments):
    out = E.select_where(experiments, {"id__gt": 1}, ["id", "name"], sort_by="_created_at", sort_order="desc", limit=2).collect()
    assert [r.id for r in out] == [4, 3] and out[0].asDict().keys() == {"id", "name"}
    asc = E.select_where(experiments, None, ["id"], sort_by="id", sort_order="up", limit=0).collect()
    assert [r.id for r in asc] == [1, 2, 3, 4]


def test_updates_and_latest(spark, experiments):
    upd = spark.createDataFrame(
        [(2, "archived", dt(2024, 3, 1), "x"), (2, "reopened", dt(2024, 3, 2), "y"), (99, "ghost", dt(2024, 3, 1), "z")],
        "id long, status string, _updated_at timestamp_ntz, unknown string",
    )
    cur = {r.id: r for r in E.apply_updates(experiments, upd, "id").collect()}
    assert set(cur) == {1, 2, 3, 4}  # unknown id 99 not created
    assert cur[2].status == "reopened" and cur[2]._updated_at == dt(2024, 3, 2) and cur[2].name == "New onboarding"
    assert cur[1].status == "running"
    assert "unknown" not in cur[1].asDict()


def test_partial_and_stale_updates(spark):
    cur = spark.createDataFrame(
        [(1, "n0", "s0", dt(2024, 1, 5)), (2, "n0", "s0", dt(2024, 1, 5)), (3, "n0", "s0", None)], "id long, name string, status string, _updated_at timestamp_ntz"
    )
    upd = spark.createDataFrame(
        [
            (1, "n1", None, dt(2024, 1, 6), None), (1, None, "s1", dt(2024, 1, 7), None),  # two halves
            (2, "old", "old", dt(2024, 1, 4), None),  # older than the row
            (3, "n1", "s1", dt(2023, 1, 1), None), (3, None, None, dt(2023, 1, 2), ["status"]),  # a NULL that is set
        ],
        "id long, name string, status string, _updated_at timestamp_ntz, given array<string>",
    )
    got = {r.id: (r.name, r.status, r._updated_at) for r in E.apply_updates(cur, upd, "id", set_fields="given").collect()}
    assert got == {1: ("n1", "s1", dt(2024, 1, 7)), 2: ("n0", "s0", dt(2024, 1, 5)), 3: ("n1", None, dt(2023, 1, 2))}


def test_delete_and_cascade(spark):
    exp = spark.createDataFrame([(1,), (2,)], "id long")
    obs = spark.createDataFrame([(10, 1), (11, 2), (12, 2)], "id long, experiment_id long")
    job = spark.createDataFrame([(100, 10), (101, 11), (102, 12), (103, 12)], "id long, observation_id long")
    pre = spark.createDataFrame([(1000, 100), (1001, 102), (1002, 103)], "id long, job_id long")
    tomb = spark.createDataFrame([(2,)], "id long")
    assert ids(E.delete_keys(exp, tomb, "id")) == [1]
    e, o, j, p = E.cascade_delete([(exp, "id", None), (obs, "id", "experiment_id"), (job, "id", "observation_id"), (pre, "id", "job_id")], tomb, "id")
    assert ids(e) == [1] and ids(o) == [10] and ids(j) == [100] and ids(p) == [1000]


def test_latest_per_key_and_copy(spark, experiments):
    jobs = spark.createDataFrame([(1, 10, "completed"), (2, 10, "failed"), (3, 11, "completed")], "id long, observation_id long, status string")
    done = E.select_where(jobs, {"status": "completed"})
    latest = {r.observation_id: r.id for r in E.latest_per_key(done, "observation_id", "id").collect()}
    assert latest == {10: 1, 11: 3}
    copy = E.copy_row(experiments, "id", 1, 5, {"name": "Checkout button v2"}).collect()[0]
    assert copy.id == 5 and copy.name == "Checkout button v2" and copy.status == "running"


def _pre(spark):
    rows = [
        ("control", "rev", "Revenue", "avg", 100, 10.0, None, 4.0, None, None, None),
        ("t1", "rev", "Revenue", "avg", 100, 11.0, None, 4.0, None, None, None),
        ("t2", "rev", "Revenue", "avg", 100, 10.1, None, 4.0, None, None, None),
        ("control", "conv", None, "proportion", 100, 0.2, None, None, None, None, None),
        ("t1", "conv", None, "proportion", 100, 0.3, None, None, None, None, None),
        ("t2", "conv", None, "proportion", 100, 0.2, None, None, None, None, None),
        ("control", "only_ctl", "Only", "avg", 100, 1.0, None, 1.0, None, None, None),
        ("t1", "only_t1", "Only t1", "avg", 100, 1.0, None, 1.0, None, None, None),
        ("control", "bad", "Bad", "proportion", 100, 1.5, None, None, None, None, None),
        ("t1", "bad", "Bad", "proportion", 100, 0.5, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, PRECOMPUTE_SCHEMA)


def test_significance_table_rules(spark):
    sig = {(r.metric_name, r.group_name_compared): r for r in S.significance_table(_pre(spark)).collect()}
    assert ("only_t1", "t1") not in sig  # metric missing in control drops out
    assert sig[("only_ctl", None)].p_value is None  # metric only in control: NULL compared
    assert sig[("conv", "t1")].metric_display_name is None and sig[("conv", "t1")].p_value < 0.2
    assert sig[("bad", "t1")].input_errors == ["proportion_out_of_range"] and sig[("bad", "t1")].p_value is None
    assert sig[("rev", "t1")].group_name_control == "control"
    with pytest.raises(Exception):
        S.significance_table(_pre(spark), strict=True).collect()


def test_control_choice(spark):
    pre = _pre(spark).where(F.col("group_name") != "control")
    assert S.control_groups(pre).collect()[0].control_group == "t1"  # none contains "control": first by name
    assert S.control_groups(_pre(spark), "t2").collect()[0].control_group == "t2"


def test_pivot_and_report(spark):
    sig = S.significance_table(_pre(spark))
    piv = S.significance_pivot(sig, ["t2", "t1"], ["p_value", "diff_abs"])
    assert piv.columns == ["t2__p_value", "t2__diff_abs", "t1__p_value", "t1__diff_abs", "metric_name", "metric_type", "metric_display_name"]
    from splitmill.plans.testdata_metrics import LIGHT_METRICS
    from splitmill.sources.catalog import catalog_frame

    pres = R.present(sig, catalog_frame(spark, LIGHT_METRICS), threshold=0.05).collect()
    assert {r.metric_group for r in pres} == {"Other"}
    assert all(r.metric_display_name is not None for r in pres)
    nan = spark.createDataFrame([(float("nan"),), (0.01,), (None,)], "p double")
    assert [r.f for r in nan.select(S.significance_flag(F.col("p")).alias("f")).collect()] == [False, True, False]
    js = R.json_lines(spark.createDataFrame([(float("inf"), dt(2024, 1, 2, 3, 4, 5))], "x double, t timestamp_ntz")).collect()[0].json
    assert js == '{"x":null,"t":"2024-01-02T03:04:05.000000"}'
    rd = R.rounded(spark.createDataFrame([(1.234567891,)], "x double")).collect()[0].x
    assert rd == 1.23457


def test_topk_matches_brute_force(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rng = np.random.default_rng(3)
    q = rng.normal(size=(7, 64))
    queries = spark.createDataFrame([(i, [float(x) for x in q[i]]) for i in range(7)], "query_id long, embedding array<double>")
    got = SIM.topk_similar(spark, emb, queries, k=4).collect()
    chunked = SIM.topk_similar(spark, emb, queries, k=4, block_bytes=3 * 8 * 64).collect()
    pdf = emb.toPandas()
    mat = np.stack(pdf["embedding"].to_numpy()).astype(float)
    ids_ = pdf["vec_id"].to_numpy()
    want = {}
    for i in range(7):
        d = np.sqrt(((mat - q[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids_, d))[:4]
        want[i] = [int(ids_[j]) for j in order]
    for res in (got, chunked):
        by_q = {}
        for r in sorted(res, key=lambda r: (r.query_id, r.rank)):
            by_q.setdefault(r.query_id, []).append(r.doc_id)
        assert by_q == want
    cos = SIM.topk_similar(spark, emb, queries, k=2, metric="cosine").collect()
    assert all(0 <= r.distance <= 2 for r in cos)


def test_dedupe_across_queries(spark):
    hits = spark.createDataFrame([(1, 1, 7, 0.1), (1, 2, 8, 0.2), (2, 1, 7, 0.05), (2, 2, 9, 0.3)], "query_id long, rank int, doc_id long, distance double")
    out = sorted((r.query_id, r.doc_id) for r in SIM.dedupe_across_queries(hits).collect())
    assert out == [(1, 7), (1, 8), (2, 9)]


def test_label_centroids(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    cents = {r.query_id: r.embedding for r in SIM.label_centroids(emb).collect()}
    pdf = emb.toPandas()
    lab = int(pdf["label"].iloc[0])
    want = np.stack(pdf[pdf["label"] == lab]["embedding"].to_numpy()).astype(float).mean(axis=0)
    assert np.allclose(cents[lab], want, rtol=1e-12)


def test_nearest_of_a_pair_of_blocks():
    rng = np.random.default_rng(0)
    for n in range(300):
        metric = SIM.METRICS[n % 2]
        q = rng.integers(-2, 3, size=(rng.integers(1, 6), 3)).astype(float)  # many ties
        d = rng.integers(-2, 3, size=(rng.integers(1, 40), 3)).astype(float)
        order, k = rng.permutation(len(d)), int(rng.integers(1, 6))
        rows, cols, far = SIM.nearest(q, d, order, k, metric)
        for i in range(len(q)):
            if metric == "l2":
                dist = np.sqrt(((d - q[i]) ** 2).sum(axis=1))
            else:
                with np.errstate(invalid="ignore"):
                    dist = 1 - d @ q[i] / (np.linalg.norm(d, axis=1) * np.linalg.norm(q[i]))
            mine = far[rows == i]
            assert np.allclose(mine, np.sort(dist)[: min(k, len(d))], atol=1e-12, equal_nan=True)
            if metric == "l2":
                assert cols[rows == i].tolist() == np.lexsort((order, dist))[:k].tolist()


def test_topk_of_close_vectors_odd_rows_and_text_ids(spark):
    corpus = [("a", [1e6 + 0.01, 0.0]), ("b", [1e6 + 0.001, 0.0]), ("c", [1e6 + 0.1, 0.0]), ("d", None), ("e", [1.0, None]), ("f", [float("nan"), 0.0]), ("g", []), ("h", [1.0, 2.0, 3.0]), ("i", [1e150, -1e150]), (None, [5.0, 5.0]), ("b", [1e6 + 0.001, 0.0])]
    docs = spark.createDataFrame(corpus, "name string, v array<double>").repartition(4)
    queries = spark.createDataFrame([("x", [1e6, 0.0]), ("y", None), ("z", [1.0, 2.0, 3.0]), ("w", [1.0])], "who string, v array<double>")
    for block_bytes in (16, 1 << 20):
        got = SIM.topk_similar(spark, docs, queries, k=4, doc_id="name", query_id="who", vec="v", block_bytes=block_bytes).collect()
        near = sorted((r.rank, r.doc_id, r.distance) for r in got if r.query_id == "x")
        assert [n[1] for n in near] == ["b", "b", "a", "c"]
        assert np.allclose([n[2] for n in near], [0.001, 0.001, 0.01, 0.1], rtol=1e-6)
        assert [(r.query_id, r.doc_id, r.distance) for r in got if r.query_id != "x"] == [("z", "h", 0.0)]
    far = SIM.topk_similar(spark, docs, queries, k=50, doc_id="name", query_id="who", vec="v").where("query_id = 'x'").orderBy("rank").collect()
    assert [r.doc_id for r in far] == ["b", "b", "a", "c", None, "i"] and np.isclose(far[-1].distance, np.sqrt(2) * 1e150)
    cos = SIM.topk_similar(spark, docs, spark.createDataFrame([(1, [1.0, 0.0])], "q int, v array<double>"), k=6, doc_id="name", query_id="q", vec="v", metric="cosine").orderBy("rank").collect()
    assert [r.doc_id for r in cos] == ["a", "b", "b", "c", None, "i"]  # ties by id
    assert SIM.topk_similar(spark, docs.where("false"), queries, doc_id="name", query_id="who", vec="v").count() == 0
    assert SIM.topk_similar(spark, docs, queries.where("false"), doc_id="name", query_id="who", vec="v").count() == 0


def test_topk_plan_keeps_k_rows_of_a_task_before_the_shuffle(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = SIM.topk_similar(spark, emb, emb.where("vec_id % 100 = 0"), query_id="vec_id")._jdf.queryExecution().executedPlan().toString()
    partial, final = plan.index("WindowGroupLimit"), plan.rindex("WindowGroupLimit")
    assert partial < plan.index("Exchange hashpartitioning(query_id") < final
    assert "SinglePartition" not in plan
