"""Observation pipeline on hand-made cases (assignment, exposure, windows, audiences, filters)."""

from datetime import datetime as dt

import numpy as np
import pytest

from splitmill.plans.analysis import Inputs, joined_events, run_observation, unit_table
from splitmill.plans.observation import Observation
from splitmill.sources.catalog import FormulaSpec, MetricSpec

EV_SCHEMA = "user_id long, event_id long, event_name string, event_value double, event_timestamp timestamp_ntz"
TI_SCHEMA = "user_id long, experiment_name string, group_name string, record_timestamp timestamp_ntz, record_id long"

CNT = FormulaSpec("n_events", "COUNT(*)")
CNT_EV = FormulaSpec("n_buy", "COUNT(CASE WHEN event_name = 'buy' THEN 1 END)")
REV = FormulaSpec("rev", "SUM(CASE WHEN event_name = 'buy' THEN event_value ELSE 0 END)")
AVGV = FormulaSpec("avg_value", "AVG(event_value)")
METRICS = [
    MetricSpec("buys", "avg", CNT_EV),
    MetricSpec("revenue", "avg", REV),
    MetricSpec("value", "avg", AVGV),
    MetricSpec("rev_per_event", "ratio", REV, CNT),
    MetricSpec("buyer", "proportion", FormulaSpec("buyer", "MAX(CASE WHEN event_name = 'buy' THEN 1 ELSE 0 END)")),
]

D = lambda day, h=0: dt(2024, 1, day, h)


def obs(**kw):
    base = dict(
        name="t", split_id="user_id", experiment_name="exp", exposure_event=None,
        exposure_start=D(1), exposure_end=D(10), calc_start=D(1), calc_end=D(20),
    )
    base.update(kw)
    return Observation(**base)


@pytest.fixture(scope="module")
def data(spark):
    ev = [
        # unit 1: two assignments (A first, B later); events after split
        (1, 1, "view", 0.0, D(2, 1)), (1, 2, "buy", 10.0, D(3)), (1, 3, "buy", 5.0, D(4)),
        # unit 2: one buy before split (ignored), one after
        (2, 4, "buy", 100.0, D(1, 1)), (2, 5, "view", 0.0, D(2, 5)), (2, 6, "buy", 7.0, D(5)),
        # unit 3: first view before split -> dropped when exposure event is 'view'
        (3, 7, "view", 0.0, D(1, 2)), (3, 8, "view", 0.0, D(3)), (3, 9, "buy", 1.0, D(4)),
        # unit 4: assigned, never any event
        # unit 5: events only after the calculation window
        (5, 10, "view", 0.0, D(21)),
        # unit 6: events exactly on both calculation window ends
        (6, 11, "buy", 2.0, D(1)), (6, 12, "buy", 3.0, D(20)),
    ]
    ti = [
        (1, "exp", "A", D(2), 1), (1, "exp", "B", D(3), 2), (1, "other", "Z", D(1), 3),
        (2, "exp", "B", D(2), 4),
        (3, "exp", "A", D(2), 5),
        (4, "exp", "A", D(2), 6),
        (5, "exp", "B", D(2), 7),
        (6, "exp", "A", D(1), 8),
        # unit 7: tie on assignment time; tie broken by record id
        (7, "exp", "B", D(2), 10), (7, "exp", "A", D(2), 9),
    ]
    return spark.createDataFrame(ev, EV_SCHEMA), spark.createDataFrame(ti, TI_SCHEMA)


def units(spark, data, metrics=METRICS, **kw):
    ev, ti = data
    audiences = kw.pop("audiences", [])
    inp = Inputs(events=ev, testids=ti, audiences=audiences, assignment_tie_break=["record_id"], event_tie_break=["event_id"])
    return {r.user_id: r.asDict() for r in unit_table(spark, inp, obs(**kw), metrics).collect()}


def test_first_assignment_and_split_time(spark, data):
    u = units(spark, data)
    assert u[1]["group_name"] == "A"  # later switch to B ignored
    assert u[1]["n_buy"] == 2 and u[1]["rev"] == 15.0
    assert u[2]["n_buy"] == 1 and u[2]["rev"] == 7.0  # buy before split not counted


def test_strict_window_drops_units_without_events(spark, data):
    u = units(spark, data)
    assert 4 not in u and 5 not in u and 7 not in u  # no event after split in the window


def test_window_ends_inclusive(spark, data):
    u = units(spark, data)
    assert u[6]["n_buy"] == 2 and u[6]["rev"] == 5.0


def test_keep_inactive_units(spark, data):
    u = units(spark, data, keep_inactive_units=True)
    assert u[4]["n_buy"] == 0 and u[4]["rev"] == 0 and u[4]["avg_value"] is None
    assert u[7]["group_name"] == "A"  # tie on time: lower record id wins
    assert u[5]["n_buy"] == 0  # its only event is outside the visible window: kept as inactive
    late = units(spark, data, keep_inactive_units=True, calc_start=D(5))
    assert 1 not in late  # visible events after split, none in the calculation window: dropped
    assert late[4]["n_buy"] == 0


def test_exposure_event_rules(spark, data):
    u = units(spark, data, exposure_event="view")
    assert 3 not in u  # first view precedes split -> dropped
    assert 1 in u and 2 in u
    u2 = units(spark, data, exposure_event="view", exposure_rule="first_after_split")
    assert 3 in u2 and u2[3]["n_buy"] == 1


def test_exposure_window_inclusive(spark, data):
    u = units(spark, data, exposure_start=D(2), exposure_end=D(2))
    assert set(u) == {1, 2, 3}  # split on Jan 2 exactly; unit 6 split Jan 1 is outside


def test_filters_are_parenthesised(spark, data):
    # (buy OR value > 1000) AND value < 8: without parentheses the OR would keep every buy
    u = units(spark, data, filters=("event_name = 'buy' OR event_value > 1000", "event_value < 8"))
    assert u[1]["n_buy"] == 1 and u[1]["rev"] == 5.0
    assert u[2]["n_buy"] == 1 and u[6]["n_buy"] == 2


def test_audiences_semi_vs_inner(spark, data):
    aud = spark.createDataFrame([(1,), (1,), (2,)], "user_id long")
    semi = units(spark, data, audiences=[aud])
    assert set(semi) == {1, 2} and semi[1]["n_buy"] == 2
    inner = units(spark, data, audiences=[aud], audience_join="inner")
    assert inner[1]["n_buy"] == 4  # repeated id multiplies rows, as a plain join does


def test_event_row_number(spark, data):
    ev, ti = data
    inp = Inputs(events=ev, testids=ti, assignment_tie_break=["record_id"], event_tie_break=["event_id"])
    o = obs(filters=("event_row_number = 1",))
    rows = joined_events(spark, inp, o, []).where("user_id = 1").orderBy("event_timestamp").collect()
    assert [(r.event_name, r.event_row_number) for r in rows] == [("view", 1), ("buy", 1), ("buy", 2)]
    u = units(spark, data, filters=("event_row_number = 1",))
    assert u[1]["n_buy"] == 1 and u[1]["rev"] == 10.0


def test_precompute_moments_match_numpy(spark, data):
    ev, ti = data
    inp = Inputs(events=ev, testids=ti, assignment_tie_break=["record_id"])
    pre = {(r.group_name, r.metric_name): r for r in run_observation(spark, inp, obs(), METRICS).collect()}
    ut = units(spark, data)
    a = [u for u in ut.values() if u["group_name"] == "A"]
    rev = np.array([u["rev"] for u in a])
    cnt = np.array([u["n_events"] for u in a], dtype=float)
    r = pre[("A", "rev_per_event")]
    assert r.observation_cnt == len(a)
    assert r.metric_value == pytest.approx(rev.sum() / cnt.sum())
    assert r.numerator_avg == pytest.approx(rev.mean()) and r.denominator_avg == pytest.approx(cnt.mean())
    assert r.numerator_var == pytest.approx(rev.var(ddof=1)) and r.denominator_var == pytest.approx(cnt.var(ddof=1))
    assert r.covariance == pytest.approx(np.cov(rev, cnt, ddof=1)[0, 1])
    p = pre[("A", "buyer")]
    assert p.numerator_avg is None and p.numerator_var is None and 0 <= p.metric_value <= 1
    assert pre[("A", "revenue")].numerator_var == pytest.approx(rev.var(ddof=1))


def test_planning_purpose_single_group(spark, data):
    ev, ti = data
    inp = Inputs(events=ev, testids=ti, assignment_tie_break=["record_id"])
    pre = run_observation(spark, inp, obs(purpose="planning"), METRICS).collect()
    assert {r.group_name for r in pre} == {"planning"}


def test_ratio_value_zero_denominator(spark, data):
    m = [MetricSpec("never", "ratio", REV, FormulaSpec("zero", "SUM(0)"))]
    ev, ti = data
    inp = Inputs(events=ev, testids=ti, assignment_tie_break=["record_id"])
    pre = run_observation(spark, inp, obs(), m).collect()
    assert all(r.metric_value == 0.0 for r in pre)


def test_row_number_strategies_agree_on_hot_unit(spark):
    from splitmill.operators.exposure import with_event_row_number

    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):  # one hot unit, ties on timestamps, several event names
        ts = dt(2024, 1, 1) + __import__("datetime").timedelta(minutes=int(rng.integers(0, 3000)))
        rows.append((1 if i < 500 else int(rng.integers(2, 6)), i, ["a", "b"][i % 2], ts))
    df = spark.createDataFrame(rows, "user_id long, event_id long, event_name string, event_timestamp timestamp_ntz")
    w = {r.event_id: r.event_row_number for r in with_event_row_number(df, "user_id", ["event_id"], "window").collect()}
    b = {r.event_id: r.event_row_number for r in with_event_row_number(df, "user_id", ["event_id"], "ranges", 40).collect()}
    assert w == b


def test_date_partition_pruning(spark, tmp_path):
    from splitmill.sources.events import visible_events

    ev = spark.createDataFrame(
        [(1, "buy", 1.0, D(2)), (1, "buy", 2.0, D(5)), (2, "view", 0.0, D(9))],
        "user_id long, event_name string, event_value double, event_timestamp timestamp_ntz",
    ).withColumn("event_date", __import__("pyspark.sql.functions", fromlist=["to_date"]).to_date("event_timestamp"))
    path = str(tmp_path / "ev")
    ev.write.partitionBy("event_date").parquet(path)
    stored = spark.read.parquet(path)
    vis = visible_events(stored, D(4), D(6), date_col="event_date")
    assert [r.event_value for r in vis.collect()] == [2.0] and "event_date" not in vis.columns
    plan = vis._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_string_split_id(spark):
    ev = spark.createDataFrame(
        [("d1", 7, "buy", 3.0, D(3)), ("d1", 7, "buy", 4.0, D(4)), ("d2", 8, "buy", 1.0, D(5)), ("d2", 8, "view", 0.0, D(1))],
        "device_id string, user_id long, event_name string, event_value double, event_timestamp timestamp_ntz",
    )
    ti = spark.createDataFrame(
        [("d1", "exp", "A", D(2)), ("d2", "exp", "B", D(2))],
        "device_id string, experiment_name string, group_name string, record_timestamp timestamp_ntz",
    )
    o = obs(split_id="device_id")
    u = {r.device_id: r for r in unit_table(spark, Inputs(events=ev, testids=ti), o, METRICS).collect()}
    assert u["d1"].rev == 7.0 and u["d2"].n_buy == 1 and u["d2"].group_name == "B"


def test_display_names_with_quotes(spark, data):
    ev, ti = data
    odd = "Buyer's share \\ (it's \"quoted\")"
    m = [MetricSpec("buyer_share", "proportion", FormulaSpec("buyer", "MAX(CASE WHEN event_name = 'buy' THEN 1 ELSE 0 END)"), display_name=odd)]
    pre = run_observation(spark, Inputs(events=ev, testids=ti, assignment_tie_break=["record_id"]), obs(), m).collect()
    assert {r.metric_display_name for r in pre} == {odd}


def test_observation_metric_selection(spark):
    from splitmill.plans import registry as RG

    d = "/root/testdata/sf0.001"
    pre = RG.light_precompute(spark, d, metric_tags=("ux",))
    want = {m.alias for m in RG.LIGHT_METRICS if m.tags and "ux" in m.tags}
    assert {r.metric_name for r in pre.select("metric_name").distinct().collect()} == want
    pre2 = RG.light_precompute(spark, d, metric_groups=("quality",))
    assert {r.metric_name for r in pre2.select("metric_name").distinct().collect()} == {"error_share"}


def test_row_numbers_of_nameless_events(spark):
    from splitmill.operators.exposure import with_event_row_number

    at = [dt(2024, 1, d) for d in (1, 8, 20)]
    rows = spark.createDataFrame([(1, None, t) for t in at], "user_id long, event_name string, event_timestamp timestamp_ntz")
    for strategy in ("ranges", "window"):
        got = with_event_row_number(rows, "user_id", strategy=strategy).orderBy("event_timestamp").collect()
        assert [r.event_row_number for r in got] == [1, 2, 3]


def test_a_hot_unit_is_split_before_the_unit_aggregate(spark):
    from pyspark.sql import functions as F

    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        events = spark.range(0, 200_000, 1, 8).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 1000).alias("user_id"), F.rand(1).alias("v"))
        units = spark.range(1000).select(F.col("id").alias("user_id"), F.lit("a").alias("group_name"))
        out = events.join(units, "user_id").groupBy("user_id", "group_name").agg(F.sum("v"))
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_hour_is_numbered_by_several_tasks(spark):
    from pyspark.sql import functions as F

    from splitmill.operators.exposure import hot_events, hot_ranges, with_event_row_number

    # a third of all rows: one unit, one name, one hour
    hot = F.col("id") % 3 == 0
    rows = spark.range(0, 30_000, 1, 6).select(
        F.when(hot, 7).otherwise(F.col("id") % 900).alias("user_id"), F.when(hot, F.lit("a")).otherwise(F.lit("b")).alias("event_name"), F.col("id").alias("event_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, pmod(xxhash64(id), 3600000) / 1000)").alias("event_timestamp"),
    )
    events = rows.select("user_id", "event_name", "event_timestamp")
    (cuts,) = hot_ranges(events, "user_id", 1000).collect()
    assert (cuts.user_id, cuts.event_name) == (7, "a") and 8 <= len(cuts.cuts) <= 12
    table = hot_ranges(events, "user_id", 1000)
    out = with_event_row_number(rows, "user_id", ["event_id"], "ranges", 1000, table, hot_events(events, table, "user_id"))
    want = with_event_row_number(rows, "user_id", ["event_id"], "window")
    assert out.select("event_id", "event_row_number").exceptAll(want.select("event_id", "event_row_number")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(__key" in plan  # numbered by key and range
    sizes = rows.join(F.broadcast(spark.createDataFrame([(cuts.cuts,)], "cuts array<long>"))).where(hot_key := F.expr("user_id = 7 and event_name = 'a'"))
    per = sizes.groupBy(F.size(F.filter("cuts", lambda x: x < F.unix_micros(F.col("event_timestamp").cast("timestamp")))).alias("r")).count().collect()
    assert max(r["count"] for r in per) < 2000 and hot_key is not None


def test_units_without_events_join_the_events_once(spark, data):
    ev, ti = data
    inp = Inputs(events=ev, testids=ti, assignment_tie_break=["record_id"])
    from splitmill.plans.analysis import joined_events

    rows = joined_events(spark, inp, obs(exposure_event=None, keep_inactive_units=True))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join Inner" in line and "event_timestamp" in line for line in plan.split("\n")) == 1
    seen = {(r.user_id, r.event_timestamp is None) for r in rows.collect()}
    assert {u for u, none in seen if none} and not {u for u, none in seen if none} & {u for u, none in seen if not none}


def test_events_of_other_units_are_dropped_before_the_exchange(spark, tmp_path):
    from pyspark.sql import functions as F

    from splitmill.operators.exposure import attach_events
    from splitmill.plans.analysis import assigned_units, reduced_events
    from splitmill.session import cluster_conf

    spark.range(200_000).select((F.col("id") % 50_000).alias("user_id"), F.lit("a").alias("event_name"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("event_timestamp")).write.parquet(f"{tmp_path}/events")
    spark.range(20_000).select(F.col("id").alias("user_id"), F.when(F.col("id") % 10 == 0, "mine").otherwise("other").alias("experiment_name"), F.lit("g").alias("group_name"), F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz").alias("record_timestamp")).write.parquet(f"{tmp_path}/testids")
    conf = {k: v for k, v in cluster_conf(1e12, 100).items() if "bloomFilter" in k or "runtime" in k} | {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        events, testids = spark.read.parquet(f"{tmp_path}/events"), spark.read.parquet(f"{tmp_path}/testids")
        o, inp = obs(experiment_name="mine"), Inputs(events=events, testids=testids)
        out = attach_events(assigned_units(spark, inp, o), reduced_events(inp, o, events), "user_id")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "might_contain" in plan
        above = plan[: plan.index("might_contain")]
        assert above.rindex("Exchange hashpartitioning(user_id") > above.rindex("SortMergeJoin")  # the filter is below the events' exchange
        assert plan[plan.index("might_contain") :].index("FileScan") and plan.count("event_name") and plan.count("Exchange hashpartitioning(user_id") == 3  # events, ids, units
        assert out.count() == 200_000 // 50_000 * 2_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_record_without_a_time_is_not_the_first(spark):
    from splitmill.sources.assignment import first_per_unit

    log = spark.createDataFrame([(1, None, "control"), (1, dt(2024, 1, 1), "treatment"), (2, None, "control")], "user_id long, record_timestamp timestamp_ntz, group_name string")
    got = {r.user_id: (r.first_split_timestamp, r.group_name) for r in first_per_unit(log, "user_id").collect()}
    assert got == {1: (dt(2024, 1, 1), "treatment"), 2: (None, "control")}


def test_missing_folder_owner_and_empty_lists(spark, tmp_path):
    from splitmill.sources.catalog import CatalogError, catalog_frame, distinct_labels, filter_metrics, load_catalog, select_metrics
    from splitmill.sources.corpus import metric_documents

    with pytest.raises(CatalogError):
        load_catalog(tmp_path / "nowhere")
    m = [MetricSpec("one", "avg", FormulaSpec("a", "SUM(1)"), owner="Ann", group_name="g", tags=("x", "y", "x")), MetricSpec("two", "avg", FormulaSpec("b", "SUM(2)"), group_name="g", tags=("y",))]
    doc = metric_documents(catalog_frame(spark, m)).where("doc_id = 'one'").first()
    assert "Owner: Ann" in doc.document and doc.metadata["owner"] == "Ann"
    assert filter_metrics(m, types=[], tags=[], group_names=[]) == m == select_metrics(m, [])
    assert [x.alias for x in filter_metrics(m, tags=["x"], group_names=[])] == ["one"]
    assert [tuple(r) for r in distinct_labels(catalog_frame(spark, m)).collect()] == [("group", "g", 2), ("tag", "x", 1), ("tag", "y", 2)]
