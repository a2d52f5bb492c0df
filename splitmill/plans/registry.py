"""Registered queries over the driver's test tables, and their DuckDB twins.

Every query reads the given parquet tables (or DataFrames Spark derives from
them) in full; no id subsets, prefixes or row caps.  Outputs print doubles to a
fixed precision (``report.significant_digits`` / ``report.fixed_decimals``) so
two engines agree bit for bit after last-digit summation differences."""

from __future__ import annotations

import uuid
from dataclasses import replace
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities as E
from ..operators import exposure as X
from ..operators import power as PW
from ..operators import quality as Q
from ..operators import report as R
from ..operators import significance as S
from ..operators import similarity as SIM
from ..operators import srm as SRM
from ..operators.precompute import group_sizes, precompute
from ..operators.stats import delta_ratio_variance
from ..sources import assignment as A
from ..sources import corpus as C
from ..sources import testdata as TD
from ..sources.catalog import catalog_frame, distinct_labels
from ..sources.events import bounded, ts_lit, union_sources
from . import oracle_sql as O
from .analysis import Inputs, joined_events, run_observation, unit_table
from .observation import Observation
from ..session import ensure_checkpoint_dir, materialize
from ..sources import sinks
from ..sources import state as ST
from .testdata_metrics import HEAVY_METRICS, LIGHT_METRICS

MOMENT_COLS = ["metric_value", "numerator_avg", "numerator_var", "denominator_avg", "denominator_var", "covariance"]
TEST_SIG_COLS = ["ci_lower", "ci_upper", "diff_abs", "diff_ratio"]
TEST_DEC_COLS = ["statistic", "p_value"]
LW = TD.LIGHT_WINDOWS
HW = TD.HEAVY_WINDOWS

# all metrics, also one whose unit values have no variance on the test data (statistic NaN)
SIG_METRICS_LIGHT = LIGHT_METRICS

# ----------------------------------------------------------------- settings


def light_obs(**kw) -> Observation:
    base = dict(name="light", split_id="user_id", experiment_name="exp_signup", exposure_event="view", **LW)
    base.update(kw)
    return Observation(**base)


def heavy_obs(**kw) -> Observation:
    base = dict(name="heavy", split_id="custkey", experiment_name="priority_test", exposure_event="R", **HW)
    base.update(kw)
    return Observation(**base)


def light_inputs(spark, d, **kw) -> Inputs:
    return Inputs(
        events=TD.light_events(spark, d), testids=TD.light_testids(spark, d),
        assignment_tie_break=["record_id"], assignment_attributes=["segment_k"], event_tie_break=["event_id"], **kw,
    )


def heavy_inputs(spark, d, **kw) -> Inputs:
    return Inputs(
        events=TD.heavy_events(spark, d), testids=TD.heavy_testids(spark, d),
        assignment_tie_break=["o_orderkey"], assignment_attributes=["c_mktsegment"],
        event_tie_break=["l_orderkey", "l_linenumber"], **kw,
    )


def light_psql(**kw) -> O.PipelineSQL:
    base = dict(
        events=O.LIGHT_EVENTS, testids=O.LIGHT_TESTIDS, split_id="user_id",
        event_cols=["event_id", "event_name", "event_value", "event_timestamp", "k"], unit_cols=["segment_k"],
        assignment_order=["record_id", "group_name", "segment_k"], experiment_name="exp_signup", exposure_event="view",
        row_number_order=["event_id"], **LW,
    )
    base.update(kw)
    return O.PipelineSQL(**base)


def heavy_psql(**kw) -> O.PipelineSQL:
    base = dict(
        events=O.HEAVY_EVENTS, testids=O.HEAVY_TESTIDS, split_id="custkey",
        event_cols=["l_orderkey", "l_linenumber", "event_name", "event_value", "event_timestamp", "l_quantity", "l_linestatus"],
        unit_cols=["c_mktsegment"], assignment_order=["o_orderkey", "group_name", "c_mktsegment"],
        experiment_name="priority_test", exposure_event="R", row_number_order=["l_orderkey", "l_linenumber"], **HW,
    )
    base.update(kw)
    return O.PipelineSQL(**base)


def _pc_out(df: DataFrame) -> DataFrame:
    return R.significant_digits(df, 10, MOMENT_COLS)


def _sig_out(df: DataFrame) -> DataFrame:
    out = df.select("metric_name", "metric_type", "group_name_control", "group_name_compared", *TEST_DEC_COLS, *TEST_SIG_COLS)
    return R.comparable(out, {c: 8 for c in TEST_SIG_COLS}, {c: 6 for c in TEST_DEC_COLS})


def light_precompute(spark, d, metrics=None, **obs_kw) -> DataFrame:
    return run_observation(spark, light_inputs(spark, d), light_obs(**obs_kw), metrics or LIGHT_METRICS)


def heavy_precompute(spark, d) -> DataFrame:
    return run_observation(spark, heavy_inputs(spark, d), heavy_obs(), HEAVY_METRICS)


def light_significance(spark, d) -> DataFrame:
    return S.significance_table(materialize(light_precompute(spark, d, SIG_METRICS_LIGHT)))


def _unit_out(df: DataFrame) -> DataFrame:
    return R.significant_digits(df, 10)


# audiences derived from the events table (ids repeat on purpose)
def audience_big_buyers(spark, d) -> DataFrame:
    return TD.table(spark, d, "events").where((F.col("event_type") == "purchase") & (F.col("value") > 150)).select("user_id")


def audience_high_k(spark, d) -> DataFrame:
    return TD.table(spark, d, "events").where(F.get_json_object("props", "$.k").cast("int") > 90).select("user_id")


AUD_BIG_BUYERS_SQL = "SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150"
AUD_HIGH_K_SQL = "SELECT user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 90"

# ----------------------------------------------------------------- queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# S-1..S-3, U-1
_SRC_SQL = " UNION ALL ".join(
    f"SELECT * FROM ({O.LIGHT_EVENTS}) WHERE event_timestamp BETWEEN {O.ts(LW['exposure_start'])} AND {O.ts(LW['calc_end'])} AND event_name IN ({names})"
    for names in ("'view', 'click'", "'error'", "'signup', 'purchase'")
)


@register("q_events_union", _SRC_SQL)
def q_events_union(spark, d):
    srcs = [bounded(s, LW["exposure_start"], LW["calc_end"]) for s in TD.light_event_sources(spark, d)]
    return union_sources(*srcs)


# S-4, W-1
@register("q_assignment_first", f"SELECT * FROM ({light_psql().ctes()['t']})")
def q_assignment_first(spark, d):
    return A.experiment_assignment(TD.light_testids(spark, d), "user_id", "exp_signup", ["record_id"], ["segment_k"])


# S-5, W-2
@register("q_assignment_planning", f"SELECT * FROM ({light_psql(planning=True).ctes()['t']})")
def q_assignment_planning(spark, d):
    return A.planning_assignment(TD.light_testids(spark, d), "user_id", LW["exposure_start"], LW["calc_end"], ["record_id"], ["segment_k"])


# W-1 on a log with several rows per unit (orders)
@register("q_assignment_heavy", f"SELECT * FROM ({heavy_psql().ctes()['t']})")
def q_assignment_heavy(spark, d):
    return A.experiment_assignment(TD.heavy_testids(spark, d), "custkey", "priority_test", ["o_orderkey"], ["c_mktsegment"])


# W-3, A-24
_p = light_psql()
@register("q_exposure_first", _p.with_clause() + " SELECT * FROM exposure")
def q_exposure_first(spark, d):
    ev = bounded(TD.light_events(spark, d), LW["exposure_start"], LW["calc_end"])
    return X.first_exposure(ev, "user_id", "view")


# units of the log that no event has: each unit again under a negative id
_NO_EVENTS_SQL = f"SELECT * FROM ({O.LIGHT_TESTIDS}) UNION ALL SELECT * REPLACE (-1 - user_id AS user_id) FROM ({O.LIGHT_TESTIDS})"


def _with_units_without_events(inputs: Inputs) -> Inputs:
    inputs.testids = inputs.testids.unionByName(inputs.testids.withColumn("user_id", -1 - F.col("user_id")))
    return inputs


# J-1, J-2, P-2, F-2: events x assignment (LEFT JOIN semantics: units without events keep one NULL row)
@register(
    "q_events_x_assignment",
    light_psql(testids=_NO_EVENTS_SQL, exposure_event=None).with_clause()
    + f" SELECT * EXCLUDE (event_row_number) FROM j WHERE exposure_timestamp BETWEEN {O.ts(LW['exposure_start'])} AND {O.ts(LW['exposure_end'])}",
)
def q_events_x_assignment(spark, d):
    return joined_events(spark, _with_units_without_events(light_inputs(spark, d)), light_obs(keep_inactive_units=True, exposure_event=None))


# W-4
@register(
    "q_event_row_number",
    _p.with_clause()
    + " SELECT user_id, group_name, event_id, event_name, event_timestamp, CAST(event_row_number AS INTEGER) AS event_row_number FROM j "
    + f"WHERE event_timestamp IS NOT NULL AND exposure_timestamp BETWEEN {O.ts(LW['exposure_start'])} AND {O.ts(LW['exposure_end'])}",
)
def q_event_row_number(spark, d):
    obs = light_obs(filters=("event_row_number >= 1",))
    rows = joined_events(spark, light_inputs(spark, d), obs, [])
    return rows.select("user_id", "group_name", "event_id", "event_name", "event_timestamp", "event_row_number")


def _ua_sql(p: O.PipelineSQL, metrics) -> str:
    return p.with_clause({"ua": p.unit_agg(metrics)}) + " SELECT * FROM ua"


# DuckDB's COUNT_IF is HUGEINT, and NULL if all conditions are; Spark's is BIGINT and counts 0
LIGHT_HUGEINT_FORMULAS = ["big_purchases_cnt"]


def _ua_sql_rounded(p: O.PipelineSQL, metrics, double_cols) -> str:
    inner = _ua_sql(p, metrics)
    repl = [f"{O.sig(c)} AS {c}" for c in double_cols] + [f"CAST(COALESCE({c}, 0) AS BIGINT) AS {c}" for c in LIGHT_HUGEINT_FORMULAS]
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM ({inner})"


LIGHT_DOUBLE_FORMULAS = ["revenue", "error_event_share", "event_value_mean", "max_event_value"]


# A-1..A-8, P-15
@register("q_unit_agg_strict", _ua_sql_rounded(light_psql(), LIGHT_METRICS, LIGHT_DOUBLE_FORMULAS))
def q_unit_agg_strict(spark, d):
    return _unit_out(unit_table(spark, light_inputs(spark, d), light_obs(), LIGHT_METRICS))


_KEEP = dict(experiment_name="exp_click", exposure_event=None)


# P-16
@register("q_unit_agg_keep_inactive", _ua_sql_rounded(light_psql(keep_inactive=True, testids=_NO_EVENTS_SQL, **_KEEP), LIGHT_METRICS, LIGHT_DOUBLE_FORMULAS))
def q_unit_agg_keep_inactive(spark, d):
    inputs = _with_units_without_events(light_inputs(spark, d))
    return _unit_out(unit_table(spark, inputs, light_obs(keep_inactive_units=True, **_KEEP), LIGHT_METRICS))


_FILTERS = ("event_value > 20 OR event_name = 'view'", "k < 80")


# P-17
@register("q_unit_agg_filters", _ua_sql_rounded(light_psql(filters=list(_FILTERS)), LIGHT_METRICS, LIGHT_DOUBLE_FORMULAS))
def q_unit_agg_filters(spark, d):
    return _unit_out(unit_table(spark, light_inputs(spark, d), light_obs(filters=_FILTERS), LIGHT_METRICS))


# J-3, U-4 (semi: intersection of audiences)
@register(
    "q_audience_semi",
    _ua_sql_rounded(light_psql(audiences=[AUD_BIG_BUYERS_SQL, AUD_HIGH_K_SQL], audience_mode="semi"), LIGHT_METRICS, LIGHT_DOUBLE_FORMULAS),
)
def q_audience_semi(spark, d):
    inp = light_inputs(spark, d, audiences=[audience_big_buyers(spark, d), audience_high_k(spark, d)])
    return _unit_out(unit_table(spark, inp, light_obs(), LIGHT_METRICS))


# J-3 literal inner join (repeated audience ids multiply rows)
@register(
    "q_audience_inner",
    _ua_sql_rounded(light_psql(audiences=[AUD_BIG_BUYERS_SQL], audience_mode="inner"), LIGHT_METRICS, LIGHT_DOUBLE_FORMULAS),
)
def q_audience_inner(spark, d):
    inp = light_inputs(spark, d, audiences=[audience_big_buyers(spark, d)])
    return _unit_out(unit_table(spark, inp, light_obs(audience_join="inner"), LIGHT_METRICS))


# J-4, U-3 (audience tables UNION ALL inside EXISTS)
@register(
    "q_audience_exists_union",
    _ua_sql_rounded(light_psql(audiences=[AUD_BIG_BUYERS_SQL, AUD_HIGH_K_SQL], audience_mode="exists_union"), LIGHT_METRICS, LIGHT_DOUBLE_FORMULAS),
)
def q_audience_exists_union(spark, d):
    union = audience_big_buyers(spark, d).unionByName(audience_high_k(spark, d))
    inp = light_inputs(spark, d, audiences=[union])
    return _unit_out(unit_table(spark, inp, light_obs(), LIGHT_METRICS))


# A-9..A-19, R-1 (flagship)
@register("q_precompute_long", O.precompute_sql(light_psql(), LIGHT_METRICS))
def q_precompute_long(spark, d):
    return _pc_out(light_precompute(spark, d))


@register("q_precompute_heavy", O.precompute_sql(heavy_psql(), HEAVY_METRICS))
def q_precompute_heavy(spark, d):
    return _pc_out(heavy_precompute(spark, d))


# S-6
@register("q_precompute_planning", O.precompute_sql(light_psql(planning=True), LIGHT_METRICS))
def q_precompute_planning(spark, d):
    return _pc_out(light_precompute(spark, d, purpose="planning"))


# S-1..S-3 + U-1 feeding the whole flagship
@register("q_precompute_three_sources", O.precompute_sql(light_psql(), LIGHT_METRICS))
def q_precompute_three_sources(spark, d):
    inp = light_inputs(spark, d)
    inp.events = TD.light_event_sources(spark, d)
    return _pc_out(run_observation(spark, inp, light_obs(), LIGHT_METRICS))


# A-20
@register(
    "q_group_sizes",
    light_psql().with_clause({"ua": light_psql().unit_agg(LIGHT_METRICS), "pc": O.precompute_selects(LIGHT_METRICS, "user_id")})
    + " SELECT group_name, MAX(observation_cnt) AS observation_cnt FROM pc GROUP BY group_name",
)
def q_group_sizes(spark, d):
    return group_sizes(light_precompute(spark, d))


# A-22
@register(
    "q_distinct_exposure_events",
    f"SELECT DISTINCT event_type AS event_name FROM events WHERE ts >= {O.ts(LW['exposure_end'])}",
)
def q_distinct_exposure_events(spark, d):
    ev = TD.light_events(spark, d)
    return ev.where(F.col("event_timestamp") >= ts_lit(LW["exposure_end"])).select("event_name").distinct()


# A-23, U-7: distinct groups and tags of a metric catalog, here one metric per customer
@register(
    "q_distinct_labels",
    "WITH m AS (SELECT c_custkey, c_mktsegment AS g, [CASE WHEN c_acctbal < 0 THEN 'debt' END, 'nation' || c_nationkey % 7, CASE WHEN c_custkey % 3 = 0 THEN 'nation1' END, ' '] AS tags FROM customer), "
    "x AS (SELECT DISTINCT 'tag' AS kind, unnest(tags) AS label, c_custkey FROM m UNION SELECT 'group', g, c_custkey FROM m) "
    "SELECT kind, label, count(*) AS n_metrics FROM x WHERE trim(label) <> '' GROUP BY kind, label",
)
def q_distinct_labels(spark, d):
    tags = F.array(F.when(F.col("c_acctbal") < 0, "debt"), F.concat(F.lit("nation"), F.col("c_nationkey") % 7), F.when(F.col("c_custkey") % 3 == 0, "nation1"), F.lit(" "))
    catalog = TD.table(spark, d, "customer").select(F.col("c_custkey").alias("metric_name"), F.col("c_mktsegment").alias("metric_group"), tags.alias("tags"))
    return distinct_labels(catalog)


# K-1, S-11: a job that ran in part, ran again and was killed during a third run
@register("q_job_rerun", O.precompute_sql(light_psql(), LIGHT_METRICS))
def q_job_rerun(spark, d):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/job-{uuid.uuid4().hex}"
    rows = materialize(light_precompute(spark, d))
    sinks.append_precompute(rows.where("metric_type = 'avg'"), path, 5)
    sinks.append_precompute(rows, path, 5)
    rows.withColumns({"job_id": F.lit(5).cast("long"), "run": F.lit("killed")}).write.mode("append").partitionBy("job_id", "run").parquet(path)
    return _pc_out(sinks.read_precompute(spark, path, 5).drop("job_id"))


# K-3, M-6: current state of every job of a log (the orders: one job per customer), lost ones closed
_LOG_STATUS = {"F": "completed", "O": "running", "P": "pending"}
_LOG_NOW = "1998-08-02 00:00:00"


@register(
    "q_job_states",
    "WITH cur AS (SELECT o_custkey AS job_id, o_orderdate AS seen, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status FROM orders "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1), "
    f"x AS (SELECT *, status <> 'completed' AND seen <= TIMESTAMP '{_LOG_NOW}' - INTERVAL 2400 HOUR AS lost FROM cur) "
    f"SELECT job_id, CASE WHEN lost THEN 'failed' ELSE status END AS status, CASE WHEN lost THEN '{sinks.LOST}' END AS error_message, CAST(seq + CASE WHEN lost THEN 1 ELSE 0 END AS BIGINT) AS seq FROM x",
)
def q_job_states(spark, d):
    status = F.element_at(F.create_map(*[F.lit(x) for kv in _LOG_STATUS.items() for x in kv]), F.col("o_orderstatus"))
    log = TD.table(spark, d, "orders").select(
        F.col("o_custkey").alias("job_id"), F.lit(None).cast("string").alias("error_message"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("_created_at"), F.col("o_orderkey").cast("bigint").alias("seq")
    )
    closed = log.unionByName(sinks.lost_jobs(log, _LOG_NOW, hours=2400))
    return sinks.current_jobs(closed).select("job_id", "status", "error_message", "seq")


def _both_pc_sql() -> str:
    lp, hp = light_psql(), heavy_psql()
    light = lp.with_clause({"ua": lp.unit_agg(LIGHT_METRICS), "pc": O.precompute_selects(LIGHT_METRICS, "user_id")}) + " SELECT 'light' AS analysis, * FROM pc"
    heavy = hp.with_clause({"ua": hp.unit_agg(HEAVY_METRICS), "pc": O.precompute_selects(HEAVY_METRICS, "custkey")}) + " SELECT 'heavy' AS analysis, * FROM pc"
    return f"({light}) UNION ALL ({heavy})"


def _both_pc(spark, d) -> DataFrame:
    return light_precompute(spark, d).withColumn("analysis", F.lit("light")).unionByName(
        heavy_precompute(spark, d).withColumn("analysis", F.lit("heavy"))
    )


_CONTRACT_CASE = (
    "concat_ws(',', "
    "CASE WHEN observation_cnt IS NULL OR observation_cnt <= 0 THEN 'non_positive_count' END, "
    "CASE WHEN metric_value IS NULL THEN 'missing_value' END, "
    "CASE WHEN metric_type IS NULL OR metric_type NOT IN ('avg', 'ratio', 'proportion') THEN 'unknown_type' END, "
    "CASE WHEN numerator_var < 0 OR denominator_var < 0 THEN 'negative_variance' END, "
    "CASE WHEN metric_type = 'proportion' AND (metric_value < 0 OR metric_value > 1) THEN 'proportion_out_of_range' END, "
    "CASE WHEN metric_type = 'ratio' AND (numerator_avg IS NULL OR numerator_var IS NULL OR denominator_avg IS NULL "
    "OR denominator_var IS NULL OR covariance IS NULL) THEN 'ratio_missing_moments' END, "
    "CASE WHEN metric_type = 'avg' AND numerator_var IS NULL THEN 'avg_missing_variance' END)"
)


# P-25 over every precompute row of both analyses, and over rows made of each customer that
# break the rules by what the customer's key and balance are
_MADE_CONTRACT_SQL = (
    "SELECT 'customer' AS analysis, CAST(c_custkey AS VARCHAR) AS group_name, c_mktsegment AS metric_name, "
    "CASE c_custkey % 4 WHEN 0 THEN 'avg' WHEN 1 THEN 'ratio' WHEN 2 THEN 'proportion' ELSE CASE WHEN c_custkey % 8 = 3 THEN 'median' END END AS metric_type, "
    "CAST(c_custkey % 5 AS BIGINT) AS observation_cnt, CASE WHEN c_nationkey < 22 THEN CAST(c_acctbal AS DOUBLE) / 5000 END AS metric_value, "
    "CAST(c_nationkey AS DOUBLE) AS numerator_avg, CASE WHEN c_custkey % 7 > 1 THEN CAST(c_acctbal AS DOUBLE) END AS numerator_var, "
    "CAST(1 AS DOUBLE) AS denominator_avg, CASE WHEN c_custkey % 9 > 0 THEN CAST(1 AS DOUBLE) END AS denominator_var, CAST(0 AS DOUBLE) AS covariance FROM customer"
)


@register(
    "q_contract_violations",
    f"SELECT analysis, group_name, metric_name, {_CONTRACT_CASE} AS violations FROM ({_both_pc_sql()}) UNION ALL "
    f"SELECT analysis, group_name, metric_name, {_CONTRACT_CASE} AS violations FROM ({_MADE_CONTRACT_SQL})",
)
def q_contract_violations(spark, d):
    key, balance = F.col("c_custkey"), F.col("c_acctbal").cast("double")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("avg", "ratio", "proportion", None)]), (key % 4 + 1).cast("int"))
    made = TD.table(spark, d, "customer").select(
        F.lit("customer").alias("analysis"), key.cast("string").alias("group_name"), F.col("c_mktsegment").alias("metric_name"),
        F.coalesce(kind, F.when(key % 8 == 3, "median")).alias("metric_type"), (key % 5).cast("bigint").alias("observation_cnt"),
        F.when(F.col("c_nationkey") < 22, balance / 5000).alias("metric_value"), F.col("c_nationkey").cast("double").alias("numerator_avg"),
        F.when(key % 7 > 1, balance).alias("numerator_var"), F.lit(1.0).alias("denominator_avg"), F.when(key % 9 > 0, 1.0).alias("denominator_var"), F.lit(0.0).alias("covariance"),
    )
    pc = _both_pc(spark, d).select(*made.columns).unionByName(made)
    return pc.select("analysis", "group_name", "metric_name", F.array_join(Q.contract_violations(), ",").alias("violations"))


# T-6
@register(
    "q_control_group",
    f"SELECT analysis, arg_min(group_name, CASE WHEN lower(group_name) LIKE '%control%' THEN '1' ELSE '2' END || group_name) AS control_group, "
    f"COUNT(*) AS n_groups FROM (SELECT DISTINCT analysis, group_name FROM ({_both_pc_sql()})) GROUP BY analysis",
)
def q_control_group(spark, d):
    return S.control_groups(_both_pc(spark, d), keys=["analysis"])


def _light_sig_sql(metric_filter: str | None = None) -> str:
    p = light_psql()
    pc_with = p.with_clause({"ua": p.unit_agg(SIG_METRICS_LIGHT), "pc": O.precompute_selects(SIG_METRICS_LIGHT, "user_id")})
    body = O.significance_sql(pc_with)
    where = f" WHERE {metric_filter}" if metric_filter else ""
    return body + f" SELECT {O.SIG_OUT} FROM sig{where}"


# T-1
@register("q_welch", _light_sig_sql("metric_type = 'avg'"))
def q_welch(spark, d):
    return _sig_out(light_significance(spark, d).where(F.col("metric_type") == "avg"))


# T-2
@register("q_ztest", _light_sig_sql("metric_type = 'proportion'"))
def q_ztest(spark, d):
    return _sig_out(light_significance(spark, d).where(F.col("metric_type") == "proportion"))


# T-4, T-5
@register("q_ratio_test", _light_sig_sql("metric_type = 'ratio'"))
def q_ratio_test(spark, d):
    return _sig_out(light_significance(spark, d).where(F.col("metric_type") == "ratio"))


# T-3
_dv = "(numerator_var / (denominator_avg * denominator_avg) + numerator_avg * numerator_avg * denominator_var / power(denominator_avg, 4) - 2 * numerator_avg * covariance / power(denominator_avg, 3))"
@register(
    "q_delta_variance",
    light_psql().with_clause({"ua": light_psql().unit_agg(LIGHT_METRICS), "pc": O.precompute_selects(LIGHT_METRICS, "user_id")})
    + f" SELECT group_name, metric_name, {O.sig(f'CASE WHEN {_dv} > -1e-9 AND {_dv} < 0 THEN 0 ELSE {_dv} END')} AS delta_variance, "
    + f"{O.sig(f'CASE WHEN {_dv} > -1e-9 AND {_dv} < 0 THEN 0 ELSE {_dv} END / observation_cnt')} AS mean_variance FROM pc WHERE metric_type = 'ratio'",
)
def q_delta_variance(spark, d):
    pc = light_precompute(spark, d).where(F.col("metric_type") == "ratio")
    v = delta_ratio_variance(F.col("numerator_avg"), F.col("numerator_var"), F.col("denominator_avg"), F.col("denominator_var"), F.col("covariance"))
    out = pc.select("group_name", "metric_name", v.alias("delta_variance"), (v / F.col("observation_cnt")).alias("mean_variance"))
    return R.significant_digits(out, 10)


def _heavy_sig_sql() -> str:
    p = heavy_psql()
    pc_with = p.with_clause({"ua": p.unit_agg(HEAVY_METRICS), "pc": O.precompute_selects(HEAVY_METRICS, "custkey")})
    return O.significance_sql(pc_with) + f" SELECT {O.SIG_OUT} FROM sig"


# J-5, T-7 (heavy mapping: 5 priority groups, control chosen by rule)
@register("q_significance_long", _heavy_sig_sql())
def q_significance_long(spark, d):
    return _sig_out(S.significance_table(materialize(heavy_precompute(spark, d))))


PIVOT_GROUPS = ["treatment1", "treatment2"]
PIVOT_COLS = ["metric_value_control", "metric_value_compared", "p_value", "diff_abs"]


def _pivot_sql() -> str:
    p = light_psql()
    pc_with = p.with_clause({"ua": p.unit_agg(SIG_METRICS_LIGHT), "pc": O.precompute_selects(SIG_METRICS_LIGHT, "user_id")})
    body = O.significance_sql(pc_with)
    # the Welch/z/ratio results need metric values from sj: rebuild them by join
    full = (
        "full_sig AS (SELECT s.*, sj.metric_value_control, sj.metric_value_compared FROM sig s JOIN sj "
        "ON s.metric_name = sj.metric_name AND s.group_name_compared = sj.group_name_compared)"
    )
    cols = []
    for g in PIVOT_GROUPS:
        for c in PIVOT_COLS:
            val = f"MAX(CASE WHEN group_name_compared = '{g}' THEN {c} END)"
            val = O.dec(val) if c == "p_value" else O.sig(val, 8)
            cols.append(f"{val} AS \"{g}__{c}\"")
    return body + ", " + full + f" SELECT metric_name, metric_type, metric_display_name, {', '.join(cols)} FROM full_sig GROUP BY ALL"


# R-2
@register("q_significance_pivot", _pivot_sql())
def q_significance_pivot(spark, d):
    piv = S.significance_pivot(light_significance(spark, d), PIVOT_GROUPS, PIVOT_COLS)
    p_cols = [f"{g}__p_value" for g in PIVOT_GROUPS]
    other = [f"{g}__{c}" for g in PIVOT_GROUPS for c in PIVOT_COLS if c != "p_value"]
    return R.fixed_decimals(R.significant_digits(piv, 8, other), 6, p_cols)


# two metrics without a display name, and two that the catalog lacks
FLAG_METRICS = [replace(m, display_name=None) if m.alias in ("click_through", "error_share") else m for m in SIG_METRICS_LIGHT]
FLAG_CATALOG = [m for m in FLAG_METRICS if m.alias not in ("max_event_value", "purchases_per_user")]
FLAG_THRESHOLD = 0.5

_CAT_VALUES = ", ".join(
    f"('{m.alias}', '{m.group_name}', {('[' + ', '.join(repr(t) for t in m.tags) + ']') if m.tags else 'CAST([] AS VARCHAR[])'})"
    for m in FLAG_CATALOG
)


# P-21, P-28, P-29, J-7, R-4
def _flagged_sql() -> str:
    p = light_psql()
    pc_with = p.with_clause({"ua": p.unit_agg(FLAG_METRICS), "pc": O.precompute_selects(FLAG_METRICS, "user_id")})
    body = O.significance_sql(pc_with)
    return (
        body
        + f", cat AS (SELECT * FROM (VALUES {_CAT_VALUES}) v(metric_name, metric_group, tags)) "
        + "SELECT s.metric_name, s.group_name_compared, COALESCE(s.metric_display_name, s.metric_name) AS metric_display_name, "
        + "COALESCE(cat.metric_group, 'Other') AS metric_group, "
        + f"{O.dec('s.p_value')} AS p_value, COALESCE(NOT isnan(s.p_value) AND s.p_value < {FLAG_THRESHOLD}, false) AS is_significant "
        + "FROM sig s LEFT JOIN cat ON s.metric_name = cat.metric_name "
        + "WHERE cat.metric_name IS NULL OR cat.metric_group IN ('money') OR list_has_any(cat.tags, ['ux'])"
    )


@register("q_significance_flagged", _flagged_sql())
def q_significance_flagged(spark, d):
    cat = catalog_frame(spark, FLAG_CATALOG)
    table = S.significance_table(materialize(light_precompute(spark, d, FLAG_METRICS)))
    out = R.present(table, cat, threshold=FLAG_THRESHOLD, groups=["money"], tags=["ux"])
    out = out.select("metric_name", "group_name_compared", "metric_display_name", "metric_group", "p_value", "is_significant")
    return R.fixed_decimals(out, 6, ["p_value"])


# T-14 uniform shares on the heavy groups (5 groups -> df 4)
def _heavy_sizes_sql() -> str:
    p = heavy_psql()
    return p.with_clause({"ua": p.unit_agg(HEAVY_METRICS), "pc": O.precompute_selects(HEAVY_METRICS, "custkey")})


@register(
    "q_srm_uniform",
    _heavy_sizes_sql()
    + ", gs AS (SELECT group_name, MAX(observation_cnt) AS o FROM pc GROUP BY group_name), "
    + "tot AS (SELECT SUM(o) AS n, COUNT(*) AS k FROM gs), "
    + "st AS (SELECT SUM(power(o - n / k, 2) / (n / k)) AS x, MAX(k) AS k FROM gs, tot) "
    + f"SELECT {O.sig('x')} AS statistic, {O.dec('exp(-x / 2) * (1 + x / 2)')} AS p_value, CAST(k - 1 AS INTEGER) AS df, "
    + "exp(-x / 2) * (1 + x / 2) < 0.001 AS is_srm, "
    + "(SELECT string_agg(CAST(o AS VARCHAR), ',' ORDER BY group_name) FROM gs) AS observed FROM st",
)
def q_srm_uniform(spark, d):
    res = SRM.srm_test(group_sizes(heavy_precompute(spark, d)))
    out = res.select("statistic", "p_value", "df", "is_srm", F.array_join(F.transform("observed", lambda x: x.cast("string")), ",").alias("observed"))
    return R.fixed_decimals(R.significant_digits(out, 10, ["statistic"]), 6, ["p_value"])


# T-14 with expected shares joined by group name: the assignment log's share per group
def _light_sizes_with() -> str:
    p = light_psql()
    return p.with_clause({"ua": p.unit_agg(LIGHT_METRICS), "pc": O.precompute_selects(LIGHT_METRICS, "user_id")})


_MADE_SHARES = {"even": (1 / 3, 1 / 3, 1 / 3), "skewed": (0.5, 0.3, 0.2)}
_MADE_SHARES_SQL = ", ".join(f"('{check}', '{g}', {O.dbl(x)})" for check, shares in _MADE_SHARES.items() for g, x in zip(TD.LIGHT_GROUPS, shares))


@register(
    "q_srm_expected",
    _light_sizes_with()
    + f", sh AS (SELECT 'log' AS plan_name, group_name, COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM ({O.LIGHT_TESTIDS}) GROUP BY group_name UNION ALL VALUES {_MADE_SHARES_SQL}), "
    + "gs AS (SELECT group_name, MAX(observation_cnt) AS o FROM pc GROUP BY group_name), "
    + "tot AS (SELECT SUM(o) AS n FROM gs), "
    + "st AS (SELECT plan_name, SUM(power(o - n * share, 2) / (n * share)) AS x, COUNT(*) AS k FROM gs JOIN sh USING (group_name), tot GROUP BY plan_name) "
    + f"SELECT plan_name, {O.sig('x')} AS statistic, {O.dec('exp(-x / 2)')} AS p_value, CAST(k - 1 AS INTEGER) AS df, exp(-x / 2) < 0.001 AS is_srm FROM st",
)
def q_srm_expected(spark, d):
    log = SRM.group_shares(TD.light_testids(spark, d).groupBy("group_name").agg(F.count("*").alias("observation_cnt")))
    made = spark.createDataFrame([(check, g, float(x)) for check, shares in _MADE_SHARES.items() for g, x in zip(TD.LIGHT_GROUPS, shares)], "plan_name string, group_name string, share double")
    shares = log.select(F.lit("log").alias("plan_name"), "group_name", "share").unionByName(made)
    sizes = group_sizes(light_precompute(spark, d)).select(F.explode(F.array(*[F.lit(x) for x in ("log", *_MADE_SHARES)])).alias("plan_name"), "group_name", "observation_cnt")
    res = SRM.srm_test(sizes, shares, keys=["plan_name"])
    out = res.select("plan_name", "statistic", "p_value", "df", "is_srm")
    return R.fixed_decimals(R.significant_digits(out, 10, ["statistic"]), 6, ["p_value"])


def _planning_with() -> str:
    p = light_psql(planning=True)
    return p.with_clause({"ua": p.unit_agg(LIGHT_METRICS), "pc": O.precompute_selects(LIGHT_METRICS, "user_id")})


_EFFECTS_SQL = "(VALUES " + ", ".join(f"({O.dbl(e)})" for e in PW.DEFAULT_EFFECTS) + ") eff(effect_size)"
_ZZ = (PW.NORM_PPF_ALPHA_TWO_SIDED[0.05] + PW.NORM_PPF_BETA[0.2]) ** 2
REFERENCE_DAYS = light_obs().reference_days


def _light_planning(spark, d) -> DataFrame:
    return materialize(light_precompute(spark, d, purpose="planning"))


# T-8, P-27, T-13
@register(
    "q_sample_size_proportion",
    _planning_with()
    + ", x AS (SELECT pc.*, eff.effect_size, metric_value * (1 + eff.effect_size) AS p2 FROM pc, "
    + _EFFECTS_SQL
    + " WHERE metric_type = 'proportion') "
    + f"SELECT metric_name, effect_size, CAST(CEIL({_ZZ!r} * (metric_value * (1 - metric_value) + q2 * (1 - q2)) / power(metric_value - q2, 2)) AS DOUBLE) AS sample_size "
    + "FROM (SELECT *, metric_value + metric_value * effect_size AS q2 FROM x) WHERE p2 > 0 AND p2 < 1",
)
def q_sample_size_proportion(spark, d):
    plan = PW.plan_sample_sizes(_light_planning(spark, d).where(F.col("metric_type") == "proportion"), reference_days=REFERENCE_DAYS)
    return plan.select("metric_name", "effect_size", "sample_size")


_RV = "(numerator_var / (denominator_avg * denominator_avg) + numerator_avg * numerator_avg * denominator_var / power(denominator_avg, 4) - 2 * numerator_avg * covariance / power(denominator_avg, 3))"


# T-10
@register(
    "q_sample_size_ratio",
    _planning_with()
    + ", x AS (SELECT pc.*, eff.effect_size, numerator_avg / denominator_avg AS ratio, "
    + f"CASE WHEN {_RV} > -1e-9 AND {_RV} < 0 THEN 0 ELSE {_RV} END AS rv FROM pc, "
    + _EFFECTS_SQL
    + " WHERE metric_type = 'ratio') "
    + f"SELECT metric_name, effect_size, CAST(CEIL({2 * _ZZ!r} * rv / ((ratio * (1 + effect_size) - ratio) * (ratio * (1 + effect_size) - ratio))) AS DOUBLE) AS sample_size FROM x",
)
def q_sample_size_ratio(spark, d):
    plan = PW.plan_sample_sizes(_light_planning(spark, d).where(F.col("metric_type") == "ratio"), reference_days=REFERENCE_DAYS)
    return plan.select("metric_name", "effect_size", "sample_size")


# T-9 (non-central t / bisection; rows-only check)
@register("q_sample_size_avg")
def q_sample_size_avg(spark, d):
    plan = PW.plan_sample_sizes(_light_planning(spark, d).where(F.col("metric_type") == "avg"), reference_days=REFERENCE_DAYS)
    return plan.select("metric_name", "effect_size", "sample_size", "observations_per_day", "days")


# T-11, T-12, A-25
@register(
    "q_plan_days",
    _planning_with()
    + ", x AS (SELECT pc.*, eff.effect_size, metric_value * (1 + eff.effect_size) AS p2 FROM pc, "
    + _EFFECTS_SQL
    + " WHERE metric_type = 'proportion'), y AS (SELECT metric_name, effect_size, observation_cnt, "
    + f"CAST(CEIL({_ZZ!r} * (metric_value * (1 - metric_value) + q2 * (1 - q2)) / power(metric_value - q2, 2)) AS DOUBLE) AS sample_size "
    + "FROM (SELECT *, metric_value + metric_value * effect_size AS q2 FROM x) WHERE p2 > 0 AND p2 < 1) "
    + f"SELECT metric_name, effect_size, sample_size, {O.sig(f'observation_cnt / {float(REFERENCE_DAYS)!r}')} AS observations_per_day, "
    + f"{O.sig(f'sample_size / (observation_cnt / {float(REFERENCE_DAYS)!r})')} AS days FROM y",
)
def q_plan_days(spark, d):
    plan = PW.plan_sample_sizes(_light_planning(spark, d).where(F.col("metric_type") == "proportion"), reference_days=REFERENCE_DAYS)
    out = plan.select("metric_name", "effect_size", "sample_size", "observations_per_day", "days")
    return R.significant_digits(out, 10, ["observations_per_day", "days"])


# P-1..P-10, O-1..O-3
_DSL_FILTERS = {
    "c_mktsegment__in": ["BUILDING", "MACHINERY", "AUTOMOBILE"],
    "c_acctbal__gte": 0.0,
    "c_name__ilike": "%0%",
    "c_nationkey__lt__or": [3, 12],
    "c_custkey__gt": 0,
}


@register(
    "q_select_dsl",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') "
    "AND c_acctbal >= 0 AND c_name ILIKE '%0%' AND (c_nationkey < 3 OR c_nationkey < 12) AND c_custkey > 0 "
    "ORDER BY c_custkey DESC LIMIT 100",
)
def q_select_dsl(spark, d):
    cust = TD.table(spark, d, "customer")
    return E.select_where(cust, _DSL_FILTERS, ["c_custkey", "c_name", "c_acctbal"], sort_by="c_custkey", sort_order="desc", limit=100)


# W-6, P-13: latest finished order per customer
@register(
    "q_latest_job",
    "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'F' "
    "QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
)
def q_latest_job(spark, d):
    od = E.select_where(TD.table(spark, d, "orders"), {"o_orderstatus": "F"})
    return E.latest_per_key(od, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


# M-2, W-7: customer balances updated by an append-only log of versions (the orders)
@register(
    "q_upsert_latest",
    "WITH u AS (SELECT o_custkey AS c_custkey, MAX(o_orderdate) AS seen, "
    "last(o_totalprice / 100 ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS balance, "
    "last(o_orderpriority ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS segment "
    "FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY o_custkey) "
    "SELECT c_custkey, COALESCE(seen, TIMESTAMP '1995-01-01 00:00:00') AS _updated_at, c_name, "
    "COALESCE(balance, c_acctbal) AS c_acctbal, COALESCE(segment, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN u USING (c_custkey)",
)
def q_upsert_latest(spark, d):
    """Orders as updates of customers: each sets one of two fields, and those before 1995 are stale."""
    cust = TD.table(spark, d, "customer").select(
        "c_custkey", ts_lit("1995-01-01 00:00:00").alias("_updated_at"), "c_name", "c_acctbal", "c_mktsegment"
    )
    final = F.col("o_orderstatus") == "F"
    upd = TD.table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("_updated_at"), "o_orderkey",
        F.when(final, F.col("o_totalprice") / 100).alias("c_acctbal"),
        F.when(~final, F.col("o_orderpriority")).alias("c_mktsegment"), F.col("o_orderpriority").alias("unknown_field"),
    )
    return E.apply_updates(cust, upd, "c_custkey", "_updated_at", tie_break=["o_orderkey"])


# K-2, M-2, M-3, W-7: stored customers, changed by three batches of the log and compacted in between
@register(
    "q_stored_state",
    "WITH u AS (SELECT o_custkey AS c_custkey, MAX(o_orderdate) FILTER (WHERE o_orderstatus <> 'P') AS seen, "
    "last(o_totalprice ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS balance, "
    "last(o_orderpriority ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS segment, "
    "COALESCE(bool_or(o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'), FALSE) AS gone FROM orders GROUP BY o_custkey) "
    "SELECT c_custkey, COALESCE(seen, TIMESTAMP '1990-01-01 00:00:00') AS _updated_at, c_name, COALESCE(balance, c_acctbal) AS c_acctbal, "
    "COALESCE(segment, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN u USING (c_custkey) WHERE NOT COALESCE(gone, FALSE)",
)
def q_stored_state(spark, d):
    """Customers in debt are created by the log.  Orders set one of two fields; an open order
    of the last batch deletes its customer."""
    cust = TD.table(spark, d, "customer").select(
        "c_custkey", ts_lit("1990-01-01 00:00:00").alias("_updated_at"), "c_name", "c_acctbal", "c_mktsegment"
    )
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    debt = F.col("c_acctbal") < 0
    ST.create_state(cust.where(~debt), path, "c_custkey", buckets=8)
    ST.append_changes(cust.where(debt).withColumn("op", F.lit("create")), path, ["_updated_at"])
    status = F.col("o_orderstatus")
    changes = TD.table(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").alias("_updated_at"), "o_orderkey",
        F.when(status == "F", F.col("o_totalprice")).alias("c_acctbal"), F.when(status == "O", F.col("o_orderpriority")).alias("c_mktsegment"),
        F.when(status == "P", "delete").otherwise("set").alias("op"),
    )
    late = F.col("_updated_at") >= ts_lit("1995-01-01 00:00:00")
    ST.append_changes(changes.where(~late & (F.col("op") == "set")), path, ["_updated_at", "o_orderkey"])
    ST.compact_state(spark, path)
    ST.append_changes(changes.where(late), path, ["_updated_at", "o_orderkey"])
    return ST.read_state(spark, path)


# M-3, M-4, J-10: delete a region and everything below it
@register(
    "q_cascade_delete",
    "WITH dr AS (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'), "
    "dn AS (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM dr)), "
    "dc AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM dn)) "
    "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM dc WHERE dc.c_custkey = o.o_custkey)",
)
def q_cascade_delete(spark, d):
    region, nation = TD.table(spark, d, "region"), TD.table(spark, d, "nation")
    customer, orders = TD.table(spark, d, "customer"), TD.table(spark, d, "orders")
    doomed = region.where(F.col("r_name") == "ASIA").select("r_regionkey")
    levels = [(region, "r_regionkey", None), (nation, "n_nationkey", "n_regionkey"), (customer, "c_custkey", "c_nationkey"), (orders, "o_orderkey", "o_custkey")]
    survivors = E.cascade_delete(levels, doomed, "r_regionkey")
    return survivors[-1].select("o_orderkey", "o_custkey")


# J-9
@register(
    "q_hierarchy",
    "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
    "JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
)
def q_hierarchy(spark, d):
    o, c = TD.table(spark, d, "orders"), TD.table(spark, d, "customer")
    n, r = TD.table(spark, d, "nation"), TD.table(spark, d, "region")
    return (
        o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        .select("o_orderkey", "c_name", "n_name", "r_name")
    )


# P-23, P-24: query and expression texts of every kind, made of the nations' names and keys,
# next to every conversation turn
_TEXTS = [
    "SELECT * FROM nation WHERE n_nationkey = {k}", "with a as (select {k} as x) select x from a;", "VALUES ({k}), ('{n}')", "-- only a comment on {n}", "(SELECT {k})", "SHOW TABLES LIKE '{n}'",
    "SELECT {k}; DROP TABLE t{k}", "DELETE FROM t WHERE n = '{n}'", "SELECT n_name INTO t{k} FROM nation", "SELECT a FROM t{k} FOR UPDATE", "select a from t{k} for  share", "SELECT pg_sleep({k})",
    "WITH x AS (INSERT INTO t{k} VALUES (1)) SELECT 1", "SELECT 'drop table {n}' AS words /* delete */", "SELECT '/*' a, drop b, '{n}*/' c", "WITH u AS (SELECT {k}), v AS ( DELETE FROM t) TABLE v", "  ",
    "n_name = '{n}'", "n_nationkey > {k} AND n_name IS NOT NULL", "n_nationkey = {k} OR 1=1", "n_name = '{n}' -- end", "x{k}; stop", "name UNION ALL SELECT {k}", "xp_cmdshell '{n}'", "utl_http.request('{n}')", "benchmark({k}, 1)", "exec ('{n}')", "pg_sleep({k})",
]
_TEXT_VALUES = ", ".join(f"({k}, '{t.replace(chr(39), chr(39) * 2)}')" for k, t in enumerate(_TEXTS))
_TEXTS_SQL = (
    "SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1 - n_nationkey, t.k, replace(replace(t.text, '{k}', CAST(n_nationkey AS VARCHAR)), '{n}', n_name) "
    f"FROM nation, (VALUES {_TEXT_VALUES}) t(k, text)"
)


def _query_texts(spark, d) -> DataFrame:
    made = F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(t).alias("text")) for k, t in enumerate(_TEXTS)])
    rows = TD.table(spark, d, "nation").select("n_nationkey", "n_name", F.inline(made))
    text = F.replace(F.replace("text", F.lit("{k}"), F.col("n_nationkey").cast("string")), F.lit("{n}"), F.col("n_name"))
    conv = TD.table(spark, d, "conversations")
    own = rows.select((-1 - F.col("n_nationkey")).cast(conv.schema["conv_id"].dataType).alias("conv_id"), F.col("turn").cast(conv.schema["turn"].dataType).alias("turn"), text.alias("text"))
    return conv.select("conv_id", "turn", "text").unionByName(own)


def _audit_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(text, '{pat.replace(chr(39), chr(39) * 2)}') THEN '{name}' END" for name, pat in ORACLE_INJECTION_PATTERNS)
    return f"SELECT conv_id, turn, concat_ws(',', {cases}) AS hits FROM ({_TEXTS_SQL})"


# RE2 spellings of the same rules: a Unicode-aware word boundary (as in the JVM
# and in Python) is written as an explicit non-word character or string end.
_NW = r"[^\p{L}\p{Nd}_]"
_B1 = f"(?:^|{_NW})"
_B2 = f"(?:$|{_NW})"
ORACLE_INJECTION_PATTERNS = [
    ("statement_keyword", f"(?i){_B1}(ALTER|CREATE|DELETE|DROP|EXEC(UTE){{0,1}}|INSERT( +INTO){{0,1}}|MERGE|SELECT|UPDATE|UNION( +ALL){{0,1}}){_B2}"),
    ("comment", r"(\s*(--|#|/\*))"),
    ("tautology", f"(?i){_B1}(AND|OR)\\s+[\\w\\d'\"]+\\s*=\\s*[\\w\\d'\"]+"),
    ("stacked_query", r"(\s*;\s*)"),
    ("shell_procedure", f"(?i){_B1}(xp_cmdshell|sp_oacreate|sp_oamethod){_B2}"),
    ("file_or_http_package", f"(?i){_B1}(UTL_HTTP|UTL_FILE){_B2}"),
    ("pg_sleep", f"(?i){_B1}(pg_sleep){_B2}"),
    ("benchmark_or_sleep", f"(?i){_B1}(BENCHMARK|SLEEP){_B2}"),
]


def _guard_sql() -> str:
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    token = Q.TOKEN_RE.replace("'", "''")
    any_at = lambda cond: f"len(list_filter(range(1, len(w) + 1), lambda i: {cond})) > 0"
    codes = [
        (r"contains(regexp_replace(text, '[\s;]+$', ''), ';')", "multiple_statements"),
        ("len(w) > 0 AND NOT regexp_matches(w[1], '^[A-Z_]')", "unknown_statement"),
        (f"regexp_matches(w[1], '^[A-Z_]') AND NOT list_contains({listed(Q.READ_ONLY_FIRST_WORDS)}, w[1])", "not_read_only"),
        (f"list_has_any(w, {listed(Q.FORBIDDEN_QUERY_WORDS)})", "forbidden_keyword"),
        (any_at("w[i] = 'INTO' AND list_contains(w[1:i], 'SELECT')"), "select_into"),
        (any_at(f"w[i] = 'FOR' AND list_contains({listed(Q.LOCKING_WORDS)}, w[i + 1])"), "row_lock"),
        (any_at(f"list_contains({listed(Q.TIMING_FUNCTIONS)}, w[i]) AND w[i + 1] = '('"), "timing_function"),
        (any_at(f"w[i] = 'AS' AND w[i + 1] = '(' AND list_contains({listed(Q.CHANGING_WORDS)}, w[i + 2])"), "modifying_cte"),
    ]
    cases = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for cond, code in codes)
    upper = "translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    return (
        f"WITH t AS (SELECT *, list_transform(list_filter(regexp_extract_all(text, '{token}'), lambda x: NOT regexp_matches(x, '^(/\\*|--|#)')), "
        f"lambda x: CASE WHEN x[1] = chr(39) THEN x ELSE {upper} END) AS v "
        f"FROM ({_TEXTS_SQL})), w AS (SELECT *, CASE WHEN v[-1] = ';' THEN v[1:-2] ELSE v END AS w FROM t) "
        f"SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL ELSE concat_ws(',', {cases}) END AS violations FROM w"
    )


@register("q_expression_audit", _audit_sql())
def q_expression_audit(spark, d):
    return _query_texts(spark, d).select("conv_id", "turn", F.array_join(Q.injection_hits(F.col("text")), ",").alias("hits"))


@register("q_guarded_sql", _guard_sql())
def q_guarded_sql(spark, d):
    return _query_texts(spark, d).select("conv_id", "turn", F.array_join(Q.read_only_violations(F.col("text")), ",").alias("violations"))


# O-4: label centroids as queries, exact top-3 neighbours by L2 distance
TOPK = 3


def _topk_ranked_sql() -> str:
    """Label centroids as queries, all (centroid, vector) distances, ranked per query."""
    return (
        "WITH c AS (SELECT label, i, AVG(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i), "
        "q AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS qv FROM c GROUP BY label), "
        "dist AS (SELECT q.query_id, e.vec_id AS doc_id, sqrt(list_sum(list_transform(range(1, 65), "
        "lambda i: (CAST(e.embedding[i] AS DOUBLE) - q.qv[i]) * (CAST(e.embedding[i] AS DOUBLE) - q.qv[i])))) AS distance FROM q, embeddings e), "
        f"ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM dist), "
        f"top AS (SELECT * FROM ranked WHERE rank <= {TOPK})"
    )


_TOPK_OUT = f"query_id, CAST(rank AS INTEGER) AS rank, doc_id, {O.sig('distance', 8)} AS distance"


def _topk_sql() -> str:
    return _topk_ranked_sql() + f" SELECT {_TOPK_OUT} FROM top"


def _topk(spark, d) -> DataFrame:
    emb = TD.table(spark, d, "embeddings")
    return SIM.topk_similar(spark, emb, SIM.label_centroids(emb), k=TOPK)


@register("q_topk_similar", _topk_sql())
def q_topk_similar(spark, d):
    return R.significant_digits(_topk(spark, d), 8, ["distance"])


# U-6: vectors with an id divisible by 100 as queries; their neighbours overlap
_NEIGHBOURS = 20


def _neighbours_sql() -> str:
    return (
        "WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), "
        "dist AS (SELECT q.query_id, e.vec_id AS doc_id, sqrt(list_sum(list_transform(range(1, 65), "
        "lambda i: power(CAST(e.embedding[i] AS DOUBLE) - CAST(q.qv[i] AS DOUBLE), 2)))) AS distance FROM q, embeddings e), "
        f"top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM dist QUALIFY rank <= {_NEIGHBOURS}) "
        f"SELECT {_TOPK_OUT} FROM top QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY query_id, rank) = 1"
    )


@register("q_topk_dedup", _neighbours_sql())
def q_topk_dedup(spark, d):
    emb = TD.table(spark, d, "embeddings")
    hits = SIM.topk_similar(spark, emb, emb.where("vec_id % 100 = 0"), k=_NEIGHBOURS, query_id="vec_id")
    return R.significant_digits(SIM.dedupe_across_queries(hits), 8, ["distance"])


# S-16 on the document table, under paths of which some are in skipped folders
_CORPUS_PATH = "concat(source, CASE lang WHEN 'de' THEN '/.uv/' WHEN 'fr' THEN '/build/' WHEN 'es' THEN '/rebuild/' ELSE '/' END, CAST(doc_id AS STRING))"


@register(
    "q_corpus_filter",
    f"SELECT doc_id, lang, source, length(text) AS n_text FROM documents WHERE len(list_intersect(string_split({_CORPUS_PATH.replace('STRING', 'VARCHAR')}, '/'), "
    "['.git', '__pycache__', '.venv', 'venv', '.env', '.uv', '.streamlit', 'node_modules', '.pytest_cache', 'dist', 'build'])) = 0",
)
def q_corpus_filter(spark, d):
    docs = TD.table(spark, d, "documents").withColumn("path", F.expr(_CORPUS_PATH))
    return C.indexable(docs).select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_text"))


# K-5 export form of the light significance table
@register(
    "q_export_rounded",
    _light_sig_sql().replace(f" SELECT {O.SIG_OUT} FROM sig", "")
    + " SELECT metric_name, group_name_compared, round(p_value, 5) AS p_value, round(diff_ratio, 5) AS diff_ratio FROM sig",
)
def q_export_rounded(spark, d):
    sig = light_significance(spark, d).select("metric_name", "group_name_compared", "p_value", "diff_ratio")
    return R.rounded(sig, 5)


# S-7: user-supplied assignment query (read-only guard, then Spark SQL)
CUSTOM_ASSIGNMENT_SQL = (
    "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS group_name, "
    "ts AS record_timestamp FROM {events} WHERE event_type = 'click'"
)


@register(
    "q_precompute_custom_assignment",
    O.precompute_sql(
        light_psql(testids=CUSTOM_ASSIGNMENT_SQL.format(events="events"), custom=True, unit_cols=[], assignment_order=["group_name"]),
        LIGHT_METRICS,
    ),
)
def q_precompute_custom_assignment(spark, d):
    TD.table(spark, d, "events").createOrReplaceTempView("sm_events")
    inp = light_inputs(spark, d, custom_assignment=CUSTOM_ASSIGNMENT_SQL.format(events="sm_events"))
    return _pc_out(run_observation(spark, inp, light_obs(), LIGHT_METRICS))


# S-17: ad-hoc read-only SQL over registered tables
ADHOC_SQL = (
    "SELECT o_orderpriority, COUNT(*) AS n_orders, SUM(o_totalprice) AS revenue, MAX(o_orderdate) AS last_order "
    "FROM {orders} GROUP BY o_orderpriority"
)


@register(
    "q_adhoc_sql",
    f"SELECT o_orderpriority, n_orders, {O.sig('revenue')} AS revenue, last_order FROM ({ADHOC_SQL.format(orders='orders')})",
)
def q_adhoc_sql(spark, d):
    from ..sources.sinks import guarded_sql

    TD.table(spark, d, "orders").createOrReplaceTempView("sm_orders")
    return R.significant_digits(guarded_sql(spark, ADHOC_SQL.format(orders="sm_orders")), 10, ["revenue"])


# P-11 / P-12: list filter (created range half-open, status any-of, name ILIKE), newest first
@register(
    "q_list_filter",
    "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' "
    "AND o_orderstatus IN ('F', 'O') AND o_orderpriority ILIKE '%urgent%'",
)
def q_list_filter(spark, d):
    from datetime import datetime

    return E.list_filter(
        TD.table(spark, d, "orders"), created_from=datetime(1996, 1, 1), created_to=datetime(1997, 1, 1),
        statuses=["F", "O"], name_like="urgent", created_col="o_orderdate", status_col="o_orderstatus", name_col="o_orderpriority",
    )


# W-5, A-26: observed share of units per group and the uniform expected share
@register(
    "q_group_shares",
    _heavy_sizes_sql()
    + ", gs AS (SELECT group_name, MAX(observation_cnt) AS observation_cnt FROM pc GROUP BY group_name) "
    + f"SELECT group_name, observation_cnt, {O.sig('observation_cnt / SUM(observation_cnt) OVER ()')} AS share, "
    + f"{O.sig('1.0 / COUNT(*) OVER ()')} AS expected_share FROM gs",
)
def q_group_shares(spark, d):
    out = SRM.group_shares(group_sizes(heavy_precompute(spark, d)))
    return R.significant_digits(out, 10, ["share", "expected_share"])


# F-19: non-blank trimmed lines of every conversation turn (whole texts), with a
# tab-only line and a line between tabs added to each
@register(
    "q_text_lines",
    "SELECT conv_id, turn, CAST(len(list_filter(list_transform(regexp_split_to_array(text || chr(10) || chr(9) || chr(10) || ' ' || chr(9) || 'end' || chr(9), '\\r?\\n'), "
    "lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')) AS INTEGER) AS n_lines FROM conversations",
)
def q_text_lines(spark, d):
    from ..functions.text import split_lines

    conv = TD.table(spark, d, "conversations").withColumn("text", F.concat("text", F.lit("\n\t\n \tend\t")))
    return conv.select("conv_id", "turn", F.size(split_lines(F.col("text"))).alias("n_lines"))


# O-5: preview rows (the limit is the feature; which rows is engine-defined: rows-only)
@register("q_sample_rows")
def q_sample_rows(spark, d):
    return E.sample_rows(TD.light_events(spark, d), 20)


# K-6: JSON export of the flagship significance table (float text formats differ by engine: rows-only)
@register("q_json_export")
def q_json_export(spark, d):
    return R.json_lines(light_significance(spark, d).drop("input_errors"))
