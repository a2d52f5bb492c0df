"""Metric catalog rules and quality checks (guards, injection audit, result contract)."""

import pytest
from pyspark.sql import functions as F

from splitmill.operators import guard as G
from splitmill.operators import quality as Q
from splitmill.operators.precompute import PRECOMPUTE_SCHEMA
from splitmill.sources import catalog as C
from splitmill.sources.corpus import metric_documents


@pytest.mark.parametrize("alias", ["revenue", "_x1", "a" * 50, "select_from", "my_join"])
def test_valid_alias(alias):
    assert C.check_alias(alias) == alias


@pytest.mark.parametrize("alias", ["Revenue", "1abc", "a-b", "", "a" * 51, "select", "join", "SELECT", "fa fa fa", "DELETED", "54", ".*", "total--comment"])
def test_invalid_alias(alias):
    with pytest.raises(C.CatalogError):
        C.check_alias(alias)


@pytest.mark.parametrize("sql", ["SUM(x", "SELECT 1", "COUNT(*) -- c", "SUM(a) /* x */", "   ", "MAX(a) FROM t", "EXTRACT(day FROM ts)"])
def test_invalid_formula(sql):
    with pytest.raises(C.CatalogError):
        C.FormulaSpec("a", sql)


def test_ratio_needs_denominator():
    with pytest.raises(C.CatalogError):
        C.MetricSpec("r", "ratio", C.FormulaSpec("n", "SUM(x)"))
    m = C.MetricSpec("r", "ratio", C.FormulaSpec("n", "SUM(x)"), C.FormulaSpec("d", "COUNT(*)"))
    assert m.value_sql() == "CASE WHEN SUM(d) > 0 THEN SUM(n) / SUM(d) ELSE 0 END"
    assert C.MetricSpec("p", "proportion", C.FormulaSpec("f", "MAX(1)")).value_sql() == "AVG(f)"


def test_shared_formula_aliases():
    f = C.FormulaSpec("clicks", "COUNT(*)")
    a = C.MetricSpec("a", "avg", f)
    b = C.MetricSpec("b", "ratio", f, C.FormulaSpec("views", "COUNT(1)"))
    assert [x.alias for x in C.required_formulas([a, b])] == ["clicks", "views"]
    c = C.MetricSpec("c", "avg", C.FormulaSpec("clicks", "SUM(1)"))
    with pytest.raises(C.CatalogError):
        C.required_formulas([a, c])
    with pytest.raises(C.CatalogError):
        C.check_unique_metrics([a, a])


def test_load_catalog_yaml(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g.yaml").write_text(
        """
metric_group_name: Orders
user_aggregations:
  n: &n {alias: orders_cnt, sql: "COUNT(*)"}
metrics:
  - alias: orders_per_user
    type: avg
    display_name: Orders per user
    description: x
    formula: {numerator: *n, denominator: null}
    owner: me
    tags: null
  - alias: order_rate
    type: proportion
    display_name: Order rate
    description: null
    formula: {numerator: {alias: has_order, sql: "MAX(1)"}, denominator: null}
    owner: null
    tags: [core]
"""
    )
    ms = C.load_catalog(tmp_path)
    assert [m.alias for m in ms] == ["orders_per_user", "order_rate"]
    assert ms[0].group_name == "Orders" and ms[0].tags is None
    assert [m.alias for m in C.select_metrics(ms, ["order_rate", "missing", "orders_per_user"])] == ["order_rate", "orders_per_user"]
    assert [m.alias for m in C.filter_metrics(ms, types=["proportion"], tags=["core"])] == ["order_rate"]
    assert C.filter_metrics(ms, tags=["nothing"]) == []


def test_catalog_frame_and_documents(spark):
    from splitmill.plans.testdata_metrics import LIGHT_METRICS

    cat = C.catalog_frame(spark, LIGHT_METRICS)
    assert cat.count() == len(LIGHT_METRICS)
    docs = metric_documents(cat).collect()
    d = {r.doc_id: r for r in docs}
    assert "Metric: click_through (ratio)" in d["click_through"].document
    assert d["click_through"].metadata["metric_group"] == "engagement"
    tags = sorted({t for r in cat.select(F.explode("tags").alias("t")).distinct().collect() for t in [r.t]})
    assert tags == ["core", "orders", "quality", "revenue", "ux"]


GUARD_CASES = [
    ("SELECT * FROM t", []),
    ("  with a as (select 1) select * from a;  ", []),
    ("VALUES (1)", []),
    ("-- only a comment", []),
    ("DELETE FROM t", ["not_read_only", "forbidden_keyword"]),
    ("SELECT 1; DROP TABLE t", ["multiple_statements", "forbidden_keyword"]),
    ("SELECT a INTO b FROM t", ["select_into"]),
    ("SELECT * FROM t FOR UPDATE", ["row_lock", "forbidden_keyword"]),
    ("SELECT pg_sleep(5)", ["timing_function"]),
    ("WITH x AS (INSERT INTO t VALUES (1)) SELECT 1", ["forbidden_keyword", "modifying_cte"]),
    ("/* c */ SELECT 1", []),
    ("(SELECT 1)", ["unknown_statement"]),
]


@pytest.mark.parametrize("text,codes", GUARD_CASES)
def test_read_only_violations(spark, text, codes):
    got = spark.createDataFrame([(text,)], "q string").select(Q.read_only_violations(F.col("q")).alias("v")).collect()[0].v
    assert sorted(got) == sorted(codes)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM t", " with a as (select 1) select * from a; ", "VALUES (1)", "/* c */ SELECT 1", "(SELECT 1)", "FROM t SELECT a",
        "SELECT replace(x, 'a', 'b') FROM t", "SELECT ';' AS semicolon", "SELECT 'drop table' AS words -- delete", "SELECT * FROM default.t",
    ],
)
def test_queries_that_only_read_pass(spark, text):
    assert G.ensure_read_only(text, spark) == text


@pytest.mark.parametrize(
    "text",
    [
        "", "-- only a comment", "DELETE FROM t", "SELECT 1; DROP TABLE t", "SELECT a INTO b FROM t", "SELECT * FROM t FOR UPDATE", "SHOW TABLES",
        "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "FROM t INSERT INTO u SELECT a", "SET a = 1", "CACHE TABLE t", "SELECT pg_sleep(5)",
        "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT a FROM t WHERE b IN (SELECT reflect('a.B', 'c'))",
        "WITH x AS (SELECT Java_Method('a.B', 'c')) SELECT * FROM x", "SELECT 1 + (SELECT max(reflect('a.B', 'c')) FROM t)",
        "SELECT * FROM text.`/etc/passwd`", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM parquet.`/data`)", "WITH x AS (SELECT * FROM csv.`/a`) SELECT 1 FROM x",
        "SELECT TRANSFORM (a) USING 'cat' FROM t",
    ],
)
def test_other_statements_do_not_pass(spark, text):
    with pytest.raises(ValueError):
        G.ensure_read_only(text, spark)


@pytest.mark.parametrize(
    "expr,hit",
    [
        ("country = 'US'", None),
        ("a = 1 OR 1=1", "tautology"),
        ("x; drop", "stacked_query"),
        ("name -- comment", "comment"),
        ("union all select", "statement_keyword"),
        ("sleep(10)", "benchmark_or_sleep"),
        ("utl_http.request", "file_or_http_package"),
    ],
)
def test_injection_hits(spark, expr, hit):
    got = spark.createDataFrame([(expr,)], "e string").select(Q.injection_hits(F.col("e")).alias("h")).collect()[0].h
    assert (hit in got) if hit else got == []


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')", "SELECT IDENTIFIER('reflect')('java.lang.System','currentTimeMillis')", "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System','currentTimeMillis')",
        "SELECT * FROM IDENTIFIER(concat('text.', '`/etc/hostname`'))", "SELECT * FROM text.`/etc/hostname`", "SELECT 1 WHERE EXISTS (SELECT * FROM IDENTIFIER('csv.`/etc/hosts`'))",
        "WITH x AS (SELECT IDENTIFIER('java_method')('java.lang.System', 'currentTimeMillis') AS y) SELECT y FROM x",
    ],
)
def test_identifier_hides_nothing(spark, text):
    with pytest.raises(ValueError):
        G.audited_query(text, spark)


def test_analysed_plan_is_audited(spark):
    spark.range(3).createOrReplaceTempView("guard_own")
    spark.read.parquet("/root/testdata/sf0.001/nation.parquet").createOrReplaceTempView("guard_files")
    assert G.audited_query("SELECT count(*) AS n FROM guard_files JOIN guard_own ON n_nationkey = id;", spark).first().n == 3
    assert G.audited_query("SELECT * FROM IDENTIFIER('guard_own')", spark).count() == 3
    spark.sql("SELECT reflect('java.lang.System', 'currentTimeMillis') AS t").createOrReplaceTempView("guard_hidden")
    with pytest.raises(ValueError):
        G.audited_query("SELECT t FROM guard_hidden", spark)


@pytest.mark.parametrize("text", ["a > 1 OR (b = 2 AND c IS NULL)", "SUM(CASE WHEN event_name = 'select' THEN 1 ELSE 0 END)", "exists(array(1, 2), x -> x > 1)"])
def test_expressions_that_pass(spark, text):
    G.audited_expression(text, spark)


@pytest.mark.parametrize(
    "text",
    [
        "a IN (SELECT x FROM t)", "EXISTS (SELECT 1)", "(SELECT max(x) FROM t) > 1", "reflect('java.lang.System', 'exit', 0) = 1", "1 = 1) OR (reflect('a.B', 'c') = 'd'", "a = 1; DROP TABLE t", "IDENTIFIER('reflect')('a.B', 'c') = 'x'",
        "x IN (SELECT * FROM text.`/etc/hosts`)",
    ],
)
def test_expressions_that_do_not_pass(spark, text):
    with pytest.raises(ValueError):
        G.audited_expression(text, spark)


def test_filters_and_formulas_are_audited(spark):
    from splitmill.operators import unit_agg as U

    with pytest.raises(ValueError):
        U.row_filter(["event_value > 1", "event_value = (SELECT 1)"])
    with pytest.raises(ValueError):
        U.formula_columns([C.FormulaSpec("x", "SUM(java_method('a.B', 'c'))")])


def test_typed_fields_of_an_observation(spark):
    from datetime import datetime

    from splitmill.plans.observation import submitted

    when = dict(exposure_start=datetime(2024, 1, 1), exposure_end=datetime(2024, 1, 2), calc_start=datetime(2024, 1, 1), calc_end=datetime(2024, 1, 3))
    good = submitted(name="o", split_id="user_id", experiment_name="e", filters=("country = 'US'",), audience_tables=("aud.one",), custom_query="SELECT 1", spark=spark, **when)
    assert good.filters == ("country = 'US'",)
    for bad in (dict(experiment_name="x'; --"), dict(filters=("a = 1 OR 1=1",)), dict(exposure_event="union all select"), dict(split_id="sleep"), dict(audience_tables=("t; drop",)), dict(custom_query="DELETE FROM t")):
        with pytest.raises(ValueError):
            submitted(**{"name": "o", "split_id": "user_id", "spark": spark, **when, **bad})


def test_parentheses_balanced(spark):
    df = spark.createDataFrame([("(a(b))",), ("(()",), (")(",), ("",)], "t string")
    assert [r.b for r in df.select(Q.parentheses_balanced(F.col("t")).alias("b")).collect()] == [True, False, False, True]


def test_contract_violations(spark):
    rows = [
        ("g", "ok", None, "avg", 10, 1.0, None, 2.0, None, None, None),
        ("g", "p15", None, "proportion", 10, 1.5, None, None, None, None, None),
        ("g", "ratio_missing", None, "ratio", 10, 1.0, 1.0, 1.0, None, None, None),
        ("g", "avg_novar", None, "avg", 10, 1.0, None, None, None, None, None),
        ("g", "negvar", None, "avg", 10, 1.0, None, -0.01, None, None, None),
    ]
    df = spark.createDataFrame(rows, PRECOMPUTE_SCHEMA)
    got = {r.metric_name: r.v for r in df.select("metric_name", Q.contract_violations().alias("v")).collect()}
    assert got == {
        "ok": [], "p15": ["proportion_out_of_range"], "ratio_missing": ["ratio_missing_moments"],
        "avg_novar": ["avg_missing_variance"], "negvar": ["negative_variance"],
    }


@pytest.mark.parametrize(
    "text,codes",
    [
        ("SELECT 1 # trailing mysql comment", []),
        ("SELECT 1;   ", []),
        ("SELECT '/*' a, drop b, '*/' c", ["forbidden_keyword"]),
        ("select * from t for share", ["row_lock"]),
        ("VALUES (1), (2);\n", []),
        ("SELECT 'a;b' FROM t", ["multiple_statements"]),  # the rule is textual, as in the reference
        ("SELECT sleep (3)", ["timing_function"]),
        ("with a as (select 1) select * from a union all select 2", []),
    ],
)
def test_read_only_guard_edges(spark, text, codes):
    got = spark.createDataFrame([(text,)], "q string").select(Q.read_only_violations(F.col("q")).alias("v")).collect()[0].v
    assert sorted(got) == sorted(codes)


def test_shipped_yaml_catalog_matches_python_definitions():
    import os

    from splitmill.plans.testdata_metrics import LIGHT_METRICS

    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "metrics")
    loaded = {m.alias: m for m in C.load_catalog(root)}
    assert set(loaded) == {m.alias for m in LIGHT_METRICS}
    for m in LIGHT_METRICS:
        got = loaded[m.alias]
        assert (got.type, got.numerator, got.denominator, got.display_name, got.group_name, got.tags) == (
            m.type, m.numerator, m.denominator, m.display_name, m.group_name, m.tags)
