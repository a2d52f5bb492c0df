"""Audit of what a user-supplied query or expression really does (P-23, P-24, S-7, S-17, X-4, X-5).

A text is first parsed by Spark: it must be one query (or one expression), and may name no
function that runs JVM code, no script and no files; a name behind IDENTIFIER must be a
plain string, which is looked at like a name.  A query is then analysed (not run), and
the analysed plan, in which views, parameters and identifiers are resolved, is gone
through again: what reads files must be a table of the catalog or a view that the
application has made, and no reflection call may have appeared."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from py4j.java_gateway import is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import INJECTION_PATTERNS

CATALYST = "org.apache.spark.sql.catalyst"
# Functions that run JVM code or hold a task up, and the nodes that they become.
UNSAFE_FUNCTIONS = {"java_method", "reflect", "try_reflect", "sleep", "pg_sleep", "benchmark"}
REFLECTION = ("CallMethodViaReflection", "TryReflect")
FILE_RELATIONS = ("LogicalRelation", "DataSourceV2Relation", "DataSourceV2ScanRelation", "StreamingRelation", "StreamingRelationV2")


def _items(seq) -> Iterator:
    return (seq.apply(k) for k in range(seq.size()))


def _nodes(gateway, node, in_view: bool = False) -> Iterator[tuple[str, object, bool]]:
    """(class name, node, below a view?) of a plan: operators, expressions, subqueries, CTEs."""
    kind = node.getClass().getSimpleName()
    yield kind, node, in_view
    in_view |= kind == "View"
    below = [*_items(node.children())]
    if is_instance_of(gateway, node, f"{CATALYST}.plans.QueryPlan"):
        inner = (x for x in _items(node.innerChildren()) if is_instance_of(gateway, x, f"{CATALYST}.trees.TreeNode"))
        below += [*_items(node.expressions()), *inner]
    elif is_instance_of(gateway, node, f"{CATALYST}.expressions.PlanExpression"):
        below.append(node.plan())
    for x in below:
        yield from _nodes(gateway, x, in_view)


def _parser(spark: SparkSession):
    return spark._jsparkSession.sessionState().sqlParser()


def _check_function(parts: list[str]) -> None:
    if parts[-1].lower() in UNSAFE_FUNCTIONS:
        raise ValueError(f"a query may not call {parts[-1].lower()}")


def _check_relation(spark: SparkSession, parts: list[str]) -> None:
    if len(parts) == 2 and not spark.catalog.databaseExists(parts[0]):
        raise ValueError(f"unknown schema {parts[0]}: a query may not read files by path")


def _check_parsed(spark: SparkSession, tree) -> None:
    gateway = spark.sparkContext._gateway
    for kind, node, _ in _nodes(gateway, tree):
        if "ScriptTransformation" in kind:
            raise ValueError("a query may not run a script")
        if kind == "UnresolvedFunction":
            _check_function([*_items(node.nameParts())])
        if kind == "UnresolvedTableValuedFunction":
            _check_function([*_items(node.name())])
        if kind == "UnresolvedRelation":
            _check_relation(spark, [*_items(node.multipartIdentifier())])
        if kind.endswith("WithUnresolvedIdentifier"):
            name = node.identifierExpr()
            if name.getClass().getSimpleName() != "Literal":
                raise ValueError("IDENTIFIER may only hold a plain string")
            parts = [*_items(_parser(spark).parseMultipartIdentifier(name.toString()))]
            _check_function(parts)
            _check_relation(spark, parts)


def _check_analysed(spark: SparkSession, plan) -> None:
    for kind, node, in_view in _nodes(spark.sparkContext._gateway, plan):
        if kind in REFLECTION or "ScriptTransformation" in kind:
            raise ValueError("a query may not run JVM methods or scripts")
        if kind in FILE_RELATIONS and not in_view:
            named = node.catalogTable() if hasattr(node, "catalogTable") and kind == "LogicalRelation" else node.identifier() if kind.startswith("DataSourceV2") else None
            if named is None or named.isEmpty():
                raise ValueError("a query may not read files by path")


def _one_line(exc: Exception) -> str:
    return str(exc).strip().split("\n")[0]


def ensure_read_only(sql: str, spark: SparkSession | None = None) -> str:
    """``sql`` itself if Spark parses it as one query that passes the audit of its parsed
    plan; else ValueError.  One closing semicolon is allowed."""
    spark = spark or SparkSession.active()
    text = (sql or "").strip().removesuffix(";")
    try:  # the grammar's query rule: no command, no DML, no second statement
        plan = _parser(spark).parseQuery(text)
    except ParseException as exc:
        raise ValueError(f"this is no single read-only query: {_one_line(exc)}") from exc
    _check_parsed(spark, plan)
    return sql


def audited_query(sql: str, spark: SparkSession) -> DataFrame:
    """The query as a DataFrame, after the audit of its parsed and its analysed plan.  Unknown
    tables and columns are Spark's own errors."""
    df = spark.sql(ensure_read_only(sql, spark).strip().removesuffix(";"))
    _check_analysed(spark, df._jdf.queryExecution().analyzed())
    return df


MOST_PASSED = 10_000
_PASSED: set[str] = set()  # expressions that have passed, so that a text is gone through once


def audited_expression(text: str, spark: SparkSession | None = None) -> Column:
    """A filter or formula as a Column, if it parses as one expression without subqueries
    that passes the audit of a query's expressions; else ValueError."""
    if text in _PASSED:  # what an expression may hold does not depend on the session
        return F.expr(text)
    spark = spark or SparkSession.active()
    try:
        tree = _parser(spark).parseExpression(text)
    except ParseException as exc:
        raise ValueError(f"this is no expression: {text!r}: {_one_line(exc)}") from exc
    for _, node, _ in _nodes(spark.sparkContext._gateway, tree):
        if is_instance_of(spark.sparkContext._gateway, node, f"{CATALYST}.expressions.PlanExpression"):
            raise ValueError(f"an expression may not hold a query: {text!r}")
    _check_parsed(spark, tree)
    if len(_PASSED) < MOST_PASSED:
        _PASSED.add(text)
    return F.expr(text)


def field_violations(fields: dict[str, str | Iterable[str] | None]) -> list[tuple[str, str, str]]:
    """(field, text, pattern name) for each injection pattern in texts that a user typed into
    the fields of an observation (texts or lists of texts; None and empty are clean)."""
    found = []
    for name, value in fields.items():
        for text in [value] if isinstance(value, str) else value or ():
            found += [(name, text, code) for code, pattern in INJECTION_PATTERNS if re.search(pattern, text)]
    return found
