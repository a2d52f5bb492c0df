"""Metric catalog: unit-level formulas and group-level metric definitions.

A *formula* is one SQL aggregate evaluated per unit over its event rows
(``SUM(CASE WHEN event_name = 'purchase' THEN event_value ELSE 0 END)``).
A *metric* is a type (``avg``, ``ratio``, ``proportion``) plus a numerator
formula and an optional denominator formula.  Definitions live on the driver
(they are configuration, tens of rows); ``catalog_frame`` turns them into a
DataFrame for joins and filters on the result tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

METRIC_TYPES = ("avg", "ratio", "proportion")
# Words a formula may not contain (whole word, any case).
FORBIDDEN_FORMULA_WORDS = ["SELECT", "FROM", "INSERT", "DELETE", "CREATE", "MERGE", "UPDATE", "JOIN", "WHERE", "GROUP", "HAVING"]
ALIAS_RE = re.compile(r"^[a-z_][a-z0-9_]*$")
_FORBIDDEN_RE = re.compile(r"\b(?:" + "|".join(FORBIDDEN_FORMULA_WORDS) + r")\b", re.IGNORECASE)
MAX_ALIAS = 50
MAX_DISPLAY_NAME = 60
MAX_GROUP_NAME = 140


class CatalogError(ValueError):
    pass


def parentheses_balanced(text: str) -> bool:
    depth = 0
    for ch in text:
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth < 0:
                return False
    return depth == 0


def check_alias(alias: str) -> str:
    if not isinstance(alias, str) or not (1 <= len(alias) <= MAX_ALIAS) or not ALIAS_RE.match(alias):
        raise CatalogError(f"invalid alias {alias!r}: lower-case letters, digits, '_', 1-{MAX_ALIAS} chars")
    if _FORBIDDEN_RE.search(alias):
        raise CatalogError(f"alias {alias!r} contains a SQL keyword")
    return alias


COMMENT_MARKS = ("--", "/*", "*/")


def formula_problems(sql: str) -> list[str]:
    """Everything that keeps a text from being a unit formula."""
    if not isinstance(sql, str) or not sql.strip():
        return ["it is blank"]
    rules = {
        "its parentheses do not pair up": not parentheses_balanced(sql),
        f"it uses one of {', '.join(FORBIDDEN_FORMULA_WORDS)}": _FORBIDDEN_RE.search(sql) is not None,
        "it holds a comment": any(mark in sql for mark in COMMENT_MARKS),
    }
    return [problem for problem, broken in rules.items() if broken]


def check_formula_sql(sql: str) -> str:
    if problems := formula_problems(sql):
        raise CatalogError(f"no unit formula: {sql!r}: {'; '.join(problems)}")
    return sql


@dataclass(frozen=True)
class FormulaSpec:
    """One unit-level aggregate: ``alias`` names the unit column, ``sql`` computes it."""

    alias: str
    sql: str

    def __post_init__(self):
        check_alias(self.alias)
        check_formula_sql(self.sql)


@dataclass(frozen=True)
class MetricSpec:
    alias: str
    type: str
    numerator: FormulaSpec
    denominator: FormulaSpec | None = None
    display_name: str | None = None
    description: str | None = None
    owner: str | None = None
    group_name: str | None = None
    tags: tuple[str, ...] | None = None

    def __post_init__(self):
        check_alias(self.alias)
        if self.type not in METRIC_TYPES:
            raise CatalogError(f"metric {self.alias}: type must be one of {METRIC_TYPES}")
        if self.type == "ratio" and self.denominator is None:
            raise CatalogError(f"metric {self.alias}: a ratio has two formulas, and one is missing")
        if self.display_name is not None and len(self.display_name) > MAX_DISPLAY_NAME:
            raise CatalogError(f"metric {self.alias}: display name longer than {MAX_DISPLAY_NAME}")
        if self.group_name is not None and len(self.group_name) > MAX_GROUP_NAME:
            raise CatalogError(f"metric {self.alias}: group name longer than {MAX_GROUP_NAME}")

    @property
    def label(self) -> str:
        return self.display_name if self.display_name is not None else self.alias

    @property
    def uses_ratio_value(self) -> bool:
        """Value is ``SUM(num)/SUM(den)`` (ratio, or proportion with a denominator)."""
        return self.denominator is not None and self.type in ("ratio", "proportion")

    def value_sql(self) -> str:
        """Group-level value over the unit table (SQL text, also used by oracles)."""
        n = self.numerator.alias
        if self.uses_ratio_value:
            d = self.denominator.alias
            return f"CASE WHEN SUM({d}) > 0 THEN SUM({n}) / SUM({d}) ELSE 0 END"
        return f"AVG({n})"

    def formulas(self) -> list[FormulaSpec]:
        return [self.numerator] + ([self.denominator] if self.denominator is not None else [])


def required_formulas(metrics: list[MetricSpec]) -> list[FormulaSpec]:
    """Unit formulas needed by ``metrics``, one per alias, in first-use order.

    The same alias with the same SQL is shared; the same alias with different SQL
    is an error (two metrics would silently read different numbers)."""
    seen: dict[str, FormulaSpec] = {}
    for m in metrics:
        for f in m.formulas():
            prev = seen.get(f.alias)
            if prev is None:
                seen[f.alias] = f
            elif prev.sql.strip() != f.sql.strip():
                raise CatalogError(f"formula alias {f.alias!r} is defined twice with different SQL")
    return list(seen.values())


def check_unique_metrics(metrics: list[MetricSpec]) -> list[MetricSpec]:
    aliases = [m.alias for m in metrics]
    dup = sorted({a for a in aliases if aliases.count(a) > 1})
    if dup:
        raise CatalogError(f"duplicate metric aliases: {dup}")
    return metrics


def _formula_from(obj) -> FormulaSpec | None:
    if obj is None:
        return None
    return FormulaSpec(alias=obj["alias"], sql=obj["sql"])


def metrics_from_group(doc: dict) -> list[MetricSpec]:
    group = doc.get("metric_group_name")
    out = []
    for m in doc.get("metrics") or []:
        formula = m.get("formula") or {}
        tags = m.get("tags")
        out.append(
            MetricSpec(
                alias=m["alias"],
                type=m["type"],
                numerator=_formula_from(formula.get("numerator")),
                denominator=_formula_from(formula.get("denominator")),
                display_name=m.get("display_name"),
                description=m.get("description"),
                owner=m.get("owner"),
                group_name=group,
                tags=tuple(tags) if tags is not None else None,
            )
        )
    return out


def load_catalog(directory: str | Path) -> list[MetricSpec]:
    """Every ``*.yaml`` below ``directory`` is one metric group (driver-side config); a missing
    folder is an error."""
    import yaml

    if not Path(directory).is_dir():
        raise CatalogError(f"there is no metrics folder {str(directory)!r}")

    metrics: list[MetricSpec] = []
    for path in sorted(Path(directory).rglob("*.yaml")):
        with open(path, encoding="utf-8") as fh:
            doc = yaml.safe_load(fh)
        if doc:
            metrics.extend(metrics_from_group(doc))
    check_unique_metrics(metrics)
    required_formulas(metrics)
    return metrics


def select_metrics(metrics: list[MetricSpec], aliases: list[str] | None) -> list[MetricSpec]:
    """Metrics in request order, unknown aliases skipped; ``None`` or empty = all."""
    if not aliases:
        return list(metrics)
    by_alias = {m.alias: m for m in metrics}
    return [by_alias[a] for a in aliases if a in by_alias]


def filter_metrics(metrics, types=None, tags=None, group_names=None) -> list[MetricSpec]:
    """Type AND any-tag AND group (each criterion skipped when ``None`` or empty)."""
    kinds, wanted, groups = set(types or ()), set(tags or ()), set(group_names or ())
    fits = lambda m: (not kinds or m.type in kinds) and (not wanted or bool(wanted & set(m.tags or ()))) and (not groups or m.group_name in groups)
    return [m for m in metrics if fits(m)]


def distinct_labels(catalog: DataFrame) -> DataFrame:
    """``kind`` ("group" or "tag"), ``label``, ``n_metrics``: every metric group and tag of a
    catalog table once, with the number of metrics that have it, sorted (A-23, U-7).  NULL
    and blank labels are none; a tag that a metric has twice counts once."""
    from pyspark.sql import functions as F

    groups = catalog.select(F.lit("group").alias("kind"), F.col("metric_group").alias("label"), "metric_name")
    tags = catalog.select(F.lit("tag").alias("kind"), F.explode("tags").alias("label"), "metric_name")
    named = groups.unionByName(tags).where(F.trim("label") != "").distinct()
    return named.groupBy("kind", "label").agg(F.count("*").alias("n_metrics")).orderBy("kind", "label")


FORMULA_TYPE = T.StructType([T.StructField("alias", T.StringType()), T.StructField("sql", T.StringType())])
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("metric_name", T.StringType(), False),
        T.StructField("metric_type", T.StringType(), False),
        T.StructField("metric_display_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("metric_group", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("numerator", FORMULA_TYPE),
        T.StructField("denominator", FORMULA_TYPE),
        T.StructField("position", T.IntegerType(), False),
    ]
)


def catalog_frame(spark: SparkSession, metrics: list[MetricSpec]) -> DataFrame:
    rows = [
        (
            m.alias, m.type, m.display_name, m.description, m.owner, m.group_name,
            list(m.tags) if m.tags is not None else None,
            (m.numerator.alias, m.numerator.sql),
            (m.denominator.alias, m.denominator.sql) if m.denominator else None,
            i,
        )
        for i, m in enumerate(metrics)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def formula_table(catalog: DataFrame) -> DataFrame:
    """Unit formulas needed by a catalog DataFrame, one row per alias (J-8).

    First use wins (metric order, numerator before denominator)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    parts = catalog.select(F.col("position").alias("__m"), F.posexplode(F.array("numerator", "denominator")).alias("__p", "f")).where(F.col("f").isNotNull())
    w = Window.partitionBy(F.col("f.alias")).orderBy("__m", "__p")
    first = parts.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    return first.select(F.col("f.alias").alias("alias"), F.col("f.sql").alias("sql"))
