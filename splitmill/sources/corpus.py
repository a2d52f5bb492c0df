"""Text corpus scans (S-14..S-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders never indexed.
SKIP_DIRS = ["__pycache__", ".git", ".pytest_cache", "node_modules", ".venv", "venv", ".env", "dist", "build", ".uv", ".streamlit"]


def read_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """One row per file (``path, text``), recursive, filtered by extension."""
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}" if len(extensions) > 1 else f"*{extensions[0]}"
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return df.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def indexable(df: DataFrame, path_col: str = "path", length_col: str | None = None, text_col: str = "text",
              max_chars: int | None = None) -> DataFrame:
    """Drop files under a skipped folder; with ``max_chars`` also longer texts (no limit by default)."""
    skip = "(^|/)(" + "|".join(d.replace(".", r"\.") for d in SKIP_DIRS) + ")(/|$)"
    kept = df.where(~F.col(path_col).rlike(skip))
    if max_chars is None:
        return kept
    n = F.col(length_col) if length_col else F.length(text_col)
    return kept.where(n <= max_chars)


def metric_documents(catalog: DataFrame) -> DataFrame:
    """Searchable text per metric definition with its metadata."""
    text = F.concat_ws(
        "\n",
        F.format_string("Metric: %s (%s)", F.col("metric_name"), F.col("metric_type")),
        F.concat(F.lit("Name: "), F.coalesce(F.col("metric_display_name"), F.col("metric_name"))),
        F.concat(F.lit("Description: "), F.coalesce(F.col("description"), F.lit(""))),
        F.concat(F.lit("Owner: "), F.coalesce(F.col("owner"), F.lit(""))),
        F.concat(F.lit("Group: "), F.coalesce(F.col("metric_group"), F.lit(""))),
        F.concat(F.lit("Tags: "), F.array_join(F.coalesce(F.col("tags"), F.array().cast("array<string>")), ", ")),
        F.concat(F.lit("Numerator: "), F.col("numerator.sql")),
        F.concat(F.lit("Denominator: "), F.coalesce(F.col("denominator.sql"), F.lit("-"))),
    )
    meta = F.create_map(
        F.lit("metric_name"), F.col("metric_name"), F.lit("metric_type"), F.col("metric_type"),
        F.lit("metric_group"), F.coalesce(F.col("metric_group"), F.lit("")), F.lit("owner"), F.coalesce(F.col("owner"), F.lit("")),
    )
    return catalog.select(F.col("metric_name").alias("doc_id"), text.alias("document"), meta.alias("metadata"))
