"""From raw documents to token ids: quality rules, near-duplicates, benchmark
decontamination, secrets, byte-level BPE.  Each stage reads what the one before kept.

All stages but the last return the columns of ``documents``; n_chars follows the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitmill.llm import bpe, decontam, quality, secrets, simhash
from splitmill.llm.common import staged


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their boilerplate lines."""
    return _sized(quality.clean(docs, host_col="source"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (three-word shingles, at most 3 bits)."""
    return simhash.keep_one(docs, size=3, most=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by their kind."""
    return _sized(secrets.mask_secrets(docs, ["doc_id"]))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document; the ids are decoded and compared with its
    text, and a difference is an error."""
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode_decode(docs.select("doc_id", "text"), ranks, P.PATTERN)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    lost = F.raise_error(F.lit("a text does not survive its encoding"))
    ids = ids.withColumn("ids", F.when(same, F.col("ids")).otherwise(lost))
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("encode", encode),
]

# SQL has no SimHash components and no byte-level BPE: tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
