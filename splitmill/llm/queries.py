"""Registered queries of the text operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontam, fim, oracle_sql, pii, quality, records, secrets, sharding, simhash, substring, urls
from .common import shared_folder

URL_RULES = [("net/", True), ("example.net/en/", False), ("example.com/de/", True), ("org/fr/", False)]
SHARDS = [f"shard-{k:03d}" for k in range(100)]
OWN_CONVERSATION = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(text) -> F.Column:
    return F.sha2(text, 256)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), size=3, most=3)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, size=50).select("doc_id", "n_words", "n_removed", _sha(F.col("kept")).alias("kept_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ranks = P.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = bpe.encode_decode(docs, ranks, P.PATTERN)
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        _sha(F.col("decoded")).alias("decoded_sha256"),
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter(spans, lambda s: s["kind"].isin(*secrets.BASE))
    return secrets.find_secrets(docs, ["doc_id"]).select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in secrets.BASE],
        _sha(secrets.spans_text(base)).alias("base_sha256"),
        secrets.spans_text(spans).alias("spans"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"], SHARDS).select("doc_id", "slot", "shard")


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = records.write_records(docs, shared_folder(spark, "token-records"), P.path("word_bpe_49k.json"), end=1)
    index = records.starts(index).withColumnRenamed("id", "doc_id")
    read = records.read_records(index, "doc_id", "start")
    return read.select("doc_id", "start", (F.octet_length("tokens") / 4).cast("bigint").alias("n_tokens"), F.crc32("tokens").alias("ids_crc32"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", OWN_CONVERSATION), (-7, 1, "assistant", OWN_CONVERSATION)], rows.schema)
    made = chat.format_conversations(rows.unionByName(own)).withColumn("turns", chat.parse(F.col("formatted")))
    said = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        _sha(all_turns).alias("turns_sha256"),
        F.length(said).cast("bigint").alias("loss_chars"),
        _sha(said).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        _sha(F.array_join("hit_items", ",")).alias("items_sha256"),
        "contaminated",
    )


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return pii.find_pii(docs, pii.trained_on(docs)).select(
        "doc_id", *[of(kind).alias(f"n_{kind}") for kind in pii.BASE], _sha(pii.spans_text(base)).alias("base_sha256"), pii.spans_text(spans).alias("spans")
    )


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = align.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(_sha(F.col("groups")))
    return made.withColumn("groups_sha256", digest).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fim.fill_in_middle(docs, seed=7, percent=100, spm=50)
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha(F.col("output")).alias("output_sha256"), _sha(back).alias("restored_sha256"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_url_filters": op2_url_filters,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_secrets": op5_secrets,
    "op6_quality_rules": op6_quality_rules,
    "op7_sharding": op7_sharding,
    "op8_records": op8_records,
    "op9_chat": op9_chat,
    "op10_decontaminate": op10_decontaminate,
    "op11_pii": op11_pii,
    "op12_align": op12_align,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE: dict[str, str] = {
    "op2_url_filters": oracle_sql.url_filters(URL_RULES),
    "op3_substring_dedup": oracle_sql.SUBSTRING,
    "op6_quality_rules": oracle_sql.quality(),
    "op9_chat": oracle_sql.chat(OWN_CONVERSATION),
    "op10_decontaminate": oracle_sql.DECONTAMINATE,
    "op13_fill_in_middle": oracle_sql.FILL_IN_MIDDLE,
}
