"""Secret scans with an incremental ledger of scanned contents.

Every version of every path is addressed by the SHA-256 of its content.  The ledger is a
Parquet table with one row per (blob, rule version) scanned so far and the spans found.
A scan takes only the pairs that the ledger lacks, reads one copy of each such blob, adds
its rows to the ledger, and then joins findings back to all paths and versions that hold
the blob.  Texts move once, and only those of blobs to be scanned."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_worker_path
from .common import column, free_name, shared_folder, staged, utf8, with_arrow

RULES_VERSION = "3"

# The base rules, then those that this scan adds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
PRIVATE_KEY = r"-----BEGIN ((?:[A-Z]+ ){0,3}PRIVATE KEY)-----"
# Lines of a key without its end: base64, or a header of an encrypted key.  A line break
# may also stand as \\n, as in JSON.
_BREAK = r"(?:[\x20\t]*+(?:\r\n|\r|\n|(?:\\r)?\\n))++[\x20\t]*+"
KEY_LINES = rf"(?:{_BREAK}(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/]++={{0,2}}+)(?=[\x20\t]*+(?:[\r\n\\\"',]|\Z)))*+"
WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"

KINDS = ("assign", "access", "hex", "private_key", "web_token")
BASE = KINDS[:3]
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

SPAN = "struct<kind:string,start:int,end:int>"


def key_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of private keys: from BEGIN to the END of the same name, if it comes
    before another BEGIN, else over the key's lines that follow."""
    begins = list(re.finditer(PRIVATE_KEY, text))
    found = []
    for m, after in zip(begins, [*[n.start() for n in begins[1:]], len(text)]):
        close = f"-----END {m[1]}-----"
        at = text.find(close, m.end(), after)
        found.append((m.start(), at + len(close) if at >= 0 else re.compile(KEY_LINES).match(text, m.end(), after).end()))
    return found


def text_spans(raw: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start, then kind in the order of KINDS."""
    lower = raw.lower()
    text = raw.decode()
    found = []
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text)]
    found += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    if b"PRIVATE KEY-----" in raw:
        found += [(a, 3, b) for a, b in key_spans(text)]
    if b"eyJ" in raw:
        found += [(m.start(), 4, m.end()) for m in re.finditer(WEB_TOKEN, text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def _scan(blobs: DataFrame) -> DataFrame:
    """(blob, spans) of (blob, text)."""

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def work(names: pa.Array, texts: pa.Array):
            rows = [[{"kind": k, "start": a, "end": b} for a, k, b in text_spans(t)] for t in utf8(texts)]
            return [names, pa.array(rows, kind)]

        return work

    return with_arrow(blobs, [F.col("blob"), F.col("text")], f"blob string, spans array<{SPAN}>", make)


def blob_of(text: Column) -> Column:
    """Content address; null counts as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def update_ledger(docs: DataFrame, ledger: str, key_cols: list[str], text_col: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """Scans the blobs of ``docs`` that ``ledger`` (a folder) lacks under ``version``, adds
    them to it and returns its rows of that version: (blob, version, spans).

    ``key_cols`` tell rows apart well enough to pick one copy of each blob; rows that
    agree in them and in the content are scanned more than once but written once.
    Concurrent updates of one ledger folder may scan a blob twice; ``findings`` is not
    affected, as it takes one row per blob."""
    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    text = F.coalesce(column(docs, text_col), F.lit(""))
    rows = docs.select(blob_of(column(docs, text_col)).alias("blob"), F.xxhash64(*[column(docs, c) for c in key_cols]).alias("copy"), text.alias("text"))
    wanted = rows.groupBy("blob").agg(F.min("copy").alias("copy"))
    if there:
        done = spark.read.parquet(ledger).where(F.col("version") == version).select("blob")
        wanted = wanted.join(done, "blob", "left_anti")
    wanted = staged(wanted, "secrets-unseen")
    # (blob, copy) rather than blob alone: a blob that many rows share is not one hot key
    fresh = rows.join(wanted, ["blob", "copy"], "left_semi").select("blob", "text")
    found = _scan(fresh).dropDuplicates(["blob"]).withColumn("version", F.lit(version))
    found.select("blob", "version", "spans").write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger).where(F.col("version") == version)


def find_secrets(docs: DataFrame, key_cols: list[str], ledger: str | None = None, text_col: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """``docs`` without its text, with ``blob`` and ``secret_spans`` (array of kind, start,
    end; code points, end exclusive; empty if there are none) for every row: every path
    and version of a blob gets the blob's findings.  Columns of these names are replaced.
    Null text is empty; an empty table gives an empty result; equal rows stay."""
    known = update_ledger(docs, ledger or shared_folder(docs.sparkSession, "secrets-ledger"), key_cols, text_col, version)
    key, found = free_name(docs, "_blob"), free_name(docs, "_spans")
    hits = known.where(F.size("spans") > 0).dropDuplicates(["blob"]).select(F.col("blob").alias(key), F.col("spans").alias(found))
    kept = [column(docs, c).alias(c) for c in docs.columns if c not in (text_col, "blob", "secret_spans")]
    rows = docs.select(*kept, blob_of(column(docs, text_col)).alias("blob"))
    out = rows.join(hits, F.col("blob") == F.col(key), "left")
    return out.withColumn("secret_spans", F.coalesce(found, F.expr(f"cast(array() as array<{SPAN}>)"))).drop(key, found)


def masked(text: str, spans: list[dict]) -> str:
    """``text`` with its spans (by start, then kind) replaced; one pass over both."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], "[", s["kind"], "]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, key_cols: list[str], ledger: str | None = None, text_col: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]`` in the text (of overlapping spans the
    first by start, then kind; the rest of a later one is masked too).  Documents without
    findings, null texts included, stay as they are.  All columns are kept."""
    ensure_worker_path(docs.sparkSession)
    known = update_ledger(docs, ledger or shared_folder(docs.sparkSession, "secrets-ledger"), key_cols, text_col, version)
    blob, spans = free_name(docs, "_blob"), free_name(docs, "_spans")
    hits = known.where(F.size("spans") > 0).dropDuplicates(["blob"]).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    text, made = column(docs, text_col), free_name(docs, "_masked")
    marked = docs.join(hits, blob_of(text) == F.col(blob), "left")

    def work(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = (None if t is None else masked(t, s) if s else t for t, s in zip(texts.to_pylist(), found.to_pylist()))
        return pa.array(rows, pa.string())

    rows = marked.withColumn(made, F.arrow_udf(work, "string")(text, F.col(spans)))
    return rows.select(*[column(rows, made if c == text_col else c).alias(c) for c in docs.columns])


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
