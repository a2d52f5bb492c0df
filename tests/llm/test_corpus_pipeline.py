"""The pipeline, op6's kept and op7's shards against plain Python versions."""

import base64
import hashlib
import re
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from splitmill.llm import bpe, quality, secrets, sharding
from splitmill.llm import queries as Q

from . import brute
from .test_contracts import SF, table

LINE = "Notice: " + " ".join(f"all rights{k} reserved" for k in range(12))


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    """The small tables as one host, with a long line in 25 texts, keys, a copy and a null."""
    folder = tmp_path_factory.mktemp("sf")
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    for k, d in enumerate(docs):
        key = "-----BEGIN PRIVATE KEY-----\nAbCd\n-----END PRIVATE KEY-----" if k % 7 == 0 else "no key"
        d["text"] = f"{LINE}\n{d['text']}\n{key}" if k < 25 else d["text"]
    docs += [docs[30] | {"doc_id": 10**6}, {"doc_id": 10**6 + 1, "text": None, "lang": "en"}, {"doc_id": 10**6 + 2, "text": LINE + "\nshort", "lang": "en"}]
    docs = [d | {"source": "h", "n_chars": len(d["text"] or "")} for d in docs]
    pq.write_table(pa.Table.from_pylist(docs), folder / "documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/benchmark.parquet"), folder / "benchmark.parquet")
    return str(folder)


def normal(line):
    return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower())).strip(" ")


def clean(docs):
    """(id, cleaned text) of the kept documents, all of one host."""
    holders = defaultdict(set)
    for _, t in docs:
        for x in (t or "").split("\n"):
            if brute.WORD.search(x):
                holders[normal(x)].add(t)
    out = []
    for (i, t), row in zip(docs, (brute.quality([d])[0] for d in docs)):
        lines = (t or "").split("\n")
        gone = [x for x in lines if len(holders.get(normal(x), ())) >= 20]
        lost = sum(len(brute.WORD.findall(x)) for x in gone)
        if not row[-1] and row[1] - lost >= 10 and lost <= 0.7 * row[1]:
            out.append((i, "\n".join(x for x in lines if x not in gone)))
    return out


def masked(text):
    out, at = "", 0
    for a, kind, b in secrets.text_spans(text.encode()):
        out, at = out + (text[at:a] + f"[{kind}]" if a >= at else ""), max(at, b)
    return out + text[at:]


def test_run(spark, sf):
    import public_tokenizers as P
    import tiktoken

    given = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    docs = clean([(d["doc_id"], d["text"]) for d in given])
    kept = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("kept")
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, _ in docs}
    assert not any(LINE in t for _, t in docs) and 10**6 + 2 not in dict(docs)
    firsts = {i for i, _, c in brute.simhash(docs) if i == c}
    docs = [(i, t) for i, t in docs if i in firsts]
    items = [(d["item_id"], d["text"]) for d in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    bad = {r[0] for r in brute.decontaminate(docs, items) if r[-1]}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: enc.encode_ordinary(masked(t)) for i, t in docs if i not in bad}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want) > 10
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_encode_notices_wrong_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens > 0 for r in corpus_pipeline.encode(spark, docs, "").collect()} == {1: True, 2: False}
    right = bpe.encode
    wrong = lambda rows, ranks, pattern: bpe.decode(right(rows, ranks, pattern).withColumn("ids", F.slice("ids", 1, 1)), ranks)
    monkeypatch.setattr(bpe, "encode_decode", wrong)
    with pytest.raises(Exception, match="does not survive"):
        corpus_pipeline.encode(spark, docs, "").collect()


def test_op7(spark):
    filled = sharding.fill_table(Q.SHARDS, sharding.TABLE_SIZE)
    slots = {i: int(hashlib.md5(f"={i}".encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE for (i,) in table("documents", "doc_id")}
    got = Q.QUERIES["op7_sharding"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((i, s, Q.SHARDS[filled[s]]) for i, s in slots.items())
