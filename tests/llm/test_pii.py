"""Personal data: base spans against the contract's patterns, the random field against sums
over all labellings, its held-out accuracy, and odd texts."""

import hashlib
import itertools
import os
import random
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from splitmill.llm import crf, pii
from splitmill.llm import queries as Q

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


def plain(text):
    """The contract's base spans, by its own patterns."""
    text = text or ""
    ok = lambda s: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(s))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and ok(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def spans_text(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


@pytest.fixture(scope="module")
def model(spark):
    return pii.trained_on(spark.read.parquet(f"{SF}/documents.parquet"))


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    want = {}
    for i, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()):
        s = plain(x)
        want[i] = (*[sum(k == j for _, k, _ in s) for j in range(4)], hashlib.sha256(spans_text(s).encode()).hexdigest(), set(filter(None, spans_text(s).split(","))))
    got = Q.QUERIES["op11_pii"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        *counts, base = want[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == counts
        assert base <= set(r.spans.split(","))  # base spans stay


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    for alphabet in ("a@.b", "a.b@@. -", "12.", "0123456789 -", "+12 ().-", "4 -", "1.2.3+@a", "é1@.a\n"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(text) == plain(text), text
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "x4111111111111111y", "41111111111111114111111111111111"]
    for text in cards:
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_time_in_proportion():
    began = time.time()
    for run in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a." * 200_000, "+1(" * 100_000, "a@" * 100_000, "@a.b" * 100_000, "(at)" * 50_000):
        pii.base_spans(run)
    assert time.time() - began < 20


def test_sums_and_best_labels_are_those_of_all_labellings():
    rng = np.random.default_rng(4)
    k, lengths = 3, np.array([2, 4, 1, 3])
    n = int(lengths.sum())
    emit, moves, start = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    gold = rng.integers(0, k, n)

    def score(ys, e, m, s):
        return s[ys[0]] + sum(e[t, y] for t, y in enumerate(ys)) + sum(m[a, b] for a, b in zip(ys, ys[1:]))

    def value(e, m, s):
        total, at = 0.0, 0
        for z in lengths:
            part = e[at : at + z]
            total += score(gold[at : at + z], part, m, s) - np.log(sum(np.exp(score(ys, part, m, s)) for ys in itertools.product(range(k), repeat=z)))
            at += z
        return total

    got, d_emit, d_moves, d_start = crf.likelihood(emit, lengths, gold, moves, start)
    assert np.isclose(got, value(emit, moves, start))
    for x, d in ((emit, d_emit), (moves, d_moves), (start, d_start)):
        for at in np.ndindex(x.shape):
            x[at] += 1e-5
            up = value(emit, moves, start)
            x[at] -= 2e-5
            down = value(emit, moves, start)
            x[at] += 1e-5
            assert np.isclose(d[at], (up - down) / 2e-5, atol=1e-5)
    best, at = crf.viterbi(emit, lengths, moves, start), 0
    for z in lengths:
        part = emit[at : at + z]
        assert tuple(best[at : at + z]) == max(itertools.product(range(k), repeat=z), key=lambda ys: score(ys, part, moves, start))
        at += z


def test_held_out_accuracy(spark, model):
    lines = [x for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() for x in (t or "").split("\n") if len(x) > 20]
    rng, tagger = random.Random(9), pii.Tagger(model)
    hit = wrong = missed = 0
    for seed in range(10**6, 10**6 + 1500):  # seeds that no training row has
        words, labels = pii.labelled_line(rng.choice(lines), seed)
        for a, b in zip(labels, (pii.LABELS[x] for x in tagger.label([words])[0])):
            hit += a == b != "O"
            wrong += b != "O" and a != b
            missed += a != "O" and a != b
    assert hit / (hit + wrong) > 0.93 and hit / (hit + missed) > 0.9


def test_forms_that_the_patterns_miss(model):
    tagger = pii.Tagger(model)
    texts = [
        "write to jane.doe (at) example (dot) org or", "call (017) 555-7713 now", "it is 4111.1111.1111.1111 there", "from 2001:db8::8a2e:370:7334 came", "his number 078-05-1120 is",
        "on 2024-05-17 at 12:30:45 we paid 1,299.00 for version 2.10.4 (2019) and 10-20 more of 3:2", "nothing here at all",
    ]
    got = [[(pii.KINDS[k], t[a:b]) for a, k, b, _ in s] for t, s in zip(texts, tagger.spans(texts))]
    assert got == [
        [("email", "jane.doe (at) example (dot) org")], [("phone", "(017) 555-7713")], [("card", "4111.1111.1111.1111")], [("ip", "2001:db8::8a2e:370:7334")], [("id", "078-05-1120")], [], [],
    ]


def test_skipped_lines_change_nothing(spark, model):
    texts = [t or "" for (t,) in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    quick, whole = pii.Tagger(model), pii.Tagger(model)
    assert not quick.every_line
    whole.every_line = True
    assert quick.spans(texts) == whole.spans(texts)


def test_odd_rows(spark, model):
    long = "word " * 200_000 + "a.b@example.com " + "x" * 100_000 + " 10.0.0.1\n" + "12 " * 20_000
    data = [(1, None), (2, ""), (3, "\n\n"), (4, "a@b.co"), (4, "a@b.co"), (None, "é😀 +1 (017) 555-7713, a@b.co"), (5, long)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("pii_spans", F.lit("old")).withColumn("a.b", F.lit(1)).withColumn("_masked", F.lit(2))
    out = pii.find_pii(df, model)
    assert set(out.columns) == {"doc_id", "a.b", "_masked", "pii_spans"}
    base = lambda spans: [(s.start, pii.KINDS.index(s.kind), s.end) for s in spans if s.base]
    assert sorted(((r.doc_id, base(r.pii_spans)) for r in out.collect()), key=repr) == sorted(((i, plain(t)) for i, t in data), key=repr)
    masked = pii.mask_pii(df, model)
    assert masked.columns == df.columns
    texts = {(r.doc_id, r.text) for r in masked.where("doc_id is null or doc_id < 5").collect()}
    assert texts == {(1, None), (2, ""), (3, "\n\n"), (4, "[email]"), (None, "é😀 [phone], [email]")}
    none = df.where("doc_id > 99")
    assert pii.find_pii(none, model).count() == pii.mask_pii(none, model).count() == 0


def test_labelled_table_is_small_and_whatever_the_documents(spark):
    empty = spark.createDataFrame([], "text string")
    rows = pii.labelled_table(empty, lines=40).collect()
    assert 0 < len(rows) <= 40 and all(len(r.words) == len(r.labels) for r in rows)
    docs = spark.createDataFrame([("the same line of some words here\n" * 3,)] * 50, "text string")
    assert pii.labelled_table(docs, lines=40).count() <= 40
    with pytest.raises(ValueError):
        pii.train(pii.labelled_table(docs, lines=40), most=5)
