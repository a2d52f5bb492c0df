"""Fill-in-the-middle against a plain version, and its skip list against sums."""

import hashlib
import os
import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from splitmill.llm import fim
from splitmill.llm import queries as Q

SF = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")


def plain(i, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return i, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "no line feed"), (6, "a\r\nb\x0bc d\n"), (7, "é\n😀\nñ"), (8, "has <P> mark\nx"), (9, "<\nS>\n<"), (9, "<\nS>\n<"),
    (None, "null id\nx\n"), (-5, "neg\n" * 9), (10, "line\n" * 50_000 + "é" * 100_000),
]


def made(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=repr)


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(*r[:5], sha(r[5]), sha(x or "")) for i, x in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()) for r in [plain(i, x)]]
    got = [tuple(r) for r in Q.QUERIES["op13_fill_in_middle"](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got} >= {"spm", "psm"}


def test_odd_texts(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n", F.lit("mine")).withColumn("a.b", F.lit(1)).withColumn("_made", F.lit(2))
    for percent, spm in ((100, 50), (40, 0), (0, 50), (100, 100)):
        out = fim.fill_in_middle(df, percent=percent, spm=spm)
        assert made(out) == sorted((plain(i, x, percent, spm) for i, x in ODD), key=repr)
        assert {"a.b", "_made", "text"} <= set(out.columns) and out.columns.count("n") == 1
        lost = out.where(fim.restored(F.col("output"), F.col("form")) != F.coalesce("text", F.lit("")))
        assert lost.count() == 0
    assert fim.fill_in_middle(df.where("doc_id > 99")).count() == 0


def test_places_are_sums_of_widths():
    rng = random.Random(1)
    for _ in range(300):
        widths = [rng.randint(1, 9) for _ in range(rng.choice([0, 1, 2, 3, 40, 700]))]
        lanes = fim.SkipList(widths)
        for rank in {0, len(widths), *(rng.randint(0, len(widths)) for _ in range(20))}:
            assert lanes.place(rank) == sum(widths[:rank])
        for units, chars, _ in lanes.lanes:
            assert units.sum() == len(widths) and chars.sum() == sum(widths)
    top = fim.SkipList([1] * 100_000).lanes
    assert len(top) > 8 and len(top[-1][0]) < 64  # lanes thin out
