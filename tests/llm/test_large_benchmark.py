"""Large benchmarks: shared windows, sets that go one after the other, and the plan."""

import random

from splitmill.llm import decontam

from . import brute


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shared_window(spark):
    shared = "a b c d e f g h i j"
    bench = spark.createDataFrame([(k, f"{shared} own{k}") for k in range(300)], "item_id long, text string")
    assert "items" not in decontam.test_windows(bench).columns
    docs = spark.createDataFrame([(1, f"x {shared} y"), (2, f"{shared} own7"), (3, "none")], "doc_id long, text string")
    rows = lambda **how: sorted(map(tuple, decontam.find_contamination(docs, bench, **how).drop("text").collect()))
    want = rows()
    assert [len(r[3]) for r in want] == [300, 300, 0]
    assert [len(r[4]) for r in want] == [1, 2, 0]
    assert rows(most_bytes=20_000) == want


def test_many_windows(spark):
    """Some 16,000 windows: the documents are not shuffled, and the plan does not print the set."""
    draw = random.Random(5)
    item = lambda n: " ".join(f"w{draw.randrange(3000)}" for _ in range(n))
    items = [(k, item(draw.choice([4, 10, 40]))) for k in range(1500)] + [(2000, "same words"), (2001, "same words")]
    texts = [f"{item(30)} {items[draw.randrange(1500)][1]}, {item(20)}" for _ in range(150)] + ["", None, "same words", "Same-Words " * 500]
    docs = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    given = spark.createDataFrame(docs, "doc_id long, text string")
    for most_bytes in (decontam.BYTES, 2 << 20):
        out = decontam.find_contamination(given, bench, most_bytes=most_bytes)
        assert "Exchange" not in plan(out) and len(plan(out)) < 100_000
        got = {r.doc_id: (r.n_words, r.n_hit, r.hit_items, r.contaminated) for r in out.collect()}
        want = {r[0]: r for r in brute.decontaminate(docs, items)}
        assert {k: (v[0], v[1], len(v[2]), v[3]) for k, v in got.items()} == {k: (r[1], r[2], r[3], r[5]) for k, r in want.items()}
        assert [x for x in got[152][2]] == ["2000", "2001"]
