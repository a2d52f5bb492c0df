"""Stored state: a snapshot in buckets and a log, against the rules applied one by one."""

import random

import pytest

from splitmill.sources import state as ST

FIELDS = "id long, name string, score double"
CHANGE = "id long, op string, n long, name string, score double, extra string, clear array<string>"


def rows(df):
    return sorted(map(tuple, df.collect()))


def plain(state, batch):
    for i, op, _, name, score, _, clear in sorted(batch, key=lambda r: r[2]):
        if op == "create":
            state[i] = (i, name, score)
        elif op == "delete":
            state.pop(i, None)
        elif i in state:
            _, a, b = state[i]
            clear = clear or []
            state[i] = (i, name if name is not None or "name" in clear else a, score if score is not None or "score" in clear else b)


def random_batch(draw, size, keys=40):
    # one key holds a third of all changes
    key = lambda: 3 if draw.random() < 0.33 else draw.randrange(keys)
    out = []
    for n in range(size):
        op = draw.choices(ST.OPS, [2, 8, 1])[0]
        out.append((key(), op, n, draw.choice([None, f"n{n}"]), draw.choice([None, n / 2]), "ignored", draw.choice([None, [], ["name"], ["score", "other"]])))
    return out


def test_batches_follow_the_rules(spark, tmp_path):
    draw, path = random.Random(11), str(tmp_path / "s")
    first = [(k, f"first {k}", float(k)) for k in range(0, 30)]
    ST.create_state(spark.createDataFrame(first, FIELDS), path, "id", buckets=4)
    want = {r[0]: r for r in first}
    for step, size in enumerate([60, 1, 0, 80, 40]):
        batch = random_batch(draw, size)
        plain(want, batch)
        ST.append_changes(spark.createDataFrame(batch, CHANGE), path, ["n"], set_fields="clear")
        key = lambda r: (r[0], str(r))
        assert sorted(map(tuple, ST.read_state(spark, path).collect()), key=key) == sorted(want.values(), key=key)
        if step in (1, 3):
            ST.compact_state(spark, path)
            assert sorted(map(tuple, ST.read_state(spark, path).collect()), key=key) == sorted(want.values(), key=key)


def test_compaction_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "s")
    ST.create_state(spark.createDataFrame([(k, "a", 1.0) for k in range(50)], FIELDS), path, "id", buckets=8)
    assert ST.compact_state(spark, path) == []
    ST.append_changes(spark.createDataFrame([(7, "set", 1, "b", None, None, None)], CHANGE), path, ["n"])
    plan = ST.read_state(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 3  # still buckets, the touched one, its log
    (bucket,) = ST.compact_state(spark, path)
    runs = sorted((tmp_path / "s" / "snapshot").iterdir(), key=lambda p: p.stat().st_mtime)
    assert len(runs) == 2 and [p.name for p in runs[1].iterdir() if p.is_dir()] == [f"bucket={bucket}"]
    assert ST.read_state(spark, path).where("name = 'b'").count() == 1
    assert ST.compact_state(spark, path) == []


def test_bucket_that_loses_all_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    ST.create_state(spark.createDataFrame([(1, "a", 1.0)], FIELDS), path, "id", buckets=2)
    ST.append_changes(spark.createDataFrame([(1, "delete", 1, None, None, None, None), (1, "set", 2, "x", None, None, None), (9, "set", 1, "x", None, None, None)], CHANGE), path, ["n"])
    assert rows(ST.read_state(spark, path)) == []
    ST.compact_state(spark, path)
    assert rows(ST.read_state(spark, path)) == []
    ST.append_changes(spark.createDataFrame([(1, "create", 1, "again", None, None, None)], CHANGE), path, ["n"])
    assert rows(ST.read_state(spark, path)) == [(1, "again", None)]


def test_uncommitted_batch_and_bad_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    ST.create_state(spark.createDataFrame([], FIELDS), path, "id")
    ST.append_changes(spark.createDataFrame([(1, "create", 1, "a", 1.0, None, None)], CHANGE), path, ["n"])
    for bad in [(2, "upsert", 1, "b", None, None, None), (None, "create", 1, "b", None, None, None)]:
        with pytest.raises(Exception):
            ST.append_changes(spark.createDataFrame([(3, "create", 0, "c", None, None, None), bad], CHANGE), path, ["n"])
        assert rows(ST.read_state(spark, path)) == [(1, "a", 1.0)]
    # files of a batch whose writer was lost before the commit
    spark.createDataFrame([(5, "x")], "id long, name string").write.parquet(f"{path}/log/lost/bucket=0")
    assert rows(ST.read_state(spark, path)) == [(1, "a", 1.0)]
