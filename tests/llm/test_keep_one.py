"""One document of each component, when an id has several texts."""

import pytest

from splitmill.llm import simhash

A, B, C = ("aa bb cc dd ee ff gg hh", "kk ll mm nn oo pp qq rr", "one two three four five six seven")


@pytest.mark.parametrize("data, want", [
    # unrelated texts under one id: both are the first of their component
    ([(1, A, "x"), (1, B, "x"), (2, A, "y"), (3, C, "y")], [(1, A, "x"), (1, B, "x"), (3, C, "y")]),
    # only one of the two stands for its component: the other one goes
    ([(1, B, "x"), (2, A, "x"), (2, B, "x"), (2, B, "y")], [(1, B, "x"), (2, A, "x")]),
    # equal texts under one id, null and empty alike, and rows without an id
    ([(1, A, "y"), (1, A, "x"), (1, A, "x"), (1, B, "z"), (None, A, "x"), (2, None, "x"), (2, "", "y")], [(1, A, "x"), (1, B, "z"), (None, A, "x"), (2, None, "x")]),
])
def test_one_row_of_each_component(spark, data, want):
    kept = simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string, source string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)
