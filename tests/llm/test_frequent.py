"""Lossy counting: bounds hold for any order of rows, splits and skew."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import frequent

SCHEMA = "object string, predicate string, count int, value string"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=400), st.integers(2, 40), st.integers(1, 50))
def test_counts_are_within_their_deltas(values, width, batch):
    counter = frequent.LossyCounter(width)
    texts = [None if v == 30 else str(v) for v in values]
    for at in range(0, len(texts), batch):
        counter.add(pa.array(texts[at : at + batch], pa.string()))
    counter.prune()
    true = Counter(t for t in texts if t is not None)
    assert counter.rows == len(texts)
    for value, (n, delta) in counter.entries.items():
        assert n <= true[value] <= n + delta and delta <= counter.bucket
    for value, n in true.items():
        assert value in counter.entries or n <= counter.bucket


def rows(n: int = 6000) -> list[tuple]:
    rng = random.Random(3)
    out = []
    for i in range(n):
        value = "hot" if i % 3 == 0 else f"v{rng.randrange(40)}" if i % 5 == 0 else f"only {i} " + "x" * (i % 3)
        out.append((None if i % 97 == 0 else value, rng.choice(["", "p", "q"]), 1, "clash"))
    return out


def test_intervals_hold_and_nothing_frequent_is_missed(spark):
    data = rows()
    for parts in (1, 7):
        df = spark.createDataFrame(data, SCHEMA).repartition(parts)
        got = {(r["field"], r["value"]): r for r in frequent.frequent_values(df, ["object", "predicate"], 0.02, 0.004).collect()}
        for field, i in (("object", 0), ("predicate", 1)):
            true = Counter(r[i] for r in data if r[i] is not None)
            assert {v for v, n in true.items() if n >= 0.02 * len(data)} <= {v for f, v in got if f == field}
            for (f, v), r in got.items():
                if f == field:
                    assert r["at_least"] <= true[v] <= r["at_most"] and true[v] >= (0.02 - 0.004) * len(data)
                    assert r["at_most"] - r["at_least"] <= 0.004 * len(data) and r["n_rows"] == len(data)


def test_empty_and_null_columns(spark):
    assert frequent.frequent_values(spark.createDataFrame([], SCHEMA), ["object"], 0.1).count() == 0
    nulls = spark.createDataFrame([(None, "", 1, "x")] * 5, SCHEMA)
    assert [(r["field"], r["value"]) for r in frequent.frequent_values(nulls, ["object", "predicate"], 0.1).collect()] == [("predicate", "")]
    long = spark.createDataFrame([("y" * 200_000, "p", 1, "x")] * 3, SCHEMA)
    assert frequent.frequent_values(long, ["object"], 0.5).collect()[0]["at_least"] == 3
