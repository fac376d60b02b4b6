"""Registers to a logarithmic base: estimates, merging and joint estimates within the stated error."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import distinct

SCHEMA = "day date, graph string, predicate string, subject string, level string, _k int"


def test_stated_error():
    assert abs(distinct.relative_error(4096, 1.1) * 64 - 1.0) < 0.01
    assert 1.03 < distinct.relative_error(4096, 2.0) * 64 < 1.06


@pytest.mark.parametrize("n", [1, 10, 1000, 50_000])
@pytest.mark.parametrize("base", [1.1, 2.0])
def test_sizes(spark, n, base):
    df = spark.range(n).select(F.lit("g").alias("g"), F.concat(F.lit("id"), "id").alias("e"))
    sized = distinct.estimates(distinct.sketch(df.union(df), ["g"], "e", 1024, base), ["g"], 1024, base).collect()[0]["n_distinct"]
    assert abs(sized - n) <= max(1, 4 * distinct.relative_error(1024, base) * n)


def test_partials_merge_to_the_whole(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("part"), F.concat(F.lit("s"), F.col("id") % 1700).alias("e"))
    whole = distinct.sketch(df.select("e"), [], "e")
    parts = [distinct.sketch(df.where(F.col("part") == k).select("e"), [], "e") for k in range(3)]
    order = lambda d: sorted(tuple(r) for r in d.select("_reg", "_k").collect())
    assert order(distinct.merge(*parts)) == order(whole)


def test_all_combinations(spark):
    day = [dt.date(2025, 3, 1), dt.date(2025, 3, 2), None]
    rows = [(day[i % 3], "" if i % 2 else f"g{i % 5}", f"p{i % 4}", None if i % 50 == 0 else f"s{i % 800}", "x", 1) for i in range(5000)]
    got = distinct.all_combinations(spark.createDataFrame(rows, SCHEMA), ["day", "graph", "predicate"], "subject").collect()
    true: dict[tuple, set] = {}
    names = ["day", "graph", "predicate"]
    for mask in range(8):
        keep = [n for i, n in enumerate(names) if mask >> i & 1]
        for r in rows:
            if r[3] is not None:
                key = ("+".join(keep) or "all", *[r[i] if names[i] in keep else None for i in range(3)])
                true.setdefault(key, set()).add(r[3])
    have = {(r["level"], r["day"], r["graph"], r["predicate"]): r["n_distinct"] for r in got}
    assert len(have) == len(got) and set(have) == set(true)
    for k, s in true.items():
        assert abs(have[k] - len(s)) <= max(1.5, 4 * 0.016 * len(s)), k


def test_joint_estimates(spark):
    first, second = dt.date(2025, 3, 1), dt.date(2025, 3, 2)
    rows = [(first, f"a{i}") for i in range(9000)] + [(second, f"a{i}") for i in range(6000, 16000)] + [(None, "z")]
    got = {r["day"]: r for r in distinct.day_overlaps(spark.createDataFrame(rows, "d date, s string"), F.col("d"), "s").collect()}
    r = got[first]
    assert abs(r["n_both"] - 3000) < 450 and abs(r["n_union"] - 16000) < 800 and abs(r["jaccard"] - 3000 / 16000) < 0.03
    assert got[second]["n_b"] < 1e-3 and got[second]["n_both"] < 1e-3
    assert set(got) == {first, second, first - dt.timedelta(days=1)}


def test_same_and_disjoint_sets():
    rng = np.random.default_rng(1)
    k = np.maximum.accumulate(np.ones(1))
    del k
    m, base = 4096, 1.1

    def registers(n):
        out = np.zeros(m, int)
        np.maximum.at(out, rng.integers(0, m, n), np.ceil(-np.log(rng.random(n)) / np.log(base)).astype(int))
        return out

    a, b = registers(20_000), registers(20_000)
    for x, y, want in ((a, a, 20_000), (a, b, 0)):
        ones, starts = np.ones(m), np.array([0])
        size = np.array([20_000.0])
        rates, covariance = distinct.joint_rates(x, y, ones, starts, size, size, m, base)
        assert abs(rates[2, 0] * m - want) < 900 and rates.min() >= 0 and covariance.shape == (3, 3, 1)


def test_errors_hold_and_rates_are_joint(spark):
    """Over many pairs, the truth lies within two stated errors about as often as it should."""
    rows, truth = [], {}
    rng = np.random.default_rng(4)
    for k in range(60):
        both, only_a, only_b = rng.integers(200, 6000, 3).tolist()
        truth[2 * k] = (both, both + only_a + only_b)
        rows += [(2 * k, f"{k}c{i}") for i in range(both)] + [(2 * k + 1, f"{k}c{i}") for i in range(both)]
        rows += [(2 * k, f"{k}a{i}") for i in range(only_a)] + [(2 * k + 1, f"{k}b{i}") for i in range(only_b)]
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"g": [r[0] for r in rows], "s": [r[1] for r in rows]}))
    registers = distinct.sketch(df, ["g"], "s", 1024)
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(60)] + [(0, 999), (None, 1)], "a long, b long")
    got = {r["a"]: r for r in distinct.overlaps(registers, "g", pairs, 1024).collect() if r["b"] != 999}
    assert len(got) == 60
    within = [abs(got[a]["n_both"] - both) <= 2 * got[a]["both_error"] for a, (both, _) in truth.items()]
    united = [abs(got[a]["n_union"] - union) <= 2 * got[a]["union_error"] for a, (_, union) in truth.items()]
    assert sum(within) >= 52 and sum(united) >= 52
    assert all(r["both_error"] < 0.5 * r["n_a"] and r["jaccard_error"] > 0 for r in got.values())


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert distinct.all_combinations(empty, ["day", "graph"], "subject").count() == 0
    assert distinct.day_overlaps(empty, F.col("day"), "subject").count() == 0
    with pytest.raises(ValueError):
        distinct.sketch(empty, [], "subject", 1000)
