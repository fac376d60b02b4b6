"""Problems 1, 4 and 5 on small fixtures against plain Python."""

from __future__ import annotations

import csv
import datetime as dt
import io
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.operators import rejects, skew, wide

csv.field_size_limit(10**7)
LINES = "raw_id long, origin string, received_at timestamp, raw string"


def expected_reason(raw: str | None) -> str | None:
    """Judge a record one character at a time."""
    if raw is None:
        return "columns"
    body = raw[:-1] if raw.endswith("\r") else raw
    fields, at = [], 0
    while True:
        if body[at : at + 1] == '"':
            end, text = at + 1, ""
            while True:
                if end >= len(body):
                    return "quoting"
                if body[end] == '"':
                    if body[end + 1 : end + 2] == '"':
                        text, end = text + '"', end + 2
                        continue
                    break
                text, end = text + body[end], end + 1
            at = end + 1
            if at < len(body) and body[at] != ",":
                return "quoting"
        else:
            end = at
            while end < len(body) and body[end] != ",":
                if body[end] in '"\r\n':
                    return "quoting"
                end += 1
            text, at = body[at:end], end
        fields.append(text)
        if at >= len(body):
            break
        at += 1
    if len(fields) != 5:
        return "columns"
    ranges = {0: (0, 10), 2: (1, 2**31 - 1), 3: (0, 2**31 - 1)}
    for i, (low, high) in ranges.items():
        if not fields[i] or not set(fields[i]) <= set("0123456789") or not low <= int(fields[i]) <= high:
            return "value"
    return None if rejects.visible(fields[1]) else "value"


CASES = [
    "3,a.nt,1,2,ok", "3,a.nt,1,2,", "3,a.nt,1,2", "3,a.nt,1,2,x,y", "", ",", ",,,,", '"3","a,b","1","2","say ""x""\nline"',
    '3,a"b,1,2,x', '3,"a,1,2,x', '3,"a"b,1,2,x', "3,a\nb,1,2,x", "3,a,1,2,x\r", "3,a,1,2,x\r\n", "3,a,1,2,x\n", "11,a,1,2,x",
    "0010,a,0001,0,x", "3, ,1,2,x", "3, ​,1,2,x", "+3,a,1,2,x", "3,a,0,2,x", "3,a,2147483647,2147483647,x",
    "3,a,2147483648,2,x", "3,a,1,-1,x", "٣,a,1,2,x", "3,a,1,2,'x'", '3,a,1,2,""', '"",a,1,2,x', "3,a,1,2,\"\r\"",
    "9" * 400 + ",a,1,2,x", "0" * 400 + "7,a,1,2,x", "3,a,1,2," + "m" * 300_000, None, "3,\x01,1,2,\x01", "x" * 70_000,
]


def test_records_are_judged_as_by_hand(spark):
    rows = [(i, None, None, raw) for i, raw in enumerate(CASES * 2)]
    found = {r["raw_id"]: r for r in rejects.parse_records(spark.createDataFrame(rows, LINES)).collect()}
    assert len(found) == len(rows)
    for i, _, _, raw in rows:
        assert found[i]["reason"] == expected_reason(raw), (raw or "")[:60]
        if found[i]["reason"] is None:
            fields = next(csv.reader(io.StringIO(raw.removesuffix("\r"), newline=""), strict=True))
            typed = found[i]
            assert [typed["status"], typed["filename"], typed["line"], typed["col"], typed["message"]] == [
                int(fields[0]), fields[1], int(fields[2]), int(fields[3]), fields[4]
            ]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='3,"a\n\r 1', max_size=14), min_size=1, max_size=20))
def test_any_records_of_awkward_characters(records):
    reader = rejects._classify(iter([rejects.pa.RecordBatch.from_pydict({"i": list(range(len(records))), "raw": records})]))
    found = next(reader).to_pylist()
    assert [r["reason"] for r in found] == [expected_reason(r) for r in records]


def test_no_records(spark):
    assert rejects.parse_records(spark.createDataFrame([], LINES)).count() == 0
    extra = spark.createDataFrame([(1, "3,a,1,2,x", "clash", 5)], "raw_id long, raw string, reason string, status int")
    assert rejects.accepted(extra).collect()[0]["status"] == 3


STATEMENTS = "graph string, predicate string, subject string, emitted_at timestamp, task int, extra string"


def skewed(n: int = 3000) -> list[tuple]:
    rng = random.Random(5)
    start = dt.datetime(2025, 3, 1)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        key = ("hot", "p0") if hot else rng.choice([(None, "p1"), ("", "p1"), ("g", None), (None, None), (f"g{i % 90}", f"p{i % 7}")])
        at = None if i % 17 == 0 else start + dt.timedelta(hours=i % 1500)
        rows.append((*key, f"s{i % 50}", at, i, "x"))
    return rows


def test_key_results_do_not_depend_on_tasks_or_shards(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, STATEMENTS)
    counts = Counter((g or "", p) for g, p, *_ in rows)
    for tasks in (1, 3, 8):
        got = skew.key_shares(df, tasks).collect()
        assert {(r["graph"], r["predicate"]): r["n_rows"] for r in got} == counts
        assert len(got) == len(counts)
    heavy = {(r["graph"], r["predicate"]) for r in skew.heavy_keys(df, 0.02).collect()}
    assert heavy == {k for k, n in counts.items() if n >= 0.02 * len(rows)}


def test_late_rows_match_brute_force(spark):
    rows = skewed()
    by = defaultdict(list)
    for g, p, _, at, *_ in rows:
        by[(g or "", p)].append(at)
    got = {(r["graph"], r["predicate"]): (r["n_rows"], r["late_rows"]) for r in skew.late_rows_per_key(spark.createDataFrame(rows, STATEMENTS), 7, 5).collect()}
    want = {}
    for k, times in by.items():
        known = [t for t in times if t is not None]
        first = min(known, default=None)
        want[k] = (len(times), sum(t - first > dt.timedelta(days=7) for t in known))
    assert got == want


def test_plan_spreads_a_hot_key_and_places_each_shard_once(spark):
    where, packed = skew.pack({1: 1000, 2: 10, 3: 10, 4: 980}, 4)
    assert len(where[1]) >= 4 and max(packed) <= 1.3 * sum(packed) / 4
    assert skew.pack({}, 4) == ({}, [0, 0, 0, 0])
    df = spark.createDataFrame(skewed(), STATEMENTS).select("graph", "predicate")
    plan = skew.plan_loads(df, ["graph", "predicate"], 6)
    sizes = skew.fragment(df, plan).groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert sum(r["count"] for r in sizes) == 3000 and max(r["count"] for r in sizes) < 3000 / 3


def test_only_heavy_keys_are_replicated(spark):
    rows = [("hot", "p")] * 3000 + [(f"g{k}", "p") for k in range(3000)]
    df = spark.createDataFrame(rows, "graph string, predicate string").repartition(4)
    keys = ["graph", "predicate"]
    plan = skew.plan_loads(df, keys, 8, buckets=128)  # about 23 cold keys share the bucket of the hot one
    assert len(plan.heavy) == 1 and max(plan.loads) < 1.6 * 6000 / 8
    copies = skew.replicate(df.distinct(), plan).groupBy(*keys).count().collect()
    assert {r["graph"]: r["count"] for r in copies}["hot"] > 2
    assert all(r["count"] == 1 for r in copies if r["graph"] != "hot") and len(copies) == 3001
    left = skew.fragment(df, plan).select("graph", "_task").distinct().groupBy("graph").count()
    assert left.where("count > 1").collect()[0]["graph"] == "hot" and left.where("count > 1").count() == 1


def test_no_statements(spark):
    empty = spark.createDataFrame([], STATEMENTS)
    assert skew.key_shares(empty).count() == 0
    assert skew.late_rows_per_key(empty).count() == 0


MANIFEST = "row_id long, doc string, subject string, p_type string, predicate string, object string, attr string, value int"
ATTRS = [("n", "http://x#n", "integer"), ("d", "http://x#d", "date"), ("b", "http://x#b", "boolean"), ("s", "http://x#s", "string"), ("q", "http://x#q", "decimal")]


def wide_tables(spark, rows):
    manifests = spark.createDataFrame([(*r, "clash", 1) for r in rows], MANIFEST)
    prefixes = spark.createDataFrame([("d1", 0, "x", "http://x#"), ("d1", 1, "", "http://x#"), ("d2", 0, "x", "http://other#")], "doc string, ord int, name string, uri string")
    attributes = spark.createDataFrame(ATTRS, "attr string, predicate string, dtype string")
    return manifests, prefixes, attributes


ROWS = [
    (1, "d1", "a", "CURIE", "x:n", " +007\n"), (2, "d1", "a", "URI", "http://x#n", "8"), (3, "d1", "a", "CURIE", ":d", "2024-02-29"),
    (4, "d1", "a", "CURIE", "x:b", "TRUE"), (5, "d2", "a", "CURIE", "x:s", "lost"), (6, "d1", "b", "URI", "http://x#d", "2023-02-29"),
    (7, "d1", "b", "URI", "http://x#s", " \t\r\n"), (8, "d1", "b", "URI", "http://x#q", "-.5"), (9, "d1", "b", "URI", "http://x#q", "1."),
    (10, "d1", "c", "CURIE", "zz:n", "1"), (11, "d1", "c", "URI", None, None), (12, "d1", None, "URI", "http://x#b", "1"),
    (13, "d1", "e", "URI", "http://x#n", "9" * 60), (14, "d1", "a", "URI", "http://x#b", "0"), (2, "d1", "a", "URI", "http://x#n", "8"),
    (15, "d1", "f", "URI", "http://x#s", "long " * 30_000), (16, "d1", "f", "URI", "http://x#q", "."), (17, "d1", "f", "CURIE", "nocolon", "x"),
]


def test_wide_rows(spark):
    manifests, prefixes, attributes = wide_tables(spark, ROWS)
    columns = wide.attribute_columns(attributes)
    table = wide.wide_rows(manifests, prefixes, attributes, columns)
    got = {r["subject"]: r for r in table.collect()}
    assert set(got) == {"a", "b", "c", None, "e", "f"}
    a = got["a"]
    assert (a["n"], a["d"], a["b"], a["s"], a["n_rows"]) == (7, dt.date(2024, 2, 29), False, None, 7)
    assert a["cast_failures"]["b"]["first"] == "TRUE" and a["cast_failures"]["b"]["n"] == 1
    assert got["b"]["d"] is None and set(got["b"]["cast_failures"]) == {"d", "s"} and float(got["b"]["q"]) == -0.5
    assert got["c"]["cells"] is None and got[None]["b"] is True
    assert got["e"]["n"] is None and got["e"]["cells"]["n"] == "9" * 60
    cells = {(r["subject"], r["attr"]) for r in wide.cell_list(table).collect()}
    assert cells == {("a", "n"), ("a", "d"), ("a", "b"), ("b", "q"), (None, "b"), ("e", "n"), ("f", "s")}
    failures = sorted(r["row_id"] for r in wide.cast_failures(manifests, prefixes, attributes).collect())
    assert failures == [4, 6, 7, 16]


def test_wide_rows_of_nothing(spark):
    manifests, prefixes, attributes = wide_tables(spark, [])
    assert wide.wide_rows(manifests, prefixes, attributes, wide.attribute_columns(attributes)).count() == 0


@pytest.mark.parametrize("text, dtype, good", [("+1", "integer", True), ("1.5", "integer", False), ("+", "decimal", False), (".", "decimal", False), ("0000-00-01", "date", False), ("2024-1-01", "date", False), ("1e5", "decimal", False), (None, "string", False), ("x", "other", False)])
def test_readable(spark, text, dtype, good):
    df = spark.createDataFrame([(text, dtype)], "t string, d string")
    assert df.select(wide.readable(F.col("t"), F.col("d")).alias("x")).collect()[0]["x"] is good
