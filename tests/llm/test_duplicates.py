"""Formatting-blind duplicates against a plain canonical form."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import defaultdict

from termloom.llm import duplicates

SCHEMA = "desc_id long, subject string, type string, object string, first_id long, doc string"


def plain(text):
    if text is None:
        return None
    return "".join(c for c in text if unicodedata.category(c)[0] in "LNM").upper().lower()


def canonical(row):
    _, subject, kind, obj = row[:4]
    fields = None
    if obj is not None:
        fields = set()
        for f in re.split(r"[;|\n\r]", obj):
            name, _, value = re.sub("[:=]", "\0", f, count=1).partition("\0")
            if plain(name) or plain(value):
                fields.add((plain(name), plain(value)))
        fields = frozenset(fields)
    return plain(subject), plain(kind), fields


def check(spark, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[canonical(r)].append(r[0])
    firsts = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    want = sorted((firsts[k], i) for k, ids in groups.items() for i in ids if i is not None and i > firsts[k])
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in duplicates.repeats(df).collect()) == want
    got = duplicates.collapse(df).collect()
    assert sorted((r["first_id"] or -1, r["copies"]) for r in got) == sorted((firsts[k] or -1, len(ids)) for k, ids in groups.items())


def variants(rng, n):
    rows = []
    for i in range(n):
        names = [("label", f"Größe {i % 7}"), ("to", "été"), ("unit", "m3 per h")]
        rng.shuffle(names)
        sep, part = rng.choice([";", "|", "\n", " ; "]), rng.choice([":", "=", " : "])
        obj = sep.join(f"{a}{part}{rng.choice([b, b.upper(), b.replace(' ', '-')])}" for a, b in names) + rng.choice(["", ";", "\r\n"])
        rows.append((i, rng.choice(["Hall (1)", "HALL-1", "hall 1."]), rng.choice(["Flow Meter", "flowmeter"]), obj))
    return rows


def test_variants_and_lookalikes(spark):
    rng = random.Random(1)
    rows = variants(rng, 120)
    rows += [(900, "a", "t", "x: 1; y: 2"), (901, "a", "t", "y=2|x=1"), (902, "a", "t", "x: 2; y: 1"), (903, "a", "t", "x: 1"), (904, "a", "t", "x: 1; x:1"), (905, "á", "t", "x: 1"), (906, "a", "t", "a: b: c"), (907, "a", "t", "a = b=c"), (908, "a", "t", "a b: c")]
    check(spark, rows)


def test_hot_group_and_copies(spark):
    rows = [(i, "hot", "t", "a: 1") for i in range(300)] + [(1000 + i, f"s{i}", "t", "a: 1") for i in range(50)] + [(2000 + i, "HOT!" + "." * i, "t", "A=1") for i in range(150)]
    check(spark, rows)


def test_nulls_empty_and_long(spark):
    rows = [(1, None, "t", "a:1"), (2, None, "T", "a=1"), (3, "", "t", "a:1"), (4, "s", None, None), (5, "S", None, None), (6, "s", None, ""), (None, "s", None, ""), (7, "s", None, " ; "), (8, "x" * 100_000, "t", "a:" + "y" * 100_000), (9, "X" * 100_000, "t", "A: " + "Y" * 100_000), (4, "s", None, None)]
    check(spark, rows)
    assert duplicates.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert duplicates.collapse(spark.createDataFrame([], SCHEMA)).count() == 0
