"""Lengths that are limits, endings learned from the corpus, and what the two give together."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from termloom.llm import truncation

SCHEMA = "doc_id long, source string, text string, kind string"
EN = "shaft turns drives housing cover sensor valve pump under load near plate holds moving frame light spring".split()
DE = "Welle dreht Gehäuse Deckel Sensor Ventil Pumpe unter Last neben Platte hält Rahmen Licht Feder".split()
HI = "यह वाल्व पंप के साथ चलता है और दबाव नीचे ऊपर प्लेट धारक तेल".split()
AR = "هذا الصمام يعمل مع المضخة تحت الضغط فوق اللوحة الزيت الحامل".split()


def text(rng: random.Random, words: list[str], stop: str, n: int) -> str:
    return " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(4, 9))).capitalize() + stop for _ in range(n))


def corpus(seed: int = 3) -> list[tuple]:
    """Complete texts of many kinds, and cut ones: at 400 characters in one source, anywhere in two."""
    rng, rows = random.Random(seed), []

    def add(source: str, body: str, kind: str) -> None:
        rows.append((len(rows), source, body, kind))

    for _ in range(160):
        add("prose", text(rng, EN, ".", rng.randint(2, 14)), "whole")
        add("german", text(rng, DE, ".", rng.randint(2, 14)), "whole")
        add("hindi", text(rng, HI, "।", rng.randint(2, 9)), "whole")
        add("arabic", text(rng, AR, "؟", rng.randint(2, 9)), "whole")
        add("headlines", " ".join(rng.choice(EN) for _ in range(rng.randint(3, 7))).capitalize(), "whole")
        add("bullets", text(rng, EN, ".", 3) + "\n" + "\n".join(f"– {rng.choice(EN)} {rng.choice(EN)}" for _ in range(4)), "whole")
        add("code", "\n".join(f"if ({rng.choice(EN)}) {{\n  {rng.choice(EN)}({rng.randint(1, 9)});\n}}" for _ in range(3)), "whole")
        add("signs", text(rng, EN, ".", 4) + "\nSIGNS\n" + "\n".join(f"{rng.randint(1, 99)} {rng.choice(EN)} {rng.choice(EN)}" for _ in range(5)), "whole")
        long = text(rng, EN, ".", 12)
        add("limited", long[:400] if rng.random() < 0.6 else text(rng, EN, ".", 4), "")
        add("teasers", " ".join(rng.choice(EN) for _ in range(rng.randint(4, 16))).capitalize()[:60], "")
    for _ in range(12):
        for source, words, stop in (("prose", EN, "."), ("german", DE, ".")):
            body = text(rng, words, stop, 9)
            add(source, body[: rng.randint(40, len(body) - 2)], "transfer")
    return [(i, s, b, k or ("limit" if len(b) in (400, 60) else "whole")) for i, s, b, k in rows]


def inside(body: str) -> bool:
    """Whether a text stops inside a sentence."""
    return not body.rstrip().endswith((".", "।", "؟"))


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    return rows, {lim: {r["doc_id"]: r for r in truncation.judged(df, limits=lim).collect()} for lim in (True, False)}


def test_cuts_are_found_by_length_and_ending(found):
    rows, judged = found
    cut = {i for i, _, b, k in rows if k in ("limit", "transfer") and inside(b)}
    got = {i for i, r in judged[True].items() if r["truncated"]}
    assert len(got & cut) >= 0.9 * len(cut) and len(got & cut) >= 0.95 * len(got)
    assert all(judged[True][i]["at_limit"] == (k == "limit") for i, s, b, k in rows if s == "limited")
    assert {k for i, _, _, k in rows if i in got} >= {"limit", "transfer"}


def test_complete_texts_of_any_kind_are_none(found):
    rows, judged = found
    wrong = [(s, b[-30:]) for i, s, b, k in rows if k == "whole" and judged[True][i]["truncated"]]
    assert len(wrong) <= 3, wrong


def test_the_lengths_decide(found):
    rows, judged = found
    cut = [i for i, _, b, k in rows if k in ("limit", "transfer") and inside(b)]
    share = lambda lim: sum(judged[lim][i]["truncated"] for i in cut) / len(cut)
    assert share(False) < 0.8 * share(True)


def test_limits(spark):
    rows = [(s, "chars", n) for s, lengths in (("a", [*range(100, 300), *[200] * 40]), ("b", list(range(100, 300))), (None, [50] * 30 + list(range(40, 70)))) for n in lengths]
    found = truncation.significant_lengths(spark.createDataFrame(rows, "source string, unit string, n int")).collect()
    assert sorted((r["source"] or "", r["n"]) for r in found) == [("", 50), ("a", 200)]


@pytest.mark.parametrize("line, want", [("12 drive shaft", "9 a a"), ("(7)  η = a·b", "(9) a = a·a"), ("[FIG. 3]", "[A. 9]"), ("转子盘，12", "x，9"), ("so on...", "a a.."), ("", "")])
def test_shapes(spark, line, want):
    assert spark.createDataFrame([(line,)], "t string").select(truncation.shape(F.col("t"))).collect()[0][0] == want


def test_nothing_and_odd_texts(spark):
    rows = [(1, None, None, ""), (2, "s", "", ""), (3, "s", " \n　", ""), (4, None, "x" * 300_000 + ".", ""), (5, "s", "Same.", ""), (5, "s", "Same.", ""), (None, "s", "a", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = truncation.judged(df).collect()
    assert len(got) == len(rows) and not any(r["truncated"] for r in got)
    rates = {r["source"]: r["n_docs"] for r in truncation.truncation_rates(df.withColumnRenamed("kind", "chars")).collect()}
    assert rates == {"s": 5, None: 2}
    empty = spark.createDataFrame([], SCHEMA)
    assert truncation.judged(empty).count() == 0 and truncation.truncation_rates(empty).count() == 0
