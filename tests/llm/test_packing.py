"""Bin completion: every item once, nothing over capacity, close to the least number of containers."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import packing

SCHEMA = "doc_id long, text string, container long, piece int"


def valid(bins, sizes, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= capacity for b in bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_packings_are_valid_and_no_worse_than_best_fit(sizes):
    bins = packing.pack(sizes, 50)
    valid(bins, sizes, 50)
    assert len(bins) <= len(packing.best_fit(sizes, 50))


def least(sizes, capacity):
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[k] >= sizes[i]:
                place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_optimal_on_small_cases():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted((rng.randint(5, 60) for _ in range(9)), reverse=True)
        assert len(packing.pack(sizes, 100, packing.EXACT)) == least(sizes, 100)


def test_search_beats_best_fit():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6] * 1 + [7, 6, 5, 4, 3]
    got = packing.search(sizes, 61, len(packing.best_fit(sizes, 61)) + 1)
    assert got is not None and sorted(itertools.chain(*got)) == sorted(sizes)


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_documents(spark, capacity):
    rng = random.Random(4)
    texts = [None, "", "a", "a" * 5000, *[" ".join(["word"] * rng.randint(1, 90)) for _ in range(300)]]
    df = spark.createDataFrame([(i, t, 9, 9) for i, t in enumerate(texts)] + [(3, "twice", 9, 9)] * 2, SCHEMA).coalesce(2)
    rows = packing.packed(df, capacity, block=64).collect()
    encode = packing.tokenizer(packing.TOKENIZER).encode_ordinary
    fill, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        if r["container"] is None:
            assert r["n_tokens"] == 0
        else:
            fill[r["container"]] += r["n_tokens"]
        pieces[r["doc_id"]].append(r)
    assert max(fill.values()) <= capacity and set(pieces) == set(range(len(texts)))
    for i, text in enumerate(texts):
        own = pieces[i]
        n = len(encode(text or "")) + (2 * len(encode("twice")) if i == 3 else 0)
        assert sum(r["n_tokens"] for r in own) == n
        if i != 3:
            assert len(own) == max(1, -(-n // capacity)) and sorted(r["first_token"] for r in own) == list(range(0, max(n, 1), capacity))
    assert sum(r["unused"] for r in packing.container_fill(packing.packed(df, capacity, block=64), capacity).collect()) == len(fill) * capacity - sum(fill.values())


def test_little_room_is_left(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, " ".join(["word"] * rng.randint(20, 700)), 0, 0) for i in range(3000)], SCHEMA).coalesce(1)
    fill = packing.container_fill(packing.packed(df, 1024, block=512), 1024).collect()
    assert sum(r["unused"] for r in fill) <= 0.005 * 1024 * len(fill)


def test_no_documents(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0
