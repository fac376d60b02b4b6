"""Leaked passages against a brute-force alignment."""

from __future__ import annotations

import pickle
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import leaks

DOCS = "doc_id long, text string, item_id int, start int"
ITEMS = "item_id long, text string, lang string"
WORDS = [f"w{i}" for i in range(400)]


def holds(doc, item, least=20, per=8):
    """Whether a passage of the item stands in the document that begins and ends with words alike."""
    n, m, far = len(item), len(doc), 10**6
    for a in range(n - least + 1):
        # cost[j]: fewest edits to lay item[a:i] along the document so that it ends at j
        cost = [far] + [0 if doc[j - 1] == item[a] else far for j in range(1, m + 1)]
        for j in range(1, m + 1):
            cost[j] = min(cost[j], cost[j - 1] + 1)
        for i in range(a + 1, n):
            new = [far] * (m + 1)
            for j in range(1, m + 1):
                alike = doc[j - 1] == item[i]
                new[j] = min(cost[j - 1] + (not alike), new[j - 1] + 1, cost[j] + 1)
                if alike and i - a + 1 >= least and cost[j - 1] * per <= i - a + 1:
                    return True
            cost = new
    return False


def passage(rng, item, length, edits):
    start = rng.randrange(len(item) - length + 1)
    words = item[start : start + length]
    for k in sorted(rng.sample(range(1, length - 1), edits), reverse=True):
        if rng.random() < 0.6:
            words[k] = "zz" + rng.choice(WORDS)
        else:
            words.insert(k, "zz" + rng.choice(WORDS))
    return words


def test_against_brute_force(spark):
    rng = random.Random(11)
    items = [[rng.choice(WORDS) for _ in range(rng.randint(30, 60))] for _ in range(6)]
    items[5] = items[4][:25] + [rng.choice(WORDS) for _ in range(20)]
    docs = []
    for k in range(70):
        item = rng.choice(items)
        length = rng.randint(14, min(len(item), 40))
        middle = passage(rng, list(item), length, rng.randint(0, length // 7))
        docs.append([rng.choice(WORDS) for _ in range(15)] + middle + [rng.choice(WORDS) for _ in range(15)])
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if holds(doc, item)}
    text = lambda ws: " ".join(ws)
    df = spark.createDataFrame([(d, text(w), 1, 1) for d, w in enumerate(docs)], DOCS)
    bench = spark.createDataFrame([(i, text(w), "en") for i, w in enumerate(items)], ITEMS)
    got = {tuple(r) for r in leaks.leaked_items(df, bench).collect()}
    assert want <= got
    # the brute force also allows words left out at any place; what is found must hold in it
    assert got <= want
    grouped = leaks.leak_spans(df, bench, automaton_words=60)
    assert {(r["doc_id"], r["item_id"]) for r in grouped.collect()} == got


def test_what_does_not_count(spark):
    item = " ".join(WORDS[:24])
    shown = ", ".join(WORDS[:10]).upper() + " (12)\n\n[0003] " + " - ".join(WORDS[10:24]) + "!"
    docs = [(1, "x " + shown + " y", 0, 0), (2, " ".join(WORDS[:19]), 0, 0), (3, None, 0, 0), (4, "", 0, 0), (5, " ".join(WORDS[::2]), 0, 0), (1, shown, 0, 0), (6, "q " * 50_000 + item, 0, 0)]
    bench = [(7, item, "en"), (8, None, "en"), (9, "too short", "en"), (10, item.upper(), "en"), (None, item, "en")]
    df, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, ITEMS)
    assert sorted(tuple(r) for r in leaks.leaked_items(df, b).collect()) == [(1, 7), (1, 10), (6, 7), (6, 10)]
    assert leaks.leaked_items(df.limit(0), b).count() == 0
    assert leaks.leaked_items(df, b.limit(0)).count() == 0


def test_passages_are_removed(spark):
    item = " ".join(WORDS[:30])
    docs = [(1, "Before it. " + item.title() + " After it.", 0, 0), (2, item, 0, 0), (3, "nothing", 0, 0)]
    df, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item, "en")], ITEMS)
    got = {r["doc_id"]: r for r in leaks.without_leaks(df, b, 0.95).collect()}
    assert got[1]["text"] == "Before it.  After it." and not got[1]["dropped"]
    assert got[2]["text"] == "" and got[2]["dropped"] and set(got) == {1, 2}


def test_automaton_knows_all_pieces():
    rng = random.Random(3)
    sequences = [[rng.randrange(5) for _ in range(30)] for _ in range(4)]
    auto = leaks.Automaton()
    for i, s in enumerate(sequences):
        auto.add(i, s)
    auto = pickle.loads(pickle.dumps(auto.packed(5, 4)))
    for _ in range(300):
        text = [rng.randrange(5) for _ in range(20)]
        for end, (state, n) in enumerate(auto.run(text), 1):
            inside = lambda k: {i for i, s in enumerate(sequences) if any(s[a : a + k] == text[end - k : end] for a in range(31 - k))}  # noqa: B023, E731
            assert not n or inside(n)
            assert end == n or not inside(n + 1)
            if n >= 4:
                assert set(auto.items(state)) == inside(4)


def test_no_passage_is_given_up_early():
    """Edits in a row are paid for by what comes after them, however many there are."""
    item = list(range(1, 121))
    doc = item[:50] + [-1] * 5 + item[55:]
    assert leaks.passages(doc, item, [(0, 50)], 20, 8, 6) == [(0, 120, 0, 120, 5)]
    short = item[:10] + [-1, -1] + item[12:22]
    assert leaks.passages(short, item, [(0, 10)], 20, 8, 6) == [(0, 22, 0, 22, 2)]


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 40)), min_size=1, max_size=16), st.integers(0, 15))
def test_every_passage_has_a_match_to_start_from(runs, lifted):
    """Runs of words alike with an edit between each two: one run of a seed's words has half the words needed on each side."""
    edits = len(runs) - 1
    missing = max(20, 8 * edits) - sum(runs) - edits
    if missing > 0:
        runs[lifted % len(runs)] += missing

    def pays(side):
        total = 0
        for e, n in enumerate(side):
            total += n
            if 2 * total < 8 * (e - 1):
                return False
        return True

    assert any(n >= leaks.SEED and pays(runs[k:]) and pays(runs[k::-1]) for k, n in enumerate(runs))


def test_items_in_several_automata(spark):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(40)), "en") for k in range(30)]
    docs = spark.createDataFrame([(k, "before " + items[k][1] + " after") for k in range(30)], "doc_id long, text string")
    found = leaks.leak_spans(docs, spark.createDataFrame(items, ITEMS), automaton_words=100)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(k, k) for k in range(30)]
