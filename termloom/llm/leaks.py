"""Evaluation texts that leak into training texts (problem 9): a generalised suffix automaton.

The normalised test items become one automaton over words. The words of a document run through
it, which gives the longest match that ends at each word; matches of ``SEED`` words or more are
laid along the item and joined over replaced and added words. A passage counts if it covers enough
successive words of the item with few enough edits. Every allowed passage holds an exact match of
at least ``SEED`` words, so nothing is lost by looking at those only.
"""

from __future__ import annotations

import pickle
import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.util import spread

#: Successive words of an item that make a leak, and words per allowed edit.
LEAST_WORDS, WORDS_PER_EDIT = 20, 8
#: With at most one edit in eight of 20 or more words, some 6 words in a row are untouched.
SEED = 6
#: Words of test items in one automaton at most; more items go through several, one after another. Ready to run, an
#: automaton takes about 120 bytes a word, and some 900 while it is built, in a task of its own.
AUTOMATON_WORDS = 500_000

#: A number in brackets, which does not count, or a word.
TOKEN = re.compile(r"[(\[{（【]\s*[0-9]+\s*[)\]}）】]|([^\W_]+)")


def words(text: str) -> list[str]:
    """Words of a text in lower case, without numbers in brackets."""
    return [w for w in TOKEN.findall(text.lower()) if w]


@dataclass
class Automaton:
    """Suffix automaton of several word sequences, each state with the items it occurs in."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[set[int]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the shorter words that reach it through p."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.items[clone] |= self.items[q]
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, item: int, sequence: Sequence[int]) -> None:
        """Insert all suffixes of a sequence."""
        last, ends = 0, []
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                last = new
            ends.append(last)
        state = last
        node = 0  # states may have been split since: walk the sequence again
        for c in sequence:
            node = self.next[node][c]
            state = node
            while state > 0 and item not in self.items[state]:
                self.items[state].add(item)
                state = self.link[state]

    def roots(self, least: int) -> list[int]:
        """For each state, the state of the last ``least`` words of its matches (-1: shorter)."""
        root = [-1] * len(self.length)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            if self.length[state] >= least:
                above = root[self.link[state]]
                root[state] = state if above < 0 else above
        return root

    def packed(self, size: int, least: int) -> Packed:
        """The automaton over ``size`` words in flat arrays, with the items of matches of ``least`` words."""
        edges = sorted((state * size + c, to) for state, moves in enumerate(self.next) for c, to in moves.items())
        root = self.roots(least)
        ends, flat = [0], []
        for state, own in enumerate(self.items):
            if root[state] == state:
                flat += sorted(own)
            ends.append(len(flat))
        return Packed(size, array("q", (k for k, _ in edges)), array("i", (to for _, to in edges)), array("i", self.link), array("i", self.length),
                      array("i", root), array("i", ends), array("i", flat))


@dataclass(frozen=True)
class Packed:
    """A suffix automaton in flat arrays: moves sorted by state and word, and items by the state of their last words."""

    size: int
    keys: array
    to: array
    link: array
    length: array
    root: array
    ends: array
    flat: array

    def move(self, state: int, c: int) -> int:
        """The state after a word; -1 if there is none."""
        key = state * self.size + c
        at = bisect_left(self.keys, key)
        return self.to[at] if at < len(self.keys) and self.keys[at] == key else -1

    def run(self, sequence: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each word."""
        state, n = 0, 0
        for c in sequence:
            after = self.move(state, c)
            while state and after < 0:
                state = self.link[state]
                n = self.length[state]
                after = self.move(state, c)
            state, n = (0, 0) if after < 0 else (after, n + 1)
            yield state, n

    def items(self, state: int) -> array:
        """Items that hold the last words of a match."""
        at = self.root[state]
        return self.flat[self.ends[at] : self.ends[at + 1]]


def passages(
    doc: Sequence[int], item: Sequence[int], seeds: Sequence[tuple[int, int]], least: int, per_edit: int, seed: int
) -> list[tuple[int, int, int, int, int]]:
    """Passages of an item in a document: (doc start, doc end, item start, item end, edits).

    ``seeds`` are (start, end) of words in the document all of whose ``seed``-word pieces stand in
    the item. Each exact match in them is extended to both sides edit by edit.
    """
    where = defaultdict(list)
    for j, w in enumerate(item):
        where[w].append(j)
    found: list[tuple[int, int, int, int, int]] = []
    for start, end in seeds:
        at = start
        while at + seed <= end:
            far = at + 1
            for j in where.get(doc[at], ()):
                n = 0
                while at + n < end and j + n < len(item) and doc[at + n] == item[j + n]:
                    n += 1
                if n < seed:
                    continue
                far = max(far, at + n - seed + 1)
                if not any(f[0] <= at and at + n <= f[1] and f[2] <= j and j + n <= f[3] for f in found):
                    best = _around(doc, item, at, j, n, least, per_edit)
                    if best:
                        found.append(best)
            at = far
    return sorted(set(found))


def _reaches(doc: Sequence[int], item: Sequence[int], i: int, j: int, step: int, own: int, per_edit: int) -> list[tuple[int, int]]:
    """Farthest (item words, doc words) to one side of an exact match, for 0, 1, 2 ... edits.

    For each number of edits and each shift between the texts, the farthest place is kept. A place
    counts if it ends in words alike. ``own`` are the words of the match. A side is followed as long as it has, with the
    match, half the words an edit that a passage needs: every passage has an exact match from which both of its sides
    keep to that (of two parts with too many edits between them, the larger pays for half of these at least), and
    the passage is found from there.
    """
    n, m = (len(item) - j, len(doc) - i) if step > 0 else (j + 1, i + 1)

    def alike(y: int, x: int) -> int:
        at = x
        while y < m and x < n and doc[i + step * y] == item[j + step * x]:
            y, x = y + 1, x + 1
        return x - at

    run = alike(0, 0)
    places = {0: run}
    best = (run, run)
    reaches = [best]
    while places and 2 * (own + best[0]) >= per_edit * (len(reaches) - 2):
        after: dict[int, int] = {}
        for d, x in places.items():  # replaced, added in the document, left out
            for shift, to in ((d, x + 1), (d + 1, x), (d - 1, x + 1)):
                if to <= n and 0 <= to + shift <= m and to > after.get(shift, -1):
                    after[shift] = to
        places = {}
        for d, x in after.items():
            run = alike(x + d, x)
            places[d] = x + run
            if run and x + run > best[0]:
                best = (x + run, x + run + d)
        reaches.append(best)
    return reaches


def _around(doc: Sequence[int], item: Sequence[int], i: int, j: int, n: int, least: int, per_edit: int) -> tuple[int, int, int, int, int] | None:
    """The longest passage that holds the exact match of ``n`` words at ``i`` and ``j``, or None."""
    right = _reaches(doc, item, i + n, j + n, 1, n, per_edit)
    left = _reaches(doc, item, i - 1, j - 1, -1, n, per_edit) if i and j else [(0, 0)]
    best = None
    for e1, (x1, y1) in enumerate(left):
        for e2, (x2, y2) in enumerate(right):
            words = x1 + n + x2
            if words >= least and (e1 + e2) * per_edit <= words and (best is None or words > best[3] - best[2]):
                best = (i - y1, i + n + y2, j - x1, j + n + x2, e1 + e2)
    return best


class Matcher:
    """Test items ready to be looked for; pickled to the workers."""

    def __init__(self, items: Sequence[tuple[int, str]], least: int, per_edit: int, seed: int) -> None:
        self.least, self.per_edit, self.seed = least, per_edit, seed
        self.ids: dict[str, int] = {"": -2}  # a number in brackets
        self.items: list[tuple[int, list[int]]] = []
        automaton = Automaton()
        for item_id, text in items:
            sequence = [self.ids.setdefault(w, len(self.ids) - 1) for w in words(text)]
            automaton.add(len(self.items), sequence)
            self.items.append((item_id, array("i", sequence)))
        self.size = len(self.ids)
        self.automaton = automaton.packed(self.size, seed)
        self.item_pairs = [{a * self.size + b for a, b in zip(s, s[1:])} for _, s in self.items]
        pairs = set().union(*self.item_pairs)
        self.pairs = np.array(sorted(pairs) or [-1], dtype=np.int64)

    def candidates(self, sequence: list[int], runs: np.ndarray) -> dict[int, list[list[int]]]:
        """Per item, (start, end) of words all of whose ``seed``-word pieces stand in the item."""
        seed, of = self.seed, self.automaton.items
        spans: dict[int, list[list[int]]] = {}
        for start, end in runs.tolist():
            at = start
            for state, n in self.automaton.run(sequence[start : end + 1]):
                at += 1
                if n >= seed:
                    for item in of(state):
                        own = spans.setdefault(item, [])
                        if own and own[-1][1] == at - 1 and own[-1][0] <= at - seed - 1:
                            own[-1][1] = at
                        else:
                            own.append([at - seed, at])
        return spans

    def document(self, text: str) -> list[tuple[int, int, int, int, int, int]]:
        """(item_id, doc word start, doc word end, item start, item end, edits) for one text."""
        get = self.ids.get
        raw = np.array([get(w, -1) for w in TOKEN.findall(text.lower())], dtype=np.int64)
        doc = raw[raw != -2]
        if len(doc) < self.seed:
            return []
        a, b = doc[:-1], doc[1:]
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -2)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        known = self.pairs[at] == key
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known.astype(np.int8), [0]))))
        runs = edges.reshape(-1, 2)  # successive known pairs: words start .. end + 1
        runs = runs[runs[:, 1] - runs[:, 0] >= self.seed - 1]
        if not len(runs):
            return []
        sequence, keys = doc.tolist(), key.tolist()
        found = []
        # A passage can be narrowed to fewer than twice `least` words around some seed; its equal
        # words then form at least this many pairs of the item.
        needed, around = self.least - 2 * (self.least // self.per_edit) - 1, 2 * self.least
        for item, spans in self.candidates(sequence, runs).items():
            own = self.item_pairs[item].__contains__
            seeds = [s for s in spans if sum(map(own, keys[max(0, s[0] - around) : s[1] + around])) >= needed]
            if seeds:
                item_id, words_of = self.items[item]
                found += [
                    (item_id, *p) for p in passages(sequence, words_of, seeds, self.least, self.per_edit, self.seed)
                ]
        return found


SPANS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("item_start", T.IntegerType()),
        T.StructField("item_end", T.IntegerType()),
        T.StructField("item_words", T.IntegerType()),
        T.StructField("edits", T.IntegerType()),
    ]
)
_SPAN_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(n, pa.int32()) for n in SPANS.names[2:]]])


def _matchers(benchmark: DataFrame, least: int, per_edit: int, seed: int, most: int) -> Iterator[Matcher]:
    """Matchers of all test items, each built in a task of its own and fetched one after another."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), "text")
    total = items.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    groups = max(1, -(-total // (2 * most)))  # a word is two characters at least, with what parts it from the next
    own = items.repartitionById(groups, F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        if rows:
            made = pickle.dumps(Matcher(sorted(rows), least, per_edit, seed), pickle.HIGHEST_PROTOCOL)
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["matcher"])

    for r in own.mapInArrow(build, "matcher binary").toLocalIterator():
        yield pickle.loads(bytes(r["matcher"]))


def leak_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    least: int = LEAST_WORDS,
    per_edit: int = WORDS_PER_EDIT,
    automaton_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """Passages of test items in documents, in words of the document and of the item.

    One narrow pass over the documents for each group of items; an automaton is at most about
    ``automaton_words`` words. A passage begins and ends with words alike; ``edits`` counts the words
    replaced, added or left out between. Per document, item and seed region the longest passage is
    reported.

    Defined results: null texts and ids of items have no passages; empty tables give no rows;
    repeated documents are reported each; an item shorter than ``least`` is never found; items
    alike are reported each.
    """
    seed = SEED if (least, per_edit) == (LEAST_WORDS, WORDS_PER_EDIT) else max(2, min(SEED, (least - least // per_edit) // (least // per_edit + 1)))
    slim = spread(documents.where(F.col("text").isNotNull()).select("doc_id", "text"))
    parts = None
    for made in _matchers(benchmark, least, per_edit, seed, automaton_words):
        matcher = slim.sparkSession.sparkContext.broadcast(made)

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            m = matcher.value
            lengths = {i: len(s) for i, s in m.items}
            for batch in batches:
                rows = [
                    (doc_id, p[0], p[1], p[2], p[3], p[4], lengths[p[0]], p[5])
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for p in m.document(text)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t.type) for c, t in zip(zip(*rows), _SPAN_ARROW)], schema=_SPAN_ARROW
                    )

        found = slim.mapInArrow(run, SPANS)
        parts = found if parts is None else parts.unionByName(found)
    return parts if parts is not None else slim.sparkSession.createDataFrame([], SPANS)


def leaked_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document and the items that leaked into it, each once."""
    return leak_spans(documents, benchmark).select("doc_id", "item_id").distinct()


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the given spans of its words."""
    places = [m.span() for m in TOKEN.finditer(text.lower()) if m.group(1)]
    if len(text.lower()) != len(text):  # lower case of other length: place words in the text itself
        places = [m.span() for m in TOKEN.finditer(text) if m.group(1)]
    out, at = [], 0
    for start, end in sorted(spans):
        left, right = places[start][0], places[min(end, len(places)) - 1][1]
        if right > at:
            out.append(text[at : max(left, at)])
            at = right
    return "".join([*out, text[at:]])


CLEAN = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_removed", T.IntegerType()),
        T.StructField("dropped", T.BooleanType()),
    ]
)


def without_leaks(documents: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """(doc_id, text, n_removed, dropped) of the documents that leak, their passages removed.

    ``n_removed`` counts characters. ``dropped``: the passages hold more than ``coverage`` of the
    document's words, so nothing worth training on is left.
    """
    spans = leak_spans(documents, benchmark).groupBy("doc_id").agg(
        F.collect_set(F.struct("start", "end")).alias("spans")  # at most one per item and region
    )
    leaky = documents.select("doc_id", "text").join(spans, "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int32()), ("dropped", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                pairs = [(s["start"], s["end"]) for s in r["spans"]]
                hit = len({k for a, b in pairs for k in range(a, b)})
                text = _without(r["text"], pairs)
                total = max(len(words(r["text"])), 1)
                rows.append((r["doc_id"], text, len(r["text"]) - len(text), hit > coverage * total))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return leaky.mapInArrow(run, CLEAN)
