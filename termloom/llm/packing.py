"""Documents packed into containers of fixed token capacity (problem 8): bin completion.

Each task sizes its documents with a public tokenizer and packs them block by block. A block is
packed by best fit and by completing the largest document again and again with its best undominated
filling; the fewer containers win. The worst containers are then searched exactly by branch and
bound with a waste bound. Items of containers that stay badly filled wait for the next block.
Only the last containers of a task stay open, so no document is shuffled.
"""

from __future__ import annotations

import base64
import bisect
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.util import spread

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's vocabulary parts a text; a fixed value that belongs to the file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items packed together.
BLOCK = 8192
#: A container waits for the next block if more than this part of it is empty.
OPEN_PART = 1 / 256


@dataclass(frozen=True)
class Effort:
    """How far the search goes; None: without limit.

    ``fillings`` looked at for one container, ``sizes`` tried for one place of a filling, ``branches`` and ``nodes`` of
    the branch and bound, and ``items`` of the worst containers that it is given. With limits a packing can have
    containers too many, never an item too few; :data:`EXACT` has none, and then the packing of a block has as few
    containers as there can be, at a cost that grows exponentially with the items.
    """

    fillings: int | None = 200
    sizes: int | None = 6
    branches: int | None = 50
    nodes: int | None = 2000
    items: int | None = 48


EXACT = Effort(None, None, None, None, None)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices per container: largest item first, into the fullest container that has room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []  # (room, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            bins.append([i])
            room, b = capacity, len(bins) - 1
        else:
            room, b = rooms.pop(at)
            bins[b].append(i)
        bisect.insort(rooms, (room - sizes[i], b))
    return bins


class _Stock:
    """Sizes still to be packed, with the number of items of each."""

    def __init__(self, sizes: list[int]) -> None:
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.sorted = sorted(self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            del self.count[size]
            self.sorted.pop(bisect.bisect_left(self.sorted, size))

    def put(self, size: int) -> None:
        if size in self.count:
            self.count[size] += 1
        else:
            self.count[size] = 1
            bisect.insort(self.sorted, size)


def fillings(stock: _Stock, room: int, most: int | None, sizes: int | None) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, sizes) of undominated fillings of a room, least waste first.

    At most ``most`` are looked at, and ``sizes`` for one place.

    Items are chosen in falling order, the largest that fits first. A filling to which an item could
    be added is dominated and never made; one in which a chosen item could be exchanged for a larger
    unused one that fits is dropped.
    """
    found: dict[tuple[int, ...], int] = {}
    looked = 0
    order = stock.sorted

    def grow(chosen: list[int], room: int, top: int) -> bool:
        nonlocal looked
        at = bisect.bisect_right(order, min(room, top)) - 1
        used_up = True
        tried = 0
        while at >= 0 and (most is None or looked < most):
            size = order[at]
            if chosen.count(size) < stock.count[size]:
                used_up = False
                chosen.append(size)
                exact = grow(chosen, room - size, size)
                chosen.pop()
                tried += 1
                if exact and most is not None:
                    return True
                if sizes is not None and tried >= sizes:
                    break
            at -= 1
        if used_up and tried == 0:
            looked += 1
            found[tuple(chosen)] = room
            return room == 0
        return False

    grow([], room, room)
    kept = []
    for chosen, waste in found.items():
        dominated = False
        if waste:
            for size in set(chosen):
                at = bisect.bisect_right(order, size)
                while at < len(order) and order[at] <= size + waste:
                    if chosen.count(order[at]) < stock.count[order[at]]:
                        dominated = True
                        break
                    at += 1
                if dominated:
                    break
        if not dominated:
            kept.append((waste, chosen))
    return sorted(kept or [(w, s) for s, w in found.items()], key=lambda x: (x[0], [-s for s in x[1]]))


def complete(sizes: list[int], capacity: int, effort: Effort = Effort()) -> list[tuple[int, ...]]:
    """Sizes per container: the largest item each time with its best filling."""
    stock = _Stock(sizes)
    bins = []
    while stock.sorted:
        largest = stock.sorted[-1]
        stock.take(largest)
        filling = fillings(stock, capacity - largest, effort.fillings or 200, effort.sizes or 6)[0][1] if stock.sorted else ()
        for s in filling:
            stock.take(s)
        bins.append((largest, *filling))
    return bins


def search(sizes: list[int], capacity: int, incumbent: int, effort: Effort = Effort()) -> list[tuple[int, ...]] | None:
    """A packing into fewer than ``incumbent`` containers by branch and bound, or None.

    Branches over the undominated fillings around the largest item, least waste first. A branch is
    cut when the waste so far leaves too little room for the rest in one container less than the
    best packing known.
    """
    best: list[tuple[int, ...]] | None = None
    total = sum(sizes)
    least = -(-total // capacity)
    stock = _Stock(sizes)
    left = math.inf if effort.nodes is None else effort.nodes

    def descend(bins: list[tuple[int, ...]], waste: int) -> None:
        nonlocal best, incumbent, left
        if not stock.sorted:
            if len(bins) < incumbent:
                best, incumbent = list(bins), len(bins)
            return
        if waste > (incumbent - 1) * capacity - total or left <= 0:
            return
        left -= 1
        largest = stock.sorted[-1]
        stock.take(largest)
        for unused, filling in fillings(stock, capacity - largest, effort.branches, effort.sizes) if stock.sorted else [(0, ())]:
            for s in filling:
                stock.take(s)
            last = not stock.sorted
            descend([*bins, (largest, *filling)], waste + (0 if last else unused))
            for s in filling:
                stock.put(s)
            if incumbent <= least or left <= 0:
                break
        stock.put(largest)

    if incumbent > least:
        descend([], 0)
    return best


def pack(sizes: list[int], capacity: int, effort: Effort = Effort()) -> list[list[int]]:
    """Indices per container for items of at most ``capacity``; every item is in one container."""
    least = -(-sum(sizes) // capacity)
    bins = best_fit(sizes, capacity)
    if len(bins) > least:
        other = complete(sizes, capacity, effort)
        if len(other) < len(bins):
            bins = _indices(other, sizes)
    if len(bins) > least:
        fill = [sum(sizes[i] for i in b) for b in bins]
        order = sorted(range(len(bins)), key=lambda b: (fill[b], b))
        tail, n = [], 0
        for b in order:
            if effort.items is not None and n + len(bins[b]) > effort.items:
                break
            tail.append(b)
            n += len(bins[b])
        own = [i for b in tail for i in bins[b]]
        better = search([sizes[i] for i in own], capacity, len(tail), effort)
        if better is not None:
            repacked = _indices(better, [sizes[i] for i in own])
            rest = set(tail)
            bins = [x for b, x in enumerate(bins) if b not in rest] + [[own[k] for k in x] for x in repacked]
    return bins


def _indices(bins: list[tuple[int, ...]], sizes: list[int]) -> list[list[int]]:
    """Containers of sizes as containers of indices, equal sizes in order of index."""
    by: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        by.setdefault(sizes[i], []).append(i)
    return [[by[s].pop() for s in b] for b in bins]


OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("first_token", T.LongType()),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("container", T.LongType()),
    ]
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int32()),
     ("container", pa.int64())]
)


def tokenizer(path: str):  # noqa: ANN201
    """The public byte-level tokenizer whose ranks are in the file at ``path``."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(documents: DataFrame, capacity: int = CAPACITY, tokenizer_path: str = TOKENIZER, block: int = BLOCK, effort: Effort = Effort()) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, container): every document in containers of ``capacity`` tokens.

    A document is split only if it is larger than a container: into full pieces and one rest.
    Containers are numbered per task. ``effort`` limits the search for better packings. A task keeps at most ``block`` and an eighth items in memory,
    whatever its partition holds, and the texts of one Arrow batch.

    Defined results: a null or empty text has one piece of no tokens and no container; repeated
    rows are packed each; an empty table gives no rows; of items of one size, those read first come
    first.
    """
    most_waiting = max(1, block // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        items: list[tuple[int, int, int, int]] = []

        def close(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)

        def packing(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal items, number
            bins = pack([x[3] for x in items], capacity, effort)
            waste = [capacity - sum(items[i][3] for i in b) for b in bins]
            waiting: list[int] = []
            if not last:
                for b in sorted(range(len(bins)), key=lambda b: (-waste[b], b)):
                    if waste[b] <= capacity * OPEN_PART or len(waiting) + len(bins[b]) > most_waiting:
                        break
                    waiting += bins[b]
            later = set(waiting)
            rows = []
            for b in bins:
                if b[0] not in later:
                    rows += [(*items[i], number) for i in b]
                    number += 1
            if rows:
                yield close(rows)
            items = [items[i] for i in sorted(waiting)]

        for batch in batches:
            if encode is None:
                encode = tokenizer(tokenizer_path).encode_ordinary
            empty = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(encode(text)) if text else 0
                if not n:
                    empty.append((doc_id, 0, 0, 0, None))
                for piece, first in enumerate(range(0, n, capacity)):
                    items.append((doc_id, piece, first, min(capacity, n - first)))
                if len(items) >= block + most_waiting:
                    yield from packing(False)
            if empty:
                yield close(empty)
        if items:
            yield from packing(True)

    return spread(documents.select("doc_id", "text")).mapInArrow(run, OUT)


def container_fill(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, n_pieces, n_tokens, unused) of every container."""
    return pieces.where(F.col("container").isNotNull()).groupBy("container").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"),
        (F.lit(capacity) - F.sum("n_tokens")).alias("unused"),
    )
