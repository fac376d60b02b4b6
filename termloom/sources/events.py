"""Parser events as Arrow batches, and rows back to events."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from termloom.schema import CURIE, EVENT, URI
from termloom.sources.env import Env

SCHEMA: pa.Schema = to_arrow_schema(EVENT)
#: Events in one batch.
BATCH = 4096


def event_row(doc: str | None, seq: int, event: tuple) -> tuple:
    """One event as a row of the event schema."""
    kind = event[0]
    none = (None,) * 12
    if kind == "statement":
        _, flags, g, s, p, o, o_flags, dt, lang = event
        terms = (*(g or (None, None)), *s, *p, *o, o_flags, *(dt or (None, None)), lang)
        return (kind, doc, seq, flags, *terms, None, None, None, None, None, None)
    if kind == "prefix":
        return (kind, doc, seq, None, *none, event[1], event[2], None, None, None, None)
    if kind == "base":
        return (kind, doc, seq, None, *none, None, event[1], None, None, None, None)
    if kind == "end":
        return (kind, doc, seq, None, None, None, *event[1], *none[4:], None, None, None, None, None, None)
    return (kind, doc, seq, None, *none, None, None, *event[1:])


def row_event(row: dict) -> tuple:
    """The event of a row; the inverse of :func:`event_row`."""
    return _event(*[row.get(n) for n in _FIELDS])


_FIELDS = (
    "kind", "flags", "g_type", "g", "s_type", "s", "p_type", "p", "o_type", "o", "o_flags", "o_datatype_type", "o_datatype", "o_lang",
    "name", "uri", "status", "line", "col", "message",
)


def _event(kind, flags, gt, g, st, s, pt, p, ot, o, o_flags, dtt, dt, lang, name, uri, status, line, col, message) -> tuple:  # noqa: ANN001
    if kind is None or kind == "statement":
        return (
            "statement", flags or 0, None if gt is None else (gt, g), None if st is None else (st, s), None if pt is None else (pt, p),
            None if ot is None else (ot, o), o_flags or 0, None if dtt is None else (dtt, dt), lang,
        )
    if kind == "prefix":
        return (kind, name, uri)
    if kind == "base":
        return (kind, uri)
    if kind == "end":
        return (kind, None if st is None else (st, s))
    return (kind, status, line, col, message)


def row_events(batch: pa.RecordBatch) -> Iterator[tuple[str | None, int | None, tuple]]:
    """(doc, seq, event) of event or statement rows; columns that are not there are null."""
    own = {n: batch.column(n).to_pylist() for n in batch.schema.names}
    columns = [own.get(n) or repeat(None) for n in _FIELDS]
    docs, seqs = (own.get(n) or repeat(None, batch.num_rows) for n in ("doc", "seq"))
    for doc, seq, *fields in zip(docs, seqs, *columns):
        yield doc, seq, _event(*fields)


def batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of the event schema as Arrow batches of bounded size."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= BATCH:
            yield _batch(part)
            part = []
    if part:
        yield _batch(part)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.nulls(n, f.type) if c.count(None) == n else pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


class Absolute:
    """Makes references and prefixed names of events absolute, in the scope of their place.

    Bases and prefixes come out absolute; a name whose prefix is unknown stays as it is.
    """

    def __init__(self, base: str | None = None) -> None:
        self.env = Env(base)
        self.memo: dict[tuple, tuple] = {}

    def node(self, node: tuple[str, str] | None) -> tuple[str, str] | None:
        if node is None or node[0] not in (URI, CURIE):
            return node
        found = self.memo.get(node)
        if found is None:
            if len(self.memo) > 20_000:
                self.memo.clear()
            found = self.memo[node] = self.env.expand_node(node) or node
        return found

    def event(self, e: tuple) -> tuple:
        """The event with its nodes absolute; directives change the scope of those after them."""
        full, kind = self.node, e[0]
        if kind == "statement":
            return (kind, e[1], full(e[2]), full(e[3]), full(e[4]), full(e[5]), e[6], full(e[7]), e[8])
        if kind == "end":
            return (kind, full(e[1]))
        if kind not in ("base", "prefix"):
            return e
        self.memo.clear()
        if kind == "base":
            self.env.set_base(e[1])
            return (kind, self.env.base)
        self.env.set_prefix(e[1], e[2])
        return (kind, e[1], self.env.prefixes[e[1]])
