"""Reading of one document under the options of the sources, whole or piece by piece.

Files, table rows and streams all read through :class:`Reading`, so they give the same rows for the same
options. Its state between pieces is a small dictionary and the text of one unfinished item.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Mapping

from termloom.functions.uri import file_uri
from termloom.sources.events import Absolute
from termloom.sources.parser import Parser


class ParseFailure(ValueError):
    """An error in a document that is read with FAILFAST."""


def document_base(doc: str | None) -> str | None:
    """Base URI of a document by its path or URI."""
    if doc is None or "://" in doc:
        return doc
    return file_uri(os.path.abspath(doc))


class Reading:
    """A parser with the reading options: ``mode``, ``blankprefix``, ``defaultgraph``, ``expand``, ``base``."""

    def __init__(self, syntax: str, doc: str | None, options: Mapping[str, str], state: dict | None = None) -> None:
        self.doc = doc
        self.mode = options.get("mode", "PERMISSIVE").upper()
        graph = options.get("defaultgraph")
        self.parser = Parser(
            syntax, strict=self.mode in ("FAILFAST", "STRICT"), blank_prefix=options.get("blankprefix", ""),
            default_graph=("URI", graph) if graph else None,
        )
        expand = options.get("expand", "true").lower() != "false"
        self.absolute = Absolute(options.get("base") or document_base(doc)) if expand else None
        self.seq = 0
        if state is not None:
            self._resume(state)

    def _resume(self, state: dict) -> None:
        p = self.parser
        self.seq, p.line, p.col, p.next_id = state["seq"], state["line"], state["col"], state["next_id"]
        p.seen_genid, p.started, p.failed, p.skipping = state["seen"], state["started"], state["failed"], state["skipping"]
        if self.absolute is not None:
            self.absolute.env.base = state["base"]
            self.absolute.env.prefixes.update(state["prefixes"])

    def state(self) -> dict:
        """What to know to go on after the items read so far, apart from the unfinished text."""
        p, env = self.parser, self.absolute.env if self.absolute is not None else None
        p._drop_read()
        return {
            "seq": self.seq, "line": p.line, "col": p.col, "next_id": p.next_id, "seen": p.seen_genid, "started": p.started,
            "failed": p.failed, "skipping": p.skipping, "base": env.base if env else None, "prefixes": dict(env.prefixes) if env else {},
        }

    def rest(self) -> bytes:
        """The unfinished text."""
        return self.parser.text[self.parser.pos :].encode("utf-8", "surrogateescape") + self.parser._pending

    def feed(self, data: bytes | str, final: bool = False, wait: int = 0) -> Iterator[tuple]:
        """(number, event) of the items that more input completes; none looked for below ``wait`` characters."""
        self.parser.feed(data, final)
        if len(self.parser.text) < wait and not final:
            return
        while (events := self.parser.step()) is not None:
            for e in events:
                if e[0] == "error":
                    if self.mode == "FAILFAST":
                        raise ParseFailure(f"{self.doc}:{e[2]}:{e[3]}: {e[4]}")
                    if self.mode == "DROPMALFORMED":
                        continue
                yield self.seq, e if self.absolute is None else self.absolute.event(e)
                self.seq += 1


def document_events(blocks: Iterable[bytes | str], syntax: str, doc: str | None, options: Mapping[str, str]) -> Iterator[tuple]:
    """Events of a whole document under the reading options."""
    reading, wait = Reading(syntax, doc, options), 0
    for block in blocks:
        for _, event in reading.feed(block, wait=wait):
            yield event
        left = len(reading.parser.text) - reading.parser.pos
        if left >= wait:  # an item longer than a block is looked at again when there is twice as much of it
            wait = 2 * left if left > len(block) else 0
    for _, event in reading.feed(b"", True):
        yield event
