"""Incremental parser of Turtle, TriG, N-Triples and N-Quads.

Text goes in by ``feed``; ``step`` takes one top-level item (a directive, a graph block or a
description) from the front of the buffer. An item that reaches the end of the buffer waits for
more text unless the input is complete, so memory holds one item and one block of input. Nested
nodes are kept on an explicit stack, so depth is bounded by memory only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from termloom.functions.terms import CHARS, CHARS_BASE, CHARS_U, LOCAL_ESCAPABLE, BadEscape, unescape, unescape_iri
from termloom.schema import (
    ANON_CONT,
    ANON_O_BEGIN,
    ANON_S_BEGIN,
    BAD_SYNTAX,
    BAD_TEXT,
    BLANK,
    CURIE,
    EMPTY_O,
    EMPTY_S,
    HAS_NEWLINE,
    HAS_QUOTE,
    ID_CLASH,
    LIST_CONT,
    LIST_O_BEGIN,
    LIST_S_BEGIN,
    LITERAL,
    RDF_FIRST,
    RDF_NIL,
    RDF_REST,
    RDF_TYPE,
    URI,
    XSD,
)

Node = tuple[str, str]
#: Prefixed names whose nodes are kept at most.
NAMES = 20_000

_SPACE = re.compile(r"(?:[ \t\r\n]+|#[^\r\n]*)*")
_IRI = re.compile(r"<([^\x00-\x20<>\"{}|^`\\]*(?:\\[^<>][^\x00-\x20<>\"{}|^`\\]*)*)>")
_PLX = rf"%[0-9A-Fa-f]{{2}}|\\[{LOCAL_ESCAPABLE}]"
_PREFIX = rf"[{CHARS_BASE}](?:[{CHARS}.]*[{CHARS}])?"
_NAME = re.compile(rf"({_PREFIX})?:((?:[{CHARS_U}0-9:]|{_PLX})(?:[{CHARS}.:]|{_PLX})*)?")
_WORD = re.compile(rf"[{CHARS_BASE}][{CHARS}]*")
_PREFIX_DECL = re.compile(rf"({_PREFIX})?:")
_BLANK = re.compile(rf"_:([{CHARS}][{CHARS}.]*)")
_NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.(?=[0-9eE])[0-9]*)?|(\.)[0-9]+)([eE][+-]?[0-9]+)?")
_SHORT = {'"': re.compile(r'"([^"\\\n\r]*(?:\\.[^"\\\n\r]*)*)"'), "'": re.compile(r"'([^'\\\n\r]*(?:\\.[^'\\\n\r]*)*)'")}
_LONG = {
    '"': re.compile(r'"""((?:"{0,2}(?:[^"\\]|\\.))*)"""', re.DOTALL),
    "'": re.compile(r"'''((?:'{0,2}(?:[^'\\]|\\.))*)'''", re.DOTALL),
}
#: A string without quotes, escapes or line breaks that is neither tagged nor typed.
_PLAIN = re.compile(r'"([^"\\\n\r]+)"(?=[ \t\r\n;,.)\]])')
_LANG = re.compile(r"@([A-Za-z]+(?:-[A-Za-z0-9]*)*)")
_SURROGATE = re.compile(r"[\ud800-\udfff]+")
_LOCAL_ESCAPE = re.compile(r"\\(.)")
_IRI_BREAK = re.compile(r'[<>"{}|^`\n]')
_BAD_IRI_LAX = re.compile(r"<([^<>\"{}|^`\\]*(?:\\[^<>][^<>\"{}|^`\\]*)*)>")


# The common case in one match each: a plain object with what ends it, and a plain verb. Whatever is not
# plain (escapes, dots or non-ASCII letters in names, odd strings) is left to the rules below.
_B = r"[ \t\r\n]"
_PLAIN_IRI = r'<[^\x00-\x20<>"{}|^`\\\x7f-\U0010ffff]*>'
_PLAIN_NAME = r"(?:[A-Za-z][A-Za-z0-9_-]*)?:(?:[A-Za-z0-9_][A-Za-z0-9_-]*)?"
_OBJECT = re.compile(
    rf"{_B}*(?:(?P<iri>{_PLAIN_IRI})|(?P<name>{_PLAIN_NAME})|\"(?P<text>[^\"\\\n\r\x7f-\U0010ffff]+)\"(?:@(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*))?"
    rf"|(?P<number>[+-]?[0-9]+(?P<point>\.[0-9]+)?)){_B}*(?P<end>[;,\]]|\.(?={_B}))"
)
_VERB = re.compile(rf"{_B}*(?:(?P<name>{_PLAIN_NAME})|(?P<iri>{_PLAIN_IRI})|a(?={_B})){_B}+(?=[^ \t\r\n#])")
_FULL_IRI = r'<([A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20<>"{}|^`\\\x7f-\U0010ffff]*)>'
_LABEL = r"_:([A-Za-z0-9_][A-Za-z0-9_-]*)"
_QUAD = re.compile(
    rf"(?:{_FULL_IRI}|{_LABEL})[ \t]+{_FULL_IRI}[ \t]+(?:{_FULL_IRI}|{_LABEL}|\"([^\"\\\n\r\x7f-\U0010ffff]*)\"(?:\^\^{_FULL_IRI}|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)"
    rf"[ \t]+(?:(?:{_FULL_IRI}|{_LABEL})[ \t]+)?\.[ \t]*(?=\r?\n)"
)
_INTEGER, _DECIMAL = (URI, XSD + "integer"), (URI, XSD + "decimal")


class SyntaxFault(Exception):
    """Input that the grammar does not allow: status, message and offset into the buffer."""

    def __init__(self, message: str, at: int, status: int = BAD_SYNTAX) -> None:
        super().__init__(message)
        self.at, self.status = at, status


class NeedMore(Exception):
    """The buffer ends inside an item."""


class Parser:
    """One input stream. Events are tuples that start with their kind:

    ``("base", uri)``, ``("prefix", name, uri)``, ``("statement", flags, g, s, p, o, o_flags,
    datatype, lang)``, ``("end", node)`` and ``("error", status, line, col, message)``. Nodes are
    (type, value) as written: references and prefixed names are not expanded.
    """

    def __init__(self, syntax: str, strict: bool = True, blank_prefix: str = "", default_graph: Node | None = None) -> None:
        self.syntax, self.strict, self.blank_prefix = syntax, strict, blank_prefix
        self.default_graph = default_graph
        self.fancy = syntax in ("turtle", "trig")
        self.text, self.pos, self.final = "", 0, False
        self.line, self.col = 1, 1
        self.next_id, self.seen_genid = 1, False
        self.events: list[tuple] = []
        self.graph: Node | None = None
        self.names: dict[str, Node] = {}
        self.started = False
        self._pending = b""

    # Input

    def feed(self, data: bytes | str, final: bool = False) -> None:
        """Add input. Bytes that are no UTF-8 are kept as lone surrogates until a term holds them."""
        if isinstance(data, bytes):
            data = self._pending + data
            keep = 0
            if not final:  # a character may be cut at the end of a block
                for back in range(1, min(4, len(data) + 1)):
                    if data[-back] & 0xC0 == 0xC0:
                        need = 2 if data[-back] < 0xE0 else 3 if data[-back] < 0xF0 else 4
                        keep = back if need > back else 0
                        break
                    if data[-back] < 0x80:
                        break
            self._pending = data[len(data) - keep :] if keep else b""
            data = data[: len(data) - keep].decode("utf-8", "surrogateescape")
        self._drop_read()
        self.text += data
        self.final = self.final or final

    def _drop_read(self) -> None:
        done = self.text[: self.pos]
        lines = done.count("\n")
        if lines:
            self.line += lines
            self.col = len(done) - done.rfind("\n") - 1
        else:
            self.col += len(done)
        self.text, self.pos = self.text[self.pos :], 0

    def place(self, at: int) -> tuple[int, int]:
        """(line, column) of an offset into the buffer; columns start at 1 in the first line, then at 0."""
        before = self.text[:at]
        lines = before.count("\n")
        return (self.line + lines, len(before) - before.rfind("\n") - 1) if lines else (self.line, self.col + len(before))

    # Top level

    def step(self) -> list[tuple] | None:
        """Events of the next item; None at the end of the input so far. Errors are events, too.

        After an error the reader is done in strict mode and goes on after the next line end in lax
        mode; statements read before the error stay.
        """
        if self.failed:
            return None
        state = (self.pos, self.next_id, self.seen_genid, self.skipping)
        self.events = []
        try:
            if not self._begin():
                return None
            if not self.fancy and (m := _QUAD.match(self.text, self.pos)) and self._plain_line(m):
                return self.events
            self._nquads_item() if self.syntax == "nquads" else self._item()
        except NeedMore:
            if not self.final:
                self.pos, self.next_id, self.seen_genid, self.skipping = state
                self.events = []
                self.graph = None
                return None
            self._fault(SyntaxFault("unexpected end of file", len(self.text)))
        except SyntaxFault as fault:
            if not self.final and fault.at >= len(self.text) - 16:  # what is there may be half a term
                self.pos, self.next_id, self.seen_genid, self.skipping = state
                self.events = []
                self.graph = None
                return None
            self._fault(fault)
        self.graph = None
        return self.events

    failed = False

    def _fault(self, fault: SyntaxFault) -> None:
        line, col = self.place(min(fault.at, len(self.text)))
        self.events.append(("error", fault.status, line, col, str(fault)))
        if self.strict:
            self.failed = True
        else:
            at = self.text.find("\n", fault.at)
            self.pos = len(self.text) if at < 0 else at
            self.skipping = at < 0 and not self.final

    skipping = False

    def _begin(self) -> bool:
        if self.skipping:
            at = self.text.find("\n", self.pos)
            self.pos = len(self.text) if at < 0 else at
            self.skipping = at < 0
            if at < 0:
                return False
        if not self.started:
            if not self.text and not self.final:
                return False
            self.started = True
            if self.text.startswith("\ufeff"):
                self.pos = 1
            elif self.text[:1] == "\udcef":
                raise SyntaxFault("corrupt byte order mark", 0)
        while True:
            c = self._space()
            if c != "\0":
                return bool(c)
            self.pos += 1
            if self.syntax == "nquads":
                raise SyntaxFault("bad subject", self.pos)

    def _space(self) -> str:
        """Skip blanks and comments; the character after them, empty at the end of the buffer.

        A comment that may go on after the buffer is not skipped.
        """
        start = self.pos
        c = self.text[start : start + 1]
        if c and c not in " \t\r\n#":
            return c
        self.pos = _SPACE.match(self.text, start).end()
        if self.pos == len(self.text) and not self.final:
            line = max(self.text.rfind("\n", start), self.text.rfind("\r", start), start - 1) + 1
            comment = self.text.find("#", line)
            if comment >= 0:
                self.pos = comment
                return ""
        return self.text[self.pos : self.pos + 1]

    def _peek(self) -> str:
        """The next character after blanks, which must come."""
        c = self.text[self.pos : self.pos + 1]
        if c and c not in " \t\r\n#":
            return c
        c = self._space()
        if not c:
            raise NeedMore
        return c

    def _take(self, c: str) -> None:
        if self._peek() != c:
            raise SyntaxFault(f"expected '{c}', not '{self.text[self.pos]}'", self.pos)
        self.pos += 1

    def _item(self) -> None:
        c = self.text[self.pos]
        if c == "@":
            if not self.fancy:
                raise SyntaxFault("syntax does not support directives", self.pos)
            self._directive()
        elif c == "{":
            if self.syntax != "trig":
                raise SyntaxFault("syntax does not support graphs", self.pos)
            self._block()
        elif not self._keyword():
            self._triples(top=True)

    def _directive(self) -> None:
        for word, read in (("@base", self._base), ("@prefix", self._prefix)):
            if self.text.startswith(word, self.pos):
                self.pos += len(word)
                read()
                self._take(".")
                return
        if len(self.text) - self.pos < 8 and not self.final:
            raise NeedMore
        raise SyntaxFault("invalid directive", self.pos + 1)

    def _keyword(self) -> bool:
        """BASE, PREFIX or GRAPH, in any case, without an ``@``."""
        if not self.fancy:
            return False
        m = _WORD.match(self.text, self.pos)
        if m is None or self.text[m.end() : m.end() + 1] == ":":
            return False
        if m.end() == len(self.text) and not self.final:
            raise NeedMore
        word = m[0].lower()
        if word == "base":
            self.pos = m.end()
            self._base()
            if self._space() == ".":
                raise SyntaxFault("full stop after SPARQL BASE", self.pos)
        elif word == "prefix":
            self.pos = m.end()
            self._prefix()
        elif word == "graph":
            if self.syntax != "trig":
                raise SyntaxFault("syntax does not support graphs", self.pos)
            self.pos = m.end()
            c = self._peek()
            if c == "[":
                self.pos += 1
                self._take("]")
                self.graph = self._new_blank()
            else:
                self.graph = self._blank() if c == "_" else self._iri_or_name()
            self._block()
        else:
            return False
        return True

    def _base(self) -> None:
        self._peek()
        self.events.append(("base", self._iri()[1]))

    def _prefix(self) -> None:
        self._peek()
        m = _PREFIX_DECL.match(self.text, self.pos)
        if m is None:
            raise SyntaxFault("expected a prefix name", self.pos)
        self.pos = m.end()
        self._peek()
        self.events.append(("prefix", m[1] or "", self._iri()[1]))

    def _block(self) -> None:
        """The statements of a graph between braces."""
        self._take("{")
        while self._peek() != "}":
            self._triples(top=False)
            if self._peek() == ".":
                self.pos += 1
            elif self.text[self.pos] != "}":
                raise SyntaxFault("expected '.' or '}'", self.pos)
        self.pos += 1
        if self._space() == ".":
            raise SyntaxFault("graph followed by '.'", self.pos)

    # Terms

    def _valid(self, text: str, at: int, what: str) -> str:
        """Text without bytes that are no UTF-8: an error, or U+FFFD in lax mode."""
        if not text.isascii() and _SURROGATE.search(text):
            if self.strict:
                raise SyntaxFault(f"invalid UTF-8 in {what}", at, BAD_TEXT)
            return _SURROGATE.sub("\ufffd", text)
        return text

    def _iri(self) -> Node:
        at = self.pos
        m = _IRI.match(self.text, at)
        if m is None and not self.strict:
            m = _BAD_IRI_LAX.match(self.text, at)
            if m is None and not self.final and not _IRI_BREAK.search(self.text, at + 1):
                raise NeedMore
            if m is not None and "\n" in m[0]:
                raise SyntaxFault("invalid IRI character", at + m[0].index("\n"))
            if m is not None:
                line, col = self.place(at)
                self.events.append(("error", BAD_SYNTAX, line, col, "invalid IRI character"))
        if m is None:
            if self.text[at : at + 1] != "<":
                raise SyntaxFault("expected '<'", at)
            bad = re.compile(r"[\x00-\x20<>\"{}|^`]").search(self.text, at + 1)
            if bad is None:
                raise NeedMore
            raise SyntaxFault(f"bad IRI character U+{ord(bad[0]):04X}", bad.start())
        body = m[1]
        if not self.fancy and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", body):
            raise SyntaxFault("expected IRI scheme", at + 1)
        try:
            body = unescape_iri(body, not self.strict)
        except BadEscape as e:
            raise SyntaxFault(str(e), at + 1 + e.at) from None
        self.pos = m.end()
        return URI, self._valid(body, at, "IRI")

    def _iri_or_name(self) -> Node:
        c = self.text[self.pos : self.pos + 1]
        if c == "<":
            return self._iri()
        if not self.fancy:
            raise SyntaxFault("expected '<' or '_'", self.pos)
        m = _NAME.match(self.text, self.pos)
        if m is not None and m.end() < len(self.text) and (node := self.names.get(m[0])) is not None:
            if self.text[m.end()] not in "%\\":
                self.pos = m.end()
                return node
        if m is None:
            w = _WORD.match(self.text, self.pos)
            if w is not None and w.end() == len(self.text):
                raise NeedMore
            raise SyntaxFault("expected prefixed name", self.pos)
        end, local = m.end(), m[2] or ""
        if end == len(self.text) and not self.final:
            raise NeedMore
        if local.endswith(".") and not local.endswith("\\."):
            local, end = local[:-1], end - 1
        if self.text[end : end + 1] in ("%", "\\"):
            raise SyntaxFault("bad escape", end)
        self.pos = end
        if "\\" in local:
            local = _LOCAL_ESCAPE.sub(r"\1", local)
        node = (CURIE, f"{m[1] or ''}:{local}")
        if end == m.end():
            if len(self.names) >= NAMES:
                self.names.clear()
            self.names[m[0]] = node
        return node

    def _blank(self) -> Node:
        m = _BLANK.match(self.text, self.pos)
        if m is None:
            if len(self.text) - self.pos < 3:
                raise NeedMore
            raise SyntaxFault("invalid name start", self.pos + 2)
        label, end = m[1], m.end()
        if end == len(self.text) and not self.final:
            raise NeedMore
        if label.endswith("."):
            label, end = label[:-1], end - 1
        if self.fancy and label[1:2].isdigit() and label[1:2].isascii():
            if label[0] == "b":  # generated labels start with b
                label, self.seen_genid = "B" + label[1:], True
            elif label[0] == "B" and self.seen_genid:
                raise SyntaxFault("found both 'b' and 'B' blank IDs, prefix required", self.pos, ID_CLASH)
        self.pos = end
        return BLANK, self.blank_prefix + label

    def _new_blank(self) -> Node:
        node = (BLANK, f"{self.blank_prefix}b{self.next_id}")
        self.next_id += 1
        return node

    def _literal(self) -> tuple[Node, int, Node | None, str | None]:
        """(node, flags, datatype, language) of a quoted literal."""
        at, q = self.pos, self.text[self.pos]
        m = _PLAIN.match(self.text, at)
        if m is not None:
            body = self._valid(m[1], at, "string")
            self.pos = m.end()
            return (LITERAL, body), HAS_QUOTE if "'" in body else 0, None, None
        long = self.text.startswith(q * 3, at)
        if not self.fancy and (q == "'" or long):
            raise SyntaxFault("syntax does not support this string", at)
        if not long and self.text.startswith(q * 2, at) and len(self.text) == at + 2 and not self.final:
            raise NeedMore
        m = (_LONG if long else _SHORT)[q].match(self.text, at)
        if m is None:
            stop = -1 if long else min((x for x in (self.text.find("\n", at), self.text.find("\r", at)) if x >= 0), default=-1)
            if stop < 0:
                raise NeedMore
            raise SyntaxFault("line end in short string", stop)
        raw, end = m[1], m.end()
        try:
            body = unescape(raw, not self.strict)
        except BadEscape as e:
            if self.strict or not long:
                raise SyntaxFault(str(e), at + (3 if long else 1) + e.at) from None
            body = self._lax_long(raw, at + 3)
        body = self._valid(body, at, "string")
        bare = re.sub(r"\\.", "", raw, flags=re.DOTALL) if "\\" in raw else raw
        flags = HAS_QUOTE if '"' in bare or "'" in bare else 0
        if "\n" in body or "\r" in body:
            flags |= HAS_NEWLINE
        self.pos = end
        if end == len(self.text) and not self.final:
            raise NeedMore
        if self.text.startswith("@", end):
            t = _LANG.match(self.text, end)
            if t is None:
                raise SyntaxFault("bad language", end + 1)
            if t.end() == len(self.text) and not self.final:
                raise NeedMore
            self.pos = t.end()
            return (LITERAL, body), flags, None, t[1]
        if self.text.startswith("^", end):
            if not self.text.startswith("^^", end):
                raise SyntaxFault("expected '^'", end + 1) if len(self.text) > end + 1 else NeedMore()
            self.pos = end + 2
            if self.pos == len(self.text):
                raise NeedMore
            return (LITERAL, body), flags, self._iri_or_name(), None
        return (LITERAL, body), flags, None, None

    def _lax_long(self, raw: str, at: int) -> str:
        """A long string with bad escapes left out, each reported."""
        out, start = [], 0
        while True:
            try:
                out.append(unescape(raw[start:], True))
                return "".join(out)
            except BadEscape as e:
                line, col = self.place(at + start + e.at)
                self.events.append(("error", BAD_SYNTAX, line, col, str(e)))
                stop = start + e.at - 1
                out.append(unescape(raw[start:stop], True))
                start = stop + 1

    def _number(self) -> tuple[Node, Node]:
        m = _NUMBER.match(self.text, self.pos)
        if m is None:
            raise SyntaxFault("expected digit", self.pos + 1)
        if m.end() >= len(self.text) - 1 and not self.final:
            raise NeedMore
        if m[2] is None and self.text[m.end() : m.end() + 1] in ("e", "E"):
            raise SyntaxFault("expected digit", m.end() + 1)
        self.pos = m.end()
        kind = "double" if m[2] else "decimal" if "." in m[0] else "integer"
        return (LITERAL, m[0]), (URI, XSD + kind)

    # Statements

    def _emit(self, flags: int, s: Node, p: Node, o: Node, o_flags: int = 0, dt: Node | None = None, lang: str | None = None) -> int:
        self.events.append(("statement", flags, self.graph or self.default_graph, s, p, o, o_flags, dt, lang))
        return flags & (ANON_CONT | LIST_CONT)

    def _plain_name(self, name: str) -> Node:
        node = self.names.get(name)
        if node is None:
            if len(self.names) >= NAMES:
                self.names.clear()
            node = self.names[name] = (CURIE, name)
        return node

    def _plain_object(self, m: re.Match, flags: int, s: Node, p: Node) -> int:
        """Emit the statement of an object that one match has read."""
        o_flags, dt, lang = 0, None, None
        if m["name"] is not None:
            node = self._plain_name(m["name"])
        elif m["iri"] is not None:
            node = (URI, m["iri"][1:-1])
        elif m["text"] is not None:
            node, lang = (LITERAL, m["text"]), m["lang"]
            o_flags = HAS_QUOTE if "'" in m["text"] else 0
        else:
            node, dt = (LITERAL, m["number"]), _DECIMAL if m["point"] else _INTEGER
        self.events.append(("statement", flags, self.graph or self.default_graph, s, p, node, o_flags, dt, lang))
        return flags & (ANON_CONT | LIST_CONT)

    def _verb(self) -> Node:
        if self.text[self.pos] == "a":
            m = _NAME.match(self.text, self.pos)
            w = _WORD.match(self.text, self.pos)
            if m is None and w[0] == "a":
                if w.end() == len(self.text):
                    raise NeedMore
                self.pos += 1
                return URI, RDF_TYPE
        return self._iri_or_name()

    def _triples(self, top: bool) -> None:
        """A subject with its description; for ``top``, also a named graph's block or the full stop."""
        text_at = self.pos
        c = self.text[self.pos]
        subject: Node | None = None
        flags, optional = 0, False
        stack: list[tuple] = []
        if c == "[" and self.fancy:
            self.pos += 1
            if self._peek() == "]":
                self.pos += 1
                subject, flags = self._new_blank(), EMPTY_S
            else:
                subject, flags = self._new_blank(), ANON_S_BEGIN
                stack.append(("[", None, None, 0, subject))
                optional = True
        elif c == "(" and self.fancy:
            self.pos += 1
            if self._peek() == ")":
                self.pos += 1
                subject = (URI, RDF_NIL)
            else:
                subject, flags = self._new_blank(), LIST_S_BEGIN
                stack.append(("(", None, None, 0, subject))
        elif c == "_":
            subject = self._blank()
        else:
            w = _WORD.match(self.text, self.pos) if self.fancy else None
            if w is not None and w[0] in ("true", "false") and self.text[w.end() : w.end() + 1] not in (":", ""):
                raise SyntaxFault("expected subject", self.pos)
            subject = self._iri_or_name()
        if not stack and top and self._space() == "{":
            if self.syntax != "trig":
                raise SyntaxFault("syntax does not support graphs", self.pos)
            if c == "(":
                raise SyntaxFault("invalid graph name", text_at)
            self.graph = subject
            self._block()
            return
        self._description(subject, flags, stack, optional, c == "(")
        if top:
            self._take(".")

    def _description(self, subject: Node, flags: int, stack: list[tuple], optional: bool, is_list: bool) -> None:
        """Predicates and objects up to the end of the subject, with an explicit stack of open nodes.

        An open node is (bracket, outer subject, outer predicate, flags before, the node). While a
        list is open, ``subject`` is its current cell.
        """
        predicate: Node | None = None
        first, nil, rest = (URI, RDF_FIRST), (URI, RDF_NIL), (URI, RDF_REST)
        state = "member" if stack and stack[-1][0] == "(" else "verb"
        began = False  # whether a predicate was read since the subject became current
        plain = self.fancy
        while True:
            if plain and state == "object" and not (stack and stack[-1][0] == "(") and (m := _OBJECT.match(self.text, self.pos)):
                flags = self._plain_object(m, flags, subject, predicate)
                end = m["end"]
                if end == ",":
                    self.pos = m.end()
                    continue
                self.pos, state = m.start("end"), "after"
                if end == ";" and (m := _VERB.match(self.text, self.pos + 1)):
                    name, iri = m["name"], m["iri"]
                    predicate = self._plain_name(name) if name else (URI, iri[1:-1]) if iri else (URI, RDF_TYPE)
                    self.pos, state = m.end(), "object"
                continue
            c = self._peek()
            if state == "verb":
                if not stack and not began and c in ".}" and (optional or (is_list and not self.strict)):
                    return
                predicate = self._verb()
                began = True
                state = "object"
                continue
            if state == "member":
                predicate, state = first, "object"
                if c in "]}" or (c == "." and not self.text[self.pos + 1 : self.pos + 2].isdigit()):
                    raise SyntaxFault("expected object", self.pos)
                continue
            if state == "object":
                if not self.fancy and c not in '"<_':
                    raise SyntaxFault("expected: ':', '<', or '_'", self.pos)
                if c == "[":
                    self.pos += 1
                    before = flags
                    if self._peek() == "]":
                        self.pos += 1
                        flags = self._emit(flags | EMPTY_O, subject, predicate, self._new_blank())
                        state = "after"
                        continue
                    flags |= ANON_O_BEGIN
                    node = None
                    if self.text[self.pos] == "=":
                        if not self.text.startswith("==", self.pos):
                            raise SyntaxFault("expected '='", self.pos + 1)
                        self.pos += 2
                        self._peek()
                        node = self._iri_or_name()
                        self._take(";")
                    node = node or self._new_blank()
                    flags = self._emit(flags, subject, predicate, node)
                    flags = flags & ~LIST_CONT | ANON_CONT
                    stack.append(("[", subject, predicate, before, node))
                    subject, began, state = node, False, "verb"
                elif c == "(":
                    self.pos += 1
                    if self._peek() == ")":
                        self.pos += 1
                        self._emit(flags, subject, predicate, nil)
                        flags, state = 0, "after"
                        continue
                    node = self._new_blank()
                    self._emit(flags | LIST_O_BEGIN, subject, predicate, node)
                    flags = LIST_CONT
                    stack.append(("(", subject, predicate, 0, node))
                    subject, state = node, "member"
                else:
                    o_flags, datatype, lang = 0, None, None
                    if c == "_":
                        node = self._blank()
                    elif c in "\"'":
                        node, o_flags, datatype, lang = self._literal()
                    elif c in "+-0123456789" or (c == "." and self.text[self.pos + 1 : self.pos + 2].isdigit()):
                        node, datatype = self._number()
                    elif c in ").;,]}":
                        raise SyntaxFault("expected object", self.pos)
                    else:
                        w = _WORD.match(self.text, self.pos) if self.fancy else None
                        if w is not None and w[0] in ("true", "false") and not _NAME.match(self.text, self.pos):
                            if w.end() == len(self.text) and not self.final:
                                raise NeedMore
                            node, datatype = (LITERAL, w[0]), (URI, XSD + "boolean")
                            self.pos = w.end()
                        else:
                            node = self._iri_or_name()
                    flags = self._emit(flags, subject, predicate, node, o_flags, datatype, lang)
                    state = "after"
                continue
            # after an object
            if stack and stack[-1][0] == "(":
                if c == ")":
                    self.pos += 1
                    flags = self._emit(flags | LIST_CONT, subject, rest, nil) & ~LIST_CONT
                    _, outer, outer_predicate, _, node = stack.pop()
                    if outer is None:
                        subject, began, state = node, False, "verb"
                    else:
                        subject, predicate, state = outer, outer_predicate, "after"
                    continue
                node = self._new_blank()
                flags = self._emit(flags | LIST_CONT, subject, rest, node)
                subject, state = node, "member"
                continue
            if c == ",":
                if not self.fancy:
                    raise SyntaxFault("syntax does not support abbreviation", self.pos)
                self.pos += 1
                state = "object"
                continue
            if c == ";" and self.fancy:
                while c == ";":
                    self.pos += 1
                    c = self._peek()
                if c not in ".]}":
                    state = "verb"
                    continue
            if stack:
                if c != "]":
                    raise SyntaxFault("expected ']'", self.pos)
                self.pos += 1
                _, outer, outer_predicate, before, node = stack.pop()
                self.events.append(("end", node))
                flags = before
                if outer is None:
                    subject, began, state = node, False, "verb"
                else:
                    subject, predicate = outer, outer_predicate
                continue
            if c in ".}":
                return
            raise SyntaxFault("missing ';' or '.'", self.pos)

    def _plain_line(self, m: re.Match) -> bool:
        """Take a plain line, unless it has a graph where there are none."""
        s_iri, s_blank, p, o_iri, o_blank, text, dt, lang, g_iri, g_blank = m.groups()
        if self.syntax == "ntriples" and (g_iri or g_blank):
            return False
        blank = lambda x: (BLANK, self.blank_prefix + x)
        g = (URI, g_iri) if g_iri else blank(g_blank) if g_blank else self.default_graph
        o = (URI, o_iri) if o_iri else blank(o_blank) if o_blank else (LITERAL, text)
        flags = HAS_QUOTE if text and "'" in text else 0
        s = (URI, s_iri) if s_iri else blank(s_blank)
        self.events.append(("statement", 0, g, s, (URI, p), o, flags, (URI, dt) if dt else None, lang))
        self.pos = m.end()
        return True

    def _nquads_item(self) -> None:
        """Subject, predicate, object, maybe a graph, and a full stop; a statement only if all is well."""
        if self.text[self.pos] == "@":
            raise SyntaxFault("syntax does not support directives", self.pos)
        subject = self._blank() if self.text[self.pos] == "_" else self._iri()
        self._peek()
        predicate = self._iri()
        c = self._peek()
        o_flags, datatype, lang = 0, None, None
        if c == "_":
            node = self._blank()
        elif c == '"':
            node, o_flags, datatype, lang = self._literal()
        elif c == "<":
            node = self._iri()
        else:
            raise SyntaxFault("expected: ':', '<', or '_'", self.pos)
        c = self._peek()
        if c != ".":
            self.graph = self._blank() if c == "_" else self._iri()
        self._take(".")
        self._emit(0, subject, predicate, node, o_flags, datatype, lang)


def parse_blocks(parser: Parser, blocks: Iterable[bytes | str]) -> Iterator[tuple]:
    """Events of a whole input given in blocks."""
    for block in blocks:
        parser.feed(block)
        while (events := parser.step()) is not None:
            yield from events
    parser.feed(b"", final=True)
    while (events := parser.step()) is not None:
        yield from events


def parse(data: bytes | str, syntax: str, strict: bool = True, blank_prefix: str = "") -> Iterator[tuple]:
    """Events of a whole document."""
    yield from parse_blocks(Parser(syntax, strict, blank_prefix), [data])
