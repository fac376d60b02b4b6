"""Lexical functions as Column expressions; all but the last group stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions import terms as T
from termloom.functions import uri as U
from termloom.schema import STATUS_MESSAGES, XSD

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
NUMBER = r"^\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _lit(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


# URIs


def uri_has_scheme(uri: Column) -> Column:
    """Whether a text starts with a scheme; false for null."""
    return F.coalesce(uri.rlike(SCHEME), F.lit(False))


#: A reference in five pieces with their delimiters, so that absent and empty ones differ.
_PIECES = r"^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#[\s\S]*)?$"


def _pieces(uri: Column) -> Column:
    """Array of the five pieces in one pass; control characters do not occur in references."""
    return F.split(F.regexp_replace(uri, _PIECES, "$1\x01$2\x01$3\x01$4\x01$5"), "\x01", 5)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def uri_parse(uri: Column) -> Column:
    """Struct of the components; null ones are absent, the path never is."""

    def parts(p: Column) -> Column:
        cut = lambda i, n: F.when(p[i] != "", F.substr(p[i], F.lit(n)))
        scheme = F.when(p[0] != "", F.substr(p[0], F.lit(1), F.length(p[0]) - 1))
        return F.struct(
            scheme.alias("scheme"), cut(1, 3).alias("authority"), p[2].alias("path"), cut(3, 2).alias("query"),
            cut(4, 1).alias("fragment"),
        )

    return F.when(uri.isNotNull(), _let(_pieces(uri), parts))


def uri_part(uri: Column, part: str) -> Column:
    """``scheme``, ``authority``, ``path``, ``query`` or ``fragment``."""
    return uri_parse(uri)[part]


def uri_serialise(parts: Column) -> Column:
    """A reference from its components; a slash goes between an authority and a path without one."""
    slash = F.when(
        parts["authority"].isNotNull() & (parts["path"] != "") & ~parts["path"].startswith("/")
        & ~parts["authority"].endswith("/"), F.lit("/"),
    ).otherwise(F.lit(""))
    return F.concat(
        F.coalesce(F.concat(parts["scheme"], F.lit(":")), F.lit("")),
        F.coalesce(F.concat(F.lit("//"), parts["authority"]), F.lit("")),
        slash, F.coalesce(parts["path"], F.lit("")),
        F.coalesce(F.concat(F.lit("?"), parts["query"]), F.lit("")),
        F.coalesce(parts["fragment"], F.lit("")),
    )


def uri_resolve(uri: Column, base: Column) -> Column:
    """A reference resolved against a base; leading dot segments only are removed.

    Null for a null reference; unchanged against a base that is null or has no scheme.
    """

    def climbed(path: Column, of: Column) -> Column:
        """Path with leading dot segments, from the base path ``of``."""
        dots = F.regexp_extract(path, r"^(?:(?:\.\.?(?:/|$))|(?:/\.\.?(?=/)))*", 0)

        def from_dots(d: Column) -> Column:
            rest = F.substr(path, F.length(d) + 1)
            ups = F.size(F.regexp_extract_all(d, F.lit(r"(\.\.)"), 1))
            segments = F.split(F.regexp_extract(of, r"^(.*/)[^/]*$", 1), "/")  # "", a, b, ""
            keep = F.greatest(F.size(segments) - 1 - ups, F.when(of.startswith("/"), 1).otherwise(0))
            folder = F.concat(F.array_join(F.slice(segments, F.lit(1), keep), "/"), F.lit("/"))
            return F.when(path.startswith("/") | (keep == 0), rest).otherwise(F.concat(folder, rest))

        return _let(dots, from_dots)

    def full(x: Column) -> Column:
        r, b = x["r"], x["b"]
        path = r[2]
        plain = F.concat(F.regexp_extract(b[2], r"^(.*/)?", 0), path)
        slash = F.when((r[1] != "//") & (r[1] != "") & (path != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
        merged = F.when(path.rlike(r"^/?\.\.?(?:/|$)"), climbed(path, b[2])).when(path.startswith("/"), path).otherwise(plain)
        start = F.when(
            (b[1] != "") & (merged != "") & ~merged.startswith("/") & ~b[1].endswith("/"), F.lit("/")
        ).otherwise(F.lit(""))
        return (
            F.when(r[1].isin("", "//"), F.when(path == "", F.concat(
                b[0], b[1], F.when((b[1] != "") & (b[2] != "") & ~b[2].startswith("/"), F.lit("/")).otherwise(F.lit("")), b[2],
                F.when(F.length(r[3]) > 1, r[3]).otherwise(b[3]), r[4],
            )).otherwise(F.concat(b[0], b[1], start, merged, r[3], r[4])))
            .otherwise(F.concat(b[0], r[1], slash, path, r[3], r[4]))
        )

    both = F.struct(_pieces(uri).alias("r"), _pieces(base).alias("b"))
    rest = _plain_resolved(uri, base, _let(both, full))
    return F.when(uri.isNull() | uri_has_scheme(uri) | ~uri_has_scheme(base), uri).otherwise(rest)


_ROOT, _LAST = r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/", r"[^/?#]*/$"


def _plain_resolved(uri: Column, base: Column, otherwise: Column) -> Column:
    """A reference resolved by plain pieces of the base, where that has an authority and a path; else ``otherwise``.

    What is frequent stays free of lambdas, which no generated code holds.
    """
    piece = lambda pattern: F.regexp_extract(base, pattern, 1)
    folder = piece(rf"^({_ROOT}(?:[^?#]*/)?)")
    found = (
        F.when(uri.startswith("#") | (uri == ""), F.concat(piece(r"^([^#]*)"), uri))
        .when(uri.rlike(r"^\?[^#]"), F.concat(piece(r"^([^?#]*)"), uri))
        .when(uri.rlike(r"^/(?!/|\.\.?(?:[/?#]|$))"), F.concat(piece(rf"^({_ROOT[:-1]})/"), uri))
        .when(uri.rlike(r"^(?!\.\.?(?:[/?#]|$))[^/?#]"), F.concat(folder, uri))
        .when(uri.rlike(r"^\./(?![./])"), F.concat(folder, F.substr(uri, F.lit(3))))
    )
    for n in (1, 2, 3):
        folder = F.regexp_replace(folder, rf"^({_ROOT}(?:[^?#]*/)?){_LAST}", "$1")
        found = found.when(uri.rlike(rf"^(?:\.\./){{{n}}}(?![./])"), F.concat(folder, F.substr(uri, F.lit(3 * n + 1))))
    return F.when(base.rlike("^" + _ROOT), found.otherwise(otherwise)).otherwise(otherwise)


def uri_under(uri: Column, folder: str) -> Column:
    """Whether a URI lies in a folder, given as a URI that ends in a slash below the top."""
    return uri.startswith(folder)


def uri_relative(uri: Column, folder: str) -> Column:
    """A URI as seen from a folder it lies in; itself elsewhere."""
    return F.when(uri_under(uri, folder), F.substr(uri, F.lit(len(folder) + 1))).otherwise(uri)


def uri_to_path(uri: Column) -> Column:
    """Path of a file URI without decoding; other URIs give null, other texts themselves."""
    rest = F.regexp_replace(uri, r"^file:(?://(?:localhost)?(?=/))?", "")
    rest = F.regexp_replace(rest, r"^/(?=[A-Za-z][:|])", "")
    return F.when(uri.startswith("file:"), rest).when(~uri_has_scheme(uri), uri)


# Text


def text_measure(text: Column) -> Column:
    """Struct of characters, bytes and flags (1: line break, 2: double quote)."""
    flags = F.when(F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r")), 1).otherwise(0) + F.when(
        F.contains(text, F.lit('"')), 2
    ).otherwise(0)
    return F.struct(F.length(text).alias("n_chars"), F.octet_length(text).alias("n_bytes"), flags.alias("flags"))


def parse_double(text: Column) -> Column:
    """Number at the start of a text; 0 where there is none."""
    return F.coalesce(F.trim(F.regexp_extract(text, NUMBER, 0)).try_cast("double"), F.when(text.isNotNull(), F.lit(0.0)))


def number_end(text: Column) -> Column:
    """Characters that the number at the start of a text takes; 0 where there is none."""
    return F.length(F.regexp_extract(text, NUMBER, 0))


def cut_bytes(text: Column, most: Column) -> Column:
    """The longest start of a text that takes at most so many bytes and holds whole characters."""
    raw = F.substring(F.encode(text, "utf-8"), F.lit(1), most)
    size = F.length(raw)
    # a character cut at the end shows as its lead byte among the last three, which tells how long it is
    lead = lambda back: F.conv(F.hex(F.substring(raw, size - back + 1, F.lit(1))), 16, 10).cast("int")
    over = (
        F.when((size >= 1) & (lead(1) >= 0xC0), 1).when((size >= 2) & (lead(2) >= 0xE0), 2).when((size >= 3) & (lead(3) >= 0xF0), 3).otherwise(0)
    )
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), size - over), "utf-8"))


def node_of(kind: Column, text: Column, most: Column | None = None) -> Column:
    """Struct of a node: type, text and its measures; with ``most``, of the text's first bytes only."""
    own = text if most is None else cut_bytes(text, most)
    return _let(F.struct(kind.alias("k"), own.alias("v")), lambda x: F.struct(
        x["k"].alias("type"), x["v"].alias("text"), text_measure(x["v"])["n_chars"].alias("n_chars"),
        text_measure(x["v"])["n_bytes"].alias("n_bytes"), text_measure(x["v"])["flags"].alias("flags"),
    ))


def same_folded(a: Column, b: Column) -> Column:
    """Whether two texts are the same but for the case of ASCII letters."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(a, upper, lower) == F.translate(b, upper, lower)


def valid_utf8(raw: Column) -> Column:
    """Text of bytes, each run that is no UTF-8 as U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def decimal_text(value: Column, places: int = 8) -> Column:
    """Decimal text with at most ``places`` digits after the point, one at least."""
    fixed = F.round(value.cast(f"decimal(38,{min(places + 8, 18)})"), places).cast(f"decimal(38,{places})").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", ".0")


def integer_text(value: Column) -> Column:
    """Integer text."""
    return value.cast("bigint").cast("string")


def base64_text(data: Column, wrap: bool = False) -> Column:
    """Base64 of binary data on one line, or with a line feed after every 76 characters."""
    flat = F.regexp_replace(F.base64(data), r"[\r\n]", "")
    return F.regexp_replace(flat, r"(.{76})(?=.)", "$1\n") if wrap else flat


def base64_length(n_bytes: Column, wrap: bool = False) -> Column:
    """Length of the base64 text of so many bytes."""
    flat = F.floor((n_bytes + 2) / 3) * 4
    return flat + F.greatest(F.floor((n_bytes - 1) / 57), F.lit(0)) if wrap else flat


def base64_bytes(text: Column) -> Column:
    """Bytes of base64 text; characters outside the alphabet are skipped, a cut last unit gives what it has."""
    letters = F.regexp_replace(text, r"[^A-Za-z0-9+/]", "")
    over = F.length(letters) % 4
    whole = F.when(over == 1, F.substr(letters, F.lit(1), F.length(letters) - 1)).otherwise(letters)
    return F.unbase64(F.concat(whole, F.when(over == 2, "==").when(over == 3, "=").otherwise("")))


def status_message(status: Column) -> Column:
    """Text of a status code."""
    table = F.create_map(*[F.lit(x) for pair in STATUS_MESSAGES.items() for x in pair])
    return F.coalesce(table[status], F.lit("Unknown error"))


# Escapes

_SIMPLE = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ('"', '\\"')]


def _hex(code: Column, width: int) -> Column:
    return F.lpad(F.hex(code), width, "0")


def escape_text(text: Column, ascii_only: bool = False, turtle: bool = False) -> Column:
    """Body of a short literal: named escapes, and numeric ones for control characters.

    ``ascii_only`` escapes all characters outside ASCII; ``turtle`` adds the names of backspace and
    form feed. Texts with nothing to escape pass unchanged.
    """
    done = text
    for raw, shown in [*_SIMPLE, *([("\b", "\\b"), ("\f", "\\f")] if turtle else [])]:
        done = F.replace(done, F.lit(raw), F.lit(shown))
    # the mark that parts odd characters from the rest is itself one of them
    done = F.replace(done, F.lit(_MARK), F.lit("\\u0001"))
    odd = "[^ -~]" if ascii_only else r"[\x00-\x1f\x7f]"
    return F.when(done.rlike(odd), _numbered(done, odd)).otherwise(done)


_MARK = "\x01"


def _numbered(text: Column, odd: str) -> Column:
    """A text without marks, its odd characters as numeric escapes."""

    def one(c: Column) -> Column:
        code = F.ascii(c)
        number = F.when(code <= 0xFFFF, F.concat(F.lit("\\u"), _hex(code, 4))).otherwise(
            F.concat(F.lit("\\U"), _hex(code, 8))
        )
        return F.when(c.rlike(f"^{odd}$"), number).otherwise(c)

    parts = F.split(F.regexp_replace(text, f"({odd})", f"{_MARK}$1{_MARK}"), _MARK)
    return F.array_join(F.transform(parts, one), "")


def unescape_text(body: Column) -> Column:
    """Text of a literal's body without bad escapes, as the line grammars have it."""
    # an escaped backslash goes first, as a name of its own; then there is a piece for each escape
    marked = F.replace(body, F.lit("\\\\"), F.lit("\\s"))
    pieces = F.split(F.regexp_replace(marked, r"\\u([0-9A-Fa-f]{4})", r"\\U0000$1"), r"\\")

    def one(x: Column, i: Column) -> Column:
        kind, rest = F.substr(x, F.lit(1), F.lit(1)), F.substr(x, F.lit(2))
        wide = F.decode(F.unhex(F.substr(rest, F.lit(1), F.lit(8))), "UTF-32")
        return (
            F.when(i == 0, x)
            .when(kind == "s", F.concat(F.lit("\\"), rest))
            .when(kind == "U", F.concat(wide, F.substr(rest, F.lit(9))))
            .otherwise(F.concat(F.translate(kind, "nrtbf", "\n\r\t\b\f"), rest))
        )

    return F.when(F.contains(body, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(body)


def escape_iri(iri: Column) -> Column:
    """Body of an IRI with numeric escapes for the ASCII characters it must not hold."""
    odd = r"[\x00-\x20<>\"{}|^`\\\x7f]"
    clear = F.replace(iri, F.lit(_MARK), F.lit(""))
    return F.when(iri.rlike(odd), _numbered(clear, odd)).otherwise(iri)


# Terms


def literal_quotes(o_flags: Column) -> Column:
    """The quotes that a literal is written in, by its flags."""
    return F.when(o_flags.bitwiseAND(3) != 0, F.lit('"""')).otherwise(F.lit('"'))


def bare_literal(value: Column, datatype: Column) -> Column:
    """Whether Turtle writes a literal without quotes."""
    name = F.when(datatype.startswith(XSD), F.substr(datatype, F.lit(len(XSD) + 1)))
    point = F.contains(value, F.lit(".")) & ~value.endswith(".")
    return F.coalesce(name.isin("boolean", "integer") | ((name == "decimal") & point), F.lit(False))


def number_datatype(text: Column) -> Column:
    """Datatype that Turtle reads from a bare number or boolean; null for other texts."""
    kind = (
        F.when(text.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(text.rlike(r"^[+-]?(?:[0-9]+\.[0-9]+|\.[0-9]+)$"), "decimal")
        .when(text.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)[eE][+-]?[0-9]+$"), "double")
        .when(text.isin("true", "false"), "boolean")
    )
    return F.concat(F.lit(XSD), kind)


def add_blank_prefix(kind: Column, value: Column, prefix: str | Column) -> Column:
    """Labels of blank nodes with a prefix, so that documents can be put together."""
    return F.when(kind == "BLANK", F.concat(_lit(prefix), value)).otherwise(value)


def chop_blank_prefix(kind: Column, value: Column, prefix: str | Column) -> Column:
    """Labels of blank nodes without a prefix that they start with."""
    p = _lit(prefix)
    return F.when((kind == "BLANK") & F.startswith(value, p), F.substr(value, F.length(p) + 1)).otherwise(value)


def same_node(kind_a: Column, a: Column, kind_b: Column, b: Column) -> Column:
    """Whether two nodes are the same: type and text, absent ones included."""
    return kind_a.eqNullSafe(kind_b) & a.eqNullSafe(b)


def valid_statement(row: dict[str, Column] | None = None) -> Column:
    """Whether a statement can be written: resources in place, no datatype with a language, flags that agree."""
    c = row or {k: F.col(k) for k in ("flags", "s_type", "s", "p_type", "p", "o_type", "o", "o_datatype", "o_lang")}
    resource = lambda t, v: F.coalesce(t.isin("URI", "CURIE", "BLANK"), F.lit(False)) & v.isNotNull()
    has = lambda bits: c["flags"].bitwiseAND(bits) != 0
    clash = (has(64) & has(8 | 2)) | (has(128) & has(16 | 4))
    return (
        resource(c["s_type"], c["s"]) & resource(c["p_type"], c["p"]) & c["o_type"].isNotNull() & c["o"].isNotNull()
        & ~(c["o_datatype"].isNotNull() & c["o_lang"].isNotNull()) & ~F.coalesce(clash, F.lit(False))
    )


# Functions that need Python, on Arrow batches


def _text_function(one: Callable[..., str | None]) -> Callable[..., Column]:
    """A function of texts as one over Arrow batches; null if any argument is."""

    @F.arrow_udf("string")
    def run(*columns: pa.Array) -> pa.Array:
        rows = zip(*[c.to_pylist() for c in columns])
        return pa.array([None if any(x is None for x in row) else one(*row) for row in rows], pa.string())

    return run


def file_uri(path: Column) -> Column:
    """File URI of a path; a relative path stays one."""
    return _text_function(U.file_uri)(path)


def file_path(uri: Column) -> Column:
    """Decoded path of a file URI, null for other URIs; texts without a scheme are paths."""

    def one(text: str) -> str | None:
        path = U.file_path(text)[0]
        return None if path is None else path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")

    return _text_function(one)(uri)


def uri_relative_to(uri: Column, base: Column, root: Column | None = None) -> Column:
    """A URI as seen from a base it is related to, with ``../`` where needed; itself elsewhere.

    With a ``root`` (null: none), only URIs under it are seen from the base, and ``../`` never leaves it.
    """

    @F.arrow_udf("string")
    def run(uris: pa.Array, bases: pa.Array, roots: pa.Array) -> pa.Array:
        rows = zip(uris.to_pylist(), bases.to_pylist(), roots.to_pylist())
        seen = lambda u, b, r: U.relative(U.parse(u), U.parse(b), None if r is None else U.parse(r))
        return pa.array([None if u is None or b is None else seen(u, b, r) for u, b, r in rows], pa.string())

    return run(uri, base, F.lit(None).cast("string") if root is None else root)


def local_name(text: Column) -> Column:
    """Local part of a prefixed name, escaped as it is written."""
    return _text_function(T.local_name)(text)
