"""N-Triples and N-Quads in the JVM: statements to lines, lines to statements.

Lines of the one-line grammar are read and written by expressions; a text source can be split
anywhere between lines. What the grammar does not cover goes to the parser, line by line.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.columns import escape_iri, escape_text, unescape_text, valid_statement
from termloom.functions.terms import CHARS, CHARS_U
from termloom.schema import LITERAL
from termloom.sources.parser import parse
from termloom.util import free_name


_ROWS_ARROW = pa.list_(
    pa.struct([(n, pa.int32() if n in ("o_flags", "status", "col") else pa.string()) for n in (
        "kind", "g_type", "g", "s_type", "s", "p_type", "p", "o_type", "o", "o_flags", "o_datatype_type", "o_datatype",
        "o_lang", "status", "col", "message",
    )])
)


def _java(chars: str) -> str:
    """A character class with its wide characters as Java writes them."""
    return "".join(c if ord(c) < 0x80 else f"\\x{{{ord(c):X}}}" for c in chars)


# Runs of plain characters are taken whole: the matcher recurses once per escape, not per character.
_U = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}"
_IRI = rf'<([A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20<>"{{}}|^`\\]*+(?:(?:{_U})[^\x00-\x20<>"{{}}|^`\\]*+)*+)>'
_BLANK = rf"_:([{_java(CHARS_U)}0-9](?:[{_java(CHARS)}.]*[{_java(CHARS)}])?)"
_TEXT = rf'"([^"\\\n\r]*+(?:(?:\\[tbnrf"\'\\]|{_U})[^"\\\n\r]*+)*+)"'
#: Escapes in a line that the expressions read at most; lines with more go to the parser.
MOST_ESCAPES = 500
_WS = r"[ \t]*"
LINE = (
    rf"^{_WS}(?:{_IRI}|{_BLANK}){_WS}{_IRI}{_WS}(?:{_IRI}|{_BLANK}|{_TEXT}(?:\^\^{_IRI}|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)"
    rf"{_WS}(?:{_IRI}|{_BLANK})?{_WS}\.{_WS}(?:#.*)?$"
)
#: The groups of a line in the order they are taken apart; the text, which may hold the mark, is last.
_ORDER = ("s_iri", "s_blank", "p_iri", "o_iri", "o_blank", "dt_iri", "lang", "g_iri", "g_blank", "o_text")
_JOINED = "\x01".join(f"${i}" for i in (1, 2, 3, 4, 5, 7, 8, 9, 10, 6))
NOTHING = r"^[ \t\r]*(?:#.*)?$"
#: Escapes that stand for no character, which the parser judges.
_NO_CHARACTER = r"\\u[dD][89a-fA-F][0-9A-Fa-f]{2}|\\U(?:0000[dD][89a-fA-F]|00(?:[2-9A-Fa-f]|1[1-9A-Fa-f])|0[1-9A-Fa-f]|[1-9A-Fa-f])"

ROW = T.StructType(
    [T.StructField(n, T.IntegerType() if n in ("o_flags", "status", "col") else T.StringType()) for n in (
        "kind", "g_type", "g", "s_type", "s", "p_type", "p", "o_type", "o", "o_flags", "o_datatype_type", "o_datatype",
        "o_lang", "status", "col", "message",
    )]
)


def term_text(kind: Column, value: Column, ascii_only: bool = False) -> Column:
    """A URI or blank node as it stands in a line; null for other nodes."""
    iri = escape_text(escape_iri(value), True) if ascii_only else escape_iri(value)
    if ascii_only:  # numeric escapes of the IRI are already there
        iri = F.when(value.rlike(r"[^ -~]"), F.replace(iri, F.lit("\\\\u"), F.lit("\\u"))).otherwise(escape_iri(value))
    return F.when(kind == "URI", F.concat(F.lit("<"), iri, F.lit(">"))).when(
        kind == "BLANK", F.concat(F.lit("_:"), value)
    )


def statement_line(quads: bool = True, ascii_only: bool = False, typed: bool = False, **names: str) -> Column:
    """The line of a statement; null for one that cannot be written, such as with an unexpanded name.

    ``typed``: whether to look at the column ``o_datatype_type``; datatypes are URIs else.
    """
    c = {k: F.col(names.get(k, k)) for k in (
        "flags", "g_type", "g", "s_type", "s", "p_type", "p", "o_type", "o", "o_datatype", "o_lang",
    )}
    tail = F.when(c["o_lang"].isNotNull(), F.concat(F.lit("@"), c["o_lang"])).when(
        c["o_datatype"].isNotNull(), F.concat(F.lit("^^"), term_text(F.lit("URI"), c["o_datatype"], ascii_only))
    ).otherwise(F.lit(""))
    literal = F.concat(F.lit('"'), escape_text(c["o"], ascii_only), F.lit('"'), tail)
    obj = F.when(c["o_type"] == LITERAL, literal).otherwise(term_text(c["o_type"], c["o"], ascii_only))
    parts = [term_text(c["s_type"], c["s"], ascii_only), term_text(c["p_type"], c["p"], ascii_only), obj]
    whole = F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2])
    if quads:
        graph = F.when(c["g_type"].isNull(), F.lit("")).otherwise(
            F.concat(F.lit(" "), term_text(c["g_type"], c["g"], ascii_only))
        )
        whole = F.concat(whole, graph)
    named = F.coalesce(F.col(names.get("o_datatype_type", "o_datatype_type")) == "CURIE", F.lit(False)) if typed else F.lit(False)
    return F.when(valid_statement(c) & ~named, F.concat(whole, F.lit(" .")))


def refusal(quads: bool = True, **names: str) -> Column:
    """Why a statement has no line; null for one that has. Cheap, as it looks at types and nulls only."""
    c = {k: F.col(names.get(k, k)) for k in (
        "flags", "g_type", "g", "s_type", "s", "p_type", "p", "o_type", "o", "o_datatype_type", "o_datatype", "o_lang",
    )}
    order = [("s_type", "s"), ("p_type", "p"), ("o_type", "o"), ("o_datatype_type", "o_datatype"), *([("g_type", "g")] if quads else [])]
    name = F.coalesce(*[F.when(c[t] == "CURIE", c[v]) for t, v in order])
    undefined = F.concat(F.lit("undefined namespace prefix '"), name, F.lit("'"))
    return F.when(~valid_statement(c), "incoherent statement").otherwise(undefined)


def _slow_rows(line: str, syntax: str, strict: bool) -> list[dict]:
    """Statements and errors of a line that the fast grammar does not cover."""
    rows = []
    for e in parse(line, syntax, strict):
        if e[0] == "statement":
            none = (None, None)
            terms = (*(e[2] or none), *e[3], *e[4], *e[5], e[6], *(e[7] or none), e[8])
            rows.append(dict(zip(ROW.names, ("statement", *terms, None, None, None))))
        elif e[0] == "error":
            rows.append(dict(zip(ROW.names, ("error", *[None] * 12, e[1], e[3], e[4]))))
    return rows


def read_lines(lines: DataFrame, syntax: str = "nquads", strict: bool = True, column: str = "value") -> DataFrame:
    """Statements and errors of a table with one line per row; its other columns are kept.

    Every row of the result is a statement (``kind``) or the error of its line. Lines are read
    independently, so an error never stops the lines after it: this is the lax way of reading, with
    the errors as rows; filter or count them to be strict. ``o_flags`` tells line breaks and quotes.
    Null lines, blank ones and comments give nothing. Graphs in N-Triples are errors.
    """
    keys = [c for c in lines.columns if c != column]
    line, groups = F.col(column), free_name(lines, "_groups")
    escapes = F.length(line) - F.length(F.replace(line, F.lit("\\"), F.lit("")))
    odd = F.contains(line, F.lit("\\")) & ((escapes > MOST_ESCAPES) | line.rlike(_NO_CHARACTER))
    found = F.when(odd, line).otherwise(F.regexp_replace(line, LINE, _JOINED))
    split = lines.select(*keys, column, found.alias(groups))  # a line of the grammar is changed, any other is not
    fast = F.col(groups) != line
    if syntax == "ntriples":
        fast = fast & F.col(groups).rlike(r"^(?:[^\x01]*\x01){7}\x01\x01")
    part = {n: F.col("_p")[i] for i, n in enumerate(_ORDER)}
    kind = lambda n: F.when(part[f"{n}_iri"] != "", "URI").when(part[f"{n}_blank"] != "", "BLANK")
    iri = lambda n: unescape_text(part[f"{n}_iri"])
    value = lambda n: F.when(part[f"{n}_iri"] != "", iri(n)).when(part[f"{n}_blank"] != "", part[f"{n}_blank"])
    o_type = F.coalesce(kind("o"), F.lit(LITERAL))
    text = unescape_text(part["o_text"])
    bare = F.regexp_replace(part["o_text"], r"\\.", "")
    lines_in = part["o_text"].rlike(r"\\[nr]|\\u000[AaDd]|\\U0000000[AaDd]") & part["o_text"].rlike(
        r"(?:^|[^\\])(?:\\\\)*\\(?:[nr]|u000[AaDd]|U0000000[AaDd])"
    )
    flags = F.when(lines_in, 1).otherwise(0) + F.when(F.contains(bare, F.lit("'")), 2).otherwise(0)
    none = F.lit(None).cast("string")
    good = F.struct(
        F.lit("statement").alias("kind"),
        kind("g").alias("g_type"), value("g").alias("g"),
        kind("s").alias("s_type"), value("s").alias("s"),
        F.lit("URI").alias("p_type"), iri("p").alias("p"),
        o_type.alias("o_type"), F.coalesce(value("o"), text).alias("o"),
        F.when(o_type == LITERAL, flags).otherwise(0).alias("o_flags"),
        F.when(part["dt_iri"] != "", "URI").alias("o_datatype_type"),
        F.when(part["dt_iri"] != "", iri("dt")).alias("o_datatype"),
        F.when(part["lang"] != "", part["lang"]).alias("o_lang"),
        F.lit(None).cast("int").alias("status"), F.lit(None).cast("int").alias("col"), none.alias("message"),
    )

    @F.arrow_udf(T.ArrayType(ROW))
    def slow(values: pa.Array) -> pa.Array:
        rows = [None if v is None else _slow_rows(v, syntax, strict) for v in values.to_pylist()]
        return pa.array(rows, _ROWS_ARROW)

    # One pass over the lines and no filter, which would be pushed down and repeat the matching. The worker
    # sees only the lines that the expressions leave over; the others are null to it.
    left_over = ~fast & ~line.rlike(NOTHING)
    judged = split.select(
        *keys, F.when(fast, F.split(groups, "\x01", len(_ORDER))).alias("_p"), F.when(left_over, line).alias("_rest")
    )
    statement = F.when(F.col("_p").isNotNull(), F.array(good))
    both = judged.select(*keys, F.explode(F.coalesce(slow("_rest"), statement)).alias("_row"))
    return both.select(*keys, "_row.*")


def scan(spark: SparkSession, path: str, syntax: str = "nquads", strict: bool = True) -> DataFrame:
    """Statements and errors of line files, split between lines; ``doc`` is the file's path."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("doc"), "value")
    return read_lines(text, syntax, strict)
