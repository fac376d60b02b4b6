"""Statements and events as rows: schemas, node types, flags and statuses."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model: node types, statement flags, literal flags, statuses.
URI, CURIE, BLANK, LITERAL = "URI", "CURIE", "BLANK", "LITERAL"
EMPTY_S, EMPTY_O = 2, 4
ANON_S_BEGIN, ANON_O_BEGIN, ANON_CONT = 8, 16, 32
LIST_S_BEGIN, LIST_O_BEGIN, LIST_CONT = 64, 128, 256
HAS_NEWLINE, HAS_QUOTE = 1, 2
STATUS_MESSAGES = {
    0: "Success", 1: "Non-fatal failure", 2: "Unknown error", 3: "Invalid syntax", 4: "Invalid argument",
    5: "Not found", 6: "Blank node ID clash", 7: "Invalid CURIE", 8: "Internal error", 9: "Error writing to file",
    10: "Invalid text encoding",
}
BAD_SYNTAX, BAD_ARG, ID_CLASH, BAD_CURIE, BAD_TEXT = 3, 4, 6, 7, 10

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE, RDF_FIRST, RDF_REST, RDF_NIL = RDF + "type", RDF + "first", RDF + "rest", RDF + "nil"

SYNTAXES = ("turtle", "ntriples", "nquads", "trig")
EXTENSIONS = {".ttl": "turtle", ".nt": "ntriples", ".nq": "nquads", ".trig": "trig"}

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()

STATEMENT = T.StructType(
    [
        T.StructField(n, t)
        for n, t in [
            ("doc", _S), ("seq", _L), ("flags", _I), ("g_type", _S), ("g", _S), ("s_type", _S), ("s", _S),
            ("p_type", _S), ("p", _S), ("o_type", _S), ("o", _S), ("o_flags", _I), ("o_datatype_type", _S),
            ("o_datatype", _S), ("o_lang", _S),
        ]
    ]
)

EVENT = T.StructType(
    [
        T.StructField("kind", _S),
        *STATEMENT.fields,
        *[
            T.StructField(n, t)
            for n, t in [("name", _S), ("uri", _S), ("status", _I), ("line", _I), ("col", _I), ("message", _S)]
        ],
    ]
)


def syntax_of(path: str) -> str:
    """Syntax that a file's extension stands for, in any case; TriG where it tells nothing."""
    lower = path.lower()
    return next((s for e, s in EXTENSIONS.items() if lower.endswith(e)), "trig")
