"""Queries over small fixed documents: every production, layout rule and option, against results written out by hand.

The documents are rows of a table that the plan itself holds. What they say is in ``CASES`` beside them and becomes
the SQL, so neither side is computed from the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import columns as C
from termloom.operators import documents
from termloom.sources import lines
from termloom.streaming import chunks
from termloom.util import shared_folder

QUERIES, ORACLE = {}, {}
_INPUT = "doc string, syntax string, bytes binary, base_uri string, strict boolean"

E, X = "http://e.example/", "http://www.w3.org/2001/XMLSchema#"
R = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
EP = f"prefix e <{E}>"
P = f"@prefix e: <{E}> .\n"


def _e(name: str) -> str:
    return f"<{E}{name}>"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    """The rows as a table in SQL."""
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else _quote(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


# What documents say. Case: name, syntax, strict, text, base, then an event a line: "flags: s p o g", directives, ends, errors
# as "error status line:column".

_TERMS = [
    ("iri", "turtle", True, "<http://a> <http://b#\\u00E9> <http://c/%41?q#f> .", None, ["0: <http://a> <http://b#é> <http://c/%41?q#f>"]),
    ("relative iri", "turtle", True, "<a> <#b> <../c> .", "http://h.example/x/y", ["0: <http://h.example/x/a> <http://h.example/x/y#b> <http://h.example/c>"]),
    ("names", "turtle", True, P + "e:a e:b.c e:d\\,e%41 . e: e:1 e:x:y .", None,
     [EP, f"0: {_e('a')} {_e('b.c')} {_e('d,e%41')}", f"0: <{E}> {_e('1')} {_e('x:y')}"]),
    ("a", "turtle", True, P + "e:x a e:C ; a e:D .", None, [EP, f"0: {_e('x')} <{R}type> {_e('C')}", f"0: {_e('x')} <{R}type> {_e('D')}"]),
    ("lists of objects", "turtle", True, P + "e:s e:p e:o , e:o2 ;; e:q e:r ; .", None,
     [EP, f"0: {_e('s')} {_e('p')} {_e('o')}", f"0: {_e('s')} {_e('p')} {_e('o2')}", f"0: {_e('s')} {_e('q')} {_e('r')}"]),
    ("numbers", "turtle", True, P + "e:s e:p 1 , -2.50 , +.5 , 1e3 , 4.E-2 , 7.", None,
     [EP, *[f'0: {_e("s")} {_e("p")} "{v}"^^<{X}{t}>' for v, t in (("1", "integer"), ("-2.50", "decimal"), ("+.5", "decimal"), ("1e3", "double"), ("4.E-2", "double"), ("7", "integer"))]]),
    ("booleans", "turtle", True, P + "e:s e:p true,false .", None, [EP, f'0: {_e("s")} {_e("p")} "true"^^<{X}boolean>', f'0: {_e("s")} {_e("p")} "false"^^<{X}boolean>']),
    ("short strings", "turtle", True, P + "e:s e:p \"a\\tb\\n\" , 'it\"s' , \"\" , '\\U0001F600\\u00e9\\\\' .", None,
     [EP, f'0: {_e("s")} {_e("p")} "a\\tb\\n"', f'0: {_e("s")} {_e("p")} "it\\"s"', f'0: {_e("s")} {_e("p")} ""', f'0: {_e("s")} {_e("p")} "😀é\\\\"']),
    ("long strings", "turtle", True, P + 'e:s e:p """a "b" ""c\nd""" , \'\'\'x\'y\'\'\' .', None,
     [EP, f'0: {_e("s")} {_e("p")} "a \\"b\\" \\"\\"c\\nd"', f'0: {_e("s")} {_e("p")} "x\'y"']),
    ("tagged", "turtle", True, P + '@prefix x: <http://x.example/> . e:s e:p "a"@en-GB , "b"^^x:t , "c"^^<http://t> .', None,
     [EP, "prefix x <http://x.example/>", f'0: {_e("s")} {_e("p")} "a"@en-GB', f'0: {_e("s")} {_e("p")} "b"^^<http://x.example/t>', f'0: {_e("s")} {_e("p")} "c"^^<http://t>']),
    ("labels", "turtle", True, P + "_:x e:p _:y.z . _:b1 e:p _:b2x . _:B3 e:p _:q .", None, [EP, f"0: _:x {_e('p')} _:y.z", f"0: _:B1 {_e('p')} _:B2x", "error 6 2:33"]),
    ("comments", "turtle", True, "# one\n" + P + "e:s # two\n\te:p\r\n e:o# three\n.#end", None, [EP, f"0: {_e('s')} {_e('p')} {_e('o')}"]),
    ("letters", "turtle", True, "@prefix é: <http://x/> . é:ñ é:日本 é:a·b .", None, ["prefix é <http://x/>", "0: <http://x/ñ> <http://x/日本> <http://x/a·b>"]),
]
_SCOPES = [
    ("base", "turtle", True, "@base <http://h/d/> . <a> <b> <c> . @base <e/> . <a> <b> </c> .", None,
     ["base <http://h/d/>", "0: <http://h/d/a> <http://h/d/b> <http://h/d/c>", "base <http://h/d/e/>", "0: <http://h/d/e/a> <http://h/d/e/b> <http://h/c>"]),
    ("sparql forms", "turtle", True, "BASE <http://h/>\nPREFIX p: <q#>\np:a p:b <c> .", None, ["base <http://h/>", "prefix p <http://h/q#>", "0: <http://h/q#a> <http://h/q#b> <http://h/c>"]),
    ("redefined", "turtle", True, "@prefix : <http://a/> . :x :y :z . @prefix : <http://b/> . :x :y :z .", None,
     ["prefix  <http://a/>", "0: <http://a/x> <http://a/y> <http://a/z>", "prefix  <http://b/>", "0: <http://b/x> <http://b/y> <http://b/z>"]),
    ("undefined", "turtle", True, "n:x n:y <http://z> .", None, ["0: n:x n:y <http://z>"]),
    ("dots", "turtle", True, "<../../x> <./y> <?q> .", "http://h/a/b", ["0: <http://h/x> <http://h/a/y> <http://h/a/b?q>"]),
    ("other scheme", "turtle", True, "<urn:a:b> <mailto:x> <file:///p> .", "http://h/a/b", ["0: <urn:a:b> <mailto:x> <file:///p>"]),
]
_NODES = [
    ("empty object", "turtle", True, P + "e:s e:p [] .", None, [EP, f"4: {_e('s')} {_e('p')} _:b1"]),
    ("empty subject", "turtle", True, P + "[] e:p e:o ; e:q e:r .", None, [EP, f"2: _:b1 {_e('p')} {_e('o')}", f"0: _:b1 {_e('q')} {_e('r')}"]),
    ("object node", "turtle", True, P + "e:s e:p [ e:q 'x' ; e:r [ e:t e:u ] ] , e:o .", None,
     [EP, f"16: {_e('s')} {_e('p')} _:b1", f'32: _:b1 {_e("q")} "x"', f"48: _:b1 {_e('r')} _:b2", f"32: _:b2 {_e('t')} {_e('u')}", "end _:b2", "end _:b1", f"0: {_e('s')} {_e('p')} {_e('o')}"]),
    ("subject node", "turtle", True, P + "[ e:p e:o ] e:q e:r . [ e:p e:o ] .", None,
     [EP, f"8: _:b1 {_e('p')} {_e('o')}", "end _:b1", f"0: _:b1 {_e('q')} {_e('r')}", f"8: _:b2 {_e('p')} {_e('o')}", "end _:b2"]),
    ("named node", "turtle", True, P + "e:s e:p [ == e:n ; e:q e:r ] .", None, [EP, f"16: {_e('s')} {_e('p')} {_e('n')}", f"32: {_e('n')} {_e('q')} {_e('r')}", f"end {_e('n')}"]),
]
_LISTS = [
    ("empty list", "turtle", True, P + "e:s e:p () .", None, [EP, f"0: {_e('s')} {_e('p')} <{R}nil>"]),
    ("object list", "turtle", True, P + "e:s e:p ( e:a 2 ) .", None,
     [EP, f"128: {_e('s')} {_e('p')} _:b1", f"256: _:b1 <{R}first> {_e('a')}", f"256: _:b1 <{R}rest> _:b2", f'256: _:b2 <{R}first> "2"^^<{X}integer>', f"256: _:b2 <{R}rest> <{R}nil>"]),
    ("subject list", "turtle", True, P + "( e:a ) e:p e:o .", None, [EP, f"64: _:b1 <{R}first> {_e('a')}", f"256: _:b1 <{R}rest> <{R}nil>", f"0: _:b1 {_e('p')} {_e('o')}"]),
    ("list in list", "turtle", True, P + "e:s e:p ( ( e:a ) ) .", None,
     [EP, f"128: {_e('s')} {_e('p')} _:b1", f"384: _:b1 <{R}first> _:b2", f"256: _:b2 <{R}first> {_e('a')}", f"256: _:b2 <{R}rest> <{R}nil>", f"256: _:b1 <{R}rest> <{R}nil>"]),
]
_GRAPHS = [
    ("default block", "trig", True, P + "{ e:a e:b e:c . e:d e:e e:f }", None, [EP, f"0: {_e('a')} {_e('b')} {_e('c')}", f"0: {_e('d')} {_e('e')} {_e('f')}"]),
    ("named block", "trig", True, P + "e:g { e:a e:b e:c } e:a e:b e:c . GRAPH <http://g> { e:a e:b e:c . }", None,
     [EP, f"0: {_e('a')} {_e('b')} {_e('c')} {_e('g')}", f"0: {_e('a')} {_e('b')} {_e('c')}", f"0: {_e('a')} {_e('b')} {_e('c')} <http://g>"]),
    ("blank block", "trig", True, P + "_:g { e:a e:b e:c } [] { e:a e:b [] }", None, [EP, f"0: {_e('a')} {_e('b')} {_e('c')} _:g", f"4: {_e('a')} {_e('b')} _:b2 _:b1"]),
    ("quads", "nquads", True, '<http://a> <http://b> "c\\u00e9" <http://g> . # x\n\n_:a <http://b> _:c .\n<http://a> <http://b> "1"^^<http://t> _:g .', None,
     ['0: <http://a> <http://b> "cé" <http://g>', "0: _:a <http://b> _:c", '0: <http://a> <http://b> "1"^^<http://t> _:g']),
    ("triples", "ntriples", True, '<http://a> <http://b> "c"@en .\n<http://a> <http://b> <http://c> .', None, ['0: <http://a> <http://b> "c"@en', "0: <http://a> <http://b> <http://c>"]),
]
_FAULTS = [
    ("strict stops", "turtle", True, P + "e:a e:b e:c .\ne:a e:b .\ne:d e:e e:f .", None, [EP, f"0: {_e('a')} {_e('b')} {_e('c')}", "error 3 3:8"]),
    ("lax goes on", "turtle", False, P + "e:a e:b e:c .\ne:a e:b .\ne:d e:e e:f .", None, [EP, f"0: {_e('a')} {_e('b')} {_e('c')}", "error 3 3:8", f"0: {_e('d')} {_e('e')} {_e('f')}"]),
    ("said before the fault", "turtle", False, P + "e:a e:b e:c ; e:d ] .\ne:x e:y e:z .", None, [EP, f"0: {_e('a')} {_e('b')} {_e('c')}", "error 3 2:18", f"0: {_e('x')} {_e('y')} {_e('z')}"]),
    ("graph in turtle", "turtle", True, "{ <http://a> <http://b> <http://c> }", None, ["error 3 1:1"]),
    ("scheme", "nquads", True, "<a> <http://b> <http://c> .", None, ["error 3 1:2"]),
    ("abbreviated triples", "ntriples", True, '<http://a> <http://b> "x" , "y" .', None, ['0: <http://a> <http://b> "x"', "error 3 1:27"]),
    ("end in a string", "turtle", True, '<http://a> <http://b> "x', None, ["error 3 1:25"]),
    ("break in a string", "turtle", True, '<http://a> <http://b> "x\n" .', None, ["error 3 1:25"]),
    ("escape", "turtle", True, '<http://a> <http://b> "\\q" .', None, ["error 3 1:25"]),
    ("iri character", "turtle", True, "<http://a b> <http://b> <http://c> .", None, ["error 3 1:10"]),
    ("directive", "turtle", True, "@nonsense <http://a> .", None, ["error 3 1:2"]),
    ("lone list", "turtle", True, P + "( e:a ) .", None, [EP, f"64: _:b1 <{R}first> {_e('a')}", f"256: _:b1 <{R}rest> <{R}nil>", "error 3 2:8"]),
    ("lone list, lax", "turtle", False, P + "( e:a ) .", None, [EP, f"64: _:b1 <{R}first> {_e('a')}", f"256: _:b1 <{R}rest> <{R}nil>"]),
]
_BYTES = [
    ("mark", "turtle", True, b"\xef\xbb\xbf<http://a> <http://b> <http://c> .", None, ["0: <http://a> <http://b> <http://c>"]),
    ("broken mark", "turtle", True, b"\xef\xbb<http://a> <http://b> <http://c> .", None, ["error 3 1:1"]),
    ("not UTF-8", "turtle", True, b'<http://a> <http://b> "\xff" .', None, ["error 10 1:23"]),
    ("not UTF-8, lax", "turtle", False, b'<http://a> <http://b> "x\xffy" .', None, ['0: <http://a> <http://b> "x�y"']),
    ("NUL between items", "turtle", True, b"<http://a> <http://b> <http://c> .\0<http://d> <http://b> <http://c> .", None, ["0: <http://a> <http://b> <http://c>", "0: <http://d> <http://b> <http://c>"]),
    ("nothing", "turtle", True, b"", None, []),
    ("null syntax", None, True, b"<http://g> { <http://a> <http://b> <http://c> }", None, ["0: <http://a> <http://b> <http://c> <http://g>"]),
]


def _inputs(spark: SparkSession, cases: list[tuple]) -> DataFrame:
    rows = [(doc, syntax, bytearray(text if isinstance(text, bytes) else text.encode()), base, strict) for doc, syntax, strict, text, base, *_ in cases]
    return spark.createDataFrame(rows, _INPUT)


def _said(events: DataFrame) -> DataFrame:
    """(doc, seq, event): events as text, as the cases have them."""
    names = ("g_type", "g", "s_type", "s", "p_type", "p", "o_type", "o", "o_datatype", "o_lang")
    term = lambda k, v: F.when(F.col(k) == "CURIE", F.col(v)).otherwise(lines.term_text(F.col(k), F.col(v)))
    literal = F.concat(
        F.lit('"'), C.escape_text(F.col("o")), F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang")))
        .when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">"))).otherwise(""),
    )
    obj = F.when(F.col("o_type") == "LITERAL", literal).otherwise(term("o_type", "o"))
    graph = F.coalesce(F.concat(F.lit(" "), term("g_type", "g")), F.lit(""))
    text = (
        F.when(F.col("kind") == "statement", F.concat(F.col("flags").cast("string"), F.lit(": "), term("s_type", "s"), F.lit(" "), term("p_type", "p"), F.lit(" "), obj, graph))
        .when(F.col("kind") == "prefix", F.concat(F.lit("prefix "), "name", F.lit(" <"), "uri", F.lit(">")))
        .when(F.col("kind") == "base", F.concat(F.lit("base <"), "uri", F.lit(">")))
        .when(F.col("kind") == "end", F.concat(F.lit("end "), term("s_type", "s")))
        .otherwise(F.concat(F.lit("error "), F.col("status").cast("string"), F.lit(" "), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string")))
    )
    assert set(names) <= set(events.columns)
    return events.select("doc", "seq", text.alias("event"))


def _said_sql(cases: list[tuple]) -> str:
    return _values([(c[0], n, e) for c in cases for n, e in enumerate(c[5])], "doc, seq, event").replace("SELECT *", "SELECT doc, CAST(seq AS BIGINT) AS seq, event")


def _add(name: str, about: str, query, sql: str) -> None:  # noqa: ANN001
    query.__name__, query.__doc__ = name, about
    QUERIES[name], ORACLE[name] = query, sql


for _name, _about, _cases in (
    ("read_terms", "IRIs, prefixed names, labels, numbers, booleans, strings, tags, lists of verbs and objects.", _TERMS),
    ("read_scopes", "Bases and prefixes, each in the scope of its place.", _SCOPES),
    ("read_nodes", "Anonymous and named nodes, with flags and ends.", _NODES),
    ("read_lists", "Collections as statements with flags.", _LISTS),
    ("read_graphs", "Graph blocks, quads and triples.", _GRAPHS),
    ("read_faults", "Errors with status, line and column; strict reading stops, lax reading goes on.", _FAULTS),
    ("read_bytes", "Byte order marks, bytes that are no UTF-8, NUL, nothing.", _BYTES),
):
    _add(_name, _about, lambda spark, sf_dir, cases=_cases: _said(documents.read_documents(_inputs(spark, cases))), _said_sql(_cases))


# The same documents cut into pieces of a stream

_PIECED = [c for c in (*_TERMS, *_NODES, *_LISTS, *_GRAPHS[:3], *_FAULTS) if c[1] == "turtle" and c[4] is None and not c[2]] + [
    (c[0], *c[1:]) for c in (*_TERMS, *_NODES, *_LISTS) if c[4] is None and not any(e.startswith("error") for e in c[5])
]


def stream_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive seven bytes a piece, a few files a trigger, through stateful parsing."""
    folder = shared_folder(spark, "pieces")
    pieces = spark.createDataFrame([(c[0], bytearray(c[3].encode())) for c in _PIECED], "stream string, all binary")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("all") - 1, F.lit(0)), F.lit(7)))
    cut = pieces.select("stream", "all", at.alias("at")).select(
        "stream", (F.col("at") / 7).cast("int").alias("n"), F.substring("all", F.col("at") + 1, F.lit(7)).alias("bytes"),
        (F.col("at") + 7 >= F.length("all")).alias("final"), (F.col("at") / 70).cast("int").alias("part"),
    )
    for part in range(3):  # later pieces come in later files
        own = F.least("part", F.lit(2)) == part
        cut.where(own).drop("part").coalesce(1).write.mode("append" if part else "overwrite").parquet(folder)
    source = spark.readStream.schema("stream string, n int, bytes binary, final boolean").option("maxFilesPerTrigger", 1).parquet(folder)
    return _drained(spark, chunks.parse_stream(source), "pieces")


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that arrive in files, read in the JVM as a stream."""
    folder = shared_folder(spark, "lines")
    rows = spark.createDataFrame([(c[0], line, k) for c in _GRAPHS[3:] for k, line in enumerate(c[3].split("\n"))], "doc string, value string, k int")
    rows.write.mode("overwrite").parquet(folder)
    source = spark.readStream.schema("doc string, value string, k int").parquet(folder)
    found = chunks.line_stream(source).select("doc", "k", "kind", F.lit(0).alias("flags"), *[F.lit(None).cast(t).alias(n) for n, t in (("name", "string"), ("uri", "string"), ("line", "int"))],
        "status", "col", *[n for p in "gspo" for n in (f"{p}_type", p)], "o_datatype", "o_lang", F.col("k").cast("bigint").alias("seq"))
    return _said(_drained_rows(spark, found, "lines")).drop("seq")


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    return _said(_drained_rows(spark, stream, name))


def _drained_rows(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The rows of a stream that is run until nothing is left."""
    out, state = shared_folder(spark, name), shared_folder(spark, f"{name}-state")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_add("stream_pieces", stream_pieces.__doc__, stream_pieces, _said_sql(_PIECED))
_add("stream_lines", stream_lines.__doc__, stream_lines,
     _values([(c[0], e) for c in _GRAPHS[3:] for e in c[5]], "doc, event"))


# What documents look like when they are written. Case: name, input syntax, text, output syntax, options, result.

_RICH = P + "e:s a e:C ; e:p e:o , e:o2 ; e:n [ e:q 1 ; e:r [] ] , [ e:q 2.5 ] ; e:l ( e:a ( ) [ e:q true ] ) .\n[ e:p 'x' ] e:q \"y\"@en .\n( 1 ) e:p e:o .\n[] e:p 1e3 ."
_WRITE = [
    ("turtle layout", "turtle", _RICH, "turtle", {},
     P + "\ne:s\n\ta e:C ;\n\te:p e:o ,\n\t\te:o2 ;\n\te:n [\n\t\te:q 1 ;\n\t\te:r []\n\t] , [\n\t\te:q 2.5\n\t] ;\n\te:l (\n\t\te:a\n\t\t()\n\t\t[\n\t\t\te:q true\n\t\t]\n\t) .\n"
     "\n[\n\te:p \"x\"\n]\n\te:q \"y\"@en .\n\n(\n\t1\n)\n\te:p e:o .\n\n[]\n\te:p \"1e3\"^^<" + X + "double> .\n"),
    ("objects then nodes", "turtle", P + "e:s e:p e:a , [ e:q e:r ] , ( 1 ) , e:b .", "turtle", {},
     P + "\ne:s\n\te:p e:a ,\n\t[\n\t\te:q e:r\n\t] , (\n\t\t1\n\t) ,\n\t\te:b .\n"),
    ("trig blocks", "trig", P + "e:a e:b e:c . e:g { e:a e:b e:c ; e:d 'x' . e:e e:b e:c } e:h { e:a e:b e:c }", "trig", {},
     P + "\ne:a\n\te:b e:c .\n\ne:g {\n\te:a\n\t\te:b e:c ;\n\t\te:d \"x\" .\n\n\te:e\n\t\te:b e:c .\n}\n\ne:h {\n\te:a\n\t\te:b e:c .\n}\n"),
    ("turtle drops graphs", "trig", P + "e:g { e:a e:b e:c }", "turtle", {}, P + "\ne:a\n\te:b e:c .\n"),
    ("triples", "turtle", P + "e:s e:p [ e:q 'é\\n\"\\u0001' ] .", "ntriples", {}, f'<{E}s> <{E}p> _:b1 .\n_:b1 <{E}q> "\\u00E9\\n\\"\\u0001" .\n'),
    ("quads", "trig", P + "e:g { e:s e:p 'é' }", "nquads", {}, f'<{E}s> <{E}p> "é" <{E}g> .\n'),
    ("ascii quads", "trig", P + "e:g { e:s e:p 'é😀' }", "nquads", {"ascii": True}, f'<{E}s> <{E}p> "\\u00E9\\U0001F600" <{E}g> .\n'),
    ("long strings", "turtle", P + "e:s e:p 'a\\nb\"' , \"'\" , '''\"\"\"q\"\"\"''' .", "turtle", {},
     P + '\ne:s\n\te:p """a\nb\\"""" ,\n\t\t"""\'""" ,\n\t\t"""""\\"q""\\"""" .\n'),
    ("escapes in turtle", "turtle", P + "e:s e:p '\\b\\f\\t\\\\' .", "turtle", {}, P + '\ne:s\n\te:p "\\b\\f\\t\\\\" .\n'),
    ("escapes in trig", "turtle", P + "e:s e:p '\\b\\f' .", "trig", {}, P + '\ne:s\n\te:p "\\u0008\\u000C" .\n'),
    ("names", "turtle", P + "e:a\\,b e:c%20 e:d.e .", "turtle", {}, P + "\ne:a\\,b\n\te:c\\%20 e:d.e .\n"),
    ("qualified", "turtle", P + f"<{E}s> <{E}p> <{E}o> , <http://other/x> .", "turtle", {}, P + "\ne:s\n\te:p e:o ,\n\t\t<http://other/x> .\n"),
    ("full", "turtle", P + f"<{E}s> <{E}p> <{E}o> .", "turtle", {"full_uris": True}, P + f"\n<{E}s>\n\t<{E}p> <{E}o> .\n"),
    ("relative again", "turtle", "@base <http://h/d/> . <a> <b> <http://h/d/c> , <http://h/x> .", "turtle", {}, "@base <http://h/d/> .\n\n<a>\n\t<b> <c> ,\n\t\t<http://h/x> .\n"),
    ("root", "turtle", "@base <http://h/d/e/> . <a> <../b> <http://h/x> .", "turtle", {"root": "http://h/d/"}, "@base <http://h/d/e/> .\n\n<a>\n\t<../b> <http://h/x> .\n"),
    ("directive between", "turtle", P + "e:a e:b e:c . @prefix f: <http://f/> . f:a f:b f:c .", "turtle", {},
     P + "\ne:a\n\te:b e:c .\n\n@prefix f: <http://f/> .\n\nf:a\n\tf:b f:c .\n"),
    ("added prefix", "turtle", "_:x <http://b> [] .", "ntriples", {"blank_prefix": "k"}, "_:kx <http://b> _:kb1 .\n"),
    ("chopped prefix", "turtle", "_:kx <http://b> _:y .", "ntriples", {"chop_prefix": "k"}, "_:x <http://b> _:y .\n"),
    ("iri escapes", "turtle", "<http://a/é> <http://b> <http://x\\U0001F600> .", "ntriples", {}, "<http://a/\\u00E9> <http://b> <http://x\\U0001F600> .\n"),
    ("nil", "turtle", f"<http://a> <http://b> <{R}nil> .", "turtle", {}, "<http://a>\n\t<http://b> () .\n"),
    ("lax", "turtle", "<http://a> <http://b> <http://c> .\nwrong\n<http://a> <http://b> <http://d> .", "turtle", {"lax": True}, "<http://a>\n\t<http://b> <http://c> ,\n\t\t<http://d> .\n"),
    ("strict", "turtle", "<http://a> <http://b> <http://c> .\nwrong\n<http://a> <http://b> <http://d> .", "ntriples", {}, "<http://a> <http://b> <http://c> .\n"),
    ("undefined name", "turtle", "n:a <http://b> <http://c> .", "ntriples", {}, ""),
    ("nothing", "turtle", "", "turtle", {}, ""),
]


def write_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout, abbreviation, escapes and options of the writer, character by character."""
    whole = None
    for doc, syntax, text, output, options, _ in _WRITE:
        chosen = {k: v for k, v in options.items() if k != "lax"}
        inputs = _inputs(spark, [(doc, syntax, not options.get("lax", False), text, None)])
        done = documents.convert_documents(inputs, output, **chosen).select("doc", "text")
        whole = done if whole is None else whole.union(done)
    return whole


_add("write_documents", write_documents.__doc__, write_documents, _values([(c[0], c[5]) for c in _WRITE], "doc, text"))

_REFUSED = [  # seq, flags, s_type, s, p_type, p, o_type, o, datatype, lang; status and message, or none
    ((1, 0, "LITERAL", "x", "URI", "http://p", "LITERAL", "y", None, None), (4, "incoherent statement")),
    ((2, 0, "URI", "http://s", "LITERAL", "p", "LITERAL", "y", None, None), (4, "incoherent statement")),
    ((3, 0, "URI", "http://s", "URI", "http://p", None, None, None, None), (4, "incoherent statement")),
    ((4, 0, "URI", "http://s", "URI", "http://p", "LITERAL", "y", "http://t", "en"), (4, "incoherent statement")),
    ((5, 66, "BLANK", "s", "URI", "http://p", "LITERAL", "y", None, None), (4, "incoherent statement")),
    ((6, 144, "URI", "http://s", "URI", "http://p", "BLANK", "o", None, None), (4, "incoherent statement")),
    ((7, 0, "URI", "http://s", "CURIE", "n:p", "LITERAL", "y", None, None), (7, "undefined namespace prefix 'n:p'")),
    ((8, 0, "URI", "http://s", "URI", "http://p", "LITERAL", "fine", None, None), None),
    ((9, 16, "URI", "http://s", "URI", "http://p", "BLANK", "n", None, None), None),
    ((10, 0, "URI", "http://other", "URI", "http://p", "LITERAL", "y", None, None), (4, "subject is not the open anonymous node or list")),
]


def write_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that the writer refuses, each with status and message; the others are written."""
    columns = "doc string, seq bigint, flags int, s_type string, s string, p_type string, p string, o_type string, o string, o_datatype string, o_lang string"
    rows = spark.createDataFrame([("d", *r) for r, _ in _REFUSED], columns)
    typed = rows.withColumn("o_datatype_type", F.when(F.col("o_datatype").isNotNull(), "URI"))
    return documents.refused_statements(typed, "turtle")


_add("write_faults", write_faults.__doc__, write_faults, _values([("d", r[0], *w) for r, w in _REFUSED if w], "doc, seq, status, message"))


# Scalars. Texts and what they stand for.

_NUMBERS = [("1E3", 1000.0), ("0", 0.0), ("+.5", 0.5), (" +8e2", 800.0), ("-3.25x", -3.25), ("x", 0.0), ("", 0.0), ("1e", 1.0), (".", 0.0), ("1.5.2", 1.5)]
_SCHEMES = [("http://a", 1), ("a+b-c.d:x", 1), ("1a:x", 0), ("", 0), ("noscheme", 0), ("a/b:c", 0), (":x", 0), ("é:x", 0), ("A:", 1)]
_RELATIVE = [  # uri, base, root, as seen from the base
    ("http://h/d/a", "http://h/d/", None, "a"), ("http://h/d/", "http://h/d/x", None, ""), ("http://h/a", "http://h/d/e", None, "../a"),
    ("http://o/a", "http://h/d/", None, "http://o/a"), ("http://h/d/a?q#f", "http://h/d/", None, "a?q#f"),
    ("http://h/d/x/a", "http://h/d/y/b", "http://h/d/", "../x/a"), ("http://h/z/a", "http://h/d/y/b", "http://h/d/", "http://h/z/a"),
]
_LOCAL = [("a", "a"), ("a,b", "a\\,b"), ("a.b", "a.b"), (".a", "\\.a"), ("a.", "a\\."), ("x:y", "x:y"), ("~", "\\~"), ("a b", "a%20b"), ("é", "é")]
_MEASURES = [("abcdef", 3, 3, 3, 0), ("aé日", 3, 2, 3, 0), ("a\nb", 9, 3, 3, 1), ('q"', 2, 2, 2, 2), ("😀x", 3, 0, 0, 0), ("😀x", 4, 1, 4, 0), ("", 5, 0, 0, 0)]


def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers at the start of texts, and where each ends."""
    rows = spark.createDataFrame([(t,) for t, _ in _NUMBERS], "text string")
    return rows.select("text", C.parse_double(F.col("text")).alias("number"), C.number_end(F.col("text")).alias("ends"))


_ENDS = [3, 1, 3, 5, 5, 0, 0, 1, 0, 3]
_add("parse_numbers", parse_numbers.__doc__, parse_numbers, _values([(t, v, e) for (t, v), e in zip(_NUMBERS, _ENDS)], "text, number, ends").replace("SELECT *", "SELECT text, CAST(number AS DOUBLE) AS number, ends"))


def has_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts begin with a scheme."""
    rows = spark.createDataFrame([(t,) for t, _ in _SCHEMES], "uri string")
    return rows.select("uri", C.uri_has_scheme(F.col("uri")).cast("int").alias("found"))


_add("has_schemes", has_schemes.__doc__, has_schemes, _values(_SCHEMES, "uri, found"))


def relative_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URIs as seen from a base, within a root where there is one."""
    rows = spark.createDataFrame([r[:3] for r in _RELATIVE], "uri string, base string, root string")
    return rows.select("uri", "base", "root", C.uri_relative_to(F.col("uri"), F.col("base"), F.col("root")).alias("seen"))


_add("relative_uris", relative_uris.__doc__, relative_uris, _values(_RELATIVE, "uri, base, root, seen"))


def local_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local parts of prefixed names as they are written."""
    return spark.createDataFrame([(t,) for t, _ in _LOCAL], "text string").select("text", C.local_name(F.col("text")).alias("written"))


_add("local_names", local_names.__doc__, local_names, _values(_LOCAL, "text, written"))


def bounded_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at a number of bytes, never inside a character, and their measures."""
    rows = spark.createDataFrame([(t, n) for t, n, *_ in _MEASURES], "text string, most int")
    node = C.node_of(F.lit("LITERAL"), F.col("text"), F.col("most"))
    return rows.select("text", "most", node.alias("x")).select("text", "most", F.col("x.n_chars"), F.col("x.n_bytes"), F.col("x.flags"))


_add("bounded_measures", bounded_measures.__doc__, bounded_measures, _values(_MEASURES, "text, most, n_chars, n_bytes, flags"))


_FOLDED = [("ABC", "abc", 1), ("a", "b", 0), ("É", "é", 0), ("", "", 1), ("Turtle", "tURTLE", 1)]
_RAW = [("61c3a962", "aéb"), ("61ff62", "a�b"), ("c3", "�"), ("", ""), ("f09f9880", "😀")]


def folded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are the same but for the case of ASCII letters."""
    return spark.createDataFrame([r[:2] for r in _FOLDED], "a string, b string").select("a", "b", C.same_folded(F.col("a"), F.col("b")).cast("int").alias("same"))


_add("folded_texts", folded_texts.__doc__, folded_texts, _values(_FOLDED, "a, b, same"))


def repaired_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of bytes, what is no UTF-8 as U+FFFD."""
    return spark.createDataFrame([(h,) for h, _ in _RAW], "raw string").select("raw", C.valid_utf8(F.unhex("raw")).alias("text"))


_add("repaired_bytes", repaired_bytes.__doc__, repaired_bytes, _values(_RAW, "raw, text"))

_FRAMES = [(1, "a\0b\0"), (2, ""), (3, "\0\0c"), (4, "d")]


def nul_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of frames parted by NUL; empty ones are dropped."""
    return chunks.split_frames(spark.createDataFrame(_FRAMES, "id int, text string"), "text")


_add("nul_frames", nul_frames.__doc__, nul_frames, _values([(1, "a"), (1, "b"), (3, "c"), (4, "d")], "id, text"))

# The command line: arguments, exit code, what is written, and how many errors are told.
_S = "<http://a> <http://b> "
_COMMANDS = [
    (["-s", _S + "'é' ."], 0, _S + '"é" .\n', 0),
    (["-a", "-i", "turtle", "-s", _S + "'é' ."], 0, _S + '"\\u00E9" .\n', 0),
    (["-b", "-s", _S + "1 ."], 0, _S + f'"1"^^<{X}integer> .\n', 0),
    (["-e", "-s", _S + "<http://c> ."], 0, _S + "<http://c> .\n", 0),
    (["-c", "k", "-s", "_:kx <http://b> _:y ."], 0, "_:x <http://b> _:y .\n", 0),
    (["-p", "k", "-s", "_:x <http://b> _:y ."], 0, "_:kx <http://b> _:ky .\n", 0),
    (["-f", "-i", "turtle", "-o", "turtle", "-s", P + f"<{E}s> e:p e:o ."], 0, P + f"\n<{E}s>\n\te:p e:o .\n", 0),
    (["-i", "turtle", "-o", "turtle", "-s", P + f"<{E}s> e:p e:o ."], 0, P + "\ne:s\n\te:p e:o .\n", 0),
    (["-i", "nquads", "-o", "trig", "-s", _S + "<http://c> <http://g> .\n"], 0, "\n<http://g> {\n\t<http://a>\n\t\t<http://b> <http://c> .\n}\n", 0),
    (["-i", "ntriples", "-s", _S + "<http://c> .\n"], 0, _S + "<http://c> .\n", 0),
    (["-i", "trig", "-s", "<http://g> { " + _S + "<http://c> }"], 0, _S + "<http://c> <http://g> .\n", 0),
    (["-l", "-i", "turtle", "-s", _S + "1 .\nwrong\n" + _S + "<http://c> ."], 0, _S + f'"1"^^<{X}integer> .\n' + _S + "<http://c> .\n", 1),
    (["-i", "turtle", "-s", _S + "<http://c> .\nwrong\n" + _S + "<http://d> ."], 1, _S + "<http://c> .\n", 1),
    (["-q", "-i", "turtle", "-s", "wrong"], 1, "", 0),
    (["-r", "http://h/d/", "-i", "turtle", "-o", "turtle", "-s", "<a> <../../b> <http://h/x> .", "http://h/d/e/"], 0, "<a>\n\t<http://h/b> <http://h/x> .\n", 0),
    (["-i", "turtle", "-s", "<a> <b> <c> .", "http://h/"], 0, "<http://h/a> <http://h/b> <http://h/c> .\n", 0),
    (["-i", "turtle", "-s", "<a> <http://b> <http://c> ."], 1, "", 1),
    (["-v"], 0, "termloom ", 0),
    (["-h"], 0, "usage: te", 0),
    (["http://remote.example/x.ttl"], 2, "", 1),
]


def command_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command with each of its options; of help and version only how they begin."""
    rows = spark.createDataFrame([(n, args) for n, (args, *_) in enumerate(_COMMANDS)], "n int, args array<string>")

    def run(parts):  # noqa: ANN001, ANN202
        import contextlib
        import io

        import pyarrow as pa

        from termloom.__main__ import main

        for part in parts:
            done = []
            for args in part.column("args").to_pylist():
                out, err = io.TextIOWrapper(io.BytesIO(), "utf-8", newline=""), io.StringIO()
                with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
                    try:
                        code = main(args)
                    except SystemExit as stop:
                        code = stop.code or 0
                out.flush()
                text = out.buffer.getvalue().decode()
                done.append((code, text[:9] if args[0] in ("-v", "-h") else text, err.getvalue().count("error:")))
            codes, texts, errors = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [part.column("n"), pa.array(codes, pa.int32()), pa.array(texts), pa.array(errors, pa.int32())], names=["n", "code", "text", "errors"]
            )

    return rows.mapInArrow(run, "n int, code int, text string, errors int")


_add("command_runs", command_runs.__doc__, command_runs, _values([(n, c, t, e) for n, (_, c, t, e) in enumerate(_COMMANDS)], "n, code, text, errors"))
