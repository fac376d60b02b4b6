"""Parser, writer, data sources, line formats and streams."""

from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.__main__ import main as command
from termloom.operators import documents, env
from termloom.plans import rdf_queries
from termloom.plans.transcode import Options, convert
from termloom.schema import BAD_ARG, BAD_CURIE, STATEMENT
from termloom.sources import lines
from termloom.sources.datasource import register
from termloom.sources.env import Env
from termloom.sources.parser import Parser, parse, parse_blocks
from termloom.sources.reading import document_events
from termloom.sources.writer import Style, WriteFault, Writer
from termloom.streaming import chunks

RICH = """@prefix e: <http://e/> .
@base <http://b/d/> .
<x> a e:T ; e:p "s"@en-GB , 'it''s' , 1 , 2.5 , 3e4 , true ; .
[] e:q ( 1 [ e:r ( ) ] <y> ) .
( e:a ) e:b [ e:c [ e:d e:e ; e:f \"\"\"long "q"
x\"\"\" ] ] , _:l .
e:\\,x e:p e:a.b , e:%41 . # comment
""".replace("'it''s'", '"it\'s"')


def test_blocks_of_any_size_give_the_same_events():
    whole = list(parse(RICH, "turtle"))
    assert not [e for e in whole if e[0] == "error"]
    raw = RICH.encode()
    for size in (1, 2, 3, 7, 50):
        assert list(parse_blocks(Parser("turtle"), [raw[i : i + size] for i in range(0, len(raw), size)])) == whole


def test_deep_nesting_needs_no_recursion():
    depth = 5000
    text = "<http://s> <http://p> " + "[ <http://p> " * depth + "1" + " ]" * depth + " ."
    events = list(parse(text, "turtle"))
    assert len(events) == 2 * depth + 1
    lists = "<http://s> <http://p> " + "( " * depth + ") " * depth + "."
    assert not [e for e in parse(lists, "turtle") if e[0] == "error"]


@pytest.mark.parametrize("text, line", [("<http://a> <http://b> .", 1), ("@prefix a: <http://a>\n<x> a a:b .", 2), ("a:b a:c a:d", 1), ('<http://a> <http://b> "x', 1), ("\n\n}", 3)])
def test_errors_have_places(text, line):
    errors = [e for e in parse(text, "turtle") if e[0] == "error"]
    assert len(errors) == 1 and errors[0][2] == line


def test_lax_reading_goes_on_after_the_line():
    text = '<http://a> <http://b> "1" .\nbad line .\n<http://a> <http://b> "2" .\n'
    for syntax in ("turtle", "trig", "ntriples", "nquads"):
        kinds = [e[0] for e in parse(text, syntax, strict=False)]
        assert kinds == ["statement", "error", "statement"], syntax
        assert [e[0] for e in parse(text, syntax)] == ["statement", "error"]


def test_bad_utf8():
    raw = b'<http://a> <http://b> "x\xffy" .\n'
    assert [e[0] for e in parse(raw, "ntriples")] == ["error"]
    (event,) = parse(raw, "ntriples", strict=False)
    assert event[5] == ("LITERAL", "x\ufffdy")


NODES = st.one_of(
    st.tuples(st.just("URI"), st.text(alphabet="abé/#?%", min_size=1, max_size=8).map(lambda x: "http://h/" + x)),
    st.tuples(st.just("BLANK"), st.text(alphabet="abc", min_size=1, max_size=3)),
)
VALUES = st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=20)
STATEMENTS = st.lists(
    st.tuples(NODES, st.sampled_from([("URI", "http://h/p"), ("URI", "http://h/q")]), st.one_of(NODES, st.tuples(st.just("LITERAL"), VALUES)), st.sampled_from([None, ("URI", "http://g/1"), ("BLANK", "g")]), st.sampled_from([None, "en", ("URI", "http://h/dt")])),
    max_size=12,
)


@settings(max_examples=150, deadline=None)
@given(STATEMENTS, st.sampled_from(["turtle", "trig", "nquads", "ntriples"]), st.booleans())
def test_what_is_written_reads_back(statements, syntax, ascii_only):
    writer = Writer(syntax, Env(), Style(ascii=ascii_only))
    want = []
    for s, p, o, g, tail in statements:
        dt, lang = (None, None) if o[0] != "LITERAL" or tail is None else ((tail, None) if isinstance(tail, tuple) else (None, tail))
        flags = 3 if o[0] == "LITERAL" and ("\n" in o[1] or '"' in o[1]) else 0
        writer.statement(0, g, s, p, o, flags, dt, lang)
        want.append((g if syntax in ("trig", "nquads") else None, s, p, o, dt, lang))
    writer.finish()
    got = [(e[2], e[3], e[4], e[5], e[7], e[8]) for e in parse(writer.text(), syntax) if e[0] != "end"]
    assert got == want


def test_incoherent_statements_are_refused():
    u, lit = ("URI", "http://u"), ("LITERAL", "x")
    writer = Writer("turtle", Env())
    for s, p, o, dt, lang, flags in [(lit, u, u, None, None, 0), (u, lit, u, None, None, 0), (u, u, lit, u, "en", 0), (u, u, u, None, None, 64 | 8), (u, u, u, None, None, 128 | 16)]:
        with pytest.raises(WriteFault) as fault:
            writer.statement(flags, None, s, p, o, 0, dt, lang)
        assert fault.value.status == BAD_ARG
    with pytest.raises(WriteFault) as fault:
        Writer("ntriples", Env()).statement(0, None, ("CURIE", "no:x"), u, u)
    assert fault.value.status == BAD_CURIE
    with pytest.raises(WriteFault):
        writer.end(("BLANK", "b"))


def test_a_refused_statement_leaves_nothing_behind():
    u = ("URI", "http://u")
    writer = Writer("trig", Env(), Style(resolved=True))
    writer.statement(0, None, u, u, ("LITERAL", "1"))
    with pytest.raises(WriteFault):
        writer.statement(0, u, ("URI", "http://v"), u, ("CURIE", "no:x"))
    writer.statement(0, None, u, u, ("LITERAL", "2"))
    writer.finish()
    assert [e[5][1] for e in parse(writer.text(), "trig") if e[0] == "statement"] == ["1", "2"]


def test_options_of_a_conversion():
    text, errors = convert("@prefix e: <http://e/> .\ne:a e:b _:x .", Options(blank_prefix="p-"))
    assert (text, errors) == ("<http://e/a> <http://e/b> _:p-x .\n", [])
    assert convert("<http://e/a> <http://e/b> _:p-x .", Options("ntriples", chop_prefix="p-"))[0] == "<http://e/a> <http://e/b> _:x .\n"
    assert convert("<http://é> <http://p> 'é' .", Options("turtle"))[0] == '<http://\\u00E9> <http://p> "\\u00E9" .\n'
    assert convert("<a> <b> <c> .", Options("turtle", base="http://h/x/y"))[0] == "<http://h/x/a> <http://h/x/b> <http://h/x/c> .\n"


LINES = [
    '<http://a> <http://p> "x\\u00e9\\U0001F600\\\\n\\"\\n"@en-GB .', "_:b1 <http://p> _:b2 <http://g> . # c", "# only", "  ", None,
    '<http://a> <http://p> "1"^^<http://t> _:g .', "broken", '<http://a> <http://p> "bad \\x" .', '<http://a> <http://p> "\\uD800" .',
    '<http://a><http://p>"tight"<http://g>.', '<http://a> <http://p> "' + "y" * 200_000 + '" .', '<http://a> <http://p> "' + "\\n" * 3000 + '" .', "<rel> <http://p> <http://o> .",
    "_:é.x <http://p> _:1 .", '<http://\\u00E9/> <http://p> "it\'s" .', '<http://a> <http://p> "a" . <http://a> <http://p> "b" .',
]


def test_lines_agree_with_the_parser(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(LINES)], "id int, value string, _groups string")
    got = {}
    for r in lines.read_lines(df.select("id", "value", "_groups"), "nquads").collect():
        got.setdefault(r["id"], []).append(r)
    for i, text in enumerate(LINES):
        want = list(parse(text or "", "nquads"))
        assert [r["kind"] for r in got.get(i, [])] == [e[0] for e in want], (text or "")[:80]
        for r, e in zip(got.get(i, []), want):
            if e[0] == "statement":
                have = ((r["g_type"], r["g"]), (r["s_type"], r["s"]), (r["p_type"], r["p"]), (r["o_type"], r["o"]), r["o_flags"], (r["o_datatype_type"], r["o_datatype"]), r["o_lang"])
                none = (None, None)
                assert have == (e[2] or none, e[3], e[4], e[5], e[6], e[7] or none, e[8])
    graph = lines.read_lines(df.where("id = 1").select("id", "value"), "ntriples").collect()
    assert [r["kind"] for r in graph] == ["statement", "error"]
    assert lines.read_lines(df.limit(0)).count() == 0


def test_lines_written_read_back(spark):
    rows = [(0, 0, None, None, "URI", "http://s ^", "URI", "http://p", "LITERAL", 'é"\\\n\x01😀', None, None), (1, 0, "BLANK", "g", "BLANK", "b", "URI", "http://p", "URI", "http://é", None, None), (2, 0, "URI", "http://g", "URI", "http://s", "URI", "http://p", "LITERAL", "5", "http://int", None)]
    df = spark.createDataFrame(rows, "id int, flags int, g_type string, g string, s_type string, s string, p_type string, p string, o_type string, o string, o_datatype string, o_lang string")
    for ascii_only in (False, True):
        text = df.select("id", lines.statement_line(True, ascii_only).alias("value"))
        assert all(r["value"].isascii() or not ascii_only for r in text.collect())
        back = lines.read_lines(text).drop("o_flags", "kind", "status", "col", "message", "o_datatype_type").orderBy("id").collect()
        assert [tuple(r) for r in back] == [(r[0], *r[2:]) for r in rows[:0]] + [(r[0], r[2], r[3], "URI" if r[4] == "URI" else "BLANK", r[5], r[6], r[7], r[8], r[9], r[10], r[11]) for r in rows]


def test_data_sources(spark, tmp_path):
    register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ttl").write_text(RICH)
    (tmp_path / "in" / "b.ttl").write_text("@prefix e: <http://e/> .\ne:a e:b <c> .\nwrong\ne:d e:e e:f .")
    read = spark.read.format("turtle").option("base", "http://h/").load(str(tmp_path / "in"))
    kinds = {r["kind"]: r["count"] for r in read.groupBy("kind").count().collect()}
    assert kinds["error"] == 1 and kinds["prefix"] == 2
    assert read.where("o = 'http://h/c'").count() == 1 and read.where("o_type = 'CURIE'").count() == 0
    strict = spark.read.format("turtle").option("mode", "FAILFAST").load(str(tmp_path / "in" / "b.ttl"))
    with pytest.raises(Exception, match="3:"):
        strict.count()
    dropped = spark.read.format("turtle").option("mode", "DROPMALFORMED").option("defaultGraph", "http://g").load(str(tmp_path / "in" / "b.ttl"))
    assert dropped.where("kind = 'error'").count() == 0 and dropped.where("g = 'http://g'").count() == 2
    one = spark.read.format("turtle").load(str(tmp_path / "in" / "a.ttl")).orderBy("seq").coalesce(1)
    one.write.format("trig").mode("append").save(str(tmp_path / "out"))
    parts = [f for f in os.listdir(tmp_path / "out") if f.endswith("-00000.trig")]
    assert len(parts) == 1 and sorted(os.listdir(tmp_path / "out")) == ["_SUCCESS", *parts]
    again = spark.read.format("trig").load(str(tmp_path / "out"))
    count = lambda df: df.where("kind = 'statement'").count()
    assert count(again) == count(one)


def test_files_by_extension_and_text_in_columns(spark, tmp_path):
    register(spark)
    (tmp_path / "a.NT").write_text("<http://a> <http://b> <http://c> .\n")
    (tmp_path / "b.trig").write_text("<http://g> { <http://a> <http://b> 1 . }")
    read = spark.read.format("rdf").load(str(tmp_path)).where("kind = 'statement'")
    assert sorted((os.path.basename(r["doc"]), r["g"]) for r in read.select("doc", "g").collect()) == [("a.NT", None), ("b.trig", "http://g")]
    spark.createDataFrame([(1, "<a> <b> <c> , [] ."), (2, None), (3, "oops")], "id int, t string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, kind FROM texts, LATERAL parse_rdf(t, 'turtle')").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "statement"), (1, "statement"), (3, "error")]


def test_command(tmp_path, capfdbinary):
    path = tmp_path / "x.ttl"
    path.write_text("@prefix e: <http://e/> .\n<y> e:p [ e:q 1 ] .\n")
    base = path.as_uri().rsplit("/", 1)[0]
    assert command([str(path)]) == 0
    out, err = capfdbinary.readouterr()
    assert out.decode() == f"<{base}/y> <http://e/p> _:b1 .\n_:b1 <http://e/q> \"1\"^^<http://www.w3.org/2001/XMLSchema#integer> .\n" and not err
    assert command(["-o", "turtle", "-i", "turtle", "-s", "<http://a> <http://b> 'c'.", "http://h/"]) == 0
    assert capfdbinary.readouterr().out.decode() == '<http://a>\n\t<http://b> "c" .\n'
    assert command(["-s", "<http://a> nonsense"]) == 1 and b"error" in capfdbinary.readouterr().err
    assert command(["-q", "-l", "-s", "<http://a> nonsense"]) == 0 and not capfdbinary.readouterr().err
    assert command([str(tmp_path / "missing.ttl")]) == 2 and command(["http://remote.example/x.ttl"]) == 2


def test_documents_in_rows(spark):
    rows = [("d1", "turtle", RICH.encode(), "http://h/", True), ("d2", "ntriples", b"nonsense\n<http://a> <http://b> <http://c> .", None, False), ("d3", None, None, None, None), ("d4", "turtle", b"nonsense .\n<http://a> <http://b> <http://c> .", None, True)]
    df = spark.createDataFrame(rows, "doc string, syntax string, bytes binary, base_uri string, strict boolean")
    events = documents.read_documents(df)
    got = {(r["doc"], r["kind"]): r["count"] for r in events.groupBy("doc", "kind").count().collect()}
    assert got[("d2", "statement")] == 1 and got[("d2", "error")] == 1 and ("d3", "statement") not in got and ("d4", "statement") not in got
    text = documents.document_text(events.where("doc = 'd1'"), "turtle").orderBy("piece").collect()
    whole = "".join(r["text"] for r in text)
    assert [e[0] for e in parse(whole, "turtle")].count("statement") == got[("d1", "statement")]
    assert documents.convert_documents(df.where("doc = 'd2'")).collect()[0]["n_errors"] == 1
    assert documents.read_documents(df.limit(0)).count() == 0
    prefixes = documents.prefix_table(events)
    assert [tuple(r) for r in prefixes.collect()] == [("d1", 0, "e", "http://e/")]
    assert documents.document_text(spark.createDataFrame([], STATEMENT), "turtle").count() == 0


def test_expansion_of_statements(spark):
    statements = spark.createDataFrame(
        [("d", "URI", "g", "CURIE", "x:a", "CURIE", ":p", "LITERAL", "v", "CURIE", "x:t"), ("d", None, None, "CURIE", "no:a", "URI", "q", "BLANK", "b", None, None), (None, None, None, "URI", "r", "URI", "q", "URI", "o", None, None)],
        "doc string, g_type string, graph string, s_type string, subject string, p_type string, predicate string, o_type string, object string, o_datatype_type string, o_datatype string",
    )
    prefixes = spark.createDataFrame([("d", 0, "x", "http://x/"), ("d", 1, "", "http://e/"), ("d", 2, "x", "http://y/"), ("e", 0, "no", "http://n/")], "doc string, ord int, name string, uri string")
    inputs = spark.createDataFrame([("d", "http://base/f")], "doc string, base_uri string")
    got = env.expand_statements(statements, prefixes, inputs).collect()
    first, second, third = (next(r for r in got if r["object"] == o) for o in ("v", "b", "o"))
    assert (first["graph"], first["subject"], first["predicate"], first["o_datatype"], first["undefined"]) == ("http://base/g", "http://y/a", "http://e/p", "http://y/t", False)
    assert (second["subject"], second["s_type"], second["undefined"], second["predicate"]) == ("no:a", "CURIE", True, "http://base/q")
    assert third["subject"] == "r"
    assert [tuple(r) for r in env.undefined_prefixes(statements, prefixes).collect()] == [("d", "no", 1)]


def test_stream_of_pieces(spark, tmp_path):
    raw = RICH.encode()
    cuts = [0, 10, 95, 180, 240, len(raw)]
    pieces = [("one", n, raw[a:b], b == len(raw)) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    pieces += [("two", 0, b"<http://a> <http://b> <http://c> .\0<http://a>", None), ("two", 1, b" <http://b> <http://d> .\nbad .\n# and more to come\n", None), ("three", 0, None, None)]
    folder = tmp_path / "pieces"
    schema = "stream string, n int, bytes binary, final boolean"
    for k in range(len(pieces)):
        spark.createDataFrame([pieces[k]], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = chunks.parse_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(str(folder)))
    query = stream.writeStream.format("memory").queryName("pieces").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(120)
    rows = spark.table("pieces").collect()
    assert sum(r["kind"] == "statement" for r in rows if r["doc"] == "two") == 2
    assert {r["kind"] for r in rows if r["doc"] == "two"} >= {"statement", "error"}


@pytest.mark.parametrize("strict", [True, False])
def test_pieces_one_by_one(strict):
    raw = RICH.encode() + (b"" if strict else b"<a> oops and so on until the line ends here\n<a> <b> <c> . \n")
    want = list(parse(raw, "turtle", strict))
    state, got = None, []
    options = {"mode": "STRICT" if strict else "PERMISSIVE"}
    for at in range(0, len(raw), 9):
        reading, _ = chunks.resume("turtle", None, {**options, "expand": "false"}, state)
        got += reading.feed(raw[at : at + 9], at + 9 >= len(raw))
        state = chunks.suspend(reading)
    assert got == list(enumerate(want))
    whole, state, got = list(document_events([raw], "turtle", None, options)), None, []
    for at in range(0, len(raw), 7):
        reading, _ = chunks.resume("turtle", None, options, state)
        got += reading.feed(raw[at : at + 7], at + 7 >= len(raw))
        state = chunks.suspend(reading)
    assert got == list(enumerate(whole)) and not any(n and n[0] == "CURIE" for _, e in got if e[0] == "statement" for n in e[2:6])


def test_growing_file(spark, tmp_path):
    register(spark)
    path = tmp_path / "grow.ttl"
    path.write_text("@prefix e: <http://e/> .\ne:a e:b [] .\ne:a e:")
    stream = spark.readStream.format("turtle").load(str(path))
    query = stream.writeStream.format("memory").queryName("grow").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    assert spark.table("grow").count() == 2
    with open(path, "a") as f:
        f.write("c e:d .\n")
    query.processAllAvailable()
    rows = spark.table("grow").orderBy("seq").collect()
    query.stop()
    assert [r["p"] for r in rows] == [None, "http://e/b", "http://e/c"]


def test_frames(spark):
    df = spark.createDataFrame([(1, "a\0b\0"), (2, "")], "id int, text string")
    assert [tuple(r) for r in chunks.split_frames(df, "text").select("id", "text").collect()] == [(1, "a"), (1, "b")]
    typed = chunks.typed_view(spark.createDataFrame([("1.5", None), ("x", None), ("7", "http://www.w3.org/2001/XMLSchema#integer")], "object string, o_datatype string"))
    assert [r["number"] for r in typed.collect()] == [1.5, None, 7.0]
    assert F is not None


def test_arrays_as_collections(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (3, None)], "id int, xs array<string>")
    got = sorted((r["place"], r["s"], r["p"].rpartition("#")[2], r["o_type"], r["o"].rpartition("#")[2]) for r in env.list_statements(df, "id", "xs").collect())
    assert got == [(0, "l1-1", "first", "LITERAL", "a"), (0, "l1-1", "rest", "BLANK", "l1-2"), (1, "l1-2", "first", "LITERAL", "b"), (1, "l1-2", "rest", "URI", "nil")]


PARTS = ["<http://a>", "<b>", "<a b>", "e:x", ":", "e:", "_:b1", "_:B1", "_:x.", "[", "]", "(", ")", "{", "}", ";", ",", ".", "..", "a", "true", '"x"', '"', "'", '"""', "\\u00e9", "\\x", "@en", "@", "^^", "1", "-", "+1.", "2e", "@prefix e: <http://e/> .", "PREFIX", "BASE", "GRAPH", "#c", "\n", "\r\n", " ", "\t", "\0", "é", "%41", "%4", "<", ">", "=="]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14), st.sampled_from(["turtle", "trig", "ntriples", "nquads"]), st.booleans(), st.integers(1, 9), st.sampled_from(["", " "]))
def test_any_input_gives_events_or_errors_in_any_blocks(parts, syntax, strict, size, between):
    raw = between.join(parts).encode()
    whole = list(parse(raw, syntax, strict))
    blocks = list(parse_blocks(Parser(syntax, strict), [raw[i : i + size] for i in range(0, len(raw), size)]))
    assert blocks == whole
    assert not strict or [e[0] for e in whole].count("error") <= 1


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.sampled_from(["turtle", "trig", "ntriples", "nquads"]), st.booleans())
def test_any_bytes_are_read_or_refused(raw, syntax, strict):
    text, errors = convert(raw, Options(syntax, "nquads", base="http://h/", lax=not strict))
    text.encode()
    assert isinstance(errors, list)


@pytest.mark.parametrize("split", [23, 64, 1000])
def test_line_files_are_split_between_lines(spark, tmp_path, split):
    register(spark)
    text = "".join(f'<http://s{i}> <http://p> "é{"x" * (i % 9)}" .\n' for i in range(12)) + "<http://last> <http://p> <http://o> ."
    (tmp_path / "a.nt").write_text(text)
    (tmp_path / "empty.nt").write_text("")
    read = spark.read.format("ntriples").option("splitBytes", str(split)).load(str(tmp_path))
    rows = read.orderBy("seq").collect()
    assert [r["s"] for r in rows] == [f"http://s{i}" for i in range(12)] + ["http://last"]
    assert {r["kind"] for r in rows} == {"statement"}


def test_writer_queries_keep_prefixed_names(spark, tmp_path):
    kinds = "stmt_id long, doc string, seq long, flags int, g_type string, graph string, s_type string, subject string, p_type string, predicate string, o_type string, object string, o_flags int, o_datatype_type string, o_datatype string, o_lang string"
    rows = [
        (1, "d", 1, 0, "CURIE", "x:g", "CURIE", "x:a", "CURIE", ":p", "LITERAL", "v", 0, "CURIE", "x:t", None),
        (2, "d", 2, 0, None, None, "URI", "http://a", "URI", "http://b", "CURIE", "no:c", 0, None, None, None),
        (3, "e", 3, 0, None, None, "URI", "http://a", "URI", "http://b", "CURIE", "no:c", 0, None, None, None),
    ]
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "statements.parquet"))
    prefixes = [("d", 0, "x", "http://x/"), ("d", 1, "", "http://e/"), ("e", 0, "no", "http://n/")]
    spark.createDataFrame(prefixes, "doc string, ord int, name string, uri string").write.parquet(str(tmp_path / "prefixes.parquet"))
    run = lambda name: rdf_queries.QUERIES[name](spark, str(tmp_path)).collect()
    triple = '<http://x/a> <http://e/p> "v"^^<http://x/t>'
    other = "<http://a> <http://b> <http://n/c> ."
    lost = "undefined namespace prefix 'no:c'"
    assert {r["stmt_id"]: (r["line"], r["refused"]) for r in run("nq_lines")} == {1: (f"{triple} <http://x/g> .", None), 2: (None, lost), 3: (other, None)}
    assert {r["stmt_id"]: (r["line"], r["refused"]) for r in run("nt_lines")} == {1: (f"{triple} .", None), 2: (None, lost), 3: (other, None)}
    assert {r["stmt_id"] for r in run("nq_roundtrip")} == {1, 3}
    for name in ("trig_text", "turtle_text", "turtle_reserialised"):
        text = "".join(r["text"] for r in run(name))
        assert '"v"^^<http://x/t>' in text and "<http://n/c>" in text and "no:c" not in text
    assert len(run("turtle_reread")) == 2
    assert [tuple(r) for r in run("write_errors")] == [(2, "d", BAD_CURIE, "undefined namespace prefix 'no:c'")]


def test_two_appends_and_an_overwrite(spark, tmp_path):
    register(spark)
    out = str(tmp_path / "out")
    row = lambda k: ("statement", k, 0, 0, "URI", f"http://s/{k}", "URI", "http://p", "LITERAL", "x")
    columns = "kind string, doc string, seq bigint, flags int, s_type string, s string, p_type string, p string, o_type string, o string"
    make = lambda *ks: spark.createDataFrame([row(k) for k in ks], columns).coalesce(1)
    subjects = lambda: sorted(r["s"][-1] for r in spark.read.format("turtle").load(out).where("kind = 'statement'").collect())
    make("a").write.format("turtle").mode("append").save(out)
    make("b").write.format("turtle").mode("append").save(out)
    assert subjects() == ["a", "b"]
    bad = make("c").union(spark.createDataFrame([("statement", "d", 0, 0, "LITERAL", "no", "URI", "http://p", "LITERAL", "x")], columns)).coalesce(1)
    with pytest.raises(Exception, match="incoherent"):
        bad.write.format("turtle").mode("overwrite").save(out)
    assert subjects() == ["a", "b"]  # an overwrite that fails takes nothing away
    assert not [f for f in os.listdir(out) if f.startswith("_staged")]
    bad.write.format("turtle").option("mode", "DROPMALFORMED").mode("overwrite").save(out)
    assert subjects() == ["c"]
    refused = [f for f in os.listdir(out) if f.startswith("_refused")]
    assert len(refused) == 1 and '"doc": "d"' in (tmp_path / "out" / refused[0]).read_text()
    make("e").write.format("turtle").mode("overwrite").save(out)
    assert subjects() == ["e"] and len([f for f in os.listdir(out) if f.startswith(("part-", "_refused"))]) == 1


def test_large_item_in_a_stream(spark, tmp_path):
    register(spark)
    path = tmp_path / "large.ttl"
    path.write_text("@prefix e: <http://e/> .\ne:a e:b 1 .\ne:a e:c \"" + "x" * (10 << 20) + "\" .\ne:a e:d 2 .\n")
    stream = spark.readStream.format("turtle").option("maxBytesPerTrigger", 1 << 20).load(str(path))
    query = stream.selectExpr("p", "length(o) AS n").writeStream.format("memory").queryName("large").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    rows = sorted((r["p"], r["n"]) for r in spark.table("large").where("p IS NOT NULL").collect())
    assert rows == [("http://e/b", 1), ("http://e/c", 10 << 20), ("http://e/d", 1)]


STREAMED = "@base <http://b/> .\n@prefix e: <x/> .\ne:a e:p [] ; e:q ( 1 2 ) .\nbad line .\n<y> a e:T .\n@prefix e: <z/> .\ne:a e:p _:c .\n"


@pytest.mark.parametrize("option, value", [("mode", "PERMISSIVE"), ("mode", "DROPMALFORMED"), ("mode", "STRICT"), ("defaultGraph", "http://g"), ("expand", "false"), ("base", "http://other/"), ("blankPrefix", "k")])
def test_streams_give_the_rows_of_batches(spark, tmp_path, option, value):
    register(spark)
    path = tmp_path / "x.ttl"
    path.write_text(STREAMED)
    batch = spark.read.format("turtle").option(option, value).load(str(path)).drop("doc")
    stream = spark.readStream.format("turtle").option(option, value).option("maxBytesPerTrigger", 40).load(str(path))
    name = f"s_{option}_{value}".translate({ord(c): "_" for c in ":/."})
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(spark.table(name).drop("doc")) == order(batch)


def test_pieces_give_the_rows_of_batches(spark, tmp_path):
    raw = STREAMED.encode()
    schema = "stream string, n int, bytes binary, final boolean"
    for k, at in enumerate(range(0, len(raw), 25)):
        spark.createDataFrame([("d", k, raw[at : at + 25], at + 25 >= len(raw))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    stream = chunks.parse_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "p")), defaultGraph="http://g")
    query = stream.writeStream.format("memory").queryName("in_pieces").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(120)
    inputs = spark.createDataFrame([("d", "turtle", bytearray(raw), None, False)], "doc string, syntax string, bytes binary, base_uri string, strict boolean")
    batch = documents.read_documents(inputs, defaultGraph="http://g")
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(spark.table("in_pieces")) == order(batch)


def test_streamed_files_and_sink(spark, tmp_path):
    register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ttl").write_text("<a> <b> <c> .\n")
    (tmp_path / "in" / "b.ttl").write_text("<d> <b> [ <e> 1 ] .\n")
    events = chunks.stream_files(spark, str(tmp_path / "in"), "turtle")
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        query = events.writeStream.format("ntriples").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    lines_out = spark.read.text(out)
    assert lines_out.count() == 3 and lines_out.where("value LIKE '<file:%/a> <file:%/b> <file:%/c> .'").count() == 1


def test_statements_that_are_refused(spark):
    columns = "doc string, seq bigint, flags int, s_type string, s string, p_type string, p string, o_type string, o string"
    rows = [("d", 1, 0, "URI", "http://s", "URI", "http://p", "CURIE", "no:name"), ("d", 2, 0, "URI", "http://s", "URI", "http://p", "LITERAL", "x")]
    df = spark.createDataFrame(rows, columns)
    assert [r["text"] for r in documents.document_text(df).collect()] == ['<http://s>\n\t<http://p> "x" .\n']
    assert [tuple(r) for r in documents.refused_statements(df).collect()] == [("d", 1, BAD_CURIE, "undefined namespace prefix 'no:name'")]
    flat = spark.createDataFrame([("d", k, 0, "URI", "http://s", "URI", "http://p", "LITERAL", str(k)) for k in range(400)] + [(None, 1, None, "BLANK", "b", "URI", "http://p", "LITERAL", "")], columns)
    pieces = documents.document_text(flat, flat=True)
    back = documents.read_pieces(pieces, "turtle").where("kind = 'statement'")
    assert sorted(int(r["o"]) for r in back.where("doc = 'd'").collect()) == list(range(400)) and back.where("doc IS NULL").count() == 1
    assert pieces.select(F.spark_partition_id()).distinct().count() > 1 and documents.document_text(flat.limit(0)).count() == 0
