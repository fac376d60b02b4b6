"""Lexical functions: vectors, edge cases and round trips; Column forms against the plain ones."""

from __future__ import annotations

import base64
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import columns as C
from termloom.functions import terms as T
from termloom.functions import uri as U
from termloom.sources.env import Env, UnknownPrefix

TEXT = st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=60)

NUMBERS = [("1E3", 1e3), ("0", 0.0), ("+.5", 0.5), (" +8e20", 8e20), ("-3.25x", -3.25), ("x", 0.0), ("", 0.0), ("1e", 1.0), ("02e18", 2e18)]
DECIMALS = [(0.0, 8, "0.0"), (42.0, 8, "42.0"), (0.01, 8, "0.01"), (-1.5, 2, "-1.5"), (0.999999999, 8, "1.0"), (16.00000000001, 8, "16.0"), (math.nan, 8, None), (math.inf, 8, None), (12345.6789, 2, "12345.68")]


@pytest.mark.parametrize("text, value", NUMBERS)
def test_strtod(text, value):
    assert T.strtod(text)[0] == value


@pytest.mark.parametrize("value, places, text", DECIMALS)
def test_new_decimal(value, places, text):
    assert T.new_decimal(value, places) == text


def test_numbers_as_columns(spark):
    df = spark.createDataFrame([(t,) for t, _ in NUMBERS] + [(None,)], "t string")
    assert [r[0] for r in df.select(C.parse_double(F.col("t"))).collect()] == [v for _, v in NUMBERS] + [None]
    rows = [(v, t) for v, p, t in DECIMALS if p == 8 and t is not None]
    df = spark.createDataFrame(rows, "v double, t string")
    assert all(r[0] == r[1] for r in df.select(C.decimal_text(F.col("v")), "t").collect())


@given(st.binary(max_size=200), st.booleans())
def test_base64_round_trip(data, wrap):
    text = T.base64_text(data, wrap)
    assert T.base64_bytes(text) == data and text.replace("\n", "") == base64.b64encode(data).decode()


@pytest.mark.parametrize("text, data", [("Zm9v\n YmFy!", b"foobar"), ("Zm8", b"fo"), ("Zg", b"f"), ("Z", b""), ("", b""), ("=Zg==", b"f")])
def test_base64_junk(spark, text, data):
    assert T.base64_bytes(text) == data
    assert spark.createDataFrame([(text,)], "t string").select(C.base64_bytes(F.col("t"))).collect()[0][0] == data


def test_base64_lengths(spark):
    rows = [(i, bytes(i)) for i in range(1, 256)]
    df = spark.createDataFrame(rows, "n int, b binary")
    out = df.select("n", F.length(C.base64_text(F.col("b"), True)), C.base64_length(F.col("n"), True), F.length(C.base64_text(F.col("b"))), C.base64_length(F.col("n"))).collect()
    assert all(r[1] == r[2] and r[3] == r[4] for r in out)


URIS = ["http://a/b?q#f", "http://a", "http://a?", "http://a#", "//h/p", "/p", "p", "", "#x", "?y", "urn:x:y", "file:///a%20b", "a:b/c//d", "http://u@h:8/%C3%A9/é?é#é", "1x:y", "./a:b"]
BASES = ["http://a/b/c/d;p?q", "http://a", "http://a/", "http://a/b", "urn:x", "x", "http://h?q"]
REFERENCES = URIS + ["g", "./g", "g/", "/g", "?y", ".", "./", "..", "../", "../g", "../..", "../../../../g", "/./g", "/../g", "g.", "..g", "a/../b", "x/./y", "../../x?q#f"]


@pytest.mark.parametrize("uri", URIS)
def test_parse_and_serialise(uri):
    assert U.serialise(U.parse(uri)) == uri


def test_uri_columns_agree_with_plain_functions(spark):
    df = spark.createDataFrame([(r, b) for r in REFERENCES for b in [*BASES, None]], "r string, b string")
    for row in df.select("r", "b", C.uri_resolve(F.col("r"), F.col("b")).alias("x"), C.uri_parse(F.col("r")).alias("p"), C.uri_serialise(C.uri_parse(F.col("r"))).alias("s"), C.uri_has_scheme(F.col("r")).alias("h")).collect():
        assert row["x"] == U.resolve_text(row["r"], row["b"]), (row["r"], row["b"])
        assert tuple(row["p"][n] for n in U.Parts._fields) == tuple(U.parse(row["r"])), row["r"]
        assert row["s"] == row["r"] and row["h"] == U.has_scheme(row["r"])


@pytest.mark.parametrize("reference, want", [("g", "http://a/b/c/g"), ("../g", "http://a/b/g"), ("../../g", "http://a/g"), ("?y", "http://a/b/c/d;p?y"), ("", "http://a/b/c/d;p?q"), ("//g", "http://g"), ("#s", "http://a/b/c/d;p?q#s"), ("../..", "http://a/"), ("g:h", "g:h")])
def test_resolve_examples_of_the_standard(reference, want):
    assert U.resolve_text(reference, "http://a/b/c/d;p?q") == want


@pytest.mark.parametrize("uri, base, root, want", [
    ("http://e/a/b", "http://e/a/c", None, "b"), ("http://e/a/b/x", "http://e/a/c/y", None, "../b/x"), ("http://e/a/b", "http://f/a", None, "http://e/a/b"),
    ("http://e/a/b", "http://e/a/b", None, ""), ("http://e/a/b?q#f", "http://e/a/b", None, "?q#f"), ("http://e/top/x", "http://e/top/a/b", "http://e/top/a/", "http://e/top/x"),
    ("http://e/top/a/x", "http://e/top/a/b", "http://e/top/", "x"), ("http://e/a/b", "http://e/a/b?q", None, "http://e/a/b"),
])
def test_relative(uri, base, root, want):
    assert U.relative(U.parse(uri), U.parse(base), U.parse(root) if root else None) == want


@pytest.mark.parametrize("path, host, uri", [("/a b", None, "file:///a%20b"), ("/é", "h", "file://h/%C3%A9"), ("rel/x", None, "rel/x"), ("/100%", None, "file:///100%%"), ("C:\\x y", None, "file:///C:/x%20y")])
def test_file_uri(path, host, uri):
    assert U.file_uri(path, host) == uri
    back, back_host = U.file_path(uri)
    assert (back, back_host) == (path.replace("\\", "/"), host)


@pytest.mark.parametrize("uri, want", [("file:///foo/%0Xbar", "/foo/bar"), ("http://x/y", None), ("/plain", "/plain"), ("file:///a%2Fb", "/a/b"), ("file://h", None)])
def test_file_path(uri, want):
    assert U.file_path(uri)[0] == want


@settings(max_examples=200)
@given(TEXT)
def test_escapes_round_trip(text):
    short = text.replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace('"', '\\"')
    assert T.unescape(short) == text
    assert T.unescape("".join(T.u_escape(ord(c)) for c in text)) == text


ODD = ["", "plain", 'q"\\\n\r\t\b\f', "é", "😀\x00\x01\x7f", "\\u0041", "\\\\u0041", "\\n", "x" * 5000 + "\né", "\x01", "a\\", None]


def test_escape_columns(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for ascii_only in (False, True):
        for turtle in (False, True):
            shown = C.escape_text(F.col("t"), ascii_only, turtle)
            for raw, text, back in df.select("t", shown, C.unescape_text(shown)).collect():
                assert back == raw
                if raw is not None:
                    assert T.unescape(text) == raw and not set(text) & set('\n\r\t\x00\x01')
                    assert text.isascii() or not ascii_only


@pytest.mark.parametrize("bad", ["\\x", "\\u12", "\\uD800", "\\U00110000", "\\"])
def test_bad_escapes(bad):
    with pytest.raises(T.BadEscape):
        T.unescape(bad)


@pytest.mark.parametrize("name, shown", [("a.b", "a.b"), (".a", "\\.a"), ("a.", "a\\."), ("-a", "\\-a"), ("a b", "a%20b"), ("a/b", "a\\/b"), ("é:1", "é:1"), ("a|b", "a%7Cb"), ("", "")])
def test_local_names(name, shown):
    assert T.local_name(name) == shown


def test_environment():
    env = Env("http://b/d/")
    env.set_prefix("x", "rel#")
    env.set_prefix("y", "http://b/d/rel")
    env.set_prefix("x", "http://z/")
    assert list(env.prefixes.items()) == [("x", "http://z/"), ("y", "http://b/d/rel")]
    assert env.expand("x:a:b") == "http://z/a:b" and env.qualify("http://z/q") == ("x", "q") and env.qualify("urn:q") is None
    env.set_base("../e")
    assert env.base == "http://b/e" and env.expand_node(("URI", "f")) == ("URI", "http://b/f")
    assert env.expand_node(("BLANK", "b")) is None and env.expand_node(("CURIE", "q:a")) is None
    for bad in ("q:a", "nocolon"):
        with pytest.raises(UnknownPrefix):
            env.expand(bad)
