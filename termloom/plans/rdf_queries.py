"""Queries of the syntax and lexical operators with the SQL they are checked against."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import columns as C
from termloom.operators import documents, env
from termloom.schema import BAD_CURIE, EVENT, XSD
from termloom.sources import lines
from termloom.sources.datasource import register
from termloom.util import parallelism, shared_folder, spread, table

FOLDER = "http://kelmar.example/thing/"
NAMES = {"g": "graph", "s": "subject", "p": "predicate", "o": "object"}
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query, with its SQL where SQL can express it."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


# Environment

_ENV = """
WITH first AS (SELECT doc, name, min(ord) AS ord, arg_max(uri, ord) AS uri FROM prefixes GROUP BY doc, name),
x AS (
  SELECT s.*, p.uri || substr(s.subject, instr(s.subject, ':') + 1) AS full_s
  FROM statements s LEFT JOIN first p ON s.s_type = 'CURIE' AND p.doc = s.doc
    AND p.name = substr(s.subject, 1, instr(s.subject, ':') - 1))
"""


@query(f"""{_ENV} SELECT stmt_id, CASE WHEN s_type = 'CURIE' THEN full_s ELSE subject END AS uri FROM x""")
def env_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = env.with_scope(_t(spark, sf_dir, "statements").select("stmt_id", "doc", "s_type", "subject"), _t(spark, sf_dir, "prefixes"))
    return rows.select("stmt_id", env.expanded(F.col("s_type"), F.col("subject"), F.col("env")).alias("uri"))


@query("""
WITH t AS (
  SELECT doc, g_type AS k, graph AS v FROM statements UNION ALL SELECT doc, s_type, subject FROM statements
  UNION ALL SELECT doc, p_type, predicate FROM statements UNION ALL SELECT doc, o_type, object FROM statements
  UNION ALL SELECT doc, o_datatype_type, o_datatype FROM statements),
u AS (SELECT doc, substr(v, 1, instr(v, ':') - 1) AS prefix, count(*) AS n FROM t WHERE k = 'CURIE' AND contains(v, ':') GROUP BY 1, 2)
SELECT doc, prefix, n FROM u WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.doc = u.doc AND p.name = u.prefix)""")
def env_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return env.undefined_prefixes(_t(spark, sf_dir, "statements"), _t(spark, sf_dir, "prefixes"))


@query("""
WITH first AS (SELECT doc, name, min(ord) AS ord, arg_max(uri, ord) AS uri FROM prefixes GROUP BY doc, name),
f AS (
  SELECT s.stmt_id, p.name || ':' || substr(s.object, length(p.uri) + 1) AS short,
         row_number() OVER (PARTITION BY s.stmt_id ORDER BY p.ord) AS n
  FROM statements s JOIN first p ON p.doc = s.doc AND s.o_type = 'URI' AND starts_with(s.object, p.uri))
SELECT s.stmt_id, f.short FROM statements s LEFT JOIN f ON f.stmt_id = s.stmt_id AND f.n = 1""")
def env_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = env.with_scope(_t(spark, sf_dir, "statements").select("stmt_id", "doc", "o_type", "object"), _t(spark, sf_dir, "prefixes"))
    return rows.select("stmt_id", env.qualified(F.col("o_type"), F.col("object"), F.col("env")).alias("short"))


@query("""
SELECT i.doc, p.ord, p.name, p.uri FROM inputs i JOIN prefixes p ON p.doc = i.doc
WHERE coalesce(i.syntax, 'trig') IN ('turtle', 'trig')""")
def env_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _t(spark, sf_dir, "inputs").where(F.coalesce("syntax", F.lit("trig")).isin("turtle", "trig"))
    return documents.prefix_table(documents.read_documents(inputs))


@query("SELECT doc, ord, name, uri, row_number() OVER (PARTITION BY doc ORDER BY ord) - 1 AS place FROM prefixes")
def env_foreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = env.scopes(_t(spark, sf_dir, "prefixes"))
    return scopes.select("doc", F.posexplode("env").alias("place", "e")).select("doc", "e.ord", "e.name", "e.uri", F.col("place").cast("bigint").alias("place"))


# URIs


@query("SELECT stmt_id, regexp_matches(object, '^[A-Za-z][A-Za-z0-9+.-]*:') AS has_scheme FROM statements WHERE object IS NOT NULL")
def uri_has_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "statements").where("object IS NOT NULL")
    return rows.select("stmt_id", C.uri_has_scheme(F.col("object")).alias("has_scheme"))


_URI_SQL = r"""
SELECT stmt_id, object,
  CASE WHEN regexp_matches(object, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN regexp_extract(object, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) END AS scheme,
  CASE WHEN regexp_matches(object, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//') THEN regexp_extract(object, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) END AS authority,
  regexp_extract(object, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path,
  CASE WHEN regexp_matches(object, '^[^?#]*\?') THEN regexp_extract(object, '^[^?#]*\?([^#]*)', 1) END AS query,
  CASE WHEN contains(object, '#') THEN regexp_extract(object, '(#[\s\S]*)$', 1) END AS fragment
FROM statements WHERE o_type = 'URI'"""


@query(f"SELECT stmt_id, scheme, authority, path, query, fragment FROM ({_URI_SQL})")
def uri_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "statements").where("o_type = 'URI'")
    return rows.select("stmt_id", C.uri_parse(F.col("object")).alias("u")).select("stmt_id", "u.*")


@query("SELECT stmt_id, object AS uri FROM statements WHERE o_type = 'URI'")
def uri_serialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "statements").where("o_type = 'URI'")
    return rows.select("stmt_id", C.uri_serialise(C.uri_parse(F.col("object"))).alias("uri"))


@query("""
SELECT stmt_id, CASE WHEN starts_with(subject, 'http://kelmar.example/thing/') THEN substr(subject, 29) ELSE subject END AS uri
FROM statements WHERE s_type = 'URI'""")
def uri_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "statements").where("s_type = 'URI'")
    return rows.select("stmt_id", C.uri_relative(F.col("subject"), FOLDER).alias("uri"))


@query("SELECT stmt_id, starts_with(subject, 'http://kelmar.example/thing/') AS under FROM statements WHERE s_type = 'URI'")
def uri_under_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "statements").where("s_type = 'URI'")
    return rows.select("stmt_id", C.uri_under(F.col("subject"), FOLDER).alias("under"))


@query("""
WITH r AS (
  SELECT stmt_id, predicate, subject, regexp_extract(predicate, '^(.*/)[^/]*$', 1) AS folder,
         regexp_extract(predicate, '^([^/]*//[^/]*)', 1) AS host, regexp_extract(predicate, '^([^#]*)', 1) AS page
  FROM statements WHERE p_type = 'URI' AND s_type = 'URI')
SELECT stmt_id, subject AS absolute, folder || 'x.ttl' AS name, host || '/y' AS rooted, page || '#z' AS fragment,
       page || '?q' AS query, regexp_extract(predicate, '^([A-Za-z]*:)', 1) || '//other.example/a' AS authority,
       host || '/up.ttl' AS up
FROM r""")
def uri_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "statements").where("p_type = 'URI' AND s_type = 'URI'")
    against = lambda r: C.uri_resolve(F.lit(r) if isinstance(r, str) else r, F.col("predicate"))
    return rows.select(
        "stmt_id", against(F.col("subject")).alias("absolute"), against("./x.ttl").alias("name"), against("/y").alias("rooted"),
        against("#z").alias("fragment"), against("?q").alias("query"), against("//other.example/a").alias("authority"),
        against("../../../up.ttl").alias("up"),
    )


@query("""SELECT doc, '/' || doc AS path, doc AS same, CAST(NULL AS VARCHAR) AS remote FROM inputs""")
def uri_to_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda start: C.uri_to_path(F.concat(F.lit(start), F.col("doc")))
    return _t(spark, sf_dir, "inputs").select(
        "doc", path("file:///").alias("path"), path("").alias("same"), path("http://h/").alias("remote")
    )


@query("SELECT node_id, '/' || buf AS path FROM nodes WHERE buf IS NOT NULL")
def file_uri_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "nodes").where("buf IS NOT NULL")
    return rows.select("node_id", C.file_path(C.file_uri(F.concat(F.lit("/"), F.col("buf")))).alias("path"))


@query("SELECT stmt_id, subject AS uri FROM statements WHERE s_type = 'URI' AND p_type = 'URI'")
def uri_relative_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "statements").where("s_type = 'URI' AND p_type = 'URI'")
    base = F.lit("http://kelmar.example/thing/sub/here.ttl")
    return rows.select("stmt_id", C.uri_resolve(C.uri_relative_to(F.col("subject"), base), base).alias("uri"))


@query("""
WITH n AS (SELECT doc, name, row_number() OVER (PARTITION BY doc ORDER BY ord) AS k, count(*) OVER (PARTITION BY doc) AS n FROM prefixes)
SELECT doc, k - 1 AS place, 'l' || doc || '-' || k AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#first' AS p, 'LITERAL' AS o_type, name AS o FROM n
UNION ALL
SELECT doc, k - 1, 'l' || doc || '-' || k, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#rest', CASE WHEN k = n THEN 'URI' ELSE 'BLANK' END,
  CASE WHEN k = n THEN 'http://www.w3.org/1999/02/22-rdf-syntax-ns#nil' ELSE 'l' || doc || '-' || (k + 1) END FROM n""")
def list_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = env.scopes(_t(spark, sf_dir, "prefixes"))
    return env.list_statements(scopes.select("doc", F.transform("env", lambda e: e["name"]).alias("names")), "doc", "names")


# Terms and text


@query("""SELECT node_id, length(buf) AS n_chars, strlen(buf) AS n_bytes,
    (CASE WHEN contains(buf, chr(10)) OR contains(buf, chr(13)) THEN 1 ELSE 0 END) + (CASE WHEN contains(buf, '"') THEN 2 ELSE 0 END) AS flags
    FROM nodes""")
def text_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "nodes").select("node_id", C.text_measure(F.col("buf")).alias("m")).select("node_id", "m.*")


_NUM = r"^\s*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


@query(rf"SELECT stmt_id, coalesce(try_cast(regexp_extract(object, '{_NUM}', 1) AS DOUBLE), 0.0) AS number FROM statements WHERE o_type = 'LITERAL' AND object IS NOT NULL")
def parse_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "statements").where("o_type = 'LITERAL' AND object IS NOT NULL")
    return rows.select("stmt_id", C.parse_double(F.col("object")).alias("number"))


@query("""
SELECT stmt_id, regexp_replace(regexp_replace(CAST(round(CAST(object AS DECIMAL(38,12)), 4)::DECIMAL(38,4) AS VARCHAR), '0+$', ''), '\\.$', '.0') AS text
FROM statements WHERE o_datatype = 'http://vocab.example/xsd#decimal' AND try_cast(object AS DECIMAL(38,12)) IS NOT NULL""".replace("\\\\", "\\"))
def node_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "statements").where("o_datatype = 'http://vocab.example/xsd#decimal'")
    number = F.col("object").try_cast("decimal(38,12)")
    return rows.where(number.isNotNull()).select("stmt_id", C.decimal_text(number, 4).alias("text"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS text FROM orders")
def node_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", C.integer_text(F.col("o_orderkey")).alias("text"))


@query("SELECT doc_id, to_base64(encode(text)) AS text FROM documents WHERE text IS NOT NULL")
def base64_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", C.base64_text(F.encode("text", "utf-8")).alias("text"))


@query("""SELECT doc_id, rtrim(regexp_replace(to_base64(encode(text)), '(.{76})', '\\1' || chr(10), 'g'), chr(10)) AS text
    FROM documents WHERE text IS NOT NULL""")
def base64_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", C.base64_text(F.encode("text", "utf-8"), True).alias("text"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def base64_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    wrapped = C.base64_text(F.encode("text", "utf-8"), True)
    return rows.select("doc_id", F.decode(C.base64_bytes(wrapped), "utf-8").alias("text"))


@query("SELECT doc_id, CAST(length(to_base64(encode(text))) AS BIGINT) AS flat, CAST(length(to_base64(encode(text))) + greatest((strlen(text) - 1) // 57, 0) AS BIGINT) AS wrapped FROM documents WHERE text IS NOT NULL")
def base64_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    n = F.octet_length("text")
    return rows.select("doc_id", C.base64_length(n).cast("bigint").alias("flat"), C.base64_length(n, True).cast("bigint").alias("wrapped"))


_ESC = "replace(replace(replace(replace(replace({}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), '\"', '\\\"')"


@query(f"SELECT doc_id, {_ESC.format('text')} AS text FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')")
def escape_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))
    return rows.select("doc_id", C.escape_text(F.col("text")).alias("text"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def escape_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", C.unescape_text(C.escape_text(F.col("text"), True, True)).alias("text"))


@query("""SELECT stmt_id, CASE WHEN contains(object, chr(10)) OR contains(object, chr(13)) OR contains(object, '"') THEN '\"\"\"' ELSE '"' END AS quotes
    FROM statements WHERE o_type = 'LITERAL' AND object IS NOT NULL""")
def literal_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "statements").where("o_type = 'LITERAL' AND object IS NOT NULL")
    return rows.select("stmt_id", C.literal_quotes(C.text_measure(F.col("object"))["flags"]).alias("quotes"))


@query(f"""
SELECT l_orderkey, l_linenumber, k AS kind, v AS value, CASE k WHEN 'integer' THEN true WHEN 'decimal' THEN contains(v, '.') AND NOT ends_with(v, '.') ELSE false END AS bare,
  CASE WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN '{XSD}integer' WHEN regexp_matches(v, '^[+-]?([0-9]+\\.[0-9]+|\\.[0-9]+)$') THEN '{XSD}decimal' END AS inferred
FROM (SELECT l_orderkey, l_linenumber, 'integer' AS k, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS v FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'decimal', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, 'string', l_returnflag FROM lineitem)""")
def literal_shorthand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.explode(F.array(
            F.struct(F.lit("integer").alias("kind"), F.col("l_quantity").cast("bigint").cast("string").alias("value")),
            F.struct(F.lit("decimal").alias("kind"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("value")),
            F.struct(F.lit("string").alias("kind"), F.col("l_returnflag").alias("value")),
        )).alias("x"),
    ).select("l_orderkey", "l_linenumber", "x.*")
    bare = C.bare_literal(F.col("value"), F.concat(F.lit(XSD), F.col("kind")))
    return rows.select("*", bare.alias("bare"), C.number_datatype(F.col("value")).alias("inferred"))


@query("SELECT stmt_id, CASE WHEN s_type = 'BLANK' THEN 'd1-' || subject ELSE subject END AS added, subject AS chopped FROM statements")
def blank_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = C.add_blank_prefix(F.col("s_type"), F.col("subject"), "d1-")
    return _t(spark, sf_dir, "statements").select(
        "stmt_id", added.alias("added"), C.chop_blank_prefix(F.col("s_type"), added, "d1-").alias("chopped")
    )


@query("SELECT stmt_id, coalesce(graph, 'http://kelmar.example/graph/default') AS graph FROM statements")
def default_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "statements").select("stmt_id", F.coalesce("graph", F.lit("http://kelmar.example/graph/default")).alias("graph"))


@query("""SELECT a.node_id, a.type IS NOT DISTINCT FROM b.type AND a.buf IS NOT DISTINCT FROM b.buf AS same
    FROM nodes a JOIN nodes b ON b.node_id = a.node_id + 1""")
def node_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _t(spark, sf_dir, "nodes").select("node_id", "type", "buf")
    after = nodes.select((F.col("node_id") - 1).alias("_id"), F.col("type").alias("_type"), F.col("buf").alias("_buf"))
    both = nodes.join(after, F.col("node_id") == F.col("_id"))
    return both.select("node_id", C.same_node(F.col("type"), F.col("buf"), F.col("_type"), F.col("_buf")).alias("same"))


# Texts of the status codes, in the order of their numbers.
_STATUS_SQL = """WHEN 0 THEN 'Success' WHEN 1 THEN 'Non-fatal failure' WHEN 2 THEN 'Unknown error' WHEN 3 THEN 'Invalid syntax'
    WHEN 4 THEN 'Invalid argument' WHEN 5 THEN 'Not found' WHEN 6 THEN 'Blank node ID clash' WHEN 7 THEN 'Invalid CURIE'
    WHEN 8 THEN 'Internal error' WHEN 9 THEN 'Error writing to file' WHEN 10 THEN 'Invalid text encoding'"""


@query(f"SELECT stmt_id, CASE stmt_id % 13 {_STATUS_SQL} ELSE 'Unknown error' END AS message FROM statements")
def status_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "statements").select("stmt_id", C.status_message((F.col("stmt_id") % 13).cast("int")).alias("message"))


@query("""SELECT stmt_id FROM statements WHERE s_type IN ('URI', 'CURIE', 'BLANK') AND subject IS NOT NULL
    AND p_type IN ('URI', 'CURIE', 'BLANK') AND predicate IS NOT NULL AND o_type IS NOT NULL AND object IS NOT NULL
    AND NOT (o_datatype IS NOT NULL AND o_lang IS NOT NULL)
    AND NOT coalesce(((flags & 64) <> 0 AND (flags & 10) <> 0) OR ((flags & 128) <> 0 AND (flags & 20) <> 0), false)""")
def valid_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "statements").withColumnsRenamed({v: k for k, v in NAMES.items()})
    return rows.where(C.valid_statement()).select("stmt_id")


@query("""
WITH w AS (
  SELECT stmt_id, lag(doc) OVER d IS NULL AS start,
    g_type IS DISTINCT FROM lag(g_type) OVER d OR graph IS DISTINCT FROM lag(graph) OVER d AS ng,
    s_type IS DISTINCT FROM lag(s_type) OVER d OR subject IS DISTINCT FROM lag(subject) OVER d AS ns,
    p_type IS DISTINCT FROM lag(p_type) OVER d OR predicate IS DISTINCT FROM lag(predicate) OVER d AS np
  FROM statements WINDOW d AS (PARTITION BY doc ORDER BY seq NULLS FIRST, stmt_id))
SELECT stmt_id, start OR ng AS new_graph, start OR ng OR ns AS new_subject, start OR ng OR ns OR np AS new_predicate FROM w""")
def elide_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return env.elisions(_t(spark, sf_dir, "statements")).select("stmt_id", "new_graph", "new_subject", "new_predicate")


# Lines and documents

_TERM_SQL = ", ".join(
    f"CASE WHEN s.{k} = 'CURIE' AND {k}_p.uri IS NOT NULL THEN 'URI' ELSE s.{k} END AS {k}, "
    f"CASE WHEN s.{k} = 'CURIE' AND {k}_p.uri IS NOT NULL THEN {k}_p.uri || substr(s.{v}, instr(s.{v}, ':') + 1) ELSE s.{v} END AS {v}"
    for k, v in env.TERMS
)
_SCOPE_SQL = " ".join(
    f"LEFT JOIN first {k}_p ON s.{k} = 'CURIE' AND {k}_p.doc = s.doc AND contains(s.{v}, ':') AND {k}_p.name = substr(s.{v}, 1, instr(s.{v}, ':') - 1)"
    for k, v in env.TERMS
)
_COHERENT_SQL = """coalesce(s_type IN ('URI', 'CURIE', 'BLANK') AND subject IS NOT NULL AND p_type IN ('URI', 'CURIE', 'BLANK')
    AND predicate IS NOT NULL AND o_type IS NOT NULL AND object IS NOT NULL AND NOT (o_datatype IS NOT NULL AND o_lang IS NOT NULL)
    AND NOT coalesce(((flags & 64) <> 0 AND (flags & 10) <> 0) OR ((flags & 128) <> 0 AND (flags & 20) <> 0), false), false)"""


def _lost(terms: list[tuple[str, str]]) -> str:
    names = ", ".join(f"CASE WHEN {k} = 'CURIE' THEN {v} END" for k, v in terms)
    return f"'undefined namespace prefix ' || chr(39) || coalesce({names}) || chr(39)"


#: Every statement with its names in full, and why it cannot be written as a quad or as a triple.
_EXPANDED_SQL = f"""
WITH first AS (SELECT doc, name, min(ord) AS ord, arg_max(uri, ord) AS uri FROM prefixes WHERE name IS NOT NULL AND uri IS NOT NULL GROUP BY doc, name),
named AS (SELECT s.stmt_id, s.doc, s.o_lang, s.flags, {_TERM_SQL} FROM statements s {_SCOPE_SQL}),
expanded AS (SELECT *, CASE WHEN NOT {_COHERENT_SQL} THEN 'incoherent statement' ELSE {_lost(env.WRITTEN)} END AS no_quad,
  CASE WHEN NOT {_COHERENT_SQL} THEN 'incoherent statement' ELSE {_lost(env.WRITTEN[:-1])} END AS no_triple FROM named)
"""
_TEXT_SQL = """CASE {k} WHEN 'URI' THEN '<' || {v} || '>' WHEN 'BLANK' THEN '_:' || {v} END"""
_LITERAL_SQL = f"""'"' || {_ESC.format('object')} || '"' || CASE WHEN o_lang IS NOT NULL THEN '@' || o_lang
    WHEN o_datatype IS NOT NULL THEN '^^<' || o_datatype || '>' ELSE '' END"""


def _line_sql(quads: bool) -> str:
    parts = [_TEXT_SQL.format(k="s_type", v="subject"), _TEXT_SQL.format(k="p_type", v="predicate"),
             f"CASE WHEN o_type = 'LITERAL' THEN {_LITERAL_SQL} ELSE {_TEXT_SQL.format(k='o_type', v='object')} END"]
    line = " || ' ' || ".join(parts) + (f" || coalesce(' ' || {_TEXT_SQL.format(k='g_type', v='graph')}, '')" if quads else "")
    why = "no_quad" if quads else "no_triple"
    return f"{_EXPANDED_SQL} SELECT stmt_id, CASE WHEN {why} IS NULL THEN {line} || ' .' END AS line, {why} AS refused FROM expanded"


def _expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements with prefixed names in full where their document defines the prefix; ``refused`` tells of the others."""
    rows = env.expand_statements(spread(_t(spark, sf_dir, "statements")), _t(spark, sf_dir, "prefixes"))
    return rows.withColumnsRenamed({v: k for k, v in NAMES.items()})


def _lines(spark: SparkSession, sf_dir: str, quads: bool = True, ascii_only: bool = False) -> DataFrame:
    return _expanded(spark, sf_dir).select("stmt_id", lines.statement_line(quads, ascii_only, True).alias("line"), lines.refusal(quads).alias("refused"))


_ALL_SQL = ", ".join(f"{k}, {v}" for k, v in env.TERMS)
_ANY_LOST = " OR ".join(f"coalesce({k} = 'CURIE', false)" for k, _ in env.TERMS)


@query(_EXPANDED_SQL + f"SELECT stmt_id, doc, {_ALL_SQL}, {_ANY_LOST} AS undefined FROM named")
def env_expand_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All terms of all statements absolute, by the prefixes and the base of their documents."""
    tables = [_t(spark, sf_dir, t) for t in ("statements", "prefixes", "inputs")]
    return env.expand_statements(*tables).select("stmt_id", "doc", *[c for pair in env.TERMS for c in pair], "undefined")


#: Heads of documents: a directive is a line; syntaxes without directives have an error a line, or in strict reading one.
_HEADS_SQL = """
WITH i AS (SELECT doc, coalesce(syntax, 'trig') AS syntax, coalesce(strict, true) AS strict FROM inputs),
d AS (SELECT i.doc, p.ord, p.name, p.uri, i.syntax, i.strict FROM i JOIN prefixes p ON p.doc = i.doc)
SELECT doc, 'prefix' AS kind, name, uri FROM d WHERE syntax IN ('turtle', 'trig')
UNION ALL SELECT doc, 'error', NULL, NULL FROM d WHERE syntax NOT IN ('turtle', 'trig') AND (NOT strict OR ord = 0)"""


@query(_HEADS_SQL)
def documents_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the documents' heads; the fixed documents of ``read_*`` have all other events."""
    return documents.read_documents(_t(spark, sf_dir, "inputs")).select("doc", "kind", "name", "uri")


@query(_line_sql(True))
def nq_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per statement: its line, or why it has none."""
    return _lines(spark, sf_dir)


@query(_line_sql(False))
def nt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, quads=False)


_BACK = ["s_type", "s", "p_type", "p", "o_type", "o", "o_datatype_type", "o_datatype", "o_lang"]
_BACK_SQL = "s_type, subject AS s, p_type, predicate AS p, o_type, object AS o, o_datatype_type, o_datatype, o_lang"


@query(_EXPANDED_SQL + f"SELECT stmt_id, g_type, graph AS g, {_BACK_SQL}, no_quad AS refused FROM expanded WHERE no_quad IS NULL")
def nq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements written as ASCII lines and read again; those without a line are rows of ``nq_lines``."""
    back = lines.read_lines(_lines(spark, sf_dir, ascii_only=True), "nquads", column="line")
    return back.where("kind = 'statement'").select("stmt_id", "g_type", "g", *_BACK, "refused")


@query(_EXPANDED_SQL + f"SELECT stmt_id, doc, {BAD_CURIE} AS status, no_quad AS message FROM expanded WHERE no_quad <> 'incoherent statement'")
def write_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that no text or line can hold, as their document defines no prefix for a name in them."""
    return env.write_errors(_t(spark, sf_dir, "statements"), _t(spark, sf_dir, "prefixes"))


@query("SELECT n_nationkey, '<http://data.example/nation/' || n_nationkey || '> <http://data.example/name> \"' || n_name || '\" .' AS line FROM nation")
def nation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "nation").select(
        "n_nationkey", F.lit(0).alias("flags"), F.lit(None).cast("string").alias("g_type"), F.lit(None).cast("string").alias("g"),
        F.lit("URI").alias("s_type"), F.concat(F.lit("http://data.example/nation/"), F.col("n_nationkey").cast("string")).alias("s"),
        F.lit("URI").alias("p_type"), F.lit("http://data.example/name").alias("p"), F.lit("LITERAL").alias("o_type"),
        F.col("n_name").alias("o"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"),
    )
    return rows.select("n_nationkey", lines.statement_line(False).alias("line"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir).withColumn("flags", F.lit(0)).withColumn("seq", F.col("stmt_id"))


def _text(spark: SparkSession, sf_dir: str, syntax: str) -> DataFrame:
    return documents.document_text(_events(spark, sf_dir), syntax, flat=True, fulluris="true")


@query()
def trig_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements that can be written, as TriG; ``trig_reread`` and ``trig_refused`` tell whether it is right."""
    return _text(spark, sf_dir, "trig")


@query()
def turtle_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, "turtle")


@query()
def turtle_reserialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements written as Turtle, read again and written again, in one pass after one shuffle."""
    return documents.transcode_pieces(_text(spark, sf_dir, "turtle"), "turtle", "turtle")


# a reader renames labels that look like its own
_LABEL = "CASE WHEN {k} = 'BLANK' THEN regexp_replace({v}, '^b([0-9])', 'B\\1') ELSE {v} END AS {n}".replace("\\\\", "\\")
_REREAD_SQL = ", ".join(
    ["doc", *[f"{k}, {_LABEL.format(k=k, v=v, n=n)}" for k, v, n in (("s_type", "subject", "s"), ("p_type", "predicate", "p"), ("o_type", "object", "o"))],
     "o_datatype_type, o_datatype, o_lang"]
)


@query(_EXPANDED_SQL + f"SELECT {_REREAD_SQL} FROM expanded WHERE no_triple IS NULL")
def turtle_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement that can be written as Turtle, as it comes back from the text."""
    back = documents.read_pieces(_text(spark, sf_dir, "turtle"), "turtle", expand="false")
    return back.where("kind = 'statement'").select("doc", *_BACK)


@query(_EXPANDED_SQL + f"SELECT g_type, {_LABEL.format(k='g_type', v='graph', n='g')}, {_REREAD_SQL} FROM expanded WHERE no_quad IS NULL")
def trig_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = documents.read_pieces(_text(spark, sf_dir, "trig"), "trig", expand="false")
    return back.where("kind = 'statement'").select("doc", "g_type", "g", *_BACK)


@query(_EXPANDED_SQL + f"SELECT {_REREAD_SQL} FROM expanded WHERE no_triple IS NULL")
def turtle_rewritten_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of ``turtle_reserialised``, read once more."""
    again = documents.transcode_pieces(_text(spark, sf_dir, "turtle"), "turtle", "turtle")
    back = documents.read_pieces(again, "turtle", expand="false")
    return back.where("kind = 'statement'").select("doc", *_BACK)


@query(_EXPANDED_SQL + "SELECT doc, stmt_id AS seq, CASE no_triple WHEN 'incoherent statement' THEN 4 ELSE 7 END AS status, no_triple AS message FROM expanded WHERE no_triple IS NOT NULL")
def turtle_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements that the writer of Turtle refuses, each with why."""
    return documents.refused_statements(_events(spark, sf_dir), "turtle", flat=True, fulluris="true")


@query(_EXPANDED_SQL + "SELECT doc, stmt_id AS seq, CASE no_quad WHEN 'incoherent statement' THEN 4 ELSE 7 END AS status, no_quad AS message FROM expanded WHERE no_quad IS NOT NULL")
def trig_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.refused_statements(_events(spark, sf_dir), "trig", flat=True, fulluris="true")


# Files and streams


def _filed(spark: SparkSession, sf_dir: str, syntax: str, source: str | None = None) -> DataFrame:
    """The statements written to files of a syntax in the shared folder, and read from there by URI and pattern."""
    register(spark)
    events = _events(spark, sf_dir).where(lines.refusal(syntax in ("nquads", "trig")).isNull())
    sorted_rows = events.repartitionByRange(parallelism(spark), "doc", "seq").sortWithinPartitions("doc", "seq")
    path = shared_folder(spark, f"files-{source or syntax}")
    slim = sorted_rows.select(*[c for c in EVENT.names if c in sorted_rows.columns])
    slim.write.format(syntax).option("fullUris", "true").mode("overwrite").save(path)
    uri = path if ":" in path.partition("/")[0] else f"file://{os.path.abspath(path)}"
    back = spark.read.format(source or syntax).option("mode", "FAILFAST").option("expand", "false").load(f"{uri}/part-*")
    return back.where("kind = 'statement'")


_FILED_SQL = _REREAD_SQL.removeprefix("doc, ")


@query(_EXPANDED_SQL + f"SELECT {_FILED_SQL} FROM expanded WHERE no_triple IS NULL")
def turtle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, "turtle").select(*_BACK)


@query(_EXPANDED_SQL + f"SELECT g_type, {_LABEL.format(k='g_type', v='graph', n='g')}, {_FILED_SQL} FROM expanded WHERE no_quad IS NULL")
def trig_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, "trig").select("g_type", "g", *_BACK)


@query(_EXPANDED_SQL + f"SELECT {_BACK_SQL} FROM expanded WHERE no_triple IS NULL")
def ntriples_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, "ntriples").select(*_BACK)


@query(_EXPANDED_SQL + f"SELECT g_type, graph AS g, {_BACK_SQL} FROM expanded WHERE no_quad IS NULL")
def nquads_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, "nquads").select("g_type", "g", *_BACK)


@query(_EXPANDED_SQL + f"SELECT g_type, graph AS g, {_BACK_SQL} FROM expanded WHERE no_quad IS NULL")
def files_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir, "nquads", "rdf").select("g_type", "g", *_BACK)
