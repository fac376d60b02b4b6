"""Prefixes applied to tables: expand, qualify, find what is undefined.

The prefixes of a document are one row with an ordered list, joined on the document; a list is as
long as a document's head, and the lookup in it is an expression. No prefix is compared with rows of
another document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.columns import uri_resolve
from termloom.schema import BAD_CURIE, RDF_FIRST, RDF_NIL, RDF_REST


def scopes(prefixes: DataFrame) -> DataFrame:
    """(doc, env): the prefixes of each document as a list of (ord, name, uri) in order of definition.

    A name defined again keeps its first place and has its last URI.
    """
    named = prefixes.where(F.col("name").isNotNull() & F.col("uri").isNotNull())
    once = named.groupBy("doc", "name").agg(F.min("ord").alias("ord"), F.max_by("uri", "ord").alias("uri"))
    return once.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "uri"))).alias("env"))


def with_scope(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``rows`` with ``env`` of their document; null where it has no prefixes."""
    env = scopes(prefixes).withColumnRenamed("doc", "_e_doc")
    return rows.join(env, F.col("doc") == F.col("_e_doc"), "left").drop("_e_doc")


def expanded(kind: Column, value: Column, env: Column) -> Column:
    """Full URI of a prefixed name; null if its prefix is not defined; other values as they are."""
    name = F.substring_index(value, ":", 1)
    rest = F.substr(value, F.length(name) + 2)
    found = F.filter(env, lambda e: e["name"] == name)
    full = F.when(F.contains(value, F.lit(":")) & (F.size(found) > 0), F.concat(found[0]["uri"], rest))
    return F.when(kind == "CURIE", full).otherwise(value)


def qualified(kind: Column, value: Column, env: Column) -> Column:
    """Prefixed name of a URI by the first prefix that fits, in order of definition; null if none does."""
    fits = F.filter(env, lambda e: F.startswith(value, e["uri"]))
    short = F.concat(fits[0]["name"], F.lit(":"), F.substr(value, F.length(fits[0]["uri"]) + 1))
    return F.when((kind == "URI") & (F.size(fits) > 0), short)


#: (type column, value column) of the terms of a statement.
TERMS = [("g_type", "graph"), ("s_type", "subject"), ("p_type", "predicate"), ("o_type", "object"),
         ("o_datatype_type", "o_datatype")]
#: The same in the order in which a line has them.
WRITTEN = [*TERMS[1:], TERMS[0]]


def expand_statements(statements: DataFrame, prefixes: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """Statements with all terms absolute, and ``undefined``: whether a prefix was missing.

    A term whose prefix is not defined stays as it is. With ``inputs``, URI references are resolved
    against the ``base_uri`` of their document.
    """
    rows = with_scope(statements, prefixes)
    if inputs is not None:
        bases = inputs.select(F.col("doc").alias("_b_doc"), F.col("base_uri").alias("_base"))
        rows = rows.join(bases, F.col("doc") == F.col("_b_doc"), "left").drop("_b_doc")
    missing = F.lit(False)
    new = {}
    for kind, value in TERMS:
        full = expanded(F.col(kind), F.col(value), F.col("env"))
        lost = (F.col(kind) == "CURIE") & full.isNull()
        missing = missing | F.coalesce(lost, F.lit(False))
        if inputs is not None:
            full = F.when(F.col(kind) == "URI", uri_resolve(F.col(value), F.col("_base"))).otherwise(full)
        new[value] = F.coalesce(full, F.col(value))
        new[kind] = F.when((F.col(kind) == "CURIE") & ~lost, F.lit("URI")).otherwise(F.col(kind))
    # new terms get names of their own first: a name inside a lambda would mean the new column beside it
    full = rows.select(*statements.columns, *[e.alias(f"_new_{c}") for c, e in new.items()], missing.alias("undefined"))
    return full.select(
        *[F.col(f"_new_{c}").alias(c) if c in new else F.col(c) for c in statements.columns], "undefined"
    )


def write_errors(statements: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(stmt_id, doc, status, message) of statements with a prefixed name that cannot be expanded.

    The name told is the first one in a line. Such statements are left out of lines and text.
    """
    rows = expand_statements(statements, prefixes).where("undefined")
    first = F.coalesce(*[F.when(F.col(k) == "CURIE", F.col(v)) for k, v in WRITTEN])
    message = F.concat(F.lit("undefined namespace prefix '"), first, F.lit("'"))
    return rows.select("stmt_id", "doc", F.lit(BAD_CURIE).alias("status"), message.alias("message"))


def undefined_prefixes(statements: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc, prefix, n): prefixes that a document's statements use and the document does not define."""
    uses = None
    for kind, value in TERMS:
        own = statements.where((F.col(kind) == "CURIE") & F.contains(value, F.lit(":"))).select(
            "doc", F.substring_index(value, ":", 1).alias("prefix")
        )
        uses = own if uses is None else uses.unionByName(own)
    counted = uses.groupBy("doc", "prefix").agg(F.count(F.lit(1)).alias("n"))
    known = prefixes.select(F.col("doc").alias("_e_doc"), F.col("name").alias("_e_name"))
    return counted.join(known, (F.col("doc") == F.col("_e_doc")) & (F.col("prefix") == F.col("_e_name")), "left_anti")


def elisions(statements: DataFrame) -> DataFrame:
    """Statements with what a writer may leave out: ``new_graph``, ``new_subject``, ``new_predicate``.

    Compared with the statement before in the same document, in order of ``seq``; a term is new,
    too, if one before it is.
    """
    w = Window.partitionBy("doc").orderBy("seq", "stmt_id")

    def changed(kind: str, value: str) -> Column:
        return ~(
            F.col(kind).eqNullSafe(F.lag(kind).over(w)) & F.col(value).eqNullSafe(F.lag(value).over(w))
        ) | F.lag("doc").over(w).isNull()

    rows = statements.select(
        "*", changed("g_type", "graph").alias("_g"), changed("s_type", "subject").alias("_s"),
        changed("p_type", "predicate").alias("_p"),
    )
    return rows.select(
        *statements.columns, F.col("_g").alias("new_graph"), (F.col("_g") | F.col("_s")).alias("new_subject"),
        (F.col("_g") | F.col("_s") | F.col("_p")).alias("new_predicate"),
    )


def list_statements(rows: DataFrame, key: str, items: str, prefix: str = "l") -> DataFrame:
    """(key, place, s, p, o_type, o): an array column as collections of first and rest statements.

    The cells of a row's list are blank nodes ``prefix``, its key, ``-`` and the place from 1; the last
    cell's rest is nil. Null items are literals without text and are left out with their cell; an empty
    or null array has no statements. No shuffle: a list is one row.
    """
    kept = F.filter(items, lambda x: x.isNotNull())
    cells = rows.select(F.col(key), F.size(kept).alias("_n"), F.posexplode(kept).alias("_at", "_item"))
    cell = lambda at: F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit("-"), at.cast("string"))
    last = F.col("_at") + 1 == F.col("_n")
    first = F.struct(F.lit(RDF_FIRST).alias("p"), F.lit("LITERAL").alias("o_type"), F.col("_item").cast("string").alias("o"))
    rest = F.struct(
        F.lit(RDF_REST).alias("p"), F.when(last, "URI").otherwise("BLANK").alias("o_type"),
        F.when(last, RDF_NIL).otherwise(cell(F.col("_at") + 2)).alias("o"),
    )
    both = cells.select(key, F.col("_at").alias("place"), cell(F.col("_at") + 1).alias("s"), F.explode(F.array(first, rest)).alias("_x"))
    return both.select(key, "place", "s", "_x.*")
