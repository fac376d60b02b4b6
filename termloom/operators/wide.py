"""Attribute-value rows into wide, typed rows (problem 5).

Each row's predicate is resolved with the prefixes of its document, the pairs of a subject are
aggregated into a map from attribute to its readable value and its unreadable ones, and the known
attributes are projected out of the map into typed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters removed at both ends of a value: space, tab, line feed, carriage return.
BLANKS = " \t\n\r"
#: What a dtype reads, as a pattern over the trimmed text.
READABLE = {
    "integer": r"^[+-]?[0-9]+$",
    "decimal": r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$",
    "boolean": r"^(?:true|false|1|0)$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
}
SQL_TYPE = {
    "string": "string", "integer": "decimal(38,0)", "decimal": "decimal(38,10)", "boolean": "boolean", "date": "date",
}


def expand_curies(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``rows`` with ``_uri``: the predicate, or for a CURIE the prefix of the row's doc and the rest.

    Null where the predicate is null or its prefix is not defined in the row's document.
    """
    env = prefixes.select(
        F.col("doc").alias("_e_doc"), F.col("name").alias("_e_name"), F.col("uri").alias("_e_uri")
    )
    colon = F.instr("predicate", ":")
    name = F.when((F.col("p_type") == "CURIE") & (colon > 0), F.substring_index("predicate", ":", 1))
    found = rows.withColumn("_name", name).join(
        env, (F.col("doc") == F.col("_e_doc")) & (F.col("_name") == F.col("_e_name")), "left"
    )
    full = F.concat("_e_uri", F.expr("substr(predicate, instr(predicate, ':') + 1)"))
    uri = F.when(F.col("p_type") == "CURIE", full).otherwise(F.col("predicate"))
    return found.withColumn("_uri", uri).drop("_name", "_e_doc", "_e_name", "_e_uri")


def readable(text: Column, dtype: Column) -> Column:
    """Whether the trimmed ``text`` can be read as ``dtype``. False for null text or an unknown dtype."""
    date = text.rlike(READABLE["date"]) & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
    return F.coalesce(
        F.when(dtype == "string", text != "")
        .when(dtype == "integer", text.rlike(READABLE["integer"]))
        .when(dtype == "decimal", text.rlike(READABLE["decimal"]))
        .when(dtype == "boolean", text.rlike(READABLE["boolean"]))
        .when(dtype == "date", date),
        F.lit(False),
    )


def resolved_pairs(manifests: DataFrame, prefixes: DataFrame, attributes: DataFrame) -> DataFrame:
    """(row_id, subject, attr, dtype, raw, value): one row per manifest row of a known attribute.

    ``value`` is the trimmed object where it can be read as the attribute's dtype, else null.
    """
    known = attributes.select(
        "attr", F.col("predicate").alias("_a_uri"), "dtype"
    ).where(F.col("_a_uri").isNotNull() & F.col("attr").isNotNull())
    slim = manifests.select("row_id", "doc", "subject", "p_type", "predicate", F.col("object").alias("raw"))
    # `attributes` names the columns of one table; Spark broadcasts it by its own size check.
    pairs = expand_curies(slim, prefixes).join(known, F.col("_uri") == F.col("_a_uri"))
    text = F.trim("raw", F.lit(BLANKS))
    return pairs.select(
        "row_id", "subject", "attr", "dtype", "raw", F.when(readable(text, F.col("dtype")), text).alias("value")
    )


def attribute_cells(manifests: DataFrame, prefixes: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row per (subject, attr): value of the smallest row_id that can be read, and what could not.

    Rows are combined before the shuffle, so an entity with very many rows costs no more than one
    row per attribute and task.
    """
    pairs = resolved_pairs(manifests, prefixes, attributes)
    good = F.when(F.col("value").isNotNull(), F.struct("row_id", "value"))
    bad = F.when(F.col("value").isNull(), F.struct("row_id", F.col("raw")))
    return pairs.groupBy("subject", "attr", "dtype").agg(
        F.min(good).alias("first_good"),
        F.count("value").alias("n_good"),
        F.min(bad).alias("first_bad"),
        F.count_if(F.col("value").isNull()).alias("n_bad"),
    )


def wide_rows(
    manifests: DataFrame, prefixes: DataFrame, attributes: DataFrame, columns: list[tuple[str, str]]
) -> DataFrame:
    """One row per subject: a typed column per attribute, and the cast failures.

    ``columns`` lists (attr, dtype). Of several readable values the one with the smallest row_id
    stands in the column. ``cells`` keeps the lexical value of every attribute that has one, so a
    number too large for its column is null there and still in ``cells``. ``cast_failures`` maps an
    attribute to the first unreadable object and the number of them; every such row is in
    :func:`cast_failures`.

    Defined results: rows with a null subject form one row; a subject without any known attribute
    stays, with nulls; an unreadable, null or blank object fails; a repeated row changes nothing
    but the counts; empty tables give no rows.
    """
    cells = attribute_cells(manifests, prefixes, attributes)
    entry = F.struct(
        F.col("attr").alias("key"),
        F.struct(
            F.col("first_good.value").alias("value"), "n_good", F.col("first_bad.raw").alias("bad"), "n_bad"
        ).alias("value"),
    )
    # at most one entry per attribute: the map is bounded by the attribute list
    maps = cells.groupBy("subject").agg(F.map_from_entries(F.collect_list(entry)).alias("_map"))
    everyone = manifests.select("subject").groupBy("subject").agg(F.count(F.lit(1)).alias("n_rows"))
    joined = everyone.alias("e").join(
        maps.alias("m"), F.col("e.subject").eqNullSafe(F.col("m.subject")), "left"
    ).select("e.subject", "e.n_rows", "m._map")
    typed = []
    for attr, dtype in columns:
        value = F.col("_map")[attr]["value"]
        if dtype == "boolean":
            typed.append(value.isin("true", "1").alias(attr))
        elif dtype == "string":
            typed.append(value.alias(attr))
        else:
            typed.append(value.try_cast(SQL_TYPE[dtype]).alias(attr))
    with_value = F.map_filter("_map", lambda k, v: v["value"].isNotNull())
    with_bad = F.map_filter("_map", lambda k, v: v["n_bad"] > 0)
    return joined.select(
        "subject",
        "n_rows",
        *typed,
        F.transform_values(with_value, lambda k, v: v["value"]).alias("cells"),
        F.transform_values(with_bad, lambda k, v: F.struct(v["bad"].alias("first"), v["n_bad"].alias("n"))).alias(
            "cast_failures"
        ),
    )


def cell_list(wide: DataFrame) -> DataFrame:
    """(subject, attr) for every cell of :func:`wide_rows` that has a value."""
    return wide.select("subject", F.explode(F.map_keys("cells")).alias("attr"))


def cast_failures(manifests: DataFrame, prefixes: DataFrame, attributes: DataFrame) -> DataFrame:
    """Every row of a known attribute whose object cannot be read as its dtype."""
    pairs = resolved_pairs(manifests, prefixes, attributes)
    return pairs.where(F.col("value").isNull()).select("row_id", "subject", "attr", "dtype", F.col("raw").alias("object"))


def attribute_columns(attributes: DataFrame) -> list[tuple[str, str]]:
    """(attr, dtype) of the attribute table, which is the column list of one table."""
    rows = attributes.where(F.col("attr").isNotNull()).select("attr", "dtype").distinct().orderBy("attr").collect()
    return [(r["attr"], r["dtype"]) for r in rows if r["dtype"] in SQL_TYPE]
