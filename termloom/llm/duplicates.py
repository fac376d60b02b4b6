"""Records that differ in formatting only, collapsed and counted (problem 6).

Byte-identical rows are collapsed first with their counts; only the distinct survivors are brought
to canonical form; these are grouped again on the full canonical text and the counts summed. To
label every row, survivors and rows meet in joins that are fragmented by estimated load, so a
group with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.skew import fragment, plan_loads, replicate
from termloom.util import cut

#: What does not count: all but letters, digits and the marks that carry accents.
NOT_COUNTED = r"[^\p{L}\p{N}\p{M}]"
#: Ends of a field, and what parts name from value.
FIELD_END, NAME_END = r"[;|\n\r]", "[:=]"

KEYS = ("subject", "type", "object")


def plain(text: Column) -> Column:
    """Letters and digits only, case folded; null as a text that no value has."""
    # the optimizer would take lower(upper(x)) for lower(x), which keeps ß apart from SS
    return F.coalesce(F.lower(F.regexp_replace(F.upper(text), NOT_COUNTED, "")), F.lit("\x00"))


def field_set(text: Column) -> Column:
    """The distinct name=value fields of a description in sorted order, as one text."""

    def one(field: Column) -> Column:
        parts = F.split(field, NAME_END, 2)
        return F.concat(
            plain(parts[0]), F.lit("="), F.when(F.size(parts) > 1, plain(parts[1])).otherwise(F.lit(""))
        )

    fields = F.filter(F.transform(F.split(text, FIELD_END), one), lambda x: x != "=")
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(fields)), "\n"), F.lit("\x00"))


def survivors(rows: DataFrame, id_column: str = "desc_id") -> DataFrame:
    """One row per byte-identical record, with its smallest id and count, and its canonical text."""
    slim = rows.select(F.col(id_column).alias("_id"), *KEYS)
    collapsed = slim.groupBy(*KEYS).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    canonical = F.concat_ws("\n\n", plain(F.col("subject")), plain(F.col("type")), field_set(F.col("object")))
    return collapsed.withColumn("_canonical", canonical)


def _labelled(rows: DataFrame, keys: Sequence[str], labels: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``label`` from the one row of ``labels`` that has the same keys, nulls equal."""
    plan = plan_loads(rows, keys)
    left = fragment(rows, plan)
    right = replicate(labels, plan).select(
        F.col("_task").alias("_r_task"), *[F.col(k).alias(f"_r_{k}") for k in keys], F.col(label)
    )
    same = F.col("_task") == F.col("_r_task")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, same).drop("_task", "_r_task", *[f"_r_{k}" for k in keys])


def collapse(rows: DataFrame, id_column: str = "desc_id") -> DataFrame:
    """One record per group of equal rows: ``first_id``, its raw text, ``copies`` and ``forms``.

    ``copies`` counts all rows of the group, ``forms`` its byte-wise different ones. Ids may be
    null: such rows count, and a group of them alone has a null ``first_id``.
    """
    whole = F.min(F.struct(F.col("_first").isNull(), "_first", *KEYS)).alias("_r")
    groups = survivors(rows, id_column).groupBy("_canonical").agg(
        whole, F.sum("_n").alias("copies"), F.count(F.lit(1)).alias("forms")
    )
    return groups.select(F.col("_r._first").alias("first_id"), *[f"_r.{k}" for k in KEYS], "copies", "forms")


def repeats(rows: DataFrame, id_column: str = "desc_id") -> DataFrame:
    """(first_id, id) of every row that has an equal row with a smaller id.

    Equal: subject, type and the set of name/value fields of object agree in letters and digits,
    case folded (``ß`` as ``ss``); accents count; combining marks count as written, without
    Unicode normalisation. A field is parted at its first ``:`` or ``=``; one without either is a
    name with no value; fields without letters and digits are none.

    Defined results: nulls equal nulls only; empty tables give no rows; a null id is never
    reported; very long texts are compared whole.
    """
    distinct = cut(survivors(rows, id_column))
    groups = distinct.groupBy("_canonical").agg(F.min("_first").alias("first_id"))
    labels = _labelled(distinct.select(*KEYS, "_canonical"), ["_canonical"], groups, "first_id").select(*KEYS, "first_id")
    slim = rows.select(F.col(id_column).alias("_id"), *KEYS)
    found = _labelled(slim, KEYS, labels, "first_id").where(F.col("_id") > F.col("first_id"))
    return found.select("first_id", F.col("_id").alias(id_column))
