"""Queries of the problems on training data with the SQL they are checked against."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import distinct, duplicates, encoding, frequent, leaks, packing, truncation
from termloom.util import cut, table

FREQUENT_SHARE = 0.005


def p2_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent.frequent_values(table(spark, sf_dir, "statements"), ["object", "predicate"], FREQUENT_SHARE)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_intervals(spark, sf_dir).select("field", "value")


def p2_intervals_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exact count of every value found lies in its interval, and the interval is as narrow as promised."""
    statements = table(spark, sf_dir, "statements")
    found = p2_intervals(spark, sf_dir)
    both = statements.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("object", "predicate")])).alias("x")).select("x.*")
    exact = both.join(F.broadcast(found), ["field", "value"]).groupBy("field", "value", "at_least", "at_most", "n_rows").agg(F.count(F.lit(1)).alias("n"))
    # at most 2 / share values are found
    narrow = F.col("at_most") - F.col("at_least") <= F.col("n_rows") * (FREQUENT_SHARE / 10) + spark.sparkContext.defaultParallelism
    return exact.select("field", "value", F.col("n").between(F.col("at_least"), F.col("at_most")).alias("holds"), narrow.alias("narrow"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled(table(spark, sf_dir, "nodes"))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.judged(table(spark, sf_dir, "nodes")).where("garbled").drop("garbled")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.repeats(table(spark, sf_dir, "descriptions"))


def p6_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.collapse(table(spark, sf_dir, "descriptions"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "statements").select(
        F.to_date("emitted_at").alias("day"), F.coalesce("graph", F.lit("")).alias("graph"), "predicate", "subject"
    )


def p7_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.all_combinations(_days(spark, sf_dir), ["day", "graph", "predicate"], "subject")


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.day_overlaps(_days(spark, sf_dir), F.col("day"), "subject")


def distinct_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per level, the groups, and whether all but one in a hundred lie within three stated errors of the exact count.

    A check of ``p7_distinct`` for tables small enough to count exactly, not a way to count at scale.
    """
    keys = ["day", "graph", "predicate"]
    rows = _days(spark, sf_dir).where("subject IS NOT NULL").distinct()
    kept = [[*s] for n in range(4) for s in combinations(keys, n)]
    level = F.concat_ws("+", *[F.when(F.grouping(k) == 0, k) for k in keys])
    cells = rows.groupingSets([[*s, "subject"] for s in kept], *keys, "subject").agg(level.alias("_l"))
    exact = cells.groupBy("_l", *keys).agg(F.count(F.lit(1)).alias("n"))
    found = p7_distinct(spark, sf_dir)
    same = F.col("_l") == F.when(F.col("level") == "all", "").otherwise(F.col("level"))
    for k in keys:
        same &= F.col(f"f.{k}").eqNullSafe(F.col(f"e.{k}"))
    both = found.alias("f").join(exact.alias("e"), same, "full")
    far = F.coalesce(F.abs(F.col("n_distinct") - F.col("n")) > 3 * F.col("rel_error") * F.col("n") + 1, F.lit(True))
    return both.groupBy("level").agg(F.count(F.lit(1)).alias("n_groups"), (F.count_if(far) <= 0.01 * F.count(F.lit(1))).alias("holds"))


def p7_overlaps_within_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of days, and whether all but one in twenty intersections and unions lie within three of their own errors."""
    days = _days(spark, sf_dir).where("subject IS NOT NULL AND day IS NOT NULL").select("day", "subject").distinct()
    after = days.select(F.date_sub("day", 1).alias("day"), "subject", F.lit(1).alias("b"))
    cells = days.withColumn("a", F.lit(1)).join(after, ["day", "subject"], "full")
    exact = cells.groupBy("day").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count(F.lit(1)).alias("either"))
    pairs = p7_overlaps(spark, sf_dir).join(exact, "day")
    far = (F.abs(F.col("n_both") - F.col("both")) > 3 * F.col("both_error") + 2) | (F.abs(F.col("n_union") - F.col("either")) > 3 * F.col("union_error") + 2)
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), (F.count_if(far) <= 0.05 * F.count(F.lit(1))).alias("holds"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.container_fill(p8_packed(spark, sf_dir))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, containers over capacity, documents split without need, documents with pieces that do not add up, and
    whether less than one in a hundred places is left over, apart from the last container of each task."""
    capacity = packing.CAPACITY
    pieces = cut(p8_packed(spark, sf_dir))
    docs = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"), F.max("piece").alias("last"), F.max("first_token").alias("at"))
    needless = (F.col("n") > 1) & (F.col("tokens") <= capacity)
    gaps = (F.col("last") + 1 != F.col("n")) | (F.col("at") != F.col("last").cast("long") * capacity) | (F.col("n") != F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)))
    open_ends = F.count_distinct(F.shiftright("container", 32))  # containers are numbered per task
    fill = packing.container_fill(pieces).agg(F.count_if(F.col("unused") < 0).alias("n_over"), (F.sum("unused") <= (0.01 * F.count(F.lit(1)) + open_ends) * capacity).alias("tight"))
    counted = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(needless).alias("n_split"), F.count_if(gaps).alias("n_gaps"))
    both = counted.unionByName(fill, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_intervals, p2_intervals_hold, p3_found, p3_restored, p6_found, p6_collapsed, p7_distinct, p7_overlaps, distinct_within_error,
        p7_overlaps_within_error, p8_packed, p8_fill, p8_containers, p9_found, p9_spans, p9_cleaned, p10_found, p10_rates,
    )
}

_PLAIN = r"lower(upper(regexp_replace({}, '[^\pL\pN\pM]', '', 'g')))"
_FIELDS = r"""array_to_string(list_sort(list_distinct(list_filter(list_transform(
    string_split_regex(coalesce(object, ''), '[;|\n\r]'),
    lambda x: {name} || '=' || CASE WHEN regexp_matches(x, '[:=]') THEN {value} ELSE '' END), lambda y: y <> '='))), chr(10))""".format(
    name=_PLAIN.format(r"regexp_extract(x, '^([^:=]*)', 1)"),
    value=_PLAIN.format(r"regexp_extract(x, '(?s)^[^:=]*[:=](.*)$', 1)"),
)
_CANON = f"""
WITH c AS (SELECT desc_id, subject, type, object,
  {_PLAIN.format("coalesce(subject, '')")} || chr(10) || chr(10) || {_PLAIN.format("coalesce(type, '')")} || chr(10) || chr(10) || {_FIELDS} AS k
  FROM descriptions),
g AS (SELECT *, min(desc_id) OVER (PARTITION BY k) AS first_id FROM c)"""

_LEVELS = " UNION ALL ".join(
    f"SELECT '{'+'.join(s) or 'all'}' AS level, count(*) AS n_groups, true AS holds FROM (SELECT DISTINCT {', '.join(s) or '1'} FROM s)"
    for n in range(4) for s in combinations(("day", "graph", "predicate"), n)
)
_LEVELS = f"""WITH s AS (SELECT CAST(emitted_at AS DATE) AS day, coalesce(graph, '') AS graph, predicate FROM statements WHERE subject IS NOT NULL) {_LEVELS}"""

ORACLE = {
    "p2_found": """
        SELECT 'object' AS field, object AS value FROM statements WHERE object IS NOT NULL GROUP BY object
        HAVING count(*) >= 0.005 * (SELECT count(*) FROM statements)
        UNION ALL
        SELECT 'predicate', predicate FROM statements WHERE predicate IS NOT NULL GROUP BY predicate
        HAVING count(*) >= 0.005 * (SELECT count(*) FROM statements)""",
    "p2_intervals_hold": """
        SELECT 'object' AS field, object AS value, true AS holds, true AS narrow FROM statements WHERE object IS NOT NULL GROUP BY object
        HAVING count(*) >= 0.005 * (SELECT count(*) FROM statements)
        UNION ALL
        SELECT 'predicate', predicate, true, true FROM statements WHERE predicate IS NOT NULL GROUP BY predicate
        HAVING count(*) >= 0.005 * (SELECT count(*) FROM statements)""",
    "distinct_within_error": _LEVELS,
    "p7_overlaps_within_error": """
        WITH d AS (SELECT DISTINCT CAST(emitted_at AS DATE) AS day FROM statements WHERE emitted_at IS NOT NULL AND subject IS NOT NULL),
        p AS (SELECT day FROM d UNION SELECT CAST(day - 1 AS DATE) FROM d)
        SELECT count(*) AS n_pairs, true AS holds FROM p""",
    "p8_containers": "SELECT count(DISTINCT doc_id) AS n_docs, 0 AS n_over, 0 AS n_split, 0 AS n_gaps, true AS tight FROM documents",
    "p6_found": f"{_CANON} SELECT first_id, desc_id FROM g WHERE desc_id > first_id",
    "p6_collapsed": f"""{_CANON}
        SELECT first_id, min(subject) FILTER (desc_id = first_id) AS subject, min(type) FILTER (desc_id = first_id) AS type,
               min(object) FILTER (desc_id = first_id) AS object, count(*) AS copies,
               count(DISTINCT (subject, type, object)) AS forms
        FROM g GROUP BY k, first_id""",
}
