"""Queries of problems 1, 4 and 5 with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import rejects, skew, wide
from termloom.util import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(table(spark, sf_dir, "error_lines"))


def p1_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.accepted(table(spark, sf_dir, "error_lines"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(table(spark, sf_dir, "statements"))


def p4_key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.key_shares(table(spark, sf_dir, "statements"))


def p4_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.late_rows_per_key(table(spark, sf_dir, "statements"))


def _wide_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, t) for t in ("manifests", "prefixes", "attributes"))


def p5_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity with typed columns; the number of failures beside them."""
    failures = F.coalesce(F.aggregate(F.map_values("cast_failures"), F.lit(0).cast("bigint"), lambda n, x: n + x["n"]), F.lit(0).cast("bigint"))
    return _wide(spark, sf_dir).withColumn("n_failures", failures).drop("cells", "cast_failures")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests, prefixes, attributes = _wide_inputs(spark, sf_dir)
    return wide.wide_rows(manifests, prefixes, attributes, wide.attribute_columns(attributes))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.cell_list(_wide(spark, sf_dir))


def p5_cast_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.cast_failures(*_wide_inputs(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_valid, p4_found, p4_key_results, p4_late_rows, p5_found, p5_wide, p5_cast_failures)
}

_PAIRS = """
pairs AS (
  SELECT m.row_id, m.subject, a.attr, a.dtype, m.object AS raw,
         trim(m.object, chr(32) || chr(9) || chr(10) || chr(13)) AS t
  FROM manifests m
  LEFT JOIN prefixes p ON m.p_type = 'CURIE' AND contains(m.predicate, ':') AND p.doc = m.doc
       AND p.name = substr(m.predicate, 1, instr(m.predicate, ':') - 1)
  JOIN attributes a ON a.predicate = CASE WHEN m.p_type = 'CURIE'
       THEN p.uri || substr(m.predicate, instr(m.predicate, ':') + 1) ELSE m.predicate END
),
judged AS (
  SELECT *, coalesce(CASE dtype
    WHEN 'string' THEN t <> ''
    WHEN 'integer' THEN regexp_full_match(t, '[+-]?[0-9]+')
    WHEN 'decimal' THEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)')
    WHEN 'boolean' THEN t IN ('true', 'false', '1', '0')
    WHEN 'date' THEN regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(t AS DATE) IS NOT NULL
    ELSE false END, false) AS good
  FROM pairs
)"""

_F = r'("([^"]|"")*"|[^",\r\n]*)'
_D = r'([0-9]+|"[0-9]+")'
_FIRST = r'^(?:"(?:[^"]|"")*"|[^",\r\n]*)'

ORACLE = {
    "p1_found": rf"""
        WITH q AS (SELECT raw_id, coalesce(raw, '') AS raw FROM error_lines),
        s AS (
          SELECT raw_id, raw, regexp_full_match(raw, '{_F}(,{_F})*\r?') AS quoted,
                 regexp_full_match(raw, '{_F}(,{_F}){{4}}\r?') AS five,
                 regexp_full_match(raw, '{_D},{_F},{_D},{_D},{_F}\r?') AS digits FROM q),
        f AS (
          SELECT *, CASE WHEN digits THEN regexp_extract(raw, '^"?0*([0-9]*)', 1) END AS st,
                 CASE WHEN digits THEN regexp_replace(raw, '^"?[0-9]+"?,', '') END AS rest FROM s),
        g AS (
          SELECT *, regexp_extract(rest, '{_FIRST}', 0) AS fn,
                 regexp_replace(rest, '{_FIRST},', '') AS nums FROM f),
        h AS (
          SELECT *, regexp_extract(nums, '^"?0*([0-9]*)"?,"?0*([0-9]*)"?', 1) AS ln,
                 regexp_extract(nums, '^"?0*([0-9]*)"?,"?0*([0-9]*)"?', 2) AS co FROM g),
        r AS (
          SELECT raw_id, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT five THEN 'columns'
            WHEN NOT digits THEN 'value'
            WHEN coalesce(try_cast(CASE st WHEN '' THEN '0' ELSE st END AS HUGEINT), 99) > 10 THEN 'value'
            WHEN coalesce(try_cast(CASE ln WHEN '' THEN '0' ELSE ln END AS HUGEINT), 0) NOT BETWEEN 1 AND 2147483647 THEN 'value'
            WHEN coalesce(try_cast(CASE co WHEN '' THEN '0' ELSE co END AS HUGEINT), -1) NOT BETWEEN 0 AND 2147483647 THEN 'value'
            WHEN NOT regexp_matches(CASE WHEN starts_with(fn, '"') THEN substr(fn, 2, length(fn) - 2) ELSE fn END, '[^\pZ\pC]') THEN 'value'
            END AS reason FROM h)
        SELECT raw_id, reason FROM r WHERE reason IS NOT NULL""",
    "p4_found": """
        SELECT coalesce(graph, '') AS graph, predicate FROM statements GROUP BY 1, 2
        HAVING count(*) >= 0.02 * (SELECT count(*) FROM statements)""",
    "p4_key_results": """
        SELECT coalesce(graph, '') AS graph, predicate, count(*) AS n_rows, min(emitted_at) AS first_emitted,
               max(emitted_at) AS last_emitted,
               count(*) / (SELECT count(*) FROM statements)::DOUBLE AS share
        FROM statements GROUP BY 1, 2""",
    "p4_late_rows": """
        WITH s AS (SELECT coalesce(graph, '') AS graph, predicate, emitted_at FROM statements),
        k AS (SELECT *, epoch_us(emitted_at) - epoch_us(min(emitted_at) OVER (PARTITION BY graph, predicate)) AS lag FROM s)
        SELECT graph, predicate, count(*) AS n_rows, count(*) FILTER (lag > 604800000000) AS late_rows,
               CAST(sum(lag) FILTER (lag > 604800000000) AS BIGINT) AS late_lag_us
        FROM k GROUP BY 1, 2""",
    "p5_found": f"WITH {_PAIRS} SELECT DISTINCT subject, attr FROM judged WHERE good",
    "p5_cast_failures": f"WITH {_PAIRS} SELECT row_id, subject, attr, dtype, raw AS object FROM judged WHERE NOT good",
}

_RECORDS = ORACLE["p1_found"].rpartition("SELECT raw_id, reason FROM r")[0]
_WHOLE = "CASE WHEN starts_with({0}, '\"') THEN replace(substr({0}, 2, length({0}) - 2), '\"\"', '\"') ELSE {0} END"
ORACLE["p1_valid"] = _RECORDS + rf""", v AS (
          SELECT h.*, regexp_replace(regexp_replace(nums, '^"?[0-9]+"?,"?[0-9]+"?,', ''), '\r$', '') AS m FROM h JOIN r USING (raw_id) WHERE r.reason IS NULL)
        SELECT raw_id, CAST(CASE st WHEN '' THEN '0' ELSE st END AS INTEGER) AS status, {_WHOLE.format("fn")} AS filename,
               CAST(ln AS INTEGER) AS line, CAST(CASE co WHEN '' THEN '0' ELSE co END AS INTEGER) AS col, {_WHOLE.format("m")} AS message FROM v"""
# The columns of `attributes`, which is a fixed table.
_COLUMNS = {
    "string": "action base_uri klass remark result section team title", "integer": "exit_code priority timeout_ms",
    "decimal": "tolerance weight", "boolean": "approved lax reversed", "date": "added_on retired_on",
}
_CAST = {
    "string": "{}", "integer": "try_cast({} AS DECIMAL(38,0))", "decimal": "try_cast({} AS DECIMAL(38,10))", "boolean": "{} IN ('true', '1')",
    "date": "try_cast({} AS DATE)",
}
_CELLS = ", ".join(
    _CAST[dtype].format(f"arg_min(j.t, j.row_id) FILTER (j.good AND j.attr = '{attr}')") + f" AS {attr}"
    for dtype, attrs in _COLUMNS.items() for attr in attrs.split()
)
ORACLE["p5_wide"] = f"""WITH {_PAIRS}, e AS (SELECT subject, count(*) AS n_rows FROM manifests GROUP BY subject)
    SELECT e.subject, any_value(e.n_rows) AS n_rows, {_CELLS}, count(*) FILTER (NOT j.good) AS n_failures
    FROM e LEFT JOIN judged j ON j.subject IS NOT DISTINCT FROM e.subject GROUP BY e.subject"""
