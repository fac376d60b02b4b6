"""Most frequent values of columns with very many distinct values (problem 2): lossy counting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.util import cut

OUT = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("slack", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("bound", T.LongType()),
    ]
)
_ARROW = pa.schema(
    [("field", pa.string()), ("value", pa.string()), ("count", pa.int64()), ("slack", pa.int64()), ("rows", pa.int64()),
     ("bound", pa.int64())]
)


class LossyCounter:
    """Counts of the values that may be frequent, each at most ``delta`` too small.

    The stream is cut into buckets of ``width`` rows. A value first seen in bucket b may have been
    pruned before, so at most b of its rows are missing: its delta. At a bucket boundary all
    entries with count + delta <= b go. The entries kept are at most width * log(rows / width).
    """

    def __init__(self, width: int) -> None:
        self.width = width
        self.rows = 0
        self.entries: dict[str, list[int]] = {}

    @property
    def bucket(self) -> int:
        """Number of full buckets so far: no value has more missing rows."""
        return self.rows // self.width

    def add(self, values: pa.Array) -> None:
        """Count one batch, nulls as rows without a value; prune if a boundary was crossed."""
        before = self.bucket
        entries = self.entries
        counted = values.drop_null().value_counts()
        for value, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
            entry = entries.get(value)
            if entry is None:
                entries[value] = [n, before]
            else:
                entry[0] += n
        self.rows += len(values)
        if self.bucket > before:
            self.prune()

    def prune(self) -> None:
        b = self.bucket
        self.entries = {v: e for v, e in self.entries.items() if e[0] + e[1] > b}


def summaries(df: DataFrame, fields: Sequence[str], eps: float) -> DataFrame:
    """One lossy-counting summary per partition and field.

    Entries have ``count`` and ``slack``, the partition's bound less the entry's delta; one row per
    field with a null value has the partition's ``rows`` and ``bound``. Partials of other tables
    made with the same ``eps`` can be added with ``unionByName``.
    """
    names = list(fields)
    width = max(1, round(1 / eps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [LossyCounter(width) for _ in names]
        for batch in batches:
            for counter, values in zip(counters, batch.columns):
                counter.add(values)
        for name, counter in zip(names, counters):
            counter.prune()
            bound = counter.bucket
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([None], pa.string()), pa.array([0]), pa.array([0]),
                 pa.array([counter.rows]), pa.array([bound])], schema=_ARROW,
            )
            entries = list(counter.entries.items())
            for at in range(0, len(entries), 10_000):
                part = entries[at : at + 10_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array([v for v, _ in part], pa.string()),
                     pa.array([e[0] for _, e in part], pa.int64()), pa.array([bound - e[1] for _, e in part], pa.int64()),
                     pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int64())], schema=_ARROW,
                )

    return df.select(*[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(names)]).mapInArrow(run, OUT)


def frequent_values(
    df: DataFrame, fields: Sequence[str], share: float, eps: float | None = None
) -> DataFrame:
    """(field, value, at_least, at_most, n_rows) of the values that may hold ``share`` of all rows.

    The true count lies in [at_least, at_most], and at_most - at_least <= eps * rows. Every value
    with at least ``share`` of the rows is there; one with less than share - eps never is. ``eps``
    defaults to a tenth of ``share``.

    Summaries of partitions are merged by adding counts and deltas; a value that a partition did
    not keep may have had that partition's bound. Memory of a task: 1/eps * log(eps * rows) entries
    and one batch, whatever the number of distinct values.

    Defined results: nulls count as rows, never as values; the empty string is a value; an empty
    table gives no rows; ties are all reported.
    """
    parts = summaries(df, fields, eps or share / 10)
    merged = cut(
        parts.groupBy("field", "value").agg(
            F.sum("count").alias("count"), F.sum("slack").alias("slack"), F.sum("rows").alias("rows"),
            F.sum("bound").alias("bound"),
        )
    )
    totals = merged.where(F.col("value").isNull()).select(
        "field", F.col("rows").alias("n_rows"), F.col("bound").alias("all_bound")
    )
    counted = merged.where(F.col("value").isNotNull()).select("field", "value", "count", "slack")
    found = counted.join(F.broadcast(totals), "field")  # one row per field
    at_most = F.col("count") + F.col("all_bound") - F.col("slack")
    return found.where((at_most >= F.col("n_rows") * F.lit(share)) & (F.col("count") > 0)).select(
        "field", "value", F.col("count").alias("at_least"), at_most.alias("at_most"), "n_rows"
    )
