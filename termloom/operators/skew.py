"""Per-key results when a few keys hold most rows (problem 4).

Fragment and replicate by estimated load. Loads are counted over all rows, first of a fixed number of
key buckets, then of the keys in the buckets that are too heavy for their task. Keys that are heavy by
themselves are split into shards proportionate to their load, and the matching side of such a key goes to
all of its shards; all other keys stay whole, and their matching side goes to one task. Shards and
buckets are packed onto tasks, largest first. At most ``tasks / SHARD_PART`` keys can be heavy, so the plan's
broadcast has a bound, however many keys there are.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.util import parallelism

#: Buckets of keys whose loads are counted; one is about 16 bytes when broadcast.
BUCKETS = 8192
#: A shard holds at most this part of a task's fair share, so that packing can even out.
SHARD_PART = 0.5

PLAN_SCHEMA = T.StructType(
    [T.StructField("_route", T.LongType()), T.StructField("_tasks", T.ArrayType(T.IntegerType())), T.StructField("_split", T.BooleanType())]
)


@dataclass(frozen=True)
class LoadPlan:
    """Where keys go: ``table`` has the tasks of every heavy key and of every bucket of the others."""

    table: DataFrame
    keys: tuple[str, ...]
    buckets: int
    tasks: int
    rows: int
    loads: tuple[int, ...]
    heavy: tuple[int, ...]


def key_hash(keys: Sequence[str]) -> Column:
    """Hash that names a key; null parts are told apart from empty ones."""
    return F.xxhash64(*[x for k in keys for x in (F.col(k).isNull(), F.col(k))])


def _bucket(name: Column, buckets: int) -> Column:
    return F.pmod(name, F.lit(buckets))


def _route(name: Column, plan: LoadPlan) -> Column:
    """The entry of the plan that a key belongs to: its own, or that of its bucket."""
    bucket = _bucket(name, plan.buckets)
    return F.when(name.isin(list(plan.heavy)), name).otherwise(bucket) if plan.heavy else bucket


def pack(loads: dict[int, int], tasks: int, part: float = SHARD_PART) -> tuple[dict[int, list[int]], list[int]]:
    """Tasks of every bucket's shards, and the load of each task.

    Largest shard first onto the least loaded task. ``loads`` maps a bucket to its rows.
    """
    total = sum(loads.values())
    most = max(1.0, total / max(tasks, 1) * part)
    shards = sorted(
        ((load / n, b, n) for b, load in loads.items() for n in [max(1, math.ceil(load / most))]),
        key=lambda x: (-x[0], x[1]),
    )
    heap = [(0.0, t) for t in range(tasks)]
    where: dict[int, list[int]] = {}
    for size, bucket, n in shards:
        for _ in range(n):
            load, task = heapq.heappop(heap)
            where.setdefault(bucket, []).append(task)
            heapq.heappush(heap, (load + size, task))
    packed = [0] * tasks
    for load, task in heap:
        packed[task] = round(load)
    return where, packed


def plan_loads(df: DataFrame, keys: Sequence[str], tasks: int | None = None, buckets: int = BUCKETS, part: float = SHARD_PART) -> LoadPlan:
    """Count loads over all rows and pack them onto tasks.

    The counts are combined before the shuffle; at most ``buckets`` and then ``tasks / part`` of them reach
    the driver. The second count, of keys, reads the rows of buckets heavier than a shard only, and there
    is none where no bucket is. Two heavy keys with one 64-bit hash would share their shards, which
    costs copies and changes no result. An empty ``df`` gives an empty plan.
    """
    tasks = tasks or parallelism(df.sparkSession)
    buckets = max(buckets, 16 * tasks)
    named = df.select(key_hash(keys).alias("_name"))
    counted = named.groupBy(_bucket(F.col("_name"), buckets).alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    loads = {r["_bucket"]: r["n"] for r in counted.collect()}
    total = sum(loads.values())
    most = max(1.0, total / tasks * part)
    hot = [b for b, n in loads.items() if n > most]
    heavy: dict[int, int] = {}
    if hot:
        inside = named.where(_bucket(F.col("_name"), buckets).isin(hot)).groupBy("_name").agg(F.count(F.lit(1)).alias("n"))
        heavy = {r["_name"]: r["n"] for r in inside.where(F.col("n") > most).collect()}
        for name, n in heavy.items():
            loads[name % buckets] -= n
    heavy = {k: n for k, n in heavy.items() if not 0 <= k < buckets}  # never taken for a bucket
    where, packed = pack({**loads, **heavy}, tasks, part)
    rows = [(k, t, k in heavy) for k, t in sorted(where.items())]
    table = df.sparkSession.createDataFrame(rows, PLAN_SCHEMA)
    return LoadPlan(table, tuple(keys), buckets, tasks, total, tuple(packed), tuple(heavy))


def _routed(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """``df`` with the tasks of its keys; a bucket with several has each key on one of them."""
    tagged = df.withColumn("_name", key_hash(plan.keys))
    routed = tagged.withColumn("_route", _route(F.col("_name"), plan)).join(F.broadcast(plan.table), "_route")  # bounded
    own = F.slice("_tasks", (F.pmod(F.xxhash64(F.lit(1), "_name"), F.size("_tasks")) + 1).cast("int"), F.lit(1))
    return routed.withColumn("_tasks", F.when(F.col("_split"), F.col("_tasks")).otherwise(own)).drop("_name", "_route", "_split")


def fragment(df: DataFrame, plan: LoadPlan, by: Column | None = None) -> DataFrame:
    """``df`` with ``_task``, each row on the task of its shard.

    ``by`` decides the shard of a heavy key; rows alike in ``by`` stay together. Without it the
    rows go round its shards by their position in the input partition.
    """
    spread = F.monotonically_increasing_id() if by is None else F.xxhash64(by)
    routed = _routed(df.withColumn("_spread", spread), plan)
    task = F.element_at("_tasks", (F.pmod("_spread", F.size("_tasks")) + 1).cast("int"))
    return routed.withColumn("_task", task).drop("_tasks", "_spread").repartitionById(plan.tasks, F.col("_task"))


def replicate(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """The matching side: once for every task that holds a shard of a heavy key, once for any other key."""
    copies = _routed(df, plan).withColumn("_task", F.explode(F.array_distinct("_tasks"))).drop("_tasks")
    return copies.repartitionById(plan.tasks, F.col("_task"))


def balanced_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partial: Sequence[Column],
    final: Sequence[Column],
    by: Column | None = None,
    match: DataFrame | None = None,
    tasks: int | None = None,
    buckets: int = BUCKETS,
    plan: LoadPlan | None = None,
) -> DataFrame:
    """Per-key aggregates without a task that holds a hot key alone.

    ``partial`` is computed per key and task after joining ``match`` (inner, on ``keys``, nulls
    equal) where given; ``final`` combines the partial columns per key. ``by`` keeps rows that
    must meet, such as equal values of an exact distinct count, in one shard.

    Defined results: null key parts are keys of their own; an empty table gives no rows; repeated
    rows count each time; columns of ``df`` other than those used are carried nowhere. A column
    of ``df`` named ``_task``, ``_tasks``, ``_name``, ``_route``, ``_split`` or ``_spread`` must be dropped before.
    """
    plan = plan or plan_loads(df, keys, tasks, buckets)
    rows = fragment(df, plan, by)
    if match is not None:
        other = replicate(match, plan)
        renamed = other.select(
            F.col("_task").alias("_m_task"),
            *[F.col(k).alias(f"_m_{k}") for k in keys],
            *[F.col(c) for c in other.columns if c not in keys and c != "_task"],
        )
        same = F.col("_task") == F.col("_m_task")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_m_{k}"))
        rows = rows.join(renamed, same)
    shards = rows.groupBy("_task", *keys).agg(*partial)
    return shards.groupBy(*keys).agg(*final)


def key_shares(statements: DataFrame, tasks: int | None = None) -> DataFrame:
    """For every (graph, predicate): rows, first and last emission, share of all rows.

    ``graph`` is the empty string for the default graph.
    """
    slim = statements.select(F.coalesce("graph", F.lit("")).alias("graph"), "predicate", "emitted_at")
    plan = plan_loads(slim, ["graph", "predicate"], tasks)
    result = balanced_aggregate(
        slim,
        ["graph", "predicate"],
        [
            F.count(F.lit(1)).alias("rows"),
            F.min("emitted_at").alias("first_at"),
            F.max("emitted_at").alias("last_at"),
        ],
        [
            F.sum("rows").alias("n_rows"),
            F.min("first_at").alias("first_emitted"),
            F.max("last_at").alias("last_emitted"),
        ],
        plan=plan,
    )
    return result.withColumn("share", F.col("n_rows") / F.lit(max(plan.rows, 1)).cast("double"))


def heavy_keys(statements: DataFrame, share: float = 0.02, tasks: int | None = None) -> DataFrame:
    """Keys holding at least ``share`` of all rows, by :func:`key_shares`. ``predicate`` may be null."""
    return key_shares(statements, tasks).where(F.col("share") >= share).select("graph", "predicate")


def late_rows_per_key(statements: DataFrame, days: int = 7, tasks: int | None = None) -> DataFrame:
    """Per (graph, predicate): rows emitted more than ``days`` after the key's first, and their mean lag.

    Every row is matched with its key's first emission, so hot keys go through the fragment and
    replicate join. Rows without ``emitted_at`` count in ``n_rows`` only.
    """
    slim = statements.select(F.coalesce("graph", F.lit("")).alias("graph"), "predicate", "emitted_at")
    plan = plan_loads(slim, ["graph", "predicate"], tasks)
    first = slim.groupBy("graph", "predicate").agg(F.min("emitted_at").alias("first_at"))
    lag = F.unix_micros(F.col("emitted_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))
    late = lag > days * 86_400_000_000
    return balanced_aggregate(
        slim,
        ["graph", "predicate"],
        [F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late"), F.sum(F.when(late, lag)).alias("lag")],
        [
            F.sum("rows").alias("n_rows"),
            F.sum("late").alias("late_rows"),
            F.sum("lag").cast("bigint").alias("late_lag_us"),
        ],
        match=first,
        plan=plan,
    )
