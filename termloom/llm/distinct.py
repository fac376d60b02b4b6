"""Distinct counts over huge identifier sets (problem 7): registers to a logarithmic base.

A set is ``m`` registers. The hash of an element picks a register and a uniform number u; the
register keeps the largest k = ceil(-log_b(u)). Registers merge by maximum, so partial results of
any rows or days can be merged. Given the expected number x of elements per register,
P(K <= k) = exp(-x * b**-k); estimates maximise this likelihood, for single sets and jointly
for pairs. Registers are rows (group, register, k): a small set costs as many rows as elements.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

M = 4096
BASE = 1.1
HASH_BITS = 64


def relative_error(m: int = M, base: float = BASE) -> float:
    """Standard error of a count relative to it, for sets much larger than ``m``.

    1/sqrt(m) times the loss of information by rounding to powers of ``base``.
    """
    x = np.exp(np.linspace(-12, 12, 4001))  # x * b**-k over many registers, integrated in log x
    d = x * (base - 1)
    p = np.exp(-x) * -np.expm1(-d)
    score = -x + d * np.exp(-d) / -np.expm1(-d)
    information = np.trapezoid(p * score**2, np.log(x)) / math.log(base)
    return float(1 / math.sqrt(m * information))


def register(element: Column, m: int = M) -> Column:
    """Register of an element."""
    return F.xxhash64(element).bitwiseAND(m - 1).cast("smallint")


def level(element: Column, m: int = M, base: float = BASE) -> Column:
    """k of an element: at least 1, at most about 64 * ln 2 / ln b."""
    bits = HASH_BITS - int(math.log2(m))
    u = (F.shiftrightunsigned(F.xxhash64(element), int(math.log2(m))).cast("double") + 0.5) / float(2**bits)
    return F.ceil(-F.log(u) / math.log(base)).cast("smallint")


def sketch(df: DataFrame, keys: Sequence[str | Column], element: str, m: int = M, base: float = BASE) -> DataFrame:
    """Registers of the set of ``element`` per group: (keys, _reg, _k). Null elements do not count."""
    if m & (m - 1) or m > 32768:
        raise ValueError("m must be a power of two up to 32768")
    rows = df.where(F.col(element).isNotNull())
    return rows.groupBy(*keys, register(F.col(element), m).alias("_reg")).agg(
        F.max(level(F.col(element), m, base)).alias("_k")
    )


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of the unions, group by group."""
    both = sketches[0]
    for s in sketches[1:]:
        both = both.unionByName(s)
    return both.groupBy(*[c for c in both.columns if c != "_k"]).agg(F.max("_k").alias("_k"))


def solve_counts(k: np.ndarray, c: np.ndarray, starts: np.ndarray, m: int, base: float) -> np.ndarray:
    """Maximum-likelihood sizes of many sets from the histograms of their non-empty registers.

    ``k`` and ``c`` hold the levels and their counts, group after group from ``starts`` on.
    """
    if not len(starts):
        return np.zeros(0)
    step = np.power(base, -k.astype(float))
    lengths = np.diff(np.append(starts, len(k)))
    group = np.repeat(np.arange(len(starts)), lengths)
    full = np.add.reduceat(c, starts)
    empty = m - full
    low, high = np.full(len(starts), math.log(1e-9)), np.full(len(starts), math.log(2.0**64))
    for _ in range(60):
        middle = (low + high) / 2
        x = np.exp(middle)[group] * step
        d = np.minimum(x * (base - 1), 700)
        slope = np.add.reduceat(c * step * ((base - 1) / np.expm1(np.maximum(d, 1e-300)) - 1), starts) - empty
        low, high = np.where(slope > 0, middle, low), np.where(slope > 0, high, middle)
    return np.exp((low + high) / 2) * m


def histograms(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels and their counts, set after set, and where each set starts."""
    levels = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(np.asarray(lists.offsets))
    cells = np.repeat(np.arange(len(lengths)), lengths) << 16 | levels
    cells, counts = np.unique(cells, return_counts=True)
    return cells & 0xFFFF, counts.astype(float), np.searchsorted(cells, np.arange(len(lengths)) << 16)


def estimates(registers: DataFrame, keys: Sequence[str], m: int = M, base: float = BASE) -> DataFrame:
    """(keys, n_distinct): the maximum-likelihood size of every group's set."""
    # a list has at most m levels
    lists = registers.groupBy(*keys).agg(F.collect_list("_k").alias("_h"))
    fields = [f for f in lists.schema.fields if f.name != "_h"]
    out = T.StructType([*fields, T.StructField("n_distinct", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = solve_counts(*histograms(batch.column(len(fields))), m, base)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(sizes)], schema=schema)

    return lists.select(*[f.name for f in fields], "_h").mapInArrow(run, out)


def all_combinations(
    df: DataFrame, keys: Sequence[str], element: str, m: int = M, base: float = BASE
) -> DataFrame:
    """Distinct elements for every combination of ``keys``, the empty one included.

    ``level`` names the keys that are fixed, joined by ``+`` (``all`` if none); the others are
    null. A null key is a group of its own at the levels that fix it. Rows are collapsed to
    registers once, at the finest level; coarser levels merge registers, never rows. A hot group
    has at most ``m`` registers after the map-side maximum, so no task holds more than that of it.

    The true count lies within 2 * ``relative_error(m, base)`` of ``n_distinct`` with a probability
    of 95 percent; ``rel_error`` states the standard error. An empty table gives no rows.
    """
    finest = sketch(df, keys, element, m, base)
    error = F.lit(relative_error(m, base)).alias("rel_error")
    sized = estimates(finest, keys, m, base).select(F.lit("+".join(keys)).alias("level"), *keys, "n_distinct", error)
    sets = [s for n in range(len(keys) - 1, -1, -1) for s in combinations(keys, n)]
    merged = (
        finest.groupingSets([[*s, "_reg"] for s in sets], *keys, "_reg")
        .agg(F.max("_k").alias("_k"), F.grouping_id().alias("_gid"))
    )
    # grouping_id has a bit per grouping column, the first highest; _reg is never grouped away
    names = {
        sum(1 << (len(keys) - i) for i, k in enumerate(keys) if k not in s): "+".join(s) or "all" for s in sets
    }
    label = F.lit(None).cast("string")
    for gid, name in names.items():
        label = F.when(F.col("_gid") == gid, F.lit(name)).otherwise(label)
    coarser = estimates(merged, ["_gid", *keys], m, base)
    return sized.unionByName(coarser.select(label.alias("level"), *keys, "n_distinct", error))


def log_likelihoods(ka: np.ndarray, kb: np.ndarray, c: np.ndarray, starts: np.ndarray, rates: np.ndarray, base: float) -> np.ndarray:
    """Log likelihood of the registers of many pairs of sets, given the rates (only a, only b, both) of each.

    A rate is elements per register. ``ka``, ``kb`` and ``c`` hold the pairs of levels (0: empty register) and
    their counts, pair after pair from ``starts`` on.
    """
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(c))))
    ra, rb, x = np.maximum(rates, 0.0)[:, group]

    def interval(rate: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log P(k is the largest level) of a set with ``rate`` elements per register."""
        upper = -rate * np.power(base, -k.astype(float))
        d = np.minimum(-upper * (base - 1), 700)
        return upper + np.where(k == 0, 0.0, np.log(np.maximum(-np.expm1(-d), 1e-300)))

    low = np.minimum(ka, kb)
    apart = np.where(ka < kb, interval(ra + x, ka) + interval(rb, kb), interval(ra, ka) + interval(rb + x, kb))
    r = np.power(base, -low.astype(float))
    s = r * base
    whole = np.exp(-(ra + rb + x) * r)
    tied = np.where(
        low == 0,
        whole,
        whole - np.exp(-(ra + x) * s - rb * r) - np.exp(-ra * r - (rb + x) * s) + np.exp(-(ra + rb + x) * s),
    )
    each = np.where(ka == kb, np.log(np.maximum(tied, 1e-300)), apart)
    return np.add.reduceat(c * each, starts)


def joint_rates(
    ka: np.ndarray, kb: np.ndarray, c: np.ndarray, starts: np.ndarray, na: np.ndarray, nb: np.ndarray, m: int, base: float
) -> tuple[np.ndarray, np.ndarray]:
    """Rates (only a, only b, both) of many pairs that maximise the likelihood together, and their covariances.

    Starts from the best overlap for the sizes ``na`` and ``nb`` of the sets alone; Newton steps then change all three
    rates at once, as long as the likelihood grows. The covariance is the inverse of the observed information.
    """
    a, b = na / m, nb / m
    value = lambda rates: log_likelihoods(ka, kb, c, starts, rates, base)
    split = lambda x: np.stack((a - x, b - x, x))
    low, high = np.zeros(len(starts)), np.minimum(a, b)
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(30):
        left, right = high - golden * (high - low), low + golden * (high - low)
        better = value(split(left)) > value(split(right))
        low, high = np.where(better, low, left), np.where(better, right, high)
    rates = np.maximum(split((low + high) / 2), 0.0)
    for _ in range(4):
        slope, curve = derivatives(value, rates)
        step = np.zeros_like(rates)
        for g in range(rates.shape[1]):
            step[:, g] = -np.linalg.lstsq(curve[:, :, g], slope[:, g], rcond=1e-10)[0]
        now, scale = value(rates), 1.0
        for _ in range(4):
            moved = np.maximum(rates + scale * step, 0.0)
            gained = value(moved) > now
            rates, now = np.where(gained, moved, rates), np.where(gained, value(moved), now)
            step = np.where(gained, 0.0, step)
            scale /= 4
    _, curve = derivatives(value, rates)
    covariance = np.stack([np.linalg.pinv(-curve[:, :, g], rcond=1e-10) for g in range(rates.shape[1])], 2) if len(starts) else np.zeros((3, 3, 0))
    return rates, covariance


def derivatives(value, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Gradients and Hessians of functions of three rates, by differences around points kept off the border."""
    h = np.maximum(1e-3 * rates, 1e-6 + 1e-4 * rates.sum(0))
    at = np.maximum(rates, h)
    unit = [h * (np.arange(3) == i)[:, None] for i in range(3)]
    here, up, down = value(at), [value(at + u) for u in unit], [value(at - u) for u in unit]
    slope = np.stack([(up[i] - down[i]) / (2 * h[i]) for i in range(3)])
    curve = np.zeros((3, 3, rates.shape[1]))
    for i in range(3):
        curve[i, i] = (up[i] - 2 * here + down[i]) / h[i] ** 2
        for j in range(i):
            both = value(at + unit[i] + unit[j]) + value(at - unit[i] - unit[j]) - value(at + unit[i] - unit[j]) - value(at - unit[i] + unit[j])
            curve[i, j] = curve[j, i] = both / (4 * h[i] * h[j])
    return slope, curve


_PAIR_OUT = [(n, T.DoubleType()) for n in ("n_a", "n_b", "n_both", "n_union", "jaccard", "both_error", "union_error", "jaccard_error")]


def pair_estimates(pairs: DataFrame, keys: Sequence[str], m: int = M, base: float = BASE) -> DataFrame:
    """Joint estimates from registers of pairs: (keys, _reg, _ka, _kb), 0 where a set has none.

    Sizes, intersection, union and Jaccard similarity come from the three rates that together make the registers
    likeliest; the errors are standard errors of each row's own values, from the information matrix.
    """
    cells = pairs.groupBy(*keys, "_ka", "_kb").agg(F.count(F.lit(1)).alias("_c"))
    # at most m entries per pair
    lists = cells.groupBy(*keys).agg(F.collect_list(F.struct("_ka", "_kb", "_c")).alias("_h"))
    fields = [f for f in lists.schema.fields if f.name != "_h"]
    out = T.StructType([*fields, *[T.StructField(n, t) for n, t in _PAIR_OUT]])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, n_keys = to_arrow_schema(out), len(fields)

    def marginal(k: np.ndarray, c: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return solve_counts(k, np.where(k > 0, c, 0.0), starts, m, base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(n_keys)
            flat = lists.flatten()
            ka, kb, c = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            c = c.astype(float)
            starts = np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(c))))
            empty = m - np.add.reduceat(c, starts)  # registers empty in both sets
            ka, kb, c = (np.append(x, y) for x, y in ((ka, 0 * empty), (kb, 0 * empty), (c, empty)))
            order = np.argsort(np.append(group, np.arange(len(starts))), kind="stable")
            ka, kb, c = ka[order].astype(np.int64), kb[order].astype(np.int64), c[order]
            starts = starts + np.arange(len(starts))
            rates, cov = joint_rates(ka, kb, c, starts, marginal(ka, c, starts), marginal(kb, c, starts), m, base)
            only_a, only_b, both = rates * m
            union = only_a + only_b + both
            jaccard = both / np.maximum(union, 1e-9)
            error = lambda w: np.sqrt(np.maximum(np.einsum("ig,ijg,jg->g", w, cov, w), 0.0)) * m  # noqa: B023, E731
            one, zero = np.ones(len(starts)), np.zeros(len(starts))
            slope = np.stack((-jaccard, -jaccard, 1 - jaccard)) / np.maximum(union, 1e-9)
            numbers = [only_a + both, only_b + both, both, union, jaccard, error(np.stack((zero, zero, one))), error(np.stack((one, one, one))), error(slope)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *[pa.array(x) for x in numbers]], schema=schema)

    return lists.select(*[f.name for f in fields], "_h").mapInArrow(run, out)


def overlaps(registers: DataFrame, key: str, pairs: DataFrame, m: int = M, base: float = BASE) -> DataFrame:
    """Union, intersection and Jaccard similarity of the sets of any pairs of groups, jointly estimated.

    ``registers`` is a sketch by ``key``; ``pairs`` has the columns ``a`` and ``b`` with keys. A key without elements
    is an empty set; null keys name no group. A set's at most ``m`` registers go to each pair it is in.
    """
    asked = pairs.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    none = F.lit(0).cast("smallint")
    sides = [
        asked.join(registers.select(F.col(key).alias(side), "_reg", "_k"), side).select(
            "a", "b", "_reg", F.col("_k").alias("_ka") if side == "a" else none.alias("_ka"), F.col("_k").alias("_kb") if side == "b" else none.alias("_kb")
        )
        for side in ("a", "b")
    ]
    both = sides[0].unionByName(sides[1]).groupBy("a", "b", "_reg").agg(F.max("_ka").alias("_ka"), F.max("_kb").alias("_kb"))
    return pair_estimates(both, ["a", "b"], m, base)


def day_overlaps(df: DataFrame, day: Column, element: str, m: int = M, base: float = BASE) -> DataFrame:
    """Union, intersection and Jaccard similarity of each day's set with the next day's.

    One row per day that has elements or whose next day has; rows without a day do not count.
    """
    days = sketch(df.select(day.alias("_day"), F.col(element).alias("_e")).where("_day IS NOT NULL"), ["_day"], "_e", m, base)
    known = days.select("_day").distinct()
    pairs = known.select(F.col("_day").alias("a")).union(known.select(F.date_sub("_day", 1).alias("a"))).distinct().withColumn("b", F.date_add("a", 1))
    return overlaps(days, "_day", pairs, m, base).drop("b").withColumnRenamed("a", "day")
