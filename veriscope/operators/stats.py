"""Resampling tests from a counter-based random source.

The k-th draw of replicate b is a fixed mix of (seed, b, k) modulo the prime
2**31 - 1, so results depend on neither engine nor partitioning, and any engine
with 64-bit integers gives the same.  A series is a set of rows (keys,
question_id, value); all series are resampled in one plan: values lie in blocks
of bounded size, a task draws some replicates of a series and sums what falls
into its block, and only sums move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

REPLICATES = 5000
#: Values of a block, draws that are made at once, and tasks at most that a block's replicates are dealt to.
BLOCK, DRAWS, TASKS = 1 << 20, 1 << 16, 64
PRIME = (1 << 31) - 1


def _fold(v: np.ndarray) -> np.ndarray:
    """``v`` in place, congruent modulo :data:`PRIME`, and below 2**33 if it was below 2**63."""
    high = v >> 31
    v &= PRIME
    v += high
    return v


def draw(seed: int, b: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th draw, below 2**31 - 1, of replicate b; :data:`DRAW_SQL` is the same in SQL.

    Values between are congruent to the SQL's and small enough for the next
    step; the last one alone is brought below the prime.
    """
    x = (seed * 1000003 + b * 48271 + 1) % PRIME
    y = _fold(_fold(x * 16807 + (k * 69621 + 7)))  # below 2**31 + 1
    z = y * y
    z += x
    _fold(_fold(z))
    y += z * 48271
    u = _fold(_fold(y))
    v = u * u
    v += z
    _fold(_fold(v))
    v *= 69621
    v += u
    _fold(_fold(v))
    v[v >= PRIME] -= PRIME
    return v


#: Select items that end in ``drawn``, the draw of a row's ``b`` and ``k``.
DRAW_SQL = (
    "({seed} * 1000003 + b * 48271 + 1) % 2147483647 AS dx, (dx * 16807 + k * 69621 + 7) % 2147483647 AS dy, (dy * dy + dx) % 2147483647 AS dz, "
    "(dz * 48271 + dy) % 2147483647 AS du, (du * du + dz) % 2147483647 AS dv, (dv * 69621 + du) % 2147483647 AS drawn"
)


def _indexed(series: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``series`` with its place ``j`` from 0 and the number ``n`` of its values."""
    rows = series.where("value is not null")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return rows.withColumn("j", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).join(sizes, keys)


def _sums(series: DataFrame, keys: list[str], replicates: int, seed: int, order: str, flips: bool) -> DataFrame:
    """(keys, b, m): the mean of each resample, or with ``flips`` of the values under random signs."""
    rows = _indexed(series, keys, order)
    block = F.floor(F.col("j") / BLOCK)
    values = F.transform(F.array_sort(F.collect_list(F.struct("j", "value"))), lambda x: x["value"].cast("double"))
    blocks = rows.groupBy(*keys, "n", block.alias("block")).agg(values.alias("v"))
    # replicates of a series are dealt in runs of about as many draws each
    run = F.least(F.lit(replicates), F.greatest(F.floor(F.lit(64 * DRAWS) / F.col("n")), F.lit(-(-replicates // TASKS)))).cast("int")
    work = blocks.withColumn("run", run).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.col("run"))))
    work = work.repartition(*keys, "block", "first")
    schema = StructType([*(rows.schema[k] for k in keys), StructField("b", LongType()), StructField("n", LongType()), StructField("s", DoubleType())])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, at, first, size = (batch.column(c)[i].as_py() for c in ("n", "block", "first", "run"))
                v = batch.column("v")[i].values.to_numpy(zero_copy_only=False)
                b, out = np.arange(first, min(first + size, replicates)), []
                wide = max(1, DRAWS // max(1, len(v) if flips else n))
                for lo in range(0, len(b), wide):
                    some = b[lo : lo + wide, None]
                    if flips:
                        sign = 1 - 2 * (draw(seed, some, np.arange(at * BLOCK, at * BLOCK + len(v))[None]) % 2)
                        out.append((sign * v[None]).sum(axis=1))
                        continue
                    total = np.zeros(len(some))
                    for k in range(0, n, DRAWS):
                        j = draw(seed, some, np.arange(k, min(k + DRAWS, n))[None])
                        j -= j // n * n  # NumPy divides by one number faster than it takes remainders
                        j -= at * BLOCK
                        if n > BLOCK:
                            inside = (j >= 0) & (j < len(v))
                            total += np.where(inside, v[np.where(inside, j, 0)], 0.0).sum(axis=1)
                        else:
                            total += v[j].sum(axis=1)
                    out.append(total)
                cols = [pa.repeat(batch.column(c)[i], len(b)) for c in keys]
                cols += [pa.array(b, pa.int64()), pa.array(np.full(len(b), n)), pa.array(np.concatenate(out))]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "b", "n", "s"])

    made = work.mapInArrow(sums, schema)
    return made.groupBy(*keys, "b", "n").agg(F.sum("s").alias("s")).select(*keys, "b", (F.col("s") / F.col("n")).alias("m"))


def bootstrap_means(series: DataFrame, keys: list[str], replicates: int = REPLICATES, seed: int = 42, order: str = "question_id") -> DataFrame:
    """(keys, b, m): the mean of each resample."""
    return _sums(series, keys, replicates, seed, order, flips=False)


def interval(means: DataFrame, keys: list[str], replicates: int, alpha: float = 0.05) -> DataFrame:
    """(keys, ci_low, ci_high): percentiles of the resamples' means by place."""
    low, high = int(alpha / 2 * replicates), min(replicates - 1, int((1 - alpha / 2) * replicates))
    placed = means.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("m")) - 1)
    return placed.groupBy(*keys).agg(F.max(F.when(F.col("r") == low, F.col("m"))).alias("ci_low"), F.max(F.when(F.col("r") == high, F.col("m"))).alias("ci_high"))


def bootstrap_ci(series: DataFrame, keys: list[str], replicates: int = REPLICATES, seed: int = 42, order: str = "question_id") -> DataFrame:
    """(keys, mean, ci_low, ci_high, n); one value is its own interval, none gives no row."""
    plain = series.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("value").alias("n")).where("n > 0")
    bounds = interval(bootstrap_means(series, keys, replicates, seed, order), keys, replicates)
    return plain.join(bounds, keys).select(*keys, "mean", "ci_low", "ci_high", "n")


def pair(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, question_id, a, b) of questions for which both have a value."""
    left, right = a.select(*keys, "question_id", F.col("value").alias("a")), b.select(*keys, "question_id", F.col("value").alias("b"))
    return left.join(right, [*keys, "question_id"]).where("a is not null and b is not null")


def dropped(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, only_a, only_b): questions that one of both has alone."""
    left = a.where("value is not null").select(*keys, "question_id", F.lit(True).alias("a"))
    right = b.where("value is not null").select(*keys, "question_id", F.lit(True).alias("b"))
    both = left.join(right, [*keys, "question_id"], "full_outer")
    return both.groupBy(*keys).agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def paired_bootstrap(pairs: DataFrame, keys: list[str], replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Means, delta with interval, sign-flip permutation p (never 0), and counts of pairs better, worse and tied."""
    deltas = pairs.select(*keys, "question_id", (F.col("b") - F.col("a")).alias("value"))
    plain = pairs.groupBy(*keys).agg(
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("b") - F.col("a")).alias("delta"), F.count("*").alias("n_pairs"),
        F.count_if(F.col("b") > F.col("a")).alias("n_better"), F.count_if(F.col("b") < F.col("a")).alias("n_worse"), F.count_if(F.col("b") == F.col("a")).alias("n_tied"),
    )
    bounds = interval(bootstrap_means(deltas, keys, replicates, seed), keys, replicates)
    flipped = _sums(deltas, keys, replicates, seed + 1, "question_id", flips=True).join(plain.select(*keys, "delta"), keys)
    extreme = flipped.groupBy(*keys).agg(F.count_if(F.abs("m") >= F.abs("delta") - 1e-12).alias("extreme"))
    out = plain.join(bounds, keys).join(extreme, keys).withColumn("p_value", (F.col("extreme") + 1) / F.lit(replicates + 1)).drop("extreme")
    significant = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    return out.select(*out.columns, significant.alias("significant"), (significant != (F.col("p_value") < 0.05)).alias("borderline"))


def _binomial_tail(k: Column, n: Column) -> Column:
    """Sum of C(n, i) / 2**n for i up to k, in logarithms so that no n is too large."""
    start = F.struct((-n * math.log(2)).cast("double").alias("log"), F.exp(-n * math.log(2)).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add)["sum"]


def mcnemar(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, b_wins, a_wins, p_value), exact two-sided; only series whose values are all 0 or 1."""
    binary = F.bool_and(F.col("a").isin(0.0, 1.0) & F.col("b").isin(0.0, 1.0))
    counts = pairs.groupBy(*keys).agg(F.count_if(F.col("b") > F.col("a")).alias("b_wins"), F.count_if(F.col("a") > F.col("b")).alias("a_wins"), binary.alias("binary"))
    p = F.least(F.lit(1.0), 2 * _binomial_tail(F.least("a_wins", "b_wins"), F.col("a_wins") + F.col("b_wins")))
    return counts.where("binary").select(*keys, "b_wins", "a_wins", F.when(F.col("a_wins") + F.col("b_wins") == 0, 1.0).otherwise(p).alias("p_value"))


def cohen_kappa(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, agreement, kappa) of ratings (keys, a, b), rounded half to even; kappa is null where chance agrees always."""
    cells = ratings.where("a is not null and b is not null").groupBy(*keys, F.bround("a").alias("a"), F.bround("b").alias("b")).agg(F.count("*").alias("n"))
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    of_a = cells.groupBy(*keys, F.col("a").alias("c")).agg(F.sum("n").alias("na"))
    of_b = cells.groupBy(*keys, F.col("b").alias("c")).agg(F.sum("n").alias("nb"))
    chance = of_a.join(of_b, [*keys, "c"]).groupBy(*keys).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("chance"))
    out = total.join(chance, keys, "left").select(*keys, "n", (F.col("same") / F.col("n")).alias("agreement"), (F.coalesce("chance", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))).alias("expected"))
    return out.select(*keys, "n", "agreement", F.when(F.col("expected") < 1, (F.col("agreement") - F.col("expected")) / (1 - F.col("expected"))).alias("kappa"))


def kappa_band(kappa: Column) -> Column:
    return F.when(kappa.isNull() | F.isnan(kappa), "undefined").when(kappa < 0.4, "weak").when(kappa < 0.6, "moderate").when(kappa < 0.8, "substantial").otherwise("excellent")


def required_n(effect: Column, baseline: float = 0.5, power: float = 0.8) -> Column:
    z = 1.96 + (0.84 if power <= 0.8 else 1.28)
    return F.ceil(2 * baseline * (1 - baseline) * F.pow(F.lit(z) / effect, F.lit(2.0)))


def holm(tests: DataFrame, p: str = "p_value", family: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """``tests`` with ``p_holm``; a family is one window, as small as the number of its tests."""
    by = Window.partitionBy(*(family or [F.lit(0)]))
    order = by.orderBy(F.col(p), *(ties or []))
    raw = F.least(F.lit(1.0), (F.count("*").over(by) - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("__raw", raw).withColumn("p_holm", F.max("__raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__raw")


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
