"""Exact top-k inner products, pruned by segment means and deviations.

A vector is cut into 1, 4, 16, ... segments, down to two components each; of
each segment its mean and deviation are kept.  For two vectors, segment by
segment, ``len * (mean * mean + dev * dev)`` bounds the inner product from
above, which bounds their squared distance ``|q|^2 + |v|^2 - 2 q.v`` from
below.  From coarse to fine, pairs whose bound cannot reach the query's k-th
best so far drop out; only survivors are computed.

Every query starts with the k-th best of a sample of rows of bounded size.
Queries and candidates then meet in blocks: a block of queries is sent to
every strip of candidate blocks, and a strip hands its k best a query to the
merge.  Task memory depends on block sizes alone.

Components are whole numbers of 64 bits.  Scores are exact at any size: where
doubles could round, they only choose whom to compute in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialise, runs

K, SCALE = 20, 64.0
#: Rows of a block of queries and those compared at once; of a block of candidates; blocks of a strip; of the sample.
QUERY_BLOCK, QUERY_ROWS, ROW_BLOCK, STRIP_BLOCKS, SAMPLE = 8192, 1024, 4096, 16, 2048
#: A share of survivors below which they are computed one by one; pairs after which a level that drops none is left out.
SPARSE, TRIED = 0.1, 1 << 20
_LIMB = 42


def quantised(vector: str, scale: float) -> Column:
    """floor(scale * component) as longs (the nearest long beyond their range), or null if a component is null or not finite."""
    x = column(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(F.lit(scale) * v)))


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(block, g, dim, ids, marks, data): rows (g, id, mark, x) of one g and length, packed where they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, marks = batch.column("id").to_numpy(), batch.column("mark").to_numpy()
            dims = np.array([len(v) for v in batch.column("x")], dtype=np.int64)
            flat = batch.column("x").flatten().to_numpy()
            begin = np.append(0, np.cumsum(dims))
            g = batch.column("g").to_numpy()
            for group, dim in np.unique(np.stack([g, dims], axis=1), axis=0):
                mine = np.flatnonzero((dims == dim) & (g == group))
                for k in range(0, len(mine), block):
                    pick = mine[k : k + block]
                    data = flat[begin[pick][:, None] + np.arange(dim)] if dim else np.zeros((len(pick), 0))
                    cols = [[(part << 32) + n], [int(group)], [int(dim)], [ids[pick].astype(np.int64).tobytes()], [marks[pick].astype(np.int64).tobytes()], [data.astype(np.int64).tobytes()]]
                    n += 1
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["block", "g", "dim", "ids", "marks", "data"])

    return rows.mapInArrow(run, "block long, g long, dim int, ids binary, marks binary, data binary")


def segments(dim: int) -> list[int]:
    """Numbers of segments, coarse to fine: 1, 4, 16, ... and one of two components each."""
    out, n = [], 1
    while 2 * n < dim:
        out.append(n)
        n *= 4
    return [*out, max(1, (dim + 1) // 2)]


def _summary(x: np.ndarray, n: int) -> np.ndarray:
    """Per vector, numbers whose plain product with another's bounds the inner product."""
    dim = x.shape[1]
    cuts = np.arange(n) * dim // n
    size = np.diff(np.append(cuts, dim)).astype(np.float64)
    if not dim:
        return np.zeros((len(x), 0))
    mean = np.add.reduceat(x, cuts, axis=1) / size
    off = x - np.repeat(mean, size.astype(np.int64), axis=1)
    dev = np.sqrt(np.add.reduceat(off * off, cuts, axis=1) / size)
    return np.concatenate([mean * np.sqrt(size), dev * np.sqrt(size)], axis=1)


def _limbs(scores: np.ndarray) -> np.ndarray:
    """Whole numbers (64 bits, or Python's) as three 64-bit columns that sort alike."""
    mask = (1 << _LIMB) - 1
    top = scores >> (2 * _LIMB) if scores.dtype == object else scores >> 63  # of 64 bits only the sign is left
    mid = (scores >> _LIMB) & mask
    return np.stack([top.astype(np.int64), mid.astype(np.int64), (scores & mask).astype(np.int64)], axis=1)


def _value(limbs: np.ndarray) -> np.ndarray:
    return limbs[:, 0] * 2.0 ** (2 * _LIMB) + limbs[:, 1] * 2.0**_LIMB + limbs[:, 2]


def _products(q: np.ndarray, v: np.ndarray, exact: bool, small: bool, approximate: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``q`` and ``v``: the approximate ones if these are exact, else in whole numbers."""
    if exact:
        return approximate.astype(np.int64)
    if small:
        return np.einsum("ij,ij->i", q, v)
    return np.array([sum(a * b for a, b in zip(x, y, strict=True)) for x, y in zip(q.tolist(), v.tolist(), strict=True)] or [0], dtype=object)[: len(q)]


@dataclass
class Pruned:
    """Pairs that each level looked at and left, and pairs that were computed."""

    seen: dict[int, list[int]] = field(default_factory=dict)
    pairs: int = 0
    computed: int = 0

    def useless(self, n: int) -> bool:
        """Whether a level has dropped next to nothing of many pairs: it is then left out, which changes no result."""
        seen, left = self.seen.get(n, (0, 0))
        return seen > TRIED and left > 0.98 * seen

    def level(self, n: int, before: int, after: int) -> None:
        have = self.seen.setdefault(n, [0, 0])
        have[0], have[1] = have[0] + before, have[1] + after


class Search:
    """The k best so far of each of a block of queries."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None, stats: Pruned | None = None) -> None:
        self.q, self.ids, self.k = queries, ids, k
        self.near = queries.astype(np.float64)
        self.norm = np.sqrt((self.near**2).sum(axis=1))
        self.levels = {n: _summary(self.near, n) for n in segments(queries.shape[1])}
        self.least = np.full(len(queries), -np.inf) if least is None else least.copy()
        self.rows = self.found = np.zeros(0, dtype=np.int64)
        self.limbs = np.zeros((0, 3), dtype=np.int64)
        self.stats = stats or Pruned()

    def meet(self, cand_ids: np.ndarray, cand: np.ndarray) -> None:
        """Take in a block of candidates."""
        order = np.argsort(cand_ids, kind="stable")
        cand_ids, cand = cand_ids[order], cand[order]
        near = cand.astype(np.float64)
        norm = np.sqrt((near**2).sum(axis=1)).max(initial=0)
        summaries = {n: _summary(near, n) for n in self.levels}
        most = np.abs(near).max(initial=0)
        for k in range(0, len(self.q), QUERY_ROWS):
            self._meet(slice(k, k + QUERY_ROWS), cand_ids, cand, near, norm, summaries, most)

    def _meet(self, part: slice, cand_ids: np.ndarray, cand: np.ndarray, near: np.ndarray, norm: float, summaries: dict[int, np.ndarray], most: float) -> None:
        q, least = self.near[part], self.least[part]
        bound = q.shape[1] * np.abs(q).max(initial=0) * most
        exact, small = bound < 2.0**52, bound < 2.0**62
        scale = self.norm[part].max(initial=0) * norm
        slack = 1e-9 * scale + 1e-9 * np.abs(np.where(np.isfinite(least), least, 0))
        alive = self.ids[part][:, None] != cand_ids[None, :]
        self.stats.pairs += int(alive.sum())
        r, c = np.arange(len(q)), np.arange(len(cand))
        left = int(alive.sum())
        for n, mine in self.levels.items() if np.isfinite(least).any() else ():
            if not left or self.stats.useless(n):
                continue
            if left == alive.size:
                alive &= mine[part] @ summaries[n].T >= (least - slack)[:, None]
            else:
                r, c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
                alive[np.ix_(r, c)] &= mine[part][r] @ summaries[n][c].T >= (least - slack)[r][:, None]
            before, left = left, int(alive.sum())
            self.stats.level(n, before, left)
        if not left:
            return
        self.stats.computed += left
        r, c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        table = np.full((len(r), len(c)), -np.inf)
        live = alive[np.ix_(r, c)]
        if left < SPARSE * live.size:
            i, j = np.nonzero(live)
            for k in range(0, len(i), 1 << 15):
                a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                table[a, b] = np.einsum("ij,ij->i", q[r[a]], near[c[b]])
        else:
            table[live] = (q[r] @ near[c].T)[live]
        rounding = 0.0 if exact else 1e-9 * scale
        keep = live & (table >= (least - (0 if exact else slack))[r][:, None])
        if len(c) > self.k:
            kth = -np.partition(-table, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            if exact:  # of equal scores those of smaller ids, which stand first
                tie = table == kth
                keep &= (table > kth) | (tie & (np.cumsum(tie, axis=1) <= self.k - (table > kth).sum(axis=1, keepdims=True)))
            else:
                keep &= table >= kth - 2 * rounding
        i, j = np.nonzero(keep)
        if not len(i):
            return
        start = part.start
        scores = _products(self.q[part][r[i]], cand[c[j]], exact, small, table[i, j])
        self._merge(start + r[i], cand_ids[c[j]], _limbs(scores))

    def _merge(self, rows: np.ndarray, ids: np.ndarray, limbs: np.ndarray) -> None:
        rows, ids = np.concatenate([self.rows, rows]), np.concatenate([self.found, ids])
        limbs = np.concatenate([self.limbs, limbs])
        order = np.lexsort((ids, -limbs[:, 2], -limbs[:, 1], -limbs[:, 0], rows))
        rows, ids, limbs = rows[order], ids[order], limbs[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < self.k
        self.rows, self.found, self.limbs = rows[keep], ids[keep], limbs[keep]
        last = np.flatnonzero(rank[keep] == self.k - 1)
        self.least[self.rows[last]] = np.maximum(self.least[self.rows[last]], _value(self.limbs[last]))


def _unpack(batch: pa.RecordBatch, i: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(dim, ids, marks, vectors) of a block."""
    dim = batch.column("dim")[i].as_py()
    ids, marks, data = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.int64) for c in ("ids", "marks", "data"))
    return dim, ids, marks, data.reshape(len(ids), dim)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row.

    Components are floor(scale * x).  Candidates are all rows but those that
    bear the query's id; ties go to the smaller id.

    Rows: vectors that are null or hold a null or non-finite component, and
    rows without an id, take no part; vectors meet those of the same length
    only; a repeated id is several candidates, and one query for each distinct
    vector, ranked apart.  Components beyond the range of a long count as its
    nearest end; scores are ranked exactly and shown as the nearest long.
    Other columns are not read.
    """
    rows = vectors.where(is_query.isNotNull()).select(column(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("x"), is_query.alias("q"))
    rows = rows.where("id is not null and x is not null").withColumn("mark", F.xxhash64("x"))
    rows = materialise(rows, "vectors")
    n, n_q = rows.agg(F.count("*"), F.count_if("q")).first()
    spark = vectors.sparkSession
    zero = F.lit(0).cast("long").alias("g")
    blocks = materialise(_blocks(rows.select(zero, "id", "mark", "x"), ROW_BLOCK), "blocks")
    n_blocks = blocks.count()
    n_qb = max(1, -(-n_q // QUERY_BLOCK))
    strips = max(1, -(-n_blocks // STRIP_BLOCKS), min(n_blocks, -(-2 * spark.sparkContext.defaultParallelism // n_qb)))
    # a bounded sample of candidates gives each query its first bound
    picked = rows.select("id", "x").orderBy(F.xxhash64("id", "mark"), "id").limit(max(SAMPLE, 2 * k)).toArrow()
    some: dict[int, tuple[list[int], list[list[int]]]] = {}
    for i, x in zip(picked.column("id").to_pylist(), picked.column("x").to_pylist(), strict=True):
        ids, data = some.setdefault(len(x), ([], []))
        ids.append(i)
        data.append(x)
    sample = spark.sparkContext.broadcast({d: (np.array(ids, dtype=np.int64), np.array(x, dtype=np.int64).reshape(len(ids), d)) for d, (ids, x) in some.items()})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for i in range(batch.num_rows):
                dim, ids, _, x = _unpack(batch, i)
                search = Search(x, ids, k)
                if dim in sample.value:
                    search.meet(*sample.value[dim])
                least.append(search.least.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.binary())], names=[*batch.schema.names, "least"])

    asked = rows.where("q").select("id", "mark", "x").distinct().withColumn("g", F.pmod(F.xxhash64("id"), F.lit(n_qb)))
    asked = _blocks(asked.repartition(n_qb, "g"), QUERY_BLOCK)
    asked = materialise(asked.mapInArrow(first, "block long, g long, dim int, ids binary, marks binary, data binary, least binary"), "queries")

    def to_all(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))

    # the stated query set, in blocks: each block of queries meets each strip of rows
    data = [F.col(c) for c in ("dim", "ids", "marks", "data")]
    left = asked.select(F.col("g").alias("qb"), to_all(strips).alias("strip"), F.lit(0).alias("kind"), *data, "least")
    right = blocks.select(to_all(n_qb).alias("qb"), F.pmod(F.xxhash64("block"), F.lit(strips)).alias("strip"), F.lit(1).alias("kind"), *data, F.lit(None).cast("binary").alias("least"))
    keys = ["qb", "strip"]
    both = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, keys):
            kind = part.column("kind").to_pylist()
            made: list[tuple[int, np.ndarray, Search]] = []
            for i, what in enumerate(kind):
                dim, ids, marks, x = _unpack(part, i)
                if what == 0:
                    made.append((dim, marks, Search(x, ids, k, np.frombuffer(part.column("least")[i].as_py(), dtype=np.float64))))
                else:
                    for d, _, search in made:
                        if d == dim:
                            search.meet(ids, x)
            for _, marks, s in made:
                cols = [s.ids[s.rows], marks[s.rows], s.found, *s.limbs.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["query_id", "mark", "vec_id", "s2", "s1", "s0"])

    found = both.mapInArrow(run, "query_id long, mark long, vec_id long, s2 long, s1 long, s0 long")
    w = Window.partitionBy("query_id", "mark").orderBy(F.desc("s2"), F.desc("s1"), F.desc("s0"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # limbs of 42 bits; a score within 64 bits has a top of 0 or -1 and 22 bits more in the middle
    whole = F.shiftleft(F.col("s1").cast("long"), _LIMB).bitwiseOR(F.col("s0"))
    half = F.lit(1 << 21)
    score = (
        F.when((F.col("s2") == 0) & (F.col("s1") < half), whole)
        .when((F.col("s2") == -1) & (F.col("s1") >= F.lit((1 << _LIMB) - (1 << 21))), whole)
        .otherwise(F.when(F.col("s2") < 0, F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1)))
    )
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
