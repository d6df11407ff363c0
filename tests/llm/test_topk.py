"""Exact top-k at large and repeated values, and how much its bounds drop."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from veriscope.llm import topk


def search(queries, ids, blocks, k, **more):
    s = topk.Search(np.array(queries, dtype=np.int64), np.array(ids, dtype=np.int64), k, **more)
    for cand_ids, cand in blocks:
        s.meet(np.array(cand_ids, dtype=np.int64), np.array(cand, dtype=np.int64))
    return s


def big(v):
    return int(v[0]) * 2 ** (2 * topk._LIMB) + int(v[1]) * 2**topk._LIMB + int(v[2])


@pytest.mark.parametrize("scale", [50, 2**25, 2**30 + 1, 2**45, 2**62])
def test_scores_are_whole_numbers_of_any_size(scale):
    rng = np.random.default_rng(5)
    x = [[int(v) for v in rng.integers(-scale, scale, 7)] for _ in range(60)]
    x[40:50] = [x[3]] * 10
    got = search(x[:9], range(9), [(range(0, 25), x[:25]), (range(25, 60), x[25:])], 6)
    for q in range(9):
        want = sorted((-sum(a * b for a, b in zip(x[q], x[c], strict=True)), c) for c in range(60) if c != q)[:6]
        mine = got.rows == q
        assert [(big(v), int(c)) for v, c in zip(got.limbs[mine], got.found[mine], strict=True)] == [(-s, c) for s, c in want]


def test_neighbours_beyond_doubles(spark):
    """Scores that differ by less than a double can tell, and some that no long can hold."""
    rows = [(0, [2.0**24 + 1 / 64]), (1, [2.0**24 + 1 / 64]), (2, [2.0**24 + 3 / 64]), (3, [2.0**24 + 2 / 64]), (20, [3e17]), (21, [3e17]), (22, [-3e17]), (40, [9.0, 1.0]), (41, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df, F.pmod("vec_id", F.lit(20)) == 0, k=8).collect()}
    one = 2**30 + 1
    assert [got[0, r][0] for r in (1, 2, 3, 4, 5, 6)] == [20, 21, 2, 3, 1, 22]
    assert [got[0, r][1] for r in (3, 4, 5)] == [one * (one + 2), one * (one + 1), one * one]
    assert got[20, 1] == (21, 2**63 - 1) and got[20, 6] == (22, -(2**63)) and got[40, 1] == (41, 64 * 9 * 64)


def test_repeated_query_ids_rank_apart(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=2).collect())
    assert got == sorted([(0, 1, 1, 8192), (0, 2, 2, 0), (0, 1, 2, 12288), (0, 2, 2, 12288)])


def test_bounds_hold_and_drop():
    """No bound lies below a product; vectors that lie in groups are mostly never multiplied."""
    rng = np.random.default_rng(8)
    x = rng.integers(-90, 90, (80, 24)).astype(np.float64)
    assert topk.segments(24) == [1, 4, 12] and topk.segments(1) == [1] and topk.segments(64) == [1, 4, 16, 32]
    for n in topk.segments(24):
        s = topk._summary(x, n)
        assert (s @ s.T >= x @ x.T - 1e-6).all()
    centres = np.repeat(rng.integers(-400, 400, (40, 8)), 3, axis=1)
    near = np.repeat(centres, 50, axis=0) + rng.integers(-5, 5, (2000, 24))
    order = rng.permutation(2000)
    got = search(near[:60], range(60), [(order[k : k + 400], near[order[k : k + 400]]) for k in range(0, 2000, 400)], 10)
    want = brute.top_k([(i, (v / 64).tolist()) for i, v in enumerate(near)], lambda i: i < 60, 10, 64.0)
    assert sorted(zip(got.ids[got.rows].tolist(), got.found.tolist(), [big(v) for v in got.limbs], strict=True)) == sorted((q, c, s) for q, _, c, s in want)
    assert got.stats.computed < 0.35 * got.stats.pairs and set(got.stats.seen) == {1, 4, 12}


def test_a_level_that_drops_nothing_is_left_out(monkeypatch):
    monkeypatch.setattr(topk, "TRIED", 500)
    rng = np.random.default_rng(9)
    x = rng.integers(-60, 60, (300, 32))
    got = search(x[:30], range(30), [(range(k, k + 50), x[k : k + 50]) for k in range(0, 300, 50)], 5)
    want = brute.top_k([(i, (v / 64).tolist()) for i, v in enumerate(x)], lambda i: i < 30, 5, 64.0)
    assert sorted(zip(got.ids[got.rows].tolist(), got.found.tolist(), strict=True)) == sorted((q, c) for q, _, c, _ in want)
    assert got.stats.useless(1) and got.stats.seen[1][0] < got.stats.pairs
