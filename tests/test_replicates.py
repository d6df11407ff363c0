"""The registered resampling queries against plain ones of 5000 replicates."""

from collections import Counter
from statistics import fmean

import numpy as np
import pytest
from veriscope import queries
from veriscope.operators import stats

N = 5000


def draw(seed, b, k):
    p = 2**31 - 1
    x = (seed * 1000003 + b * 48271 + 1) % p
    y = (x * 16807 + k * 69621 + 7) % p
    z = (y * y + x) % p
    u = (z * 48271 + y) % p
    v = (u * u + z) % p
    return (v * 69621 + u) % p


def bounds(v):
    means = sorted(fmean(v[draw(42, b, k) % len(v)] for k in range(len(v))) for b in range(N))
    return means[125], means[4875]


@pytest.fixture
def small(spark, monkeypatch):
    base = {"click": [0.9, 0.6, 0.8, 0.75, 0.95, 0.7, 0.85, 1.0, 0.65, 0.9, 0.8, 0.7], "view": [0.2, 0.1, 0.3, 0.15, 0.25, 0.05, 0.35, 0.1, 0.3, 0.2, 0.4, 0.1]}
    data = {(r, m): [x * f for x in v] for r, v in base.items() for m, f in (("high", 1.0), ("mean_value", 3000.0))}
    rows = [(r, i, "native", m, x) for (r, m), v in data.items() for i, x in enumerate(v)]
    frame = spark.createDataFrame(rows, "run_id string, question_id long, evaluator string, metric string, value double")
    monkeypatch.setattr(queries, "scores", lambda spark, sf: frame)
    return data


def test_intervals(spark, small):
    want = {k: bounds(v) for k, v in small.items()}
    for r in queries.bootstrap_ci(spark, "").collect():
        assert (r.ci_low, r.ci_high) == pytest.approx(want[r.run_id, r.metric], abs=2e-6)
    for r in queries.leaderboard(spark, "").collect():
        assert (r.ci_low, r.ci_high) == pytest.approx(want[r.run_id, "high"], abs=2e-6)
    for r in queries.regression_gate(spark, "").collect():
        assert (r.ci_low, r.ci_high) == pytest.approx(want["click", r.metric], abs=2e-6)


def test_comparison_shows_small_p(spark, small):
    for r in queries.compare_all(spark, "").collect():
        d = [b - a for a, b in zip(small["click", r.metric], small["view", r.metric], strict=True)]
        flips = [fmean(x if draw(43, b, k) % 2 == 0 else -x for k, x in enumerate(d)) for b in range(N)]
        p = (sum(abs(m) >= abs(fmean(d)) - 1e-12 for m in flips) + 1) / (N + 1)
        assert (r.ci_low, r.ci_high) == pytest.approx(bounds(d), abs=2e-6)
        assert r.p_value == pytest.approx(p, abs=1e-6) and p < 1 / 401


def test_draws_are_even_and_apart():
    b, k = np.arange(5000)[:, None], np.arange(200)[None]
    got = stats.draw(42, b, k)
    assert got[17, 23] == draw(42, 17, 23) and got.min() >= 0 and got.max() < 2**31 - 1
    for n in (2, 7, 12, 200):
        counts = np.array([x for _, x in sorted(Counter((got % n).ravel().tolist()).items())])
        assert len(counts) == n and ((counts - got.size / n) ** 2 / (got.size / n)).sum() < n + 5 * (2 * n) ** 0.5
    unit = got / (2**31 - 1) - 0.5  # neighbours in either direction, and the other seed, do not go together
    for a, c in ((unit[1:], unit[:-1]), (unit[:, 1:], unit[:, :-1]), (unit, stats.draw(43, b, k) / (2**31 - 1) - 0.5)):
        assert abs((a * c).mean()) * 12 * a.size**0.5 < 4.5


def test_blocks_and_runs(spark, monkeypatch):
    rows = [("a", i, float(i % 11)) for i in range(50)] + [("b", 3, 7.0), ("c", 1, None)]
    series = spark.createDataFrame(rows, "metric string, question_id long, value double")
    whole = {(r.metric, r.b): r.m for r in stats.bootstrap_means(series, ["metric"], 40).collect()}
    v = [x for m, _, x in rows if m == "a"]
    assert whole["a", 5] == pytest.approx(fmean(v[draw(42, 5, k) % 50] for k in range(50))) and whole["b", 0] == 7.0 and len(whole) == 80
    monkeypatch.setattr(stats, "BLOCK", 16)
    monkeypatch.setattr(stats, "DRAWS", 8)
    monkeypatch.setattr(stats, "TASKS", 3)
    cut = {(r.metric, r.b): r.m for r in stats.bootstrap_means(series, ["metric"], 40).collect()}
    assert cut == pytest.approx(whole)
