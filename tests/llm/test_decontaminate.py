import random

import brute
import numpy as np
import pytest
from veriscope.llm import decontaminate as d


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]

    items = [(i, " ".join(text(rng.choice([1, 3, 5, 6, 9, 15, 15, 30, 60])))) for i in range(40)] + [(100, None), (101, " "), (None, "w1 w2 w3 w4 w5 w6"), (102, "rep rep rep rep rep rep rep")]
    items[0] = (0, "only once")
    docs = []
    for k in range(160):
        w = text(rng.choice([3, 8, 50, 120]))
        if k % 2:
            v = items[rng.randrange(40)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                j = rng.randrange(len(v)) if v else 0
                v[j : j + 1] = rng.choice([[], ["zz"], [*v[j : j + 1], "yy"]])
            at = rng.randrange(len(w))
            w[at:at] = v
        docs.append(" ".join(w).upper() if k % 5 == 0 else " ".join(w))
    docs += [None, "", "only", "rep " * 30, " ".join(items[9][1].split()[:-1])]
    return docs, items


def test_hits_equal_brute_force(spark, case):
    docs, items = case
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "3 as item_id", "'x' as hits").repartition(4)
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    want = brute.find_items(docs, [(i, t) for i, t in items if i is not None])
    got = {(r.doc_id, r.item_id): r.similarity for r in d.pairs(df, bench).collect()}
    assert got == want
    left = d.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(range(len(docs))) - {k for k, _ in want})


def runs_of_a_token():
    """Items with a run of one token, and texts in which words stand in place of a part of it: pairs at 0.80 to 0.82."""
    rng = random.Random(4)
    docs, items = [], []
    for k in range(24):
        run, n = rng.choice([(18, 204), (16, 200), (20, 220)])
        fresh = iter(range(10**6))
        v = [f"i{k}x{next(fresh)}" for _ in range(n - run)]
        at = rng.randrange(20, n - run - 20)
        around = [f"d{k}x{next(fresh)}" for _ in range(60)]
        items.append((k, " ".join([*v[:at], *["_"] * run, *v[at:]])))
        w = [f"r{k}x{next(fresh)}" for _ in range(run)]
        docs.append(" ".join([*around[:30], *v[:at], *w, *v[at:], *around[30:]]))
    docs += [t.replace(" _ _ _ _ ", " _ a _ b ", 1) for _, t in items] + ["_ " * 400, " ".join(t for _, t in items[:3])]
    return docs, items


def test_runs_of_a_token_equal_brute_force():
    docs, items = runs_of_a_token()
    want = brute.find_items(docs, items)
    at_threshold = [v for (a, b), v in want.items() if a < 24 and a == b]
    assert len(at_threshold) >= 12 and all(0.80 <= v <= 0.83 for v in at_threshold)
    found = d.search(d.Index(d.make_items(items)).build(), docs)
    assert {(k, x["item_id"]): x["similarity"] for k, hits in enumerate(found) for x in hits} == want


def test_window_sums_equal_their_features():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 6, 300).astype(np.uint64)
    run = np.repeat([0, 1, 2], [120, 1, 179])
    length = np.repeat([17, 1, 40], [120, 1, 179])
    at = np.array([a for a in range(300) if a + length[a] <= 300 and run[a] == run[a + length[a] - 1]])
    sums = d.window_sums(h, run, length, at)
    for a, got in zip(at, sums, strict=True):
        w = h[a : a + length[a]]
        nth = np.array([(w[:j] == x).sum() + 1 for j, x in enumerate(w)])
        assert (d._bit_rows(d._features(w, nth)).sum(axis=0, dtype=np.int64) == got).all()


def test_passes_over_slices(spark, case, monkeypatch):
    docs, items = case
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(r.doc_id, r.item_id, r.similarity, r.start) for r in d.pairs(df, bench).collect()}
    monkeypatch.setattr(d, "SLICE_ITEMS", 15)
    assert {(r.doc_id, r.item_id, r.similarity, r.start) for r in d.pairs(df, bench).collect()} == want


@pytest.mark.parametrize("listed", [0, 1, 2, 3])
def test_multi_index_finds_all_within_radius(listed, monkeypatch):
    monkeypatch.setattr(d, "ITEM_RADIUS", listed)
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, (50, 12), dtype=np.uint64)
    items = [d.Item(i, 16, np.sort(x), np.ones(12), 12, d.fingerprints(d._bit_rows(x).sum(axis=0, dtype=np.int64)[None])[0]) for i, x in enumerate(h)]
    index = d.Index(items).build()
    prints = np.stack([x.print for x in items])[rng.integers(0, 50, 300)].copy()
    for row in prints:
        for bit in rng.choice(256, rng.integers(0, 90), replace=False):
            row[bit // 16] ^= 1 << (bit % 16)
    near = d.distance(prints[:, None, :], np.stack([x.print for x in items])[None]) <= d.RADIUS
    assert set(zip(*map(list, index.candidates(16, prints)), strict=True)) == set(zip(*map(list, np.nonzero(near)), strict=True))


@pytest.mark.parametrize("changed", range(1, 12))
def test_recall_by_similarity(changed):
    """Every pair of an item of 204 words and a copy with ``changed`` words changed in a row or apart, by brute force."""
    rng = random.Random(changed)
    items, docs = [], []
    for k in range(40):
        v = [f"k{k}w{i}" for i in range(204)]
        w, at = list(v), rng.randrange(5, 150)
        for i in range(changed):
            w[at + i * rng.choice([1, 2])] = "zz"
        items.append((k, " ".join(v)))
        docs.append(" ".join(w))
    want = brute.find_items(docs, items)
    found = d.search(d.Index(d.make_items(items)).build(), docs)
    assert {(k, x["item_id"]): x["similarity"] for k, hits in enumerate(found) for x in hits} == want and want


def test_clashing_names(spark):
    names = ["_text", "__text", "__hits", "hits", "found", "c0", "c1", "item_id"]
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "zz")], "doc_id long, text string")
    for i, c in enumerate(names):
        df = df.withColumn(c, df.doc_id + i)
    bench = spark.createDataFrame([(7, "a b c d e f g")], "item_id long, text string")
    left = d.drop_contaminated(df, bench)
    assert left.columns == df.columns and [[r[c] for c in names] for r in left.collect()] == [[2 + i for i in range(len(names))]]


def test_nothing(spark, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert d.pairs(nothing, bench).count() == 0 and d.pairs(some, bench).count() == 0
    assert d.drop_contaminated(some, bench).count() == 1
