"""Memory of a task does not grow with the number of questions; results stay those of the whole job."""

import pickle
import tracemalloc

import numpy as np
import pyarrow as pa
from veriscope.operators import chunking as C
from veriscope.operators import retrieval as R


def _vectors(ids, v, rows=10_000):
    for at in range(0, len(ids), rows):
        yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + rows]), pa.array(list(v[at : at + rows]))], names=["chunk_id", "vector"])


def test_dense_memory_of_many_questions():
    rng = np.random.default_rng(0)
    n, k = 12_000, 5
    v = rng.normal(size=(n, 4))
    v[n // 2 :] = v[: n // 2]  # ties
    v[7], v[8] = 0, np.nan
    ids = rng.permutation(n)
    blocks = {4: (ids[::4], R._unit(v[::4]))}
    batches = list(_vectors(ids, v))
    tracemalloc.start()
    rows = pa.Table.from_batches(list(R._best(iter(batches), blocks, k)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    got = {}
    for q, c, s in zip(*(rows.column(c).to_pylist() for c in rows.column_names), strict=True):
        got.setdefault(q, []).append((-s, c))
    unit = R._unit(v)
    for q in range(0, n, 400):
        score = np.round(unit[q] @ unit.T, 9)
        want = sorted((-s, int(c)) for s, c in zip(score, ids, strict=True) if c != ids[q] and not np.isnan(s))[:k]
        assert [c for _, c in sorted(got.get(int(ids[q]), []))] == [c for _, c in want]


def test_dense_null_components_and_other_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, None]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.5, 0.5]), (6, []), (7, [2.0, 0.0])], "chunk_id long, vector array<double>")
    found = R.dense(rows.withColumnRenamed("chunk_id", "question_id"), rows, 9).collect()
    assert sorted((r[0], r[1], r[3]) for r in found) == [(1, 5, 2), (1, 7, 1), (5, 1, 1), (5, 7, 2), (7, 1, 1), (7, 5, 2)]


def test_lexical_memory_of_many_questions():
    rng = np.random.default_rng(1)
    n, k, runs = 3000, 4, [False, True]
    vocabulary = np.array([f"w{i}" for i in range(4000)])
    docs = [list(vocabulary[np.minimum(rng.zipf(1.3, 60), 4000) - 1]) for _ in range(n)]
    docs[n // 2 :] = docs[: n // 2]  # ties
    ids = rng.permutation(n)
    asked = {q: sorted({*docs[q][:20]}) for q in range(n)}
    rows = pa.table({"question_id": [q for q, t in asked.items() for _ in t], "term": [w for t in asked.values() for w in t]})
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[at : at + 1000]), pa.array(docs[at : at + 1000])], names=["chunk_id", "terms"]) for at in range(0, n, 1000)]
    tracemalloc.start()
    blocks = R._questions(rows) if hasattr(R, "_questions") else R._question_blocks(rows)
    found = pa.Table.from_batches(list(R._scored(iter(batches), blocks, runs, k)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {}
    for run, q, c, s in zip(*(found.column(c).to_pylist() for c in found.column_names), strict=True):
        got.setdefault((run, q), []).append((-s, c))
    for q in range(0, n, 300):
        for run, different in enumerate(runs):
            score = [sum(min(1, d.count(w)) if different else d.count(w) for w in asked[q]) for d in map(list, docs)]
            want = sorted((-s, int(c)) for s, c in zip(score, ids, strict=True) if s)[:k]
            assert sorted(got.get((run, q), [])) == want
    assert peak < 60e6 and len(pickle.dumps(blocks)) < 3e6  # what each worker holds: questions, not questions by terms


def test_sentence_chunks_of_a_large_batch():
    texts = pa.array([None, "", *(f"{i}. " + "One two three. " * 400 for i in range(3000))])
    tracemalloc.start()
    made = C._lists(texts, lambda t: C._by_sentences(t, 1000, 150))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == len(texts) and peak < 5e6  # of 18 MB of text
    assert made[0].as_py() == [] and all(made[i].as_py() == C._by_sentences(texts[i].as_py(), 1000, 150) for i in range(1, len(texts), 100))


def test_draws_of_a_long_series_are_made_once():
    """Half a million values, as events at 6 GB have, lie in one block: work is not squared by blocks."""
    from veriscope.operators import stats as X

    assert X.BLOCK >= 540_000
    n, b, k = 2**31 - 1, [0, 1, 4999], [0, 7, 10**6, 10**9]
    for seed in (0, 42, 43):
        got = X.draw(seed, np.array(b)[:, None], np.array(k)[None])
        for i, bb in enumerate(b):
            for j, kk in enumerate(k):
                x = (seed * 1000003 + bb * 48271 + 1) % n
                y = (x * 16807 + kk * 69621 + 7) % n
                z = (y * y + x) % n
                u = (z * 48271 + y) % n
                v = (u * u + z) % n
                assert got[i, j] == (v * 69621 + u) % n
