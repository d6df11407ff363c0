import brute
import pytest
from veriscope.llm import near_dup


@pytest.mark.parametrize("percent", [85, 80])
def test_classes_equal_brute_force(documents, corpus, percent):
    want = brute.near_duplicates(corpus, percent)
    got = near_dup.near_duplicates(documents, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_smaller_than_groups(documents, corpus, monkeypatch):
    monkeypatch.setattr(near_dup, "LIST_BLOCK", 8)
    monkeypatch.setattr(near_dup, "SET_BLOCK", 4)
    got = near_dup.near_duplicates(documents, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(corpus, 85)


def test_nulls_repeats_and_nothing(spark, nothing):
    long = "one two three four five six seven"
    rows = [(None, long), (2, long), (1, long), (1, long), (1, "other words of the same id here"), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_dup.near_duplicates(df).collect()), key=str)
    want = [(None, 3, None, True), (2, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (1, 3, 1, True), (None, 0, None, True), (3, 0, 3, True)]
    assert got == sorted(want, key=str)
    assert near_dup.near_duplicates(nothing).count() == 0
    left = near_dup.drop_duplicates(df).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([r for r in rows if r[0] != 2], key=str)


def test_drop_keeps_columns(documents, corpus):
    want = brute.near_duplicates(corpus, 80)
    left = near_dup.drop_duplicates(documents, 80)
    assert left.columns == documents.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_match_threshold():
    assert near_dup.match_threshold(64, 100) == 64
    assert near_dup.match_threshold(64, 85) < 54 < near_dup.match_threshold(64, 99)
