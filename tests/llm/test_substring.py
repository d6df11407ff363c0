import brute
import pytest
from pyspark.sql import functions as F
from veriscope.llm import substring


@pytest.mark.parametrize("window", [13, 2, 50])
def test_words_equal_brute_force(documents, corpus, window):
    got = substring.remove_repeats(documents, window, joined=True)
    assert got.columns == [*documents.columns, "n_words", "n_removed"]
    have = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got.collect()}
    assert have == {i: (n, gone, " ".join(kept)) for i, n, gone, kept in brute.remove_repeats(corpus, window)}


def test_small_groups_and_buckets(documents, corpus, monkeypatch):
    monkeypatch.setattr(substring, "GROUP_BYTES", 500)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 5000)
    got = substring.remove_repeats(documents, 13, joined=True).select("doc_id", "n_removed", F.sha2("text", 256).alias("k")).collect()
    assert {(r.doc_id, r.n_removed, r.k) for r in got} == {(i, g, brute.digest(k)) for i, _, g, k in brute.remove_repeats(corpus, 13)}


def test_spacing_is_kept(spark):
    a = "a  b\tc\nd e"
    df = spark.createDataFrame([(1, "b c d"), (2, a), (3, " untouched  text\n")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring.remove_repeats(df, 3).collect()}
    assert got == {1: "b c d", 2: "a  e", 3: " untouched  text\n"}


def test_nulls_repeats_and_nothing(spark, nothing):
    w = " ".join(f"w{i}" for i in range(20))
    rows = [(None, w), (5, w), (5, w), (7, w), (8, None), (9, ""), (9, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("x"))
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in substring.remove_repeats(df, 13).collect()), key=str)
    assert got == sorted([(None, w, 20, 0), (5, w, 20, 0), (5, w, 20, 0), (7, "", 20, 20), (8, None, 0, 0), (9, "", 0, 0), (9, "one", 1, 0)], key=str)
    out = substring.remove_repeats(nothing, 13)
    assert out.count() == 0 and "n_chars" in out.columns
