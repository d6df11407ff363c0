"""Extra columns whose names clash with what operators use within are carried along by all of them."""

import pytest
from pyspark.sql import functions as F
from veriscope.llm import common, langid, near_dup, sharding, substring

NAMES = ["_id", "_text", "__text", "__id", "__slot", "__shard", "__gone", "__th", "th", "id", "n", "lost", "vid", "part", "gid", "payload", "c0", "c1", "h", "file", "a.b", "a`b", "key"]


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, "seven eight"), (None, "nine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)], F.create_map(F.lit("k"), F.lit(1)).alias("map"))


def same(got, wide, kept):
    assert got.columns[: len(wide.columns)] == wide.columns or set(wide.columns) <= set(got.columns)
    rows = got.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, kept))
    assert all([r[n] for n in NAMES] == list(range(len(NAMES))) and r["map"] == {"k": 1} for r in rows)


def test_near_dup(wide):
    same(near_dup.drop_duplicates(wide), wide, [1, 3, 4, None])


def test_substring(wide):
    same(substring.remove_repeats(wide, 3), wide, [1, 2, 3, 4, None])


def test_langid(spark, wide):
    labelled = spark.createDataFrame([(1, "one two", "en"), (2, "eins zwei", "de")], "doc_id long, text string, lang string")
    same(langid.identify(wide, langid.fit(spark, labelled)), wide, [1, 2, 3, 4, None])


def test_sharding(spark, wide, tmp_path):
    same(sharding.place(wide, F.col("doc_id")), wide, [1, 2, 3, 4, None])
    clash = wide.select("doc_id", F.lit("old").alias("slot"), F.lit("old").alias("shard"), "map")
    placed = sharding.place(clash, F.col("doc_id"))
    assert placed.columns == ["doc_id", "map", "slot", "shard"] and placed.where("shard = 'old'").count() == 0 and dict(placed.dtypes)["slot"] == "bigint"
    sharding.write_shards(clash.drop("slot"), F.col("doc_id"), f"file://{tmp_path}/s", shards=["a", "b"], slots=13)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 5 and set(back.columns) == {"doc_id", "map", "shard"}
    same_rows = spark.range(4000, numPartitions=8).select(F.lit(1).alias("doc_id"))
    sharding.write_shards(same_rows, F.col("doc_id"), f"file://{tmp_path}/t", shards=["a", "b"], slots=13, files=4)
    sizes = spark.read.parquet(f"file://{tmp_path}/t").groupBy(F.input_file_name()).count().collect()
    assert len(sizes) == 4 and {r["count"] for r in sizes} == {1000}


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    """Without a folder a local session gets one of its own, any other an error."""

    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        def __init__(self, local):
            self.local, self._jsc = local, self

        def isLocal(self):
            return self.local

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isDefined(self):
            return False

        def setCheckpointDir(self, path):
            self.path = path

    class Session:
        conf = Conf()

        def __init__(self, local):
            self.sparkContext = Context(local)

    assert common.checkpoint_root(Session(True)) == common.LOCAL_DIR
    with pytest.raises(ValueError, match="checkpoint"):
        common.checkpoint_root(Session(False))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 300), (300, 250), (5, 5)] + [(500, k) for k in range(501, 540)]
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in [*range(1, 41), 100]} | {200: 200, 250: 200, 300: 200} | {k: 500 for k in range(500, 540)}
    assert got == want
    none = spark.createDataFrame([], "a long, b long")
    assert common.connected_components(none).count() == 0
