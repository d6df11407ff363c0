"""Known answers, stores, configurations and the question pipeline."""

import json

import pytest
from pyspark.sql import functions as F
from veriscope import evaluators
from veriscope.functions import text as T
from veriscope.operators import chunking as C
from veriscope.operators import stats as X
from veriscope.plans import config, models, pipeline
from veriscope.sources import loaders
from veriscope.sources.store import Store
from veriscope.streaming import campaign


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_chunkers(spark):
    text = "First paragraph here. It has sentences!\n\nSecond one? Yes; it does, too.\n\n" + "word " * 60
    for strategy in ("fixed", "recursive", "sentence", "document"):
        got = one(spark, C.chunks_of(F.lit(text), strategy, 100, 0))
        assert got and all(c.strip() for c in got)
        assert set(" ".join(got).split()) >= set(text.split()) or strategy == "fixed"
    assert one(spark, C.chunks_of(F.lit("ab cd ef"), "recursive", 5, 2)) == ["ab cd", "cdef"]
    assert one(spark, C.chunks_of(F.lit("One. Two. Three."), "sentence", 9, 3)) == ["One. Two.", "wo.Three."]
    assert one(spark, C.chunks_of(F.lit(" \n "), "fixed")) == [] and one(spark, C.chunks_of(F.lit(None).cast("string"))) == []
    with pytest.raises(ValueError):
        C.chunks_of(F.lit("x"), "other")


def test_text_scalars(spark):
    assert one(spark, T.normalize(F.lit("The  Cat, a-b!"))) == "cat ab"
    assert one(spark, T.token_f1(F.lit("a b b"), F.lit("b b c"))) == pytest.approx(0.8)
    assert one(spark, T.contains_gold(F.lit("Yes, it is"), F.lit("yes"))) and not one(spark, T.contains_gold(F.lit("it is yes"), F.lit("Yes")))
    assert one(spark, T.abstained(F.lit("The provided context does not say"))) and not one(spark, T.abstained(F.lit("Paris")))
    assert one(spark, T.sub_queries(F.lit('1. "a"\n- A\n\n* b\nc\nd'), 3)) == ["a", "b", "c"]
    assert one(spark, T.claims(F.lit("- a claim of some length\n- short"))) == ["a claim of some length"] and one(spark, T.claims(F.lit("NONE"))) == []
    assert [one(spark, T.verdict(F.lit(x).cast("string"))) for x in ("supported.", "", None, "maybe")] == ["SUPPORTED", "UNPARSED", "UNPARSED", "NEUTRAL"]
    assert one(spark, T.final_answer(F.lit("x ANSWER: y ANSWER: z"))) == "y ANSWER: z"
    assert one(spark, T.json_block(F.lit('so: {"a": 1} ok'), "a int")).a == 1


def test_statistics(spark):
    tests = spark.createDataFrame([(i, p) for i, p in enumerate([0.04, 0.01, 0.03, 0.02])], "i int, p_value double")
    assert [r.p_holm for r in X.holm(tests).orderBy("i").collect()] == pytest.approx([0.06, 0.04, 0.06, 0.06])
    pairs = spark.createDataFrame([("m", i, 0.0, 1.0) for i in range(20)] + [("t", i, 1.0, 1.0) for i in range(5)], "metric string, question_id long, a double, b double")
    got = {r.metric: (r.b_wins, r.a_wins, r.p_value) for r in X.mcnemar(pairs, ["metric"]).collect()}
    assert got["m"] == (20, 0, pytest.approx(2 / 2**20)) and got["t"] == (0, 0, 1.0)
    assert X.cohen_kappa(pairs, ["metric"]).where("metric = 't'").first().kappa is None
    assert one(spark, X.required_n(F.lit(0.05))) == 1568


def test_config():
    made = config.matrix({"base": {"name": "b", "retrieval": {"top_k": 5}}, "variants": [{"name": "x", "retrieval": {"mode": "lexical"}}, {"name": "y"}]})
    assert [c.retrieval.top_k for c in made] == [5, 5] and made[0].hash() != made[1].hash() and made[0].index_hash() == made[1].index_hash()
    assert config.Config.of({"name": "a"}).hash() == config.Config.of({"name": "b", "description": "d"}).hash()
    for bad in ({"retrieval": {"nope": 1}}, {"retrieval": {"rerank": "cross_encoder"}}, {"retrieval": {"hyde": True, "mode": "lexical"}}, {"chunking": {"strategy": "x"}}):
        with pytest.raises(ValueError):
            config.Config.of({"name": "a"} | bad)
    wide, notes = config.pool_config(config.Config.of({"name": "a", "retrieval": {"max_per_document": 2}}), 50)
    assert wide.retrieval.fetch_k == 200 and notes
    assert config.option("ks=1, 2") == ("ks", [1, 2])


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    cols = "run_id long, question_id long, evaluator string, metric string, value double"
    s.upsert("scores", spark.createDataFrame([(1, 1, "e", "m", 0.1), (1, None, "e", "m", 0.2)], cols))
    s.upsert("scores", spark.createDataFrame([(1, None, "e", "m", 0.9), (1, 2, "e", "m", 0.3)], cols))
    assert sorted((r.question_id or 0, r.value) for r in s.read("scores").collect()) == [(0, 0.9), (1, 0.1), (2, 0.3)]
    s.upsert("configs", spark.createDataFrame([("h", "old", "p")], "hash string, name string, payload string"))
    s.upsert("configs", spark.createDataFrame([("h", "new", "q"), ("i", "n", "r")], "hash string, name string, payload string"), only=["name"])
    assert sorted(map(tuple, s.read("configs").collect())) == [("h", "new", "p"), ("i", "n", "r")]
    made = []
    for _ in range(2):
        s.ensure_index("x", lambda: made.append(1) or spark.range(3))
    assert made == [1]
    s.upsert("configs", s.read("configs"))
    s.vacuum("configs", 1)
    assert s.read("configs").count() == 2


def test_loaders(spark, tmp_path):
    corpus = [{"url": "u1", "title": "t", "body": "b", "source": "s"}]
    asked = [{"query": "q", "answer": "a", "question_type": "x", "evidence_list": [{"url": "u1", "fact": "f"}, {"url": "gone", "fact": "g"}]}]
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    (tmp_path / "q.json").write_text(json.dumps(asked))
    d = loaders.get_loader("multihop_rag")(spark, f"file://{tmp_path}/c.json", f"file://{tmp_path}/q.json")
    q = d.questions.first()
    assert q.external_id == "mhr-00000" and [e.document_external_id for e in q.gold_evidence] == ["u1"] and d.orphans.first().n == 1
    hot = [{"_id": "1", "question": "q", "answer": "a", "type": "bridge", "level": "easy", "context": [["A", ["x ", "y"]], ["A", ["z"]]], "supporting_facts": [["A", 1], ["A", 0]]}]
    (tmp_path / "h.json").write_text(json.dumps(hot))
    h = loaders.hotpotqa(spark, f"file://{tmp_path}/h.json")
    assert h.documents.first().body == "x y" and h.questions.first().gold_evidence[0].sentence_ids == [0, 1]


def _index(spark):
    rows = [(i, i // 2, t, [float(i == j) + 0.1 for j in range(6)]) for i, t in enumerate(["red fox", "red hen", "blue sky", "green tea", "red red dog", "grey cat"])]
    return pipeline.Index(spark.createDataFrame(rows, "chunk_id long, document_id long, text string, vector array<double>"))


def test_campaign_and_evaluation(spark):
    asked = spark.createDataFrame([(100, "red"), (101, "nothing here")], "question_id long, text string")
    conf = config.Config.of({"name": "a", "retrieval": {"mode": "lexical", "top_k": 3, "max_per_document": 1, "rerank": "llm", "query_decompose": True}})

    def call(role, prompt):
        if role == "reranker":
            return ("grade 3" if "hen" in prompt else "1", 1, 1)
        return ("red\nblue" if role == "decomposer" and "red" in prompt else "" if role == "decomposer" else "a fox", 1, 1)

    got = {r.question_id: r for r in pipeline.campaign(_index(spark), asked, conf, models.Called(call, wait=0.0), 7).collect()}
    assert [c.chunk_id for c in got[100].contexts][0] == 1 and got[100].answer == "a fox" and got[100].error is None
    assert len({c.document_external_id for c in got[100].contexts}) == len(got[100].contexts)
    assert got[101].abstained and got[101].answer == T.ABSTAIN
    preds = spark.createDataFrame([(100, "a fox", "fox", True), (101, T.ABSTAIN, "", False)], "question_id long, answer string, gold string, answerable boolean")
    scores = evaluators.evaluate(evaluators.Run(7, preds), ["native.answer"]).collect()
    assert {(r.question_id, r.metric): r.value for r in scores}[100, "contains"] == 1.0
    with pytest.raises(ValueError):
        evaluators.evaluate(evaluators.Run(7, preds), ["native.ir"])


def test_dense_and_closed_book(spark):
    asked = spark.createDataFrame([(100, "x", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])], "question_id long, text string, vector array<double>")
    conf = config.Config.of({"name": "a", "retrieval": {"top_k": 2}})
    assert [r.chunk_id for r in pipeline.retrieve(_index(spark), asked, conf).orderBy("rank").collect()] == [0, 1]
    closed = config.Config.of({"name": "a", "generation": {"prompt_template": "closed_book"}})
    none = spark.createDataFrame([], "prompt_id string, text string")
    assert pipeline.campaign(_index(spark), asked, closed, models.Canned(none), 1).first().error == "call failed"


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "q")], "question_id long, text string").write.parquet(f"file://{tmp_path}/in")
    s = Store(spark, f"file://{tmp_path}/store")
    answer = lambda df: df.select(F.lit(1).cast("long").alias("run_id"), "question_id", F.upper("text").alias("answer"))
    for _ in range(2):
        campaign.start(spark, f"file://{tmp_path}/in", "question_id long, text string", answer, s, f"file://{tmp_path}/ck", once=True).awaitTermination(120)
    assert [tuple(r) for r in s.read("predictions").collect()] == [(1, 1, "Q")]
