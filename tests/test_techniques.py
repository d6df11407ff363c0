"""Clarification and cross-encoder of the retrieval plan."""

import pytest
from veriscope.plans import config, models, pipeline


@pytest.fixture(scope="module")
def index(spark):
    texts = ["Title: Foxes\nSource: BBC\nPublished: 2024-01-02T03:04\n\nred fox", "red hen red", "blue sky", "green tea", "red red red dog", "grey cat"]
    return pipeline.Index(spark.createDataFrame([(i, i // 2, t) for i, t in enumerate(texts)], "chunk_id long, document_id long, text string"))


def _conf(**retrieval):
    return config.Config.of({"name": "a", "retrieval": {"mode": "lexical", "top_k": 4, **retrieval}})


def _ranks(ranking):
    out = {}
    for r in ranking.orderBy("question_id", "rank").collect():
        out.setdefault(r.question_id, []).append((r.chunk_id, round(r.score, 6)))
    return out


def test_clarify_fuses_the_reply(spark, index):
    asked = spark.createDataFrame([(1, "red"), (2, "green"), (3, "absent"), (4, "grey")], "question_id long, text string")
    articles = spark.createDataFrame([(1, "Cats", "AP", "2024-05-06T00")], "question_id long, title string, source string, published_at string")

    def call(role, prompt):
        if role == "clarifier":
            assert "absent" not in prompt
            assert "Question: red" not in prompt or "- BBC, 2024-01-02: Foxes" in prompt or "- ?, : ?" in prompt
            return ("Which animal?" if "Question: red" in prompt or "Question: grey" in prompt else "NONE", 1, 1)
        assert role == "simulated_user" and "The assistant asks you: Which animal?" in prompt
        return ("grey cat" if "- AP, 2024-05-06: Cats" in prompt else "", 1, 1)

    provider = models.Called(call, tries=1, wait=0.0)
    plain = _ranks(pipeline.retrieve(index, asked, _conf()))
    got = _ranks(pipeline.retrieve(index, asked, _conf(clarify=True), provider, pipeline.simulated_user(provider, articles)))
    first, second = [c for c, _ in plain[1]], [4, 1, 5, 0]  # "red grey cat": counts 3, 2, 2, 1
    want = {c: round(sum(1 / (61 + run.index(c)) for run in (first, second) if c in run), 6) for c in {*first, *second}}
    assert dict(got[1]) == want and 5 not in first
    assert got[2] == plain[2] and got[4] == plain[4] and 3 not in got
    with pytest.raises(ValueError, match="user"):
        pipeline.retrieve(index, asked, _conf(clarify=True), provider)


def test_candidate_lines(spark):
    head = "Title: a\nSource: s\nPublished: 2024-01-02T03\n\nbody"
    rows = [(1, 7, 2, "Title: x\nno"), (1, 8, 1, head), (1, 8, 3, "y")]
    ranking = spark.createDataFrame(rows, "question_id long, document_id long, rank int, text string")
    assert pipeline.candidate_lines(ranking).first().candidates == "- s, 2024-01-02: a\n- ?, : x"


def test_cross_encoder_orders_by_its_scores(spark, index):
    asked = spark.createDataFrame([(1, "red"), (2, "green")], "question_id long, text string")
    conf = _conf(rerank="cross_encoder", rerank_model="back:model")

    def call(model, question, passages):
        assert model == "back:model" and question in ("red", "green")
        return [2.5 if "fox" in p else 0.5 for p in passages]

    got = _ranks(pipeline.retrieve(index, asked, conf, scorer=models.Scorer(call)))
    assert got == {1: [(0, 2.5), (4, 0.5), (1, 0.5)], 2: [(3, 0.5)]}
    with pytest.raises(ValueError, match="scorer"):
        pipeline.retrieve(index, asked, conf)
    with pytest.raises(Exception, match="scores"):
        pipeline.retrieve(index, asked, conf, scorer=models.Scorer(lambda m, q, p: [float("nan")] * len(p))).collect()
