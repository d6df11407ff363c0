"""A run from the command line and in Python, from raw files to reports; each step against what must come out."""

import json
import warnings

import pytest
from pyspark.sql import functions as F
from veriscope import cli, evaluators, runner
from veriscope.operators import metrics as M
from veriscope.operators import retrieval as R
from veriscope.operators import runs as U
from veriscope.plans import models
from veriscope.plans.config import Config
from veriscope.schemas import INDEXES, PREDICTIONS, RUNS, SCORES
from veriscope.sources.store import Store

CORPUS = [
    {"url": f"u{i}", "title": f"About {w}", "body": f"The {w} lives in {p}. It eats {f} every day.", "author": None, "source": "BBC", "category": "news", "published_at": "2024-01-02T03"}
    for i, (w, p, f) in enumerate([("fox", "woods", "berries"), ("whale", "oceans", "krill"), ("camel", "deserts", "thorns"), ("lemur", "forests", "fruit")])
]
QUERIES = [
    {"query": "What does the fox eat in the woods?", "answer": "berries", "question_type": "inference", "evidence_list": [{"url": "u0", "fact": "It eats berries every day."}]},
    {"query": "What does the whale eat in the oceans?", "answer": "krill", "question_type": "inference", "evidence_list": [{"url": "u1", "fact": "It eats krill every day."}]},
    {"query": "What does the dragon eat?", "answer": "Insufficient information.", "question_type": "null", "evidence_list": []},
]
CONFIG = {"name": "lexical", "chunking": {"strategy": "sentence", "chunk_size": 200, "chunk_overlap": 0}, "retrieval": {"mode": "lexical", "top_k": 2}}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    for name, data in (("corpus", CORPUS), ("queries", QUERIES), ("config", CONFIG), ("wide", {**CONFIG, "name": "wide", "retrieval": {"mode": "lexical", "top_k": 3}})):
        (at / f"{name}.json").write_text(json.dumps(data))
    return at


@pytest.fixture(scope="module")
def store(spark, files):
    store = Store(spark, f"file://{files}/store")
    cli.load_dataset(store, "multihop_rag", [f"file://{files}/corpus.json", f"file://{files}/queries.json"], 10)
    return store


def _talker():
    def call(role, prompt):
        for w, f in (("fox", "berries"), ("whale", "krill")):
            if f"Question: What does the {w}" in prompt:
                return (f"It eats {f}." if role == "generator" else "YES", 7, 3)
        return ("INSUFFICIENT_CONTEXT", 5, 1)

    return call


said = _talker()  # workers can't import this module: a function within goes to them by value


@pytest.fixture(scope="module")
def run_id(store):
    docs, asked = store.read("documents").drop("dataset"), store.read("questions")
    return runner.run_campaign(store, Config.of(CONFIG), "multihop_rag", docs, asked, models.Called(said, tries=1, wait=0.0), label="first")


def test_run_is_kept(store, run_id):
    run = store.read("runs", RUNS).where(F.col("run_id") == run_id).first()
    assert (run.status, run.n_questions, run.n_failed, run.label) == ("completed", 3, 0, "first")
    used = json.loads(run.usage)["generator"]
    assert used["calls"] == 2 and used["completion_tokens"] == 6  # nothing is found for the third: no call
    rows = {r.question_id: r for r in store.read("predictions", PREDICTIONS).collect()}
    assert len(rows) == 3 and all(r.retrieval_ms >= 0 and r.generation_ms >= 0 for r in rows.values())
    assert sorted((r.abstained, len(r.contexts), r.prompt_tokens) for r in rows.values()) == [(False, 1, 7), (False, 1, 7), (True, 0, None)]
    assert all(c.rank == 1 and c.source == "lexical" for r in rows.values() for c in r.contexts)
    index = store.read("indexes", INDEXES).first()
    assert index.n_chunks == 4 and index.dim is None
    assert "Title: About fox\nSource: BBC" in store.spark.read.parquet(f"{store.root}/chunks").orderBy("document_id").first().text
    assert runner.stored_config(store, run_id).hash() == Config.of(CONFIG).hash()


def test_index_is_used_again(store, run_id):
    docs = store.read("documents").drop("dataset")
    assert runner.build_index(store, Config.of(CONFIG), "multihop_rag", docs)[2]
    assert not runner.build_index(store, Config.of(CONFIG), "multihop_rag", docs, force=True)[2]
    embedder = models.Embedder(lambda texts: [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))], batch=3)
    other = Config.of({**CONFIG, "models": {"embedder": "lengths"}})
    _, chunks, there = runner.build_index(store, other, "multihop_rag", docs, embedder)
    assert not there and all(r.vector[0] == len("search_document: " + r.text) for r in chunks.collect())
    assert store.read("indexes", INDEXES).where("dim = 2").count() == 1
    with pytest.raises(ValueError, match="places"):
        models.by_index([(0, [1.0]), (0, [2.0])], 2)


def test_evaluation_is_stored(store, run_id):
    asked = store.read("questions").drop("dataset", "split")
    run = runner.load_run(store, run_id, asked, {"ks": [1, 2]})
    got = {r.evaluator: r for r in runner.evaluate_run(store, run, ["native.ir", "native.answer", "native.nuggets", "native.erag"], judge="j")}
    assert got["native.erag"].skipped and got["native.erag"].problems[0] == "needs utilities" and got["native.ir"].n_scores > 0
    scores = {(r.evaluator, r.metric, r.question_id is None): r.value for r in store.read("scores", SCORES).groupBy("evaluator", "metric", "question_id").agg(F.avg("value").alias("value")).collect()}
    assert scores["native.ir", "hit_rate@1", False] == 1.0 and scores["native.answer", "contains", False] == 1.0
    assert scores["native.nuggets", "mean_nugget_recall", True] == 1.0
    wide = U.drill_down(run.predictions, store.read("scores", SCORES), ["native.answer/contains", "native.ir/mrr"]).collect()
    assert {(r["native.answer/contains"], r["native.ir/mrr"]) for r in wide if r.answerable} == {(1.0, 1.0)} and len(wide) == 3
    with pytest.raises(ValueError, match="no run"):
        runner.load_run(store, 99, asked)


def test_judge_mode_and_doubts(store, run_id):
    run = runner.load_run(store, run_id, store.read("questions").drop("dataset", "split"), {"nugget_mode": "judge"})
    with pytest.raises(ValueError, match="replies"):
        evaluators.evaluate(run, ["native.nuggets"])
    asked = []
    provider = models.Called(lambda role, prompt: ("Yes." if "berries" in prompt.split("Passage:")[0] else "unsure", 1, 1), tries=1)
    run.completions["nuggets"] = runner.judge_nuggets(run, provider)
    rows = {r.metric: r.value for r in evaluators.evaluate(run, ["native.nuggets"]).where("question_id is null").collect()}
    assert rows["mean_nugget_recall"] == 0.5 and not asked
    run.judge = run.generator
    run.completions["utilities"] = run.ranking.select("question_id", "rank", F.lit(0.5).alias("utility"))
    with pytest.warns(UserWarning, match="judge is the generator"):
        made = evaluators.evaluate(run, ["native.erag"], judge="other").collect()
    assert {r.evaluator for r in made} == {"native.erag@other"} and any(r.metric == "mean_utility@rank1" for r in made)


def test_utilities_and_claims(store, run_id):
    run = runner.load_run(store, run_id, store.read("questions").drop("dataset", "split"))
    got = runner.erag_utilities(run, models.Called(lambda role, prompt: ("It eats krill" if "krill" in prompt else "who knows", 1, 1), tries=1)).collect()
    assert sorted(r.utility for r in got) == [0.0, 1.0] and {r["rank"] for r in got} == {1}
    assert runner.erag_utilities(run, models.Called(lambda role, prompt: 1 / 0, tries=1, wait=0.0)).agg(F.sum("utility")).first()[0] == 0.0

    def call(role, prompt):
        if role == "extractor":
            return ("- the animal eats berries\n- the animal likes music" if "It eats berries" in prompt else "- the fact is krill" if "krill" in prompt else "NONE", 1, 1)
        assert role == "verifier"
        claim, passages = prompt.split("Passages:")
        word = claim.split("Claim: ")[1].split()[-1]
        return ("SUPPORTED" if word in passages else "NEUTRAL.", 1, 1)

    run.completions["verdicts"] = runner.claim_verdicts(run, models.Called(call, tries=1, wait=0.0))
    rows = {(r.metric, r.question_id is None): r.value for r in evaluators.evaluate(run, ["native.claims"]).orderBy("value").collect()}
    assert rows["mean_claim_precision", True] == 0.75 and rows["mean_claim_recall", True] == 1.0


def test_completions_are_asked_for_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    calls = spark.sparkContext.accumulator(0)

    def call(role, prompt):
        calls.add(1)
        if prompt == "bad":
            raise RuntimeError
        return (prompt.upper(), 1, 1)

    recorded = models.Recorded(models.Called(call, tries=1, wait=0.0), store)
    prompts = spark.createDataFrame([("r:1", "r", "a"), ("r:2", "r", "bad"), ("r:3", "r", "c")], "prompt_id string, role string, prompt string")
    for n in (3, 4):  # the failed one is asked for again, the others are not
        assert {r.prompt_id: r.text for r in recorded(prompts).collect()} == {"r:1": "A", "r:2": None, "r:3": "C"}
        assert calls.value == n
    assert recorded(prompts.withColumn("prompt", F.lit("new"))).where("text = 'NEW'").count() == 3


def test_failed_step_ends_the_run(store):
    docs, asked = store.read("documents").drop("dataset"), store.read("questions")
    wrong = Config.of({**CONFIG, "retrieval": {"mode": "lexical", "clarify": True}})
    with pytest.raises(ValueError, match="user"):
        runner.run_campaign(store, wrong, "multihop_rag", docs, asked, models.Called(said, tries=1))
    assert U.newest(store.read("runs", RUNS), 1).first().status == "failed"


def test_all_unparsed_grades_fail_the_question(store):
    docs, asked = store.read("documents").drop("dataset"), store.read("questions")

    def call(role, prompt):
        if role == "reranker":
            return ("no idea" if "whale eat" in prompt else "2", 1, 1)
        return said(role, prompt)

    config = Config.of({**CONFIG, "name": "graded", "retrieval": {"mode": "lexical", "top_k": 2, "fetch_k": 3, "rerank": "llm"}})
    made = runner.run_campaign(store, config, "multihop_rag", docs, asked, models.Called(call, tries=1, wait=0.0))
    rows = store.read("predictions", PREDICTIONS).where(F.col("run_id") == made).collect()
    assert sorted(str(r.error) for r in rows) == ["None", "None", "rerank failed"]
    assert store.read("runs", RUNS).where(F.col("run_id") == made).first().n_failed == 1


def test_command_line(files, store, run_id, capsys, spark):
    root = ["--store", store.root]
    assert cli.main(["stats", *root]) == 0 and "multihop_rag" in capsys.readouterr().out
    assert cli.main(["doctor", *root]) == 0 and "runs in" in capsys.readouterr().out
    assert cli.main(["matrix", f"{files}/config.json"]) == 0 and json.loads(capsys.readouterr().out) == {"configurations": 1, "indexes": 1}
    assert cli.main(["runs", *root, "--status", "completed"]) == 0 and "lexical" in capsys.readouterr().out
    assert cli.main(["index", f"{files}/config.json", "--dataset", "multihop_rag", *root]) == 0 and "there already" in capsys.readouterr().out
    ids = [r.question_id for r in store.read("questions").collect()]
    spark.createDataFrame([(f"generator:{i}", "krill", 1, 1) for i in ids], "prompt_id string, text string, prompt_tokens int, completion_tokens int").write.mode("overwrite").parquet(f"file://{files}/said")
    assert cli.main(["run", f"{files}/wide.json", "--dataset", "multihop_rag", "--completions", f"file://{files}/said", *root]) == 0
    second = int(capsys.readouterr().out.split("run ")[1])
    for r in (run_id, second):
        assert cli.main(["eval", str(r), "--option", "ks=1,2", *root]) == 0
        assert '"n_scores"' in capsys.readouterr().out
    for command in (["show", str(run_id)], ["compare", str(run_id), str(second)], ["report", "--metrics", "contains,mrr"], ["leaderboard", "contains", "--dataset", "multihop_rag"],
                    ["drill", str(run_id), "--metrics", "native.ir/mrr"], ["curve", f"{files}/config.json", "--dataset", "multihop_rag", "--ks", "1,2"],
                    ["curves", f"{files}/config.json", f"{files}/wide.json", "--dataset", "multihop_rag", "--ks", "1,2"]):
        assert cli.main([*command, *root]) == 0 and "|" in capsys.readouterr().out
    out = f"file://{files}/curve"
    assert cli.main(["curve", f"{files}/config.json", "--dataset", "multihop_rag", "--ks", "1,2", "--out", out, *root]) == 0
    assert json.loads(spark.read.text(out).first().value)["doc_recall"]["1"]["mean"] == 1.0


def test_lexical_passes_agree(spark, monkeypatch):
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "blue", "the", "sky fox sky", None])], "question_id long, text string")
    texts = ["red red fox", "blue sky", None, "", "Fox! FOX; sky", "fox sky", "red"]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "chunk_id long, text string").repartition(3)
    for scoring in ("occurrences", "distinct"):
        want = R.lexical(asked, chunks, 4, scoring, R.postings(chunks)).collect()
        assert sorted(map(tuple, R.lexical(asked, chunks, 4, scoring).collect())) == sorted(map(tuple, want)) and want
        with monkeypatch.context() as m:
            m.setattr(R, "QUERY_TERMS", 2)
            m.setattr(R, "_ASKED", 1)
            m.setattr(R, "_CELLS", 4)
            assert sorted(map(tuple, R.lexical(asked, chunks, 4, scoring).collect())) == sorted(map(tuple, want))


def test_evidence_stands_in_documents(spark, monkeypatch):
    docs = [(1, "one two three"), (2, "two"), (3, None), (4, ""), (5, "xtwo threex")]
    items = [(10, "two"), (11, "two three"), (12, ""), (13, None), (14, "two"), (15, "absent")]
    monkeypatch.setattr(R, "ITEM_BYTES", 30)
    found = R.evidence(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted((i, d) for i, a in items for d, t in docs if a and t and a in t)


def test_missing_facts(spark):
    facts = spark.createDataFrame([(1, k, f"alpha{k} beta" + "x" * 300) for k in range(8)] + [(2, 0, "seen words here")], "question_id long, fact_id int, fact string")
    passages = spark.createDataFrame([(2, 1, "seen words here")], "question_id long, rank int, text string")
    got = {r.question_id: r.missing for r in M.missing_facts(M.nugget_support(facts, passages), facts).collect()}
    assert got[2] == [] and [x[:6] for x in got[1]] == [f"alpha{k}" for k in range(5)] and {len(x) for x in got[1]} == {200}


def test_no_warning_without_doubt(store, run_id):
    run = runner.load_run(store, run_id, store.read("questions").drop("dataset", "split"))
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert evaluators.evaluate(run, ["native.answer"]).count() > 0
