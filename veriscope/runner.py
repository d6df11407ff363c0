"""Runs from start to report: index, campaign, evaluation, all kept in a store."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import evaluators
from .functions.text import claims, says_yes, verdict
from .operators import chunking, runs
from .operators.metrics import recall_curve, utility
from .plans import pipeline
from .plans.config import Config, pool_config
from .plans.models import RECORD, Embedder, Provider, Recorded, Scorer, User, usage
from .schemas import CONFIGS, PREDICTIONS, RUNS, SCORES
from .sources.store import Store

#: Texts of prompts are cut to these widths.
FACT_CHARS, PASSAGE_CHARS, ERAG_CHARS = 800, 1500, 4000
ANSWER_CHARS, CLAIM_CHARS, CONTEXT_CHARS = 3000, 500, 1200
#: Questions that these costly evaluators take, the first by id.
ERAG_SAMPLES, CLAIM_SAMPLES = 40, 50
ERAG = "Answer the question from the passage alone, in a few words.\n\nPassage:\n{passage}\n\nQuestion: {question}\n\nAnswer:"
EXTRACT = "List the facts that the text states, one a line behind a dash, each clear without the others. If it states none, reply NONE.\n\nText:\n{text}\n\nFacts:"
VERIFY = "Do the passages support the claim? Reply with one word: SUPPORTED, CONTRADICTED or NEUTRAL.\n\nClaim: {claim}\n\nPassages:\n{passages}\n\nReply:"
NUGGET = "Does the passage state the fact? Reply YES or NO.\n\nFact: {fact}\n\nPassage:\n{passage}\n\nReply:"


def create_run(store: Store, config: Config, dataset: str, index_id: str | None = None, label: str = "", warnings: list[str] | None = None) -> int:
    """Store the configuration and a new run in state ``running``; returns its id, one above the greatest."""
    spark = store.spark
    payload = json.dumps(config.payload(), sort_keys=True)
    store.upsert("configs", spark.createDataFrame([(config.hash(), config.name, payload)], CONFIGS))
    run_id = (store.read("runs", RUNS).agg(F.max("run_id")).first()[0] or 0) + 1
    row = [(run_id, config.hash(), dataset, index_id, label, "running", warnings or config.warnings(), None, None, None)]
    names = [f.split()[0] for f in RUNS.split(", ")][:10]
    made = spark.createDataFrame(row, RUNS.split(", created")[0]).select(*names, F.current_timestamp().alias("created"), F.lit(None).cast("timestamp").alias("finished"))
    store.upsert("runs", made)
    return run_id


def finish_run(store: Store, run_id: int, status: str, n_questions: int, n_failed: int, used: dict[str, Any]) -> None:
    """Set a run's last state."""
    row = store.read("runs", RUNS).where(F.col("run_id") == run_id)
    changed = row.select(
        *[c for c in row.columns if c not in ("status", "n_questions", "n_failed", "usage", "finished")],
        F.lit(status).alias("status"), F.lit(n_questions).cast("long").alias("n_questions"), F.lit(n_failed).cast("long").alias("n_failed"),
        F.lit(json.dumps(used, sort_keys=True)).alias("usage"), F.current_timestamp().alias("finished"),
    )
    store.upsert("runs", store.spark.createDataFrame(changed.select(*row.columns).collect(), row.schema))  # one row


def build_index(store: Store, config: Config, dataset: str, documents: DataFrame, embedder: Embedder | None = None, force: bool = False) -> tuple[str, DataFrame, bool]:
    """(index id, chunks, whether they were there): documents are cut, headed, embedded and written in one plan.

    Indexes of equal chunking and embedder over one dataset are the same.
    ``documents`` is (external_id, title, body, metadata).
    """
    c = config.chunking
    index_id = f"{dataset}-{config.index_hash()}"

    def make() -> DataFrame:
        known = {"title": F.col("title")} | {k: F.col("metadata")[k] for k in ("source", "published_at", "author", "category")}
        fields = {k: known[k] for k in c.header_fields}
        cut = chunking.chunk(documents.withColumnRenamed("external_id", "document_id"), c.strategy, c.chunk_size, c.chunk_overlap, "document_id", "body", fields, c.header_scope)
        chunks = cut.select(F.xxhash64("document_id", "ordinal").alias("chunk_id"), "document_id", "ordinal", "text")
        return chunks if embedder is None else embedder(chunks, prefix=c.document_prefix)

    chunks, reused = store.ensure_index(index_id, make, force, dataset, config.index_hash())
    return index_id, chunks, reused


def run_campaign(
    store: Store, config: Config, dataset: str, documents: DataFrame, questions: DataFrame, provider: Provider, *, embedder: Embedder | None = None,
    user: User | None = None, scorer: Scorer | None = None, limit: int | None = None, label: str = "", split: str = "eval",
) -> int:
    """Index, retrieve, answer and store the questions of a split; returns the run's id.

    Completions, the ranking and the answers are each written once, so that
    what follows reads the same.  A step that fails leaves the run ``failed``.
    """
    index_id, chunks, _ = build_index(store, config, dataset, documents, embedder)
    run_id = create_run(store, config, dataset, index_id, label)
    asked = runs.load_questions(questions, dataset, split, limit).select("question_id", F.col("question").alias("text"))
    recorded = Recorded(provider, store)
    try:
        n = asked.count()
        began = time.perf_counter()
        index, ranking = pipeline.Index(chunks, embedder), None
        if config.generation.prompt_template != "closed_book":
            ranking = store.keep(f"rankings/run_id={run_id}", pipeline.retrieve(index, asked, config, recorded, user, scorer))
        ranked_at = time.perf_counter()
        made = pipeline.predictions(asked, ranking, config, recorded, run_id)
        made = store.keep(f"answers/run_id={run_id}", made)
        took = time.perf_counter()
        ms = [F.lit(int(1000 * x / max(1, n))).cast("int") for x in (ranked_at - began, took - ranked_at)]
        calls = store.read_all("completions", RECORD).select(F.split_part("prompt_id", F.lit(":"), F.lit(2)).cast("long").alias("question_id"), "role", "prompt_tokens", "completion_tokens", "text", "prompt_id", "at")
        mine = calls.join(asked.select("question_id"), "question_id", "left_semi").where(F.col("at") >= store.read("runs", RUNS).where(F.col("run_id") == run_id).first()["created"])
        tokens = mine.where("role = 'generator'").groupBy("question_id").agg(F.max("prompt_tokens").alias("prompt_tokens"), F.max("completion_tokens").alias("completion_tokens"))
        rows = made.join(tokens, "question_id", "left").withColumn("retrieval_ms", ms[0]).withColumn("generation_ms", ms[1])
        store.upsert("predictions", rows.select(*[c for c in _names(PREDICTIONS) if c in rows.columns]))
        failed = made.where("error is not null").count()
        used = {r["role"]: {k: r[k] for k in ("calls", "prompt_tokens", "completion_tokens", "failed")} for r in usage(mine).collect()}  # a row a role
        finish_run(store, run_id, "completed", n, failed, used)
    except Exception:
        finish_run(store, run_id, "failed", 0, 0, {})
        raise
    return run_id


def _names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


@dataclass
class Report:
    """What became of one evaluator: how many scores, what was missing or doubtful, metrics that no question has."""

    evaluator: str
    n_scores: int = 0
    problems: list[str] = field(default_factory=list)
    skipped: bool = False
    empty: list[str] = field(default_factory=list)


def stored_config(store: Store, run_id: int) -> Config:
    """The configuration that a run was made with, from the store and not from a file."""
    run = store.read("runs", RUNS).where(F.col("run_id") == run_id).first()
    if run is None:
        raise ValueError(f"there is no run {run_id}")
    row = store.read("configs", CONFIGS).where(F.col("hash") == run["config_hash"]).first()
    return Config.of({"name": row["name"], **json.loads(row["payload"])})


def load_run(store: Store, run_id: int, questions: DataFrame, options: dict[str, Any] | None = None, judge: str | None = None) -> evaluators.Run:
    """What evaluators look at, from a run's predictions and their questions (question_id, external_id, question, answer, question_type, gold_evidence)."""
    config = stored_config(store, run_id)
    gold = questions.withColumnRenamed("answer", "gold")
    rows = runs.load_predictions(store.read("predictions", PREDICTIONS), gold, run_id)
    if rows.isEmpty():
        raise ValueError(f"run {run_id} has no predictions")
    rows = rows.withColumn("answerable", F.size("gold_evidence") > 0)
    flat = rows.select("question_id", F.explode("contexts").alias("c")).select("question_id", F.col("c.chunk_id").alias("chunk_id"), F.col("c.document_external_id").alias("document_id"), "c.rank", "c.text")
    named = rows.select("question_id", F.posexplode("gold_evidence").alias("fact_id", "e"))
    facts = named.where("e.fact <> ''").select("question_id", "fact_id", F.col("e.fact").alias("fact"))
    return evaluators.Run(
        run_id, rows, flat, named.select("question_id", F.col("e.document_external_id").alias("document_id")), facts, flat.select("question_id", "rank", "text"),
        options=options or {}, judge=judge or config.models.judge, generator=config.models.generator,
    )


def evaluate_run(store: Store, run: evaluators.Run, names: list[str], judge: str | None = None) -> list[Report]:
    """Score a run by each evaluator and store what it gives; one that misses something is skipped, not fatal.

    A judge of its own becomes part of the evaluator's name, so that two judges
    of one run stand beside one another.
    """
    out = []
    for name in names:
        e = evaluators.get(name)
        missing, warnings = evaluators.check(e, run)
        if missing:
            out.append(Report(name, problems=[f"needs {m}" for m in missing] + warnings, skipped=True))
            continue
        rows = evaluators.evaluate(run, [name], judge).withColumn("detail", F.lit(None).cast("string")).select(*_names(SCORES))
        rows = store.keep(f"scored/{name}", rows)
        store.upsert("scores", rows)
        empty = [r["metric"] for r in runs.empty_metrics(rows).collect()]  # a row a metric
        out.append(Report(f"{name}@{judge}" if judge and e.judged else name, rows.count(), warnings, empty=sorted(empty)))
    return out


def judge_nuggets(run: evaluators.Run, provider: Provider) -> DataFrame:
    """(question_id, fact_id, supported) by a judge: one call a fact over the question's passages; a reply that can't be read counts as no."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, PASSAGE_CHARS).alias("t")))), lambda x: x["t"]), "\n\n")
    passages = run.passages.groupBy("question_id").agg(joined.alias("passage"))
    rows = run.facts.select("question_id", "fact_id", F.substring("fact", 1, FACT_CHARS).alias("fact")).join(passages, "question_id", "left").withColumn("passage", F.coalesce("passage", F.lit("")))
    made = pipeline.ask(provider, rows, "judge", ["question_id", "fact_id"], pipeline.filled(NUGGET, fact=F.col("fact"), passage=F.col("passage")))
    return made.select("question_id", "fact_id", (says_yes(F.col("reply")) & (F.col("passage") != "")).alias("supported"))


def _first(rows: DataFrame, samples: int) -> DataFrame:
    return rows.orderBy("question_id").limit(samples)


def erag_utilities(run: evaluators.Run, provider: Provider, samples: int = ERAG_SAMPLES) -> DataFrame:
    """(question_id, rank, utility): how good an answer each passage alone gives; a failed call has none."""
    asked = _first(run.predictions.where("answerable").join(run.passages.select("question_id").distinct(), "question_id", "left_semi"), samples)
    rows = asked.select("question_id", "question", "gold").join(run.passages, "question_id").withColumn("passage", F.substring("text", 1, ERAG_CHARS))
    made = pipeline.ask(provider, rows, "erag", ["question_id", "rank"], pipeline.filled(ERAG, passage=F.col("passage"), question=F.col("question")))
    return made.select("question_id", "rank", utility(F.col("reply"), F.col("gold")).alias("utility"))


def claim_verdicts(run: evaluators.Run, provider: Provider, samples: int = CLAIM_SAMPLES) -> DataFrame:
    """(question_id, side, verdict): claims of answers against their passages, claims of gold answers against the answer.

    Answers that are empty, failed or abstained take no part.
    """
    usable = run.predictions.where("trim(coalesce(answer, '')) <> '' and error is null and not coalesce(abstained, false)")
    rows = _first(usable, samples).select("question_id", F.substring("answer", 1, ANSWER_CHARS).alias("said"), F.substring(F.coalesce("gold", F.lit("")), 1, ANSWER_CHARS).alias("wanted"))
    sides = F.array(F.struct(F.lit("answer").alias("side"), F.col("said").alias("text")), F.struct(F.lit("gold").alias("side"), F.col("wanted").alias("text")))
    texts = rows.select("question_id", "said", F.explode(sides).alias("x")).select("question_id", "said", "x.side", "x.text")
    found = pipeline.ask(provider, texts, "extractor", ["question_id", "side"], pipeline.filled(EXTRACT, text=F.col("text")))
    claims_ = found.select("question_id", "said", "side", F.posexplode(claims(F.col("reply"))).alias("place", "claim"))
    cut = F.struct("rank", F.substring("text", 1, CONTEXT_CHARS).alias("t"))
    contexts = run.passages.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cut)), lambda x: x["t"]), "\n\n").alias("context"))
    against = F.when(F.col("side") == "gold", F.col("said")).otherwise(F.coalesce(F.nullif("context", F.lit("")), F.lit("(no passage)")))
    rows = claims_.join(contexts, "question_id", "left").withColumn("passages", against)
    made = pipeline.ask(provider, rows, "verifier", ["question_id", "side", "place"], pipeline.filled(VERIFY, claim=F.substring("claim", 1, CLAIM_CHARS), passages=F.col("passages")))
    return made.select("question_id", "side", verdict(F.col("reply")).alias("verdict"))


def curve(store: Store, config: Config, dataset: str, documents: DataFrame, questions: DataFrame, ks: list[int], *, embedder: Embedder | None = None, provider: Provider | None = None, split: str = "eval", limit: int | None = None) -> DataFrame:
    """Per-question recall curve of a configuration: one deep ranking, every prefix of it."""
    deep, _ = pool_config(config, max(ks))
    _, chunks, _ = build_index(store, config, dataset, documents, embedder)
    asked = runs.load_questions(questions, dataset, split, limit)
    ranking = store.keep(f"curves/{config.hash()}", pipeline.retrieve(pipeline.Index(chunks, embedder), asked.select("question_id", F.col("question").alias("text")), deep, provider))
    named = asked.select("question_id", F.posexplode("gold_evidence").alias("fact_id", "e"))
    gold = named.select("question_id", F.col("e.document_external_id").alias("document_id"))
    facts = named.where("e.fact <> ''").select("question_id", "fact_id", F.col("e.fact").alias("fact"))
    return recall_curve(ranking, gold, facts, ranking.select("question_id", "rank", "text"), ks)
