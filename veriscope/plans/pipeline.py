"""From questions to predictions: the retrieval order and generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators.runs import article_line
from .config import Config
from .models import Embedder, Provider, Scorer, User

# What the query techniques ask.
REWRITE = "Rewrite the question as a short search query. Reply with the query only.\n\nQuestion: {question}\n\nQuery:"
DECOMPOSE = "Split the question into at most {n} simpler search queries, one per line.\n\nQuestion: {question}\n\nQueries:"
HYDE = "Write a short passage that could answer the question.\n\nQuestion: {question}\n\nPassage:"
CLARIFY = (
    "A user asked a search assistant the question below. These are the articles the first search found (source, date, title):\n{candidates}\n\n"
    "If the question clearly identifies which articles are needed, reply exactly: NONE\nOtherwise, ask the user one short clarifying question "
    "that would help pick the right articles.\nReply with NONE or with the question only.\n\nQuestion: {question}\n\nReply:"
)
USER = (
    "You asked a search assistant the question below. You know which articles you have in mind, but you do not know the answer.\n\n"
    "Your question: {question}\n\nThe articles you have in mind:\n{articles}\n\nThe assistant asks you: {clarifying}\n\n"
    "Reply in one short sentence, only with what you know about which articles you mean. Never answer your own question.\n\nReply:"
)
GRADE = "Grade from 0 to 3 how useful the passage is for the question. Reply with one digit.\n\nQuestion: {question}\n\nPassage:\n{passage}\n\nGrade:"


class Index:
    """Chunks (chunk_id, document_id, text[, vector]) that are searched."""

    def __init__(self, chunks: DataFrame, embedder: Embedder | None = None) -> None:
        self.chunks, self.embedder = chunks, embedder


def ask(provider: Provider, rows: DataFrame, role: str, key: list[str], prompt) -> DataFrame:
    """``rows`` with ``reply``: the completion of a prompt for each, null if it failed."""
    prompt_id = F.concat(F.lit(f"{role}:"), F.concat_ws(":", *[F.col(k).cast("string") for k in key]))
    made = rows.withColumn("prompt_id", prompt_id)
    done = provider(made.select("prompt_id", F.lit(role).alias("role"), prompt.alias("prompt")).distinct())
    return made.join(done.select("prompt_id", F.col("text").alias("reply")), "prompt_id", "left").drop("prompt_id")


def filled(template: str, **columns):
    """A template with columns in its braces."""
    parts, rest = [], template
    for name, column in columns.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [F.lit(before), column]
    return F.concat(*parts, F.lit(rest))


def search(index: Index, questions: DataFrame, config: Config, k: int) -> DataFrame:
    """A ranking of (question_id, text[, dense_text, vector]) by the configuration's mode."""
    r, runs = config.retrieval, []
    if r.mode != "lexical":
        asked = questions
        if "vector" not in questions.columns:
            dense_text = F.coalesce("dense_text", "text") if "dense_text" in questions.columns else F.col("text")
            asked = index.embedder(questions.select("question_id", dense_text.alias("text")), prefix=r.query_prefix)
        runs.append(R.dense(asked, index.chunks, k))
    if r.mode != "dense":
        runs.append(R.lexical(questions, index.chunks, k))
    return runs[0] if len(runs) == 1 else R.fuse(runs, k, r.rrf_k)


def _header(text, name: str):
    """The last value of a header's field in the first four lines of a passage, or null."""
    lines = F.filter(F.slice(T._lines(text), 1, 4), lambda x: x.startswith(f"{name}: "))
    return F.substring(F.try_element_at(lines, F.lit(-1)), F.lit(len(name) + 3), F.length(text))


def candidate_lines(ranking: DataFrame, most: int = 8) -> DataFrame:
    """(question_id, candidates): source, date and title of the best documents of a ranking with texts, a line each."""
    best = R.renumber(ranking.groupBy("question_id", "document_id").agg(F.min(F.struct("rank", "text")).alias("b")).select("question_id", F.col("b.rank").alias("rank"), "b.text"))
    source, date, title = (_header(F.col("text"), x) for x in ("Source", "Published", "Title"))
    line = F.struct("rank", article_line(source, date, title).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])
    return best.where(F.col("rank") <= most).groupBy("question_id").agg(F.array_join(lines, "\n").alias("candidates"))


def simulated_user(provider: Provider, articles: DataFrame) -> User:
    """Replies by a model that knows the ``articles`` of a question but not its answer.

    ``articles`` is (question_id, articles) as ``describe_articles`` gives it,
    or (question_id, title, source, published_at), a row an article.
    """
    known = articles
    if "articles" not in articles.columns:
        line = article_line(F.col("source"), F.col("published_at"), F.col("title"))
        known = articles.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("articles"))

    def reply(asked: DataFrame) -> DataFrame:
        rows = asked.join(known, "question_id", "left").withColumn("articles", F.coalesce("articles", F.lit("- (no specific article)")))
        prompt = filled(USER, question=F.col("question"), articles=F.col("articles"), clarifying=F.col("clarifying"))
        return ask(provider, rows, "simulated_user", ["question_id"], prompt).select("question_id", "reply")

    return reply


def _clarified(index: Index, ranking: DataFrame, questions: DataFrame, config: Config, provider: Provider, user: User) -> DataFrame:
    """``ranking``, fused with that of question and reply where the user was asked and replied."""
    r, pool = config.retrieval, config.retrieval.pool_size()
    lines = candidate_lines(ranking.join(index.chunks.select("chunk_id", "document_id", "text"), "chunk_id"))
    rows = questions.select("question_id", F.col("text").alias("question")).join(lines, "question_id")
    made = ask(provider, rows, "clarifier", ["question_id"], filled(CLARIFY, candidates=F.col("candidates"), question=F.col("question")))
    asked = made.where(T.wants_clarification(F.col("reply"))).select("question_id", "question", T.strip(F.col("reply")).alias("clarifying"))
    replies = user(asked).select("question_id", T.strip(F.col("reply")).alias("reply")).where("reply <> ''")
    # kept, so that both parts below see the same replies
    more = asked.join(replies, "question_id").select("question_id", F.concat_ws(" ", "question", "reply").alias("text")).persist()
    first = ranking.join(more.select("question_id"), "question_id", "left_semi")
    fused = R.fuse([first, search(index, more, config, pool)], pool, r.rrf_k)
    return ranking.join(more.select("question_id"), "question_id", "left_anti").select("question_id", "chunk_id", "score", "rank").unionByName(fused)


def retrieve(
    index: Index, questions: DataFrame, config: Config, provider: Provider | None = None, user: User | None = None, scorer: Scorer | None = None
) -> DataFrame:
    """(question_id, chunk_id, document_id, text, score, rank) in the order rewrite, HyDE, search, clarification, sub-queries, rerank, cap, cut, threshold.

    A technique whose call fails falls back to the question itself.  ``clarify``
    needs a ``user`` who replies, ``rerank=cross_encoder`` a ``scorer``.  With
    ``rerank=llm`` a column ``rerank_failed`` marks questions none of whose
    passages was graded; :func:`predictions` counts them as failed.
    """
    r = config.retrieval
    if r.clarify and user is None:
        raise ValueError("clarify needs a user who replies")
    if r.rerank == "cross_encoder" and scorer is None:
        raise ValueError("rerank=cross_encoder needs a scorer")
    pool = r.pool_size()
    asked = questions
    if r.query_rewrite:
        asked = ask(provider, asked, "rewriter", ["question_id"], filled(REWRITE, question=F.col("text")))
        asked = asked.withColumn("text", F.coalesce(F.nullif(T.strip(F.col("reply")), F.lit("")), F.col("text"))).drop("reply", "vector")
    if r.hyde:
        asked = ask(provider, asked, "hyde", ["question_id"], filled(HYDE, question=F.col("text")))
        asked = asked.withColumn("dense_text", F.nullif(T.strip(F.col("reply")), F.lit(""))).drop("reply", "vector")
    ranking = search(index, asked, config, pool)
    if r.clarify:
        ranking = _clarified(index, ranking, questions, config, provider, user)
    if r.query_decompose:
        subs = ask(provider, asked, "decomposer", ["question_id"], filled(DECOMPOSE.replace("{n}", str(r.max_sub_queries)), question=F.col("text")))
        subs = subs.select("question_id", F.posexplode(T.sub_queries(F.coalesce("reply", F.lit("")), r.max_sub_queries)).alias("n", "text"))
        runs = [ranking]
        for n in range(r.max_sub_queries):
            runs.append(search(index, subs.where(F.col("n") == n).select("question_id", "text"), config, pool))
        ranking = R.fuse(runs, pool, r.rrf_k)
    # texts join once candidates are few
    ranking = ranking.join(index.chunks.select("chunk_id", "document_id", "text"), "chunk_id")
    ranking = ranking.withColumn("dense_score", F.col("score"))
    if r.rerank == "cross_encoder":
        pairs = ranking.select("question_id", "chunk_id", "rank", "text").join(questions.select("question_id", F.col("text").alias("question")), "question_id")
        ranking = R.rerank(ranking, scorer(pairs, r.rerank_model).select("question_id", "chunk_id", F.col("score").alias("grade")))
        ranking = ranking.withColumn("score", F.col("grade")).drop("grade")
    elif r.rerank == "llm":
        prompt = filled(GRADE, question=F.col("question"), passage=F.substring("text", 1, 2000))
        graded = ask(provider, ranking.join(questions.select("question_id", F.col("text").alias("question")), "question_id"), "reranker", ["question_id", "chunk_id"], prompt)
        ranking = R.rerank(ranking, graded.select("question_id", "chunk_id", T.rerank_grade(F.col("reply")).alias("grade")))
        none = F.count("grade").over(Window.partitionBy("question_id")) == 0
        ranking = ranking.withColumn("rerank_failed", none).withColumn("score", F.coalesce(F.col("grade").cast("double"), "score")).drop("grade")
    if r.max_per_document:
        ranking = R.renumber(R.cap_per_document(ranking, r.max_per_document))
    ranking = ranking.where(F.col("rank") <= r.top_k)
    if r.similarity_threshold is not None and r.mode == "dense":
        ranking = R.at_least(ranking, r.similarity_threshold, "dense_score")
    return R.renumber(ranking).drop("dense_score")


def generate(questions: DataFrame, ranking: DataFrame | None, config: Config, provider: Provider) -> DataFrame:
    """(question_id, answer, abstained, error): a question without passages abstains without a call; an empty answer is an error."""
    g = config.generation
    closed = g.prompt_template == "closed_book"
    rows = questions.select("question_id", F.col("text").alias("question"))
    if closed:
        rows = rows.withColumn("context", F.lit(""))
    else:
        rows = rows.join(R.pack_context(ranking).select("question_id", "context"), "question_id", "left")
    asked = ask(provider, rows.where("context is not null"), "generator", ["question_id"], T.prompt(g.prompt_template, F.col("question"), F.col("context"), g.allow_abstain))
    reply = F.nullif(T.strip(F.coalesce("reply", F.lit(""))), F.lit(""))
    answer = T.final_answer(reply) if g.prompt_template == "decompose" else reply
    error = F.when(F.col("reply").isNull(), "call failed").when(reply.isNull(), "empty answer")
    made = asked.select("question_id", answer.alias("answer"), error.alias("error"))
    none = rows.where("context is null").select("question_id", F.lit(T.ABSTAIN).alias("answer"), F.lit(None).cast("string").alias("error"))
    return made.unionByName(none).withColumn("abstained", T.abstained(F.col("answer")))


def predictions(questions: DataFrame, ranking: DataFrame | None, config: Config, provider: Provider, run_id: int) -> DataFrame:
    """Predictions of a run from its ranking: contexts in rank order, answer, abstention, error."""
    made = generate(questions, ranking, config, provider)
    if ranking is not None and "rerank_failed" in ranking.columns:
        bad = ranking.where("rerank_failed").select("question_id").distinct().withColumn("bad", F.lit("rerank failed"))
        made = made.join(bad, "question_id", "left").withColumn("answer", F.when(F.col("bad").isNull(), F.col("answer"))).withColumn("error", F.coalesce("bad", "error")).drop("bad")
    if ranking is None:
        empty = "array<struct<chunk_id: bigint, document_external_id: string, text: string, score: double, rank: int, source: string>>"
        return made.select(F.lit(run_id).cast("long").alias("run_id"), "*", F.array().cast(empty).alias("contexts"))
    item = F.struct("rank", "chunk_id", F.col("document_id").cast("string").alias("document_external_id"), "text", F.round("score", 6).alias("score"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(
        x["chunk_id"].alias("chunk_id"), x["document_external_id"].alias("document_external_id"), x["text"].alias("text"), x["score"].alias("score"),
        x["rank"].alias("rank"), F.lit(config.retrieval.mode).alias("source"),
    ))
    contexts = ranking.groupBy("question_id").agg(ordered.alias("contexts"))
    none = F.array().cast(contexts.schema["contexts"].dataType)
    return made.join(contexts, "question_id", "left").select(F.lit(run_id).cast("long").alias("run_id"), *made.columns, F.coalesce("contexts", none).alias("contexts"))


def campaign(index: Index, questions: DataFrame, config: Config, provider: Provider, run_id: int, user: User | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Predictions of a run in one plan; :func:`veriscope.runner.run_campaign` keeps each step in a store."""
    ranking = None if config.generation.prompt_template == "closed_book" else retrieve(index, questions, config, provider, user, scorer)
    return predictions(questions, ranking, config, provider, run_id)
