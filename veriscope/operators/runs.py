"""Runs and what hangs on them: readers, listings, drill-down, summaries, curves against curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import bootstrap_ci, cohen_kappa, holm, paired_bootstrap

#: Curve metrics that are compared unless others are named.
CURVE_FAMILY = ("doc_recall", "nugget_full_coverage")


def listing(runs: DataFrame, configs: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """Runs with the name of their configuration and, if there are ``datasets`` (dataset, ...), their columns."""
    out = runs.join(configs.select(F.col("hash").alias("config_hash"), F.col("name").alias("config_name")), "config_hash")
    return out if datasets is None else out.join(datasets, "dataset")


def newest(runs: DataFrame, n: int, status: str | None = None) -> DataFrame:
    """The ``n`` newest runs by id, of one status if it is named."""
    rows = runs if status is None else runs.where(F.col("status") == status)
    return rows.orderBy(F.desc("run_id")).limit(n)


def newest_scored(runs: DataFrame, scores: DataFrame, status: str = "completed") -> DataFrame:
    """The newest run of a status that has scores: one row or none."""
    return newest(runs.join(scores.select("run_id").distinct(), "run_id", "left_semi"), 1, status)


def load_questions(questions: DataFrame, dataset: str, split: str = "eval", limit: int | None = None) -> DataFrame:
    """Questions of a split by ``external_id``, so that a limit names the same ones whenever they are loaded."""
    rows = questions.where((F.col("dataset") == dataset) & (F.col("split") == split)).orderBy("external_id")
    return rows.limit(limit) if limit else rows


def load_predictions(predictions: DataFrame, questions: DataFrame, run_id) -> DataFrame:
    """A run's predictions with their question, gold answer and evidence, by question."""
    rows = predictions.where(F.col("run_id") == run_id).drop("run_id")
    asked = questions.select("question_id", *[c for c in questions.columns if c not in rows.columns])
    return rows.join(asked, "question_id").orderBy("question_id")


def document_meta(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(external_id, title, source, published_at) of the documents that ``wanted`` (external_id) names."""
    rows = documents.join(wanted.select("external_id").distinct(), "external_id", "left_semi")
    return rows.select("external_id", "title", F.col("metadata")["source"].alias("source"), F.col("metadata")["published_at"].alias("published_at"))


def article_line(source: Column, published_at: Column, title: Column, blank: bool = False) -> Column:
    """``- source, date: title`` of an article; a field that is null (or with ``blank`` empty) is a question mark, such a date nothing."""
    def known(x: Column) -> Column:
        return F.coalesce(F.nullif(x, F.lit("")) if blank else x, F.lit("?"))

    return F.concat(F.lit("- "), known(source), F.lit(", "), F.substring(F.coalesce(published_at.cast("string"), F.lit("")), 1, 10), F.lit(": "), known(title))


def describe_articles(questions: DataFrame, meta: DataFrame) -> DataFrame:
    """(question_id, articles): a line for each document of ``gold_evidence`` in the order it is first named.

    Documents that ``meta`` lacks give no line; a question without a line says so.
    """
    named = questions.select("question_id", F.posexplode("gold_evidence").alias("pos", "e")).select("question_id", "pos", F.col("e.document_external_id").alias("external_id"))
    first = named.groupBy("question_id", "external_id").agg(F.min("pos").alias("pos"))
    line = F.struct("pos", article_line(F.col("source"), F.col("published_at"), F.col("title"), blank=True).alias("line"))
    lines = first.join(meta, "external_id").groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("articles"))
    return questions.select("question_id").join(lines, "question_id", "left").withColumn("articles", F.coalesce("articles", F.lit("- (no specific article)")))


def import_verdicts(verdicts: DataFrame, scores: DataFrame, predictions: DataFrame, evaluator: str, metric: str, annotator: str) -> DataFrame:
    """Annotation rows (run_id, question_id, metric, value, annotator, notes) of ``verdicts`` (external_id, value, notes).

    A verdict counts for a prediction without an error whose question bears
    the external id and which ``evaluator`` scored on ``metric``.
    """
    scored = scores.where((F.col("evaluator") == evaluator) & (F.col("metric") == metric) & F.col("value").isNotNull()).select("run_id", "question_id").distinct()
    rows = predictions.where("error is null").select("run_id", "question_id", "external_id").join(scored, ["run_id", "question_id"], "left_semi")
    made = rows.join(verdicts, "external_id")
    return made.select("run_id", "question_id", F.lit(metric).alias("metric"), F.col("value").cast("double").alias("value"), F.lit(annotator).alias("annotator"), "notes")


def drill_down(predictions: DataFrame, scores: DataFrame, metrics: list[str]) -> DataFrame:
    """A row a prediction with a column for each ``evaluator/metric`` of ``metrics``; null where it has no score."""
    named = scores.where("question_id is not null and value is not null").select("question_id", F.concat_ws("/", "evaluator", "metric").alias("name"), "value")
    wide = named.groupBy("question_id").pivot("name", metrics).agg(F.first("value"))
    return predictions.join(wide, "question_id", "left")


def dataset_counts(datasets: DataFrame, documents: DataFrame, questions: DataFrame, indexes: DataFrame) -> DataFrame:
    """Datasets with their numbers of documents, questions (all, of the eval split, without an answer) and indexes; 0 where there are none."""
    q = questions.groupBy("dataset").agg(F.count("*").alias("questions"), F.count_if(F.col("split") == "eval").alias("eval_questions"), F.count_if("unanswerable").alias("unanswerable"))
    d = documents.groupBy("dataset").agg(F.count("*").alias("documents"))
    i = indexes.groupBy("dataset").agg(F.count("*").alias("indexes"))
    counts = ["documents", "questions", "eval_questions", "unanswerable", "indexes"]
    out = datasets.join(d, "dataset", "left").join(q, "dataset", "left").join(i, "dataset", "left")
    return out.select(*datasets.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def summarize(scores: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """(run_id, evaluator, metric, mean, ci_low, ci_high, n): intervals of per-question metrics, and aggregates as they are.

    Aggregate rows (no question) have neither interval nor number.
    """
    keys = ["run_id", "evaluator", "metric"]
    per = bootstrap_ci(scores.where("question_id is not null"), keys, replicates, seed)
    none = F.lit(None).cast("double")
    whole = scores.where("question_id is null and value is not null").select(*keys, F.col("value").alias("mean"), none.alias("ci_low"), none.alias("ci_high"), F.lit(None).cast("long").alias("n"))
    return per.select(*whole.columns).unionByName(whole)


def curve_means(curve: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """(metric, k, mean, ci_low, ci_high, n) of curve rows (question_id, k, metric, value), over the questions that define the value."""
    return bootstrap_ci(curve, ["metric", "k"], replicates, seed)


def curve_json(means: DataFrame) -> DataFrame:
    """(curve): one JSON object, metric → k → interval; it has as many entries as ``means`` has rows."""
    point = F.struct(F.col("k").cast("string").alias("k"), F.struct("mean", "ci_low", "ci_high", "n").alias("at"))
    by = means.groupBy("metric").agg(F.array_sort(F.collect_list(point)).alias("points"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("metric", "points"))), lambda x: F.struct(x["metric"], F.map_from_entries(x["points"])))
    return by.agg(F.to_json(F.map_from_entries(every)).alias("curve"))


def compare_curves(a: DataFrame, b: DataFrame, replicates: int, metrics: tuple[str, ...] = CURVE_FAMILY, ks: list[int] | None = None, seed: int = 42) -> DataFrame:
    """Two curves, paired by question at each metric and k; Holm's p over the whole family, and a verdict.

    Questions that either curve lacks or leaves undefined are not paired.
    """
    keys = ["metric", "k"]

    def rows(curve: DataFrame, name: str) -> DataFrame:
        some = curve.where(F.col("metric").isin(*metrics) & F.col("value").isNotNull())
        some = some if ks is None else some.where(F.col("k").isin(*ks))
        return some.select(*keys, "question_id", F.col("value").alias(name))

    pairs = rows(a, "a").join(rows(b, "b"), [*keys, "question_id"])
    out = holm(paired_bootstrap(pairs, keys, replicates, seed), ties=keys)
    better = F.when(F.col("delta") > 0, "B better").otherwise("B worse")
    verdict = F.when(~F.col("significant"), "inconclusive").when(F.col("p_holm") < 0.05, better).otherwise("borderline")
    return out.withColumn("verdict", verdict)


def judge_agreement(annotations: DataFrame, scores: DataFrame) -> DataFrame:
    """(metric, evaluator, n, agreement, kappa) of annotations with scores of the same run, question and metric; negative annotations mean none."""
    human = annotations.where("value >= 0").select("run_id", "question_id", "metric", F.col("value").alias("a"))
    rows = scores.where("question_id is not null and value is not null").select("run_id", "question_id", "metric", "evaluator", F.when(F.col("value") >= 0.5, 1.0).otherwise(0.0).alias("b"))
    return cohen_kappa(human.join(rows, ["run_id", "question_id", "metric"]), ["metric", "evaluator"])


def by_kappa(calibrations: DataFrame) -> DataFrame:
    """``calibrations`` with ``place``: by falling kappa, undefined ones last."""
    kappa = F.when(~F.isnan("kappa"), F.col("kappa"))
    return calibrations.withColumn("place", F.row_number().over(Window.orderBy(kappa.desc_nulls_last(), "metric")))  # one row a metric


def utility_by_rank(utilities: DataFrame) -> DataFrame:
    """(metric, value, n): mean utility of the passages at each rank."""
    rows = utilities.groupBy("rank").agg(F.avg("utility").alias("value"), F.count("*").alias("n"))
    return rows.select(F.concat(F.lit("mean_utility@rank"), F.col("rank").cast("string")).alias("metric"), "value", "n")


def run_means(scores: DataFrame, named: dict[str, str]) -> DataFrame:
    """Aggregate score rows (metric, value, n): of each metric in ``named`` the mean, under its new name; null if no value is defined."""
    name = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])[F.col("metric")]
    rows = scores.where(F.col("metric").isin(*named)).groupBy(name.alias("metric"))
    return rows.agg(F.avg("value").alias("value"), F.count("value").alias("n"))


def empty_metrics(scores: DataFrame) -> DataFrame:
    """(evaluator, metric): metrics that were asked for and for which no question has a value."""
    return scores.where("question_id is not null").groupBy("evaluator", "metric").agg(F.count("value").alias("n")).where("n = 0").select("evaluator", "metric")


def technique_counts(debug: DataFrame) -> DataFrame:
    """(flag, n): how often each ``*_fallback`` or ``*_asked`` column of ``debug`` is true; flags that never are give no row."""
    flags = [c for c in debug.columns if c.endswith(("_fallback", "_asked"))]
    if not flags:
        return debug.select(F.lit("").alias("flag"), F.lit(0).cast("long").alias("n")).limit(0)
    counts = debug.agg(*[F.count_if(F.col(c)).alias(c) for c in flags])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("n")) for c in flags])).alias("x")).select("x.*").where("n > 0")


def pool_sources(pool: DataFrame, dense: DataFrame, lexical: DataFrame, cap: int, threshold: float | None = None) -> DataFrame:
    """(question_id, n_pool, n_dense, n_lexical, distinct_documents, dropped_by_cap, dropped_by_threshold) of a fused pool and its two rankings."""
    per = pool.groupBy("question_id", "document_id").agg(F.count("*").alias("n"), F.count_if(F.lit(False) if threshold is None else F.col("score") < threshold).alias("low"))
    out = per.groupBy("question_id").agg(
        F.sum("n").alias("n_pool"), F.count("*").alias("distinct_documents"), F.sum(F.greatest(F.col("n") - cap, F.lit(0))).alias("dropped_by_cap"), F.sum("low").alias("dropped_by_threshold")
    )
    for name, ranking in (("n_dense", dense), ("n_lexical", lexical)):
        out = out.join(ranking.groupBy("question_id").agg(F.count("*").alias(name)), "question_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
