"""Runs against runs: summaries, comparisons, calibration, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import bootstrap_ci, cohen_kappa, holm, kappa_band, mcnemar, pair, paired_bootstrap


def run_summary(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean, deviation and number of each run's per-question metrics; runs without scores stay."""
    rows = scores.where("question_id is not null")  # before the join, so that unscored runs are kept
    keys = [*runs.columns, "evaluator", "metric"]
    return runs.join(rows.select("run_id", "evaluator", "metric", "value"), "run_id", "left").groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"), F.count("value").alias("n")
    )


def available_metrics(scores: DataFrame) -> DataFrame:
    return scores.where("question_id is not null and value is not null").groupBy("evaluator", "metric").agg(F.count("*").alias("n"))


def common_metrics(scores: DataFrame, a, b) -> DataFrame:
    keys = ["evaluator", "metric"]
    return scores.where(F.col("run_id") == a).select(*keys).intersect(scores.where(F.col("run_id") == b).select(*keys))


def compare_all(scores: DataFrame, a, b, replicates: int, seed: int = 42) -> DataFrame:
    """Every metric that both runs have, in one plan; with McNemar where all values are 0 or 1, and Holm's p."""
    keys = ["metric"]
    rows = scores.where("question_id is not null")
    pairs = pair(rows.where(F.col("run_id") == a), rows.where(F.col("run_id") == b), keys)
    out = paired_bootstrap(pairs, keys, replicates, seed)
    exact = mcnemar(pairs, keys).select("metric", F.col("p_value").alias("p_mcnemar"))
    return holm(out.join(exact, "metric", "left"), ties=["metric"])


def leaderboard(scores: DataFrame, metric: str, replicates: int, seed: int = 42) -> DataFrame:
    """Runs by falling mean of a metric, with intervals."""
    board = bootstrap_ci(scores.where(F.col("metric") == metric), ["run_id"], replicates, seed)
    return board.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean"), "run_id")))  # one row a run


def report(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """A row a run, a column a metric's mean."""
    return scores.groupBy("run_id").pivot("metric", metrics).agg(F.avg("value"))


def calibrate(judged: DataFrame, reference: DataFrame, least: int = 5) -> DataFrame:
    """Agreement of each metric (at 0.5 and above: 1) with reference values rounded half to even; fewer than ``least`` pairs give no row."""
    ref = reference.select("question_id", F.bround("value").alias("b"))
    rows = judged.where("value is not null").select("metric", "question_id", F.when(F.col("value") >= 0.5, 1.0).otherwise(0.0).alias("a")).join(ref, "question_id").where("b is not null")
    rates = rows.groupBy("metric").agg(
        F.avg(((F.col("a") == 1) & (F.col("b") == 0)).cast("double")).alias("false_positive"), F.avg(((F.col("a") == 0) & (F.col("b") == 1)).cast("double")).alias("false_negative")
    )
    out = cohen_kappa(rows, ["metric"]).where(F.col("n") >= least).join(rates, "metric")
    return out.withColumn("verdict", kappa_band(F.col("kappa")))


def regression_gate(scores: DataFrame, floors: DataFrame, replicates: int, least: int = 100, half_width: float = 0.15) -> DataFrame:
    """(metric, ..., passed): the interval's lower bound against the metric's floor, enough rows, narrow enough."""
    rows = bootstrap_ci(scores, ["metric"], replicates).join(F.broadcast(floors), "metric")
    ok = (F.col("ci_low") >= F.col("floor")) & (F.col("n") >= least) & ((F.col("ci_high") - F.col("ci_low")) / 2 <= half_width)
    return rows.withColumn("passed", ok)


def failure_kinds(hit_rate, correct, abstained, answerable, error):
    """A question's kind of failure as a column."""
    return (
        F.when(error.isNotNull(), "technical_error").when(answerable & abstained, "unjustified_abstention").when(answerable & (hit_rate == 0), "retrieval_failed")
        .when(answerable & (correct == 0), "wrong_answer").otherwise("ok")
    )
