"""Metrics of rankings and answers, as long score rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import abstained, contains_gold, exact_match, nugget_tokens, support, token_f1

FULL = 0.999


def document_hits(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, document_id, rank, hit, n_gold): distinct documents of answerable questions, by best rank.

    A question with gold but no ranking stays, with a null document.
    """
    order = Window.partitionBy("question_id").orderBy("best")
    docs = ranking.groupBy("question_id", "document_id").agg(F.min("rank").alias("best"))
    docs = docs.withColumn("rank", F.row_number().over(order)).drop("best")
    wanted = gold.select("question_id", "document_id").distinct()
    sizes = wanted.groupBy("question_id").agg(F.count("*").alias("n_gold"))
    flagged = docs.join(wanted.withColumn("gold", F.lit(True)), ["question_id", "document_id"], "left")
    return sizes.join(flagged, "question_id", "left").select("question_id", "document_id", "rank", F.coalesce("gold", F.lit(False)).alias("hit"), "n_gold")


def usable_ks(hits: DataFrame, ks: list[int]) -> list[int]:
    """The ks up to the longest list of distinct documents; that length (or 1) if none is."""
    longest = hits.agg(F.max("rank")).first()[0] or 0
    return [k for k in ks if k <= longest] or [longest or 1]


def ir_metrics(ranking: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(question_id, metric, value): recall, precision, hit rate and nDCG at each k, and MRR; answerable questions only."""
    hits = document_hits(ranking, gold)
    sums = []
    for k in ks:
        inside = F.col("hit") & (F.col("rank") <= k)
        n = F.count_if(inside)
        gain = F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, r: acc + 1 / F.log2(r + 1.0))
        sums += [n.alias(f"n{k}"), gain.alias(f"g{k}"), F.first(ideal).alias(f"i{k}")]
    row = hits.groupBy("question_id").agg(F.first("n_gold").alias("n_gold"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), *sums)
    values: list[tuple[str, Column]] = [("mrr", F.coalesce(1.0 / F.col("first"), F.lit(0.0)))]
    for k in ks:
        n = F.col(f"n{k}")
        values += [
            (f"recall@{k}", n / F.col("n_gold")), (f"precision@{k}", n / F.lit(k)),
            (f"hit_rate@{k}", (n > 0).cast("double")), (f"ndcg@{k}", F.col(f"g{k}") / F.col(f"i{k}")),
        ]
    return long_form(row, ["question_id"], values)


def long_form(rows: DataFrame, keys: list[str], values: list[tuple[str, Column]]) -> DataFrame:
    """One row (keys, metric, value) for each value."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values])
    return rows.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric", "m.value")


def retrieval_debug(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, gold, retrieved, hit, missed), sorted arrays of documents."""
    wanted = gold.groupBy("question_id").agg(F.sort_array(F.collect_set("document_id")).alias("gold"))
    got = ranking.groupBy("question_id").agg(F.sort_array(F.collect_set("document_id")).alias("retrieved"))
    out = wanted.join(got, "question_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array_except("gold", "gold")))
    return out.select("*", F.array_intersect("gold", "retrieved").alias("hit"), F.array_except("gold", "retrieved").alias("missed"))


def answer_metrics(predictions: DataFrame) -> DataFrame:
    """(question_id, metric, value) of predictions (question_id, answer, gold, answerable).

    Answerable: em, contains, token_f1, false_abstention.  Others: negative_rejection.
    """
    gone = F.coalesce(F.col("abstained"), abstained(F.col("answer"))) if "abstained" in predictions.columns else abstained(F.col("answer"))
    p, g = F.col("answer"), F.col("gold")
    values = [
        ("em", exact_match(p, g)), ("contains", contains_gold(p, g)), ("token_f1", token_f1(p, g)), ("false_abstention", gone),
        ("negative_rejection", gone),
    ]
    rows = long_form(predictions, ["question_id", "answerable"], values)
    return rows.where((F.col("metric") == "negative_rejection") != F.col("answerable")).drop("answerable")


def accuracy_by_type(predictions: DataFrame) -> DataFrame:
    """Accuracy of each question type beside that of always giving its commonest gold answer; answerable questions.

    Of equally common answers the one met first by question id counts.
    """
    rows = predictions.where("answerable").withColumn("right", contains_gold(F.col("answer"), F.col("gold")).cast("double")).withColumn("g", F.lower("gold"))
    per = rows.groupBy("question_type", "g").agg(F.count("*").alias("n"), F.min("question_id").alias("first"), F.sum("right").alias("right"))
    order = Window.partitionBy("question_type").orderBy(F.desc("n"), "first")
    top = per.withColumn("r", F.row_number().over(order)).where("r <= 1").select("question_type", F.col("g").alias("majority"), F.col("n").alias("majority_n"))
    sums = per.groupBy("question_type").agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.bool_and(F.col("g").isin("yes", "no")).alias("binary"))
    return sums.join(top, "question_type").select(
        "question_type", "n", (F.col("right") / F.col("n")).alias("accuracy"), "majority", (F.col("majority_n") / F.col("n")).alias("majority_accuracy"), "binary"
    )


def answer_statistics(predictions: DataFrame) -> DataFrame:
    """Number of rows, abstentions, errors, and the upper median of answer lengths (the element at n / 2), all rows as one."""
    length = F.length(F.coalesce("answer", F.lit("")))
    counts = predictions.groupBy(length.alias("chars")).agg(
        F.count("*").alias("n"), F.count_if(abstained(F.col("answer"))).alias("abstained"), F.count_if(F.col("answer").isNull()).alias("errors")
    )  # one row a length
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("chars")))
    totals = counts.agg(F.sum("n").alias("n"), F.sum("abstained").alias("n_abstained"), F.sum("errors").alias("n_errors"))
    return upto.crossJoin(F.broadcast(totals.withColumnRenamed("n", "all"))).where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("all", "n_abstained", "n_errors").agg(
        F.min("chars").alias("median_chars")
    ).withColumnRenamed("all", "n")


def nugget_support(facts: DataFrame, passages: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(question_id, fact_id, best, supported, best_rank): lexical support of each fact by its question's passages; 0 without any."""
    f = facts.select("question_id", "fact_id", nugget_tokens(F.col("fact")).alias("f"))
    p = passages.select("question_id", "rank", nugget_tokens(F.col("text")).alias("p"))
    share = F.coalesce(support(F.col("f"), F.col("p")), F.lit(0.0))
    both = f.join(p, "question_id", "left").select("question_id", "fact_id", "rank", share.alias("share"))
    out = both.groupBy("question_id", "fact_id").agg(F.max("share").alias("best"), F.max_by("rank", F.struct("share", -F.col("rank"))).alias("best_rank"))
    return out.select("question_id", "fact_id", "best", (F.col("best") >= threshold).alias("supported"), "best_rank")


def nugget_recall(support_rows: DataFrame) -> DataFrame:
    """(question_id, metric, value): share of facts supported, and whether all are."""
    row = support_rows.groupBy("question_id").agg(F.avg(F.col("supported").cast("double")).alias("r"))
    return long_form(row, ["question_id"], [("nugget_recall", F.col("r")), ("nugget_full_coverage", F.col("r") >= FULL)])


def missing_facts(support_rows: DataFrame, facts: DataFrame, most: int = 5, width: int = 200) -> DataFrame:
    """(question_id, missing): the first facts without support, cut to ``width``; an empty array if there are none."""
    rows = support_rows.join(facts.select("question_id", "fact_id", "fact"), ["question_id", "fact_id"])
    lost = F.collect_list(F.when(~F.col("supported"), F.struct("fact_id", F.substring("fact", 1, width).alias("fact"))))
    return rows.groupBy("question_id").agg(F.transform(F.slice(F.array_sort(lost), 1, most), lambda x: x["fact"]).alias("missing"))


def _grid(ranking: DataFrame, ks: list[int]) -> DataFrame:
    return F.broadcast(ranking.sparkSession.createDataFrame([(k,) for k in ks], "k int"))  # a few rows


def _document_prefixes(ranking: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(question_id, k, n_gold, n): gold documents among the first ``k`` passages."""
    wanted = gold.select("question_id", "document_id").distinct()
    n_gold = wanted.groupBy("question_id").agg(F.count("*").alias("n_gold"))
    first = ranking.groupBy("question_id", "document_id").agg(F.min("rank").alias("rank")).join(wanted, ["question_id", "document_id"])
    found = n_gold.join(first, "question_id", "left").crossJoin(_grid(ranking, ks))
    return found.groupBy("question_id", "k", "n_gold").agg(F.count_if(F.col("rank") <= F.col("k")).alias("n"))


def _of_documents() -> list[tuple[str, Column]]:
    return [("doc_recall", F.col("n") / F.col("n_gold")), ("hit_rate", F.col("n") > 0)]


def document_curve(ranking: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(question_id, k, metric, value): doc_recall and hit_rate of every prefix of ``k`` passages."""
    return long_form(_document_prefixes(ranking, gold, ks), ["question_id", "k"], _of_documents())


def recall_curve(ranking: DataFrame, gold: DataFrame, facts: DataFrame, passages: DataFrame, ks: list[int]) -> DataFrame:
    """(question_id, k, metric, value) of every prefix of ``k`` passages of one ranking.

    doc_recall and hit_rate need gold; nugget metrics need facts, and are null
    without.
    """
    tokens = passages.select("question_id", "rank", nugget_tokens(F.col("text")).alias("p"))
    f = facts.select("question_id", "fact_id", nugget_tokens(F.col("fact")).alias("f"))
    share = F.when(support(F.col("f"), F.col("p")) >= 0.6, F.col("rank"))
    ranks = f.join(tokens, "question_id", "left").groupBy("question_id", "fact_id").agg(F.min(share).alias("rank"))
    nuggets = ranks.crossJoin(_grid(ranking, ks)).groupBy("question_id", "k").agg(F.avg(F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("double")).alias("r"))
    row = _document_prefixes(ranking, gold, ks).join(nuggets, ["question_id", "k"], "left")
    return long_form(row, ["question_id", "k"], [*_of_documents(), ("nugget_recall", F.col("r")), ("nugget_full_coverage", F.col("r") >= FULL)])


def erag(utilities: DataFrame) -> DataFrame:
    """(question_id, metric, value) of utilities (question_id, rank, utility): graded nDCG, best utility and its rank."""
    order = Window.partitionBy("question_id").orderBy(F.desc("utility"), "rank")
    rows = utilities.withColumn("ideal", F.row_number().over(order))
    row = rows.groupBy("question_id").agg(
        F.sum(F.col("utility") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(F.col("utility") / F.log2(F.col("ideal") + 1.0)).alias("best_dcg"),
        F.max("utility").alias("best"), F.min_by("rank", "ideal").alias("at"),
    )
    ndcg = F.when(F.col("best_dcg") > 0, F.col("dcg") / F.col("best_dcg")).otherwise(0.0)
    return long_form(row, ["question_id"], [("erag_ndcg", ndcg), ("erag_best_utility", F.col("best")), ("erag_best_rank", F.col("at"))])


def utility(completion: Column, gold: Column) -> Column:
    """1 if the answer holds the gold one, else its token F1 to four digits; 0 for a failed call."""
    return F.when(completion.isNull(), 0.0).when(contains_gold(completion, gold), 1.0).otherwise(F.round(token_f1(completion, gold), 4))


def claim_metrics(verdicts: DataFrame) -> DataFrame:
    """(question_id, metric, value) of verdicts (question_id, side, verdict), side ``answer`` or ``gold``.

    claim_precision: supported of judged; context_utilization: supported of
    all; claim_recall: covered of gold claims.  Null where undefined.
    """
    answer, gold, yes = F.col("side") == "answer", F.col("side") == "gold", F.col("verdict") == "SUPPORTED"
    judged = answer & F.coalesce(F.col("verdict") != "UNPARSED", F.lit(False))
    row = verdicts.groupBy("question_id").agg(
        F.count_if(answer & yes).alias("s"), F.count_if(judged).alias("j"), F.count_if(answer).alias("n"), F.count_if(gold & yes).alias("c"), F.count_if(gold).alias("g")
    )
    return long_form(row, ["question_id"], [
        ("claim_precision", F.try_divide("s", "j")), ("context_utilization", F.try_divide("s", "n")), ("claim_recall", F.try_divide("c", "g")),
    ])


def attribution(precision: Column, recall: Column) -> Column:
    """Which part is to blame for a run's claims."""
    return F.when((precision >= 0.7) & (recall < 0.5), "retrieval").when(precision < 0.5, "generator").otherwise("none")


def run_aggregates(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, number scored, number of rows and coverage of each metric; undefined values are counted, not averaged."""
    return scores.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.count("value").alias("n_scored"), F.count("*").alias("n_submitted"), (F.count("value") / F.count("*")).alias("coverage")
    )


def pass_rates(scores: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg("value").alias("mean"), F.avg((F.col("value") >= threshold).cast("double")).alias("pass_rate"), (F.count("value") / F.count("*")).alias("coverage"))


def align_by_text(predictions: DataFrame, results: DataFrame, text: str = "question") -> tuple[DataFrame, DataFrame]:
    """(results with ``question_id`` found by the question's text, results without); of equal questions the last counts."""
    last = predictions.groupBy(text).agg(F.max("question_id").alias("question_id"))
    return results.join(last, text), results.join(last, text, "left_anti")
