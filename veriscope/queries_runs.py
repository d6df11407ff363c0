"""Queries over runs, curves, techniques and fused rankings, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import text as T
from .operators import compare as P
from .operators import metrics as M
from .operators import retrieval as R
from .operators import runs as U
from .plans import pipeline as PL
from .plans.config import Config, Generation, Retrieval
from .plans.models import Canned
from .queries import query, rounded, table

# The relations that the tables stand for: orders are runs, customers configurations, nations datasets.

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END"
RUNS = f"runs AS (SELECT o_orderkey AS run_id, o_custkey AS config_hash, (o_custkey % 25)::INT AS dataset, {_STATUS} AS status FROM orders)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("config_hash"), (F.col("o_custkey") % 25).cast("int").alias("dataset"), status.alias("status"))


def configs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("hash"), F.col("c_name").alias("name"))


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("dataset"), F.col("n_name").alias("dataset_name"))


@query(
    f"""WITH {RUNS} SELECT run_id, dataset, status, c_name AS config_name, n_name AS dataset_name FROM runs JOIN customer ON c_custkey = config_hash JOIN nation ON n_nationkey = dataset
    WHERE status = 'completed' ORDER BY run_id DESC LIMIT 50"""
)
def run_listing(spark: SparkSession, sf: str) -> DataFrame:
    rows = U.newest(U.listing(runs(spark, sf), configs(spark, sf), datasets(spark, sf)), 50, "completed")
    return rows.select("run_id", "dataset", "status", "config_name", "dataset_name")


@query(f"WITH {RUNS} SELECT run_id, config_hash, status FROM runs WHERE status = 'completed' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = run_id AND l_quantity > 49) ORDER BY run_id DESC LIMIT 1")
def newest_scored_run(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("run_id"))
    return U.newest_scored(runs(spark, sf), scored).select("run_id", "config_hash", "status")


@query(
    f"""WITH {RUNS} SELECT n_nationkey AS dataset, n_name AS dataset_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS documents, (SELECT count(*) FROM runs WHERE dataset = n_nationkey) AS questions,
    (SELECT count(*) FROM runs WHERE dataset = n_nationkey AND status = 'completed') AS eval_questions, (SELECT count(*) FROM runs WHERE dataset = n_nationkey AND status = 'failed') AS unanswerable,
    (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS indexes FROM nation"""
)
def dataset_counts(spark: SparkSession, sf: str) -> DataFrame:
    asked = runs(spark, sf).select("dataset", F.when(F.col("status") == "completed", "eval").otherwise("pool").alias("split"), (F.col("status") == "failed").alias("unanswerable"))
    documents = table(spark, sf, "customer").select(F.col("c_nationkey").alias("dataset"))
    indexes = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("dataset"))
    return U.dataset_counts(datasets(spark, sf), documents, asked, indexes)


@query("SELECT format('q-{:06d}', item_id) AS external_id, item_id AS question_id, length(text)::INT AS chars FROM benchmark WHERE item_id % 3 <> 0 ORDER BY external_id LIMIT 20")
def load_questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select(
        F.lit("bench").alias("dataset"), F.when(F.col("item_id") % 3 != 0, "eval").otherwise("pool").alias("split"), F.format_string("q-%06d", "item_id").alias("external_id"), F.col("item_id").alias("question_id"), "text"
    )
    return U.load_questions(rows, "bench", limit=20).select("external_id", "question_id", F.length("text").alias("chars"))


@query(f"WITH {Q.PREDICTIONS} SELECT question_id, answer, 'c-' || question_id AS external_id, md5(question) AS question, gold AS gold_answer, question_type FROM predictions WHERE answerable")
def load_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.predictions(spark, sf)
    made = rows.select(F.when(F.col("answerable"), 1).otherwise(2).alias("run_id"), "question_id", "answer")
    asked = rows.select("question_id", F.concat(F.lit("c-"), F.col("question_id").cast("string")).alias("external_id"), F.md5(F.col("question").cast("binary")).alias("question"), F.col("gold").alias("gold_answer"), "question_type")
    return U.load_predictions(made, asked, 1)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("published_at"), F.concat(F.lit("2024-01-02T"), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("external_id"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), meta.alias("metadata"))


_META = "meta AS (SELECT 'd' || doc_id AS external_id, 'T' || doc_id AS title, source, '2024-01-02T' || doc_id AS published_at FROM documents WHERE doc_id IN (SELECT item_id * 7 FROM benchmark UNION SELECT item_id + 1 FROM benchmark))"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    def item(n: Column) -> Column:
        return F.struct(F.concat(F.lit("d"), n.cast("string")).alias("document_external_id"), F.lit(None).cast("string").alias("fact"))

    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(i.alias("question_id"), F.array(item(i * 7), item(i + 1), item(i * 7), item(i + 9_000_000_000)).alias("gold_evidence"))


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    ids = _named(spark, sf).select(F.explode("gold_evidence").alias("e")).select(F.col("e.document_external_id").alias("external_id"))
    return U.document_meta(_documents(spark, sf), ids)


@query(f"WITH {_META} SELECT * FROM meta")
def document_meta(spark: SparkSession, sf: str) -> DataFrame:
    return _meta(spark, sf)


@query(
    f"""WITH {_META}, named AS (SELECT item_id AS question_id, unnest([0, 1, 2, 3]) AS pos, unnest(['d' || (item_id * 7), 'd' || (item_id + 1), 'd' || (item_id * 7), 'd' || (item_id + 9000000000)]) AS external_id FROM benchmark),
    first AS (SELECT question_id, external_id, min(pos) AS pos FROM named GROUP BY 1, 2),
    lines AS (SELECT question_id, string_agg('- ' || coalesce(nullif(source, ''), '?') || ', ' || substr(published_at, 1, 10) || ': ' || title, chr(10) ORDER BY pos) AS articles FROM first JOIN meta USING (external_id) GROUP BY 1)
    SELECT item_id AS question_id, coalesce(articles, '- (no specific article)') AS articles FROM benchmark b LEFT JOIN lines l ON l.question_id = b.item_id"""
)
def describe_articles(spark: SparkSession, sf: str) -> DataFrame:
    return U.describe_articles(_named(spark, sf), _meta(spark, sf))


_HEADED = "'Title: T' || document_id || chr(10) || 'Source: S' || (document_id % 5) || chr(10) || 'Published: 2024-03-0' || (1 + document_id % 9) || 'T08' || chr(10) || 'body'"


@query(
    f"""WITH {Q.DENSE}, docs AS (SELECT question_id, document_id, min(rank) AS rank FROM ranking GROUP BY 1, 2),
    lines AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS n, '- S' || (document_id % 5) || ', 2024-03-0' || (1 + document_id % 9) || ': T' || document_id AS line FROM docs)
    SELECT question_id, string_agg(line, chr(10) ORDER BY n) AS candidates FROM lines WHERE n <= 4 GROUP BY 1"""
)
def candidate_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("document_id")
    head = F.concat(F.lit("Title: T"), d.cast("string"), F.lit("\nSource: S"), (d % 5).cast("string"), F.lit("\nPublished: 2024-03-0"), (d % 9 + 1).cast("string"), F.lit("T08\nbody"))
    return PL.candidate_lines(Q.dense_documents(spark, sf).withColumn("text", head), 4)


@query(
    f"""WITH {Q.PREDICTIONS}, v AS (SELECT 'c-' || question_id AS external_id, (question_id % 3)::DOUBLE AS value, 'n' || question_id AS notes FROM predictions WHERE question_id % 2 = 0)
    SELECT 1::BIGINT AS run_id, question_id, 'contains' AS metric, value, 'frozen' AS annotator, notes FROM predictions p JOIN v ON v.external_id = 'c-' || p.question_id WHERE answer IS NOT NULL AND answerable"""
)
def import_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.predictions(spark, sf)
    made = rows.select(F.lit(1).cast("long").alias("run_id"), "question_id", F.concat(F.lit("c-"), F.col("question_id").cast("string")).alias("external_id"), F.when(F.col("answer").isNull(), "failed").alias("error"))
    scores = M.answer_metrics(rows).select(F.lit(1).cast("long").alias("run_id"), "question_id", F.lit("native.answer").alias("evaluator"), "metric", "value")
    verdicts = rows.where("question_id % 2 = 0").select(
        F.concat(F.lit("c-"), F.col("question_id").cast("string")).alias("external_id"), (F.col("question_id") % 3).cast("double").alias("value"), F.concat(F.lit("n"), F.col("question_id").cast("string")).alias("notes")
    )
    return U.import_verdicts(verdicts, scores, made, "native.answer", "contains", "frozen")


@query(
    f"""WITH {Q.PREDICTIONS}, {Q.SCORES} SELECT p.question_id, question_type, max(value) FILTER (metric = 'high') AS "events/high", round(max(value) FILTER (metric = 'mean_value'), 6) AS "events/mean_value"
    FROM predictions p LEFT JOIN (SELECT * FROM scores WHERE run_id = 'click') s ON s.question_id = p.question_id % 100000 * 7 GROUP BY 1, 2"""
)
def drill_down(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.predictions(spark, sf).select(F.col("question_id").alias("id"), (F.col("question_id") % 100_000 * 7).alias("question_id"), "question_type")
    wide = U.drill_down(rows, Q.scores(spark, sf).where("run_id = 'click'"), ["events/high", "events/mean_value"])
    return rounded(wide.drop("question_id").withColumnRenamed("id", "question_id"))


@query(
    f"WITH {Q.SCORES}, {Q._series('scores', 'run_id, evaluator, metric')}, plain AS (SELECT run_id, evaluator, metric, avg(value) AS mean, count(value) AS n FROM scores GROUP BY 1, 2, 3) "
    "SELECT run_id, evaluator, metric, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n FROM plain JOIN bounds USING (run_id, evaluator, metric) "
    "UNION ALL SELECT event_type, 'events', 'mean_total', round(avg(value), 6), NULL, NULL, NULL FROM events GROUP BY 1"
)
def summarize(spark: SparkSession, sf: str) -> DataFrame:
    whole = table(spark, sf, "events").groupBy(F.col("event_type").alias("run_id")).agg(F.avg("value").alias("value"))
    whole = whole.select("run_id", F.lit(None).cast("long").alias("question_id"), F.lit("events").alias("evaluator"), F.lit("mean_total").alias("metric"), "value")
    rows = Q.scores(spark, sf).select("run_id", "question_id", "evaluator", "metric", "value").unionByName(whole)
    return rounded(U.summarize(rows, Q.REPLICATES))


# Curves


def _curve_sql(name: str, ranking: str) -> str:
    """``name`` (question_id, k, metric, value): document recall and hits of prefixes of ``ranking``; gold and ks are there already."""
    return f"""{name}_first AS (SELECT question_id, document_id, min(rank) AS rank FROM {ranking} JOIN (SELECT DISTINCT * FROM gold) USING (question_id, document_id) GROUP BY 1, 2),
    {name} AS (SELECT question_id, k, unnest(['doc_recall', 'hit_rate']) AS metric, unnest([n / n_gold, (n > 0)::DOUBLE]) AS value FROM (SELECT s.question_id, k, n_gold, count(*) FILTER (f.rank <= k) AS n
    FROM (SELECT question_id, count(DISTINCT document_id) AS n_gold FROM gold GROUP BY 1) s CROSS JOIN ks LEFT JOIN {name}_first f USING (question_id) GROUP BY 1, 2, 3))"""


_KS = "ks AS (SELECT unnest([1, 3, 5, 10])::INT AS k)"
_TWO = f"{Q._dense('ra', '[1:32]')}, {Q._dense('rb', '[33:64]')}, {Q.DENSE_GOLD}, {_KS}, {_curve_sql('a', 'ra')}, {_curve_sql('b', 'rb')}"


def _halves(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Document curves of the rankings by each half of the vectors."""
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"))
    gold = Q.dense_gold(spark, sf)
    return [M.document_curve(Q.dense_ranking(spark, sf, 20, part).join(labels, "chunk_id"), gold, Q.KS) for part in ((1, 32), (33, 32))]


@query(
    f"""WITH {_TWO}, rows_ AS (SELECT metric, k AS upto, question_id, value FROM a), {Q._series('rows_', 'metric, upto')}, plain AS (SELECT metric, upto, avg(value) AS mean, count(value) AS n FROM rows_ GROUP BY 1, 2)
    SELECT metric, upto AS k, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n FROM plain JOIN bounds USING (metric, upto)"""
)
def curve_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(U.curve_means(_halves(spark, sf)[0], Q.REPLICATES))


@query()
def curve_json(spark: SparkSession, sf: str) -> DataFrame:
    return U.curve_json(curve_means(spark, sf))


@query(
    f"""WITH {_TWO}, pairs AS (SELECT metric, k, question_id, a.value AS a, b.value AS b FROM a JOIN b USING (metric, k, question_id) WHERE metric IN ('doc_recall', 'hit_rate')),
    deltas AS (SELECT metric, k AS upto, question_id, b - a AS value FROM pairs), {Q._series('deltas', 'metric, upto')},
    plain AS (SELECT metric, k AS upto, avg(a) AS mean_a, avg(b) AS mean_b, avg(b - a) AS delta, count(*) AS n_pairs, count(*) FILTER (b > a) AS n_better, count(*) FILTER (b < a) AS n_worse, count(*) FILTER (b = a) AS n_tied FROM pairs GROUP BY 1, 2),
    signs AS (SELECT metric, upto, b, value, {Q.X.DRAW_SQL.format(seed=43)} FROM (SELECT metric, upto, value, j AS k, b FROM placed, range({Q.REPLICATES}) r(b))),
    flipped AS (SELECT metric, upto, b, avg(CASE WHEN drawn % 2 = 0 THEN value ELSE -value END) AS m FROM signs GROUP BY ALL),
    tested AS (SELECT p.*, ci_low, ci_high, ((SELECT count(*) FROM flipped f WHERE f.metric = p.metric AND f.upto = p.upto AND abs(f.m) >= abs(p.delta) - 1e-12) + 1) / {Q.REPLICATES + 1}::DOUBLE AS p_value
    FROM plain p JOIN bounds USING (metric, upto)), raw AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, metric, upto) + 1) * p_value) AS raw FROM tested),
    done AS (SELECT *, max(raw) OVER (ORDER BY p_value, metric, upto) AS p_holm, ci_low > 0 OR ci_high < 0 AS significant FROM raw)
    SELECT metric, upto AS k, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(delta, 6) AS delta, n_pairs, n_better, n_worse, n_tied, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
    round(p_value, 6) AS p_value, significant, significant <> (p_value < 0.05) AS borderline, round(p_holm, 6) AS p_holm,
    CASE WHEN NOT significant THEN 'inconclusive' WHEN p_holm < 0.05 THEN CASE WHEN delta > 0 THEN 'B better' ELSE 'B worse' END ELSE 'borderline' END AS verdict FROM done"""
)
def compare_curves(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _halves(spark, sf)
    return rounded(U.compare_curves(a, b, Q.REPLICATES, ("doc_recall", "hit_rate")))


# Aggregates


@query(
    f"""WITH {Q.DENSE} SELECT 'mean_utility@rank' || rank AS metric, round(avg(({Q._n("question_id || '/' || chunk_id")} % 101) / 100.0), 6) AS value, count(*) AS n FROM ranking GROUP BY rank"""
)
def utility_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    u = (Q.number(F.concat(F.col("question_id").cast("string"), F.lit("/"), F.col("chunk_id").cast("string"))) % 101) / 100.0
    return rounded(U.utility_by_rank(Q.dense_ranking(spark, sf).select("question_id", "rank", u.alias("utility"))))


@query(
    f"""WITH {Q.ANSWERS} SELECT question_id, round(CASE WHEN answer IS NULL THEN 0 WHEN contains_gold = 1 THEN 1 ELSE round(f1, 4) END, 4)::DOUBLE AS utility FROM judged"""
)
def answer_utility(spark: SparkSession, sf: str) -> DataFrame:
    return Q.predictions(spark, sf).select("question_id", M.utility(F.col("answer"), F.col("gold")).alias("utility"))


@query(
    f"""WITH {Q.TEXT_RANKING}, {Q._NUGGETS}, s AS (SELECT question_id, (max(coalesce(share, 0)) >= 0.6)::DOUBLE AS r FROM shares GROUP BY 1)
    SELECT unnest(['mean_nugget_recall', 'nugget_full_coverage']) AS metric, round(unnest([avg(r), avg((r >= 0.999)::DOUBLE)]), 6) AS value, unnest([count(*), count(*)]) AS n FROM s"""
)
def nugget_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.nugget_recall(M.nugget_support(Q._facts(spark, sf), Q._passages(spark, sf)))
    return rounded(U.run_means(rows, {"nugget_recall": "mean_nugget_recall", "nugget_full_coverage": "nugget_full_coverage"}))


@query(
    f"""WITH {Q.TEXT_RANKING}, {Q._NUGGETS}, s AS (SELECT question_id, max(coalesce(share, 0)) >= 0.6 AS ok FROM shares GROUP BY 1)
    SELECT item_id AS question_id, CASE WHEN ok THEN 0 ELSE 1 END::INT AS n, CASE WHEN ok THEN '' ELSE substr(text, 1, 200) END AS missing FROM benchmark b JOIN s ON s.question_id = b.item_id"""
)
def missing_facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = Q._facts(spark, sf)
    rows = M.missing_facts(M.nugget_support(facts, Q._passages(spark, sf)), facts)
    return rows.select("question_id", F.size("missing").alias("n"), F.array_join("missing", "|").alias("missing"))


@query(
    """SELECT * FROM (SELECT unnest(['rewrite_fallback', 'clarify_asked', 'hyde_fallback']) AS flag, unnest([count(*) FILTER (turn % 3 = 0), count(*) FILTER (role = 'user'), count(*) FILTER (turn < 0)]) AS n FROM conversations) WHERE n > 0"""
)
def technique_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return U.technique_counts(rows.select((F.col("turn") % 3 == 0).alias("rewrite_fallback"), (F.col("role") == "user").alias("clarify_asked"), (F.col("turn") < 0).alias("hyde_fallback"), "turn"))


@query(
    f"""WITH {Q.SCORES}, more AS (SELECT evaluator, metric, value FROM scores UNION ALL SELECT 'judge', 'unparsed', NULL FROM scores) SELECT evaluator, metric FROM more GROUP BY 1, 2 HAVING count(value) = 0"""
)
def empty_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.scores(spark, sf).select("question_id", "evaluator", "metric", "value")
    none = rows.select("question_id", F.lit("judge").alias("evaluator"), F.lit("unparsed").alias("metric"), F.lit(None).cast("double").alias("value"))
    return U.empty_metrics(rows.unionByName(none))


@query(f"WITH {Q.SCORES} SELECT run_id, metric, round(avg(value), 6) AS mean, round(avg((value >= 0.5)::DOUBLE), 6) AS pass_rate, round(count(value) / count(*), 6) AS coverage FROM scores GROUP BY 1, 2")
def pass_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.pass_rates(Q.scores(spark, sf), ["run_id", "metric"], 0.5))


_AGREED = """rows_ AS (SELECT 'toxic' AS metric, quality::DOUBLE AS a, toxic::DOUBLE AS b FROM labels UNION ALL SELECT 'always', quality, 1 FROM labels UNION ALL SELECT 'never', 0, 0 FROM labels)"""


def _three(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("question_id"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return rows.select("question_id", F.explode(F.array(
        F.struct(F.lit("toxic").alias("metric"), F.col("quality").alias("a"), F.col("toxic").alias("b")),
        F.struct(F.lit("always").alias("metric"), F.col("quality").alias("a"), F.lit(1.0).alias("b")),
        F.struct(F.lit("never").alias("metric"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")),
    )).alias("x")).select("question_id", "x.*")


@query(
    f"""WITH {_AGREED}, {Q._KAPPA} SELECT metric, 'judge' AS evaluator, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa,
    row_number() OVER (ORDER BY kappa DESC NULLS LAST, metric)::INT AS place FROM kappa"""
)
def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = _three(spark, sf).withColumn("run_id", F.lit(1))
    annotations = rows.select("run_id", "question_id", "metric", F.col("a").alias("value")).union(rows.select("run_id", "question_id", "metric", F.lit(-1.0)).limit(5))
    scores = rows.select("run_id", "question_id", "metric", F.lit("judge").alias("evaluator"), F.col("b").alias("value"))
    return rounded(U.by_kappa(U.judge_agreement(annotations, scores)))


# Fused rankings and techniques

_ASKED = "SELECT vec_id AS question_id, substr(text, 1, 200) AS text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0"
_DOC_POSTINGS = f"""postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))
  WHERE term NOT IN ({Q._STOP}) GROUP BY ALL), asked AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM ({_ASKED}))"""


def _hybrid_parts(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Dense and lexical rankings of the same documents for the same questions."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    docs = table(spark, sf, "documents").select("doc_id", "text").join(vectors, "doc_id")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("question_id"), F.substring("text", 1, 200).alias("text"))
    lexical = R.lexical(asked, docs.select(F.col("doc_id").alias("chunk_id"), "text"), k)
    return Q.dense_ranking(spark, sf, k).join(asked.select("question_id"), "question_id", "left_semi"), lexical


_HYBRID = f"""{_DOC_POSTINGS}, {Q._lexical('b', 'sum(tf)', 20)}, {Q._dense('every')}, a AS (SELECT * FROM every WHERE question_id IN (SELECT question_id FROM ({_ASKED}))), {Q._fused(['a', 'b'], 20)}"""


@query(f"WITH {_HYBRID} SELECT question_id, chunk_id, round(score, 6) AS score, rank::INT AS rank FROM fused")
def hybrid_dense_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.fuse(list(_hybrid_parts(spark, sf, 20)), 20).select("question_id", "chunk_id", "score", "rank"))


@query(
    f"""WITH {_HYBRID}, per AS (SELECT question_id, chunk_id % 7 AS document_id, count(*) AS n, count(*) FILTER (score < 0.015) AS low FROM fused GROUP BY 1, 2)
    SELECT question_id, sum(n)::BIGINT AS n_pool, (SELECT count(*) FROM a WHERE a.question_id = per.question_id) AS n_dense, (SELECT count(*) FROM b WHERE b.question_id = per.question_id) AS n_lexical,
    count(*) AS distinct_documents, sum(greatest(n - 2, 0))::BIGINT AS dropped_by_cap, sum(low)::BIGINT AS dropped_by_threshold FROM per GROUP BY question_id"""
)
def pool_sources(spark: SparkSession, sf: str) -> DataFrame:
    dense, lexical = _hybrid_parts(spark, sf, 20)
    pool = R.fuse([dense, lexical], 20).withColumn("document_id", F.col("chunk_id") % 7)
    return U.pool_sources(pool, dense, lexical, 2, 0.015)


def _canned(spark: SparkSession, sf: str, role: str, keys: list[str], rows: DataFrame, text: Column) -> DataFrame:
    prompt_id = F.concat(F.lit(f"{role}:"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]))
    return rows.select(prompt_id.alias("prompt_id"), text.alias("text"), F.lit(1).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"))


def _config(**retrieval) -> Config:
    return Config("canned", retrieval=Retrieval(mode="lexical", top_k=10, max_per_document=None, **retrieval), generation=Generation())


def _index(spark: SparkSession, sf: str) -> PL.Index:
    return PL.Index(Q.chunks(spark, sf).select("chunk_id", "document_id", "text"))


@query(
    f"""WITH {Q.CHUNKS}, postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks) WHERE term NOT IN ({Q._STOP}) GROUP BY ALL),
    asked AS (SELECT DISTINCT item_id AS question_id, unnest(regexp_extract_all(lower(CASE WHEN item_id % 2 = 0 THEN substr(text, 1, 60) ELSE text END), '[a-z0-9]+')) AS term FROM benchmark), {Q._lexical('found', 'sum(tf)')}
    SELECT question_id, chunk_id, score, rank::INT AS rank FROM found"""
)
def query_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Rewritten questions are searched; where the call failed (odd ids) the question itself."""
    asked = Q.questions(spark, sf)
    canned = Canned(_canned(spark, sf, "rewriter", ["question_id"], asked, F.when(F.col("question_id") % 2 == 0, F.substring("text", 1, 60))))
    return PL.retrieve(_index(spark, sf), asked, _config(query_rewrite=True), canned).select("question_id", "chunk_id", "score", "rank")


@query(
    f"""WITH {Q.TEXT_RANKING}, graded AS (SELECT *, CASE WHEN h < 4 THEN h END AS grade FROM (SELECT *, {Q._n("question_id || ':' || chunk_id")} % 5 AS h FROM ranking))
    SELECT question_id, chunk_id, coalesce(grade::DOUBLE, score) AS score, row_number() OVER (PARTITION BY question_id ORDER BY grade IS NULL, grade DESC, rank)::INT AS rank FROM graded"""
)
def llm_rerank(spark: SparkSession, sf: str) -> DataFrame:
    asked, h = Q.questions(spark, sf), Q.number(F.concat(F.col("question_id").cast("string"), F.lit(":"), F.col("chunk_id").cast("string"))) % 5
    text = F.when(h < 4, F.concat(F.lit("Grade: "), h.cast("string"))).otherwise("none")
    canned = Canned(_canned(spark, sf, "reranker", ["question_id", "chunk_id"], Q.lexical_ranking(spark, sf), text))
    config = _config(rerank="llm", fetch_k=10)
    return PL.retrieve(_index(spark, sf), asked, config, canned).select("question_id", "chunk_id", "score", "rank")


@query(
    f"""SELECT item_id AS question_id, t AS template, md5(CASE t WHEN 'default' THEN 'Answer the question using only the context below.' || chr(10) || abstain || chr(10) || 'Context:' || chr(10) || c || q || chr(10) || chr(10) || 'Answer:'
    WHEN 'cited' THEN 'Answer the question using only the context below.' || chr(10) || 'Cite the passage number in brackets after each claim, like [2].' || chr(10) || abstain || chr(10) || 'Context:' || chr(10) || c || q || chr(10) || chr(10) || 'Answer:'
    WHEN 'decompose' THEN 'Answer the question using only the context below.' || chr(10) || 'First list the intermediate facts you need, then give the final answer' || chr(10) || 'after the marker "ANSWER:".' || chr(10) || abstain || chr(10) || 'Context:' || chr(10) || c || q || chr(10) || chr(10) || 'Facts:'
    ELSE 'Answer the question from your own knowledge.' || chr(10) || abstain || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer:' END) AS digest
    FROM (SELECT *, CASE WHEN item_id % 2 = 0 THEN chr(10) || 'If the context does not contain the answer, reply exactly: {T.ABSTAIN}' || chr(10) ELSE '' END AS abstain, '[1] ' || substr(text, 1, 20) AS c, chr(10) || chr(10) || 'Question: ' || text AS q
    FROM benchmark), (SELECT unnest(['default', 'cited', 'decompose', 'closed_book']) AS t) WHERE text IS NOT NULL"""
)
def prompt_templates(spark: SparkSession, sf: str) -> DataFrame:
    rows = Q.questions(spark, sf).where("text is not null")
    context = F.concat(F.lit("[1] "), F.substring("text", 1, 20))
    out = None
    for name in T.TEMPLATES:
        text = F.when(F.col("question_id") % 2 == 0, T.prompt(name, F.col("text"), context, True)).otherwise(T.prompt(name, F.col("text"), context, False))
        part = rows.select("question_id", F.lit(name).alias("template"), F.md5(text.cast("binary")).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    rf"""WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'YES. ' || text WHEN 1 THEN 'none' WHEN 2 THEN 'Facts first. ANSWER: ' || text || ' ?' ELSE text || '?' END AS x FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, starts_with(upper({Q._strip('x')}), 'YES') AS yes, {Q._strip('x')} <> '' AND NOT starts_with(upper({Q._strip('x')}), 'NONE') AND contains(x, '?') AS asks,
    md5({Q._strip("CASE WHEN contains(x, 'ANSWER:') THEN substr(x, strpos(x, 'ANSWER:') + 7) ELSE x END")}) AS final FROM t"""
)
def reply_parsing(spark: SparkSession, sf: str) -> DataFrame:
    """What the plan reads from replies: yes, a question back, the final answer."""
    t, turn = F.col("text"), F.col("turn") % 4
    x = F.when(turn == 0, F.concat(F.lit("YES. "), t)).when(turn == 1, "none").when(turn == 2, F.concat(F.lit("Facts first. ANSWER: "), t, F.lit(" ?"))).otherwise(F.concat(t, F.lit("?")))
    rows = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", x.alias("x"))
    return rows.select("conv_id", "turn", T.says_yes(F.col("x")).alias("yes"), T.wants_clarification(F.col("x")).alias("asks"), F.md5(T.final_answer(F.col("x")).cast("binary")).alias("final"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events WHERE event_id % 50 < 5""")
def json_replies(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON object within a reply, by its outermost braces; null where there is none."""
    reply = F.when(F.col("event_id") % 3 == 0, "no object").otherwise(F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" as asked")))
    rows = table(spark, sf, "events").where("event_id % 50 < 5")
    return rows.select("event_id", T.json_block(reply, "k bigint")["k"].alias("k"))


@query(
    f"""WITH v AS (SELECT conv_id % 7 AS run_id, CASE WHEN turn % 2 = 0 THEN 'gold' ELSE 'answer' END AS side, {Q._n("conv_id || '#' || turn")} % 4 AS h FROM conversations),
    s AS (SELECT run_id, count(*) FILTER (side = 'answer' AND h <= run_id % 3) / count(*) FILTER (side = 'answer') AS p, count(*) FILTER (side = 'gold' AND h = 0) / count(*) FILTER (side = 'gold') AS r FROM v GROUP BY 1)
    SELECT run_id, CASE WHEN p >= 0.7 AND r < 0.5 THEN 'retrieval' WHEN p < 0.5 THEN 'generator' ELSE 'none' END AS blame FROM s"""
)
def claims_attribution(spark: SparkSession, sf: str) -> DataFrame:
    h = Q.number(F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string"))) % 4
    rows = table(spark, sf, "conversations").select((F.col("conv_id") % 7).alias("run_id"), (F.col("turn") % 2 == 0).alias("gold"), h.alias("h"))
    per = rows.groupBy("run_id").agg(
        (F.count_if(~F.col("gold") & (F.col("h") <= F.col("run_id") % 3)) / F.count_if(~F.col("gold"))).alias("p"), (F.count_if(F.col("gold") & (F.col("h") == 0)) / F.count_if("gold")).alias("r")
    )
    return per.select("run_id", M.attribution(F.col("p"), F.col("r")).alias("blame"))


@query("SELECT p_size AS size, ceil(2 * 0.4 * 0.6 * power(2.8 / (p_size / 100.0), 2.0))::BIGINT AS n FROM (SELECT DISTINCT p_size FROM part)")
def required_n(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "part").select(F.col("p_size").alias("size")).distinct()
    return sizes.select("size", Q.X.required_n(F.col("size") / 100.0, 0.4).cast("long").alias("n"))


@query(
    f"WITH {Q.SCORES}, newest AS (SELECT DISTINCT event_type AS run_id FROM events WHERE event_type <> 'view' ORDER BY run_id DESC LIMIT 3), newest_scores AS (SELECT * FROM scores WHERE metric = 'high' AND run_id IN (SELECT run_id FROM newest)), "
    f"{Q._series('newest_scores', 'run_id')}, plain AS (SELECT run_id, avg(value) AS mean, count(value) AS n FROM newest_scores GROUP BY 1) "
    "SELECT run_id, round(mean, 6) AS mean, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, n, row_number() OVER (ORDER BY mean DESC, run_id)::INT AS place FROM plain JOIN bounds USING (run_id)"
)
def leaderboard_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The board of the newest completed runs alone."""
    made = table(spark, sf, "events").select(F.col("event_type").alias("run_id")).distinct().withColumn("status", F.when(F.col("run_id") == "view", "running").otherwise("completed"))
    some = Q.scores(spark, sf).join(U.newest(made, 3, "completed").select("run_id"), "run_id", "left_semi")
    return rounded(P.leaderboard(some, "high", Q.REPLICATES))
