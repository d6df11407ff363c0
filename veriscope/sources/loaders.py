"""Dataset loaders: raw JSON to documents and questions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import EVIDENCE


class Dataset(NamedTuple):
    name: str
    documents: DataFrame
    questions: DataFrame
    orphans: DataFrame  # (external_id, n): evidence that names no document


_LOADERS: dict[str, Callable[..., Dataset]] = {}

CORPUS = "url string, title string, body string, author string, source string, category string, published_at string"
QUERIES = "query string, answer string, question_type string, evidence_list array<struct<url: string, fact: string>>"
HOTPOT = (
    "_id string, question string, answer string, type string, level string, context array<array<string>>, supporting_facts array<array<string>>"
)


def register(name: str) -> Callable:
    def add(f: Callable[..., Dataset]) -> Callable[..., Dataset]:
        _LOADERS[name] = f
        return f

    return add


def get_loader(name: str) -> Callable[..., Dataset]:
    if name not in _LOADERS:
        raise KeyError(f"unknown dataset {name}; there are {', '.join(available())}")
    return _LOADERS[name]


def available() -> list[str]:
    return sorted(_LOADERS)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array (or lines) of objects; the schema is given, not inferred."""
    return spark.read.schema(schema).json(path, multiLine=True)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their place from 0 in the order they are read: places in a partition, and sums over partitions before it."""
    placed = rows.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__c"))  # one row a partition
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__b"))
    place = F.col("__m").bitwiseAND((1 << 33) - 1) + F.col("__b")
    return placed.join(F.broadcast(before), "__p").withColumn(name, place).drop("__m", "__p", "__b")


@register("multihop_rag")
def multihop_rag(spark: SparkSession, corpus: str, queries: str) -> Dataset:
    """Articles by URL and questions whose evidence names URLs; evidence without an article is counted, not kept."""
    return multihop_from(read_json(spark, corpus, CORPUS), read_json(spark, queries, QUERIES))


def multihop_from(corpus: DataFrame, queries: DataFrame, order: str | None = None) -> Dataset:
    """``order`` is the column of the queries that numbers them from 0; by default their place in the file."""
    meta = F.map_filter(F.create_map(*[x for c in ("source", "author", "category", "published_at") for x in (F.lit(c), F.col(c))]), lambda _, v: v.isNotNull())
    docs = corpus.where("url is not null").select(F.col("url").alias("external_id"), "title", "body", meta.alias("metadata"))
    rows = queries.withColumn("__n", F.col(order)) if order else numbered(queries, "__n")
    rows = rows.withColumn("external_id", F.format_string("mhr-%05d", F.col("__n").cast("long")))
    flat = rows.select("external_id", F.posexplode("evidence_list").alias("pos", "e")).select("external_id", "pos", F.col("e.url").alias("url"), F.col("e.fact").alias("fact"))
    known = flat.join(docs.select(F.col("external_id").alias("url"), F.lit(True).alias("known")).distinct(), "url", "left")
    item = F.struct(F.col("url").alias("document_external_id"), "fact", F.lit(None).cast("array<int>").alias("sentence_ids"))
    kept = known.where("known").groupBy("external_id").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("g"))
    gold = kept.select("external_id", F.transform("g", lambda x: x["item"]).cast(EVIDENCE).alias("gold_evidence"))
    questions = rows.join(gold, "external_id", "left").select(
        "external_id", F.col("query").alias("question"), "answer", "question_type", F.coalesce("gold_evidence", F.array().cast(EVIDENCE)).alias("gold_evidence")
    )
    return Dataset("multihop_rag", docs, questions, known.where("known is null").groupBy("external_id").agg(F.count("*").alias("n")))


@register("hotpotqa")
def hotpotqa(spark: SparkSession, path: str) -> Dataset:
    """Paragraphs by title (the first one met counts) and questions with the sentences that support them."""
    return hotpot_from(read_json(spark, path, HOTPOT))


def hotpot_from(rows: DataFrame) -> Dataset:
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    context = numbered.select("__row", F.posexplode("context").alias("pos", "c"))
    body = F.concat_ws("", F.from_json(F.col("c")[1], "array<string>")) if dict(rows.dtypes)["context"] == "array<array<string>>" else F.concat_ws("", F.col("c.sentences"))
    title = F.col("c")[0] if dict(rows.dtypes)["context"] == "array<array<string>>" else F.col("c.title")
    flat = context.select(title.alias("external_id"), body.alias("body"), F.struct("__row", "pos").alias("at"))
    docs = flat.groupBy("external_id").agg(F.min_by("body", "at").alias("body")).select("external_id", F.col("external_id").alias("title"), "body")
    fact = numbered.select("_id", F.posexplode("supporting_facts").alias("pos", "f"))
    struct = dict(rows.dtypes)["supporting_facts"] != "array<array<string>>"
    fact = fact.select("_id", "pos", (F.col("f.title") if struct else F.col("f")[0]).alias("title"), (F.col("f.sent_id") if struct else F.col("f")[1]).cast("int").alias("s"))
    per = fact.groupBy("_id", "title").agg(F.min("pos").alias("pos"), F.sort_array(F.collect_list("s")).alias("sentence_ids"))
    item = F.struct(F.col("title").alias("document_external_id"), F.lit(None).cast("string").alias("fact"), "sentence_ids")
    gold = per.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("g"))
    gold = gold.select("_id", F.transform("g", lambda x: x["item"]).cast(EVIDENCE).alias("gold_evidence"))
    questions = rows.join(gold, "_id", "left").select(
        F.col("_id").alias("external_id"), "question", "answer", F.col("type").alias("question_type"), F.coalesce("gold_evidence", F.array().cast(EVIDENCE)).alias("gold_evidence")
    )
    orphan = per.join(docs.select("title"), "title", "left_anti").groupBy(F.col("_id").alias("external_id")).agg(F.count("*").alias("n"))
    return Dataset("hotpotqa", docs, questions, orphan)


def summary(dataset: Dataset) -> DataFrame:
    """Numbers of documents, questions and unanswerable questions, and questions of each type."""
    q = dataset.questions.groupBy("question_type").agg(F.count("*").alias("n"), F.count_if(F.size("gold_evidence") == 0).alias("u"))
    q = q.agg(F.sum("n").alias("n_questions"), F.sum("u").alias("n_unanswerable"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("question_type", "n")))).alias("types"))
    return q.crossJoin(F.broadcast(dataset.documents.agg(F.count("*").alias("n_documents"))))
