"""The corpus pipeline: five stages over ``documents``, each written and read again.

Rows: a null or blank text, and one in no language that the labelled rows
teach, go in the first stage; repeated rows stay or go together there and in
the second; an empty table gives no rows.  Stages read and return the columns of
``documents`` alone: any others are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm import decontaminate, langid, near_dup, packing, substring
from veriscope.llm.common import cleared, delete, shared_path
from veriscope.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the labelled rows teach; ``und`` and ambiguous ones go."""
    model = langid.fit(spark, docs.where(~langid.held_out(F.col("doc_id"))))
    named = langid.identify(docs.select(*COLUMNS), model)
    return named.where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate component (five words, 80 % and more)."""
    return near_dup.drop_duplicates(docs.select(*COLUMNS), percent=80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of words that a document of smaller id has; texts left empty go."""
    cut = substring.remove_repeats(docs.select(*COLUMNS), window=substring.PASSAGE)
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_words") > F.col("n_removed")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

#: SQL cannot express these stages; tests/llm/test_queries.py holds each of them, and run(), against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written and reread.

    What a stage keeps for itself goes when its result is written, and that
    result when the next one is.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"stage-{name}")
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
