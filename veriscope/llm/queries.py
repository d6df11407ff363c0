"""What ``__spark_entry__`` registers for this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, langid, near_dup, oracles, packing, sharding, substring, tokenfile, topk, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, F.col("doc_id"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(spark, docs.where(~out))
    made = langid.identify(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return made.select("doc_id", "held_out", "lang_pred", "score", "ambiguous", "lang_second")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1).read()


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "html"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13, joined=True)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20, scale=64.0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write(table(spark, sf_dir, "pages")).read()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_token_files": op6_token_files,
    "op7_html_text": op7_html_text,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_warc": op10_warc,
}

#: SQL has no tokenizer (op4, op6), no fitted classifier (op2) and no layout of pages (op7), and op3's windows of
#: every size are too slow in it; tests/llm holds those against plain versions.
ORACLES: dict[str, str] = {
    "op1_sharding": oracles.op1(),
    "op5_minhash_near_dedup": oracles.OP5,
    "op8_substring_dedup": oracles.OP8,
    "op9_exact_topk": oracles.OP9,
    "op10_warc": oracles.OP10,
}
