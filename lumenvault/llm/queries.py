"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunks, decontaminate, divergence, infill, merkle, mixing, oracles, pii, simhash, suffixes, toxicity, urls
from .common import table


def tokenizer(name: str) -> tuple[str, str]:
    """Path of a vocabulary file and the split pattern that goes with rank files."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    marked = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "text")
    return toxicity.scored(marked, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.count_tokens(docs, tokenizer("word_bpe_49k.json")[0]).drop("text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, *tokenizer("byte_bpe_multi_50k.tiktoken")).drop("text")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.planned(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = infill.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("text"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash_near_dedup, op3_toxicity, op4_decontaminate, op5_merkle, op6_token_counts, op7_substring_dedup, op8_pii, op9_byte_bpe, op10_suffix_dedup, op11_source_divergence, op12_source_mix, op13_fill_in_middle)}
ORACLE_SQL: dict[str, str] = {"op4_decontaminate": oracles.OP4, "op5_merkle": oracles.OP5, "op8_pii": oracles.OP8, "op10_suffix_dedup": oracles.OP10, "op11_source_divergence": oracles.OP11, "op12_source_mix": oracles.OP12, "op13_fill_in_middle": oracles.OP13}
