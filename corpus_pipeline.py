"""Training-corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvault.llm import bpe, decontaminate, pii, simhash, toxicity
from lumenvault.llm.common import shared_dir, table
from lumenvault.llm.queries import tokenizer

#: Documents of this toxicity score or more are rejected.
TOXIC = 0.3
#: SQL cannot express the classifier or the token ids.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, fitted on the labelled ones among `docs`, scores as toxic.

    A null text is scored as an empty one; equal texts share their fate. Without labels of both kinds the score
    is their share, 0.5 for none. All columns of `docs` stay, one called score too.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, out="__toxicity").where(F.col("__toxicity") < TOXIC).drop("__toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each near-duplicate group.

    Null and empty texts are one group. Unlike texts under one doc_id all stay; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages.

    Documents without words stay; rows that share a doc_id are judged each by its text, repeated rows alike.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by the names of their kinds; n_chars follows. All rows stay; a null text stays null."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each text and their number; columns of these names are replaced. A null text has none."""
    encoded = bpe.encode_column(docs, *tokenizer("byte_bpe_multi_50k.tiktoken"))
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("pii", redact), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each result is written to the shared folder and read again.

    An empty table goes through all stages and gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
