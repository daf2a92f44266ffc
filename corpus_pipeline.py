"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Every stage takes whatever its predecessor kept: null ids, texts, languages and sources, empty and very long texts, repeated rows, further columns and no rows at
all; what it does with them stands at each.  All but the last return the columns of their input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from reclutark.llm import bpe, mixing, passages, queries, rules, simhash
from reclutark.llm.common import crc_fold, shared_folder, ship


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones that aren't held out, doesn't reject.

    Every row is judged by its own text, null and empty ones by their zero statistics, so repeated rows share a verdict.  Without labels of both
    kinds the score is one for all.  The model learns from the documents that are given, by doc_id; an empty table gives none.
    """
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    return rules.keep_good(docs, rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of least doc_id, null last, and of least hash among rows of one id.

    Null, empty and blank texts are copies of each other; an empty table gives none.
    """
    return simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in an earlier one, by doc_id.

    All rows stay, with all other words; a text that is all passages becomes empty.  Rows without id or text aren't touched, nor are those that repeat an id
    with another text than the one that takes part.
    """
    return passages.without_repeats(docs, passages.repeated(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the target mixture, once for each epoch that takes them.

    Null languages and sources are names of their own; texts without words cost nothing and are taken as often as the epochs go.  No words at all
    give no rows.
    """
    return mixing.mixed(docs, queries.mixture()).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level identifiers of every document that is left, and the text decoded from them, as digests; a row per row, a null text is empty."""
    return bpe.round_trip(docs, queries.BYTE_VOCABULARY)


STAGES = [("classifier", good), ("simhash", near_duplicates), ("passages", repeats), ("mixing", mixture), ("bpe", tokens)]

#: The classifier and the mixture aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage.  What lies between is written under the session's checkpoint folder, which all executors share."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
