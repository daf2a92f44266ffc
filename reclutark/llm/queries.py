"""Named queries of the training-data operators over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reclutark.llm import backoff, bpe, itq, language, mixing, outliers, passages, preference, prefix_trie, rules, simhash, sql, token_counts, whitening
from reclutark.llm.common import crc_fold, ship

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Domains are given by the number that ends a source's name, modulo four; sources without a number are of the first.
DOMAINS = ("web", "books", "forums", "reference")

MIXTURE_WEIGHTS = {
    "domain": {"web": 4, "books": 3, "forums": 2, "reference": 1},
    "lang": {"en": 4, "de": 2, "fr": 2, "es": 2},
}


def mixture() -> mixing.Mixture:
    number = F.coalesce(F.regexp_extract("source", r"([0-9]{1,9})$", 1).try_cast("long"), F.lit(0))
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), (number % len(DOMAINS) + 1).cast("int"))
    return mixing.Mixture(domain, MIXTURE_WEIGHTS)


def op1_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.segments(preference.with_other_reply(table(spark, sf_dir, "conversations")))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mixture()).drop("row")


def op4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.filtered(table(spark, sf_dir, "documents"))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 5) == 0
    return rules.classify(docs, rules.fit(docs, table(spark, sf_dir, "labels"), held_out), held_out)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    return language.identify(docs, language.learn(docs.filter(~held_out)), held_out)


def op10_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.components(table(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 10) == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_preference, op2_passages, op3_mixing, op4_outliers, op5_rules, op6_simhash, op7_bpe, op8_token_counts, op9_language, op10_itq, op11_prefix_trie,
            op12_backoff, op13_whitening,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_preference": sql.PREFERENCE, "op3_mixing": sql.mixing(DOMAINS, MIXTURE_WEIGHTS), "op11_prefix_trie": sql.PREFIX_TRIE}
