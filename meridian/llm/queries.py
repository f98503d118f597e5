"""Queries op1 to op10 over the whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meridian.llm.chat import SQL as CHAT_SQL
from meridian.llm.licenses import SQL as LICENSE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import chat

    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    from meridian.llm.common import pick

    turns = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(turns, vocabulary_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import simhash

    return simhash.classes(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import decontam

    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import licenses

    return licenses.report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import toxicity

    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import quality

    return quality.posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import caps

    return caps.classes(table(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meridian.llm import secrets

    return secrets.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_formatting, op2_simhash, op3_decontamination, op4_language_id, op5_bpe, op6_licenses, op7_toxicity, op8_quality, op9_embedding_dedup, op10_secrets)}
ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": CHAT_SQL, "op6_licenses": LICENSE_SQL}
