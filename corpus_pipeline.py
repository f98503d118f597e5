"""A corpus pipeline: five stages over `documents`, each written and read again by the next.

Quality: rejected documents go. Near-dedup: the smallest doc_id of each class stays. Decontamination:
documents that hold a benchmark item go. Secrets: spans are replaced in the text. BPE: the ids of each text.
Null and empty texts are near-duplicates of each other, so one of them stays; repeated rows of one doc_id go or stay
together; rows without doc_id pass the stages that go by doc_id; an empty table gives an empty result; further columns
are kept up to the last stage. Each stage's table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridian.llm import bpe, decontam, quality, secrets, simhash
from meridian.llm.common import forget, stored
from meridian.llm.queries import table, vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and their number."""
    ids = bpe.tokenize(docs, vocabulary_path())
    return ids.selectExpr("doc_id", "cast(octet_length(ids) div 4 as bigint) as n_tokens", "ids")


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("bpe", bpe_stage)]
#: Learned weights and component search are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
