"""A training corpus from raw documents in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``.

1. quality: documents that the additive model rejects go.
2. near_dedup: one document of each group of near duplicates stays.
3. decontamination: documents with a window of the benchmark go.
4. mixing: every document is drawn as often as its source's weight asks for, at least once.
5. sharding: each row gets a shard and a slot.

Every stage takes nulls in any column, empty and very long texts, ties of doc_id and repeated rows,
empty tables and further columns of any name; what it makes of them is said in its docstring.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloupe.llm import decontamination, mixing, quality_gam, sharding, simhash_dedup
from codeloupe.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose whole text scores ``THRESHOLD`` or more; null texts are judged as empty ones, ties and repeats one by one, an empty table stays empty."""
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of the smallest doc_id; null and empty texts are one component, null doc_ids come last."""
    return simhash_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window of the benchmark; null and empty texts have none and stay, equal texts fare alike."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it is drawn, once at least; null sources are a source, repeats are drawn each, other columns pass through."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``size, text_crc32, law, shard, slot, grown_shard``; equal texts share a shard, null ones count as empty, an empty table gives none."""
    return sharding.shard(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: The first stage's model is fitted by boosting, which SQL can't express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
