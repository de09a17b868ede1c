"""A training corpus from `documents`: stages that each apply one operator to all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions.session import ensure_checkpoint_dir
from docgraph.llm import decontaminate, mixing, quality, sharding, simhash
from docgraph.llm.common import remove_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage model scores at 0.5 or more. It is fitted on labels outside the held-out third.

    Null and empty texts are scored as a passage of zeros; repeated rows stay or go together; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True)))
    return quality.keep_good(docs, quality.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one of least doc_id.

    Null and empty texts are copies of each other; rows of one doc_id stay together where their texts are of one component;
    a null doc_id stays only where its component has no other.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window. Null and empty texts stay; a doc_id goes with all its rows; ties do not matter."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, by doc_id alone, so reruns agree. Texts without words are not taken; a null
    source is a source; rows of equal doc_id and size are taken alike."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and its place there; copies of a row get a place each, a null doc_id a shard like any other."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", shards),
]

#: The model and the hashes of the first two stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents. What each keeps is written to the shared checkpoint folder and read again by the next;
    once that is written in turn, the copy before goes, so one copy of the corpus stays behind the result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        here = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            remove_folder(spark, before)
        before = here
    return docs
