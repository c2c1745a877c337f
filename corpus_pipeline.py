"""Documents to token ids: quality, near duplicates, benchmark leaks, secrets, tokens.

Each stage is (name, function) and maps (spark, docs, sf_dir) to a DataFrame;
run() writes each stage's rows to the shared checkpoint folder as Parquet and
reads them as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairgrid.llm import decontaminate, near_copies, quality, secrets, sentencepiece_codec
from fairgrid.llm.common import bounded_batches, fresh, labelled, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality model rejects."""
    model = quality.fit(labelled(docs, table(spark, sf_dir, "labels"), "quality", 3, 1))
    p = fresh(docs, "score")
    return docs.withColumn(p, quality.score_udf(docs, model)(F.col("text"))).where(F.col(p) >= 0.5).drop(p)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of five-word similarity 0.8 or more."""
    bounded_batches(spark)
    return near_copies.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets, all but widely copied examples; every document stays."""
    bounded_batches(spark)
    return secrets.redact(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, lang, source, n_tokens, ids."""
    bounded_batches(spark)
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.load(), ["doc_id", "lang", "source"])


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("tokens", tokens_stage)]

#: Learned models and trie joins have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        to = f"{shared}/{name}"
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return docs
