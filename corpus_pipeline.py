"""The corpus pipeline: documents pass five stages, each written as Parquet and read again as the next one's input.

Stages that filter keep whole rows with the columns of documents; the last one packs what is left into
sequences. Empty tables and nulls in any column pass as the operators define it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tensorloom.llm import decontamination, neardup, packing, quality, toxicity
from tensorloom.llm.common import mark, release, rows_where, shared_folder, stored, table, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches the operator's threshold."""
    model = toxicity.learned(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows_where(docs, lambda texts: model.scores(texts) < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the weakly labelled scorer holds for bad."""
    model = quality.learned(docs)
    return rows_where(docs, lambda texts: model.of_texts(texts) >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five words, similarity 0.8)."""
    found = neardup.classes(docs)
    return without(docs, stored(found.where("NOT kept").select("doc_id").distinct(), "copies"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark passage."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences."""
    return packing.packed_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("packing", pack)]

#: The models, the MinHash search and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/tensorloom/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        before = mark()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        release(spark, before)  # what the stage wrote on its way
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
