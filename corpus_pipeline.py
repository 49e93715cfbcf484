"""A corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, line_dedup, packing, quality, simhash
from tessera.llm.common import delete, table, with_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected. Null and empty texts go; a null source is a host
    like any other; repeated rows stay or go together; an empty table gives none; extra columns stay."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of line runs of 50 words and more; of equal runs the first by id stays. Null and
    empty texts, and rows with a null id, stay; rows that repeat id and text get the same text each."""
    return line_dedup.keep_with_text(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard >= 0.8 over 5-word shingles), that with the smallest id; one
    row of it where rows repeat. Texts without words are copies of each other; rows with a null id come last."""
    return simhash.keep_one_similar(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, by id: all rows of an id go together, and null ids are one. Null and
    empty texts stay; an empty benchmark keeps all; items of fewer than eight characters aren't looked for."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences. Null and empty texts give the end token alone; repeated rows are packed
    each; a null id gives a null doc_id; an empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: Edit matching, components and packing can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents of sf_dir. A stage's table is deleted once the next one is written."""
    with_checkpoint_dir(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        if k:
            delete(spark, f"{at}/{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
