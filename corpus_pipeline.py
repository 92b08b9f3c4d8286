"""From raw documents to packed training sequences, one operator a stage.

The stages are the five that the pipeline is specified to have, in its order; personal data, repetition rules,
substring dedup, URLs and archives are operators of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.common import stage
from ledgerloom.llm.decontamination import decontaminate
from ledgerloom.llm.jaccard_join import one_of_each
from ledgerloom.llm.line_dedup import dedup_lines
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality_classifier import accepted, fit, training_labels


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    return accepted(docs, fit(docs, training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines; those that are nothing else go."""
    return dedup_lines(docs, window=None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the min-hash labels, the tokenizer and the linear program are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each one's result is written to the shared folder and read back by the next.

    Null and empty texts: the classifier treats both as empty texts, and what it keeps of them passes the other
    stages unchanged and is packed as one end token.  Rows without an id are never near duplicates and lose no lines.
    Rows that repeat an id are one document to the near-duplicate stage, which keeps or drops them together.  An empty
    table gives an empty result.  Columns beyond those of `documents` are carried to the last stage, which drops them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
