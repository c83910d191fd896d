"""From raw documents to packed sequences: quality rules, quality classifier, line dedup, near-duplicate removal, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs. All but
the last return the columns of documents, and further columns of any name with them. Stages set the size of Arrow batches in their session:
common.small_batches says why.

Null text counts as empty text: the quality rules reject it. Rows without doc_id, and rows that share one, are judged by their texts. Repeated
rows get equal results; near_duplicates keeps one of them. Texts of any length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelogs.llm.common import fresh, read_table, small_batches, written
from devicelogs.llm.jaccard_join import drop_near_copies
from devicelogs.llm.line_dedup import dedup_lines
from devicelogs.llm.packing import pack
from devicelogs.llm.quality_classifier import THRESHOLD, score, train
from devicelogs.llm.quality_rules import filter_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    small_batches(spark)
    return filter_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold go. The model learns from the labelled rows of the raw documents."""
    small_batches(spark)
    model = train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    (name,) = fresh(docs.columns, "score")
    return score(docs, model, name).where(F.col(name) >= THRESHOLD).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages are cut from the texts, and n_chars follows; no document goes."""
    small_batches(spark)
    cut = dedup_lines(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id stays; of repeated rows one. Rows without words or without doc_id stay."""
    small_batches(spark)
    return drop_near_copies(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, packed into sequences."""
    small_batches(spark)
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs


#: The classifier and the packing can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None
