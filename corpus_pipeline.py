"""From documents to packed sequences: quality, line dedup, near duplicates, mixing, packing.

Each stage works on all rows that the one before returned. All but the last return the columns of documents, in their order, whatever other
columns a table has. Null texts and texts without words are documents like any other: the classifier scores them, no line of theirs is aligned, those
without words are near copies of each other, and packing gives them a piece that holds the end mark alone. Rows without doc_id are never judged by
lines or near copies. Rows that repeat a doc_id count as one document in those two stages, so one of them stays. Ties go to the smaller doc_id.
Very long texts are taken whole, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonalyt.llm import lines, mixing, packing, quality, simhash
from sonalyt.llm.common import dropped, table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on labels, rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that align with an earlier document's go; so does a document with nothing else."""
    return lines.remove_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id: five-word shingles, Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until the languages' token totals meet the target weights; none is lost."""
    return mixing.remix(docs, mixing.languages(docs, table(spark, sf_dir, "labels")), keep_all=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", good_documents), ("line_dedup", without_shared_lines), ("simhash", one_of_each_group), ("mixing", mixed), ("packing", packed)]

#: no stage can be expressed in SQL as a whole: models are trained, fingerprints hashed, tokens counted by a vocabulary; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = written(stage(spark, docs, sf_dir))
        if before:
            dropped(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
