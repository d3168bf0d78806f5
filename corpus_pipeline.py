"""A corpus, step by step: rules, lines, near duplicates, passages, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankatlas.llm import blocks, forest, line_rules, near_lines, packing
from rankatlas.llm.frames import table, written
from rankatlas.llm.queries import tokenizer_path


# Every stage takes null and empty texts as texts without words, treats repeated rows and null ids
# as its operator's docstring says, takes texts of any length, gives no rows for an empty table, and
# but for the last returns the columns of documents, whatever they are called.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go; documents that lose too much, or are short or repetitive, go, and so those without text."""
    return line_rules.clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier one go, and documents that lose all their words by it."""
    return near_lines.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays; repeated rows are one."""
    return forest.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start earlier go, and documents that lose all their words by it."""
    return blocks.dedup_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths; a text without words is its end alone."""
    return packing.digests(packing.pack(docs, tokenizer_path()))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substring_dedup), ("packing", packed)]

#: SQL can't express the later stages; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
