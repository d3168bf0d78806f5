"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import blocks, bpe, context_tree, forest, line_rules, merkle, near_lines, packing, pivots, site_quality, spellings, suffixes, token_counts
from .frames import table


def _vocabulary(variable: str, name: str) -> str:
    if path := os.environ.get(variable):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_path() -> str:
    """The vocabulary file: RANKATLAS_TOKENIZER, or the installed public one."""
    return _vocabulary("RANKATLAS_TOKENIZER", "word_bpe_49k.json")


def byte_tokenizer_path() -> str:
    """The byte-level vocabulary file: RANKATLAS_BYTE_TOKENIZER, or the installed public one."""
    return _vocabulary("RANKATLAS_BYTE_TOKENIZER", "byte_bpe_50k.json")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.digests(blocks.remove_passages(table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.digests(site_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.digests(line_rules.judge_documents(table(spark, sf_dir, "documents")))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.digests(forest.near_duplicates(table(spark, sf_dir, "documents")))


def op8_near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_lines.digests(near_lines.drop_repeated_lines(table(spark, sf_dir, "documents")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op9_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"))


def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), byte_tokenizer_path())


def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.spelling_variants(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(merkle.manifest(table(spark, sf_dir, "documents"), merkle.altered()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_array, op2_packing, op3_substring, op4_site_quality, op5_line_rules, op6_bpe, op7_lsh_forest, op8_near_lines, op9_pivot_search, op10_context_tree, op11_token_counts, op12_spellings, op13_merkle)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_rules": line_rules.ORACLE_SQL, "op9_pivot_search": pivots.ORACLE_SQL, "op12_spellings": spellings.ORACLE_SQL, "op13_merkle": merkle.ORACLE_SQL}
