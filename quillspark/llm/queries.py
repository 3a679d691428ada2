"""The registered queries of the subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import ann, decontaminate, filter_audit, line_dedup, lm_scoring, near_dedup, packing, secrets, sentencepiece_bpe, suffix_dedup, token_count, toxicity, whitening
from quillspark.sources.tables import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.page_lines(table(spark, sf_dir, "pages"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), PIECE_TOKENIZER)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_token_counts": op2_token_counts,
    "op3_near_dedup": op3_near_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_secrets": op5_secrets,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_decontamination": op10_decontamination,
    "op11_filter_audit": op11_filter_audit,
    "op12_whitening": op12_whitening,
    "op13_packing": op13_packing,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op8_line_dedup": line_dedup.PAGE_SQL,
    "op10_decontamination": decontaminate.SQL,
    "op11_filter_audit": filter_audit.SQL,
}
