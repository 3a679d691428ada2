"""The stages of a training-data pipeline over `documents`, each one operator of quillspark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs
of the next. All but the last return the columns of `documents`. Stages decide on rows, not on ids: where ids repeat or
are null, rows are numbered first, so that no text goes on account of another one with the same id.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, line_dedup, near_dedup, sentencepiece_bpe, toxicity
from quillspark.llm.common import remove, scratch, written
from quillspark.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A line on more than this share of a source's distinct texts is boilerplate.
LINE_RATIO, LINE_DOCS = 0.2, 5
#: Documents of this similarity, in hundredths, are near duplicates.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, predicts to be toxic go.

    Each row is judged by its own text; repeated ids and null ids make no difference.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=_present(docs)).filter("predicted = 0").select(*_present(docs))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its documents; the documents stay, with n_chars of what is left.

    Rows are counted by their texts, whatever their ids; a null source is a source of its own.
    """
    out = line_dedup.drop_boilerplate(docs, "source", "text", LINE_RATIO, LINE_DOCS, copies=False)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*_present(docs))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the least id (null ids last; of equal ids any one).

    Rows without words are near to nothing and stay.
    """
    docs, row = _rows(spark, docs)
    found = near_dedup.near_duplicates(docs, row, percent=NEAR_PERCENT)
    if row == "doc_id":
        gone = found.filter(~F.col("kept")).select(row)
    else:
        groups = found.select(F.col("doc_id").alias(row), F.col("component_id").alias("__group"))
        alike = groups.groupBy("__group").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        first = docs.join(groups, row).groupBy("__group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("x")).select(F.col(f"x.{row}").alias(row))
        gone = groups.join(alike, "__group").select(row).join(first, row, "left_anti")
    return docs.join(gone, row, "left_anti").select(*_present(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go, whatever their id."""
    docs, row = _rows(spark, docs)
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), id_col=row).select(F.col("doc_id").alias(row)).distinct()
    return docs.join(found, row, "left_anti").select(*_present(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of the pieces of each document, and of their decoding."""
    return sentencepiece_bpe.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _rows(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs, the column that names a row): doc_id where it does, else a number given once and written down."""
    docs = docs.select(*_present(docs))
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    return written(docs.withColumn("__row", F.monotonically_increasing_id()), scratch(spark), "rows"), "__row"


def _present(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("near_dedup", keep_one),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: A classifier, a similarity join and an encoder are beyond SQL: the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from `documents`."""
    folder = scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
        remove(spark, folder, name)  # the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
