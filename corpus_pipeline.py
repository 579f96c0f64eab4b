"""The corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnflow.llm.common import read, stash
from cairnflow.llm.exact_dedup import distinct_rows, fresh_index
from cairnflow.llm.near_dedup import one_of_each
from cairnflow.llm.pieces import PieceTable, encode
from cairnflow.llm.quality import good_rows
from cairnflow.llm.source_mixing import mixed_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return good_rows(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the largest id."""
    return distinct_rows(docs, fresh_index(spark))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of each document, checked by decoding."""
    return encode(docs, PieceTable.load())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near dedup", near), ("mixing sources", mix), ("SentencePiece encoding", encoded)]
#: Learning, sampling by consistent hashes and merges aren't SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
