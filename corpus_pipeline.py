"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
to the shared folder and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolattice.llm import line_dedup, mixing, near_dedup, packing, quality
from chronolattice.llm._common import mark, materialise, release, table
from chronolattice.llm.queries import vocabulary
from chronolattice.runtime import shipped


@shipped
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@shipped
def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one word of an earlier line go."""
    return line_dedup.drop_lines(docs)


@shipped
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_first(docs)


@shipped
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, cut or left out for the sources' weights, in training order."""
    return mixing.mix(docs)


@shipped
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024."""
    return packing.pack(docs, vocabulary())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_documents),
    ("line dedup", distinct_lines),
    ("near dedup", distinct_documents),
    ("source mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: No SQL expresses the trained classifier, the signatures or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = mark(spark)
        docs = materialise(stage(spark, docs, sf_dir), "stage")
        release(spark, before, keep="stage")
    return STAGES[-1][1](spark, docs, sf_dir)
