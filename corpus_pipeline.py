"""From raw documents to packed training sequences.

Each stage works on every document that the one before it kept.  All stages but the last
return documents with the columns they came with; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanbook.llm import lines, mixing, near_duplicates, toxicity
from loanbook.llm.packing import Limits, pack_sequences
from loanbook.llm.queries import table, vocabulary
from loanbook.llm.storage import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic by a network fitted to the labelled ones."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document before them has; emptied ones go."""
    return lines.drop_duplicate_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return near_duplicates.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, twice at most."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens: one row per piece of a document."""
    return pack_sequences(docs, vocabulary(), Limits())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None
"""Neither the network's scores nor token ids can be written in SQL; see tests/llm/test_pipeline.py."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage but the last written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
