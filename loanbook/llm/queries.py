"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loanbook.llm import conversations, hard_negatives, licences, lines, mixing, near_duplicates, neighbours, personal, quality, repeats, toxicity, warc
from loanbook.llm.packing import Limits, Vocabulary, pack_sequences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> Vocabulary:
    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_texts(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(spark, table(spark, sf_dir, "pages"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_table(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents"), vocabulary(), Limits())


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.span_table(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_table(conversations.damage(conversations.rows_of(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_neighbours": op5_neighbours,
    "op6_licences": op6_licences,
    "op7_repeats": op7_repeats,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_lines": op9_lines,
    "op10_packing": op10_packing,
    "op11_personal": op11_personal,
    "op12_negatives": op12_negatives,
    "op13_repair": op13_repair,
}

ORACLE: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op4_warc": warc.ORACLE,
    "op6_licences": licences.oracle(),
    "op12_negatives": hard_negatives.ORACLE,
}
