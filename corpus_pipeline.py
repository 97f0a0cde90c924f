"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, source mix.

Each stage takes what its predecessor kept, as a table of its own. All but the last
return the columns of `documents`; the last returns them once per copy taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowspark.llm.common import read_table, save
from flowspark.llm.decontaminate import drop_contaminated
from flowspark.llm.line_dedup import drop_repeated_lines
from flowspark.llm.mixing import mix
from flowspark.llm.quality_rules import MIN_WORDS, keep_good
from flowspark.llm.simhash import keep_one_each


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines an earlier one has; one that keeps too few words for the rules goes."""
    return drop_repeated_lines(docs, least_words=MIN_WORDS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: SimHash components are no SQL query; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
