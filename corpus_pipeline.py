"""From raw documents to packed training windows: five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. NULL texts pass the toxicity stage and fail the
quality rules; an empty table goes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlspan.llm import packing, rules, simhash, substring, toxicity
from crawlspan.session import cut_lineage, ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier, trained on the labelled ones, doesn't reject."""
    ship(spark)
    return toxicity.accept(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that pass the current policy."""
    return rules.accept(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group of near copies."""
    ship(spark)
    return simhash.accept(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: passages that documents share, left in the first of them alone."""
    ship(spark)
    return substring.cut(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: windows of tokens with their boundary records."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: SQL can express neither the trained classifier nor the searches; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written before the next one reads it."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
