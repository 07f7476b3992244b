"""A corpus pipeline of five stages: quality rules, near-duplicates, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the docs of the
next one. All but the last keep the columns of ``documents``, and any further ones, whatever their names. The stages before
mixing only drop rows: documents that fail the quality rules, all but one of each near-duplicate class (five-word shingles, a
Jaccard similarity of 0.8), and documents that hold benchmark questions. Mixing repeats documents of small sources; it drops
none, as its budget plays the largest source once.

Null texts count as texts without words: the quality rules drop them, near-duplicates keep one of all blank texts, the other
stages keep them. Null ids, and ids used twice, stand for their own text each. Equal rows are one near-duplicate class; of
equal ids and texts one row stays there, and mixing plays them together. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontaminate, mixing, near_text, quality, token_order
from larkspur.llm.common import shared_path
from larkspur.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_text.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.replay(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_order.materialise(docs, shared_path(spark, "token-shards"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_shards", token_shards),
]

#: Hashes, fingerprints and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(kept)
        docs = spark.read.parquet(kept)
    return STAGES[-1][1](spark, docs, sf_dir)
