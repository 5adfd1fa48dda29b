"""The corpus pipeline: from raw documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the last
return the columns of documents; each result is written as Parquet and read again as the next input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import mixing, near_copies, packing, substrings, toxicity
from loomgraph.llm.common import prepare, table
from loomgraph.session import shared_path, ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id: five-word shingles, similarity from 0.8 on."""
    return near_copies.drop_near_copies(docs)


def cut_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds are cut out; every document stays."""
    return substrings.cut_repeated_substrings(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per epoch of their source's target, and a drawn part of the last epoch."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with their token ids."""
    return packing.pack_documents(docs)


def _prepared(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _prepared(drop_toxic)),
    ("simhash_near_dedup", _prepared(drop_near_duplicates)),
    ("suffix_array_dedup", _prepared(cut_repeated_substrings)),
    ("mix_sources", _prepared(mix_sources)),
    ("packing", _prepared(pack_sequences)),
]

#: Trained scores, fingerprint components, byte spans and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
