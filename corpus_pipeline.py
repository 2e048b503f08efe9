"""The corpus pipeline: documents without toxic ones, exact copies and near copies, packed into sequences.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import foliograph
from foliograph.llm import exact_dedup, packing, simhash, toxicity
from foliograph.llm.common import materialize

WORD_FILE = "word_bpe_49k.json"
#: SQL can't express scoring, SimHash and tokens.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    foliograph.ship(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    foliograph.ship(spark)
    return simhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document has a place in a sequence."""
    foliograph.ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path(WORD_FILE))


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Nulls, ties, repeated rows, empty tables and further columns are as the stages' operators say."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
