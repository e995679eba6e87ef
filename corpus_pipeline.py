"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs.
In every stage an empty table gives an empty table, and columns come through whatever their names (the last stage adds shard
and slot in place of columns so named). What happens to null ids, null and empty texts and repeated rows stands with each stage.
SQL cannot express the models of the first stages, so there is no ORACLE_SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillworks.llm import decontaminate, mixing, sharding, simhash, toxicity
from quillworks.llm.common import Scratch, tidy


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic go.

    Rows with a null id stay. Null and empty texts are scored as texts without evidence. Rows that share an id go together.
    """
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest id; of rows with that id, one.

    Rows with a null id stay. Null, empty and blank texts are copies of each other.
    """
    return simhash.drop_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a benchmark item away go.

    Rows with a null id, null and empty texts stay. Rows that share an id go together. Items under five words match nothing.
    """
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the words takes it.

    Null sources are one source. Null and empty texts weigh nothing and are taken as often as the document before them. Repeated rows
    count each for itself.
    """
    return mixing.mix_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their shard and slot.

    Null ids come first, null texts have the size of an empty one, repeated rows have slots of their own.
    """
    return sharding.shard_rows(docs)


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("decontamination", uncontaminated), ("mixing", mixed), ("sharding", sharded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with what each keeps written before the next."""
    scratch, docs = Scratch(spark, "pipeline"), _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with tidy(scratch):
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
