"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, with the
columns of documents for all but the last. ``run`` writes every stage's result
as Parquet in the folder that ``spark.checkpoint.dir`` names and reads it
again, so a lost executor never costs more than a stage.

Defined cases, of all stages: a null text counts as an empty one; texts of any
length are taken whole; rows are judged one by one, so repeated and null ids do
no harm; extra columns are carried along, whatever their names; an empty table
gives an empty one. Equal rows share their fate but in ``near_dedup``, where one
of them stays, and of ties in a group the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from buildatlas.llm import decontaminate, packing, quality, secrets, simhash
from buildatlas.llm.common import documents, folder
from buildatlas.llm.queries import labels, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality voters don't reject."""
    return quality.keep(docs, labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.keep(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked, also where a live value stands without its keyword."""
    return secrets.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return packing.pack(docs, tokenizer())


STAGES = [("quality", good_quality), ("simhash", near_dedup), ("decontaminate", decontaminated), ("secrets", without_secrets), ("packing", packed)]
#: Learnt models and tokenizers can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = folder(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
