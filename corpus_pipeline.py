"""From raw documents to sharded training data, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideframe.llm import decontaminate, minhash, mixing, sharding, toxicity
from tideframe.sources.files import work_folder


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; learned from the labelled ones that are not held out.

    Null and empty texts score as texts without words; repeated rows score alike.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, equal rows and rows without an id included."""
    return minhash.without_near_duplicates(docs, k=5, percent=80)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item stand; null and empty texts have none."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """About half of the tokens, drawn to the target shares of sources, languages and topics.

    Null sources and languages are levels of their own; documents without words
    are drawn by the weight of their cell like others; equal rows are drawn together.
    """
    return mixing.draw(docs)


def _sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, all columns, with their size, checksum, shard of 40 and place in it.

    Null ids and texts are placed like others. Columns of the documents with the
    name of a result give way to it.
    """
    results = {"doc_id", "size", "text_crc32", "shard", "slot"}
    return sharding.assign(docs, shards=40, keep=[c for c in docs.columns if c.lower() not in results])


STAGES = [
    ("toxicity", _toxicity),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontaminate),
    ("mixing", _mixing),
    ("sharding", _sharding),
]

#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again by the next."""
    folder = work_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
