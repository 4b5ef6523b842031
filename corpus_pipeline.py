"""A corpus made ready for training: STAGES, each a job over all that the stage before it kept.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import toxicity
from tidebook.llm._common import read, stored
from tidebook.llm.decontam import drop_contaminated
from tidebook.llm.mixing import mixed_documents
from tidebook.llm.neardup import keep_one
from tidebook.llm.sharding import shard_documents

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.5 or more go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, name="__toxicity").where("__toxicity < 0.5").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five words, a similarity of 0.8."""
    return keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item, or a whole shorter one, go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighed 5, 2, 1 in turn; a document comes as often as the mix takes it, in training order."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every training document."""
    return shard_documents(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the learned stage; tests/llm compares the stages with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), narrow=False)
    return STAGES[-1][1](spark, docs, sf_dir)
