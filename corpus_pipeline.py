"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wachter.llm import decontaminate, jaccard_join, mixing, token_ids, toxicity
from wachter.llm.common import work_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of its input and drops those that score 0.5 or more. Null and empty texts score as the model's bias
    does (below 0.5 unless most labels are toxic), so they stay; so does all without labels. Repeated rows go or stay together."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates; null, empty and blank texts all stay; of repeated rows one stays."""
    return jaccard_join.deduplicate(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts, and all with an empty benchmark, stay; repeated rows go together."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all up to three times. A null source is one of the sources; texts without words
    have size 0 and may be taken; rows alike in id, source and size are taken equally often."""
    return mixing.mix(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of the ORC files of token ids. A null or empty text is the end id alone; repeated documents repeat."""
    return token_ids.digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token ids", to_token_ids),
]
#: No SQL: learning, sampling and the tokenizer cannot be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = work_path(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
