"""The thin queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wachter.llm import decontaminate, embedding_neardup, jaccard_join, katz, line_dedup, mixing, token_counts, token_ids, toxicity, warc_fixity


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.digest(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(read(spark, sf_dir, "documents"))


def op3_mixing_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_pivot_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_neardup.digest(read(spark, sf_dir, "embeddings"))


def op6_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.digest(read(spark, sf_dir, "pages"))


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(read(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.digest(read(spark, sf_dir, "documents"))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_token_id_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.digest(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_katz_backoff, op2_line_dedup, op3_mixing_cube, op4_toxicity_ftrl, op5_pivot_neardup, op6_warc_merkle, op7_token_attribution, op8_ngram_jaccard_join, op9_template_decontamination, op10_token_id_orc)}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE_SQL, "op6_warc_merkle": warc_fixity.ORACLE_SQL, "op8_ngram_jaccard_join": jaccard_join.ORACLE_SQL}
