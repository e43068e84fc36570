"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, jaccard_join, line_dedup, main_text, mixing, periodic_runs, phrases, quality, repeated_passages, secrets, token_count, token_store, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(spark, _table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents")).drop("times")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    token_store.write(spark, _table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_store.read_digests(spark, path)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, _table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(spark, docs, _table(spark, sf_dir, "labels"))).drop("passages")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(spark, _table(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.remove(spark, _table(spark, sf_dir, "documents")).drop("spans")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(spark, _table(spark, sf_dir, "documents")).withColumn("kept_md5", F.md5("text")).drop("text")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return periodic_runs.find(_table(spark, sf_dir, "documents"), columns)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken")))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_token_store": op4_token_store,
    "op5_token_count": op5_token_count,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_secrets": op12_secrets,
    "op13_phrases": op13_phrases,
}
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op3_decontamination": decontamination.ORACLE,
    "op7_quality": quality.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op13_phrases": phrases.ORACLE,
}
