"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and gives the documents that the next one works on.

Null and empty texts are clean, link with nothing, hold no item and have no words, so they come through the first three
stages; the mix takes them as often as their source's hashes say, and the store holds an end id for them. Very long
texts are worked on whole. Rows of equal doc_id stand or fall together in the stages that go by doc_id (decontamination);
of repeated rows with words the Jaccard join keeps one. Ties are settled by doc_id, then by hashes, alike in every run.
Extra columns come through unread, whatever their names. Empty tables give an empty result; without labels of both kinds
nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, jaccard_join, mixing, queries, token_store, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels table predicts to be toxic go; null and wordless texts never are."""
    model = toxicity.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    clean = toxicity.score(docs, model, tuple(docs.columns)).filter("predicted = 0")
    return clean.select(*(F.col(f"kept_{c}").alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one of smallest doc_id stays; documents without words all stay."""
    return jaccard_join.keep_first(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark table go, with all rows of their doc_id."""
    return decontamination.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it; null sources are one source."""
    return mixing.repeat(spark, docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token store holds of each document: doc_id, start, n_tokens, ids_crc32."""
    path = common.new_path(spark, "tokens")
    token_store.write(spark, docs, path, queries.tokenizer_path("word_bpe_49k.json"))
    return token_store.read_digests(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token ids", store_tokens),
]
#: A model's scores and a tokenizer's ids are beyond SQL; tests/llm/test_values.py holds the stages against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut(spark, docs, f"stage-{i + 1}")
    return docs
