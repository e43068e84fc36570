"""Connected components of an edge table, by least labels and pointer jumps; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, root) for each end of edges (a, b): root is the least id that can be reached. Rounds grow with the log of a
    component's width; each sums neighbours' labels per id before its shuffle."""
    pairs = common.cut(spark, edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "pairs")
    labels = common.cut(spark, pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = pairs.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "id")
        step = labels.join(near, "id").select("id", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("root").alias("far"))
        moved = step.join(jump, "low").select("id", F.least("low", "far").alias("root"), F.col("root").alias("old"))
        moved = common.cut(spark, moved, "labels")
        done = moved.filter(F.col("root") != F.col("old")).isEmpty()
        common.drop(spark, labels)
        path = moved._tessera_path
        labels = moved.select("id", "root")
        labels._tessera_path = path
        if done:
            common.drop(spark, pairs)
            return labels


def merged(labels: DataFrame, moved: DataFrame) -> DataFrame:
    """labels (id, root) after moved (id, root), the components of links between roots and ids that had no label."""
    to = moved.select(F.col("id").alias("root"), F.col("root").alias("to"))
    known = labels.join(to, "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return known.unionByName(moved.join(labels.select("id"), "id", "left_anti"))
