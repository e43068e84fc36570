"""Walks from labelled nodes to split and numbered sequences in one call, and walks of whole slides."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import cut, rank_by_parts
from tessera.operators import graph, metrics, sequences

REGION = ["wsi_id", "label", "root"]


def slide_walks(spark: SparkSession, nodes: DataFrame, per_slide: int = 50, least: int = config.WALK_MIN) -> DataFrame:
    """(wsi_id, attempt, path): so many different walks over each slide, whatever the labels, out of ten tries for each.

    Slides of fewer than `least` nodes have none. Walks that are stuck end; they don't turn back."""
    whole = nodes.select("wsi_id", "node_id", "c", "r").withColumn("label", F.lit("")).withColumn("root", F.lit(0).cast("long"))
    quotas = whole.groupBy(*REGION).agg(F.count("*").alias("n_nodes")).filter(F.col("n_nodes") >= least).withColumn("quota", F.lit(per_slide).cast("long"))
    tries = cut(spark, sequences.attempts(whole, quotas, "slide"), "slide-attempts")
    return sequences.accept(sequences.tile_walks(nodes, tries, False, False), tries, least).select("wsi_id", "attempt", "path")


def to_global(walks: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """walks with path as global_idx, label_id (of most nodes, the first met of equals) and path_len."""
    steps = walks.select(*keys, F.posexplode("path").alias("pos", "node_id")).join(index.select("wsi_id", "node_id", "global_idx", "label_id"), ["wsi_id", "node_id"])
    path = F.array_sort(F.collect_list(F.struct("pos", "global_idx")))  # a walk's steps: WALK_MAX at most
    paths = steps.groupBy(*keys).agg(F.transform(path, lambda s: s["global_idx"]).alias("path"), F.count("*").alias("path_len"))
    votes = steps.groupBy(*keys, "label_id").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    return paths.join(votes.groupBy(*keys).agg(F.max_by("label_id", F.struct("c", -F.col("p"))).alias("label_id")), keys)


def region_walks(spark: SparkSession, nodes: DataFrame, balanced: bool = True, per_region: int = 30, bounce: bool = True) -> tuple[DataFrame, DataFrame]:
    """(walks, regions): walks (wsi_id, label, root, attempt, walk_id, start, length, path) inside regions (wsi_id, label, root, component_id,
    region_key), by the balanced allocation or so many of each region. nodes are numbered and labelled."""
    found = cut(spark, graph.regions(spark, nodes), "regions")
    sizes = cut(spark, graph.region_sizes(found), "region-sizes")
    if balanced:
        made = sequences.balanced_walks(spark, None, found, sizes, bounce)[0]
    else:
        tries = cut(spark, sequences.attempts(found, sizes.withColumn("quota", F.lit(per_region).cast("long"))), "attempts")
        made = sequences.accept(sequences.tile_walks(found, tries, bounce), tries)
    key = F.concat_ws("__", F.col("wsi_id").cast("string"), "label", F.col("component_id").cast("string"))
    return made, sizes.select(*REGION, "component_id", key.alias("region_key"))


def run(
    spark: SparkSession, nodes: DataFrame, balanced: bool = True, holdout: int | Mapping[str, int] | None = None, stratified: bool = True, per_region: int = 30
) -> DataFrame:
    """(path_id, wsi_id, split, path_len, label_id, label, component_id, region_key, path) of walks over labelled nodes
    (wsi_id, node_id, c, r, label): tiles without tissue go, the rest is indexed, walked inside its regions, and split by
    whole regions (holdout), else by walks of each label (stratified), else by slide.

    path has global_idx, and path_id is dense in order of region and attempt."""
    kept = cut(spark, graph.drop_label(nodes), "tissue")
    index = cut(spark, graph.node_index(spark, kept), "index")
    made, regions = region_walks(spark, kept, balanced, per_region)
    made = cut(spark, made.drop("path"), "made-walks")
    ids = spark.createDataFrame(list(config.LABELS.items()), "label string, label_id int")
    # The walks made are taken again with the numbers of their nodes: no step is joined with its node.
    paths = graph.grid_walks(index, made, True, True, keep=("label", "root", "attempt"), carry=("global_idx",))
    paths = paths.select(*REGION, "attempt", F.col("path_global_idx").alias("path"), F.size("path").cast("long").alias("path_len"))
    paths = paths.join(F.broadcast(ids), "label")  # a region's walks have its label
    regions = regions.withColumn("place", F.row_number().over(Window.orderBy("wsi_id", "label", "component_id")))  # a row for each region
    ranked = rank_by_parts(paths.join(regions, REGION), [], F.col("place"), ["attempt"])
    walks = ranked.withColumn("path_id", (F.col("k_") - 1).cast("long")).drop("k_", "n_", "place")
    if holdout is not None:
        walks = sequences.holdout_walks(walks, holdout)
    elif stratified:
        walks = metrics.stratified_split(walks, "path_id", "label_id")
    else:
        walks = walks.join(metrics.slide_split(kept.select("wsi_id").distinct()), "wsi_id")
    return walks.select("path_id", "wsi_id", "split", "path_len", "label_id", "label", "component_id", "region_key", "path")
