"""Staggered tile grids: geometry, generation, look-up, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config


def slide_geometry(slides: DataFrame, start_col: int = 0, start_row: int = 0, max_cols: int = 0, max_rows: int = 0) -> DataFrame:
    """Adds scale, tile, half, cols, rows to (wsi_id, width, height, mpp); halves round to even.

    An mpp that is missing or no number (mpp may be text) is DEFAULT_MPP; one of 0 is an error. cols and rows are of the
    window that starts at that column and row, and has at most so many of them where the limit is not 0."""
    mpp = F.coalesce(F.expr("try_cast(mpp AS double)"), F.lit(config.DEFAULT_MPP))
    scale = F.greatest(F.lit(1), F.bround(F.lit(config.TARGET_MPP) / mpp).cast("long"))
    out = slides.withColumn("scale", scale.cast("long")).withColumn("tile", F.col("scale") * config.PATCH)
    cols, rows = F.expr("width div tile") - start_col, F.expr("height div tile") - start_row
    cols = F.least(cols, F.lit(max_cols)) if max_cols else cols
    rows = F.least(rows, F.lit(max_rows)) if max_rows else rows
    return out.select("*", F.expr("tile div 2").alias("half"), cols.cast("long").alias("cols"), rows.cast("long").alias("rows"))


def thumbnail_window(tiles: DataFrame, downsample: float, thumb_width: int, thumb_height: int, x0: int = 0, y0: int = 0) -> DataFrame:
    """Adds x1, y1, x2, y2 to tiles (px, py, tile): the pixels of a smaller picture of the region from (x0, y0) that a
    tile covers, cut off towards zero and held inside the picture; tiles that cover none go."""
    side = lambda x, start, more: ((F.col(x) - start + more) / downsample).cast("long")
    out = tiles.withColumn("x1", side("px", x0, 0)).withColumn("y1", side("py", y0, 0))
    out = out.withColumn("x2", F.least(side("px", x0, F.col("tile")), F.lit(thumb_width))).withColumn("y2", F.least(side("py", y0, F.col("tile")), F.lit(thumb_height)))
    return out.filter("x1 < x2 AND y1 < y2")


def hex_grid(geometry: DataFrame, start_col: int = 0, start_row: int = 0) -> DataFrame:
    """(wsi_id, c, r, px, py, cx, cy) of each tile of the window inside its slide; odd columns are half a tile lower."""
    cells = geometry.filter("cols > 0 AND rows > 0")
    cells = cells.select("*", F.explode(F.sequence(F.lit(start_col).cast("long"), F.col("cols") + (start_col - 1))).alias("c"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(start_row).cast("long"), F.col("rows") + (start_row - 1))).alias("r"))
    cells = cells.withColumn("px", F.col("c") * F.col("tile")).withColumn("py", F.col("r") * F.col("tile") + F.when(F.col("c") % 2 == 1, F.col("half")).otherwise(0))
    cells = cells.filter("px + tile <= width AND py + tile <= height")
    return cells.select("wsi_id", "c", "r", "px", "py", (F.col("px") + F.col("half")).alias("cx"), (F.col("py") + F.col("half")).alias("cy"))


def cell_of(x: Column, y: Column, tile: Column, half: Column) -> tuple[Column, Column]:
    """Column and row of the tile that holds a point."""
    c = F.floor(x / tile)
    return c, F.floor((y - F.when(F.pmod(c, F.lit(2)) == 1, half).otherwise(0)) / tile)


def spatial_lookup(points: DataFrame, nodes: DataFrame, tile: int) -> DataFrame:
    """points (wsi_id, x, y, ...) with the node_id of the tile they are in, null where there is none."""
    c, r = cell_of(F.col("x"), F.col("y"), F.lit(tile), F.lit(tile // 2))
    found = points.withColumn("c", c).withColumn("r", r)
    return found.join(nodes.select("wsi_id", "c", "r", "node_id"), ["wsi_id", "c", "r"], "left")


def offsets(spark: SparkSession) -> DataFrame:
    """The 12 neighbour offsets (parity, dir, dc, dr)."""
    rows = [(p, d, dc, dr) for p, ring in config.NEIGHBOURS.items() for d, (dc, dr) in enumerate(ring)]
    return spark.createDataFrame(rows, "parity long, dir int, dc long, dr long")


def neighbours(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Directed edges (wsi_id, src, dir, dst, src_c, src_r), and the labels of both ends where nodes have one."""
    label = ["label"] if "label" in nodes.columns else []
    a = nodes.select("wsi_id", F.col("node_id").alias("src"), "c", "r", *(F.col(x).alias("src_label") for x in label))
    a = a.join(F.broadcast(offsets(spark)), F.pmod("c", F.lit(2)) == F.col("parity"))  # 12 rows
    a = a.select("wsi_id", "src", "dir", F.col("c").alias("src_c"), F.col("r").alias("src_r"), (F.col("c") + F.col("dc")).alias("c"), (F.col("r") + F.col("dr")).alias("r"), *(f"src_{x}" for x in label))
    b = nodes.select("wsi_id", "c", "r", F.col("node_id").alias("dst"), *(F.col(x).alias("dst_label") for x in label))
    return a.join(b, ["wsi_id", "c", "r"]).drop("c", "r")


def edges(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Undirected edges, once each: src < dst."""
    return neighbours(spark, nodes).filter("src < dst").drop("dir", "src_c", "src_r")


def luma_mask(pixels: DataFrame, threshold: float = 220) -> DataFrame:
    """Adds gray and tissue (gray <= threshold) to rows with red, green, blue."""
    gray = 0.2989 * F.col("red") + 0.5870 * F.col("green") + 0.1140 * F.col("blue")
    return pixels.withColumn("gray", gray).withColumn("tissue", F.col("gray") <= threshold)


def tissue_filter(pixels: DataFrame, keys: list[str], white_ratio: float = 0.5) -> DataFrame:
    """The keys of tiles whose share of tissue pixels is above 1 - white_ratio."""
    share = F.avg(F.col("tissue").cast("double"))
    return pixels.groupBy(*keys).agg(share.alias("tissue_share")).filter(F.col("tissue_share") > 1 - white_ratio)
