"""Queries over image files that are written from the test tables: each slide's pixels come from its orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera import streaming
from tessera.functions import cut, shared_path
from tessera.operators import encoders, grid
from tessera.operators.sequences import CHANNELS
from tessera.plans import fixture as X
from tessera.plans.queries import query
from tessera.sources import raster, store

#: Pixels along a tile of the grid, rows of pixels of a file, pixels along a tile of a file, levels.
SIDE, BAND, TILE, LEVELS = 8, 64, 32, 3
MPP = 16.0


def _files(spark, sf):
    """(wsi_id, band, path): the slides as files. A pixel's colours come from the order in its place; without one it is white."""
    w = X.edge_tiles(spark, sf)
    o = X.table(spark, sf, "orders").select((F.col("o_orderkey") % 5).cast("int").alias("wsi_id"), F.expr("o_orderkey div 5").alias("k"), F.floor("o_totalprice").cast("long").alias("a"), F.col("o_custkey").cast("long").alias("b"))
    o = o.filter(F.col("k") < w * w).select("wsi_id", F.expr(f"k div {w}").alias("c"), (F.col("k") % w).alias("r"), "a", "b")
    rows = spark.range(5 * w).select((F.col("id") % 5).cast("int").alias("wsi_id"), F.expr("id div 5").alias("r"))
    cells = o.groupBy("wsi_id", "r").agg(F.collect_list(F.struct("c", "a", "b")).alias("cells"))  # as many as a slide is wide
    rows = rows.join(cells, ["wsi_id", "r"], "left")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = np.arange(SIDE)
        for batch in batches:
            for row in batch.to_pylist():
                out = np.full((SIDE, w, SIDE, 3), 255, np.uint8)
                if row["cells"]:
                    c, a, b = (np.array([x[k] for x in row["cells"]], np.int64) for k in "cab")
                    a, b, dx, dy = a[None, :, None], b[None, :, None], d[None, None, :], d[:, None, None]
                    red, green, blue = a + 3 * dx + 5 * dy, b + 7 * dx + dy, a // 7 + dx * dy + 0 * b
                    out[:, c] = np.stack(np.broadcast_arrays(red, green, blue), -1) % 256
                y = row["r"] * SIDE + d
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["wsi_id"]] * SIDE, pa.int32()), pa.array(y // BAND), pa.array(y), pa.array([v.tobytes() for v in out], pa.binary())], names=["wsi_id", "band", "y", "line"]
                )

    return raster.write_bands(spark, rows.mapInArrow(lines, "wsi_id int, band long, y long, line binary"), shared_path(spark, "slides"), LEVELS, TILE, MPP)


_SUMS = "red long, green long, blue long, mark long"


def _summed(rows, width: str, height: str):
    """Rows with the sums of their pixels' colours, and one in which each place counts differently, instead of the pixels."""
    rest = [c for c in rows.columns if c != "pixels"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for v, n in zip(batch.column(batch.schema.get_field_index("pixels")), batch.column(batch.schema.get_field_index(width)).to_pylist(), strict=True):
                x = np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, 3).astype(np.int64)
                i = np.arange(len(x))
                sums.append([*x.sum(0).tolist(), int((x.sum(1) * (1 + i % n + 31 * (i // n))).sum())])
            cols = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([s[k] for s in sums], pa.int64()) for k in range(4))], names=[*rest, "red", "green", "blue", "mark"])

    return rows.mapInArrow(run, f"{kinds}, {_SUMS}")


_PIXELS = f"""WITH w AS (SELECT CAST(ceil(sqrt(count(*) / 5.0)) AS BIGINT) AS w FROM orders),
g AS (SELECT CAST(s AS INTEGER) AS wsi_id, c, r, w, s + 5 * (c * w + r) AS k FROM w, (SELECT unnest(generate_series(0, 4)) AS s), (SELECT unnest(generate_series(0, w - 1)) AS c FROM w), (SELECT unnest(generate_series(0, w - 1)) AS r FROM w)),
o AS (SELECT wsi_id, c, r, w, CAST(floor(o_totalprice) AS BIGINT) AS a, CAST(o_custkey AS BIGINT) AS b FROM g LEFT JOIN orders ON o_orderkey = k),
p0 AS MATERIALIZED (SELECT wsi_id, 0 AS level, {SIDE} * c + dx AS x, {SIDE} * r + dy AS y, coalesce((a + 3 * dx + 5 * dy) % 256, 255) AS red, coalesce((b + 7 * dx + dy) % 256, 255) AS green, coalesce((a // 7 + dx * dy) % 256, 255) AS blue
    FROM o, (SELECT unnest(generate_series(0, {SIDE - 1})) AS dx), (SELECT unnest(generate_series(0, {SIDE - 1})) AS dy)),
p1 AS MATERIALIZED (SELECT wsi_id, 1 AS level, x // 2 AS x, y // 2 AS y, CAST(sum(red) // 4 AS BIGINT) AS red, CAST(sum(green) // 4 AS BIGINT) AS green, CAST(sum(blue) // 4 AS BIGINT) AS blue FROM p0 GROUP BY ALL),
p2 AS MATERIALIZED (SELECT wsi_id, 2 AS level, x // 2 AS x, y // 2 AS y, CAST(sum(red) // 4 AS BIGINT) AS red, CAST(sum(green) // 4 AS BIGINT) AS green, CAST(sum(blue) // 4 AS BIGINT) AS blue FROM p1 GROUP BY ALL),
px AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2),
bd AS (SELECT *, y // CAST({BAND} / power(2, level) AS BIGINT) AS band FROM px),
tl AS (SELECT wsi_id, level, band, x // {TILE} AS col, (y - band * CAST({BAND} / power(2, level) AS BIGINT)) // {TILE} AS row, * EXCLUDE (wsi_id, level, band) FROM bd),
sm AS (SELECT wsi_id, level, min(x) AS x, min(y) AS y, max(x) + 1 AS x2, max(y) + 1 AS y2, CAST(sum(red) AS BIGINT) AS red, CAST(sum(green) AS BIGINT) AS green, CAST(sum(blue) AS BIGINT) AS blue,
    CAST(sum((red + green + blue) * (1 + x - {TILE} * col + 31 * (y - band * CAST({BAND} / power(2, level) AS BIGINT) - {TILE} * row))) AS BIGINT) AS mark FROM tl GROUP BY wsi_id, level, band, col, row)
"""


def _tiles(spark, files):
    slides = F.regexp_extract("path", r"/(\d+)-\d+\.tif$", 1).cast("int").alias("wsi_id")
    held = raster.tiles(spark, [r.path for r in files.select("path").collect()])  # as many as there are files
    return held.select("*", slides)


def _tile_sums(rows):
    return _summed(rows.select("wsi_id", "level", "x", "y", "x2", "y2", "width", "height", "pixels"), "width", "height").drop("width", "height")


@query(_PIXELS + "SELECT wsi_id, level, x, y, x2, y2, red, green, blue, mark FROM sm")
def raster_tiles(spark, sf):
    """All tiles of all levels, read back from the files."""
    return _tile_sums(_tiles(spark, _files(spark, sf)))


@query(_PIXELS + f"SELECT wsi_id, level, x, y, x2, y2, red, green, blue, mark FROM sm, w WHERE level = 1 AND x < w * {SIDE} // 4 AND x2 > w * {SIDE} // 8 AND y < w * {SIDE} // 3 AND y2 > w * {SIDE} // 16")
def raster_window_tiles(spark, sf):
    """The tiles of one level that a window touches; the others are not read."""
    side = X.edge_tiles(spark, sf) * SIDE
    inside = (F.col("level") == 1) & (F.col("x") < side // 4) & (F.col("x2") > side // 8) & (F.col("y") < side // 3) & (F.col("y2") > side // 16)
    return _tile_sums(_tiles(spark, _files(spark, sf)).filter(inside))


@query(f"""WITH w AS (SELECT {SIDE} * CAST(ceil(sqrt(count(*) / 5.0)) AS BIGINT) AS side FROM orders),
b AS (SELECT CAST(s AS INTEGER) AS wsi_id, band, side, least({BAND}, side - band * {BAND}) AS h FROM w, (SELECT unnest(generate_series(0, 4)) AS s), (SELECT unnest(generate_series(0, (side - 1) // {BAND})) AS band FROM w)),
l AS (SELECT *, CAST(power(2, level) AS BIGINT) AS f FROM b, (SELECT CAST(unnest(generate_series(0, {LEVELS - 1})) AS INTEGER) AS level))
SELECT wsi_id, band, level, side // f AS width, h // f AS height, {TILE} AS tile_width, round((CAST(side AS DOUBLE) / (side // f) + CAST(h AS DOUBLE) / (h // f)) / 2, 6) AS downsample, CAST({MPP} AS DOUBLE) AS mpp, band * {BAND} AS y FROM l""")
def raster_levels(spark, sf):
    """What the headers of the files say."""
    heads = raster.levels(_files(spark, sf))
    return heads.select("wsi_id", "band", "level", "width", "height", "tile_width", F.round("downsample", 6).alias("downsample"), F.round("mpp", 6).alias("mpp"), "y")


def _level_files(files, level):
    return files.withColumn("level", F.lit(level))


def _windows(files, index):
    """Windows of eight pixels of the second level around each node's tile, resampled to four."""
    half = SIDE // 2
    y = F.col("r") * half + F.when(F.col("c") % 2 == 1, half // 2).otherwise(0)
    n = index.select("wsi_id", "node_id", *(["global_idx"] if "global_idx" in index.columns else []), (F.col("c") * half).alias("x"), y.alias("y"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))
    return raster.read_windows(n, _level_files(files, 1), SIDE // 2, BAND // 2)


_KERNEL = f"""k0 AS (SELECT o, i, (i + 0.5 - (o + 0.5) * 2) / 2 AS z FROM (SELECT CAST(unnest(generate_series(0, {SIDE // 2 - 1})) AS DOUBLE) AS o), (SELECT CAST(unnest(generate_series(0, {SIDE - 1})) AS DOUBLE) AS i)),
k1 AS (SELECT CAST(o AS BIGINT) AS o, CAST(i AS BIGINT) AS i, sin(pi() * z) / (pi() * z) * (sin(pi() * z / 3) / (pi() * z / 3)) AS v FROM k0 WHERE abs(z) < 3 AND i >= trunc(greatest((o + 0.5) * 2 - 5.5, 0)) AND i < trunc((o + 0.5) * 2 + 6.5)),
kn AS MATERIALIZED (SELECT o, i, v / sum(v) OVER (PARTITION BY o) AS v FROM k1)"""


def _whole(x: str) -> str:
    return f"least(greatest(floor(round({x}, 6) + 0.5), 0), 255)"


_WINDOWS = (
    _PIXELS.rstrip()
    + f""", nd AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS wsi_id, (o_orderkey // 5) // w AS c, (o_orderkey // 5) % w AS r FROM orders, w WHERE o_totalprice > 20000),
ni AS (SELECT *, row_number() OVER (PARTITION BY wsi_id ORDER BY c, r) - 1 AS node_id FROM nd),
pt AS (SELECT wsi_id, node_id, {SIDE // 2} * c AS x, {SIDE // 2} * r + CASE WHEN c % 2 = 1 THEN {SIDE // 4} ELSE 0 END AS y FROM ni),
{_KERNEL},
wi AS (SELECT pt.wsi_id, node_id, i, j, coalesce(red, 255) AS red, coalesce(green, 255) AS green, coalesce(blue, 255) AS blue
    FROM pt CROSS JOIN (SELECT unnest(generate_series(0, {SIDE - 1})) AS i) CROSS JOIN (SELECT unnest(generate_series(0, {SIDE - 1})) AS j) LEFT JOIN p1 ON p1.wsi_id = pt.wsi_id AND p1.x = pt.x + i AND p1.y = pt.y + j),
ac AS (SELECT wsi_id, node_id, j, o, {_whole("sum(v * red)")} AS red, {_whole("sum(v * green)")} AS green, {_whole("sum(v * blue)")} AS blue FROM wi JOIN kn ON kn.i = wi.i GROUP BY wsi_id, node_id, j, o),
dn AS (SELECT wsi_id, node_id, ac.o AS x, kn.o AS y, CAST({_whole("sum(v * red)")} AS BIGINT) AS red, CAST({_whole("sum(v * green)")} AS BIGINT) AS green, CAST({_whole("sum(v * blue)")} AS BIGINT) AS blue FROM ac JOIN kn ON kn.i = ac.j GROUP BY wsi_id, node_id, ac.o, kn.o)
"""
)


_PATCH_SUMS = _WINDOWS + "SELECT wsi_id, node_id, CAST(sum(red) AS BIGINT) AS red, CAST(sum(green) AS BIGINT) AS green, CAST(sum(blue) AS BIGINT) AS blue, CAST(sum((red + green + blue) * (1 + x + 31 * y)) AS BIGINT) AS mark FROM dn GROUP BY ALL"


@query(_PATCH_SUMS)
def raster_patches(spark, sf):
    got = _windows(_files(spark, sf), X.nodes(spark, sf)).withColumn("side", F.lit(SIDE // 2))
    return _summed(got.select("wsi_id", "node_id", "side", "pixels"), "side", "side").drop("side")


@query(_PIXELS.rstrip() + f""", nd AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS wsi_id, (o_orderkey // 5) // w AS c, (o_orderkey // 5) % w AS r, w FROM orders, w),
ok AS (SELECT wsi_id, c, r, 2 * c AS x1, 2 * r + c % 2 AS y1 FROM nd WHERE c < w AND {SIDE} * r + CASE WHEN c % 2 = 1 THEN {SIDE // 2} ELSE 0 END + {SIDE} <= {SIDE} * w)
SELECT ok.wsi_id, ok.c, ok.r, avg(CASE WHEN CAST(0.2989 AS DOUBLE) * red + CAST(0.5870 AS DOUBLE) * green + CAST(0.1140 AS DOUBLE) * blue <= 130 THEN 1.0 ELSE 0.0 END) AS tissue_share
FROM ok JOIN p2 ON p2.wsi_id = ok.wsi_id AND p2.x >= x1 AND p2.x < x1 + 2 AND p2.y >= y1 AND p2.y < y1 + 2 GROUP BY ALL HAVING tissue_share > 0.5""")
def raster_tissue(spark, sf):
    """Tiles of the grid whose share of tissue in a small picture, the level that fits a fourth of the size, is over a half."""
    files = _files(spark, sf)
    w = X.edge_tiles(spark, sf)
    best = raster.best_level(raster.levels(files), LEVELS + 1.5).select("wsi_id", "band", "path", "level")
    o = X.table(spark, sf, "orders").select((F.col("o_orderkey") % 5).cast("int").alias("wsi_id"), F.expr("o_orderkey div 5").alias("k"))
    t = o.select("wsi_id", F.expr(f"k div {w}").alias("c"), (F.col("k") % w).alias("r")).filter(F.col("c") < w)
    t = t.withColumn("px", F.col("c") * SIDE).withColumn("py", F.col("r") * SIDE + F.when(F.col("c") % 2 == 1, SIDE // 2).otherwise(0)).filter(F.col("py") + SIDE <= w * SIDE)
    thumb = w * SIDE // 4
    t = grid.thumbnail_window(t.withColumn("tile", F.lit(SIDE)), 4.0, thumb, thumb)
    t = t.select("wsi_id", "c", "r", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).cast("int").alias("width"), (F.col("y2") - F.col("y1")).cast("int").alias("height"))
    got = raster.read_windows(t, best, None, BAND // 4)
    return raster.tissue_share(got, 130).filter("tissue_share > 0.5").select("wsi_id", "c", "r", "tissue_share")


def _encoded(spark, sf, name):
    files = _files(spark, sf)
    index = cut(spark, X.index(spark, sf), "index")
    held, made = shared_path(spark, "patches"), shared_path(spark, "embeddings")
    store.materialise(spark, index, held, lambda rows: _windows(files, rows), f"{held}-meta", size=SIDE // 2)
    fitted = None
    if name.startswith("components"):
        fitted = encoders.fit(store.load_patches(spark, held), name, SIDE // 2)
    store.materialise_embeddings(spark, index, held, made, lambda rows: encoders.encode(rows.select("wsi_id", "global_idx", "pixels"), name, SIDE // 2, fitted), f"{made}-meta", model=name)
    return store.load_embeddings(spark, index, made, encoders.ENCODERS[name].dim)


def _coarse(name: str, channel: int) -> str:
    """The mean of a channel in steps of eight. Patches of 16 pixels have means in sixteenths, and steps begin in between, at
    places that half precision does not reach over: values near the ends, where it is coarser, are one step."""
    mean, deviation = CHANNELS["photographs"]
    return f"floor((least(greatest({name}, 8), 216) + 0.03125) / 8)".replace(name, f"(({name} * {deviation[channel]} + {mean[channel]}) * 255)")


def _steps_sql(name: str) -> str:
    return f"CAST(floor((least(greatest(avg({name}), 8), 216) + 0.03125) / 8) AS BIGINT) AS {name}"


@query(_WINDOWS + f", ix AS (SELECT wsi_id, node_id, row_number() OVER (ORDER BY wsi_id, node_id) - 1 AS global_idx FROM ni) SELECT global_idx, {', '.join(map(_steps_sql, ('red', 'green', 'blue')))} FROM dn JOIN ix ON ix.wsi_id = dn.wsi_id AND ix.node_id = dn.node_id GROUP BY global_idx")
def patch_encoding(spark, sf):
    """Patches of all nodes and their vectors by an encoder of the registry, both made through stores that go on where they
    stopped; of the vectors, the means of the channels in coarse steps."""
    e = _encoded(spark, sf, "colours").select("global_idx", *(F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(("red", "green", "blue"))))
    return e.select("global_idx", *(F.expr(_coarse(c, k)).cast("long").alias(c) for k, c in enumerate(("red", "green", "blue"))))


@query(None)
def patch_components(spark, sf):
    """Vectors of all patches by an encoder that is fitted on them."""
    return _encoded(spark, sf, "components16").select("global_idx", "embedding")


@query(_PATCH_SUMS)
def patches_as_a_stream(spark, sf):
    """Patches of slides that come one after the other, a file of nodes each."""
    files, inbox, out = _files(spark, sf), shared_path(spark, "inbox"), shared_path(spark, "streamed")
    nodes = X.nodes(spark, sf).select("wsi_id", "node_id", "c", "r")
    nodes.repartition("wsi_id").write.parquet(inbox)
    streaming.take_in(spark, inbox, "wsi_id int, node_id long, c long, r long", out, f"{out}-state", lambda rows: _windows(files, rows), ("wsi_id", "node_id"), 1)
    got = streaming.read(spark, out)
    return _summed(got.withColumn("side", F.lit(SIDE // 2)).select("wsi_id", "node_id", "side", "pixels"), "side", "side").drop("side")
