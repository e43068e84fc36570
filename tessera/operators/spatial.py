"""Points in polygons, and which polygon names a tile.

A polygon is an array of rings, a ring an array of points (x, y), closed or not. A point is within if it is inside by
the even-odd rule over all rings and on no edge. A polygon is covered by square cells of a quadtree: of cells that no side
touches those inside are kept as they are, and all their points are within; cells on the border, of the smallest size, hold
the sides that a point in them is tested with. The join is an equi-join on (slide, level, cell), so many polygons or points
make no nested loop, and a polygon of very many points is not copied into each of its cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config

#: The largest cells, how many cells of the next size are along the edge of one, and how many sizes there are.
CELL, SPLIT, LEVELS = 4096, 4, 3


def _sides(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(ring, (i + 1) % n)["x"].alias("x2"), F.get(ring, (i + 1) % n)["y"].alias("y2")))


def within(rings: Column, x: Column, y: Column) -> Column:
    return inside(F.flatten(F.transform(rings, _sides)), x, y)


def inside(sides: Column, x: Column, y: Column) -> Column:
    """Whether a point is within a polygon of these sides; those that its level line does not meet, or that lie left of it,
    may be missing."""

    def crosses(s: Column) -> Column:
        cut = (s["x2"] - s["x1"]) * (y - s["y1"]) / F.when(s["y1"] == s["y2"], F.lit(1.0)).otherwise(s["y2"] - s["y1"]) + s["x1"]
        return ((s["y1"] > y) != (s["y2"] > y)) & (x < cut)

    def on(s: Column) -> Column:
        area = (s["x2"] - s["x1"]) * (y - s["y1"]) - (s["y2"] - s["y1"]) * (x - s["x1"])
        box = x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"]))
        return (area == 0) & box

    return (F.size(F.filter(sides, crosses)) % 2 == 1) & ~F.exists(sides, on)


def ring_area(ring: Column) -> Column:
    """Area of one ring, by the shoelace rule."""
    return F.abs(F.aggregate(_sides(ring), F.lit(0.0), lambda a, s: a + s["x1"] * s["y2"] - s["x2"] * s["y1"])) / 2


def area(rings: Column) -> Column:
    """Of a polygon: its first ring less the others, its holes."""
    return ring_area(F.get(rings, F.lit(0))) - F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1))), F.lit(0.0), lambda a, r: a + ring_area(r))


def _is_object(value: Column) -> Column:
    """Whether text is a JSON object, with single or double quotes."""
    text = F.trim(value)
    return text.startswith("{") & text.endswith("}") & F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull()


def extract_label(value: Column) -> Column:
    """The class in an annotation's text: null is background, an object's name (background without), other text is
    itself, that in braces that do not parse too."""
    name = F.coalesce(F.get_json_object(F.trim(value), "$.name"), F.lit(config.BACKGROUND))
    return F.when(value.isNull(), config.BACKGROUND).when(_is_object(value), name).otherwise(value)


def extract_label_for_counts(value: Column) -> Column:
    """The class as the counts of classes name it: an object's name (unknown without), other text is itself, null is None."""
    name = F.coalesce(F.get_json_object(F.trim(value), "$.name"), F.lit("unknown"))
    return F.when(value.isNull(), "None").when(_is_object(value), name).otherwise(value)


def outlines(polygons: DataFrame) -> DataFrame:
    """(wsi_id, poly_id, cls, ring, point, x, y) of each point of each ring."""
    rings = polygons.select("wsi_id", "poly_id", "cls", F.posexplode("rings").alias("ring", "points"))
    return rings.select("wsi_id", "poly_id", "cls", "ring", F.posexplode("points").alias("point", "p")).select("wsi_id", "poly_id", "cls", "ring", "point", "p.x", "p.y")


def _touches(sides: np.ndarray, x: float, y: float, size: float) -> np.ndarray:
    """Which of the sides (x1, y1, x2, y2) share a point with a square."""
    x1, y1, x2, y2 = sides.T
    box = (np.minimum(x1, x2) <= x + size) & (np.maximum(x1, x2) >= x) & (np.minimum(y1, y2) <= y + size) & (np.maximum(y1, y2) >= y)
    at = [(x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1) for cx in (x, x + size) for cy in (y, y + size)]
    return box & (np.min(at, 0) <= 0) & (np.max(at, 0) >= 0)


def _odd(sides: np.ndarray, x: float, y: float) -> bool:
    x1, y1, x2, y2 = sides.T
    over = (y1 > y) != (y2 > y)
    meets = (x2 - x1)[over] * (y - y1[over]) / (y2 - y1)[over] + x1[over]
    return bool((x < meets).sum() % 2)


def cells_of(sides: np.ndarray, cell: int, levels: int = LEVELS) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """(level, column, row, sides) of the cells that cover a polygon of sides (x1, y1, x2, y2): None for cells inside."""
    if not len(sides) or not np.isfinite(sides).all():
        return
    xs, ys = sides[:, [0, 2]], sides[:, [1, 3]]
    cols, rows = (np.arange(np.floor(v.min() / cell), np.floor(v.max() / cell) + 1) for v in (xs, ys))
    everything = np.arange(len(sides))
    stack = [(0, int(c), int(r), everything, everything) for r in rows for c in cols]
    while stack:
        level, c, r, near, band = stack.pop()
        size = cell / SPLIT**level
        x, y = c * size, r * size
        near = near[_touches(sides[near], x - 1e-6, y - 1e-6, size + 2e-6)]
        # Sides that the level lines of the cell's points may meet to the right of them.
        band = band[(ys[band].min(1) <= y + size) & (ys[band].max(1) >= y) & (xs[band].max(1) >= x - 1)]
        if not len(near):
            if _odd(sides[band], x + size / 2, y + size / 2):
                yield level, c, r, None
        elif level == levels - 1:
            # Sides right of the cell that reach over all its height are met by the level line of any of its points.
            over = (xs[band].min(1) > x + size) & (ys[band].min(1) < y) & (ys[band].max(1) > y + size)
            yield level, c, r, sides[np.append(band[~over], band[over][: over.sum() % 2])]
        else:
            stack += [(level + 1, c * SPLIT + i, r * SPLIT + j, near, band) for i in range(SPLIT) for j in range(SPLIT)]


def cover(polygons: DataFrame, cell: int = CELL) -> DataFrame:
    """polygons (wsi_id, poly_id, cls, area, rings) as rows (wsi_id, poly_id, cls, area, level, cell_x, cell_y, sides), sides
    null for cells that are all inside. Polygons without points, or with one that is null, have no cells."""
    names = ["wsi_id", "poly_id", "cls", "area"]
    kinds = {f.name: f.dataType.simpleString() for f in polygons.schema.fields}
    side = pa.struct([(k, pa.float64()) for k in ("x1", "y1", "x2", "y2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(batch.schema.get_field_index("rings"))
            for i in range(batch.num_rows):
                if not held[i].is_valid:
                    continue
                sides = [np.zeros((0, 4))]
                for ring in held[i].values:
                    if ring.is_valid and len(ring.values):
                        p = np.stack([ring.values.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in ("x", "y")], 1)
                        sides.append(np.concatenate([p, np.roll(p, -1, 0)], 1))
                found = list(cells_of(np.concatenate(sides), cell))
                for at in range(0, len(found), 1024):
                    part = found[at : at + 1024]
                    flat = np.concatenate([np.zeros((0, 4)), *(s for *_, s in part if s is not None)])
                    values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], fields=list(side))
                    ends = np.cumsum([0, *(0 if s is None else len(s) for *_, s in part)])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([s is None for *_, s in part]))
                    own = batch.slice(i, 1).select(names).take(pa.array(np.zeros(len(part), np.int64)))
                    yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([f[k] for f in part], pa.int64()) for k in range(3)), lists], names=[*names, "level", "cell_x", "cell_y", "sides"])

    kind = ", ".join(f"{n} {kinds[n]}" for n in names)
    return polygons.select(*names, "rings").mapInArrow(run, f"{kind}, level long, cell_x long, cell_y long, sides array<struct<x1: double, y1: double, x2: double, y2: double>>")


def near_cells(points: DataFrame, polygons: DataFrame, cell: int = CELL) -> DataFrame:
    """points (wsi_id, node_id, cx, cy) with the cells of polygons that they lie in, whether within or on the border."""
    at = [F.struct(F.lit(k).cast("long").alias("level"), *(F.floor(F.col(f"c{v}") * SPLIT**k / cell).cast("long").alias(f"cell_{v}") for v in "xy")) for k in range(LEVELS)]
    p = points.select("wsi_id", "node_id", "cx", "cy", F.inline(F.array(*at)))
    return p.join(cover(polygons, cell), ["wsi_id", "level", "cell_x", "cell_y"])


def point_in_polygon(points: DataFrame, polygons: DataFrame, cell: int = CELL) -> DataFrame:
    """points (wsi_id, node_id, cx, cy) with each polygon (wsi_id, poly_id, cls, area, rings) that they are within."""
    near = near_cells(points, polygons, cell)
    return near.filter(F.col("sides").isNull() | inside(F.col("sides"), F.col("cx"), F.col("cy"))).select("wsi_id", "node_id", "poly_id", "cls", "area")


def annotate(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Adds label: a fine class before a coarse one, then the smallest polygon, then the smallest poly_id; background without."""
    order = F.struct(F.col("cls").isin(*config.EXCLUDED), F.col("area"), F.col("poly_id"))
    best = matches.filter("cls IS NOT NULL").groupBy("wsi_id", "node_id").agg(F.min_by("cls", order).alias("label"))
    return nodes.join(best, ["wsi_id", "node_id"], "left").withColumn("label", F.coalesce("label", F.lit(config.BACKGROUND)))


def annotate_last(nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """The older rule: the last polygon wins."""
    best = matches.groupBy("wsi_id", "node_id").agg(F.max_by("cls", "poly_id").alias("old_label"))
    return nodes.join(best, ["wsi_id", "node_id"], "left").withColumn("old_label", F.coalesce("old_label", F.lit(config.BACKGROUND)))
