"""The registered queries over the test tables, each with SQL that another engine can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import cut, draw
from tessera.operators import graph, grid, metrics, sequences, spatial, walk_pipeline
from tessera.plans import drawn_walks as W
from tessera.plans import fixture as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- grid -------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT CAST(ceil(sqrt(count(*) / 5.0)) AS BIGINT) AS w FROM orders),
m AS (SELECT r_regionkey AS wsi_id, 448 * w AS side, [CAST(0.25 AS DOUBLE), 0.2, NULL, 0.5, 2.0][r_regionkey % 5 + 1] AS mpp FROM region, w),
s AS (SELECT *, greatest(1, CAST(round_even(CAST(0.5 AS DOUBLE) / coalesce(mpp, 0.25), 0) AS BIGINT)) AS scale FROM m)
SELECT wsi_id, scale, 224 * scale AS tile, 112 * scale AS half, side // (224 * scale) AS cols, side // (224 * scale) AS rows FROM s""")
def slide_geometry(spark, sf):
    """Slides of five resolutions, one of them missing."""
    mpp = F.element_at(F.array(*map(F.lit, (0.25, 0.2, None, 0.5, 2.0))), F.col("wsi_id") % 5 + 1)
    return grid.slide_geometry(X.slides(spark, sf).withColumn("mpp", mpp)).select("wsi_id", "scale", "tile", "half", "cols", "rows")


@query("""WITH w AS (SELECT CAST(ceil(sqrt(count(*) / 5.0)) AS BIGINT) AS w FROM orders), g AS (SELECT r_regionkey AS wsi_id, c, r, w, 448 * c AS px, 448 * r + CASE WHEN c % 2 = 1 THEN 224 ELSE 0 END AS py
    FROM region, w, (SELECT unnest(generate_series(0, w - 1)) AS c FROM w), (SELECT unnest(generate_series(0, w - 1)) AS r FROM w))
SELECT wsi_id, c, r, px, py, px + 224 AS cx, py + 224 AS cy FROM g WHERE py + 448 <= 448 * w""")
def hex_grid(spark, sf):
    return grid.hex_grid(grid.slide_geometry(X.slides(spark, sf)))


@query(X.BASE + "SELECT wsi_id, node_id, c, r, cx, cy FROM nodes")
def grid_nodes(spark, sf):
    return X.nodes(spark, sf).select("wsi_id", "node_id", "c", "r", "cx", "cy")


@query("""SELECT CAST(l_suppkey AS BIGINT) AS tile_key, avg(CASE WHEN 0.2989 * (l_quantity * 5) + 0.5870 * (l_partkey % 256) + 0.1140 * (l_linenumber * 36) <= 130 THEN 1.0 ELSE 0.0 END) AS tissue_share
FROM lineitem GROUP BY l_suppkey HAVING avg(CASE WHEN 0.2989 * (l_quantity * 5) + 0.5870 * (l_partkey % 256) + 0.1140 * (l_linenumber * 36) <= 130 THEN 1.0 ELSE 0.0 END) > 0.5""")
def tissue_filter(spark, sf):
    px = X.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("tile_key"), (F.col("l_quantity") * 5).alias("red"), (F.col("l_partkey") % 256).alias("green"), (F.col("l_linenumber") * 36).alias("blue"))
    return grid.tissue_filter(grid.luma_mask(px, 130), ["tile_key"])


@query("""WITH w AS (SELECT CAST(ceil(sqrt(count(*) / 5.0)) AS BIGINT) AS w FROM orders), g AS (SELECT r_regionkey AS wsi_id, c, r, w, 448 * c AS px, 448 * r + CASE WHEN c % 2 = 1 THEN 224 ELSE 0 END AS py
    FROM region, w, (SELECT unnest(generate_series(3, 3 + least(w - 3, 8) - 1)) AS c FROM w), (SELECT unnest(generate_series(2, w - 1)) AS r FROM w))
SELECT wsi_id, c, r, px, py, px + 224 AS cx, py + 224 AS cy FROM g WHERE py + 448 <= 448 * w""")
def grid_window(spark, sf):
    """Tiles of at most 8 columns from the fourth on, and of the rows from the third on."""
    return grid.hex_grid(grid.slide_geometry(X.slides(spark, sf), 3, 2, 8, 0), 3, 2)


@query(X.BASE + """, b AS (SELECT wsi_id, node_id, CAST(trunc(px / 33.5) AS BIGINT) AS x1, CAST(trunc(py / 33.5) AS BIGINT) AS y1, least(CAST(trunc((px + 448) / 33.5) AS BIGINT), 13 * w - 40) AS x2, least(CAST(trunc((py + 448) / 33.5) AS BIGINT), 13 * w - 40) AS y2 FROM nodes, w)
SELECT * FROM b WHERE x1 < x2 AND y1 < y2""")
def thumbnail_window(spark, sf):
    side = 13 * X.edge_tiles(spark, sf) - 40
    tiles = X.nodes(spark, sf).withColumn("tile", F.lit(X.TILE))
    return grid.thumbnail_window(tiles, 33.5, side, side).select("wsi_id", "node_id", "x1", "y1", "x2", "y2")


@query(X.BASE + """, p AS (SELECT event_id, CAST(user_id % 5 AS INTEGER) AS wsi_id, CAST(event_id * 37 % (448 * w) AS BIGINT) AS x, CAST(event_id * 91 % (448 * w) AS BIGINT) AS y FROM events, w),
q AS (SELECT *, x // 448 AS c, CAST(floor((y - CASE WHEN (x // 448) % 2 = 1 THEN 224 ELSE 0 END) / 448.0) AS BIGINT) AS r FROM p)
SELECT q.event_id, q.wsi_id, q.c, q.r, n.node_id FROM q LEFT JOIN nodes n ON n.wsi_id = q.wsi_id AND n.c = q.c AND n.r = q.r""")
def spatial_lookup(spark, sf):
    side = X.edge_tiles(spark, sf) * X.TILE
    e = X.table(spark, sf, "events").select("event_id", (F.col("user_id") % 5).cast("int").alias("wsi_id"), (F.col("event_id") * 37 % side).alias("x"), (F.col("event_id") * 91 % side).alias("y"))
    return grid.spatial_lookup(e, X.nodes(spark, sf), X.TILE).select("event_id", "wsi_id", "c", "r", "node_id")


@query(X.BASE + "SELECT r_regionkey AS wsi_id, k.c AS cc, k.r AS cr, n.node_id FROM region, (SELECT DISTINCT c, r FROM nodes) k LEFT JOIN nodes n ON n.wsi_id = r_regionkey AND n.c = k.c AND n.r = k.r")
def chess_to_brick(spark, sf):
    n = X.nodes(spark, sf)
    cells = n.select("c", "r").distinct().withColumn("wsi_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    pts = cells.select("wsi_id", F.col("c").alias("cc"), F.col("r").alias("cr"), (F.col("c") * X.TILE + X.TILE // 2).alias("x"), (F.col("r") * X.TILE + X.TILE // 2).alias("y"))
    return grid.spatial_lookup(pts, n, X.TILE).select("wsi_id", "cc", "cr", "node_id")


# --- labels -----------------------------------------------------------------------------------------------------


@query(X.BASE + "SELECT wsi_id, node_id, CAST(poly_id AS BIGINT) AS poly_id, cls FROM m")
def point_in_polygon(spark, sf):
    return X.matches(spark, sf).select("wsi_id", "node_id", F.col("poly_id").cast("long").alias("poly_id"), "cls")


@query(X.BASE + "SELECT wsi_id, node_id, label FROM lab")
def annotation_priority(spark, sf):
    return X.labelled(spark, sf).select("wsi_id", "node_id", "label")


@query(X.BASE + "SELECT wsi_id, label, count(*) AS n_nodes FROM lab GROUP BY ALL")
def label_distribution(spark, sf):
    return X.labelled(spark, sf).groupBy("wsi_id", "label").agg(F.count("*").alias("n_nodes"))


def _raw_labels(spark, sf):
    """Events with a class as annotation files write it: none, an object with and without a name, a name, and braces that are no object."""
    k, t = F.col("event_id") % 5, F.col("event_type")
    raw = F.when(k == 0, F.lit(None)).when(k == 1, F.to_json(F.struct(t.alias("name")))).when(k == 2, F.lit('{"color": 3}')).when(k == 3, t).otherwise(F.concat(F.lit("{"), t, F.lit("}")))
    return X.table(spark, sf, "events").select("event_id", raw.alias("raw"))


@query("SELECT event_id, CASE WHEN event_id % 5 IN (0, 2) THEN 'background' WHEN event_id % 5 = 4 THEN '{' || event_type || '}' ELSE event_type END AS label FROM events")
def extract_label(spark, sf):
    return _raw_labels(spark, sf).select("event_id", spatial.extract_label(F.col("raw")).alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'None' WHEN event_id % 5 = 2 THEN 'unknown' WHEN event_id % 5 = 4 THEN '{' || event_type || '}' ELSE event_type END AS label FROM events")
def extract_label_for_counts(spark, sf):
    return _raw_labels(spark, sf).select("event_id", spatial.extract_label_for_counts(F.col("raw")).alias("label"))


@query(X.BASE + "SELECT label, count(*) AS n_nodes, count(DISTINCT wsi_id) AS n_slides FROM lab GROUP BY label")
def label_totals(spark, sf):
    return X.labelled(spark, sf).groupBy("label").agg(F.count("*").alias("n_nodes"), F.countDistinct("wsi_id").alias("n_slides"))


@query(X.BASE + "SELECT wsi_id, CAST(poly_id AS BIGINT) AS poly_id, cls, i AS ring_point, x0 + s * CASE WHEN i IN (1, 2) THEN 1 ELSE 0 END AS x, y0 + s * CASE WHEN i IN (2, 3) THEN 1 ELSE 0 END AS y FROM poly, (SELECT unnest(generate_series(0, 3)) AS i)")
def polygon_outlines(spark, sf):
    """The points of each ring, for drawing."""
    return spatial.outlines(X.polygons(spark, sf)).select("wsi_id", F.col("poly_id").cast("long").alias("poly_id"), "cls", F.col("point").cast("long").alias("ring_point"), "x", "y")


@query(X.BASE + "SELECT wsi_id, src, dst, src_label, dst_label FROM e WHERE src < dst AND wsi_id = 2")
def one_slide_graph(spark, sf):
    """The labelled graph of the slide of that name."""
    return grid.edges(spark, graph.one_slide(spark, X.labelled(spark, sf), 2))


@query(X.BASE + "SELECT wsi_id, count(*) AS n_matched, count(*) FILTER (WHERE k > 1) AS n_overlapping, max(k) AS most FROM (SELECT wsi_id, node_id, count(*) AS k FROM m GROUP BY ALL) GROUP BY wsi_id")
def overlap_stats(spark, sf):
    per = X.matches(spark, sf).groupBy("wsi_id", "node_id").agg(F.count("*").alias("k"))
    return per.groupBy("wsi_id").agg(F.count("*").alias("n_matched"), F.count_if(F.col("k") > 1).alias("n_overlapping"), F.max("k").alias("most"))


@query(X.BASE + ", old AS (SELECT wsi_id, node_id, arg_max(cls, poly_id) AS old_label FROM m GROUP BY ALL) SELECT coalesce(old_label, 'background') AS old_label, label, count(*) AS n FROM lab LEFT JOIN old ON old.wsi_id = lab.wsi_id AND old.node_id = lab.node_id WHERE coalesce(old_label, 'background') <> label GROUP BY ALL ORDER BY n DESC, old_label, label LIMIT 12")
def label_transitions(spark, sf):
    both = spatial.annotate_last(X.labelled(spark, sf), X.matches(spark, sf)).filter("old_label <> label")
    return both.groupBy("old_label", "label").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "old_label", "label").limit(12)


@query(X.BASE + f"SELECT label, count(*) AS n FROM lab WHERE label NOT IN ({X._EXCLUDED}) GROUP BY label ORDER BY n DESC, label LIMIT 3")
def top_classes(spark, sf):
    n = X.labelled(spark, sf).filter(~F.col("label").isin(*config.EXCLUDED)).groupBy("label").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "label").limit(3)


_STATS = ", st AS (SELECT wsi_id AS slide, cls AS class, area / 50176 AS patches FROM poly)"


def _stats(spark, sf):
    p = X.polygons(spark, sf)
    return p.select(F.col("wsi_id").alias("slide"), F.col("cls").alias("class"), (F.col("area") / config.PATCH**2).alias("patches"))


@query(X.BASE + _STATS + "SELECT class, count(*) AS polygons, round(sum(patches), 3) AS patches, round(100 * sum(patches) / sum(sum(patches)) OVER (), 6) AS pct FROM st GROUP BY class")
def class_balance_global(spark, sf):
    g = _stats(spark, sf).groupBy("class").agg(F.count("*").alias("polygons"), F.sum("patches").alias("p"))
    return g.select("class", "polygons", F.round("p", 3).alias("patches"), F.round(100 * F.col("p") / F.sum("p").over(Window.partitionBy()), 6).alias("pct"))  # a row for each class


@query(X.BASE + _STATS + "SELECT slide, class, count(*) AS polygons, round(sum(patches), 3) AS patches FROM st GROUP BY ALL")
def class_balance_per_slide(spark, sf):
    return _stats(spark, sf).groupBy("slide", "class").agg(F.count("*").alias("polygons"), F.round(F.sum("patches"), 3).alias("patches"))


@query(X.BASE + _STATS + "SELECT round(max(p) / min(p), 6) AS ratio FROM (SELECT sum(patches) AS p FROM st GROUP BY class)")
def imbalance_ratio(spark, sf):
    return _stats(spark, sf).groupBy("class").agg(F.sum("patches").alias("p")).agg(F.round(F.coalesce(F.try_divide(F.max("p"), F.min("p")), F.lit(float("inf"))), 6).alias("ratio"))


@query(X.BASE + "SELECT wsi_id, " + ", ".join(f"count(*) FILTER (WHERE label = '{c}') AS \"{c}\"" for c in config.LABELS) + " FROM lab GROUP BY wsi_id")
def slide_class_pivot(spark, sf):
    return X.labelled(spark, sf).groupBy("wsi_id").pivot("label", list(config.LABELS)).count().na.fill(0)


# --- graph ------------------------------------------------------------------------------------------------------


@query(X.BASE + "SELECT global_idx, wsi_id, node_id, label, label_id FROM idx")
def node_index(spark, sf):
    return X.index(spark, sf).select("global_idx", "wsi_id", "node_id", "label", "label_id")


@query(X.BASE + "SELECT wsi_id, node_id, label FROM lab WHERE label <> 'background'")
def drop_label_nodes(spark, sf):
    return graph.drop_label(X.labelled(spark, sf), "background").select("wsi_id", "node_id", "label")


@query(X.BASE + f"SELECT wsi_id, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(sha, ',' ORDER BY chunk)) AS sha256 FROM (SELECT wsi_id, global_idx // {graph.CHUNK} AS chunk, count(*) AS n, sha256(string_agg(px || '|' || py, ',' ORDER BY global_idx)) AS sha FROM idx GROUP BY ALL) GROUP BY wsi_id")
def index_fingerprint(spark, sf):
    return graph.fingerprint(X.index(spark, sf))


@query(X.BASE + "SELECT wsi_id, src, dst FROM e WHERE src < dst")
def hex_edges(spark, sf):
    return grid.edges(spark, X.nodes(spark, sf)).select("wsi_id", "src", "dst")


@query(X.BASE + "SELECT n.wsi_id, n.node_id, count(e.dst) AS degree FROM nodes n LEFT JOIN e ON e.wsi_id = n.wsi_id AND e.src = n.node_id GROUP BY ALL")
def node_degree(spark, sf):
    n = X.nodes(spark, sf)
    d = grid.neighbours(spark, n).groupBy("wsi_id", F.col("src").alias("node_id")).agg(F.count("*").alias("d"))
    return n.select("wsi_id", "node_id").join(d, ["wsi_id", "node_id"], "left").select("wsi_id", "node_id", F.coalesce("d", F.lit(0)).alias("degree"))


@query(X.BASE + "SELECT n.wsi_id, n.n_nodes, x.n_edges FROM (SELECT wsi_id, count(*) AS n_nodes FROM nodes GROUP BY wsi_id) n JOIN (SELECT wsi_id, count(*) AS n_edges FROM e WHERE src < dst GROUP BY wsi_id) x ON x.wsi_id = n.wsi_id")
def graph_stats(spark, sf):
    n = X.nodes(spark, sf)
    return n.groupBy("wsi_id").agg(F.count("*").alias("n_nodes")).join(grid.edges(spark, n).groupBy("wsi_id").agg(F.count("*").alias("n_edges")), "wsi_id")


def _regions(spark, sf):
    return graph.region_sizes(graph.regions(spark, X.labelled(spark, sf)))


@query(X.BASE + X.REGIONS + "SELECT wsi_id, label, root, n_nodes, component_id FROM reg")
def region_components(spark, sf):
    return _regions(spark, sf).select("wsi_id", "label", "root", "n_nodes", "component_id")


@query(X.BASE + X.REGIONS + "SELECT label, n_regions, n_nodes, capacity, target FROM cap")
def class_capacity(spark, sf):
    return graph.class_capacity(_regions(spark, sf))


@query(X.BASE + X.REGIONS + """, rk AS (SELECT reg.*, row_number() OVER (PARTITION BY reg.label ORDER BY reg.n_nodes DESC, wsi_id, root) - 1 AS size_rank, cap.target, cap.n_nodes AS total FROM reg JOIN cap ON cap.label = reg.label),
al(label, size_rank, lft, nds, alloc) AS (SELECT label, CAST(-1 AS BIGINT), target, total, CAST(0 AS BIGINT) FROM rk WHERE size_rank = 0
    UNION ALL SELECT al.label, rk.size_rank, al.lft - a, al.nds - rk.n_nodes, a FROM al JOIN rk ON rk.label = al.label AND rk.size_rank = al.size_rank + 1,
    LATERAL (SELECT CASE WHEN al.lft <= 0 THEN CAST(0 AS BIGINT) ELSE greatest(1, CAST(round_even(al.lft * rk.n_nodes / al.nds, 0) AS BIGINT)) END AS a))
SELECT rk.wsi_id, rk.label, root, n_nodes, rk.size_rank, alloc, rk.wsi_id || '__' || rk.label || '__' || rk.size_rank AS region_key FROM rk JOIN al ON al.label = rk.label AND al.size_rank = rk.size_rank""")
def balanced_alloc(spark, sf):
    return graph.balanced_allocation(_regions(spark, sf))


# --- walks ------------------------------------------------------------------------------------------------------


def _walks(spark, sf, bounce: bool, same: bool, sharp: int = 1):
    n = cut(spark, X.labelled(spark, sf).select("wsi_id", "node_id", "c", "r", "label"), "labelled")
    return graph.grid_walks(n, X.starts(n, not same), bounce, same, sharp)


@query(X.BASE + X.walk_sql(False, False) + "SELECT wsi_id, walk_id, array_to_string(path, ',') AS path FROM walk")
def walk_stop(spark, sf):
    return _walks(spark, sf, False, False).select("wsi_id", "walk_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(X.BASE + X.walk_sql(True, True) + "SELECT wsi_id, walk_id, array_to_string(path, ',') AS path FROM walk")
def walk_bounce(spark, sf):
    return _walks(spark, sf, True, True).select("wsi_id", "walk_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(X.BASE + X.walk_sql(True, True, 0) + "SELECT wsi_id, walk_id, array_to_string(path, ',') AS path FROM walk")
def walk_bounce_no_sharp(spark, sf):
    """Bouncing walks whose sharp turns have no weight: they count in full only where nothing else is left."""
    return _walks(spark, sf, True, True, 0).select("wsi_id", "walk_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(X.BASE + X.walk_sql(True, True) + "SELECT wsi_id, min(walk_id) AS walk_id, len(least(path, list_reverse(path))) AS path_len FROM walk GROUP BY wsi_id, least(path, list_reverse(path))")
def walk_dedup(spark, sf):
    w = _walks(spark, sf, True, True).withColumn("canonical", F.least("path", F.reverse("path")))
    return w.groupBy("wsi_id", "canonical").agg(F.min("walk_id").alias("walk_id")).select("wsi_id", "walk_id", F.size("canonical").cast("long").alias("path_len"))


_STEPS = X.walk_sql(False, False) + ", sp AS (SELECT wsi_id, walk_id, unnest(path) AS node_id, generate_subscripts(path, 1) AS pos FROM walk), sl AS (SELECT sp.walk_id, pos, idx.* FROM sp JOIN idx ON idx.wsi_id = sp.wsi_id AND idx.node_id = sp.node_id)"


def _indexed(spark, sf, *columns):
    """The nodes and some of their columns, written out."""
    return cut(spark, X.index(spark, sf).select("wsi_id", "node_id", "c", "r", "label", *columns), "indexed")


def _along(spark, sf, *columns, **more):
    """The walks from all nodes with columns of their nodes along them."""
    n = _indexed(spark, sf, *(x for x in columns if x != "label"))
    return graph.grid_walks(n, X.starts(n, True), False, carry=columns, **more)


def _pooled(spark, sf, **how):
    """Means of the embeddings along the walks from all nodes."""
    v = X.table(spark, sf, "embeddings").select("vec_id", "embedding")
    count, width = v.agg(F.count("*"), F.max(F.size("embedding"))).first()
    n = _indexed(spark, sf, (F.col("global_idx") % count).alias("vec_id"))
    return sequences.walk_means(n, X.starts(n, True), v.withColumnRenamed("embedding", "vector"), "vec_id", width, **how)


@query(X.BASE + _STEPS + "SELECT walk_id, arg_max(label, (c, -p)) AS label FROM (SELECT walk_id, label, count(*) AS c, min(pos) AS p FROM sl GROUP BY ALL) GROUP BY walk_id")
def walk_label(spark, sf):
    return _along(spark, sf, "label", fold=sequences.label_of_most, folded="label string").select("walk_id", "label")


@query(X.BASE + _STEPS + "SELECT walk_id, string_agg(global_idx, ',' ORDER BY pos) AS path FROM sl GROUP BY walk_id")
def walk_to_global(spark, sf):
    return _along(spark, sf, "global_idx").select("walk_id", F.array_join(F.col("path_global_idx").cast("array<string>"), ",").alias("path"))


@query(X.BASE + _STEPS + "SELECT walk_id, string_agg(cx || ' ' || cy, ',' ORDER BY pos) AS line FROM sl GROUP BY walk_id")
def walk_polyline(spark, sf):
    points = F.zip_with("path_cx", "path_cy", lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string")))
    return _along(spark, sf, "cx", "cy").select("walk_id", F.array_join(points, ",").alias("line"))


@query(X.BASE + _STEPS + ", v AS (SELECT vec_id, embedding, count(*) OVER () AS n FROM embeddings) SELECT walk_id, dim, round(avg(CAST(x AS DOUBLE)), 5) + 0.0 AS mean FROM (SELECT walk_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM sl JOIN v ON v.vec_id = sl.global_idx % v.n) GROUP BY ALL")
def walk_embedding_mean(spark, sf):
    return _pooled(spark, sf).select("walk_id", "dim", (F.round("value", 5) + F.lit(0.0)).alias("mean"))


_HEADED = X.walk_sql(False, False) + """, sp AS (SELECT wsi_id, walk_id, unnest(path) AS node_id, generate_subscripts(path, 1) - 1 AS pos FROM walk),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, count(*) OVER () AS n FROM embeddings),
hd AS (SELECT walk_id, pos, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM sp JOIN idx ON idx.wsi_id = sp.wsi_id AND idx.node_id = sp.node_id JOIN v ON v.vec_id = idx.global_idx % v.n),
both_ AS (SELECT walk_id, dim, max(x) FILTER (WHERE pos = 0) AS cls, coalesce(avg(x) FILTER (WHERE pos > 0), 0) AS mean FROM hd GROUP BY ALL)"""


@query(X.BASE + _HEADED + "SELECT walk_id, dim, round(cls, 5) + 0.0 AS value FROM both_ UNION ALL SELECT walk_id, dim + 64, round(mean, 5) + 0.0 FROM both_")
def pool_concat(spark, sf):
    """The first node stands in for the head token."""
    return _pooled(spark, sf, head=True).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query(X.BASE + _HEADED + "SELECT walk_id, dim, round(cls, 5) + 0.0 AS value FROM both_")
def pool_cls(spark, sf):
    v = X.table(spark, sf, "embeddings").select("vec_id", "embedding")
    count = v.count()
    # A walk's head is its start.
    n = _indexed(spark, sf, (F.col("global_idx") % count).alias("vec_id"))
    heads = X.starts(n, True).join(n.select("wsi_id", F.col("node_id").alias("start"), "vec_id"), ["wsi_id", "start"]).select("walk_id", "vec_id")
    steps = heads.join(v, "vec_id").select("walk_id", F.lit(0).alias("pos"), "embedding")
    return sequences.pool(steps, "cls").withColumn("value", F.round("value", 5) + F.lit(0.0))


@query(X.BASE + X.walk_sql(False, False) + "SELECT walk_id, array_to_string(list_transform(generate_series(0, 40), lambda i: CASE WHEN i < len(path) + 1 THEN 1 ELSE 0 END), '') AS mask FROM walk")
def valid_mask(spark, sf):
    mask = sequences.valid_mask(F.size("path"), F.lit(config.WALK_MAX))
    return _walks(spark, sf, False, False).select("walk_id", F.array_join(F.transform(mask, lambda x: x.cast("int").cast("string")), "").alias("mask"))


@query(X.BASE + X.walk_sql(False, False) + "SELECT walk_id, array_to_string(path, ',') AS path FROM walk ORDER BY substr(md5('42:' || walk_id), 1, 8), walk_id LIMIT 300")
def walk_sample(spark, sf):
    """At most 300 walks for a picture."""
    w = _walks(spark, sf, False, False)
    return w.orderBy(draw(F.lit(str(config.SEED)), F.col("walk_id").cast("string")), "walk_id").limit(300).select("walk_id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query(W.PER_SLIDE + "SELECT wsi_id, attempt, array_to_string(path, ',') AS path FROM made")
def walks_per_slide(spark, sf):
    """Fifty walks of each slide, over nodes of all labels."""
    return walk_pipeline.slide_walks(spark, cut(spark, X.labelled(spark, sf), "labelled")).select("wsi_id", "attempt", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def _numbered(walks):
    return walks.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query(W.BALANCED + W.FINISHED + W.BY_WALK)
def walk_pipeline_balanced(spark, sf):
    """The whole pipeline: balanced walks, split by walks of each label."""
    return _numbered(walk_pipeline.run(spark, X.labelled(spark, sf)))


@query(W.PER_REGION + W.FINISHED + W.BY_REGION)
def walk_pipeline_holdout(spark, sf):
    """The whole pipeline: thirty walks a region, split by whole regions."""
    return _numbered(walk_pipeline.run(spark, X.labelled(spark, sf), balanced=False, holdout={"default": 1, "SOLIDE": 2}))


# --- splits and samples -----------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT r_regionkey AS wsi_id, row_number() OVER (ORDER BY substr(md5('42:' || r_regionkey), 1, 8), r_regionkey) AS k, count(*) OVER () AS n FROM region)
SELECT wsi_id, CASE WHEN k <= greatest(1, n // 6) THEN 'test' WHEN k <= 2 * greatest(1, n // 6) THEN 'val' ELSE 'train' END AS split FROM s""")
def slide_split(spark, sf):
    return metrics.slide_split(X.table(spark, sf, "region").select(F.col("r_regionkey").alias("wsi_id")))


@query(X.BASE + """, s AS (SELECT global_idx, label, row_number() OVER (PARTITION BY label ORDER BY substr(md5('42:' || global_idx), 1, 8), global_idx) AS k, count(*) OVER (PARTITION BY label) AS n FROM idx)
SELECT global_idx, label, CASE WHEN k <= round_even(n * CAST(0.15000000000000005 AS DOUBLE), 0) THEN 'test' WHEN k <= round_even(n * CAST(0.30000000000000004 AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS split FROM s""")
def stratified_split(spark, sf):
    return metrics.stratified_split(X.index(spark, sf).select("global_idx", "label"), "global_idx", "label")


@query(X.BASE + "SELECT global_idx, label FROM (SELECT global_idx, label, row_number() OVER (PARTITION BY label ORDER BY substr(md5('42:' || global_idx), 1, 8), global_idx) AS k FROM idx) WHERE k <= 200")
def stratified_sample(spark, sf):
    return metrics.stratified_sample(X.index(spark, sf).select("global_idx", "label"), "global_idx", "label", 200)


@query(X.BASE + "SELECT wsi_id, count(*) AS todo FROM idx WHERE global_idx % 3 <> 0 GROUP BY wsi_id")
def resume_antijoin(spark, sf):
    i = X.index(spark, sf).select("wsi_id", "global_idx")
    done = i.filter("global_idx % 3 = 0").select("global_idx")
    return i.join(done, "global_idx", "left_anti").groupBy("wsi_id").agg(F.count("*").alias("todo"))


_KEYED = X.REGIONS + """, hold AS (SELECT lab.node_id, lab.wsi_id, reg.label, ids.label_id, reg.wsi_id || '__' || reg.label || '__' || reg.component_id AS region_key
    FROM reg JOIN cc ON cc.root = reg.wsi_id * 10000000 + reg.root JOIN lab ON lab.wsi_id * 10000000 + lab.node_id = cc.id JOIN ids ON ids.label = reg.label)"""


def _keyed(spark, sf):
    """Nodes of regions in the role of walks: one from each."""
    found = cut(spark, graph.regions(spark, X.labelled(spark, sf)), "regions")
    key = F.concat_ws("__", F.col("wsi_id").cast("string"), "label", F.col("component_id").cast("string"))
    regions = graph.region_sizes(found).withColumn("region_key", key).select("wsi_id", "label", "root", "region_key")
    ids = spark.createDataFrame(list(config.LABELS.items()), "label string, label_id int")
    return found.join(regions, ["wsi_id", "label", "root"]).join(F.broadcast(ids), "label").select("wsi_id", "node_id", "label", "label_id", "region_key")


@query(X.BASE + _KEYED + f""", pr AS (SELECT label, region_key, any_value(label_id) AS label_id, substr(md5('42:' || region_key), 1, 8) AS h FROM hold GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, region_key) AS k FROM pr),
rest AS (SELECT * FROM rk WHERE k > CASE WHEN label = 'SOLIDE' THEN 2 ELSE 1 END),
fw AS (SELECT min(c) AS fewest FROM (SELECT count(*) AS c FROM rest GROUP BY label_id)),
st AS (SELECT region_key, h, CASE WHEN fewest >= 2 THEN label_id ELSE -1 END AS s FROM rest, fw),
tv AS (SELECT region_key, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY h, region_key) <= round_even(count(*) OVER (PARTITION BY s) * CAST({0.15 / (0.70 + 0.15)!r} AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS split FROM st)
SELECT hold.wsi_id, hold.node_id, hold.region_key, coalesce(tv.split, 'test') AS split FROM hold LEFT JOIN tv ON tv.region_key = hold.region_key""")
def holdout_walks(spark, sf):
    return sequences.holdout_walks(_keyed(spark, sf), {"default": 1, "SOLIDE": 2}).select("wsi_id", "node_id", "region_key", "split")


@query(X.BASE + _KEYED + "SELECT region_key, label, count(*) AS n_walks FROM hold GROUP BY ALL")
def walks_per_region(spark, sf):
    return _keyed(spark, sf).groupBy("region_key", "label").agg(F.count("*").alias("n_walks"))


@query(X.BASE + """, s AS (SELECT label_id, label, row_number() OVER (PARTITION BY label ORDER BY substr(md5('42:' || global_idx), 1, 8), global_idx) AS k, count(*) OVER (PARTITION BY label) AS n FROM idx)
SELECT split, string_agg(label_id, ',' ORDER BY label_id) AS classes FROM (SELECT DISTINCT label_id, CASE WHEN k <= round_even(n * CAST(0.15000000000000005 AS DOUBLE), 0) THEN 'test' WHEN k <= round_even(n * CAST(0.30000000000000004 AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS split FROM s) GROUP BY split""")
def split_classes(spark, sf):
    parts = metrics.stratified_split(X.index(spark, sf).select("global_idx", "label", "label_id"), "global_idx", "label")
    return parts.groupBy("split").agg(F.array_join(F.array_sort(F.collect_set("label_id")).cast("array<string>"), ",").alias("classes"))  # classes, of which there are few


@query(X.BASE + "SELECT wsi_id, count(*) AS n, avg(CASE WHEN global_idx % 3 = 0 THEN 1.0 ELSE 0.0 END) AS done_share FROM idx GROUP BY wsi_id")
def completion_ratio(spark, sf):
    done = (F.col("global_idx") % 3 == 0).cast("double")
    return X.index(spark, sf).groupBy("wsi_id").agg(F.count("*").alias("n"), F.avg(done).alias("done_share"))


# --- metrics ----------------------------------------------------------------------------------------------------


@query(X.BASE + X.PRED + ", l AS (SELECT y_true AS y FROM pred UNION SELECT y_pred FROM pred) SELECT a.y AS y_true, b.y AS y_pred, count(pred.y_true) AS n, round(count(pred.y_true) / greatest(sum(count(pred.y_true)) OVER (PARTITION BY a.y), 1), 6) AS share FROM l a CROSS JOIN l b LEFT JOIN pred ON pred.y_true = a.y AND pred.y_pred = b.y GROUP BY a.y, b.y")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(X.predictions(spark, sf)).withColumn("share", F.round("share", 6))


@query(X.BASE + X.REPORT + "SELECT label, support, n_pred, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rep")
def classification_report(spark, sf):
    return metrics.classification_report(X.predictions(spark, sf)).select("label", "support", "n_pred", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(X.BASE + X.REPORT + "SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(avg(f1), 6) AS f1_macro, round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy FROM rep")
def eval_metrics(spark, sf):
    return metrics.eval_metrics(X.predictions(spark, sf)).select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "f1_weighted", "f1_macro", "balanced_accuracy")))


@query(X.BASE + X.REPORT + """SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, CAST(sum(support) AS BIGINT) AS support FROM rep
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rep""")
def report_averages(spark, sf):
    return metrics.report_averages(X.predictions(spark, sf)).select("average", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(X.BASE + X.PRED + "SELECT y_pred, count(*) AS n FROM pred GROUP BY y_pred")
def prediction_distribution(spark, sf):
    return X.predictions(spark, sf).groupBy("y_pred").agg(F.count("*").alias("n"))


@query(X.BASE + "SELECT CAST(k AS INTEGER) AS label_id, count(idx.label_id) AS n, round(sqrt(CASE WHEN count(idx.label_id) > 0 THEN (SELECT count(*) FROM idx) / (14.0 * count(idx.label_id)) ELSE 0 END), 6) AS weight FROM (SELECT unnest(generate_series(0, 13)) AS k) LEFT JOIN idx ON idx.label_id = k GROUP BY k")
def class_weights(spark, sf):
    return metrics.class_weights(spark, X.index(spark, sf), len(config.LABELS)).withColumn("weight", F.round("weight", 6))


@query(X.BASE + "SELECT global_idx, label_id, CAST(dense_rank() OVER (ORDER BY label_id) - 1 AS INTEGER) AS new_id FROM idx WHERE label_id NOT IN (0, 1, 2, 3)")
def filter_remap(spark, sf):
    return metrics.filter_remap(X.index(spark, sf).select("global_idx", "label_id"), [0, 1, 2, 3]).select("global_idx", "label_id", F.col("new_id").cast("int").alias("new_id"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def embedding_norms(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", F.round(metrics.norm(F.col("embedding")), 5).alias("norm"))


_NORMS = "SELECT count(*) AS n, round(avg(x), 5) AS mean, round(min(x), 5) AS least, round(max(x), 5) AS most, round(stddev_pop(x), 5) AS deviation, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) AS zero_share FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS x FROM {})"


def _rounded_norms(v):
    got = metrics.norm_statistics(v, "embedding")
    return got.select("n", *(F.round(c, 5).alias(c) for c in ("mean", "least", "most", "deviation")), "zero_share")


@query(_NORMS.format("embeddings"))
def norm_statistics(spark, sf):
    return _rounded_norms(X.table(spark, sf, "embeddings"))


@query(X.BASE + _NORMS.format("idx JOIN embeddings v ON v.vec_id = idx.global_idx"))
def alignment_norms(spark, sf):
    """Norms of the embeddings that nodes of the index have."""
    return _rounded_norms(X.index(spark, sf).join(X.table(spark, sf, "embeddings"), F.col("global_idx") == F.col("vec_id")))


@query(X.BASE + "SELECT count(*) AS n_nodes, count(v.vec_id) AS n_found, min(len(v.embedding)) AS least_dim, max(len(v.embedding)) AS most_dim FROM idx LEFT JOIN embeddings v ON v.vec_id = idx.global_idx")
def embedding_alignment(spark, sf):
    both = X.index(spark, sf).join(X.table(spark, sf, "embeddings"), F.col("global_idx") == F.col("vec_id"), "left")
    dim = F.size("embedding").cast("long")
    some = F.when(F.col("vec_id").isNotNull(), dim)
    return both.agg(F.count("*").alias("n_nodes"), F.count("vec_id").alias("n_found"), F.min(some).alias("least_dim"), F.max(some).alias("most_dim"))


_HISTORY = "h AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, round(CAST('0x' || substr(md5('h:' || event_id), 1, 8) AS BIGINT) / 4294967296.0, 6) AS va_f1m FROM events)"


def _history(spark, sf):
    """A history for each user: an epoch for each event."""
    epoch = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return X.table(spark, sf, "events").select("user_id", epoch.alias("epoch"), F.round(draw(F.lit("h"), F.col("event_id").cast("string")) / 4294967296, 6).alias("va_f1m"))


@query("WITH " + _HISTORY + """,
b AS (SELECT *, coalesce(max(va_f1m) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best FROM h),
l AS (SELECT user_id, epoch, va_f1m, va_f1m > best AS improved, epoch - coalesce(max(CASE WHEN va_f1m > best THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch), 0) AS bad FROM b),
s AS (SELECT user_id, min(epoch) AS stop FROM l WHERE bad >= 5 GROUP BY user_id)
SELECT l.* FROM l LEFT JOIN s ON s.user_id IS NOT DISTINCT FROM l.user_id WHERE stop IS NULL OR epoch <= stop""")
def early_stopping(spark, sf):
    return metrics.early_stopping(_history(spark, sf), runs=("user_id",))


@query("WITH RECURSIVE " + _HISTORY + """,
p(user_id, epoch, loss, lr, best, bad, next) AS (SELECT user_id, epoch, va_f1m, CAST(0.0002 AS DOUBLE), va_f1m, 0, CAST(0.0002 AS DOUBLE) FROM h WHERE epoch = 1
    UNION ALL SELECT h.user_id, h.epoch, h.va_f1m, p.next, CASE WHEN h.va_f1m < p.best * (1 - 1e-4) THEN h.va_f1m ELSE p.best END,
    CASE WHEN h.va_f1m < p.best * (1 - 1e-4) OR p.bad = 3 THEN 0 ELSE p.bad + 1 END, CASE WHEN h.va_f1m >= p.best * (1 - 1e-4) AND p.bad = 3 THEN p.next * 0.5 ELSE p.next END
    FROM p JOIN h ON h.user_id = p.user_id AND h.epoch = p.epoch + 1)
SELECT user_id, epoch, round(lr * 1000000, 6) AS micro_lr FROM p""")
def lr_schedule_plateau(spark, sf):
    h = _history(spark, sf).withColumnRenamed("va_f1m", "loss")
    return metrics.plateau_schedule(h, runs=("user_id",)).select("user_id", "epoch", F.round(F.col("lr") * 1000000, 6).alias("micro_lr"))


def _cosine_sql(place: str, width: str) -> str:
    return f"(CAST(0.000001 AS DOUBLE) + (CAST(0.0002 AS DOUBLE) - CAST(0.000001 AS DOUBLE)) * (1 + cos(pi() * {place} / {width})) / 2)"


_COUNTED = "WITH " + _HISTORY + ", c AS (SELECT user_id, epoch, count(*) OVER (PARTITION BY user_id) AS n FROM h), k AS (SELECT *, floor(log2(1 + (epoch - 1) / 10.0) + 1e-9) AS cycle FROM c) "


@query(_COUNTED + f"SELECT user_id, epoch, round({_cosine_sql('(epoch - 1)', 'n')}, 10) AS lr FROM c")
def lr_schedule_cosine(spark, sf):
    h = metrics.cosine_rates(_history(spark, sf), runs=("user_id",))
    return h.select("user_id", "epoch", F.round("lr", 10).alias("lr"))


@query(_COUNTED + f"SELECT user_id, epoch, round({_cosine_sql('(epoch - 1 - 10 * (power(2, cycle) - 1))', '(10 * power(2, cycle))')}, 10) AS lr FROM k")
def lr_schedule_restart(spark, sf):
    h = metrics.cosine_rates(_history(spark, sf), period=10, growth=2, runs=("user_id",))
    return h.select("user_id", "epoch", F.round("lr", 10).alias("lr"))


@query(_COUNTED + f"SELECT user_id, epoch, CASE WHEN epoch > 4 THEN 2 ELSE 1 END AS phase, round({_cosine_sql('(epoch - 1)', 'n')} * CASE WHEN epoch > 4 THEN 0.1 ELSE 1 END, 10) AS lr FROM c")
def two_phases(spark, sf):
    h = metrics.two_phases(metrics.cosine_rates(_history(spark, sf), runs=("user_id",)), 4)
    return h.select("user_id", "epoch", "phase", F.round("lr", 10).alias("lr"))


@query("SELECT vec_id, CASE WHEN b < 1.5 / 10 THEN 'fail' WHEN b > 0.45 THEN 'separable' ELSE 'intermediate' END AS verdict FROM (SELECT vec_id, (vec_id % 100) / 100.0 AS b FROM embeddings)")
def probe_verdict(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", metrics.probe_verdict((F.col("vec_id") % 100) / 100.0, F.lit(10)).alias("verdict"))
