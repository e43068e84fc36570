"""The test tables in the roles of slides, tiles, polygons, embeddings and predictions, in Spark and in SQL."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import draw
from tessera.operators import graph, grid, spatial

TILE = 448
#: Per place j of a nation in its region: class, left and top edge, and side, as shares of the slide's.
SQUARES = (("Tumor", 0.0, 0.0, 0.95), ("ACINAIRE", 0.05, 0.05, 0.42), ("LÉPIDIQUE", 0.42, 0.05, 0.40), ("SOLIDE", 0.1, 0.42, 0.44), ("PAPILLAIRE", 0.55, 0.5, 0.38))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=64)
def _edge_tiles(session: str, spark: SparkSession, sf_dir: str) -> int:
    return math.ceil(math.sqrt(table(spark, sf_dir, "orders").count() / 5))


def edge_tiles(spark: SparkSession, sf_dir: str) -> int:
    """Tiles along a slide's edge; counted once a session."""
    return _edge_tiles(spark.sparkContext.applicationId, spark, sf_dir)


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(wsi_id, width, height, mpp): every third slide lacks its mpp."""
    side = edge_tiles(spark, sf_dir) * TILE
    mpp = F.when(F.col("r_regionkey") % 3 == 2, F.lit(None)).otherwise(F.lit(0.25))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("wsi_id"), F.lit(side).cast("long").alias("width"), F.lit(side).cast("long").alias("height"), mpp.alias("mpp"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = edge_tiles(spark, sf_dir)
    k = F.expr("o_orderkey div 5")
    t = table(spark, sf_dir, "orders").filter("o_totalprice > 20000")
    t = t.select((F.col("o_orderkey") % 5).cast("int").alias("wsi_id"), F.floor(k / w).cast("long").alias("c"), (k % w).cast("long").alias("r"))
    t = t.withColumn("px", F.col("c") * TILE).withColumn("py", F.col("r") * TILE + F.when(F.col("c") % 2 == 1, TILE // 2).otherwise(0))
    t = t.withColumn("cx", F.col("px") + TILE // 2).withColumn("cy", F.col("py") + TILE // 2)
    return graph.number_nodes(t)


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = float(edge_tiles(spark, sf_dir) * TILE)
    shape = spark.createDataFrame([(j, c, x * side, y * side, s * side) for j, (c, x, y, s) in enumerate(SQUARES)], "j int, name string, x0 double, y0 double, side double")
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("wsi_id"), F.col("n_nationkey").alias("poly_id"), F.expr("n_nationkey div 5").cast("int").alias("j"))
    n = n.join(F.broadcast(shape), "j")  # five rows
    x1, y1 = F.col("x0") + F.col("side"), F.col("y0") + F.col("side")
    ring = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.col("x0"), F.col("y0")), (x1, F.col("y0")), (x1, y1), (F.col("x0"), y1))))
    raw = F.to_json(F.struct("name"))
    return n.select("wsi_id", "poly_id", spatial.extract_label(raw).alias("cls"), F.array(ring).alias("rings")).withColumn("area", spatial.area(F.col("rings")))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.point_in_polygon(nodes(spark, sf_dir), polygons(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return spatial.annotate(n, spatial.point_in_polygon(n, polygons(spark, sf_dir)))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_index(spark, labelled(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = draw(F.lit("p"), F.col("global_idx").cast("string"))
    pred = F.when(h % 5 == 0, F.expr("h div 5") % len(config.LABELS)).otherwise(F.col("label_id"))
    return index(spark, sf_dir).withColumn("h", h).select("global_idx", F.col("label_id").cast("long").alias("y_true"), pred.cast("long").alias("y_pred"))


def starts(nodes_: DataFrame, excluded: bool) -> DataFrame:
    """(wsi_id, walk_id, start, length) and (c, r, label) of the start of a walk from each node, those of excluded labels too or not."""
    n = nodes_ if excluded else nodes_.filter(~F.col("label").isin(*config.EXCLUDED))
    walk = F.col("wsi_id").cast("long") * 10_000_000 + F.col("node_id")
    length = config.WALK_MIN + draw(F.lit("length"), walk.cast("string")) % (config.WALK_MAX - config.WALK_MIN + 1)
    return n.select("wsi_id", walk.alias("walk_id"), F.col("node_id").alias("start"), length.alias("length"), "c", "r", "label")


_LABELS = ", ".join(f"('{k}', {v})" for k, v in config.LABELS.items())
_EXCLUDED = ", ".join(f"'{x}'" for x in config.EXCLUDED)
_SQUARES = ", ".join(f"({j}, '{c}', CAST({x} AS DOUBLE), CAST({y} AS DOUBLE), CAST({s} AS DOUBLE))" for j, (c, x, y, s) in enumerate(SQUARES))
_OFFSETS = ", ".join(f"({p}, {d}, {dc}, {dr})" for p, ring in config.NEIGHBOURS.items() for d, (dc, dr) in enumerate(ring))

#: Common table expressions that oracles start with.
BASE = f"""
WITH RECURSIVE w AS (SELECT CAST(ceil(sqrt(count(*) / 5.0)) AS BIGINT) AS w FROM orders),
t AS (SELECT CAST(o_orderkey % 5 AS INTEGER) AS wsi_id, (o_orderkey // 5) // w AS c, (o_orderkey // 5) % w AS r FROM orders, w WHERE o_totalprice > 20000),
nodes AS MATERIALIZED (SELECT wsi_id, c, r, 448 * c AS px, 448 * r + CASE WHEN c % 2 = 1 THEN 224 ELSE 0 END AS py, 448 * c + 224 AS cx, 448 * r + CASE WHEN c % 2 = 1 THEN 448 ELSE 224 END AS cy,
    row_number() OVER (PARTITION BY wsi_id ORDER BY c, r) - 1 AS node_id FROM t),
sq(j, cls, x0, y0, s) AS (VALUES {_SQUARES}),
poly AS (SELECT n_regionkey AS wsi_id, n_nationkey AS poly_id, cls, x0 * (448 * w) AS x0, y0 * (448 * w) AS y0, s * (448 * w) AS s, s * (448 * w) * (s * (448 * w)) AS area FROM nation JOIN sq ON j = n_nationkey // 5, w),
m AS MATERIALIZED (SELECT n.wsi_id, n.node_id, p.poly_id, p.cls, p.area FROM nodes n JOIN poly p ON n.wsi_id = p.wsi_id AND cx > x0 AND cx < x0 + s AND cy > y0 AND cy < y0 + s),
best AS (SELECT wsi_id, node_id, arg_min(cls, (cls IN ({_EXCLUDED}), area, poly_id)) AS label FROM m GROUP BY ALL),
lab AS MATERIALIZED (SELECT n.*, coalesce(b.label, 'background') AS label FROM nodes n LEFT JOIN best b ON b.wsi_id = n.wsi_id AND b.node_id = n.node_id),
ids(label, label_id) AS (VALUES {_LABELS}),
idx AS MATERIALIZED (SELECT lab.*, row_number() OVER (ORDER BY wsi_id, node_id) - 1 AS global_idx, coalesce(label_id, 0) AS label_id FROM lab LEFT JOIN ids ON ids.label = lab.label),
off(parity, dir, dc, dr) AS (VALUES {_OFFSETS}),
e AS MATERIALIZED (SELECT a.wsi_id, a.node_id AS src, o.dir, b.node_id AS dst, a.label AS src_label, b.label AS dst_label FROM lab a JOIN off o ON o.parity = a.c % 2 JOIN lab b ON b.wsi_id = a.wsi_id AND b.c = a.c + o.dc AND b.r = a.r + o.dr)
"""
PRED = """, pred AS MATERIALIZED (SELECT global_idx, CAST(label_id AS BIGINT) AS y_true, CAST(CASE WHEN h % 5 = 0 THEN (h // 5) % 14 ELSE label_id END AS BIGINT) AS y_pred
    FROM (SELECT *, CAST('0x' || substr(md5('p:' || global_idx), 1, 8) AS BIGINT) AS h FROM idx))"""
REPORT = (
    PRED
    + """, hits AS (SELECT y AS label, count(*) FILTER (WHERE y = y_true) AS support, count(*) FILTER (WHERE y = y_pred) AS n_pred, count(*) FILTER (WHERE y = y_true AND y = y_pred) AS hit
    FROM (SELECT y_true AS y FROM pred UNION SELECT y_pred FROM pred) u JOIN pred ON y = y_true OR y = y_pred GROUP BY y),
pr AS (SELECT *, CASE WHEN n_pred > 0 THEN hit / n_pred ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM hits),
rep AS (SELECT label, support, n_pred, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""
)
REGIONS = f""", cc(id, root) USING KEY (id) AS (SELECT wsi_id * 10000000 + node_id, wsi_id * 10000000 + node_id FROM lab
    UNION (SELECT p.id, min(q.root) FROM recurring.cc p JOIN e ON e.wsi_id * 10000000 + e.src = p.id AND e.src_label = e.dst_label JOIN recurring.cc q ON q.id = e.wsi_id * 10000000 + e.dst WHERE q.root < p.root GROUP BY p.id)),
sz AS (SELECT lab.wsi_id, lab.label, cc.root % 10000000 AS root, count(*) AS n_nodes FROM lab JOIN cc ON cc.id = lab.wsi_id * 10000000 + lab.node_id WHERE label NOT IN ({_EXCLUDED}) GROUP BY ALL),
reg AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wsi_id, label ORDER BY root) - 1 AS component_id FROM sz) WHERE n_nodes >= {config.MIN_REGION}),
cap0 AS (SELECT label, count(*) AS n_regions, CAST(sum(n_nodes) AS BIGINT) AS n_nodes, CAST(floor(sum(n_nodes) * {config.MAX_REDUNDANCY} / {(config.WALK_MIN + config.WALK_MAX) / 2}) AS BIGINT) AS capacity FROM reg GROUP BY label),
cap AS (SELECT *, least(capacity, min(capacity) OVER () * {config.MAX_IMBALANCE}) AS target FROM cap0)"""


def walk_sql(bounce: bool, same_label: bool, sharp: int = 1, tries: str | None = None) -> str:
    """CTE walk(wsi_id, walk_id, path): the walks from all nodes on the graph, step by step, or those of a CTE
    tries(wsi_id, walk_id, start, length)."""
    same = "WHERE src_label = dst_label" if same_label else ""
    only = f"WHERE label NOT IN ({_EXCLUDED})" if same_label else ""
    begun = f"""st AS (SELECT wsi_id, CAST(wsi_id AS BIGINT) * 10000000 + node_id AS walk_id, node_id AS start FROM lab {only}),
stl AS (SELECT *, {config.WALK_MIN} + CAST('0x' || substr(md5('length:' || walk_id), 1, 8) AS BIGINT) % {config.WALK_MAX - config.WALK_MIN + 1} AS length FROM st)"""
    if tries:
        begun = f"stl AS (SELECT wsi_id, walk_id, start, length FROM {tries})"
    weights = f"list_transform(dirs, lambda x: CASE WHEN came IS NULL OR (x - came + 6) % 6 NOT IN (2, 4) THEN 10 ELSE {sharp} END)"
    if sharp == 0:  # where only sharp turns are left they count in full, or not at all without bounce
        only_sharp = "list_transform(dirs, lambda x: 1)" if bounce else "list_transform(dirs, lambda x: 0)"
        weights = f"CASE WHEN list_sum({weights}) > 0 THEN {weights} ELSE {only_sharp} END"
    back = "CASE WHEN came IS NOT NULL AND d[(came + 3) % 6 + 1] IS NOT NULL THEN (came + 3) % 6 END" if bounce else "NULL"
    return f""", adj AS MATERIALIZED (SELECT wsi_id, src, [max(dst) FILTER (WHERE dir = 0), max(dst) FILTER (WHERE dir = 1), max(dst) FILTER (WHERE dir = 2), max(dst) FILTER (WHERE dir = 3), max(dst) FILTER (WHERE dir = 4), max(dst) FILTER (WHERE dir = 5)] AS d FROM e {same} GROUP BY wsi_id, src),
{begun},
wk(wsi_id, walk_id, length, step, nd, came, path) AS (SELECT wsi_id, walk_id, length, CAST(1 AS BIGINT), start, CAST(NULL AS INTEGER), [start] FROM stl
    UNION ALL SELECT wsi_id, walk_id, length, step + 1, d[go + 1], go, list_append(path, d[go + 1]) FROM (
        SELECT *, coalesce(dirs[list_position(list_transform(generate_series(1, len(ws)), lambda i: list_sum(ws[1:i]) > h % list_sum(ws)), true)], {back}) AS go FROM (
        SELECT *, {weights} AS ws FROM (
        SELECT wk.*, adj.d, list_filter([0, 1, 2, 3, 4, 5], lambda x: adj.d[x + 1] IS NOT NULL AND (wk.came IS NULL OR (x - wk.came + 6) % 6 <> 3)) AS dirs,
            CAST('0x' || substr(md5('walk:' || wk.walk_id || ':' || wk.step), 1, 8) AS BIGINT) AS h
        FROM wk JOIN adj ON adj.wsi_id = wk.wsi_id AND adj.src = wk.nd WHERE wk.step < wk.length))) WHERE go IS NOT NULL),
walk AS MATERIALIZED (SELECT wsi_id, walk_id, arg_max(path, step) AS path FROM wk GROUP BY wsi_id, walk_id)"""
