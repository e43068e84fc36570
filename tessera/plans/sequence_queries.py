"""Queries over sequences, sources and learners; they join those of queries.py."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import cut, shared_path
from tessera.operators import graph, learners, metrics, neighbours, sequences, training
from tessera.operators.sequence_model import Shape
from tessera.plans import drawn_walks as W
from tessera.plans import fixture as X
from tessera.plans.queries import _STEPS, _indexed, _pooled, _regions, _walks, query
from tessera.sources import annotations, store

_SPLIT = """, sp AS (SELECT global_idx, label, row_number() OVER (PARTITION BY label ORDER BY substr(md5('42:' || global_idx), 1, 8), global_idx) AS k, count(*) OVER (PARTITION BY label) AS n FROM idx),
split AS (SELECT label, CASE WHEN k <= round_even(n * CAST(0.15000000000000005 AS DOUBLE), 0) THEN 'test' WHEN k <= round_even(n * CAST(0.30000000000000004 AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS split FROM sp)"""


def _text(path):
    return F.array_join(F.col(path).cast("array<string>"), ",").alias("path")


# --- sources ----------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT 'S' || c_custkey AS wsi_id, c_custkey AS k FROM customer)
SELECT wsi_id, 'data/' || wsi_id || CASE WHEN k % 4 = 0 THEN '.SVS' ELSE '.svs' END AS raster, 'data/' || wsi_id || '.geojson' AS annot FROM p WHERE k % 2 = 0 AND k % 3 = 0""")
def pair_discovery(spark, sf):
    k = F.col("c_custkey")
    stem = F.concat(F.lit("data/S"), k.cast("string"))
    names = F.array(
        F.when(k % 2 == 0, F.concat(stem, F.when(k % 4 == 0, ".SVS").otherwise(".svs"))), F.when(k % 3 == 0, F.concat(stem, F.lit(".geojson"))), F.when(k % 5 == 0, F.concat(stem, F.lit("_Pred.geojson")))
    )
    return annotations.pair_files(X.table(spark, sf, "customer").select(F.explode(F.array_compact(names)).alias("path")))[0]


@query(X.BASE + "SELECT CAST(poly_id AS BIGINT) AS poly_id, cls, round(area, 3) AS area, CAST(4 AS BIGINT) AS n_points FROM poly")
def geojson_parse(spark, sf):
    p = X.polygons(spark, sf)
    shape = F.transform("rings", lambda ring: F.transform(ring, lambda q: F.array(q["x"], q["y"])))
    multi = F.col("poly_id") % 2 == 0
    kind, one, many = F.when(multi, "MultiPolygon").otherwise("Polygon"), F.to_json(shape), F.to_json(F.array(shape))
    text = F.concat(
        F.lit('{"type": "FeatureCollection", "features": [{"properties": {"classification": {"name": "'), "cls", F.lit('"}}, "geometry": {"type": "'), kind,
        F.lit('", "coordinates": '), F.when(multi, many).otherwise(one), F.lit("}}]}"),
    )
    got = annotations.parse_features(p.select(F.col("poly_id").cast("long").alias("poly_id"), text.alias("json")), "poly_id", "json")
    return got.select("poly_id", "cls", F.round("area", 3).alias("area"), F.size(F.flatten("rings")).cast("long").alias("n_points"))


@query(X.BASE + X.walk_sql(False, False) + "SELECT wsi_id, walk_id, array_to_string(path, ',') AS path FROM walk")
def walk_roundtrip(spark, sf):
    path = shared_path(spark, "walks")
    store.save_walks(_walks(spark, sf, False, False).select("wsi_id", "walk_id", "path"), path)
    return store.load_walks(spark, path).select("wsi_id", "walk_id", _text("path"))


# --- sequences --------------------------------------------------------------------------------------------------


@query(X.BASE + X.walk_sql(False, False) + "SELECT walk_id, false AS reversed, array_to_string(path, ',') AS path FROM walk UNION ALL SELECT walk_id, true, array_to_string(list_reverse(path), ',') FROM walk")
def reverse_augment(spark, sf):
    return sequences.reverse_augment(_walks(spark, sf, False, False).select("walk_id", "path")).select("walk_id", "reversed", _text("path"))


@query(X.BASE + X.walk_sql(False, False) + "SELECT walk_id, CAST(len(path) AS BIGINT) AS length, array_to_string(list_resize(path, max(len(path)) OVER (PARTITION BY walk_id // 1600), 0), ',') AS path FROM walk")
def pad_sequences(spark, sf):
    w = _walks(spark, sf, False, False).select("walk_id", "path").withColumn("batch", F.expr("walk_id div 1600"))
    return sequences.pad_sequences(w, "batch").select("walk_id", "length", _text("path"))


@query("WITH n AS (SELECT count(*) AS n, least(count(*), 200) AS k FROM embeddings) SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT (i * (n - 1)) // greatest(k - 1, 1) FROM (SELECT n, k, unnest(generate_series(0, k - 1)) AS i FROM n))")
def linspace_sample(spark, sf):
    return sequences.linspace_sample(spark, X.table(spark, sf, "embeddings").select("vec_id"), "vec_id", 200)


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity * 5 / 255 - 0.485) / 0.229, 6) AS red, round((l_partkey % 256 / 255.0 - 0.456) / 0.224, 6) AS green, round((l_linenumber * 36 / 255.0 - 0.406) / 0.225, 6) AS blue
FROM (SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_partkey AS DOUBLE) AS l_partkey FROM lineitem)""")
def channel_normalize(spark, sf):
    return _channels(spark, sf, "photographs")


def _channels(spark, sf, kind):
    cols = (F.col("l_quantity") * 5, F.col("l_partkey") % 256, F.col("l_linenumber") * 36)
    named = zip(sequences.channel_normalize(cols, kind), ("red", "green", "blue"), strict=True)
    return X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(n) for c, n in named))


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity * 5 / 255 - 0.707223) / 0.211883, 6) AS red, round((l_partkey % 256 / 255.0 - 0.578729) / 0.230117, 6) AS green, round((l_linenumber * 36 / 255.0 - 0.703617) / 0.177517, 6) AS blue
FROM (SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_partkey AS DOUBLE) AS l_partkey FROM lineitem)""")
def channel_normalize_tissue(spark, sf):
    return _channels(spark, sf, "tissue")


@query(None)
def fp16_quantize(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", sequences.to_half("embedding").alias("embedding"))


_POSITION = 0.14391156831212787  # ln(10000) / 64


@query(X.BASE + _STEPS + f""", v AS (SELECT vec_id, embedding, count(*) OVER () AS n FROM embeddings),
x AS (SELECT walk_id, pos - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM sl JOIN v ON v.vec_id = sl.global_idx % v.n)
SELECT walk_id, dim, round(avg(x + CASE WHEN dim % 2 = 0 THEN sin(pos * exp(-(dim - dim % 2) * CAST({_POSITION} AS DOUBLE))) ELSE cos(pos * exp(-(dim - dim % 2) * CAST({_POSITION} AS DOUBLE))) END), 5) + 0.0 AS value FROM x GROUP BY ALL""")
def positional_encoding(spark, sf):
    """The means of walks whose steps' embeddings have their positions added."""
    return _pooled(spark, sf, positions=True).withColumn("value", F.round("value", 5) + F.lit(0.0))


_HIDDEN = [[0.1] * 64, [0.05 if i % 2 == 0 else -0.05 for i in range(64)]]


@query(X.BASE + _STEPS + """, v AS (SELECT vec_id, embedding, count(*) OVER () AS n, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
a AS (SELECT walk_id, e, exp(0.7 * tanh(list_sum(list_transform(e, lambda x: 0.1 * x))) - 0.3 * tanh(list_sum(list_transform(e, lambda x, i: CASE WHEN i % 2 = 1 THEN 0.05 * x ELSE -0.05 * x END)))) AS w FROM sl JOIN v ON v.vec_id = sl.global_idx % v.n)
SELECT walk_id, dim, round(sum(w * x) / sum(w), 5) + 0.0 AS value FROM (SELECT walk_id, w, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM a) GROUP BY ALL""")
def attention_pool(spark, sf):
    weight = F.exp(sequences.attention_score(F.col("vector"), _HIDDEN, [0.7, -0.3]))
    return _pooled(spark, sf, weight=weight).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query("SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS BIGINT) AS best, round(1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS p FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)")
def softmax_argmax(spark, sf):
    x = F.col("embedding").cast("array<double>")
    return X.table(spark, sf, "embeddings").select("vec_id", (F.array_position(x, F.array_max(x)) - 1).alias("best"), F.round(F.array_max(metrics.softmax(x)), 6).alias("p"))


@query("""WITH c AS (SELECT label, sqrt(sum(count(*)) OVER () / (10.0 * count(*))) AS w FROM embeddings GROUP BY label),
e AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
l AS (SELECT w, ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) + list_max(v) - v[e.label + 1] AS loss FROM e JOIN c ON c.label = e.label)
SELECT round(sum(w * loss) / sum(w), 6) AS loss FROM l""")
def weighted_cross_entropy(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("embedding").alias("logits"), F.col("label").cast("int").alias("label_id"))
    return sequences.weighted_cross_entropy(e, metrics.class_weights(spark, e, 10)).select(F.round("loss", 6).alias("loss"))


@query("SELECT user_id % 30 AS epoch, round(sum(value * (1 + event_id % 32)) / sum(1 + event_id % 32), 6) AS loss FROM events GROUP BY ALL")
def epoch_loss(spark, sf):
    b = X.table(spark, sf, "events").select((F.col("user_id") % 30).alias("epoch"), F.col("value").alias("loss"), (1 + F.col("event_id") % 32).alias("n"))
    return sequences.epoch_loss(b).withColumn("loss", F.round("loss", 6))


# --- splits -----------------------------------------------------------------------------------------------------


@query(X.BASE + "SELECT wsi_id, block, arg_min(label, (-n, label)) AS label FROM (SELECT wsi_id, c // 8 AS block, label, count(*) AS n FROM lab GROUP BY ALL) GROUP BY ALL")
def region_majority_label(spark, sf):
    return sequences.mode_label(X.labelled(spark, sf).withColumn("block", F.expr("c div 8")), ["wsi_id", "block"], "label")


@query(X.BASE + _SPLIT + "SELECT split, label, count(*) AS n FROM split GROUP BY ALL")
def split_label_counts(spark, sf):
    s = metrics.stratified_split(X.index(spark, sf).select("global_idx", "label"), "global_idx", "label")
    return s.groupBy("split", "label").agg(F.count("*").alias("n"))


@query(X.BASE + X.REGIONS + f""", rk AS (SELECT wsi_id, label, root, row_number() OVER (PARTITION BY label ORDER BY substr(md5('42:' || wsi_id || ':' || label || ':' || root), 1, 8), wsi_id, root) AS k, count(*) OVER (PARTITION BY label) AS n FROM reg)
SELECT wsi_id, label, root, CASE WHEN k <= 1 THEN 'test' WHEN k <= 1 + round_even((n - 1) * CAST({0.15 / (0.70 + 0.15)!r} AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS split FROM rk""")
def region_holdout(spark, sf):
    return sequences.region_holdout(_regions(spark, sf).select("wsi_id", "label", "root"))


@query(X.BASE + """, k AS (SELECT greatest(1, 32 // count(DISTINCT label)) AS share FROM idx),
rk AS (SELECT global_idx, label, substr(md5('42:' || global_idx), 1, 8) AS h, row_number() OVER (PARTITION BY label ORDER BY substr(md5('42:' || global_idx), 1, 8), global_idx) AS r FROM idx)
SELECT global_idx, label FROM rk, k ORDER BY r > share, h, global_idx LIMIT 32""")
def overfit_subset(spark, sf):
    return metrics.overfit_subset(X.index(spark, sf).select("global_idx", "label"), "global_idx", "label", 32)


@query(W.BALANCED + W.REPORT)
def walk_report(spark, sf):
    sizes, _, made = _balanced(spark, sf)
    return sequences.walk_report(made, graph.class_capacity(sizes)).withColumn("redundancy", F.round("redundancy", 6))


def _balanced(spark, sf):
    n = cut(spark, X.labelled(spark, sf), "labelled")
    found = cut(spark, graph.regions(spark, n), "regions")
    sizes = cut(spark, graph.region_sizes(found), "region-sizes")
    return sizes, *sequences.balanced_walks(spark, None, found, sizes, True)


def _region_walks(spark, sf, quotas):
    n = cut(spark, X.labelled(spark, sf), "labelled")
    found = cut(spark, graph.regions(spark, n), "regions")
    tries = cut(spark, sequences.attempts(found, quotas(graph.region_sizes(found))), "attempts")
    return sequences.accept(sequences.tile_walks(found, tries, True), tries).select("wsi_id", "label", "root", "attempt", _text("path"))


@query(W.PER_REGION + "SELECT wsi_id, label, root, attempt, array_to_string(path, ',') AS path FROM made")
def walks_by_region(spark, sf):
    """Thirty walks of each region."""
    return _region_walks(spark, sf, lambda sizes: sizes.withColumn("quota", F.lit(30).cast("long")))


@query(W.BALANCED + "SELECT wsi_id, label, root, attempt, array_to_string(path, ',') AS path FROM made")
def walks_balanced(spark, sf):
    """The whole balanced allocation of each region; what a region falls short of is shared among later ones."""
    return _balanced(spark, sf)[1].select("wsi_id", "label", "root", "attempt", _text("path"))


# --- learners ---------------------------------------------------------------------------------------------------


def _vectors(spark, sf):
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("int").alias("label"), "embedding")


@query(None)
def linear_probe(spark, sf):
    return learners.linear_probe(_vectors(spark, sf))


@query(None)
def pca_projection(spark, sf):
    return learners.pca_projection(_vectors(spark, sf))


@query(None)
def neighbour_projection(spark, sf):
    """All embeddings in two dimensions, near ones near each other."""
    return neighbours.neighbour_projection(spark, _vectors(spark, sf))


@query(None)
def neighbour_distances(spark, sf):
    """How far the fifteen nearest other embeddings of each one are, as found by the trees."""
    v = _vectors(spark, sf).select("key", F.col("embedding").cast("array<double>").alias("vector"))
    near = neighbours.neighbour_graph(spark, v, 15)
    return near.select("key", F.posexplode("near").alias("rank", "near")).select("key", "rank", F.col("near.key").alias("other"), F.col("near.d").alias("distance"))


@query(None)
def walk_classifier(spark, sf):
    """A classifier of pooled walks from all nodes, fitted on all walks of train and judged on all of test; labels are
    those of the nodes that walks start from."""
    pooled = _pooled(spark, sf, keep=("label",), flat=False).filter("vector IS NOT NULL").select("walk_id", F.col("label").alias("name"), F.col("vector").alias("embedding"))
    ids = spark.createDataFrame(list(config.LABELS.items()), "name string, label int")
    rows = pooled.join(F.broadcast(ids), "name")
    # The fit reads its rows many times.
    return learners.linear_probe(cut(spark, rows.select(F.col("walk_id").alias("key"), "label", "embedding"), "pooled"), None)


_PLAN = training.Plan(epochs=8, steps=6, rate=3e-3, frozen=2, factor=0.5, patience=3)


#: Bytes of embeddings up to which tasks hold all of them, and sequences hold their numbers alone.
_HELD = 64 << 20


def _sequences(spark, sf):
    """(rows, classes, width, known): the walks from all nodes as sequences of vectors, each a node's embedding and its place in
    the slide; labels are the classes of the nodes that walks start from, coarse ones left out, numbered anew. known has the
    embeddings where they are small and of the numbers from 0 on; else sequences hold them."""
    v = X.table(spark, sf, "embeddings").select("vec_id", "embedding")
    size = F.size("embedding")
    n, width, least, last, ids, whole = v.agg(F.count("*"), F.max(size), F.min(size), F.max("vec_id"), F.count_distinct("vec_id"), F.count("embedding")).first()
    small = n and n == ids == whole == last + 1 and least == width and 4 * n * width <= _HELD
    side = X.edge_tiles(spark, sf) * X.TILE
    places = [(2 * F.col(c) / side - 1).cast("float").alias(f"p{c}") for c in ("cx", "cy")]
    nodes = _indexed(spark, sf, (F.col("global_idx") % n).cast("int").alias("vec_id"), *places)
    starts = X.starts(nodes, False)
    if small:
        known = spark.sparkContext.broadcast(np.array([r.embedding for r in v.orderBy("vec_id").collect()], np.float32))
        walks = graph.grid_walks(nodes, starts, False, keep=("label",), carry=("vec_id", "pcx", "pcy"))
        held = [F.col("path_vec_id").alias("numbers"), F.flatten(F.zip_with("path_pcx", "path_pcy", lambda x, y: F.array(x, y))).alias("more")]
        length = F.size("path")
    else:
        known = None
        near = nodes.join(v.filter("embedding IS NOT NULL"), "vec_id", "left")
        near = near.select("wsi_id", "node_id", "c", "r", F.concat("embedding", F.array("pcx", "pcy")).alias("vector"))
        walks = graph.grid_walks(near, starts, False, keep=("label",), carry=("vector",)).withColumn("path_vector", F.array_compact("path_vector"))
        held, length = [F.flatten("path_vector").alias("vectors")], F.size("path_vector")
    walks = cut(spark, walks.select("wsi_id", F.col("walk_id").alias("key"), "label", length.alias("length"), *held).filter("length > 0"), "sequences")
    names = [r.label for r in walks.select("label").distinct().collect()]  # a row for each class
    ids = {name: k for k, name in enumerate(sorted(names, key=config.LABELS.__getitem__))}
    labels = spark.createDataFrame(list(ids.items()), "label string, label_id int")
    parts = metrics.stratified_split(walks.select("key", "label"), "key", "label").select("key", "split")
    rows = walks.join(F.broadcast(labels), "label").join(parts, "key").drop("label")  # a row for each class
    return training.prepare(spark, rows, _PLAN.steps), len(ids), width + 2, known


def _trained(spark, sf, pooling):
    rows, classes, width, known = _sequences(spark, sf)
    shape = Shape(inputs=width, classes=max(classes, 1), pooling=pooling)
    return rows, shape, training.fit(rows, shape, _PLAN, path=shared_path(spark, "best-model"), known=known), known


@query(None)
def sequence_training(spark, sf):
    """The history of a training, a row for each epoch, and in epoch 0 how the best weights do on test."""
    got = _trained(spark, sf, "attention")[2]
    names = [k for k in got.history[0] if k not in ("epoch", "phase", "improved")]
    test = {"epoch": 0, "phase": 0, "improved": False} | {f"va_{k}": v for k, v in got.test.items()}
    kind = "epoch int, phase int, improved boolean, " + ", ".join(f"{k} double" for k in names)
    return spark.createDataFrame([tuple(h.get(k) for k in ("epoch", "phase", "improved", *names)) for h in [*got.history, test]], kind)


@query(None)
def slide_vote(spark, sf):
    """The class of each slide by its test walks, weighted by the trained model's attention."""
    rows, shape, got, known = _trained(spark, sf, "attention")
    predicted = training.predict(rows.filter("split = 'test'"), shape, got.weights, ("wsi_id",), known)
    return training.vote(predicted, "wsi_id", shape.classes, training.most_evidence(shape, got.weights))
