import numpy as np
from pyspark.sql import functions as F

from tessera import config
from tessera.operators import graph, grid, metrics, spatial

RINGS = "array<array<struct<x:double,y:double>>>"


def test_within_excludes_edges_vertices_and_holes(spark):
    square = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]]
    points = [(2.0, 2.0, True), (5.0, 5.0, False), (0.0, 5.0, False), (10.0, 10.0, False), (4.0, 5.0, False), (11.0, 5.0, False), (5.0, 10.0, False)]
    df = spark.createDataFrame([(square, x, y, w) for x, y, w in points], f"rings {RINGS}, x double, y double, want boolean")
    assert df.filter(spatial.within(F.col("rings"), F.col("x"), F.col("y")) != F.col("want")).count() == 0
    assert df.select(spatial.area(F.col("rings"))).first()[0] == 96.0


def test_triangle(spark):
    df = spark.createDataFrame([([[(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]], x, y, w) for x, y, w in [(2.0, 2.0, True), (5.0, 5.0, False), (6.0, 6.0, False)]], f"rings {RINGS}, x double, y double, want boolean")
    assert df.filter(spatial.within(F.col("rings"), F.col("x"), F.col("y")) != F.col("want")).count() == 0


def test_priority_falls_through_null_and_breaks_ties(spark):
    nodes = spark.createDataFrame([(0, k) for k in range(4)], "wsi_id int, node_id long")
    m = spark.createDataFrame(
        [(0, 0, 1, None, 1.0), (0, 0, 2, "SOLIDE", 5.0), (0, 1, 4, "SOLIDE", 2.0), (0, 1, 3, "PAPILLAIRE", 2.0), (0, 2, 5, "Tumor", 1.0), (0, 2, 6, "ACINAIRE", 9.0)],
        "wsi_id int, node_id long, poly_id long, cls string, area double",
    )
    got = {r.node_id: r.label for r in spatial.annotate(nodes, m).collect()}
    assert got == {0: "SOLIDE", 1: "PAPILLAIRE", 2: "ACINAIRE", 3: "background"}


def test_label_forms(spark):
    df = spark.createDataFrame([(None, "background"), ("{'name': 'a'}", "a"), ('{"name": "b"}', "b"), ("{}", "background"), ("plain", "plain")], "v string, want string")
    assert df.filter(spatial.extract_label(F.col("v")) != F.col("want")).count() == 0


def test_scale_rounds_halves_to_even(spark):
    s = spark.createDataFrame([(0, 1000, 1000, 0.2), (1, 1000, 1000, None), (2, 1000, 1000, 0.5), (3, 1000, 1000, 2.0)], "wsi_id int, width long, height long, mpp double")
    assert {r.wsi_id: r.scale for r in grid.slide_geometry(s).collect()} == {0: 2, 1: 2, 2: 1, 3: 1}


def test_grid_drops_tiles_past_the_bottom(spark):
    s = spark.createDataFrame([(0, 448 * 3, 448 * 3, 0.25)], "wsi_id int, width long, height long, mpp double")
    got = grid.hex_grid(grid.slide_geometry(s))
    assert {(r.c, r.r) for r in got.collect()} == {(c, r) for c in range(3) for r in range(3) if not (c == 1 and r == 2)}


def test_edges_are_symmetric_and_regions_cross_blocks(spark):
    rows = [(0, c, r, "SOLIDE" if c < 100 else "Tumor") for c in range(130) for r in range(3)] + [(0, 200, 0, "SOLIDE")]
    nodes = graph.number_nodes(spark.createDataFrame(rows, "wsi_id int, c long, r long, label string"))
    near = {(r.src, r.dst) for r in grid.neighbours(spark, nodes).collect()}
    assert near == {(b, a) for a, b in near}
    got = graph.regions(spark, nodes).groupBy("label", "root").count().collect()
    assert sorted(r["count"] for r in got) == [1, 90, 300]
    sizes = graph.region_sizes(graph.regions(spark, nodes)).collect()
    assert [(r.label, r.n_nodes, r.component_id) for r in sizes] == [("SOLIDE", 300, 0)]


def test_walks_follow_edges_and_never_turn_back(spark):
    nodes = graph.number_nodes(spark.createDataFrame([(0, c, r) for c in range(8) for r in range(8)], "wsi_id int, c long, r long"))
    e = grid.neighbours(spark, nodes)
    todo = nodes.select("wsi_id", F.col("node_id").alias("walk_id"), F.col("node_id").alias("start"), F.lit(30).cast("long").alias("length"))
    ways = {(r.src, r.dst): r.dir for r in e.collect()}
    for w in graph.walks(e, todo, bounce=False).collect():
        steps = [ways[a, b] for a, b in zip(w.path, w.path[1:])]
        assert len(w.path) <= 30 and all((b - a) % 6 != 3 for a, b in zip(steps, steps[1:]))
    assert graph.walks(e, todo, True).orderBy("walk_id").collect() == graph.walks(e, todo, True).orderBy("walk_id").collect()


def test_splits(spark):
    for n, want in ((1, {"test"}), (2, {"test", "val"}), (12, {"test", "val", "train"})):
        got = metrics.slide_split(spark.range(n).select(F.col("id").cast("int").alias("wsi_id"))).collect()
        assert len(got) == n and {r.split for r in got} == want


def test_metrics_of_zero_support_and_absent_class(spark):
    pred = spark.createDataFrame([(0, 0), (0, 1), (2, 2)], "y_true long, y_pred long")
    per = {r.label: r for r in metrics.classification_report(pred).collect()}
    assert per[1].support == 0 and per[1].recall == 0 and per[0].recall == 0.5
    row = metrics.eval_metrics(pred).first()
    assert row.balanced_accuracy == 0.75 and abs(row.accuracy - 2 / 3) < 1e-12
    ids = spark.createDataFrame([(0,), (0,), (2,)], "label_id int")
    got = {r.label_id: r.weight for r in metrics.class_weights(spark, ids, 3, "balanced").collect()}
    assert got == {0: 0.5, 1: 0.0, 2: 1.0}


def test_softmax_and_layer_norm(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>")
    s, z = df.select(metrics.softmax(F.col("x")), metrics.layer_norm(F.col("x"))).first()
    assert abs(sum(s) - 1) < 1e-12 and s[2] > s[1] > s[0] and abs(sum(z)) < 1e-9
    assert config.LABELS["PAPILLAIRE"] == 13


def test_entry_has_no_unknown_oracle():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def star(x: float, y: float, radius: float, n: int, seed: int) -> list[tuple[float, float]]:
    rng = np.random.default_rng(seed)
    r, a = radius * rng.uniform(0.5, 1, n), np.sort(rng.uniform(0, 2 * np.pi, n))
    return [(float(x + p * np.cos(t)), float(y + p * np.sin(t))) for p, t in zip(r, a, strict=True)]


def test_cover_finds_what_a_test_of_all_pairs_finds(spark):
    square = [(100.0, 100.0), (900.0, 100.0), (900.0, 900.0), (100.0, 900.0)]
    polygons = [
        (0, 1, "a", [square, [(300.0, 300.0), (500.0, 300.0), (500.0, 512.0), (300.0, 512.0)]]), (0, 2, "b", [star(500, 500, 700, 4000, 1)]), (0, 3, "c", [[(0.0, 0.0), (1024.0, 1023.0), (13.0, 700.0)]]),
        (1, 4, "d", [star(-300, 200, 900, 9, 2), star(-300, 200, 200, 30, 3)]), (1, 5, None, [[]]), (1, 6, "f", None), (1, 7, "g", [[(0.0, 0.0), (None, 5.0), (5.0, 5.0)]]), (1, 8, "h", [[(0.0, 0.0), (50.0, 0.0), (50.0, 0.0), (0.0, 0.0)]]),
        (0, 9, "a", [[(256.0, 256.0), (512.0, 256.0), (512.0, 512.0), (256.0, 512.0), (256.0, 256.0)]]),
    ]
    polygons = spark.createDataFrame([(w, p, c, 1.0, r) for w, p, c, r in polygons], f"wsi_id int, poly_id int, cls string, area double, rings {RINGS}")
    rng = np.random.default_rng(8)
    at = [(float(x), float(y)) for x, y in rng.integers(-1300, 1400, (1200, 2))] + [(float(x), float(y)) for x in range(0, 1025, 64) for y in range(0, 1025, 64)]
    points = spark.createDataFrame([(k % 2, k, x, y) for k, (x, y) in enumerate(at)], "wsi_id int, node_id long, cx double, cy double")
    want = points.join(polygons, "wsi_id").filter(spatial.within(F.col("rings"), F.col("cx"), F.col("cy"))).select("wsi_id", "node_id", "poly_id", "cls", "area")
    want = sorted(map(tuple, want.filter("poly_id <> 7").collect()), key=str)  # a point without a place: no polygon
    for cell in (4096, 1024, 96):
        assert sorted(map(tuple, spatial.point_in_polygon(points, polygons, cell).collect()), key=str) == want, cell


def test_rings_are_tested_at_borders_only(spark):
    polygon = spark.createDataFrame([(0, 1, "a", 1.0, [star(5_000, 5_000, 4_500, 6_000, 4)])], f"wsi_id int, poly_id int, cls string, area double, rings {RINGS}")
    big = spark.createDataFrame([(0, 1, "a", 1.0, [[(1000.0, 1000.0), (99_000.0, 1000.0), (99_000.0, 99_000.0), (1000.0, 99_000.0)]])], f"wsi_id int, poly_id int, cls string, area double, rings {RINGS}")
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(0, k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 100_000, (20_000, 2)))], "wsi_id int, node_id long, cx double, cy double")
    near = spatial.near_cells(points, big)
    tested, all_ = near.filter("sides IS NOT NULL").count(), near.count()
    assert all_ > 19_000 and tested < 0.03 * all_
    cells = spatial.cover(polygon)  # a side of a cell is held by the cells whose points it may matter to
    assert cells.agg(F.avg(F.size("sides")).alias("held")).first().held < 0.1 * 6_000


def test_a_polygon_of_no_width_has_no_points(spark):
    assert list(spatial.cells_of(np.zeros((0, 4)), 64)) == [] and list(spatial.cells_of(np.array([[0, 0, np.nan, 1]]), 64)) == []
    inner = [c for c in spatial.cells_of(np.array([[0, 0, 300, 0], [300, 0, 300, 300], [300, 300, 0, 300], [0, 300, 0, 0.0]]), 64, 2) if c[3] is None]
    assert len(inner) > 4 and {c[0] for c in inner} == {0, 1}


def test_starts_without_edges_are_walks_by_themselves(spark):
    nodes = spark.createDataFrame([(0, c * 3, r * 3, c * 100 + r, "SOLIDE") for c in range(4) for r in range(4)] + [(0, 0, 1, 900, "SOLIDE")], "wsi_id int, c long, r long, node_id long, label string")
    tries = spark.createDataFrame([(0, 10 * n + k, n, 5) for n in (0, 101, 303, 900, 123_456_789) for k in range(3)], "wsi_id int, walk_id long, start long, length long")
    got = {r.walk_id: r.path for r in graph.walks(grid.neighbours(spark, nodes), tries, False).collect()}
    assert len(got) == 15 and all(got[10 * n + k] == [n] for n in (101, 303, 123_456_789) for k in range(3))
    assert all(set(got[10 * n + k]) == {0, 900} and got[10 * n + k][0] == n for n in (0, 900) for k in range(3))
