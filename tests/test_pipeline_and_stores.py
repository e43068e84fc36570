import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import rank_by_parts
from tessera.operators import graph, grid, learners, metrics, sequences, spatial, walk_pipeline
from tessera.sources import annotations, store

CELLS = "wsi_id int, c long, r long, label string"


def board(spark, width: int = 16, height: int = 8, slides: int = 1):
    rows = [(s, c, r, "SOLIDE" if c < width // 2 else "ACINAIRE") for s in range(slides) for c in range(width) for r in range(height)]
    return graph.number_nodes(spark.createDataFrame(rows, CELLS))


def test_ranks_by_parts_are_ranks(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") * 37 % 101).alias("v"), "id").withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    got = rank_by_parts(rows.fillna(-1, ["v"]), ["g"], F.expr("floor(v / 10)"), ["v", "id"]).collect()
    for g in (None, 1, 2):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.k_)
        assert [r.k_ for r in mine] == list(range(1, len(mine) + 1)) and {r.n_ for r in mine} == {len(mine)}
        assert [(r.v, r.id) for r in mine] == sorted((r.v, r.id) for r in mine)


def test_walks_do_not_depend_on_blocks(spark, monkeypatch):
    nodes = board(spark, 40, 30)
    edges, todo = grid.neighbours(spark, nodes), nodes.select("wsi_id", F.col("node_id").alias("walk_id"), F.col("node_id").alias("start"), F.lit(40).cast("long").alias("length"))
    want = {r.walk_id: r.path for r in graph.walks(edges, todo, True).collect()}
    monkeypatch.setattr(graph, "BLOCK", 7)
    assert {r.walk_id: r.path for r in graph.walks(edges, todo, True).collect()} == want
    assert len(want) == 1200 and all(len(p) == 40 for p in want.values())


def test_a_start_without_edges_is_a_walk_and_too_long_ones_are_refused(spark):
    nodes = graph.number_nodes(spark.createDataFrame([(0, 0, 0, "a"), (0, 9, 9, "a"), (0, 9, 10, "a")], CELLS))
    todo = spark.createDataFrame([(0, 1, 0, 30), (0, 2, 1, 3)], "wsi_id int, walk_id long, start long, length long")
    edges = grid.neighbours(spark, nodes)
    assert {r.walk_id: r.path for r in graph.walks(edges, todo, True).collect()} == {1: [0], 2: [1, 2, 1]}
    assert {r.walk_id: r.path for r in graph.walks(edges, todo, False).collect()} == {1: [0], 2: [1, 2]}
    with pytest.raises(Exception, match="wider margin"):
        graph.walks(edges, todo.withColumn("length", F.lit(41).cast("long")), False).collect()


def test_sharp_turns_come_before_the_way_back(spark):
    # From (0, 0) to (0, 1) to the corner, where only a sharp turn or the way back is left.
    nodes = graph.number_nodes(spark.createDataFrame([(0, 0, 0, "a"), (0, 0, 1, "a"), (0, 1, 0, "a")], CELLS))
    edges = grid.neighbours(spark, nodes)
    ways = {(r.src, r.dst): r.dir for r in edges.collect()}
    todo = spark.createDataFrame([(0, k, k % 3, 8) for k in range(30)], "wsi_id int, walk_id long, start long, length long")
    for w in graph.walks(edges, todo, True, sharp=0).collect():
        steps = [ways[a, b] for a, b in zip(w.path, w.path[1:])]
        assert len(w.path) == 8 and all((b - a) % 6 != 3 for a, b in zip(steps, steps[1:]))
    assert all(len(w.path) == 2 for w in graph.walks(edges, todo, False, sharp=0).collect())


def test_slide_walks(spark):
    small = spark.createDataFrame([(7, c, 0, "Tumor") for c in range(5)], CELLS)
    nodes = board(spark, slides=2).unionByName(graph.number_nodes(small))
    got = walk_pipeline.slide_walks(spark, nodes, 12).collect()
    assert {r.wsi_id for r in got} <= {0, 1} and all(len(r.path) >= 30 for r in got)
    for s in (0, 1):
        own = [tuple(r.path) for r in got if r.wsi_id == s]
        assert len({min(p, p[::-1]) for p in own}) == len(own) <= 12


@pytest.mark.parametrize("holdout", [None, {"default": 1}])
def test_whole_pipeline(spark, holdout):
    extra = [(0, c, r, "no_Tissu") for c in range(30, 34) for r in range(8)]
    nodes = graph.number_nodes(board(spark, slides=3).drop("node_id").unionByName(spark.createDataFrame(extra, CELLS)))
    walks = walk_pipeline.run(spark, nodes, balanced=False, holdout=holdout, per_region=4).collect()
    assert sorted(r.path_id for r in walks) == list(range(24)) and {r.label for r in walks} == {"SOLIDE", "ACINAIRE"}
    index = {r.global_idx: r for r in graph.node_index(spark, graph.drop_label(nodes)).collect()}
    for w in walks:
        assert w.path_len == len(w.path) and {(index[g].wsi_id, index[g].label) for g in w.path} == {(w.wsi_id, w.label)}
    parts: dict = {}
    for w in walks:
        parts.setdefault(w.region_key, set()).add(w.split)
    if holdout:
        assert all(len(p) == 1 for p in parts.values()) and sum(p == {"test"} for p in parts.values()) == 2
    else:
        assert {w.split for w in walks} == {"train", "val", "test"}


def test_holdout_rules(spark):
    rows = [("A", 4, f"A{k}") for k in range(5) for _ in range(3)] + [("B", 5, "B0")] * 2
    walks = spark.createDataFrame(rows, "label string, label_id int, region_key string")
    got = sequences.holdout_walks(walks, {"A": 2, "default": 3}).select("region_key", "split").distinct().collect()
    by = {r.region_key: r.split for r in got}
    assert len(by) == 6 and by["B0"] == "test" and sum(v == "test" for k, v in by.items() if k[0] == "A") == 2
    with pytest.raises(ValueError):
        sequences.holdout_walks(walks.drop("region_key"))


def test_limits_of_the_report(spark):
    made = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 9)], "label string, got long")
    capacity = spark.createDataFrame([("a", 9, 9, 10), ("b", 9, 7, 10), ("c", 20, 20, 10), ("d", 9, 9, 10)], "label string, capacity long, target long, n_nodes long")
    assert {r.label: r.limited_by for r in sequences.walk_report(made, capacity, most=12).collect()} == {"a": "tissue", "b": "ratio", "c": "absolute", "d": "none"}


def test_labels_in_braces_that_do_not_parse(spark):
    df = spark.createDataFrame([(None, "background", "None"), ("{bad}", "{bad}", "{bad}"), ("{'name': 'a'}", "a", "a"), ('{"x": 1}', "background", "unknown"), ("plain", "plain", "plain"), (" {'name': 'b'} ", "b", "b")], "v string, a string, b string")
    got = df.select("a", "b", spatial.extract_label(F.col("v")).alias("x"), spatial.extract_label_for_counts(F.col("v")).alias("y")).collect()
    assert all((r.x, r.y) == (r.a, r.b) for r in got)


def test_geometry_of_windows_and_odd_resolutions(spark):
    s = spark.createDataFrame([(0, 4480, 4480, "0.25"), (1, 4480, 4480, "none"), (2, 4480, 4480, None)], "wsi_id int, width long, height long, mpp string")
    assert [(r.scale, r.cols, r.rows) for r in grid.slide_geometry(s, 2, 3, 5, 0).collect()] == [(2, 5, 7)] * 3
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        grid.slide_geometry(s.limit(1).withColumn("mpp", F.lit("0"))).collect()


def test_stores_refuse_what_is_not_whole(spark, tmp_path):
    index = spark.createDataFrame([(0, k, k, k) for k in range(6)], "wsi_id int, global_idx long, px long, py long")
    patches, out, meta = (str(tmp_path / n) for n in ("patches", "embeddings", "meta"))
    with pytest.raises(FileNotFoundError):
        store.load_patches(spark, patches)
    index.filter("global_idx < 4").select("wsi_id", "global_idx").write.parquet(patches)
    encode = lambda rows: rows.select("wsi_id", "global_idx", F.array(F.col("global_idx") / 3, F.lit(1.0)).cast("array<float>").alias("embedding"))
    assert store.completion(index, store.load_patches(spark, patches)).first().asDict() == {"wsi_id": 0, "n": 6, "todo": 2, "done_share": 4 / 6}
    with pytest.raises(RuntimeError, match="2 of 6"):
        store.materialise_embeddings(spark, index, patches, out, encode, meta)
    index.filter("global_idx >= 4").select("wsi_id", "global_idx").write.mode("append").parquet(patches)
    store.materialise_embeddings(spark, index, patches, out, encode, meta, model="x")
    got = {r.global_idx: list(r.embedding) for r in store.load_embeddings(spark, index, out, 2).collect()}
    assert got == {k: [float(np.float16(np.float32(k / 3))), 1.0] for k in range(6)}
    with pytest.raises(RuntimeError, match="dimension"):
        store.load_embeddings(spark, index, out, 3)
    with pytest.raises(RuntimeError, match="do not belong"):
        store.load_embeddings(spark, index.filter("global_idx > 0"), out, 2)
    with pytest.raises(RuntimeError, match="1 of 7"):
        store.load_embeddings(spark, index.unionByName(index.limit(1).withColumn("global_idx", F.lit(99).cast("long"))), out, 2)


def test_rasters_classes_and_slides_have_to_be_known(spark):
    pairs = spark.createDataFrame([(0, "a.svs"), (1, "b.svs")], "wsi_id int, raster string")
    nodes = board(spark)
    assert [r.raster for r in store.require_rasters(spark, nodes, pairs).collect()] == ["a.svs"]
    with pytest.raises(FileNotFoundError):
        store.require_rasters(spark, nodes.withColumn("wsi_id", F.lit(5)), pairs)
    assert metrics.resolve_classes(spark, nodes) == ["ACINAIRE", "SOLIDE"] and metrics.resolve_classes(spark, nodes, ["SOLIDE"]) == ["SOLIDE"]
    with pytest.raises(ValueError, match="NECK"):
        metrics.resolve_classes(spark, nodes, ["SOLIDE", "NECK"])
    assert graph.one_slide(spark, nodes).count() == 128
    with pytest.raises(ValueError):
        graph.one_slide(spark, nodes, 4)


def test_class_counts_of_files(spark, tmp_path):
    square = "[[[0,0],[224,0],[224,448],[0,448]]]"
    feature = lambda c: '{"properties": {"classification": %s}, "geometry": {"type": "Polygon", "coordinates": %s}}' % (c, square)
    (tmp_path / "a.geojson").write_text('{"features": [%s, %s, %s]}' % (feature('{"name": "SOLIDE"}'), feature('{"id": 1}'), feature("null")))
    (tmp_path / "b.GeoJSON").write_text('{"features": [%s]}' % feature('{"name": "SOLIDE"}'))
    (tmp_path / "c_PRED.geojson").write_text('{"features": [%s]}' % feature('{"name": "SOLIDE"}'))
    out = tmp_path / "out"
    whole, per = annotations.class_counts(spark, str(tmp_path), str(out))
    assert {(r["class"], r.polygons, r.patches) for r in whole.collect()} == {("SOLIDE", 1, 2.0), ("unknown", 1, 2.0), ("None", 1, 2.0)}
    assert {r.slide for r in per.collect()} == {"a"}
    held = store.read_csv(spark, str(out / "class_balance_global"), "class string, polygons long, patches double, pct double").collect()
    assert sorted(r.pct for r in held) == pytest.approx([100 / 3] * 3)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("")
    assert annotations.class_counts(spark, str(tmp_path / "none")) == (None, None)


def test_histories(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, 0.9), (2, 0.25, 0.8)], "epoch long, tr_loss double, va_loss double")
    store.write_csv(rows, str(tmp_path / "h"))
    got = store.read_csv(spark, str(tmp_path / "h"), "epoch long, va_loss double")
    assert sorted(map(tuple, got.collect())) == [(1, 0.9), (2, 0.8)]
    assert sorted(map(tuple, store.training_curves(rows).collect())) == [(1, "loss", "tr", 0.5), (1, "loss", "va", 0.9), (2, "loss", "tr", 0.25), (2, "loss", "va", 0.8)]


def test_schedules(spark):
    losses = [1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.5, 0.6, 0.6, 0.6, 0.6, 0.6]
    h = spark.createDataFrame(list(enumerate(losses, 1)), "epoch long, loss double")
    got = [r.lr for r in metrics.plateau_schedule(h, 1.0).orderBy("epoch").collect()]
    assert got == [1.0] * 5 + [0.5] * 6 + [0.25]
    assert [r.lr for r in metrics.schedule(spark, None, 2, 0.1).collect()] == [0.1, 0.1]
    with pytest.raises(ValueError):
        metrics.schedule(spark, "linear", 3)
    phases = metrics.two_phases(metrics.schedule(spark, "none", 3, 1.0), 2).orderBy("epoch").collect()
    assert [(r.phase, r.lr) for r in phases] == [(1, 1.0), (1, 1.0), (2, 0.1)]


def test_pooling_modes(spark):
    steps = spark.createDataFrame([(1, 0, [9.0, 8.0]), (1, 1, [1.0, 2.0]), (1, 2, [3.0, 6.0]), (2, 0, [5.0, 5.0])], "walk_id long, pos int, embedding array<float>")
    read = lambda mode: {(r.walk_id, r.dim): r.value for r in sequences.pool(steps, mode).collect()}
    assert read("cls") == {(1, 0): 9, (1, 1): 8, (2, 0): 5, (2, 1): 5} and read("mean") == {(1, 0): 2, (1, 1): 4, (2, 0): 0, (2, 1): 0}
    assert read("concat") == {(1, 0): 9, (1, 1): 8, (1, 2): 2, (1, 3): 4, (2, 0): 5, (2, 1): 5, (2, 2): 0, (2, 3): 0}
    with pytest.raises(ValueError):
        sequences.pool(steps, "max")


def test_norms_count_zero_rows(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "e array<float>")
    assert metrics.norm_statistics(v, "e").first().asDict() == {"n": 2, "mean": 2.5, "least": 0.0, "most": 5.0, "deviation": 2.5, "zero_share": 0.5}


def test_best_model_is_kept_and_loaded(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("label"), F.array(F.rand(1) + F.col("id") % 2, F.rand(2)).cast("array<float>").alias("embedding"))
    history, test = learners.keep_best(rows, str(tmp_path / "model"), (0.0, 0.1))
    assert history[0]["improved"] and len(history) == 2 and test.first().n == 60 and test.first().accuracy > 0.9


def test_projection_spans_the_spread(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 3)) @ np.diag([1, 1, 1]) + np.outer(rng.normal(size=200) * 3, [1, -1, 0])
    rows = spark.createDataFrame([(int(k), 0, [float(x) for x in v]) for k, v in enumerate(data)], "key long, label int, embedding array<float>")
    got = np.array([(r.x, r.y) for r in learners.pca_projection(rows).orderBy("key").collect()])
    z = (data - data.mean(0)) / data.std(0, ddof=1)
    _, _, axes = np.linalg.svd(z - z.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(z @ axes[:2].T), atol=1e-3)


def test_fixed_values():
    assert len(config.LABELS) == 14 and len(config.NEIGHBOURS[0]) == 6
