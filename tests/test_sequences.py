import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers all queries)
from tessera.operators import graph, grid, learners, metrics, sequences
from tessera.plans import fixture
from tessera.plans import queries as plans
from tessera.plans import sequence_queries
from tessera.sources import annotations, store

SF = "/root/testdata/sf0.001"
OWN = [n for n, f in plans.QUERIES.items() if f.__module__ == sequence_queries.__name__]


@pytest.mark.parametrize("name", OWN)
def test_against_sql(spark, name):
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    got = plans.QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows
    if name not in plans.ORACLES:
        return
    con = duckdb.connect()
    for t in os.listdir(SF):
        at = f"{SF}/{t}"
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}{'/*' if os.path.isdir(at) else ''}')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_half_precision(spark):
    df = spark.createDataFrame([([0.1, 70000.0, -2.5],), (None,), ([],)], "v array<float>")
    got = [r.v for r in df.select(sequences.to_half("v").alias("v")).collect()]
    assert got[0] == [float(np.float16(0.1)), float("inf"), -2.5] and got[1] is None and got[2] == []


def test_pairs(spark):
    paths = [("d/a.svs",), ("d/a.geojson",), ("d/b.SVS",), ("d/b.GeoJSON",), ("d/c.svs",), ("d/c_pred.geojson",), ("d/apredb.geojson",), ("d/x.geojson",)]
    pairs, lone = annotations.pair_files(spark.createDataFrame(paths, "path string"))
    assert sorted(r.wsi_id for r in pairs.collect()) == ["a", "b"]
    assert [r.wsi_id for r in lone.collect()] == ["c"]


def test_geojson_files(spark, tmp_path):
    square = "[[[0,0],[4,0],[4,4],[0,4]],[[1,1],[2,1],[2,2],[1,2]]]"
    text = '{"features": [{"properties": {"classification": {"name": "SOLIDE"}}, "geometry": {"type": "Polygon", "coordinates": %s}},' % square
    text += '{"properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [%s, %s]}}, {"properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}' % (square, square)
    (tmp_path / "a.geojson").write_text(text)
    (tmp_path / "b.geojson").write_text("no json")
    got = sorted((r.feature, r.cls, r.area, len(r.rings)) for r in annotations.read_geojson(spark, str(tmp_path)).collect())
    assert got == [(0, "SOLIDE", 15.0, 2), (1, "background", 30.0, 4)]


def test_stages_go_on_and_start_again(spark, tmp_path):
    index = spark.createDataFrame([(0, k, k * 2, k * 3) for k in range(6)], "wsi_id int, global_idx long, px long, py long")
    out, meta = str(tmp_path / "out"), str(tmp_path / "meta")
    assert not store.is_valid(spark, index, meta)
    work = lambda d: d.select("wsi_id", "global_idx", (F.col("px") + F.col("py")).alias("s"))
    store.materialise(spark, index, out, work, meta, patch=224)
    assert store.is_valid(spark, index, meta, patch=224) and not store.is_valid(spark, index, meta, patch=256)
    assert store.todo(spark, index, out).count() == 0
    store.materialise(spark, index, out, work, meta, patch=224)
    assert spark.read.parquet(out).count() == 6
    moved = index.withColumn("px", F.col("px") + 1)
    store.materialise(spark, moved, out, work, meta, patch=224)
    assert sorted(r.s for r in spark.read.parquet(out).collect()) == [1 + 5 * k for k in range(6)]


def test_region_walks_stay_inside_and_differ(spark):
    nodes = graph.number_nodes(spark.createDataFrame([(0, c, r, "SOLIDE" if c < 8 else "ACINAIRE") for c in range(16) for r in range(8)], "wsi_id int, c long, r long, label string"))
    found = graph.regions(spark, nodes)
    tries = sequences.attempts(found, graph.region_sizes(found).withColumn("quota", F.lit(5).cast("long")))
    walks = sequences.accept(graph.walks(grid.neighbours(spark, nodes).filter("src_label = dst_label"), tries, True), tries).collect()
    label = {r.node_id: r.label for r in nodes.collect()}
    assert len(walks) == 10 and len({min(tuple(w.path), tuple(w.path[::-1])) for w in walks}) == 10
    assert all(len(w.path) >= 30 and {label[k] for k in w.path} == {w.label} for w in walks)


def test_balanced_walks_are_whole_and_shortfalls_roll_over(spark):
    """A thin region, the largest, yields few walks where they stop; the reference gives what it lacks to later ones."""
    cells = [(0, 0, r, "SOLIDE") for r in range(32)] + [(0, c, r, "SOLIDE") for c in range(4, 10) for r in range(5)] + [(0, c, r, "SOLIDE") for c in range(14, 19) for r in range(6)]
    cells += [(0, c, r, "ACINAIRE") for c in range(30, 37) for r in range(6)]
    nodes = graph.number_nodes(spark.createDataFrame(cells, "wsi_id int, c long, r long, label string"))
    found = graph.regions(spark, nodes)
    sizes = graph.region_sizes(found)
    edges = grid.neighbours(spark, nodes).filter("src_label = dst_label")
    target = {r.label: r.target for r in graph.class_capacity(sizes).collect()}
    every = sequences.attempts(found, sizes.withColumn("quota", F.lit(max(target.values())).cast("long")))
    for bounce in (False, True):
        tried: dict = {}
        paths = {r.walk_id: tuple(r.path) for r in graph.walks(edges, every, bounce).collect()}
        for t in every.collect():
            tried.setdefault((t.label, t.root), {})[t.attempt] = paths[t.walk_id]
        want = set()
        for label in target:
            parts = sorted((r for r in sizes.collect() if r.label == label), key=lambda r: (-r.n_nodes, r.wsi_id, r.root))
            produced = 0
            for i, p in enumerate(parts):
                if target[label] - produced <= 0:
                    break
                alloc = max(1, round((target[label] - produced) * p.n_nodes / sum(x.n_nodes for x in parts[i:])))
                seen = set()
                for k in range(max(10 * alloc, 10)):
                    path = tried[label, p.root][k]
                    if len(seen) < alloc and len(path) >= 30 and min(path, path[::-1]) not in seen:
                        seen.add(min(path, path[::-1]))
                        want.add((label, p.root, k, path))
                produced += len(seen)
        kept, made = sequences.balanced_walks(spark, edges, found, sizes, bounce)
        assert {(r.label, r.root, r.attempt, tuple(r.path)) for r in kept.collect()} == want
        report = {r.label: r for r in sequences.walk_report(made, graph.class_capacity(sizes)).collect()}
        assert {k: r.produced for k, r in report.items()} == {k: sum(w[0] == k for w in want) for k in target}
        rows = {(r.label, r.root): r for r in made.collect()}
        thin = rows["SOLIDE", 0]
        assert (thin.got < thin.quota) == (not bounce)


def test_balanced_query_makes_the_whole_allocation(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    alloc = {(r.wsi_id, r.label, r.root): r.alloc for r in plans.QUERIES["balanced_alloc"](spark, SF).collect() if r.alloc}
    got = {(r.wsi_id, r.label, r.root): r["count"] for r in plans.QUERIES["walks_balanced"](spark, SF).groupBy("wsi_id", "label", "root").count().collect()}
    assert got == alloc
    assert sum(r.produced for r in plans.QUERIES["walk_report"](spark, SF).collect()) == sum(alloc.values())


def test_probe_without_a_cap_counts_all_rows(spark):
    rows = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("label"), F.array(F.rand(1) + F.col("id") % 2, F.rand(2)).cast("array<float>").alias("embedding"))
    assert [learners.linear_probe(rows, most).first().n for most in (2000, None)] == [1200, 1500]


def test_walk_classifier_is_judged_on_the_test_walks_of_all_nodes(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    walks = fixture.labelled(spark, SF).select((F.col("wsi_id").cast("long") * 10_000_000 + F.col("node_id")).alias("key"), "label")
    want = metrics.stratified_split(walks, "key", "label", 0.70, 0.0, 42).filter("split = 'test'").count()
    assert plans.QUERIES["walk_classifier"](spark, SF).first().n == want


def test_means_of_wide_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(w), rng.normal(size=1536).astype(np.float32)) for k, w in zip(rng.integers(0, 40, 900), rng.uniform(0.5, 2, 900), strict=True)]
    rows += [(99, 2.0, None), (99, 1.0, np.ones(1536)), (100, 1.0, np.full(3, 7.0))]
    df = spark.createDataFrame([(k, w, None if x is None else [float(v) for v in x]) for k, w, x in rows], "walk_id long, w double, embedding array<float>").repartition(7)
    out = {}
    for r in sequences.mean_vectors(df, F.col("w")).groupBy("walk_id").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).collect():
        assert [x.dim for x in r.v] == list(range(1536))
        out[r.walk_id] = np.array([x.value for x in r.v])
    for k in out:
        own = [(w, np.zeros(1536) if x is None else np.pad(x, (0, 1536 - len(x)))) for i, w, x in rows if i == k]
        assert np.allclose(out[k], sum(w * x for w, x in own) / sum(w for w, _ in own), atol=1e-6)
    assert len(out) == len({k for k, *_ in rows})
    assert sequences.mean_vectors(df.limit(0)).count() == 0


def test_half_precision_of_whole_columns(spark):
    rows = [(0, [0.1, 1e-9, 70000.0]), (1, None), (2, []), (3, [None, 3.14159265])]
    got = {r.k: r.h for r in spark.createDataFrame(rows, "k int, v array<float>").repartition(1).select("k", sequences.to_half("v").alias("h")).collect()}
    assert got[1] is None and got[2] == [] and got[3][0] is None and got[3][1] == float(np.float16(3.14159265)) and got[0][:2] == [float(np.float16(0.1)), 0.0] and np.isinf(got[0][2])
