"""Walks over tiles: the same walks as over edges, the same draws as in SQL, and no row for each step."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import cut, draw
from tessera.operators import graph, grid, sequences, training
from tessera.operators.sequence_model import Shape
from tessera.plans import fixture as X
from tessera.plans import queries as Q
from tessera.plans import sequence_queries as S

SF = "/root/testdata/sf0.001"


def test_draws_are_those_of_columns(spark):
    ids = [0, 7, 99, 10_000_288, 2**60 - 1, -5]
    df = spark.createDataFrame([(i, k) for i in ids for k in (1, 9, 10, 39)], "i long, k int")
    for seed in ("walk", "s" * 60):
        want = {(r.i, r.k): r.d for r in df.select("i", "k", draw(F.lit(seed), F.col("i").cast("string"), F.col("k").cast("string")).alias("d")).collect()}
        got = graph.step_draws(seed, np.array(ids), 39)
        assert {(i, k): int(got[n, k - 1]) for n, i in enumerate(ids) for k in (1, 9, 10, 39)} == want


@pytest.mark.parametrize(("bounce", "same", "sharp"), [(False, False, 1), (True, True, 0)])
def test_walks_are_those_over_edges(spark, monkeypatch, bounce, same, sharp):
    monkeypatch.setattr(graph, "WALK_BLOCK", 9)
    monkeypatch.setattr(graph, "TOGETHER", 17)
    n = X.labelled(spark, SF).filter("wsi_id < 2")
    edges = grid.neighbours(spark, n)
    edges = edges.filter("src_label = dst_label") if same else edges
    todo = X.starts(n, not same)
    # A start that is no node is a walk by itself.
    lost = todo.limit(1).withColumn("start", F.lit(9_000_000).cast("long")).withColumn("walk_id", F.lit(-3).cast("long")).drop("c", "r", "label")
    want = {(r.wsi_id, r.walk_id): r.path for r in graph.walks(edges, todo.drop("c", "r", "label").unionByName(lost), bounce, sharp).collect()}
    got = graph.grid_walks(n, todo.drop("c", "r", "label").unionByName(lost), bounce, same, sharp, carry=("label", "cx")).collect()
    assert {(r.wsi_id, r.walk_id): r.path for r in got} == want
    at = {(r.wsi_id, r.node_id): (r.label, r.cx) for r in n.collect()}
    for r in got:
        assert list(zip(r.path_label, r.path_cx, strict=True)) == [at.get((r.wsi_id, x), (None, None)) for x in r.path]


def test_means_over_walks_with_several_vectors_of_a_key_and_none(spark):
    n = spark.createDataFrame([(0, k, 0, k, k % 3) for k in range(5)], "wsi_id int, node_id long, c long, r long, v long")
    starts = spark.createDataFrame([(0, 10, 0, 4), (0, 11, 4, 1)], "wsi_id int, walk_id long, start long, length long")
    v = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, None)], "v long, vector array<float>")  # none for 2
    read = lambda **how: {(r.walk_id, r.dim): r.value for r in sequences.walk_means(n, starts, v, "v", 2, **how).collect()}
    assert read() == {(10, 0): 2.0, (10, 1): 1.0}  # nodes 0 to 3, two vectors each at 0 and 3; node 4 has none
    turn = np.mean([np.sin(0.0), np.sin(3.0)])
    assert read(positions=True)[10, 0] == pytest.approx(2.0 + turn)
    assert read(head=True) == {(10, 0): 3.0, (10, 1): 2.0, (10, 2): 2.0, (10, 3): 1.0}


def test_label_of_most_takes_the_first_met_of_equals():
    table = pa.table({"label": ["a", "b", "c"]})
    places = np.array([[2, 1, 1, 2, -1], [0, 1, 1, -1, -1], [-1, -1, -1, -1, -1]])
    assert sequences.label_of_most(table, np.arange(3), places, np.array([4, 3, 1]))[0].to_pylist() == ["c", "b", None]


@pytest.mark.parametrize(
    "query", [Q.walk_label, Q.walk_to_global, Q.walk_polyline, Q.walk_embedding_mean, Q.pool_concat, S.positional_encoding, S.attention_pool, S.reverse_augment], ids=lambda q: q.__name__
)
def test_no_row_for_each_step_and_no_draws_are_shuffled(spark, query):
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(path" not in plan and "concat_ws(:, walk" not in plan


def test_tries_are_made_in_many_tasks_and_not_gathered_on_the_driver(spark):
    n = spark.createDataFrame([(0, "a", 0, k) for k in range(50)], "wsi_id int, label string, root long, node_id long")
    quotas = cut(spark, spark.createDataFrame([(0, "a", 0, 50, 2000)], "wsi_id int, label string, root long, n_nodes long, quota long").coalesce(1), "quotas")
    tries = sequences.attempts(n, quotas)
    plan = tries._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[[^\]]*place", plan) and re.search(r"SortMergeJoin \[[^\]]*place", plan)
    assert sorted(r.attempt for r in tries.select("attempt").collect()) == list(range(20_000))


def test_sequences_hold_numbers_of_vectors_or_the_vectors(spark, monkeypatch):
    rows, classes, width, known = S._sequences(spark, SF)
    assert {"numbers", "more"} <= set(rows.columns) and "vectors" not in rows.columns
    monkeypatch.setattr(S, "_HELD", 0)
    wide, _, _, none = S._sequences(spark, SF)
    assert none is None
    read = lambda df, kn: {int(k): (int(n), x[i, :n]) for b, x, ns in training._batches(iter(df.toArrow().to_batches()), width, kn) for i, (k, n) in enumerate(zip(b.column("key").to_pylist(), ns, strict=True))}
    a, b = read(rows, known), read(wide, none)
    assert set(a) == set(b) and all(a[k][0] == b[k][0] and np.array_equal(a[k][1], b[k][1]) for k in a)
    w = training.M.create(Shape(inputs=width, classes=classes, pooling="attention"), 1)
    p = [{r.key: r.y_pred for r in training.predict(df.filter("split = 'test'"), Shape(inputs=width, classes=classes, pooling="attention"), w, known=kn).collect()} for df, kn in ((rows, known), (wide, none))]
    assert p[0] == p[1]
