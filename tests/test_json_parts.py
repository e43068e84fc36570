"""Objects of one file's list, read in stretches of any size, against a plain parser."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import annotations, json_parts


def collection(n: int) -> dict:
    rng = np.random.default_rng(n)
    out = {"type": "FeatureCollection", "crs": {"a": {"b": [1, {"geometry": "no"}]}, "bbox": [[1, 2], {"x": "]"}]}, "features": [], "more": {"list": [{"type": "Feature"}]}}
    for k in range(n):
        name = ["Tumor", 'quoted "name" {[', "back\\slash \\", "é漢🎈", "}]", ""][k % 6]
        ring = [[float(v) for v in p] for p in rng.integers(0, 900, (int(rng.integers(3, 9)), 2))]
        shape = {"type": "Polygon", "coordinates": [ring]} if k % 3 else {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}
        out["features"].append({"type": "Feature", "id": k, "properties": {"classification": {"name": name}, "deep": {"x": [{}, [[]]]}}, "geometry": shape if k % 7 else {"type": "Point", "coordinates": [1, 2]}})
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("annotations")
    for n, name in ((60, "large"), (3, "small"), (0, "none")):
        (at / f"{name}.geojson").write_text(json.dumps(collection(n), indent=n % 7 or None, ensure_ascii=bool(n % 2)), "utf-8")
    (at / "bare.geojson").write_text("")
    (at / "other.geojson").write_text('[{"type": "Feature"}, "x"]')
    return at


@pytest.mark.parametrize("size", [1 << 20, 977, 64, 7])
def test_objects_of_all_stretches(spark, folder, size):
    if size == 7:  # a stretch may begin anywhere: in a text, behind a backslash, between the bytes of a letter
        (folder / "tiny").mkdir(exist_ok=True)
        (folder / "tiny" / "tiny.geojson").write_text(json.dumps(collection(7), ensure_ascii=False), "utf-8")
        path, want = str(folder / "tiny"), {"tiny": collection(7)["features"]}
    else:
        path, want = f"{folder}/*.geojson", {n: collection(k)["features"] for k, n in ((60, "large"), (3, "small"))}
    got = json_parts.list_items(spark, path, size)
    held: dict = {}
    for r in got.orderBy("file", "item").collect():
        held.setdefault(r.file.rsplit("/", 1)[1].removesuffix(".geojson"), []).append((r.item, json.loads(r.json)))
    assert {k: [x for _, x in v] for k, v in held.items()} == want
    assert all([i for i, _ in v] == list(range(len(v))) for v in held.values())


def test_several_tasks_read_one_file_and_give_equal_rows(spark, folder):
    whole = annotations.parse_features(spark.read.text(f"{folder}/large.geojson", wholetext=True).select(F.lit("x").alias("file"), "value"), "file", "value")
    parts = annotations.read_geojson(spark, f"{folder}/large.geojson", 1000)
    names = ("feature", "cls", "rings", "area")
    by = lambda df: sorted(map(str, df.select(*names).collect()))
    assert by(parts) == by(whole) and whole.count() > 40
    one = json_parts.list_items(spark, f"{folder}/large.geojson", 1000)
    assert one.groupBy(F.spark_partition_id()).count().count() > 1


def test_a_file_that_breaks_off(spark, tmp_path):
    text = json.dumps(collection(12))
    (tmp_path / "a.geojson").write_text(text[: text.index('"id": 9') + 40])
    got = annotations.read_geojson(spark, f"{tmp_path}/a.geojson", 100).collect()
    assert {r.feature for r in got} == {k for k in range(9) if k % 7}
