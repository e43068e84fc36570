"""Image files, windows of them and encoders of patches against numpy arrays and plain loops."""

import io
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan

from tessera.operators import encoders, grid
from tessera.sources import raster, store


def image(seed: int, height: int, width: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3)).astype(np.uint8)


def pyramid(im: np.ndarray, levels: int = 3) -> list[np.ndarray]:
    out = [im]
    while len(out) < levels:
        out.append(raster.halved(out[-1]))
    return out


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("deflate", [False, True])
def test_files_are_read_as_written(big, deflate):
    ims = pyramid(image(1, 100, 150))
    file = io.BytesIO(raster.encode(ims, 32, 0.25, 0, 640, deflate, big))
    p = raster.Pyramid.parse(file)
    assert [(v.width, v.height, v.cols, v.rows) for v in p.levels] == [(150, 100, 5, 4), (75, 50, 3, 2), (37, 25, 2, 1)]
    assert (p.mpp, p.x, p.y, p.levels[2].place(640)) == (0.25, 0, 640, 160)
    for k, im in enumerate(ims):
        got = p.window(file, k, -5, -3, im.shape[1] + 10, im.shape[0] + 7)
        assert (got[3 : 3 + im.shape[0], 5 : 5 + im.shape[1]] == im).all() and (got[:3] == 255).all() and (got[:, -5:] == 255).all()
    assert (p.window(file, 0, 31, 40, 70, 33) == ims[0][40:73, 31:101]).all()
    assert (p.window(file, 0, 900, 0, 4, 4) == 255).all()


def by_hand(order: str, entries: list[tuple], pixels: bytes) -> bytes:
    """A file of one directory behind its pixels."""
    at = 8 + len(pixels)
    out = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at) + pixels + struct.pack(f"{order}H", len(entries))
    for tag, kind, value in entries:
        out += struct.pack(f"{order}HHI", tag, kind, 1) + struct.pack(order + ("HH" if kind == 3 else "I"), *((value, 0) if kind == 3 else (value,)))
    return out + struct.pack(f"{order}I", 0)


TILED = [(256, 4, 4), (257, 4, 4), (258, 3, 8), (259, 3, 1), (277, 3, 3), (322, 4, 4), (323, 4, 4), (324, 4, 8), (325, 4, 48)]


def test_either_order_of_bytes_and_what_is_not_read():
    pixels = image(2, 4, 4)
    for order in "<>":
        file = io.BytesIO(by_hand(order, TILED, pixels.tobytes()))
        p = raster.Pyramid.parse(file)
        assert p.mpp is None and (p.window(file, 0, 0, 0, 4, 4) == pixels).all()
    for entries, said in (([e for e in TILED if e[0] not in (322, 323)], "no tiled level"), ([(259, 3, 7) if e[0] == 259 else e for e in TILED], "compression 7"), ([(277, 3, 1) if e[0] == 277 else e for e in TILED], "RGB")):
        with pytest.raises(ValueError, match=said):
            raster.Pyramid.parse(io.BytesIO(by_hand("<", entries, pixels.tobytes())))
    with pytest.raises(ValueError, match="not a TIFF"):
        raster.Pyramid.parse(io.BytesIO(b"\x89PNG" + bytes(40)))
    with pytest.raises(ValueError, match="too early"):
        raster.Pyramid.parse(io.BytesIO(raster.encode(pyramid(image(3, 64, 64)), 32)[:-200]))


def slow_resample(im: np.ndarray, width: int, height: int) -> np.ndarray:
    def line(row: list, n: int) -> list:
        scale = len(row) / n
        stretch, out = max(scale, 1), []
        for i in range(n):
            centre, total, sums = (i + 0.5) * scale, 0.0, [0.0] * 3
            for x in range(max(0, int(centre - 3 * stretch + 0.5)), min(len(row), int(centre + 3 * stretch + 0.5))):
                z = (x - centre + 0.5) / stretch
                w = 0 if abs(z) >= 3 else 1 if z == 0 else math.sin(math.pi * z) / (math.pi * z) * math.sin(math.pi * z / 3) / (math.pi * z / 3)
                total += w
                sums = [s + w * v for s, v in zip(sums, row[x], strict=True)]
            out.append([min(255, max(0, math.floor(round(s / total, 6) + 0.5))) for s in sums])
        return out

    rows = [line(r, width) if im.shape[1] != width else r for r in im.tolist()]
    cols = [line([r[x] for r in rows], height) if im.shape[0] != height else [r[x] for r in rows] for x in range(width)]
    return np.array(cols).transpose(1, 0, 2)


@pytest.mark.parametrize(("height", "width", "to"), [(20, 20, 10), (20, 20, 8), (21, 17, 9), (12, 12, 31), (16, 16, 16), (40, 10, 10), (7, 1, 3)])
def test_resampling(height, width, to):
    im = image(height, height, width)
    assert (raster.resample(im, to, to) == slow_resample(im, to, to)).all()
    assert (raster.resample(np.stack([im, im[::-1]]), to, to)[0] == slow_resample(im, to, to)).all()


@pytest.fixture(scope="module")
def bands(spark, tmp_path_factory):
    """Two slides of 150 by 200 in bands of 64 rows."""
    slides = {1: image(11, 200, 150), 2: image(12, 200, 150)}
    rows = [(w, y // 64, y, im[y].tobytes()) for w, im in slides.items() for y in range(200)]
    lines = spark.createDataFrame(rows, "wsi_id int, band long, y long, line binary").repartition(5)
    files = raster.write_bands(spark, lines, str(tmp_path_factory.mktemp("slides")), 3, 32, 0.5)
    return slides, files


def test_bands_and_headers(spark, bands):
    _, files = bands
    heads = raster.levels(files.withColumn("extra", F.lit("x"))).orderBy("wsi_id", "band", "level").collect()
    assert len(heads) == 2 * 4 * 3 and [(r.width, r.height, r.y, r.mpp, r.levels, r.extra) for r in heads[-3:]] == [(150, 8, 192, 0.5, 3, "x"), (75, 4, 192, 0.5, 3, "x"), (37, 2, 192, 0.5, 3, "x")]
    for downsample, level in ((1.0, 0), (3.0, 1), (32.0, 2), (0.5, 0)):
        assert {r.level for r in raster.best_level(raster.levels(files), downsample).collect()} == {level}
    g = grid.slide_geometry(raster.levels(files).filter("level = 0 AND band = 0").select("wsi_id", "width", "height", "mpp")).collect()
    assert {(r.scale, r.tile) for r in g} == {(1, 224)}


def test_tiles_and_what_is_pushed_down(spark, bands):
    slides, files = bands
    paths = [r.path for r in files.collect()]
    everything = raster.tiles(spark, paths, 7)
    got = {w: np.zeros((200, 150, 3), np.uint8) for w in slides}
    for r in everything.filter("level = 0").collect():
        w = int(r.path.rsplit("/", 1)[1].split("-")[0])
        got[w][r.y : r.y2, r.x : r.x2] = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
    assert all((got[w] == slides[w]).all() for w in slides)
    some = everything.filter((F.col("level") == 0) & (F.col("x") < 64) & (F.col("x2") > 40) & F.col("y").isin(64, 96))
    assert {(r.x, r.y) for r in some.collect()} == {(32, 64), (32, 96)}
    plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert all(x in plan for x in ("EqualTo(level,0)", "LessThan(x,64)", "GreaterThan(x2,40)", "In(y, [64,96])")) and "Filter (" not in plan  # none is left above the scan
    assert some.rdd.getNumPartitions() < everything.rdd.getNumPartitions() and everything.count() == 2 * (3 * (10 + 3) + 2 * 3 + 5 + 3 + 2)


class Counted(io.BytesIO):
    """A file that counts what is read of it."""

    def __init__(self, data: bytes):
        super().__init__(data)
        self.n = 0

    def read(self, size: int = -1) -> bytes:
        got = super().read(size)
        self.n += len(got)
        return got


def test_bytes_read_fall_with_the_window(monkeypatch):
    data = raster.encode(pyramid(image(5, 640, 640)), 32, deflate=False)
    opened: list[Counted] = []
    monkeypatch.setattr(raster, "opened", lambda path: opened.append(Counted(data)) or opened[-1])

    def read(filters: list) -> tuple[int, int]:
        reader = raster.TileReader(["a"])
        rest = list(reader.pushFilters(filters))
        assert rest == []
        opened.clear()
        rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
        return len(rows), sum(f.n for f in opened)

    everything, all_bytes = read([])
    assert everything == 400 + 100 + 25 and all_bytes > len(data) * 0.95
    one, few_bytes = read([IsNotNull(("x",)), EqualTo(("level",), 0), LessThan(("x",), 64), GreaterThan(("x2",), 0), LessThan(("y",), 64), GreaterThan(("y2",), 32)])
    assert one == 2 and few_bytes < all_bytes / 50
    assert read([EqualTo(("level",), 9)])[0] == 0 and read([In(("level",), (1, 2)), In(("col",), (0,))])[0] == 10 + 5
    assert read([In(("path",), ("b",))])[0] == 0 and read([EqualTo(("path",), "a"), EqualTo(("level",), 2)])[0] == 25


def test_windows(spark, bands):
    slides, files = bands
    rng = np.random.default_rng(4)
    asked = [(k, int(rng.integers(1, 3)), int(rng.integers(0, 150)), int(rng.integers(0, 200)), int(rng.integers(1, 90)), int(rng.integers(1, 90))) for k in range(60)]
    asked += [(60, 1, 0, 0, 150, 200), (61, 2, 149, 199, 1, 1), (61, 2, 149, 199, 1, 1)]
    w = spark.createDataFrame(asked, "key int, wsi_id int, x long, y long, width int, height int").withColumn("band", F.lit("own")).repartition(3)
    for level in (0, 1):
        ims = {k: pyramid(np.concatenate([im]), 2)[level] for k, im in slides.items()}
        got = raster.read_windows(w, files.withColumn("level", F.lit(level)), None, 64 >> level).collect()
        for r in got:
            want = np.full((r.height, r.width, 3), 255, np.uint8)
            piece = ims[r.wsi_id][r.y : r.y + r.height, r.x : r.x + r.width]
            want[: piece.shape[0], : piece.shape[1]] = piece
            assert (np.frombuffer(r.pixels, np.uint8).reshape(want.shape) == want).all(), r.key
        assert len(got) == len(asked)
    one = spark.createDataFrame([(1, f"{next(iter(files.filter('wsi_id = 1 AND band = 0').collect())).path}", 0)], "wsi_id int, path string, level int")
    got = raster.read_windows(w, one, None).filter("y + height <= 64").collect()
    assert got and all((np.frombuffer(r.pixels, np.uint8) == 255).all() for r in got if r.wsi_id == 2)
    small = {r.key: r.pixels for r in raster.read_windows(w, files.withColumn("level", F.lit(0)), 8, 64).collect()}
    for key, s, x, y, width, height in asked[:8]:
        full = np.full((height, width, 3), 255, np.uint8)
        piece = slides[s][y : y + height, x : x + width]
        full[: piece.shape[0], : piece.shape[1]] = piece
        assert (np.frombuffer(small[key], np.uint8).reshape(8, 8, 3) == slow_resample(full, 8, 8)).all()


def test_tissue_share(spark, bands):
    slides, files = bands
    w = spark.createDataFrame([(1, 10, 60, 30, 20), (2, 0, 0, 7, 5)], "wsi_id int, x long, y long, width int, height int")
    got = raster.tissue_share(raster.read_windows(w, files.withColumn("level", F.lit(0)), None, 64), 120).collect()
    for r in got:
        piece = slides[r.wsi_id][r.y : r.y + r.height, r.x : r.x + r.width].astype(float)
        assert r.tissue_share == pytest.approx(float((piece @ [0.2989, 0.5870, 0.1140] <= 120).mean()))


# --- encoders -----------------------------------------------------------------------------------------------------


def patches(n: int, size: int = 12) -> list[tuple]:
    rng = np.random.default_rng(6)
    return [(k, k % 3, k // 3, k * size, 0, (rng.integers(0, 256, (size, size, 3)) * rng.random(3)).astype(np.uint8).tobytes()) for k in range(n)]


PATCH = "global_idx long, wsi_id int, node_id long, px long, py long, pixels binary"


def test_checks_come_before_any_work(monkeypatch):
    assert encoders.check("colours", 12) == 6
    with pytest.raises(ValueError, match="unknown encoder"):
        encoders.check("vit", 12)
    with pytest.raises(ValueError, match="fitted first"):
        encoders.check("components16", 12)
    monkeypatch.setitem(encoders.ENCODERS, "wrong", encoders.Encoder(5, "tissue", encoders._colours))
    with pytest.raises(ValueError, match=r"gives \(6,\) for a patch, not 5"):
        encoders.check("wrong", 12)


def test_fitted_encoder(spark, tmp_path):
    rows = patches(150)
    df = spark.createDataFrame(rows, PATCH)
    fitted = encoders.fit(df.repartition(5), "components16", 12)
    x = np.stack([np.frombuffer(r[-1], np.uint8).reshape(12, 12, 3) for r in rows])
    mean, deviation = encoders.CHANNELS["photographs"]
    x = (x / 255 - mean) / deviation
    edges = np.linspace(0, 12, 9).astype(int)
    y = np.stack([[x[:, a:b, c:d].mean((1, 2)) for c, d in zip(edges, edges[1:])] for a, b in zip(edges, edges[1:])]).transpose(2, 0, 1, 3).reshape(len(x), -1)
    _, _, axes = np.linalg.svd(y - y.mean(0), full_matrices=False)
    for got, want in zip(fitted[1], axes[:16], strict=True):
        assert abs(got @ want) == pytest.approx(1, abs=1e-3) and got[np.abs(got).argmax()] > 0
    encoders.save(spark, fitted, f"{tmp_path}/model")
    again = encoders.load(spark, f"{tmp_path}/model")
    out = {r.global_idx: r.embedding for r in encoders.encode(df.repartition(4), "components16", 12, again).collect()}
    want = (y - y.mean(0)) @ fitted[1].T
    assert all(np.allclose(out[k], want[k], atol=1e-3) for k in out) and len(out) == 150
    with pytest.raises(ValueError, match="no patches"):
        encoders.fit(df.limit(0), "components16", 12)


def test_embeddings_go_on_where_they_stopped(spark, tmp_path):
    rows = patches(30)
    index = spark.createDataFrame([r[:5] for r in rows], "global_idx long, wsi_id int, node_id long, px long, py long")
    held, made, done = f"{tmp_path}/patches", f"{tmp_path}/vectors", []
    store.materialise(spark, index, held, lambda r: spark.createDataFrame(rows, PATCH).join(r.select("global_idx"), "global_idx", "left_semi"), f"{held}-meta")

    def encode(r, fail: bool = False):
        done.append(r.count())
        if fail:
            raise KeyboardInterrupt
        return encoders.encode(r.select("global_idx", "wsi_id", "pixels"), "colours", 12)

    store.materialise_embeddings(spark, index, held, made, encode, f"{made}-meta", model="colours")
    first = store.load_embeddings(spark, index, made, 6).orderBy("global_idx").collect()
    spark.read.parquet(made).filter("global_idx >= 20").write.partitionBy("wsi_id").parquet(f"{made}-part")  # as if a run had died
    with pytest.raises(KeyboardInterrupt):
        store.materialise_embeddings(spark, index, held, f"{made}-part", lambda r: encode(r, True), f"{made}-meta", model="colours")
    store.materialise_embeddings(spark, index, held, f"{made}-part", encode, f"{made}-meta", model="colours")
    assert done == [30, 20, 20]
    assert [r.embedding for r in store.load_embeddings(spark, index, f"{made}-part", 6).orderBy("global_idx").collect()] == [r.embedding for r in first]
    with pytest.raises(RuntimeError, match="dimension 7"):
        store.load_embeddings(spark, index, made, 7)
