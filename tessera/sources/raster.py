"""Tiled image pyramids: TIFF files whose levels are cut into tiles, read tile by tile.

* ``register`` adds the source ``tiled_raster``, whose rows are tiles. Conditions on path, level, col, row, x, y, x2 and y2
  are pushed down: headers alone are read for tiles that they leave out. A task has a range of a level's tiles, and reads
  the stretches of the file that hold those it needs.
* ``levels`` gives what the headers say, a row for each level of each file.
* ``read_windows`` reads windows of slides, which may lie in several files (bands of rows, with their places in the slide
  as the TIFF positions), and resamples them.
* ``write_bands`` writes such files.

Read are files of 8-bit RGB, plain or deflated, with offsets of 32 or 64 bits and either order of bytes; others are an error
that names what is missing. Paths go to pyarrow's file systems, so they may be local, HDFS or an object store.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tessera.functions import cut

# Fixed values of the file format: tags, sizes of its types, compressions.
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 270: "description", 277: "samples", 282: "resolution", 286: "place_x", 287: "place_y",
    296: "unit", 322: "tile_width", 323: "tile_height", 324: "offsets", 325: "sizes",
}
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946
PER_CENTIMETRE, PER_INCH = 3, 2

SCHEMA = "path string, level int, col int, row int, x long, y long, x2 long, y2 long, width int, height int, downsample double, stored long, pixels binary"
#: Tiles of a task, and the gap in a file up to which two of them are read together.
TILES, GAP = 256, 1 << 16


def opened(path: str):
    """A file for reading at any place."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def _read(file, at: int, size: int) -> bytes:
    file.seek(at)
    got = file.read(size)
    if len(got) < size:
        raise ValueError("the file ends too early")
    return got


@dataclass
class Level:
    """One level of a pyramid. Tables of tile offsets stay in the file: only their place is kept."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    compression: int
    tables: dict[str, tuple[int, str, int]]  # name: where, type, count
    downsample: float = 1.0

    @property
    def cols(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def rows(self) -> int:
        return -(-self.height // self.tile_height)

    def place(self, at: int) -> int:
        """Where a place of the first level lies in this one. Sizes of odd length are rounded, so a level of half the size
        may be a little more than twice as small."""
        return at // max(1, round(self.downsample))


@dataclass
class Pyramid:
    """What the header of a file says: its levels, largest first, the size of a pixel in micrometres if it is given, and
    where in its slide the image lies."""

    levels: list[Level]
    mpp: float | None
    x: int = 0
    y: int = 0
    order: str = "<"

    @classmethod
    def parse(cls, file) -> Pyramid:
        head = _read(file, 0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{order or '<'}H", head[2:4])[0]
        if order is None or version not in (42, 43):
            raise ValueError("not a TIFF file")
        big = version == 43
        at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
        levels, first = [], None
        while at:
            entries, at = cls._directory(file, at, order, big)
            if first is None:
                first = entries
            one = lambda name, otherwise=None, e=entries: e[name][0] if name in e else otherwise
            if one("tile_width") is None:
                continue  # labels and overviews, which aren't tiled
            if one("samples", 1) != 3 or set(entries.get("bits", (8,))) != {8}:
                raise ValueError("only 8-bit RGB is read")
            if one("compression", PLAIN) not in (PLAIN, DEFLATE, OLD_DEFLATE):
                raise ValueError(f"compression {one('compression')} is not read")
            levels.append(Level(one("width"), one("height"), one("tile_width"), one("tile_height"), one("compression", PLAIN), {k: entries[k] for k in ("offsets", "sizes")}))
        if not levels:
            raise ValueError("no tiled level in the file")
        levels.sort(key=lambda v: -v.width)
        for level in levels:
            level.downsample = (levels[0].width / level.width + levels[0].height / level.height) / 2
        return cls(levels, cls._mpp(first), *(round(first[k][0] / max(first[k][1], 1)) if k in first else 0 for k in ("place_x", "place_y")), order)

    @staticmethod
    def _directory(file, at: int, order: str, big: bool) -> tuple[dict, int]:
        word, wide = ("Q", 20) if big else ("H", 12)
        n = struct.unpack(order + word, _read(file, at, struct.calcsize(word)))[0]
        held = _read(file, at + struct.calcsize(word), n * wide + (8 if big else 4))
        entries: dict = {}
        for k in range(n):
            raw = held[k * wide : (k + 1) * wide]
            tag, kind, count = struct.unpack(f"{order}HH{'Q' if big else 'I'}", raw[: 12 if big else 8])
            if tag not in TAGS or kind not in TYPES:
                continue
            name, size, room = TAGS[tag], struct.calcsize("=" + TYPES[kind]) * count, 8 if big else 4
            inner = raw[-room:]
            place = at + struct.calcsize(word) + (k + 1) * wide - room if size <= room else struct.unpack(order + ("Q" if big else "I"), inner)[0]
            if name in ("offsets", "sizes"):
                entries[name] = (place, TYPES[kind], count)
                continue
            value = inner[:size] if size <= room else _read(file, place, size)
            entries[name] = value if kind == 2 else struct.unpack(order + TYPES[kind] * count, value)
        return entries, struct.unpack(order + ("Q" if big else "I"), held[n * wide :])[0]

    @staticmethod
    def _mpp(entries: dict) -> float | None:
        said = re.search(rb"MPP\s*=\s*([0-9.]+)", entries.get("description", b""))
        if said:
            return float(said.group(1))
        up, down = entries.get("resolution", (0, 1))
        unit = {PER_CENTIMETRE: 10_000, PER_INCH: 25_400}.get(entries.get("unit", (PER_INCH,))[0])
        return unit * down / up if up and unit else None

    def table(self, file, level: int, name: str, first: int, last: int) -> np.ndarray:
        """Entries first to last (excluded) of a level's offsets or sizes."""
        at, kind, _ = self.levels[level].tables[name]
        width = struct.calcsize("=" + kind)
        return np.frombuffer(_read(file, at + first * width, (last - first) * width), np.dtype(kind).newbyteorder(self.order)).astype(np.int64)

    def tiles(self, file, level: int, wanted: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(number, bytes stored, pixels) of tiles, by number from 0 along rows; what lies beyond the image is cut off."""
        v = self.levels[level]
        if not len(wanted):
            return
        first, last = int(wanted.min()), int(wanted.max()) + 1
        offsets, sizes = (self.table(file, level, name, first, last)[wanted - first] for name in ("offsets", "sizes"))
        order = np.argsort(offsets, kind="stable")
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and offsets[order[to]] - (offsets[order[to - 1]] + sizes[order[to - 1]]) <= GAP and offsets[order[to]] - offsets[order[at]] < 1 << 24:
                to += 1
            start = int(offsets[order[at]])
            held = _read(file, start, int(offsets[order[to - 1]] + sizes[order[to - 1]]) - start)
            for k in order[at:to]:
                raw = held[offsets[k] - start : offsets[k] - start + sizes[k]]
                raw = zlib.decompress(raw) if v.compression != PLAIN else raw
                col, row = int(wanted[k]) % v.cols, int(wanted[k]) // v.cols
                whole = np.frombuffer(raw, np.uint8).reshape(v.tile_height, v.tile_width, 3)
                yield int(wanted[k]), int(sizes[k]), whole[: v.height - row * v.tile_height, : v.width - col * v.tile_width]
            at = to

    def window(self, file, level: int, x: int, y: int, width: int, height: int, seen: dict | None = None) -> np.ndarray:
        """Pixels of a level, the part of a window that the image has in their place and white around them. seen keeps
        tiles for windows to come."""
        v = self.levels[level]
        out = np.full((height, width, 3), 255, np.uint8)
        x1, y1, x2, y2 = max(x, 0), max(y, 0), min(x + width, v.width), min(y + height, v.height)
        if x1 >= x2 or y1 >= y2:
            return out
        cols, rows = np.arange(x1 // v.tile_width, (x2 - 1) // v.tile_width + 1), np.arange(y1 // v.tile_height, (y2 - 1) // v.tile_height + 1)
        wanted = (rows[:, None] * v.cols + cols).ravel()
        seen = {} if seen is None else seen
        missing = np.array([k for k in wanted.tolist() if (level, k) not in seen], np.int64)
        for k, _, pixels in self.tiles(file, level, missing):
            seen[level, k] = pixels
        for k in wanted.tolist():
            left, top = k % v.cols * v.tile_width, k // v.cols * v.tile_height
            pixels = seen[level, k]
            a, b = max(left, x1), min(left + pixels.shape[1], x2)
            c, d = max(top, y1), min(top + pixels.shape[0], y2)
            out[c - y : d - y, a - x : b - x] = pixels[c - top : d - top, a - left : b - left]
        return out


# --- the source -----------------------------------------------------------------------------------------------------


@dataclass
class TileRange(InputPartition):
    path: str
    level: int
    tiles: np.ndarray


@dataclass
class Bounds:
    """What is asked of a column: a range of numbers, or a set of values."""

    least: float = -np.inf
    most: float = np.inf
    among: set | None = None

    def holds(self, values: np.ndarray) -> np.ndarray:
        keep = (values >= self.least) & (values <= self.most)
        return keep & np.isin(values, list(self.among)) if self.among is not None else keep


@dataclass
class TileReader(DataSourceReader):
    paths: list[str]
    per_task: int = TILES
    numbers: dict[str, Bounds] = field(default_factory=dict)
    files: set[str] | None = None

    PUSHED = ("level", "col", "row", "x", "y", "x2", "y2")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if isinstance(f, IsNotNull):
                continue  # no column is ever null
            if name == "path" and isinstance(f, (EqualTo, In)):
                among = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = among if self.files is None else self.files & among
            elif name in self.PUSHED and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                b = self.numbers.setdefault(name, Bounds())
                if isinstance(f, In):
                    among = {v for v in f.value if v is not None}
                    b.among = among if b.among is None else b.among & among
                    continue
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    b.least = max(b.least, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    b.most = min(b.most, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _places(self, p: Pyramid, level: int, tiles: np.ndarray) -> dict[str, np.ndarray]:
        v = p.levels[level]
        col, row = tiles % v.cols, tiles // v.cols
        x0, y0 = v.place(p.x), v.place(p.y)
        x, y = col * v.tile_width, row * v.tile_height
        return {"level": np.full(len(tiles), level), "col": col, "row": row, "x": x + x0, "y": y + y0, "x2": np.minimum(x + v.tile_width, v.width) + x0, "y2": np.minimum(y + v.tile_height, v.height) + y0}

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.paths:
            if self.files is not None and path not in self.files:
                continue
            with opened(path) as file:
                p = Pyramid.parse(file)  # some hundred bytes; tables of tiles stay where they are
            for level, v in enumerate(p.levels):
                for first in range(0, v.cols * v.rows, self.per_task * 64):  # in stretches, as a level may have millions
                    tiles = np.arange(first, min(first + self.per_task * 64, v.cols * v.rows))
                    places = self._places(p, level, tiles)
                    keep = np.ones(len(tiles), bool)
                    for name, b in self.numbers.items():
                        keep &= b.holds(places[name])
                    tiles = tiles[keep]
                    out += [TileRange(path, level, tiles[k : k + self.per_task]) for k in range(0, len(tiles), self.per_task)]
        return out or [TileRange("", 0, np.zeros(0, np.int64))]

    def read(self, partition: TileRange) -> Iterator[pa.RecordBatch]:
        if not len(partition.tiles):
            return
        with opened(partition.path) as file:
            p = Pyramid.parse(file)
            v = p.levels[partition.level]
            for number, stored, pixels in p.tiles(file, partition.level, partition.tiles):
                at = {k: int(x[0]) for k, x in self._places(p, partition.level, np.array([number])).items()}
                row = {"path": partition.path, **at, "width": pixels.shape[1], "height": pixels.shape[0], "downsample": v.downsample, "stored": stored, "pixels": pixels.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)


_ARROW = pa.schema(
    [("path", pa.string()), *((k, pa.int32()) for k in ("level", "col", "row")), *((k, pa.int64()) for k in ("x", "y", "x2", "y2")), ("width", pa.int32()), ("height", pa.int32()), ("downsample", pa.float64()), ("stored", pa.int64()), ("pixels", pa.binary())]
)


class TiledRaster(DataSource):
    """Option path: files, parted by commas. Option tilesPerTask: tiles of a task at most."""

    @classmethod
    def name(cls) -> str:
        return "tiled_raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TileReader:
        paths = [p for p in self.options.get("path", "").split(",") if p]
        if not paths:
            raise ValueError("option path: which files?")
        return TileReader(paths, int(self.options.get("tilespertask", self.options.get("tilesPerTask", TILES))))


def register(spark: SparkSession) -> None:
    """Add the source to a session, and let it see conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiledRaster)


def tiles(spark: SparkSession, paths: Sequence[str], per_task: int = TILES) -> DataFrame:
    """The tiles of all levels of the files."""
    register(spark)
    held = spark.read.format("tiled_raster").option("path", ",".join(paths)).option("tilesPerTask", str(per_task)).load()
    # Spark plans a source again only if a query has conditions; one without any would get the tiles of the query before.
    return held.filter("level >= 0")


# --- headers and windows --------------------------------------------------------------------------------------------

_LEVELS = "level int, levels int, width long, height long, tile_width int, tile_height int, downsample double, mpp double, x long, y long"


def levels(files: DataFrame) -> DataFrame:
    """files (path, ...) with a row for each level of a file: its sizes, how much smaller than the first it is, the size of
    a pixel (null if the file does not say), and the place in the slide."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    p = Pyramid.parse(file)
                more = [{"level": k, "levels": len(p.levels), "width": v.width, "height": v.height, "tile_width": v.tile_width, "tile_height": v.tile_height, "downsample": v.downsample, "mpp": p.mpp, "x": p.x, "y": p.y} for k, v in enumerate(p.levels)]
                yield pa.RecordBatch.from_pylist([row | m for m in more], schema=pa.schema([*batch.schema, *_LEVELS_ARROW]))

    return files.mapInArrow(run, f"{kinds}, {_LEVELS}")


_LEVELS_ARROW = pa.schema(
    [("level", pa.int32()), ("levels", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("tile_width", pa.int32()), ("tile_height", pa.int32()), ("downsample", pa.float64()), ("mpp", pa.float64()), ("x", pa.int64()), ("y", pa.int64())]
)


def best_level(heads: DataFrame, downsample: float) -> DataFrame:
    """Of each file of levels() the smallest level that is not smaller than asked, or the first."""
    fits = F.when(F.col("downsample") <= downsample, F.col("level")).otherwise(0)
    best = heads.groupBy("path").agg(F.max(fits).alias("level"))
    return heads.join(best, ["path", "level"], "left_semi")


def kernel(size: int, out: int, lobes: int = 3) -> np.ndarray:
    """(out, size): what each pixel of a line of that size adds to one of a shorter or longer line, by a windowed sinc that
    is stretched where the line gets shorter."""
    scale = size / out
    stretch = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale
    first = np.maximum(0, (centre - lobes * stretch + 0.5).astype(int))
    last = np.minimum(size, (centre + lobes * stretch + 0.5).astype(int))
    place = np.arange(size)
    z = (place + 0.5 - centre[:, None]) / stretch
    w = np.where((np.abs(z) < lobes) & (place >= first[:, None]) & (place < last[:, None]), np.sinc(z) * np.sinc(z / lobes), 0)
    return w / w.sum(1, keepdims=True)


def resample(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Images (..., rows, columns, 3) in another size, along rows first; each pass rounds to whole 8-bit values. What is a
    half but for the sixth decimal goes up, so that the order of sums does not tell."""

    def whole(x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(np.round(x, 6) + 0.5), 0, 255)

    out = pixels
    if pixels.shape[-2] != width:
        out = whole(np.einsum("ow,...hwc->...hoc", kernel(pixels.shape[-2], width), out, optimize=True))
    if pixels.shape[-3] != height:
        out = whole(np.einsum("oh,...hwc->...owc", kernel(pixels.shape[-3], height), out, optimize=True))
    return out.astype(np.uint8)


#: Windows of a block of so many pixels squared are read by one task one after the other, and share tiles.
BLOCK = 4096
#: Bytes of tiles that a task keeps for the windows to come.
KEPT = 64 << 20


def read_windows(windows: DataFrame, files: DataFrame, out: int | None = None, band: int | None = None) -> DataFrame:
    """windows (wsi_id, x, y, width, height, and any other columns) with their pixels of a level, resampled to out times out
    where they have another size.

    x and y are places in the level; files has (wsi_id, path, level), and where slides lie in bands of so many rows of that
    level, (wsi_id, band, path, level). What lies outside of the image is white, and so are windows of slides that files
    lacks (store.require_rasters tells). Repeated rows have a row each. Windows of a block of a slide go to one task together, where a tile that several
    of them see is read once; pixels are not shuffled."""
    rest = [c for c in windows.columns if c != "band"]
    given = windows.select(*rest)
    one = F.when(F.col("path").isNotNull(), F.struct("path", "level"))
    if band is None:
        held = given.join(files.select("wsi_id", "path", "level"), "wsi_id", "left").select(*rest, F.array_compact(F.array(one)).alias("files"))
    else:
        first, last = F.expr(f"y div {band}"), F.expr(f"(y + height - 1) div {band}")
        over = given.withColumn("band", F.explode(F.sequence(first, last)))
        over = over.join(files.select("wsi_id", F.col("band").cast("long").alias("band"), "path", "level"), ["wsi_id", "band"], "left")
        held = over.groupBy(*rest).agg(F.array_sort(F.collect_set(one)).alias("files"), F.count("*").alias("copies_"))  # two or three files
        again = F.array_repeat(F.lit(0), (F.col("copies_") / (last - first + 1)).cast("int"))  # rows that are alike stay as many
        held = held.withColumn("copies_", F.explode(again)).drop("copies_")
    block = [F.col("wsi_id"), F.expr(f"x div {BLOCK}"), F.expr(f"y div {BLOCK}")]
    dealt = held.repartition(*block).sortWithinPartitions("wsi_id", F.expr(f"x div {BLOCK}"), F.expr(f"y div {BLOCK}"), "y", "x")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Windows()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                images = [reader.read(r) for r in batch.select(["x", "y", "width", "height", "files"]).to_pylist()]
                if out:
                    for shape in {i.shape for i in images} - {(out, out, 3)}:  # those of one size together
                        same = [k for k, i in enumerate(images) if i.shape == shape]
                        for k, image in zip(same, resample(np.stack([images[k] for k in same]), out, out), strict=True):
                            images[k] = image
                cols = [batch.column(batch.schema.get_field_index(c)) for c in rest]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([i.tobytes() for i in images], pa.binary())], names=[*rest, "pixels"])
        reader.close()

    return dealt.mapInArrow(run, f"{kinds}, pixels binary")


def tissue_share(windows: DataFrame, threshold: float = 220) -> DataFrame:
    """Rows of read_windows() with tissue_share in place of their pixels: how many are not lighter than the threshold."""
    rest = [c for c in windows.columns if c != "pixels"]
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in windows.schema.fields if f.name != "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = (np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, 3) for v in batch.column(batch.schema.get_field_index("pixels")))
            share = [float((0.2989 * x[:, 0] + 0.5870 * x[:, 1] + 0.1140 * x[:, 2] <= threshold).mean()) for x in held]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(share, pa.float64())], names=[*rest, "tissue_share"])

    return windows.select(*rest, "pixels").mapInArrow(run, f"{kinds}tissue_share double")


class _Windows:
    """Reads windows, keeping files open and tiles in memory while they are near."""

    def __init__(self):
        self.files: dict[str, tuple] = {}

    def read(self, row: dict) -> np.ndarray:
        out = np.full((row["height"], row["width"], 3), 255, np.uint8)
        for f in row["files"]:
            if f["path"] not in self.files:
                if len(self.files) >= 8:
                    self.close()
                file = opened(f["path"])
                self.files[f["path"]] = (file, Pyramid.parse(file), {})
            file, p, seen = self.files[f["path"]]
            if sum(x.nbytes for x in seen.values()) > KEPT:
                seen.clear()
            v = p.levels[f["level"]]
            x, y = row["x"] - v.place(p.x), row["y"] - v.place(p.y)
            top, end = max(0, -y), min(row["height"], v.height - y)
            if top < end:
                out[top:end] = p.window(file, f["level"], x, y + top, row["width"], end - top, seen)
        return out

    def close(self) -> None:
        for file, *_ in self.files.values():
            file.close()
        self.files.clear()


# --- writing --------------------------------------------------------------------------------------------------------


def halved(image: np.ndarray) -> np.ndarray:
    """Means of two by two pixels, rounded down; a last odd row or column is left out."""
    h, w = image.shape[0] // 2 * 2, image.shape[1] // 2 * 2
    x = image[:h, :w].astype(np.uint16)
    return ((x[0::2, 0::2] + x[1::2, 0::2] + x[0::2, 1::2] + x[1::2, 1::2]) // 4).astype(np.uint8)


def encode(images: Sequence[np.ndarray], tile: int, mpp: float | None = None, x: int = 0, y: int = 0, deflate: bool = True, big: bool = True) -> bytes:
    """A file of levels, largest first."""
    word, entry = ("Q", "<HHQ") if big else ("I", "<HHI")
    room = struct.calcsize(word)
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
    link = len(out) - room  # where the next directory's place has to be filled in
    for image in images:
        h, w, _ = image.shape
        offsets, sizes = [], []
        for top in range(0, h, tile):
            for left in range(0, w, tile):
                part = np.full((tile, tile, 3), 255, np.uint8)
                piece = image[top : top + tile, left : left + tile]
                part[: piece.shape[0], : piece.shape[1]] = piece
                raw = zlib.compress(part.tobytes(), 6) if deflate else part.tobytes()
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw
        values = {256: (4, (w,)), 257: (4, (h,)), 258: (3, (8, 8, 8)), 259: (3, (DEFLATE if deflate else PLAIN,)), 262: (3, (2,)), 277: (3, (3,)), 284: (3, (1,)), 286: (5, (x, 1)), 287: (5, (y, 1)), 322: (4, (tile,)), 323: (4, (tile,)), 324: (16 if big else 4, offsets), 325: (4, sizes)}
        if mpp:
            values |= {282: (5, (round(10_000_000 / mpp), 1000)), 283: (5, (round(10_000_000 / mpp), 1000)), 296: (3, (PER_CENTIMETRE,))}
        packed = []
        for tag, (kind, v) in sorted(values.items()):
            raw = struct.pack("<" + (TYPES[kind][0] * len(v)), *v)
            if len(raw) > room:
                at = len(out)
                out += raw
                raw = struct.pack("<" + word, at)
            packed.append(struct.pack(entry, tag, kind, len(v) // len(TYPES[kind])) + raw.ljust(room, b"\0"))
        struct.pack_into("<" + word, out, link, len(out))
        out += struct.pack("<Q" if big else "<H", len(packed)) + b"".join(packed)
        link = len(out)
        out += struct.pack("<" + word, 0)
    return bytes(out)


def write_bands(spark: SparkSession, pixels: DataFrame, folder: str, levels: int, tile: int, mpp: float | None = None) -> DataFrame:
    """Write slides as files, one for each band, and give (wsi_id, band, path).

    pixels has (wsi_id, band, y, line): lines of RGB bytes, all of a band of one length, y the place in the
    slide; a band is what one task holds. Files replace those of the same name whole."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("y", "ascending")])
        wsi, band = rows.column("wsi_id")[0].as_py(), rows.column("band")[0].as_py()
        image = np.stack([np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, 3) for v in rows.column("line")])
        images = [image]
        while len(images) < levels:
            images.append(halved(images[-1]))
        path = f"{folder}/{wsi}-{band}.tif"
        system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        partial = f"{at}.{uuid.uuid4().hex}"  # another try of the task may write at the same time
        with system.open_output_stream(partial) as file:
            file.write(encode(images, tile, mpp, 0, rows.column("y")[0].as_py()))
        system.move(partial, at)
        return rows.slice(0, 1).select(["wsi_id", "band"]).append_column("path", pa.array([path]))

    kinds = [f"{k} {pixels.schema[k].dataType.simpleString()}" for k in ("wsi_id", "band")]
    return cut(spark, pixels.groupBy("wsi_id", "band").applyInArrow(run, f"{kinds[0]}, {kinds[1]}, path string"), "bands")
