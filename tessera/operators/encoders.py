"""Vectors of patches: a registry of encoders, loaded once for each worker, and their run over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.sequences import CHANNELS

#: Patches of a batch.
BATCH = 64
#: Cells along a patch's edge whose means the fitted encoder sees; as many as there are pixels in smaller patches.
CELLS = 8

Forward = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Encoder:
    """channels: whose means and deviations the pixels are normalised with. load: makes the function from normalised
    patches (n, size, size, 3) to (n, dim); it is called once in each worker, with what fit gave, if anything."""

    dim: int
    channels: str
    load: Callable[[object], Forward]


def _colours(_: object) -> Forward:
    return lambda x: np.concatenate([x.mean((1, 2)), x.std((1, 2))], 1)


def cells(x: np.ndarray) -> np.ndarray:
    """Means of the cells of patches, as rows; cells differ by a pixel where the size is no multiple."""
    edges = np.linspace(0, x.shape[1], min(CELLS, x.shape[1]) + 1).astype(int)
    n = np.diff(edges)
    sums = np.add.reduceat(np.add.reduceat(x, edges[:-1], 1), edges[:-1], 2)
    return (sums / (n[:, None] * n)[:, :, None]).reshape(len(x), -1)


def _projection(fitted: object) -> Forward:
    if fitted is None:
        raise ValueError("this encoder has to be fitted first")
    mean, axes = fitted
    return lambda x: (cells(x) - mean) @ axes.T


ENCODERS: dict[str, Encoder] = {
    "colours": Encoder(6, "photographs", _colours),
    "colours_tissue": Encoder(6, "tissue", _colours),
    "components16": Encoder(16, "photographs", _projection),
    "components32": Encoder(32, "tissue", _projection),
}
_loaded: dict[tuple, Forward] = {}


def _of(name: str) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name!r}: {', '.join(sorted(ENCODERS))}")
    return ENCODERS[name]


def normalised(pixels: np.ndarray, channels: str) -> np.ndarray:
    mean, deviation = CHANNELS[channels]
    return (pixels.astype(np.float32) / 255 - np.float32(mean)) / np.float32(deviation)


def check(name: str, size: int, fitted: object = None) -> int:
    """The dimension of an encoder's vectors; an error, before anything is run, if a patch of that size does not give it."""
    encoder = _of(name)
    got = encoder.load(fitted)(normalised(np.zeros((1, size, size, 3), np.uint8), encoder.channels)).shape
    if got != (1, encoder.dim):
        raise ValueError(f"encoder {name} gives {got[1:]} for a patch, not {encoder.dim}")
    return encoder.dim


def _patches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            held = batch.column(batch.schema.get_field_index("pixels"))
            yield batch, np.stack([np.frombuffer(v.as_buffer(), np.uint8).reshape(size, size, 3) for v in held])


def encode(patches: DataFrame, name: str, size: int, fitted: object = None) -> DataFrame:
    """patches (..., pixels: RGB bytes of size times size) with the embedding of each in place of its pixels."""
    check(name, size, fitted)
    sent = patches.sparkSession.sparkContext.broadcast(fitted)  # as large as the encoder
    rest = [c for c in patches.columns if c != "pixels"]
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in patches.schema.fields if f.name != "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (name, sent.id if hasattr(sent, "id") else id(sent))
        for batch, x in _patches(batches, size):
            if key not in _loaded:
                _loaded.clear()
                _loaded[key] = ENCODERS[name].load(sent.value)
            out = _loaded[key](normalised(x, ENCODERS[name].channels)).astype(np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), vectors], names=[*rest, "embedding"])

    return patches.select(*rest, "pixels").mapInArrow(run, f"{kinds}embedding array<float>")


def fit(patches: DataFrame, name: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes) of the encoder that projects the means of a patch's cells on their main axes.

    Each task sums products over its patches; these are summed in eight tasks, so that eight matrices of the cells come to
    the driver. An axis points to where its largest part is positive."""
    encoder, wide = _of(name), min(CELLS, size) ** 2 * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, np.zeros(wide), np.zeros((wide, wide))
        for _, x in _patches(batches, size):
            y = cells(normalised(x, encoder.channels)).astype(np.float64)
            n, total, products = n + len(y), total + y.sum(0), products + y.T @ y
        yield pa.RecordBatch.from_pydict({"n": [n], "sums": pa.array([np.concatenate([total, products.ravel()]).tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(r["n"], np.frombuffer(r["sums"])) for b in batches for r in b.to_pylist()]
        if held:
            yield pa.RecordBatch.from_pydict({"n": [sum(k for k, _ in held)], "sums": pa.array([sum(s for _, s in held).tobytes()], pa.binary())})

    parts = patches.select("pixels").mapInArrow(run, "n long, sums binary").repartition(8).mapInArrow(add, "n long, sums binary").collect()  # 8 rows
    n, sums = sum(r.n for r in parts), sum((np.frombuffer(r.sums) for r in parts), np.zeros(wide + wide * wide))
    if not n:
        raise ValueError("no patches to fit an encoder on")
    mean = sums[:wide] / n
    spread = sums[wide:].reshape(wide, wide) / n - np.outer(mean, mean)
    _, axes = np.linalg.eigh(spread)
    axes = axes.T[::-1][: encoder.dim]
    return mean, axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]


def save(spark: SparkSession, fitted: tuple[np.ndarray, np.ndarray], path: str) -> None:
    mean, axes = fitted
    spark.createDataFrame([(len(axes), mean.tobytes(), axes.tobytes())], "dim int, mean binary, axes binary").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    r = spark.read.parquet(path).first()
    return np.frombuffer(r["mean"]), np.frombuffer(r["axes"]).reshape(r["dim"], -1)
