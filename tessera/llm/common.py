"""Small helpers shared by the operators: shared folders, lineage cuts, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text that a Python worker holds arrays of at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Input for each task of a shuffle, at most.
TASK_BYTES = 64 << 20
#: The separators of words: space and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (local runs)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and lost executors lose nothing."""
    path = new_path(spark, name)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Within, Spark deletes a query's shuffle files as soon as the query is done."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what cut() wrote for frames that nothing reads any more."""
    for df in frames:
        delete(spark, df._tessera_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tasks(spark: SparkSession, size: int = 0) -> int:
    """How many tasks to deal that many bytes to: the session's shuffle partitions, or more where they would be large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


# --- text columns as byte buffers -------------------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, as_given: str | None = None) -> Iterator[pa.RecordBatch]:
    """Batches re-cut so that the named text column has at most limit bytes, one row at least; nulls become ''.

    as_given names a further column with the text as it came, nulls included; it shares the buffers of the batch."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        given = batch.column(i)
        text = pc.fill_null(given, "").cast(pa.large_string())
        batch = batch.set_column(i, column, text)
        if as_given:
            batch = batch.append_column(as_given, given)
        if not batch.num_rows:
            continue
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def give_back() -> None:
    """Return memory that the worker's allocators hold unused: idle workers stay, beside those of other stages and the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array without nulls, and the offsets of its rows."""
    n = len(text)
    off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
    data = text.buffers()[2]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which each bit depends on all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 16)
        for k, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums S with (S[e] - S[s]) * base**-s a hash of buf[s:e]."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * powers(len(buf))[0], out=out[1:])
    return out


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of non-separators; words never cross rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.ones(len(buf) + 2, bool)
    edge[1:-1] = SPACE[buf]
    solid = ~edge[1:-1]
    first = np.zeros(len(buf) + 1, bool)
    first[off[(off < len(buf))]] = True
    first = first[:-1]
    start = np.flatnonzero(solid & (edge[:-2] | first))
    last = np.zeros(len(buf), bool)
    last[off[off > 0] - 1] = True
    end = np.flatnonzero(solid & (edge[2:] | last)) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    s = prefix_hash(buf)
    return mix((s[end] - s[start]) * powers(len(buf) + 1)[1][start])


_STEP = [pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)]


def shingles(buf: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their rows, in text order; a row of fewer words has one: its whole sequence."""
    start, end, row = words(buf, off)
    h = word_hashes(buf, start, end)
    n = len(h)
    out, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        whole = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
        acc = np.zeros(len(whole), np.uint64)
        for j in range(k):
            acc += h[whole + j] * np.uint64(_STEP[j])
        out, rows = mix(acc), row[whole]
    count = np.bincount(row, minlength=len(off) - 1)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = np.searchsorted(row, short)
        extra = []
        for r, a in zip(short, at, strict=True):
            m = int(count[r])
            extra.append((sum(int(h[a + j]) * _STEP[j] for j in range(m)) + m * _BASE) % (1 << 64))
        out = np.concatenate([out, mix(np.array(extra, np.uint64))])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per row, the sorted distinct shingle hashes."""
    h, rows = shingles(buf, off, k)
    at = np.searchsorted(rows, np.arange(len(off)))
    return [np.unique(h[at[i] : at[i + 1]]) for i in range(len(off) - 1)]
