"""Large JSON files with one long list of objects, read by many tasks.

A file is dealt out in stretches of bytes. What a stretch means depends on what comes before it: whether it begins inside
of a text, and how deep. So each stretch first says what it changes in either case, sums over a file's stretches tell where
each begins, and then each gives the objects of the list that begin in it, reading on to the end of its last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.raster import opened

#: Bytes of a stretch.
STRETCH = 8 << 20
_QUOTE, _ESCAPE = 34, 92
_CHANGE = np.zeros(256, np.int8)
_CHANGE[[ord("{"), ord("[")]] = 1
_CHANGE[[ord("}"), ord("]")]] = -1


def _bytes(file, start: int, end: int) -> np.ndarray:
    file.seek(start)
    return np.frombuffer(file.read(end - start), np.uint8)


def _quotes(b: np.ndarray, escaped: bool) -> np.ndarray:
    """Where texts begin or end: quotes behind an even number of backslashes; escaped tells that one stands open before b."""
    out = b == _QUOTE
    if escaped and len(b):
        out[0] = False
    slash = np.flatnonzero(b == _ESCAPE)
    if len(slash):
        first = np.flatnonzero(np.append(True, np.diff(slash) > 1))
        run = np.diff(np.append(first, len(slash)))
        begin = slash[first]
        end = begin + run
        odd = (run - ((begin == 0) & escaped)) % 2 == 1  # the first one of b may be escaped itself
        end = end[odd & (end < len(b))]
        out[end] = False
    return out


def _open_escape(file, start: int) -> bool:
    """Whether an odd number of backslashes stands right before a place."""
    n = 0
    while start - n > 0:
        back = _bytes(file, max(0, start - n - 256), start - n)
        tail = np.flatnonzero(back[::-1] != _ESCAPE)
        n += int(tail[0]) if len(tail) else len(back)
        if len(tail):
            break
    return n % 2 == 1


def _depth(b: np.ndarray, quotes: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """What each byte changes in depth, and the changes summed up to it, it included."""
    text = (np.cumsum(quotes, dtype=np.int32) + within) % 2 == 1
    change = np.where(text, np.int8(0), _CHANGE[b])
    return change, np.cumsum(change, dtype=np.int32)


def stretches(spark: SparkSession, path: str, size: int = STRETCH) -> DataFrame:
    """(file, start, end) of the files under path; their contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start")
    return files.select("file", "length", start).select("file", "start", F.least(F.col("start") + size, F.col("length")).alias("end"))


def _begun(parts: DataFrame) -> DataFrame:
    """Adds to stretches whether they begin inside of a text, how deep, what the list's depth was opened with (the last
    bracket of the second depth) and how many objects were begun before."""

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["file"]) as file:
                    b = _bytes(file, r["start"], r["end"])
                    quotes = _quotes(b, _open_escape(file, r["start"]))
                sums = [int(s[-1]) if len(s) else 0 for s in (_depth(b, quotes, w)[1] for w in (False, True))]
                yield pa.RecordBatch.from_pylist([r | {"odd": int(quotes.sum() % 2), "outside": sums[0], "inside": sums[1]}], schema=pa.schema([*batch.schema, *((k, pa.int64()) for k in ("odd", "outside", "inside"))]))

    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch of a file
    known = parts.mapInArrow(changes, "file string, start long, end long, odd long, outside long, inside long")
    known = known.withColumn("within", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    known = known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))

    def openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["file"]) as file:
                    b, begun, bracket = _objects(file, r)
                early = begun[begun < bracket[0]] if len(bracket) else begun
                listed = [k for k in begun.tolist() if len(bracket) and k > bracket[0] and b[bracket[np.searchsorted(bracket, k) - 1]] == ord("[")]
                yield pa.RecordBatch.from_pylist(
                    [r | {"early": len(early), "late": len(listed), "bracket": chr(b[bracket[-1]]) if len(bracket) else None}], schema=pa.schema([*batch.schema, ("early", pa.int64()), ("late", pa.int64()), ("bracket", pa.string())])
                )

    kinds = "file string, start long, end long, within boolean, depth long"
    known = known.select("file", "start", "end", "within", "depth").mapInArrow(openings, f"{kinds}, early long, late long, bracket string")
    known = known.withColumn("under", F.coalesce(F.last("bracket", ignorenulls=True).over(before), F.lit("")))
    return known.withColumn("n", F.col("late") + F.when(F.col("under") == "[", F.col("early")).otherwise(0)).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _objects(file, r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a stretch, where objects begin at the third depth, and where brackets open the second one."""
    b = _bytes(file, r["start"], r["end"])
    change, depth = _depth(b, _quotes(b, _open_escape(file, r["start"])), r["within"])
    depth = depth + r["depth"]
    return b, np.flatnonzero((change == 1) & (depth == 3) & (b == ord("{"))), np.flatnonzero((change == 1) & (depth == 2))


def list_items(spark: SparkSession, path: str, size: int = STRETCH) -> DataFrame:
    """(file, item, json) of the objects in lists right inside of the outer object of each file, item from 0 in their order.

    A file that breaks off gives the objects before the break, and the broken one as it is."""

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["file"]) as file:
                    b, begun, bracket = _objects(file, r)
                    under = [r["under"], *(chr(b[k]) for k in bracket)]
                    begun = [k for k in begun.tolist() if under[int(np.searchsorted(bracket, k))] == "["]
                    for at in range(0, len(begun), 256):
                        texts = [_whole(file, r["start"] + k, b[k:]) for k in begun[at : at + 256]]
                        yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(texts)), pa.array(np.arange(len(texts)) + r["first"] + at), pa.array(texts, pa.string())], names=["file", "item", "json"])

    known = _begun(stretches(spark, path, size)).select("file", "start", "end", "within", "depth", "under", "first")
    dealt = known.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "file", "start")
    return dealt.mapInArrow(objects, "file string, item long, json string")


def _whole(file, start: int, held: np.ndarray) -> str:
    """The object that begins at start; held has the bytes from there to the end of its stretch."""
    size = 1 << 12
    while True:
        more = held[:size] if size <= len(held) else np.concatenate([held, _bytes(file, start + len(held), start + size)])
        ends = np.flatnonzero(_depth(more, _quotes(more, False), False)[1] == 0)
        if len(ends) or len(more) < size:
            return more[: int(ends[0]) + 1 if len(ends) else len(more)].tobytes().decode("utf-8", "replace")
        size *= 4
