"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Texts are lower-cased and cut at every ASCII character that is no letter or digit; five words make a shingle. A
document holds an item if at least ``CONTAINMENT`` of the item's distinct shingles are in it.

An item of n shingles is sketched by its n - ceil(0.75 n) + 1 smallest shingle hashes: a document with 75% of the item
must have one of them, so the search loses nothing. Items fall in partitions by the power of two of their size; each
partition has the document size below which none of its items can be held. One pass over the documents looks their
shingles up in two bitmaps of fixed size (sketches; all item shingles), so only documents with a sketch hash leave it,
with those of their hashes that may be an item's; a join on the hash finds candidates, and the intersection of the two
hash arrays decides.

Null or wordless texts hold nothing and are held by nothing; a text of fewer than five words has one shingle, its
whole sequence. Rows of equal doc_id, or of equal item_id, are judged apart and reported once, with the largest
containment, and of equal ones that of the larger item. Very long texts are searched whole. Other columns are ignored,
and empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

WORDS = 5
CONTAINMENT = (3, 4)
FILTER_BITS = 24

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _sets(text: pa.Array) -> list[np.ndarray]:
    buf, off = common.utf8(pc.utf8_lower(text))
    return common.shingle_sets(np.where(_BREAK[buf], np.uint8(32), buf), off, WORDS)


def _needed(n: int) -> int:
    return -(-n * CONTAINMENT[0] // CONTAINMENT[1])


def item_sets(items: DataFrame) -> DataFrame:
    """Per item with words: item_id, n, needed, hashes (all, ascending as unsigned), sketch (the first n - needed + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = _sets(batch.column("text"))
            n = np.array([len(s) for s in sets])
            needed = [_needed(int(x)) for x in n]
            signed = [s.view(np.int64) for s in sets]
            sketch = [s[: len(s) - k + 1] if len(s) else s for s, k in zip(signed, needed, strict=True)]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(n, pa.int32()), pa.array(needed, pa.int32()), pa.array(signed, kind), pa.array(sketch, kind)],
                names=["item_id", "n", "needed", "hashes", "sketch"],
            ).filter(pa.array(n > 0))

    kind = items.schema["item_id"].dataType.simpleString()
    out = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, n int, needed int, hashes array<long>, sketch array<long>")
    return out.withColumn("size_class", F.floor(F.log2("n")).cast("int"))


def _bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """One bit for the top bits of each hash; built by a bitwise-or aggregate, so its size is fixed."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = hashes.select(F.explode(column).alias("h")).select(slot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(s & 31))")).alias("b"))
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return out


def search(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document and item that it holds: doc_id, item_id, n_item, n_shared, containment."""
    sets = common.cut(spark, item_sets(items), "items")
    in_sketch, in_items = _bitmap(sets, "sketch"), _bitmap(sets, "hashes")
    smallest = sets.agg(F.min("needed")).first()[0] or 1

    def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        slot = h >> np.uint64(64 - FILTER_BITS)
        return (bits[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1 == 1

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            buf, off = common.utf8(pc.utf8_lower(batch.column("text")))
            h, row = common.shingles(np.where(_BREAK[buf], np.uint8(32), buf), off, WORDS)
            any_item = has(in_items, h)
            h, row = h[any_item], row[any_item]
            first = np.zeros(len(off) - 1, bool)
            first[row[has(in_sketch, h)]] = True
            rows, hits, sketched = np.flatnonzero(first), [], []
            at = np.searchsorted(row, np.arange(len(off)))
            for r in rows:
                own = np.unique(h[at[r] : at[r + 1]])
                hits.append(own.view(np.int64))
                sketched.append(own[has(in_sketch, own)].view(np.int64))
            enough = np.array([len(x) >= smallest for x in hits], bool)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array(hits, kind), pa.array(sketched, kind)], names=["doc_id", "found", "sketched"]
            ).filter(pa.array(enough, pa.bool_()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(look_up, f"doc_id {kind}, found array<long>, sketched array<long>")
    found = common.cut(spark, found, "decontamination")
    # Each size class has the least number of hashes that a document must share with any of its items.
    sketch = sets.select("item_id", "size_class", F.explode("sketch").alias("hash"))
    least = sets.groupBy("size_class").agg(F.min("needed").alias("least"))
    sketch = sketch.join(F.broadcast(least), "size_class")  # one row for each power of two
    # A hash that many documents share is a hot key: only ids and counts meet there, the arrays are joined to what is left.
    found = found.withColumn("row", F.xxhash64("doc_id", "found"))
    probes = found.select("row", F.size("found").alias("n_found"), F.explode("sketched").alias("hash"))
    pairs = probes.join(sketch, "hash").filter(F.col("n_found") >= F.col("least")).select("row", "item_id").distinct()
    checked = pairs.join(found.select("row", "doc_id", "found"), "row").join(sets.select("item_id", "n", "needed", "hashes"), "item_id")
    checked = checked.withColumn("n_shared", F.size(F.array_intersect("found", "hashes"))).filter("n_shared >= needed")
    best = F.max_by(F.struct(F.col("n"), F.col("n_shared")), F.struct(F.col("n_shared") / F.col("n"), F.col("n")))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", F.col("b.n").cast("long").alias("n_item"), F.col("b.n_shared").cast("long").alias("n_shared"), (F.col("b.n_shared") / F.col("b.n")).alias("containment")
    )


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id holds no item."""
    bad = search(spark, docs, items).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


ORACLE = r"""
WITH norm AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT k, id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM norm),
s AS (SELECT DISTINCT k, id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
    FROM (SELECT k, id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM s WHERE k = 'i')
SELECT d.id AS doc_id, n.id AS item_id, n.n AS n_item, count(*) AS n_shared, count(*) / CAST(n.n AS DOUBLE) AS containment
FROM s d JOIN n ON d.s = n.s WHERE d.k = 'd' GROUP BY d.id, n.id, n.n HAVING 4 * count(*) >= 3 * n.n
"""
