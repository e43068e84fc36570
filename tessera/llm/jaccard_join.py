"""Documents whose word-shingle sets have a Jaccard similarity of 0.75 or more, as connected components; exact.

Words are runs of anything but space and U+0009 to U+000D, with A-Z lower-cased; five make a shingle, and fewer words
are one shingle as a whole. Sets are arrays of 64-bit hashes.

1. ``profile``: per document the size of its set, a fingerprint of it (copies share it, and are one node from here on)
   and a bitmap of hashed shingles, twice as many bits as shingles; besides, how frequent shingles are, in a table of
   fixed size. A set's text is found again by a hash of one of its rows' doc_id and text, so null ids do no harm.
2. ``keys``: the n - ceil(0.75 n) + 1 shingles of a set that come first when rare ones precede frequent ones. Linked
   sets have one of them in common.
3. ``members``: the sets of each key, in order of size, with the first of them as the key's centre.
4. Sets are tested against their keys' centres; what links is a component. Keys that hold several components are then
   tested against a few sets drawn for each key, and once more against others. A huge group of near copies falls
   together here, with as many pairs as rows.
5. Tiles: for each key that still holds several components, the sets of neighbouring size bands (sizes in a ratio under
   4:3), in blocks of at most ``BLOCK`` a side. In a tile, all pairs from different components whose bit counts allow a
   link are candidates, each tested by the first key that it shares. Sets with a candidate get their arrays and meet
   again in their tile, which tests them and gives one link for each two components that fall together: rows are sets
   of tiles, never pairs.

A test has two parts: bits that only one bitmap has are shingles that the other set lacks, which bounds the overlap
from above; what passes is decided by intersecting the sorted arrays. Pairs within a component are left out.

Null, empty and wordless texts have 0 shingles, link with nothing and are their own component. Very long texts are
taken whole, each in one worker. Rows are neither merged nor dropped, and repeated rows share a set. Rows of a null
doc_id link like others, but give a component no name: it is null where no other document is in it. Other columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.components import components, merged

WORDS = 5
TABLE_BITS = 21
CHUNK_BITS = 15
#: Keys whose table entry is this many times the mean (as a power of two) are dealt out over several groups.
HOT_LEVEL = 6
BLOCK = 512
#: Bytes of arrays in a block, about.
BLOCK_BYTES = 32 << 20
BAND = np.log(4 / 3)
#: Rounds of tests against drawn sets of a key, and how many are drawn for each key and round.
TURNS = 2
HUBS = 3
_SALT = np.uint64(0xA0761D6478BD642F)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    buf, off = common.utf8(batch.column("text"))
    return common.shingle_sets(common.LOWER[buf], off, WORDS)


def _row_key() -> Column:
    """Tells rows apart, but for repeated ones; whether a row has the set that is looked for is told by the set."""
    return F.xxhash64("doc_id", "text")


def _fingerprint(s: np.ndarray) -> int:
    return int(common.mix(np.array([common.mix(s ^ _SALT).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _width(n: int) -> int:
    return min(1 << 15, max(256, 1 << (2 * n - 1).bit_length()))


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(_width(len(s)), bool)
    bits[(s >> np.uint64(20)).astype(np.int64) & (len(bits) - 1)] = True
    return np.packbits(bits).tobytes()


def _folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of equal width: wide ones are folded onto the narrowest."""
    width = min(map(len, bitmaps))
    out = np.empty((len(bitmaps), width), np.uint8)
    for i, b in enumerate(bitmaps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def _possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether bit counts leave enough overlap for a link."""
    only_a = np.bitwise_count(a & ~b).sum(axis=-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=-1, dtype=np.int64)
    return 7 * np.minimum(na - only_a, nb - only_b) >= 3 * (na + nb)


# --- 1: profiles and frequencies --------------------------------------------------------------------------------


def profile(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(doc_id, row_key, n, set_id), (set_id, n, bits, first_key) and the levels of the frequency table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << TABLE_BITS, np.uint32)
        names = ["doc_id", "row_key", "n", "set_id", "bits", "chunk", "counts"]
        kind = None
        for batch in common.slices(batches):
            sets = _sets(batch)
            kind, none = batch.schema.field("doc_id").type, pa.nulls(len(sets))
            if len(flat := np.concatenate(sets)):
                counts += np.bincount(flat >> np.uint64(64 - TABLE_BITS), minlength=len(counts)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array([len(s) for s in sets], pa.int32()), pa.array([_fingerprint(s) for s in sets], pa.int64()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())],
                names=names,
            )
        if kind is not None:
            parts = counts.reshape(-1, 1 << CHUNK_BITS)
            none = pa.nulls(len(parts))
            yield pa.RecordBatch.from_arrays(
                [none.cast(kind), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())],
                names=names,
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[chunk] = held.get(chunk, np.int64(0)) + np.frombuffer(zlib.decompress(counts), np.uint32)
        if held:
            blobs = [zlib.compress(v.astype(np.int64).tobytes(), 1) for v in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = docs.select("doc_id", _row_key().alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key long, n int, set_id long, bits binary, chunk int, counts binary")
    both = common.cut(spark, both, "profile")
    profiles = both.filter("chunk IS NULL").select("doc_id", "row_key", "n", "set_id", "bits")
    chunks = both.filter("chunk IS NOT NULL").select("chunk", "counts").repartition(1 << (TABLE_BITS - CHUNK_BITS), "chunk")
    total = np.zeros((1 << (TABLE_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.int64)
    for row in chunks.mapInArrow(add, "chunk int, counts binary").collect():  # the table, of fixed size
        total[row.chunk] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    level = np.log2(np.maximum(total.ravel() / max(64.0, total.mean()), 1)).astype(np.uint8)
    sets = profiles.filter("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("row_key").alias("first_key"))
    return profiles.select("doc_id", "row_key", "n", "set_id"), common.cut(spark, sets, "sets"), level


# --- 2 and 3: keys, and the sets that share them ----------------------------------------------------------------


def members(spark: SparkSession, docs: DataFrame, level: np.ndarray) -> DataFrame:
    """(key, set_id, n, centre, hot) of the keys that several sets have; a key's parts have centres of their own."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task send their keys once
        for batch in common.slices(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for s in _sets(batch):
                n = len(s)
                if not n or (mark := _fingerprint(s)) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(mark)
                rank = level[s >> np.uint64(64 - TABLE_BITS)]
                first = np.argsort(rank, kind="stable")[: n - -(-3 * n // 4) + 1]
                hot = np.maximum(rank[first].astype(np.int64) - HOT_LEVEL, 0)
                for x, y in zip(out, (s[first].view(np.int64), np.where(hot > 0, 1 + (mark & ((1 << hot) - 1)), 0), np.full(len(first), n), np.full(len(first), mark)), strict=True):
                    x.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["key", "part", "n", "set_id"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, (0, 0)  # the key and part that the previous batch ended in, and its centre (n, set)
        for batch in batches:
            key, part, n, own = (c.to_numpy() for c in batch.columns)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            carried = last == (key[0], part[0])
            new[0] = not carried
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            c_set = np.where(at < 0, centre[1], own[at])
            c_n = np.where(at < 0, centre[0], n[at])
            other = own != c_set
            head = np.flatnonzero(other)  # each group's centre joins with its first other set
            head = head[np.concatenate([[True], (key[head[1:]] != key[head[:-1]]) | (part[head[1:]] != part[head[:-1]])])] if len(head) else head
            alone = np.flatnonzero(new & (part > 0))
            lines = np.concatenate([np.flatnonzero(other), head, alone])
            is_other = np.arange(len(lines)) < other.sum()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[lines]), pa.array(np.where(is_other, own[lines], c_set[lines])), pa.array(np.where(is_other, n[lines], c_n[lines]).astype(np.int32)), pa.array(c_set[lines]), pa.array(part[lines] > 0)],
                names=["key", "set_id", "n", "centre", "hot"],
            )
            last, centre = (key[-1], part[-1]), (int(c_n[-1]), int(c_set[-1]))

    keyed = docs.select("text").mapInArrow(keys, "key long, part int, n int, set_id long")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a key is as long as a word, and a quarter of them are sent
    keyed = keyed.repartition(common.tasks(spark, size), "key", "part").sortWithinPartitions("key", "part", "n", "set_id")
    return common.cut(spark, keyed.mapInArrow(groups, "key long, set_id long, n int, centre long, hot boolean"), "members")


# --- 4: tests and components ------------------------------------------------------------------------------------


def _arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, hashes) of the wanted sets (set_id, first_key), each from one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            sets = _sets(batch)
            marks = [_fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(marks), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "hashes"]
            ).filter(pa.array(np.array(marks) == batch.column("wanted").to_numpy()))

    chosen = docs.select(_row_key().alias("row_key"), "text").join(wanted.select(F.col("first_key").alias("row_key"), F.col("set_id").alias("wanted")), "row_key")
    found = chosen.select("text", "wanted").mapInArrow(run, "set_id long, hashes binary")
    return found.dropDuplicates(["set_id"])


def _linked(x: bytes | pa.Buffer, y: bytes | pa.Buffer) -> bool:
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    return 7 * len(np.intersect1d(u, v, assume_unique=True)) >= 3 * (len(u) + len(v))


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
        ok = []
        for x, y in zip(left, right, strict=True):
            ok.append(_linked(x, y))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], names=["a", "b", "linked"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
        ok = np.zeros(len(na), bool)
        for i in range(len(na)):
            pair = _folded([left[i], right[i]])
            ok[i] = _possible(pair[0], pair[1], int(na[i]), int(nb[i]))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))


class Linker:
    """Grows components by testing candidate pairs."""

    def __init__(self, spark: SparkSession, docs: DataFrame, sets: DataFrame):
        self.spark, self.docs, self.sets = spark, docs, sets
        self.tested = self.labels = None

    def label(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with the components ra, rb of their ends."""
        if self.labels is None:
            return pairs.withColumn("ra", F.col("a")).withColumn("rb", F.col("b"))
        for end in "ab":
            roots = self.labels.select(F.col("id").alias(end), F.col("root").alias(f"r{end}_"))
            pairs = pairs.join(roots, end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}_", end)).drop(f"r{end}_")
        return pairs

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and bitmaps allow a link."""
        for end, side in (("a", "left"), ("b", "right")):
            pairs = pairs.join(self.sets.select(F.col("set_id").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(side)), end)
            if end == "b":
                pairs = pairs.filter((4 * F.col("na") >= 3 * F.col("nb")) & (4 * F.col("nb") >= 3 * F.col("na")))
        return pairs.select("a", "b", "na", "nb", "left", "right").mapInArrow(_bounded, "a long, b long")

    def arrays(self, ids: DataFrame) -> DataFrame:
        """(set_id, hashes) of the sets (set_id)."""
        wanted = ids.distinct().join(self.sets.select("set_id", "first_key"), "set_id")
        return common.cut(self.spark, _arrays(self.docs, wanted), "arrays")

    def merge(self, links: DataFrame) -> None:
        """Components that the links (a, b) join become one; only their names are looked at, not what made them."""
        if links.isEmpty():
            return
        edges = self.label(links).select(*_ordered("ra", "rb")).filter("a <> b").distinct()
        moved = components(self.spark, edges)
        if self.labels is None:
            self.labels = moved
            return
        labels = common.cut(self.spark, merged(self.labels, moved), "labels")
        common.drop(self.spark, self.labels, moved)
        self.labels = labels

    def connect(self, pairs: DataFrame) -> None:
        """Test the pairs (a, b; bounded already) that weren't tested before, and label the components anew."""
        pairs = self.label(pairs.distinct()).filter("ra <> rb").select("a", "b")
        if self.tested is not None:
            pairs = pairs.join(self.tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = common.cut(self.spark, pairs, "candidates")
        if pairs.isEmpty():
            return
        arrays = self.arrays(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")))
        both = pairs.join(arrays.select(F.col("set_id").alias("b"), F.col("hashes").alias("right")), "b")
        both = both.join(arrays.select(F.col("set_id").alias("a"), F.col("hashes").alias("left")), "a").select("a", "b", "left", "right")
        fresh = common.cut(self.spark, both.mapInArrow(_intersect, "a long, b long, linked boolean"), "tested")
        common.drop(self.spark, arrays, pairs)
        self.tested = fresh if self.tested is None else self.tested.unionByName(fresh)
        self.merge(fresh.filter("linked"))

    def finish(self, owned: DataFrame) -> None:
        """Test all pairs of different components that share one of the owned keys."""
        hopeful = common.cut(self.spark, tiles(self.spark, owned, self.sets), "hopeful")
        if hopeful.isEmpty():
            return
        arrays = self.arrays(hopeful.select("set_id"))
        rows = _dealt(self.spark, hopeful.join(arrays, "set_id"))
        links = common.cut(self.spark, rows.mapInArrow(_tile, "a long, b long"), "links")
        common.drop(self.spark, arrays, hopeful)
        self.merge(links)

    def owned(self, held: DataFrame) -> DataFrame:
        """(key, set_id, n, root) of the keys that several components share; of keys with the same sets (those of one
        passage, say) one stands for all."""
        rows = held.select("key", "set_id", "n").distinct()
        if self.labels is None:
            rows = rows.withColumn("root", F.col("set_id"))
        else:
            rows = rows.join(self.labels.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        mark = F.xxhash64("set_id")
        mixed = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.bit_xor(mark).alias("mark"), F.count("*").alias("c")).filter("x <> y")
        mixed = mixed.groupBy("mark", "c").agg(F.min("key").alias("key")).select("key")
        return common.cut(self.spark, rows.join(mixed, "key"), "owned")


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def hubs(owned: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of sets and a few sets of their keys, other ones each turn: as many as rows, whatever a key's size."""
    drawn = [F.min(F.struct(F.xxhash64("set_id", F.lit(HUBS * turn + i)).alias("h"), F.col("set_id"), F.col("root"))) for i in range(HUBS)]
    chosen = owned.groupBy("key").agg(F.array_distinct(F.array(*drawn)).alias("hubs")).select("key", F.explode("hubs").alias("hub"))
    pairs = owned.join(chosen, "key").filter(F.col("root") != F.col("hub.root")).select("set_id", F.col("hub.set_id").alias("hub"))
    return pairs.select(*_ordered("set_id", "hub")).distinct()


# --- 5: tiles ---------------------------------------------------------------------------------------------------


def _tile_pairs(n: np.ndarray, root: np.ndarray, low: np.ndarray, side: np.ndarray, bits: list[bytes]) -> Iterator[tuple[int, int]]:
    """Pairs of different components of a tile that sizes and bit counts allow."""
    i, j = np.triu_indices(len(n), 1)
    ok = (root[i] != root[j]) & (low[i] | low[j]) & ((side[i] == 0) | (side[i] != side[j])) & (4 * n[i] >= 3 * n[j]) & (4 * n[j] >= 3 * n[i])
    i, j = i[ok], j[ok]
    if not len(i):
        return
    folded = _folded(bits)
    step = max(1, (1 << 19) // folded.shape[1])
    for k in range(0, len(i), step):
        a, b = i[k : k + step], j[k : k + step]
        keep = _possible(folded[a], folded[b], n[a], n[b])
        yield from zip(a[keep].tolist(), b[keep].tolist(), strict=True)


def _in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """The rows of whole tiles, which come one after the other, and where each tile of several components starts and ends."""

    def several(rows: pa.RecordBatch, starts: np.ndarray) -> list[tuple[int, int]]:
        root = rows.column("root").to_numpy()
        return [(a, b) for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True) if (root[a:b] != root[a]).any()]

    rest: pa.RecordBatch | None = None  # the last tile so far
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        key, band, tile = (batch.column(c).to_numpy() for c in ("key", "band", "tile"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (tile[1:] != tile[:-1])
        starts = np.flatnonzero(new)
        rest = batch.slice(starts[-1])
        if len(starts) > 1:
            yield (whole := pa.concat_batches([batch.slice(0, starts[-1])])), several(whole, starts[:-1])
    if rest is not None:
        yield (whole := pa.concat_batches([rest])), several(whole, np.zeros(1, np.int64))


def _candidates(rows: pa.RecordBatch, a: int, b: int, skip: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Pairs of rows of the tile from a to b that may link and whose least common key this is, but for those to skip."""
    n, root, low, side = (rows.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("n", "root", "low", "side"))
    ring = rows.column("keys")
    ends, keys, key = ring.offsets.to_numpy(), ring.values.to_numpy(), rows.column("key")[a].as_py()
    for i, j in _tile_pairs(n.astype(np.int64), root, low, side, rows.column("bits").slice(a, b - a).to_pylist()):
        x, y = a + i, a + j
        if not skip(x, y) and np.intersect1d(keys[ends[x] : ends[x + 1]], keys[ends[y] : ends[y + 1]], assume_unique=True)[0] == key:
            yield x, y


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of tiles that are in a candidate pair there."""
    for rows, whole in _in_tiles(batches):
        some = np.zeros(rows.num_rows, bool)
        for a, b in whole:
            for x, y in _candidates(rows, a, b, lambda x, y: some[x] and some[y]):
                some[[x, y]] = True
        yield rows.filter(pa.array(some))


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of different components from the rows of each tile: those that may link or, where rows have their
    hashes, those that do, as many as make one of what they join."""
    for rows, whole in _in_tiles(batches):
        own, root = rows.column("set_id").to_numpy(), rows.column("root").to_numpy()
        hashes = rows.column("hashes") if "hashes" in rows.schema.names else None
        out: list[tuple[int, int]] = []
        for a, b in whole:
            joined = root[a:b].copy() if hashes is not None else None  # the components as this tile's links join them
            for x, y in _candidates(rows, a, b, lambda x, y: joined is not None and joined[x - a] == joined[y - a]):
                if hashes is not None:
                    if not _linked(hashes[x].as_buffer(), hashes[y].as_buffer()):
                        continue
                    joined[joined == joined[y - a]] = joined[x - a]
                out.append((min(own[x], own[y]), max(own[x], own[y])))
        left, right = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _dealt(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return rows.repartition(common.tasks(spark), "key", "band", "tile").sortWithinPartitions("key", "band", "tile", "set_id")


def tiles(spark: SparkSession, owned: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of tiles of owned (key, set_id, n, root) that are in a candidate pair there."""
    band = F.floor(F.log("n") / F.lit(BAND)).cast("int")
    rings = owned.groupBy("set_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))  # a quarter of the set at most
    rows = owned.select("key", "set_id", "n", "root", band.alias("own"))
    rows = rows.select("*", F.explode(F.array("own", F.col("own") - 1)).alias("band")).withColumn("low", F.col("own") == F.col("band"))
    size = rows.groupBy("key", "band").agg(F.count("*").alias("c"), F.sum("n").alias("all"), F.count_if("low").alias("lows"), F.min("root").alias("x"), F.max("root").alias("y"))
    size = size.filter("c > 1 AND lows > 0 AND x <> y").select("key", "band", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(8 * F.col("all") / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = rows.join(size, ["key", "band"])
    # Beyond one block, a row goes to the tiles of its block with each block: side 0 is a block with itself.
    block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.least("block", "with") * F.col("blocks") + F.greatest("block", "with")
    side = F.when(F.col("block") == F.col("with"), 0).when(F.col("block") < F.col("with"), 1).otherwise(2)
    rows = rows.select("key", "band", tile.alias("tile"), "set_id", "n", "root", "low", side.cast("int").alias("side"))
    rows = rows.join(sets.select("set_id", "bits").join(rings, "set_id"), "set_id").select("key", "band", "tile", "set_id", "n", "root", "low", "side", "bits", "keys")
    return _dealt(spark, rows).mapInArrow(_hopeful, rows.schema)


def _grouped(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, row_key, n, and root, the set that names its component (null without words)."""
    profiles, sets, level = profile(spark, docs)
    held = members(spark, docs, level)
    linker = Linker(spark, docs, sets)
    stars = held.filter("set_id <> centre").select(*_ordered("set_id", "centre")).distinct()
    centres = held.filter("hot").select("key", F.col("centre").alias("set_id")).distinct()
    first = centres.groupBy("key").agg(F.min("set_id").alias("centre"))
    stars = stars.union(centres.join(first, "key").filter("set_id <> centre").select(*_ordered("set_id", "centre"))).distinct()
    linker.connect(linker.bounded(stars))

    for turn in range(TURNS):
        owned = linker.owned(held)
        linker.connect(linker.bounded(hubs(owned, turn)))
        common.drop(spark, owned)
    owned = linker.owned(held)
    linker.finish(owned)
    common.drop(spark, owned, held)

    named = profiles.withColumn("root", F.col("set_id"))
    if linker.labels is not None:
        labels = linker.labels.select(F.col("id").alias("set_id"), F.col("root").alias("linked"))
        named = profiles.join(labels, "set_id", "left").withColumn("root", F.coalesce("linked", "set_id"))
    return named.select("doc_id", "row_key", "n", F.when(F.col("n") > 0, F.col("root")).alias("root"))


def join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    named = _grouped(spark, docs).select("doc_id", "n", "root")
    least = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("m"))
    out = named.join(least, "root", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("m")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of docs for each component: one of its smallest doc_id, a null one only where there is no other. Rows without
    words link with nothing and all stay."""
    named = _grouped(spark, docs).filter("root IS NOT NULL")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("row_key"))).alias("b"))
    best = best.select(F.coalesce("b.row_key", F.lit(0)).alias("kept_key_")).distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.filter(worded).withColumn("kept_key_", _row_key()).join(best, "kept_key_", "left_semi").dropDuplicates(["kept_key_"])
    return docs.filter(~worded).unionByName(kept.drop("kept_key_"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END) AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
    JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = w.doc_id
"""
