"""Token ids of whole documents in a compressed random-access store.

Every document is encoded, gets an end id, and is compressed by itself with one zstandard dictionary that all
documents share. A store is a folder of three Parquet tables, so that writes go through Spark's commit protocol
(a lost executor or a repeated task leaves no half shard) and any store that Spark writes to will do:

* ``dictionary``: one row, the dictionary, its sha256, the width of a serialized id, the end id;
* ``shards``: the frames of consecutive documents, one after the other, in blobs of about ``SHARD_BYTES``;
* ``index``: per document the shard, the frame's offset and length, the ids before it and its own ids.

Nulls count as empty texts. Rows of equal doc_id stay, ordered by their text; null doc_ids come first. Very long texts are
encoded whole, each in one worker. doc_id has to be of a whole-number type. Other columns are ignored, and an empty table
makes an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm import common

END_ID = 1
#: The dictionary is fitted on the documents with the smallest key hashes, at most so many.
DICTIONARY_DOCUMENTS = 600
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 2 << 20
#: Encoded words that a Python worker keeps.
CACHE_WORDS = 500_000
LEVEL = 3

_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


#: Texts that tell whether a tokenizer lower-cases, keeps pre-tokens inside white space, and parts letters from marks.
PROBES = (
    "The QUICK brown fox, and the dog.", "  two  spaces\n\nand lines\t tab ", "it's 3.14 % of A.B. !? #x", "end. <|endoftext|> Start", "É ÉCOLE naïve 漢字 Ünïcode ß", "a\u00a0b \u200d c", "x.y z... w!",
)


class Encoder:
    """Ids of whole texts. Where the tokenizer lower-cases and its pre-tokens never hold white space, each distinct
    white-space-free chunk is encoded once by the library and its ids are gathered by numpy. PROBES are encoded both ways
    when a tokenizer is loaded; one that differs has all its texts encoded by the library."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.clear()
        self.by_chunks = True
        whole = pa.array(PROBES, pa.large_string())
        self.by_chunks = all(np.array_equal(a, b) for a, b in zip(self._by_chunks(whole, END_ID), self._whole(whole, END_ID), strict=True))

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # the tokenizer lower-cases, so chunks come lower-cased
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 12, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks in long strings, 500 to each; a token's offset says to which chunk it belongs."""
        at = len(self.known)
        groups = [chunks[i : i + 500] for i in range(0, len(chunks), 500)]
        ids, counts = [], []
        for group, got in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            starts = np.cumsum([0, *(len(c) + 1 for c in group[:-1])])
            where = np.fromiter((o[0] for o in got.offsets), np.int64)
            counts.append(np.bincount(np.searchsorted(starts, where, "right") - 1, minlength=len(group)))
            ids.append(np.array(got.ids, np.uint32))
        flat = np.concatenate(ids)
        ends = self.bounds[at] + np.cumsum(np.concatenate(counts))
        while len(self.bounds) < at + len(chunks) + 1:
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        while len(self.ids) < ends[-1]:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.bounds[at] : ends[-1]] = flat
        self.bounds[at + 1 : at + 1 + len(chunks)] = ends
        self.known.update(zip(chunks, range(at, at + len(chunks)), strict=True))

    def encode(self, text: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after the other, and the bounds of the rows."""
        return self._by_chunks(text, end_id) if self.by_chunks else self._whole(text, end_id)

    def _whole(self, text: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        more = [] if end_id is None else [end_id]
        ids = [[*e.ids, *more] for e in self.tokenizer.encode_batch(text.to_pylist(), add_special_tokens=False)]
        bounds = np.cumsum([0, *map(len, ids)])
        return np.array([i for row in ids for i in row], np.uint32), bounds

    def _by_chunks(self, text: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        special = pc.match_substring(text, "<|")  # special strings count as they stand
        text = pc.if_else(special, text, pc.ascii_lower(text))
        # Letters and the marks that close a word are pre-tokens of their own: apart, fewer chunks differ.
        text = pc.replace_substring_regex(text, r"([A-Za-z])([.,!%#*&$|]+)([ \n]|$)", r"\1 \2\3")
        chunks = pc.ascii_split_whitespace(text)
        coded = chunks.flatten().dictionary_encode()
        counts = pc.list_value_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self.clear()
        fresh = [c for c in distinct if c not in self.known]
        if fresh:
            self._learn(fresh)
        known = self.known
        where = np.fromiter((known[c] for c in distinct), np.int64, len(distinct))
        word = where[coded.indices.to_numpy(zero_copy_only=False)] if len(distinct) else np.zeros(0, np.int64)
        # an end id per row is one more word of one id
        row_end = np.cumsum(counts)
        lengths = self.bounds[word + 1] - self.bounds[word]
        source = self.bounds[word]
        if end_id is not None:
            lengths = np.insert(lengths, row_end, 1)
            source = np.insert(source, row_end, -1)
            row_end = row_end + np.arange(1, len(row_end) + 1)
        to = np.concatenate([[0], np.cumsum(lengths)])
        step = np.ones(to[-1], np.int64)
        full = lengths > 0
        at, src = to[:-1][full], source[full]
        if len(at):
            step[at[0]] = src[0]
            step[at[1:]] = src[1:] - (src[:-1] + lengths[full][:-1] - 1)
        pick = np.cumsum(step)
        ids = self.ids[np.maximum(pick, 0)]
        if end_id is not None:
            ids[pick < 0] = end_id
        return ids, np.concatenate([[0], to[row_end]])


def _width(tokenizer_path: str) -> int:
    return 2 if _tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else 4


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; with too few samples to train on, their bytes themselves; b'' without any."""
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _zdict(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode docs (doc_id, text; other columns are ignored) with the tokenizer file and write the store to path."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be of a whole-number type")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chosen = docs.orderBy(F.xxhash64(F.col("doc_id")), "doc_id", F.xxhash64("text")).limit(DICTIONARY_DOCUMENTS)
    width = _width(tokenizer)
    encoder = Encoder(tokenizer)
    samples = []
    for row in chosen.toLocalIterator():
        ids, _ = encoder.encode(pa.array([row.text or ""], pa.large_string()))
        samples.append(ids.astype(f"<u{width}").tobytes())
    raw = train_dictionary(samples)
    digest = hashlib.sha256(raw).hexdigest()
    head = spark.createDataFrame([(digest, bytearray(raw), width, END_ID)], "dict_hash string, dictionary binary, width int, end_id int")
    head.coalesce(1).write.parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(tokenizer)
        zdict = _zdict(raw)
        if zdict is not None:
            zdict.precompute_compress(level=LEVEL)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zdict, write_content_size=True)
        blobs, doc_ids, sizes, n_ids, firsts, part, seq, first, held = [], [], [], [], [], None, 0, 0, 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([digest]), pa.array([firsts], pa.list_(pa.int64())),
                    pa.array([doc_ids], pa.list_(pa.int64())), pa.array([n_ids], pa.list_(pa.int32())),
                    pa.array([np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(blobs)], pa.binary()),
                ],
                names=["part", "seq", "dict_hash", "firsts", "doc_ids", "n_ids", "offsets", "lengths", "payload"],
            )

        for batch in common.slices(batches, limit=2 << 20):
            ids, bounds = coder.encode(batch.column("text"))
            ids = ids.astype(f"<u{width}")
            part = batch.column("part")[0].as_py()
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                blob = squeeze.compress(ids[bounds[i] : bounds[i + 1]].tobytes())
                blobs.append(blob)
                doc_ids.append(doc)
                sizes.append(len(blob))
                n_ids.append(int(bounds[i + 1] - bounds[i]))
                firsts.append(first)
                first += n_ids[-1]
                held += len(blob)
                if held >= SHARD_BYTES:
                    yield shard()
                    blobs, doc_ids, sizes, n_ids, firsts, seq, held = [], [], [], [], [], seq + 1, 0
        if blobs:
            yield shard()

    ranged = (
        docs.repartitionByRange(common.tasks(spark, total), F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )
    ranged.mapInArrow(
        pack, "part int, seq int, dict_hash string, firsts array<long>, doc_ids array<long>, n_ids array<int>, offsets array<long>, lengths array<int>, payload binary"
    ).write.option("compression", "none").parquet(f"{path}/shards")

    shards = spark.read.parquet(f"{path}/shards")
    sums = shards.groupBy("part").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    base, total = [], 0  # one entry for each of the range partitions
    for part, n in sorted(map(tuple, sums)):
        base.append((part, total))
        total += n
    bases = spark.createDataFrame(base or [(0, 0)], "part int, base long")
    (
        shards.join(F.broadcast(bases), "part")
        .select("part", "seq", "dict_hash", "base", F.posexplode(F.arrays_zip("doc_ids", "firsts", "n_ids", "offsets", "lengths")).alias("slot", "of"))
        .select(
            F.col("of.doc_ids").alias("doc_id"), (F.col("base") + F.col("of.firsts")).alias("start"), F.col("of.n_ids").cast("long").alias("n_tokens"),
            "part", "seq", "slot", F.col("of.offsets").alias("offset"), F.col("of.lengths").alias("length"), "dict_hash",
        )
        .write.parquet(f"{path}/index")
    )


def _dictionary(spark: SparkSession, path: str):
    head = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(head.dictionary)
    if hashlib.sha256(raw).hexdigest() != head.dict_hash:
        raise ValueError(f"the dictionary of {path} is damaged")
    return raw, head.dict_hash, head.width


def _unpack(raw: bytes):
    return zstandard.ZstdDecompressor(dict_data=_zdict(raw))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the store, from its frames: doc_id, start, n_tokens, ids_crc32."""
    raw, digest, width = _dictionary(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = _unpack(raw)
        for batch in batches:
            out = []
            for shard in batch.to_pylist():
                if shard["dict_hash"] != digest:
                    raise ValueError("a shard was written with another dictionary")
                payload = memoryview(shard["payload"])
                for slot, (at, size) in enumerate(zip(shard["offsets"], shard["lengths"], strict=True)):
                    ids = np.frombuffer(open_.decompress(payload[at : at + size]), f"<u{width}").astype("<u4")
                    out.append((shard["part"], shard["seq"], slot, len(ids), zlib.crc32(ids.tobytes())))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                names=["part", "seq", "slot", "read_tokens", "ids_crc32"],
            )

    got = spark.read.parquet(f"{path}/shards").select("part", "seq", "dict_hash", "offsets", "lengths", "payload")
    got = got.mapInArrow(decode, "part int, seq int, slot int, read_tokens long, ids_crc32 long")
    index = spark.read.parquet(f"{path}/index").select("doc_id", "start", "part", "seq", "slot")
    return index.join(got, ["part", "seq", "slot"]).select("doc_id", "start", F.col("read_tokens").alias("n_tokens"), "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of that id, reading the index, then one shard each and decompressing one frame."""
    raw, digest, width = _dictionary(spark, path)
    out = []
    for row in spark.read.parquet(f"{path}/index").filter(F.col("doc_id") == doc_id).orderBy("start").collect():
        shard = spark.read.parquet(f"{path}/shards").filter((F.col("part") == row.part) & (F.col("seq") == row.seq))
        frame = shard.select(F.substring("payload", row.offset + 1, row.length)).first()[0]
        if row.dict_hash != digest:
            raise ValueError("the document was written with another dictionary")
        out.append(np.frombuffer(_unpack(raw).decompress(bytes(frame)), f"<u{width}").tolist())
    return out
