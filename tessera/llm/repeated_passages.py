"""Removal of passages that an earlier document has, by blockwise suffix sorting with a difference cover; exact.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document of smaller doc_id. A suffix is
what starts at a byte; suffixes matter if their first LENGTH bytes do not end beyond their document.

1. A suffix's bucket comes from the least hash among the ``SAMPLE``-byte strings in its first LENGTH bytes. Equal
   strings of LENGTH bytes so share a bucket, and neighbouring suffixes mostly do: a run of them travels as one piece of
   text, which takes about six bytes a suffix instead of fifty. A first pass over these hashes alone finds those that
   several documents have; suffixes with any other hash are unique and are not sorted. Hashes only choose where and
   whether suffixes are compared; whether they are equal is always told by their bytes.
2. A task sorts one bucket at a time. The difference cover modulo ``PERIOD`` has, for any two places, an offset at which
   both are in the cover. The cover's sample of the bucket is ranked first; then suffixes are sorted by their first
   ``DEPTH`` bytes, and ties by the ranks at the offset that their pair has in common, by ternary partition of all ties
   at once. Neighbours in order that agree in LENGTH bytes (LCP >= LENGTH) are one string; all but the smallest document
   that has it lose it. A bucket of more than ``BLOCK`` suffixes is sorted block by block, and between blocks each
   string is kept once, so memory is bounded by the different strings of a bucket.
3. Runs of lost suffixes go back to their documents, where covered bytes are cut out.

Pieces of text that are equal as a whole (most of those of copies are) are told before any suffix is sorted, in a slice
and again in a bucket: all but the smallest document lose them. Before suffixes are shuffled, a task settles ties among
its own documents and sends each string for the smallest of them alone: a passage that a third of all documents share
comes to a bucket once for each slice of input, besides the pieces at its edges, which differ.

Null texts are empty; so are texts of fewer than LENGTH bytes for the search, and nothing of them goes. Rows of a null
doc_id are left as they are and remove nothing; rows of equal doc_id are judged apart and never against each other, so
ties between them remove nothing. A text longer than a slice is a slice of its own; no text is cut. doc_id has to be of
a whole-number type. Other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm import common

LENGTH = 50
SAMPLE = 30
#: Bytes of text for each bucket of suffixes, and hashes for each bucket of the first pass.
BUCKET = 2_000_000
#: Suffixes that are sorted at a time.
BLOCK = 600_000
SLICE = 4 << 20
#: What a task gathers of its slices before it is dealt: hashes, and bytes of pieces or runs of lost suffixes. A row is made for
#: each bucket then, so rows would grow with the square of the input if each slice were dealt by itself.
HASHES, TEXT, RUNS = 2_000_000, 24 << 20, 1_000_000
#: Buckets of the first pass hold the hashes of so many buckets' text.
WIDER = 4

#: The cover: each difference modulo 21 is one between two of these residues.
PERIOD = 21
COVER = (0, 1, 6, 8, 18)
#: Suffixes are compared by so many leading bytes, ties by ranks at offsets from LOW to DEPTH.
DEPTH = 24
LOW = DEPTH - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_COMMON = np.array([[next(d for d in range(LOW, DEPTH + 1) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)] for r in range(PERIOD)])

_HASHES = "bucket int, done boolean, doc_ids array<long>, counts array<int>, hashes binary"
_PIECES = "bucket int, done boolean, doc_ids array<long>, marks array<int>, starts array<int>, counts array<int>, text binary"


# --- sorting suffixes -------------------------------------------------------------------------------------------


def _word(text: np.ndarray, at: np.ndarray, k: int, depth: int) -> np.ndarray:
    """Bytes 8 k to 8 k + 7 of the suffixes at these places as numbers of the same order; bytes from depth on count as 0."""
    word = np.ascontiguousarray(sliding_window_view(text, 8)[at + 8 * k]).view(">u8")[:, 0].astype(np.uint64)
    beyond = 8 * k + 8 - depth
    return word & np.uint64((1 << 64) - (1 << 8 * beyond)) if beyond > 0 else word


def _by_bytes(text: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by their first depth bytes, and in that order whether one differs from the one before."""
    words = [_word(text, at, k, depth) for k in range(-(-depth // 8))]
    order = np.lexsort(words[::-1])
    new = np.ones(len(at), bool)
    new[1:] = False
    for w in words:
        w = w[order]
        new[1:] |= w[1:] != w[:-1]
    return order, new


def cover_ranks(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """By place the rank of the cover's suffixes that ties of suffixes at these places can lead to; depth bytes count."""
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, at + LOW, 1)
    np.add.at(change, at + DEPTH + 1, -1)
    sample = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    sample = sample[_IN_COVER[sample % PERIOD]]
    order, new = _by_bytes(text, sample, depth)
    rank = np.zeros(len(text), np.int32)
    rank[sample[order]] = np.cumsum(new)
    return rank


def _settle_ties(place: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where each suffix comes in order, given its group (the place in order where its ties begin): ternary partition of
    all groups at once, by ranks at the offset that a suffix has in common with its group's pivot."""
    group = group.copy()
    size = np.bincount(group, minlength=len(group))
    tied = np.random.default_rng(1).permutation(np.flatnonzero(size[group] > 1))
    while len(tied):
        start, first, which = np.unique(group[tied], return_index=True, return_inverse=True)
        own, pivot = place[tied], place[tied[first]][which]
        offset = _COMMON[own % PERIOD, pivot % PERIOD]
        a, b = rank[own + offset], rank[pivot + offset]
        less, more = a < b, a > b
        n_less, n_more = np.bincount(which[less], minlength=len(start)), np.bincount(which[more], minlength=len(start))
        n_equal = np.bincount(which, minlength=len(start)) - n_less - n_more
        group[tied] = start[which] + np.where(less, 0, n_less[which] + np.where(more, n_equal[which], 0))
        tied = tied[(less & (n_less[which] > 1)) | (more & (n_more[which] > 1))]
    return group


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of that length at places a and b agree."""
    windows, out = sliding_window_view(text, length), np.empty(len(a), bool)
    for i in range(0, len(a), 1 << 17):
        out[i : i + (1 << 17)] = (windows[a[i : i + (1 << 17)]] == windows[b[i : i + (1 << 17)]]).all(axis=1)
    return out


def twins(text: np.ndarray, start: np.ndarray, width: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which pieces of text are, byte for byte, one that a smaller document has too."""
    sums = common.prefix_hash(text)
    h = common.mix((sums[start + width] - sums[start]) * common.powers(len(text) + 1)[1][start])
    order = np.lexsort((doc, width, h))
    start, width, doc, h = start[order], width[order], doc[order], h[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (width[1:] == width[:-1]))
    new = np.ones(len(order), bool)
    at = 0
    while at < len(same):  # about a megabyte of bytes at a time
        to = max(at + 1, int(np.searchsorted(np.cumsum(width[same[at:]]), 1 << 20)) + at)
        some, wide = same[at:to], width[same[at:to]]
        first = np.cumsum(wide) - wide
        inner = np.arange(int(wide.sum())) - np.repeat(first, wide)
        equal = text[np.repeat(start[some], wide) + inner] == text[np.repeat(start[some + 1], wide) + inner]
        new[some + 1] = ~np.logical_and.reduceat(equal, first)
        at = to
    low = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(order), bool)
    out[order[doc > low]] = True
    return out


def suffix_groups(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For the suffix at each place the number of its first length bytes among all such strings, in order of bytes.

    Ranks tell ties of the first DEPTH bytes apart by LOW + (length - LOW) bytes at least, so suffixes that agree in
    length bytes come one after the other, and no others come between."""
    if not len(at):
        return np.zeros(0, np.int64)
    text = np.concatenate([text, np.zeros(DEPTH + length + 8, np.uint8)])
    order, new = _by_bytes(text, at, min(DEPTH, length))
    if length > DEPTH and not new.all():
        begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        alone = new & np.append(new[1:], True)
        rank = cover_ranks(text, at[order[~alone]], length - LOW)
        order = order[np.argsort(_settle_ties(at[order], begin, rank), kind="stable")]
    fresh = np.ones(len(at), bool)
    fresh[1:] = ~_same(text, at[order[1:]], at[order[:-1]], length)
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(fresh) - 1
    return out


# --- which hashes several documents have ------------------------------------------------------------------------


def _slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of so many elements, by doubling."""
    n = 1
    while 2 * n <= width:
        a, n = f(a[:-n], a[n:]), 2 * n
    return f(a[: len(a) - (width - n)], a[width - n :]) if n < width else a


def window_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    sums = common.prefix_hash(buf)
    return common.mix((sums[size:] - sums[:-size]) * common.powers(len(buf) + 1)[1][: len(buf) - size + 1])


def runs(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring suffixes of a row with the same least hash: first place, length, hash and row of each."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none.astype(np.uint64), none
    sample = min(SAMPLE, length)
    least = _slide(window_hashes(buf, sample), length - sample + 1, np.minimum)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(least)]
    inside = np.arange(length, length + len(least)) <= off[row + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside) + 1
    return first, ends - first, least[first], row[first]


def _by_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, how many hashes each has, and the hashes, in order of documents."""
    order = np.argsort(doc, kind="stable")
    docs, counts = np.unique(doc, return_counts=True)
    return docs, counts, h[order]


def _rows(parts: list[tuple[int, bool, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A row for each (bucket, done, documents, hashes)."""
    packed = [(b, done, *_by_doc(doc, h)) for b, done, doc, h in parts if len(h)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p[0] for p in packed], pa.int32()), pa.array([p[1] for p in packed], pa.bool_()), pa.array([p[2] for p in packed], pa.list_(pa.int64())),
            pa.array([p[3].astype(np.int32) for p in packed], pa.list_(pa.int32())), pa.array([p[4].tobytes() for p in packed], pa.binary()),
        ],
        names=["bucket", "done", "doc_ids", "counts", "hashes"],
    )


def _settle(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (hash, document) entries: those of hashes that several documents have, and one entry of the smallest document
    for each hash."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    several = np.zeros(len(first), bool)
    several[group[doc != doc[first][group]]] = True
    once = np.ones(len(h), bool)
    once[1:] = new[1:] | (doc[1:] != doc[:-1])
    hit = several[group] & once
    return h[hit], doc[hit], h[first], doc[first]


def _pieces_of(key: np.ndarray) -> list[np.ndarray]:
    """The indices of each key's elements."""
    order = np.argsort(key, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(key) else []


def _deal(h: np.ndarray, doc: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows for a slice's entries: its own ties are done, and each hash goes once to its bucket."""
    done_h, done_doc, h, doc = _settle(h, doc)
    parts = [(int(done_doc[0]) % buckets, True, done_doc, done_h)] if len(done_h) else []
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    return _rows(parts + [(int(bucket[i[0]]), False, doc[i], h[i]) for i in _pieces_of(bucket)])


def _target(doc: np.ndarray, targets: int) -> np.ndarray:
    return (common.mix(doc.astype(np.uint64)) % np.uint64(targets)).astype(np.int64)


def _tied(targets: int):
    """Reads rows bucket by bucket; gives what several documents have, packed for as many targets (a document has one)."""

    def out(h: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        target = _target(doc, targets)
        return _rows([(int(target[i[0]]), False, doc[i], h[i]) for i in _pieces_of(target)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for some in tied(batches):
            found.append(some)
            if sum(len(h) for h, _ in found) >= HASHES:
                yield out(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found = []
        if found:
            yield out(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        bucket, held = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                b, done = batch.column("bucket")[row].as_py(), batch.column("done")[row].as_py()
                docs, counts = (batch.column(c)[row].values.to_numpy() for c in ("doc_ids", "counts"))
                h, doc = np.frombuffer(batch.column("hashes")[row].as_buffer(), np.uint64), np.repeat(docs, counts)
                if done:
                    yield h.copy(), doc
                    continue
                if b != bucket and held:
                    yield _settle(*(np.concatenate(x) for x in zip(*held, strict=True)))[:2]
                    held = []
                bucket = b
                held.append((h.copy(), doc))
        if held:
            yield _settle(*(np.concatenate(x) for x in zip(*held, strict=True)))[:2]

    return run


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads packed rows target by target; gives each document's hashes in one row."""

    def close(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        docs, counts, h = _by_doc(doc, h)
        ends = np.concatenate([[0], np.cumsum(counts)])
        for i in range(0, len(docs), 1000):
            blobs = [np.unique(h[a:b]).tobytes() for a, b in zip(ends[i : i + 1000], ends[i + 1 : i + 1001], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(docs[i : i + 1000], pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "tied"])

    target, held = None, []
    for batch in batches:
        for row in range(batch.num_rows):
            t = batch.column("bucket")[row].as_py()
            docs, counts = (batch.column(c)[row].values.to_numpy() for c in ("doc_ids", "counts"))
            if t != target and held:
                yield from close(held)
                held = []
            target = t
            held.append((np.frombuffer(batch.column("hashes")[row].as_buffer(), np.uint64).copy(), np.repeat(docs, counts)))
    if held:
        yield from close(held)


def _row_mask(h: np.ndarray, row: np.ndarray, batch: pa.RecordBatch, n: int) -> np.ndarray:
    """Which hashes (in order of rows) are in their row's sorted list."""
    at = np.searchsorted(row, np.arange(n + 1))
    hit = np.zeros(len(h), bool)
    for r in range(n):
        if at[r + 1] > at[r]:
            tied, own = np.frombuffer(batch.column("tied")[r].as_buffer(), np.uint64), h[at[r] : at[r + 1]]
            hit[at[r] : at[r + 1]] = tied[np.minimum(np.searchsorted(tied, own), len(tied) - 1)] == own
    return hit


# --- pieces of text, and what their suffixes lose ----------------------------------------------------------------


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _packed(key: np.ndarray, done: bool, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, count: np.ndarray, text: np.ndarray | None = None, width: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each key with its runs of suffixes; text has their bytes, width[i] for run i, in the order of runs."""
    order = np.argsort(key, kind="stable")
    ends = np.concatenate([np.flatnonzero(np.diff(key[order], prepend=-1)), [len(key)]])
    n = len(ends) - 1
    if text is None:
        blobs = pa.nulls(n, pa.binary())
    else:
        wide = width[order]
        from_ = (np.cumsum(width) - width)[order]
        to = np.concatenate([[0], np.cumsum(wide)])
        squeeze, held, k = zstandard.ZstdCompressor(level=1), [], 0
        while k < n:  # some megabytes at a time, one key at least
            upto = max(k + 1, int(np.searchsorted(to[ends], to[ends[k]] + SLICE, "right")) - 1)
            a, b = ends[k], ends[upto]
            data = text[np.repeat(from_[a:b] - to[a:b] + to[a], wide[a:b]) + np.arange(to[b] - to[a])]
            held += [squeeze.compress(data[i:j]) for i, j in zip(to[ends[k:upto]] - to[a], to[ends[k + 1 : upto + 1]] - to[a], strict=True)]
            k = upto
        blobs = pa.array(held, pa.binary())
    columns = [_lists(x[order], ends) for x in (doc, mark.astype(np.int32), start.astype(np.int32), count.astype(np.int32))]
    return pa.RecordBatch.from_arrays(
        [pa.array(key[order[ends[:-1]]], pa.int32()), pa.array(np.full(n, done)), *columns, blobs], names=["bucket", "done", "doc_ids", "marks", "starts", "counts", "text"]
    )


def _stretches(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First element and length of each stretch; breaks says where one begins."""
    first = np.flatnonzero(breaks)
    return first, np.diff(np.append(first, len(breaks)))


def _sent(batch: pa.RecordBatch, length: int, buckets: int, targets: int) -> Iterator[tuple[bool, tuple[np.ndarray, ...]]]:
    """A slice's suffixes of tied hashes, as what _packed takes: those that a smaller document of the slice has are lost
    (true); the others go to their buckets as pieces of text (false)."""
    buf, off = common.utf8(batch.column("text"))
    first, count, h, row = runs(buf, off, length)
    hit = _row_mask(h, row, batch, batch.num_rows)
    first, count, h, row = first[hit], count[hit], h[hit], row[hit]
    if not len(first):
        return
    docs, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
    copy = twins(buf, first, count + length - 1, docs[row])  # whole pieces first, then suffix by suffix
    if copy.any():
        r = row[copy]
        yield True, (_target(docs[r], targets), docs[r], marks[r], first[copy] - off[r], count[copy])
        first, count, h, row = first[~copy], count[~copy], h[~copy], row[~copy]
    to = np.cumsum(count)
    run = np.repeat(np.arange(len(first)), count)
    at = np.arange(to[-1]) + (first - to + count)[run]
    doc = docs[row][run]
    w = window_hashes(buf, length)[at]
    order = np.argsort(w, kind="stable") if (np.diff(docs) >= 0).all() else np.lexsort((doc, w))
    w = w[order]
    equal = np.flatnonzero(w[1:] == w[:-1])
    new = np.ones(len(w), bool)
    new[1 + equal] = ~_same(buf, at[order[equal]], at[order[equal + 1]], length)
    low = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    lost = np.zeros(len(at), bool)
    lost[order[doc[order] > low]] = True
    for gone in (True, False):
        chosen = np.flatnonzero(lost == gone)
        if not len(chosen):
            continue
        place, of = at[chosen], run[chosen]
        other = row[of] if gone else of  # what is lost needs no hash
        breaks = np.ones(len(chosen), bool)
        breaks[1:] = (place[1:] != place[:-1] + 1) | (other[1:] != other[:-1])
        a, n = _stretches(breaks)
        start, r = place[a], row[of[a]]
        if gone:
            yield True, (_target(docs[r], targets), docs[r], marks[r], start - off[r], n)
            continue
        width = n + length - 1
        ends = np.cumsum(width)
        text = buf[np.repeat(start - ends + width, width) + np.arange(ends[-1])]
        yield False, ((h[of[a]] % np.uint64(buckets)).astype(np.int64), docs[r], marks[r], start - off[r], n, text, width)


def _dealt(parts: Iterator[tuple[bool, tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
    """Packed rows of parts (lost or not, what _packed takes), so many parts together that rows are few."""
    held: dict[bool, list[tuple[np.ndarray, ...]]] = {True: [], False: []}
    size = {True: 0, False: 0}

    def close(gone: bool) -> pa.RecordBatch:
        key, *rest = (np.concatenate(x) for x in zip(*held[gone], strict=True))
        held[gone], size[gone] = [], 0
        return _packed(key, gone, *rest)

    for gone, part in parts:
        held[gone].append(part)
        size[gone] += len(part[0]) if gone else len(part[5])
        if size[gone] >= (RUNS if gone else TEXT):
            yield close(gone)
    for gone in (True, False):
        if held[gone]:
            yield close(gone)


class Bucket:
    """The suffixes of one bucket, sorted block by block: each different string once, and who of its smallest document has it."""

    def __init__(self, length: int):
        self.length = length
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.n_fresh = 0
        self.strings = np.zeros((0, length), np.uint8)
        self.held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64))  # string, document, mark, place

    def add(self, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, count: np.ndarray, text: np.ndarray) -> None:
        self.fresh.append((doc, mark, start, count, text))
        self.n_fresh += int(count.sum())

    def sort(self) -> tuple[np.ndarray, ...]:
        """Sort what came; document, mark, first place and number of the runs of suffixes that are lost."""
        doc, mark, start, count, text = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
        self.fresh, self.n_fresh = [], 0
        width = count + self.length - 1
        copy = twins(text, np.cumsum(width) - width, width, doc)
        whole = tuple(x[copy] for x in (doc, mark, start, count))
        text = text[np.repeat(~copy, width)]
        doc, mark, start, count, width = (x[~copy] for x in (doc, mark, start, count, width))
        to = np.cumsum(count)
        piece = np.repeat(np.arange(len(count)), count)
        inner = np.arange(to[-1]) - (to - count)[piece]
        m = len(self.strings)
        at = np.concatenate([np.arange(m) * self.length, m * self.length + (np.cumsum(width) - width)[piece] + inner])
        text = np.concatenate([self.strings.ravel(), text])
        group = suffix_groups(text, at, self.length)
        string = np.concatenate([group[:m][self.held[0]], group[m:]])
        doc, mark, place = (np.concatenate(x) for x in zip(self.held[1:], (doc[piece], mark[piece], start[piece] + inner), strict=True))
        order = np.argsort(string, kind="stable")
        first = np.flatnonzero(np.diff(string[order], prepend=-1))
        lost = doc > np.minimum.reduceat(doc[order], first)[string]
        one = np.empty(group.max() + 1, np.int64)
        one[group] = at
        self.strings = sliding_window_view(text, self.length)[one]
        self.held = tuple(x[~lost] for x in (string, doc, mark, place))
        doc, mark, place = doc[lost], mark[lost], place[lost]
        breaks = np.ones(len(doc), bool)
        breaks[1:] = (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
        a, n = _stretches(breaks)
        return tuple(np.concatenate(x) for x in zip(whole, (doc[a], mark[a], place[a], n), strict=True))


def _lost(length: int, targets: int):
    """Reads pieces bucket by bucket; gives the runs of suffixes that are lost, packed for as many targets."""

    def out(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[bool, tuple[np.ndarray, ...]]]:
        if len(doc):
            yield True, (_target(doc, targets), doc, mark, start, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(lost(batches))

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple[np.ndarray, ...]]]:
        bucket, held = None, Bucket(length)
        for batch in batches:
            for row in range(batch.num_rows):
                b = batch.column("bucket")[row].as_py()
                doc, mark, start, count = (batch.column(c)[row].values.to_numpy() for c in ("doc_ids", "marks", "starts", "counts"))
                if batch.column("done")[row].as_py():
                    yield from out(doc.copy(), mark.copy(), start.copy(), count.copy())
                    continue
                if b != bucket:
                    if held.fresh:
                        yield from out(*held.sort())
                    bucket, held = b, Bucket(length)
                # Long pieces (of periodic texts) are taken a block at a time.
                text = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("text")[row].as_buffer()), np.uint8)
                to = np.cumsum(count + length - 1)
                for i in range(len(count)):
                    if count[i] > BLOCK:
                        whole = text[to[i] - count[i] - length + 1 : to[i]]
                        for k in range(0, int(count[i]), BLOCK):
                            n = min(BLOCK, int(count[i]) - k)
                            held.add(doc[i : i + 1], mark[i : i + 1], start[i : i + 1] + k, np.array([n]), whole[k : k + n + length - 1].copy())
                            yield from out(*held.sort())
                small = count <= BLOCK
                if small.any():
                    kept = text if small.all() else text[np.repeat(small, count + length - 1)]
                    held.add(doc[small], mark[small], start[small].astype(np.int64), count[small].astype(np.int64), kept.copy())
                if held.n_fresh >= BLOCK:
                    yield from out(*held.sort())
        if held.fresh:
            yield from out(*held.sort())

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads packed runs target by target; gives each document's in one row."""

    def close(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        doc, mark, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((mark, doc))
        doc, mark = doc[order], mark[order]
        pairs = np.stack([start[order], count[order]], axis=1).astype(np.int32)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
        first, n = _stretches(new)
        for i in range(0, len(first), 1000):
            blobs = [pairs[a : a + k].tobytes() for a, k in zip(first[i : i + 1000], n[i : i + 1000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[first[i : i + 1000]], pa.int64()), pa.array(mark[first[i : i + 1000]], pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "mark", "runs"])

    target, held = None, []
    for batch in batches:
        for row in range(batch.num_rows):
            t = batch.column("bucket")[row].as_py()
            if t != target and held:
                yield from close(held)
                held = []
            target = t
            held.append(tuple(batch.column(c)[row].values.to_numpy().copy() for c in ("doc_ids", "marks", "starts", "counts")))
    if held:
        yield from close(held)


def _cut_out(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=SLICE):
            buf, off = common.utf8(batch.column("text"))
            out = []
            for i, lost in enumerate(batch.column("runs")):
                own, removed, spans = buf[off[i] : off[i + 1]], 0, []
                if lost.is_valid:
                    pairs = np.frombuffer(lost.as_buffer(), np.int32).reshape(-1, 2).astype(np.int64)
                    change = np.bincount(pairs[:, 0], minlength=len(own) + 1) - np.bincount(pairs.sum(axis=1) + length - 1, minlength=len(own) + 1)
                    gone = np.cumsum(change[:-1]) > 0
                    spans = np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2).tolist()
                    removed, own = int(gone.sum()), own[~gone]
                out.append((int(off[i + 1] - off[i]), removed, len(spans), hashlib.sha256(own.tobytes()).hexdigest(), spans))
            size, removed, n, kept, spans = zip(*out, strict=True)
            columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def remove(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end of each removed run)."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be of a whole-number type")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("mark"), text.alias("text"))  # mark tells texts of equal doc_id apart
    known = texts.filter("doc_id IS NOT NULL")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = common.tasks(spark, total)
    buckets = max(4 * n, total // BUCKET)

    wide = max(4 * n, total // (WIDER * BUCKET))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in common.slices(batches, limit=SLICE):
            _, _, h, row = runs(*common.utf8(batch.column("text")), length)
            if len(h):
                held.append((h, batch.column("doc_id").to_numpy()[row]))
            if sum(len(h) for h, _ in held) >= HASHES:
                yield _deal(*(np.concatenate(x) for x in zip(*held, strict=True)), wide)
                held = []
        if held:
            yield _deal(*(np.concatenate(x) for x in zip(*held, strict=True)), wide)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(part for batch in common.slices(batches, limit=SLICE) for part in _sent(batch, length, buckets, n))

    dealt = known.select("doc_id", "text").mapInArrow(hashes, _HASHES).repartition(n, "bucket").sortWithinPartitions("bucket", "done")
    packed = dealt.mapInArrow(_tied(n), _HASHES).repartition(n, "bucket").sortWithinPartitions("bucket")
    tied = common.cut(spark, packed.mapInArrow(_per_document, "doc_id long, tied binary"), "passages-tied")
    dealt = known.join(tied, "doc_id").select("doc_id", "mark", "text", "tied").mapInArrow(pieces, _PIECES).repartition(n, "bucket").sortWithinPartitions("bucket", "done")
    packed = dealt.mapInArrow(_lost(length, n), _PIECES).repartition(n, "bucket").sortWithinPartitions("bucket")
    lost = common.cut(spark, packed.mapInArrow(_gathered, "doc_id long, mark int, runs binary"), "passages-lost")
    common.drop(spark, tied)
    return texts.join(lost, ["doc_id", "mark"], "left").select("doc_id", "text", "runs").mapInArrow(
        _cut_out(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>"
    )
