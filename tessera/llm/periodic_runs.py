"""Runs of repeated word sequences in whole texts, by Crochemore's partition refinement.

Positions of a text are in one class at level l if the l words from there on are the same. Going from level l to l + 1, a
class falls apart by the classes of the next positions. Of the parts that a class has fallen into, all but the largest
make their predecessors move, so a position moves O(log n) times (the smaller half). A class is a linked list in order
of position; two neighbours at a distance equal to the level are a square, a sequence that stands there twice in a row,
and its root is no repetition itself. Consecutive squares of one period make a run.

All texts of a slice are refined together in numpy arrays, level by level. A pair of neighbours keeps the level that it
came up at, and is looked at when it breaks: it was a square if its distance was one of the levels in between. As a run
holds its period three times, a text of n words is refined up to level n / 3. A word outside of all texts, another one for
each, ends them, so that no class has positions of two texts.

A text whose doc_id has the checksum of a multiple of ten is worked on in another form, see ``rearranged``; a null doc_id
has no checksum and its text stays as it is. Null, empty and short
texts have no runs. Very long texts are worked on whole, each in one worker, whose memory grows with the longest text. Rows are neither merged nor dropped, repeated ones are worked on alike, and other columns are
ignored. Of equal exponents the run of smallest start, then of smallest period is given. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm import common

#: A run has so many words, and so many periods, at least.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Text that is refined together. Each level costs some array calls, however few positions move.
SLICE_BYTES = 4 << 20
#: So few moving positions are faster one by one than in arrays.
FEW = 24


def _in_order(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, p in order of (a, b, p): sorted as one number where that has room."""
    bits = int(max(a.max(), b.max(), p.max())).bit_length()
    if 3 * bits > 63:
        order = np.lexsort((p, b, a))
        return a[order], b[order], p[order]
    packed = a << (2 * bits)
    packed |= b << bits
    packed |= p
    packed.sort()
    mask = (1 << bits) - 1
    return packed >> (2 * bits), (packed >> bits) & mask, packed & mask


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Partition:
    """The classes of all positions of some texts (words as numbers, and the bounds of the texts), refined level by level."""

    def __init__(self, words: np.ndarray, off: np.ndarray):
        n = np.diff(off)
        text = np.repeat(np.arange(len(n)), n)
        self.begin = off[:-1] + np.arange(len(n))  # where each text begins; it ends with a place of its own
        size = len(words) + len(n)
        self.last = np.repeat(n // LEAST_PERIODS, n + 1)  # the level that a position is refined to
        self.text = np.repeat(np.arange(len(n)), n + 1)
        self.opens = np.zeros(size, bool)
        self.opens[self.begin] = True
        self.level = 1
        self.kind = np.full(size, -1)
        self.after, self.before = np.full(size, -1), np.full(size, -1)
        self.since = np.ones(size, np.int64)
        self.count, self.head = np.ones(size, np.int64), np.zeros(size, np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        a, b, p = _in_order(text, words.astype(np.int64), np.arange(len(words)) + text)
        first = _firsts(a, b)
        self.kinds = len(first)
        held = np.diff(np.append(first, len(p)))
        self.kind[p] = np.repeat(np.arange(self.kinds), held)
        self.count[: self.kinds], self.head[: self.kinds] = held, p[first]
        self._link(p, first)
        ends = np.flatnonzero(self.kind < 0)
        self.kind[ends] = self.kinds + np.arange(len(ends))
        self.head[self.kind[ends]] = ends
        self.kinds += len(ends)
        self.moved = np.arange(size)
        self.active = np.sort(p)
        self.views = tuple(map(memoryview, (self.kind, self.after, self.before, self.since, self.count, self.head, self.last, self.opens)))

    def _link(self, p: np.ndarray, first: np.ndarray) -> None:
        """Make lists of p, each from one place of first to the next."""
        self.after[p[:-1]], self.before[p[1:]] = p[1:], p[:-1]
        self.before[p[first]] = -1
        self.after[np.append(p[first[1:] - 1], p[-1])] = -1

    def _broken(self, p: np.ndarray) -> None:
        """Keep those of the pairs (p, what comes after) that were squares, now that they part or go up."""
        p = p[self.after[p] >= 0]
        gap = self.after[p] - p
        square = (self.since[p] <= gap) & (gap <= self.level)
        if square.any():
            self.found.append((p[square], gap[square]))

    def _all(self) -> None:
        """To the next level by ordering all positions that are not alone."""
        p = self.active = self.active[(self.count[self.kind[self.active]] > 1) & (self.last[self.active] > self.level)]
        if not len(p):
            self.moved = p
            return
        a, b, p = _in_order(self.kind[p], self.kind[p + 1], p)
        first = _firsts(a, b)
        held = np.diff(np.append(first, len(p)))
        of = a[first]
        outer = _firsts(of)
        largest = self._largest(held, outer)
        to = of.copy()
        to[~largest] = self.kinds + np.arange(len(of) - len(outer))
        self.kinds += len(of) - len(outer)
        old = self.after[p]
        new = np.append(p[1:], -1)
        new[np.append(first[1:] - 1, len(p) - 1)] = -1
        other = p[old != new]
        self._broken(other)
        self.since[other] = self.level + 1
        self._link(p, first)
        self.kind[p] = np.repeat(to, held)
        self.count[to], self.head[to] = held, p[first]
        self.moved = p[np.repeat(~largest, held)]

    @staticmethod
    def _largest(held: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """Which group is the largest of each stretch of groups that starts at outer; of equal ones the first."""
        each = np.diff(np.append(outer, len(held)))
        top = np.flatnonzero(held == np.repeat(np.maximum.reduceat(held, outer), each))
        stretch = np.searchsorted(outer, top, "right")
        out = np.zeros(len(held), bool)
        out[top[_firsts(stretch)]] = True
        return out

    def _some(self) -> None:
        """To the next level by moving the predecessors of what moved."""
        s = self.moved[~self.opens[self.moved]]
        p = s - 1
        use = (self.count[self.kind[p]] > 1) & (self.last[p] > self.level)
        s, p = s[use], p[use]
        self.moved = p
        if not len(p):
            return
        a, b, p = _in_order(self.kind[p], self.kind[s], p)
        first = _firsts(a, b)
        held = np.diff(np.append(first, len(p)))
        of = a[first]
        outer = _firsts(of)
        each = np.diff(np.append(outer, len(of)))
        rest = self.count[of[outer]] - np.add.reduceat(held, outer)
        # What stays keeps the class's number: what has no moving successor, or else the largest group.
        largest = self._largest(held, outer)
        stays = largest & np.repeat(rest == 0, each)
        if stays.any():
            goes = np.repeat(~stays, held)
            p, held, of = p[goes], held[~stays], of[~stays]
            self.moved = p
            if not len(p):
                return
            first = np.cumsum(held) - held
            outer = _firsts(of)
            each = np.diff(np.append(outer, len(of)))
            largest = self._largest(held, outer)
        self._broken(p)
        q = p[np.lexsort((p, np.repeat(of, held)))]  # as they stand in the lists that they leave
        cut = np.flatnonzero(self.after[q[:-1]] != q[1:])
        left = self.before[q[np.append(0, cut + 1)]]
        right = self.after[q[np.append(cut, len(q) - 1)]]
        named = self.kind[q[np.append(0, cut + 1)]]
        inner = left >= 0
        self._broken(left[inner])
        self.after[left[inner]] = right[inner]
        self.since[left[inner]] = self.level + 1
        self.head[named[~inner]] = right[~inner]
        inner = right >= 0
        self.before[right[inner]] = left[inner]
        self._link(p, first)
        self.since[p] = self.level + 1
        to = self.kinds + np.arange(len(of))
        self.kinds += len(of)
        self.kind[p] = np.repeat(to, held)
        self.count[to], self.head[to] = held, p[first]
        whole = of[outer]
        self.count[whole] -= np.add.reduceat(held, outer)
        smaller = self.count[whole] < np.maximum.reduceat(held, outer)
        if smaller.any():  # what stayed moves its predecessors, and the largest group that left does not
            goes = np.repeat(~(largest & np.repeat(smaller, each)), held)
            more, at = [p[goes]], self.head[whole[smaller]]
            while len(at):
                more.append(at)
                at = self.after[at]
                at = at[at >= 0]
            self.moved = np.concatenate(more)

    def _few(self) -> None:
        """What _some does, one position after the other."""
        kind, after, before, since, count, head, last, opens = self.views
        level, parts = self.level, {}
        for s in self.moved.tolist():
            p = s - 1
            if not opens[s] and count[kind[p]] > 1 and last[p] > level:
                parts.setdefault(kind[p], {}).setdefault(kind[s], []).append(p)
        moved, found = [], []
        for of, by_next in parts.items():
            groups = sorted(by_next.values(), key=len)
            if sum(map(len, groups)) == count[of]:
                groups.pop()
            for group in groups:
                group.sort()
                for p in group:
                    left, right = before[p], after[p]
                    if right >= 0:
                        if since[p] <= right - p <= level:
                            found.append((p, right - p))
                        before[right] = left
                    if left >= 0:
                        if since[left] <= p - left <= level:
                            found.append((left, p - left))
                        after[left], since[left] = right, level + 1
                    else:
                        head[of] = right
                count[of] -= len(group)
                to = self.kinds
                self.kinds += 1
                count[to], head[to] = len(group), group[0]
                for k, p in enumerate(group):
                    kind[p], since[p] = to, level + 1
                    before[p] = group[k - 1] if k else -1
                    after[p] = group[k + 1] if k + 1 < len(group) else -1
            if groups and count[of] < len(groups[-1]):
                groups.pop()
                at = head[of]
                while at >= 0:
                    moved.append(at)
                    at = after[at]
            moved += [p for group in groups for p in group]
        if found:
            self.found.append(tuple(np.array(found).T))
        self.moved = np.array(moved, np.int64)

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of all squares with roots of up to a third of their text."""
        while len(self.moved):
            if 4 * len(self.moved) > len(self.active):
                self._all()
            elif len(self.moved) > FEW:
                self._some()
            else:
                self._few()
            self.level += 1
        p = np.flatnonzero(self.after >= 0)
        gap = self.after[p] - p
        left = (self.since[p] <= gap) & (gap <= self.last[p])
        self.found.append((p[left], gap[left]))
        return tuple(np.concatenate(x) for x in zip(*self.found, strict=True))


def runs(words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts given as numbers of words and bounds, in that order."""
    none = np.zeros(0, np.int64)
    use = np.diff(off) >= LEAST_WORDS
    if not use.any():
        return none, none, none, none
    n = np.where(use, np.diff(off), 0)
    part = Partition(words[np.repeat(use, np.diff(off))], np.concatenate([[0], np.cumsum(n)]))
    place, period = part.squares()
    if not len(place):
        return none, none, none, none
    text = part.text[place]
    order = np.lexsort((place, period, text))
    text, period, place = text[order], period[order], place[order]
    first = _firsts(text, period, place - np.arange(len(place)))
    length = np.diff(np.append(first, len(place))) - 1 + 2 * period[first]
    text, period, start = text[first], period[first], (place - part.begin[text])[first]
    keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    text, start, length, period = text[keep], start[keep], length[keep], period[keep]
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def rearranged(doc_id: list, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the place a and the period p of its form: from word a on, word i is word a + (i - a) % p of the text."""
    h = np.array([1 if i is None else zlib.crc32(str(i).encode()) for i in doc_id], np.int64)
    g, some = h // 10, (h % 10 == 0) & (n > 0)
    a = np.where(some, g % np.maximum(n, 1), n)
    return a, np.where(some, 1 + (n - a) // (3 + g % 8), 1)


def _work(doc_id: list, text: pa.Array) -> dict[str, pa.Array]:
    buf, off = common.utf8(text)
    start, end, row = common.words(buf, off)
    first = np.searchsorted(row, np.arange(len(off)))
    n = np.diff(first)
    solid = buf[~common.SPACE[buf]]
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    each = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(solid)])
    a, p = rearranged(doc_id, n)
    i = np.arange(len(row)) - first[row]
    source = first[row] + np.where(i >= a[row], a[row] + (i - a[row]) % p[row], i)
    number = each.dictionary_encode().indices.to_numpy(zero_copy_only=False)[source]
    which, at, length, period = runs(number, first)
    # Words in a run after its first period go.
    change = np.zeros(len(row) + 1, np.int64)
    np.add.at(change, first[which] + at + period, 1)
    np.add.at(change, first[which] + at + length, -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    lists = pa.LargeListArray.from_arrays(np.searchsorted(row[kept], np.arange(len(off))), each.take(pa.array(source[kept])).cast(pa.large_binary()))
    collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
    bounds = np.searchsorted(which, np.arange(len(off)))
    best: list[tuple] = []
    said = []
    for k in range(len(n)):
        own = [x[bounds[k] : bounds[k + 1]].tolist() for x in (at, length, period)]
        top = None
        for s, m, q in zip(*own, strict=True):
            if top is None or m * top[2] > top[1] * q:
                top = (s, m, q)
        best.append((len(own[0]), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None))
        said.append(hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in zip(*own, strict=True)).encode()).hexdigest())
    names = ("n_runs", "start", "length", "period", "exponent_milli")
    columns = {name: pa.array([b[k] for b in best], pa.int64()) for k, name in enumerate(names)}
    columns["runs_sha256"] = pa.array(said, pa.string())
    columns["collapsed_sha256"] = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in collapsed], pa.string())
    columns["n_words"] = pa.array(n)
    columns["runs"] = pa.array([[{"start": s, "length": m, "period": q} for s, m, q in zip(*(x[bounds[k] : bounds[k + 1]].tolist() for x in (at, length, period)), strict=True)] for k in range(len(n))], _RUNS)
    columns["collapsed"] = collapsed.cast(pa.large_string())
    return columns


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_KINDS = {
    "n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string",
    "n_words": "long", "runs": "array<struct<start: long, length: long, period: long>>", "collapsed": "string",
}


def find(docs: DataFrame, columns: tuple[str, ...] = tuple(_KINDS)) -> DataFrame:
    """Per row of docs: doc_id and what columns name: n_runs; start, length, period and exponent_milli of the run of
    greatest exponent; runs_sha256 and collapsed_sha256; n_words; runs; collapsed, the text with each run's first period
    alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=SLICE_BYTES):
            got = _work(batch.column("doc_id").to_pylist(), batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(got[c] for c in columns)], names=["doc_id", *columns])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} {_KINDS[c]}" for c in columns)]))
