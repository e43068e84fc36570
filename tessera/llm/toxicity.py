"""Toxicity of whole texts by maximum-scoring segments.

* A token (a lower-cased run of letters) has the log-odds of its rates in toxic and in clean labelled documents (of how
  many it is in). The
  rates are smoothed with Dirichlet priors in a chain: a word's prior is what its first six bytes say, theirs what the
  first four say, and theirs that both classes are alike. Counts lie in hashed tables of fixed size.
* Per document, a linear-time scan finds all maximal scoring segments of (log-odds - ``DRIFT``).
* With n tokens, segments of score S are expected K n exp(-lambda S) times in clean text (extreme-value theory of
  segment scores); lambda and K come from the clean documents of the sample. A logistic curve turns what the segments
  have above chance, lambda S - ln(K n), into a probability: the logarithm of their sum, and the best of them.

The model is fitted on at most ``SAMPLE`` documents of each label, those with the smallest hashes, never on rows held
out. Labels of null doc_id or null value are ignored; a document with several labels counts as toxic if one says so.
Null or wordless texts score 0 and have no passages. Without labels of both kinds every score is 0. Very long texts are
scored whole, each in one worker. Repeated rows score alike, each for itself. Other columns are ignored, and an empty
table gives an empty result. Rows are neither merged nor dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Documents of each label that the model is fitted on, at most.
SAMPLE = 8000
BITS = 18
ALPHA = 1.0
DRIFT = 1.0
PREFIXES = (4, 6)
THRESHOLD = 0.7
#: Bins of the score histogram from which lambda is found.
EDGES = np.linspace(-8, 12, 2001)

_BREAK = np.ones(256, bool)
_BREAK[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Table slots of each token (a row for each level), the bounds of the texts in them, and where tokens start and end
    in the bytes of their text. A text that lower-casing makes longer or shorter is lower-cased in ASCII alone."""
    low = pc.utf8_lower(text)
    buf, off = common.utf8(pc.if_else(pc.equal(pc.binary_length(low), pc.binary_length(text)), low, pc.ascii_lower(text)))
    start, end, row = common.words(np.where(_BREAK[buf], np.uint8(32), buf), off)
    sums, down = common.prefix_hash(buf), common.powers(len(buf) + 1)[1][start]
    out = np.empty((len(PREFIXES) + 1, len(start)), np.int64)
    for k, size in enumerate((*PREFIXES, 1 << 30)):
        h = common.mix((sums[np.minimum(end, start + size)] - sums[start]) * down)
        out[k] = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return out, np.searchsorted(row, np.arange(len(off))), start - off[row], end - off[row]


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first token, token after the last, score), in linear time. Of equal ways to cut
    them the shortest segments are given."""
    up = np.flatnonzero(score > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    kept: list[tuple[float, float, int, int]] = []  # running total before and after each segment, and its tokens
    for left, right, first in zip(total[up], total[up + 1], up.tolist(), strict=True):
        last = first + 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= left:
                j -= 1
            if j < 0 or kept[j][1] >= right:
                kept.append((left, right, first, last))
                break
            left, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(first, last, float(right - left)) for left, right, first, last in kept]


class Model:
    """Hashed counts of tokens by level and class, and the calibration."""

    def __init__(self, clean: np.ndarray, toxic: np.ndarray):
        ratio = max(float(toxic[-1].sum()), 1.0) / max(float(clean[-1].sum()), 1.0)
        self.toxic = toxic.astype(np.float32)
        self.below = (1 / (clean * ratio + ALPHA)).astype(np.float32)
        self.rate, self.k, self.curve = 1.0, 1.0, None

    def scores(self, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-odds less the drift; what a text repeats counts at its first place only."""
        odds = np.ones(slots.shape[1], np.float32)
        for level in range(len(slots)):
            odds = (self.toxic[level][slots[level]] + ALPHA * odds) * self.below[level][slots[level]]
        out = np.log(odds) - DRIFT
        up = np.flatnonzero(out > 0)
        again = np.ones(len(up), bool)
        again[np.unique(np.searchsorted(at, up, "right") << BITS | slots[-1][up], return_index=True)[1]] = False
        out[up[again]] = -DRIFT
        return out

    def above_chance(self, found: list[float], n: int) -> np.ndarray:
        """How far the scores of segments of a text of n tokens are above what chance gives; significant ones are above 0."""
        return self.rate * np.array(found or [0.0]) - np.log(max(self.k * n, 1.0))

    def evidence(self, found: list[float], n: int) -> tuple[float, float]:
        """What the segments of a text of n tokens have above chance, on a log scale, and the best of them."""
        above = self.above_chance(found, n)
        return float(np.log1p(above[above > 0].sum())), float(max(0.0, above.max()))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + evidence @ self.curve[1:], -30, 30)))


def _rate(histogram: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 for the scores of clean tokens."""
    p, s = histogram / max(histogram.sum(), 1), (EDGES[1:] + EDGES[:-1]) / 2
    if not (p[s > 0].sum() > 0 and (p * s).sum() < 0):
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(high * s)).sum() < 1 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton steps on the weighted log-likelihood with a weak ridge."""
    a = np.vstack([np.ones(len(x)), x.T])
    w = np.zeros(len(a))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(w @ a, -30, 30)))
        grad = a @ (weight * (y - p)) - 1e-2 * w
        hess = (a * (weight * p * (1 - p))) @ a.T + 1e-2 * np.eye(len(a))
        w = w + np.linalg.solve(hess, grad)
    return w


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of docs that are not held out."""
    label = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    key = F.xxhash64("doc_id")
    sides = [label.filter(F.col("toxic") == v).orderBy(key, "doc_id").limit(sample) for v in (0, 1)]
    rates = {int(r.toxic): r["count"] for r in label.groupBy("toxic").count().filter("toxic IN (0, 1)").collect()}
    chosen = sides[0].unionByName(sides[1]).withColumnRenamed("doc_id", "chosen_id")  # 2 * sample rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id")).select("text", "toxic")
    rows = common.cut(spark, rows.repartition(8), "toxicity-sample")
    levels = len(PREFIXES) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, levels, 1 << BITS), np.uint32)
        for batch in common.slices(batches):
            slots, at, _, _ = tokens(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(toxic)), np.diff(at))
            for k in range(levels):  # a text counts once for each of its tokens
                each = np.unique(text << BITS | slots[k])
                for v in (0, 1):
                    held[v, k] += np.bincount(each[toxic[each >> BITS] == v] & ((1 << BITS) - 1), minlength=1 << BITS).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(held.tobytes(), 1)])], names=["counts"])

    held = np.zeros((2, levels, 1 << BITS), np.int64)
    for row in rows.mapInArrow(count, "counts binary").toLocalIterator():
        held += np.frombuffer(zlib.decompress(row.counts), np.uint32).reshape(held.shape)
    model = Model(held[0], held[1])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            slots, at, _, _ = tokens(batch.column("text"))
            score, toxic = model.scores(slots, at), batch.column("toxic").to_pylist()
            clean = np.repeat(np.array(toxic) == 0, np.diff(at))
            bins = np.histogram(np.clip(score[clean], EDGES[0], EDGES[-1]), EDGES)[0].astype(np.int64)
            found = [[x for _, _, x in segments(score[at[i] : at[i + 1]])] for i in range(len(toxic))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic, pa.int32()), pa.array(np.diff(at), pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.array([bins.tobytes(), *[None] * (len(toxic) - 1)], pa.binary())],
                names=["toxic", "n", "found", "bins"],
            )

    measured = rows.mapInArrow(measure, "toxic int, n long, found array<double>, bins binary").collect()  # 2 * sample rows at most
    common.drop(spark, rows)
    if not rates.get(0) or not rates.get(1) or not measured:
        return model
    model.rate = _rate(sum(np.frombuffer(r.bins, np.int64) for r in measured if r.bins))
    best = [model.rate * max(r.found) - np.log(r.n) for r in measured if r.toxic == 0 and r.n and r.found]
    share = sum(1 for r in measured if r.toxic == 0 and r.n and r.found) / max(1, sum(1 for r in measured if r.toxic == 0 and r.n))
    model.k = float(np.exp(np.mean(best) - 0.5772156649015329)) * max(share, 1e-3) if best else 1e-3
    x = np.array([model.evidence(list(r.found), r.n) for r in measured])
    y = np.array([r.toxic for r in measured], float)
    each = {v: rates[v] / max(1, (y == v).sum()) for v in (0, 1)}
    weight = np.where(y == 1, each[1], each[0])
    model.curve = _logistic(x, y, weight * len(y) / weight.sum())
    return model


_PASSAGES = "array<struct<start: int, end: int, above: double>>"


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, passages (bytes from start to end, and how far above chance:
    the significant segments), and the columns named in keep as kept_<name>. The text goes through Python once."""
    rest = [c for c in keep if c != "text"]
    given = docs.select(F.col("doc_id"), F.col("text"), *(F.col(c).alias(f"kept_{c}") for c in rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, as_given="kept_text"):
            slots, at, start, end = tokens(batch.column("text"))
            s = model.scores(slots, at)
            hot = np.concatenate([[0], np.cumsum(s > 0)])
            n = np.diff(at)
            evidence, passages = np.zeros((len(n), 2)), [[] for _ in n]
            for i in np.flatnonzero(hot[at[1:]] > hot[at[:-1]]):
                found = segments(s[at[i] : at[i + 1]])
                scores = [x for _, _, x in found]
                evidence[i] = model.evidence(scores, int(n[i]))
                above = model.above_chance(scores, int(n[i]))
                passages[i] = [{"start": int(start[at[i] + a]), "end": int(end[at[i] + b - 1]), "above": float(x)} for (a, b, _), x in zip(found, above, strict=True) if x > 0]
            p = np.where(n > 0, model.probability(evidence), 0.0)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("above", pa.float64())]))
            kept = [batch.column(f"kept_{c}") for c in keep]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p), pa.array(passages, kind), *kept], names=["doc_id", "score", "passages", *(f"kept_{c}" for c in keep)]
            )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    out = given.mapInArrow(run, f"doc_id {kinds['doc_id']}, score double, passages {_PASSAGES}" + "".join(f", kept_{c} {kinds[c]}" for c in keep))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages", *(f"kept_{c}" for c in keep)
    )
