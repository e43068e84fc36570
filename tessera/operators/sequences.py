"""Sequences along walks: reversal, padding, positions, pooling, losses, and what walks are made for and held out."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tessera import config
from tessera.functions import cut, draw, rank_by_parts
from tessera.operators import graph

# Means and deviations of colour channels that image encoders are trained with.
CHANNELS = {
    "photographs": ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
    "tissue": ((0.707223, 0.578729, 0.703617), (0.211883, 0.230117, 0.177517)),
}


def reverse_augment(walks: DataFrame) -> DataFrame:
    """Each walk twice: as it is and, with reversed true, from its end to its start."""
    rest = [c for c in walks.columns if c != "path"]
    both = F.array(F.struct(F.col("path").alias("p"), F.lit(False).alias("r")), F.struct(F.reverse("path").alias("p"), F.lit(True).alias("r")))
    return walks.select(*rest, F.explode(both).alias("both_")).select(*rest, F.col("both_.p").alias("path"), F.col("both_.r").alias("reversed"))


def pad_sequences(walks: DataFrame, batch: str, fill: int = 0) -> DataFrame:
    """Adds length, and fills each path up to the longest of its batch."""
    longest = F.max(F.size("path")).over(Window.partitionBy(batch))
    return walks.withColumn("most_", longest).select(
        *(c for c in walks.columns if c != "path"), F.size("path").cast("long").alias("length"),
        F.concat("path", F.array_repeat(F.lit(fill).cast("long"), F.col("most_") - F.size("path"))).alias("path"),
    )


def linspace_sample(spark: SparkSession, items: DataFrame, position: str, most: int) -> DataFrame:
    """At most so many rows, evenly spaced over dense positions from 0, first and last included."""
    n = items.count()
    k = min(n, most)
    picks = spark.range(k).select(F.expr(f"id * {max(n - 1, 0)}L div {max(k - 1, 1)}L").alias(position))
    return items.join(F.broadcast(picks), position, "left_semi")  # `most` numbers


def channel_normalize(channels: Sequence[Column], kind: str = "photographs") -> list[Column]:
    """Colours of 0 to 255 as standardised shares, by the means and deviations of that kind of pictures."""
    return [(c / 255 - m) / s for c, m, s in zip(channels, *CHANNELS[kind], strict=True)]


@F.arrow_udf(ArrayType(FloatType()))
def to_half(vectors: pa.Array) -> pa.Array:
    """Vectors rounded to what half precision can hold; null stays null, vectors and numbers alike."""
    flat = vectors.flatten()
    half = pa.array(flat.to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32), mask=np.array(flat.is_null()))
    ends = np.append(0, np.cumsum(np.array(vectors.value_lengths().fill_null(0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), half, mask=vectors.is_null())


def positional_encoding(spark: SparkSession, length: int, width: int) -> DataFrame:
    """(pos, dim, value): sines on even and cosines on odd dimensions, each pair slower than the one before."""
    pos, dim = F.expr(f"id div {width}L"), F.col("id") % width
    at = pos * F.exp(-(dim - dim % 2) * F.lit(math.log(10000.0) / width))
    return spark.range(length * width).select(pos.alias("pos"), dim.alias("dim"), F.when(dim % 2 == 0, F.sin(at)).otherwise(F.cos(at)).alias("value"))


def with_positions(steps: DataFrame, width: int) -> DataFrame:
    """steps (pos, embedding, ...) with positional_encoding added to their embeddings."""
    rate = F.array(*(F.lit(math.exp(-(d - d % 2) * (math.log(10000.0) / width))) for d in range(width)))
    add = F.zip_with("embedding", F.transform(rate, lambda r, d: F.struct((F.col("pos") * r).alias("at"), (d % 2).alias("odd"))), lambda x, p: x.cast("double") + F.when(p["odd"] == 0, F.sin(p["at"])).otherwise(F.cos(p["at"])))
    return steps.withColumn("embedding", add)


def attention_score(x: Column, hidden: Sequence[Sequence[float]], out: Sequence[float]) -> Column:
    """out . tanh(hidden x). At most the sum of |out|, so its exponential needs no shift."""

    def unit(row: Sequence[float], weight: float) -> Column:
        products = F.zip_with(x, F.array(*(F.lit(float(w)) for w in row)), lambda a, b: a.cast("double") * b)
        return F.lit(float(weight)) * F.tanh(F.aggregate(products, F.lit(0.0), lambda s, v: s + v))

    units = [unit(r, w) for r, w in zip(hidden, out, strict=True)]
    return sum(units[1:], units[0])


def _summed(key: pa.Array, weight: np.ndarray, vectors: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Keys once each, and the sums of their weights and vectors."""
    coded = key.dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(number, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(number[order]) > 0))
    return coded.dictionary, np.add.reduceat(weight[order], first), np.add.reduceat(vectors[order], first, 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of one width: what is missing or null is 0."""
    flat = column.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    n = np.array(column.value_lengths().fill_null(0))
    if (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat[(np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)) < width]
    return out


def mean_vectors(steps: DataFrame, weight: Column | None = None, width: int | None = None) -> DataFrame:
    """(walk_id, dim, value): the mean of the embeddings of each walk's steps, weighted or not; a null vector counts as one
    of zeros.

    Tasks sum vectors as whole arrays, batch by batch; only these sums are dealt by walk, and only the means are laid out by
    dimension, so the plan is the same for any width. width is the vectors' dimension; without it one row is read to
    learn it."""
    if width is None:
        first = steps.select(F.size("embedding").alias("n")).first()
        width = first.n if first else 0
    kind = f"walk_id {steps.schema['walk_id'].dataType.simpleString()}, w double, sums array<double>"

    def batch_of(key: pa.Array, w: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([key, pa.array(w), lists], names=["walk_id", "w", "sums"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                w = batch.column(1).to_numpy(zero_copy_only=False)
                yield batch_of(*_summed(batch.column(0), w, _matrix(batch.column(2), width) * w[:, None]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last walk, of which the next batch may have more
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                key, w, x = _summed(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2), width))
                if held is not None and held[0].equals(key.slice(0, 1)):
                    w[0], x[0] = w[0] + held[1][0], x[0] + held[2][0]
                elif held is not None:
                    yield batch_of(*held)
                if len(key) > 1:
                    yield batch_of(key.slice(0, len(key) - 1), w[:-1], x[:-1])
                held = (key.slice(len(key) - 1), w[-1:], x[-1:])
        if held is not None:
            yield batch_of(*held)

    rows = steps.select("walk_id", (F.lit(1.0) if weight is None else weight).cast("double").alias("w"), "embedding")
    sums = rows.mapInArrow(part, kind).repartition("walk_id").sortWithinPartitions("walk_id").mapInArrow(meet, kind)
    means = sums.select("walk_id", F.posexplode(F.transform("sums", lambda x: x / F.col("w"))).alias("dim", "value"))
    return means.withColumn("dim", F.col("dim").cast("long"))


def attention_pool(steps: DataFrame, hidden: Sequence[Sequence[float]], out: Sequence[float]) -> DataFrame:
    """(walk_id, dim, value): the mean embedding of a walk's steps, weighted by the softmax of their attention scores."""
    return mean_vectors(steps, F.exp(attention_score(F.col("embedding"), hidden, out)), len(hidden[0]))


def label_of_most(nodes: pa.Table, first: np.ndarray, places: np.ndarray, made: np.ndarray) -> list[pa.Array]:
    """A fold of graph.grid_walks: the label of most of a walk's nodes, the first met of equals."""
    held = nodes.column("label").combine_chunks().take(pa.array(first)).dictionary_encode()
    code = np.append(held.indices.fill_null(-1).to_numpy(zero_copy_only=False), -1)[places]
    best, count, since = np.full(len(code), -1), np.zeros(len(code), np.int64), np.full(len(code), code.shape[1])
    for k in range(len(held.dictionary)):
        hit = code == k
        n, at = hit.sum(1), hit.argmax(1)
        more = (n > count) | ((n == count) & (n > 0) & (at < since))
        best, count, since = np.where(more, k, best), np.where(more, n, count), np.where(more, at, since)
    return [held.dictionary.take(pa.array(best, mask=best < 0))]


def walk_means(
    nodes: DataFrame, starts: DataFrame, vectors: DataFrame, on: str, width: int, weight: Column | None = None, positions: bool = False, head: bool = False, bounce: bool = False, keep: Sequence[str] = (), flat: bool = True
) -> DataFrame:
    """(walk_id, dim, value): the means over the walks from starts of the vectors (on, vector) of their nodes (wsi_id, node_id, c, r,
    and the column named by on), weighted or not, with positional_encoding added or not. With head a walk's first vector comes
    first, as dimensions of their own, and the mean is that of the others (0 where there are none).

    A step whose node has no vector, or a null one, doesn't count; where a key has several all count. Vectors travel with the nodes
    to the blocks that walks are made in, so nothing is as large as the steps. Without flat: (walk_id, vector) and the columns of starts named in keep."""
    known = vectors.filter("vector IS NOT NULL").withColumn("w_", (F.lit(1.0) if weight is None else weight).cast("double"))
    near = nodes.select("wsi_id", "node_id", "c", "r", on).join(known, on, "left").drop(on)
    rate = np.exp(-(np.arange(width) - np.arange(width) % 2) * (math.log(10000.0) / width))

    def fold(table: pa.Table, first: np.ndarray, places: np.ndarray, made: np.ndarray) -> list[pa.Array]:
        if not len(first):
            return [pa.nulls(len(made), pa.list_(pa.float64()))]
        x = _matrix(table.column("vector").combine_chunks(), width)
        w = table.column("w_").combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False)
        mass = np.append(np.add.reduceat(w, first), 0.0)
        sums = np.concatenate([np.add.reduceat(x * w[:, None], first), np.zeros((1, width))])  # the last is that of no node
        out, total = np.zeros((len(made), width)), np.zeros(len(made))
        for k in range(1 if head else 0, places.shape[1]):
            at = places[:, k]
            out += sums[at]
            total += mass[at]
            if positions:
                turn = np.where(np.arange(width) % 2 == 0, np.sin(k * rate), np.cos(k * rate))
                out += mass[at][:, None] * turn
        out /= np.where(total > 0, total, 1.0)[:, None]
        none = total <= 0
        if head:
            begun = np.maximum.reduceat(np.where(w[:, None] > 0, x, -np.inf), first)
            begun = np.concatenate([begun, np.full((1, width), -np.inf)])[places[:, 0]]
            none &= mass[places[:, 0]] <= 0
            out = np.concatenate([begun, out], 1)
        ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        values = pa.array(out.ravel(), mask=np.isneginf(out.ravel())) if head else pa.array(out.ravel())
        return [pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(none))]

    got = graph.grid_walks(near, starts, bounce, keep=keep, carry=("vector", "w_"), fold=fold, folded="vector array<double>")
    if not flat:
        return got.select("walk_id", *keep, "vector")
    return got.select("walk_id", F.posexplode("vector").alias("dim", "value")).withColumn("dim", F.col("dim").cast("long"))


def valid_mask(length: Column, most: Column, head: bool = True) -> Column:
    """Which of the places of a padded sequence count, as booleans: those before its end, and the head token before all."""
    places = F.sequence(F.lit(0), most.cast("int") - (0 if head else 1))
    return F.transform(places, lambda i: i < length + (1 if head else 0))


def pool(steps: DataFrame, mode: str, hidden: Sequence[Sequence[float]] | None = None, out: Sequence[float] | None = None, width: int | None = None) -> DataFrame:
    """(walk_id, dim, value) of steps (walk_id, pos, embedding), pos 0 being the head token: its embedding (cls), the mean
    of the others (mean; 0 for a walk without any), both one after the other (concat), or their attention pool (attention)."""
    if mode == "attention":
        return attention_pool(steps.filter("pos > 0"), hidden, out)
    if mode not in ("cls", "mean", "concat"):
        raise ValueError(f"unknown mode {mode!r}: cls, mean, concat or attention")
    wide = steps.select("walk_id", "pos", "embedding")
    head = wide.filter("pos = 0").select("walk_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value")).withColumn("dim", F.col("dim").cast("long"))
    if mode == "cls":
        return head
    rest = mean_vectors(wide.filter("pos > 0"), width=width)
    alone = wide.groupBy("walk_id").agg(F.max("pos").alias("last"), F.max(F.size("embedding")).alias("dims")).filter("last = 0")
    rest = rest.unionByName(alone.select("walk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dims").cast("long") - 1)).alias("dim"), F.lit(0.0).alias("value")))
    if mode == "mean":
        return rest
    dims = wide.filter("pos = 0").select("walk_id", F.size("embedding").cast("long").alias("dims"))
    return head.unionByName(rest.join(dims, "walk_id").select("walk_id", (F.col("dim") + F.col("dims")).alias("dim"), "value"))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-ln softmax(logits)[target]."""
    x = F.transform(logits, lambda v: v.cast("double"))
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.ln(total) + top - F.get(x, target)


def weighted_cross_entropy(items: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: the mean loss of (logits, label_id) under the weights (label_id, weight) of the classes."""
    both = items.join(F.broadcast(weights.select("label_id", "weight")), "label_id")  # a row for each class
    loss = cross_entropy(F.col("logits"), F.col("label_id"))
    return both.agg((F.sum(F.col("weight") * loss) / F.sum("weight")).alias("loss"))


def epoch_loss(batches: DataFrame) -> DataFrame:
    """(epoch, loss): the mean of (epoch, loss, n), each batch counting as often as it has rows."""
    return batches.groupBy("epoch").agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


def mode_label(items: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the smallest."""
    n = items.groupBy(*keys, value).agg(F.count("*").alias("n_"))
    return n.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n_"), F.col(value))).alias(value))


def region_holdout(regions: DataFrame, per_class: int = 1, train: float = 0.70, val: float = 0.15, seed: int = config.SEED) -> DataFrame:
    """Adds split to regions (wsi_id, label, root): of each label so many, drawn by hash, are test; the rest train and val."""
    h = draw(F.lit(str(seed)), F.concat_ws(":", F.col("wsi_id").cast("string"), "label", F.col("root").cast("string")))
    k = F.row_number().over(Window.partitionBy("label").orderBy(h, "wsi_id", "root"))
    n = F.count("*").over(Window.partitionBy("label"))
    ranked = regions.withColumn("k_", k).withColumn("n_", n)
    upto = per_class + F.bround((F.col("n_") - per_class) * F.lit(val / (train + val)))
    return ranked.withColumn("split", F.when(F.col("k_") <= per_class, "test").when(F.col("k_") <= upto, "val").otherwise("train")).drop("k_", "n_")


def holdout_walks(walks: DataFrame, per_class: int | Mapping[str, int] = 1, train: float = 0.70, val: float = 0.15, seed: int = config.SEED) -> DataFrame:
    """Adds split to walks (label, label_id, region_key): of each label so many regions, drawn by hash and all of them if
    there are fewer, are test with all of their walks; per_class may name labels, and `default` for the others.

    The other regions go to train and val, each region whole: by the label_id that most of its walks have (of equal ones
    the smallest), or all together where some label_id has one region only."""
    if "region_key" not in walks.columns:
        raise ValueError("walks need a region_key")
    h = draw(F.lit(str(seed)), F.col("region_key"))
    per = walks.groupBy("label", "region_key").agg(F.count("*").alias("n_walks")).withColumn("h_", h)  # a row for each region
    if isinstance(per_class, Mapping):
        named = [F.when(F.col("label") == k, F.lit(v)) for k, v in per_class.items() if k != "default"]
        most = F.coalesce(*named, F.lit(per_class.get("default", 1)))
    else:
        most = F.lit(per_class)
    k = F.row_number().over(Window.partitionBy("label").orderBy("h_", "region_key"))
    test = per.withColumn("k_", k).filter(F.col("k_") <= most).select("region_key").distinct()
    rest = mode_label(walks.join(test, "region_key", "left_anti"), ["region_key"], "label_id").withColumn("h_", h)
    fewest = rest.groupBy("label_id").agg(F.count("*").alias("c")).agg(F.min("c").alias("fewest"))
    rest = rest.join(F.broadcast(fewest)).withColumn("stratum", F.when(F.col("fewest") >= 2, F.col("label_id")).otherwise(-1))  # one row
    stratum = Window.partitionBy("stratum")
    rest = rest.withColumn("k_", F.row_number().over(stratum.orderBy("h_", "region_key"))).withColumn("n_", F.count("*").over(stratum))
    upto = F.bround(F.col("n_") * F.lit(val / (train + val)))
    parts = rest.select("region_key", F.when(F.col("k_") <= upto, "val").otherwise("train").alias("split")).unionByName(test.withColumn("split", F.lit("test")))
    return walks.join(parts, "region_key")


def walk_report(made: DataFrame, capacity: DataFrame, most: int | None = None) -> DataFrame:
    """Per label: target, produced walks, how often they visit a node on average, and what held their number down.

    made (label, got) has the walks accepted in each region; most is the absolute number of walks a class may have. Where
    fewer walks than the capacity were produced, the first limit that the target equals is named: tissue (the capacity),
    ratio (the imbalance ceiling), absolute."""
    made = made.groupBy("label").agg(F.sum("got").alias("produced"))
    length = (config.WALK_MIN + config.WALK_MAX) / 2
    both = capacity.join(made, "label", "left").withColumn("produced", F.coalesce("produced", F.lit(0)))
    target = F.col("target") if most is None else F.least("target", F.lit(most))
    reason = F.when(F.col("produced") >= F.col("capacity"), F.lit("none")).when(target == F.col("capacity"), "tissue").when(target == F.col("target"), "ratio").otherwise("absolute")
    return both.select("label", target.alias("target"), "produced", (F.col("produced") * length / F.col("n_nodes")).alias("redundancy"), reason.alias("limited_by"))


def most_attempts(quota: Column) -> Column:
    """Ten tries for each walk of a region's quota, and ten at least."""
    return F.greatest(10 * quota, F.lit(10)).cast("long")


def attempts(nodes: DataFrame, quotas: DataFrame, seed: str = "attempt") -> DataFrame:
    """(wsi_id, walk_id, start, length, label, root, attempt, quota), and (c, r) where nodes have them: all tries that a region's
    quota may take.

    nodes has (wsi_id, node_id, label, root), quotas (wsi_id, label, root, n_nodes, quota). Starts and lengths are md5
    draws of region and attempt."""
    whole = quotas.filter("quota > 0").withColumn("since", F.lit(0).cast("long")).withColumn("until", most_attempts(F.col("quota")))
    return attempts_between(nodes, whole, seed)


def attempts_between(nodes: DataFrame, ranges: DataFrame, seed: str = "attempt") -> DataFrame:
    """The attempts of ranges (wsi_id, label, root, n_nodes, quota, since, until), until excluded."""
    region = F.concat_ws(":", F.col("wsi_id").cast("string"), "label", F.col("root").cast("string"))
    # A plan has a row for each region but tries by the million: they are made in many tasks, and joined by sorting, as a planner
    # that goes by the plan's size would gather them on the driver to send them to all tasks.
    parts = F.sequence(F.expr(f"since div {graph.PART}"), F.expr(f"(until - 1) div {graph.PART}"))
    tries = ranges.filter("since < until").select("*", F.explode(parts).alias("part_"))
    tries = tries.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "wsi_id", "label", "root", "part_")
    low, high = F.greatest("since", F.col("part_") * graph.PART), F.least("until", (F.col("part_") + 1) * graph.PART)
    tries = tries.select("*", F.explode(F.sequence(low, high - 1)).alias("attempt")).drop("part_")
    name = F.concat_ws(":", region, F.col("attempt").cast("string"))
    tries = tries.withColumn("place", draw(F.lit(seed), name) % F.col("n_nodes"))
    tries = tries.withColumn("length", config.WALK_MIN + draw(F.lit("length"), name) % (config.WALK_MAX - config.WALK_MIN + 1))
    tile = [x for x in ("c", "r") if {"c", "r"} <= set(nodes.columns)]
    ranked = rank_by_parts(nodes.select("wsi_id", "label", "root", "node_id", *tile), ["wsi_id", "label", "root"], F.expr(f"node_id div {graph.PART}"), ["node_id"])
    placed = ranked.select("wsi_id", "label", "root", "node_id", *tile, (F.col("k_") - 1).cast("long").alias("place"))
    out = tries.hint("merge").join(placed, ["wsi_id", "label", "root", "place"])
    walk_id = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")  # 60 bits, which any engine makes alike
    return out.select("wsi_id", walk_id.alias("walk_id"), F.col("node_id").alias("start"), F.col("length").cast("long").alias("length"), "label", "root", "attempt", "quota", *tile)


_TRY = ("walk_id", "start", "length")


def accept(walks: DataFrame, tries: DataFrame, least: int = config.WALK_MIN) -> DataFrame:
    """The first walks of each region, up to its quota, that are long enough and no earlier walk either way round, with
    walk_id, start and length of their tries. walks that have the tries' columns (see tile_walks) are not joined with them."""
    return _first_distinct(_long_enough(walks, tries, least)).select("wsi_id", "label", "root", "attempt", *_TRY, "path")


def tile_walks(nodes: DataFrame, tries: DataFrame, bounce: bool, same_label: bool = True) -> DataFrame:
    """Walks of tries over tiles, with the tries' columns."""
    return graph.grid_walks(nodes, tries, bounce, same_label, keep=("label", "root", "attempt", "quota"))


def _long_enough(walks: DataFrame, tries: DataFrame, least: int) -> DataFrame:
    if "attempt" in walks.columns:
        return walks.filter(F.size("path") >= least)
    # A start is in one region, so tries that share an id are told apart, or are the same walk.
    same = ["wsi_id", "walk_id", "start", "length"]
    w = walks.filter(F.size("path") >= least).select(*same, "path")
    return w.join(tries.select(*same, "label", "root", "attempt", "quota"), same)


def _first_distinct(w: DataFrame) -> DataFrame:
    # One way round of a path travels, with a sign of which.
    w = w.withColumn("canonical", F.least("path", F.reverse("path"))).withColumn("turned", F.col("path") != F.col("canonical"))
    first = w.groupBy("wsi_id", "label", "root", "quota", "canonical").agg(F.min(F.struct("attempt", "turned", *_TRY)).alias("f"))
    path = F.when(F.col("f.turned"), F.reverse("canonical")).otherwise(F.col("canonical"))
    first = first.select("wsi_id", "label", "root", "quota", "f.attempt", *(f"f.{x}" for x in _TRY), path.alias("path"))
    k = F.row_number().over(Window.partitionBy("wsi_id", "label", "root").orderBy("attempt"))
    return first.withColumn("k", k).filter("k <= quota")


def balanced_walks(spark: SparkSession, edges: DataFrame | None, nodes: DataFrame, sizes: DataFrame, bounce: bool, least: int = config.WALK_MIN) -> tuple[DataFrame, DataFrame]:
    """(walks, made) of the whole balanced allocation: walks (wsi_id, label, root, attempt, path) and per region made
    (wsi_id, label, root, quota, tried, got).

    What a region does not yield in ten tries a walk is shared among the later regions of its label. Each round takes
    the regions at their word that are not through yet, makes the walks that this needs, and counts; it ends when no
    region has tries left that it needs and all allocations rest on counts. edges lead to nodes of the same label; without them
    nodes are tiles (c, r), and walks go to neighbours of the same label. walks have walk_id, start and length of their tries, too."""
    region = ["wsi_id", "label", "root"]
    walked: DataFrame | None = None
    made: DataFrame | None = None
    alloc, quota, tried = F.col("alloc"), F.col("quota"), F.col("tried")
    limit = most_attempts(alloc)
    while True:
        plan = graph.balanced_allocation(sizes, made).select(*region, "n_nodes", "alloc")
        if made is None:
            plan = plan.withColumns({"quota": F.lit(0).cast("long"), "tried": F.lit(0).cast("long"), "got": F.lit(0).cast("long")})
        else:
            plan = plan.join(made, region)
        through = (alloc == quota) & ((F.col("got") >= alloc) | (tried >= limit))
        # A quarter more tries than walks at first, then twice as many as before: most regions need few.
        more = F.least(limit, F.greatest(alloc + F.expr("alloc div 4") + 10, F.when(alloc == quota, 2 * tried).otherwise(0)))
        plan = cut(spark, plan.withColumn("through", through).withColumn("until", F.when(through, tried).otherwise(F.greatest(tried, more))), "plan")
        if made is not None and plan.filter("NOT through").isEmpty():
            break
        tries = attempts_between(nodes, plan.select(*region, "n_nodes", F.col("alloc").alias("quota"), F.col("tried").alias("since"), "until"))
        tries = cut(spark, tries, "attempts")
        made_now = tile_walks(nodes, tries, bounce) if edges is None else graph.walks(edges, tries, bounce)
        fresh = cut(spark, _long_enough(made_now, tries, least).select(*region, "attempt", *_TRY, "path"), "walked")
        walked = fresh if walked is None else walked.unionByName(fresh)
        now = plan.select(*region, F.col("alloc").alias("quota"), F.col("until").alias("tried"))
        kept = _first_distinct(walked.join(now, region).filter(F.col("attempt") < most_attempts(quota)))
        kept = cut(spark, kept.select(*region, "attempt", *_TRY, "path"), "kept")
        counts = kept.groupBy(*region).agg(F.count("*").alias("got"))
        made = cut(spark, now.join(counts, region, "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))), "made")
    return kept, made
