"""Node index, label filters, fingerprints and same-label regions."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from tessera import config
from tessera.functions import cut, discard, draw, rank_by_parts
from tessera.operators import grid

#: A block of tiles that one task joins up: at most BLOCK * BLOCK nodes, whatever a slide holds.
BLOCK = 64
#: A block of starts that one task walks from; with a margin of the longest walk on all sides.
WALK_BLOCK = 128
#: Walks that take their steps together.
TOGETHER = 8192
#: Neighbouring node_ids that are put in order together, and rows of an index that are hashed together.
PART, CHUNK = 4096, 1024


def number_nodes(tiles: DataFrame) -> DataFrame:
    """Adds node_id: dense from 0 in each slide, by column, then row."""
    ranked = rank_by_parts(tiles, ["wsi_id"], F.col("c"), ["c", "r"])
    return ranked.withColumn("node_id", (F.col("k_") - 1).cast("long")).drop("k_", "n_")


def drop_label(nodes: DataFrame, label: str = "no_Tissu") -> DataFrame:
    return nodes.filter(F.col("label") != label)


def one_slide(spark: SparkSession, nodes: DataFrame, wsi_id: object = None) -> DataFrame:
    """The nodes of the slide of that name, or of the first in order of names; an unknown name is an error that lists the known ones."""
    names = [r[0] for r in nodes.select("wsi_id").distinct().orderBy("wsi_id").collect()]  # slides
    if wsi_id is None and names:
        wsi_id = names[0]
    if wsi_id not in names:
        raise ValueError(f"no slide {wsi_id!r}; there are {names}")
    return nodes.filter(F.col("wsi_id") == F.lit(wsi_id))


def node_index(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Adds global_idx, dense over slides in order of wsi_id and node_id, and label_id (unknown labels: 0)."""
    counts = nodes.groupBy("wsi_id").count()
    before = Window.orderBy("wsi_id").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slide
    base = counts.select("wsi_id", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = rank_by_parts(nodes, ["wsi_id"], F.expr(f"node_id div {PART}"), ["node_id"])
    labels = spark.createDataFrame(list(config.LABELS.items()), "label string, label_id int")
    out = ranked.join(base, "wsi_id").withColumn("global_idx", F.col("base") + F.col("k_") - 1).drop("base", "k_", "n_")
    return out.join(F.broadcast(labels), "label", "left").withColumn("label_id", F.coalesce("label_id", F.lit(0)))


def fingerprint(index: DataFrame) -> DataFrame:
    """Per slide n and sha256 over px and py in order of global_idx.

    Any number of tasks share a slide: each CHUNK of neighbouring global_idx is hashed by itself, and the slide's hash is
    that of its chunks' hashes in order. It tells the same changes as one hash over all rows, but is another number."""
    listed = F.expr("sha2(listagg(concat_ws('|', px, py), ',') WITHIN GROUP (ORDER BY global_idx), 256)")
    chunks = index.groupBy("wsi_id", F.expr(f"global_idx div {CHUNK}").alias("chunk")).agg(F.count("*").alias("n"), listed.alias("sha"))
    return chunks.groupBy("wsi_id").agg(F.sum("n").alias("n"), F.expr("sha2(listagg(sha, ',') WITHIN GROUP (ORDER BY chunk), 256)").alias("sha256"))


def _block_roots(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least node_id of each same-label region inside one block."""
    at = {(c, r): i for i, (c, r) in enumerate(zip(pdf["c"], pdf["r"], strict=True))}
    label, ids = pdf["label"].tolist(), pdf["node_id"].tolist()
    up = list(range(len(ids)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for (c, r), i in at.items():
        for dc, dr in config.NEIGHBOURS[c % 2]:
            j = at.get((c + dc, r + dr))
            if j is not None and label[i] == label[j]:
                a, b = find(i), find(j)
                if a != b:
                    up[max(a, b, key=ids.__getitem__)] = min(a, b, key=ids.__getitem__)
    return pdf.assign(root=[ids[find(i)] for i in range(len(ids))])


def regions(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Adds root to nodes: the least node_id of the same-label region. Blocks are joined up in tasks of bounded size;
    the few roots on block borders are then joined by least labels and pointer jumps, each round written out."""
    n = nodes.select("wsi_id", "node_id", "c", "r", "label")
    block = n.withColumn("bc", F.floor(F.col("c") / BLOCK)).withColumn("br", F.floor(F.col("r") / BLOCK))
    local = block.groupBy("wsi_id", "bc", "br").applyInPandas(_block_roots, "wsi_id int, node_id long, c long, r long, label string, bc long, br long, root long")
    local = cut(spark, local, "block-roots")
    # Both ends of an edge between blocks are on a border.
    border = local.filter(f"pmod(c, {BLOCK}) IN (0, {BLOCK - 1}) OR pmod(r, {BLOCK}) IN (0, {BLOCK - 1})")
    edge = grid.neighbours(spark, border.select("wsi_id", "node_id", "c", "r", "label")).filter("src_label = dst_label")
    pairs = edge.join(local.select("wsi_id", F.col("node_id").alias("src"), F.col("root").alias("a")), ["wsi_id", "src"])
    pairs = pairs.join(local.select("wsi_id", F.col("node_id").alias("dst"), F.col("root").alias("b")), ["wsi_id", "dst"])
    pairs = cut(spark, pairs.filter("a <> b").select("wsi_id", "a", "b").distinct(), "root-pairs")
    if pairs.isEmpty():
        return local.drop("bc", "br")
    top = cut(spark, pairs.groupBy("wsi_id", "a").agg(F.min("b").alias("m")).select("wsi_id", "a", F.least("a", "m").alias("top")), "tops")
    while True:
        near = pairs.join(top.withColumnRenamed("a", "b"), ["wsi_id", "b"]).groupBy("wsi_id", "a").agg(F.min("top").alias("near"))
        step = top.join(near, ["wsi_id", "a"]).withColumn("low", F.least("top", "near"))
        far = top.select("wsi_id", F.col("a").alias("low"), F.col("top").alias("far"))
        moved = step.join(far, ["wsi_id", "low"]).select("wsi_id", "a", F.least("low", "far").alias("new"), "top")
        moved = cut(spark, moved, "tops")
        done = moved.filter("new <> top").isEmpty()
        discard(spark, top)
        path, top = moved._tessera_path, moved.select("wsi_id", "a", F.col("new").alias("top"))
        top._tessera_path = path
        if done:
            discard(spark, pairs)
            break
    found = local.join(top.withColumnRenamed("a", "root"), ["wsi_id", "root"], "left")
    return found.select("wsi_id", "node_id", "c", "r", "label", F.coalesce("top", "root").alias("root"))


def region_sizes(found: DataFrame, excluded: tuple[str, ...] = config.EXCLUDED, least: int = config.MIN_REGION) -> DataFrame:
    """(wsi_id, label, component_id, root, n_nodes) of the regions of at least so many nodes; component_id counts all of a slide's label."""
    sizes = found.filter(~F.col("label").isin(*excluded)).groupBy("wsi_id", "label", "root").agg(F.count("*").alias("n_nodes"))
    order = Window.partitionBy("wsi_id", "label").orderBy("root")
    return sizes.withColumn("component_id", F.row_number().over(order) - 1).filter(F.col("n_nodes") >= least)


def class_capacity(regions_: DataFrame) -> DataFrame:
    """Per label: n_regions, n_nodes, capacity (walks at most), target (under the imbalance ceiling too)."""
    length = (config.WALK_MIN + config.WALK_MAX) / 2
    per = regions_.groupBy("label").agg(F.count("*").alias("n_regions"), F.sum("n_nodes").alias("n_nodes"))
    per = per.withColumn("capacity", F.floor(F.col("n_nodes") * config.MAX_REDUNDANCY / length))
    least = per.agg((F.min("capacity") * config.MAX_IMBALANCE).alias("ceiling"))
    return per.join(F.broadcast(least)).withColumn("target", F.least("capacity", "ceiling")).drop("ceiling")  # one row


def balanced_allocation(regions_: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """Adds region_key, size_rank and alloc (walks of each region): large regions first, in proportion to what is left.

    made (wsi_id, label, root, quota, got) has what regions yielded for a quota. Where a region's alloc is its quota,
    later regions of the label share what it did not yield; else a region is taken to yield its alloc."""
    targets = class_capacity(regions_).select("label", "target", F.col("n_nodes").alias("total"))
    order = Window.partitionBy("label").orderBy(F.col("n_nodes").desc(), "wsi_id", "root")
    ranked = regions_.withColumn("size_rank", F.row_number().over(order) - 1).join(targets, "label")
    if made is None:
        known = ranked.withColumn("quota", F.lit(None).cast("long")).withColumn("got", F.lit(None).cast("long"))
    else:
        known = ranked.join(made.select("wsi_id", "label", "root", "quota", "got"), ["wsi_id", "label", "root"], "left")
    folded = known.groupBy("label", "target", "total").agg(F.array_sort(F.collect_list(F.struct("size_rank", "n_nodes", "quota", "got"))).alias("rs"))  # regions, not nodes
    start = F.struct(F.col("target").alias("left"), F.col("total").alias("nodes"), F.array().cast("array<bigint>").alias("allocs"))

    def step(acc, r):
        share = F.when(acc["left"] <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(acc["left"] * r["n_nodes"] / acc["nodes"]).cast("long")))
        share = share.cast("long")
        yielded = F.when(r["quota"] == share, r["got"]).otherwise(share)
        return F.struct((acc["left"] - yielded).alias("left"), (acc["nodes"] - r["n_nodes"]).alias("nodes"), F.concat(acc["allocs"], F.array(share)).alias("allocs"))

    allocs = folded.select("label", F.aggregate("rs", start, step)["allocs"].alias("allocs"))
    allocs = allocs.select("label", F.posexplode("allocs").alias("size_rank", "alloc"))
    key = F.concat_ws("__", F.col("wsi_id").cast("string"), "label", F.col("size_rank").cast("string"))
    return ranked.join(allocs, ["label", "size_rank"]).select("wsi_id", "label", "root", "n_nodes", "size_rank", "alloc", key.alias("region_key"))


def _stepped(seed_draws: np.ndarray, length: np.ndarray, at: np.ndarray, ways: np.ndarray, bounce: bool, sharp: int, straight: int) -> tuple[np.ndarray, np.ndarray]:
    """All walks of a block step by step: paths (a row each, of places in ways) and how many steps of them count."""
    k, most = len(at), int(length.max())
    path = np.full((k, most), -1)
    path[:, 0] = at
    made, came = np.ones(k, np.int64), np.full(k, -1)
    going = np.arange(k)
    for step in range(1, most):
        going = going[step < length[going]]
        out, turn = ways[path[going, step - 1]], (np.arange(6) - came[going, None]) % 6
        begun = came[going, None] >= 0
        free = (out >= 0) & ~(begun & (turn == 3))
        weight = np.where(begun & ((turn == 2) | (turn == 4)), sharp, straight) * free
        if bounce:  # sharp turns count in full where there is nothing else, and the way back after them
            weight = np.where(weight.any(axis=1, keepdims=True), weight, free)
            weight = np.where(weight.any(axis=1, keepdims=True), weight, (out >= 0) & begun)
        upto = np.cumsum(weight, axis=1)
        free = upto[:, -1] > 0
        going, out, upto = going[free], out[free], upto[free]
        if not len(going):
            break
        pick = seed_draws[going, step - 1] % upto[:, -1]
        way = (upto <= pick[:, None]).sum(axis=1)
        path[going, step], came[going] = out[np.arange(len(going)), way], way
        made[going] = step + 1
    return path, made


def walks(edges: DataFrame, attempts: DataFrame, bounce: bool, sharp: int = 1, straight: int = 10, seed: str = "walk", most: int = config.WALK_MAX) -> DataFrame:
    """Adds path (node_ids) to attempts (wsi_id, walk_id, start, length): weighted steps without turning back. Sharp are the
    two turns next to the way back.

    edges are those of grid.neighbours, both ways, with the places (c, r) of their sources. Weights are whole numbers and
    the draw is md5 of seed, walk and step, so a walk is the same on every engine and machine. A walk that is stuck ends;
    with bounce it takes sharp turns that sharp = 0 forbids, or turns back. length is at most `most`, and a walk so never
    leaves the tiles within `most` of its start: a task has a block of starts with that margin, whatever a slide holds."""

    def block(key: tuple, near: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        if not len(todo):
            return todo[["slide", "walk_id", "start", "length"]].assign(path=pd.Series([], dtype=object))
        ids = np.union1d(near["src"].to_numpy(np.int64), todo["start"].to_numpy(np.int64))
        ways = np.full((len(ids), 6), -1)
        if len(near):
            dst = np.stack(near["ways"].to_numpy()).astype(np.int64)
            place = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
            ways[np.searchsorted(ids, near["src"].to_numpy(np.int64))] = np.where(ids[place] == dst, place, -1)
        length = todo["length"].to_numpy(np.int64)
        if length.max() > most:
            raise ValueError(f"a walk of more than {most} steps needs a wider margin")
        draws = np.zeros((len(todo), most), np.int64)
        for i, d in enumerate(todo["draws"]):
            draws[i, : len(d)] = d
        path, made = _stepped(draws, length, np.searchsorted(ids, todo["start"].to_numpy(np.int64)), ways, bounce, sharp, straight)
        return todo.assign(path=[ids[p[:n]] for p, n in zip(path, made, strict=True)])[["slide", "walk_id", "start", "length", "path"]]

    ways = F.array(*(F.coalesce(F.max(F.when(F.col("dir") == d, F.col("dst"))), F.lit(-1)) for d in range(6)))
    near = edges.groupBy(F.col("wsi_id").alias("graph"), "src", F.col("src_c").alias("c"), F.col("src_r").alias("r")).agg(ways.alias("ways"))
    for x in "cr":
        low, high = F.floor((F.col(x) - most) / BLOCK), F.floor((F.col(x) + most) / BLOCK)
        near = near.withColumn(f"b{x}", F.explode(F.sequence(low, high)))
    at = edges.select(F.col("wsi_id").alias("graph"), F.col("src").alias("start"), "src_c", "src_r").distinct()
    todo = attempts.select(F.col("wsi_id").alias("slide"), "walk_id", "start", "length")
    todo = todo.join(at.withColumnRenamed("graph", "slide"), ["slide", "start"], "left")  # a start without edges is a walk by itself
    alone = {"c": F.expr(f"-2L - start div {PART}"), "r": F.lit(-2).cast("long")}  # and is worked on in blocks apart from the slide's
    draws = F.when(F.col("length") > 1, F.transform(F.sequence(F.lit(1), F.col("length").cast("int") - 1), lambda i: draw(F.lit(seed), F.col("walk_id").cast("string"), i.cast("string"))))
    todo = todo.select("slide", "walk_id", "start", "length", *(F.coalesce(F.floor(F.col(f"src_{x}") / BLOCK), alone[x]).alias(f"t{x}") for x in "cr"), F.coalesce(draws, F.array().cast("array<bigint>")).alias("draws"))
    grouped = near.select("graph", "bc", "br", "src", "ways").groupBy("graph", "bc", "br").cogroup(todo.groupBy("slide", "tc", "tr"))
    return grouped.applyInPandas(block, "slide int, walk_id long, start long, length long, path array<long>").withColumnRenamed("slide", "wsi_id")


# --- walks over tiles -------------------------------------------------------------------------------------------

_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def _md5_head(words: list[np.ndarray | np.uint32], n: int) -> np.ndarray:
    """The first 32 bits of the md5 of n messages of one block each, given as their sixteen words."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + _SINES[i] + words[g]
        turn = _TURNS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    return (a + np.uint32(0x67452301)).byteswap()


def step_draws(seed: str, walk_id: np.ndarray, most: int) -> np.ndarray:
    """draw(seed, walk_id, step) of each walk (a row each) and step from 1 to most."""
    out = np.empty((len(walk_id), most), np.int64)
    heads = [f"{seed}:{w}:".encode() for w in walk_id.tolist()]
    wide = np.array([len(h) for h in heads], np.int64)
    for n in np.unique(wide):
        own = np.flatnonzero(wide == n)
        if n + len(str(most)) > 55:  # more than a block of md5
            for i in own:
                out[i] = [int(hashlib.md5(heads[i] + str(k).encode()).hexdigest()[:8], 16) for k in range(1, most + 1)]
            continue
        text = np.zeros((len(own), 64), np.uint8)
        text[:, :n] = np.frombuffer(b"".join(heads[i] for i in own), np.uint8).reshape(-1, n)
        for k in range(1, most + 1):
            tail = str(k).encode() + b"\x80"
            text[:, n : n + len(tail)] = np.frombuffer(tail, np.uint8)
            text[:, 56:58] = np.frombuffer((8 * (int(n) + len(tail) - 1)).to_bytes(2, "little"), np.uint8)
            words = np.ascontiguousarray(text.view("<u4").T)
            out[own, k - 1] = _md5_head([words[j] if 4 * j < n + len(tail) or j == 14 else np.uint32(0) for j in range(16)], len(own))
    return out


def _ways(c: np.ndarray, r: np.ndarray, label: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each tile the places of its six neighbours of the same label, -1 where there is none; of several tiles in one
    place the one of the largest node counts."""
    high, wide = c - c.min() + 1, r - r.min() + 1
    span = int(wide.max()) + 2
    at = (label.astype(np.int64) * (int(high.max()) + 2) + high) * span + wide
    order = np.lexsort((node, at))
    last = order[np.append(at[order][1:] != at[order][:-1], True)]
    known = at[last]
    out = np.full((len(c), 6), -1)
    for parity, ring in config.NEIGHBOURS.items():
        own = np.flatnonzero(c % 2 == parity)
        for d, (dc, dr) in enumerate(ring):
            to = at[own] + dc * span + dr
            place = np.minimum(np.searchsorted(known, to), len(known) - 1)
            out[own, d] = np.where(known[place] == to, last[place], -1)
    return out


def along(places: np.ndarray, made: np.ndarray, values: pa.Array) -> pa.ListArray:
    """For each walk the values at the places that it visits."""
    flat = places[np.arange(places.shape[1]) < made[:, None]]
    ends = np.append(0, np.cumsum(made)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values.take(pa.array(flat, mask=flat < 0)))


def grid_walks(
    nodes: DataFrame, attempts: DataFrame, bounce: bool, same_label: bool = False, sharp: int = 1, straight: int = 10, seed: str = "walk", most: int = config.WALK_MAX,
    keep: Sequence[str] = (), carry: Sequence[str] = (), fold: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]] | None = None, folded: str = "",
) -> DataFrame:
    """The walks of walks() over the tiles of nodes (wsi_id, node_id, c, r, ...), next to each other or, with same_label, of the
    same label too.

    A task has a block of starts and the nodes within `most` of it, finds their neighbours and makes the draws itself: neither
    edges nor draws are shuffled, and no step is joined with its node. Columns of attempts named in keep stay; those of nodes
    named in carry come as arrays along the path. With a fold its columns (named by the types `folded`) come in place of path
    and arrays: it gets the block's nodes in order of node_id with their carried columns (a node has several rows where nodes
    has), the first row of each, and of some walks the places on their paths (-1 after the end; nodes counted once) and lengths.

    attempts that have c and r of their starts are not joined with nodes for them."""
    named = [x for x in carry if x != "label"]
    columns = ["wsi_id", "node_id", "c", "r", *(["label"] if same_label or "label" in carry else []), *named]
    todo = attempts
    if not {"c", "r"} <= set(attempts.columns):
        todo = attempts.join(nodes.select("wsi_id", F.col("node_id").alias("start"), "c", "r").distinct(), ["wsi_id", "start"], "left")
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    schema = StructType()
    for f in todo.select("wsi_id", "walk_id", "start", "length", *keep).schema.fields:
        schema = schema.add(f.name, f.dataType)
    if fold is None:
        schema = schema.add("path", ArrayType(LongType()))
        for x in carry:
            schema = schema.add(f"path_{x}", ArrayType(kinds[x]))
    else:
        schema = StructType([*schema.fields, *StructType.fromDDL(folded).fields])
    shape = to_arrow_schema(schema)

    def block(near: pa.Table, todo: pa.Table) -> pa.Table:
        if not todo.num_rows:
            return shape.empty_table()
        near, todo = near.sort_by("node_id"), todo.rename_columns(["slide", "tc", "tr", *shape.names[: len(keep) + 4][1:]])
        node = near.column("node_id").to_numpy()
        ids, first = np.unique(node, return_index=True)
        start = todo.column("start").to_numpy()
        known, ways = len(ids), np.full((0, 6), -1)
        if known:
            one = near.take(pa.array(first)).combine_chunks()
            if same_label:
                label = one.column("label").combine_chunks().dictionary_encode()
                label = (label.chunk(0) if isinstance(label, pa.ChunkedArray) else label).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            else:
                label = np.zeros(known, np.int64)
            ways = _ways(one.column("c").to_numpy(), one.column("r").to_numpy(), label, ids)
            if same_label:
                ways[label < 0] = -1
        lost = np.setdiff1d(start, ids)  # starts that are no nodes are walks by themselves
        ways = np.concatenate([ways, np.full((len(lost), 6), -1)])
        at = np.searchsorted(ids, start)
        here = (at < known) & (ids[np.minimum(at, known - 1)] == start) if known else np.zeros(len(start), bool)
        at = np.where(here, at, known + np.searchsorted(lost, start))
        length = todo.column("length").to_numpy().astype(np.int64)
        if length.max() > most:
            raise ValueError(f"a walk of more than {most} steps needs a wider margin")
        every, walk_id, out = pa.array(np.concatenate([ids, lost])), todo.column("walk_id").to_numpy(), []
        held = todo.select(["slide", *shape.names[1 : len(keep) + 4]])
        for i in range(0, len(start), TOGETHER):
            some = slice(i, i + TOGETHER)
            draws = step_draws(seed, walk_id[some], max(int(length[some].max()) - 1, 0))
            path, made = _stepped(draws, length[some], at[some], ways, bounce, sharp, straight)
            if fold is None:
                seen = np.where(path < known, path, -1)
                got = [along(path, made, every), *(along(seen, made, one.column(x).combine_chunks() if known else pa.nulls(1, shape.field(f"path_{x}").type.value_type)) for x in carry)]
            else:
                got = fold(near, first, np.where(path < known, path, -1), made)
            rows = held.slice(i, TOGETHER).combine_chunks()
            out.append(pa.Table.from_arrays([*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in rows.columns), *got], names=shape.names).cast(shape))
        return pa.concat_tables(out)

    near = nodes.filter("c IS NOT NULL AND r IS NOT NULL AND node_id IS NOT NULL").select(*columns)
    for x in "cr":
        low, high = F.floor((F.col(x) - most) / WALK_BLOCK), F.floor((F.col(x) + most) / WALK_BLOCK)
        near = near.withColumn(f"b{x}", F.explode(F.sequence(low, high)))
    alone = {"c": F.expr(f"-2L - start div {PART}"), "r": F.lit(-2).cast("long")}
    todo = todo.select("wsi_id", *(F.coalesce(F.floor(F.col(x) / WALK_BLOCK), alone[x]).alias(f"t{x}") for x in "cr"), "walk_id", "start", "length", *keep)
    near = near.withColumnRenamed("wsi_id", "graph").groupBy("graph", "bc", "br")
    return near.cogroup(todo.withColumnRenamed("wsi_id", "slide").groupBy("slide", "tc", "tr")).applyInArrow(block, schema)
