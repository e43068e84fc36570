"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources in code point order, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words. A source stops at
``MAX_EPOCHS`` times its words; the excess goes to the others by weight until none is above (each round of the water
level is one small aggregate over the table of sources). A source then takes each document ``floor(target / words)``
times whole, and once more the documents with the smallest seeded hashes, up to its remaining words: the document at
the edge is taken if at least half of it fits, so a source misses its target by half a document at most.

The edge is found by two histogram passes over the hash (4,096 buckets a source each, summed before they are
shuffled), so no task ever sorts a whole source; only the documents of one bucket in 2**24 are put in order.

Null texts have 0 words, null sources are one source, null doc_ids hash as empty text. Repeated rows of one doc_id
are separate documents; those with the same text are put in order by chance, which changes no result. Very long texts
count whole. An empty table gives an empty mix. Other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(doc_id: Column, text: Column, seed: str) -> Column:
    """Of doc_id and text, so that neither many rows without an id nor many copies of a text share one."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("long")


def _weighted(spark: SparkSession, sized: DataFrame) -> DataFrame:
    """Per source its words and weight, by a sort that any number of tasks share."""
    order = F.col("source").asc_nulls_last()
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = totals.repartitionByRange(8, order).withColumn("part", F.spark_partition_id())
    ranged = common.cut(spark, ranged, "mix-sources")
    base, start = [], 0
    for part, n in sorted(map(tuple, ranged.groupBy("part").count().collect())):  # one row a part
        base.append((part, start))
        start += n
    bases = spark.createDataFrame(base or [(0, 0)], "part int, base long")
    rank = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS)).cast("int") + 1)
    return ranged.join(F.broadcast(bases), "part").select("source", "source_size", weight.cast("double").alias("weight"))


def water_fill(sources: DataFrame, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target to (source, source_size, weight)."""
    cap = F.col("source_size") * epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        under = cap < F.lit(level) * F.col("weight")
        spent, weight, n = sources.agg(
            F.sum(F.when(under, cap)), F.sum(F.when(~under, F.col("weight"))), F.count_if(under)
        ).first()
        if n == clamped or not weight:
            break
        clamped, level = n, (share * total - (spent or 0)) / weight
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def _cross(bucketed: DataFrame, keys: list[str], bucket: str, goal: str) -> DataFrame:
    """The bucket of each group of keys in which the running sum of sizes reaches the goal, and what is left of it there."""
    sums = bucketed.groupBy(*keys, goal, bucket).agg(F.sum("size").alias("held"))
    to = F.sum("held").over(Window.partitionBy(*keys).orderBy(bucket))
    sums = sums.withColumn("to", to)
    return sums.filter((F.col("to") - F.col("held") < F.col(goal)) & (F.col("to") >= F.col(goal))).select(
        *keys, F.col(bucket).alias(f"edge_{bucket}"), (F.col(goal) - F.col("to") + F.col("held")).alias(f"left_{bucket}")
    )


def mix(spark: SparkSession, docs: DataFrame, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, times, and the columns named in keep as kept_<name>."""
    keys = [F.col(c).alias(f"kept_{c}") for c in keep]
    h = _hash(F.col("doc_id"), F.col("text"), seed)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), h.alias("h"), *keys)
    narrow = common.cut(spark, sized.select("doc_id", "source", "size", "h"), "mix-sizes") if not keep else common.cut(spark, sized, "mix-sizes")
    sources = common.cut(spark, water_fill(_weighted(spark, narrow)), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.select("source", "source_size", "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("goal"))

    def on_source(rows: DataFrame, table: DataFrame, *more: str) -> DataFrame:
        t = table.withColumnRenamed("source", "s")
        same = F.col("source").eqNullSafe(F.col("s"))
        for c in more:
            same = same & F.col(c).eqNullSafe(F.col(f"e_{c}"))
        return rows.join(t, same, "left").drop("s")

    high, low = F.shiftright("h", 36), F.shiftright("h", 24) % 4096
    rows = on_source(narrow.withColumn("high", high).withColumn("low", low), sources)
    edges = common.cut(spark, _cross(rows, ["source"], "high", "goal"), "mix-edges")
    near = on_source(rows, edges).filter(F.col("high") == F.col("edge_high"))
    finer = common.cut(spark, _cross(near, ["source"], "low", "left_high"), "mix-finer")
    rows = on_source(on_source(rows, edges), finer)
    at_edge = (F.col("high") == F.col("edge_high")) & (F.col("low") == F.col("edge_low"))
    before = F.coalesce(F.col("high") < F.col("edge_high"), F.lit(False)) | F.coalesce(
        (F.col("high") == F.col("edge_high")) & (F.col("low") < F.col("edge_low")), F.lit(False)
    )
    rows = rows.withColumn("at_edge", F.coalesce(at_edge, F.lit(False)))
    clear = rows.filter(~F.col("at_edge")).withColumn("more", before)
    run = F.sum("size").over(Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = rows.filter("at_edge").withColumn("more", run - F.col("size") / 2 < F.col("left_low"))
    times = (F.col("whole") + F.col("more").cast("long")).cast("long")
    return clear.unionByName(edge).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"), *(f"kept_{c}" for c in keep)
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM d GROUP BY source),
l AS (SELECT *, 2 * source_size / w AS cap_at, sum(2 * source_size) OVER o AS capped, sum(w) OVER () - sum(w) OVER o AS w_left, sum(w) OVER () AS w_all, 1.5 * sum(source_size) OVER () AS budget
    FROM s WINDOW o AS (ORDER BY 2 * source_size / w, source ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, lag(capped, 1, 0) OVER p AS was_capped, coalesce(lag(w_left, 1) OVER p, w_all) AS was_left FROM l WINDOW p AS (ORDER BY cap_at, source)),
f AS (SELECT CAST(arg_min((budget - was_capped) / was_left, (cap_at, source)) AS DOUBLE) AS level FROM c WHERE cap_at * was_left >= budget - was_capped),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), coalesce(level, 0) * w) AS target FROM s, f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS k FROM t),
r AS (SELECT d.*, g.source_size, g.target, g.k, g.target - g.k * g.source_size AS goal,
    sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
    size * (k + CASE WHEN source_size > 0 AND upto - size / 2 < goal THEN 1 ELSE 0 END) AS taken FROM r
"""


def repeat(spark: SparkSession, docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    columns = docs.columns
    mixed = mix(spark, docs, seed, tuple(columns)).filter("times > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return copies.select(*(F.col(f"kept_{c}").alias(c) for c in columns))
