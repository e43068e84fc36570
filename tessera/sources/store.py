"""Saved walks, and stages that go on where they stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph, sequences


def save_walks(walks: DataFrame, path: str) -> None:
    walks.write.mode("overwrite").parquet(path)


def load_walks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _meta(index: DataFrame, extra: dict[str, str]) -> DataFrame:
    more = [F.lit(str(v)).alias(f"extra_{k}") for k, v in sorted(extra.items())]
    return graph.fingerprint(index).select("wsi_id", "n", "sha256", *more)


def write_meta(index: DataFrame, path: str, **extra: object) -> None:
    """What a stage's output was made from: a fingerprint of each slide's rows of the index, and settings."""
    _meta(index, extra).write.mode("overwrite").parquet(path)


def is_valid(spark: SparkSession, index: DataFrame, path: str, **extra: object) -> bool:
    """Whether write_meta at path was of the same index and settings; false where nothing is written."""
    try:
        held = spark.read.parquet(path)
    except AnalysisException:
        return False
    now = _meta(index, extra)
    if set(held.columns) != set(now.columns):
        return False
    held = held.select(*now.columns)
    return held.exceptAll(now).isEmpty() and now.exceptAll(held).isEmpty()


def todo(spark: SparkSession, index: DataFrame, path: str, key: str = "global_idx") -> DataFrame:
    """Rows of the index whose key is not yet in the output at path."""
    try:
        done = spark.read.parquet(path).select(key)
    except AnalysisException:
        return index
    return index.join(done, key, "left_anti")


def materialise(spark: SparkSession, index: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], meta_path: str, **extra: object) -> None:
    """Add work(rows) for the rows of the index that path lacks. Output of another index or other settings is replaced.

    work keeps global_idx and wsi_id. An append is committed whole, so a run that dies leaves no half-written rows."""
    if is_valid(spark, index, meta_path, **extra):
        work(todo(spark, index, path)).write.mode("append").partitionBy("wsi_id").parquet(path)
        return
    write_meta(index.limit(0), meta_path)  # nothing is valid while the old output goes
    work(index).write.mode("overwrite").partitionBy("wsi_id").parquet(path)
    write_meta(index, meta_path, **extra)


# --- stores that have to be whole before they are read ------------------------------------------------------------


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no {what} at {path}; make them first") from e


def require_all(index: DataFrame, done: DataFrame, what: str, key: str = "global_idx") -> None:
    """An error if rows of the index are missing in done, or done has rows that the index lacks or has twice."""
    n, held = index.count(), done.agg(F.count("*").alias("n"), F.countDistinct(key).alias("keys")).first()
    missing = index.join(done.select(key), key, "left_anti").count()
    if missing:
        raise RuntimeError(f"{missing} of {n} {what} are not made yet")
    if held.n != n or held["keys"] != n:
        raise RuntimeError(f"{held.n} {what} do not belong to an index of {n}: it has changed since, make them anew")


def load_patches(spark: SparkSession, path: str) -> DataFrame:
    """The patches made so far (global_idx, wsi_id, and what work() made); an error if there are none."""
    return _read(spark, path, "patches")


def completion(index: DataFrame, done: DataFrame, key: str = "global_idx") -> DataFrame:
    """Per slide n, todo, and done_share."""
    both = index.select("wsi_id", key).join(done.select(key).distinct().withColumn("made_", F.lit(1)), key, "left")
    made = F.coalesce("made_", F.lit(0))
    return both.groupBy("wsi_id").agg(F.count("*").alias("n"), F.sum(1 - made).alias("todo"), F.avg(made.cast("double")).alias("done_share"))


def materialise_embeddings(spark: SparkSession, index: DataFrame, patches: str, path: str, encode: Callable[[DataFrame], DataFrame], meta_path: str, **extra: object) -> None:
    """Embeddings of all patches, rounded to half precision, going on where an earlier run stopped. All patches have to be
    made before. encode turns rows of patches into (global_idx, wsi_id, embedding)."""
    held = load_patches(spark, patches)
    require_all(index, held, "patches")

    def work(rows: DataFrame) -> DataFrame:
        return encode(held.join(rows.select("global_idx"), "global_idx", "left_semi")).withColumn("embedding", sequences.to_half("embedding"))

    materialise(spark, index, path, work, meta_path, **extra)


def load_embeddings(spark: SparkSession, index: DataFrame, path: str, dim: int) -> DataFrame:
    """The embeddings of a whole index; errors if there are none, if they belong to another index or are incomplete, or
    if one is not of that dimension."""
    held = _read(spark, path, "embeddings")
    require_all(index, held, "embeddings")
    wrong = held.filter(F.col("embedding").isNull() | (F.size("embedding") != dim)).count()
    if wrong:
        raise RuntimeError(f"{wrong} embeddings are not of dimension {dim}")
    return held


def require_rasters(spark: SparkSession, index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(wsi_id, raster) of the slides of the index; a slide without one is an error."""
    slides = index.select("wsi_id").distinct()
    missing = [r[0] for r in slides.join(pairs, "wsi_id", "left_anti").limit(10).collect()]
    if missing:
        raise FileNotFoundError(f"no raster for slides {missing}")
    return pairs.join(slides, "wsi_id", "left_semi").select("wsi_id", "raster")


# --- tables of training runs and of class counts, as CSV -----------------------------------------------------------

HISTORY = "epoch long, lr double, tr_loss double, tr_acc double, tr_f1w double, va_loss double, va_acc double, va_f1w double, va_f1m double, va_bacc double"
PREDICTIONS = "y_true int, y_pred int"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; its columns may stand in any order, and those that the schema lacks are left out."""
    held = spark.read.option("header", "true").csv(path)
    kinds = spark.createDataFrame([], schema).schema
    return held.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds))


def training_curves(history: DataFrame) -> DataFrame:
    """(epoch, measure, part, value) of a history, for drawing; measures that it lacks are left out."""
    names = [(m, p, f"{p}_{m}") for p in ("tr", "va") for m in ("loss", "acc", "f1w", "f1m", "bacc") if f"{p}_{m}" in history.columns]
    points = F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(p).alias("part"), F.col(c).cast("double").alias("value")) for m, p, c in names))
    return history.select("epoch", F.explode(points).alias("p")).select("epoch", "p.measure", "p.part", "p.value")
