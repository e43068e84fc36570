"""Column functions and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def draw(*parts: Column | str) -> Column:
    """A 32-bit number that depends on the texts of its parts alone, and is the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which ends its lineage."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what cut() wrote for frames that nothing reads any more."""
    for df in frames:
        where = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rank_by_parts(rows: DataFrame, group: Sequence[str], part: Column, order: Sequence[Column | str], rank: str = "k_", total: str = "n_") -> DataFrame:
    """Adds the place of each row in its group, from 1, and the group's size.

    part is a number that never falls along the order. Rows of one part of a group are put in order together, and what
    comes before a part is a sum over a small table of parts: no task sorts a whole group, however large."""
    parted = rows.withColumn("part_", part)
    own = [F.col(g).alias(f"{g}_of_part") for g in group]
    sums = parted.groupBy(*own, F.col("part_").alias("part_of_part")).agg(F.count("*").alias("held_"))
    whole = Window.partitionBy(*(f"{g}_of_part" for g in group))  # a row for each part
    upto = whole.orderBy("part_of_part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("before_", F.sum("held_").over(upto) - F.col("held_")).withColumn(total, F.sum("held_").over(whole))
    same = F.col("part_").eqNullSafe(F.col("part_of_part"))
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_of_part"))
    both = parted.join(sums, same).drop("part_of_part", "held_", *(f"{g}_of_part" for g in group))
    place = F.row_number().over(Window.partitionBy(*group, "part_").orderBy(*order))
    return both.withColumn(rank, F.col("before_") + place).drop("before_", "part_")
