"""Stages that take in new slides as they come: files of index rows in, rows of work out, each once.

A stream of files is read batch by batch. What a batch makes is written to a folder of its own, named by the batch's number,
in place of what an earlier try of the same batch left there; a batch is done when its folder says so. Spark's checkpoint
holds which files belong to which batch, so a run that dies is taken up at the batch that it died in, with the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import store

Work = Callable[[DataFrame], DataFrame]


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def done(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that are whole."""
    where, system = _folder(spark, path)
    if not system.exists(where):
        return []
    names = {s.getPath().getName(): s.getPath() for s in system.listStatus(where)}
    whole = (n for n, p in names.items() if n.startswith("batch=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
    return sorted(int(n.removeprefix("batch=")) for n in whole)


def read(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """What the whole batches made (those of smaller numbers than below, where it is given); None if there is none. What a
    run that died left behind is not read."""
    batches = [b for b in done(spark, path) if below is None or b < below]
    return spark.read.parquet(*(f"{path}/batch={b}" for b in batches)) if batches else None


def take_in(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, work: Work, key: Sequence[str] = ("global_idx",), files: int = 1000, after: Callable[[int], None] | None = None) -> int:
    """Work on all files of index rows (Parquet, of that schema) in the folder source that no run has worked on before, at
    most so many to a batch, and give how many batches there are in all.

    work turns rows of the index into rows that keep the key. Rows whose key an earlier batch has made are left out, and so
    are all but one of those that a batch has twice, so that a slide that is delivered again changes nothing. Rows of null
    keys are left out too. after is called with the number of each batch that was written."""

    def run(batch: DataFrame, number: int) -> None:
        rows = batch.dropna(subset=list(key)).dropDuplicates(list(key))
        before = read(spark, path, number)
        if before is not None:
            rows = rows.join(before.select(*key), list(key), "left_anti")
        work(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if after:
            after(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done(spark, path))


def progress(spark: SparkSession, index: DataFrame, path: str, key: str = "global_idx") -> DataFrame:
    """Per slide of the index n, todo and done_share, by what the whole batches have made."""
    held = read(spark, path)
    return store.completion(index, held if held is not None else index.select(F.col(key)).limit(0), key)
