"""Taking in slides as a stream: nothing is lost and nothing made twice, wherever a run ends."""

import pytest
from pyspark.sql import functions as F

from tessera import streaming

SCHEMA = "global_idx long, wsi_id int, px long"


def deliver(spark, folder: str, slide: int, n: int, first: int = 0) -> None:
    rows = [(slide * 1000 + k, slide, k * 7) for k in range(first, n)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


class Ended(RuntimeError):
    pass


@pytest.fixture
def place(tmp_path):
    return {"source": f"{tmp_path}/in", "path": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/state"}


def work(rows):
    return rows.select("global_idx", "wsi_id", (F.col("px") * 2).alias("made"))


def made(spark, place) -> list[int]:
    held = streaming.read(spark, place["path"])
    return sorted(r.global_idx for r in held.collect()) if held is not None else []


def test_new_slides_are_picked_up(spark, place):
    deliver(spark, place["source"], 1, 5)
    deliver(spark, place["source"], 2, 3)
    assert streaming.read(spark, place["path"]) is None
    assert streaming.take_in(spark, schema=SCHEMA, work=work, files=1, **place) == 2
    assert made(spark, place) == [1000, 1001, 1002, 1003, 1004, 2000, 2001, 2002]
    assert streaming.take_in(spark, schema=SCHEMA, work=work, files=1, **place) == 2  # nothing new
    deliver(spark, place["source"], 3, 2)
    deliver(spark, place["source"], 1, 7)  # delivered again, with two rows more
    spark.createDataFrame([(None, 9, 1), (9000, 9, 1), (9000, 9, 1)], SCHEMA).coalesce(1).write.mode("append").parquet(place["source"])
    streaming.take_in(spark, schema=SCHEMA, work=work, files=10, **place)
    assert made(spark, place) == [1000, 1001, 1002, 1003, 1004, 1005, 1006, 2000, 2001, 2002, 3000, 3001, 9000]
    index = spark.createDataFrame([(1000, 1, 0), (4000, 4, 0), (3000, 3, 0)], SCHEMA)
    assert {r.wsi_id: r.todo for r in streaming.progress(spark, index, place["path"]).collect()} == {1: 0, 4: 1, 3: 0}


@pytest.mark.parametrize("where", ["before", "during", "after"])
def test_a_run_that_ends_goes_on(spark, place, where):
    for slide in (1, 2, 3):
        deliver(spark, place["source"], slide, 4)
    calls = []

    def ends(rows):
        calls.append(1)
        if len(calls) == 2 and where == "before":
            raise Ended
        out = work(rows)
        if len(calls) == 2 and where == "during":  # a task of the second batch fails once rows are written
            out = out.withColumn("made", F.when(F.col("global_idx") % 4 == 3, F.raise_error("ended").cast("long")).otherwise(F.col("made")))
        return out

    def after(number: int) -> None:
        if number == 1 and where == "after":  # written whole, but Spark does not know yet
            raise Ended

    with pytest.raises(Exception, match="(?i)ended"):
        streaming.take_in(spark, schema=SCHEMA, work=ends, files=1, after=after, **place)
    held = made(spark, place)
    assert len(held) == (8 if where == "after" else 4) and len(set(held)) == len(held)
    assert streaming.take_in(spark, schema=SCHEMA, work=work, files=1, **place) == 3
    assert made(spark, place) == [s * 1000 + k for s in (1, 2, 3) for k in range(4)]


def test_what_a_dead_run_left_is_not_read(spark, place):
    deliver(spark, place["source"], 1, 4)
    streaming.take_in(spark, schema=SCHEMA, work=work, **place)
    work(spark.createDataFrame([(77, 7, 7)], SCHEMA)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{place['path']}/batch=5")
    assert streaming.done(spark, place["path"]) == [0] and made(spark, place) == [1000, 1001, 1002, 1003]
