"""The endless stream: the same rows however often it stops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import epochs


def run(spark, tmp_path, name, until, tasks=13):
    stream = epochs.epochs(spark, tasks, 5, until=until)
    numbered = spark.range(tasks).select(F.col("id").alias("task"), F.concat(F.lit("t"), "id").alias("text"))
    q = epochs.examples(stream, numbered).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / name)).orderBy("epoch", "position").collect()
    return [(r.epoch, r.position, r.task, r.augmentation, r.text) for r in rows]


def plain(until, tasks=13):
    out, epoch = [], 0
    while len(out) < until:
        order = list(range(tasks))
        random.Random(f"5:{epoch}").shuffle(order)
        out += [(epoch, i, t, (t + epoch) % 8, f"t{t}") for i, t in enumerate(order)]
        epoch += 1
    return out[:until]


def test_stopping_and_going_on_gives_the_same_stream(spark, tmp_path, monkeypatch):
    for until in (0, 5, 13, 30, 30, 57):
        assert run(spark, tmp_path, "stops", until) == plain(until)
    assert run(spark, tmp_path, "whole", 57) == plain(57)


def test_an_endless_stream_goes_by_the_clock(spark, tmp_path):
    with pytest.raises(Exception, match="needs a rate"):
        epochs.epochs(spark, 13, 5).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "n")).start().awaitTermination()
    since = time.time() - 10
    stream = epochs.epochs(spark, 13, 5, rate=20, since=since)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "e")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    deadline = time.time() + 60
    while time.time() < deadline and len([p for p in q.recentProgress if p["numInputRows"]]) < 2:
        time.sleep(0.5)
    q.stop()
    rows = [(r.epoch, r.position, r.task, r.augmentation) for r in spark.read.parquet(str(tmp_path / "e")).orderBy("epoch", "position").collect()]
    assert len(rows) >= 200 and rows == [x[:4] for x in plain(len(rows))]


def test_an_epoch_beyond_one_generator_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="one generator"):
        epochs.epochs(spark, 2_000_000, 5, until=10).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "n")).start().awaitTermination()
