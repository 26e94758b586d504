"""An endless stream of training examples, epoch after epoch.

A Python streaming data source gives (epoch, position, task, augmentation): in
every epoch each of ``tasks`` once, in an order that only the seed and the epoch
decide, and with an augmentation one further around the sweep than in the epoch
before. Offsets are (epoch, position), so a stream that stops anywhere goes on
with the very next row. How far a batch goes is read off the clock (``rate`` rows
a second since ``since``), which a restart doesn't turn back, up to ``until`` rows
if that is given.
"""

from __future__ import annotations

import random
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.splits import MOST_SHUFFLED

SWEEP, AT_ONCE = 8, 1 << 16


@lru_cache(maxsize=2)
def order(seed: str, epoch: int, tasks: int) -> np.ndarray:
    """The tasks of an epoch in their order: one generator draws for all in turn."""
    positions = list(range(tasks))
    random.Random(f"{seed}:{epoch}").shuffle(positions)
    return np.array(positions)


@dataclass
class Stretch(InputPartition):
    epoch: int
    first: int
    last: int


class Epochs(DataSource):
    """Options: tasks, seed, rate and since (seconds), until (rows in all)."""

    @classmethod
    def name(cls) -> str:
        return "epochs"

    def schema(self) -> str:
        return "epoch int, position int, task int, augmentation int"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Reader(self.options)


class _Reader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.tasks, self.seed = int(options["tasks"]), options.get("seed", "0")
        self.rate, self.since = float(options.get("rate", "inf")), float(options.get("since", "0"))
        self.until = int(options["until"]) if "until" in options else None
        if not 0 < self.tasks <= MOST_SHUFFLED:
            raise ValueError(f"{self.tasks} tasks; an epoch's order is drawn by one generator for 1 to {MOST_SHUFFLED}")
        if self.until is None and self.rate == float("inf"):
            raise ValueError("an endless stream needs a rate")

    def _offset(self, row: int) -> dict:
        return {"epoch": row // self.tasks, "position": row % self.tasks}

    def _row(self, offset: dict) -> int:
        return offset["epoch"] * self.tasks + offset["position"]

    def initialOffset(self) -> dict:  # noqa: N802
        return self._offset(0)

    def latestOffset(self) -> dict:  # noqa: N802
        due = float("inf") if self.rate == float("inf") else max(0, int((time.time() - self.since) * self.rate))
        return self._offset(int(due if self.until is None else min(due, self.until)))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        row, last, out = self._row(start), self._row(end), []
        while row < last:  # stretches of one epoch
            epoch, first = divmod(row, self.tasks)
            n = min(AT_ONCE, self.tasks - first, last - row)
            out.append(Stretch(epoch, first, first + n))
            row += n
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        task = order(self.seed, partition.epoch, self.tasks)[partition.first : partition.last]
        columns = [np.full(len(task), partition.epoch), np.arange(partition.first, partition.last), task, (task + partition.epoch) % SWEEP]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], ["epoch", "position", "task", "augmentation"])


def epochs(spark: SparkSession, tasks: int, seed: int | str, rate: float | None = None, since: float | None = None, until: int | None = None) -> DataFrame:
    """The stream: epoch, position, task (from 0), augmentation (a place of the
    sweep). Either ``rate`` and ``since`` (seconds since 1970) or ``until`` must be given."""
    spark.dataSource.register(Epochs)
    options = {"tasks": tasks, "seed": seed, "rate": rate, "since": since, "until": until}
    return spark.readStream.format("epochs").options(**{k: str(v) for k, v in options.items() if v is not None}).load()


def examples(stream: DataFrame, numbered: DataFrame, task: str = "task") -> DataFrame:
    """The stream's rows with the columns of their task: ``numbered`` is a table
    with ``task``, a number from 0 to tasks - 1 (see ``ranks.places``)."""
    return stream.join(numbered.withColumn(task, F.col(task).cast("int")), task)
