"""Batched delivery to a receiver, and the registry of writers."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession

from ..plans.storage import has_finished, scratch_dir
from .files import to_points, write_points


@dataclass
class BatchedSink:
    """Delivers rows in chunks of at most ``max_rows`` from the tasks that hold them.

    ``write_fn(rows, token)`` gets a list of rows and ``(batch_id, partition, chunk)``, which stays equal when a
    batch or task is repeated, so a receiver can drop duplicates. Connection errors and timeouts are
    retried ``retries`` times (-1: for ever) after ``wait_s`` seconds, then the batch fails and the stream
    stops. Chunks that the receiver refuses with any other error are lost to it but not to the caller: their rows are written below
    ``dead_letters`` (a folder of the cluster's shared one if not given), one directory a batch, see :meth:`refused`. The directory
    also marks the batch as delivered: a repeated batch is not sent again.
    """

    write_fn: Callable[[list[Row], tuple[int, int, int]], None]
    max_rows: int = 50
    retries: int = -1
    wait_s: float = 30.0
    dead_letters: str | None = None
    discarded: object = field(default=None, repr=False)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.discarded is None:
            self.discarded = spark.sparkContext.accumulator(0)
        if self.dead_letters is None:
            self.dead_letters = scratch_dir(spark, "dead-letters")
        path = f"{self.dead_letters}/batch={batch_id}"
        if has_finished(spark, path):
            return
        write, size, retries, wait, lost = self.write_fn, self.max_rows, self.retries, self.wait_s, self.discarded

        def deliver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, n = TaskContext.get().partitionId(), itertools.count()
            for rows in batches:
                for start in range(0, rows.num_rows, size):
                    chunk = rows.slice(start, size)
                    if send(write, [Row(**r) for r in chunk.to_pylist()], (batch_id, part, next(n)), retries, wait):
                        lost.add(chunk.num_rows)
                        yield chunk

        batch.mapInArrow(deliver, batch.schema).write.mode("overwrite").parquet(path)

    def refused(self, spark: SparkSession) -> DataFrame | None:
        """Rows of all batches that the receiver refused; None before the first batch."""
        return None if self.dead_letters is None else spark.read.parquet(self.dead_letters)


def send(write: Callable, rows: list, token: tuple, retries: int, wait_s: float) -> bool:
    """True when the receiver refused the rows."""
    attempt = 0
    while True:
        try:
            write(rows, token)
            return False
        except (ConnectionError, TimeoutError):
            if 0 <= retries <= attempt:
                raise
            attempt += 1
            time.sleep(wait_s)
        except Exception:
            return True


class WriterRegistry:
    """Writers by name. A factory takes the writer's definition and returns a ``foreachBatch`` function."""

    def __init__(self) -> None:
        self._factories: dict[str, Callable[[dict], Callable[[DataFrame, int], None]]] = {}

    def register(self, name: str, factory: Callable[[dict], Callable[[DataFrame, int], None]]) -> None:
        self._factories[name] = factory

    def names(self) -> list[str]:
        return sorted(self._factories)

    def create(self, name: str, definition: dict) -> Callable[[DataFrame, int], None]:
        if name not in self._factories:
            raise KeyError(f"unknown writer {name!r}, known: {self.names()}")
        return self._factories[name](definition)


def _point_writer(definition: dict) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        points = to_points(
            batch,
            definition["name"],
            batch["time"],
            definition.get("include"),
            definition.get("exclude", ()),
        )
        # One directory per batch: a repeated batch replaces its own output.
        write_points(points, f"{definition['path']}/batch={batch_id}", mode="overwrite")

    return write


def default_writers() -> WriterRegistry:
    registry = WriterRegistry()
    registry.register("points", _point_writer)
    registry.register("batched", lambda d: BatchedSink(**d))
    return registry
