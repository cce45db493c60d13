"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.storage import drop_dir, scratch_dir

# What separates words: space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # else shuffle files stay until the driver happens to collect its garbage
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000  # of whole texts that Spark and a Python worker hold at once, each at both ends of the pipe
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)  # paths saved below a call of save_result


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: lineage ends here, and what was shuffled for it is deleted."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, name)
    rows, cleanup = spark.conf.get(BATCH), spark.conf.get(CLEANUP, "false")
    spark.conf.set(BATCH, str(min(int(rows), BATCH_ROWS) if int(rows) > 0 else BATCH_ROWS))
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, rows)
        spark.conf.set(CLEANUP, cleanup)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def save_result(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` saved. Frames that were saved on the way are deleted when the result is written and complete, which until
    then may have to be computed again from them."""
    made: list[str] = []
    outer = _made.set(made)
    try:
        result = make()
    finally:
        _made.reset(outer)
    written = save(result, name)
    for path in made:
        drop_dir(spark, path)
    return written


def drop_saved(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`save`; it must not be used afterwards."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_dir(df.sparkSession, file)


SLICE = 256  # rows of an Arrow batch whose texts and results a task holds as Python objects


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in parts, so that what a task makes of them does not grow with the batches (10,000 rows or 64 MB)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ids(df: DataFrame) -> list[str]:
    """Column names of ``df`` in lower case, to find names that are free."""
    return [c.lower() for c in df.columns]


def text_of(column: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def seeded(seed: int, *columns: str | Column) -> Column:
    """64-bit hash of columns under a seed; it depends on nothing else."""
    return F.xxhash64(F.lit(seed), *columns)


def ranked(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """Adds the 0-based position of each row under a total order, without one task for all rows.

    Rows are range-partitioned and written; positions inside a partition are added to the row counts of the
    partitions before it.
    """
    parts = save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_pno"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = parts.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    joined = inside.join(offsets, F.col("_part") == F.col("_pno"))
    return joined.withColumn(rank, (F.col("_before") + F.col("_row") - 1).cast("long")).drop("_part", "_pno", "_row", "_before")


BROADCAST_IDS = 500_000  # ids (8 bytes each) up to which they are sent to every task


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``gone(doc_id)``; many ids are joined by a shuffle instead of a broadcast."""
    gone = save(gone.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("_gone"), "left_anti")
