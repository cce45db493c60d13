"""Latest-state tables, updated batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.aggregates import latest
from ..operators.windows import sliding_log
from ..plans.storage import drop_dir, exists, has_finished

BUCKETS = 64  # parts of a table by the hash of its keys


class StateTable:
    """Newest rows per resource, ``depth`` of them, in ``<path>/_bucket=<hash of the keys>``.

    A batch rewrites the buckets of its own keys only, by dynamic partition overwrite. Every bucket holds its rows as they are after the
    batch that wrote it last and as they were before (``_after`` false), so a repeated batch finds the state it started from and gives
    the same table. The new buckets are first written next to the table; should a run end while they replace the
    old ones, the next one repeats that step.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], depth: int = 1, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.order, self.depth, self.buckets = list(keys), list(order), depth, buckets

    def _newest(self, df: DataFrame) -> DataFrame:
        if self.depth == 1:
            return latest(df, self.keys, self.order)
        return sliding_log(df, self.keys, self.order, self.depth)

    def _stored(self, like: DataFrame) -> DataFrame | None:
        """All rows with ``_bucket, _written, _after``, or None before the first batch."""
        if not exists(self.spark, self.path):
            return None
        marks = like.limit(0).withColumns({"_written": F.lit(0).cast("long"), "_after": F.lit(True), "_bucket": F.lit(0)})
        return self.spark.read.schema(marks.schema).parquet(self.path)

    def _replace(self, pending: str) -> None:
        rows = self.spark.read.parquet(pending)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        drop_dir(self.spark, pending)

    def _before(self, stored: DataFrame, batch_id: int) -> DataFrame:
        # What a later batch (one after a restart from an older checkpoint) has written is older state too, as far as it is kept.
        return stored.filter((F.col("_written") < batch_id) & F.col("_after") | (F.col("_written") >= batch_id) & ~F.col("_after"))

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        pending = f"{self.path}-pending"
        if has_finished(self.spark, pending):
            self._replace(pending)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        # The batch shrinks to its newest rows before it meets the stored state.
        rows = self._newest(batch)
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        stored = self._stored(batch)
        old = None if stored is None else self._before(stored.filter(F.col("_bucket").isin(touched)), batch_id).select(*batch.columns)
        new = rows if old is None else self._newest(old.unionByName(rows))
        both = new.withColumn("_after", F.lit(True))
        if old is not None:
            both = both.unionByName(old.withColumn("_after", F.lit(False)))
        marked = both.withColumns({"_written": F.lit(batch_id).cast("long"), "_bucket": bucket})
        marked.repartition("_bucket", "_after").write.mode("overwrite").parquet(pending)
        self._replace(pending)

    def before(self, batch_id: int, like: DataFrame) -> DataFrame:
        """Rows kept by the batches before ``batch_id``; none for the first batch."""
        stored = self._stored(like)
        return like.limit(0) if stored is None else self._before(stored, batch_id).select(*like.columns)

    def read(self) -> DataFrame:
        """Rows after the newest batch."""
        return self.spark.read.parquet(self.path).filter("_after").drop("_written", "_after", "_bucket")
