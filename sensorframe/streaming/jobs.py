"""Streaming jobs: windows, row hooks, latest state, header handling and the push job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.filters import filter_expr, require_any_field
from ..operators.project import apply_transforms, split_tags_fields
from ..operators.windows import counter_rows, dvdt
from ..sinks.state import StateTable
from ..sources.metric_csv import in_metric_rows, metric_rows, stream_metric_files


def minute_stats(
    sdf: DataFrame, ts: str, keys: Sequence[str], aggs: Mapping[str, Column], delay: str = "1 minute"
) -> DataFrame:
    """Aggregates per completed minute; a minute is emitted once the watermark passed its end."""
    rows = sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return (
        rows.groupBy(F.window(ts, "1 minute"), *keys)
        .agg(*[a.alias(n) for n, a in aggs.items()])
        .select(F.col("window.start").alias("minute"), *keys, *aggs)
    )


def run_available(
    sdf: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Process everything available now in micro-batches, then stop."""
    query = (
        sdf.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer with one directory per batch: repeating a batch replaces its output."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def stream_state(
    sdf: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], log_rows: int = 20
) -> tuple[Callable[[DataFrame, int], None], StateTable, StateTable]:
    """Batch function keeping the latest row and the last ``log_rows`` rows per resource."""
    state = StateTable(sdf.sparkSession, f"{path}/state", keys, order)
    log = StateTable(sdf.sparkSession, f"{path}/log", keys, order, depth=log_rows)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            state.upsert(rows, batch_id)
            log.upsert(rows, batch_id)
        finally:
            rows.unpersist()

    return write, state, log


def rate_batches(
    state: StateTable,
    resource: Sequence[str],
    time_col: str,
    data_cols: Sequence[str],
    order: Sequence[str],
    passed_on: Callable[[DataFrame, int], None],
) -> Callable[[DataFrame, int], None]:
    """Batch function for rates of change: ``dvdt`` over each batch plus the stored previous rows.

    All work stays in generated code and a resource that fills a batch is split like in the batch
    operator; ``stateful.stream_dvdt`` keeps the previous row in the state store instead.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = counter_rows(batch, data_cols)
        stored = state.before(batch_id, rows)
        # Stored rows sort first; as first row of their resource they give no output themselves.
        both = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        rates = dvdt(both, resource, time_col, data_cols, ["_new", *order])
        passed_on(rates.drop("_new"), batch_id)
        state.upsert(rows, batch_id)

    return write


def for_each(
    action: Callable, mode: str = "row", silent: bool = False, passed_on: Callable[[DataFrame, int], None] | None = None
) -> Callable[[DataFrame, int], None]:
    """Batch function calling ``action`` for rows on the executors.

    ``row`` passes each row, ``trigger`` calls without arguments once per row, ``pipe`` passes an iterator over a
    partition's rows. Unless ``silent`` the batch goes on to ``passed_on`` unchanged.
    """
    if mode not in ("row", "trigger", "pipe"):
        raise ValueError(f"unknown mode {mode!r}")

    def run(rows) -> None:
        if mode == "pipe":
            action(rows)
            return
        for row in rows:
            action(row) if mode == "row" else action()

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.foreachPartition(run)
        if not silent and passed_on is not None:
            passed_on(batch, batch_id)

    return write


def split_headers(lines: DataFrame, columns: Sequence[str], null_mark: str = "(!)") -> DataFrame:
    """``file``, the system columns and ``columns`` of header-in-stream CSV lines, see :func:`.metric_csv.metric_rows`.

    Every file's first header names its columns; header rows are dropped, rows before the header are held back and
    read with it. A file without a header is an error.
    """
    return metric_rows(lines, columns, None, null_mark, ["file"])


def stream_headers(
    columns: Sequence[str], passed_on: Callable[[DataFrame, int], None]
) -> Callable[[DataFrame, int], None]:
    """Batch function over :func:`stream_lines` batches: :func:`split_headers`, then ``passed_on``."""

    return in_metric_rows(columns, passed_on, keep=("file",))


def stream_lines(spark: SparkSession, root: str, max_files: int = 300, pattern: str = "*") -> DataFrame:
    """New text files as a stream of lines with their file and block."""
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .text(root)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            "value",
        )
    )


def push_points(
    rows: DataFrame,
    tags: Sequence[str],
    fields: Sequence[str],
    time_ns: Column,
    transforms: Sequence[str] = (),
    condition: str | None = None,
    common_tags: Sequence[str] = (),
) -> DataFrame:
    """Rows to ``time, tags, fields``: rows without any field value are dropped, then the transforms
    and the filter run."""
    numeric = rows.select(
        time_ns.alias("time"),
        *[F.col(t) for t in tags],
        *[F.col(f).cast("string").try_cast("double").alias(f) for f in fields],
    )
    kept = require_any_field(numeric, fields)
    changed = apply_transforms(kept, transforms)
    new = [c for c in changed.columns if c not in ("time", *tags, *fields)]
    new_fields = [c for c in new if isinstance(changed.schema[c].dataType, T.NumericType)]
    new_tags = [c for c in new if c not in new_fields]
    wanted = filter_expr(changed, condition) if condition else changed
    return split_tags_fields(wanted, [*tags, *new_tags], [*fields, *new_fields], common_tags, keep=["time"])


def push_job(
    spark: SparkSession,
    root: str,
    columns: Sequence[str],
    points: Callable[[DataFrame], DataFrame],
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    pattern: str = "*",
    max_files: int = 300,
    clean: str | None = None,
    header: str | None = None,
) -> None:
    """Files to points to a sink, in micro-batches, until no file is left.

    ``points`` gets the system columns, ``columns`` and ``instance`` of a batch, every file read by its own header
    (``header`` where it has none).
    """
    source = stream_metric_files(spark, root, pattern, max_files, clean)
    run_available(source, in_metric_rows(columns, lambda rows, n: sink(points(rows), n), header, None), checkpoint)
