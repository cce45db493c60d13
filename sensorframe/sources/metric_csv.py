"""Metric CSV logs: the header is part of the stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import to_instant
from ..operators.project import SYSTEM_COLUMNS, clean_header
from ..plans.storage import drop_written
from .headers import by_header, every_name, file_headers, plain_names
from .lines import read_lines

TIME = "datetime"


def text_schema(header: str) -> T.StructType:
    """All columns as text, header names trimmed and cleaned."""
    return T.StructType([T.StructField(clean_header(n), T.StringType()) for n in header.split(",")])


def header_mark() -> Column:
    """True for a line whose first cell is the name of the time column."""
    return F.col("value").rlike(rf'^\s*"?{TIME}"?\s*(,|$)')


def typed(df: DataFrame) -> DataFrame:
    """Drop repeated headers and rows with a malformed time; ``timestamp`` becomes a number."""
    rows = df.filter(F.col(TIME) != TIME).filter(to_instant(F.col(TIME), F.col("timezone")).isNotNull())
    return rows.withColumn("timestamp", F.col("timestamp").try_cast("long"))


def metric_rows(
    lines: DataFrame, columns: Sequence[str] | None = None, header: str | None = None, null_mark: str | None = "(!)",
    keep: Sequence[str] = (), headers: DataFrame | None = None,
) -> DataFrame:
    """Text cells of ``lines(file, block, pos, value)`` under the system columns and ``columns``, each file read by its own header.

    The first header of a file names its columns, also for rows that stand before it; later ones are dropped. Without ``columns``
    all names of all files appear, null where a file lacks them; otherwise a missing column holds ``null_mark``.
    ``header`` is the layout of files that have none; without it they are an error. ``keep`` names columns of ``lines`` to go along;
    ``headers`` is the table of :func:`.headers.file_headers` where the caller has it already.
    """
    headers = file_headers(lines, header_mark()) if headers is None else headers
    widest = None
    if columns is None:
        (names, widest), null_mark = every_name(headers), None
        if header is not None:
            names += [n for n in plain_names(header) if n not in names]
        if not names:
            raise ValueError("no header line")
    else:
        names = [*SYSTEM_COLUMNS, *columns]
    return by_header(lines, headers, names, header_mark(), header, null_mark, widest=widest).select(*names, *[c for c in keep if c not in names])


def read_metric_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, header: str | None = None
) -> DataFrame:
    """Rows of all files below ``path``, whatever the order of their columns; ``columns`` picks and orders the sensor columns.

    Headers and rows with a malformed time are dropped; see :func:`metric_rows` for files that differ.
    """
    return typed(metric_rows(read_lines(spark, path), columns, header))


def stream_metric_files(
    spark: SparkSession,
    root: str,
    pattern: str = "*",
    max_files: int = 300,
    clean: str | None = None,
    archive: str | None = None,
) -> DataFrame:
    """New log files as a stream of lines, in batches of at most ``max_files`` files, oldest first.

    The instance is the file's directory. ``clean`` is ``delete`` or ``archive`` and applies once a batch has been committed.
    :func:`in_metric_rows` reads a batch by the headers of its files.
    """
    reader = (
        spark.readStream.option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
    )
    if clean:
        reader = reader.option("cleanSource", clean)
        if archive:
            reader = reader.option("sourceArchiveDir", archive)
    path = F.col("_metadata.file_path")
    return reader.text(root).select(
        path.alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.element_at(F.split(path, "/"), -2).alias("instance")
    )


def in_metric_rows(
    columns: Sequence[str], passed_on: Callable[[DataFrame, int], None], header: str | None = None, null_mark: str | None = "(!)",
    keep: Sequence[str] = ("instance",),
) -> Callable[[DataFrame, int], None]:
    """Batch function over lines of :func:`stream_metric_files`: rows by the headers of their files, with ``keep``, go to ``passed_on``.

    A batch holds whole files, so a header and its rows meet here. Line positions are numbered here too, where the
    batch is a plain frame over its files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        lines = batch.withColumn("pos", F.monotonically_increasing_id())
        headers = file_headers(lines, header_mark())
        passed_on(metric_rows(lines, columns, header, null_mark, [c for c in keep if c in batch.columns], headers), batch_id)
        drop_written(headers)

    return write


def read_stream_of_one_header(spark: SparkSession, root: str, schema: T.StructType, pattern: str = "*", max_files: int = 300) -> DataFrame:
    """A stream of rows, for stateful operators: every file must have the header of ``schema``; any other one stops the stream with an error."""
    reader = spark.readStream.schema(schema).option("header", "true").option("enforceSchema", "false")
    reader = reader.option("maxFilesPerTrigger", max_files).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.csv(root).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("instance"))


def _days(t_from: datetime, t_to: datetime) -> list[str]:
    return [
        (t_from.date() + timedelta(days=n)).isoformat() for n in range((t_to.date() - t_from.date()).days + 1)
    ]


def scan_daily_logs(
    spark: SparkSession, root: str, probe: str, t_from: datetime, t_to: datetime, header: str | None = None
) -> DataFrame:
    """Rows of a probe in a dated log tree ``<root>/<day>/<start time>_<probe>*.log``.

    Pruned in three steps: only directories of the days asked for are listed (plain or ``date=`` names), files by the time
    in their name, rows by their own time. Files whose header differs from the first (or from ``header``) are skipped.
    """
    days = _days(t_from, t_to)
    tree = f"{root.rstrip('/')}/{{{','.join([*days, *[f'date={d}' for d in days]])}}}/*_{probe}*.log"
    file_time = F.try_to_timestamp(
        F.regexp_extract("file", r"/(?:\w+=)?(\d{4}-\d{2}-\d{2}-\d{6})_[^/]*\.log(?:/|$)", 1),
        F.lit("yyyy-MM-dd-HHmmss"),
    )
    lines = read_lines(spark, tree).filter(file_time.between(F.lit(t_from), F.lit(t_to)))
    # A log starts with its header: other lines are not searched for one.
    headers = file_headers(lines.filter("block = 0"), header_mark())
    if header is not None:
        names = plain_names(header)
    else:
        first = headers.agg(F.min_by("_names", "_of")).first()[0]
        if first is None:
            raise ValueError(f"no header line of {probe} in {root}")
        names = list(first)
    same = headers.filter(F.col("_names") == F.array(*[F.lit(n) for n in names]))
    rows = by_header(lines, same, names, header_mark(), known_only=True, widest=len(names))
    instant = F.try_to_timestamp(F.col(TIME), F.lit("yyyy-MM-dd HH:mm:ss"))
    return (
        typed(rows.select(*names))
        .filter(instant.between(F.lit(t_from), F.lit(t_to)))
        .withColumn("date", F.substring(TIME, 1, 10))
    )
