"""File sinks: rotating logs, per-resource logs, points and entity records."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import epoch_seconds, iso_utc, safe_name
from ..operators.aggregates import list_files
from ..operators.project import route_entities


def _clustered(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range partition by directory, then order: few files per directory, and a directory that holds
    most rows is still written by many tasks."""
    return df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)


def write_rotating_log(
    df: DataFrame, path: str, name: str | Column, ts: str, slot_s: int = 3600, max_rows: int = 0, order: Sequence[str] = ()
) -> None:
    """CSV logs below ``date=<day>/slot=<start>_<name>.log``; a new file per time slot and after ``max_rows`` rows.

    Every file starts with the header. ``name`` may differ from row to row.
    """
    label = name if isinstance(name, Column) else F.lit(name)
    start = F.floor(epoch_seconds(F.col(ts)) / slot_s) * slot_s
    stamp = F.date_format(F.timestamp_seconds(start), "yyyy-MM-dd-HHmmss")
    rows = df.withColumn("date", F.date_format(F.timestamp_seconds(start), "yyyy-MM-dd")).withColumn(
        "slot", F.concat(stamp, F.lit("_"), label, F.lit(".log"))
    )
    writer = _clustered(rows, ["date", "slot"], [*order] or [ts]).write.partitionBy("date", "slot")
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    writer.mode("append").csv(path, header=True)


def finished_logs(spark: SparkSession, path: str) -> DataFrame:
    """Committed files of :func:`write_rotating_log` with ``instance`` (its name), ``stamp`` of the slot and ``part`` in the slot."""
    slot = r"/slot=([0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{6})_([^/]+)\.log/[^/]+$"
    logs = list_files(spark, path).select(
        "path", "length", F.regexp_extract("path", slot, 1).alias("stamp"), F.regexp_extract("path", slot, 2).alias("instance")
    )
    within = Window.partitionBy("instance", "stamp").orderBy("path")
    return logs.filter("stamp <> ''").withColumn("part", F.row_number().over(within) - 1)


def publish_groups(logs: DataFrame, target: str, groups: Sequence[int]) -> None:
    """Copies finished logs to ``<target>/<instance>/<instance>_<stamp>-<part>.log.<group>``, one copy per group.

    Each consumer group takes and removes copies of its own, :func:`..operators.aggregates.backlog` counts what waits. Files
    are copied as streams by the tasks, under a hidden name that is renamed when it is complete; a copy that is there in full is
    left, so a repeated task or call changes nothing. ``target`` is a path that pyarrow can open.
    """
    if not groups or not all(1 <= g <= 9 for g in groups):
        raise ValueError("groups are numbers from 1 to 9")

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                copy_file(row["path"], f"{target}/{row['name']}", row["length"])
            yield rows

    name = F.format_string("%s/%s_%s-%04d.log.%d", "instance", "instance", "stamp", "part", "group")
    copies = logs.withColumn("group", F.explode(F.array(*[F.lit(g) for g in sorted(set(groups))])))
    names = copies.select("path", "length", name.alias("name"))
    # One task copies a bounded number of files on average; names are known before anything is copied.
    spread = names.repartition(F.xxhash64("name"))
    spread.mapInArrow(copy, spread.schema).write.format("noop").mode("overwrite").save()


def copy_file(source: str, target: str, length: int) -> None:
    """Copy a file unless ``target`` has it already."""
    (from_fs, from_path), (to_fs, to_path) = (fs.FileSystem.from_uri(_uri(p)) for p in (source, target))
    there = to_fs.get_file_info(to_path)
    if there.type == fs.FileType.File and there.size == length:
        return
    folder, _, name = to_path.rpartition("/")
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    to_fs.create_dir(folder)
    with from_fs.open_input_stream(from_path) as given, to_fs.open_output_stream(hidden) as out:
        while chunk := given.read(1 << 20):
            out.write(chunk)
    to_fs.move(hidden, to_path)


def _uri(path: str) -> str:
    """Spark writes ``file:/x`` and ``s3a://x`` where Arrow reads ``file:///x`` and ``s3://x``."""
    path = re.sub(r"^file:/+", "file:///", path)
    return re.sub(r"^s3[an]://", "s3://", path)


def write_per_resource(df: DataFrame, path: str, resource: Sequence[str], order: Sequence[str]) -> None:
    """One log directory per resource, each file with its header."""
    rows = df.withColumn("resource_id", safe_name(*[F.col(c).cast("string") for c in resource]))
    _clustered(rows, ["resource_id"], order).write.partitionBy("resource_id").mode("append").csv(path, header=True)


def write_fanout(df: DataFrame, targets: Sequence[Callable[[DataFrame], None]]) -> DataFrame:
    """Write the same rows to several targets; they are computed once and passed on."""
    rows = df.persist()
    try:
        for write in targets:
            write(rows)
    finally:
        rows.unpersist()
    return df


def to_points(
    df: DataFrame,
    measurement: str,
    time_ns: Column,
    include: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """``measurement, time, tags, fields`` from rows with ``tags`` and ``fields`` maps."""

    def wanted(name: Column) -> Column:
        keep = F.lit(True) if include is None else name.isin(list(include))
        return keep & ~name.isin(list(exclude)) if exclude else keep

    return df.select(
        F.lit(measurement).alias("measurement"),
        time_ns.alias("time"),
        F.map_filter("tags", lambda k, _: wanted(k)).alias("tags"),
        F.map_filter("fields", lambda k, _: wanted(k)).alias("fields"),
    )


def write_points(points: DataFrame, path: str, mode: str = "append") -> None:
    points.write.mode(mode).json(path)


def to_entity_records(
    df: DataFrame,
    entities: Sequence[tuple[str, Mapping[str, str]]],
    metrics: Sequence[str],
    common: Mapping[str, str],
    ts: str,
) -> DataFrame:
    """JSON documents: properties, ``collectionTs``, ``metricNames`` and ``metricValues``."""
    routed = route_entities(df, entities, metrics, common, keep=[ts])
    names = sorted({*common, *[n for _, props in entities for n in props]})
    return routed.select(
        F.to_json(
            F.struct(
                *[F.try_element_at("properties", F.lit(n)).alias(n) for n in names],
                iso_utc(F.col(ts)).alias("collectionTs"),
                "metricNames",
                "metricValues",
            )
        ).alias("value")
    )


def write_entity_records(records: DataFrame, path: str, mode: str = "append") -> None:
    records.write.mode(mode).text(path)
