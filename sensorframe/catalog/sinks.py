"""Sinks: written from the tables and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..operators import aggregates as A, project as R
from ..sinks import files as K
from ..sinks.delivery import BatchedSink, default_writers
from ..sinks.state import StateTable
from ..streaming.jobs import run_available
from .base import Catalog, Inputs
from .sources import LOG_COLUMNS

catalog = Catalog()
query = catalog.query
col, lit = F.col, F.lit


@query(
    "snk01_rotating_log",
    """SELECT substr(datetime, 1, 10) AS date, strftime(to_timestamp(timestamp - timestamp % 21600) AT TIME ZONE 'UTC', '%Y-%m-%d-%H%M%S') || '_probe.log' AS slot,
      count(*) AS rows, round(sum(value), 4) AS total FROM metrics GROUP BY 1, 2""",
    ["metrics"],
)
def _(i: Inputs) -> DataFrame:
    path = i.scratch("rotating")
    K.write_rotating_log(i.metrics.select(*LOG_COLUMNS, "ts"), path, "probe", "ts", 6 * 3600, max_rows=1000)
    back = i.spark.read.csv(path, header=True)
    return back.groupBy(F.date_format("date", "yyyy-MM-dd").alias("date"), "slot").agg(
        F.count(lit(1)).alias("rows"), F.round(F.sum(col("value").cast("double")), 4).alias("total")
    )


@query(
    "snk02_fanout",
    "SELECT 'all' AS target, count(*) AS rows FROM metrics UNION ALL SELECT 'errors', count(*) FILTER (source = 'error') FROM metrics",
    ["metrics"],
)
def _(i):
    every, errors = i.scratch("fanout-all"), i.scratch("fanout-errors")
    K.write_fanout(
        i.metrics.select("seq", "device", "source"),
        [lambda d: d.write.parquet(every), lambda d: d.filter("source = 'error'").write.parquet(errors)],
    )
    a, b = i.spark.read.parquet(every), i.spark.read.parquet(errors)
    return a.select(lit("all").alias("target")).unionByName(b.select(lit("errors").alias("target"))).groupBy("target").agg(
        F.count(lit(1)).alias("rows")
    )


GROUPS = (1, 3)


def published(i: Inputs) -> str:
    """Daily logs per system, copied for two groups."""
    path, out = i.scratch("grouped"), i.scratch("published")
    K.write_rotating_log(i.metrics.select(*LOG_COLUMNS, "ts", "seq"), path, col("system"), "ts", 86_400, max_rows=1000)
    for _ in range(2):  # as after a lost task: nothing changes
        K.publish_groups(K.finished_logs(i.spark, path), out, GROUPS)
    return out


_STAMP = "strftime(to_timestamp(timestamp - timestamp % 86400) AT TIME ZONE 'UTC', '%Y-%m-%d-%H%M%S')"


@query(
    "snk02_file_groups",
    f"""SELECT system AS instance, {_STAMP} AS stamp, g AS file_group, count(*) AS rows, round(sum(value), 4) AS total, cast(sum(seq) AS bigint) AS seqs
    FROM metrics, (VALUES ('1'), ('3')) v(g) GROUP BY 1, 2, 3""",
    ["metrics"],
)
def _(i):
    out = published(i)
    lines = i.spark.read.option("recursiveFileLookup", "true").option("header", "true").csv(out)
    name = r"/([^/]+)/([^/]+)_([0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{6})-[0-9]{4}\.log\.([1-9])$"
    at = [F.regexp_extract("_metadata.file_path", name, n).alias(a) for n, a in ((2, "instance"), (3, "stamp"), (4, "file_group"))]
    return lines.select(*at, "value", "seq").groupBy("instance", "stamp", "file_group").agg(
        F.count(lit(1)).alias("rows"), F.round(F.sum(col("value").cast("double")), 4).alias("total"), F.sum(col("seq").cast("long")).alias("seqs")
    )


@query(
    "agg28_backlog_files",
    "SELECT system AS instance, "
    + ", ".join(f"{'count(DISTINCT timestamp // 86400)' if g in GROUPS else 'cast(0 AS bigint)'} AS backlog_group_{g}" for g in range(1, 10))
    + ", 2 * count(DISTINCT timestamp // 86400) AS backlog_total, cast(0 AS bigint) AS errorlog_size FROM metrics GROUP BY system",
    ["metrics"],
)
def _(i):
    # The first file of each slot, as the number of files in a slot depends on the partitions that wrote it.
    files = A.list_files(i.spark, published(i)).filter(col("path").rlike(r"-0000\.log\.[1-9]$"))
    return A.backlog(files).drop("errorlog_time")


def points(i: Inputs) -> DataFrame:
    parts = R.split_tags_fields(i.metrics, ["device", "source"], ["value", "k"], ["system"], keep=["ts"])
    return K.to_points(parts, "events", F.unix_micros(col("ts").cast("timestamp")) * 1000, exclude=["source", "k"])


@query(
    "snk03_points",
    """SELECT 'events' AS measurement, epoch_us(ts) * 1000 AS time, system, device, value, 2 AS n_tags, 1 AS n_fields FROM metrics""",
    ["metrics"],
)
def _(i):
    path = i.scratch("points")
    K.write_points(points(i), path)
    schema = "measurement STRING, time LONG, tags MAP<STRING, STRING>, fields MAP<STRING, DOUBLE>"
    back = i.spark.read.schema(schema).json(path)
    return back.select(
        "measurement", "time", col("tags")["system"].alias("system"), col("tags")["device"].alias("device"), col("fields")["value"].alias("value"),
        F.size("tags").alias("n_tags"), F.size("fields").alias("n_fields"),
    )


@query(
    "snk04_entity_records",
    """SELECT device AS entity_name, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS collected, 'value,k' AS names, cast(value AS string) AS first_value FROM metrics WHERE source = 'error'""",
    ["metrics"],
)
def _(i):
    path = i.scratch("entities")
    entities = [("source = 'error'", {"entityName": "device", "entityId": "'E1'"})]
    K.write_entity_records(K.to_entity_records(i.metrics, entities, ["value", "k"], {"entityType": "'FAULT'"}, "ts"), path)
    schema = "entityName STRING, entityType STRING, collectionTs STRING, metricNames ARRAY<STRING>, metricValues ARRAY<ARRAY<STRING>>"
    doc = i.spark.read.text(path).select(F.from_json("value", schema).alias("d"))
    return doc.select(
        col("d.entityName").alias("entity_name"), col("d.collectionTs").alias("collected"), F.array_join("d.metricNames", ",").alias("names"),
        col("d.metricValues")[0][0].alias("first_value"),
    )


@query(
    "snk05_latest_state",
    "SELECT device, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY timestamp DESC, seq DESC) AS rn FROM metrics) q WHERE rn = 1",
    ["metrics"],
)
def _(i):
    rows = i.metrics.select("device", "seq", "timestamp", "value")
    table = StateTable(i.spark, i.scratch("state"), ["device"], ["timestamp", "seq"])
    for batch_id, source in enumerate(("k % 3 = 0", "k % 3 = 1", "k % 3 = 2")):
        table.upsert(rows.filter(source), batch_id)
    return table.read().select("device", "seq", "value")


@query(
    "snk06_per_resource",
    "SELECT system || '_' || source AS resource_id, count(*) AS rows, round(sum(value), 4) AS total FROM metrics GROUP BY 1",
    ["metrics"],
)
def _(i):
    path = i.scratch("resources")
    K.write_per_resource(i.metrics.select(*LOG_COLUMNS, "seq"), path, ["system", "source"], ["seq"])
    back = i.spark.read.csv(path, header=True)
    return back.groupBy("resource_id").agg(F.count(lit(1)).alias("rows"), F.round(F.sum(col("value").cast("double")), 4).alias("total"))


def chunk_files(root: str):
    """A receiver for tests and examples: one file per chunk, named by the delivery token."""

    def write(rows: list, token: tuple) -> None:
        from pyarrow import fs

        target, path = fs.FileSystem.from_uri(root)
        target.create_dir(path)
        with target.open_output_stream(f"{path}/{'-'.join(str(t) for t in token)}.json") as out:
            for row in rows:
                out.write((json.dumps(row.asDict()) + "\n").encode())

    return write


@query("snk07_batched_delivery", "SELECT source, count(*) AS rows, cast(sum(seq) AS bigint) AS seqs FROM metrics GROUP BY source", ["metrics"])
def _(i):
    root = i.scratch("delivered")
    sink = BatchedSink(chunk_files(root), max_rows=500, retries=2, wait_s=0.1)
    sink(i.metrics.select("seq", "source"), 0)
    back = i.spark.read.schema("seq LONG, source STRING").json(root)
    return back.groupBy("source").agg(F.count(lit(1)).alias("rows"), F.sum("seq").alias("seqs"))


@query(
    "udf02_writer_registry",
    "SELECT device, count(*) AS points, round(sum(value), 4) AS total FROM metrics GROUP BY device",
    ["metrics"],
)
def _(i):
    root, out = i.scratch("events-in"), i.scratch("writer-out")
    parts = R.split_tags_fields(i.metrics, ["device"], ["value", "k"], keep=["timestamp"]).withColumn(
        "time", S.to_epoch_nanos(col("timestamp"), "s")
    )
    parts.select("time", "tags", "fields").write.parquet(root)
    writer = default_writers().create("points", {"name": "events", "path": out, "exclude": ["k"]})
    stream = i.spark.readStream.schema(i.spark.read.parquet(root).schema).parquet(root)
    run_available(stream, writer, i.scratch("checkpoint"))
    back = i.spark.read.schema("time LONG, tags MAP<STRING, STRING>, fields MAP<STRING, DOUBLE>").json(out)
    return back.groupBy(col("tags")["device"].alias("device")).agg(
        F.count(lit(1)).alias("points"), F.round(F.sum(col("fields")["value"]), 4).alias("total")
    )
