"""Sources: files are written from the tables, read back with the library and compared with the tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from ..sinks.files import write_rotating_log
from ..sources import captures as T
from ..sources.access_log import AccessLogConfig, read_access_log
from ..sources.lines import read_lines
from ..sources.load_test import read_load_test
from ..sources.metric_csv import in_metric_rows, read_metric_csv, scan_daily_logs, stream_metric_files, typed
from ..sources.tbml import read_tbml
from ..streaming.jobs import run_available, to_parquet
from .base import Catalog, Inputs

catalog = Catalog()
query = catalog.query
col, lit = F.col, F.lit

LOG_COLUMNS = ["datetime", "timezone", "timestamp", "system", "source", "device", "value"]
HEADER = ",".join(LOG_COLUMNS)


def log_rows(i: Inputs) -> DataFrame:
    return i.metrics.select(*LOG_COLUMNS)


COMMA_DEVICE = "CASE seq % 5 WHEN 1 THEN concat(device, ', x') ELSE device END"


def unlike_logs(i: Inputs, root: str, instance: str | None = None) -> None:
    """Metric logs that differ from file to file, by ``seq % 5``: 0 plain, with repeated headers and broken rows, 1 columns in another order
    and cells with commas, 2 a column missing, 3 no header at all, 4 rows before the header."""
    system = LOG_COLUMNS[:5]
    layouts = [LOG_COLUMNS, [*system, "value", "device"], [c for c in LOG_COLUMNS if c != "device"], LOG_COLUMNS, [*system, "value", "device"]]
    kind = (col("seq") % 5).cast("int")
    rows = i.metrics.withColumns({"kind": kind, "device": F.when(kind == 1, F.concat(lit('"'), "device", lit(', x"'))).otherwise(col("device"))})
    texts = F.array(*[F.concat_ws(",", *names) for names in layouts])
    heads = F.array(*[lit(",".join(names) if n else ", ".join(names)) for n, names in enumerate(layouts)])
    line, head = F.get(texts, "kind"), F.get(heads, "kind")
    folder = [instance] if instance else []
    rows = rows.select("kind", "seq", "k", col("system").alias(instance or "system"), line.alias("line"), head.alias("head"))
    # A stretch is what one task writes to one folder; its first row carries the header, before or after itself.
    rows = rows.repartitionByRange("kind", *folder, "seq").withColumn("stretch", F.spark_partition_id())
    first = F.row_number().over(Window.partitionBy("kind", *folder, "stretch").orderBy("seq")) == 1
    broken = F.concat(lit("2024-13-01 xx"), F.substring("line", 20, 1000))
    value = (
        F.when(first & (col("kind") == 4), F.concat_ws("\n", "line", "head"))
        .when(first & (col("kind") != 3), F.concat_ws("\n", "head", "line"))
        .when((col("kind") == 0) & (col("k") == 0), F.concat_ws("\n", "head", "line"))
        .when((col("kind") == 0) & (col("k") == 1), F.concat_ws("\n", "line", broken))
        .otherwise(col("line"))
    )
    rows.select("kind", *folder, value.alias("value")).write.partitionBy("kind", *folder).text(root)


@query(
    "src01_metric_csv",
    f"SELECT datetime, timestamp, system, source, CASE WHEN seq % 5 <> 2 THEN {COMMA_DEVICE} END AS device, value FROM metrics",
    ["metrics"],
)
def _(i: Inputs) -> DataFrame:
    path = i.scratch("metric-csv")
    unlike_logs(i, path)
    return read_metric_csv(i.spark, path, header=HEADER).select(
        "datetime", "timestamp", "system", "source", "device", col("value").cast("double").alias("value")
    )


@query(
    "src01_metric_csv_columns",
    f"""SELECT datetime, timezone, timestamp, system, source, cast(value AS string) AS value, '(!)' AS absent,
      CASE WHEN seq % 5 <> 2 THEN {COMMA_DEVICE} ELSE '(!)' END AS device FROM metrics""",
    ["metrics"],
)
def _(i):
    path = i.scratch("metric-csv")
    unlike_logs(i, path)
    return read_metric_csv(i.spark, path, ["value", "absent", "device"], HEADER)


@query(
    "src02_stream_metric_files",
    f"""SELECT concat('instance=', system) AS instance, datetime, cast(timestamp AS string) AS timestamp, value,
      CASE WHEN seq % 5 <> 2 THEN {COMMA_DEVICE} ELSE '(!)' END AS device FROM metrics""",
    ["metrics"],
)
def _(i):
    root, out = i.scratch("stream-logs"), i.scratch("stream-out")
    unlike_logs(i, root, "instance")
    source = stream_metric_files(i.spark, root, "part-*", max_files=40)

    def rows(batch: DataFrame, batch_id: int) -> None:
        to_parquet(out)(typed(batch), batch_id)

    run_available(source, in_metric_rows(["value", "device"], rows, HEADER), i.scratch("checkpoint"))
    found = i.spark.read.parquet(out)
    return found.select("instance", "datetime", col("timestamp").cast("string").alias("timestamp"), col("value").cast("double").alias("value"), "device")


@query(
    "src03_scan_daily_logs",
    """SELECT datetime, timestamp, device, value, substr(datetime, 1, 10) AS date FROM metrics
    WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00' AND datetime <= '2024-01-10 12:00:00'""",
    ["metrics"],
)
def _(i):
    root = i.scratch("daily-logs")
    write_rotating_log(i.metrics.select(*LOG_COLUMNS, "ts"), root, "vmstat", "ts", 6 * 3600)
    # Logs of the same probe under another header, to be skipped.
    other = i.metrics.select(*LOG_COLUMNS[:5], "value", "device", "ts")
    write_rotating_log(other, root, "vmstat_other", "ts", 6 * 3600)
    out = scan_daily_logs(i.spark, root, "vmstat", datetime(2024, 1, 5), datetime(2024, 1, 10, 12))
    return out.select("datetime", "timestamp", "device", col("value").cast("double").alias("value"), "date")


@query(
    "src04_load_test",
    """SELECT second, elapsed, response_code, success, latency, cast(all_threads AS bigint) AS all_threads FROM samples
    WHERE time_ms >= 1704412800000 AND time_ms <= 1705276800000""",
    ["samples"],
)
def _(i):
    path = i.scratch("load-test")
    i.samples.select(
        "elapsed", col("time_ms").alias("timeStamp"), F.lit("home").alias("label"), F.lit("OK, done").alias("responseMessage"),
        F.lit("Thread 1-1").alias("threadName"), F.lit("text").alias("dataType"), col("response_code").alias("responseCode"),
        col("all_threads").alias("allThreads"), F.lit(1).alias("grpThreads"), col("latency").alias("Latency"), "success",
    ).write.csv(path, header=True)
    out = read_load_test(i.spark, path, True, datetime(2024, 1, 5), datetime(2024, 1, 15))
    return out.select("second", "elapsed", "response_code", "success", "latency", "all_threads")


@query(
    "src05_access_log",
    """SELECT concat('node', cast(node AS string)) AS server, minute, second, method, url, status, bytes, seconds FROM requests
    WHERE method <> 'HEAD' AND url <> '/app/view'""",
    ["requests"],
)
def _(i):
    path = i.scratch("access-log")
    line = F.concat_ws(
        " ", F.concat(lit("10.0.0."), (col("bytes") % 255).cast("string")), "second", "method", "url", "status", "bytes", "seconds", lit("-")
    )
    rows = i.requests.select(F.concat(lit("node"), col("node").cast("string")).alias("server"), line.alias("value"), "seq")
    rows.repartitionByRange("server", "seq").select("server", "value").write.partitionBy("server").text(path)
    cfg = AccessLogConfig(url_exclude="view$", server_pattern="node[0-9]+")
    return read_access_log(i.spark, path, cfg).select("server", "minute", "second", "method", "url", "status", "bytes", "seconds")


@query(
    "src07_tbml",
    """SELECT cast(p_partkey AS string) AS "Host", CASE WHEN p_size % 3 = 0 THEN 'n/a' ELSE cast(p_size AS string) END AS n_count,
      CASE WHEN p_size % 2 = 0 THEN 'n/a' ELSE p_name END AS "Name" FROM part""",
)
def _(i):
    rows = i.table("part").select(
        col("p_partkey").alias("at"),
        F.concat(
            lit('<row><column name="Host">'), col("p_partkey").cast("string"), lit("</column>"),
            F.when(col("p_size") % 3 != 0, F.concat(lit('<column name="n.count"> '), col("p_size").cast("string"), lit(" </column>"))).otherwise(""),
            lit('<column name="Name">'), F.when(col("p_size") % 2 != 0, col("p_name")).otherwise("  "), lit("</column></row>"),
        ).alias("value"),
    )
    head = '<tbml version="11.0"><table><columndef name="Host"/><columndef name="n.count"/><columndef name="Name"/>'
    first = i.table("part").agg(F.min("p_partkey").alias("at")).select((col("at") - 1).alias("at"), lit(head).alias("value"))
    last = i.table("part").agg(F.max("p_partkey").alias("at")).select((col("at") + 1).alias("at"), lit("</table></tbml>").alias("value"))
    path = i.write_lines(rows.unionByName(first).unionByName(last), ["at"], "tbml")
    return read_tbml(i.spark, path)


def capture(i: Inputs, rows: DataFrame, order: str, name: str) -> DataFrame:
    """Lines of a capture written from ``rows`` (``value`` may span several lines)."""
    return read_lines(i.spark, i.write_lines(rows, [order], name))


@query(
    "src08_table_capture",
    """SELECT 'fs' || cast(s_suppkey AS string) AS filesystem, 'ext4' AS type, cast(s_nationkey * 100 AS string) AS used, cast(s_nationkey AS string) AS capacity FROM supplier""",
)
def _(i):
    line = F.concat(lit("fs"), col("s_suppkey").cast("string"), lit("   ext4  "), (col("s_nationkey") * 100).cast("string"), lit("  "), col("s_nationkey").cast("string"), lit("%"))
    path = i.scratch("df")
    # The CSV writer puts the header line on top of every file, like the captured tool.
    i.table("supplier").select(line.alias("Filesystem Type Used Capacity")).repartition(2).write.option("sep", "\t").csv(path, header=True)
    rows = T.parse_table_capture(read_lines(i.spark, path), ["filesystem", "type", "used", "capacity"], skip=1)
    return rows.drop("file")


@query(
    "src08_summary_line",
    """SELECT target, CASE WHEN failed THEN '-1' ELSE cast(lo AS string) || '.5' END AS min, CASE WHEN failed THEN '-1' ELSE cast(lo + 1 AS string) || '.5' END AS avg
    FROM (SELECT c_nationkey AS target, min(c_custkey) AS lo, c_nationkey % 4 = 0 AS failed FROM customer GROUP BY c_nationkey) q""",
)
def _(i):
    rows = i.table("customer").groupBy(col("c_nationkey").alias("target")).agg(F.min("c_custkey").alias("lo"))
    good = F.concat(lit("rtt min/avg/max/mdev = "), col("lo").cast("string"), lit(".5/"), (col("lo") + 1).cast("string"), lit(".5/9/1 ms"))
    path = i.scratch("ping")
    rows.select(
        "target", F.concat(lit("PING host\n64 bytes\n"), F.when(col("target") % 4 != 0, good).otherwise("100% packet loss")).alias("value")
    ).repartition("target").write.partitionBy("target").text(path)
    out = T.parse_summary_line(read_lines(i.spark, path), r"= ([0-9.]+)/([0-9.]+)/", ["min", "avg"])
    return out.select(F.regexp_extract("file", r"target=(\d+)", 1).cast("int").alias("target"), "min", "avg")


@query(
    "src09_section_capture",
    """SELECT 'sda' AS device, cast(k AS string) AS tps, cast(value AS string) AS kb FROM metrics UNION ALL SELECT 'sdb', cast(ivalue AS string), source FROM metrics""",
    ["metrics"],
)
def _(i):
    text = F.concat(
        lit("Linux host up\nDevice:   tps  kB\nsda  "), col("k").cast("string"), lit("  "), col("value").cast("string"),
        lit("\nsdb   "), col("ivalue").cast("string"), lit(" "), col("source"), lit("\nsda1 7 7\n"),
    )
    lines = capture(i, i.metrics.select("seq", text.alias("value")), "seq", "iostat")
    return T.parse_section_capture(lines, r"^Device", ["device", "tps", "kb"], exclude="sda[0-9]").drop("file")


@query("src10_kv_colon", "SELECT cast(k AS string) AS total, cast(ivalue AS string) AS free FROM metrics", ["metrics"])
def _(i):
    text = F.concat(lit("MemTotal:       "), col("k").cast("string"), lit(" kB\nMemFree:    "), col("ivalue").cast("string"), lit(" kB\nBuffers: 1 kB"))
    lines = capture(i, i.metrics.select("seq", text.alias("value")), "seq", "meminfo")
    return T.parse_kv_capture(lines, "colon", {"MemTotal": "total", "MemFree": "free"}).select("total", "free")


@query("src10_kv_number", "SELECT cast(k AS string) AS opened, cast(ivalue AS string) AS resets FROM metrics", ["metrics"])
def _(i):
    text = F.concat(lit("Tcp:\n    "), col("k").cast("string"), lit(" active connections openings\n    "), col("ivalue").cast("string"), lit(" resets sent"))
    lines = capture(i, i.metrics.select("seq", text.alias("value")), "seq", "netstat")
    return T.parse_kv_capture(lines, "number", {"active connections openings": "opened", "resets sent": "resets"}).select("opened", "resets")


@query("src10_kv_pair", "SELECT cast(k AS string) AS sent, cast(ivalue AS string) AS lost FROM metrics", ["metrics"])
def _(i):
    text = F.concat(lit("TcpExt: Sent Lost Other\nTcpExt: "), col("k").cast("string"), lit(" "), col("ivalue").cast("string"), lit(" 5"))
    lines = capture(i, i.metrics.select("seq", text.alias("value")), "seq", "tcpext")
    return T.parse_kv_capture(lines, "pair", {"Sent": "sent", "Lost": "lost"}).select("sent", "lost")


@query(
    "src11_block_capture",
    "SELECT cast(c_custkey AS string) AS rx_packets, cast(c_nationkey AS string) AS tx_packets, cast(c_custkey % 7 AS string) AS tx_errors FROM customer",
)
def _(i):
    text = F.concat(
        lit("RX packets "), col("c_custkey").cast("string"), lit("  bytes 9\nTX packets "), col("c_nationkey").cast("string"), lit("  bytes 8\nTX errors "),
        (col("c_custkey") % 7).cast("string"), lit("  dropped 0"),
    )
    lines = capture(i, i.table("customer").select("c_custkey", text.alias("value")), "c_custkey", "ifconfig")
    patterns = {"rx_packets": r"RX packets (\d+)", "tx_packets": r"TX packets (\d+)", "tx_errors": r"TX errors (\d+)"}
    return T.parse_block_capture(lines, "TX errors", patterns).drop("file", "record")


@query(
    "src12_status_page",
    """SELECT cast(s_suppkey * 10 AS string) AS total_accesses, cast(s_nationkey AS string) AS busy_workers, cast(s_suppkey % 5 AS bigint) AS waiting, cast(s_suppkey % 3 AS bigint) AS sending,
      1::bigint AS keepalive FROM supplier""",
)
def _(i):
    text = F.concat(
        lit("Total Accesses: "), (col("s_suppkey") * 10).cast("string"), lit("\nBusyWorkers: "), col("s_nationkey").cast("string"), lit("\nIdleWorkers: 4\nScoreboard: K"),
        F.expr("repeat('_', cast(s_suppkey % 5 AS int))"), F.expr("repeat('W', cast(s_suppkey % 3 AS int))"),
    )
    lines = capture(i, i.table("supplier").select("s_suppkey", text.alias("value")), "s_suppkey", "status")
    return T.parse_status_page(lines).select("total_accesses", "busy_workers", "waiting", "sending", "keepalive")


@query(
    "src13_demux_subsystems",
    "SELECT device AS name, cast(k AS string) AS accepts, cast(ivalue AS string) AS connections FROM metrics WHERE source = 'click'",
    ["metrics"],
)
def _(i):
    body = F.concat(lit(" "), F.concat_ws(",", "device", "k", "ivalue"))
    row = F.when(col("source") == "click", F.concat(lit(">>>20:DATA:"), body)).otherwise(F.concat(lit(">>>10:DATA: x,"), col("source")))
    rows = i.metrics.select("seq", row.alias("value"))
    head = i.metrics.agg(F.min("seq").alias("seq")).select((col("seq") - 1).alias("seq"), lit(">>>10:HEADER: a,b\n>>>20:HEADER: name,accepts,connections").alias("value"))
    lines = capture(i, rows.unionByName(head), "seq", "wls")
    return T.demux_subsystems(lines, "20").drop("file")
