"""Streaming operators: the stream is fed from the tables and read back as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..sinks.delivery import default_writers
from ..sinks.state import StateTable
from ..sources.metric_csv import typed
from ..streaming import alerts as E, jobs as B, stateful as Z
from .base import Catalog, Inputs, common_tables
from .batch import RATES_SQL, rates
from .sources import COMMA_DEVICE, HEADER, LOG_COLUMNS, unlike_logs

catalog = Catalog()
query = catalog.query
col, lit = F.col, F.lit

HALF = "TIMESTAMP_NTZ '2024-01-15 00:00:00'"


class Feed:
    """A directory stream: every :meth:`push` writes rows and processes them as the next micro-batch."""

    def __init__(self, i: Inputs, name: str):
        self.i = i
        self.root, self.out, self.checkpoint = i.scratch(f"{name}-in"), i.scratch(f"{name}-out"), i.scratch(f"{name}-checkpoint")

    def push(self, rows: DataFrame, transform, write=None, mode: str = "append") -> None:
        rows.write.mode("append").parquet(self.root)
        source = self.i.spark.readStream.schema(rows.schema).parquet(self.root)
        B.run_available(transform(source), write or B.to_parquet(self.out), self.checkpoint, mode)

    def result(self) -> DataFrame:
        return self.i.spark.read.parquet(self.out).drop("batch")


@query("str01_stream_dvdt", RATES_SQL, ["metrics", "counters"])
def _(i: Inputs) -> DataFrame:
    rows = i.counters.select("seq", "device", "timestamp", "counter", "k", "ts")
    feed = Feed(i, "rates")
    state = StateTable(i.spark, i.scratch("previous"), ["device"], ["seq"])
    write = B.rate_batches(state, ["device"], "timestamp", ["counter", "k"], ["seq"], B.to_parquet(feed.out))
    for half in (f"ts < {HALF}", f"ts >= {HALF}"):
        feed.push(rows.filter(half).drop("ts"), lambda s: s, write)
    return feed.result()


@query("str01_keyed_state", RATES_SQL, ["metrics", "counters"])
def _(i):
    rows = i.counters.select("seq", "device", "timestamp", "counter", "k", "ts")
    feed = Feed(i, "dvdt")
    for half in (f"ts < {HALF}", f"ts >= {HALF}"):
        feed.push(
            rows.filter(half).drop("ts"), lambda s: Z.stream_dvdt(s, ["device"], "timestamp", ["counter", "k"], ["seq"])
        )
    return feed.result()


@query(
    "str02_stream_state",
    """SELECT 'state' AS part, device, seq FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY seq DESC) AS rn FROM metrics) a WHERE rn = 1
    UNION ALL SELECT 'log', device, seq FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY seq DESC) AS rn FROM metrics) b WHERE rn <= 20""",
    ["metrics"],
)
def _(i):
    rows = i.metrics.select("seq", "device", "value", "ts")
    feed = Feed(i, "state")
    write, state, log = B.stream_state(rows.drop("ts"), i.scratch("latest"), ["device"], ["seq"], 20)
    for half in (f"ts < {HALF}", f"ts >= {HALF}"):
        feed.push(rows.filter(half).drop("ts"), lambda s: s, write)
    parts = [t.read().select(lit(n).alias("part"), "device", "seq") for n, t in (("state", state), ("log", log))]
    return parts[0].unionByName(parts[1])


_FLAGS = """SELECT seq, device, k, cast(sum(CASE WHEN value > 100 AND value >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY device, island ORDER BY seq) AS bigint) AS flag FROM (
  SELECT *, sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY seq) AS island FROM metrics) q"""


@query("str03_flag_counts", _FLAGS, ["metrics"])
def _(i):
    rows = i.metrics.select("seq", "device", "k", "value")
    return E.flag_counts(rows, ["device"], ["seq"], col("value") > 100, col("value") < 5).drop("value")


@query("str03_stream_flags", _FLAGS, ["metrics"])
def _(i):
    rows = i.metrics.select("seq", "device", "k", (col("value") > 100).alias("up"), (col("value") < 5).alias("down"), "ts")
    feed = Feed(i, "flags")
    for half in (f"ts < {HALF}", f"ts >= {HALF}"):
        feed.push(rows.filter(half).drop("ts"), lambda s: Z.stream_flag_counts(s, ["device"], ["seq"], "up", "down"))
    return feed.result().drop("up", "down")


@query(
    "str04_when",
    f"SELECT seq, device, counter, 'flag' AS action, 'counter' AS attribute, cast(counter AS double) AS value_seen, cast(0 AS double) AS \"limit\" FROM ({RATES_SQL}) r WHERE counter > 0",
    ["metrics", "counters"],
)
def _(i):
    return E.when(rates(i), "counter", "gt", 0, "flag").select("seq", "device", "counter", "action", "attribute", "value_seen", "limit")


@query("str05_hysteresis_alert", f"SELECT q.seq, q.device, q.flag FROM ({_FLAGS}) q JOIN (SELECT seq, value FROM metrics) m ON m.seq = q.seq WHERE q.flag > 2 AND m.value > 100", ["metrics"])
def _(i):
    rows = i.metrics.select("seq", "device", "value")
    return E.hysteresis_alert(rows, ["device"], ["seq"], "value", 100, 5, 2).select("seq", "device", "flag")


@query("str06_for_each", "SELECT seq, device, (SELECT count(*) FROM metrics) AS called FROM metrics", ["metrics"])
def _(i):
    called = i.spark.sparkContext.accumulator(0)
    feed = Feed(i, "hook")
    hook = B.for_each(lambda row: called.add(1), "row", passed_on=B.to_parquet(feed.out))
    feed.push(i.metrics.select("seq", "device"), lambda s: s, hook)
    return feed.result().withColumn("called", lit(called.value).cast("long"))


@query(
    "str07_minute_stats",
    """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, source, count(*) AS n, round(sum(value), 4) AS total FROM metrics
    WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM metrics) - INTERVAL 1 MINUTE GROUP BY 1, 2""",
    ["metrics"],
)
def _(i):
    feed = Feed(i, "minutes")
    aggs = {"n": F.count(lit(1)), "total": F.sum("value")}
    feed.push(i.metrics.select("ts", "source", "value"), lambda s: B.minute_stats(s, "ts", ["source"], aggs))
    return feed.result().select(
        F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "source", "n", F.round("total", 4).alias("total")
    )


@query(
    "str08_late_policy",
    """SELECT seq, device, timestamp FROM (
      SELECT *, max(timestamp) OVER (PARTITION BY device ORDER BY k, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM metrics) q
    WHERE newest IS NULL OR timestamp > newest""",
    ["metrics"],
)
def _(i):
    # Rows arrive by k: two batches, each in (k, seq) order.
    rows = i.metrics.select("seq", "device", "timestamp", "k")
    feed = Feed(i, "late")
    for part in ("k < 50", "k >= 50"):
        feed.push(rows.filter(part), lambda s: Z.late_policy(s, "newest", "timestamp", ["device"], ["k", "seq"]))
    return feed.result().drop("k")


_SUPPRESS = (
    "WITH RECURSIVE "
    + common_tables("metrics")[len("WITH ") :]
    + """, runs AS (
  SELECT device, min(timestamp) AS timestamp FROM metrics GROUP BY device
  UNION ALL SELECT r.device, (SELECT min(m.timestamp) FROM metrics m WHERE m.device = r.device AND m.timestamp >= r.timestamp + 86400) FROM runs r WHERE r.timestamp IS NOT NULL)
SELECT device, timestamp, (SELECT min(seq) FROM metrics m WHERE m.device = r.device AND m.timestamp = r.timestamp) AS seq FROM runs r WHERE timestamp IS NOT NULL"""
)


@query("str09_suppress", _SUPPRESS)
def _(i):
    rows = i.metrics.select("device", "timestamp", "seq")
    return E.suppress(rows, ["device"], ["timestamp", "seq"], "timestamp", 86_400)


@query("str09_stream_suppress", _SUPPRESS)
def _(i):
    rows = i.metrics.select("device", "timestamp", "seq", "ts")
    feed = Feed(i, "suppress")
    for half in (f"ts < {HALF}", f"ts >= {HALF}"):
        feed.push(
            rows.filter(half).drop("ts"), lambda s: Z.stream_suppress(s, ["device"], ["timestamp", "seq"], "timestamp", 86_400)
        )
    return feed.result()


# Groups of three events within 36 hours of the first, per device.
FAN_N, FAN_S = 3, 129_600
_FAN_GROUPS = (
    "WITH RECURSIVE "
    + common_tables("metrics")[len("WITH ") :]
    + f""", rows AS (SELECT device, epoch_ms(date_trunc('millisecond', ts)) AS t, row_number() OVER (PARTITION BY device ORDER BY seq) AS rn FROM metrics),
groups AS (
  SELECT device, cast(1 AS bigint) AS s FROM rows WHERE rn = 1
  UNION ALL SELECT g.device, g.s + (SELECT count(*) FROM rows r, rows f WHERE r.device = g.device AND f.device = g.device AND f.rn = g.s
    AND r.rn BETWEEN g.s AND g.s + {FAN_N - 1} AND r.t < f.t + {FAN_S * 1000}) FROM groups g
    WHERE g.s <= (SELECT max(rn) FROM rows r WHERE r.device = g.device)),
closed AS (
  SELECT g.device, f.t AS started, count(*) AS events, count(*) = {FAN_N} AS complete, CASE WHEN count(*) = {FAN_N} THEN max(r.t) ELSE f.t + {FAN_S * 1000} END AS emitted
  FROM groups g JOIN rows f ON f.device = g.device AND f.rn = g.s JOIN rows r ON r.device = g.device AND r.rn BETWEEN g.s AND g.s + {FAN_N - 1} AND r.t < f.t + {FAN_S * 1000}
  GROUP BY g.device, g.s, f.t) """
)


@query(
    "str10_fan_in_batch",
    _FAN_GROUPS + "SELECT device, started, emitted, events, complete FROM closed",
)
def _(i):
    rows = i.metrics.select("device", "seq", F.unix_millis(col("ts").cast("timestamp")).alias("t"))
    out = E.fan_in_batch(rows, ["device"], ["seq"], "t", FAN_N, FAN_S * 1000)
    return out.select("device", col("started").cast("long").alias("started"), col("emitted").cast("long").alias("emitted"), "events", "complete")


@query(
    "str10_stream_fan_in",
    _FAN_GROUPS
    + "SELECT device, started, emitted, events, complete FROM closed WHERE complete OR emitted < (SELECT max(t) FROM rows) - 60000",
)
def _(i):
    rows = i.metrics.select("device", "seq", col("ts").cast("timestamp").alias("ts"))
    feed = Feed(i, "fan")
    feed.push(rows, lambda s: Z.fan_in(s.withWatermark("ts", "1 minute"), ["device"], ["seq"], "ts", FAN_N, FAN_S))
    return feed.result()


@query(
    "str11_push_job",
    f"""SELECT timestamp * 1000000000 AS time, {COMMA_DEVICE} AS device, source, value, value * 2 AS doubled FROM metrics
    WHERE value > 1 AND source <> 'view' AND seq % 5 <> 2
    UNION ALL SELECT timestamp * 1000000000, NULL, source, value, value * 2 FROM metrics WHERE value > 1 AND source <> 'view' AND seq % 5 = 2""",
    ["metrics"],
)
def _(i):
    root, out = i.scratch("push-in"), i.scratch("push-out")
    unlike_logs(i, root, "instance")

    def to_points(log: DataFrame) -> DataFrame:
        at = S.to_epoch_nanos(col("timestamp").cast("long"), "s")
        return B.push_points(typed(log), ["device", "source"], ["value"], at, ["doubled = value * 2"], "value > 1 AND source <> 'view'")

    sink = default_writers().create("points", {"name": "metrics", "path": out})
    B.push_job(i.spark, root, ["device", "value"], to_points, sink, i.scratch("checkpoint"), "part-*", max_files=40, header=HEADER)
    back = i.spark.read.schema("time LONG, tags MAP<STRING, STRING>, fields MAP<STRING, DOUBLE>").json(out)
    return back.select(
        "time", col("tags")["device"].alias("device"), col("tags")["source"].alias("source"), col("fields")["value"].alias("value"),
        col("fields")["doubled"].alias("doubled"),
    )


@query(
    "str12_stream_headers",
    f"""SELECT datetime, timestamp AS timestamp, {COMMA_DEVICE} AS device,
      CASE WHEN seq % 2 = 0 THEN cast(value AS string) ELSE '(!)' END AS value, '(!)' AS absent FROM metrics""",
    ["metrics"],
)
def _(i):
    root, out = i.scratch("header-in"), i.scratch("header-out")
    # Every file starts with a header, in one of two orders; one of them lacks the value.
    rows = i.metrics.withColumn("device", F.expr(COMMA_DEVICE))
    rows.filter("seq % 2 = 0").select(*LOG_COLUMNS).write.csv(root, header=True)
    rows.filter("seq % 2 <> 0").select(*LOG_COLUMNS[:5], "seq", "device").write.mode("append").csv(root, header=True)
    lines = B.stream_lines(i.spark, root)
    B.run_available(lines, B.stream_headers(["device", "value", "absent"], B.to_parquet(out)), i.scratch("checkpoint"))
    back = i.spark.read.parquet(out)
    return back.select("datetime", col("timestamp").cast("long").alias("timestamp"), "device", "value", "absent")
