"""Access-log and load-test statistics, backlog inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as A
from .base import Catalog, Inputs

catalog = Catalog()
query = catalog.query
col, lit = F.col, F.lit

# Per server and URL by the hour: the inputs hold few requests per minute.
_RANKED = """SELECT *, row_number() OVER (PARTITION BY minute, server, url ORDER BY ms) AS rn, count(*) OVER (PARTITION BY minute, server, url) AS n
  FROM (SELECT substr(minute, 1, {w}) AS minute, concat('node', cast(node AS string)) AS server, url, second, status, bytes, seconds * 1000 AS ms FROM requests) r"""


def access_sql(width: int, error: str = "'^[45]'", success: str = "'^2'") -> str:
    ranked = _RANKED.format(w=width)
    return f"""SELECT a.*, b.max_rps, b.avg_rps FROM (
      SELECT minute, server, url, count(*) FILTER (regexp_matches(status, {error})) AS errors, count(*) FILTER (regexp_matches(status, {success})) AS success,
        cast(round(sum(ms) / count(*)) AS bigint) AS time_avg_ms,
        cast(round(coalesce(max(CASE WHEN rn = cast(floor(n * 0.95 - 0.5) AS bigint) THEN ms END), 0)) AS bigint) AS time_p95_ms,
        cast(round(coalesce(max(CASE WHEN rn = cast(floor(n * 0.90 - 0.5) AS bigint) THEN ms END), 0)) AS bigint) AS time_p90_ms,
        cast(round(cast(sum(bytes) AS double) / count(*)) AS bigint) AS size_avg_bytes FROM ({ranked}) q GROUP BY 1, 2, 3) a
    JOIN (SELECT minute, server, url, max(c) AS max_rps, round(avg(c), 2) AS avg_rps FROM (
      SELECT minute, server, url, second, count(*) AS c FROM ({ranked}) q GROUP BY 1, 2, 3, 4) s GROUP BY 1, 2, 3) b
    ON a.minute = b.minute AND a.server = b.server AND a.url = b.url"""


def hits(i: Inputs, width: int) -> DataFrame:
    return i.requests.select(
        F.substring("minute", 1, width).alias("minute"), F.concat(lit("node"), col("node").cast("string")).alias("server"),
        "url", "second", "status", "bytes", "seconds",
    )


@query("agg08_access_minute_stats", access_sql(16), ["requests"])
def _(i):
    return A.access_minute_stats(hits(i, 16))


@query("agg08_access_day_stats", access_sql(10, "'4|5[0-9]+'", "'2[0-9]+'"), ["requests"])
def _(i):
    return A.access_minute_stats(hits(i, 10), compat=True)


@query(
    "agg18_throughput",
    "SELECT second, count(*) AS requests, max(all_threads) AS threads FROM samples WHERE success AND elapsed <= 500 GROUP BY second",
    ["samples"],
)
def _(i):
    return A.throughput(i.samples, 500)


@query("agg19_error_rate", "SELECT second, count(*) AS errors, max(all_threads) AS threads FROM samples WHERE NOT success GROUP BY second", ["samples"])
def _(i):
    return A.error_rate(i.samples)


_FILES = """SELECT concat('/logs/', device, '/', device, CASE WHEN source = 'error' AND k % 2 = 0 THEN '.error.out'
    WHEN source = 'error' THEN '_2024-01-01.error.out' WHEN source = 'view' THEN '.csv'
    ELSE concat('_2024-01-', cast(seq AS string), '.log.', cast(k % 10 AS string)) END) AS path, k AS length, timestamp AS seen_at, source, k, device FROM {metrics}"""


@query(
    "agg28_backlog",
    "SELECT device AS instance, "
    + ", ".join(f"count(*) FILTER (source NOT IN ('error', 'view') AND k % 10 = {g}) AS backlog_group_{g}" for g in range(1, 10))
    + f""", count(*) FILTER (source NOT IN ('error', 'view') AND k % 10 > 0) AS backlog_total, coalesce(max(CASE WHEN source = 'error' THEN length END), 0) AS errorlog_size,
      max(CASE WHEN source = 'error' AND length > 0 THEN seen_at END) AS errorlog_time FROM ({_FILES.format(metrics='metrics')}) f GROUP BY device""",
    ["metrics"],
)
def _(i):
    files = i.spark.sql(_FILES, metrics=i.metrics).withColumn("modificationTime", F.timestamp_seconds("seen_at"))
    return A.backlog(files).withColumn("errorlog_time", F.unix_seconds("errorlog_time"))
