"""Call traces, socket captures and other text: lines are made from the tables, then parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as A, filters as L, joins as J, profiles as C, windows as W
from ..sources import captures as T
from ..sources.call_trace import read_call_trace
from ..sources.lines import read_lines
from .base import Catalog, Inputs

catalog = Catalog()
query = catalog.query
col, lit = F.col, F.lit

# One top-level call per order, one nested call per order line; in a fifteenth of these calls nested three more levels.
_LINE_CALLS = """SELECT l_orderkey AS orderkey, concat('PCM_OP_', l_returnflag) AS name, l_quantity / 10 AS duration, l_linenumber AS records,
  CASE WHEN l_suppkey % 10 = 0 THEN l_suppkey % 3 + 1 ELSE 0 END AS bucket, l_suppkey % 3 AS cache_calls, l_linenumber % 2 AS errors, l_partkey % 15 = 0 AS deep,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM {lineitem}"""

# The lines of orders and order lines are brought together as they are, so that one shuffle numbers them; ``n`` counts the lines of an order.
_TRACE_CALLS = """SELECT orderkey, whole, concat('PCM_OP_', l_returnflag) AS name, l_quantity / 10 AS duration, l_linenumber AS records,
  CASE WHEN l_suppkey % 10 = 0 THEN l_suppkey % 3 + 1 ELSE 0 END AS bucket, l_suppkey % 3 AS cache_calls, l_linenumber % 2 AS errors, l_partkey % 15 = 0 AS deep,
  CASE WHEN whole AND orderkey IS NULL THEN 0 ELSE count_if(NOT whole) OVER (
    PARTITION BY orderkey ORDER BY whole, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) END AS n
FROM (SELECT l_orderkey AS orderkey, false AS whole, l_returnflag, l_quantity, l_linenumber, l_suppkey, l_partkey, l_extendedprice FROM {lineitem}
  UNION ALL SELECT o_orderkey, true, NULL, NULL, NULL, NULL, NULL, NULL FROM {orders}) rows"""
_TRACE_ROWS = """SELECT *, concat('cm.', cast(orderkey % 4 AS string), '.20240101_000000.plog.txt') AS trace,
  explode(CASE WHEN whole THEN array(0, 1000000) ELSE array(10 * n) END) AS line_no FROM {calls}"""
_START = "concat_ws(',', 'S', 2, orderkey * 100 + n, 101, 0, name, orderkey * 1000 + 10 * n, 'f.c', 2, 11, 21, 'prog', bucket, 'obj')"
_FINISH = "concat_ws(',', 'F', orderkey * 1000 + 10 * n + duration, records, 1, duration, duration, bucket, bucket + 1, cache_calls, 0.5, errors, 0, 0)"
_DEEP_START = """concat_ws(',', 'S', {level}, (orderkey * 100 + n) * 10 + {level}, 102, 0, concat('SUB_', {level}), orderkey * 1000 + 10 * n, 'f.c', 2, 11, 21, 'prog', 0, 'obj')"""
_DEEP_FINISH = """concat_ws(',', 'F', orderkey * 1000 + 10 * n + duration / power(2, {level} - 2), 1, 1, duration / power(2, {level} - 2), duration / power(2, {level} - 2), 0, 0, 0, 0, 0, 0, 0)"""
_DEEP = [*[_DEEP_START.format(level=n) for n in (3, 4, 5)], *[_DEEP_FINISH.format(level=n) for n in (5, 4, 3)]]
_ORDER_START = "concat_ws(',', 'S', 1, orderkey * 100, 100, 0, 'OP_ORDER', orderkey * 1000, 'f.c', 1, 11, 21, 'prog', 0, 'obj')"
_ORDER_FINISH = "concat_ws(',', 'F', orderkey * 1000 + 10 * (n + 1), 0, 1, 10 * (n + 1), 10 * (n + 1), 0, 0, 0, 0, 0, 0, 0)"
_TRACE_LINES = f"""CASE WHEN whole AND line_no = 0 THEN {_ORDER_START} WHEN whole THEN {_ORDER_FINISH}
  WHEN deep THEN concat_ws('\n', {_START}, {", ".join(_DEEP)}, {_FINISH}) ELSE concat_ws('\n', {_START}, {_FINISH}) END"""

_CALLS_SQL = f"""WITH lines AS ({_LINE_CALLS.format(lineitem='lineitem')}),
calls AS (SELECT orderkey * 100 + n AS opid, 2 AS level, name, 'OP_ORDER.' || name AS path, round(duration, 6) AS duration, cast(records + CASE WHEN deep THEN 3 ELSE 0 END AS bigint) AS records,
    cast(bucket AS bigint) AS bucket, cast(cache_calls AS bigint) AS cache_calls, cast(errors AS bigint) AS errors, orderkey, n FROM lines
  UNION ALL SELECT (orderkey * 100 + n) * 10 + level, level, 'SUB_' || level, 'OP_ORDER.' || name || '.SUB_3' || CASE WHEN level > 3 THEN '.SUB_4' ELSE '' END || CASE WHEN level > 4 THEN '.SUB_5' ELSE '' END,
    round(duration / power(2, level - 2), 6), 6 - level, 0, 0, 0, orderkey, n FROM lines, (SELECT unnest([3, 4, 5]) AS level) d WHERE deep
  UNION ALL SELECT o_orderkey * 100, 1, 'OP_ORDER', 'OP_ORDER', cast(10 * (coalesce(n, 0) + 1) AS double), cast(coalesce(r, 0) AS bigint), 0, 0, 0, o_orderkey, 0
  FROM orders LEFT JOIN (SELECT orderkey, max(n) AS n, sum(CASE WHEN bucket = 0 THEN records ELSE 0 END + CASE WHEN deep THEN 3 ELSE 0 END) AS r FROM lines GROUP BY orderkey) m ON orderkey = o_orderkey) """

PROFILE_COLUMNS = """round(sum(duration), 6) AS total, count(*) AS calls, cast(sum(errors) AS bigint) AS errors, min(duration) AS minimum, max(duration) AS maximum,
  cast(sum(records) AS bigint) AS records, round(100 * sum(duration) / (SELECT sum(duration) FROM calls WHERE level = 1), 2) AS percentage, round(sum(duration) / count(*), 6) AS average"""


def trace_path(i: Inputs) -> str:
    """Trace logs of four processes, one directory per log."""
    calls = i.spark.sql(_TRACE_CALLS, lineitem=i.table("lineitem"), orders=i.table("orders"))
    rows = i.spark.sql(_TRACE_ROWS, calls=calls)
    path = i.scratch("trace")
    # The window deals rows by order: each file holds whole calls. A call's lines are made after the sort, so that short rows are sorted.
    rows.sortWithinPartitions("trace", "orderkey", "line_no").select("trace", F.expr(_TRACE_LINES).alias("value")).write.partitionBy("trace").text(
        path, compression="gzip"
    )
    return path


def calls(i: Inputs, **options) -> DataFrame:
    return W.pair_calls(read_call_trace(i.spark, trace_path(i)), in_place=True, **options)


@query(
    "src06_call_trace",
    f"""{_CALLS_SQL} SELECT cast(orderkey % 4 AS string) AS process, 'cm' AS chain, name, cast(level AS bigint) AS level, count(*) AS starts, cast(sum(opid) AS bigint) AS opids
    FROM calls GROUP BY 1, 2, 3, 4""",
)
def _(i):
    rows = read_call_trace(i.spark, trace_path(i)).filter("kind = 'S'")
    return rows.groupBy("process", "chain", "name", "level").agg(F.count(lit(1)).alias("starts"), F.sum("opid").alias("opids"))


@query(
    "win12_pair_calls",
    f"""{_CALLS_SQL} SELECT opid, cast(level AS bigint) AS level, path, duration, records, level > 1 AS nested FROM calls""",
)
def _(i):
    return calls(i).select(
        "opid", "level", F.array_join("path", ".").alias("path"), "duration", "records", col("parent_id").isNotNull().alias("nested")
    )


@query("agg21_call_profile", f"{_CALLS_SQL} SELECT name, {PROFILE_COLUMNS} FROM calls WHERE bucket = 0 GROUP BY name")
def _(i):
    return C.call_profile(calls(i))


@query("agg22_call_path_profile", f"{_CALLS_SQL} SELECT path, {PROFILE_COLUMNS} FROM calls WHERE bucket = 0 GROUP BY path")
def _(i):
    return C.call_path_profile(calls(i), depth=5)


@query(
    "agg23_exclusive_time",
    f"""{_CALLS_SQL} SELECT path || '.' || v AS path, v AS name, count(*) AS calls, round(sum(rest), 6) AS total FROM (
      SELECT a.path, 'VRT_OP_' || coalesce(nullif(regexp_extract(a.name, '^PCM_OP_(.*)', 1), ''), a.name) AS v, round(a.duration - b.d, 6) AS rest FROM calls a
      JOIN (SELECT orderkey, CASE WHEN level = 2 THEN 0 ELSE n END AS up, level - 1 AS above, sum(duration) AS d FROM calls WHERE level > 1 AND bucket = 0 GROUP BY ALL) b
      ON a.orderkey = b.orderkey AND a.n = up AND a.level = above WHERE a.bucket = 0) q WHERE rest > 0 GROUP BY ALL""",
)
def _(i):
    return C.exclusive_time(calls(i))


@query(
    "agg24_call_buckets",
    f"""{_CALLS_SQL} SELECT b.name, b.bucket, cast(b.bucket AS double) AS range_from, cast(b.bucket + 1 AS double) AS range_to, b.c AS calls,
      round(100.0 * b.c / a.c, 2) AS share FROM (SELECT name, bucket, count(*) AS c FROM calls WHERE bucket > 0 GROUP BY 1, 2) b
      JOIN (SELECT name, count(*) AS c FROM calls WHERE bucket = 0 GROUP BY 1) a ON a.name = b.name""",
)
def _(i):
    return C.call_buckets(calls(i, with_buckets=True))


@query(
    "agg25_cache_profile",
    f"""{_CALLS_SQL} SELECT name, count(*) AS calls, round(sum(duration), 6) AS total FROM calls WHERE bucket = 0 GROUP BY name
    UNION ALL SELECT name || '*TXN*', cast(sum(cache_calls) AS bigint), round(0.5 * count(*), 6) FROM calls WHERE bucket = 0 AND cache_calls > 0 GROUP BY name""",
)
def _(i):
    return C.cache_profile(calls(i))


@query(
    "agg26_call_totals",
    f"""{_CALLS_SQL} SELECT count(DISTINCT name) AS names, count(*) AS calls, cast(sum(errors) AS bigint) AS errors, sum(CASE WHEN level = 1 THEN duration END) AS elapsed,
      round(sum(CASE WHEN name = 'PCM_OP_R' THEN duration END), 6) AS base_elapsed, count(*) FILTER (name = 'PCM_OP_R') AS base_calls,
      round(100.0 * sum(errors) / count(*), 2) AS errors_pct,
      round(100.0 * sum(CASE WHEN name = 'PCM_OP_R' THEN duration END) / sum(CASE WHEN level = 1 THEN duration END), 2) AS base_elapsed_pct,
      round(100.0 * count(*) FILTER (name = 'PCM_OP_R') / count(*), 2) AS base_calls_pct FROM calls WHERE bucket = 0""",
)
def _(i):
    return C.call_totals(calls(i), ["PCM_OP_R"]).drop("files", "calls_per_file", "elapsed_per_file")


@query(
    "flt07_filter_call_path",
    f"""{_CALLS_SQL} SELECT path, level > 1 AS counted, count(*) AS calls FROM calls WHERE path = 'OP_ORDER' OR path || '.' LIKE 'OP_ORDER.PCM_OP_R.%' GROUP BY 1, 2""",
)
def _(i):
    on = L.filter_call_path(calls(i), ["OP_ORDER", "PCM_OP_R"])
    return on.groupBy(F.array_join("path", ".").alias("path"), "counted").agg(F.count(lit(1)).alias("calls"))


@query(
    "flt08_exclude_call_paths",
    f"""{_CALLS_SQL} SELECT path, count(*) AS calls FROM calls WHERE path <> 'OP_ORDER' AND path || '.' NOT LIKE 'OP_ORDER.PCM_OP_A.%' GROUP BY 1""",
)
def _(i):
    kept = L.exclude_call_paths(calls(i), [["OP_ORDER", "PCM_OP_A"]])
    return kept.groupBy(F.array_join("path", ".").alias("path")).agg(F.count(lit(1)).alias("calls"))


@query(
    "srt03_order_profile",
    f"{_CALLS_SQL} SELECT name, {PROFILE_COLUMNS} FROM calls WHERE bucket = 0 GROUP BY name ORDER BY total DESC, name",
)
def _(i):
    return C.order_profile(C.call_profile(calls(i)))


# --- sockets ---------------------------------------------------------------------------------

_SOCKET = """SELECT seq, k AS recv_q, ivalue AS send_q, cast(8000 + CASE WHEN source = 'signup' THEN k % 10 ELSE ivalue % 20 END AS string) AS local_port,
  cast(40000 + k % 3 AS string) AS foreign_port, CASE source WHEN 'signup' THEN 'LISTEN' WHEN 'view' THEN 'TIME_WAIT' ELSE 'ESTABLISHED' END AS state,
  CASE WHEN k % 4 = 0 THEN '-' ELSE concat(cast(k % 6 AS string), '/java') END AS process FROM {metrics}"""


def socket_rows(i: Inputs) -> DataFrame:
    rows = i.spark.sql(_SOCKET, metrics=i.metrics)
    line = F.concat_ws(
        " ", lit("tcp "), "recv_q", "send_q", F.concat(lit("10.0.0.1:"), "local_port"), F.concat(lit("10.0.0.2:"), "foreign_port"), "state", "process"
    )
    path = i.write_lines(rows.select("seq", line.alias("value")), ["seq"], "sockets")
    return T.parse_sockets(read_lines(i.spark, path))


@query(
    "agg09_socket_summary",
    f"""SELECT CASE WHEN contains(process, '/') THEN split_part(process, '/', 1) ELSE '0' END AS pid, CASE WHEN contains(process, '/') THEN split_part(process, '/', 2) ELSE 'unknown' END AS program,
      CASE WHEN inbound THEN local_port ELSE foreign_port END AS port, CASE WHEN inbound THEN 'inbound' ELSE 'outbound' END AS direction, state,
      count(*) AS count, cast(sum(send_q) AS bigint) AS send_q, cast(sum(recv_q) AS bigint) AS recv_q
    FROM (SELECT *, local_port IN (SELECT local_port FROM ({_SOCKET.format(metrics='metrics')}) l WHERE state = 'LISTEN') AS inbound FROM ({_SOCKET.format(metrics='metrics')}) s
      WHERE state <> 'LISTEN') q GROUP BY 1, 2, 3, 4, 5""",
    ["metrics"],
)
def _(i):
    return A.socket_summary(socket_rows(i))


@query(
    "joi06_listening_ports",
    f"""SELECT local_port, local_port IN (SELECT local_port FROM ({_SOCKET.format(metrics='metrics')}) l WHERE state = 'LISTEN') AS inbound, count(*) AS count
    FROM ({_SOCKET.format(metrics='metrics')}) s WHERE state <> 'LISTEN' GROUP BY 1, 2""",
    ["metrics"],
)
def _(i):
    rows = socket_rows(i)
    flagged = J.flag_member(rows.filter("state <> 'LISTEN'"), rows.filter("state = 'LISTEN'"), "local_port", "inbound")
    return A.count_by(flagged, ["local_port", "inbound"])


@query(
    "udf04_text_rows",
    r"""SELECT doc_id, pos, nullif(regexp_extract(line, '^\s*([^ ]+)', 1), '') AS word FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) q WHERE trim(line) <> ''""",
)
def _(i):
    lines = i.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(F.trim("line") != "").select(
        "doc_id", col("pos").cast("long").alias("pos"), F.nullif(F.regexp_extract("line", r"^[ \t\n\f\r]*([^ ]+)", 1), lit("")).alias("word")
    )
