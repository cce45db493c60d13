"""Flow analytics over application tables: instances, faults, message groups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..operators import aggregates as A, joins as J, sets as U
from ..sources.sql_metric import metric_table, rules, run_sql_metric
from .base import Catalog, Inputs

catalog = Catalog()
query = catalog.query
col, lit = F.col, F.lit

CONSUMER, PRODUCER, ROUTER = "default/OrderConsumer%", "default/OrderProducer%", "default/OrderRouter%"
FLOWS = {"ORDER": (CONSUMER, PRODUCER), "ROUTE": (ROUTER, PRODUCER)}

_PAIR = """SELECT '{flow}' AS flow, b.ecid, b.id, b.title, b.created, cast(epoch(b.created) - epoch(a.created) AS double) AS duration
FROM instances a JOIN instances b ON a.ecid = b.ecid WHERE a.composite_dn LIKE '{a}' AND b.composite_dn LIKE '{b}'"""
_PAIRS = " UNION ALL ".join(_PAIR.format(flow=n, a=a, b=b) for n, (a, b) in FLOWS.items())


@query("joi01_pair_stages", f"SELECT ecid, id, duration FROM ({_PAIR.format(flow='ORDER', a=CONSUMER, b=PRODUCER)}) q", ["instances"])
def _(i: Inputs) -> DataFrame:
    rows = i.instances.select("ecid", "id", "composite_dn", "created")
    dn = col("composite_dn")
    return J.pair_stages(rows, ["ecid"], dn.like(CONSUMER), dn.like(PRODUCER)).select("ecid", "id", "duration")


@query("joi01_pair_flows", f"SELECT flow, ecid, id, duration FROM ({_PAIRS}) q", ["instances"])
def _(i):
    rows = i.instances.select("ecid", "id", "composite_dn", "created")
    return J.pair_flows(rows, "composite_dn", "ecid", FLOWS).select("flow", "ecid", "id", "duration")


@query(
    "joi02_fault_rows",
    "SELECT i.id, i.title, 'ERROR' AS err FROM instances i JOIN faults f ON i.id = f.composite_instance_id",
    ["instances", "faults"],
)
def _(i):
    return J.fault_rows(i.instances.select("id", "title"), i.faults)


@query(
    "joi03_enrich",
    """SELECT i.id, i.ecid, f.error_message, o.o_orderpriority AS priority FROM instances i
    LEFT JOIN faults f ON i.id = f.composite_instance_id LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o.o_orderkey = i.ecid""",
    ["instances", "faults"],
)
def _(i):
    faults = i.faults.select(col("composite_instance_id").alias("id"), "error_message")
    orders = i.table("orders").filter("o_orderstatus <> 'P'").select(col("o_orderkey").alias("ecid"), col("o_orderpriority").alias("priority"))
    return J.enrich(i.instances.select("id", "ecid"), [(faults, ["id"]), (orders, ["ecid"])]).select(
        "id", "ecid", "error_message", "priority"
    )


_GROUPS = """SELECT o_orderkey AS owner_id, o_orderkey % 10 AS group_id, o_custkey % 7 AS group_status,
  concat('default/comp/C', cast(o_custkey % 13 AS string)) AS component_dn, o_custkey % 29 AS container_id FROM {orders}"""
_MESSAGES = """SELECT l_orderkey AS owner_id, CASE WHEN l_partkey % 5 = 0 THEN 99 ELSE l_orderkey % 10 END AS group_id, l_suppkey % 7 AS message_status,
  l_linenumber FROM {lineitem}"""


def grouped_messages(i: Inputs) -> DataFrame:
    groups = i.spark.sql(_GROUPS, orders=i.table("orders"))
    messages = i.spark.sql(_MESSAGES, lineitem=i.table("lineitem"))
    return J.group_messages(groups, messages, ["owner_id", "group_id"])


_GROUPED_SQL = f"""SELECT g.*, m.message_status, m.l_linenumber FROM ({_GROUPS.format(orders='orders')}) g JOIN ({_MESSAGES.format(lineitem='lineitem')}) m
  ON m.owner_id = g.owner_id AND m.group_id = g.group_id WHERE g.group_status <= 3 AND m.message_status <= 3"""


@query("joi04_group_messages", f"SELECT owner_id, group_id, group_status, message_status, l_linenumber FROM ({_GROUPED_SQL}) q")
def _(i):
    return grouped_messages(i).select("owner_id", "group_id", "group_status", "message_status", "l_linenumber")


_LEASES = "SELECT c_custkey + 500 AS container_id, c_acctbal AS renewal_time FROM {customer}"
_HELD = "SELECT o_custkey AS container_id, o_orderkey % 5 AS status FROM {orders}"
_COUNTS = "count(*) FILTER (status = 3) AS error_groups, count(*) FILTER (status = 1) AS locked_groups"


@query(
    "joi05_coverage_union",
    f"""SELECT mg.container_id, {_COUNTS} FROM ({_HELD.format(orders='orders')}) mg LEFT JOIN ({_LEASES.format(customer='customer')}) l
      ON mg.container_id = l.container_id WHERE mg.status IN (1, 3) GROUP BY mg.container_id, l.renewal_time
    UNION SELECT mg.container_id, {_COUNTS} FROM ({_LEASES.format(customer='customer')}) l LEFT JOIN ({_HELD.format(orders='orders')}) mg
      ON mg.container_id = l.container_id GROUP BY mg.container_id, l.renewal_time""",
)
def _(i):
    groups = i.spark.sql(_HELD, orders=i.table("orders"))
    leases = i.spark.sql(_LEASES, customer=i.table("customer"))
    return J.coverage_union(groups, leases, "container_id", "status")


@query(
    "joi06_flag_member",
    """SELECT l_orderkey, l_partkey, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AS inbound FROM lineitem""",
)
def _(i):
    big = i.table("part").filter("p_size > 25").select(col("p_partkey").alias("l_partkey"))
    return J.flag_member(i.table("lineitem").select("l_orderkey", "l_partkey"), big, "l_partkey", "inbound")


_ITEM = "regexp_extract(composite_dn, 'default/(.*)!', 1)"
_CLASSES = {"OrderConsumer, OrderProducer": "PAIR", "OrderRouter": "ROUTED", "OrderConsumer, OrderConsumer": "TWICE"}


@query(
    "joi07_join_flow_class",
    f"""SELECT i.id, i.ecid, CASE chain {' '.join(f"WHEN '{c}' THEN '{n}'" for c, n in _CLASSES.items())} ELSE 'UNKNOWN' END AS flow
    FROM instances i JOIN (SELECT ecid, string_agg({_ITEM}, ', ' ORDER BY created, id, {_ITEM}) AS chain FROM instances GROUP BY ecid) c ON i.ecid = c.ecid""",
    ["instances"],
)
def _(i):
    rows = i.instances.withColumn("item", F.expr(_ITEM)).select("id", "ecid", "item", "created")
    return J.join_flow_class(rows, "ecid", "item", ["created", "id"], _CLASSES).select("id", "ecid", "flow")


@query(
    "joi08_align_series",
    """SELECT a.bucket, round(a.clicks, 6) AS clicks, round(b.views, 6) AS views FROM
      (SELECT timestamp // 3600 * 3600 AS bucket, avg(value) AS clicks FROM metrics WHERE source = 'click' GROUP BY 1) a LEFT JOIN
      (SELECT timestamp // 3600 * 3600 AS bucket, avg(value) AS views FROM metrics WHERE source = 'view' GROUP BY 1) b ON a.bucket = b.bucket""",
    ["metrics"],
)
def _(i):
    clicks = A.resample(i.metrics.filter("source = 'click'"), [], "ts", 3600, ["value"], fill=False)
    views = A.resample(i.metrics.filter("source = 'view'"), [], "ts", 3600, ["value"], fill=False)
    both = J.align_series(clicks.withColumnRenamed("value", "clicks"), views.withColumnRenamed("value", "views"), ["bucket"])
    return both.select("bucket", F.round("clicks", 6).alias("clicks"), F.round("views", 6).alias("views"))


_FIRST_LONGEST = """SELECT t1.ecid, ci.id, ci.composite_dn, ci.title, t1.first_created, t2.error_message FROM
  (SELECT ecid, composite_instance_id AS cid, created AS first_created FROM (
     SELECT *, row_number() OVER (PARTITION BY ecid ORDER BY created, fault_id) AS rn FROM faults) a WHERE rn = 1) t1
  JOIN (SELECT ecid, error_message FROM (
     SELECT *, row_number() OVER (PARTITION BY ecid ORDER BY length(error_message) DESC, created, fault_id) AS rn FROM faults) b WHERE rn = 1) t2 ON t1.ecid = t2.ecid
  JOIN faults f ON f.ecid = t1.ecid JOIN instances ci ON ci.id = t1.cid"""


def first_and_longest(i: Inputs) -> DataFrame:
    return J.first_and_longest(
        i.faults, i.instances.select("id", "ecid", "composite_dn", "title"), "ecid", ["created", "fault_id"], "error_message"
    )


@query("joi09_first_and_longest", f"SELECT ecid, id, title, error_message FROM ({_FIRST_LONGEST}) q", ["instances", "faults"])
def _(i):
    return first_and_longest(i).select("ecid", "id", "title", "error_message")


# --- aggregates over flows -------------------------------------------------------------------

_FLOW_ROWS = f"""SELECT flow, created, duration, NULL AS err FROM ({_PAIRS}) p
UNION ALL SELECT CASE WHEN composite_dn LIKE '{CONSUMER}' THEN 'ORDER' ELSE 'ROUTE' END, i.created, NULL, 'ERROR'
FROM instances i JOIN faults f ON i.id = f.composite_instance_id WHERE composite_dn LIKE '{CONSUMER}' OR composite_dn LIKE '{ROUTER}'"""


@query(
    "agg03_flow_stats",
    f"""SELECT flow, strftime(created, '%y-%m-%d %H:%M') AS minute, count(*) AS count_all, count(*) FILTER (err IS NULL) AS count_ok, count(err) AS count_err,
      round(min(duration), 2) AS min, round(max(duration), 2) AS max, round(avg(duration), 2) AS avg FROM ({_FLOW_ROWS}) q GROUP BY 1, 2""",
    ["instances", "faults"],
)
def _(i):
    rows = i.instances.select("id", "ecid", "composite_dn", "created")
    done = J.pair_flows(rows, "composite_dn", "ecid", FLOWS).select("flow", "created", "duration", lit(None).cast("string").alias("err"))
    starts = {n: f"composite_dn LIKE '{a}'" for n, (a, _) in FLOWS.items()}
    failed = U.union_flows(J.fault_rows(rows, i.faults), starts).select(
        "flow", "created", lit(None).cast("double").alias("duration"), "err"
    )
    every = done.unionByName(failed).withColumn("minute", S.minute_of(col("created")))
    return A.flow_stats(every, ["flow", "minute"]).withColumn("minute", S.minute_text(col("minute")))


_STEPS = f"""SELECT i.ecid, i.id AS instance_id, {_ITEM} || ' (' || cast(i.quantity % 3 AS string) || ')' AS cdn, i.created,
  greatest(i.created, coalesce(o.o_orderdate, TIMESTAMP '2018-01-01' - INTERVAL 9000 DAY)) AS end_time, f.created AS faulted_time
  FROM instances i LEFT JOIN faults f ON i.ecid = f.ecid LEFT JOIN orders o ON o.o_orderkey * 10 + 1 = i.id"""


def chain_steps(i: Inputs) -> DataFrame:
    step = i.instances.select("id", "ecid", F.concat(F.expr(_ITEM), lit(" ("), (col("quantity") % 3).cast("string"), lit(")")).alias("cdn"), "created")
    faulted = i.faults.select("ecid", col("created").alias("faulted_time"))
    changed = i.table("orders").select((col("o_orderkey") * 10 + 1).alias("id"), col("o_orderdate").alias("modified"))
    rows = J.enrich(step, [(changed, ["id"]), (faulted, ["ecid"])])  # by flow last, as flows are grouped next
    end = S.greatest_of([col("created"), col("modified")], F.expr("TIMESTAMP_NTZ '1993-05-11'"))
    return rows.withColumn("end_time", end).withColumnRenamed("id", "instance_id")


@query(
    "agg07_flow_chain_stats",
    f"""SELECT count(*) AS count, count(faulted_time) AS count_faulted, round(min(d), 3) AS min_time, round(max(d), 3) AS max_time, round(avg(d), 3) AS avg_time,
      quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.9) AS p90, quantile_disc(d, 0.95) AS p95, min(instance_id) AS sample_cid,
      split_part(cdns, ',', 1) AS entry_point, cdns
    FROM (SELECT ecid, min(instance_id) AS instance_id, cast(epoch(max(end_time)) - epoch(min(created)) AS double) AS d, min(faulted_time) AS faulted_time,
      string_agg(cdn, ', ' ORDER BY created, instance_id, cdn) AS cdns FROM ({_STEPS}) s GROUP BY ecid) q GROUP BY cdns""",
    ["instances", "faults"],
)
def _(i):
    return A.flow_chain_stats(chain_steps(i))


@query(
    "agg10_pool_usage",
    """SELECT system, count(*) FILTER (k * 20 > 900) AS blocked, cast(round(avg(ivalue)) AS bigint) AS avg_used_ms, max(ivalue) AS max_used_ms,
      coalesce(max(CASE WHEN rn = cast(floor(n * 0.95 - 0.5) AS bigint) THEN ivalue END), 0) AS p95_used_ms,
      coalesce(max(CASE WHEN rn = cast(floor(n * 0.90 - 0.5) AS bigint) THEN ivalue END), 0) AS p90_used_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY ivalue) AS rn, count(*) OVER (PARTITION BY system) AS n FROM metrics) q GROUP BY system""",
    ["metrics"],
)
def _(i):
    return A.pool_usage(i.metrics.withColumn("held", col("k") * 20), ["system"], "ivalue", "held")


_COMPONENTS = "SELECT o_orderkey * 10 + 1 AS id, CASE o_custkey % 5 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 0 END AS component_state FROM {orders}"


@query(
    "agg11_batch_outcomes",
    f"""SELECT regexp_extract(conversation_id, '.+%(.+)', 1) AS batch_id, component_state, min(created) AS first_time, max(created) AS last_time,
      min(i.id) AS first_cid, count(*) AS num_records,
      CASE component_state WHEN 8 THEN 'STUCK' WHEN 4 THEN 'ERROR-RUN' WHEN 0 THEN 'SUCCESS' ELSE 'ERROR-OTHER' END AS result
    FROM instances i JOIN ({_COMPONENTS.format(orders='orders')}) c ON i.id = c.id WHERE component_state IS NOT NULL GROUP BY 1, 2""",
    ["instances"],
)
def _(i):
    components = i.spark.sql(_COMPONENTS, orders=i.table("orders"))
    return A.batch_outcomes(i.instances.select("id", "conversation_id", "created"), components)


def _code(name: str) -> str:
    return f"nullif(regexp_extract(error_message, '(?i){A.ERROR_PATTERNS[name]}', 1), '')"


_TAXONOMY = f"""SELECT CASE WHEN composite_dn LIKE '{CONSUMER}' AND title LIKE 'SBL%' THEN 'IN-L1' WHEN composite_dn LIKE '{CONSUMER}' THEN 'IN-L2'
    WHEN composite_dn LIKE '{PRODUCER}' THEN 'OUT' ELSE 'UNKNOWN - ' || {_ITEM} END AS flow,
  coalesce(nullif(concat({_code('xml')}, {_code('brm')}, {_code('jca')}, {_code('oramed')}, {_code('sbl')},
    CASE WHEN instr(error_message, 'Unable to access the following endpoint') > 0 THEN 'HTTP_TIMEOUT'
      WHEN instr(error_message, 'The transaction might have timedout') > 0 THEN 'JTA_TIMEOUT'
      WHEN instr(error_message, 'The result of from-spec is null') > 0 THEN 'DATA_ERROR' END,
    {_code('aia')}, CASE WHEN {_code('brm')} IS NULL THEN {_code('brm2')} END, {_code('jms')}), ''), 'UNKNOWN_ERROR') AS error_type, first_created
  FROM ({_FIRST_LONGEST}) x WHERE title NOT LIKE '%-13%'"""


@query(
    "agg12_error_taxonomy",
    f"SELECT flow, error_type, count(*) AS count, max(first_created) AS newest FROM ({_TAXONOMY}) q GROUP BY 1, 2",
    ["instances", "faults"],
)
def _(i):
    dn = col("composite_dn")
    rules = [
        (dn.like(CONSUMER) & col("title").like("SBL%"), "IN-L1"),
        (dn.like(CONSUMER), "IN-L2"),
        (dn.like(PRODUCER), "OUT"),
    ]
    rows = first_and_longest(i).filter(~col("title").like("%-13%"))
    return A.error_taxonomy(rows, "error_message", rules, F.concat(lit("UNKNOWN - "), F.expr(_ITEM)), "first_created")


_RESULT_SQL = """CASE WHEN state <> 32 AND error_message IS NULL THEN 'JTA Timeout' WHEN instr(error_message, 'nable to access the following endpoint') > 0 THEN 'PL Timeout'
  WHEN instr(error_message, 'timedout') > 0 THEN 'Transaction Timeout' WHEN error_message IS NULL THEN 'OK' ELSE 'Other Error' END"""


@query(
    "agg13_classify_count",
    f"""SELECT strftime(i.created, '%y-%m-%d %H:%M') AS minute, {_RESULT_SQL} AS result,
      CASE WHEN instr(composite_dn, 'Consumer') > 0 THEN 'IN' WHEN instr(composite_dn, 'Producer') > 0 THEN 'OUT' ELSE 'UNKNOWN' END AS flow, count(*) AS count
    FROM instances i LEFT JOIN faults f ON i.id = f.composite_instance_id GROUP BY 1, 2, 3""",
    ["instances", "faults"],
)
def _(i):
    faults = i.faults.select(col("composite_instance_id").alias("id"), "error_message")
    rows = J.enrich(i.instances, [(faults, ["id"])]).withColumn("minute", S.minute_of(col("created")))
    text = col("error_message")
    results = [
        ((col("state") != 32) & text.isNull(), "JTA Timeout"),
        (F.instr(text, "nable to access the following endpoint") > 0, "PL Timeout"),
        (F.instr(text, "timedout") > 0, "Transaction Timeout"),
        (text.isNull(), "OK"),
    ]
    flows = [(F.instr("composite_dn", "Consumer") > 0, "IN"), (F.instr("composite_dn", "Producer") > 0, "OUT")]
    return A.classify_count(rows, ["minute"], results, flows).withColumn("minute", S.minute_text(col("minute")))


@query(
    "agg14_status_matrix",
    f"""SELECT coalesce(CASE group_status WHEN 0 THEN 'READY' WHEN 1 THEN 'LOCKED' WHEN 3 THEN 'ERRORED' END, '') || '-' ||
        coalesce(CASE message_status WHEN 0 THEN 'READY' WHEN 2 THEN 'PROCESSED' WHEN 3 THEN 'ERRORED' END, '') AS status,
      group_status, message_status, count(*) AS count, split_part(component_dn, '/', -1) AS component, container_id
    FROM ({_GROUPED_SQL}) q GROUP BY component_dn, group_status, message_status, container_id""",
)
def _(i):
    return A.status_matrix(grouped_messages(i))


# --- saved SQL metrics -----------------------------------------------------------------------


@query(
    "src14_sql_metric",
    """SELECT strftime(created, '%y-%m-%d %H:%M') AS time,
      CASE WHEN substr(title, 1, 3) IN ('SBL', 'IVR', 'WEB', 'PNT', 'TIL') THEN substr(title, 1, 3) ELSE '-OTHER' END AS channel, count(*) AS count
    FROM instances WHERE created >= TIMESTAMP '2000-11-27 05:27:00' AND created < TIMESTAMP '2000-11-27 05:28:00' GROUP BY 1, 2""",
    ["instances"],
)
def _(i):
    return run_sql_metric(i.spark, "channels", {"FLOW": ""}, datetime(2000, 11, 27, 5, 29, 30), {"instances": i.instances})


@query("src14_sql_metric_entities", "SELECT '24-02-01 00:00' AS time, source AS entity_type, count(*) AS count FROM metrics GROUP BY source", ["metrics"])
def _(i):
    entities = i.metrics.withColumnRenamed("source", "entity_type")
    return run_sql_metric(i.spark, "entities", {"ENTITY": ""}, datetime(2024, 2, 1), {"entities": entities})


# Saved table functions. A window of two years, of which the last whole minute ends a minute before ``AS_OF``.
AS_OF, WINDOW_MINUTES = datetime(1997, 6, 1, 12, 0, 30), 2 * 525_600
_IN_WINDOW = "{0} >= TIMESTAMP '1997-06-01 11:59:00' - INTERVAL 730 DAY AND {0} < TIMESTAMP '1997-06-01 11:59:00'"


@query(
    "src14_flow_statistics",
    f"""SELECT strftime(created, '%y-%m-%d %H:%M') AS time, flow, count(*) AS count_all, count(*) FILTER (err IS NULL) AS count_ok, count(err) AS count_err,
      round(min(duration), 2) AS min, round(max(duration), 2) AS max, round(avg(duration), 2) AS avg
    FROM ({_FLOW_ROWS}) q WHERE {_IN_WINDOW.format('created')} GROUP BY 1, 2""",
    ["instances", "faults"],
)
def _(i):
    flows = rules(["flow", "first_dn", "last_dn"], [(n, a, b) for n, (a, b) in FLOWS.items()])
    tables = {"instances": i.instances, "faults": i.faults}
    return metric_table(i.spark, "flow_statistics", AS_OF, {"minutes": WINDOW_MINUTES, "flows": flows}, tables)


_FAULT_AS_OF, _FAULT_MINUTES = datetime(2024, 1, 20, 12, 0, 30), 14_400


@query(
    "src14_error_taxonomy",
    f"""SELECT strftime(max(first_created), '%y-%m-%d %H:%M') AS time, flow, count(*) AS count, error_type FROM (
      SELECT CASE WHEN composite_dn LIKE '{CONSUMER}' AND title LIKE 'SBL%' THEN 'IN-L1' WHEN composite_dn LIKE '{CONSUMER}' THEN 'IN-L2'
          WHEN composite_dn LIKE '{PRODUCER}' THEN 'OUT' ELSE 'UNKNOWN - ' || {_ITEM} END AS flow, first_created,
        coalesce(nullif(concat({_code('xml')}, {_code('brm')}, {_code('jca')}, {_code('oramed')}, {_code('sbl')},
          CASE WHEN instr(error_message, 'Unable to access the following endpoint') > 0 THEN 'HTTP_TIMEOUT'
            WHEN instr(error_message, 'The transaction might have timedout') > 0 THEN 'JTA_TIMEOUT'
            WHEN instr(error_message, 'The result of from-spec is null') > 0 THEN 'DATA_ERROR' END,
          {_code('aia')}, CASE WHEN {_code('brm')} IS NULL THEN {_code('brm2')} END, {_code('jms')}), ''), 'UNKNOWN_ERROR') AS error_type
      FROM (SELECT ecid, composite_instance_id AS id, created AS first_created, row_number() OVER (PARTITION BY ecid ORDER BY created, fault_id) AS rn FROM faults) a
        JOIN (SELECT ecid, error_message, row_number() OVER (PARTITION BY ecid ORDER BY length(error_message) DESC, created, fault_id) AS rn FROM faults) b
          ON a.ecid = b.ecid AND a.rn = 1 AND b.rn = 1
        JOIN (SELECT ecid FROM faults WHERE created >= TIMESTAMP '2024-01-10 11:59:00' AND created < TIMESTAMP '2024-01-20 11:59:00') c ON a.ecid = c.ecid
        JOIN instances i ON a.id = i.id) q
    GROUP BY flow, error_type""",
    ["instances", "faults"],
)
def _(i):
    flows = rules(["flow", "dn", "title"], [("IN-L1", CONSUMER, "SBL%"), ("IN-L2", CONSUMER, "%"), ("OUT", PRODUCER, "%")])
    tables = {"instances": i.instances, "faults": i.faults}
    return metric_table(i.spark, "error_taxonomy", _FAULT_AS_OF, {"minutes": _FAULT_MINUTES, "flows": flows}, tables)


@query(
    "src14_status_matrix",
    f"""SELECT '2024-02-01 00:00:00' AS time, coalesce(CASE group_status WHEN 0 THEN 'READY' WHEN 1 THEN 'LOCKED' WHEN 3 THEN 'ERRORED' END, '') || '-' ||
        coalesce(CASE message_status WHEN 0 THEN 'READY' WHEN 2 THEN 'PROCESSED' WHEN 3 THEN 'ERRORED' END, '') AS status,
      group_status, message_status, count(*) AS count, split_part(component_dn, '/', -1) AS component, container_id
    FROM ({_GROUPED_SQL}) q GROUP BY component_dn, group_status, message_status, container_id""",
)
def _(i):
    tables = {
        "message_groups": i.spark.sql(_GROUPS, orders=i.table("orders")),
        "messages": i.spark.sql(_MESSAGES, lineitem=i.table("lineitem")),
    }
    return metric_table(i.spark, "status_matrix", datetime(2024, 2, 1), {"max_status": 3}, tables)


@query(
    "src14_container_locks",
    f"""SELECT '2024-02-01 00:00:00' AS time, * FROM (
    SELECT mg.container_id, {_COUNTS} FROM ({_HELD.format(orders='orders')}) mg LEFT JOIN ({_LEASES.format(customer='customer')}) l
      ON mg.container_id = l.container_id WHERE mg.status IN (1, 3) GROUP BY mg.container_id, l.renewal_time
    UNION SELECT mg.container_id, {_COUNTS} FROM ({_LEASES.format(customer='customer')}) l LEFT JOIN ({_HELD.format(orders='orders')}) mg
      ON mg.container_id = l.container_id GROUP BY mg.container_id, l.renewal_time) q""",
)
def _(i):
    tables = {
        "message_groups": i.spark.sql(_HELD, orders=i.table("orders")).withColumnRenamed("status", "group_status"),
        "leases": i.spark.sql(_LEASES, customer=i.table("customer")),
    }
    return metric_table(i.spark, "container_locks", datetime(2024, 2, 1), tables=tables)


@query(
    "src14_chain_statistics",
    f"""SELECT count(*) AS count, count(faulted_time) AS count_faulted, round(min(d), 3) AS min_time, round(max(d), 3) AS max_time, round(avg(d), 3) AS avg_time,
      quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.9) AS p90, quantile_disc(d, 0.95) AS p95, min(instance_id) AS sample_cid,
      split_part(cdns, ',', 1) AS entry_point, cdns
    FROM (SELECT ecid, min(instance_id) AS instance_id, cast(epoch(max(end_time)) - epoch(min(created)) AS double) AS d, min(faulted_time) AS faulted_time,
      string_agg(cdn, ', ' ORDER BY created, instance_id, cdn) AS cdns FROM ({_STEPS}) s GROUP BY ecid HAVING {_IN_WINDOW.format('min(created)')}) q GROUP BY cdns""",
    ["instances", "faults"],
)
def _(i):
    steps = chain_steps(i)
    return metric_table(i.spark, "chain_statistics", AS_OF, {"minutes": WINDOW_MINUTES}, {"steps": steps})
