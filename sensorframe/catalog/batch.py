"""Projections, filters, windows, sorts, sets, scalar functions and plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalars as S
from ..functions.transforms import TransformRegistry, default_transforms
from ..operators import aggregates as A, filters as L, percentiles as P, project as R, sets as U, sorts as O, windows as W
from .base import Catalog, Inputs, common_tables

catalog = Catalog()
query = catalog.query
col, lit = F.col, F.lit


def r6(name: str):
    return F.round(name, 6).alias(name)


# --- projections ---------------------------------------------------------------------------


@query(
    "prj01_rewrite_columns",
    "SELECT datetime, timezone, timestamp, system, source, k, '(!)' AS missing, device FROM metrics",
    ["metrics"],
)
def _(i: Inputs) -> DataFrame:
    rows = i.metrics.select(*R.SYSTEM_COLUMNS, "device", "value", "k")
    return R.rewrite_columns(rows, ["k", "missing", "device"])


@query(
    "prj02_add_timestamp",
    """SELECT datetime, timezone, timestamp, 'sys' AS system, 'probe' AS source, seq, value FROM metrics""",
    ["metrics"],
)
def _(i):
    return R.add_timestamp(i.metrics.select("seq", "value", "ts"), "sys", "probe", col("ts")).drop("ts")


@query(
    "prj03_split_tags_fields",
    """SELECT seq, system AS tag_system, device AS tag_device, 2 AS n_tags, value AS field_value, cast(NULL AS double) AS field_source
    FROM metrics""",
    ["metrics"],
)
def _(i):
    out = R.split_tags_fields(i.metrics, ["device", "!source"], ["value", "source"], ["system", "source"], keep=["seq"])
    return out.select(
        "seq", col("tags")["system"].alias("tag_system"), col("tags")["device"].alias("tag_device"),
        F.size("tags").alias("n_tags"), col("fields")["value"].alias("field_value"),
        col("fields")["source"].alias("field_source"),
    )


@query(
    "prj04_infer_tags_fields",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS name, CASE WHEN bool_and(regexp_matches(cast({c} AS string), '^[+-]?[0-9]*(\\.[0-9]+)?$'))
        THEN 'field' ELSE 'tag' END AS role FROM events"""
        for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
    ),
)
def _(i):
    return R.infer_tags_fields(i.table("events"))


@query("prj05_normalize_header", "SELECT p_partkey AS part_key, p_name AS name_text, p_size AS size FROM part")
def _(i):
    return R.normalize_header(i.table("part").select("p_partkey", "p_name", "p_size").toDF(" part.key", "name.text ", " size "))


@query("prj06_include_exclude", "SELECT p_partkey, p_brand FROM part")
def _(i):
    return R.include_exclude(i.table("part"), ["p_partkey", "p_brand", "p_size"], ["p_size"])


@query(
    "prj07_apply_transforms",
    """SELECT seq, CASE WHEN k = 0 THEN 0.0 ELSE cast(100 AS double) / k END AS k, substr(device, 4) AS device, source,
      value * 2 AS doubled, substr(device, 4) || '/' || source AS label
    FROM metrics""",
    ["metrics"],
)
def _(i):
    return R.apply_transforms(
        i.metrics.select("seq", "k", "device", "source", "value"),
        [
            "k = 100 / k",
            "device = element_at(split(device, 'dev'), -1)",
            "source = cast(cast(source AS int) AS string)",
            "doubled = value * 2",
            "label = concat(device, '/', source)",
        ],
    ).drop("value")


@query(
    "prj08_resource_id",
    """SELECT p_partkey, regexp_replace(concat_ws('_', p_brand, p_name), '[^a-zA-Z0-9._-]', '_', 'g') AS resource_id FROM part""",
)
def _(i):
    return R.resource_id(i.table("part").select("p_partkey", "p_brand", "p_name"), ["p_brand", "p_name"]).select(
        "p_partkey", "resource_id"
    )


@query(
    "prj09_state_map",
    " UNION ALL ".join(
        f"SELECT s_suppkey, '{c}' AS name, cast({c} AS string) AS value FROM supplier"
        for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    ),
)
def _(i):
    return R.to_state_map(i.table("supplier"), keep=["s_suppkey"]).select(
        "s_suppkey", F.explode("state").alias("name", "value")
    )


@query(
    "prj10_project_templates",
    """SELECT o_orderkey AS id, o_orderstatus || ' (' || coalesce(nullif(o_orderpriority, '5-LOW'), '-') || ')' AS label,
      coalesce(nullif(o_orderpriority, '5-LOW'), '-') AS priority, o_totalprice AS price FROM orders""",
)
def _(i):
    nested = i.table("orders").select(
        F.struct(
            "o_orderkey",
            F.struct("o_orderstatus", F.nullif("o_orderpriority", lit("5-LOW")).alias("priority")).alias("state"),
            "o_totalprice",
        ).alias("o")
    )
    return R.project_templates(
        nested,
        {
            "id": "{o.o_orderkey}",
            "label": "{o.state.o_orderstatus} ({o.state.priority})",
            "priority": "{o.state.priority}",
            "price": "{o.o_totalprice}",
        },
    )


@query(
    "prj11_pivot_stats",
    """SELECT l_suppkey, cast(count(*) AS double) AS "calls#count", max(l_quantity) AS "quantity#max", min(l_quantity) AS "quantity#min",
      max(l_extendedprice) AS "price#max" FROM lineitem GROUP BY l_suppkey""",
)
def _(i):
    wide = i.table("lineitem").groupBy("l_suppkey").agg(
        F.count(lit(1)).cast("double").alias("calls#count"), F.max("l_quantity").alias("quantity#max"),
        F.min("l_quantity").alias("quantity#min"), F.max("l_extendedprice").alias("price#max"),
    )
    names = wide.columns[1:]
    long = wide.unpivot(["l_suppkey"], [f"`{n}`" for n in names], "name", "value").select(
        "l_suppkey", F.substring_index("name", "#", 1).alias("metric"), F.substring_index("name", "#", -1).alias("stat"), "value"
    )
    return R.pivot_stats(long, ["l_suppkey"], names)


@query(
    "prj12_one_hot_value",
    """SELECT seq, CASE WHEN response_code = '200' THEN latency ELSE 0 END AS rc_200,
      CASE WHEN response_code = '404' THEN latency ELSE 0 END AS rc_404,
      CASE WHEN response_code = '500' THEN latency ELSE 0 END AS rc_500 FROM samples""",
    ["samples"],
)
def _(i):
    return R.one_hot_value(i.samples, "response_code", "latency", "rc_", ["200", "404", "500"]).select("seq", "rc_200", "rc_404", "rc_500")


@query(
    "prj13_clip_above",
    """SELECT event_id, CASE WHEN value > (SELECT quantile_cont(value, 0.9) FROM events) THEN 0.0 ELSE value END AS value FROM events""",
)
def _(i):
    return R.clip_above(i.table("events").select("event_id", "value"), "value", 0.9)


@query(
    "prj14_split_path",
    """SELECT page_id, CASE WHEN contains(url, '/') THEN left(url, length(url) - length(split_part(url, '/', -1)) - 1) ELSE 'None' END AS parent,
      split_part(url, '/', -1) AS item FROM pages""",
)
def _(i):
    parent, item = R.split_path(col("url"), "/")
    return i.table("pages").select("page_id", parent.alias("parent"), item.alias("item"))


_CHANGING = {"size": ["l_quantity", "l_linenumber"], "money": ["l_extendedprice", "flat"]}


@query(
    "prj15_changing_metrics",
    " UNION ALL ".join(
        f"SELECT '{g}' AS metric_group, '{m}' AS metric, round(s, 6) AS std FROM (SELECT stddev_samp({x}) AS s FROM lineitem) q WHERE s > 0"
        for g, m, x in (
            ("size", "l_quantity", "l_quantity"), ("size", "l_linenumber", "l_linenumber"),
            ("money", "l_extendedprice", "l_extendedprice"), ("money", "flat", "1.5"),
        )
    ),
)
def _(i):
    return R.changing_metrics(i.table("lineitem").withColumn("flat", lit(1.5)), _CHANGING).withColumn("std", F.round("std", 6))


@query(
    "prj16_route_entities",
    """SELECT seq, 'E1' AS entity_id, 'faults' AS entity_type, device AS entity_name, 'value,k' AS names,
      cast(value AS string) || ',' || cast(k AS string) AS vals FROM metrics WHERE source = 'error'
    UNION ALL
    SELECT seq, 'E2', 'metrics', 'big', 'value,k', cast(value AS string) || ',' || cast(k AS string) FROM metrics WHERE value > 100""",
    ["metrics"],
)
def _(i):
    out = R.route_entities(
        i.metrics.withColumn("absent", lit(None).cast("double")),
        [
            ("source = 'error'", {"entityId": "'E1'", "entityName": "device", "entityType": "'faults'"}),
            ("value > 100", {"entityId": "'E2'", "entityName": "'big'"}),
        ],
        ["value", "absent", "k"],
        {"entityType": "'metrics'"},
        keep=["seq"],
    )
    return out.select(
        "seq", col("properties")["entityId"].alias("entity_id"), col("properties")["entityType"].alias("entity_type"),
        col("properties")["entityName"].alias("entity_name"), F.array_join("metricNames", ",").alias("names"),
        F.array_join(col("metricValues")[0], ",").alias("vals"),
    )


@query(
    "prj17_series_view",
    "SELECT datetime AS time, device AS target, value AS average FROM metrics WHERE substr(datetime, 1, 10) = '2024-01-05'",
    ["metrics"],
)
def _(i):
    path = i.scratch("daily")
    rows = i.metrics.withColumn("date", F.substring("datetime", 1, 10))
    rows.repartitionByRange("date", "seq").write.partitionBy("date").parquet(path)
    return R.series_view(i.spark.read.parquet(path), {"time": "datetime", "target": "device", "average": "value"}, "2024-01-05")


# --- filters ---------------------------------------------------------------------------------


@query("flt01_filter_expr", "SELECT seq, k, source FROM metrics WHERE k <> 0 AND cast(100 AS double) / k > 5 AND source <> 'view'", ["metrics"])
def _(i):
    return L.filter_expr(i.metrics, "100 / k > 5 AND source <> 'view'").select("seq", "k", "source")


@query("flt02_require_any_field", "SELECT seq, k FROM metrics WHERE k % 2 = 0 OR k % 3 = 0", ["metrics"])
def _(i):
    rows = i.metrics.withColumn("a", F.when(col("k") % 2 == 0, col("value"))).withColumn("b", F.when(col("k") % 3 == 0, col("value")))
    return L.require_any_field(rows, ["a", "b"]).select("seq", "k")


@query("flt03_max_age", "SELECT seq, timestamp FROM metrics WHERE 1705708800 - timestamp <= 432000", ["metrics"])
def _(i):
    return L.max_age(i.metrics, "timestamp", 432_000, lit(1_705_708_800)).select("seq", "timestamp")


_NEWER = """SELECT seq, device, timestamp FROM (
  SELECT *, max(timestamp) OVER ({part} ORDER BY k, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM metrics) q
WHERE newest IS NULL OR timestamp > newest"""


@query("flt04_drop_older", _NEWER.format(part=""), ["metrics"])
def _(i):
    return L.drop_older(i.metrics, "timestamp", ["k", "seq"]).select("seq", "device", "timestamp")


@query("flt04_drop_older_per_device", _NEWER.format(part="PARTITION BY device"), ["metrics"])
def _(i):
    return L.drop_older(i.metrics, "timestamp", ["k", "seq"], ["device"]).select("seq", "device", "timestamp")


@query(
    "flt05_completed_minutes",
    """SELECT event_id FROM events WHERE ts >= date_trunc('minute', TIMESTAMP '2024-01-15 10:00:30') - INTERVAL 2880 MINUTE
      AND ts < date_trunc('minute', TIMESTAMP '2024-01-15 10:00:30') - INTERVAL 60 MINUTE""",
)
def _(i):
    as_of = F.expr("TIMESTAMP_NTZ '2024-01-15 10:00:30'")
    return L.completed_minutes(i.table("events"), "ts", as_of, 2880, 60).select("event_id")


@query("flt06_at_max", "SELECT seq, all_threads FROM samples WHERE all_threads = (SELECT max(all_threads) FROM samples)", ["samples"])
def _(i):
    return L.at_max(i.samples, "all_threads").select("seq", "all_threads")


@query(
    "flt09_flow_filter",
    """SELECT id, composite_dn, title FROM instances WHERE (composite_dn LIKE 'default/OrderConsumer%' OR composite_dn LIKE 'default/OrderProducer%')
      AND NOT (title LIKE 'SBL%' OR title LIKE '%-1_')""",
    ["instances"],
)
def _(i):
    return L.flow_filter(
        i.instances,
        [("composite_dn", "default/OrderConsumer%"), ("composite_dn", "default/OrderProducer%")],
        [("title", "SBL%"), ("title", "%-1_")],
    ).select("id", "composite_dn", "title")


# --- windows ---------------------------------------------------------------------------------


def floor_sql(value: str, by: str) -> str:
    return f"({value}) // ({by}) - CASE WHEN ({value}) % ({by}) <> 0 AND (({value}) < 0) <> (({by}) < 0) THEN 1 ELSE 0 END"


RATES_SQL = f"""SELECT seq, device, timestamp, cast({floor_sql('counter - pc', 'dt')} AS bigint) AS counter, cast({floor_sql('k - pk', 'dt')} AS bigint) AS k
FROM (SELECT *, CASE WHEN timestamp = pt THEN 1 ELSE timestamp - pt END AS dt FROM (
  SELECT *, lag(timestamp) OVER w AS pt, lag(counter) OVER w AS pc, lag(k) OVER w AS pk FROM counters WHERE counter + k <> 0
  WINDOW w AS (PARTITION BY device ORDER BY seq)) a WHERE pt IS NOT NULL) b"""


def rates(i: Inputs) -> DataFrame:
    return W.dvdt(
        i.counters.select("seq", "device", "timestamp", "counter", "k"), ["device"], "timestamp", ["counter", "k"], ["seq"]
    )


@query("win01_dvdt", RATES_SQL, ["metrics", "counters"])
def _(i):
    return rates(i)


@query(
    "win02_changes_per_second",
    """SELECT seq, counter - lag(counter) OVER w AS counter_dv,
      round((counter - lag(counter) OVER w) / nullif(cast(timestamp - lag(timestamp) OVER w AS double), 0), 6) AS counter_dvdt
    FROM counters WINDOW w AS (PARTITION BY device ORDER BY seq)""",
    ["metrics", "counters"],
)
def _(i):
    return W.changes_per_second(i.counters, ["counter"], ["device"], ["seq"]).select("seq", "counter_dv", r6("counter_dvdt"))


@query(
    "win03_difference_positive",
    """SELECT seq, cast(CASE WHEN ok AND last_ok IS NOT NULL THEN greatest(ivalue - last_ok, 0) ELSE 0 END AS double) AS difference FROM (
      SELECT *, last_value(CASE WHEN ok THEN ivalue END IGNORE NULLS) OVER (PARTITION BY device ORDER BY k, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ok
      FROM (SELECT *, coalesce(timestamp >= max(timestamp) OVER (PARTITION BY device ORDER BY k, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM metrics) a) b""",
    ["metrics"],
)
def _(i):
    return W.difference_positive(i.metrics, ["device"], "timestamp", "ivalue", ["k", "seq"]).select("seq", "difference")


_ROLL = "OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(
    "win04_rolling_mean",
    f"SELECT seq, CASE WHEN count(*) {_ROLL} = 10 THEN round(avg(value) {_ROLL}, 6) END AS value_mean FROM metrics",
    ["metrics"],
)
def _(i):
    return W.rolling_mean(i.metrics, ["device"], ["seq"], "value", 10).select("seq", r6("value_mean"))


@query(
    "win05_rolling_bands",
    f"""SELECT seq, round(m, 6) AS mean, round(m + s, 6) AS upper, round(m - s, 6) AS lower FROM (
      SELECT seq, CASE WHEN count(*) {_ROLL} = 10 THEN avg(value) {_ROLL} END AS m,
        CASE WHEN count(*) {_ROLL} = 10 THEN stddev_samp(value) {_ROLL} END AS s FROM metrics) q""",
    ["metrics"],
)
def _(i):
    return W.rolling_bands(i.metrics, ["device"], ["seq"], "value", 10).select("seq", r6("mean"), r6("upper"), r6("lower"))


@query(
    "win06_rolling_corr",
    f"""SELECT seq, CASE WHEN count(c) {_ROLL} = 10 THEN round(avg(c) {_ROLL}, 6) END AS corr FROM (
      SELECT seq, device, CASE WHEN count(*) {_ROLL} = 10 THEN corr(value, k) {_ROLL} END AS c FROM metrics) q""",
    ["metrics"],
)
def _(i):
    return W.rolling_corr(i.metrics, ["device"], ["seq"], "value", "k", 10).select("seq", r6("corr"))


@query(
    "win07_first_per_key",
    "SELECT ecid, fault_id FROM (SELECT *, row_number() OVER (PARTITION BY ecid ORDER BY created, fault_id) AS rn FROM faults) q WHERE rn = 1",
    ["faults"],
)
def _(i):
    return W.first_per_key(i.faults, ["ecid"], ["created", "fault_id"]).select("ecid", "fault_id")


@query(
    "win07_longest_per_key",
    "SELECT ecid, fault_id, error_message FROM (SELECT *, row_number() OVER (PARTITION BY ecid ORDER BY length(error_message) DESC, fault_id) AS rn FROM faults) q WHERE rn = 1",
    ["faults"],
)
def _(i):
    return W.longest_per_key(i.faults, ["ecid"], "error_message", ["fault_id"]).select("ecid", "fault_id", "error_message")


@query(
    "win08_sliding_log",
    "SELECT seq, device, value FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY seq DESC) AS rn FROM metrics) q WHERE rn <= 20",
    ["metrics"],
)
def _(i):
    return W.sliding_log(i.metrics, ["device"], ["seq"], 20).select("seq", "device", "value")


def zscore_sql(lag: int, threshold: float, influence: float) -> str:
    """The smoothed z-score as recursion over rows; ``f`` holds the last ``lag + 1`` filtered values."""
    window = f"list_slice(s.f, 1, {lag})"
    far = f"s.n >= {lag} AND abs(r.value - list_aggregate({window}, 'avg')) > {threshold} * list_aggregate({window}, 'stddev_pop')"
    return (
        "WITH RECURSIVE "
        + common_tables("metrics")[len("WITH ") :]
        + f""", rows AS (SELECT device, seq, value, row_number() OVER (PARTITION BY device ORDER BY seq) AS n FROM metrics),
    s AS (SELECT device, seq, value, n, [value] AS f, 0 AS signal FROM rows WHERE n = 1
      UNION ALL SELECT r.device, r.seq, r.value, r.n,
        list_slice(list_append(s.f, CASE WHEN {far} THEN {influence} * r.value + (1 - {influence}) * s.f[-1] ELSE r.value END), -{lag + 1}, -1),
        CASE WHEN {far} THEN CASE WHEN r.value > list_aggregate({window}, 'avg') THEN 1 ELSE -1 END ELSE 0 END
      FROM s JOIN rows r ON r.device = s.device AND r.n = s.n + 1) """
    )


@query("win09_zscore_anomaly", zscore_sql(10, 2.0, 0.5) + "SELECT device, seq, value, cast(signal AS int) AS signal FROM s")
def _(i):
    return W.zscore_anomaly(i.metrics, ["device"], ["seq"], "value", 10, 2.0, 0.5)


@query(
    "win10_ffill",
    """SELECT seq, last_value(CASE WHEN k % 3 <> 0 THEN value END IGNORE NULLS) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
    FROM metrics""",
    ["metrics"],
)
def _(i):
    rows = i.metrics.withColumn("value", F.when(col("k") % 3 != 0, col("value")))
    return W.ffill(rows, ["device"], ["seq"], ["value"]).select("seq", "value")


@query(
    "win11_join_lines",
    r"""SELECT doc_id, cast(island + 1 AS bigint) AS record, string_agg(line, ',' ORDER BY pos) AS line FROM (
      SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM (
        SELECT *, CASE WHEN regexp_matches(line, '[.]\z') THEN 1 ELSE 0 END AS stop FROM (
          SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) a) b) c) d
    GROUP BY doc_id, island HAVING max(stop) = 1""",
)
def _(i):
    lines = i.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return W.join_lines(lines, ["doc_id"], ["pos"], "line", r"[.]\z")


@query(
    "win13_collapse_repeats",
    """SELECT device, min(seq) AS seq, min(source) AS source, count(*) AS repeats FROM (
      SELECT *, sum(new) OVER (PARTITION BY device ORDER BY seq) AS run FROM (
        SELECT *, CASE WHEN lag(source) OVER (PARTITION BY device ORDER BY seq) = source THEN 0 ELSE 1 END AS new FROM metrics) a) b
    GROUP BY device, run""",
    ["metrics"],
)
def _(i):
    return W.collapse_repeats(i.metrics, ["device"], ["seq"], "source")


# --- sorts, limits, top-k --------------------------------------------------------------------


@query("srt01_sort_table", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_custkey DESC")
def _(i):
    return O.sort_table(
        i.table("customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_mktsegment", "unknown", "c_custkey"], reverse=True
    )


_TOP_COLS = ("l_orderkey", "l_quantity", "l_extendedprice")


@query(
    "srt02_topk_wide",
    "SELECT l_suppkey, "
    + ", ".join(f"max(CASE WHEN rn = {n} THEN {c} END) AS {c}{n}" for n in range(1, 12) for c in _TOP_COLS)
    + """ FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_quantity) AS rn FROM lineitem) q
    WHERE rn <= 11 GROUP BY l_suppkey""",
)
def _(i):
    order = [col("l_extendedprice").desc(), col("l_orderkey"), col("l_quantity")]
    return O.topk_wide(i.table("lineitem"), ["l_suppkey"], order, 11, _TOP_COLS)


@query(
    "srt04_tail_rows",
    "SELECT source, doc_id, substr(text, 1, 80) AS text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents) q WHERE rn <= 5",
)
def _(i):
    return O.tail_rows(i.table("documents").select("source", "doc_id", "text"), ["source"], ["doc_id"], 5, "text", 80)


# --- set operations --------------------------------------------------------------------------

_FLOW_RULES = {
    "CONSUME": "composite_dn LIKE 'default/OrderConsumer%'",
    "PRODUCE": "composite_dn LIKE 'default/OrderProducer%'",
    "LARGE": "quantity > 40",
}


@query(
    "set01_union_flows",
    " UNION ALL ".join(f"SELECT id, title, '{n}' AS flow FROM instances WHERE {p}" for n, p in _FLOW_RULES.items()),
    ["instances"],
)
def _(i):
    return U.union_flows(i.instances, _FLOW_RULES).select("id", "title", "flow")


@query("set02_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def _(i):
    return U.union_distinct(
        i.table("customer").select(col("c_nationkey").alias("nation")), i.table("supplier").select(col("s_nationkey").alias("nation"))
    )


@query("set03_append_same_schema", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(i):
    return U.append_same_schema(
        [
            i.table("customer").select(col("c_custkey").alias("id"), col("c_name").alias("name")),
            i.table("part").select(col("p_partkey").alias("id"), col("p_name").alias("part_name")),
            i.table("supplier").select(col("s_suppkey").alias("id"), col("s_name").alias("name")),
        ]
    )


@query("set04_distinct_ids", "SELECT DISTINCT device, source FROM metrics", ["metrics"])
def _(i):
    return U.distinct_ids(i.metrics, ["device", "source"])


@query(
    "set05_unify_bindings",
    """SELECT o_orderkey AS binding, o_totalprice AS messages_time, 'service' AS kind FROM orders
    UNION ALL SELECT l_orderkey, l_extendedprice, 'reference' FROM lineitem""",
)
def _(i):
    services = i.table("orders").withColumn("kind", lit("service"))
    references = i.table("lineitem").withColumn("kind", lit("reference"))
    return U.unify_bindings(
        services,
        references,
        {"binding": "o_orderkey", "messages_time": "o_totalprice", "kind": "kind"},
        {"binding": "l_orderkey", "messages_time": "l_extendedprice", "kind": "kind"},
    )


# --- scalar functions ------------------------------------------------------------------------


@query(
    "sca01_regex_capture",
    "SELECT fault_id, nullif(regexp_extract(error_message, '(?i)ErrMsg=([_0-9a-zA-Z]+)', 1), '') AS code FROM faults",
    ["faults"],
)
def _(i):
    return i.faults.select("fault_id", S.regex_capture(col("error_message"), "ErrMsg=([_0-9a-zA-Z]+)").alias("code"))


@query(
    "sca02_ordered_case",
    """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'first' WHEN p_type LIKE 'S%' THEN 's-type' WHEN instr(p_name, 'ring') > 0 THEN 'ring'
      WHEN substr(p_name, 1, 3) = 'red' THEN 'red' ELSE 'UNKNOWN - ' || p_type END AS class FROM part""",
)
def _(i):
    rules = [
        (col("p_brand") == "Brand#1", "first"),
        (col("p_type").like("S%"), "s-type"),
        (F.instr("p_name", "ring") > 0, "ring"),
        (F.substring("p_name", 1, 3) == "red", "red"),
    ]
    return i.table("part").select("p_partkey", S.ordered_case(rules, F.concat(lit("UNKNOWN - "), "p_type")).alias("class"))


@query(
    "sca03_decode",
    "SELECT id, CASE state % 8 WHEN 0 THEN 'READY' WHEN 1 THEN 'LOCKED' WHEN 3 THEN 'ERRORED' WHEN 4 THEN 'TIMED OUT' WHEN 6 THEN 'GROUP ERROR' END AS label FROM instances",
    ["instances"],
)
def _(i):
    return i.instances.select("id", S.decode(col("state") % 8, A.GROUP_STATUS).alias("label"))


@query("sca04_split_ends", "SELECT id, split_part(composite_dn, '/', -1) AS tail, split_part(composite_dn, '!', 1) AS head FROM instances", ["instances"])
def _(i):
    return i.instances.select("id", S.after_last(col("composite_dn"), "/").alias("tail"), S.before_first(col("composite_dn"), "!").alias("head"))


@query(
    "sca05_greatest_of",
    """SELECT l_orderkey, greatest(coalesce(CASE WHEN l_returnflag = 'R' THEN l_shipdate END, TIMESTAMP '2000-01-01'), coalesce(o_orderdate, TIMESTAMP '2000-01-01')) AS newest
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def _(i):
    rows = i.table("lineitem").join(i.table("orders"), col("l_orderkey") == col("o_orderkey"), "left")
    default = F.expr("TIMESTAMP_NTZ '2000-01-01'")
    return rows.select(
        "l_orderkey", S.greatest_of([F.when(col("l_returnflag") == "R", col("l_shipdate")), col("o_orderdate")], default).alias("newest")
    )


@query(
    "sca06_join_text",
    "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '') || '-' || coalesce(nullif(o_orderpriority, '5-LOW'), '') AS label FROM orders",
)
def _(i):
    return i.table("orders").select(
        "o_orderkey", S.join_text(F.nullif("o_orderstatus", lit("P")), lit("-"), F.nullif("o_orderpriority", lit("5-LOW"))).alias("label")
    )


@query(
    "sca07_seconds_between",
    "SELECT l_orderkey, l_partkey, cast(epoch(l_shipdate) - epoch(o_orderdate) AS double) AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)
def _(i):
    rows = i.table("lineitem").join(i.table("orders"), col("l_orderkey") == col("o_orderkey"))
    return rows.select("l_orderkey", "l_partkey", S.seconds_between(col("o_orderdate"), col("l_shipdate")).alias("seconds"))


@query("sca08_minute_text", "SELECT event_id, strftime(date_trunc('minute', ts), '%y-%m-%d %H:%M') AS minute FROM events")
def _(i):
    return i.table("events").select("event_id", S.minute_text(col("ts")).alias("minute"))


@query(
    "sca09_to_epoch_nanos",
    """SELECT seq, timestamp * 1000000000 AS from_seconds, epoch_us(ts) // 1000 * 1000000 AS from_millis,
      timestamp * 1000000000 - cast(CASE k % 3 WHEN 0 THEN 7200 WHEN 1 THEN -30600 ELSE 5 * 3600 END AS bigint) * 1000000000 AS from_text FROM metrics""",
    ["metrics"],
)
def _(i):
    offset = F.when(col("k") % 3 == 0, "+0200").when(col("k") % 3 == 1, "-0830").otherwise("5")
    return i.metrics.select(
        "seq",
        S.to_epoch_nanos(col("timestamp"), "s").alias("from_seconds"),
        S.to_epoch_nanos(F.unix_millis(col("ts").cast("timestamp")), "ms").alias("from_millis"),
        S.to_epoch_nanos(col("datetime"), "yyyy-MM-dd HH:mm:ss", offset).alias("from_text"),
    )


@query(
    "sca10_to_instant",
    "SELECT seq, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN timestamp - 7200 ELSE timestamp + 30600 END AS epoch FROM metrics",
    ["metrics"],
)
def _(i):
    text = F.when(col("k") % 5 == 0, "not a time").otherwise(col("datetime"))
    zone = F.when(col("k") % 2 == 0, "+0200").otherwise("-0830")
    return i.metrics.select("seq", F.unix_seconds(S.to_instant(text, zone)).alias("epoch"))


@query("sca11_iso_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def _(i):
    return i.table("events").select("event_id", S.iso_utc(col("ts")).alias("iso"))


@query(
    "sca12_duration_text",
    """SELECT o_orderkey, format('{:02d}:{:02d}:{:02d}:{:02d}', s // 86400, s % 86400 // 3600, s % 3600 // 60, s % 60) AS duration,
      lpad(cast(s % 60 AS string), 2, '0') || '/' || lpad(cast(s % 24 AS string), 2, '0') AS ratio FROM (SELECT o_orderkey, o_custkey * 997 AS s FROM orders) q""",
)
def _(i):
    s = col("o_custkey") * 997
    return i.table("orders").select("o_orderkey", S.duration_text(s).alias("duration"), S.padded_ratio([s % 60, s % 24]).alias("ratio"))


@query("sca13_count_letter", "SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS letters FROM documents")
def _(i):
    return i.table("documents").select("doc_id", S.count_letter(col("text"), "e").cast("long").alias("letters"))


@query("sca14_clean_text", r"SELECT doc_id, substr(regexp_replace(text, '[^\x00-\x7F]|[\r\n,]', ' ', 'g'), 1, 100) AS text FROM documents")
def _(i):
    return i.table("documents").select("doc_id", S.clean_text(col("text")).alias("text"))


_SENTINEL = "CASE k % 5 WHEN 0 THEN ' -1' WHEN 1 THEN 'n/a' WHEN 2 THEN '  ' ELSE cast(k AS string) END"


@query("sca15_no_sentinel", f"SELECT seq, CASE WHEN trim({_SENTINEL}) NOT IN ('-1', 'n/a', '') THEN trim({_SENTINEL}) END AS value FROM metrics", ["metrics"])
def _(i):
    return i.metrics.select("seq", S.no_sentinel(F.expr(_SENTINEL)).alias("value"))


@query("sca16_last_part", "SELECT id, split_part(title, '-', -1) AS part FROM instances", ["instances"])
def _(i):
    return i.instances.select("id", S.last_part(col("title"), "-").alias("part"))


@query("sca17_group_hash", "SELECT title, count(*) AS count FROM instances GROUP BY title", ["instances"])
def _(i):
    return i.instances.groupBy(F.xxhash64("title").alias("h"), "title").agg(F.count(lit(1)).alias("count")).drop("h")


@query("sca18_json_path", "SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def _(i):
    return i.table("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "udf01_transform_functions",
    """SELECT seq, cast(substr(device, 4) AS bigint) * 10 + k AS code, upper(source) || '!' AS label FROM metrics""",
    ["metrics"],
)
def _(i):
    registry = TransformRegistry()
    registry.template("device_number", ("name:STRING",), "cast(substr(name, 4) AS BIGINT)")
    registry.template("shout", ("word:STRING",), "concat(upper(word), '!')")
    registry.install(i.spark)
    return R.apply_transforms(
        i.metrics.select("seq", "device", "k", "source"), ["code = device_number(device) * 10 + k", "label = shout(source)"]
    ).select("seq", "code", "label")


_GROWN = """SELECT seq, node, cast(CASE WHEN ok AND last_ok IS NOT NULL THEN greatest(bytes - last_ok, 0) ELSE 0 END AS double) AS grown FROM (
      SELECT *, last_value(CASE WHEN ok THEN bytes END IGNORE NULLS) OVER (PARTITION BY node ORDER BY k, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ok
      FROM (SELECT *, system || '/' || source AS node, ivalue * 100 + 7 AS bytes,
        coalesce(timestamp >= max(timestamp) OVER (PARTITION BY system || '/' || source ORDER BY k, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS ok FROM metrics) a) b"""


@query(
    "udf01_stateful_transforms",
    f"SELECT seq, node, grown, grown / 1000 AS kilo, grown > 5000 AS fast FROM ({_GROWN}) g",
    ["metrics"],
)
def _(i):
    # Projections before and after a window step, all by name.
    registry = default_transforms()
    registry.template("kilos", ("amount:DOUBLE",), "amount / 1000")
    steps = ["node = concat(system, '/', source)", "grown = difference_positive(timestamp, node, ivalue * 100 + 7)", "kilo = kilos(grown)", "fast = grown > 5000"]
    return registry.run(i.metrics, steps, ["k", "seq"]).select("seq", "node", "grown", "kilo", "fast")


@query(
    "udf03_series_aggregate",
    zscore_sql(5, 3.0, 0.0) + "SELECT device, count(*) FILTER (signal = 1) AS high, count(*) FILTER (signal = -1) AS low FROM s GROUP BY device",
)
def _(i):
    signals = W.zscore_anomaly(i.metrics, ["device"], ["seq"], "value", 5, 3.0, 0.0)
    return A.status_counts(signals, ["device"], {"high": col("signal") == 1, "low": col("signal") == -1})


# --- aggregates ------------------------------------------------------------------------------


@query("agg01_count_by", "SELECT device, source, count(*) AS count FROM metrics GROUP BY device, source", ["metrics"])
def _(i):
    return A.count_by(i.metrics, ["device", "source"])


@query(
    "agg02_status_counts",
    "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O' AND l_quantity > 25) AS large_open FROM lineitem GROUP BY l_suppkey",
)
def _(i):
    return A.status_counts(
        i.table("lineitem"),
        ["l_suppkey"],
        {"returned": col("l_returnflag") == "R", "large_open": (col("l_linestatus") == "O") & (col("l_quantity") > 25)},
    )


@query(
    "agg04_pctl_disc",
    """SELECT l_suppkey, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_extendedprice, 0.95) AS p95
    FROM lineitem GROUP BY l_suppkey""",
)
def _(i):
    return P.pctl_disc(i.table("lineitem"), ["l_suppkey"], "l_extendedprice", A.FLOW_PERCENTILES)


@query(
    "agg05_pctl_rank",
    """SELECT source, coalesce(max(CASE WHEN rn = cast(floor(n * 0.95 - 0.5) AS bigint) THEN value END), 0) AS p95,
      coalesce(max(CASE WHEN rn = cast(floor(n * 0.90 - 0.5) AS bigint) THEN value END), 0) AS p90
    FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY value) AS rn, count(*) OVER (PARTITION BY source) AS n FROM metrics) q GROUP BY source""",
    ["metrics"],
)
def _(i):
    return P.pctl_rank(i.metrics, ["source"], "value", {"p95": 0.95, "p90": 0.90})


@query(
    "agg06_listagg",
    "SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS items FROM conversations GROUP BY conv_id",
)
def _(i):
    return A.listagg(i.table("conversations"), ["conv_id"], "role", ["turn"])


@query(
    "agg15_describe",
    """SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
      round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max FROM events""",
)
def _(i):
    out = A.describe(i.table("events"), "value")
    return out.select("count", r6("mean"), r6("std"), "min", r6("p25"), r6("p50"), r6("p75"), "max")


_QS = (0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 1.0)


@query(
    "agg16_quantiles",
    "SELECT " + ", ".join(f"round(quantile_cont(latency, {q}), 6) AS q{round(q * 100)}" for q in _QS) + " FROM samples",
    ["samples"],
)
def _(i):
    names = {f"q{round(q * 100)}": q for q in _QS}
    return P.quantiles(i.samples, [], "latency", names).select(*[r6(n) for n in names])


@query(
    "agg17_histogram",
    """SELECT b.bin, round(lo + b.bin * w, 6) AS bin_from, round(lo + (b.bin + 1) * w, 6) AS bin_to, coalesce(c.count, 0) AS count
    FROM (SELECT unnest(range(20)) AS bin) b CROSS JOIN (SELECT min(value) AS lo, (max(value) - min(value)) / 20.0 AS w FROM events) s
    LEFT JOIN (SELECT cast(least(floor((value - lo) / w), 19) AS bigint) AS bin, count(*) AS count
      FROM events CROSS JOIN (SELECT min(value) AS lo, (max(value) - min(value)) / 20.0 AS w FROM events) s GROUP BY 1) c ON c.bin = b.bin""",
)
def _(i):
    return A.histogram(i.table("events"), "value").select("bin", r6("bin_from"), r6("bin_to"), "count")


@query("agg20_value_counts", "SELECT response_code, count(*) AS count FROM samples GROUP BY response_code", ["samples"])
def _(i):
    return A.value_counts(i.samples, "response_code")


@query(
    "agg27_fleet_rollup",
    """SELECT host, count(*) AS count, count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS disabled, count(*) FILTER (running) AS running,
      count(*) FILTER (1705708800 < start_after) AS waiting, cast(sum(runs) AS bigint) AS runs, cast(sum(errors) AS bigint) AS errors,
      cast(sum(backlog) AS bigint) AS backlog_total, round(sum(CASE WHEN running THEN rss END), 4) AS rss, max(greatest(last_error, errorlog_time)) AS last_error_time
    FROM (SELECT system AS host, k % 4 <> 0 AS enabled, k % 3 = 0 AS running, timestamp AS start_after, k AS runs, k % 5 AS errors, k % 7 AS backlog,
      value AS rss, timestamp AS last_error, timestamp + k AS errorlog_time FROM metrics) q GROUP BY host""",
    ["metrics"],
)
def _(i):
    rows = i.metrics.selectExpr(
        "system AS host", "k % 4 <> 0 AS enabled", "k % 3 = 0 AS running", "timestamp AS start_after", "k AS runs", "k % 5 AS errors",
        "k % 7 AS backlog", "value AS rss", "timestamp AS last_error", "timestamp + k AS errorlog_time", "1705708800 AS as_of",
    )
    return A.fleet_rollup(rows).withColumn("rss", F.round("rss", 4))


@query(
    "agg29_latest",
    "SELECT device, seq, source, value FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY timestamp DESC, seq DESC) AS rn FROM metrics) q WHERE rn = 1",
    ["metrics"],
)
def _(i):
    return A.latest(i.metrics, ["device"], ["timestamp", "seq"]).select("device", "seq", "source", "value")


@query(
    "agg29_get_metric",
    "SELECT value FROM metrics WHERE device = 'dev8' ORDER BY seq DESC LIMIT 1",
    ["metrics"],
)
def _(i):
    return A.get_metric(i.metrics, "device", "dev8", "value", ["seq"])


RESAMPLE_SQL = """SELECT g.source, g.b * {w} AS bucket, round(last_value(m.value IGNORE NULLS) OVER (PARTITION BY g.source ORDER BY g.b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value
FROM (SELECT source, unnest(range(lo, hi + 1)) AS b FROM (SELECT source, min(timestamp // {w}) AS lo, max(timestamp // {w}) AS hi FROM metrics GROUP BY source) r) g
LEFT JOIN (SELECT source, timestamp // {w} AS b, avg(value) AS value FROM metrics GROUP BY 1, 2) m ON m.source = g.source AND m.b = g.b"""


@query("agg30_resample", RESAMPLE_SQL.format(w=600), ["metrics"])
def _(i):
    return A.resample(i.metrics, ["source"], "ts", 600, ["value"]).select("source", "bucket", r6("value"))
