"""Aggregations over flows, logs and load tests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..plans.ordered import Scan, ordered_scan
from ..plans.skew import is_large, same_keys
from ..plans.storage import written
from . import percentiles as P

DAY = 86_400


def count_by(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def status_counts(df: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """One count per named condition; null conditions do not count."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def flow_stats(df: DataFrame, keys: Sequence[str], duration: str = "duration", err: str = "err") -> DataFrame:
    """Counts and rounded duration statistics; ``count_all`` includes error rows."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count_all"),
        F.count_if(F.col(err).isNull()).alias("count_ok"),
        F.count(err).alias("count_err"),
        F.round(F.min(duration), 2).alias("min"),
        F.round(F.max(duration), 2).alias("max"),
        F.round(F.avg(duration), 2).alias("avg"),
    )


def listagg(
    df: DataFrame, keys: Sequence[str], item: str, order: Sequence[str], name: str = "items", sep: str = ", "
) -> DataFrame:
    """Ordered string list per key; null items are left out."""
    ordered = F.sort_array(F.collect_list(F.when(F.col(item).isNotNull(), F.struct(*order, F.col(item).alias("_i")))))
    return df.groupBy(*keys).agg(F.array_join(ordered["_i"], sep).alias(name))


def flow_chain_stats(steps: DataFrame, cell_rows=None) -> DataFrame:
    """Whole-flow statistics per chain of components.

    ``steps`` has ``ecid, instance_id, cdn, created, end_time, faulted_time`` and one row per step.
    """
    first = steps.groupBy("ecid").agg(
        F.min("instance_id").alias("instance_id"),
        S.seconds_between(F.min("created"), F.max("end_time")).alias("duration"),
        F.min("faulted_time").alias("faulted_time"),
        F.array_join(
            F.sort_array(F.collect_list(F.struct("created", "instance_id", "cdn")))["cdn"], ", "
        ).alias("cdns"),
    )
    if cell_rows is None and is_large(first):
        # Flows are put together once: they are counted before they are ranked.
        first = written(first, "flows")
    stats = P.with_rank(first, ["cdns"], ["duration", "ecid"], cell_rows).groupBy("cdns").agg(
        F.count(F.lit(1)).alias("count"),
        F.count("faulted_time").alias("count_faulted"),
        F.round(F.min("duration"), 3).alias("min_time"),
        F.round(F.max("duration"), 3).alias("max_time"),
        F.round(F.avg("duration"), 3).alias("avg_time"),
        F.min("instance_id").alias("sample_cid"),
        *[P.pick_disc(F.col("duration"), p).alias(n) for n, p in FLOW_PERCENTILES.items()],
    )
    return stats.withColumn("entry_point", S.before_first(F.col("cdns"), ","))


FLOW_PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95}


def access_minute_stats(
    df: DataFrame, keys: Sequence[str] = ("minute", "server", "url"), compat: bool = False, cell_rows=None
) -> DataFrame:
    """Access-log statistics per minute, server and URL.

    ``df`` has the keys and ``second, status, seconds, bytes``. Errors are statuses starting with 4 or 5;
    ``compat=True`` counts any status containing a 4 or a 5 followed by a digit.
    """
    error = F.col("status").rlike("4|5[0-9]+" if compat else "^[45]")
    success = F.col("status").rlike("2[0-9]+" if compat else "^2")
    millis = F.col("seconds") * 1000
    keys = list(keys)
    # Per second and time taken first: equal rows are one row before anything is ranked.
    values = df.select(*keys, "second", "status", "bytes", millis.alias("_ms")).groupBy(*keys, "second", "_ms").agg(
        F.count(F.lit(1)).alias("_requests"), F.count_if(error).alias("_errors"), F.count_if(success).alias("_success"), F.sum("bytes").alias("_bytes")
    )
    per_second = values.groupBy(*keys, "second").agg(
        F.sum("_requests").alias("_requests"), F.sum("_errors").alias("_errors"), F.sum("_success").alias("_success"),
        F.sum(F.col("_ms") * F.col("_requests")).alias("_ms"), F.sum("_bytes").alias("_bytes"),
    )
    ranked = P.weighted_ranks(values.groupBy(*keys, "_ms").agg(F.sum("_requests").alias("_m")), keys, "_ms", cell_rows)
    slow = ranked.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        *[P.pick_weighted(F.col("_ms"), p).alias(name) for p, name in ((0.95, "_p95"), (0.90, "_p90"))]
    )
    n = F.sum("_requests")
    rates = per_second.groupBy(*keys).agg(
        F.sum("_errors").alias("errors"),
        F.sum("_success").alias("success"),
        F.round(F.sum("_ms") / n).cast("long").alias("time_avg_ms"),
        F.round(F.sum("_bytes") / n).cast("long").alias("size_avg_bytes"),
        F.max("_requests").alias("max_rps"),
        F.round(F.avg("_requests"), 2).alias("avg_rps"),
    )
    both = rates.join(slow, same_keys([F.col(k) for k in keys], [F.col(f"_k_{k}") for k in keys]))
    return both.select(
        *keys, "errors", "success", "time_avg_ms", F.round("_p95").cast("long").alias("time_p95_ms"), F.round("_p90").cast("long").alias("time_p90_ms"),
        "size_avg_bytes", "max_rps", "avg_rps",
    )


def socket_summary(df: DataFrame) -> DataFrame:
    """Connections per process, port, direction and state from parsed socket rows.

    A local port some process listens on makes the connection inbound.
    """
    from .joins import flag_member

    listening = df.filter("state = 'LISTEN'").select("local_port")
    rows = flag_member(df.filter("state <> 'LISTEN'"), listening, "local_port", "_inbound")
    owned = F.col("process").rlike("^.+/.+$")
    return (
        rows.select(
            F.when(owned, F.substring_index("process", "/", 1)).otherwise("0").alias("pid"),
            F.when(owned, F.expr("substr(process, instr(process, '/') + 1)")).otherwise("unknown").alias("program"),
            F.when(F.col("_inbound"), F.col("local_port")).otherwise(F.col("foreign_port")).alias("port"),
            F.when(F.col("_inbound"), "inbound").otherwise("outbound").alias("direction"),
            "state",
            "send_q",
            "recv_q",
        )
        .groupBy("pid", "program", "port", "direction", "state")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("send_q").alias("send_q"),
            F.sum("recv_q").alias("recv_q"),
        )
    )


def pool_usage(
    df: DataFrame, keys: Sequence[str], used_ms: str, held_s: str, blocked_after: int = 900, cell_rows=None
) -> DataFrame:
    """Session-pool usage: rounded average, maximum, rank percentiles and blocked sessions."""
    # A row a value: how many rows share it, and how many of them are blocked.
    values = df.groupBy(*keys, used_ms).agg(F.count(F.lit(1)).alias("_m"), F.count_if(F.col(held_s) > blocked_after).alias("_blocked"))
    ranked = P.weighted_ranks(values, keys, used_ms, cell_rows)
    known = F.when(F.col(used_ms).isNotNull(), F.col("_m"))
    return ranked.groupBy(*keys).agg(
        F.sum("_blocked").alias("blocked"),
        F.round(F.sum(F.col(used_ms) * F.col("_m")) / F.sum(known)).cast("long").alias("avg_used_ms"),
        F.round(F.max(used_ms)).cast("long").alias("max_used_ms"),
        F.round(P.pick_weighted(F.col(used_ms), 0.95)).cast("long").alias("p95_used_ms"),
        F.round(P.pick_weighted(F.col(used_ms), 0.90)).cast("long").alias("p90_used_ms"),
    )


def batch_outcomes(instances: DataFrame, components: DataFrame) -> DataFrame:
    """Records per batch and component state; the batch id follows the last ``%`` of the conversation id."""
    batch = F.nullif(F.regexp_extract("conversation_id", r".+%(.+)", 1), F.lit(""))
    state = F.col("component_state")
    label = (
        F.when(state == 8, "STUCK").when(state == 4, "ERROR-RUN").when(state != 0, "ERROR-OTHER").otherwise("SUCCESS")
    )
    return (
        instances.join(components.filter(state.isNotNull()), "id")
        .groupBy(batch.alias("batch_id"), "component_state")
        .agg(
            F.min("created").alias("first_time"),
            F.max("created").alias("last_time"),
            F.min("id").alias("first_cid"),
            F.count(F.lit(1)).alias("num_records"),
        )
        .withColumn("result", label)
    )


# Error code patterns, in the order in which their matches are joined.
ERROR_PATTERNS = {
    "xml": r"(XML-[0-9]+)",
    "brm": r"ErrMsg=([_0-9a-zA-Z]+)",
    "jca": r"(JCA-[0-9]+)",
    "oramed": r"(ORAMED-[0-9]+)",
    "sbl": r"(SBL-[A-Z]+-[0-9]+)",
    "aia": r"(AIA_ERR_[_A-Z0-9]+)",
    "brm2": r"(BRM-ERR[_0-9a-zA-Z]+)",
    "jms": r"(ERRJMS[_0-9a-zA-Z]+)",
}
# Phrases that stand for an error without a code.
ERROR_PHRASES = (
    ("Unable to access the following endpoint", "HTTP_TIMEOUT"),
    ("The transaction might have timedout", "JTA_TIMEOUT"),
    ("The result of from-spec is null", "DATA_ERROR"),
)


def error_type(message: Column) -> Column:
    """All codes found in a message, joined; ``UNKNOWN_ERROR`` when there is none."""
    code = {n: S.regex_capture(message, p) for n, p in ERROR_PATTERNS.items()}
    phrase = S.ordered_case([(F.instr(message, text) > 0, label) for text, label in ERROR_PHRASES])
    second = F.when(code["brm"].isNull(), code["brm2"])
    joined = S.join_text(
        code["xml"], code["brm"], code["jca"], code["oramed"], code["sbl"], phrase, code["aia"], second, code["jms"]
    )
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("UNKNOWN_ERROR"))


def error_taxonomy(
    df: DataFrame, message: str, flow_rules: Sequence[tuple[Column, str]], fallback: Column, created: str
) -> DataFrame:
    """Errors per flow and type with the newest time."""
    return (
        df.select(
            S.ordered_case(flow_rules, fallback).alias("flow"), error_type(F.col(message)).alias("error_type"), created
        )
        .groupBy("flow", "error_type")
        .agg(F.count(F.lit(1)).alias("count"), F.max(created).alias("newest"))
    )


def classify_count(
    df: DataFrame,
    keys: Sequence[str],
    result_rules: Sequence[tuple[Column, str]],
    flow_rules: Sequence[tuple[Column, str]],
) -> DataFrame:
    """Rows per key, result class and flow class; the first matching rule of a list wins."""
    return (
        df.select(
            *keys,
            S.ordered_case(result_rules, F.lit("Other Error")).alias("result"),
            S.ordered_case(flow_rules, F.lit("UNKNOWN")).alias("flow"),
        )
        .groupBy(*keys, "result", "flow")
        .agg(F.count(F.lit(1)).alias("count"))
    )


# Status codes of message groups and of messages.
GROUP_STATUS = {0: "READY", 1: "LOCKED", 3: "ERRORED", 4: "TIMED OUT", 6: "GROUP ERROR"}
MESSAGE_STATUS = {0: "READY", 2: "PROCESSED", 3: "ERRORED", 4: "TIMED OUT", 6: "ABORTED"}


def status_matrix(df: DataFrame) -> DataFrame:
    """Messages per component, container and pair of group and message status, with labels."""
    counts = df.groupBy("component_dn", "group_status", "message_status", "container_id").agg(
        F.count(F.lit(1)).alias("count")
    )
    return counts.select(
        F.concat(
            F.coalesce(S.decode(F.col("group_status"), GROUP_STATUS), F.lit("")),
            F.lit("-"),
            F.coalesce(S.decode(F.col("message_status"), MESSAGE_STATUS), F.lit("")),
        ).alias("status"),
        "group_status",
        "message_status",
        "count",
        S.after_last(F.col("component_dn"), "/").alias("component"),
        "container_id",
    )


def describe(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles."""
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    basics = [
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    ]
    if not is_large(df):
        return df.groupBy(*keys).agg(*basics, *[F.percentile(col, F.lit(q)).alias(n) for n, q in quartiles.items()])
    stats = df.groupBy(*keys).agg(*basics)
    points = P.quantiles(df, keys, col, quartiles)
    if keys:
        # Null keys are groups, and groups without a value have no quartiles.
        points = points.select(*[F.col(k).alias(f"_p_{k}") for k in keys], *quartiles)
        joined = stats.join(points, same_keys([F.col(k) for k in keys], [F.col(f"_p_{k}") for k in keys]), "left")
        return joined.drop(*[f"_p_{k}" for k in keys])
    return stats.select("*", *[points.select(n).scalar().alias(n) for n in quartiles])


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed; empty bins count 0."""
    low, high = df.agg(F.min(col).cast("double")).scalar(), df.agg(F.max(col).cast("double")).scalar()
    values = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_v"))
    width = (high - low) / F.lit(float(bins))
    bin_no = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_v") - low) / F.when(width != 0, width)), F.lit(bins - 1))
    )
    counts = values.groupBy(bin_no.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (low + F.col("id") * width).alias("bin_from"),
        (low + (F.col("id") + 1) * width).alias("bin_to"),
    )
    return edges.join(counts, "bin", "left").na.fill(0, ["count"])


def throughput(df: DataFrame, limit_ms: int) -> DataFrame:
    """Successful requests per second answered within the limit, with the thread maximum."""
    fast = df.filter(F.col("success") & (F.col("elapsed") <= limit_ms))
    return fast.groupBy("second").agg(F.count(F.lit(1)).alias("requests"), F.max("all_threads").alias("threads"))


def error_rate(df: DataFrame) -> DataFrame:
    failed = df.filter(~F.col("success"))
    return failed.groupBy("second").agg(F.count(F.lit(1)).alias("errors"), F.max("all_threads").alias("threads"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def fleet_rollup(df: DataFrame, host: str = "host") -> DataFrame:
    """Instance states, totals and newest error time per host.

    ``df`` has one row per instance: ``enabled, running, start_after, as_of`` and the summed columns.
    An error log newer than the last recorded error moves the error time.
    """
    return df.groupBy(host).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("enabled")).alias("enabled"),
        F.count_if(~F.col("enabled")).alias("disabled"),
        F.count_if(F.col("running")).alias("running"),
        F.count_if(F.col("as_of") < F.col("start_after")).alias("waiting"),
        F.sum("runs").alias("runs"),
        F.sum("errors").alias("errors"),
        F.sum("backlog").alias("backlog_total"),
        F.sum(F.when(F.col("running"), F.col("rss"))).alias("rss"),
        F.max(F.greatest("last_error", "errorlog_time")).alias("last_error_time"),
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and time of the files below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime")


def backlog(files: DataFrame) -> DataFrame:
    """Waiting log files per instance and group (1 to 9), and size and time of the error log.

    ``files`` has ``path, length, modificationTime``; only metadata is used. The instance is the parent
    directory, logs are ``<instance>_<time>.log.<group>``, error logs ``<instance>[_<time>].error.out``.
    """
    name, parent = F.substring_index("path", "/", -1), F.element_at(F.split("path", "/"), -2)
    rows = files.select(
        parent.alias("instance"),
        F.regexp_extract(name, r"^(.+)_[0-9\-]+\.log\.([1-9])$", 1).alias("log_of"),
        F.regexp_extract(name, r"^(.+)_[0-9\-]+\.log\.([1-9])$", 2).alias("file_group"),
        F.regexp_extract(name, r"^(.+?)(_[0-9\-]+)?\.error\.out$", 1).alias("error_of"),
        "length",
        "modificationTime",
    )
    is_log, is_error = F.col("log_of") == F.col("instance"), F.col("error_of") == F.col("instance")
    return rows.groupBy("instance").agg(
        *[
            F.count_if(is_log & (F.col("file_group") == str(g))).alias(f"backlog_group_{g}")
            for g in range(1, 10)
        ],
        F.count_if(is_log).alias("backlog_total"),
        F.coalesce(F.max(F.when(is_error, F.col("length"))), F.lit(0)).alias("errorlog_size"),
        F.max(F.when(is_error & (F.col("length") > 0), F.col("modificationTime"))).alias("errorlog_time"),
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per resource; a max aggregate, so combining starts before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")


def get_metric(df: DataFrame, resource: str, value, metric: str, order: Sequence[str]) -> DataFrame:
    """Newest value of one metric of one resource; null when unknown."""
    rows = df.filter(F.col(resource) == value)
    found = F.max_by(metric, F.struct(*order)) if metric in df.columns else F.lit(None)
    return rows.agg(found.alias("value"))


def resample(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    width_s: int,
    cols: Sequence[str],
    fill: bool = True,
    cell_rows=None,
) -> DataFrame:
    """Mean per fixed time bucket and, with ``fill``, the newest earlier mean for empty buckets.

    ``bucket`` is the bucket start in epoch seconds.
    """
    index = F.floor(S.epoch_seconds(F.col(ts)) / width_s)
    means = df.groupBy(*keys, index.alias("_i")).agg(*[F.avg(c).alias(c) for c in cols])
    if not fill:
        return means.select(*keys, (F.col("_i") * width_s).alias("bucket"), *cols)
    # Every mean is repeated up to the next one; long gaps are cut so that no array grows large.
    piece = 10_000
    scanned = ordered_scan(
        means.withColumn("_back", -F.col("_i")), keys, ["_back"], [Scan("_next", "prev", F.col("_i"))], cell_rows
    ).withColumn("_end", F.coalesce(F.col("_next") - 1, F.col("_i")))
    blocks = F.sequence(F.floor(F.col("_i") / piece), F.floor(F.col("_end") / piece))
    spread = scanned.withColumn("_b", F.explode(blocks)).withColumn(
        "_at",
        F.explode(
            F.sequence(
                F.greatest(F.col("_b") * piece, F.col("_i")), F.least(F.col("_b") * piece + piece - 1, F.col("_end"))
            )
        ),
    )
    return spread.select(*keys, (F.col("_at") * width_s).alias("bucket"), *cols)
