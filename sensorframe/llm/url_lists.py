"""Temporal join of captures with dated URL lists, in DataFrame functions only.

A list is a log of dated entries: from its date on, a pattern is on the list (``add``) or off it (``remove``). Entries of
one list and pattern become validity intervals, each open until the next one. A capture is evaluated against what was in force when it
was fetched: it takes its own host, the parent domains and the path prefixes as keys and joins on key and period.

Time is cut into periods of ``period_days``, so that the join is an equi-join and a pattern that changes often meets a capture only with the
intervals of the capture's own period. An interval appears once in every period between its start and end within the range of
captures. A hot host is a skewed join key, which adaptive execution splits on the side of the captures.

Defined results: null or unusable URLs have no keys and are on no list; captures without a time neither. Of entries with one date
``remove`` counts. Repeated entries change nothing. An entry in force on the very second of the fetch counts; the end of an
interval does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import read_table

PERIOD_DAYS = 30


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null without one."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(found, r"\.$", "")
    return F.when(host != "", host)


def url_keys(url: Column) -> Column:
    """Keys that a list may name: the host, its parent domains, and the host with each directory of the path."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*(/[^?#]*)?", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    depth = F.sequence(F.lit(0), F.size(parts))
    paths = F.transform(F.filter(depth, lambda k: k > 0), lambda k: F.concat_ws("/", host, F.array_join(F.slice(parts, 1, k), "/")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """``list, key, since, until`` from ``entries(list, key, at, action)``; ``until`` is null while the last entry holds."""
    usable = entries.filter(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    # One decision per date, then only changes: a log that repeats itself gives one interval.
    daily = usable.groupBy("list", "key", "at").agg(F.max("action").alias("action"))
    log = Window.partitionBy("list", "key").orderBy("at")
    changes = daily.withColumn("_was", F.lag("action").over(log)).filter(~F.col("action").eqNullSafe(F.col("_was")))
    spans = changes.withColumn("until", F.lead("at").over(log))
    return spans.filter("action = 'add'").select("list", "key", F.col("at").alias("since"), "until")


def _period(at: Column, days: int) -> Column:
    return F.floor(F.unix_seconds(at) / (days * 86400)).cast("long")


def active_entries(captures: DataFrame, spans: DataFrame, period_days: int = PERIOD_DAYS) -> DataFrame:
    """``capture, list, key, since`` of every interval in force for ``captures(capture, url, fetched)``."""
    probes = captures.filter("fetched is not null").select(
        "capture", "fetched", _period(F.col("fetched"), period_days).alias("p"), F.explode(url_keys(F.col("url"))).alias("k")
    )
    reach = captures.agg(F.min("fetched").alias("lo"), F.max("fetched").alias("hi")).first()
    if reach["lo"] is None:
        return probes.select("capture", F.lit(None).cast("string").alias("list"), F.col("k").alias("key"), F.col("fetched").alias("since")).limit(0)
    low, high = F.lit(reach["lo"]), F.lit(reach["hi"])
    inside = spans.filter((F.col("since") <= high) & (F.col("until").isNull() | (F.col("until") > low)))
    first, last = F.greatest(F.col("since"), low), F.least(F.coalesce(F.col("until"), high), high)
    dealt = inside.withColumn("q", F.explode(F.sequence(_period(first, period_days), _period(last, period_days))))
    in_force = (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    met = probes.join(dealt, (F.col("k") == F.col("key")) & (F.col("p") == F.col("q")) & in_force)
    return met.select("capture", "list", "key", "since")


def judge_captures(captures: DataFrame, entries: DataFrame, allow: str = "allow", period_days: int = PERIOD_DAYS) -> DataFrame:
    """Every capture with ``n_active`` entries, the ``decided_list`` and ``decided_key`` that count most, and ``blocked``.

    The longest key decides; of several as long, ``allow`` wins, then the first by key and list. Without an entry in force
    nothing is blocked. ``captures`` needs a unique ``capture``.
    """
    met = active_entries(captures, intervals(entries), period_days)
    order = F.struct((-F.length("key")).alias("size"), (F.col("list") != allow).alias("other"), "key", "list")
    best = met.groupBy(F.col("capture").alias("_c")).agg(F.count(F.lit(1)).alias("n_active"), F.min(order).alias("m"))
    out = captures.select("capture", "url", "fetched").join(best, F.col("capture") == F.col("_c"), "left")
    return out.select(
        "capture", "url", "fetched", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("m.list").alias("decided_list"),
        F.col("m.key").alias("decided_key"), F.coalesce(F.col("m.list") != allow, F.lit(False)).alias("blocked"),
    )


START = 1704067200  # 2024-01-01, in seconds


def dated_entries(pages: DataFrame) -> DataFrame:
    """A log of list entries made from the hosts, domains and first directories that the pages name."""
    host = host_of(F.col("url"))
    labels = F.split(host, r"\.")
    first = F.regexp_extract("url", r"^[^:]+://[^/?#]*/([^/?#]+)", 1)
    named = pages.select(
        "page_id",
        F.explode(
            F.array(
                F.struct(F.lit("block").alias("list"), host.alias("key")),
                F.struct(F.lit("allow").alias("list"), F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".").alias("key")),
                F.struct(F.lit("adult").alias("list"), F.when(first != "", F.concat(host, F.lit("/"), first)).alias("key")),
            )
        ).alias("e"),
    )
    keys = named.select("e.list", "e.key", "page_id").filter("key is not null").groupBy("list", "key").agg(F.min("page_id").alias("h"))
    h = F.col("h")
    day = F.pmod(h * 13, F.lit(300))
    event = lambda when, d, action: F.when(when, F.struct(d.alias("day"), F.lit(action).alias("action")))
    events = F.array(
        event(F.pmod(h, F.lit(3)) == 0, day, "add"), event(F.pmod(h, F.lit(6)) == 0, day + 40, "remove"),
        event(F.pmod(h, F.lit(12)) == 0, day + 90, "add"), event(F.pmod(h, F.lit(5)) == 0, day + 90, "add"),
    )
    log = keys.select("list", "key", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("v"))
    return log.select("list", "key", F.timestamp_seconds(F.col("v.day") * 86400 + START).alias("at"), F.col("v.action").alias("action"))


def op2_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, fetched in the course of a year by their id, against the lists in force on the second of the fetch."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_seconds(F.pmod(F.col("page_id") * 7919, F.lit(31536000)) + START)
    captures = pages.select(F.col("page_id").alias("capture"), "url", fetched.alias("fetched"))
    judged = judge_captures(captures, dated_entries(pages))
    return judged.select(
        F.col("capture").alias("page_id"), F.unix_seconds("fetched").alias("fetched"), "n_active", "decided_list", "decided_key", "blocked"
    )


OP2_SQL = """
WITH p AS (
  SELECT page_id, url, 1704067200 + (page_id * 7919) % 31536000 AS fetched,
    nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\\.$', ''), '') AS host,
    regexp_extract(url, '^[^:]+://[^/?#]*/([^/?#]+)', 1) AS dir,
    regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)?', 1) AS path FROM pages),
named AS (
  SELECT 'block' AS list, host AS key, page_id FROM p WHERE host IS NOT NULL
  UNION ALL SELECT 'allow', regexp_extract(host, '([^.]*\\.)?[^.]*$'), page_id FROM p WHERE host IS NOT NULL
  UNION ALL SELECT 'adult', host || '/' || dir, page_id FROM p WHERE host IS NOT NULL AND dir <> ''),
keys AS (SELECT list, key, min(page_id) AS h FROM named GROUP BY list, key),
log AS (
  SELECT list, key, h * 13 % 300 AS day, 'add' AS action FROM keys WHERE h % 3 = 0
  UNION ALL SELECT list, key, h * 13 % 300 + 40, 'remove' FROM keys WHERE h % 6 = 0
  UNION ALL SELECT list, key, h * 13 % 300 + 90, 'add' FROM keys WHERE h % 12 = 0
  UNION ALL SELECT list, key, h * 13 % 300 + 90, 'add' FROM keys WHERE h % 5 = 0),
daily AS (SELECT list, key, 1704067200 + day * 86400 AS moment, max(action) AS action FROM log GROUP BY ALL),
spans AS (SELECT *, lead(moment) OVER (PARTITION BY list, key ORDER BY moment) AS until FROM daily),
parts AS (SELECT page_id, fetched, host, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS dirs FROM p WHERE host IS NOT NULL),
probes AS (
  SELECT DISTINCT page_id, fetched, k FROM (
    SELECT page_id, fetched, unnest(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.'))) AS k FROM parts
    UNION ALL
    SELECT page_id, fetched, unnest(list_transform(range(1, len(dirs) + 1), lambda i: host || '/' || array_to_string(dirs[:i], '/'))) FROM parts)),
met AS (
  SELECT page_id, list, key, row_number() OVER (PARTITION BY page_id ORDER BY length(key) DESC, list <> 'allow', key, list) AS r,
    count(*) OVER (PARTITION BY page_id) AS n
  FROM probes JOIN spans ON k = key AND action = 'add' AND fetched >= moment AND (until IS NULL OR fetched < until))
SELECT p.page_id, p.fetched, coalesce(n, 0) AS n_active, list AS decided_list, key AS decided_key, coalesce(list <> 'allow', false) AS blocked
FROM p LEFT JOIN met ON met.page_id = p.page_id AND r = 1
"""
