"""Captured tool output. Every parser takes the frame of :func:`.lines.read_lines`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import count_letter
from ..operators.windows import join_lines
from ..plans.ordered import Scan, ordered_scan
from .lines import LINE_ORDER

FILE = ["file"]
ORDER = list(LINE_ORDER)


def _cells(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _by_position(df: DataFrame, parts: Column, columns: Sequence[str], keep: Sequence[str] = ("file",)) -> DataFrame:
    """Cells by position. They are split in a step of their own; inlined, the split would run once per column."""
    cells = df.select(*keep, parts.alias("_parts"))
    return cells.select(*keep, *[F.get("_parts", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def parse_table_capture(lines: DataFrame, columns: Sequence[str], skip: int = 1, cell_rows=None) -> DataFrame:
    """Whitespace table: the first ``skip`` lines of a capture (headers, first sample) are left out."""
    numbered = ordered_scan(lines, FILE, ORDER, [Scan("_rn", "count")], cell_rows)
    rows = numbered.filter((F.col("_rn") > skip) & (F.trim("value") != ""))
    return _by_position(rows, _cells(F.regexp_replace("value", "%", "")), columns)


def parse_summary_line(lines: DataFrame, pattern: str, columns: Sequence[str], failed: str = "-1") -> DataFrame:
    """One row per capture file from its summary line; ``failed`` everywhere when there is none."""
    found = F.nullif(F.regexp_extract("value", pattern, 0), F.lit(""))
    per_file = lines.select("file", *ORDER, found.alias("_found"), *[
        F.regexp_extract("value", pattern, i + 1).alias(c) for i, c in enumerate(columns)
    ]).groupBy("file").agg(
        F.max_by(F.struct(*columns), F.when(F.col("_found").isNotNull(), F.struct(*ORDER))).alias("_row")
    )
    return per_file.select("file", *[F.coalesce(F.col(f"_row.{c}"), F.lit(failed)).alias(c) for c in columns])


def parse_section_capture(
    lines: DataFrame, start_regex: str, columns: Sequence[str], exclude: str | None = None, cell_rows=None
) -> DataFrame:
    """Rows between a line matching ``start_regex`` and the next blank line."""
    opens, blank = F.col("value").rlike(start_regex), F.trim("value") == ""
    marker = F.when(opens, True).when(blank, False)
    inside = ordered_scan(lines, FILE, ORDER, [Scan("_inside", "last", marker)], cell_rows)
    rows = inside.filter(F.coalesce(F.col("_inside"), F.lit(False)) & ~opens & ~blank)
    out = _by_position(rows, _cells(F.col("value")), columns)
    return out.filter(~F.col(columns[0]).rlike(exclude)) if exclude else out


def parse_kv_capture(
    lines: DataFrame, style: str, keys: Mapping[str, str], start: str | None = None, cell_rows=None
) -> DataFrame:
    """Key and value lines to one wide row per snapshot.

    ``style`` is ``colon`` (``key: value kB``), ``number`` (``12 some label``) or ``pair`` (a line of names, then a line
    of values with the same prefix). ``keys`` maps capture keys to columns; a snapshot starts
    at the line with the key ``start`` (default: the first of ``keys``).
    """
    if style == "pair":
        prefix = F.substring_index("value", ":", 1)
        before = ordered_scan(lines, FILE, ORDER, [Scan("_before", "prev", F.col("value"))], cell_rows)
        body = F.trim(F.substring_index("value", ":", -1))
        names = _cells(F.substring_index("_before", ":", -1))
        is_values = (F.substring_index("_before", ":", 1) == prefix) & body.rlike(r"^-?[0-9]")
        return before.filter(F.coalesce(is_values, F.lit(False))).select(
            "file", *ORDER, F.map_from_arrays(names, _cells(body)).alias("_kv")
        ).select("file", *ORDER, *[F.try_element_at("_kv", F.lit(k)).alias(c) for k, c in keys.items()])

    if style == "colon":
        regex, key_at, value_at = r"^\s*([^:]+):\s*(\S+)", 1, 2
    elif style == "number":
        regex, key_at, value_at = r"^\s*(-?[0-9]+)\s+(.*\S)\s*$", 2, 1
    else:
        raise ValueError(f"unknown style {style!r}")
    key = F.trim(F.regexp_extract("value", regex, key_at))
    parsed = lines.select("file", *ORDER, key.alias("_key"), F.regexp_extract("value", regex, value_at).alias("_value"))
    first = start or next(iter(keys))
    # Other lines neither start a snapshot nor fill a column.
    parsed = parsed.filter(F.col("_key").isin(first, *keys))
    snaps = ordered_scan(
        parsed, FILE, ORDER, [Scan("snapshot", "sum", (F.col("_key") == first).cast("long"))], cell_rows
    )
    wide = snaps.filter("snapshot > 0").groupBy("file", "snapshot").pivot("_key", list(keys)).agg(F.max("_value"))
    return wide.select("file", "snapshot", *[F.col(f"`{k}`").alias(c) for k, c in keys.items()])


def parse_block_capture(
    lines: DataFrame, stop_regex: str, patterns: Mapping[str, str], cell_rows=None
) -> DataFrame:
    """Multi-line records ending at a line that matches ``stop_regex``; one capture group per column."""
    joined = join_lines(lines, FILE, ORDER, "value", stop_regex, ",", cell_rows)
    return joined.select(
        "file",
        "record",
        *[F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(c) for c, p in patterns.items()],
    )


# Scoreboard letters and their columns, and the keys of a status page.
SCOREBOARD = {
    "_": "waiting", "S": "starting", "R": "reading", "W": "sending", "K": "keepalive", "D": "dns",
    "C": "closing", "L": "logging", "G": "finishing", "I": "idle_cleanup", ".": "open",
}
STATUS_KEYS = {
    "Total Accesses": "total_accesses", "Total kBytes": "total_kb", "CPULoad": "cpu_load",
    "ReqPerSec": "req_per_sec", "BytesPerSec": "bytes_per_sec", "BusyWorkers": "busy_workers",
    "IdleWorkers": "idle_workers", "Scoreboard": "scoreboard",
}


def scoreboard_counts(board: Column) -> list[Column]:
    return [count_letter(board, letter).cast("long").alias(name) for letter, name in SCOREBOARD.items()]


def parse_status_page(lines: DataFrame, cell_rows=None) -> DataFrame:
    """One row per status page: its keys and the number of workers per scoreboard letter."""
    pages = parse_kv_capture(lines, "colon", STATUS_KEYS, cell_rows=cell_rows)
    kept = [c for c in pages.columns if c != "scoreboard"]
    return pages.select(*kept, *scoreboard_counts(F.coalesce(F.col("scoreboard"), F.lit(""))))


_TAGGED = r"^>>>(\w+):(HEADER|DATA):\s?(.*)$"


def subsystem_headers(lines: DataFrame) -> dict[str, list[str]]:
    """Header columns per subsystem id: one row per subsystem reaches the driver."""
    heads = (
        lines.filter(F.col("value").rlike("^>>>\\w+:HEADER:"))
        .select(F.regexp_extract("value", _TAGGED, 1).alias("id"), F.regexp_extract("value", _TAGGED, 3).alias("h"))
        .groupBy("id")
        .agg(F.min("h").alias("h"))
    )
    return {r["id"]: [c.strip() for c in r["h"].split(",")] for r in heads.collect()}


def demux_subsystems(lines: DataFrame, subsystem: str, header: Sequence[str] | None = None) -> DataFrame:
    """Rows of one subsystem of a multi-header stream under its own header."""
    columns = list(header) if header is not None else subsystem_headers(lines)[subsystem]
    body = F.regexp_extract("value", _TAGGED, 3)
    rows = lines.filter(F.col("value").rlike(f"^>>>{subsystem}:DATA:"))
    parts = F.split(F.trim(body), r"\s*,\s*")
    return _by_position(rows, parts, columns)


def parse_sockets(lines: DataFrame) -> DataFrame:
    """Connection rows: ports are what follows the last colon of an address."""
    parts = F.col("_parts")

    def port(i: int) -> Column:
        return F.regexp_extract(F.get(parts, F.lit(i)), r".+:([0-9]+|\*)$", 1)

    rows = lines.filter(F.col("value").startswith("tcp")).withColumn("_parts", _cells(F.col("value")))
    return rows.select(
        F.get(parts, F.lit(1)).try_cast("long").alias("recv_q"),
        F.get(parts, F.lit(2)).try_cast("long").alias("send_q"),
        port(3).alias("local_port"),
        port(4).alias("foreign_port"),
        F.get(parts, F.lit(5)).alias("state"),
        F.coalesce(F.get(parts, F.lit(6)), F.lit("-")).alias("process"),
    )
