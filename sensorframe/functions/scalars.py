"""Scalar helpers. Every function returns a native column expression."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession, functions as F


@contextmanager
def lenient(spark: SparkSession):
    """Analyse expressions so that run-time errors (bad casts, x/0) give null instead of failing."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def regex_capture(text: Column, pattern: str, group: int = 1) -> Column:
    """Case-insensitive capture; null when there is no match."""
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))


def ordered_case(rules: Sequence[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    """First matching rule wins."""
    out = otherwise if otherwise is not None else F.lit(None).cast("string")
    for condition, label in reversed(list(rules)):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def decode(code: Column, labels: dict) -> Column:
    """Code to label; null for an unknown code."""
    return ordered_case([(code == F.lit(k), v) for k, v in labels.items()])


def after_last(text: Column, sep: str) -> Column:
    return F.substring_index(text, sep, -1)


def before_first(text: Column, sep: str) -> Column:
    return F.substring_index(text, sep, 1)


def greatest_of(columns: Sequence[Column], default: Column) -> Column:
    return F.greatest(*[F.coalesce(c, default) for c in columns])


def join_text(*parts: Column) -> Column:
    """Concatenation that reads null as empty."""
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def minute_of(ts: Column) -> Column:
    """Minute as a timestamp: group by this, and format the few results afterwards."""
    return F.date_trunc("minute", ts.cast("timestamp"))


def minute_text(ts: Column, pattern: str = "yy-MM-dd HH:mm") -> Column:
    return F.date_format(minute_of(ts), pattern)


def offset_seconds(offset: Column) -> Column:
    """``+HHMM`` / ``-HHMM`` or a plain number of hours, in seconds."""
    signed = offset.rlike("^[+-][0-9]{4}$")
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    hours = F.try_to_number(F.when(signed, F.substring(offset, 2, 2)), F.lit("99"))
    minutes = F.try_to_number(F.when(signed, F.substring(offset, 4, 2)), F.lit("99"))
    plain = offset.try_cast("double") * 3600
    return F.when(signed, sign * (hours * 3600 + minutes * 60)).otherwise(plain).cast("long")


def to_epoch_nanos(value: Column, kind: str, offset: Column | None = None) -> Column:
    """Epoch seconds (``s``), milliseconds (``ms``) or a date pattern with offset to UTC nanoseconds."""
    if kind == "s":
        return (value.cast("double") * 1_000_000).cast("long") * 1000
    if kind == "ms":
        return (value.cast("double") * 1000).cast("long") * 1000
    micros = F.unix_micros(F.try_to_timestamp(value, F.lit(kind)))
    if offset is not None:
        micros = micros - offset_seconds(offset) * 1_000_000
    return micros * 1000


def to_instant(datetime: Column, offset: Column) -> Column:
    """Local datetime text plus ``±HHMM`` to a timestamp; null when malformed."""
    return F.try_to_timestamp(F.concat_ws(" ", datetime, offset), F.lit("yyyy-MM-dd HH:mm:ss Z"))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def duration_text(seconds: Column) -> Column:
    """Seconds as ``dd:hh:mm:ss``."""
    s = seconds.cast("long")
    return F.format_string(
        "%02d:%02d:%02d:%02d",
        F.floor(s / 86400).cast("long"),
        F.floor(s % 86400 / 3600).cast("long"),
        F.floor(s % 3600 / 60).cast("long"),
        s % 60,
    )


def padded_ratio(parts: Sequence[Column], width: int = 2) -> Column:
    """``a/b/c`` with zero-padded numbers."""
    return F.concat_ws("/", *[F.lpad(p.cast("string"), width, "0") for p in parts])


def count_letter(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def clean_text(text: Column, width: int = 100) -> Column:
    """Characters a CSV cell cannot hold become spaces; cut to ``width``."""
    return F.substring(F.regexp_replace(text, r"[^\x00-\x7F]|[\r\n,]", " "), 1, width)


def no_sentinel(value: Column) -> Column:
    """``-1``, ``n/a`` and blank mean no value."""
    trimmed = F.trim(value)
    return F.when(~trimmed.isin("-1", "n/a", ""), trimmed)


def last_part(text: Column, sep: str) -> Column:
    return F.element_at(F.split(text, F.lit(f"\\Q{sep}\\E")), -1)


def safe_name(*parts: Column) -> Column:
    """Joined with ``_``; characters unsafe in file names become ``_``."""
    return F.regexp_replace(F.concat_ws("_", *parts), "[^a-zA-Z0-9._-]", "_")


def floor_div(value: Column, by: Column) -> Column:
    """Integer division rounding towards minus infinity."""
    remainder = value % by
    return F.call_function("div", value - remainder, by) - F.when((remainder != 0) & ((value < 0) != (by < 0)), 1).otherwise(0)
