"""Call traces: ``S`` rows start a call, all other rows finish the newest open one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .lines import read_lines

# Field positions (0-based) of start and finish rows.
START_FIELDS = {
    "level": (1, "long"), "opid": (2, "long"), "opcode": (3, "long"), "flags": (4, "long"), "name": (5, "string"),
    "program": (11, "string"), "bucket": (12, "long"), "objtype": (13, "string"),
}
FINISH_FIELDS = {
    "records": (2, "long"), "calls": (3, "long"), "min_time": (4, "double"), "max_time": (5, "double"),
    "range_from": (6, "double"), "range_to": (7, "double"), "cache_calls": (8, "long"),
    "cache_time": (9, "double"), "errors": (10, "long"), "user_cpu": (11, "double"), "system_cpu": (12, "double"),
}


def file_title() -> list[Column]:
    """Process, chain and end time of a trace from the column ``file``."""
    # <chain>.<process>[.<start>].<end>.plog.txt, as a file or directory name.
    parts = F.split(F.substring_index(F.substring_index(F.substring_index("file", ".plog.txt", 1), "/", -1), "=", -1), r"\.")
    return [
        F.get(parts, F.lit(1)).alias("process"),
        F.get(parts, F.lit(0)).alias("chain"),
        F.try_to_timestamp(F.try_element_at(parts, F.lit(-1)), F.lit("yyyyMMdd_HHmmss")).alias("ended"),
    ]


def parse_call_trace(lines: DataFrame) -> DataFrame:
    """Typed start and finish rows; process, chain and end time come from the file name."""
    # A column of its own: inlined, the split would run once per field.
    parts = F.col("_parts")
    start = parts[0] == "S"

    def field(position: int, kind: str, when: Column) -> Column:
        value = F.get(parts, F.lit(position))
        return F.when(when, value if kind == "string" else value.try_cast(kind))

    rows = lines.filter(F.trim("value") != "").select(
        "file", "block", "pos", F.split("value", ",").alias("_parts")
    )
    return rows.select(
        "file", "block", "pos",
        *file_title(),
        F.when(start, "S").otherwise("F").alias("kind"),
        F.coalesce(F.when(start, F.get(parts, F.lit(6))).otherwise(F.get(parts, F.lit(1))).try_cast("double"), F.lit(0.0)).alias("time"),
        *[field(p, k, start).alias(n) for n, (p, k) in START_FIELDS.items()],
        *[field(p, k, ~start).alias(n) for n, (p, k) in FINISH_FIELDS.items()],
    )


def read_call_trace(spark: SparkSession, path: str) -> DataFrame:
    return parse_call_trace(read_lines(spark, path))
