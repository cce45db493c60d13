"""Access logs with a configurable field map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class AccessLogConfig:
    """1-based field positions in a whitespace separated line; 0 means not logged."""

    date_field: int = 2
    time_field: int = 3
    method_field: int = 4
    url_field: int = 5
    status_field: int = 6
    bytes_field: int = 7
    seconds_field: int = 8
    method_filter: str = "GET|POST"
    url_exclude: str = ""
    server_pattern: str = ""


def parse_access_log(lines: DataFrame, cfg: AccessLogConfig, file: str = "file") -> DataFrame:
    """``server, minute, second, method, url, status, bytes, seconds`` of matching requests."""
    parts = F.col("_parts")

    def field(position: int):
        return F.try_element_at(parts, F.lit(position)) if position else F.lit(None).cast("string")

    server = F.nullif(F.regexp_extract(file, cfg.server_pattern, 0), F.lit("")) if cfg.server_pattern else F.lit(None)
    rows = lines.withColumn("_parts", F.split(F.trim("value"), r"\s+")).select(
        F.coalesce(server, F.lit("n/a")).alias("server"),
        F.concat_ws(" ", field(cfg.date_field), field(cfg.time_field)).alias("second"),
        field(cfg.method_field).alias("method"),
        field(cfg.url_field).alias("url"),
        field(cfg.status_field).alias("status"),
        F.coalesce(field(cfg.bytes_field).try_cast("long"), F.lit(0)).alias("bytes"),
        F.coalesce(field(cfg.seconds_field).try_cast("double"), F.lit(0.0)).alias("seconds"),
    )
    rows = rows.filter(F.col("url").isNotNull() & F.col("method").rlike(cfg.method_filter))
    if cfg.url_exclude:
        rows = rows.filter(~F.col("url").rlike(cfg.url_exclude))
    return rows.withColumn("minute", F.substring("second", 1, 16))


def read_access_log(spark: SparkSession, path: str, cfg: AccessLogConfig) -> DataFrame:
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), "value")
    )
    return parse_access_log(lines, cfg)
