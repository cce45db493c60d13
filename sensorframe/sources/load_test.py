"""Load-test sample logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .headers import by_header, every_name, file_headers
from .lines import read_lines

SCHEMA = "timeStamp STRING, elapsed LONG, responseCode STRING, success BOOLEAN, Latency LONG, allThreads LONG"


def read_load_test(
    spark: SparkSession,
    path: str,
    epoch_ms: bool = True,
    t_from: datetime | None = None,
    t_to: datetime | None = None,
    schema: str = SCHEMA,
) -> DataFrame:
    """Samples with ``time`` and ``second`` (epoch seconds); response codes stay text.

    Columns are found by the names in the first line of each file, in any order and among any others; a column that a file lacks is
    null there, one that all files lack is an error.
    """
    lines = read_lines(spark, path)
    headers = file_headers(lines)
    wanted = StructType.fromDDL(schema)
    found, widest = every_name(headers)
    missing = [f.name for f in wanted if f.name not in found]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    named = by_header(lines, headers, wanted.names, widest=widest)
    raw = named.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])
    time = (
        F.timestamp_millis(F.col("timeStamp").try_cast("long"))
        if epoch_ms
        else F.try_to_timestamp("timeStamp")
    )
    rows = raw.withColumn("time", time).withColumn("second", F.unix_seconds("time"))
    if t_from is not None:
        rows = rows.filter(F.col("time") >= F.lit(t_from))
    if t_to is not None:
        rows = rows.filter(F.col("time") <= F.lit(t_to))
    return rows.withColumnRenamed("allThreads", "all_threads").withColumnRenamed("Latency", "latency").withColumnRenamed(
        "responseCode", "response_code"
    )
