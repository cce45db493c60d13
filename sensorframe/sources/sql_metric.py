"""Saved SQL metrics: queries and table functions kept as files, run over registered views.

Table functions take the point in time and their rules as typed arguments. Spark inlines their bodies, so that constant
arguments reach the scans as pushed filters.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_PLACEHOLDER = re.compile(r"\$\{(\w+)\}")


def metric_names() -> list[str]:
    return sorted(f.name[:-4] for f in files("sensorframe").joinpath("sqlmetrics").iterdir() if f.name.endswith(".sql"))


def metric_sql(name: str, schema_map: Mapping[str, str]) -> str:
    """Query text with each ``${SCHEMA}`` prefix replaced; an empty prefix means plain view names."""
    text = files("sensorframe").joinpath("sqlmetrics", f"{name}.sql").read_text()

    def prefix(match: re.Match) -> str:
        schema = schema_map[match.group(1)]
        if schema and not re.fullmatch(r"\w+(\.\w+)*", schema):
            raise ValueError(f"not a schema name: {schema!r}")
        return f"{schema}." if schema else ""

    return _PLACEHOLDER.sub(prefix, text)


def run_sql_metric(
    spark: SparkSession, name: str, schema_map: Mapping[str, str], as_of: datetime, tables: Mapping[str, DataFrame] = {}
) -> DataFrame:
    """Run a saved metric at ``as_of``; ``tables`` are registered as temporary views first."""
    for view, df in tables.items():
        df.createOrReplaceTempView(view)
    return spark.sql(metric_sql(name, schema_map), args={"as_of": as_of})


def metric_function_names() -> list[str]:
    folder = files("sensorframe").joinpath("sqlmetrics", "functions")
    return sorted(f.name[:-4] for f in folder.iterdir() if f.name.endswith(".sql"))


def install_metric_function(spark: SparkSession, name: str, tables: Mapping[str, DataFrame] = {}) -> None:
    """Make a saved metric callable in SQL as ``SELECT * FROM name(...)``; ``tables`` become the views it reads.

    A function keeps the views it was made with: install it again for other tables.
    """
    if name not in metric_function_names():
        raise KeyError(f"unknown metric {name!r}, known: {metric_function_names()}")
    for view, df in tables.items():
        df.createOrReplaceTempView(view)
    spark.sql(files("sensorframe").joinpath("sqlmetrics", "functions", f"{name}.sql").read_text())


def rules(fields: Sequence[str], rows: Sequence[Sequence[str]]) -> Column:
    """An argument of type array of structs of strings."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, row, strict=True)]) for row in rows])


def metric_table(
    spark: SparkSession, name: str, as_of: datetime, args: Mapping[str, object] = {}, tables: Mapping[str, DataFrame] = {}
) -> DataFrame:
    """Result of a saved metric at ``as_of``; ``args`` are its other arguments by name."""
    install_metric_function(spark, name, tables)
    given = "".join(f", {n} => :{n}" for n in args)
    # The point in time travels as text, so that it does not depend on the time zone of the driver.
    call = f"SELECT * FROM {name}(as_of => CAST(:as_of AS TIMESTAMP_NTZ){given})"
    return spark.sql(call, args={"as_of": as_of.isoformat(sep=" "), **args})
