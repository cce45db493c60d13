"""XML metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.project import clean_header
from .lines import read_lines

ROW_SCHEMA = "column ARRAY<STRUCT<_name: STRING, _VALUE: STRING>>"
VERSIONS = ("11.0",)  # fixed value


def tbml_columns(spark: SparkSession, path: str, versions: Sequence[str] = VERSIONS) -> list[str]:
    """Column names in declared order; checks the version of every document."""
    lines = read_lines(spark, path)
    version = lines.select(F.regexp_extract("value", r"<tbml[^>]*\sversion=['\"]([^'\"]+)", 1).alias("v"))
    bad = [r[0] for r in version.filter((F.col("v") != "") & ~F.col("v").isin(list(versions))).distinct().head(5)]
    if bad:
        raise ValueError(f"unsupported versions {bad}, expected one of {list(versions)}")
    declared = F.regexp_extract_all("value", F.lit(r"<columndef[^>]*\sname=['\"]([^'\"]+)"), 1)
    names = lines.select("file", "block", "pos", F.posexplode(declared).alias("nth", "name"))
    # First place of each distinct name: one row per declared column reaches the driver.
    first = names.groupBy("name").agg(F.min(F.struct("file", "block", "pos", "nth")).alias("at"))
    return [r["name"] for r in first.orderBy("at").collect()]


def read_tbml(spark: SparkSession, path: str, versions: Sequence[str] = VERSIONS, columns: Sequence[str] | None = None) -> DataFrame:
    """One text column per declared column; missing or blank cells are ``n/a``."""
    names = list(columns) if columns is not None else tbml_columns(spark, path, versions)
    rows = (
        spark.read.format("xml")
        .option("rowTag", "row")
        .option("recursiveFileLookup", "true")
        .option("ignoreNamespace", "true")
        .schema(ROW_SCHEMA)
        .load(path)
    )
    cells = F.map_from_arrays(
        F.transform("column", lambda c: c["_name"]), F.transform("column", lambda c: F.trim(c["_VALUE"]))
    )
    return rows.select(cells.alias("_cells")).select(
        *[
            F.coalesce(F.nullif(F.try_element_at("_cells", F.lit(n)), F.lit("")), F.lit("n/a")).alias(clean_header(n))
            for n in names
        ]
    )
