"""Set operations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_flows(df: DataFrame, rules: Mapping[str, str], column: str = "flow") -> DataFrame:
    """UNION ALL of one branch per flow, as a single tagged scan.

    ``rules`` maps a flow to its predicate. A row matching several flows appears once for each.
    """
    tags = F.array(*[F.when(F.coalesce(F.expr(p), F.lit(False)), F.lit(n)) for n, p in rules.items()])
    return df.select("*", F.explode(tags).alias(column)).filter(F.col(column).isNotNull())


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def append_same_schema(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames with the first one's header, appended; others are skipped."""
    header = frames[0].columns
    return union_all([f for f in frames if f.columns == header])


def distinct_ids(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def unify_bindings(
    services: DataFrame, references: DataFrame, service_cols: Mapping[str, str], reference_cols: Mapping[str, str]
) -> DataFrame:
    """Two row kinds under one header; each mapping goes from header name to source column."""
    a = services.select(*[F.col(c).alias(n) for n, c in service_cols.items()])
    b = references.select(*[F.col(c).alias(n) for n, c in reference_cols.items()])
    return a.unionByName(b)
