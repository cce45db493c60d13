"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import lenient
from ..plans.ordered import Scan, ordered_scan


def filter_expr(df: DataFrame, expression: str) -> DataFrame:
    """Keep rows where the SQL expression is true; an error or null counts as false."""
    with lenient(df.sparkSession):
        return df.filter(F.coalesce(F.expr(expression), F.lit(False)))


def require_any_field(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields]))


def max_age(df: DataFrame, ts: str, seconds: int, as_of: Column) -> DataFrame:
    """Rows at most ``seconds`` old; ``ts`` and ``as_of`` are epoch seconds."""
    return df.filter(F.col(ts) >= as_of - F.lit(seconds))


def drop_older(
    df: DataFrame, ts: str, order: Sequence[str], key: Sequence[str] | None = None, cell_rows: int | None = None
) -> DataFrame:
    """Keep rows strictly newer than all rows before them in arrival order.

    ``key=None`` keeps one newest time for the whole stream, so equal times of different
    resources are dropped as well; a key keeps one per resource.
    """
    seen = ordered_scan(
        df, list(key or ()), order, [Scan("_newest", "max", F.col(ts), before=True)], cell_rows
    )
    return seen.filter("_newest IS NULL OR " + f"`{ts}` > _newest").select(*df.columns)


def completed_minutes(df: DataFrame, ts: str, as_of: Column, start_min: int, end_min: int) -> DataFrame:
    """Rows in ``[as_of - start, as_of - end)``, both bounds truncated to the minute."""
    at = F.date_trunc("minute", as_of.cast("timestamp"))
    kind = df.schema[ts].dataType
    lower = (at - F.make_dt_interval(mins=F.lit(start_min))).cast(kind)
    upper = (at - F.make_dt_interval(mins=F.lit(end_min))).cast(kind)
    return df.filter((F.col(ts) >= lower) & (F.col(ts) < upper))


def at_max(df: DataFrame, col: str) -> DataFrame:
    """Rows where the column has its overall maximum (scalar subquery, no join)."""
    return df.filter(F.col(col) == df.agg(F.max(col)).scalar())


def _under(path: str, prefix: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(p) for p in prefix])
    return F.slice(path, 1, len(prefix)) == wanted


def filter_call_path(df: DataFrame, prefix: Sequence[str], path: str = "path") -> DataFrame:
    """Calls on the filter path. ``counted`` is false for callers above the filtered call."""
    above = [
        (F.size(path) == n) & _under(path, prefix[:n]) for n in range(1, len(prefix))
    ]
    on = _under(path, prefix)
    keep = reduce(lambda a, b: a | b, above, on)
    return df.filter(keep).withColumn("counted", on)


def exclude_call_paths(df: DataFrame, prefixes: Sequence[Sequence[str]], path: str = "path") -> DataFrame:
    """Drop calls below a listed path, and those above it whose whole path leads to it."""
    on = [_under(path, p) for p in prefixes]
    above = [
        (F.size(path) == n) & _under(path, p[:n]) for p in prefixes for n in range(1, len(p))
    ]
    return df.filter(~reduce(lambda a, b: a | b, [*on, *above], F.lit(False)))


def flow_filter(df: DataFrame, any_like: Sequence[tuple[str, str]], none_like: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """At least one LIKE rule of ``any_like`` and none of ``none_like``; rules are (column, pattern)."""
    wanted = reduce(lambda a, b: a | b, [F.col(c).like(p) for c, p in any_like], F.lit(not any_like))
    barred = reduce(lambda a, b: a | b, [F.col(c).like(p) for c, p in none_like], F.lit(False))
    return df.filter(wanted & ~barred)
