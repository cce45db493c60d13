"""Splitting heavy series into ordered cells.

A window over ``partitionBy(resource)`` puts a whole resource into one task. That is fine
until one resource holds a large share of the rows. :func:`split_cells` finds such keys with
a map-side combined count and cuts their rows along the sort order into cells of bounded
size: cell numbers never decrease in sort order, so each cell can be handled by a task of its
own and cells only exchange small summaries.

The cut is plain arithmetic, ``floor((value - lo) / width)`` with bounds per key. A cell that is
still too big (rows bunched in time) is cut again between its own bounds, and a cell whose
rows all share one value of the first sort column is cut along the next one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Rows one task should sort. The number of heavy cells is at most rows / CELL_ROWS.
CELL_ROWS = 500_000
# Heavy cells are collected and broadcast. Should there be more than this, the row limit is raised
# to a share of the data that keeps them below it.
MAX_HEAVY = 20_000
# Inputs below this size fit one task anyway; the counting pass is skipped.
PROBE_BYTES = 128 << 20
# Input bytes per task of a large frame. The number of tasks is fixed by it: joined by the size of shuffle files, which
# compress well, a few tasks would sort and hold most rows.
TASK_BYTES = 16 << 20
MAX_TASKS = 100_000
UNKNOWN_BYTES = 1 << 60
MAX_LEVELS = 8
PIECES_LIMIT = 1 << 20


@dataclass(frozen=True)
class Cells:
    """A frame with cell columns; ``columns`` is empty when no key was heavy."""

    df: DataFrame
    columns: tuple[str, ...]
    heavy: str | None  # boolean column: the row's key was split
    parts: int | None = None  # tasks for the rows of a large frame

    def with_columns(self, **columns: Column) -> Cells:
        return Cells(self.df.withColumns(columns), self.columns, self.heavy, self.parts)

    def dealt(self, keys: Sequence[str]) -> DataFrame:
        """The frame dealt by keys and cells, a large one into ``parts`` tasks."""
        by = [*keys, *self.columns]
        return self.df.repartition(self.parts, *by) if self.parts and by else self.df

    def plain(self) -> DataFrame:
        """The frame without cell columns."""
        return self.df.drop(*self.columns, self.heavy) if self.heavy else self.df


def plan_bytes(df: DataFrame) -> int:
    """Size estimate available without running a job.

    The optimizer multiplies sizes at joins, so its figure is capped by the bytes of the inputs.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return min(int(plan.stats().sizeInBytes()), read)


def is_large(df: DataFrame) -> bool:
    return plan_bytes(df) >= PROBE_BYTES


def task_count(df: DataFrame) -> int | None:
    """Tasks for a frame: those of a shuffle, and more where its input has more than ``TASK_BYTES`` for each.

    None where the size of the input is not known (Spark then estimates as much as a number holds).
    """
    size = plan_bytes(df)
    return None if size >= UNKNOWN_BYTES else max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // TASK_BYTES, MAX_TASKS))


def same_keys(left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Null-safe equality over key columns."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right)], F.lit(True))


def _ordinal(df: DataFrame, name: str) -> Column | None:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    return None


def _heavy_groups(df: DataFrame, by: Sequence[str], ordinals: Sequence[Column], limit: int) -> DataFrame:
    """Groups above ``limit`` rows with the sort column to cut along, its lower bound and the cell width.

    One pass; partial aggregation keeps the shuffle to one row per group and map task.
    """
    stats = [F.count(F.lit(1)).alias("_n")]
    for i, ordinal in enumerate(ordinals):
        stats += [F.min(ordinal).alias(f"_lo{i}"), F.max(ordinal).alias(f"_hi{i}")]
    groups = df.groupBy(*by).agg(*stats).filter(F.col("_n") > limit)
    cut, lo, width = F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("double")
    pieces = F.least(F.ceil(F.col("_n") * 2 / limit), F.lit(PIECES_LIMIT)).cast("double")
    for i in reversed(range(len(ordinals))):
        splits = F.col(f"_lo{i}") < F.col(f"_hi{i}")
        cut = F.when(splits, F.lit(i)).otherwise(cut)
        lo = F.when(splits, F.col(f"_lo{i}")).otherwise(lo)
        width = F.when(splits, (F.col(f"_hi{i}") - F.col(f"_lo{i}")) / pieces).otherwise(width)
    return groups.select(
        *[F.col(k).alias(f"_k_{k}") for k in by], cut.alias("_cut"), lo.alias("_from"), width.alias("_width")
    ).filter("_cut IS NOT NULL AND _width > 0")


def split_cells(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cell_rows: int | None = None
) -> Cells:
    """Add cell columns for keys with more than ``cell_rows`` rows.

    ``order`` names ascending, non-null sort columns; text columns end the list of columns usable for
    cutting. With ``cell_rows=None`` small inputs are returned as they are.
    """
    if cell_rows is None and not is_large(df):
        return Cells(df, (), None)
    parts = task_count(df) if cell_rows is None else None
    ordinals: list[tuple[str, Column]] = []
    for name in order:
        ordinal = _ordinal(df, name)
        if ordinal is None:
            break
        ordinals.append((name, ordinal))
    if not ordinals:
        return Cells(df, (), None, parts)

    limit = cell_rows or CELL_ROWS
    spark = df.sparkSession
    cells: list[str] = []
    for level in range(MAX_LEVELS):
        by = [*keys, *cells]
        source = df if not cells else df.filter("_heavy")
        heavy = _heavy_groups(source, by, [o for _, o in ordinals], limit)
        rows = heavy.limit(MAX_HEAVY + 1).collect()
        if len(rows) > MAX_HEAVY:
            limit = max(limit, source.count() // MAX_HEAVY)
            heavy = _heavy_groups(source, by, [o for _, o in ordinals], limit)
            rows = heavy.collect()  # at most rows / limit groups are larger than limit
        if not rows:
            break
        name = f"_cell{level}"
        if not by:
            # One series only: its bounds become literals, there is nothing to join on.
            i, lo_0, width_0 = rows[0]["_cut"], rows[0]["_from"], rows[0]["_width"]
            number = F.floor((ordinals[i][1] - F.lit(lo_0)) / F.lit(width_0)).cast("long")
            df = df.select("*", F.lit(True).alias("_heavy"), F.coalesce(number, F.lit(0)).alias(name))
            cells.append(name)
            continue
        table = F.broadcast(spark.createDataFrame(rows, heavy.schema))
        value = reduce(
            lambda acc, pair: F.when(F.col("_cut") == pair[0], pair[1]).otherwise(acc),
            [(i, o) for i, (_, o) in enumerate(ordinals)],
            F.lit(None).cast("double"),
        )
        joined = df.join(table, same_keys([F.col(k) for k in by], [F.col(f"_k_{k}") for k in by]), "left")
        cell = F.coalesce(F.floor((value - F.col("_from")) / F.col("_width")), F.lit(0)).cast("long")
        kept = [F.col(c) for c in df.columns]
        if not cells:
            kept.append(F.col("_cut").isNotNull().alias("_heavy"))
        df = joined.select(*kept, cell.alias(name))
        cells.append(name)
    return Cells(df, tuple(cells), "_heavy" if cells else None, parts)
