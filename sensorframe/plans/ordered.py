"""Ordered scans over series that may be too long for one task.

Each function gives the answer of a plain window over ``partitionBy(keys).orderBy(order)``.
Light series use exactly that window. Heavy series are cut into cells (:mod:`.skew`): the window runs per
cell, one summary row per cell is carried forward with a second, small window, and the two parts
are combined.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .skew import Cells, same_keys, split_cells


@dataclass(frozen=True)
class Scan:
    """One running value: ``kind`` is prev, sum, min, max, last or count.

    ``before=True`` leaves the current row out. ``prev`` takes the previous row's value and
    ``last`` the newest non-null value.
    """

    name: str
    kind: str
    value: Column | None = None
    before: bool = False


def _in_cell(scan: Scan, window) -> Column:
    end = -1 if scan.before else Window.currentRow
    frame = window.rowsBetween(Window.unboundedPreceding, end)
    if scan.kind == "prev":
        # Wrapped in a struct: a null value of an existing row differs from "no row".
        return F.lag(F.struct(scan.value.alias("v"))).over(window)
    if scan.kind == "count":
        return F.count(F.lit(1)).over(frame)
    if scan.kind == "last":
        return F.last(scan.value, ignorenulls=True).over(frame)
    return {"sum": F.sum, "min": F.min, "max": F.max}[scan.kind](scan.value).over(frame)


def _summary(scan: Scan, order: Sequence[str]) -> Column:
    position = F.struct(*order)
    if scan.kind == "prev":
        return F.max_by(F.struct(scan.value.alias("v")), position)
    if scan.kind == "count":
        return F.count(F.lit(1))
    if scan.kind == "last":
        return F.max_by(scan.value, F.when(scan.value.isNotNull(), position))
    return {"sum": F.sum, "min": F.min, "max": F.max}[scan.kind](scan.value)


def _carry(scan: Scan, frame) -> Column:
    name = f"_s_{scan.name}"
    if scan.kind in ("prev", "last"):
        return F.last(name, ignorenulls=True).over(frame)
    return {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[scan.kind](name).over(frame)


def _combine(scan: Scan, inner: Column, carried: Column) -> Column:
    if scan.kind in ("prev", "last"):
        return F.coalesce(inner, carried)
    if scan.kind in ("sum", "count"):
        return F.coalesce(inner + carried, inner, carried)
    return {"min": F.least, "max": F.greatest}[scan.kind](inner, carried)


def _unwrap(scan: Scan, value: Column) -> Column:
    return value["v"] if scan.kind == "prev" else value


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    scans: Sequence[Scan],
    cell_rows: int | None = None,
) -> DataFrame:
    """Add the running values of ``scans``; ``order`` must be a total order per key."""
    return scan_cells(split_cells(df, keys, order, cell_rows), keys, order, scans).plain()


def scan_cells(cells: Cells, keys: Sequence[str], order: Sequence[str], scans: Sequence[Scan]) -> Cells:
    """:func:`ordered_scan` on a frame already cut, so that several scans share the cut and its shuffle."""
    window = (Window.partitionBy(*keys, *cells.columns) if keys or cells.columns else Window.partitionBy(F.lit(0))).orderBy(
        *order
    )
    if not cells.columns:
        out = cells.dealt(keys).select("*", *[_unwrap(s, _in_cell(s, window)).alias(s.name) for s in scans])
        return Cells(out, (), None, cells.parts)

    at = [*keys, *cells.columns]
    summary = (
        cells.df.filter(cells.heavy)
        .groupBy(*at)
        .agg(*[_summary(s, order).alias(f"_s_{s.name}") for s in scans])
    )
    earlier = (
        (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
        .orderBy(*cells.columns)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = summary.select(
        *[F.col(c).alias(f"_c_{c}") for c in at], *[_carry(s, earlier).alias(f"_p_{s.name}") for s in scans]
    )
    inner = cells.dealt(keys).select("*", *[_in_cell(s, window).alias(f"_w_{s.name}") for s in scans])
    # One short row per heavy cell.
    joined = inner.join(
        F.broadcast(carry), same_keys([F.col(c) for c in at], [F.col(f"_c_{c}") for c in at]), "left"
    )
    out = joined.select(
        *cells.df.columns,
        *[_unwrap(s, _combine(s, F.col(f"_w_{s.name}"), F.col(f"_p_{s.name}"))).alias(s.name) for s in scans],
    )
    return Cells(out, cells.columns, cells.heavy, cells.parts)


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    n: int,
    values: Sequence[tuple[str, Callable]],
    cell_rows: int | None = None,
) -> DataFrame:
    """Add aggregates over the last ``n`` rows, each given as ``(name, window -> Column)``.

    Heavy series are numbered and cut into blocks; the last ``n - 1`` rows of a block are copied
    to the next one, so every frame is complete inside its block.
    """
    cells: Cells = split_cells(df, keys, order, cell_rows)
    back = -(n - 1)
    if not cells.columns:
        window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        frame = window.orderBy(*order).rowsBetween(back, 0)
        return df.select("*", *[fn(frame).alias(name) for name, fn in values])
    block_rows = max(cell_rows or 1_000_000, n)
    numbered = scan_cells(cells, keys, order, [Scan("_rn", "count")]).plain()
    block = F.floor((F.col("_rn") - 1) / block_rows)
    position = (F.col("_rn") - 1) % block_rows
    spread = numbered.withColumn("_own", block).withColumn(
        "_block",
        F.explode(
            F.when(position >= block_rows + back, F.array(block, block + 1)).otherwise(F.array(block))
        ),
    )
    frame = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(back, 0)
    return (
        spread.select("*", *[fn(frame).alias(name) for name, fn in values])
        .filter("_own = _block")
        .select(*df.columns, *[name for name, _ in values])
    )


def full_frame(frame, n: int, value: Column) -> Column:
    """Null until the frame holds ``n`` rows."""
    return F.when(F.count(F.lit(1)).over(frame) == n, value)


@dataclass(frozen=True)
class Transfer:
    """What a stretch of rows does to the state it starts with, as a small plain value.

    ``of(rows)`` sums up consecutive rows, ``then(a, b)`` joins the values of two stretches that follow one another, and
    ``apply(value, state)`` gives the state at the end from the state at the start (None at the start of a series).
    """

    of: Callable[[pd.DataFrame], object]
    then: Callable[[object, object], object]
    apply: Callable[[object, object], object]


def _stretches(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame | None]]:
    """Consecutive rows of one key from sorted batches, and ``(name, None)`` at the end of every batch's last key."""
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.reset_index(drop=True)
        changed = (pdf[by] != pdf[by].shift()).any(axis=1).to_numpy()
        starts = [*np.flatnonzero(changed), len(pdf)]
        names = list(zip(*[pdf[k].to_numpy()[starts[:-1]] for k in by]))
        for at, end, name in zip(starts, starts[1:], names):
            yield name, pdf.iloc[at:end]
        yield names[-1], None


def _concat(pieces: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pieces = [p for p in pieces if len(p)]
    if pieces:
        yield pd.concat(pieces, ignore_index=True)


def fold_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Callable,
    schema: T.StructType,
    finish: Callable | None = None,
    transfer: Transfer | None = None,
    cell_rows: int | None = None,
) -> DataFrame:
    """Walk each series in order, for rules where every row depends on the outcome of earlier ones.

    ``step(state, rows) -> (state, out)`` gets consecutive rows of one series as a pandas frame
    (``state`` is None at its start); ``finish(state) -> out`` runs at its end. Spark sorts, and the
    rows stream through in Arrow batches, so only ``state`` is held in memory whatever the length. States must be plain
    values (numbers, text, tuples, lists).

    With a ``transfer`` a heavy series is cut into cells that are walked in parallel: the cells' transfers are chained, one small row
    a cell, to the state each cell starts with. Without one a series is walked by one task, in one sorted pass. Either way
    the frame is a single plan: no job runs here (but the count of heavy keys), nothing is collected.
    """
    key_cols, order_cols, columns = list(keys), list(order), df.columns
    cells = split_cells(df, key_cols, order_cols, cell_rows) if transfer is not None else Cells(df, (), None)
    by = [*key_cols, *cells.columns]
    rows = cells.df
    if cells.columns:
        starts = _cell_starts(cells, key_cols, order_cols, columns, transfer)
        rows = rows.withColumns({"_state": F.lit(None).cast("binary"), "_last": F.lit(None).cast("boolean")})
        # Numbers are 0 in the rows that carry a state, as a null would turn whole numbers into doubles in pandas.
        filler = lambda kind: F.lit(0 if isinstance(kind, T.NumericType) else None).cast(kind)
        rows = rows.unionByName(starts.select("*", *[filler(f.dataType).alias(f.name) for f in rows.schema if f.name not in starts.columns]))
        ordered = rows.repartition(*by).sortWithinPartitions(*by, F.col("_last").isNull(), *order_cols)
    else:
        ordered = rows.repartition(*by).sortWithinPartitions(*by, *order_cols) if by else rows.repartition(1).sortWithinPartitions(*order_cols)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, last, pieces = None, None, True, []
        names = by or ["_all"]
        for name, part in _stretches((b if by else b.assign(_all=0) for b in batches), names):
            if part is None:
                # One output batch per input batch, however many series it holds.
                yield from _concat(pieces)
                pieces = []
                continue
            if name != current:
                if current is not None and finish is not None and last:
                    pieces.append(finish(state))
                current, state, last = name, None, True
                if "_last" in part.columns and part["_last"].iloc[0] is not None and not pd.isna(part["_last"].iloc[0]):
                    state, last = pickle.loads(part["_state"].iloc[0]), bool(part["_last"].iloc[0])
                    part = part.iloc[1:]
            if len(part):
                state, out = step(state, part[columns])
                pieces.append(out)
        if current is not None and finish is not None and last:
            pieces.append(finish(state))
        yield from _concat(pieces)

    return ordered.mapInPandas(walk, schema)


def _cell_starts(cells: Cells, keys: list[str], order: list[str], columns: list[str], transfer: Transfer) -> DataFrame:
    """``keys, cells, _heavy, _state, _last``: the state at the start of every heavy cell, and whether it is its series' last."""
    by = [*keys, *cells.columns]
    heavy, cell_cols = cells.df.filter(cells.heavy), list(cells.columns)
    fields = [heavy.schema[c] for c in by]

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, value = None, None
        for name, part in _stretches(batches, by):
            if part is None:
                continue
            if name != current and current is not None:
                yield pd.DataFrame([(*current, pickle.dumps(value))], columns=[*by, "_value"])
                value = None
            current, more = name, transfer.of(part[columns])
            value = more if value is None else transfer.then(value, more)
        if current is not None:
            yield pd.DataFrame([(*current, pickle.dumps(value))], columns=[*by, "_value"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cell_cols, ignore_index=True)
        state, states = None, []
        for value in pdf["_value"]:
            states.append(pickle.dumps(state))
            state = transfer.apply(pickle.loads(value), state)
        return pdf[by].assign(_state=states, _last=np.arange(len(pdf)) == len(pdf) - 1)

    found = heavy.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(
        summaries, T.StructType([*fields, T.StructField("_value", T.BinaryType())])
    )
    schema = T.StructType([*fields, T.StructField("_state", T.BinaryType()), T.StructField("_last", T.BooleanType())])
    grouped = found.groupBy(*keys) if keys else found.groupBy(F.lit(0))
    return grouped.applyInPandas(chain, schema).withColumn(cells.heavy, F.lit(True))
