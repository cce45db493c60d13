"""Flags, conditions, hysteresis alerts and repeated-action suppression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.ordered import Scan, Transfer, fold_series, scan_cells
from ..plans.skew import split_cells

OPERATORS = {
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
    "ge": lambda a, b: a >= b,
    "le": lambda a, b: a <= b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
}


def when(df: DataFrame, metric: str, op: str, value: float, action: str, resource: str | None = None) -> DataFrame:
    """Rows meeting the condition, with the action to take. Works on batch and streaming frames."""
    hit = OPERATORS[op](F.col(metric), F.lit(value))
    rows = df if resource is None else df.filter(F.col("resource_id") == resource)
    return rows.filter(F.coalesce(hit, F.lit(False))).select(
        "*",
        F.lit(action).alias("action"),
        F.lit(metric).alias("attribute"),
        F.col(metric).cast("double").alias("value_seen"),
        F.lit(float(value)).alias("limit"),
    )


def flag_counts(
    df: DataFrame,
    resource: Sequence[str],
    order: Sequence[str],
    raised: Column,
    cleared: Column,
    name: str = "flag",
    cell_rows=None,
) -> DataFrame:
    """Counter after each row: a raise adds one, a clear resets it."""
    up = F.coalesce(raised, F.lit(False)).cast("long")
    down = F.coalesce(cleared, F.lit(False))
    cells = split_cells(df, resource, order, cell_rows)
    total = scan_cells(cells, resource, order, [Scan("_raised", "sum", up)])
    base = scan_cells(total, resource, order, [Scan("_base", "last", F.when(down, F.col("_raised")))])
    return base.df.select(*df.columns, (F.col("_raised") - F.coalesce(F.col("_base"), F.lit(0))).alias(name))


def clear_by_prefix(name: Column, flag: str, prefix: bool = False) -> Column:
    """Does a clear of ``name`` reset ``flag``? With ``prefix`` it resets all flags starting with it."""
    return F.lit(flag).startswith(name) if prefix else name == flag


def hysteresis_alert(
    df: DataFrame, resource: Sequence[str], order: Sequence[str], metric: str, high: float, low: float, n: int, cell_rows=None
) -> DataFrame:
    """Rows above ``high`` while the flag, raised above ``high`` and cleared below ``low``, exceeds ``n``."""
    value = F.col(metric)
    counted = flag_counts(df, resource, order, value > high, value < low, "flag", cell_rows)
    return counted.filter((F.col("flag") > n) & (value > high))


def suppress(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, hold: float, cell_rows=None
) -> DataFrame:
    """Actions that run: one is skipped while an earlier one of its key is active for ``hold`` seconds.

    ``ts`` is a number of seconds. Whether a row runs depends on the last row that ran, so a key is
    walked in order, in batches.
    """
    schema = T.StructType(list(df.schema.fields))

    def step(active_until, pdf: pd.DataFrame):
        times = pdf[ts].to_numpy(dtype="float64")
        keep, at = [], 0
        until = -np.inf if active_until is None else active_until
        monotone = bool((times[1:] >= times[:-1]).all())
        while at < len(times):
            if monotone:
                at += int(np.searchsorted(times[at:], until))
                if at == len(times):
                    break
            elif times[at] < until:
                at += 1
                continue
            keep.append(at)
            until = times[at] + hold
            at += 1
        return float(until), pdf.iloc[keep]

    return fold_series(df, keys, order, step, schema, transfer=_suppress_transfer(ts, hold), cell_rows=cell_rows)


def _suppress_transfer(ts: str, hold: float) -> Transfer:
    """``(starts, ends)``: active until ``u`` before the rows means until ``ends[i]`` after them, ``i`` the first with ``starts[i] >= u``; beyond, ``u``."""

    def shortened(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = np.append(ends[1:] != ends[:-1], True)
        return starts[last], ends[last]

    def reached(value, until: np.ndarray) -> np.ndarray:
        starts, ends = value
        at = np.searchsorted(starts, until)
        return np.where(at < len(starts), ends[np.minimum(at, len(starts) - 1)], until)

    def then(a, b):
        beyond = b[0] > a[0][-1]
        return shortened(np.concatenate([a[0], b[0][beyond]]), np.concatenate([reached(b, a[1]), b[1][beyond]]))

    def of(pdf: pd.DataFrame):
        times = pdf[ts].to_numpy(dtype="float64")
        if not (times[1:] >= times[:-1]).all():
            return reduce(then, ((np.array([t]), np.array([t + hold])) for t in times))
        after = np.searchsorted(times, times + hold)
        ends = times + hold
        for i in range(len(times) - 1, -1, -1):  # a row's end is that of the first row after its hold
            if (j := max(i + 1, after[i])) < len(times):
                ends[i] = ends[j]
        first = np.append(True, times[1:] != times[:-1])
        return shortened(times[first], ends[first])

    return Transfer(of, then, lambda value, state: float(reached(value, np.array([-np.inf if state is None else state]))[0]))


def fan_in_batch(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, n: int, timeout: float, cell_rows=None
) -> DataFrame:
    """Groups of events: complete at the ``n``-th, or cut off ``timeout`` seconds after their first event.

    Gives the keys, ``started, emitted, events, complete``; ``ts`` is a number of seconds in order.
    """
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType(
        [
            *key_fields,
            T.StructField("started", T.DoubleType()),
            T.StructField("emitted", T.DoubleType()),
            T.StructField("events", T.LongType()),
            T.StructField("complete", T.BooleanType()),
        ]
    )
    names = [f.name for f in schema.fields]

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names)

    def step(state, pdf: pd.DataFrame):
        key, first, count = state or (tuple(pdf.iloc[0][list(keys)]), None, 0)
        out = []
        for t in pdf[ts].to_numpy(dtype="float64"):
            if first is not None and t >= first + timeout:
                out.append((*key, first, first + timeout, count, False))
                first, count = None, 0
            first = t if first is None else first
            count += 1
            if count == n:
                out.append((*key, first, t, count, True))
                first, count = None, 0
        return (key, None if first is None else float(first), count), frame(out)

    def finish(state):
        key, first, count = state
        return frame([] if first is None else [(*key, first, first + timeout, count, False)])

    # Rows from a state: how many there are, the times of the first of them, and the state at the end if a group starts at each of these.
    def run(times: np.ndarray) -> tuple:
        first, count, at = None, 0, 0
        while at < len(times):
            if first is None:
                first, count, at = times[at], 1, at + 1
            cut = at + int(np.searchsorted(times[at:], first + timeout))
            if (full := at + n - count) <= cut and full <= len(times):
                first, count, at = None, 0, full
            elif cut < len(times):
                first, count, at = None, 0, cut
            else:
                count, at = count + len(times) - at, len(times)
        return (None, 0) if first is None else (float(first), count)

    def of(pdf: pd.DataFrame):
        times = pdf[ts].to_numpy(dtype="float64")
        fresh = [run(times[j:]) for j in range(min(n, len(times)) + 1)]
        return len(times), times[:n].tolist(), fresh, tuple(pdf.iloc[0][list(keys)])

    def moved(value, first, count) -> tuple:
        length, times, fresh, _ = value
        if first is None:
            return fresh[0]
        cut, full = int(np.searchsorted(times, first + timeout)), n - count
        if full <= cut and full <= length:
            return fresh[full]
        return fresh[cut] if cut < len(times) else (first, count + length)

    def then(a, b):
        fresh = [moved(b, *s) for s in a[2]]
        return a[0] + b[0], (a[1] + b[1])[:n], (fresh + b[2][1:])[: n + 1] if a[0] < n else fresh, a[3]

    def apply(value, state):
        _, first, count = state or (None, None, 0)
        return (value[3], *moved(value, first, count))

    return fold_series(df, keys, order, step, schema, finish, Transfer(of, then, apply), cell_rows)
