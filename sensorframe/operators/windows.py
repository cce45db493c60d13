"""Operators over ordered series: rates, rolling statistics, islands, call pairing."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.scalars import floor_div, lenient
from ..plans.ordered import Scan, fold_series, full_frame, ordered_scan, rolling, scan_cells
from ..plans.skew import split_cells
from ..sources.call_trace import file_title


def counter_rows(df: DataFrame, data_cols: Sequence[str]) -> DataFrame:
    """Counters as integers, 0 when not an integer; rows whose counters sum to 0 are left out."""

    def whole(name: str) -> Column:
        value = F.col(name)
        if not isinstance(df.schema[name].dataType, T.IntegralType):
            value = value.cast("string").try_cast("long")
        return F.coalesce(value.cast("long"), F.lit(0)).alias(name)

    rows = df.select(*[whole(c) if c in data_cols else F.col(c) for c in df.columns])
    return rows.filter(sum((F.col(c) for c in data_cols), F.lit(0)) != 0)


def dvdt(
    df: DataFrame,
    resource: Sequence[str],
    time_col: str,
    data_cols: Sequence[str],
    order: Sequence[str],
    clamp: bool = False,
    cell_rows: int | None = None,
) -> DataFrame:
    """Integer change per second of counters, against the previous row of the resource.

    Non-integers count as 0, rows whose values sum to 0 are skipped, a time step of 0 counts as 1
    and division rounds down. The first row of a resource gives no result.
    """
    others = [c for c in df.columns if c not in data_cols]
    rows = counter_rows(df, data_cols)
    before = F.struct(F.col(time_col), *data_cols)
    scanned = ordered_scan(rows, resource, order, [Scan("_prev", "prev", before)], cell_rows)
    step = F.col(time_col) - F.col(f"_prev.{time_col}")
    dt = F.when(step == 0, F.lit(1).cast("long")).otherwise(step)

    def rate(c: str) -> Column:
        value = floor_div(F.col(c) - F.col(f"_prev.{c}"), dt)
        return F.greatest(value, F.lit(0).cast("long")) if clamp else value

    return scanned.filter("_prev IS NOT NULL").select(*others, *[rate(c).alias(c) for c in data_cols])


def changes_per_second(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str],
    time_col: str = "timestamp",
    cell_rows: int | None = None,
) -> DataFrame:
    """Float delta ``_dv`` and rate ``_dvdt`` per column; null on the first row and for a zero step."""
    scanned = ordered_scan(
        df, keys, order, [Scan("_prev", "prev", F.struct(F.col(time_col), *cols))], cell_rows
    )
    dt = (F.col(time_col) - F.col(f"_prev.{time_col}")).cast("double")
    out = []
    for c in cols:
        dv = F.col(c) - F.col(f"_prev.{c}")
        out += [dv.alias(f"{c}_dv"), (dv / F.nullif(dt, F.lit(0.0))).alias(f"{c}_dvdt")]
    return scanned.select(*df.columns, *out)


def difference_positive(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    value: str,
    order: Sequence[str],
    name: str = "difference",
    cell_rows: int | None = None,
) -> DataFrame:
    """Counter increase since the last accepted row; 0 for resets, late rows and the first row."""
    cells = split_cells(df, key, order, cell_rows)
    seen = scan_cells(cells, key, order, [Scan("_newest", "max", F.col(ts), before=True)])
    marked = seen.with_columns(_ok=F.col("_newest").isNull() | (F.col(ts) >= F.col("_newest")))
    accepted = F.when(F.col("_ok"), F.col(value))
    last = scan_cells(marked, key, order, [Scan("_last", "last", accepted, before=True)]).df
    diff = F.when(F.col("_ok") & F.col("_last").isNotNull(), F.greatest(F.col(value) - F.col("_last"), F.lit(0)))
    return last.select(*df.columns, F.coalesce(diff, F.lit(0)).cast("double").alias(name))


def rolling_mean(df, keys, order, col, n, name=None, cell_rows=None) -> DataFrame:
    """Mean of the last ``n`` rows, null until there are ``n``."""
    value = lambda w: full_frame(w, n, F.avg(col).over(w))
    return rolling(df, keys, order, n, [(name or f"{col}_mean", value)], cell_rows)


def rolling_bands(df, keys, order, col, n, cell_rows=None) -> DataFrame:
    """Rolling mean and mean plus/minus one standard deviation."""
    mean = lambda w: full_frame(w, n, F.avg(col).over(w))
    std = lambda w: full_frame(w, n, F.stddev_samp(col).over(w))
    out = rolling(df, keys, order, n, [("mean", mean), ("std", std)], cell_rows)
    return out.withColumn("upper", F.col("mean") + F.col("std")).withColumn("lower", F.col("mean") - F.col("std"))


def rolling_corr(df, keys, order, a, b, n, name="corr", cell_rows=None) -> DataFrame:
    """Rolling correlation of two columns, smoothed by a rolling mean of the same width.

    A frame in which a column is constant has no correlation.
    """
    corr = lambda w: full_frame(w, n, F.corr(a, b).over(w))
    with lenient(df.sparkSession):
        first = rolling(df, keys, order, n, [("_corr", corr)], cell_rows)

    def smooth(w):
        complete = F.count("_corr").over(w) == n
        return F.when(complete, F.avg("_corr").over(w))

    return rolling(first, keys, order, n, [(name, smooth)], cell_rows).drop("_corr")


def auto_window(df: DataFrame, parts: int) -> int:
    """Window width as a share of the row count."""
    return max(1, df.count() // parts)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key; a min aggregate, so combining starts before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_row")).select("_row.*")


def longest_per_key(df: DataFrame, keys: Sequence[str], text: str, tie: Sequence[str]) -> DataFrame:
    """Row with the longest text per key, ties by ``tie`` ascending."""
    size = F.struct((-F.coalesce(F.length(text), F.lit(0))).alias("n"), *tie)
    return df.groupBy(*keys).agg(F.min_by(F.struct("*"), size).alias("_row")).select("_row.*")


def sliding_log(df: DataFrame, resource: Sequence[str], order: Sequence[str], n: int = 20) -> DataFrame:
    """Last ``n`` rows per resource.

    ``row_number() <= n`` is a group limit: each task keeps ``n`` rows per resource before the shuffle.
    """
    newest = Window.partitionBy(*resource).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def ffill(df: DataFrame, keys, order, cols: Sequence[str], cell_rows=None) -> DataFrame:
    """Replace nulls by the newest earlier value."""
    scanned = ordered_scan(df, keys, order, [Scan(f"_f_{c}", "last", F.col(c)) for c in cols], cell_rows)
    return scanned.select(*[F.col(f"_f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def join_lines(
    df: DataFrame, keys, order, text: str, stop: str, sep: str = ",", cell_rows=None
) -> DataFrame:
    """Join lines up to and including one that matches ``stop``; an unfinished tail is dropped."""
    is_stop = F.col(text).rlike(stop)
    scanned = ordered_scan(
        df, keys, order, [Scan("_island", "sum", is_stop.cast("long"), before=True)], cell_rows
    ).withColumn("_island", F.coalesce(F.col("_island"), F.lit(0).cast("long")))
    pieces = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    grouped = scanned.groupBy(*keys, "_island").agg(
        pieces.alias("_pieces"), F.bool_or(is_stop).alias("_closed")
    )
    return grouped.filter("_closed").select(
        *keys,
        (F.col("_island") + 1).alias("record"),
        F.array_join(F.col("_pieces")["_text"], sep).alias(text),
    )


def collapse_repeats(df: DataFrame, keys, order, message: str, cell_rows=None) -> DataFrame:
    """One row per run of equal messages: the first position, the message and the run length."""
    cells = split_cells(df.select(*dict.fromkeys([*keys, *order, message])), keys, order, cell_rows)
    scanned = scan_cells(cells, keys, order, [Scan("_prev", "prev", F.struct(F.col(message).alias("m")))])
    changed = F.col("_prev").isNull() | ~F.col("_prev.m").eqNullSafe(F.col(message))
    runs = scan_cells(scanned.with_columns(_new=changed.cast("long")), keys, order, [Scan("_run", "sum", F.col("_new"))]).df
    grouped = runs.groupBy(*keys, "_run").agg(
        F.min(F.struct(*order, message)).alias("_first"), F.count(F.lit(1)).alias("repeats")
    )
    return grouped.select(*keys, "_first.*", "repeats")


def zscore_signals(
    y: np.ndarray, history: np.ndarray, lag: int, threshold: float, influence: float
) -> tuple[np.ndarray, np.ndarray]:
    """Signals of ``y`` after the last ``lag + 1`` filtered values ``history``.

    Returns the signals and the filtered series including the history.
    """
    start = len(history)
    filtered = np.concatenate([history, y]).astype("float64")
    signals = np.zeros(len(y), dtype="int32")
    first, total = max(start, lag), len(filtered)
    if first >= total:
        return signals, filtered
    # The first judged point uses the first lag values; later ones the window ending two back.
    at = np.arange(first, total)
    base = np.maximum(at - 1 - lag, 0)
    windows = np.lib.stride_tricks.sliding_window_view(filtered, lag)
    mean, std = windows.mean(axis=1)[base], windows.std(axis=1)[base]
    # Points beyond the limit as long as no value in their window has been replaced.
    beyond = at[np.abs(filtered[first:] - mean) > threshold * std]
    i, touched_until = first, -1
    while i < total:
        if i > touched_until:
            ahead = np.searchsorted(beyond, i)
            if ahead == len(beyond):
                break
            i = int(beyond[ahead])
            centre = mean[i - first]
        else:
            window = filtered[max(i - 1 - lag, 0) :][:lag]
            centre = window.mean()
            if not abs(filtered[i] - centre) > threshold * window.std():
                i += 1
                continue
        signals[i - start] = 1 if filtered[i] > centre else -1
        smoothed = influence * filtered[i] + (1 - influence) * filtered[i - 1]
        if smoothed != filtered[i]:
            filtered[i] = smoothed
            touched_until = i + 1 + lag
        i += 1
    return signals, filtered


def zscore_anomaly(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    y: str,
    lag: int,
    threshold: float,
    influence: float,
) -> DataFrame:
    """Smoothed z-score signal (-1, 0, 1) per row of each series.

    Every point depends on the filtered values before it, so a series is walked in order, in one sorted pass; only
    ``lag + 1`` values per series are held.
    """
    rows = df.select(*keys, *order, y)
    schema = T.StructType([*rows.schema.fields, T.StructField("signal", T.IntegerType())])

    def step(state, pdf: pd.DataFrame):
        history = np.array(state or (), dtype="float64")
        signal, filtered = zscore_signals(pdf[y].to_numpy(dtype="float64"), history, lag, threshold, influence)
        # While at most lag values were seen the start rule still applies; that is what a short state means.
        return tuple(filtered[-(lag + 1) :].tolist()), pdf.assign(signal=signal)

    return fold_series(rows, keys, order, step, schema)


# What is known of an open call: its position, the columns of its start row, and its start time.
OPEN_CALL = ["block", "pos", "level", "opid", "opcode", "name", "program", "bucket", "objtype", "time"]
MEASURED = ["calls", "min_time", "max_time", "range_from", "range_to", "cache_calls", "cache_time", "errors"]


def _is_shown(level: float | None) -> bool:
    return level is not None and level >= 1


def _runs(batch: pa.RecordBatch, last: tuple | None) -> list[int]:
    """Rows of a batch that start another block than the row before."""
    file, block = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False)
    changed = (block[1:] != block[:-1]) | pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)
    first = [] if last == (file[0].as_py(), int(block[0])) else [0]
    return first + (np.flatnonzero(changed) + 1).tolist()


def _check_in_place(pos: np.ndarray, last: int) -> int:
    """Row ids hold the number of the reading task; rows that were moved or sorted since show it."""
    if (pos >> 33 != TaskContext.get().partitionId()).any() or pos[0] <= last or (np.diff(pos) <= 0).any():
        raise ValueError("rows were moved since they were read: leave in_place out")
    return int(pos[-1])


def pair_calls(
    lines: DataFrame, with_buckets: bool = False, cell_rows=None, in_place: bool = False
) -> DataFrame:
    """Calls from the start and finish rows of traces.

    ``lines`` comes from ``read_call_trace``. A finish row closes the newest open start row; the start rows still open around it are its
    callers. ``records`` includes those of nested calls, without bucket rows unless ``with_buckets``.

    Each block of a file is walked in order with the open calls as state, whatever their depth. A block of a file of several blocks (with
    ``cell_rows``: every stretch of so many rows) is summed up by the records of the calls that it closes but did not open,
    and by the calls that it leaves open, so that blocks are walked in parallel.

    With ``in_place`` the rows must stand as ``read_call_trace`` gives them (filters are fine), and are walked where they are read, without
    a shuffle; moved rows are refused. Otherwise they are dealt by block and sorted first.
    """
    start = F.col("kind") == "S"
    rows = lines.select("file", *OPEN_CALL, start.alias("starts"), F.col("records").cast("double").alias("records"), *MEASURED)

    def placed(df: DataFrame) -> DataFrame:
        # After the joins: a sort below a join is taken out by the optimizer.
        return df if in_place else df.repartition("file", "block").sortWithinPartitions("file", "block", "pos")

    def counts(bucket: int | None) -> bool:
        return with_buckets or bucket == 0

    # A stretch: records closed from before it; counted of its own; open calls with what was closed and counted until their start.
    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, newest = None, 0, -1

        def ended():
            return pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "pos": at[2], "_value": pickle.dumps((before, own, left))}], summary_schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if in_place:
                newest = _check_in_place(batch.column("pos").to_numpy(), newest)
            new = set(_runs(batch, at and at[:2]))
            columns = [batch.column(c).to_pylist() for c in ("file", "starts", "records", *OPEN_CALL)]
            for i, (file, starts, records, *call) in enumerate(zip(*columns)):
                if i in new or size == cell_rows:
                    if at is not None:
                        yield ended()
                    at, size, before, own, left = (file, call[0], call[1]), 0, [], 0.0, []
                size += 1
                if starts:
                    left.append((tuple(call), len(before), own))
                elif left:
                    own += (records or 0.0) if counts(left.pop()[0][7]) else 0.0
                else:
                    before.append(records or 0.0)
        if at is not None:
            yield ended()

    def opened(stack: list[tuple], call: tuple, total: float) -> tuple:
        path = stack[-1][2] if stack else ()
        return call, total, (*path, call[5]) if _is_shown(call[2]) else path

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "pos"], ignore_index=True)
        total, stack, states = 0.0, [], []
        for value in pdf["_value"]:
            states.append(pickle.dumps((total, stack)))
            before, own, left = pickle.loads(value)
            sums = [total]
            for records in before:
                if not stack:
                    raise ValueError("finish row without a start row")
                sums.append(sums[-1] + (records if counts(stack.pop()[0][7]) else 0.0))
            for call, closes, counted in left:
                stack.append(opened(stack, call, sums[closes] + counted))
            total = sums[-1] + own
        return pdf[["file", "block", "pos"]].assign(_state=states)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Open calls: row in the batch (below 0: in held, from the end), shown, counted, total at the start, path.
        last, newest, total, stack, held = None, -1, 0.0, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if in_place:
                newest = _check_in_place(batch.column("pos").to_numpy(), newest)
            states, new = batch.column("_state"), set(_runs(batch, last))
            given = set(np.flatnonzero(states.is_valid().to_numpy(zero_copy_only=False)).tolist()) if states.null_count < len(states) else set()
            last = batch.column("file")[-1].as_py(), batch.column("block")[-1].as_py()
            call, finish, up, total_records, path_ids, paths = [], [], [], [], [], {}
            values = (batch.column(c).to_pylist() for c in ("starts", "records", "level", "bucket", "name"))
            for i, (starts, records, level, bucket, name) in enumerate(zip(*values)):
                if i in new or i in given:
                    total, stack = 0.0, []
                    if i in given:
                        total, started = pickle.loads(states[i].as_py())
                        for values_of, at_start, path in started:
                            held.append(values_of)
                            stack.append((-len(held), _is_shown(values_of[2]), counts(values_of[7]), at_start, path))
                    elif batch.column("block")[i].as_py() > 0:
                        raise ValueError("the blocks of a file changed between two reads")
                if starts:
                    path = stack[-1][4] if stack else ()
                    shown = level is not None and level >= 1
                    stack.append((i, shown, with_buckets or bucket == 0, total, (*path, name) if shown else path))
                    continue
                if not stack:
                    raise ValueError("finish row without a start row")
                at, _, counted, at_start, path = stack.pop()
                if counted:
                    total += records or 0.0
                call.append(at)
                finish.append(i)
                up.append(stack[-1][0] if stack and stack[-1][1] else None)
                total_records.append(total - at_start if counted else None if records is None else total - at_start + records)
                path_ids.append(paths.setdefault(path, len(paths)))
            if call:
                known = {c: pa.concat_arrays([pa.array([h[k] for h in held], batch.column(c).type), batch.column(c)]) for k, c in enumerate(OPEN_CALL)}
                slot = lambda at: at + len(held) if at >= 0 else -1 - at
                at, above, done = pa.array(map(slot, call)), pa.array([None if u is None else slot(u) for u in up], pa.int64()), pa.array(finish)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("file").take(done), pa.array(list(map(list, paths)), pa.list_(pa.string())).take(pa.array(path_ids)),
                        known["block"].take(above), known["pos"].take(above), batch.column("time").take(done), pa.array(total_records, pa.float64()),
                        *[known[c].take(at) for c in OPEN_CALL], *[batch.column(c).take(done) for c in MEASURED],
                    ],
                    names=schema.names,
                )
            # Calls that stay open go on as plain values.
            rows_open = [s[0] for s in stack if s[0] >= 0]
            fresh = iter(zip(*(batch.column(c).take(pa.array(rows_open, pa.int64())).to_pylist() for c in OPEN_CALL)))
            held = [next(fresh) if s[0] >= 0 else held[-1 - s[0]] for s in stack]
            stack = [(-1 - k, *s[1:]) for k, s in enumerate(stack)]

    position = T.StructType([rows.schema[c] for c in ("file", "block", "pos")])
    summary_schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("_value", pa.binary())])
    several = rows if cell_rows else rows.join(F.broadcast(rows.filter("block > 0").select("file").distinct()), "file", "left_semi")
    found = placed(several).mapInArrow(summaries, T.StructType([*position, T.StructField("_value", T.BinaryType())]))
    # One small row per block of a file of several blocks.
    states = found.groupBy("file").applyInPandas(chain, T.StructType([*position, T.StructField("_state", T.BinaryType())]))
    known_rows = rows.join(F.broadcast(states), ["file", "block", "pos"], "left")

    schema = T.StructType.fromDDL("file STRING, path ARRAY<STRING>, up_block LONG, up_pos LONG, finished DOUBLE, records DOUBLE")
    for c in [*OPEN_CALL, *MEASURED]:
        schema.add(T.StructField(c, rows.schema[c].dataType))
    walked = placed(known_rows).mapInArrow(walk, schema)
    return walked.select(
        "file", *file_title(),
        "level", "opid", "opcode", "name", "program", "bucket", "objtype",
        "path",
        F.struct("block", "pos").alias("call_id"),
        F.when(F.col("up_block").isNotNull(), F.struct(F.col("up_block").alias("block"), F.col("up_pos").alias("pos"))).alias("parent_id"),
        F.col("time").alias("started"), "finished",
        F.round(F.col("finished") - F.col("time"), 6).alias("duration"),
        F.col("records").cast("long").alias("records"),
        *MEASURED,
    )
