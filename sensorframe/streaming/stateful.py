"""Keyed stateful operators on streams.

State lives in the state store per key; ``ttl_ms`` drops keys that are no longer seen. Inside a micro-batch a
key's rows may arrive in several Arrow batches and in any order, so they are sorted first, in bounded memory
(:mod:`.sorting`): one key may hold a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessorHandle

from ..session import use_disk_state
from .sorting import OrderedProcessor


class _Rate(OrderedProcessor):
    """Previous time and counters of a resource."""

    def __init__(self, order, time_col, data_cols, columns, ttl_ms):
        self.order, self.time_col, self.data_cols = order, time_col, data_cols
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = T.StructType([T.StructField(c, T.LongType()) for c in [self.time_col, *self.data_cols]])
        super().init(handle)
        self.prev = handle.getValueState("prev", kind, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start = prev = self.prev.get() if self.prev.exists() else None
        names = [self.time_col, *self.data_cols]
        for pdf in self.in_order(rows):
            for c in self.data_cols:
                number = pd.to_numeric(pdf[c], errors="coerce")
                pdf[c] = number.where(number % 1 == 0).fillna(0).astype("int64")
            pdf = pdf[pdf[self.data_cols].sum(axis=1) != 0]
            if not len(pdf):
                continue
            values = pdf[names].astype("int64")
            # Whole numbers throughout: counters beyond 2^53 stay exact.
            before = values.shift(fill_value=0)
            if prev is None:
                pdf, last, values, before = pdf.iloc[1:], values.iloc[-1], values.iloc[1:], before.iloc[1:]
            else:
                before.iloc[0] = list(prev)
                last = values.iloc[-1]
            prev = tuple(int(v) for v in last)
            if len(pdf):
                dt = (values[self.time_col] - before[self.time_col]).replace(0, 1)
                yield pdf.assign(**{c: (values[c] - before[c]) // dt for c in self.data_cols})[self.columns]
        if prev is not start:
            self.prev.update(prev)


def stream_dvdt(
    sdf: DataFrame,
    resource: Sequence[str],
    time_col: str,
    data_cols: Sequence[str],
    order: Sequence[str],
    ttl_ms: int | None = None,
) -> DataFrame:
    """Streaming form of ``dvdt``: integer change per second against the resource's previous row."""
    use_disk_state(sdf.sparkSession)
    others = [c for c in sdf.columns if c not in data_cols]
    columns = [*others, *data_cols]
    schema = T.StructType(
        [*[sdf.schema[c] for c in others], *[T.StructField(c, T.LongType()) for c in data_cols]]
    )
    processor = _Rate(list(order), time_col, list(data_cols), columns, ttl_ms)
    return sdf.groupBy(*resource).transformWithStateInPandas(processor, schema, "Append", "None")


class _Flag(OrderedProcessor):
    def __init__(self, order, raised, cleared, columns, name, ttl_ms):
        self.order, self.raised, self.cleared = order, raised, cleared
        self.columns, self.name, self.ttl_ms = columns, name, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "count LONG", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        count = self.count.get()[0] if self.count.exists() else 0
        for pdf in self.in_order(rows):
            up, down = pdf[self.raised].fillna(False).astype("int64"), pdf[self.cleared].fillna(False).astype(bool)
            total = up.cumsum() + count
            base = total.where(down).ffill().fillna(0).astype("int64")
            pdf[self.name] = total - base
            count = int(pdf[self.name].iloc[-1])
            yield pdf[self.columns]
        self.count.update((count,))


def stream_flag_counts(
    sdf: DataFrame, resource, order, raised: str, cleared: str, name: str = "flag", ttl_ms: int | None = None
) -> DataFrame:
    """Streaming form of ``flag_counts``; ``raised`` and ``cleared`` name boolean columns."""
    use_disk_state(sdf.sparkSession)
    schema = T.StructType([*sdf.schema.fields, T.StructField(name, T.LongType())])
    processor = _Flag(list(order), raised, cleared, [*sdf.columns, name], name, ttl_ms)
    return sdf.groupBy(*resource).transformWithStateInPandas(processor, schema, "Append", "None")


class _Newest(OrderedProcessor):
    def __init__(self, order, ts, columns, ttl_ms):
        self.order, self.ts, self.columns, self.ttl_ms = order, ts, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.newest = handle.getValueState("newest", "newest LONG", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start = seen = self.newest.get()[0] if self.newest.exists() else None
        for pdf in self.in_order(rows):
            before = pdf[self.ts].cummax().shift()
            if seen is not None:
                before = before.fillna(seen).clip(lower=seen)
            kept = pdf[before.isna() | (pdf[self.ts] > before)]
            if len(kept):
                times = kept[self.ts].dropna()
                seen = int(times.iloc[-1]) if len(times) else seen
                yield kept[self.columns]
        if seen is not None and seen != start:
            self.newest.update((seen,))


def late_policy(
    sdf: DataFrame,
    mode: str,
    ts: str,
    keys: Sequence[str] = (),
    order: Sequence[str] = (),
    max_age_s: int = 300,
    ttl_ms: int | None = None,
) -> DataFrame:
    """What happens to late rows.

    ``newest`` keeps rows strictly newer than the newest seen of their resource, in arrival ``order``; it needs ``keys``, as
    without them the whole stream would be one state group in one task. The first rows of a resource stay while they have no time.
    ``age`` keeps rows at most ``max_age_s`` old (``ts`` in epoch seconds).
    """
    if mode == "age":
        from pyspark.sql import functions as F

        from ..operators.filters import max_age

        return max_age(sdf, ts, max_age_s, F.unix_seconds(F.current_timestamp()))
    if mode != "newest":
        raise ValueError(f"unknown mode {mode!r}")
    if not keys or not order:
        raise ValueError("mode 'newest' needs the keys of a resource and the order of arrival")
    use_disk_state(sdf.sparkSession)
    processor = _Newest(list(order), ts, sdf.columns, ttl_ms)
    return sdf.groupBy(*keys).transformWithStateInPandas(processor, sdf.schema, "Append", "None")


class _Suppress(OrderedProcessor):
    def __init__(self, order, ts, hold, columns, ttl_ms):
        self.order, self.ts, self.hold, self.columns, self.ttl_ms = order, ts, hold, columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.until = handle.getValueState("until", "until DOUBLE", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else float("-inf")
        for pdf in self.in_order(rows):
            keep = []
            for at, t in enumerate(pdf[self.ts].to_numpy(dtype="float64")):
                if t >= until:
                    keep.append(at)
                    until = t + self.hold
            if keep:
                yield pdf.iloc[keep][self.columns]
        self.until.update((float(until),))


def stream_suppress(sdf: DataFrame, keys, order, ts: str, hold: float, ttl_ms: int | None = None) -> DataFrame:
    """Streaming form of ``suppress``."""
    use_disk_state(sdf.sparkSession)
    processor = _Suppress(list(order), ts, hold, sdf.columns, ttl_ms)
    return sdf.groupBy(*keys).transformWithStateInPandas(processor, sdf.schema, "Append", "None")


class _FanIn(OrderedProcessor):
    """Open group of a key: time of its first event and the number of events."""

    def __init__(self, keys, order, ts, n, timeout_ms):
        self.keys, self.order, self.ts = keys, order, ts
        self.n, self.timeout_ms = n, timeout_ms
        self.columns = [*keys, "started", "emitted", "events", "complete"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "first LONG, events LONG")

    def _frame(self, key, rows) -> pd.DataFrame:
        return pd.DataFrame([(*key, *r) for r in rows], columns=self.columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, count = self.open.get() if self.open.exists() else (None, 0)
        old = first
        for pdf in self.in_order(rows):
            out = []
            # Milliseconds whatever unit the Arrow batch used for the timestamp.
            times = pdf[self.ts].to_numpy(dtype="datetime64[ms]").astype("int64")
            for t in times:
                t = int(t)
                if first is not None and t >= first + self.timeout_ms:
                    out.append((first, first + self.timeout_ms, count, False))
                    first, count = None, 0
                first = t if first is None else first
                count += 1
                if count == self.n:
                    out.append((first, t, count, True))
                    first, count = None, 0
            if out:
                yield self._frame(key, out)
        if old is not None and old != first:
            self.handle.deleteTimer(old + self.timeout_ms)
        if first is None:
            self.open.clear()
        else:
            self.open.update((first, count))
            self.handle.registerTimer(first + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.open.exists():
            return
        first, count = self.open.get()
        if expiredTimerInfo.getExpiryTimeInMs() < first + self.timeout_ms:
            return
        self.open.clear()
        yield self._frame(key, [(first, first + self.timeout_ms, count, False)])


def fan_in(sdf: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, n: int, timeout_s: float) -> DataFrame:
    """Emit when ``n`` events of a key arrived, or when event time passes ``timeout_s`` after the first one.

    The stream needs a watermark on ``ts``; ``started`` and ``emitted`` are epoch milliseconds.
    """
    use_disk_state(sdf.sparkSession)
    schema = T.StructType(
        [
            *[sdf.schema[k] for k in keys],
            T.StructField("started", T.LongType()),
            T.StructField("emitted", T.LongType()),
            T.StructField("events", T.LongType()),
            T.StructField("complete", T.BooleanType()),
        ]
    )
    processor = _FanIn(list(keys), list(order), ts, n, int(timeout_s * 1000))
    return sdf.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")
