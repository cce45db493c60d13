"""Rows of one key and micro-batch in order, in bounded memory."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Rows of a key that are sorted in memory, rows of a stored block, sorted runs that are merged at a time.
MEMORY_ROWS = 50_000
BLOCK_ROWS = 2_000
FAN_IN = 8


class SortedRuns:
    """Sorts what does not fit in memory by merging runs that wait in the state store.

    ``blocks`` is a map state from ``(run, block)`` to a pickled frame. Runs of one level are merged into one of the next
    when there are ``FAN_IN`` of them, so at most ``FAN_IN`` blocks per level are in memory. Blocks are removed as they are
    read: after a batch the map is empty again.
    """

    def __init__(self, blocks, order: Sequence[str], memory_rows: int = MEMORY_ROWS, block_rows: int = BLOCK_ROWS):
        self.blocks, self.order = blocks, list(order)
        self.memory_rows, self.block_rows = memory_rows, block_rows
        self.names = itertools.count()

    def _sort(self, frames: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(frames, ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)

    def _store(self, frames: Iterator[pd.DataFrame]) -> tuple[int, int]:
        run, count = next(self.names), 0
        for frame in frames:
            for start in range(0, len(frame), self.block_rows):
                self.blocks.updateValue((run, count), (pickle.dumps(frame.iloc[start : start + self.block_rows]),))
                count += 1
        return run, count

    def _load(self, run: int, block: int) -> pd.DataFrame:
        frame = pickle.loads(bytes(self.blocks.getValue((run, block))[0]))
        self.blocks.removeKey((run, block))
        return frame

    def _merge(self, runs: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        """Sorted frames of at most one block per run.

        All rows up to the first end of a block whose run goes on are final; then that run's next block is read.
        """
        counts, at = dict(runs), {run: 1 for run, _ in runs}
        held = {run: self._load(run, 0) for run, _ in runs}
        while held:
            parts = []
            for run in filter(held.__contains__, counts):  # in the order of ``runs``, for ties
                parts.append(held[run].assign(_run=run, _end=False))
                if at[run] < counts[run]:
                    parts[-1].iloc[-1, -1] = True
            rows = self._sort(parts)
            ends = rows["_end"].to_numpy().nonzero()[0]
            cut = int(ends[0]) + 1 if len(ends) else len(rows)
            yield rows.iloc[:cut].drop(columns=["_run", "_end"]).reset_index(drop=True)
            rest = rows.iloc[cut:]
            held = {run: part.drop(columns=["_run", "_end"]) for run, part in rest.groupby("_run", sort=False)}
            if len(ends):
                run = int(rows["_run"].iloc[cut - 1])
                held[run] = self._load(run, at[run])
                at[run] += 1

    def sorted(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels: list[list[tuple[int, int]]] = []

        def add(run: tuple[int, int], level: int) -> None:
            if level == len(levels):
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) == FAN_IN:
                whole = self._store(self._merge(levels[level]))
                levels[level] = []
                add(whole, level + 1)

        held, count = [], 0
        for frame in rows:
            held.append(frame)
            count += len(frame)
            if count > self.memory_rows:
                add(self._store(iter([self._sort(held)])), 0)
                held, count = [], 0
        if not levels:
            if count:
                yield self._sort(held)
            return
        if count:
            add(self._store(iter([self._sort(held)])), 0)
        # Older runs first: rows of equal order keep the order of their arrival.
        yield from self._merge([run for level in reversed(levels) for run in level])


class OrderedProcessor(StatefulProcessor):
    """A keyed processor that sees the rows of a batch in order, one bounded frame after the other.

    Frames are bounded whatever share of the batch a key holds: up to ``memory_rows`` rows are sorted at once, more go
    through the state store, see :class:`SortedRuns`.
    """

    order: Sequence[str] = ()
    memory_rows = MEMORY_ROWS
    block_rows = BLOCK_ROWS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "run LONG, block LONG", "rows BINARY")

    def in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return SortedRuns(self.blocks, self.order, self.memory_rows, self.block_rows).sorted(rows)

    def close(self) -> None:
        pass
