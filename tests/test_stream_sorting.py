"""Keyed streams whose batches do not fit in the memory of a task."""

import numpy as np
import pandas as pd
import pytest

from sensorframe.streaming import jobs as B, sorting, stateful as Z
from sensorframe.streaming.sorting import SortedRuns


class Blocks(dict):
    """A map state in memory that notes how many blocks it held."""

    most = 0

    def updateValue(self, key, value):
        self[key] = value
        self.most = max(self.most, len(self))

    def getValue(self, key):
        return self[key]

    def removeKey(self, key):
        del self[key]


@pytest.mark.parametrize("values", [40, 800, 1])
def test_runs_are_merged_in_bounded_frames(values):
    rng = np.random.default_rng(values)
    rows = pd.DataFrame({"a": rng.integers(0, values, 800), "b": rng.permutation(800), "c": [f"x{i}" for i in range(800)]})
    rows.loc[rng.integers(0, 800, 50), "a"] = np.nan
    blocks = Blocks()
    chunks = (rows.iloc[s : s + 7] for s in range(0, 800, 7))
    out = list(SortedRuns(blocks, ["a", "b"], memory_rows=20, block_rows=5).sorted(chunks))
    levels = 2  # 38 runs of 21 rows, eight merged at a time
    assert max(map(len, out)) <= 5 * sorting.FAN_IN * levels and not blocks and blocks.most > 100
    pd.testing.assert_frame_equal(pd.concat(out, ignore_index=True), rows.sort_values(["a", "b"], ignore_index=True))


def test_rows_of_equal_order_keep_their_arrival():
    rows = pd.DataFrame({"a": [1] * 400, "n": range(400)})
    out = SortedRuns(Blocks(), ["a"], memory_rows=10, block_rows=3).sorted(rows.iloc[s : s + 4] for s in range(0, 400, 4))
    assert pd.concat(out)["n"].tolist() == list(range(400))


def test_no_rows():
    assert list(SortedRuns(Blocks(), ["a"]).sorted(iter([]))) == []


ROWS = 3_000
SCHEMA = "device STRING, t LONG, v LONG, raised BOOLEAN, cleared BOOLEAN, at TIMESTAMP"


def streams(spark, tmp_path, name, transform, small):
    """Rows of one device in two batches, most of a batch in one key."""
    config = {"spark.sql.execution.arrow.maxRecordsPerBatch": "100"} if small else {}
    source, out, at = (str(tmp_path / f"{name}-{small}-{x}") for x in ("in", "out", "cp"))
    before = {k: spark.conf.get(k) for k in config}
    for k, v in config.items():
        spark.conf.set(k, v)
    try:
        for lo, hi in ((0, 2_000), (2_000, ROWS)):
            rows = spark.range(lo, hi).selectExpr(
                "if(id % 50 = 7, 'b', 'a') AS device", "id AS t", "id * (id % 7) + 1 AS v", "id % 3 = 0 AS raised", "id % 401 = 5 AS cleared",
                "timestamp_seconds(id) AS at",
            )
            rows.repartition(3).write.mode("append").parquet(source)
            B.run_available(transform(spark.readStream.schema(SCHEMA).parquet(source)), B.to_parquet(out), at)
        return sorted(map(tuple, spark.read.parquet(out).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(
    ("name", "transform"),
    [
        ("rate", lambda s: Z.stream_dvdt(s, ["device"], "t", ["v"], ["t"])),
        ("flag", lambda s: Z.stream_flag_counts(s, ["device"], ["t"], "raised", "cleared")),
        ("newest", lambda s: Z.late_policy(s, "newest", "v", ["device"], ["t"])),
        ("suppress", lambda s: Z.stream_suppress(s, ["device"], ["t"], "t", 17)),
        ("fan", lambda s: Z.fan_in(s.withWatermark("at", "1 hour"), ["device"], ["t"], "at", 5, 20)),
    ],
)
def test_a_key_that_fills_a_batch(spark, tmp_path, monkeypatch, name, transform):
    whole = streams(spark, tmp_path, name, transform, False)
    # Attributes of an instance travel to the tasks, those of an imported class do not.
    for kind in (Z._Rate, Z._Flag, Z._Newest, Z._Suppress, Z._FanIn):
        monkeypatch.setattr(kind, "__init__", _small(kind.__init__))
    parts = streams(spark, tmp_path, name, transform, True)
    assert len(whole) > 20 and parts == whole


def _small(make):
    def small(self, *args):
        make(self, *args)
        self.memory_rows, self.block_rows = 150, 20

    return small


def test_a_policy_without_keys_is_refused(spark):
    with pytest.raises(ValueError):
        Z.late_policy(spark.createDataFrame([(1,)], "ts LONG"), "newest", "ts")
