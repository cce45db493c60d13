"""Heavy series are cut into cells; the answers must equal those of plain windows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from sensorframe.operators import aggregates as A, filters as L, percentiles as P, windows as W
from sensorframe.plans.ordered import Scan, ordered_scan, rolling
from sensorframe.plans.skew import split_cells
from sensorframe.streaming import alerts as E

CELL = 50


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def series(spark):
    """One device holds most rows, a third of all rows share one instant, and there are nulls."""
    rng = random.Random(7)
    rows = []
    for n in range(3000):
        device = "hot" if rng.random() < 0.7 else f"d{rng.randrange(12)}"
        ts = 5_000 if rng.random() < 0.33 else rng.randrange(10_000)
        rows.append((device, ts, n, rng.choice([None, *range(20)]), float(rng.randrange(1000)) / 10))
    schema = "device STRING, ts LONG, seq LONG, v LONG, x DOUBLE"
    return spark.createDataFrame(rows, schema).repartition(8, "seq").cache()


def test_cells_are_bounded_and_ordered(series):
    cells = split_cells(series, ["device"], ["ts", "seq"], CELL)
    assert cells.columns
    sizes = cells.df.groupBy("device", *cells.columns).count().agg(F.max("count")).first()[0]
    assert sizes <= CELL
    order = Window.partitionBy("device").orderBy("ts", "seq")
    cell = F.struct(*cells.columns)
    broken = cells.df.withColumn("before", F.lag(cell).over(order)).filter(F.col("before") > cell)
    assert broken.count() == 0


def test_light_keys_are_left_alone(series):
    cells = split_cells(series, ["device"], ["ts", "seq"], 1_000_000)
    assert cells.columns == ()


def test_small_frames_skip_the_probe(series):
    assert split_cells(series, ["device"], ["ts", "seq"]).columns == ()


def scans():
    return [
        Scan("prev", "prev", F.col("v")),
        Scan("total", "sum", F.col("v")),
        Scan("total_before", "sum", F.col("v"), before=True),
        Scan("low", "min", F.col("v"), before=True),
        Scan("high", "max", F.col("v")),
        Scan("newest", "last", F.col("v")),
        Scan("newest_before", "last", F.col("v"), before=True),
        Scan("n", "count"),
    ]


@pytest.mark.parametrize("keys", [["device"], []])
def test_ordered_scan(series, keys):
    plain = ordered_scan(series, keys, ["ts", "seq"], scans())
    cut = ordered_scan(series, keys, ["ts", "seq"], scans(), CELL)
    assert "_cell0" not in cut.columns
    assert rows_of(cut) == rows_of(plain)


@pytest.mark.parametrize("n", [1, 2, 10, 120])
def test_rolling(series, n):
    values = [("total", lambda w: F.sum("v").over(w)), ("n", lambda w: F.count(F.lit(1)).over(w))]
    plain = rolling(series, ["device"], ["ts", "seq"], n, values)
    cut = rolling(series, ["device"], ["ts", "seq"], n, values, CELL)
    assert rows_of(cut) == rows_of(plain)


CASES = {
    "dvdt": lambda d, c: W.dvdt(d, ["device"], "ts", ["v"], ["ts", "seq"], cell_rows=c),
    "difference": lambda d, c: W.difference_positive(d, ["device"], "ts", "v", ["seq"], cell_rows=c),
    "ffill": lambda d, c: W.ffill(d, ["device"], ["seq"], ["v"], c),
    "drop_older": lambda d, c: L.drop_older(d, "ts", ["seq"], None, c),
    "drop_older_key": lambda d, c: L.drop_older(d, "ts", ["seq"], ["device"], c),
    "flags": lambda d, c: E.flag_counts(d, ["device"], ["seq"], F.col("v") > 15, F.col("v") < 2, cell_rows=c),
    "repeats": lambda d, c: W.collapse_repeats(d, ["device"], ["seq"], "v", c),
    "lines": lambda d, c: W.join_lines(d.withColumn("t", F.concat(F.lit("l"), F.col("seq").cast("string"))), ["device"], ["seq"], "t", "7$", cell_rows=c),
    "pctl_rank": lambda d, c: P.pctl_rank(d, ["device"], "x", {"p95": 0.95, "p90": 0.9}, c),
    "pctl_disc": lambda d, c: P.pctl_disc(d, ["device"], "x", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}, c),
    "pctl_disc_all": lambda d, c: P.pctl_disc(d, [], "x", {"p50": 0.5}, c),
    "quantiles": lambda d, c: P.quantiles(d, ["device"], "x", {"q1": 0.1, "q5": 0.5, "q9": 0.93}, c).select(
        "device", F.round("q1", 9), F.round("q5", 9), F.round("q9", 9)
    ),
    "resample": lambda d, c: A.resample(d.withColumn("at", F.timestamp_seconds("ts")), ["device"], "at", 7, ["x"], cell_rows=c).select(
        "device", "bucket", F.round("x", 9)
    ),
    "zscore": lambda d, c: W.zscore_anomaly(d.na.fill(0), ["device"], ["ts", "seq"], "x", 6, 1.5, 0.3),
    "suppress": lambda d, c: E.suppress(d, ["device"], ["ts", "seq"], "ts", 40, c),
    "suppress_unordered": lambda d, c: E.suppress(d, ["device"], ["seq"], "ts", 40, c),
    "suppress_long": lambda d, c: E.suppress(d, ["device"], ["ts", "seq"], "ts", 900, c),
    "fan_in_many": lambda d, c: E.fan_in_batch(d, ["device"], ["ts", "seq"], "ts", 70, 400, c),
    "fan_in_one": lambda d, c: E.fan_in_batch(d, ["device"], ["ts", "seq"], "ts", 1, 5, c),
    "fan_in": lambda d, c: E.fan_in_batch(d, ["device"], ["ts", "seq"], "ts", 3, 25, c),
    "pool": lambda d, c: A.pool_usage(d, ["device"], "ts", "v", 10, c),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_operators_do_not_depend_on_cells(series, case):
    run = CASES[case]
    assert rows_of(run(series, CELL)) == rows_of(run(series, None))


@pytest.mark.parametrize("case", sorted(CASES))
def test_operators_do_not_depend_on_input_partitioning(series, case):
    run = CASES[case]
    assert rows_of(run(series.repartition(3, "x"), None)) == rows_of(run(series, None))


def test_constant_order_columns_cannot_be_cut(spark):
    df = spark.range(300).select(F.lit("a").alias("k"), F.lit(1).alias("t"), "id")
    cells = split_cells(df, ["k"], ["t"], 100)
    assert cells.columns == ()
    assert split_cells(df, ["k"], ["t", "id"], 100).columns


def test_many_heavy_keys_raise_the_limit(spark, monkeypatch):
    from sensorframe.plans import skew

    monkeypatch.setattr(skew, "MAX_HEAVY", 10)
    df = spark.range(3000).select((F.col("id") % 40).alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    assert split_cells(df, ["k"], ["t"], 20).columns == ()
    hot = df.withColumn("k", F.when(F.col("t") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("k")))
    assert split_cells(hot, ["k"], ["t"], 20).columns
    cut = ordered_scan(hot, ["k"], ["t"], [Scan("n", "count")], 20)
    assert rows_of(cut) == rows_of(ordered_scan(hot, ["k"], ["t"], [Scan("n", "count")]))


def nested_trace(rng, calls):
    """Start and finish rows nested up to 12 levels, with names, buckets and records."""
    lines, stack, t = [], [], 0.0
    for _ in range(calls * 3):
        t += 1
        if stack and (len(stack) > 11 or rng.random() < 0.5):
            stack.pop()
            lines.append(f"F,{t},{rng.randint(0, 3)},1,1,1,0,0,0,0,{rng.randint(0, 1)},0,0")
        else:
            level = len(stack) + 1
            stack.append(level)
            lines.append(f"S,{level},{len(lines)},7,0,N{rng.randint(0, 4)},{t},f.c,1,1,1,prog,{rng.choice([0, 0, 0, 2])},obj")
    for _ in stack:
        t += 1
        lines.append(f"F,{t},1,1,1,1,0,0,0,0,0,0,0")
    return lines


@pytest.mark.parametrize("with_buckets", [False, True])
@pytest.mark.parametrize("cell_rows", [None, 9, 40])
def test_nested_calls(spark, tmp_path, cell_rows, with_buckets):
    import random

    from sensorframe.sources.call_trace import read_call_trace

    rng, want = random.Random(4), []
    for f in range(3):
        lines = nested_trace(rng, 120 if f else 5)
        (tmp_path / f"cm.{f}.20181116_201500.plog.txt").write_text("\n".join(lines) + "\n")
        stack = []
        for line in lines:
            p = line.split(",")
            if p[0] == "S":
                stack.append([p, 0])
                continue
            (start, inner), records = stack.pop(), int(p[2])
            counted = with_buckets or start[12] == "0"
            path = ".".join(c[0][5] for c in stack) + ("." if stack else "") + start[5]
            want.append((str(f), int(start[2]), path, float(p[1]) - float(start[6]), inner + records, len(stack) > 0))
            for call in stack:
                call[1] += records if counted else 0
    got = W.pair_calls(read_call_trace(spark, str(tmp_path)), with_buckets, cell_rows)
    rows = [(r.process, r.opid, ".".join(r.path), r.duration, r.records, r.parent_id is not None) for r in got.collect()]
    assert sorted(rows) == sorted(want)
    parents = {(r.file, r.call_id): r.opid for r in got.collect()}
    assert all(r.parent_id is None or (r.file, r.parent_id) in parents for r in got.collect())


def test_one_plan_whatever_the_cells(spark, series):
    """Sequential rules run in one pass: there are more cells than jobs."""
    cells = split_cells(series, ["device"], ["ts", "seq"], CELL)
    assert cells.df.select("device", *cells.columns).distinct().count() > 20
    frame = E.suppress(series, ["device"], ["ts", "seq"], "ts", 40, CELL)
    spark.sparkContext.setJobGroup("cells", "")
    frame.write.format("noop").mode("overwrite").save()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("cells")) < 15


def test_calls_in_place(spark, tmp_path):
    """Blocks of one file are walked by several tasks without a shuffle of their rows; moved rows are refused."""
    from sensorframe.sources.call_trace import read_call_trace

    lines = nested_trace(random.Random(5), 900)
    (tmp_path / "cm.1.20181116_201500.plog.txt").write_text("\n".join(lines) + "\n")
    key = lambda calls: rows_of(calls.select("process", "opid", "path", "duration", "records", F.col("parent_id").isNotNull()))
    whole = key(W.pair_calls(read_call_trace(spark, str(tmp_path))))
    assert len(whole) == sum(x.startswith("F") for x in lines)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        trace = read_call_trace(spark, str(tmp_path))
        assert trace.select("block").distinct().count() > 5
        calls = W.pair_calls(trace, in_place=True)
        assert key(calls) == whole and key(W.pair_calls(trace)) == whole
        assert key(W.pair_calls(trace, in_place=True, cell_rows=7)) == whole
        moved = trace.repartition(3, "pos")
        assert key(W.pair_calls(moved)) == whole
        with pytest.raises(Exception, match="moved"):
            W.pair_calls(moved, in_place=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_profile_pairs_calls_once(spark, tmp_path):
    from sensorframe.operators import profiles as C
    from sensorframe.sources.call_trace import read_call_trace

    (tmp_path / "cm.1.20181116_201500.plog.txt").write_text("\n".join(nested_trace(random.Random(6), 30)) + "\n")
    profile = C.call_profile(W.pair_calls(read_call_trace(spark, str(tmp_path))))
    plan = profile._jdf.queryExecution().optimizedPlan().toString()
    assert "MapIn" not in plan and profile.count() > 1


def test_large_frames_keep_their_tasks(spark, series, tmp_path, monkeypatch):
    """Rows of a large frame are not joined into few tasks because they compress well."""
    from sensorframe.plans import skew

    series.write.parquet(str(tmp_path / "series"))
    series = spark.read.parquet(str(tmp_path / "series"))
    plain = rows_of(ordered_scan(series, ["device"], ["ts", "seq"], scans()))
    monkeypatch.setattr(skew, "PROBE_BYTES", 1)
    monkeypatch.setattr(skew, "CELL_ROWS", 300)
    large = ordered_scan(series, ["device"], ["ts", "seq"], scans())
    assert large.rdd.getNumPartitions() >= 8
    assert rows_of(large) == plain
    light = ordered_scan(series.filter("device <> 'hot'"), ["device"], ["ts", "seq"], scans())
    assert light.rdd.getNumPartitions() >= 8


def test_flows_are_put_together_once(spark, monkeypatch):
    """Large flow statistics rank written flows, with the rank and the size of a group from one window."""
    from sensorframe.plans import skew

    steps = spark.range(400).selectExpr(
        "id % 90 AS ecid", "id AS instance_id", "concat('c', id % 3) AS cdn", "timestamp_seconds(id * 7) AS created",
        "timestamp_seconds(id * 7 + id % 11) AS end_time", "CASE WHEN id % 5 = 0 THEN timestamp_seconds(id) END AS faulted_time",
    )
    plain = rows_of(A.flow_chain_stats(steps))
    monkeypatch.setattr(skew, "PROBE_BYTES", 1)
    large = A.flow_chain_stats(steps)
    assert "collect_list" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(large) == plain
    assert rows_of(A.flow_chain_stats(steps, 3)) == plain
