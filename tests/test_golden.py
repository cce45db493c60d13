"""Small vectors worked out by hand."""

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sensorframe.operators import aggregates as A, filters as L, percentiles as P, profiles as C, project as R, windows as W
from sensorframe.plans.storage import scratch_dir
from sensorframe.sources import captures as T
from sensorframe.sources.call_trace import read_call_trace
from sensorframe.sources.lines import read_lines
from sensorframe.sources.tbml import read_tbml
from sensorframe.streaming import alerts as E


def write_text(tmp_path, name, text):
    target = tmp_path / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    return str(target)


def test_floor_rates(spark):
    df = spark.createDataFrame([("a", 10, 100), ("a", 12, 93), ("a", 12, 95), ("a", 13, 0)], "k STRING, t LONG, v LONG")
    out = W.dvdt(df.withColumn("seq", F.monotonically_increasing_id()), ["k"], "t", ["v"], ["t", "seq"])
    # -7 over 2 s rounds down to -4, a step of 0 s counts as 1 s, a row of zeros is skipped.
    assert [r.v for r in out.orderBy("t", "seq").collect()] == [-4, 2]
    clamped = W.dvdt(df.withColumn("seq", F.monotonically_increasing_id()), ["k"], "t", ["v"], ["t", "seq"], clamp=True)
    assert sorted(r.v for r in clamped.collect()) == [0, 2]


def test_rates_read_text_counters(spark):
    df = spark.createDataFrame([("a", 1, "10"), ("a", 2, "n/a"), ("a", 3, "17")], "k STRING, t LONG, v STRING")
    out = W.dvdt(df, ["k"], "t", ["v"], ["t"])
    assert [(r.t, r.v) for r in out.collect()] == [(3, 3)]


def test_difference_positive(spark):
    rows = [(1, 1, 10), (2, 2, 15), (3, 2, 12), (4, 1, 99), (5, 3, 20)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k STRING, seq LONG, ts LONG, v LONG")
    out = W.difference_positive(df, ["k"], "ts", "v", ["seq"]).orderBy("seq")
    assert [r.difference for r in out.collect()] == [0, 5, 0, 0, 8]


def test_drop_older(spark):
    df = spark.createDataFrame(list(enumerate([5, 6, 6, 4, 7])), "seq LONG, ts LONG")
    assert [r.ts for r in L.drop_older(df, "ts", ["seq"]).orderBy("seq").collect()] == [5, 6, 7]


def test_flags(spark):
    df = spark.createDataFrame([(n, a) for n, a in enumerate(["up", "up", "up", "clear", "up"])], "seq LONG, a STRING")
    out = E.flag_counts(df.withColumn("r", F.lit("eth0")), ["r"], ["seq"], F.col("a") == "up", F.col("a") == "clear")
    assert [r.flag for r in out.orderBy("seq").collect()] == [1, 2, 3, 0, 1]
    named = spark.createDataFrame([("net",), ("net_in",), ("other",)], "n STRING")
    hit = named.filter(E.clear_by_prefix(F.col("n"), "net_in_2", prefix=True)).collect()
    assert sorted(r.n for r in hit) == ["net", "net_in"]


def test_join_lines(spark):
    lines = ["a", "b", "RX bytes 1", "c", "RX bytes 2", "tail"]
    df = spark.createDataFrame([("f", n, v) for n, v in enumerate(lines)], "f STRING, n LONG, v STRING")
    out = W.join_lines(df, ["f"], ["n"], "v", "RX bytes").orderBy("record")
    assert [r.v for r in out.collect()] == ["a,b,RX bytes 1", "c,RX bytes 2"]


def test_rank_percentiles(spark):
    df = spark.range(1, 21).select(F.lit("a").alias("k"), "id").union(spark.range(9, 10).select(F.lit("b").alias("k"), "id"))
    out = {r.k: (r.p95, r.p90) for r in P.pctl_rank(df, ["k"], "id", {"p95": 0.95, "p90": 0.9}).collect()}
    assert out == {"a": (18, 17), "b": (0, 0)}


TRACE = """S,1,1,100,0,A,10.0,f.c,1,11,21,prog,0,obj
S,2,2,101,0,B,10.1,f.c,2,11,21,prog,0,obj
F,10.3,2,1,0.2,0.2,0,0,0,0,0,0,0
S,2,3,101,0,B,10.4,f.c,3,11,21,prog,0,obj
F,10.5,1,1,0.1,0.1,0,0,0,0,1,0,0
F,11.0,0,1,1.0,1.0,0,0,0,0,0,0,0
"""


def calls_of(spark, tmp_path, text, **options):
    write_text(tmp_path, "cm.7.20181116_201500.plog.txt", text)
    return W.pair_calls(read_call_trace(spark, str(tmp_path)), **options)


@pytest.mark.parametrize("cell_rows", [None, 2])
def test_call_profile(spark, tmp_path, cell_rows):
    calls = calls_of(spark, tmp_path, TRACE, cell_rows=cell_rows)
    got = {r.name: r for r in C.call_profile(calls).collect()}
    a, b = got["A"], got["B"]
    assert (a.total, a.percentage, a.calls, a.errors, a.average, a.minimum, a.maximum, a.records) == (1.0, 100.0, 1, 0, 1.0, 1.0, 1.0, 3)
    assert (b.total, b.percentage, b.calls, b.errors, b.average, b.minimum, b.maximum, b.records) == (0.3, 30.0, 2, 1, 0.15, 0.1, 0.2, 3)
    assert sorted(r.path for r in C.call_path_profile(calls).collect()) == ["A", "A.B"]
    assert [r.path for r in C.call_path_profile(calls, depth=1).collect()] == ["A"]
    own = C.exclusive_time(calls).collect()
    assert [(r.path, r.name, r.total, r.calls) for r in own] == [("A.VRT_OP_A", "VRT_OP_A", 0.7, 1)]
    assert C.exclusive_time(calls, base_ops=["A"]).count() == 0
    first = calls.first()
    assert (first.process, first.chain, str(first.ended)) == ("7", "cm", "2018-11-16 20:15:00")


def test_elapsed_marker_is_not_a_level(spark, tmp_path):
    text = "S,0,0,0,0,VRT_OP_ELAPSED,9.0,f,1,1,1,p,0,o\n" + TRACE + "F,12.0,0,1,0,0,0,0,0,0,0,0,0\n"
    calls = calls_of(spark, tmp_path, text)
    got = {r.name: r.total for r in C.call_profile(calls).collect()}
    assert got == {"A": 1.0, "B": 0.3}
    assert sorted(r.path for r in C.call_path_profile(calls).collect()) == ["A", "A.B"]


def test_finish_without_start_fails(spark, tmp_path):
    with pytest.raises(PySparkException):
        calls_of(spark, tmp_path, TRACE + "F,12.0,0,1,0,0,0,0,0,0,0,0,0\n").collect()


def test_bucket_rows_do_not_count(spark, tmp_path):
    text = TRACE.replace("S,2,3,101,0,B,10.4,f.c,3,11,21,prog,0,obj", "S,2,3,101,0,B,10.4,f.c,3,11,21,prog,2,obj")
    calls = calls_of(spark, tmp_path, text)
    got = {r.name: (r.calls, r.records) for r in C.call_profile(calls).collect()}
    assert got == {"A": (1, 2), "B": (1, 2)}
    shares = C.call_buckets(calls).collect()
    assert [(r.name, r.bucket, r.share) for r in shares] == [("B", 2, 100.0)]


def test_call_path_filters(spark):
    df = spark.createDataFrame([(["A"],), (["A", "B"],), (["A", "B", "C"],), (["A", "X"],), (["Z"],)], "path ARRAY<STRING>")
    on = {tuple(r.path): r.counted for r in L.filter_call_path(df, ["A", "B"]).collect()}
    assert on == {("A",): False, ("A", "B"): True, ("A", "B", "C"): True}
    left = {tuple(r.path) for r in L.exclude_call_paths(df, [["A", "B"], ["Z"]]).collect()}
    assert left == {("A", "X")}


def test_zscore(spark):
    y = [1, 1, 1, 1, 5, 1]
    df = spark.createDataFrame([("k", n, float(v)) for n, v in enumerate(y)], "k STRING, n LONG, y DOUBLE")
    out = W.zscore_anomaly(df, ["k"], ["n"], "y", 3, 2.0, 0.0).orderBy("n")
    assert [r.signal for r in out.collect()] == [0, 0, 0, 0, 1, 0]
    short = W.zscore_anomaly(df, ["k"], ["n"], "y", 30, 2.0, 0.0)
    assert {r.signal for r in short.collect()} == {0}


def brute_signals(y, lag, threshold, influence):
    """The rule written out over a whole list."""
    smooth, out = list(y), [0] * len(y)
    for i in range(lag, len(y)):
        base = smooth[0:lag] if i == lag else smooth[i - 1 - lag : i - 1]
        mean = sum(base) / lag
        std = (sum((b - mean) ** 2 for b in base) / lag) ** 0.5
        if abs(y[i] - mean) > threshold * std:
            out[i] = 1 if y[i] > mean else -1
            smooth[i] = influence * y[i] + (1 - influence) * smooth[i - 1]
    return out


@pytest.mark.parametrize("influence", [0.0, 0.5, 1.0])
def test_zscore_against_brute_force(spark, influence):
    import random

    rng = random.Random(3)
    data = {k: [round(rng.gauss(5, 1) + (9 if rng.random() < 0.05 else 0), 3) for _ in range(n)] for k, n in (("a", 400), ("b", 31), ("c", 7))}
    df = spark.createDataFrame([(k, n, v) for k, ys in data.items() for n, v in enumerate(ys)], "k STRING, n LONG, y DOUBLE")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = W.zscore_anomaly(df, ["k"], ["n"], "y", 10, 3.0, influence).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, ys in data.items():
        assert [r.signal for r in sorted(got, key=lambda r: r.n) if r.k == k] == brute_signals(ys, 10, 3.0, influence)


def test_fan_in(spark):
    df = spark.createDataFrame([("k", n, float(t)) for n, t in enumerate([0, 2, 4, 20, 25])], "k STRING, n LONG, t DOUBLE")
    out = E.fan_in_batch(df, ["k"], ["n"], "t", 3, 10).orderBy("started").collect()
    assert [(r.started, r.emitted, r.events, r.complete) for r in out] == [(0, 4, 3, True), (20, 30, 2, False)]


def test_suppress(spark):
    df = spark.createDataFrame([("k", t) for t in (0, 3, 10, 11, 21)], "k STRING, t LONG")
    assert [r.t for r in E.suppress(df, ["k"], ["t"], "t", 10).orderBy("t").collect()] == [0, 10, 21]


def test_tbml(spark, tmp_path):
    text = """<tbml xmlns="urn:x" version="11.0">
<table><columndef name="Host"/><columndef name="n.count"/>
<row><column name="Host">h</column><column name="n.count"> 3 </column></row>
<row><column name="Host">g</column><column name="n.count">  </column></row>
<row><column name="n.count">5</column></row></table></tbml>"""
    path = write_text(tmp_path, "t.xml", text)
    out = read_tbml(spark, path)
    assert out.columns == ["Host", "n_count"]
    assert sorted(tuple(r) for r in out.collect()) == [("g", "n/a"), ("h", "3"), ("n/a", "5")]
    with pytest.raises(ValueError):
        read_tbml(spark, write_text(tmp_path, "u.xml", text.replace("11.0", "9.9")))


def test_scoreboard(spark, tmp_path):
    write_text(tmp_path, "s.txt", "Total Accesses: 5\nIdleWorkers: 1\nScoreboard: __WK_S\n")
    row = T.parse_status_page(read_lines(spark, str(tmp_path))).first()
    assert (row.waiting, row.sending, row.keepalive, row.starting, row.total_accesses) == (3, 1, 1, 1, "5")


def test_line_order_spans_blocks(spark, tmp_path):
    lines = [f"line {n}" for n in range(5000)]
    write_text(tmp_path, "big.txt", "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_lines(spark, str(tmp_path))
        assert df.select("block").distinct().count() > 5
        assert [r.value for r in df.orderBy("block", "pos").collect()] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,)], "v DOUBLE")
    out = [r["count"] for r in A.histogram(df, "v", 10).orderBy("bin").collect()]
    assert out == [2, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    flat = A.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v DOUBLE"), "v", 4).orderBy("bin").collect()
    assert [r["count"] for r in flat] == [2, 0, 0, 0]


def test_transforms_keep_old_values(spark):
    df = spark.createDataFrame([("7", 2.0), ("x", 0.0)], "t STRING, v DOUBLE")
    out = R.apply_transforms(df, ["v = 1 / v", "t = cast(cast(t AS INT) + 1 AS STRING)", "w = v + 1"]).collect()
    assert [(r.t, r.v, r.w) for r in out] == [("8", 0.5, 1.5), ("x", 0.0, 1.0)]
    with pytest.raises(ValueError):
        R.apply_transforms(df, ["v == 1"])


def test_describe_keeps_null_keys_and_empty_groups(spark, tmp_path):
    rows = [("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    df.write.parquet(f"{tmp_path}/d")
    for frame in (df, spark.read.parquet(f"{tmp_path}/d")):
        got = {r["k"]: (r["count"], r["p50"]) for r in A.describe(frame, "v", ["k"]).collect()}
        assert got == {"a": (2, 2.0), "b": (0, None), None: (1, 5.0)}


def test_integer_division_is_exact(spark):
    from sensorframe.functions.scalars import floor_div

    df = spark.createDataFrame([(9007199254740993, 1), (-7, 2), (7, -2), (6, 3)], "v long, b long")
    assert [r[0] for r in df.select(floor_div(F.col("v"), F.col("b"))).collect()] == [9007199254740993, -4, -4, 2]


def test_load_test_columns_by_name(spark, tmp_path):
    from sensorframe.sources.load_test import read_load_test

    (tmp_path / "l.csv").write_text("label,allThreads,Latency,success,responseCode,elapsed,timeStamp\nhome,3,20,true,200,25,1700000000000\n")
    row = read_load_test(spark, str(tmp_path / "l.csv")).first()
    assert (row["response_code"], row["all_threads"], row["latency"], row["success"], row["elapsed"]) == ("200", 3, 20, True, 25)
    (tmp_path / "m.csv").write_text("label,elapsed\nhome,3\n")
    with pytest.raises(ValueError):
        read_load_test(spark, str(tmp_path / "m.csv"))


def test_headers_hold_back_early_rows(spark, tmp_path):
    from sensorframe.streaming.jobs import split_headers

    text = "2024-01-01 00:00:00,+0000,1,s,p,9,early\ndatetime,timezone,timestamp,system,source, b, a\n2024-01-01 00:00:01,+0000,2,s,p,1,x\n"
    write_text(tmp_path, "a.log", text)
    out = split_headers(read_lines(spark, str(tmp_path)), ["a", "b", "c"]).orderBy("timestamp").collect()
    assert [(r.timestamp, r.a, r.b, r.c) for r in out] == [("1", "early", "9", "(!)"), ("2", "x", "1", "(!)")]
    write_text(tmp_path, "b.log", "2024-01-01 00:00:00,+0000,1,s,p,9,early\n" * 3)
    with pytest.raises(PySparkException):
        split_headers(read_lines(spark, str(tmp_path)), ["a"]).collect()


def test_unlike_files_are_read_by_their_own_headers(spark, tmp_path):
    from sensorframe.sources.metric_csv import read_metric_csv

    head = "datetime,timezone,timestamp,system,source"
    row = lambda n, rest: f"2024-01-01 00:00:{n:02d},+0000,{n},s,p,{rest}\n"
    (tmp_path / "sub").mkdir()
    write_text(tmp_path, "a.log", f"{head},rx,tx\n{row(1, '1,2')}{head},rx,tx\n{row(2, ',')}")
    write_text(tmp_path, "b.log", f"{head}, tx, rx\n{row(3, '2,1')}\n2024-13-01,+0000,9,s,p,2,1\n")
    write_text(tmp_path, "c.log", f'{row(4, "1")}{head},tx,"x.y"\n{row(5, '"a,b",7')}{row(6, '"say ""hi""",8')}{row(7, "short")}')
    write_text(tmp_path / "sub", "d.log", row(8, "5,6"))
    with pytest.raises(PySparkException):
        read_metric_csv(spark, str(tmp_path)).collect()  # a file without a header
    got = read_metric_csv(spark, str(tmp_path), header=f"{head},rx,tx")
    assert got.columns == [*head.split(","), "rx", "tx", "x_y"]
    assert sorted((r.timestamp, r.rx, r.tx, r.x_y) for r in got.collect()) == [
        (1, "1", "2", None), (2, None, None, None), (3, "1", "2", None), (4, None, "1", None),
        (5, None, "a,b", "7"), (6, None, 'say "hi"', "8"), (7, None, "short", None), (8, "5", "6", None),
    ]
    some = read_metric_csv(spark, str(tmp_path), ["tx", "rx"], f"{head},rx,tx").orderBy("timestamp").collect()
    assert [(r.tx, r.rx) for r in some][2:5] == [("2", "1"), ("1", "(!)"), ("a,b", "(!)")]


def test_load_tests_in_different_orders(spark, tmp_path):
    from sensorframe.sources.load_test import read_load_test

    write_text(tmp_path, "l.csv", "label,allThreads,Latency,success,responseCode,elapsed,timeStamp\nhome,3,20,true,200,25,1700000000000\n")
    write_text(tmp_path, "m.csv", 'timeStamp,elapsed,label,responseCode,success,allThreads\n1700000001000,7,"a, b",500,false,4\n')
    got = sorted(tuple(r) for r in read_load_test(spark, str(tmp_path)).select("elapsed", "response_code", "success", "latency", "all_threads").collect())
    assert got == [(7, "500", False, None, 4), (25, "200", True, 20, 3)]


def test_scratch_follows_the_checkpoint_dir(spark):
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    assert isinstance(pd.DataFrame(), pd.DataFrame)
