"""Streams: restart, cleaning of delivered files, delivery rules, row hooks."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from sensorframe.operators import aggregates as A
from sensorframe.plans.storage import scratch_dir
from sensorframe.sinks.delivery import BatchedSink, WriterRegistry, default_writers, send
from sensorframe.sinks.state import StateTable
from sensorframe.sources.metric_csv import in_metric_rows, read_stream_of_one_header, scan_daily_logs, stream_metric_files, text_schema
from sensorframe.streaming import jobs as B, stateful as Z

HEADER = "datetime,timezone,timestamp,system,source,device,v"


def log(root, name, rows):
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/{name}", "w") as out:
        out.write(HEADER + "\n" + "".join(f"2024-01-01 00:00:{t:02d},+0000,{t},s,p,{d},{v}\n" for t, d, v in rows))


def test_files_are_removed_after_delivery(spark, tmp_path):
    root, out, at = (str(tmp_path / n) for n in ("in", "out", "cp"))
    # A file is cleaned up once the following batch has been planned, so feed a few.
    for n in range(3):
        log(f"{root}/host{n}", f"a_{n}.log", [(n, "eth0", n)])
        source = stream_metric_files(spark, root, "a_*.log", 1, clean="delete")
        B.run_available(source, in_metric_rows(["v"], B.to_parquet(out)), at)
    rows = spark.read.parquet(out)
    assert sorted((r.instance, r.v) for r in rows.collect()) == [("host0", "0"), ("host1", "1"), ("host2", "2")]
    assert not os.path.exists(f"{root}/host0/a_0.log")


def test_restart_continues_with_the_stored_state(spark, tmp_path):
    root, out, at = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = text_schema(HEADER)
    for n, rows in enumerate([[(1, "a", 10), (2, "a", 25)], [(4, "a", 24), (5, "b", 7)]]):
        log(root, f"{n}.log", rows)
        source = read_stream_of_one_header(spark, root, schema).drop("instance")
        source = source.withColumn("timestamp", F.col("timestamp").cast("long"))
        B.run_available(Z.stream_dvdt(source, ["device"], "timestamp", ["v"], ["timestamp"]), B.to_parquet(out), at)
    got = sorted((r.device, r.timestamp, r.v) for r in spark.read.parquet(out).collect())
    # 24 - 25 over two seconds rounds down to -1.
    assert got == [("a", 2, 15), ("a", 4, -1)]


def test_state_table_repeats_a_batch(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), ["k"], ["ts"])
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k STRING, ts LONG, v STRING")
    second = spark.createDataFrame([("a", 3, "z"), ("b", 0, "old")], "k STRING, ts LONG, v STRING")
    table.upsert(first, 0)
    table.upsert(second, 1)
    table.upsert(second, 1)
    assert sorted(tuple(r) for r in table.read().collect()) == [("a", 3, "z"), ("b", 1, "y")]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = StateTable(spark, path, ["k"], ["ts"], depth=2)
    rows = [(f"k{k}", t, f"{k} {t}") for k in range(60) for t in range(3)]
    table.upsert(spark.createDataFrame(rows, "k STRING, ts LONG, v STRING"), 0)

    def files():
        return {f"{d}/{n}" for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}

    before = files()
    one = spark.createDataFrame([("k7", 9, "new")], "k STRING, ts LONG, v STRING")
    for _ in range(2):  # also when the batch is repeated
        table.upsert(one, 1)
        changed = {f.split("_bucket=")[1].split("/")[0] for f in files() ^ before}
        assert len(changed) == 1
        got = {(r.k, r.ts) for r in table.read().collect()}
        assert got == {(f"k{k}", t) for k in range(60) for t in (1, 2)} - {("k7", 1)} | {("k7", 9)}
        assert {(r.k, r.ts) for r in table.before(1, one).collect()} == {(f"k{k}", t) for k in range(60) for t in (1, 2)}
    table.upsert(one.limit(0), 2)
    assert table.read().count() == 120


def test_unfinished_replacement_is_repeated(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), ["k"], ["ts"])
    schema = "k STRING, ts LONG"
    table.upsert(spark.createDataFrame([("a", 1), ("b", 1)], schema), 0)
    replace, table._replace = table._replace, lambda pending: None  # the run ends before the table changes
    table.upsert(spark.createDataFrame([("a", 2)], schema), 1)
    table._replace = replace
    table.upsert(spark.createDataFrame([("b", 3)], schema), 2)
    assert sorted(map(tuple, table.read().collect())) == [("a", 2), ("b", 3)]


def test_refused_rows_become_dead_letters(spark, tmp_path):
    sent = str(tmp_path / "sent")
    os.makedirs(sent)

    def receiver(rows, token):
        if any(r.id % 10 == 3 for r in rows):
            raise ValueError("refused")
        with open(f"{sent}/{'-'.join(map(str, token))}", "a") as out:
            out.writelines(f"{r.id}\n" for r in rows)

    sink = BatchedSink(receiver, max_rows=2, dead_letters=str(tmp_path / "dead"))
    batch = spark.range(0, 40, 1, 3)
    for _ in range(2):  # a repeated batch sends nothing again
        sink(batch, 4)
    arrived = [int(x) for f in os.listdir(sent) for x in open(f"{sent}/{f}")]
    refused = [r.id for r in sink.refused(spark).collect()]
    assert sorted(arrived + refused) == list(range(40)) and {3, 13, 23, 33} <= set(refused) and sink.discarded.value == len(refused)


def test_send_retries_connection_errors_and_discards_others():
    calls = []

    def flaky(rows, token):
        calls.append(token)
        if len(calls) < 3:
            raise ConnectionError

    assert send(flaky, [1], (0, 0, 0), retries=5, wait_s=0) is False and len(calls) == 3
    assert send(lambda r, t: 1 / 0, [1], (0, 0, 0), retries=5, wait_s=0) is True

    def down(rows, token):
        raise TimeoutError

    with pytest.raises(TimeoutError):
        send(down, [1], (0, 0, 0), retries=2, wait_s=0)


def test_writer_registry():
    registry = default_writers()
    assert registry.names() == ["batched", "points"]
    with pytest.raises(KeyError):
        WriterRegistry().create("nothing", {})


@pytest.mark.parametrize(("mode", "expected"), [("row", 5), ("trigger", 5), ("pipe", 5)])
def test_row_hook(spark, mode, expected):
    seen = spark.sparkContext.accumulator(0)
    passed = []
    actions = {
        "row": lambda row: seen.add(1),
        "trigger": lambda: seen.add(1),
        "pipe": lambda rows: seen.add(len(list(rows))),
    }
    B.for_each(actions[mode], mode, passed_on=lambda b, n: passed.append(b.count()))(spark.range(5), 0)
    B.for_each(actions[mode], mode, silent=True, passed_on=lambda b, n: passed.append(b.count()))(spark.range(0), 1)
    assert seen.value == expected and passed == [5]
    with pytest.raises(ValueError):
        B.for_each(print, "other")


def test_age_policy(spark):
    now = int(datetime.datetime.now().timestamp())
    df = spark.createDataFrame([(now - 5,), (now - 5000,)], "ts LONG")
    assert Z.late_policy(df, "age", "ts", max_age_s=300).count() == 1
    with pytest.raises(ValueError):
        Z.late_policy(df, "other", "ts")


def test_daily_scan_prunes_and_skips_other_headers(spark, tmp_path):
    root = str(tmp_path)
    log(f"{root}/2024-01-01", "2024-01-01-000000_vmstat.log", [(1, "a", 1), (50, "a", 2)])
    log(f"{root}/2024-01-02", "2024-01-02-000000_vmstat.log", [(1, "a", 3)])
    log(f"{root}/2024-01-01", "2024-01-01-000030_other.log", [(1, "a", 9)])
    with open(f"{root}/2024-01-01/2024-01-01-000010_vmstat2.log", "w") as out:
        out.write("datetime,timezone,timestamp,system,source,x\n2024-01-01 00:00:20,+0000,20,s,p,5\n")
    t = datetime.datetime
    got = scan_daily_logs(spark, root, "vmstat", t(2024, 1, 1), t(2024, 1, 1, 0, 0, 40))
    assert [(r.datetime, r.v) for r in got.collect()] == [("2024-01-01 00:00:01", "1")]


def test_backlog_of_files(spark, tmp_path):
    folder = tmp_path / "dms"
    folder.mkdir()
    for name, text in {"dms_2024-01-01.log.1": "x", "dms_2024-01-02.log.1": "x", "dms_2024-01-02.log.3": "x", "dms.error.out": "oops", "other.txt": "x"}.items():
        (folder / name).write_text(text)
    row = A.backlog(A.list_files(spark, str(tmp_path))).first()
    assert (row.instance, row.backlog_group_1, row.backlog_group_3, row.backlog_total, row.errorlog_size) == ("dms", 2, 1, 3, 4)
    assert row.errorlog_time is not None


def test_scratch_is_new_each_time(spark):
    assert scratch_dir(spark, "a") != scratch_dir(spark, "a")
