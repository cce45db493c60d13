"""Finished logs, one copy per consumer group."""

import os

import pytest

from sensorframe.operators import aggregates as A
from sensorframe.sinks import files as K


@pytest.fixture()
def logs(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = spark.range(0, 50).selectExpr("id", "timestamp_seconds(id * 600) AS ts", "if(id % 5 = 0, 'web', 'db_1') AS host")
    K.write_rotating_log(rows.repartition(3), path, rows["host"], "ts", 6 * 3600, max_rows=10, order=["ts"])
    return path


def content(root):
    return {f"{d}/{n}"[len(root) + 1 :]: open(f"{d}/{n}").read() for d, _, names in os.walk(root) for n in names if not n.endswith(".crc")}


def test_each_group_gets_each_file(spark, tmp_path, logs):
    out = str(tmp_path / "out")
    K.publish_groups(K.finished_logs(spark, logs), out, [2, 4])
    found = content(out)
    assert all(n.split("/")[0] == n.split("/")[1].rsplit("_", 1)[0] for n in found)
    of = {g: {n[:-2]: text for n, text in found.items() if n.endswith(f".{g}")} for g in (2, 4)}
    assert of[2] == of[4] and len(of[2]) * 2 == len(found)
    originals = sorted(text for n, text in content(logs).items() if n.endswith(".csv"))
    assert sorted(of[2].values()) == originals
    rows = A.backlog(A.list_files(spark, out)).orderBy("instance").collect()
    assert [(r.instance, r.backlog_group_1, r.backlog_group_2) for r in rows] == [
        (n, 0, sum(k.startswith(f"{n}/") for k in of[2])) for n in ("db_1", "web")
    ]


def test_a_repeated_call_changes_nothing_and_repairs_a_cut_copy(spark, tmp_path, logs):
    out = str(tmp_path / "out")
    K.publish_groups(K.finished_logs(spark, logs), out, [1])
    before = content(out)
    first, second = sorted(before)[:2]
    with open(f"{out}/{first}", "w") as cut:
        cut.write("half")
    times = os.stat(f"{out}/{second}").st_mtime_ns
    K.publish_groups(K.finished_logs(spark, logs), out, [1])
    assert content(out) == before and os.stat(f"{out}/{second}").st_mtime_ns == times


def test_groups_are_checked_and_other_files_left(spark, tmp_path, logs):
    with pytest.raises(ValueError):
        K.publish_groups(K.finished_logs(spark, logs), str(tmp_path / "out"), [0])
    other = tmp_path / "other"
    other.mkdir()
    (other / "notes.txt").write_text("x")
    assert K.finished_logs(spark, str(other)).count() == 0
