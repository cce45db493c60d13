"""Saved SQL metrics as table functions."""

from datetime import datetime

import pytest

from sensorframe.sources.sql_metric import install_metric_function, metric_function_names, metric_table, rules

AT = datetime(2024, 1, 1, 10, 0, 30)


@pytest.fixture()
def instances(spark, tmp_path):
    rows = [
        (1, 7, "default/In!1", "a", datetime(2024, 1, 1, 9, 50)),
        (2, 7, "default/In!1", "a", datetime(2024, 1, 1, 9, 52)),
        (3, 7, "default/Out!1", "a", datetime(2024, 1, 1, 9, 58, 30)),
        (4, 8, "default/In!1", "b", datetime(2024, 1, 1, 9, 58, 10)),
        (5, 8, "default/Out!1", "b", datetime(2024, 1, 1, 9, 59, 0)),  # the minute is not over
        (6, 9, "default/Out!1", None, datetime(2024, 1, 1, 9, 58)),  # never started
    ]
    path = str(tmp_path / "instances")
    spark.createDataFrame(rows, "id LONG, ecid LONG, composite_dn STRING, title STRING, created TIMESTAMP_NTZ").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def faults(spark):
    rows = [
        (1, 4, 8, "JCA-12 and XML-3", datetime(2024, 1, 1, 9, 58, 20)),
        (2, 5, 8, "JCA-7", datetime(2024, 1, 1, 9, 58, 25)),
        (3, 6, 9, None, datetime(2024, 1, 1, 9, 58, 26)),
        (5, 4, 8, None, datetime(2024, 1, 1, 8, 58, 26)),
        (4, 1, 7, "XML-1", datetime(2024, 1, 1, 8, 0)),
    ]
    return spark.createDataFrame(rows, "fault_id LONG, composite_instance_id LONG, ecid LONG, error_message STRING, created TIMESTAMP_NTZ")



def flows():
    return rules(["flow", "first_dn", "last_dn"], [("F", "default/In%", "default/Out%"), ("G", "default/In%", "none")])


def test_flow_statistics_of_the_last_minute(spark, instances, faults):
    got = metric_table(spark, "flow_statistics", AT, {"minutes": 1, "flows": flows()}, {"instances": instances, "faults": faults})
    # Two starts and one end give two durations, 510 and 390 seconds; both faults of the start at 9:58 count in both flows.
    assert sorted(map(tuple, got.collect())) == [
        ("24-01-01 09:58", "F", 4, 2, 2, 390.0, 510.0, 450.0),
        ("24-01-01 09:58", "G", 2, 0, 2, None, None, None),
    ]


def test_the_point_in_time_reaches_the_scan(spark, instances, faults, capsys):
    got = metric_table(spark, "flow_statistics", AT, {"minutes": 1, "flows": flows()}, {"instances": instances, "faults": faults})
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(created,2024-01-01T09:58)" in plan and "LessThan(created,2024-01-01T09:59)" in plan


def test_error_taxonomy_reads_the_longest_message(spark, instances, faults):
    kinds = rules(["flow", "dn", "title"], [("IN", "default/In%", "b%")])
    got = metric_table(spark, "error_taxonomy", AT, {"minutes": 1, "flows": kinds}, {"instances": instances, "faults": faults})
    assert sorted(map(tuple, got.collect())) == [
        ("24-01-01 08:58", "IN", 2, "XML-3JCA-12"),
        ("24-01-01 09:58", "UNKNOWN - Out", 1, "UNKNOWN_ERROR"),
    ]


def test_functions_are_called_from_sql_and_empty_tables_give_no_rows(spark, instances, faults):
    install_metric_function(spark, "flow_statistics", {"instances": instances.limit(0), "faults": faults.limit(0)})
    call = "SELECT * FROM flow_statistics(TIMESTAMP_NTZ '2024-01-01 10:00:30', 1, array(named_struct('flow', 'F', 'first_dn', '%', 'last_dn', '%')))"
    assert spark.sql(call).count() == 0


def test_container_locks(spark):
    groups = spark.createDataFrame([(1, 3), (1, 1), (1, 0), (2, 0), (3, 1)], "container_id LONG, group_status LONG")
    leases = spark.createDataFrame([(1, 5), (4, 6), (2, 7)], "container_id LONG, renewal_time LONG")
    got = metric_table(spark, "container_locks", AT, tables={"message_groups": groups, "leases": leases})
    assert sorted((r.container_id or 0, r.error_groups, r.locked_groups) for r in got.collect()) == [(0, 0, 0), (1, 1, 1), (2, 0, 0), (3, 0, 1)]


def test_names(spark):
    assert metric_function_names() == ["chain_statistics", "container_locks", "error_taxonomy", "flow_statistics", "status_matrix"]
    with pytest.raises(KeyError):
        install_metric_function(spark, "nothing")
