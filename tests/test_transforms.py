"""Named transforms with window steps between projections."""

import pytest

from sensorframe.functions.transforms import default_transforms


@pytest.fixture()
def rows(spark):
    data = [(1, "a", 10, 0.0), (2, "a", 25, 1.0), (3, "b", 7, 2.0), (4, "a", 24, 3.0), (3, "a", 99, 4.0), (9, "b", 9, 5.0)]
    return spark.createDataFrame(data, "t LONG, dev STRING, v LONG, _argument0 DOUBLE")


def test_steps_see_earlier_results_and_feed_later_ones(rows):
    steps = ["key = concat(dev, '(,')", "d = difference_positive(t, concat(key, ')'), v * 2)", "d2 = d + 1", "d3 = difference_positive(t, dev, d)"]
    out = default_transforms().run(rows, steps, ["_argument0"])
    assert out.columns == ["t", "dev", "v", "_argument0", "key", "d", "d2", "d3"]
    got = {int(r._argument0): (r.d, r.d2, r.d3) for r in out.collect()}
    # The fourth row of "a" is older than the third: 0, and later rows do not see it. Resets give 0.
    assert got == {0: (0, 1, 0), 1: (30, 31, 30), 2: (0, 1, 0), 3: (0, 1, 0), 4: (0, 1, 0), 5: (4, 5, 4)}


def test_a_result_replaces_its_column(rows):
    out = default_transforms().run(rows, ["v = difference_positive(t, dev, v)"], ["_argument0"])
    assert [r.v for r in out.orderBy("_argument0").collect()] == [0, 15, 0, 0, 0, 2]


def test_own_steps(rows, spark):
    registry = default_transforms()
    registry.stateful("seen", 1, lambda df, given, order, out: df.selectExpr("*", f"count(*) OVER (PARTITION BY {given[0]} ORDER BY {order[0]}) AS {out}"))
    out = registry.run(rows, ["n = seen(dev)"], ["_argument0"])
    assert [r.n for r in out.orderBy("_argument0").collect()] == [1, 2, 1, 3, 4, 2]
    assert registry.names() == ["difference_positive", "seen"]
    assert registry.run(rows.limit(0), ["n = seen(dev)"], ["_argument0"]).count() == 0


def test_an_argument_twice(rows):
    out = default_transforms().run(rows, ["d = difference_positive(t, dev, t)"], ["_argument0"])
    assert [r.d for r in out.orderBy("_argument0").collect()] == [0, 1, 0, 2, 0, 6]


@pytest.mark.parametrize("steps", [["d = difference_positive(t, dev)"], ["d = 1 + difference_positive(t, dev, v)"], ["no assignment"]])
def test_refused(rows, steps):
    with pytest.raises(Exception):
        default_transforms().run(rows, steps, ["_argument0"]).collect()
    with pytest.raises(ValueError):
        default_transforms().run(rows, ["d = difference_positive(t, dev, v)"])
