import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import temporal

LEFT, RIGHT = "id int, k string, at long", "k string, since long, tie int, what string"


def last_known(left, right):
    out = []
    for i, k, at in left:
        known = [r for r in right if k is not None and at is not None and r[0] == k and r[1] is not None and r[1] <= at]
        best = max(known, key=lambda r: (r[1], r[2])) if known else None
        out.append((i, k, at, best and best[2], best and best[3]))
    return sorted(out, key=str)


def in_force(spark, left, right):
    got = temporal.in_force(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(2), "k", "at", "since", "tie", ["tie", "what"])
    assert got.columns == ["id", "k", "at", "tie", "what"]
    return sorted(map(tuple, got.collect()), key=str)


def test_in_force_as_brute_force(spark):
    rnd = random.Random(1)
    left = [(i, rnd.choice([None, "a", "b", "c", "d"]), rnd.choice([None, *range(40)])) for i in range(300)]
    right = [(rnd.choice([None, "a", "b", "c", "e"]), rnd.choice([None, *range(5, 35)]), i, f"w{i}") for i in range(120)]
    assert in_force(spark, left, right) == last_known(left, right)
    assert in_force(spark, [], right) == [] and in_force(spark, left, []) == last_known(left, [])


@pytest.mark.parametrize("starts", [[-1], [700], [-1, 2500], []])
def test_a_hot_key_crosses_partitions(spark, starts):
    """Most rows of one key, and words that must pass over several partitions."""
    left = [(i, "hot", i) for i in range(3000)] + [(10_000 + i, f"k{i}", i) for i in range(50)]
    right = [("hot", s, n, f"w{s}") for n, s in enumerate(starts)] + [(f"k{i}", i, 0, "own") for i in range(0, 50, 2)]
    assert in_force(spark, left, right) == last_known(left, right)


def test_no_key_is_gathered(spark):
    left = spark.createDataFrame([(i, "hot", i) for i in range(4000)], LEFT)
    right = spark.createDataFrame([("hot", 5, 0, "w")], RIGHT)
    got = temporal.in_force(left, right, "k", "at", "since", "tie", ["what"])
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= 3 and max(sizes) < 2500 and got.where("what = 'w'").count() == 3995


def test_in_force_takes_times_and_nested_columns(spark):
    day = datetime(2024, 1, 1)
    left = spark.createDataFrame([(1, "a", day + timedelta(days=2), [1, 2])], "id int, k string, at timestamp, more array<int>")
    right = spark.createDataFrame([("a", day, 1, {"x": 1}), ("a", day + timedelta(days=3), 2, {"y": 1})], "k string, since timestamp, tie int, what map<string,int>")
    assert [tuple(r) for r in temporal.in_force(left, right, "k", "at", "since", "tie", ["what"]).collect()] == [(1, "a", day + timedelta(days=2), [1, 2], {"x": 1})]


def inside(points, periods):
    return sorted((p, q) for p, k, at in points for q, j, low, high in periods if None not in (k, j, at, low, high) and k == j and low <= at < high)


def within(spark, points, periods):
    p = spark.createDataFrame(points, "p int, k string, at long").repartition(3)
    q = spark.createDataFrame(periods, "q int, k string, low long, high long")
    return sorted(map(tuple, temporal.within(p, "at", q, "low", "high", ["k"]).select("p", "q").collect()))


def test_within_as_brute_force(spark):
    rnd = random.Random(2)
    points = [(i, rnd.choice("ab"), rnd.randint(-500, 500)) for i in range(300)] + [(900, None, 1), (901, "a", None)]
    periods = [(i, rnd.choice("ab"), a := rnd.randint(-520, 500), a + rnd.choice([-3, 0, 1, 2, 7, 60, 900])) for i in range(200)] + [(900, None, 0, 9), (901, "a", None, 9), (902, "b", 1, None)]
    want = inside(points, periods)
    assert within(spark, points, periods) == want and len(want) > 1000
    assert within(spark, points, []) == [] and within(spark, [], periods) == []
    assert within(spark, points[:3] * 2, periods) == sorted(inside(points[:3], periods) * 2)


def test_long_periods_dont_multiply_short_ones(spark):
    points = spark.createDataFrame([(i, "a", i * 1000) for i in range(1000)], "p int, k string, at long")
    periods = spark.createDataFrame([(i, "a", i * 1000, i * 1000 + 5) for i in range(1000)] + [(-1, "a", -(10**12), 10**12), (-2, "a", 0, 10**9)], "q int, k string, low long, high long")
    looked_up = temporal.within(points, "at", periods, "low", "high", ["k"])
    assert looked_up.count() == 3000
    plan = looked_up._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_a_period_is_three_rows_at_most(spark):
    rnd = random.Random(5)
    points = spark.createDataFrame([(1, "a", 50_000)], "p int, k string, at long")
    periods = spark.createDataFrame([(i, "a", low := rnd.randint(0, 10**5), low + 1000 + i) for i in range(1000)], "q int, k string, low long, high long")
    found = temporal.within(points, "at", periods, "low", "high", ["k"])
    found.collect()

    def made(plan):
        name = plan.nodeName()
        inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if name.endswith("QueryStage") else None
        own = plan.metrics().apply("numOutputRows").value() if name == "Generate" else 0
        return own + (made(inner) if inner is not None else sum(made(plan.children().apply(k)) for k in range(plan.children().size())))

    assert 1000 < made(found._jdf.queryExecution().executedPlan()) <= 3010
