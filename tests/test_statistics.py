import datetime
import itertools
import random
import statistics as plain
import tempfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import statistics as s

SCHEMA = "day date, kind string, v int, who long"
QUANTILES = {"low": 0.1, "mid": 0.5, "high": 0.9}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    days = [datetime.date(2024, m, d) for m in (1, 2) for d in range(1, 6)]
    return [(rnd.choice(days), rnd.choices(["hot", "b", None], [8, 3, 1])[0], rnd.choice([None, rnd.randint(-9, 9), rnd.randint(0, 10**6)]), rnd.randint(0, 4000)) for _ in range(30_000)]


def of(group):
    values = [r[2] for r in group if r[2] is not None]
    return (len(group), len(values), sum(values) if values else None, min(values, default=None), max(values, default=None))


def close(row, group):
    """Estimates within four times their stated errors."""
    values = sorted(r[2] for r in group if r[2] is not None)
    assert abs(row.distinct - (n := len({r[3] for r in group}))) <= max(1, 0.065 * n)
    for c, q in QUANTILES.items():
        below, upto = sum(x < row[c] for x in values), sum(x <= row[c] for x in values)
        assert below - 0.03 * len(values) - 1 <= q * len(values) <= upto + 0.03 * len(values) + 1


def test_cube_of_daily_states_as_the_rows_themselves(spark, rows):
    daily = s.states(spark.createDataFrame(rows, SCHEMA).repartition(5), ["day", "kind"], "v", "who")
    got = s.measures(s.merged(daily, ["day", "kind"], "cube"), QUANTILES).collect()
    want = {}
    for r, day, kind in itertools.product(rows, (0, 1), (0, 1)):
        want.setdefault((None if day else r[0], None if kind else r[1], 2 * day + kind), []).append(r)
    assert len(got) == len(want)
    for r in got:
        group = want[r.day, r.kind, r.level]
        assert (r.rows, r.n, r.total, r.least, r.greatest) == of(group)
        assert r.mean == pytest.approx(plain.fmean(x[2] for x in group if x[2] is not None))
        close(r, group)


def test_days_are_stored_replaced_and_merged_upward(spark, rows):
    path = tempfile.mkdtemp(prefix="states-") + "/days"
    df = spark.createDataFrame(rows, SCHEMA)
    store = lambda x: s.store_days(x, path, "day", ["kind"], "v", "who")
    store(df.where("day < '2024-02-03'"))
    store(df.where("day >= '2024-02-02'").withColumn("v", F.lit(1)))  # wrong, and then put right by a second run of the same days
    store(df.where("day >= '2024-02-02'"))
    months = s.merged(s.stored(spark, path).withColumn("month", F.month("day")), ["month", "kind"], "rollup")
    got = {(r.month, r.kind, r.level): r for r in s.measures(months, QUANTILES).collect()}
    assert len(got) == 6 + 2 + 1
    for (month, kind, level), r in got.items():
        group = [x for x in rows if level == 3 or x[0].month == month and (level or x[1] == kind)]
        assert (r.rows, r.n, r.total, r.least, r.greatest) == of(group)
        close(r, group)


def test_groups_without_values_empty_tables_and_large_totals(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, 3), ("b", 2**62, 1), ("b", 2**62, 1), ("b", 2**62, None)], "k string, v long, who long")
    got = {r.k: r for r in s.measures(s.merged(s.states(df, ["k"], "v", "who"), ["k"]), QUANTILES).collect()}
    assert tuple(got["a"]) == ("a", 2, 0, None, None, None, None, 1, None, None, None)
    assert (got["b"].n, got["b"].total, got["b"].distinct, got["b"].mid) == (3, 3 * 2**62, 1, float(2**62))
    assert s.merged(s.states(df.limit(0), ["k"], "v", "who"), ["k"], "cube").where("level = 0").count() == 0


def test_doubles_with_nan_and_decimals(spark):
    df = spark.sql("select * from values (1, double('NaN'), 1.25), (1, 2.0D, 2.50), (1, 3.0D, null) t(k, v, d)")
    r = s.measures(s.states(df, ["k"], "v", "k"), {"mid": 0.5}).first()
    assert r.n == 3 and r.greatest != r.greatest and r.mid in (2.0, 3.0)
    r = s.measures(s.states(df, ["k"], "d", "k"), {"mid": 0.5}).first()
    assert str(r.total) == "3.75" and r.n == 2


def test_states_are_combined_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = s.states(df, ["k"], "id", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_kll") >= 1 and plan.count("Exchange") == 1
