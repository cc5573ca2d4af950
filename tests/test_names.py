import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evidence, names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_similar_as_all_pairs(spark, edits):
    rnd = random.Random(edits)
    some = {"", "a", "b", "aa", "ab", "aaaa", "aaaaa", "naïve name", "naive name", "x\x01y"}
    some |= {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) for _ in range(150)}
    some |= {"".join(rnd.choice("abcdefghij ") for _ in range(12)) + end for end in ("", "s", "es") for _ in range(3)}
    rows = [(x,) for x in some] * 2 + [(None,)]
    got = names.similar(spark.createDataFrame(rows, "n string").repartition(3), "n", edits)
    want = sorted((a, b, d) for a in some for b in some if a < b and (d := distance(a, b)) <= edits)
    assert sorted(map(tuple, got.collect())) == want and want
    assert names.similar(spark.createDataFrame([], "n string"), "n", edits).count() == 0


def test_a_common_gram_makes_few_candidates(spark):
    rows = [(f"Ministry of {a}{b}{c}{d}",) for a in "bcdfg" for b in "aeiou" for c in "klmnp" for d in ("rst", "vwx", "yzq")]
    plan = names.similar(spark.createDataFrame(rows, "n string"), "n", 1)
    assert plan.count() == sum(distance(a, b) <= 1 for (a,) in rows for (b,) in rows) // 2 - len(rows) // 2


def test_resolution_follows_chains(spark):
    rows = [(5, "Acme Ltd."), (3, "ACME  LTD"), (9, "acme ltt"), (2, "acmee ltt"), (7, "else"), (8, None), (11, " . "), (12, None)]
    got = names.resolved_alike(spark.createDataFrame(rows, "id int, n string"), "n", "id")
    assert {r.id: r.entity_id for r in got.collect()} == {5: 2, 3: 2, 9: 2, 2: 2, 7: 7, 8: 8, 11: 11, 12: 12}


def test_conflicts_are_as_many_as_values(spark):
    rows = spark.range(100_000).selectExpr("id", "'g' as g", "id % 3 as v").unionByName(spark.createDataFrame([(1, "one", 5), (2, "one", 5), (3, None, 1), (4, "two", None), (5, "two", 6)], "id long, g string, v long"))
    got = sorted(map(tuple, evidence.conflict_classes(rows, "id", ["g"], "v").collect()))
    assert got == [("g", 0, 33334, 0, 66666, 1), ("g", 1, 33333, 1, 66667, 0), ("g", 2, 33333, 2, 66667, 0)]


def test_classes_hold_all_pairs(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("abc"), rnd.randint(0, 3)) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, g string, v long")
    classes = evidence.conflict_classes(table, "id", ["g"], "v").collect()
    assert sum(r.n * r.rivals for r in classes) == 2 * evidence.conflicts(table, "id", ["g"], "v").count()
    for r in classes:
        assert r.against == min(i for i, g, v in rows if g == r.g and v != r.v)


def test_units_keep_digits(spark):
    from decimal import Decimal

    units = spark.createDataFrame([("nano", "0.000000001", "x"), ("kilo", "1000", "x"), ("pound", "0.45359237", "x"), ("back", "-2.5", "x")], "unit string, factor string, normalized_unit string").withColumn("factor", F.col("factor").cast("decimal(38,18)"))
    rows = [("5,000,000,000", "nano"), ("0.12345678", "kilo"), ("3", "pound"), ("-7", "back"), ("12345678901234.5", "kilo"), ("1234567890123456", "kilo"), ("x", "kilo"), ("1", "none"), (None, "kilo"), ("0.0000000001", "kilo")]
    got = {(r.v, r.u): r.normalized_value for r in evidence.normalized(spark.createDataFrame(rows, "v string, u string"), "v", "u", units).collect()}
    want = ["5", "123.45678", "1.36077711", "17.5", "12345678901234500", None, None, None, None, "0.0000001"]
    assert got == {r: w and Decimal(w) for r, w in zip(rows, want)}


def test_a_factor_too_small_is_no_zero(spark):
    units = spark.createDataFrame([("tiny", 1e-25, "x")], "unit string, factor double, normalized_unit string")
    with pytest.raises(Exception, match="too small"):
        evidence.normalized(spark.createDataFrame([("1", "tiny")], "v string, u string"), "v", "u", units).collect()


def joined(plan):
    """Rows that the joins of a plan made."""
    name = plan.nodeName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlan" else plan.plan() if name.endswith("QueryStage") else None
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name and "semi" not in plan.toString().split("\n")[0].lower() else 0
    return own + (joined(inner) if inner is not None else sum(joined(plan.children().apply(k)) for k in range(plan.children().size())))


def test_serial_numbers_are_looked_at_no_more_often_than_they_are_alike(spark):
    rows = [(f"Customer#{k:09}",) for k in range(2000)] + [(f"Customer#{k:08}",) for k in range(50)]
    found = names.similar(spark.createDataFrame(rows, "n string"), "n", 1)
    got = found.collect()
    serial = sum(1 for k in range(2000) for p in range(4) for v in range(k // 10**p % 10 + 1, 10) if k + (v - k // 10**p % 10) * 10**p < 2000)
    assert len(set(got)) == len(got) >= serial
    assert sorted((r.a, r.b, r.edits) for r in got if len(r.a) == len(r.b) == 18)[:2] == [("Customer#000000000", f"Customer#{v:09}", 1) for v in (1, 2)]
    assert joined(found._jdf.queryExecution().executedPlan()) == len(got)
