import math

import duckdb
import numpy as np
import pytest

from quillspark.llm import hard_negatives
from quillspark.llm.queries import ORACLE_SQL, op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = []
    for k, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        kept.append((k, i, v, (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, i, v, label in kept:
        if i % 50:
            continue
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), j, other != label) for m, j, w, other in kept if m != k)
        for p, j in [(-s, j) for s, j, differs in scored if not differs][:5]:
            found = [(-s, n) for s, n, differs in scored if differs and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, schema=SCHEMA):
    got = hard_negatives.mined(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, size in (("ROW_BLOCK", 40), ("ANCHOR_SPAN", 100), ("CHUNK", 3)):
        monkeypatch.setattr(hard_negatives, name, size)


def test_query_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got, want = op12_hard_negatives(spark, sf), con.sql(ORACLE_SQL["op12_hard_negatives"])
    rows = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert rows == sorted(want.fetchall()) and len(rows) > 50


def test_blocks_and_groups_as_brute_force(spark, small_blocks):
    r = np.random.RandomState(1)
    centers = r.normal(size=(6, 12))
    rows = [(k, (centers[k % 6] * r.choice([0.01, 1, 3]) + r.normal(size=12) * 0.3).tolist(), int(k % 6 > r.randint(4))) for k in range(500)]
    rows += [(1000 + k, centers[0].tolist(), k % 2) for k in range(120)]  # copies of one vector
    want = brute(rows)
    assert mined(spark, rows) == want and len(want) > 50


def test_odd_rows(spark, small_blocks):
    good = [(k, [0.1 * (k % 7), 0.5, -0.25 * (k % 3)], k % 3) for k in range(160)]
    odd = [(None, [1.0, 1.0, 1.0], 1), (50, None, 1), (100, [1.0, None, 1.0], 1), (150, [1.0, float("nan"), 0.0], 1), (200, [float("inf"), 0.0, 0.0], 1), (250, [1.0, 1.0, 1.0], None)]
    odd += [(300, [], 1), (350, [0.0, 0.0, 0.0], 0), (400, [0.9], 2), (450, [0.1, 0.2, 0.3, 0.4, 0.5], 2), (50, [0.1, 0.2, 0.3], 1), (50, [0.1, 0.2, 0.3], 1), (-50, [0.3, 0.3, 0.3], -4), (-49, [0.3, 0.2, 0.3], -1)]
    want = brute(good + odd)
    assert mined(spark, good + odd) == want and want
    assert mined(spark, []) == [] and mined(spark, odd[:6]) == [] and mined(spark, [(50, [1.0], 1)]) == []


def test_scores_beyond_doubles_stay_whole(spark, small_blocks):
    r = np.random.RandomState(2)
    rows = [(k, [float(np.float32(x)) for x in r.normal(size=4) * 10.0 ** (k % 5)] if k % 9 else [3e37, 1.0, -2e37, 5.0], k % 3) for k in range(120)]
    want = brute(rows)
    assert mined(spark, rows) == want and want


def test_extra_columns_with_clashing_names(spark, small_blocks):
    rows = [(k, [0.1 * (k % 7), 0.5], k % 3, "x", 7) for k in range(120)]
    assert mined(spark, rows, SCHEMA + ", place string, score int") == brute([r[:3] for r in rows])


def test_bounds_hold_and_leave_pairs_out():
    r = np.random.RandomState(3)
    ints = np.floor(256 * np.concatenate([r.normal(size=(60, 8)) * 0.1 + c for c in r.normal(size=(4, 8)) * 2]))
    norm = np.linalg.norm(ints, axis=1)
    angles = np.arccos(np.clip(ints / norm[:, None] @ (ints[::60] / norm[::60, None]).T, -1, 1))
    block = object.__new__(hard_negatives.Block)
    block.place = block.id = np.arange(len(ints))
    block.label, block.norm, block.angles, block.ints = np.zeros(len(ints), int), norm, angles, ints
    low, high = hard_negatives.bounds(block, block)
    exact = ints @ ints.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low < 0.3 * norm[:, None] * norm).mean() > 0.5


def test_plan_has_no_cross_join(spark, small_blocks):
    rows = [(k, [0.1 * (k % 7), 0.5], k % 3) for k in range(120)]
    plan = hard_negatives.mined(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
