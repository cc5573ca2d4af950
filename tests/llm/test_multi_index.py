import math

import numpy as np
import pytest

from quillspark.llm import multi_index
from quillspark.llm.queries import op13_multi_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += float(np.float32(x)) * float(np.float32(y))
    return total


def brute(rows, every=20):
    kept = [(k, i, v) for k, (i, v, _) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for k, i, v in kept:
        if i % every == 0:
            found = sorted((-product(v, w), j) for m, j, w in kept if m != k)[:20]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def searched(spark, rows, schema=SCHEMA, **kw):
    got = multi_index.searched(spark.createDataFrame(rows, schema).repartition(3), **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in got.collect())


def recall(got, want):
    return len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len({(q, i) for q, _, i, _ in want})


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall_and_scores(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in table}
    got = [tuple(r) for r in op13_multi_index(spark, f"/root/testdata/{sf}").collect()]
    asks = [i for i in vectors if i % 20 == 0]
    assert len(got) == 20 * len(asks)
    ids = np.array(list(vectors))
    every = np.stack(list(vectors.values()))
    found = 0
    for q in asks:
        mine = sorted(r[1:] for r in got if r[0] == q)
        assert [r for r, _, _ in mine] == list(range(1, 21)) and [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 and i != q for _, i, s in mine)
        order = [i for i in ids[np.lexsort((ids, -(every @ vectors[q])))] if i != q][:20]
        found += len(set(order) & {i for _, i, _ in mine})
    assert found / len(got) >= 0.9


def test_all_cells_visited_give_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "ENTRY_BLOCK", 50)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 7)
    r = np.random.RandomState(1)
    rows = [(k, r.normal(size=9).tolist(), 0) for k in range(400)] + [(1000 + k, [0.5] * 9, 0) for k in range(130)]  # copies tie by id
    assert searched(spark, rows, share=1.1) == brute(rows)


def test_copies_dont_use_up_the_share(spark):
    r = np.random.RandomState(4)
    apart = r.normal(size=(1500, 16))
    rows = [(k, (apart[k] / np.linalg.norm(apart[k])).tolist(), 0) for k in range(1500)] + [(5000 + k, (apart[7] / np.linalg.norm(apart[7])).tolist(), 0) for k in range(750)]
    got, want = searched(spark, rows), brute(rows)
    assert recall([x for x in got if x[2] < 5000], [x for x in want if x[2] < 5000]) >= 0.9


def test_odd_rows(spark):
    r = np.random.RandomState(2)
    good = [(k, r.normal(size=3).tolist(), 0) for k in range(60)]
    odd = [(None, [1.0, 1.0, 1.0], 1), (100, None, 1), (120, [1.0, None], 1), (140, [float("nan"), 1.0], 1), (160, [1.0, float("-inf")], 1), (180, [0.0, 0.0], 1), (200, [], 1), (-20, [1.0], None), (40, [0.3, 0.1, 0.2, 0.9], 1), (40, [0.3, 0.1, 0.2, 0.9], 1)]
    assert searched(spark, good + odd, share=1.1) == brute(good + odd)
    assert searched(spark, []) == [] and searched(spark, odd[:7]) == [] and searched(spark, [(20, [1.0], 0)]) == []
    assert searched(spark, [(20, [1.0, 2.0], 0), (21, [3.0, 4.0], 0)]) == [(20, 1, 21, 11.0)]


def test_extra_columns_with_clashing_names(spark):
    rows = [(k, [0.1 * (k % 7), 0.5], k % 3, "x", 7) for k in range(90)]
    assert searched(spark, rows, SCHEMA + ", place string, score int", share=1.1) == brute([r[:3] for r in rows])


def test_cells_come_by_summed_distance():
    r = np.random.RandomState(3)
    near, far, weights = r.normal(size=9), r.normal(size=7), r.randint(0, 5, size=(9, 7)).astype(float)
    order = sorted((near[i] + far[j], i, j) for i in range(9) for j in range(7))
    for goal in (1, 20, 60, weights.sum()):
        have, want = 0.0, set()
        for _, i, j in order:
            if have >= goal:
                break
            want.add((i, j))
            have += weights[i, j]
        assert set(zip(*np.nonzero(multi_index.visited(near, far, weights, goal)))) == want
