import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import quality_gam as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = q.learnt(docs, labels)
    got = q.scored(docs, model, ["doc_id"]).join(labels, "doc_id").select("doc_id", "score", "predicted", "quality", q.held_out(F.col("doc_id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    out = [r for r in got if r.out]
    assert len(out) > 40 and np.mean([r.predicted == r.quality for r in out]) >= 0.97
    assert model.pairs and all(np.isfinite(t).all() for t in model.tables + model.pair_tables)


def test_labels_of_held_out_rows_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = q.learnt(docs, labels), q.learnt(docs, turned)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables + a.pair_tables, b.tables + b.pair_tables))


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = q.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.9


def test_fit_does_not_hang_on_row_order():
    rng = np.random.default_rng(2)
    x, order = rng.random((500, 4)), rng.permutation(500)
    y = (x[:, 0] > 0.3).astype(float)
    a, b = q.fit(x, y), q.fit(x[order], y[order])
    assert all(np.allclose(s, t) for s, t in zip(a.tables, b.tables))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a", 9.0), (2, "", "b", 9.0), (None, "x " * 50_000, "c", 9.0), (1, None, "a", 9.0)], "doc_id long, text string, y string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = q.learnt(docs, none)
    got = q.scored(docs, model, ["doc_id", "y", "score"]).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    one = q.learnt(docs, spark.createDataFrame([(2, 1), (2, None), (2, 0), (1, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in q.scored(docs, one, ["doc_id"]).collect())
    assert q.accepted(docs, model).columns == docs.columns and q.accepted(docs.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(400).select("id", F.lit("text of it").alias("text")).withColumnRenamed("id", "doc_id")
    docs = docs.unionAll(docs)  # repeated ids
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert abs(q.learnt(docs, labels, 10).base) < 3


def test_empty_text_features():
    assert len(q.features("")) == len(q.FEATURES) and all(np.isfinite(q.features("")))


def plain_split(rows, a, b):
    """rows: (bin, g, h). The cut of bins a to b with the greatest gain."""
    best = (1e-9, None)
    total = [sum(r[k] for r in rows if a <= r[0] < b) for k in (1, 2)]
    for cut in range(a + 1, b):
        left, right = [[r for r in rows if lo <= r[0] < hi] for lo, hi in ((a, cut), (cut, b))]
        if min(len(left), len(right)) < q.LEAST_LEAF:
            continue
        gain = sum(sum(r[1] for r in x) ** 2 / (sum(r[2] for r in x) + q.SHRINK) for x in (left, right)) - total[0] ** 2 / (total[1] + q.SHRINK)
        if gain > best[0] + 1e-12:
            best = (gain, cut)
    return best


def plain_tree(rows, bins, leaves):
    parts = [(0, bins)]
    while len(parts) < leaves:
        found = [(*plain_split(rows, a, b), a, b) for a, b in parts]
        found = [x for x in found if x[1] is not None]
        if not found:
            break
        _, cut, a, b = max(found, key=lambda x: (x[0], x[2]))
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    out = {}
    for a, b in parts:
        inside = [r for r in rows if a <= r[0] < b]
        for k in range(a, b):
            out[k] = sum(r[1] for r in inside) / (sum(r[2] for r in inside) + q.SHRINK)
    return out


def test_boosting_as_written_out(monkeypatch):
    """Cyclic rounds over each feature's bins, row by row, and the score as a sum of the looked-up values."""
    import math

    monkeypatch.setattr(q, "ROUNDS", 3)
    monkeypatch.setattr(q, "PAIRS", 0)
    monkeypatch.setattr(q, "BINS", 6)
    monkeypatch.setattr(q, "LEAST_LEAF", 4)
    rng = np.random.default_rng(5)
    x = rng.random((120, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 2] < 0.8)).astype(float)
    model = q.fit(x, y)
    share = (sum(y) + 1) / (len(y) + 2)
    total = [math.log(share / (1 - share))] * len(y)
    tables = [{} for _ in range(3)]
    bins = [[sum(e <= v for e in model.edges[f]) for v in x[:, f]] for f in range(3)]
    for _ in range(3):
        for f in range(3):
            p = [1 / (1 + math.exp(-t)) for t in total]
            step = plain_tree([(b, yy - pp, pp * (1 - pp)) for b, yy, pp in zip(bins[f], y, p)], len(model.edges[f]) + 1, 3)
            for k, v in step.items():
                tables[f][k] = tables[f].get(k, 0.0) + q.RATE * v
            total = [t + q.RATE * step[b] for t, b in zip(total, bins[f])]
    for f in range(3):
        assert np.allclose(model.tables[f], [tables[f][k] for k in range(len(model.tables[f]))])
    assert np.allclose(model.score(x), [1 / (1 + math.exp(-t)) for t in total])


def test_pair_table_as_written_out():
    """One cut along one axis, and one of each side along the other, by trying both axes."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        g, h, n = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.5, np.full((4, 5), 30)
        best = None
        for flip in (False, True):
            gg, hh = (a.T if flip else a for a in (g, h))
            # n only matters against LEAST_LEAF, which 30 rows a cell pass
            rows = [(i, gg[i, j], hh[i, j]) for i in range(gg.shape[0]) for j in range(gg.shape[1])]
            gains = {c: sum(sum(r[1] for r in s) ** 2 / (sum(r[2] for r in s) + q.SHRINK) for s in ([r for r in rows if r[0] < c], [r for r in rows if r[0] >= c])) for c in range(1, gg.shape[0])}
            cut = max(gains, key=lambda c: (gains[c], -c))
            out = np.zeros_like(gg)
            for a, b in ((0, cut), (cut, gg.shape[0])):
                columns = [(gg[a:b, j].sum(), hh[a:b, j].sum()) for j in range(gg.shape[1])]
                value = lambda part: sum(c[0] for c in part) / (sum(c[1] for c in part) + q.SHRINK)
                inner = {c: sum(sum(x[0] for x in s) ** 2 / (sum(x[1] for x in s) + q.SHRINK) for s in (columns[:c], columns[c:])) for c in range(1, len(columns))}
                c = max(inner, key=lambda c: (inner[c], -c))
                whole = sum(x[0] for x in columns) ** 2 / (sum(x[1] for x in columns) + q.SHRINK)
                c = c if inner[c] - whole > 1e-9 else len(columns)  # a cut must gain something
                out[a:b, :c], out[a:b, c:] = value(columns[:c]), value(columns[c:])
            gain = (out * gg).sum() - 0.5 * (out**2 * hh).sum()
            if best is None or gain > best[0]:
                best = (gain, out.T if flip else out)
        assert np.allclose(q.pair_tree(g, h, n), best[1])
