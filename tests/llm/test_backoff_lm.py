import math
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import backoff_lm as b

ROWS = [(1, None), (2, ""), (3, "the"), (4, "A a a a b a a"), (4, "A a a a b a a"), (5, "the cat sat on the mat"), (6, "The cat sat on the hat"), (7, "\x1c odd\x85 spaces here"), (None, "the cat is on the mat"), (8, "rare words only once " * 3), (9, "x " * 3000)]


def brute(rows, order):
    words = [(i, (t or "").lower().encode().split()) for i, t in rows]

    def grams(w):
        return Counter(tuple(w[k - n + 1 : k + 1]) for n in range(1, order + 1) for k in range(n - 1, len(w)))

    everything = sum((grams(w) for _, w in words), Counter())
    total, out = sum(len(w) for _, w in words), []
    for i, w in words:
        own, rest = grams(w), total - len(w)

        def count(g):
            return everything[g] - own[g]

        def score(g):
            if len(g) == 1:
                return count(g) / rest if count(g) > 0 else 0.4 / (rest + 1)
            return count(g) / count(g[:-1]) if count(g) > 0 else 0.4 * score(g[1:])

        out.append((str(i), len(w), sum(math.log(score(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("sizes", [(b.BLOCK_CHARS, b.PART_CHARS, 8, 256), (700, 900, 8, 256), (20, 150, 2, 3)], ids=["one block", "many", "levels"])
def test_as_brute_force(spark, monkeypatch, order, sizes):
    *sizes, fan_bits, fan = sizes
    monkeypatch.setattr(b, "FAN_BITS", fan_bits)
    monkeypatch.setattr(b, "FAN", fan)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in ROWS], "doc_id long, text string, block string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_tokens, r.log_score, r.mean_log_score) for r in b.scored(docs, order, *sizes).collect())
    want = brute(ROWS, order)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for g, w in zip(got, want):
        assert math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9)
        assert (g[3] is None) if not g[1] else math.isclose(g[3], w[2] / w[1], rel_tol=1e-9)


def test_empty_table(spark):
    assert b.scored(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_text_is_no_evidence_for_itself(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two three four")], "doc_id long, text string")
    for r in b.scored(docs).collect():
        assert r.log_score < 4 * math.log(0.4 / 5) + 1e-9


def test_the_corpus_is_shuffled_once(spark):
    plan = b.scored(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan.write.format("noop").mode("overwrite").save()
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def test_hashes_that_agree_in_40_bits_are_apart():
    keys = np.sort(np.array([5 << 40, (5 << 40) + (1 << 18), 7 << 50], np.uint64))
    assert len(np.unique(b._kept(keys, 0, b.KEPT_BITS))) == 3


def test_runs_grow_with_the_blocks(spark, monkeypatch):
    """Twice the blocks and twice the partitions make twice the runs at each level."""
    monkeypatch.setattr(b, "FAN_BITS", 2)
    monkeypatch.setattr(b, "FAN", 4)
    n_rows = []
    for n in (64, 128):
        docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + i * i) % 997}" for i in range(40))) for k in range(n)], "doc_id long, text string").repartition(4)
        runs = b._runs(b._blocks(docs, 150), 3, 2, 56)
        n_rows.append(runs.count())
    assert n_rows[1] <= 2.2 * n_rows[0] <= 2.2 * 64 * 3 * 4


def test_a_block_with_other_rows_is_an_error():
    with pytest.raises(RuntimeError, match="another order"):
        b._whole([b._packed(np.array([1, 2]))], 3)
