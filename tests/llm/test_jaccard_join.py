import random
import re
from collections import defaultdict

import pytest

from quillspark.llm import jaccard_join as j
from quillspark.llm.components import components


def shingles(text):
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                up[top(a)] = top(b)
    least = defaultdict(lambda: float("inf"))
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least[top(k)], i)
    return sorted((str(i), len(sets[k]), str(i if i is None or not sets[k] else least[top(k)])) for k, (i, _) in enumerate(rows))


def corpus():
    rnd = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  b\n"), (6, "x"), (7, "x y z w v"), (8, "x y z w v"), (None, "x y z w v"), (9, "a b c d"), (8, "x y z w v"), (8, "other words stand here now")]
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(120)]
    for k in range(90):  # a cloud of near copies, some beyond the limit
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(120)] = f"n{rnd.random()}"
        rows.append((100 + k, " ".join(words)))
    hot = [f"h{i}" for i in range(40)]  # a passage that many unlike texts share
    rows += [(300 + k, " ".join([f"u{k}_{i}" for i in range(30 + k)] + hot)) for k in range(60)]
    chain = [f"c{i}" for i in range(400)]  # links only from one to the next
    rows += [(500 + k, " ".join(chain[k * 9 : k * 9 + 100])) for k in range(20)]
    for n in (5, 6, 9, 14, 25):  # about the limit, at small sizes
        words = [f"s{n}_{i}" for i in range(n + 4)]
        rows += [(700 + n * 10 + d, " ".join(words[d:] + [f"t{n}_{d}_{i}" for i in range(d)])) for d in range(4)]
    rows.append((900, "long " * 30_000))
    return rows


@pytest.mark.parametrize("hot", [j.HOT, 15], ids=["usual", "salted"])
def test_as_brute_force(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in j.linked(docs, hot).collect())
    assert got == brute(rows)


def test_as_brute_force_through_all_levels_of_the_tree(spark, monkeypatch):
    for name, value in (("LEAF", 3), ("FAN", 2), ("SMALL", 2)):
        monkeypatch.setattr(j, name, value)
    rows = corpus()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in j.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == brute(rows)


def test_the_tree_meets_each_pair_once(spark, monkeypatch):
    """Against all pairs of points of different components."""
    monkeypatch.setattr(j, "LEAF", 5)
    monkeypatch.setattr(j, "FAN", 2)
    rnd = random.Random(7)
    base, points, members = [rnd.getrandbits(64) for _ in range(200)], [], []
    import numpy as np

    for k in range(120):
        s = np.array(sorted({x for x in base if rnd.random() > k / 900} | {rnd.getrandbits(64) for _ in range(rnd.randint(0, 20))}), np.uint64)
        fine = j._fine(s)
        points.append((k, k, len(s), fine.reshape(j.GROUPS, -1).sum(1).tolist(), bytes(np.minimum(fine, 255).astype(np.uint8).tobytes())))
        members.append((k % 2, k, len(s), 0 if k < 60 else k))
    want = sorted((a[0], b[0]) for a in points for b in points if a[0] < b[0] and members[a[0]][0] == members[b[0]][0] and members[a[0]][3] != members[b[0]][3] and min(a[2], b[2]) * 5 >= 4 * max(a[2], b[2]) and 9 * j._least_minima(a[4], b[4]) >= 4 * (a[2] + b[2]))
    got = j._tree_met(spark.createDataFrame(members, "bucket long, key long, n long, component long"), spark.createDataFrame(points, "key long, doc_id long, n long, point array<int>, fine binary"))
    assert want and sorted(map(tuple, got.collect())) == want


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, k, "s") for k, (i, t) in enumerate(rows)], "doc_id long, text string, key long, shingles string")
    kept = j.deduplicated(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute(rows) if i == c or i == "None"}
    got = [str(r.doc_id) for r in kept.collect()]
    assert set(got) == want and len(got) == len(set(got))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert j.linked(none).collect() == [] and j.deduplicated(none).collect() == []


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {x: top(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0




def test_fine_points_bound_the_shared(spark):
    import numpy as np

    rnd = random.Random(4)
    for _ in range(300):
        a = {rnd.getrandbits(64) for _ in range(rnd.randint(1, 900))}
        b = {x for x in a if rnd.random() > 0.2} | {rnd.getrandbits(64) for _ in range(rnd.randint(1, 300))}
        x, y = (np.minimum(j._fine(np.array(sorted(s), np.uint64)), 255).astype(np.uint8).tobytes() for s in (a, b))
        assert j._least_minima(x, y) == j._least_minima(y, x) >= len(a & b)
    assert j._least_minima(bytes([255] + [0] * 31), bytes([1] * 32)) > 1 << 40


def test_a_row_without_id_before_its_copy_hides_no_links(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(None, " ".join(words)), (1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, "something else of more than five words")]
    got = {r.doc_id: r.component_id for r in j.linked(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {None: None, 1: 1, 2: 1, 3: 3}
