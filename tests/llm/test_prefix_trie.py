import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np

from quillspark.llm import prefix_trie
from quillspark.llm.queries import ORACLE_SQL, op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(((m[0], len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items()), key=str)


def trie(spark, rows, schema=SCHEMA, parts=3):
    got = prefix_trie.nodes(spark.createDataFrame(rows, schema).repartition(parts))
    assert got.columns == COLUMNS
    return sorted(map(tuple, got.collect()), key=str)


def test_query_as_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    got, want = op11_prefix_trie(spark, sf), con.sql(ORACLE_SQL["op11_prefix_trie"])
    assert got.columns == want.columns == COLUMNS
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    assert rows == brute(con.sql("select conv_id, turn, role, text from conversations").fetchall())


def some(rnd, convs, words=3, longest=9):
    return [(c, t, rnd.choice(["user", "assistant"]), " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, words)))) for c in convs for t in range(rnd.randint(1, longest))]


def test_many_shared_prefixes_as_brute_force(spark):
    rnd = random.Random(5)
    rows = some(rnd, [*range(100), *range(150, 420), 1000, 1007, 1100, *range(2001, 2040)], words=1, longest=7)
    assert trie(spark, rows) == brute(rows)


def test_long_conversations_cross_partitions(spark):
    rnd = random.Random(6)
    long = [(c, t, "user", f"turn {t // (2 if c == 3 else 1)}") for c in (1, 2, 3, 700, 701) for t in range(400)]
    long += [(704, t, "user", f"turn {t}" if t < 300 else "else") for t in range(330)]
    rows = long + some(rnd, range(300, 340))
    assert trie(spark, rows, parts=5) == brute(rows)


def test_full_sketch_only_costs_exact_groups(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CELL_BITS", 12)
    rnd = random.Random(7)
    rows = [(c, t, "user", f"{rnd.random()}") for c in range(1, 1500) for t in range(rnd.randint(1, 8))] + some(rnd, range(5000, 5060))
    assert trie(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "user", "é" * 5000), (0, 1, "user", "é" * 5000), (3, 2, "", ""), (3, None, "user", None), (3, None, "user", ""), (None, 1, "user", "x"), (-5, 0, "a", "bc"), (-5, 1, "ab", "c"), (-7, 0, "ab", "c"), (-7, 1, "a", "bc"), (250, 0, "user", "x"), (251, 0, "user", "x"), (252, 0, "user", "x"), (253, 1, "user", "x"), (254, 0, "user", "y")]
    assert trie(spark, rows) == brute(rows)
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "x")]) == [] and trie(spark, [(7, 1, "user", "x")]) == brute([(7, 1, "user", "x")])


def test_extra_columns_with_clashing_names(spark):
    rows = some(random.Random(8), range(30))
    odd = [(*r, "x", 7) for r in rows]
    assert trie(spark, odd, SCHEMA + ", depth string, c int") == brute(rows)


def test_estimates_are_never_too_small(spark):
    rnd = np.random.RandomState(9)
    pool = rnd.randint(-(1 << 62), 1 << 62, size=(3000, 2))
    at = rnd.choice(3000, 4000)
    table = spark.createDataFrame([(int(p), int(q)) for p, q in pool[at]], "p long, q long").repartition(5)
    first, second = prefix_trie.shared_cells(table, 13)
    n = np.bincount(at, minlength=3000)
    bit = lambda bitmap, cell: (bitmap[cell >> 3] >> (7 - (cell & 7))) & 1
    many = np.array([bit(first, int(p) & 8191) & bit(second, int(q) & 8191) for p, q in pool])
    assert many[n > 1].all() and 0 < (many[n == 1] == 0).mean()


def test_tails_are_not_grouped(spark):
    rnd = random.Random(10)
    rows = [(c, t, "user", f"{rnd.random()}") for c in range(1, 300) if c % 100 for t in range(9)]  # no openings
    _, prefixes = prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))
    got = prefix_trie.screened(prefixes, 17)
    assert got.where("not alone and depth > 0").count() < 60 and got.where("alone").count() > 1500
