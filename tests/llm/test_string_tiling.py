import random

from quillspark.llm import string_tiling as s


def greedy(item, doc, least):
    """Greedy string tiling by the definition: mark the longest match of unmarked tokens, again and again."""
    free_i, free_d, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for p in range(len(doc)):
                k = 0
                while i + k < len(item) and p + k < len(doc) and item[i + k] == doc[p + k] and free_i[i + k] and free_d[p + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, p)
        k, i, p = best
        if k < least:
            return total
        free_i[i : i + k] = [False] * k
        free_d[p : p + k] = [False] * k
        total += k


def covered(item, doc, least=3):
    block = s.block_of([(1, s.tokens(item))], least)
    return dict(s.covered(block, doc)).get(0, 0)


def test_as_the_definition():
    rnd = random.Random(1)
    for _ in range(400):
        item = [rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 20))]
        doc = [rnd.choice("abcdefghxyz") for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            a = rnd.randrange(len(item))
            doc[(b := rnd.randint(0, len(doc))) : b] = item[a : a + rnd.randint(3, 9)]
        got, want = covered(" ".join(item), " ".join(doc)), greedy(item, doc, 3)
        assert got == want, (item, doc, got, want)


def test_partial_coverage_as_the_definition(spark):
    """Tables of moved, cut and doubled parts of items, about the threshold."""
    rnd = random.Random(3)
    items = [(k, " ".join(rnd.choice("abcdef") + str(rnd.randint(0, 3)) for _ in range(40))) for k in range(10)]
    docs = []
    for n in range(150):
        words = [f"x{rnd.randint(0, 50)}" for _ in range(30)]
        for _ in range(rnd.randint(0, 6)):
            own = rnd.choice(items)[1].split()
            a, at = rnd.randrange(40), rnd.randint(0, len(words))
            words[at:at] = own[a : a + rnd.randint(2, 15)]
        docs.append((n, " ".join(words)))
    got = {(r.doc_id, r.item_id): r.covered_tokens for r in s.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), 0.3).collect()}
    want = {(n, k): c for n, t in docs for k, x in items if (c := greedy(x.split(), t.split(), s.LEAST)) >= 0.3 * 40}
    assert got == want and 10 < len(want) < 400


def test_reordered_and_edited():
    words = [f"w{i}" for i in range(30)]
    assert covered(" ".join(words), " ".join(words[20:] + ["x"] + words[:10] + ["y"] + words[10:20]), 4) == 30
    assert covered(" ".join(words), "before, " + ", ".join(words).upper() + "! after", 4) == 30
    assert covered(" ".join(words), " ".join(words[:10] + ["x"] + words[11:]), 4) == 29
    assert covered("a a a a a a", "a a a a " * 50, 3) == 6


def tables(spark):
    rnd = random.Random(6)
    bench = [(k, " ".join(f"b{k}_{rnd.randint(0, 9999)}" for _ in range(20))) for k in range(12)] + [(50, "short one"), (51, None), (52, ""), (None, " ".join(f"n{i}" for i in range(9)))]
    bench.append((60, bench[3][1]))  # the same text under two ids
    docs = [(k, f"clean words number {k} " * 5) for k in range(20)]
    docs += [(100 + k, "filler text around it " * 10 + bench[k][1] + " and more filler") for k in range(6)]
    docs += [(200, None), (201, ""), (202, "short one"), (None, bench[2][1]), (100, "filler text around it " * 10 + bench[0][1] + " and more filler"), (203, " ".join(bench[5][1].split()[:9]))]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(i, t, 1.0) for i, t in bench], "item_id long, text string, coverage double"), docs, bench


def test_leaks_and_clean(spark, monkeypatch):
    docs, benchmark, rows, bench = tables(spark)
    want = sorted(str((i, b)) for i, t in rows for b, x in bench if x and len(s.tokens(x)) >= 4 and x in (t or ""))
    for size in (s.BLOCK_TOKENS, 30):
        monkeypatch.setattr(s, "BLOCK_TOKENS", size)
        got = s.leaks(docs, benchmark).collect()
        assert sorted(str((r.doc_id, r.item_id)) for r in got) == want and all(r.coverage == 1.0 for r in got)
        kept = s.clean(docs, benchmark)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if not any(x and len(s.tokens(x)) >= 4 and x in (t or "") for _, x in bench))


def test_empty_tables(spark):
    docs, benchmark, *_ = tables(spark)
    assert s.leaks(docs, benchmark.limit(0)).count() == 0 and s.leaks(docs.limit(0), benchmark).count() == 0
    assert s.clean(docs, benchmark.limit(0)).count() == docs.count()


def test_all_rows_of_the_table_against_plain_search(spark):
    sf = "/root/testdata/sf0.01"
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in s.leaks(docs, benchmark).collect() if r.coverage == 1.0}
    items = [(r.item_id, b" " + b" ".join(s.tokens(r.text)) + b" ") for r in benchmark.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for t in [b" " + b" ".join(s.tokens(r.text)) + b" "] for i, x in items if x in t}
    assert want and got == want
