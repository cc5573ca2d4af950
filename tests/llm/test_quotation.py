import random
import re

from quillspark.llm import quotation as q

INTRODUCES = re.compile(q.INTRODUCES)


def normal(text):
    return re.sub(r"[!-/:-@\[-`{-~\s]+", " ", text.lower()).strip(" ")


def read(text):
    raw, lines = (text or "").split("\n"), []
    quoted = lambda line: re.match(r"[ \t]*((?:>[ \t]*)+)", line) if not re.match(r"[ \t]*>+[=0-9]", line) else None
    nests = any(m and m[1].count(">") in (1, 2) for m in map(quoted, raw))
    for line in raw:
        m = quoted(line)
        if m and not nests and re.match(r"[ \t]*>>>([ \t\r]|$)", line):
            m = None
        lines.append((m[1].count(">") if m else 0, (line[m.end() :] if m else line).strip(" \r")))
    after = lambda k: next((n for n, b in lines[k + 1 :] if b), 0)
    intro = {k for k, (_, b) in enumerate(lines) if INTRODUCES.search(b) and after(k) > 0}
    runs, last = [], None
    for k, (level, body) in enumerate(lines):
        level = None if not body or k in intro else level
        if level is not None and level == last:
            runs[-1][1].append(body)
        elif level is not None:
            runs.append((level, [body]))
        last = level
    own = "\n".join(raw[k] for k, (n, _) in enumerate(lines) if n == 0 and k not in intro)
    own = re.sub(r"\A\s*\n|\s+\Z", "", own)
    units = [(0, n, normal(" ".join(b))) for n, b in runs] + [(1, n, normal(b)) for n, b in lines if len(normal(b).split(" ")) >= q.LEAST_WORDS]
    return own, runs, [u for u in units if u[2]]


def brute(rows):
    said, parent, linked = {}, {}, {}
    for conv, turn, _, text in rows:
        own, _, units = read(text)
        for part, _, t in [(p, n, t) for p, n, t in units if n == 0] + ([(0, 0, normal(own))] if normal(own) else []):
            if conv is not None and turn is not None:
                said[conv, part, t] = min(said.get((conv, part, t), turn), turn)
    for conv, turn, _, text in rows:
        hits = [(n, -said[conv, p, t], t) for p, n, t in read(text)[2] if n > 0 and turn is not None and (conv, p, t) in said and said[conv, p, t] < turn]
        if hits:
            parent[conv, turn], linked[conv, turn] = -min(hits)[1], len({(n, t) for n, _, t in hits})
    out = []
    for conv, turn, role, text in rows:
        own, runs, _ = read(text)
        root, depth = turn, 0
        while (conv, root) in parent:
            root, depth = parent[conv, root], depth + 1
        out.append((conv, turn, role, parent.get((conv, turn)), root, depth, sum(n > 0 for n, _ in runs), linked.get((conv, turn), 0), own))
    return out


ROWS = [
    (4, 0, "user", "On balance I wrote:\nnothing much of note"),
    (4, 1, "user", "On Sunday, Y wrote:\n\n\n> nothing much of note\nOn second thought he wrote:\n\nstill nothing of note"),
    (4, 2, "user", "> still nothing of note\n\n\n> nothing much of note\n>> deep words of old\n> > deep words of old\nOn Monday Z wrote:"),
    (1, 0, "user", "Hello there my friend.\nHow are you doing today?"),
    (1, 1, "assistant", "On Monday, X wrote:\n> Hello there my friend.\n> How are you doing today?\nI am fine, thanks a lot."),
    (1, 2, "user", "> > Hello there my friend.\n> I am fine, thanks a lot.\n\nGreat to hear that."),
    (1, 3, "user", ">how are you,  DOING today\nstill asking"),
    (1, 4, "user", "> nothing known here\nok"),
    (1, 5, "assistant", ">Great to hear that.\r\nyes"),
    (1, 5, "assistant", ">Great to hear that.\r\nyes"),
    (1, 6, "user", "> later words of someone\n>> ok"),
    (1, 7, "user", "later words of someone"),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (2, 3, "system", "> Hello there my friend."),
    (None, 0, "user", "> x"),
    (None, 1, "user", "x"),
    (3, None, "user", "> a b c"),
    (3, 0, None, "a b c"),
]


def texts_of(spark, texts):
    rows = [(k, 0, "user", t) for k, t in enumerate(texts)]
    return {r.conv_id: r.text for r in q.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}


def test_text_without_quotes_stays_as_it_is(spark):
    rnd = random.Random(13)
    pieces = ["def f():", "    if x:", "\t\treturn 1", "", "  ", ">>> print(1)", ">>> ", "x -> y", ">= 3", ">5 items", "On Monday he wrote:", "a  b\t c", "    - item", "é > è", "\r"]
    texts = ["def f():\n    if x:\n        return 1", "    indented first", ">>> print(1)\n1\n>>> print(2)\n2", "a\r\n  b\r\nc"]
    texts += ["\n".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))) for _ in range(150)]
    got = texts_of(spark, texts)
    for k, t in enumerate(texts):
        assert got[k] == re.sub(r"\A\s*\n|\s+\Z", "", t), t


def test_quotes_go_and_indented_answers_stay(spark):
    got = texts_of(spark, ["> said\n    code:\n        more\n>>> deep\n>> less\nend", "> a\n>>> not a prompt here", ">>> x = 1\n> said"])
    assert got == {0: "    code:\n        more\nend", 1: "", 2: ""}


def check(spark, rows):
    got = q.threads(spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, position int").repartition(3)).collect()
    keep = [(r.conv_id, r.turn, r.role, r.parent_turn, r.root_turn, r.depth, r.n_quotes, r.n_linked, r.text) for r in got]
    assert sorted(map(str, keep)) == sorted(map(str, brute(rows)))
    for conv in {r.conv_id for r in got}:
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        order = [(r.root_turn if r.root_turn is not None else -1, r.turn if r.turn is not None else -1) for r in own]
        assert order == sorted(order)
        place = {r.turn: r.position for r in reversed(own)}
        assert all(r.parent_turn is None or place[r.parent_turn] < r.position for r in own)


def test_as_brute_force(spark):
    check(spark, ROWS)


def test_one_long_conversation(spark):
    rnd, rows = random.Random(3), []
    for turn in range(150):
        lines = []
        for _ in range(rnd.randint(0, 2)):
            if rows:
                lines.append("> " * rnd.randint(1, 2) + rnd.choice(rows)[3].split("\n")[-1])
        rows.append((7, turn, "user", "\n".join([*lines, f"message number {turn} says {rnd.randint(0, 40)} things"])))
    check(spark, rows)


def test_table_empty_table_and_native_plan(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)
    assert q.threads(table.limit(0)).count() == 0
    plan = q.threads(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_messages(spark):
    """Tens of thousands of lines and passages in one message."""
    import time

    lines = [f"{'> ' * (k % 3)}line number {k} of this message" if k % 7 else "" for k in range(30_000)]
    rows = [(1, 0, "u", "\n".join(x.lstrip("> ") for x in lines)), (1, 1, "u", "\n".join(lines)), (1, 2, "u", "On 1 May X wrote:\n" * 5000 + "> x")]
    began = time.perf_counter()
    got = sorted(q.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.turn)
    took = time.perf_counter() - began
    assert [r.parent_turn for r in got] == [None, 0, None] and got[1].n_quotes == len([1 for n, _ in read(rows[1][3])[1] if n]) and got[2].text.count("\n") == 4998
    assert took < 60, took
