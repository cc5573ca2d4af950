"""Quotation linking: who a message answers, told by what it quotes.

Native: DataFrame operations only. Lines that start with > are parsed into nested levels, but for comparisons (>= or > before a digit) and prompts: a line
of >>> and a blank is a quote only in a message that also quotes at level one or two, as what it nests in would be. Neighbouring
lines of a level are a passage. Passages, and single lines of LEAST_WORDS words or more, are normalised and hashed,
and joined within their conversation to the earliest message that says the same unquoted. A message's parent is
the latest message that its least nested linked passage leads to; roots and depths follow from parents by pointer
doubling. The result has one row a message, without quotes, in reply order: by root, then by turn.

A conversation may hold any share of the rows: joins are keyed by conversation and hash, by conversation and turn, or by conversation and
sorted partition; minima are combined before the shuffle, and places come from a range-partitioned sort. Nothing gathers a conversation. Answers to one
message meet it in one key, which Spark's skew join splits where there are very many.

Defined results: null text counts as empty; messages without linked quotes have no parent and are their own root at depth
0; with null conv_id or turn they link to nothing and come first; repeated rows are all kept, and count once as an
original; equal passages belong to the earliest turn; a quote of a later or the same turn isn't linked; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, let, positioned, running, same

LEAST_WORDS = 3  # of a line that is looked up by itself
ROUNDS = 40  # of pointer doubling; enough for 2 ** 40 nested replies
MARK = r"^[ \t]*((?:>[ \t]*)+)"
COMPARES, PROMPT = r"^[ \t]*>+[=0-9]", r"^[ \t]*>>>([ \t\r]|$)"
#: Lines that introduce the quote below them and aren't the writer's words.
INTRODUCES = r"(?i)^(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:$"


def _lines(text: Column) -> Column:
    """array<struct<level, body, intro, raw>>: body is for hashing, raw the line as it stands. A line introduces a quote only if the next line that isn't blank is quoted."""
    marks = lambda line: F.regexp_extract(line, MARK, 1)
    level = lambda line: F.when(F.regexp_like(line, F.lit(COMPARES)), F.lit(0)).otherwise(F.length(marks(line)) - F.length(F.replace(marks(line), F.lit(">"), F.lit(""))))
    bare = lambda c: F.regexp_replace(c, r"^[ \r]+|[ \r]+$", "")
    counted = F.transform(F.split(text, "\n"), lambda line: F.struct(level(line).alias("level"), F.regexp_like(line, F.lit(PROMPT)).alias("prompt"), line.alias("raw")))

    def judged(lines: Column) -> Column:
        nests = F.exists(lines, lambda x: (x["level"] == 1) | (x["level"] == 2))
        quoted = lambda x: F.when(x["prompt"] & ~nests, F.lit(0)).otherwise(x["level"])
        return F.transform(lines, lambda x: F.struct(quoted(x).alias("level"), bare(F.when(quoted(x) > 0, F.regexp_replace(x["raw"], MARK, "")).otherwise(x["raw"])).alias("body"), x["raw"].alias("raw")))

    split = let(counted, judged)

    def introduced(lines: Column) -> Column:
        given = F.struct(
            F.filter(F.transform(lines, lambda x, i: F.when(x["body"] != "", i)), lambda i: i.isNotNull()).alias("said"),  # numbers of lines that aren't blank
            running(F.transform(lines, lambda x: (x["body"] != "").cast("bigint")), lambda a, b: a + b, 0).alias("rank"),
        )

        def marked(n: Column) -> Column:
            after = lambda i: F.get(lines, F.get(n["said"], (F.get(n["rank"], i) + 1).cast("int")))
            intro = lambda x, i: F.when(F.regexp_like(x["body"], F.lit(INTRODUCES)), F.coalesce(after(i)["level"] > 0, F.lit(False))).otherwise(F.lit(False))
            return F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), x["body"].alias("body"), intro(x, i).alias("intro"), x["raw"].alias("raw")))

        return let(given, marked)

    # without a > nothing is quoted, so nothing is introduced
    plain = lambda lines: F.transform(lines, lambda x: F.struct(x["level"].alias("level"), x["body"].alias("body"), F.lit(False).alias("intro"), x["raw"].alias("raw")))
    return F.when(F.contains(text, F.lit(">")), let(split, introduced)).otherwise(plain(split))


def _runs(lines: Column) -> Column:
    """array<struct<level, start, stop>> of neighbouring lines of a level; blank lines and introductions are in none."""
    levels = F.transform(lines, lambda x: F.when((x["body"] == "") | x["intro"], F.lit(-1)).otherwise(x["level"]))

    def runs(level: Column) -> Column:
        starts = F.filter(F.transform(level, lambda x, i: F.when((i == 0) | (x != F.get(level, i - 1)), i)), lambda i: i.isNotNull())
        made = lambda at: F.transform(at, lambda i, k: F.struct(F.get(level, i).alias("level"), i.alias("start"), F.coalesce(F.get(at, k + 1), F.size(level)).alias("stop")))
        return F.filter(let(starts, made), lambda r: r["level"] >= 0)

    return let(levels, runs)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\p{Punct}\s]+", " "))


def _joined(lines: Column, run: Column, glue: str) -> Column:
    return F.array_join(F.transform(F.slice(lines, run["start"] + 1, run["stop"] - run["start"]), lambda x: x["body"]), glue)


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines, runs, and own: what the message says itself, line by line as it stands, without blank lines before it and blanks behind it."""
    rows = messages.select("conv_id", "turn", "role", _lines(F.coalesce("text", F.lit(""))).alias("lines"))
    rows = rows.withColumn("runs", _runs(F.col("lines")))
    mine = F.filter("lines", lambda x: (x["level"] == 0) & ~x["intro"])
    return rows.withColumn("own", F.regexp_replace(F.array_join(F.transform(mine, lambda x: x["raw"]), "\n"), r"^\s*\n|\s+$", ""))


def _units(rows: DataFrame, quoted: bool) -> DataFrame:
    """conv_id, turn, level, part (0: passage, 1: line), key: what is quoted, or what can be."""
    runs = F.filter("runs", lambda r: (r["level"] > 0) if quoted else (r["level"] == 0))
    unit = lambda part, level, text: F.struct(F.lit(part).alias("part"), level.alias("level"), text.alias("text"))
    passages = F.transform(runs, lambda r: unit(0, r["level"], _normal(_joined(F.col("lines"), r, " "))))
    lines = F.transform(F.filter("lines", lambda x: (x["level"] > 0) if quoted else (x["level"] == 0)), lambda x: unit(1, x["level"], _normal(x["body"])))
    lines = F.filter(lines, lambda x: F.size(F.split(x["text"], " ")) >= LEAST_WORDS)
    all_of = F.concat(passages, lines) if quoted else F.concat(passages, lines, F.array(unit(0, F.lit(0), _normal(F.col("own")))))
    found = rows.select("conv_id", "turn", F.explode(F.filter(all_of, lambda x: x["text"] != "")).alias("u"))
    key = F.struct(F.xxhash64("u.text"), F.length("u.text"))
    return found.select("conv_id", "turn", F.col("u.level").alias("level"), F.col("u.part").alias("part"), key.alias("key"))


def parents(rows: DataFrame) -> DataFrame:
    """conv_id, turn, parent, n_linked of messages with a linked quote."""
    quotes = _units(rows.where(F.exists("runs", lambda r: r["level"] > 0)), True)
    sources = _units(rows, False).groupBy("conv_id", "part", "key").agg(F.min("turn").alias("source"))
    linked = quotes.join(sources, ["conv_id", "part", "key"]).where("source < turn")
    best = F.min_by("source", F.struct("level", -F.col("source")))
    return linked.groupBy("conv_id", "turn").agg(best.alias("parent"), F.countDistinct("level", "key").alias("n_linked"))


def roots(links: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth, from conv_id, turn, parent; parents that have none themselves are roots."""
    # up: the ancestor reached so far, and how far that is
    state = cut(links.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("far")))
    for _ in range(ROUNDS):
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"))
        jumped = state.join(above, ["conv_id", "up"], "left")
        new = cut(jumped.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")))
        state = new.drop("moved")
        if not new.where("moved").limit(1).count():
            break
    return state.select("conv_id", "turn", F.col("up").alias("root"), F.col("far").alias("depth"))


def threads(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position (in the conversation, from 0), parent_turn, root_turn, depth, n_quotes, n_linked, text without quotes."""
    rows = parsed(messages)
    links = cut(parents(rows))
    tree = links.join(roots(links), ["conv_id", "turn"])
    quotes = F.size(F.filter("runs", lambda r: r["level"] > 0)).cast("bigint")
    own = rows.select("conv_id", "turn", "role", quotes.alias("n_quotes"), F.col("own").alias("text"))
    full = own.join(tree, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"), "text"
    )
    placed = positioned(full, ["conv_id", "root_turn", "turn", "role", "text"], "place", "part")
    # a conversation's first place, told to each partition that it runs through, so that none of its rows need to meet
    parts = placed.groupBy("conv_id", "part").agg(F.min("place").alias("least"))
    first = parts.groupBy("conv_id").agg(F.min("least").alias("first"), F.collect_set("part").alias("parts")).select(F.col("conv_id").alias("of"), "first", F.explode("parts").alias("in"))
    out = placed.join(first, same(F.col("conv_id"), F.col("of")) & (F.col("part") == F.col("in"))).withColumn("position", F.col("place") - F.col("first"))
    return out.select("conv_id", "turn", "role", "position", "parent_turn", "root_turn", "depth", "n_quotes", "n_linked", "text")
