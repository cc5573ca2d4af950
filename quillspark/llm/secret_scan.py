"""Secret scans: three fixed patterns, and a battery of randomness tests for everything else.

Native: column expressions only. Every row is scanned on its own, so the plan of the scan has no
shuffle. The battery takes runs of 20 or more token characters that hold a letter (24 digits are a fixed pattern, and fewer lack LEAST_BITS),
infers each one's encoding from the characters used, and tests whether its symbols look drawn at
random from that alphabet: chi-squared uniformity, runs above and below the middle, and lag-one serial
correlation, combined by Fisher's method. Tokens that aren't random are the discoveries of a first Benjamini-Hochberg
step, within each length class (powers of two), over all documents; nothing with p over LOSS is dropped by it, as among many identifiers it alone would drop one random token in five.

Words of 20 letters pass three tests on 20 symbols, so what is left must also be unlike the corpus' own words. How often a letter follows another is counted over all words of WORD letters or
more; a token's evidence is how much likelier a draw from its alphabet makes it than those pairs of letters and the habits of names (NAMES: how often letters, digits and signs follow one another). Under the
pairs its mean is 1 at any length, so a second step, on evidence, holds the false discoveries of what is reported at REPORTED within each length class. What passes both is reported as
kind ``random`` where it overlaps no span of a fixed pattern. Names unlike all words of the corpus may be among it, and random tokens of few symbols may not.

The steps need ranks. Tokens are counted by length class, twentieth of a decade of p and tenth of a decade of evidence,
LENGTH_CLASSES * P_BINS * E_BINS counts at most however large the corpus, so no rows meet in one task.

Defined results: null text counts as empty; no spans give '' and zero counts; positions count code
points, ends exclusive; repeated rows and ties are scanned alike; other columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, let, running

# The patterns that the scan's contract names, with the least length of a match (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"

KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings in the order in which they are tried: characters allowed, alphabet.
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("lower", r"^[a-z]+$", LOWER),
    ("upper", r"^[A-Z]+$", UPPER),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", r"^[0-9A-Z]+$", DIGITS + UPPER),
    ("letters", r"^[A-Za-z]+$", UPPER + LOWER),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
FDR = 0.2  # share of random tokens among those called not random
LOSS = 0.001  # largest p at which a token may be dropped: about the chance that a random one is
REPORTED = 0.05  # share of tokens like words among those reported
WORD = 4  # letters of the shortest word that pairs are counted in
OTHER = 0.2  # share of a name's pairs of letters that may be like no word
#: How often a letter, a digit or a sign of a name is followed by a letter, a digit, a sign.
NAMES = ((0.88, 0.06, 0.06), (0.2, 0.6, 0.2), (0.7, 0.2, 0.1))
LEAST_BITS = 80  # symbols times bits a symbol that a reported token must have
LENGTH_CLASSES, P_BINS, BINS_A_DECADE = 32, 400, 20
E_BINS, E_A_DECADE = 400, 10
CHUNK = 4096  # characters of a text that are handled together


def _spans(text: Column, pattern: str, kind: int, keep: Column | None = None) -> Column:
    """array<struct<start, kind, end, match>> of the matches of a pattern."""
    long = lambda c: F.length(c).cast("bigint")

    def placed(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), x["found"], lambda gap, found: long(gap) + long(found))

        def span(before: Column, i: Column) -> Column:
            start = before + long(F.get(x["gaps"], i))
            return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + long(F.get(x["found"], i))).alias("end"), F.get(x["found"], i).alias("found"))

        all_of = F.transform(running(lengths, lambda a, b: a + b, 0), span)
        return all_of if keep is None else F.filter(all_of, lambda _, i: F.get(x["keep"], i))

    given = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), *([] if keep is None else [keep.alias("keep")]))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,found:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), let(given, placed)).otherwise(none)


def _encoding(s: Column) -> tuple[Column, Column]:
    """Name and alphabet of the narrowest encoding that s fits; null if none."""
    name, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, allowed, letters in reversed(ENCODINGS):
        fits = F.regexp_like(s, F.lit(allowed))
        name, alphabet = F.when(fits, F.lit(n)).otherwise(name), F.when(fits, F.lit(letters)).otherwise(alphabet)
    return name, alphabet


def _two_sided(z: Column) -> Column:
    """Normal tail beyond |z| on both sides, by a logistic approximation."""
    a = F.least(F.abs(z), F.lit(12.0))
    return F.lit(2.0) / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a))


def battery(s: Column) -> Column:
    """struct<encoding, bits, p>: the inferred encoding, its information, and Fisher's combined p-value of the three tests."""
    name, letters = _encoding(s)
    given = F.struct(s.alias("s"), name.alias("encoding"), letters.alias("letters"))

    def symbols(x: Column) -> Column:
        chars = F.filter(F.split(x["s"], ""), lambda c: c != "")
        return F.struct(x["s"].alias("s"), x["encoding"].alias("encoding"), F.length(x["letters"]).cast("double").alias("k"), chars.alias("chars"), F.transform(chars, lambda c: (F.instr(x["letters"], c) - 1).cast("double")).alias("at"))

    def sums(x: Column) -> Column:
        n = F.size(x["at"]).cast("double")
        squares = F.aggregate(F.array_distinct(x["chars"]), F.lit(0.0), lambda acc, c: acc + F.pow((F.length(x["s"]) - F.length(F.replace(x["s"], c, F.lit("")))).cast("double"), F.lit(2.0)))
        high = F.size(F.filter(x["at"], lambda v: v >= x["k"] / 2)).cast("double")
        mean = F.aggregate(x["at"], F.lit(0.0), lambda acc, v: acc + v) / n
        return F.struct(x["encoding"].alias("encoding"), x["k"].alias("k"), n.alias("n"), squares.alias("squares"), high.alias("high"), mean.alias("mean"), x["at"].alias("at"))

    def pairs(x: Column) -> Column:
        rest = F.size(x["at"]) - 1
        turn = lambda a, b: ((a >= x["k"] / 2) != (b >= x["k"] / 2)).cast("double")
        ahead, after = F.slice(x["at"], F.lit(1), rest), F.slice(x["at"], F.lit(2), rest)
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
        around = total(F.transform(x["at"], lambda v: (v - x["mean"]) * (v - x["mean"])))
        return F.struct(*(x[c].alias(c) for c in ("encoding", "k", "n", "squares", "high")), (1 + total(F.zip_with(ahead, after, turn))).alias("runs"), total(F.zip_with(ahead, after, lambda a, b: (a - x["mean"]) * (b - x["mean"]))).alias("lag"), around.alias("around"))

    def tested(x: Column) -> Column:
        n, k, low = x["n"], x["k"], x["n"] - x["high"]
        uniform = (k / n * x["squares"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        product = 2 * x["high"] * low
        spread = product * (product - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, (x["runs"] - product / n - 1) / F.sqrt(spread)).otherwise(F.lit(12.0))
        serial = F.when(x["around"] > 0, (x["lag"] / x["around"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(12.0))
        half = -F.ln(_two_sided(uniform)) - F.ln(_two_sided(runs)) - F.ln(_two_sided(serial))
        p = F.exp(-half) * (1 + half + half * half / 2)
        return F.struct(x["encoding"].alias("encoding"), (n * F.log2(k)).alias("bits"), p.alias("p"))

    # each transform names what the next one uses more than once
    out = F.array(given)
    for f in (symbols, sums, pairs, tested):
        out = F.transform(out, f)
    return F.when(name.isNotNull(), F.element_at(out, 1))


def _length_class(s: Column) -> Column:
    return F.least(F.floor(F.log2(F.length(s))).cast("int"), F.lit(LENGTH_CLASSES - 1))


def _p_bin(p: Column) -> Column:
    """0 for p = 1, more for smaller p."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * BINS_A_DECADE).cast("int"), F.lit(P_BINS - 1))


def letter_pairs(docs: DataFrame, text_col: str = "text") -> list[float]:
    """ln of how often each letter follows each other one in words, 26 * 26 numbers; one in 1 / OTHER pairs is taken to be any, as names hold words that no text has."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"[A-Za-z]{{{WORD},}}"), F.lit(0))).alias("w"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: F.lower(F.substring(F.col("w"), k, 2)))).alias("pair"))
    seen = {r["pair"]: r["count"] for r in pairs.groupBy("pair").count().collect()}  # 676 at most
    rows = [[seen.get(a + b, 0) for b in LOWER] for a in LOWER]
    return [math.log((1 - OTHER) * (n / sum(row) if any(row) else 1 / 26) + OTHER / 26) for row in rows for n in row]


def evidence(s: Column, pairs: list[float]) -> Column:
    """ln of how much likelier a draw from its alphabet makes a token than the words of the corpus; null without an encoding."""
    odds = F.lit(None).cast("array<double>")
    for _, allowed, letters in reversed(ENCODINGS):
        share = [sum(c.isalpha() for c in letters), sum(c.isdigit() for c in letters), sum(not c.isalnum() for c in letters)]
        own = [math.log(x / len(letters)) if x else 0.0 for x in share]  # a kind that the alphabet lacks isn't looked up
        odds = F.when(F.regexp_like(s, F.lit(allowed)), F.lit([*own, -math.log(len({c.lower() for c in letters if c.isalpha()}))])).otherwise(odds)
    habits, follows = F.lit([math.log(x) for row in NAMES for x in row]), F.lit(pairs)

    def seen(x: Column) -> Column:
        at = F.transform(F.filter(F.split(x["s"], ""), lambda c: c != ""), lambda c: F.instr(F.lit(LOWER + UPPER), c) - 1)
        kinds = F.transform(F.filter(F.split(x["s"], ""), lambda c: c != ""), lambda c: F.when(F.instr(F.lit(LOWER + UPPER), c) > 0, F.lit(0)).when(F.instr(F.lit(DIGITS), c) > 0, F.lit(1)).otherwise(F.lit(2)))
        # small letters from 0, capitals from 26, from 52 those before a small one
        ahead = let(at, lambda v: F.zip_with(v, F.slice(v, F.lit(2), F.size(v)), lambda a, b: F.when((a >= 26) & F.coalesce((b >= 0) & (b < 26), F.lit(False)), a + 26).otherwise(a)))
        return F.struct(x["odds"].alias("odds"), ahead.alias("at"), kinds.alias("kinds"))

    def told(x: Column) -> Column:
        rest = F.size(x["at"]) - 1
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
        # a capital between small letters begins a word
        pair = lambda a, b: F.when((a >= 0) & (b >= 0) & ~((a < 26) & (b >= 52)), F.get(x["odds"], F.lit(3)) - F.get(follows, a % 26 * 26 + b % 26)).otherwise(F.lit(0.0))
        letters = F.zip_with(F.slice(x["at"], F.lit(1), rest), F.slice(x["at"], F.lit(2), rest), pair)
        turns = F.zip_with(F.slice(x["kinds"], F.lit(1), rest), F.slice(x["kinds"], F.lit(2), rest), lambda a, b: F.get(x["odds"], b) - F.get(habits, a * 3 + b))
        return total(letters) + total(turns)

    given = F.struct(s.alias("s"), odds.alias("odds"))
    return F.when(odds.isNotNull(), let(given, lambda x: let(seen(x), told)))


def _e_bin(e: Column) -> Column:
    """0 for evidence of 1 or less, more for more."""
    return F.greatest(F.least(F.floor(e / math.log(10) * E_A_DECADE).cast("int"), F.lit(E_BINS - 1)), F.lit(0))


def _counted(docs: DataFrame, text_col: str, pairs: list[float] | None) -> DataFrame:
    """length_class, p_bin, e_bin, enough, count of all candidates with an encoding."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    token = docs.select(F.explode(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).alias("token"))
    e = F.lit(0) if pairs is None else _e_bin(evidence(F.col("token"), pairs))
    tested = token.select(_length_class(F.col("token")).alias("length_class"), battery(F.col("token")).alias("t"), e.alias("e_bin")).where("t is not null")
    return tested.groupBy("length_class", _p_bin(F.col("t.p")).alias("p_bin"), "e_bin", (F.col("t.bits") >= LEAST_BITS).alias("enough")).count()


def _not_random(counts: DataFrame, fdr: float) -> dict[int, int]:
    w = Window.partitionBy("length_class")
    by_p = counts.groupBy("length_class", "p_bin").agg(F.sum("count").alias("count"))
    ranked = by_p.withColumn("rank", F.sum("count").over(w.orderBy(F.desc("p_bin")))).withColumn("m", F.sum("count").over(w))
    # the largest p of bin b is 10 ** (-b / BINS_A_DECADE)
    found = ranked.where(F.pow(F.lit(10.0), -F.col("p_bin") / BINS_A_DECADE) <= fdr * F.col("rank") / F.col("m"))
    least = math.ceil(-math.log10(LOSS) * BINS_A_DECADE)
    return {r["length_class"]: max(least, r["p_bin"]) for r in found.groupBy("length_class").agg(F.min("p_bin").alias("p_bin")).collect()}


def not_random_from(docs: DataFrame, text_col: str = "text", fdr: float = FDR) -> dict[int, int]:
    """Per length class the least p bin whose tokens are called not random, of those with p up to LOSS. At most LENGTH_CLASSES entries come to the driver."""
    return _not_random(_counted(docs, text_col, None), fdr)


def limits(docs: DataFrame, text_col: str = "text", fdr: float = FDR, reported: float = REPORTED) -> tuple[list[float], dict[int, tuple[int, int]]]:
    """Letter pairs, and per length class with anything to report the p bin from which tokens are dropped and the least bin of evidence."""
    pairs = letter_pairs(docs, text_col)
    counts = cut(_counted(docs, text_col, pairs))
    dropped = _not_random(counts, fdr)
    w = Window.partitionBy("length_class")
    least = _by_class(F.col("length_class"), dropped, P_BINS)
    left = counts.withColumn("left", F.when((F.col("p_bin") < least) & F.col("enough"), F.col("count")).otherwise(F.lit(0)))
    by_e = left.groupBy("length_class", "e_bin").agg(F.sum("left").alias("left"), F.sum("count").alias("count"))
    ranked = by_e.withColumn("k", F.sum("left").over(w.orderBy(F.desc("e_bin")))).withColumn("m", F.sum("count").over(w))
    # the least evidence of bin b is 10 ** (b / E_A_DECADE)
    found = ranked.where((F.col("k") > 0) & (F.pow(F.lit(10.0), F.col("e_bin") / E_A_DECADE) * reported * F.col("k") >= F.col("m")))
    return pairs, {r["length_class"]: (dropped.get(r["length_class"], P_BINS), r["e_bin"]) for r in found.groupBy("length_class").agg(F.min("e_bin").alias("e_bin")).collect()}


def _by_class(length_class: Column, given: dict[int, int], default: int) -> Column:
    """The number given for a length class."""
    return F.get(F.array(*(F.lit(given.get(c, default)) for c in range(LENGTH_CLASSES))), length_class)


def scanned(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep in a struct ``kept``, text, base and all spans: array<struct<start, kind, end>>, sorted by start, then kind as in KINDS."""
    pairs, cuts = limits(docs, text_col)
    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda s: F.length(s) >= ASSIGN_LEAST)
    bare = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    parts = rows.select("kept", "text", _spans(text, ASSIGN, 0, long_enough).alias("assign"), _spans(text, ACCESS, 1).alias("access"), _spans(text, HEX, 2).alias("hex"), _spans(text, CANDIDATE, 3).alias("candidates"))
    based = parts.select("kept", "text", F.array_sort(bare(F.concat("assign", "access", "hex"))).alias("base"), "candidates")
    least = lambda k, default: lambda x: _by_class(_length_class(x["found"]), {c: v[k] for c, v in cuts.items()}, default)
    drop_from, report_from = least(0, 0), least(1, E_BINS)

    def random(x: Column) -> Column:
        drawn = let(battery(x["found"]), lambda t: (t["bits"] >= LEAST_BITS) & (_p_bin(t["p"]) < drop_from(x)))
        return F.coalesce(F.when(drawn, _e_bin(evidence(x["found"], pairs)) >= report_from(x)), F.lit(False))

    more = F.when(F.size("candidates") > 0, bare(F.filter(_apart(F.col("base"), F.col("candidates")), random))).otherwise(bare(F.col("candidates")))
    return based.select("kept", "text", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _apart(base: Column, candidates: Column) -> Column:
    """The candidates that overlap no span of base: among both by start, no earlier base span ends after theirs starts, and no later one starts before theirs ends."""
    late = 1 << 62
    given = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit("").alias("found")))
    ends = lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(F.lit(0).cast("bigint"))
    starts = lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(F.lit(late))

    def free(both: Column) -> Column:
        around = F.struct(
            running(F.transform(both, ends), lambda a, b: F.greatest(a, b), 0).alias("before"),
            F.reverse(running(F.reverse(F.transform(both, starts)), lambda a, b: F.least(a, b), late)).alias("after"),
        )
        return let(around, lambda n: F.filter(both, lambda x, i: (x["kind"] == 3) & (F.get(n["before"], i) <= x["start"]) & (F.get(n["after"], i) >= x["end"])))

    return F.when(F.size(base) > 0, let(F.array_sort(F.concat(given, candidates)), free)).otherwise(candidates)


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each stretch that spans cover replaced by mark."""
    chunks = F.when(F.length(text) > CHUNK, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(F.array(text))
    ends = running(F.concat(F.transform(spans, lambda x: x["end"]), F.array(F.length(text).cast("bigint"))), lambda a, b: F.greatest(a, b), 0)
    given = F.struct(chunks.alias("chunks"), ends.alias("ends"), spans.alias("spans"), F.length(text).cast("bigint").alias("size"))

    def done(x: Column) -> Column:
        def between(a: Column, b: Column) -> Column:  # counted from the chunk's start, not from the text's
            first = F.floor(a / CHUNK).cast("int")
            some = F.slice(x["chunks"], first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1)
            return F.when(b > a, F.substring(F.array_join(some, ""), (a - first * CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

        parts = F.transform(x["spans"], lambda s, i: F.when(s["start"] >= F.get(x["ends"], i), F.concat(between(F.get(x["ends"], i), s["start"]), F.lit(mark))))
        return F.concat(F.array_join(parts, ""), between(F.element_at(x["ends"], -1), x["size"]))

    return F.when(F.size(spans) > 0, let(given, done)).otherwise(text)


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with its own columns; each secret in text is replaced, and n_chars, where there is one, is of the new text. Null texts stay null."""
    found = scanned(docs, docs.columns)
    new = F.when(F.col("kept.text").isNotNull(), redacted(F.col("text"), F.col("spans")))
    found = found.select("kept", new.alias("new"))
    changed = {"text": F.col("new"), "n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col("new")}
    return found.select(*(changed.get(c, F.col("kept").getField(c)).alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of each fixed pattern, the digest of their spans, and all spans as text."""
    found = scanned(docs, ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return found.select("kept.doc_id", count(0), count(1), count(2), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
