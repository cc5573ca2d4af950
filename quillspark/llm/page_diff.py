"""Main text of web pages: markup, and differencing against the page with the nearest URL.

Pages are read into text lines (blocks), each in one of four zones: article, main element,
boilerplate (menus, headers, footers, notices, adverts, forms, comments, by element, role or class), or open.
Within each host, pages are ordered by URL path and paired with the neighbour whose path shares
the longest prefix; the lines of both are aligned by longest common subsequence, and shared ones are deleted. The deletion
decides lines of the open zone, on pages that mark no article. An article's line that another page shares is still the article's (copied articles, quoted
passages), and a boilerplate line that no neighbour shares is still boilerplate, so there the markup decides.

Only line hashes are shuffled for the pairing: a range-partitioned sort gives every page its place, and neighbours meet by
an equi-join on places, so a host with a third of all pages costs no more than others. Pages that equal one another in
id, url and html are aligned once.

A copy would delete a page's whole text. So pages next to one another that share COPIED of their open text form a run, however long, and each
of its pages is paired with the nearer of the pages before and after the run; if the host has no others, they keep their open lines.
A passage that a page and its nearest neighbour both quote in the open zone is deleted: nothing in the two pages tells it from boilerplate.

Defined results: null html is empty, and empty or blank html has the text ''; a null url has an empty host and path; a host's only page
keeps its open lines; of equally near neighbours the one before wins; repeated rows give repeated results; unclosed elements reach to the end, and a tag that never ends is left out with all after it; an unclosed quote ends with its tag; character references
are decoded once, and a text is joined from its lines by single spaces.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import least_partitions, positioned, written
from quillspark.llm.link_graph import host_of, path_of

ARTICLE, MAIN, OPEN, BOILERPLATE = range(4)
LENGTH_BITS = 12  # of a line's hash; they hold its length
MOST_LENGTH = (1 << LENGTH_BITS) - 1
COPIED = 0.85  # share of the open text that two near copies have in common
PIECE = 1000  # pages of a run of near copies in one row

OPENS = re.compile(r"<(?=!--|/?[a-zA-Z]|[!?])")
#: A tag to its end. A quote that is never closed is a character like others, so the tag ends at the next >.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>="']++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "math", "canvas", "object", "select", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
DROPPED = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "head", "header"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words of class names and ids that mark what isn't the article. A name is a mark if it has no other words than these and PARTS (related-links, but not related-work).
DROPPED_WORD = re.compile(
    r"ads?|adv|ads?\d+|adsense|adslot|adbox|advert\w*|alerts?|banners?|breadcrumbs?|comment\w*|comentarios?|kommentare?|consent|cookies?|copyright|discussion|disqus|footers?"
    r"|forms?|gdpr|legal|login|masthead|menus?|modal|nav|navbar|navigation|newsletters?|notices?|notifications?|pager|pagination|paywall|popups?|promos?|promoted|promotion"
    r"|reactions|recommended|related|replies|responses|respond|shar(?:e|ing)|sidebars?|signup|social|sponsor\w*|subscri\w*|toolbar|topbar|widgets?"
)
#: Those of them that are common words of articles too, and say nothing inside one.
ARTICLE_WORD = re.compile(r"alerts?|copyright|discussion|legal|promotion|responses|respond|reactions")
#: Whole names of article elements that aren't the page's own.
ASIDE_NAME = re.compile(r"ads?|advert\w*|comment\w*|comentarios?|kommentare?|promo|promoted|promotion|recommended|related|replies|sponsored")
#: Words that leave a name's meaning to its other words.
PARTS = set(
    "a action actions area article articles author avatar bar block body bottom box btn button buttons card center col column container content count desktop entry field fields group head header heading holder"
    " icon icons in inline inner input item items label left link links list main media message mobile more news outer panel post posts primary reader row rows secondary section site slot small space"
    " stories story text this title top unit user wide wrap wrapper zone right".split()
)
#: Words that mark a name they end, whatever stands before them (lower-navbar); outside articles also one that they begin.
CLEAR_WORD = re.compile(r"ads|advert\w*|breadcrumbs?|comments|cookies|disqus|footers?|masthead|nav|navbar|newsletters?|pagination|paywall|popups?|sidebars?|signup|sponsor\w*|toolbar|topbar")
#: Whole names of what holds an article's text; on the same element only a whole name, no compound, is a mark.
TEXT_NAME = re.compile(r"content|(?:main|page|article|post|entry|story)-?(?:content|body|text)|articlebody|chapter")
#: A name with one of these is of what stands around (with-sidebar), or files what it names (category-forms).
WRAPS = {"has", "with", "without", "no", "layout", "page"}
FILED = {"category", "format", "status", "tag", "topic", "type"}
MAIN_WORDS = ({"article"}, {"post", "body"}, {"post", "content"}, {"entry", "content"}, {"story", "body"}, {"story", "content"})
#: An element that ends an open one of the same group when it starts.
ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _marks(name: str, zone: int, holds_text: bool) -> bool:
    """Whether a class name or id, in lower case and hyphened, marks an element in zone as none of the article."""
    words = re.findall(r"[a-z0-9]+", name)
    if not words or WRAPS & set(words) or words[0] in FILED and len(words) > 1:
        return False
    marks = [bool(DROPPED_WORD.fullmatch(w)) and not (zone == ARTICLE and ARTICLE_WORD.fullmatch(w)) for w in words]
    if len(words) == 1 or holds_text or not any(marks):
        return marks == [True]
    if all(m or w in PARTS or w.isdigit() for m, w in zip(marks, words)):
        return True
    if zone == ARTICLE:
        return bool(CLEAR_WORD.fullmatch(words[-1]))
    return marks[-1] or bool(CLEAR_WORD.fullmatch(words[0]))


def _zone(name: str, attributes: str, zone: int) -> int:
    """The zone inside an element that starts in zone."""
    if zone == BOILERPLATE or name in ("body", "html"):
        return zone
    given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    role = given.get("role", "").lower()
    names = re.sub(r"([a-z])([A-Z])", r"\1-\2", f"{given.get('class', '')} {given.get('id', '')}").lower().split()
    if name == "header" and zone == ARTICLE:
        return zone  # an article's own heading
    if "article" in (name, role) or "main" in (name, role):  # what a page calls its article may be filed under any word
        dropped = any(ASIDE_NAME.fullmatch(x) for x in names)
    else:
        holds_text = any(TEXT_NAME.fullmatch(x) for x in names)
        dropped = any(_marks(x, zone, holds_text) for x in names)
    if name in DROPPED or role in DROPPED_ROLES or dropped or "hidden" in attributes.split() or given.get("aria-hidden") == "true":
        return BOILERPLATE
    if name == "article" or role == "article":
        return ARTICLE  # one inside another is a part of it, unless what holds it or its own name says a comment
    words = [set(re.findall(r"[a-z0-9]+", x)) for x in names]
    if zone != ARTICLE and (given.get("itemprop", "").lower() == "articlebody" or any(m <= x for m in MAIN_WORDS for x in words)):
        return ARTICLE
    if zone == OPEN and (name == "main" or role == "main"):
        return MAIN
    return zone


def lines(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order."""
    page = page or ""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    open_names: Counter[str] = Counter()
    zone, held = OPEN, OPEN

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((held, text))

    def pop() -> str:
        nonlocal zone
        name, zone = stack.pop()
        open_names[name] -= 1
        return name

    last = page.rfind(">")
    stop = 0
    while True:
        found = OPENS.search(page, stop)
        parts.append(page[stop : found.start() if found else len(page)])
        if not found or found.start() > last:
            break  # a tag that never ends has no text
        at = found.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            stop = end + 3 if end >= 0 else len(page)
            continue
        if page[at + 1] in "!?":
            stop = page.find(">", at) + 1
            continue
        tag = TAG.match(page, at, last + 1)
        if not tag:  # its end is in an attribute
            stop = page.find(">", at) + 1
            continue
        stop = tag.end()
        close, name, attributes = tag[1], tag[2].lower(), tag[3]
        if name in INLINE:
            continue
        if name == "br":
            parts.append(" ")
            continue
        flush()
        if name in RAW and not close:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, stop)
                stop = page.find(">", end.end()) + 1 if end else 0
                stop = stop or len(page)
            continue
        if close:
            if open_names[name] > 0:
                while pop() != name:
                    pass
        elif name not in VOID and not (attributes.endswith("/") and name not in ("p", "div")):
            if stack and (stack[-1][0] in ENDS.get(name, ()) or stack[-1][0] == "p"):
                pop()
            stack.append((name, zone))
            open_names[name] += 1
            zone = _zone(name, attributes, zone)
        held = zone
    flush()
    return out


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b. Bit rows over b; halves of a keep memory linear."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    inner = _aligned(a, low, len(a) - high, b[low : len(b) - high])
    return [*range(low), *inner, *range(len(a) - high, len(a))]


def _row(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of a and each prefix of b."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        if m := places.get(x, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    ones = np.frombuffer((~v & full).to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(np.unpackbits(ones, bitorder="little")[: len(b)])])


def _aligned(a: list[int], start: int, stop: int, b: list[int]) -> list[int]:
    known = set(b)
    while start < stop and a[start] not in known:
        start += 1
    while start < stop and a[stop - 1] not in known:
        stop -= 1
    if start == stop or not b:
        return []
    if stop - start == 1:
        return [start]
    half = (start + stop) // 2
    total = _row(a[start:half], b) + _row(a[half:stop][::-1], b[::-1])[::-1]
    cut = int(np.argmax(total))
    return _aligned(a, start, half, b[:cut]) + _aligned(a, half, stop, b[cut:])


def _key() -> Column:
    return F.xxhash64(F.col("page_id"), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))


def _line_hash(zone: int, text: str) -> int:
    """52 bits of the text's hash, then its length where it is open (at most 4,095): what pages may lose to a copy."""
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode()), "big", signed=True) >> LENGTH_BITS << LENGTH_BITS | (min(len(text), MOST_LENGTH) if zone == OPEN else 0)


def _hashed(pages: DataFrame) -> DataFrame:
    """host, path, key and the hashes of each page's lines."""
    rows = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _key().alias("key"), "html")
    schema = T.StructType([rows.schema["host"], rows.schema["path"], T.StructField("key", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [[_line_hash(zone, t) for zone, t in lines(x)] for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "path", "key")), pa.array(hashes, pa.list_(pa.int64()))], schema.names)

    return rows.mapInArrow(run, schema).dropDuplicates(["key"])


def near_copies(a: list[int], b: list[int]) -> bool:
    """Whether both pages share COPIED of their open text, in any order."""
    least, most = sorted(sum(x & MOST_LENGTH for x in page) for page in (a, b))
    if not least or least < COPIED * most:
        return False
    left = Counter(b)
    shared = 0
    for x in a:
        if left[x] > 0:
            left[x] -= 1
            shared += x & MOST_LENGTH
    return shared >= COPIED * most


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _shared(path: str, own: list[int], near: list[tuple[str | None, list[int]]]) -> list[int]:
    """The numbers of the lines that are shared with the page of the nearest path, of those there are."""
    pairs = [(_common(path, p), h) for p, h in near if p is not None]
    bare = lambda page: [x >> LENGTH_BITS for x in page]
    return shared_lines(bare(own), bare(max(pairs, key=lambda x: x[0])[1])) if pairs else []


def _past_copies(placed: DataFrame, copies: DataFrame) -> DataFrame:
    """key and ``shared`` of the pages in runs of near copies. copies: place, of pages whose next page is a near copy."""
    runs = positioned(copies, ["place"], "number").groupBy((F.col("place") - F.col("number")).alias("run")).agg(F.min("place").alias("start"), (F.max("place") + 1).alias("end"), F.first("host").alias("host"))
    for name, place in (("before", F.col("start") - 1), ("after", F.col("end") + 1)):
        edge = placed.select(F.col("place").alias(f"{name}_place"), F.col("host").alias("of"), F.col("path").alias(f"{name}_path"), F.col("hashes").alias(f"{name}_hashes"))
        runs = runs.join(edge, (place == F.col(f"{name}_place")) & (F.col("host") == F.col("of")), "left").drop("of", f"{name}_place")
    # a long run is dealt in pieces
    pieces = runs.drop("host").withColumn("piece", F.explode(F.sequence("start", "end", F.lit(PIECE).cast("bigint")))).repartition(least_partitions(placed.sparkSession), "piece")
    members = pieces.withColumn("place", F.explode(F.sequence("piece", F.least("end", F.col("piece") + PIECE - 1)))).drop("run", "start", "end", "piece")
    columns = ["key", "path", "hashes", "before_path", "before_hashes", "after_path", "after_hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [_shared(path, own, [near[:2], near[2:]]) for _, path, own, *near in zip(*(batch.column(c).to_pylist() for c in columns))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shared, pa.list_(pa.int32()))], ["key", "shared"])

    return members.join(placed, "place").select(*columns).mapInArrow(run, "key long, shared array<int>")


def shared_with_nearest(pages: DataFrame) -> DataFrame:
    """key and ``shared``: the numbers of the lines that a page shares, in order, with the page of its host with the nearest path, past near copies."""
    placed = positioned(_hashed(pages), ["host", "path", "key"], "place")
    other = lambda name, step: placed.select((F.col("place") + step).alias("place"), F.col("host").alias("of"), F.col("path").alias(f"{name}_path"), F.col("hashes").alias(f"{name}_hashes"))
    met = placed
    for name, step in (("before", 1), ("after", -1)):
        met = met.join(other(name, step).withColumnRenamed("place", f"{name}_place").withColumnRenamed("of", f"{name}_of"), (F.col("place") == F.col(f"{name}_place")) & (F.col("host") == F.col(f"{name}_of")), "left")
    columns = ["place", "key", "host", "path", "hashes", "before_path", "before_hashes", "after_path", "after_hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copied, next_copied, shared = [], [], []
            for _, _, _, path, own, *near in zip(*(batch.column(c).to_pylist() for c in columns)):
                before, after = (h is not None and near_copies(own, h) for h in (near[1], near[3]))
                copied.append(before or after)
                next_copied.append(after)
                shared.append([] if before or after else _shared(path, own, [near[:2], near[2:]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("place", "key", "host")), pa.array(copied), pa.array(next_copied), pa.array(shared, pa.list_(pa.int32()))], schema.names)

    schema = T.StructType([*(placed.schema[c] for c in ("place", "key", "host")), T.StructField("copied", T.BooleanType()), T.StructField("next_copied", T.BooleanType()), T.StructField("shared", T.ArrayType(T.IntegerType()))])
    found = written(met.select(*columns).mapInArrow(run, schema))
    apart = found.where("not copied").select("key", "shared")
    copies = found.where("next_copied").select("place", "host")
    return apart.unionAll(_past_copies(placed, copies)) if copies.limit(1).count() else apart


def marked_text(found: list[tuple[int, str]]) -> str | None:
    """The lines of articles or those of the main element outside them, whichever are longer; null without any."""
    marked = [[t for zone, t in found if zone == best] for best in (ARTICLE, MAIN)]
    return " ".join(max(marked, key=lambda x: sum(map(len, x)))) or None


def main_text(found: list[tuple[int, str]], shared: list[int]) -> str:
    """What extracted() gives for a page: its marked text; without any, the open lines that it doesn't share."""
    deleted = set(shared)
    return marked_text(found) or " ".join(t for k, (zone, t) in enumerate(found) if zone == OPEN and k not in deleted)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines and n_shared of every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", _key().alias("key"))
    # texts are shuffled to meet what is shared, not markup; lines (null unless open) only of pages that mark no text
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("key", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("marked", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, marked, open_lines = [], [], []
            for page in batch.column("html").to_pylist():
                found = lines(page)
                n_lines.append(len(found))
                marked.append(text := marked_text(found))
                open_lines.append([t if zone == OPEN else None for zone, t in found] if text is None else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "key")), pa.array(n_lines, pa.int64()), pa.array(marked, pa.string()), pa.array(open_lines, pa.list_(pa.string()))], schema.names)

    met = rows.mapInArrow(run, schema).join(shared_with_nearest(pages).hint("merge"), "key", "left")
    shared = F.coalesce("shared", F.array().cast("array<int>"))
    places = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))
    own = F.array_join(F.transform(F.array_except(places, shared), lambda k: F.get("lines", k)), " ")  # leaves nulls out
    text = F.coalesce("marked", own).alias("text")
    return met.select("page_id", "url", text, "n_lines", F.size(shared).cast("bigint").alias("n_shared")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_lines", "n_shared")
