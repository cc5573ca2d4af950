import html
import random
import re

import pytest

from quillspark.llm import page_diff as p


def longest(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for k in range(len(b)):
            d[i + 1][k + 1] = d[i][k] + 1 if a[i] == b[k] else max(d[i][k + 1], d[i + 1][k])
    return d[-1][-1]


def test_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(600):
        a, b = ([rnd.randint(0, 6) for _ in range(rnd.randint(0, 25))] for _ in range(2))
        got = p.shared_lines(a, b)
        rest = iter(b)
        assert got == sorted(set(got)) and len(got) == longest(a, b) and all(any(x == y for y in rest) for x in (a[i] for i in got))


def text(page, shared=()):
    return p.main_text(p.lines(page), list(shared))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("just  words &amp; more", "just words & more"),
        ("<p>a<b>b</b>c<br>d</p><p>e &lt;i&gt;&nbsp;&#233; &amp;amp; &am</p>", "abc d e <i> é &amp; &am"),
        ("<title>no</title><style>p{}</style><script>var t='</p><p>x';</script><p>yes", "yes"),
        ("<nav>m</nav><header>h</header><div class='ad'>a</div><article><h1>T</h1><p><b>x<br><p>y</article><footer>f", "T x y"),
        ("<main><p>m</p><aside>no</aside></main><p>out</p>", "m"),
        ("<article><header><h2>T</h2></header>x<section id=comments><p>no</p><article>no</article></section><article class=comment>no</article><form>no</form><footer>no</footer></article>", "T x"),
        ("<div id='cookieNotice'>no</div><div class='page with-sidebar'><div class='post-content'><p>yes</p><div class=share>no</div></div></div>", "yes"),
        ("<div role=navigation>no</div><div itemprop='articleBody'>yes<div hidden>no</div></div>", "yes"),
        ("<!-- <p>no</p> --><p title='a>b'>yes</p><!-- open <p>no", "yes"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("1 < 2 and <3", "1 < 2 and <3"),
        ("<article><p>one</p><p title=\"it's>two</p><p>three</p></article>", "one two three"),
        ("<article><p>one</p><p title='it>two</p><p>three</p></article>", "one two three"),
        ("<p class=a\"b>it's</p><p title = \"x>y\" id='z'>two</p>", "it's two"),
        ("<p>one</p><a href='x", "one"),
        ("<p>one</p><!doctype", "one"),
        ("<p>one<!-- > no", "one"),
        ("<script>no</script <p>yes", "yes"),
        ("<p>a</p></div></p><div>b</section></div>c", "a b c"),
        ("<article><p>a</p><div class='discussion'>b</div><div class='legal'>c</div><div class='share'>no</div></article>", "a b c"),
    ],
)
def test_main_text(page, want):
    assert text(page) == want


def test_shared_open_lines_are_deleted_and_article_lines_are_not(spark):
    def page(i, body, path="/a/"):
        return (i, f"http://H.com{path}{i}?q={i}", f"<div>Menu home</div><div>{body}</div><div>All rights {i // 2}</div>")

    rows = [page(10, "first"), page(11, "second"), page(12, "third &lt;b&gt;", "/b/"), (20, "http://x.org/", "<p>alone</p>"), (21, None, None), (22, "zzz", ""), page(10, "first")]
    rows += [(30 + k, f"http://art.org/{k}", f"<nav>n</nav><article><p>the same line</p><p>own {k}</p></article>") for k in range(3)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    got = sorted((r.page_id, r.text, r.n_chars) for r in p.extracted(docs).collect())
    want = [(10, "first"), (10, "first"), (11, "second"), (12, "third <b> All rights 6"), (20, "alone"), (21, ""), (22, "")] + [(30 + k, f"the same line own {k}") for k in range(3)]
    assert got == [(i, t, len(t)) for i, t in want]


def nearest(rows):
    """For each page its neighbour in the order of host, path and key, with the longer common path."""
    out = {}
    for k, (host, path, key) in enumerate(rows):
        near = [rows[j] for j in (k - 1, k + 1) if 0 <= j < len(rows) and rows[j][0] == host]
        common = [next((n for n, (a, b) in enumerate(zip(path + "\0", x[1] + "\1")) if a != b), 0) for x in near]
        if near:
            out[key] = near[max(range(len(near)), key=lambda i: (common[i], -i))][2]
    return out


def test_pairs_as_brute_force(spark):
    rnd = random.Random(8)
    pages = [(k, f"http://h{rnd.randint(0, 2)}.com/{rnd.choice('ab')}/{rnd.randint(0, 99)}", "".join(f"<p>{rnd.choice('abcde')}</p>" for _ in range(rnd.randint(0, 9)))) for k in range(120)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    keyed = {r.key: r for r in df.select("page_id", "url", "html", p._key().alias("key")).collect()}
    ordered = sorted((r.url.split("/")[2], "/" + r.url.split("/", 3)[3], key) for key, r in keyed.items())
    near = nearest(ordered)
    got = {r.key: r.shared for r in p.shared_with_nearest(df.repartition(5)).collect()}
    assert got.keys() == keyed.keys()
    for key, shared in got.items():
        lines = [t for _, t in p.lines(keyed[key].html)]
        other = [t for _, t in p.lines(keyed[near[key]].html)] if key in near else []
        assert len(shared) == longest(lines, other)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        want[r.page_id] = " ".join(" ".join(html.unescape(x) for x in blocks).split())
    got = p.extracted(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got) and p.extracted(pages.limit(0)).count() == 0


def body(k, n=8):
    return "".join(f"<p>Paragraph {j} of story {k} with words of its own {'xyz'[j % 3] * (k % 7 + 3)}</p>" for j in range(n))


def unmarked(k, inner, path, host="u.com"):
    return (k, f"http://{host}{path}", f"<div>Menu home</div>{inner}<div>All rights</div>")


def plain(inner):
    return " ".join(t for _, t in p.lines(inner))


def test_copies_of_unmarked_pages_keep_their_text(spark):
    near = body(2).replace("Paragraph 3", "Section 3")
    rows = [unmarked(1, body(1), "/a"), unmarked(2, body(2), "/x"), unmarked(3, body(2), "/x?utm_source=feed"), unmarked(4, body(2), "/x/amp"), unmarked(5, near, "/xa"), unmarked(6, body(6), "/z")]
    rows += [unmarked(7, body(7), "/only", "v.com"), unmarked(8, body(7), "/only?a=1", "v.com")]
    got = {r.page_id: r.text for r in p.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = {1: body(1), 2: body(2), 3: body(2), 4: body(2), 5: near, 6: body(6)}
    assert {k: got[k] for k in want} == {k: plain(v) for k, v in want.items()}
    assert got[7] == got[8] == f"Menu home {plain(body(7))} All rights"


def test_long_run_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(p, "PIECE", 7)
    rows = [unmarked(0, body(1), "/a")] + [unmarked(k, body(2) + f"<p>{k}</p>", f"/x{k:03}") for k in range(1, 40)]
    got = {r.page_id: r.text for r in p.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {0: plain(body(1))} | {k: f"{plain(body(2))} {k}" for k in range(1, 40)}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<main><p>a long body of the page</p><p>and more of it</p><article class=teaser>short</article></main>", "a long body of the page and more of it"),
        ("<main>On <article><p>a long article of the page</p></article></main>", "a long article of the page"),
        ("<p>out</p><article class='post category-legal'>yes</article>", "yes"),
        ("<p>out</p><article class='tag-cookies format-social category-forms'><p>yes</p></article>", "yes"),
        ("<p>out</p><div role=article class='post social'>yes</div>", "yes"),
        ("<p>out</p><main class='site-main no-menu tag-legal'>yes</main>", "yes"),
        ("<p>out</p><article class='comment odd'>no</article><article hidden>no</article>", "out"),
    ],
)
def test_the_longer_of_article_and_main_whatever_its_class(page, want):
    assert text(page) == want


def test_long_pages_take_linear_time():
    import time

    pages = ["<a " * 350_000, "<a b='" * 170_000, "<p>x</p>" + "<a b=\"" * 150_000 + ">y", "<!" * 500_000, "<!--" * 250_000, "<div>" * 120_000 + "</section>" * 60_000 + "end", "<script>" + "</script " * 110_000, "<p " + "a" * 1_000_000 + " b=c>x</p>", "<p " + "a " * 500_000 + "b=c>x</p>", "& " * 500_000, "< " * 500_000]
    for page in pages:
        began = time.perf_counter()
        p.lines(page)
        assert time.perf_counter() - began < 3, page[:20]


@pytest.mark.parametrize("given", ["class='form-factor'", "class='formFactor'", "class=notice-period", "id='social-history'", "class='related-work'", "class='lunch-menu'", "class='verb-forms'", "class='share-price'", "class='ad-hoc'", "class='promo-code-law'", "class='tag-comments'", "class='chapter'"])
@pytest.mark.parametrize("element", ["div", "section", "article"])
def test_class_words_within_other_names_leave_an_articles_text(given, element):
    assert text(f"<article><p>a</p><{element} {given}><p>size of the phone</p></{element}><p>b</p></article>") == "a size of the phone b"


def test_parts_of_articles_that_are_no_comments():
    assert text("<article><p>a</p><fieldset><legend>L</legend>b</fieldset><article><p>c</p></article></article>") == "a L b c"
    assert text("<div class='content widget-area'><p>body text</p></div>") == "body text"
    assert text("<form><fieldset>no</fieldset></form><div class='story-body lower-sidebar'>yes</div>") == "yes"


@pytest.mark.parametrize("given", ["class=ad", "class='ad-300'", "class=inline-ads", "id=adBox", "class='x comments-area'", "class=reader-comments", "id=disqus-thread-comments", "class=related-posts", "class='share-buttons'", "class=socialLinks", "class='newsletter-box'", "class='email-newsletter'", "class=cookie-notice", "class=sidebar", "class='post-nav'", "class='comment-form'", "class='menu'", "class='ad-container'"])
def test_names_of_what_is_no_article_are_marks_inside_one(given):
    page = f"<article><p>a</p><div {given}><p>no</p><article class=chapter>no</article></div><p>b</p></article>"
    assert text(page) == "a b"


@pytest.mark.parametrize("given", ["class=footer-legalese", "class='site-footer'", "id='main-menu'", "class=sidebar-xyz", "class='top-banner'", "class='weather-widget'", "class=nav-foo", "class='menu-item-42'", "id=commentsWrapper"])
def test_names_of_what_is_no_article_are_marks_outside(given):
    assert text(f"<p>a</p><div {given}><p>no</p></div><p>b</p>") == "a b"
