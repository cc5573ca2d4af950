import re

from quillspark.llm import link_graph as g

URLS = [
    "http://a.com/en/1", "https://x.example.com/en/7", "https://x.example.com/en/70#t", "HTTP://A.Net/de/8?q", "https://b.example.net/de/81", "https://example.net/de/7", "x://org/es/", "ftp://u@Ä.ORG/es/é?x://y", "nothing", None, "",
    "http://", "://com/en/", "http://com?/en/", "http://com#/en/", "http://notcom/en/", "http://c.com/EN/1", "http://q.org/fr?a://b.com/en/", "a://b://c.com/en/",
]
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(k, u, None, "x") for k, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in g.judged(pages).collect()}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        host, path = parts(u)
        rule, verdict = ruled(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert verdict is None or got[k].verdict == verdict


def rank(edges, seeds):
    """Power iteration over a dictionary, long enough to settle."""
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    r = dict(seeds)
    for _ in range(200):
        new = {}
        for (a, b), n in edges.items():
            new[b] = new.get(b, 0) + g.DAMPING * n / out[a] * r.get(a, 0)
        back = 1 - sum(new.values())
        r = {h: new.get(h, 0) + back * seeds.get(h, 0) for h in {*new, *seeds}}
    return r


def test_verdicts_follow_links(spark):
    hosts = ["a.com", "b.org", "c.io", "d.io", "e.net", "f.net", "g.io", "h.io"]
    links = [(0, 2), (1, 2), (2, 3), (3, 3), (4, 6), (6, 5), (7, 0), (5, 7), (2, 6), (6, 2)]
    paths = {0: "/en/1", 1: "/es/2", 4: "/de/3", 5: "/de/1"}
    rows, edges = [], {}
    for k, h in enumerate(hosts):
        html = "".join(f'<a class=x href="{"" if b % 2 else "https:"}//{hosts[b].upper()}/z">t</a>' for a, b in links if a == k) + "<a href='/local'>l</a><a href=http://a.com>"[: 23 if k else 0]
        rows.append((k, f"http://{h}{paths.get(k, '/q')}", html))
    for a, b in links:
        if a != b:
            edges[hosts[a], hosts[b]] = edges.get((hosts[a], hosts[b]), 0) + 1
    verdicts = {k: ruled(*parts(u))[1] for k, u, _ in rows}
    seeds = {v: [hosts[k] for k in verdicts if verdicts[k] == v] for v in ("allow", "block")}
    trust = rank(edges, {h: 1 / len(seeds["allow"]) for h in seeds["allow"]})
    distrust = rank({(b, a): n for (a, b), n in edges.items()}, {h: 1 / len(seeds["block"]) for h in seeds["block"]})
    got = {r.page_id: r.verdict for r in g.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, h in enumerate(hosts):
        t, d = trust.get(h, 0), distrust.get(h, 0)
        want = verdicts[k] or ("block" if d > 0 and d >= 0.5 * (t + d) else "allow")
        assert got[k] == want, (h, t, d)
    assert {"allow", "block"} == set(got.values())


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert g.judged(none).count() == 0
    twice = spark.createDataFrame([(1, "http://a.com/en/", "")] * 2 + [(2, "http://a.com/fr/", "")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.verdict) for r in g.judged(twice).collect()) == [(1, "block"), (1, "block"), (2, "block")]


def chained(n, bad):
    """Pages of n hosts, each linking to the next; the last links to a blocked page."""
    hosts = [f"h{k}.io" for k in range(n)] + [bad]
    return [(k, f"http://{h}/q", f'<a href="http://{hosts[k + 1]}/">t</a>') for k, h in enumerate(hosts[:-1])] + [(n, f"http://{bad}/en/1", "")]


def test_long_chain_is_blocked_to_its_end(spark):
    rows = chained(36, "bad.com") + [(99, "http://good.net/de/1", '<a href="http://fine.io/">t</a>'), (100, "http://fine.io/q", "")]
    got = {r.page_id: r.verdict for r in g.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [k for k in range(37) if got[k] != "block"] == []
    assert got[99] == got[100] == "allow"


def test_chain_counts_among_many_seeds(spark):
    rows = chained(4, "bad.com") + [(100 + k, f"http://s{k}.com/en/{k}", "") for k in range(30_000)]
    got = {r.page_id: r.verdict for r in g.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id < 100").collect()}
    assert set(got.values()) == {"block"} and len(got) == 5


def test_rank_too_small_for_a_double_still_counts(spark):
    links = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(3)] + [(f"h{k}", "x", 10**18) for k in range(3)], "source string, target string, n long")
    ranks = {r.host: r["rank"] for r in g.personalised_rank(links, spark.createDataFrame([("h0", 1e-280), ("y", 1.0)], "host string, weight double")).collect()}
    assert set(ranks) == {"h0", "h1", "h2", "h3", "x", "y"} and min(ranks.values()) > 0


def test_tags_that_never_end_are_read_once(spark):
    import time

    from quillspark.llm import link_graph

    html = "<a " * 350_000 + '<a class="x" HREF = "https://far.example/p">' + "href" * 50_000 + " " * 200_000
    pages = spark.createDataFrame([(1, "http://near.example/", html)], "page_id long, url string, html string")
    link_graph.host_links(pages.where("page_id = 0")).count()
    began = time.perf_counter()
    got = link_graph.host_links(pages).collect()
    assert len(got) == 1 and "far.example" in str(got[0]) and time.perf_counter() - began < 10
