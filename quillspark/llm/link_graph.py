"""URL filters: rules on host and path, and personalised PageRank over host links for every other URL.

Trust starts at hosts in proportion to their pages that a rule allows and follows links; distrust starts
at hosts in proportion to pages that a rule blocks and goes against links. A host whose
distrust is at least ``threshold`` of both is blocked.

Links are summed per pair of hosts before they are shuffled, and so are the shares that a host
receives, so a hub needs no room of its own. Rounds end when none reaches a new host and no host's rank
grows by more than TOLERANCE of itself, however small it is and however many rounds it takes; each is checkpointed.

Defined results: null urls, and urls without ``://``, have an empty host and path; no host, no links; a host without trust
and distrust is allowed; links inside a host don't count; repeated pages count again as seeds and links and stay in the result;
html may be null; extra columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut

DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5
LEAST = 1e-290  # what a host gets at least when it is first reached, so that no walk is too long or too widely shared to count
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags first, then what is in them: each is read once, however many tags never end.
TAG, LINK = r"(?i)<a\s[^<>]*+", r"""(?i)href\s*+=\s*+["']?\s*+((?:https?:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules that the query's contract names.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From after the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """source, target, n: absolute links between different hosts."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TAG), F.lit(0))
    to = F.explode(F.filter(F.transform(tags, lambda tag: F.regexp_extract(tag, LINK, 1)), lambda link: link != ""))
    links = pages.select(host_of(F.col("url")).alias("source"), to.alias("to"))
    target = host_of(F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to")))
    links = links.select("source", target.alias("target")).where("source <> target and source <> '' and target <> ''")
    return links.groupBy("source", "target").agg(F.count("*").alias("n"))


def personalised_rank(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, rank: PageRank that restarts at the seeds (host, weight), whose weights sum to 1. What dangling hosts hold restarts too.

    Ranks are the shares of a sum over walks from the seeds, one step longer each round: ``came`` is what the last round added to a host.
    """
    out = links.groupBy("source").agg(F.sum("n").alias("all"))
    shares = cut(links.join(out, "source").select("source", "target", (F.col("n") / F.col("all")).alias("share")))
    ranks = cut(seeds.select("host", F.col("weight").alias("rank"), F.col("weight").alias("came")))
    largest = 1.0
    while largest >= TOLERANCE:  # of a host that is reached for the first time it is 1
        moving = ranks.where("came > 0")
        sent = shares.join(moving, shares.source == moving.host).groupBy(F.col("target").alias("host")).agg(F.sum(DAMPING * F.col("share") * F.col("came")).alias("sent"))
        came = F.when(F.col("rank").isNull(), F.greatest("sent", F.lit(LEAST))).otherwise(F.coalesce("sent", F.lit(0.0)))
        ranks = cut(ranks.drop("came").join(sent, "host", "full").select("host", (F.coalesce("rank", F.lit(0.0)) + came).alias("rank"), came.alias("came")))
        largest = ranks.agg(F.max(F.col("came") / F.col("rank"))).first()[0] or 0.0
    total = ranks.agg(F.sum("rank")).first()[0]
    return ranks.select("host", (F.col("rank") / F.lit(total or 1.0)).alias("rank"))


def blocked_hosts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """host of those that distrust outweighs."""
    ruled = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = ruled.select("host", rule_of(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict")).where("verdict is not null")
    counts = cut(ruled.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block")))
    total = counts.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    links = cut(host_links(pages))
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")
    trust = personalised_rank(links, counts.where("allow > 0").select("host", (F.col("allow") / (total["allow"] or 1)).alias("weight")))
    distrust = personalised_rank(back, counts.where("block > 0").select("host", (F.col("block") / (total["block"] or 1)).alias("weight")))
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full").na.fill(0.0, ["trust", "distrust"])
    return cut(both.where((F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))).select("host"))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    blocked = blocked_hosts(pages, rules).withColumn("bad", F.lit(True))
    small = blocked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = urls.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).join(F.broadcast(blocked) if small else blocked, "host", "left")
    method = F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", method).alias("verdict"))
