"""URL filters: a list of rules, and link-graph propagation where no rule fits.

Every host has a share of pages that the rules allow and a share that they block.
These are the seeds of two personalised PageRanks over host edges: trust flows along
the links, distrust against them, to those that link to blocked hosts.  Masses get
small where many share them, so a host's score is the share of the mass it receives
that is the seeds': a host that links to blocked hosts only is one of them, however
many others link there too.  A host's own shares stay its own word, however it is
linked; for the rest of its pages the received share speaks.  A page without a rule is
blocked if its host's distrust exceeds its trust by ``THRESHOLD``.  Without edges a
host keeps its shares.

Pages are reduced to weighted host edges and to counts of a host before anything is
shuffled (partial aggregation), so a host with a third of all pages is one row; an
iteration is a join of edges and ranks and a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import keep

DAMPING, ITERATIONS, THRESHOLD = 0.85, 20, 0.5
#: iterations between checkpoints
STRIDE = 5
#: decimals of a score
DECIMALS = 9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host and path of a URL, after its first ://
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: a link to a host: absolute, or without its scheme
LINK = r"""(?i)href[ \t\r\n\f]*=[ \t\r\n\f]*["']?((?:[a-z][a-z0-9+.\-]*:)?//[^"' \t\r\n\f>]+)"""


def host_of(url: Column) -> Column:
    """A-Z lower-cased; empty for a null URL and one without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def longest_first(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null.  ``rules``: (host, path,
    verdict); a rule fits its host and all subdomains where the path starts with its."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(longest_first(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, w): links between different hosts, counted."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(
        F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return links.select("src", host_of(full).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy(
        "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """Personalised PageRanks on the host graph.  ``seeds`` (host, trust, distrust: shares of its
    pages), ``edges`` (src, dst, w) -> kind (trust: along the links, distrust: against them),
    host, got, of: what a host receives in the last step of the seeds' mass, and of all mass.
    Hosts that receive none have no row.

    All mass u is a PageRank that starts at all hosts alike.  Of the mass at a seed, its share is
    the seed's, and the rest keeps what it brings: r = share * u + damping * open * got, with
    ``open`` the share of pages that no rule speaks of.  Mass is split among a host's edges by
    weight; that of a host without edges stays unused, as only ratios of got to of count.
    """
    flow = edges.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    out = flow.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    share = keep(flow.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("all")).alias("w")))
    hosts = seeds.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(
        edges.select(F.col("dst").alias("host"))).distinct()
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    seed = keep(hosts.join(seeds, "host", "left").select(
        "host", F.greatest(F.lit(0.0), 1 - trust - distrust).alias("open"),
        F.explode(F.create_map(F.lit("trust"), trust, F.lit("distrust"), distrust)).alias("kind", "seed")))
    rank = seed.select("kind", F.col("host").alias("src"), F.col("seed").alias("r"), F.lit(1.0).alias("u"))
    for step in range(1, iterations + 1):
        moved = share.join(rank, ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(
            F.sum(F.col("w") * F.col("r")).alias("got"), F.sum(F.col("w") * F.col("u")).alias("of"))
        if step == iterations:
            return moved
        u = 1 - damping + damping * F.coalesce("of", F.lit(0.0))
        rank = seed.join(moved, ["kind", "host"], "left").select("kind", F.col("host").alias("src"), (
            F.col("seed") * u + damping * F.col("open") * F.coalesce("got", F.lit(0.0))).alias("r"), u.alias("u"))
        if step % STRIDE == 0:
            rank = keep(rank)
    raise ValueError("propagation needs a step at least")


def host_scores(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """``seeds`` (host, trust, distrust: shares of its pages), ``edges`` (src, dst, w) -> (host,
    trust, distrust) from 0 to 1, for every host of either table: its own shares, and for the
    rest of its pages the share of the PageRank mass it receives that is the seeds'."""
    def known(c):
        return F.coalesce(c, F.lit(0.0))

    if edges.isEmpty():
        return seeds.select("host", F.round("trust", DECIMALS).alias("trust"), F.round("distrust", DECIMALS).alias("distrust"))
    got = propagate(seeds, edges, damping, iterations).groupBy("host").agg(*(
        F.max(F.when(F.col("kind") == k, F.col("got") / F.col("of"))).alias(f"{k}_got") for k in ("trust", "distrust")))
    both = seeds.join(keep(got), "host", "full")
    rest = F.greatest(F.lit(0.0), 1 - known("trust") - known("distrust"))
    return both.select("host", *(F.round(known(k) + rest * known(f"{k}_got"), DECIMALS).alias(k) for k in ("trust", "distrust")))


def judge(pages: DataFrame, rules, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """A row per row of ``pages``: page_id, host, path, rule (or null), verdict.

    A null URL and one without :// have an empty host and path, no rule, and are
    allowed, as nothing is known against them.  A null html has no links.  Repeated
    rows count each; null ids have rows; other columns are not read; an empty table
    has no rows.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))

    def part(v):
        return F.avg(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))

    seeds = ruled.where("host <> ''").groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"))
    scores = host_scores(keep(seeds), keep(host_edges(pages, url_col, html_col)))
    bad = scores.where(F.col("distrust") - F.col("trust") >= threshold).select("host", F.lit("block").alias("by_host"))
    return ruled.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce(
        "by_rule", "by_host", F.lit("allow")).alias("verdict"))
