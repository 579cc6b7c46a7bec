"""URL filters: longest rule first, then trust and distrust carried over links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, names_apart, others, stored, table

#: (host, path, verdict) of the contract.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LINK = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """pages with host, path, rule (host and path of the longest rule that fits, or null) and _by_rule.

    The rules are a parameter, so they stand in the plan: the longest are tried first.
    """
    made = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return made.withColumns({"rule": rule, "_by_rule": verdict})


def links_between(pages: DataFrame) -> DataFrame:
    """(src, dst), distinct, for links of pages to other hosts."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), ascii_lower))
    links = pages.select(F.col("host").alias("src"), F.explode(found).alias("dst"))
    return links.filter("src <> dst and src <> ''").distinct()


def pagerank(
    seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, max_rounds: int = 400, rounds_per_job: int = 5
) -> DataFrame:
    """(host, rank): PageRank of edges (src, dst) that restarts at the seeds (host, seed), in their proportion.

    The ranks sum to 1. Hosts without links restart too: what they would pass on goes back to the
    seeds in their proportion, which only scales all ranks alike, so it is left out of the rounds and the ranks are
    scaled at the end. Hosts that get nothing are left out, and without seeds there are no rows.

    Ends when the rounds of a job change the ranks by less than tolerance of their sum, and raises if none does within
    max_rounds; a round shrinks the change by the damping at least, so about 100 do for the defaults. Some rounds make a
    job, whose ranks are written to the shared folder; links meet ranks by host and sums are pre-aggregated.
    """
    total = seeds.agg(F.sum("seed")).first()[0]
    if not total:
        return seeds.select("host", F.col("seed").cast("double").alias("rank")).limit(0)
    start = stored(seeds.filter("seed > 0").select("host", F.col("seed").cast("double").alias("seed")), "seeds")
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    weighted = stored(edges.join(degrees, "src").select("src", "dst", (F.lit(damping) / F.col("degree")).alias("share")), "links")
    now, before = stored(start.select("host", F.col("seed").alias("rank")), "ranks"), float(total)
    for _ in range(0, max_rounds, rounds_per_job):
        ranks = now
        for _ in range(rounds_per_job):
            flow = ranks.join(weighted, F.col("host") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
            met = start.join(flow.withColumnRenamed("dst", "host"), "host", "full")
            ranks = met.select("host", (F.coalesce("seed", F.lit(0.0)) + F.coalesce("flow", F.lit(0.0))).alias("rank"))
        after = stored(ranks, "ranks")
        dropped(now)
        now = after
        # each rank only grows from round to round, so the sums tell how much all have changed
        reached = now.agg(F.sum("rank")).first()[0]
        change, before = reached - before, reached
        if change < tolerance * reached:
            return now.select("host", (F.col("rank") / reached).alias("rank"))
    raise RuntimeError(f"ranks not settled in {max_rounds} rounds")


@names_apart
def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, majority: float = 0.5) -> DataFrame:
    """pages (page_id, url, html, ...) without html, with host, path, rule, verdict, trust and distrust.

    Where a rule fits, the verdict is its own. Else the host decides: of the urls of a host that a rule fits, if most
    are allowed it is a trusted seed, if most are blocked a blocked seed, weighing as many as it has
    such urls. Trust flows along links from the trusted seeds; distrust flows against links from the blocked ones,
    to those that link to them. Both are in urls: they sum to the weight of their seeds, so neither gains by the number
    of the other's seeds. A host with more distrust than trust is blocked, any other allowed.

    Null urls and urls without :// have an empty host and path, which no rule fits and no link reaches, and are allowed;
    null html has no links; repeated rows count again and are judged alike; columns of pages with the new names
    are replaced; an empty table gives an empty one. Only hosts and pairs of hosts are shuffled, counted
    before they meet.
    """
    new = ("html", "host", "path", "rule", "verdict", "trust", "distrust")
    kept = others(pages, new)
    known = ruled(pages.select(*kept, F.col("html").alias("html") if "html" in pages.columns else F.lit(None).cast("string").alias("html")), rules)
    count = lambda what: F.count(F.when(F.col("_by_rule") == what, 1))
    hosts = known.filter("host <> ''").groupBy("host").agg(count("allow").alias("a"), count("block").alias("b"))
    hosts = stored(hosts, "hosts")
    edges = stored(links_between(known), "edges")

    def flowed(seed: str, links: DataFrame) -> DataFrame:
        seeds = hosts.select("host", F.when(F.col(seed) > (F.col("a") + F.col("b")) * majority, F.col(seed)).otherwise(0).alias("seed"))
        weight = seeds.agg(F.sum("seed")).first()[0] or 0
        return pagerank(seeds, links).withColumn("rank", F.col("rank") * float(weight))

    trust = flowed("a", edges)
    distrust = flowed("b", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    scores = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full")
    met = known.select(*kept, "host", "path", "rule", "_by_rule").join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("_by_rule", F.when(distrust > trust, "block").otherwise("allow"))
    return met.select(*kept, "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
