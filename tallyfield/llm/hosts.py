"""URL filtering by rules, and by trust and distrust that spread over the links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import table
from tallyfield.llm.registry import query
from tallyfield.session import pinned

#: Verdict, host and path prefix of each rule.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: The rank that a further round could still move, over all hosts together, is at most ``TOLERANCE``.
DAMPING, TOLERANCE, CUT_EVERY = 0.85, 1e-4, 6
#: A host with more than 1 of so many pages is looked up in a broadcast list, which has fewer hosts than this.
HOT_SHARE = 256
#: A host is blocked if its distrust exceeds its trust by this factor.
FACTOR = 2.0


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), or null. A rule fits its host and the host's subdomains, and paths that start with its path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judged(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict by the rules alone."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", rule["rule"].alias("rule"), rule["verdict"].alias("verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): absolute links between different hosts, counted per pair, and one edge each way between a host and the next domain above it
    that has pages itself (www.a.com and a.com)."""
    host = host_of(F.col("url")).alias("src")
    links = pages.select(host, F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([a-z]+:)?(//[^\s\"'>]+)"), F.lit(2))).alias("link"))
    links = links.select("src", host_of(F.concat(F.lit(":"), "link")).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select(host).where("src <> ''").distinct()
    above = hosts.select("src", F.regexp_extract("src", r"^[^.]+\.(.+)$", 1).alias("dst")).where("dst like '%.%'").join(hosts.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    family = above.union(above.select("dst", "src")).select("src", "dst", F.lit(1).cast("long").alias("n"))
    return links.union(family).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust). Trust is a personalised PageRank from the trusted seeds along the links, distrust one from the blocked seeds against
    them. ``seeds`` is (host, kind, weight) with kind trust or distrust; all weights together are brought to a sum of 1, so the two ranks can be
    compared. Both run in one join a round; rank that reaches a host without out-edges ends there.

    Rounds go on until the ranks have settled: a round shrinks any difference by ``damping`` at least, so the change over the last rounds bounds
    what is still to come."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    steps = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("total")).alias("share"))
    steps = pinned(steps.union(edges.join(into, "dst").select(F.lit("distrust"), "dst", "src", F.col("n") / F.col("total"))))
    total = seeds.agg(F.sum("weight")).first()[0] or 1.0
    start = pinned(seeds.select("kind", "host", (F.col("weight") / total).alias("seed")))
    rank = start.withColumnRenamed("seed", "rank")
    shrunk = damping**CUT_EVERY
    while True:
        before = rank
        for _ in range(CUT_EVERY):
            moved = rank.join(steps, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            rank = moved.union(start.select("kind", "host", F.col("seed") * (1 - damping))).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank = pinned(rank)
        change = rank.union(before.select("kind", "host", -F.col("rank"))).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("change")).agg(F.sum("change")).first()[0]
        if (change or 0.0) * shrunk / (1 - shrunk) <= tolerance:
            break
    return rank.groupBy("host").agg(F.coalesce(F.sum(F.expr("if(kind = 'trust', rank, 0)")), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.expr("if(kind = 'distrust', rank, 0)")), F.lit(0.0)).alias("distrust"))


def looked_up(marked: DataFrame, ranks: DataFrame) -> DataFrame:
    """``marked`` with the trust and distrust of its hosts, null where ``ranks`` has none.

    Hosts with more than 1 of ``HOT_SHARE`` rows, the empty one too, are looked up in a broadcast list; they are fewer than that, so its size is
    bounded. The others are shuffled, and none of them can fill a task.
    """
    total = marked.count()
    often = marked.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > total).select("host")
    hot = pinned(often.join(ranks, "host", "left").select("host", "trust", "distrust"))
    return marked.join(F.broadcast(hot), "host").unionByName(marked.join(F.broadcast(hot.select("host")), "host", "left_anti").join(ranks, "host", "left"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, factor: float = FACTOR) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    A rule decides where one fits. Elsewhere the host is blocked if its distrust exceeds ``factor`` times its trust; hosts that neither reaches
    are allowed. Seeds are the hosts of allowed and blocked pages, weighted by their number. A null url, or one without ``://``, has an empty
    host and path, takes no part in the graph and is allowed. Repeated rows give repeated results; an empty table gives none. Null html has no links.
    """
    pages = pages.select("page_id", "url", "html")
    marked = judged(pages, rules)
    seeds = marked.where("verdict is not null and host <> ''").groupBy(F.expr("if(verdict = 'allow', 'trust', 'distrust')").alias("kind"), "host").agg(F.count("*").cast("double").alias("weight"))
    ranks = propagated(host_edges(pages), pinned(seeds)).where(f"distrust > {factor} * trust")
    known = looked_up(marked, pinned(ranks))
    verdict = F.coalesce("verdict", F.when(F.col("distrust").isNotNull(), "block").otherwise("allow"))
    return known.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


@query("op7_hosts")
def op7_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
