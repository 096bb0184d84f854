"""Operator 2, URL filters: rules, then link-graph propagation per host.

Rules judge a page first: a rule fits its host and all subdomains when the
url's path starts with the rule's path; the longest rule wins. Pages without a
rule get their host's verdict from the link graph: personalised PageRank runs
from trusted hosts along the links, and distrust from blocked hosts against
them (who links to a blocked host is suspect). A host is a seed when most of
its pages were allowed or blocked by rules. It is blocked when its distrust is
at least ``threshold`` of both scores together; a host that neither reaches is
allowed.

Edges between hosts are absolute and protocol-relative ``href`` links (relative
ones stay on the host and are no edges), and a host and its parent domain where
both have pages (each vouches for the other). Every host spreads its score
evenly over its distinct edges.

Only DataFrame functions are used. Scale: html is read once for links and never
shuffled; edges are distinct host pairs, aggregated before the shuffle; the
iterations carry host-sized tables, cut every few rounds. The pages meet the
host verdicts in an equi-join on host that AQE splits for a hot host.

Edge cases: a null url, or one without ``://``, has an empty host and path, no
rule, and is allowed; null html has no links; repeated pages are judged each;
rules of equal length for one page cannot differ in host and path, of equal
rules block wins; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table

#: Fixed values of the contract: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ROUNDS = 10
DAMPING = 0.85
THRESHOLD = 0.5
#: Hosts at least half of whose pages the rules judge alike are seeds.
SEED_SHARE = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"(?i)href\s*=\s*[\"']((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]*)"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))


def host_of(rest: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(rest: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and ruling (both null without a fitting rule)."""
    out = (pages.withColumn("_rest", rest_of(F.col("url"))).withColumn("host", host_of(F.col("_rest")))
           .withColumn("path", path_of(F.col("_rest"))).drop("_rest"))
    rule = ruling = None
    # longest first; at one length block first
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block")):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        ruling = F.when(fits, verdict) if ruling is None else ruling.when(fits, verdict)
    return out.withColumn("rule", rule).withColumn("ruling", ruling)


def host_edges(judged: DataFrame) -> DataFrame:
    """(src, dst): distinct links between different hosts that have pages."""
    hosts = judged.select("host").filter("host <> ''").distinct()
    links = (judged.filter("host <> '' AND html IS NOT NULL")
             .select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), 1))).alias("href"))
             .select("src", host_of(F.expr("substring(href, instr(href, '//') + 2)")).alias("dst")))
    up = hosts.select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst")).filter("src <> dst AND instr(src, '.') > 0")
    both = (links.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            .filter("src <> dst").distinct())
    for side in ("src", "dst"):
        both = both.join(hosts.withColumnRenamed("host", side), side, "left_semi")
    return both


def scores(judged: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, seed_share: float = SEED_SHARE) -> DataFrame:
    """(host, trust, distrust) after the propagation."""
    by_host = judged.filter("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("ruling") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
        F.avg(F.when(F.col("ruling") == "block", 1.0).otherwise(0.0)).alias("blocked"))
    seeds = write_table(by_host.select("host", F.when(F.col("allowed") > seed_share, 1.0).otherwise(0.0).alias("t0"),
                                       F.when(F.col("blocked") > seed_share, 1.0).otherwise(0.0).alias("d0")), "hosts")
    edges = write_table(host_edges(judged), "host-edges")
    # trust follows the links, distrust goes against them
    way = edges.select("src", "dst", F.lit("t").alias("kind")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("d").alias("kind")))
    out_degree = way.groupBy("src", "kind").agg(F.count("*").alias("deg"))
    way = write_table(way.join(out_degree, ["src", "kind"]), "host-ways")
    rank = seeds.select("host", "t0", "d0", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    for i in range(rounds):
        gone = (way.join(rank.select(F.col("host").alias("src"), "trust", "distrust"), "src")
                .withColumn("part", F.when(F.col("kind") == "t", F.col("trust")).otherwise(F.col("distrust")) / F.col("deg"))
                .groupBy("dst").agg(F.sum(F.when(F.col("kind") == "t", F.col("part")).otherwise(0.0)).alias("tin"),
                                    F.sum(F.when(F.col("kind") == "d", F.col("part")).otherwise(0.0)).alias("din")))
        rank = (seeds.join(gone, seeds["host"] == gone["dst"], "left")
                .select("host", "t0", "d0", (F.lit(1 - damping) * F.col("t0") + F.lit(damping) * F.coalesce("tin", F.lit(0.0))).alias("trust"),
                        (F.lit(1 - damping) * F.col("d0") + F.lit(damping) * F.coalesce("din", F.lit(0.0))).alias("distrust")))
        if i % 3 == 2:
            rank = write_table(rank, "host-rank")
    return rank.select("host", "trust", "distrust")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES,
          threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust)."""
    judged = ruled(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), rules)
    rank = write_table(scores(judged), "host-scores").withColumnRenamed("host", "_host")
    doubt = (F.col("distrust") > 0) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    return (judged.select("page_id", "host", "path", "rule", "ruling").join(rank, F.col("host") == F.col("_host"), "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruling", F.when(doubt, "block"), F.lit("allow")).alias("verdict"),
                    F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
