"""URL verdicts from host and path rules, and from trust and distrust spread over host links.

A rule fits its host and all its subdomains where the path starts with the rule's path; the longest
one decides. Pages without a rule get their host's verdict: trust is a personalised PageRank from
hosts with explicitly allowed pages along host edges, distrust one from hosts with explicitly
blocked pages along the reversed edges. A host's pages without a rule count as neutral mass that
stays where it is. A host is blocked where distrust makes up more than ``threshold`` of all three. Host edges are the pages' absolute links, and parent-child domain pairs of
which both are hosts of the crawl. Pages are aggregated to hosts first; ranks live in DataFrames.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is
allowed by the method; a null html has no links; hosts out of reach of any seed are allowed;
repeated rows and null ids get verdicts like any others; a page of any length counts each linked host
once; an empty table gives an empty result; other columns are not read. A host with a large share of
all links or pages is one key of two joins; both sides are aggregated first, and where they are too
large to be broadcast, adaptive execution splits such a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.sources.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    """``host`` with its subdomains, paths that start with ``path``; verdict allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines like ``block com/en/``, longest first."""
    rules = []
    for line in lines:
        verdict, place = line.split(" ", 1)
        host, slash, path = place.partition("/")
        if verdict not in ("allow", "block"):
            raise ValueError(f"no verdict in {line!r}")
        rules.append(Rule(host.lower(), slash + path, verdict))
    return sorted(rules, key=lambda r: (-len(r.name), r.name))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(_after_scheme(url, r"^([^/?#]*)"), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return _after_scheme(url, r"^[^/?#]*([^?#]*)")


def _after_scheme(url: Column, pattern: str) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), pattern, 1)), F.lit(""))


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, weight) without loops: linked hosts, and domains with their subdomains."""
    host = url_host(F.col(url_col))
    links = pages.where(F.col(html_col).isNotNull()).select(host.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    hosts = pages.select(host.alias("child")).distinct()
    family = hosts.select("child", F.regexp_replace("child", r"^[^.]*\.", "").alias("parent"))
    family = family.join(hosts.select(F.col("child").alias("parent")), "parent").where("parent <> child and parent <> ''")
    both = family.select(F.col("child").alias("src"), F.col("parent").alias("dst")).unionByName(family.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    return links.unionByName(both).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12, cut_every: int = 4) -> DataFrame:
    """(kind, host, rank): personalised PageRank per kind from ``seeds`` (kind, host, mass) along ``edges`` (kind, src, dst, weight).

    Mass at hosts without outgoing edges stays out of circulation.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all_out"))
    steps = written(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("all_out")).alias("share")), "host-steps")
    restart = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("rank"))
    ranks = restart
    for turn in range(rounds):
        moved = steps.join(ranks.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        ranks = moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if turn % cut_every == cut_every - 1 and turn + 1 < rounds:
            ranks = written(ranks, "host-ranks")
    return ranks


def judge_pages(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5) -> DataFrame:
    """One row per page: id, host, path, rule and verdict."""
    placed = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    ruled = placed.withColumns({"rule": rule, "by_rule": verdict})

    kind = F.when(F.col("by_rule") == "allow", "trust").when(F.col("by_rule") == "block", "distrust").otherwise("neutral")
    seeds = ruled.groupBy(kind.alias("kind"), "host").agg(F.count("*").cast("double").alias("mass"))
    seeds = written(seeds, "host-seeds")
    edges = written(host_edges(pages, url_col, html_col), "host-edges")
    forward = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    ranks = spread(forward.unionByName(backward), seeds)
    sums = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"), F.sum("rank").alias("all"))
    blocked = written(sums.where(F.round(F.col("distrust") - threshold * F.col("all"), 9) > 0).select("host", F.lit("block").alias("by_method")), "blocked-hosts")
    judged = ruled.join(blocked, "host", "left")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("by_rule", "by_method", F.lit("allow")).alias("verdict"))
