"""URL filtering with redirect equivalence (DataFrame functions only).

A rule is (action, host, path). It fits its host and all subdomains when the url's path
starts with the rule's path; the longest fitting rule wins. Pages that redirect to, or name
as canonical, one another form a component (distributed connected components); a page
without a rule of its own takes its component's: allow if any member is explicitly allowed,
else block if any is explicitly blocked. A page with no rule and no such component is allowed.

Null urls and urls without `://` have empty host and path and fit no rule. Repeated urls are
one node and all get the same verdict; scheme and fragment do not distinguish nodes. Null
html has no links. Relative link targets resolve against the page's host and folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components

Rule = tuple[str, str, str]

#: The registered query's rules.
RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AFTER = r"(?s)\A.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_TO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _AFTER, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """host, path and query; null for what is no absolute url."""
    return F.when(url.contains("://"), F.concat(host_of(url), path_of(url), F.regexp_extract(url, _AFTER, 3)))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, action) of the longest fitting rule; null if none fits."""

    def fits(rule: Rule) -> Column:
        return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])

    def value(rule: Rule) -> Column:
        return F.struct(F.lit(rule[1] + rule[2]).alias("rule"), F.lit(rule[0]).alias("action"))

    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]))
    if not ordered:
        return F.lit(None).cast("struct<rule:string,action:string>")
    chain = F.when(fits(ordered[0]), value(ordered[0]))
    return reduce(lambda c, r: c.when(fits(r), value(r)), ordered[1:], chain)


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) node pairs from canonical links and refresh redirects in the pages' html."""
    tags = F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(0)), lambda t: F.regexp_extract(t, _HREF, 1)),
        F.transform(F.regexp_extract_all("html", F.lit(_META), F.lit(0)), lambda t: F.regexp_extract(t, _TO, 1)),
    )
    found = pages.where(F.col("url").contains("://") & F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b"))
    links = found.select("url", F.explode(tags).alias("to")).where("`to` <> ''")
    to, site = F.col("to"), F.concat(F.lit("x://"), host_of(F.col("url")))
    folder = F.regexp_extract(path_of(F.col("url")), r"(?s)^(.*/)", 1)
    target = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat(F.lit("x:"), to))
        .when(to.startswith("/"), F.concat(site, to))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )
    return links.select(node_of(F.col("url")).alias("a"), node_of(target).alias("b")).where("a <> b")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = tuple(RULES), redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every row of pages(page_id, url, html).

    redirects: further (from_url, to_url) rows, such as a crawler's redirect log.
    """
    pages = pages.select("page_id", "url", "html")
    edges = link_edges(pages)
    if redirects is not None:
        more = redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
        edges = edges.union(more.where("a <> b"))
    members = connected_components(edges)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    action = rule_of(host_of(as_url), path_of(as_url), rules)["action"]
    per_root = members.groupBy("root").agg(F.bool_or(action == "allow").alias("allowed"), F.bool_or(action == "block").alias("blocked"))
    shared = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    by_node = members.join(per_root, "root").select("node", shared.alias("shared")).where("shared is not null")
    own = rule_of(F.col("host"), F.col("path"), rules)
    judged = (
        pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
        .withColumn("own", own)
        .join(by_node, "node", "left")
    )
    return judged.select("page_id", "url", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.action", "shared", F.lit("allow")).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
