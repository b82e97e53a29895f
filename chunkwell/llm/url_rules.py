"""URL filters whose decisions follow redirects and canonical links.

A rule names a host with its subdomains and the beginning of a path. A page that no rule
names shares the fate of its aliases: URLs that redirect to each other by convention
(scheme, ``www.``, trailing slash, fragment, tracking parameters) are one node, and
``canonical`` links and ``refresh`` redirects in the markup join nodes into components.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.components import connected_components
from chunkwell.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change what a URL shows.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"
#: Rules are broadcast: some 10 MB at most.
MAX_RULES = 100_000

_CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_TO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"

Rule = tuple[str, str, str]


def _rest(url: Column) -> Column:
    found = F.instr(url, F.lit("://"))
    return F.when(found > 0, F.substr(url, found + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def alias_key(url: Column) -> Column:
    """One text for URLs that redirect to each other by convention; NULL without a host."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), "/+$", "")
    asked = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, path, tail))


def matching_rules(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows ``(row, host, path)`` that a rule fits, as ``(row, rule, verdict)`` with the longest.

    Rules are a broadcast table. A row meets the rules of its host and of the domains above
    it, no more of them than the longest rule has labels; of equal rules the later counts.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules travel to the tasks")
    listed = [(k, verdict, host, path) for k, (verdict, host, path) in enumerate(rules)]
    table = urls.sparkSession.createDataFrame(listed, "place int, verdict string, rule_host string, rule_path string")
    most = max((host.count(".") + 1 for _, host, _ in rules), default=1)
    labels = F.split("host", r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - most + 1)
    above = F.transform(F.sequence(first, F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = urls.select("row", "path", F.explode(above).alias("rule_host"))
    met = met.join(F.broadcast(table), "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = F.max(F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), "rule_host", "rule_path", "place", "verdict"))
    found = met.groupBy("row").agg(best.alias("best"))
    return found.select("row", F.concat("best.rule_host", "best.rule_path").alias("rule"), "best.verdict")


def resolve(target: Column, url: Column) -> Column:
    """A link's target as an absolute URL: absolute, ``//host``, ``/path`` or relative."""
    base = F.regexp_extract(url, r"(?s)^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url_path(url), r"(?s)^(.*/)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b, target)``: alias keys joined by a canonical link or a refresh redirect of a page."""
    html = F.col(html_col)
    tags = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, _HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, _TO, 1)),
    )
    linked = pages.select(F.col(url_col).alias("url"), F.explode(tags).alias("target"))
    linked = linked.where("target != ''").withColumn("target", resolve(F.col("target"), F.col("url")))
    return linked.select(alias_key(F.col("url")).alias("a"), alias_key(F.col("target")).alias("b"), "target")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    redirects: DataFrame | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """``(id, host, path, rule, verdict, alias)``, one row per input row.

    ``rules`` are ``(verdict, host, path)``, at most ``MAX_RULES``; a rule's own verdict holds for the pages it
    fits. Another page is blocked if a URL of its component, a page or what a link points to,
    is blocked by a rule and none is allowed by one; else it is allowed. ``redirects`` may add known redirects as
    ``(from_url, to_url)``. ``alias`` is the smallest alias key of the component.

    A NULL URL or one without ``://`` has an empty host and path, no rule, no alias, and
    is allowed. Repeated rows stay; NULL markup has no links. Everything runs on built-in
    functions; decisions are combined before they are shuffled, and a component that holds
    a third of the pages is a hub of minima, not a group of rows.
    """
    url = F.col(url_col)
    found = written(
        pages.select(
            F.col(id_col).alias("id"),
            url_host(url).alias("host"),
            url_path(url).alias("path"),
            alias_key(url).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    fits = matching_rules(found.select("row", "host", "path"), rules)
    found = found.join(fits, "row", "left").withColumnRenamed("verdict", "given")
    edges = pages.sparkSession.createDataFrame([], "a string, b string, target string")
    if html_col:
        edges = edges.union(link_edges(pages, url_col, html_col))
    if redirects is not None:
        ends = alias_key(F.col("from_url")), alias_key(F.col("to_url")), F.col("to_url")
        edges = edges.union(redirects.select(*ends))
    edges = written(edges.distinct())
    joined = connected_components(edges)
    found = found.join(joined, F.col("key") == F.col("node"), "left").select(
        "id", "host", "path", "rule", "given", F.coalesce("component", "key").alias("alias")
    )
    # what a link points to has a fate of its own, also if it is no page of the table
    target = F.col("target")
    targets = written(
        edges.select("target").distinct().select(
            F.monotonically_increasing_id().alias("row"), alias_key(target).alias("key"),
            url_host(target).alias("host"), url_path(target).alias("path"),
        )
    )
    ends = targets.join(matching_rules(targets.select("row", "host", "path"), rules), "row")
    # a link to its own page joins nothing, but its target counts
    ends = ends.join(joined, F.col("key") == F.col("node"), "left").select(
        F.coalesce("component", "key").alias("alias"), F.col("verdict").alias("given")
    )
    # only components with a rule to pass on and only pages without one need to meet
    known = found.select("alias", "given").union(ends)
    known = known.where("given IS NOT NULL AND alias IS NOT NULL").groupBy("alias").agg(
        F.max(F.col("given") == "block").alias("blocked"), F.max(F.col("given") == "allow").alias("allowed")
    )
    known = known.where("blocked AND NOT allowed").select(F.col("alias").alias("bad"))
    verdict = F.coalesce("given", F.when(F.col("bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return found.join(known, F.col("alias") == F.col("bad"), "left").select(
        "id", "host", "path", "rule", verdict.alias("verdict"), "alias"
    )
