"""URL filter: longest matching rule, and blocks that spread to redirect and canonical aliases."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.shared import smallest_reachable


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


# A rule list is an argument written by people; it becomes part of the plan.
MAX_RULES = 10_000


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next /, ? or #, with A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the end of the host to the next ? or #; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(n, rule, verdict) of the longest rule that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    found = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(len(r.name)).alias("n"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    if not found:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*found)))


def page_key(url: Column) -> Column:
    """What a URL stands for: without scheme, fragment, campaign arguments and closing slash."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^utm_"))
    bare = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(host_of(url) != "", F.concat_ws("?", bare, F.nullif(F.array_join(kept, "&"), F.lit(""))))


def page_links(url: Column, html: Column) -> Column:
    """array<string>: where a page says it has moved to or is kept: canonical link, refresh, og:url."""
    html = F.coalesce(html, F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), 0)
    named = F.filter(
        tags, lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?canonical|http-equiv\s*=\s*["']?refresh|property\s*=\s*["']?og:url""")
    )
    to = F.transform(
        named, lambda t: F.regexp_extract(t, r"""(?i)(?:href|url|content)\s*=\s*["']?(?:\d+\s*;\s*url\s*=\s*)?([^"'\s>]+)""", 1)
    )
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    whole = F.transform(to, lambda x: F.when(F.startswith(x, F.lit("/")), F.concat(root, x)).otherwise(x))
    return F.filter(whole, lambda x: x.contains("://"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_blocked.

    A page with a rule gets that rule's verdict: an explicit allow is never overruled. Pages without a rule are
    aliases of every page that has the same :func:`page_key`, or that redirect or canonical links join to it over
    any number of steps; if one of these is blocked by a rule, so are they. All others are allowed.

    Null urls and urls without ``://`` have empty host and path, no rule and no alias: allow. Repeated rows and
    shared urls give one row each. Null html has no links. An empty table gives no rows; other columns are ignored.
    """
    u = F.col("_url")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    base = base.withColumns({"host": host_of(u), "path": path_of(u)})
    hit = longest_rule(F.col("host"), F.col("path"), rules)
    judged = base.withColumns({"_hit": hit, "_key": page_key(u)})
    links = judged.filter(F.col("_key").isNotNull() & F.col("_html").rlike("(?i)canonical|http-equiv|og:url"))
    links = links.select(F.col("_key").alias("a"), F.explode(page_links(u, F.col("_html"))).alias("_to"))
    links = links.select("a", page_key(F.col("_to")).alias("b")).filter("a <> b")
    blocked = judged.filter(F.col("_hit.verdict") == "block").select("_key").distinct()
    group = smallest_reachable(links, "a", "b").select(F.col("node").alias("_key"), "component")
    spread = group.join(blocked, "_key", "left_semi").select("component").distinct()
    spread = group.join(spread, "component", "left_semi").select("_key").unionByName(blocked).distinct()
    ruled = judged.filter(F.col("_hit").isNotNull()).withColumn("alias_blocked", F.lit(False))
    free = judged.filter(F.col("_hit").isNull()).drop("_html")
    free = free.join(spread.withColumn("alias_blocked", F.lit(True)), "_key", "left")
    free = free.withColumn("alias_blocked", F.coalesce("alias_blocked", F.lit(False)))
    out = ruled.drop("_html").unionByName(free)
    verdict = F.coalesce(F.col("_hit.verdict"), F.when(F.col("alias_blocked"), "block").otherwise("allow"))
    return out.select(
        "page_id", "host", "path", F.col("_hit.rule").alias("rule"), verdict.alias("verdict"), "alias_blocked"
    )
