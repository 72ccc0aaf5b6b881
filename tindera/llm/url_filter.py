"""URL filter with redirect equivalence: block decisions spread over redirect and
canonical-link edges to all aliases of a page.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import ascii_lower, settle

#: (host, path, verdict): a host also stands for its subdomains, a path for all paths that begin with it.
Rule = tuple[str, str, str]

# A tag ends at the latest where the next begins, so that a page of unclosed tags takes linear time.
_CANONICAL = r"""(?is)<link\b(?=[^<>]*\brel\s*=\s*(?:"[^"<>]*\bcanonical\b|'[^'<>]*\bcanonical\b|canonical\b))[^<>]*?\bhref\s*=\s*["']?([^"'\s<>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^<>]*?\bcontent\s*=\s*["']?[^"'<>]*?url\s*=\s*([^"'\s<>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does.  Of equally long ones, the first given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def node_of(url: Column) -> Column:
    """A URL's identity: without scheme and fragment, host in lower case; null without ``://``."""
    tail = F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.xxhash64(F.concat(host_of(url), F.when(tail == "", F.lit("/")).otherwise(tail))))


def absolute(link: Column, base: Column) -> Column:
    """A link as an absolute URL: absolute, scheme-relative, root-relative, or beside the base; null if there is none."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(base), r"^([^/?#]*)", 1))
    folder = F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1)
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )
    return F.when(link != "", full)


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(source, target) URLs that name the same page.

    From all canonical links and refreshes of each page, in the whole of its html however long it is, and from
    ``redirects`` (``source``, ``target``) if given.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    links = F.array_union(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(1)))
    # Most pages have neither word in a tag; a plain search for both spares them the patterns.
    low = F.lower(html)
    named = low.contains("canonical") | low.contains("refresh")
    found = pages.where(F.col("url").isNotNull() & named).select("url", F.explode(links).alias("link"))
    edges = found.select(F.col("url").alias("source"), absolute(F.col("link"), F.col("url")).alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    return edges.where(F.col("source").isNotNull() & F.col("target").isNotNull())


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Judge every page's URL.

    Input: ``page_id``, ``url`` and ``html``; other columns are ignored.  Output, one row per
    input row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``by`` (``rule``,
    ``alias`` or ``default``).

    A URL that a rule fits has that rule's verdict: an explicit allow is not overruled by
    aliases, nor does it clear them (or a blocked site could clear itself by naming an
    allowed page as canonical).  Any other URL is blocked if one of its aliases, at any
    distance, is blocked by a rule; else it has the default.  A null URL, or one without
    ``://``, has an empty host and path and the default.  Null html has no links.
    Equal rows get equal results; an empty table gives an empty result.
    """
    rules = list(rules)
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.withColumn("m", matching_rule(F.col("host"), F.col("path"), rules))

    edges = settle(alias_edges(pages, redirects).distinct(), "alias-edges")  # all html is read once
    ends = edges.select(F.explode(F.array("source", "target")).alias("url"))
    blocked = ends.where(matching_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["verdict"] == "block")
    blocked = blocked.select(node_of(F.col("url")).alias("node")).distinct()
    links = edges.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b"))
    named = connected_components(links)
    bad = named.join(blocked, "node", "left_semi").select("component").distinct()
    tainted = named.join(bad, "component", "left_semi").select("node", F.lit(True).alias("tainted"))

    # The small side is written, so that AQE can split a URL of very many pages; rows without a node get keys that differ and meet none.
    tainted = settle(tainted, "tainted-nodes")
    spread = F.coalesce("node", F.concat(F.lit("\x00"), F.xxhash64("page_id", "url").cast("string")))
    joined = judged.withColumn("node", spread).join(tainted, "node", "left")
    by = F.when(F.col("m").isNotNull(), "rule").when(F.col("tainted"), "alias").otherwise("default")
    verdict = F.when(by == "rule", F.col("m.verdict")).when(by == "alias", "block").otherwise(default)
    return joined.select("page_id", "host", "path", F.col("m.rule").alias("rule"), verdict.alias("verdict"), by.alias("by"))
