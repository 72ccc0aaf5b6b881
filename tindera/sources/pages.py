"""Products and reviews out of stored HTML.

Live browsing is out of scope; these take the pages a collector stored.  Simple picks are
native; trees of elements and JSON-LD, which need recursion, are Arrow-batched functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)


def link_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href=")).cast("int")


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, with single blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list = []

    def text(self) -> str:
        """All text below, with single blanks."""
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag not in ("script", "style"):
                stack.extend(reversed(n.children))
        return " ".join(" ".join(parts).split())

    def lines(self) -> str:
        """Texts of the leaves, a line each."""
        parts, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if n.strip():
                    parts.append(" ".join(n.split()))
            elif n.tag not in ("script", "style"):
                stack.extend(reversed(n.children))
        return "\n".join(parts)

    def walk(self) -> Iterable[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def matches(self, selector: str) -> bool:
        """Does one of the selector's alternatives fit this element?"""
        return any(_fits(self, chain, len(chain) - 1) for chain in _parsed(selector))

    def find(self, *selectors: str) -> list[Node]:
        """All below that match the first selector that matches any."""
        for s in selectors:
            if found := [n for n in self.walk() if n is not self and n.matches(s)]:
                return found
        return []

    def first(self, *selectors: str) -> str:
        """The text of the first element with one: selectors in turn, elements in order."""
        for s in selectors:
            for n in self.find(s):
                if text := n.text():
                    return text
        return ""

    def attribute(self, name: str, *selectors: str) -> str:
        """The first value of an attribute that isn't empty: selectors in turn, elements in order."""
        for s in selectors:
            for n in self.find(s):
                if value := (n.attributes.get(name) or "").strip():
                    return value
        return ""

    def up(self) -> Iterable[Node]:
        n = self.parent
        while n is not None and n.tag:
            yield n
            n = n.parent


_SIMPLE = re.compile(r"""(?P<tag>[\w*-]*)(?P<names>(?:[.#][\w-]+)*)(?P<tests>(?:\[[^\]]*\])*)(?P<first>:first-child)?""")
_TEST = re.compile(r"""\[\s*([\w-]+)\s*(?:(\*?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]"']+))\s*(i)?\s*)?\]""")


@lru_cache(512)
def _parsed(selector: str) -> list[list]:
    """A selector as alternatives; each a chain of (is a direct child, tag, classes, id, attribute tests, is first)."""
    out = []
    for part in re.split(r",(?![^\[]*\])", selector):
        chain, direct = [], False
        for word in re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", part.strip()):
            if word == ">":
                direct = True
                continue
            m = _SIMPLE.fullmatch(word)
            if m is None:
                raise ValueError(f"unknown selector {selector!r}")
            names = re.findall(r"[.#][\w-]+", m["names"])
            tests = [(n, how, a or b or c, bool(fold)) for n, how, a, b, c, fold in _TEST.findall(m["tests"])]
            chain.append((direct, m["tag"], {n[1:] for n in names if n[0] == "."}, next((n[1:] for n in names if n[0] == "#"), None), tests, bool(m["first"])))
            direct = False
        if not chain:
            raise ValueError(f"unknown selector {selector!r}")
        out.append(chain)
    return out


def _fits(node: Node, chain: list, k: int) -> bool:
    direct, tag, classes, own_id, tests, first = chain[k]
    if (tag and tag not in ("*", node.tag)) or not node.tag or (own_id is not None and node.attributes.get("id") != own_id):
        return False
    if classes and not classes <= set((node.attributes.get("class") or "").split()):
        return False
    for name, how, part, fold in tests:
        value = node.attributes.get(name)
        if value is None:
            return False
        if fold:
            value, part = value.lower(), part.lower()
        if how and not (part in value if how == "*=" else part == value):
            return False
    if first and (node.parent is None or node.parent.elements()[0] is not node):
        return False
    if k == 0:
        return True
    above = node.up()
    if direct:
        parent = next(above, None)
        return parent is not None and _fits(parent, chain, k - 1)
    return any(_fits(n, chain, k - 1) for n in above)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def extract(pages: DataFrame, key: str, records: Sequence[str], fields: Mapping[str, Sequence[str]], html: str = "html") -> DataFrame:
    """One row per record element: ``key``, ``place``, and each field's text.

    ``records``: selectors, the first that matches anything counts.  A field is a list of selectors with
    an optional ``@attribute``; ``:text`` and ``:lines`` are the record's own text.
    """
    names = list(fields)

    def value(node: Node, picks: Sequence[str]) -> str:
        for pick in picks:
            if pick in (":text", ":lines"):
                found = node.text() if pick == ":text" else node.lines()
            else:
                selector, _, attribute = pick.partition("@")
                hits = [node] if not selector else node.find(selector)
                found = (hits[0].attributes.get(attribute, "") if attribute else hits[0].text()) if hits else ""
            if found:
                return found
        return ""

    def run(frames):
        for frame in frames:
            rows = []
            for k, text in zip(frame["k"], frame["html"]):
                rows += [(k, i, *(value(n, fields[f]) for f in names)) for i, n in enumerate(tree(text).find(*records))]
            yield pd.DataFrame(rows, columns=["k", "place", *names])

    kind = pages.schema[key].dataType.simpleString()
    source = pages.select(F.col(key).alias("k"), F.col(html).alias("html"))
    out = source.mapInPandas(run, f"k {kind}, place int, " + ", ".join(f"`{n}` string" for n in names))
    return out.withColumnRenamed("k", key)


def records(pages: DataFrame, key: str, scan: Callable[[Node], list[dict]], columns: str, html: str = "html") -> DataFrame:
    """One row per record that ``scan`` finds in a page's tree: ``key``, ``place`` and the ``columns`` (``name type, ...``)."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames):
        for frame in frames:
            rows = []
            for k, text in zip(frame["k"], frame["html"]):
                rows += [(k, i, *(r.get(n) for n in names)) for i, r in enumerate(scan(tree(text)))]
            yield pd.DataFrame(rows, columns=["k", "place", *names])

    kind = pages.schema[key].dataType.simpleString()
    source = pages.select(F.col(key).alias("k"), F.col(html).alias("html"))
    return source.mapInPandas(run, f"k {kind}, place int, {columns}").withColumnRenamed("k", key)


def anchors(pages: DataFrame, key: str) -> DataFrame:
    """All links of a page, in order."""
    return extract(pages, key, ["a[href]"], {"href": ["@href"], "text": [":text"]})


def json_ld_product(html: str | None) -> str | None:
    """The first item of a page's JSON-LD whose type is a product, as JSON; depth first through lists and objects."""
    return json_ld_of(tree(html))


def json_ld_of(root: Node) -> str | None:
    for script in root.find('script[type="application/ld+json"]'):
        try:
            stack = [json.loads("".join(c for c in script.children if isinstance(c, str)))]
        except ValueError:
            continue
        while stack:
            item = stack.pop()
            if isinstance(item, dict):
                kinds = item.get("@type")
                if any("product" in str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])):
                    return json.dumps(item, ensure_ascii=False)
                stack.extend(reversed(list(item.values())))
            elif isinstance(item, list):
                stack.extend(reversed(item))
    return None


def json_ld_fields(ld: Column) -> Column:
    """Product fields out of a JSON-LD item; a missing one is null."""
    v = F.try_parse_json(ld)
    get = lambda *paths: F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])
    offer = lambda name: get(f"$.offers.{name}", f"$.offers[0].{name}")
    currency, amount = offer("priceCurrency"), F.coalesce(offer("price"), offer("lowPrice"))
    return F.struct(
        get("$.name").alias("name"), get("$.description").alias("description"), get("$.image[0].url", "$.image[0]", "$.image.url", "$.image").alias("img"), get("$.brand.name", "$.brand").alias("brand"),
        F.when(currency == "PHP", F.concat(F.lit("₱"), amount)).otherwise(amount).alias("price"), currency.alias("currency"),
        get("$.aggregateRating.ratingValue").try_cast("double").alias("rating"), get("$.aggregateRating.reviewCount", "$.aggregateRating.ratingCount").try_cast("long").alias("total_rating"),
    )


def prefer_new(new: Column, old: Column) -> Column:
    """A detail page's value, else what was there before."""
    return F.coalesce(F.nullif(F.trim(new), F.lit("")), old)


def review_root(candidates: DataFrame, key: str = "page_id", least: int = 20) -> DataFrame:
    """Of the elements of each page that could hold its reviews (``text``), the longest of at least 20 characters."""
    kept = candidates.where(F.length("text") >= least)
    return kept.groupBy(key).agg(F.max_by(F.struct(*[c for c in kept.columns if c != key]), F.struct(F.length("text"), -F.col("place"))).alias("r")).select(key, "r.*")
