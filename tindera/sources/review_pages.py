"""Raw review records of each marketplace out of stored pages.

A record is what the page shows; ``markets.normalise_reviews`` brings it to one schema.  Texts have single blanks.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from . import pages as P
from .pages import Node

COLUMNS = "comment_id string, author string, rating int, rating_label string, active_stars int, time string, content string, variation string, seller_respond string, like_count_text string, helpful string"

# Where the reviews of a Shopee page and their parts stand.
SHOPEE_ITEMS = (".product-ratings__list [data-cmtid]", ".shopee-product-comment-list > [data-cmtid]", "[data-cmtid]", ".shopee-product-rating", ".shopee-product-rating__main")
SHOPEE = {
    "buyer": 'a[href*="/shop/buyer/"]',
    "author": (".shopee-product-rating__author-name",),
    "star": ("svg.icon-rating-solid", '[class*="rating-solid--active"]'),
    "time": (".shopee-product-rating__time",),
    "content": (".shopee-product-rating__content", '[style*="white-space: pre-wrap"]'),
    "reply": (".shopee-product-rating__response", '[class*="seller-response"]', ".TQTPT9 .qiTixQ"),
    "likes": (".shopee-product-rating__like-count",),
}
# How a day and a seller's reply begin on a Shopee page.
_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
_REPLY = re.compile(r"seller.{0,3}response", re.I)


def _shortest(item: Node, pattern: re.Pattern, at_start: bool) -> str:
    """The shortest text below an element that fits: what holds the part itself and no more."""
    texts = (n.text() for n in item.walk() if n is not item)
    return min((t for t in texts if (pattern.match(t) if at_start else pattern.search(t))), key=len, default="")


def shopee(root: Node) -> list[dict]:
    """Parts with names of their own first; else by their place: content is the second part of the second column."""
    out = []
    for item in root.find(*SHOPEE_ITEMS):
        column = item.elements()[1:2]
        parts = column[0].elements()[1:2] if column else []
        buyers = (a.text() for a in item.find(SHOPEE["buyer"]))
        out.append({
            "comment_id": item.attributes.get("data-cmtid", ""),
            "author": item.first(*SHOPEE["author"]) or next(filter(None, buyers), ""),
            "rating": len(item.find(*SHOPEE["star"])),
            "time": item.first(*SHOPEE["time"]) or _shortest(item, _DAY, True),
            "content": item.first(*SHOPEE["content"]) or (parts[0].text() if parts else ""),
            "seller_respond": item.first(*SHOPEE["reply"]) or _shortest(item, _REPLY, False),
            "like_count_text": item.first(*SHOPEE["likes"]),
        })
    return out


# Where the reviews of a Lazada page and their parts stand.
LAZADA_ITEMS = ("#module_product_review .item", ".mod-reviews .item", '[data-qa-locator="review-item"]', ".review-item")
LAZADA_STARS = '.item-middle .i-rate-star-item, .container-star img, [class*="starCtns"] img, [class*="star-filled"], svg[class*="active"]'
LAZADA_LABEL = '[aria-label*="star" i], [class*="container-star"], [class*="rating"]'
LAZADA = {
    "author": (".reviewer", ".user-info .infos p:first-child", ".middle", ".user", ".review-user", '[data-qa-locator="review-author"]'),
    "time": (".user-info .time", ".title.right", ".review-date", ".date", '[data-qa-locator="review-date"]'),
    "content": (".item-content-main-content-reviews-item", ".item-content .content", ".content", ".review-content", '[data-qa-locator="review-content"]'),
    "variation": (".item-content-main-content-skuInfo", ".skuInfo", ".variation", '[class*="sku"]'),
    "seller_respond": (".seller-reply", ".seller-response", '[class*="reply"]'),
    "helpful": (".item-content-like", ".like", ".helpful", '[class*="helpful"]'),
}
# How far a colour's channels are apart at most in a grey, what an unlit star's class says, and what a half star's mask does.
GREY = 25
_UNLIT = re.compile("empty|inactive|off", re.I)
_HALF = re.compile(r"half_([0-9.]+)%")


def _channels(path: Node) -> list[float]:
    """Red, green and blue of a path's fill, by style or attribute; empty if it has none."""
    style = re.search(r"fill\s*:\s*([^;]+)", path.attributes.get("style") or "")
    fill = style[1] if style else path.attributes.get("fill") or ""
    if m := re.fullmatch(r"\s*#([0-9a-f]{6})\s*", fill, re.I):
        return [int(m[1][k : k + 2], 16) for k in (0, 2, 4)]
    found = [float(x) for x in re.findall(r"[0-9]+(?:\.[0-9]+)?", fill)]
    return found[:3] if len(found) >= 3 else []


def star_share(star: Node) -> float:
    """How much of a star is lit.

    A star drawn with paths is lit by its first coloured one, as far as that one's mask lets it show; without a coloured
    path it is dark.  A star without paths is lit unless its class says otherwise.
    """
    paths = star.find("path")
    if not paths:
        return 0.0 if _UNLIT.search(star.attributes.get("class") or "") else 1.0
    coloured = next((p for p in paths if (c := _channels(p)) and max(c) - min(c) > GREY), None)
    if coloured is None:
        return 0.0
    cut = _HALF.search(coloured.attributes.get("mask") or "")
    return float(cut[1]) / 100 if cut else 1.0


def lazada(root: Node) -> list[dict]:
    out = []
    for item in root.find(*LAZADA_ITEMS):
        label = next(iter(item.find(LAZADA_LABEL)), None)
        shown = "" if label is None else label.attributes.get("aria-label") or label.attributes.get("title") or ""
        lit = sum(map(star_share, item.find(LAZADA_STARS)))
        out.append({
            "comment_id": item.attributes.get("data-review-id") or item.attributes.get("data-id") or "",
            "rating_label": shown,
            "active_stars": int(lit + 0.5),
            **{name: item.first(*selectors) for name, selectors in LAZADA.items()},
        })
    return out


# Where the reviews of a Temu page and their parts stand.
TEMU_ITEMS = ("[data-review-id]", "[data-comment-id]", '[data-testid*="review-item" i]', '[data-uniqid*="review-item" i]', '[data-uniqid*="review_item" i]')
TEMU_ROOTS = ('[data-testid*="review" i]', '[data-uniqid*="review" i]', 'section[id*="review" i]', '[id*="review" i]')
TEMU_STAR = '[aria-label*="star" i], [aria-label*="out of 5" i]'
TEMU = {
    "content": ('[data-testid*="review-content" i]', '[data-testid*="review-text" i]', '[data-uniqid*="review-content" i]', '[data-uniqid*="review_text" i]', '[itemprop="reviewBody"]'),
    "author": ('[data-testid*="author" i]', '[data-testid*="user" i]', '[data-uniqid*="author" i]', '[data-uniqid*="user" i]', '[itemprop="author"]'),
    "date": ('[data-testid*="date" i]', '[data-uniqid*="date" i]'),
    "helpful": ('[data-testid*="helpful" i]', '[data-uniqid*="helpful" i]', 'button[aria-label*="helpful" i]'),
}
# How many elements above a star a review may be, and how short and long its text.
LEVELS, SHORT, LONG = 7, 20, 2500
# Lines of a Temu review that are not its text, dates, and variations.
_RATING_LINE = re.compile(r"[0-9](?:\.[0-9])?\s*(?:out of 5|stars?)?", re.I)
_NOTE_LINE = re.compile(r"(?:helpful|report|verified purchase|size:|color:|style:)", re.I)
_DATE_LINE = re.compile(r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}")
_DATED = re.compile(r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b|\b[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}\b", re.I)
_VARIATION = re.compile(r"(?:size|color|style|model|type)\s*:", re.I)


def temu_items(root: Node) -> list[Node]:
    """Elements that say they are reviews; else for each star the nearest element around it with a review's length."""
    if named := root.find(*TEMU_ITEMS):
        return named
    around = []
    for star in root.find(TEMU_STAR):
        line = [star, *star.up()][:LEVELS]
        fit = next((n for n in line if SHORT <= len(n.lines()) <= LONG), None)
        if fit is not None and fit not in around:
            around.append(fit)
    return around


def temu_root(root: Node) -> Node | None:
    """Of all elements that may hold the reviews and have a text, the one with the longest."""
    found = [n for s in TEMU_ROOTS for n in root.find(s) if len(n.text()) >= SHORT]
    return max(found, key=lambda n: len(n.text()), default=None)


def temu(root: Node) -> list[dict]:
    out = []
    for item in temu_items(temu_root(root) or root):
        lines = item.lines().split("\n")
        talk = [x for x in lines if len(x) >= 5 and not (_RATING_LINE.fullmatch(x) or _NOTE_LINE.match(x) or _DATE_LINE.fullmatch(x))]
        clock = next(iter(item.find("time")), None)
        stated = "" if clock is None else clock.attributes.get("datetime") or clock.text()
        out.append({
            "comment_id": item.attributes.get("data-review-id") or item.attributes.get("data-comment-id") or item.attributes.get("id") or "",
            "author": item.first(*TEMU["author"]),
            "rating_label": next((n.attributes["aria-label"] for n in item.find(TEMU_STAR)), ""),
            "time": stated or item.first(*TEMU["date"]) or next((x for x in lines if _DATED.search(x)), ""),
            "content": item.first(*TEMU["content"]) or max(talk, key=len, default=""),
            "variation": next((x for x in lines if _VARIATION.match(x)), ""),
            "helpful": item.first(*TEMU["helpful"]),
        })
    return out


SCANS = {"shopee": shopee, "lazada": lazada, "temu": temu}


def review_records(pages: DataFrame, market: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per review that a stored page shows: ``key``, ``place`` and the raw fields (null where a marketplace has none)."""
    return P.records(pages, key, SCANS[market], COLUMNS, html)
