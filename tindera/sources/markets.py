"""Product and review rows of each marketplace out of stored pages.

Product cards are found by chains of selectors, and where a page's wrappers have changed, by links that are
product URLs.  Raw review records (``review_pages``) are brought to one schema here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..operators.reviews import first_of, identity, star_total
from . import pages as P

CANONICAL = {"shopee": U.shopee_product_url, "lazada": U.lazada_product_url, "temu": U.temu_product_url}
COUNT = {"shopee": N.compact_number, "lazada": N.compact_number, "temu": N.leading_compact_number}


# By marketplace, where product cards, their links and their fields stand; the first that finds anything counts.
CARDS = {
    "shopee": {
        "card": ('[data-sqe="item"]', ".shopee-search-item-result__item", "section ul > li"),
        "link": ('a[data-sqe="link"]', "a.contents", 'a[href*="-i."]', 'a[href*="/product/"]'),
        "loose": ('a[href*="-i."], a[href*="/product/"]', "li"),
        "name": ('[data-sqe="name"]', '[class*="line-clamp-2"]', '[class*="break-words"]'),
        "price": ('[class*="items-baseline"]', '[class*="text-shopee-primary"]', '[class*="price"]'),
        "rating": ('[class*="text-shopee-black87"][class*="text-xs"]', '[aria-label*="rating" i]', '[class*="rating"]'),
        "location": ('[class*="text-shopee-black54"][class*="truncate"]', '[class*="location"]'),
        "sold": (),
    },
    "lazada": {
        "card": ('[data-qa-locator="product-item"]', "[data-item-id]", "div.Bm3ON", 'div[data-spm="list"] > div'),
        "link": ('a[href*="/products/"]', 'a[href*="-i"][href*=".html"]', ".RfADt a"),
        "loose": ('a[href*="/products/"]', "div[data-qa-locator='product-item']"),
        "name": (".RfADt", '[class*="title"]', '[data-qa-locator="product-item"] a'),
        "price": (".ooOxS", '[class*="price"]', '[data-qa-locator="product-price"]'),
        "rating": ('[class*="rating"]', '[aria-label*="rating" i]'),
        "location": (".oa6ri", '[class*="location"]'),
        "sold": ('[class*="sold"]', '[class*="sale"]'),
    },
    "temu": {
        "card": (),
        "link": ('a[href*="goods.html"][href*="goods_id="]', 'a[href*="-g-"][href*=".html"]', "[data-product-id] a[href]", "[data-goods-id] a[href]"),
        "loose": ("a[href]", "[data-product-id], [data-goods-id], li"),
        "name": ('[data-uniqid*="name" i]', "h2", "h3"),
        "price": ('[data-uniqid*="price" i]', '[itemprop="price"]', '[aria-label*="price" i]'),
        "rating": ('[aria-label*="out of 5" i]', '[aria-label*="star" i]'),
        "location": (),
        "sold": (),
    },
}
CARD_COLUMNS = "href string, name string, title string, alt string, label string, price string, rating string, location string, sold string, img string, later_img string, lines string"


def _card_scan(market: str):
    """Cards of a page: of the first card selector that leads to a product link, else the surroundings of loose links."""
    spots = CARDS[market]
    looks = re.compile({"shopee": r"-i\.\d+\.\d+|/product/\d+/\d+", "lazada": r"/products/.*\.html|\.html", "temu": r"goods_id=\d{6}|-g-\d{6}"}[market])

    def link_of(card: P.Node) -> P.Node | None:
        own = [card] if card.tag == "a" else []
        return next((a for group in (own, *(card.find(s) for s in spots["link"])) for a in group if looks.search(a.attributes.get("href") or "")), None)

    def cards(root: P.Node):
        for s in spots["card"]:
            if found := [(c, a) for c in root.find(s) if (a := link_of(c)) is not None]:
                return found
        loose = [a for s in (spots["link"] if market == "temu" else spots["loose"][:1]) for a in root.find(s) if looks.search(a.attributes.get("href") or "")]
        return [(next((n for n in a.up() if n.matches(spots["loose"][1])), a), a) for a in loose]

    def scan(root: P.Node) -> list[dict]:
        out = []
        for card, a in cards(root):
            out.append({
                "href": a.attributes.get("href"), "name": card.first(*spots["name"]), "title": a.attributes.get("title") or "", "alt": card.attribute("alt", "img"), "label": a.attributes.get("aria-label") or "",
                "price": card.first(*spots["price"]), "rating": card.attribute("aria-label", *spots["rating"]) if market == "temu" else card.first(*spots["rating"]), "location": card.first(*spots["location"]),
                "sold": card.first(*spots["sold"]), "img": card.attribute("src", "img"), "later_img": card.attribute("data-src", "img"), "lines": card.lines(),
            })
        return out

    return scan


def product_cards(pages: DataFrame, market: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """Product rows of search pages, the first of each link and page: ``key``, ``place``, and the fields of a product.

    A card that isn't found by its wrapper is found by its link.  What a marketplace's cards don't show is empty.
    """
    cards = P.records(pages, key, _card_scan(market), CARD_COLUMNS, html)
    rows = cards.withColumn("link", CANONICAL[market](F.col("href"))).where("link != ''")
    lines, flat = F.col("lines"), F.regexp_replace("lines", r"\s+", " ")
    clean = lambda c: F.trim(F.regexp_replace(c, r"[\s\u00A0]+", " "))
    filled = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    name, title, alt, label, price = (F.col(c) for c in ("name", "title", "alt", "label", "price"))
    if market == "shopee":
        name = filled(name, title, alt)
        price = F.when(price.contains("₱"), F.regexp_replace(price, r"\s+", "")).otherwise(T.price_from_text(flat))
        rating = number(filled(F.regexp_extract("rating", r"(?<![0-9])([0-5](?:\.[0-9])?)(?![0-9])", 1), N.rating_from_card(lines)))
        sold, total = T.sold_count(flat), F.lit(0).cast("long")
    elif market == "lazada":
        name, price, rating = clean(filled(name, title, alt)), clean(price), N.rating_from_text(F.col("rating"))
        sold, total = N.compact_number(F.col("sold")), F.lit(0).cast("long")
    else:
        name = clean(filled(label, title, name, alt))
        price = clean(filled(price, F.regexp_extract(flat, r"(?i)((?:₱|PHP\s*)\s*[0-9,]+(?:\.[0-9]{1,2})?)", 1)))
        rating, sold, total = N.rating_from_phrase(F.col("rating")), T.sold_count(flat), T.review_count(flat)
    img = F.when((F.col("img") == "") | F.col("img").startswith("data:image"), F.col("later_img")).otherwise(F.col("img"))
    rows = rows.select(
        key, "place", "link", name.alias("name"), price.alias("price"), rating.alias("rating"), sold.alias("sold_count"), total.alias("total_rating"), T.shipping_line(lines).alias("shipping"),
        clean(F.col("location")).alias("location"), T.image_url(img).alias("img"), F.lit(market).alias("platform"), F.lit("PH").alias("market"), F.lit("PHP").alias("currency"),
        (F.regexp_extract("link", r"goods_id=([0-9]+)", 1) if market == "temu" else F.lit("")).alias("goods_id"),
    )
    return first_of(rows, [key, "link"], "place")


# The buttons of a rating overview.
OVERVIEW, FILTER = ".product-rating-overview", ".product-rating-overview__filter"


def rating_overview(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``detailed_rating`` (count by filter, the last of a key) and ``total_rating`` (of stars) of every page; an empty map without an overview."""
    found = P.records(pages, key, lambda root: [{"label": n.text()} for n in (root.find(FILTER) if root.find(OVERVIEW) else [])], "label string", html)
    parsed = found.withColumn("f", T.rating_filter(F.col("label"))).where("f.key != ''")
    last = parsed.groupBy(key, F.col("f.key").alias("k")).agg(F.max_by("f.count", "place").alias("n"))
    maps = last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("detailed_rating"))
    out = pages.select(key).join(maps, key, "left").withColumn("detailed_rating", F.coalesce("detailed_rating", F.create_map().cast("map<string,bigint>")))
    return out.withColumn("total_rating", star_total(F.col("detailed_rating")))


def product_from_link(link: Column, market: str) -> Column:
    """A blank product for a link that was given directly; null if it is none of the market's."""
    canonical = CANONICAL[market](link)
    return F.when(canonical != "", F.struct(canonical.alias("link"), F.lit("").alias("name"), F.lit("").alias("price"), F.lit(market).alias("platform")))


def normalise_reviews(raw: DataFrame, market: str, include_empty: bool = True) -> DataFrame:
    """Raw records to the review schema; a rating is what the record counts, else what its label says, else its lit stars (Temu's may be halves).

    ``raw`` has ``comment_id, author, time, content`` and, by market, ``rating`` or ``rating_label`` and
    ``active_stars``, ``variation``, ``seller_respond``, ``like_count_text`` or ``helpful``.
    """
    has = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    single = lambda c: F.trim(F.regexp_replace(F.coalesce(has(c), F.lit("")), r"[\s\u00A0]+", " "))
    clean = (lambda c: T.repair(has(c))) if market == "lazada" else single
    label = (N.rating_from_text if market == "lazada" else N.rating_from_phrase)(has("rating_label"))
    shown = [has("rating").try_cast("double"), label, has("active_stars").try_cast("double")]
    stars = F.coalesce(*[F.nullif(x, F.lit(0.0)) for x in shown], F.lit(0.0))
    likes = COUNT[market](F.coalesce(has("like_count_text"), has("helpful")))
    kept = [c for c in ("link", "pos", "page_id", "place") if c in raw.columns]
    rows = raw.select(
        *kept, single("comment_id").alias("comment_id"), clean("author").alias("author"), (stars if market == "temu" else stars.cast("int")).alias("rating"), clean("time").alias("time"),
        clean("content").alias("content"), clean("variation").alias("variation"), clean("seller_respond").alias("seller_respond"), likes.alias("like_count"),
        has("source_rating_filter").cast("string").alias("source_rating_filter"),
    )
    return rows if include_empty else rows.where("content != ''")


def review_counts(products: DataFrame) -> DataFrame:
    """Adds ``written_reviews_collected`` (distinct by identity) and ``reported`` (the stated total, even 0, else the reported count)."""
    same = lambda r: identity(r["comment_id"], r["author"], r["time"], r["content"], r["rating"])
    written = F.coalesce(F.size(F.array_distinct(F.transform("comments", same))), F.lit(0))
    stated = F.when(F.col("total_rating").isNotNull(), F.col("total_rating").try_cast("long")).otherwise(F.col("reported_review_count").try_cast("long"))
    return products.withColumn("written_reviews_collected", written).withColumn("reported", F.coalesce(stated, F.lit(0).cast("long")))


def apply_json_ld(products: DataFrame, ld: str = "json_ld") -> DataFrame:
    """A page's JSON-LD fields over the product's own, where they are there."""
    fields = P.json_ld_fields(F.col(ld))
    out = products.withColumn("__ld", fields)
    for name in ("name", "description", "img", "brand", "price", "currency", "rating", "total_rating"):
        if name in products.columns:
            kind = dict(products.dtypes)[name]
            out = out.withColumn(name, F.coalesce(F.col(f"__ld.{name}").cast(kind), F.col(name)))
    return out.drop("__ld")
