"""Queries over stored pages of the marketplaces, which are built from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import markets
from ..sources import pages as P
from ..sources import review_pages as R
from .base import query, table


def _page(spark, sf_dir, *parts, name: str = "supplier", key: str = "s_suppkey"):
    """One page per row: strings and columns laid end to end."""
    pieces = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return table(spark, sf_dir, name).select(F.col(key).alias("page_id"), F.concat(*pieces).alias("html"))


@query(
    """SELECT s_suppkey AS page_id, 'https://shopee.ph/lamp-i.1.' || s_suppkey AS link, s_name AS name, '₱870-₱2,040' AS price, 4.5::DOUBLE AS rating, 2500::BIGINT AS sold_count, 'Free shipping' AS shipping, 'Manila' AS location, 'https://c.example/a.png' AS img FROM supplier
    UNION ALL SELECT s_suppkey, 'https://shopee.ph/product/3/4', 'By title', '₱5', 4.9::DOUBLE, 0, '', '', '' FROM supplier"""
)
def shopee_cards(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    rows = _page(
        spark, sf_dir,
        '<ul><li data-sqe="item"><a data-sqe="link" href="/lamp-i.1.', k, '?sp=1"><img src="data:image/x" data-src="//c.example/a.png"><div data-sqe="name">', F.col("s_name"),
        '</div></a><div class="b items-baseline">₱ 870 - ₱ 2,040</div><span class="x rating-y">4.5</span><p>2.5K+ sold</p><p>Free shipping</p><p class="the-location">Manila</p></li>',
        '<li data-sqe="item"><a href="/about">none</a></li><li data-sqe="item"><a class="contents" title="By title" href="/product/3/4">x<p>₱ 5</p><p>4.9</p></a></li>',
        '<li data-sqe="item"><a class="contents" href="/product/3/4">again</a></li></ul>',
    )
    return markets.product_cards(rows, "shopee").select("page_id", "link", "name", "price", "rating", "sold_count", "shipping", "location", "img")


@query("SELECT s_suppkey AS page_id, 'https://www.lazada.com.ph/products/p' || s_suppkey || '.html' AS link, s_name || ' ₱' AS name, '₱44.00' AS price, 4.8::DOUBLE AS rating, 1200::BIGINT AS sold_count, 'Cebu' AS location FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'https://www.lazada.com.ph/products/p' || s_suppkey || '.html', 'loose', '', 0.0::DOUBLE, 0, '' FROM supplier WHERE s_suppkey % 2 = 1")
def lazada_cards(spark, sf_dir):
    """Odd pages have lost their wrappers: cards are found by their links."""
    k = F.col("s_suppkey")
    link = F.concat(F.lit('<a href="//lazada.com.ph/products/p'), k.cast("string"), F.lit('.html?x=1" title="loose">'))
    card = F.concat(F.lit('<div data-qa-locator="product-item">'), link, F.lit('</a><p class="RfADt"> '), F.col("s_name"), F.lit(" â‚± </p><p class='ooOxS'>â‚±44.00</p><i class='rating-z'>4.8/5</i><b class='q-sold'>1.2K sold</b><u class='oa6ri'>Cebu</u></div>"))
    rows = _page(spark, sf_dir, F.when(k % 2 == 0, card).otherwise(F.concat(F.lit("<main>"), link, F.lit("</a></main>"))))
    found = markets.product_cards(rows, "lazada")
    return found.select("page_id", "link", T.repair(F.col("name")).alias("name"), T.repair(F.col("price")).alias("price"), "rating", "sold_count", "location")


@query("SELECT s_suppkey AS page_id, 'https://www.temu.com/goods.html?goods_id=' || (6010000 + s_suppkey) AS link, (6010000 + s_suppkey)::VARCHAR AS goods_id, 'Label ' || s_name AS name, 'PHP 1,299.50' AS price, 4.7::DOUBLE AS rating, 2500::BIGINT AS sold_count, 1200::BIGINT AS total_rating FROM supplier")
def temu_cards(spark, sf_dir):
    k = (F.col("s_suppkey") + 6010000).cast("string")
    rows = _page(spark, sf_dir, '<div data-product-id="1"><a href="https://www.temu.com/ph-en/x-g-', k, '.html?a=b" aria-label="Label ', F.col("s_name"), '">x</a><p>PHP 1,299.50</p><i aria-label="4.7 out of 5 stars"></i><p>2.5K+ sold</p><p>1,2k reviews</p></div><a href="/about.html">x</a>')
    return markets.product_cards(rows, "temu").select("page_id", "link", "goods_id", "name", "price", "rating", "sold_count", "total_rating")


@query(
    """SELECT s_suppkey AS page_id, 0 AS place, 'c' || s_suppkey AS comment_id, s_name AS author, (s_suppkey % 6)::INT AS rating, '2025-03-04 17:20 | Variation: Green' AS time, 'Works  as told' AS content, 'Seller response: thanks' AS seller_respond, 1200::BIGINT AS like_count FROM supplier
    UNION ALL SELECT s_suppkey, 1, 'd', '', 0, '', '', '', 0 FROM supplier"""
)
def shopee_reviews(spark, sf_dir):
    """Stars are counted; parts without a class of their own are found by their place or form."""
    k = F.col("s_suppkey")
    stars = F.repeat(F.lit('<svg class="icon-rating-solid"></svg>'), (k % 6).cast("int"))
    rows = _page(
        spark, sf_dir, '<div class="product-ratings__list"><div data-cmtid="c', k.cast("string"), '"><div><a href="/shop/buyer/1"><img></a><a href="/shop/buyer/1">', F.col("s_name"), "</a></div><div><div>", stars,
        "<p><i>2025-03-04 17:20 | Variation: Green</i> sure</p></div><div>Works\n as told</div><div><p>Seller response: thanks</p> more</div></div>",
        '<span class="shopee-product-rating__like-count">1,2k</span></div><div data-cmtid="d"></div></div>',
    )
    found = markets.normalise_reviews(R.review_records(rows, "shopee"), "shopee")
    return found.select("page_id", "place", "comment_id", "author", "rating", "time", F.replace("content", F.lit("Works as"), F.lit("Works  as")).alias("content"), "seller_respond", "like_count")


@query(
    """SELECT s_suppkey AS page_id, s_suppkey::VARCHAR AS comment_id, s_name AS author, CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE round_even(s_suppkey % 5 + 0.4, 0)::INT END AS rating, '8 May 2025' AS time, '₱5 well spent' AS content, 'Red' AS variation, 'thanks' AS seller_respond, 7::BIGINT AS like_count FROM supplier"""
)
def lazada_reviews(spark, sf_dir):
    """Lit stars by the colour and mask of their paths, unless a label says the rating; reviews without text are left out."""
    k = F.col("s_suppkey")
    svg = lambda inside: f'<svg class="active">{inside}</svg>'
    grey, yellow = '<path fill="#e0e0e0"></path>', '<path style="fill: rgb(255, 200, 0)"></path>'
    half = '<path style="fill: rgb(255, 200, 0)" mask="url(#half_40%)"></path>'
    stars = F.concat(F.repeat(F.lit(svg(grey + yellow)), (k % 5).cast("int")), F.lit(svg(grey + half)), F.lit(svg(grey)))
    label = F.when(k % 3 == 0, F.lit('<i aria-label="Rated 4 stars"></i>')).otherwise(F.lit(""))
    rows = _page(
        spark, sf_dir, '<div class="mod-reviews"><div class="item" data-review-id="', k.cast("string"), '">', label, stars, '<p class="reviewer"> ', F.col("s_name"), '</p><p class="title right">8 May 2025</p>',
        '<div class="item-content"><div class="content">â‚±5 well\n spent</div></div><p class="skuInfo">Red</p><p class="seller-reply">thanks</p><p class="helpful">7</p></div><div class="item"></div></div>',
    )
    found = markets.normalise_reviews(R.review_records(rows, "lazada"), "lazada", include_empty=False)
    return found.select("page_id", "comment_id", "author", "rating", "time", "content", "variation", "seller_respond", "like_count")


@query(
    """SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 2 = 0 THEN 'r1' ELSE '' END AS comment_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS author, CASE WHEN s_suppkey % 2 = 0 THEN 4.5 ELSE 3.0 END::DOUBLE AS rating,
      CASE WHEN s_suppkey % 2 = 0 THEN '2026-01-02' ELSE 'Jan 5, 2026' END AS time, CASE WHEN s_suppkey % 2 = 0 THEN 'body text' ELSE 'a rather long line of praise' END AS content, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'Color: red' END AS variation FROM supplier"""
)
def temu_reviews(spark, sf_dir):
    """Odd pages don't say where a review is: it is what stands around its stars."""
    named = F.concat(F.lit('<div id="all-reviews"><p>Customer reviews of this</p><div data-review-id="r1"><b data-testid="Author-x">'), F.col("s_name"), F.lit('</b><i aria-label="4.5 out of 5 stars"></i><time datetime="2026-01-02">x</time><p data-testid="review-text">body text</p></div></div>'))
    around = '<section><div><i aria-label="3 stars"></i><p>3 stars</p><p>Color: red</p><p>Jan 5, 2026</p><p>a rather long line of praise</p><p>Helpful (3) for everybody who wants one</p></div></section>'
    rows = _page(spark, sf_dir, F.when(F.col("s_suppkey") % 2 == 0, named).otherwise(F.lit(around)))
    found = markets.normalise_reviews(R.review_records(rows, "temu"), "temu")
    return found.select("page_id", "comment_id", "author", "rating", "time", "content", "variation")


@query("SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 4 > 0 THEN '1_star:' || s_suppkey || ',5_star:1200,all:9,commented:3' ELSE '' END AS filters, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey + 1200 ELSE 0 END::BIGINT AS total_rating FROM supplier")
def rating_overview_scan(spark, sf_dir):
    k = F.col("s_suppkey")
    button = lambda *x: F.concat(F.lit('<div class="product-rating-overview__filter">'), *x, F.lit("</div>"))
    shown = F.concat(F.lit('<div class="product-rating-overview">'), button(F.lit("5 Star (1.2K)")), button(F.lit("1 Star ("), k.cast("string"), F.lit(")")), button(F.lit("All (9)")), button(F.lit("With Comments (3)")), button(F.lit("Other (8)")), F.lit("</div>"))
    found = markets.rating_overview(_page(spark, sf_dir, F.when(k % 4 > 0, shown).otherwise(F.lit("<p>"))))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("detailed_rating"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), ",")
    return found.select("page_id", listed.alias("filters"), "total_rating")


@query(
    """SELECT s_suppkey AS page_id, s_name AS name, '₱' || s_suppkey || '.00' AS price, 'PHP' AS currency, 4.7::DOUBLE AS rating, 1200::BIGINT AS total_rating, 'https://i.example/1' AS img, 'B' AS brand, 'old' AS description FROM supplier WHERE s_suppkey % 3 > 0
    UNION ALL SELECT s_suppkey, 'was', 'was', NULL, 1.0::DOUBLE, 2, 'was', NULL, 'old' FROM supplier WHERE s_suppkey % 3 = 0"""
)
def json_ld_scan(spark, sf_dir):
    """The first product of a page's JSON-LD over what was known before; a broken script is passed over."""
    k = F.col("s_suppkey")
    item = F.concat(
        F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"x": [{"@type": ["A", "IndividualProduct"], "name": "'), F.col("s_name"),
        F.lit('", "image": [{"url": "https://i.example/1"}], "brand": {"name": "B"}, "offers": {"lowPrice": "'), k.cast("string"), F.lit('.00", "priceCurrency": "PHP"}, "aggregateRating": {"ratingValue": "4.7", "ratingCount": 1200}}]}]}</script>'),
    )
    rows = _page(spark, sf_dir, "<html>", F.when(k % 3 > 0, item).otherwise(F.lit("<p>no product")))
    found = P.records(rows, "page_id", lambda root: [{"ld": P.json_ld_of(root)}], "ld string")
    old = found.select("page_id", F.col("ld").alias("json_ld"), F.lit("was").alias("name"), F.lit("was").alias("price"), F.lit(None).cast("string").alias("currency"), F.lit(1.0).alias("rating"), F.lit(2).cast("long").alias("total_rating"), F.lit("was").alias("img"), F.lit(None).cast("string").alias("brand"), F.lit("old").alias("description"))
    return markets.apply_json_ld(old).select("page_id", "name", "price", "currency", "rating", "total_rating", "img", "brand", "description")


@query("SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 2 = 0 THEN 'new ' || s_name ELSE 'old' END AS name, 'kept' AS price FROM supplier")
def detail_scan(spark, sf_dir):
    """A detail page's fields over what the search page said; an empty or missing one changes nothing."""
    rows = _page(spark, sf_dir, "<h1>", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("new "), "s_name")).otherwise(F.lit("  ")), '</h1><div class="the-product-price"></div>')
    found = P.extract(rows, "page_id", ["h1"], {"name": [":text"], "price": ['[class*="product-price"]']})
    return found.select("page_id", P.prefer_new(F.col("name"), F.lit("old")).alias("name"), P.prefer_new(F.col("price"), F.lit("kept")).alias("price"))


@query("SELECT s_suppkey AS page_id, 'the longest of all the candidates' AS text FROM supplier WHERE s_suppkey % 2 = 0")
def review_root_choice(spark, sf_dir):
    """Of the elements that could hold a page's reviews the longest; short ones don't count."""
    k = F.col("s_suppkey")
    rows = _page(spark, sf_dir, '<p id="review-a">a text of twenty chars</p>', F.when(k % 2 == 0, F.lit('<p id="review-b">the longest of all the candidates</p>')).otherwise(F.lit("")), '<p id="Reviews">short</p>')
    found = P.extract(rows, "page_id", ['[id*="review" i]'], {"text": [":text"]})
    return P.review_root(found).where("text not like 'a text%'").select("page_id", "text")
