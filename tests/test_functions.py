"""Scalar functions against known values."""

import random

import pytest
from pyspark.sql import functions as F

from tindera.functions import numbers as N
from tindera.functions import text as T
from tindera.functions import urls as U
from tindera.functions.polarity import Polarity


def values(spark, column, inputs, kind="string"):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "column,pairs",
    [
        (N.compact_number, {"3,4k": 3400, "3.4K": 3400, "27k": 27000, "640": 640, "5,678": 5678, "1.5M": 1500000, "none at all": 0, "": 0, None: 0, "3.4K bought": 0, "5,678 comments": 0, "7.5K sold": 7500, "5,678 Ratings": 5678}),
        (N.leading_compact_number, {"7.5K+": 7500, "3,4k": 3400, "zero": 0, "5,678 bought": 5_678_000_000, None: 0}),
        (T.sold_count, {"7.5K+ sold": 7500, "5,678 bought": 5678, "new": 0}),
        (N.rating_from_text, {"3.9 / 5": 3.9, "Given 2 stars": 2.0, "no stars": 0.0, "38": 0.0}),
        (N.rating_from_phrase, {"3.6 out of five stars": 3.6, "no": 0.0}),
        (N.rating_from_card, {"Lamp\n₱ 870\n4.4": "4.4", "Lamp": "", "3.1\n4.2\nx": "4.2"}),
        (N.star_number, {"4_star": 4, "all": 6, None: 6}),
        (N.price_value, {"₱2,000 - ₱2,400": 2200.0, "â‚±315": 315.0, "": None, None: None, "₱1 ₱3 ₱99": 2.0}),
        (N.rating_value, {"4.5": 4.5, "5": 5.0, "5.1": None, "-1": None, "NaN": None, "x": None, None: None}),
        (N.risk_fraction, {"61": 0.61, "0.4": 0.4, "x": 0.0, None: 0.0, "-3": 0.0, "500": 1.0, "1": 1.0}),
        (N.risk_level, {"30": "Low", "31": "Moderate", "60.5": "Moderate", "61": "High", None: "Low"}),
        (T.slug, {"Desk Lamp / Shade": "desk_lamp_shade", "???": "search", None: "search", "_a__b_": "a__b"}),
        (T.price_from_text, {"Lamp\n₱ 870 - ₱ 2,040\nnew": "₱870-₱2,040", "x": ""}),
        (T.shipping_line, {"a\nFree Shipping today\nshipping": "Free Shipping today", "a": ""}),
        (T.label_of, {"its NEG or POS": "POS", "neg": "NEG", "neutral": "NEU", "": None}),
        (T.image_url, {"//a/b.png": "https://a/b.png", "http://x": "http://x", "data:x": ""}),
        (T.looks_like_date, {"2025-03-04 17:20": True, "8 May 2025": True, "Green": False, None: False}),
        (T.repair, {"â‚±71.50": "₱71.50", "😊 ok": "😊 ok", None: "", "a\xa0 b": "a b"}),
        (T.fingerprint, {"  LAMP, at Kahon!!!  ": "lamp at kahon", " 💙⭐️ ": "💙⭐️", "hnd ok": "hindi ok", None: "", "!!": "", "Ｆｕｌｌ straße": "full strasse", "a`b c_d": "a b c_d"}),
        (U.marketplace_or, {"https://www.lazada.com.ph/x": "lazada", "https://shopee.ph": "shopee", "http://m.temu.com/a?b": "temu", "https://example.com": None, "laptop": "shopee", "https://notshopee.ph.example.com/": None}),
        (U.shopee_product_url, {"https://shopee.ph/A-i.1.2?x=1": "https://shopee.ph/A-i.1.2", "/product/3/4": "https://shopee.ph/product/3/4", "https://other.ph/A-i.1.2": "", "": "", None: ""}),
        (U.lazada_product_url, {"//www.lazada.com.ph//products/a.html?b": "https://www.lazada.com.ph/products/a.html", "https://lazada.com.ph/x.html": ""}),
        (U.lazada_category_url, {"https://www.lazada.com.ph/shop-x/?a=1#b": "https://www.lazada.com.ph/shop-x/?a=1", "https://www.lazada.com.ph/": "", "https://www.lazada.com.ph/products/a.html": "", "https://www.lazada.com.ph/cart?x": ""}),
        (U.temu_product_url, {"https://www.temu.com/a-g-6010123.html": "https://www.temu.com/goods.html?goods_id=6010123", "https://m.temu.com/g.html?x=1&goods_id=123456": "https://www.temu.com/goods.html?goods_id=123456", "https://temu.com/?goods_id=12": "", "https://x.com/?goods_id=123456": ""}),
        (lambda c: U.category_page_url(c, F.lit(3)), {"https://www.lazada.com.ph/s/?PAGE=9&q=b": "https://www.lazada.com.ph/s/?q=b&page=3", "https://www.lazada.com.ph/s/": "https://www.lazada.com.ph/s/?page=3", "x/": "https://www.lazada.com.ph/x/?page=3"}),
        (lambda c: U.lazada_search_url(c, F.lit(0)), {"a b&c": "https://www.lazada.com.ph/catalog/?q=a+b%26c&page=1"}),
        (lambda c: N.money_text(c, F.lit("raw")), {"1234.5": "₱1,234", "x": "raw"}),
        (lambda c: N.count_value(c, F.lit(7)), {"1,234": 1234, "x": 7, "-4": 0, None: 7}),
        (lambda c: N.whole_if_integral(c.cast("double")), {"4.0": "4", "4.5": "4.5"}),
    ],
)
def test_scalars(spark, column, pairs):
    assert values(spark, column, list(pairs)) == list(pairs.values())


def test_structs(spark):
    found = values(spark, T.rating_filter, ["4 Star (3.4K)", "All (5,678)", "With Comments (36)", "With Media (14)", "", "2"])
    assert [(r.key, r["count"]) for r in found] == [("4_star", 3400), ("all", 5678), ("commented", 36), ("media", 14), ("", 0), ("2_star", 0)]
    lines = values(spark, T.label_line, ["Comment 3: POS", "4: neg", "a: b", "1:2:3", "9"])
    assert [r and tuple(r) for r in lines] == [(3, "POS"), (4, "NEG"), None, None, None]


def test_reliability_and_rounding(spark):
    frame = spark.createDataFrame([(61.0, None), (20.0, 0.75), (33.3, 75.0), (0.3, 0.1)], "a double, b double")
    assert [r.r for r in frame.select(N.reliability(F.col("a"), F.col("b")).alias("r")).collect()] == [39.0, 55.0, 41.7, 0.0]
    rnd = random.Random(4)
    values = [2.675, 0.05, 0.125, 0.375, -2.5, -0.125, 1e-9, 0.0, 28.05, 41.65, *(rnd.uniform(-200, 200) for _ in range(2000)), *(rnd.randint(-4000, 4000) / 32 for _ in range(500)), *(round(rnd.uniform(0, 9), 5) for _ in range(1000))]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", "v", *[N.round_half_even(F.col("v"), d).alias(f"d{d}") for d in (0, 1, 2, 4)]).collect()
    for d in (0, 1, 2, 4):
        assert [r[f"d{d}"] for r in table] == [round(r.v, d) for r in table]
    odd = spark.sql("select double('NaN') a, double(null) b").select(N.round_half_even(F.col("a"), 1).alias("x"), N.round_half_even(F.col("b"), 1).alias("y")).first()
    assert (odd.x, odd.y) == (None, None)


def test_lists(spark):
    frame = spark.createDataFrame([([],), (["b"],), (["b", "a"],), (["c", "a", "b"],)], "x array<string>")
    assert [r.y for r in frame.select(T.listed(F.col("x")).alias("y")).collect()] == ["", "b", "a and b", "a, b, and c"]


def test_marketplace_raises(spark):
    with pytest.raises(Exception, match="unsupported marketplace"):
        values(spark, U.marketplace, ["https://example.com/x"])
    with pytest.raises(ValueError):
        U.normalise_site("sg")


def test_highlight_and_keys(spark):
    assert T.highlighted("<b> Peke at super peke", ["peke", "super peke"]) == "&lt;b&gt; <mark>Peke</mark> at <mark>super <mark>peke</mark></mark>"
    assert T.highlighted("peking", ["PEK"]) == "<mark>pek</mark>ing" and T.highlighted(None, ["x", ""]) == "No written review"
    keys = spark.sql("select 'a' a, null b, '' c").select(T.review_key(F.col("a"), F.col("b")).alias("x"), T.review_key(F.col("a"), F.col("c")).alias("y"), T.review_key(F.lit(""), F.col("a")).alias("z")).first()
    assert keys.x == keys.y != keys.z


def test_fingerprint_keys(spark):
    some = ["Kahon, buo!", "ＫＡＨＯＮ　buo", "kahon hnd buo", "!!", "", None]
    keys = values(spark, T.fingerprint_key, some)
    assert keys[0] == keys[1] != keys[2] and keys[3:] == [None] * 3 and len(keys[0]) == T.KEY_BYTES


def test_polarity_rules():
    p = Polarity({"good": 1.9, "bad": -2.5, "nice": 1.8})
    base = p.scores("it is good")[3]
    assert p.scores("it is not good")[3] < 0 < base
    assert p.scores("it is very good")[3] > base > p.scores("it is slightly good")[3]
    assert p.scores("it is good!!")[3] > base and p.scores("bad but good")[3] > 0 > p.scores("good but bad")[3]
    assert p.scores("nothing known") == (0.0, 1.0, 0.0, 0.0) and p.scores("") == (0.0, 0.0, 0.0, 0.0)
    assert abs(base - 0.4404) < 1e-9  # the published value of one word of valence 1.9
    assert p.scores("(good)")[3] == p.scores("good!!!!!")[3] == 0 and p.scores('"good')[3] == base
    assert p.scores("a kiss of death")[3] == 0 and p.scores("it is kind of good")[3] < base
    assert p.tokens("x good, 'bad' !! it's") == ["good", "'bad'", "!!", "it's"]
