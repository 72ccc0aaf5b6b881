"""Whole analyses, and marketplace pages."""

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from tindera.operators.text_model import TextModel
from tindera.plans import analyse
from tindera.sources import markets


def test_product_file(spark, tmp_path):
    one = {"link": "a", "own": {"x": [1, None]}, "comments": [{"content": "Ayos at sulit", "rating": 5}, None, {"text": "AYOS at sulit!"}, {"comment": "Basag at hindi gumagana"}, "x", {"content": None, "text": "basag"}]}
    items = [one, 5, {"name": "no link"}, {"link": "a", "comments": [{"review": 0}]}, {"link": "b", "comments": None}]
    (tmp_path / "in.json").write_text(json.dumps({"when": [1], "products": items}), encoding="utf-8-sig")
    out = analyse.analyse_file(spark, str(tmp_path / "in.json"), TextModel())
    assert out == str(tmp_path / "in_analyzed.json")
    found = json.loads((tmp_path / "in_analyzed.json").read_text())
    assert found["when"] == [1] and len(found["products"]) == 5
    rows = found["products"]
    s = rows[0]["sentiment_summary"]
    assert (s["review_count"], s["duplicate_review_count"], s["risk_score"], s["sentiment_counts"]["positive"], s["risk_categories"]) == (2, 1, 50.0, 1, {"defect": 1, "performance": 1})
    assert [c.get("duplicate_of", "-") if isinstance(c, dict) else c for c in rows[0]["comments"]] == [None, None, 0, None, "x", None]
    assert rows[0]["comments"][5]["sentiment_analysis"]["label"] == "neutral" and rows[0]["own"] == one["own"] and rows[0]["comments"][0]["rating"] == 5
    assert rows[1] == 5 and rows[2]["sentiment_summary"]["review_count"] == 0 and rows[3]["sentiment_summary"]["review_count"] == 0 and rows[4] == {"link": "b", "comments": None}
    assert rows[0]["comments"][0]["sentiment_analysis"]["risk"] == {"detected": False, "score": 0.0, "categories": [], "evidence": []}
    analyse.analyse_file(spark, str(tmp_path / "in.json"), TextModel())  # an earlier result is replaced as a whole
    with pytest.raises(ValueError):
        analyse.analyse_file(spark, str(tmp_path / "in.json"), TextModel(), str(tmp_path / "in.json"))
    with pytest.raises(ValueError):
        analyse.analyse_file(spark, str(tmp_path / "in.txt"), TextModel())
    folder = analyse.analyse_file(spark, str(tmp_path / "in.json"), TextModel(), f"{tmp_path}/folder", one_file=False)
    assert spark.read.text(folder).count() == 5
    cache = analyse.AnalysisCache(TextModel())
    once = cache.get(spark, str(tmp_path / "in.json"), 1)
    assert once.count() == 4 and cache.get(spark, str(tmp_path / "in.json"), 1) is once and cache.get(spark, str(tmp_path / "in.json"), 2) is not once
    (tmp_path / "shopee_ph_x.json").write_text(json.dumps(items[2:3]))
    analyse.save_back(spark, str(tmp_path / "shopee_ph_x.json"), TextModel())
    assert json.loads((tmp_path / "shopee_ph_x.json").read_text())[0]["sentiment_summary"]["risk_score"] == 0.0


def test_review_file(spark, tmp_path, capsys):
    (tmp_path / "in.csv").write_text('content,n\n"Basag,\nnasira",1\nok,2\n"basag nasira",3\n,4\n', encoding="utf-8-sig")
    out = analyse.analyse_file(spark, str(tmp_path / "in.csv"), TextModel())
    raw = (tmp_path / "in_analyzed.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfcontent,n,sentiment_label,sentiment_positive") and out.endswith("in_analyzed.csv")
    rows = list(csv.DictReader(io.StringIO(raw.decode("utf-8-sig"))))
    assert [(r["risk_detected"], r["is_duplicate"], r["duplicate_of"]) for r in rows] == [("True", "False", ""), ("False", "False", ""), ("True", "True", "0"), ("False", "False", "")] and len(rows[0]) == 15
    assert rows[0]["risk_categories"] == "defect,durability" and json.loads(rows[0]["risk_evidence"])[0]["term"] == "nasira"
    assert rows[0]["risk_evidence"] == json.dumps(json.loads(rows[0]["risk_evidence"]), ensure_ascii=False)
    (tmp_path / "none.csv").write_text("content\n")
    with pytest.raises(ValueError):
        analyse.analyse_file(spark, str(tmp_path / "none.csv"), TextModel())
    assert analyse.main(["--text", "Basag"]) == 0 and '"label": "negative"' in capsys.readouterr().out


def test_market_pages(spark):
    html = '<a href="/Stand-i.1.2?sp=1" title="Stand"><img src="//c/x.png">Stand<br>₱ 1,299<br>4.9<br>2.5K sold<br>Free shipping</a><a href="/about">x</a><a href="/Stand-i.1.2">again</a>'
    r = markets.product_cards(spark.createDataFrame([(1, html)], "page_id long, html string"), "shopee").collect()
    assert [(x.link, x.name, x.price, x.rating, x.sold_count, x.shipping, x.img) for x in r] == [("https://shopee.ph/Stand-i.1.2", "Stand", "₱1,299", 4.9, 2500, "Free shipping", "https://c/x.png")]
    raw = spark.createDataFrame([("1", "A", "Rated 4 stars", "0", "t", " two \n lines ", "1,2k"), ("2", "B", "", "3", "t", "", "")], "comment_id string, author string, rating_label string, active_stars string, time string, content string, helpful string")
    found = markets.normalise_reviews(raw, "lazada").orderBy("comment_id").collect()
    assert [(x.rating, x.content, x.like_count) for x in found] == [(4, "two lines", 1200), (3, "", 0)] and markets.normalise_reviews(raw, "lazada", include_empty=False).count() == 1
    seeds = spark.createDataFrame([("https://shopee.ph/a-i.1.2",), ("https://x.y/z",)], "x string").select(markets.product_from_link(F.col("x"), "shopee").alias("p")).collect()
    assert seeds[0].p.link == "https://shopee.ph/a-i.1.2" and seeds[1].p is None


def test_counts_and_json_ld(spark):
    kind = "link string, total_rating int, reported_review_count int, price string, rating double, comments array<struct<comment_id:string,author:string,time:string,content:string,rating:int>>, json_ld string"
    ld = json.dumps({"@type": "Product", "offers": {"price": "5", "priceCurrency": "PHP"}})
    frame = spark.createDataFrame([("a", 0, 412, "x", 4.0, [("1", "a", "t", "c", 5), ("1", "b", "u", "d", 4), (None, "a", "t", "c", 5)], ld)], kind)
    r = markets.review_counts(frame).first()
    assert (r.written_reviews_collected, r.reported) == (2, 0)
    r = markets.apply_json_ld(frame).first()
    assert (r.price, r.rating) == ("₱5", 4.0)
