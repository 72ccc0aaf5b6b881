"""Operators of the review engine on small cases, and every query against its SQL."""

import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tindera.functions.text import fingerprint_key
from tindera.operators import evaluation, qualification, ranking, reviews, store, summary, views
from tindera.operators.text_model import TextModel
from tindera.plans import registry
from tindera.sources import pages, products, sinks
from tindera.streaming import collect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text,label,risks",
    [
        ("Swabe at ayos ang tunog", "positive", []), ("Hindi swabe ang takbo", "negative", []), ("Sakto sana pero madaling masira ang hawakan", "negative", ["durability"]),
        ("Walang sira at swabe ang takip", "positive", []), ("Scam ito at replica lang", "negative", ["counterfeit"]), ("Nasira agad kahapon", "negative", ["durability"]),
        ("DONT BUY", "negative", None), ("poor quality, no power", "negative", ["performance", "quality"]), ("😍⭐️", "positive", None), ("💔", "negative", None), ("hndi gumagana ang ilaw", "negative", ["performance"]),
        ("Kulay asul ito", "neutral", []), ("", "neutral", []), (None, "neutral", []),
    ],
)
def test_text_model(text, label, risks):
    found = TextModel().analysis(text)
    assert found["label"] == label and (risks is None or found["risk"]["categories"] == risks)
    if text and text.startswith("Walang"):
        assert [e["negated"] for e in found["risk"]["evidence"]] == [True]
    if not text:
        assert found["scores"]["neu"] == 1.0
    with pytest.raises(ValueError):
        TextModel(positive=0.0, negative=0.1)


def test_longest_terms_win():
    from tindera.functions.lexicon import RiskTerm

    m = TextModel([], [RiskTerm("a b", "x", 1, ""), RiskTerm("b c d", "y", 2, ""), RiskTerm("a", "z", 3, "")])
    assert [(e["term"], e["category"]) for e in m.risk_evidence("a b c d a")] == [("b c d", "y"), ("a", "z"), ("a", "z")]
    assert m.risk_evidence("xa ña aé") == []


def test_summary_and_duplicates(spark):
    rows = [("p", 0, "Ayos at sulit"), ("p", 1, "  AYOS at sulit!!!  "), ("p", 2, "Basag agad"), ("p", 3, " !! "), ("q", 0, "Ayos at sulit"), ("q", 1, "Basag at hindi gumagana")]
    frame = spark.createDataFrame(rows, "link string, pos int, content string")
    marked = reviews.mark_duplicates(summary.analyse_reviews(frame, TextModel()), fingerprint_key(F.col("content")))
    assert {(r.link, r.pos): r.duplicate_of for r in marked.collect() if r.is_duplicate} == {("p", 1): 0}
    out = {r.link: r for r in summary.summarise(marked, spark.createDataFrame([("p",), ("q",), ("none",)], "link string")).collect()}
    assert (out["p"].review_count, out["p"].duplicate_review_count, out["p"].risk_review_count, out["p"].all_reviews) == (2, 1, 1, 4)
    assert (out["q"].risk_review_count, out["q"].risk_score, out["q"].negative_ratio) == (1, 50.0, 0.5)
    assert (out["none"].review_count, out["none"].risk_score, out["none"].average_compound) == (0, 0.0, 0.0)
    words = {(r.link, r.term): r.n for r in summary.keyword_counts(marked).collect()}
    assert words[("p", "basag")] == 1 and words[("q", "hindi gumagana")] == 1
    back = reviews.attach(spark.createDataFrame([("p", []), ("none", [])], "link string, comments array<string>"), marked.select("link", "pos", "content", "label"))
    assert {r.link: [c.content for c in r.comments] for r in back.collect()} == {"p": [x[2] for x in rows[:4]], "none": []}
    assert reviews.mark_duplicates(frame.limit(0), fingerprint_key(F.col("content"))).count() == 0


def test_orders_and_labels(spark):
    frame = spark.createDataFrame([(0, [("b", 3, "NEG"), ("", 1, None), ("a", 0, None), ("c", 3, "<NEG/NEU/POS>")]), (1, [("d", 1, "")])], "ordinal int, comments array<struct<content:string,rating:int,label:string>>")
    ordered = frame.select(reviews.order_low_to_high(F.col("comments")).alias("c")).collect()
    assert [x.content for x in ordered[0].c] == ["", "b", "c", "a"]
    flat = reviews.flatten_unlabelled(frame).orderBy("global_index").collect()
    assert [(r.global_index, r.outer_idx, r.comment_idx) for r in flat] == [(0, 0, 2), (1, 0, 3), (2, 1, 0)]
    put = reviews.restore_labels(frame, spark.createDataFrame([(0, 2, "POS")], "outer_idx int, comment_idx int, label string")).orderBy("ordinal").collect()
    assert [c.label for c in put[0].comments] == ["NEG", None, "POS", "<NEG/NEU/POS>"] and put[1].comments[0].label == ""


def test_alternatives_equal_all_pairs(spark):
    names = [None, "", "  ", "C1", " c1 ", "c2", "C3"]
    rows = [(i, f"l{i}", names[i * 5 % 7], round(i * 7 % 13 + i % 4 * 0.04, 2), i % 3, i % 5 > 0) for i in range(60)] + [(60, "x", "alone", 1.0, 1, True), (61, "y", "none", 0.0, 0, False)]
    frame = spark.createDataFrame(rows, "ordinal int, link string, category string, reliability double, review_count int, analysed boolean")
    own = lambda c: (c or "").strip().lower()
    for k in (1, 3, 12, 70):
        want = {}
        for _, link, c, *_ in rows:
            others = [r for r in rows if r[1] != link and r[5]]
            want[link] = [r[1] for r in sorted(others, key=lambda r: (not (own(c) and own(r[2]) == own(c)), -round(r[3], 1), -r[4], r[0]))[:k]]  # noqa: B023
        got = {}
        for r in ranking.rank_alternatives(frame, k).orderBy("link", "rank").collect():
            got.setdefault(r.link, []).append(r.alternative)
        assert got == want


def test_evaluation(spark):
    frame = spark.createDataFrame([(" A", "a"), ("a", "b"), ("B", "b"), ("b", "b"), ("c", "a")], "x string, y string")
    pairs = evaluation.pair_counts(frame, F.col("x"), F.col("y"))
    m = evaluation.macro_metrics(pairs).first()
    assert (m.sample_count, m.accuracy) == (5, 0.6)
    assert m.precision == round((0.5 + 2 / 3 + 0) / 3, 4) and m.recall == round((0.5 + 1 + 0) / 3, 4)
    with pytest.raises(Exception, match="no labels"):
        evaluation.macro_metrics(pairs.limit(0)).collect()
    with pytest.raises(Exception, match="as many as"):
        spark.sql("select array('a') x, array() y").select(evaluation.paired_labels(F.col("x"), F.col("y"))).collect()
    cells = {(r.actual, r.predicted): r.n for r in evaluation.confusion_matrix(pairs).collect()}
    assert len(cells) == 9 and cells[("a", "b")] == 1 and cells[("c", "c")] == 0
    surveys = [([5, 1] * 5, 100.0), ([1, 5] * 5, 0.0), ([3] * 10, 50.0)]
    assert [r.s for r in spark.createDataFrame(surveys, "a array<int>, w double").select(evaluation.sus_score(F.col("a")).alias("s")).collect()] == [w for _, w in surveys]
    umux = [([7, 1, 7, 1], 100.0), ([1, 7, 1, 7], 0.0), ([4] * 4, 50.0)]
    assert [r.s for r in spark.createDataFrame(umux, "a array<int>, w double").select(evaluation.umux_score(F.col("a")).alias("s")).collect()] == [w for _, w in umux]
    with pytest.raises(Exception, match="SUS needs"):
        spark.createDataFrame([([3] * 9,)], "a array<int>").select(evaluation.sus_score(F.col("a"))).collect()
    e = spark.sql("select array(1d,2d,9d) a, array(1d,4d) b, array() c").select(evaluation.array_rmse(F.col("a"), F.col("b")).alias("x"), evaluation.array_rmse(F.col("a"), F.expr("cast(c as array<double>)")).alias("y")).first()
    assert (round(e.x, 6), e.y) == (round(2**0.5, 6), 0.0)
    assert evaluation.rmse(spark.createDataFrame([], "a double, b double"), F.col("a"), F.col("b")).first()[0] == 0.0


def test_price_bands_and_pages(spark):
    prices = [None, 499.99, 500.0, 1000.0, 1000.01, 2500.0, 2500.01]
    frame = spark.createDataFrame([(i, p, float(i), 0) for i, p in enumerate(prices)], "ordinal int, price_value double, reliability double, reviews int")
    found = {b: [r.ordinal for r in frame.where(views.in_band(F.col("price_value"), b)).orderBy("ordinal").collect()] for b in views.BANDS}
    assert list(found.values()) == [[0, 1, 2, 3, 4, 5, 6], [1], [2, 3], [4, 5], [6]]
    last = views.page(frame, views.sort_columns("price_high"), 99).collect()
    assert [(r.ordinal, r.page, r.pages) for r in last] == [(0, 1, 2)]
    assert views.page(frame.limit(0), views.sort_columns("reliability"), 3).count() == 0


def test_qualification(spark):
    frame = spark.createDataFrame([("a", "4.0", 100, ["x"]), ("b", "3.9", 99, ["x"]), ("c", None, None, ["x"])], "link string, rating string, reported_review_count int, comments array<string>")
    kept = {r.link: (r.qualification.status, r.qualification.reasons, r.comments) for r in qualification.apply_qualification(frame, 4.0, 100).collect()}
    assert kept["a"] == ("qualified", [], ["x"]) and kept["b"] == ("rejected", ["rating_below_minimum", "review_count_below_minimum"], []) and kept["c"][0] == "rejected"
    assert [r.link for r in qualification.apply_qualification(frame, 4.0, 100, keep_rejected=False).collect()] == ["a"]
    five = [1, 2, 3, 4, 5]
    cases = [("page_transition_failed", "5", five), ("next_button_disabled", "all", None), ("empty_review_page", "5", five), ("empty_review_page", "5", [5]), ("next_button_disabled", "4", None), ("no_reviews", None, None)]
    points = spark.createDataFrame([(i, (s, c), f) for i, (s, c, f) in enumerate(cases)], "i int, cp struct<stop_reason:string,context:string>, f array<int>")
    ends = points.select("i", qualification.terminal(F.col("cp"), F.col("f")).alias("any"), qualification.terminal(F.col("cp"), F.col("f"), 4).alias("four")).orderBy("i").collect()
    assert [(r["any"], r.four) for r in ends] == [(False, False), (True, True), (True, False), (False, False), (False, True), (True, True)]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    names = [c.split()[0] for c in store.SCHEMAS["products"].split(", ")]
    product = spark.range(1).select(*[F.lit("l" if n == "link" else None).cast(t).alias(n) for n, t in (c.split() for c in store.SCHEMAS["products"].split(", "))], F.lit(0).alias("ordinal"))
    review = spark.range(1).select(*[F.lit({"product_link": "l", "rating": "4", "sentiment": "positive"}.get(n)).cast(t).alias(n) for n, t in (c.split() for c in store.SCHEMAS["reviews"].split(", "))], F.lit(0).alias("ordinal"))
    s.save(product, review)
    s.save(product, review.withColumn("rating", F.lit(1)).withColumn("sentiment", F.lit(None).cast("string")))
    kept = s.read("reviews").collect()
    assert [(r.rating, r.sentiment) for r in kept] == [(4, None)] and s.read("products").columns == names
    form = spark.createDataFrame([(0, "t", "weekly", 90.0, 80.0, "{}"), (1, "u", "weekly", 90.0, 80.0, "{}")], "ordinal int, submitted_at string, shopping_frequency string, sus_score double, umux_score double, responses_json string")
    s.append("survey_responses", form.limit(1))
    s.append("survey_responses", form)
    assert sorted(r.id for r in s.read("survey_responses").collect()) == [1, 2, 3]
    assert {r.table: r.n for r in s.counts().collect()} == {"products": 1, "reviews": 1, "survey_responses": 3, "evaluation_runs": 0}
    assert store.orphans(s.read("reviews"), s.read("products")).count() == 0
    assert store.cascade(s.read("reviews"), s.read("products").limit(0)).count() == 0


def test_json_sources_and_sinks(spark, tmp_path):
    (tmp_path / "shopee_ph_a.json").write_bytes(b"\xef\xbb\xbf" + json.dumps([{"link": "x", "rating": "4.5"}, 7, {"link": "y", "rating": 3, "comments": [{"content": "ok"}]}, {"link": "x", "rating": 2}]).encode())
    (tmp_path / "lazada_ph_b.json").write_text(json.dumps({"products": [{"link": "z"}]}))
    (tmp_path / "temu_ph_bad.json").write_text('{"products": 1}')
    rows = products.typed_products(products.read_products(spark, str(tmp_path / "shopee_ph_a.json"))).orderBy("ordinal").collect()
    assert [(r.ordinal, r.link, r.rating) for r in rows] == [(0, "x", "4.5"), (2, "y", "3"), (3, "x", "2")] and rows[1].comments[0].content == "ok"
    assert products.read_products(spark, str(tmp_path / "lazada_ph_b.json")).count() == 1
    with pytest.raises(Exception, match="no list of products"):
        products.read_products(spark, str(tmp_path / "temu_ph_bad.json")).collect()
    again = products.resume_products(spark, str(tmp_path / "shopee_ph_a.json")).select("ordinal", "link", products.field("rating").alias("rating")).orderBy("ordinal").collect()
    assert [tuple(r) for r in again] == [(0, "x", "2"), (2, "y", "3")]
    assert products.resume_products(spark, str(tmp_path / "temu_ph_bad.json")).count() == 0
    os.utime(tmp_path / "temu_ph_bad.json", (2e9, 2e9))
    found, warning = products.first_usable(spark, str(tmp_path))
    assert found.count() in (1, 3) and "no list of products" in warning
    frame = spark.createDataFrame([(1, "₱ü", None)], "a int, b string, c string")
    assert json.loads(b"".join(sinks.json_array(frame))) == [{"a": 1, "b": "₱ü", "c": None}] and b"".join(sinks.json_array(frame.limit(0))) == b"[]"
    assert b"".join(sinks.csv_export(frame)) == "﻿a,b,c\r\n1,₱ü,\r\n".encode() and b"".join(sinks.csv_export(frame.limit(0))) == b""
    sinks.snapshot(spark, sinks.json_array(frame), f"file://{tmp_path}/out.json")
    sinks.snapshot(spark, sinks.json_array(frame), f"file://{tmp_path}/out.json")
    assert json.loads((tmp_path / "out.json").read_text())[0]["b"] == "₱ü"
    assert sinks.analysed_path("/x/a.csv") == "/x/a_analyzed.csv"
    with pytest.raises(ValueError):
        sinks.write_analysed(frame, "/x/a.json", "/x/a.json")
    sinks.save_discovery_checkpoint(spark, f"file://{tmp_path}/cp.json", {"q": 1}, {"p": -2}, 5)
    assert products.read_discovery_checkpoint(spark, str(tmp_path / "cp.json"), {"q": 1})["completed_pages"] == {"p": 0}
    assert products.read_discovery_checkpoint(spark, str(tmp_path / "cp.json"), {"q": 2}) is None
    (tmp_path / "r.csv").write_text('﻿label,prediction,note\nA,b,"two\nlines"\n')
    assert [tuple(r) for r in products.read_evaluation_csv(spark, str(tmp_path / "r.csv")).collect()] == [("A", "b")] or products.read_review_csv(spark, str(tmp_path / "r.csv")).columns[0] == "label"
    (tmp_path / "lex.tsv").write_text("# c\n\nPeke\tcounterfeit\t3\ttl\nSira na\tdefect\t2\ttl\n")
    from tindera.functions.lexicon import read_lexicon, terms_of

    assert [t.term for t in terms_of(read_lexicon(spark, str(tmp_path / "lex.tsv"), "risk"), "risk")] == ["peke", "sira na"]


def test_pages(spark):
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"@type": ["Product"], "name": "N", "image": [{"url": "u"}], "brand": {"name": "B"}, "offers": {"lowPrice": "199.00", "priceCurrency": "PHP"}, "aggregateRating": {"ratingValue": "4.7", "ratingCount": 1200}}]}</script>'
    item = pages.json_ld_product("<html><script type='application/ld+json'>broken</script>" + ld)
    r = spark.createDataFrame([(item,)], "x string").select(pages.json_ld_fields(F.col("x")).alias("f")).first().f
    assert (r.name, r.img, r.brand, r.price, r.currency, r.rating, r.total_rating) == ("N", "u", "B", "₱199.00", "PHP", 4.7, 1200)
    assert pages.json_ld_product("<p>none") is None
    html = '<ul><li class="card x"><a href="/p1">One<br>two</a><span class="price">₱5</span></li><li class="card"><a href="/p2"></a></li></ul>'
    frame = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    rows = pages.extract(frame, "page_id", ["div.none", "li.card"], {"link": ["a@href"], "name": ["b", "a"], "price": [".price"], "lines": [":lines"]}).orderBy("place").collect()
    assert [(r.page_id, r.place, r.link, r.name, r.price) for r in rows] == [(1, 0, "/p1", "One two", "₱5"), (1, 1, "/p2", "", "")] and rows[0].lines == "One\ntwo\n₱5"


def test_collection(spark, tmp_path):
    kind = "product string, identity string, page long, pos long"
    stored, new = spark.createDataFrame([("p", "old", 0, 0)], kind), spark.createDataFrame([("p", "old", 1, 0), ("p", "new", 2, 0), ("p", "more", 3, 0)], kind)
    assert [r.identity for r in collect.collect(stored, new, 2).orderBy("rank").collect()] == ["old", "new"]
    counts = spark.createDataFrame([("a", i, n) for i, n in enumerate([1, 5, 5, 5, 6])] + [("b", 0, 1)], "product string, round int, n int")
    assert {r["product"]: r.stop_round for r in collect.stop_after_unchanged(counts, 2).collect()} == {"a": 3, "b": None}
    for k, rows in enumerate(([("p", "a", 1, 0), ("p", "b", 1, 1), ("q", "z", 1, 0)], [("p", "a", 2, 0), ("p", "c", 2, 1), ("p", "d", 2, 2)])):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    running = collect.collect_stream(stream, 3).writeStream.format("memory").queryName("collected").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    running.processAllAvailable()
    running.stop()
    final = {r["product"]: (r.collected, r.stop_reason) for r in spark.sql("select product, max_by(struct(collected, stop_reason), page) x from collected group by product").select("product", "x.*").collect()}
    assert final == {"p": (3, "target_reached"), "q": (1, None)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries(spark, tmp_path, name):
    registry.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/rows")  # as the driver does: written, not only collected
    found = spark.read.parquet(f"{tmp_path}/rows").toPandas()
    if name not in registry.ORACLES:
        return
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    want = con.execute(registry.ORACLES[name]).df()
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    shape = lambda d: sorted(repr([plain(v) for v in row]) for row in d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist())
    assert sorted(found.columns) == sorted(want.columns) and shape(found) == shape(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
