"""Queries of single functions, predicates, the discovery queue, and collection as a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..operators import evaluation as E
from ..operators import qualification as Q
from ..operators import ranking, reviews, summary, views
from ..sources import markets
from ..streaming import collect as C
from .base import fixture_folder, query, table


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey")).withColumn("s", F.col("p_size").cast("string"))


@query("SELECT p_partkey, CASE WHEN p_size < 50 THEN p_size / 10.0 ELSE 0 END::DOUBLE AS lazada, (p_size // 10)::DOUBLE + (p_size % 10) / 10.0 AS temu, CASE WHEN p_size <= 50 THEN (p_size // 10) || '.' || p_size % 10 ELSE '' END AS card FROM part")
def rating_texts(spark, sf_dir):
    shown = F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"))
    lazada = F.when(F.col("p_size") < 50, F.concat(F.lit("Rated "), shown, F.lit(" / 5"))).otherwise(F.lit("unrated 60"))
    return _part(spark, sf_dir).select("p_partkey", N.rating_from_text(lazada).alias("lazada"), N.rating_from_phrase(F.concat(shown, F.lit(" out of five stars"))).alias("temu"), N.rating_from_card(F.concat(F.lit("₱ 5\n1.1\n "), shown, F.lit(" \nsold"))).alias("card"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 BETWEEN 1 AND 5 THEN p_size % 7 ELSE 6 END::INT AS star, CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE (p_size / 2.0)::DECIMAL(9,1)::VARCHAR END AS shown, CASE WHEN p_size % 3 = 0 THEN p_size * 1000 WHEN p_size % 3 = 1 THEN 7 ELSE 0 END::BIGINT AS sampled, repeat('★', least(5, p_size % 8)::INT) AS stars FROM part")
def star_and_count_texts(spark, sf_dir):
    size = F.col("p_size")
    given = F.when(size % 3 == 0, F.concat("s", F.lit(",000"))).when(size % 3 == 1, "many").otherwise(F.concat(F.lit("-"), "s"))
    return _part(spark, sf_dir).select(
        "p_partkey", N.star_number(F.concat((size % 7).cast("string"), F.lit("_star"))).alias("star"), N.whole_if_integral((size / 2).cast("double")).alias("shown"), N.count_value(given, F.lit(7)).alias("sampled"), T.stars(size % 8).alias("stars")
    )


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '₱' || format('{:,}', round_even(p_retailprice, 0)::BIGINT) WHEN p_size % 3 = 1 THEN 'ask' ELSE 'Price unavailable' END AS money FROM part")
def money_texts(spark, sf_dir):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return _part(spark, sf_dir).select("p_partkey", N.money_text(F.when(size % 3 == 0, price), F.when(size % 3 == 1, "ask").when(size % 3 == 2, "")).alias("money"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 16, 3)::DOUBLE AS finer, round_even(l_quantity / 8, 2)::DOUBLE AS tie, round_even(l_quantity / 4, 1)::DOUBLE AS tenth FROM lineitem")
def rounding(spark, sf_dir):
    """Half to even on the binary value, with ties."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", N.round_half_even(F.col("l_quantity") / 16, 3).alias("finer"), N.round_half_even(F.col("l_quantity") / 8, 2).alias("tie"), N.round_half_even(F.col("l_quantity") / 4, 1).alias("tenth"))


@query("SELECT p_partkey, CASE WHEN r >= 0.61 THEN 'Not recommended — strong counterfeit or defect indicators detected' WHEN r >= 0.31 THEN 'Review carefully — moderate risk indicators detected' ELSE 'Lower risk — fewer defect indicators detected in this sample' END AS alert, r * 100 AS percent, CASE WHEN r >= 0.6 THEN 'red' WHEN r >= 0.3 THEN 'amber' ELSE 'green' END AS band FROM (SELECT p_partkey, CASE WHEN p_size * 2 > 1 THEN p_size * 2 / 100::DOUBLE END AS r FROM part)")
def risk_gauge(spark, sf_dir):
    score = F.col("p_size") * 2
    gauge = views.gauge(score)
    return _part(spark, sf_dir).select("p_partkey", N.alert_text(score).alias("alert"), gauge["percent"].alias("percent"), gauge["band"].alias("band"))


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS negative, count(*) FILTER (l_returnflag = 'N') AS neutral, count(*) FILTER (l_returnflag = 'R') AS positive, round_even(100 * (count(*) FILTER (l_returnflag = 'A') / count(*)), 1)::DOUBLE AS negative_percent, round_even(100 * (count(*) FILTER (l_linestatus = 'O') / count(*)), 1)::DOUBLE AS failure_percent FROM lineitem GROUP BY l_orderkey")
def score_breakdown(spark, sf_dir):
    """The datasets of the sentiment chart and of the score's breakdown."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("link"), F.when(F.col("l_returnflag") == "A", "negative").when(F.col("l_returnflag") == "N", "neutral").otherwise("positive").alias("label"),
        F.lit(0.0).alias("compound"), (F.col("l_linestatus") == "O").alias("detected"), F.lit(False).alias("is_duplicate"), F.lit("x").alias("fingerprint"),
    )
    s = summary.summarise(rows, rounded=False)
    percent = lambda c: N.round_half_even(100 * F.col(c), 1)
    return s.select(F.col("link").alias("l_orderkey"), "negative", "neutral", "positive", percent("negative_ratio").alias("negative_percent"), percent("keyword_failure_rate").alias("failure_percent"))


@query("SELECT p_partkey, 'https://www.lazada.com.ph/catalog/?q=a+%26+' || p_partkey || '&page=' || greatest(1, p_size % 4) AS lazada, 'shopee.ph' AS site FROM part")
def search_urls(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", U.lazada_search_url(F.concat(F.lit("a & "), F.col("k").cast("string")), F.col("p_size") % 4).alias("lazada"), F.lit(U.normalise_site("ph")).alias("site"))


@query("SELECT p_partkey, '₱' || p_size || ',299-₱' || p_size || ',599' AS price, 'Free Shipping ' || p_size AS shipping, CASE WHEN p_size % 3 = 0 THEN 'https://i.example/' || p_size WHEN p_size % 3 = 1 THEN 'http://i.example/' || p_size ELSE '' END AS img, left(p_name, 5) AS short, p_size::BIGINT * 1000 AS sold, p_size::BIGINT AS total FROM part")
def card_texts(spark, sf_dir):
    s, size = F.col("s"), F.col("p_size")
    lines = F.concat(F.lit("Deal\n₱ "), s, F.lit(",299 - ₱ "), s, F.lit(",599\nFree Shipping "), s, F.lit("\nno shipping\n"), s, F.lit("K+ bought\n"), s, F.lit(" Ratings"))
    img = F.when(size % 3 == 0, F.concat(F.lit("//i.example/"), s)).when(size % 3 == 1, F.concat(F.lit("http://i.example/"), s)).otherwise("data:image/x")
    return _part(spark, sf_dir).select("p_partkey", T.price_from_text(lines).alias("price"), T.shipping_line(lines).alias("shipping"), T.image_url(img).alias("img"), views.short_name(F.col("p_name"), 5).alias("short"), T.sold_count(lines).alias("sold"), T.review_count(lines).alias("total"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN p_partkey::INT END AS index, CASE p_size % 5 WHEN 0 THEN 'POS' WHEN 1 THEN 'NEG' WHEN 2 THEN 'NEU' END AS label, p_size % 3 < 2 AS dated FROM part")
def label_lines(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in (": pos and neg", ": <NEG>", ": neutral", ": ?", " 1:2:POS")]), (F.col("p_size") % 5 + 1).cast("int"))
    line = T.label_line(F.concat(F.lit("Comment "), F.col("k").cast("string"), said))
    dated = F.element_at(F.array(F.lit("2025-03-04 17:20"), F.lit("8 May 2025"), F.lit("Green 2025")), (F.col("p_size") % 3 + 1).cast("int"))
    return _part(spark, sf_dir).select("p_partkey", line["index"].alias("index"), line["label"].alias("label"), T.looks_like_date(dated).alias("dated"))


@query("SELECT p_partkey, true AS iso, 'a\\s+b' AS term, regexp_matches(p_name, '(?i)(^|\\W)part(\\W|$)') AS has FROM part")
def term_pattern(spark, sf_dir):
    now = T.iso_now()
    shown = F.replace(F.replace(F.lit(T.term_regex("a b")), F.lit(r"(?iU)(?<!\w)"), F.lit("")), F.lit(r"(?!\w)"), F.lit(""))
    return _part(spark, sf_dir).select("p_partkey", now.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$").alias("iso"), shown.alias("term"), F.col("p_name").rlike(T.term_regex("part")).alias("has"))


@query("SELECT choice, count(*) FILTER (CASE choice WHEN 'All' THEN true WHEN 'Flagged' THEN l_linestatus = 'O' WHEN 'Positive' THEN l_returnflag = 'R' WHEN 'Neutral' THEN l_returnflag = 'N' ELSE l_returnflag = 'A' END) AS n FROM lineitem CROSS JOIN (VALUES ('All'), ('Positive'), ('Neutral'), ('Negative'), ('Flagged')) c(choice) GROUP BY choice")
def sentiment_choice(spark, sf_dir):
    label = F.when(F.col("l_returnflag") == "A", "negative").when(F.col("l_returnflag") == "N", "neutral").otherwise("positive")
    choices = ("All", "Positive", "Neutral", "Negative", "Flagged")
    counts = table(spark, sf_dir, "lineitem").agg(*[F.count_if(views.sentiment_filter(c, label, F.col("l_linestatus") == "O")).alias(c) for c in choices])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("choice"), F.col(c).alias("n")) for c in choices])).alias("x")).select("x.*")


@query("SELECT p_partkey, 'Temu PH' AS platform FROM part WHERE p_partkey % 3 = 2")
def platform_filter(spark, sf_dir):
    """A stated platform, else the link's."""
    k = F.col("k")
    stated = F.when(k % 3 == 0, " Shopee ").when(k % 3 == 1, "unknown")
    link = F.when(k % 3 == 1, "https://www.lazada.com.ph/x").when(k % 3 == 2, "https://temu.com/x")
    rows = _part(spark, sf_dir).withColumn("platform", U.platform_name(U.product_platform(stated, link)))
    return rows.where(F.col("platform").isin("Temu PH", "Elsewhere")).select("p_partkey", "platform")


@query("SELECT p_partkey, CASE WHEN p_size / 10.0 >= 2.5 AND p_partkey % 200 >= 100 THEN 2 ELSE 0 END AS comments, p_partkey % 2 = 0 AND NOT (p_size / 10.0 >= 2.5 AND p_partkey % 200 >= 100) AS known, p_partkey IN (SELECT p_partkey FROM part WHERE p_size / 10.0 >= 2.5 AND p_partkey % 200 >= 100) AS in_strict FROM part")
def qualification_effects(spark, sf_dir):
    """Rejected products lose their reviews, or go altogether; earlier rejections count under the same minima only."""
    rows = _part(spark, sf_dir).select("p_partkey", (F.col("p_size") / 10).alias("rating"), (F.col("k") % 200).alias("reported_review_count"), F.array(F.lit("a"), F.lit("b")).alias("comments"))
    kept = Q.apply_qualification(rows, 2.5, 100)
    strict = Q.apply_qualification(rows, 2.5, 100, keep_rejected=False).select("p_partkey", F.lit(True).alias("s"))
    saved = F.struct(F.col("qualification.status").alias("status"), F.when(F.col("p_partkey") % 2 == 0, 2.5).otherwise(3.0).alias("min_rating"), F.lit(100).alias("min_reviews"))
    return kept.join(strict, "p_partkey", "left").select("p_partkey", F.size("comments").alias("comments"), Q.rejected_before(saved, 2.5, 100).alias("known"), F.coalesce("s", F.lit(False)).alias("in_strict"))


@query("SELECT l_orderkey, count(*) FILTER (l_quantity::INT % 3 > 0) > 0 AND count(*) FILTER (l_quantity::INT % 3 = 1) = 0 AS all_two, count(*) FILTER (l_linenumber > 1) AS written FROM lineitem GROUP BY l_orderkey")
def star_filter_check(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_quantity").cast("int") % 3).alias("r")).alias("ratings"), F.count_if(reviews.written(F.when(F.col("l_linenumber") > 1, "x").when(F.col("l_linenumber") == 1, "  "))).alias("written"))
    return own.select("l_orderkey", reviews.all_of_star(F.col("ratings"), F.lit(2)).alias("all_two"), "written")


@query("SELECT page_id, page_id % 4 = 0 AS shopee, page_id % 4 IN (1, 2) AS lazada, page_id % 4 IN (0, 1, 3) AS temu FROM pages")
def block_pages(spark, sf_dir):
    k = F.col("page_id") % 4
    url = F.when(k == 0, "https://x.example/Buyer/LOGIN?a").when(k == 1, "https://x.example/a/verify").otherwise("https://x.example/?captcha=login")
    url = F.when(k == 0, "https://x.example/security-check/verify-login").otherwise(url)
    title, body = F.when(k == 2, "Security Verification needed"), F.when(k == 3, "please VERIFY you are human")
    rows = table(spark, sf_dir, "pages")
    found = {m: Q.is_block_page(m, url, F.when(k == 2, "Verify your identity") if m != "lazada" else title, body) for m in ("shopee", "lazada", "temu")}
    return rows.select("page_id", (found["shopee"] & (k == 0)).alias("shopee"), (found["lazada"] & (k != 0)).alias("lazada"), found["temu"].alias("temu"))


@query("SELECT o_orderkey, least(o_orderkey % 7, 5) + CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 0 END AS target, CASE WHEN o_orderkey % 3 = 0 THEN 'no_reviews' ELSE 'review_widget_missing' END AS reason, greatest(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 11 END, 0), o_orderkey % 5) AS pages FROM orders")
def collection_targets(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.target(k % 7, F.lit(5)).alias("target"), Q.missing_reviews_reason(F.when(k % 3 > 0, k % 3)).alias("reason"), Q.completed_pages(F.when(k % 2 == 0, k % 11), k % 5).alias("pages"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'retryable_error' WHEN 1 THEN 'rejected' WHEN 2 THEN 'complete' WHEN 3 THEN 'scraping' WHEN 4 THEN 'checking' ELSE 'discovered' END AS status FROM orders")
def discovery_states(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    product = F.struct(
        F.when(k == 0, "timed out").otherwise("").alias("last_error"), F.struct(F.when(k == 1, "rejected").alias("status")).alias("qualification"),
        F.when(k == 2, "no_reviews").when(k == 3, "collecting").alias("review_status"), F.when(k == 4, "checking").alias("discovery_status"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", Q.discovery_status(product).alias("status"))


@query(
    """SELECT coalesce(o.k, n.k)::VARCHAR AS link, CASE WHEN n.k IS NOT NULL AND n.k % 2 = 0 THEN 'new' ELSE o.name END AS name, CASE WHEN o.k IS NOT NULL THEN 'p' END AS price,
      CASE WHEN n.k IS NOT NULL THEN 'checking' ELSE 'complete' END AS discovery_status, CASE WHEN n.k % 5 = 0 THEN 'late' ELSE CASE WHEN n.k IS NULL THEN 'old' ELSE '' END END AS last_error
    FROM (SELECT s_suppkey AS k, 'old' AS name FROM supplier WHERE s_suppkey % 3 > 0) o FULL JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 > 0) n ON o.k = n.k WHERE o.k IS NOT NULL OR n.k % 7 > 0"""
)
def discovery_upsert(spark, sf_dir):
    """Products put into the queue: what they have replaces the entry's, without a source only known ones count."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    queue = rows.where(k % 3 > 0).select(k.cast("string").alias("link"), F.lit("old").alias("name"), F.lit("p").alias("price"), F.lit("complete").alias("discovery_status"), F.lit("old").alias("last_error"))
    new = rows.where(k % 4 > 0).select(k.cast("string").alias("link"), F.when(k % 2 == 0, "new").alias("name"), F.when(k % 7 > 0, "category").alias("discovery_source"), k.alias("k"), F.lit("not kept").alias("extra"))
    return Q.upsert_discovery(queue, new, F.lit("checking"), F.when(F.col("k") % 5 == 0, "late")).select("link", "name", "price", "discovery_status", "last_error")


@query("SELECT s_suppkey::VARCHAR AS link, CASE WHEN s_suppkey % 3 = 0 THEN 'stored' ELSE 'new' END AS part, (s_suppkey % 5 < 2)::INT AS complete_page FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey % 2 = 0")
def resume_and_new(spark, sf_dir):
    """Stored products that are to be gone on with, and newly found ones that aren't stored; a page cut by the cap isn't complete."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("link"), k.alias("ordinal"))
    stored = rows.where("ordinal % 3 = 0")
    again, _ = C.resume(stored, F.col("ordinal") % 2 == 0)
    found = C.new_only(rows.unionAll(rows.withColumn("ordinal", F.col("ordinal") + 1000000)), stored)
    both = again.select("link", F.lit("stored").alias("part")).unionByName(found.select("link", F.lit("new").alias("part")))
    n = F.col("link").cast("long") % 5
    return both.select("link", "part", C.page_complete(F.lit(4), F.when(n < 3, 4).otherwise(3), n == 2).cast("int").alias("complete_page"))


@query("SELECT user_id AS product, event_id AS page FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE event_id % 5 = 0 OR k = 1")
def checkpoint_pages(spark, sf_dir):
    return C.checkpoints(table(spark, sf_dir, "events").select(F.col("user_id").alias("product"), F.col("event_id").alias("page")), 5)


@query("SELECT user_id::VARCHAR AS product, least(count(DISTINCT event_type || props), 10) AS collected, CASE WHEN count(DISTINCT event_type || props) >= 10 THEN 'target_reached' END AS stop_reason FROM events GROUP BY user_id")
def collect_stream(spark, sf_dir):
    """The page-by-page collection as a stream with state, run over all pages there are; the last state of each product."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("product"), F.concat("event_type", "props").alias("identity"), F.col("event_id").alias("page"), F.lit(0).cast("long").alias("pos"))
    folder = fixture_folder(spark)
    for part in range(3):
        rows.where(F.col("page") % 3 == part).write.parquet(f"{folder}/in/{part}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", True).parquet(f"{folder}/in")

    def save(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    C.collect_stream(stream, 10).writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(f"{folder}/out").groupBy("product").agg(F.max_by(F.struct("collected", "stop_reason"), "batch").alias("r"))
    return states.select("product", F.least(F.col("r.collected"), F.lit(10)).alias("collected"), "r.stop_reason")


@query("SELECT DISTINCT user_id AS product, event_type AS identity FROM events")
def dedupe_stream(spark, sf_dir):
    """Each identity once within the watermark, on a stream with event time."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("product"), F.col("event_type").alias("identity"), F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("ts"))
    folder = fixture_folder(spark)
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    C.dedupe_stream(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("product", "identity")


@query("SELECT o_orderkey, 'c' || (o_orderkey % 3) || ',d' AS kept, 3 AS pairs, sqrt((1 + 4) / 2.0::DOUBLE) AS error FROM orders")
def array_evaluation(spark, sf_dir):
    """Indices without a label; labels by place; an error by place, cut to the shorter array."""
    k = F.col("o_orderkey")
    wanted = F.array(F.lit("d"), F.lit("a"), F.concat(F.lit("c"), (k % 3).cast("string")), F.lit("b"))
    names = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    error = E.array_rmse(F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0)), F.array(F.lit(2.0), F.lit(4.0)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(reviews.missing_places(wanted, F.array(F.lit("a"), F.lit("b"))), ",").alias("kept"), F.size(E.paired_labels(names, names)).alias("pairs"), error.alias("error"))


@query("SELECT s_suppkey AS ordinal, s_name AS name FROM supplier WHERE s_suppkey = 4 UNION ALL SELECT s_suppkey, 'first' FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)")
def selected_product(spark, sf_dir):
    """The product of a link, and the first one for a link that isn't there."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").cast("string").alias("link"), F.col("s_name").alias("name"))
    return views.selected(rows, "4").select("ordinal", "name").unionByName(views.selected(rows, "gone").select("ordinal", F.lit("first").alias("name")))


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 40 AS score, s_suppkey % 97 AS r FROM supplier)
    SELECT link, rank, alternative FROM (SELECT a.k::VARCHAR AS link, a.score, b.k::VARCHAR AS alternative, row_number() OVER (PARTITION BY a.k ORDER BY b.r DESC, b.k) AS rank FROM s a JOIN s b ON a.k <> b.k) WHERE rank <= 4 AND score * 2 >= 61"""
)
def alternatives_for_risky(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("ordinal"), k.cast("string").alias("link"), F.lit(None).cast("string").alias("category"), (k % 97).cast("double").alias("reliability"), F.lit("1").alias("review_count"), F.lit(True).alias("analysed"), (k % 40 * 2).cast("double").alias("risk_score"))
    return ranking.alternatives_for_risky(rows, 4)


def _grid(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("ordinal"), k.cast("string").alias("link"), (F.col("p_size") % 7).alias("reviews"), F.when(F.col("p_size") % 4 > 0, (F.col("p_size") % 11).cast("string")).alias("summary_reviews"), F.lit(1.0).alias("price_value"), F.lit(1.0).alias("reliability"))


@query("SELECT link, how FROM (SELECT p_partkey::VARCHAR AS link, 'collected' AS how FROM part ORDER BY p_size % 7 DESC, p_partkey LIMIT 6 OFFSET 6) UNION ALL SELECT link, how FROM (SELECT p_partkey::VARCHAR AS link, 'summarised' AS how FROM part ORDER BY CASE WHEN p_size % 4 > 0 THEN p_size % 11 ELSE 0 END DESC, p_partkey LIMIT 6)")
def sort_by_reviews(spark, sf_dir):
    """The two orders by number of reviews: those collected, and those in the summary."""
    rows = _grid(spark, sf_dir)
    one = views.page(rows, views.sort_columns("collected"), 1).select("link", F.lit("collected").alias("how"))
    return one.unionAll(views.page(rows, views.sort_columns("summarised"), 0).select("link", F.lit("summarised").alias("how")))


@query("SELECT s_suppkey::VARCHAR AS link, (2 + (s_suppkey % 2))::INT AS written_reviews_collected, CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 3 = 1 THEN 12 ELSE 412 END::BIGINT AS reported FROM supplier")
def review_counts(spark, sf_dir):
    """Distinct written reviews; the stated total, even 0, before the reported count."""
    k = F.col("s_suppkey")
    review = lambda i, c: F.struct(F.lit(i).alias("comment_id"), F.lit("a").alias("author"), F.lit("t").alias("time"), c.alias("content"), F.lit(5).alias("rating"))
    comments = F.array(review("1", F.lit("x")), review("1", F.lit("y")), review("", F.lit("c")), review("", F.when(k % 2 == 1, "d").otherwise("c")))
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("link"), comments.alias("comments"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 12).alias("total_rating"), F.lit(412).alias("reported_review_count"))
    return markets.review_counts(rows).select("link", "written_reviews_collected", "reported")


@query("SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY CASE WHEN l_linenumber % 3 = 0 THEN 2 WHEN l_quantity::INT % 7 BETWEEN 1 AND 5 THEN l_quantity::INT % 7 ELSE 6 END, l_linenumber) AS places FROM lineitem GROUP BY l_orderkey")
def star_order_recorded(spark, sf_dir):
    """Low to high by the star under which a review was collected, else its own."""
    one = F.struct("l_linenumber", (F.col("l_quantity").cast("int") % 7).alias("rating"), F.when(F.col("l_linenumber") % 3 == 0, "2_star").otherwise("").alias("found_under"))
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("comments"))
    ordered = reviews.order_low_to_high(F.col("comments"), "found_under")
    return nested.select("l_orderkey", F.array_join(F.transform(ordered, lambda r: r["l_linenumber"].cast("string")), ",").alias("places"))


@query("SELECT conv_id::VARCHAR AS product, turn AS stars, role AS author, coalesce(text, '') AS review, 0::BIGINT AS likes, CASE WHEN turn % 2 = 0 THEN 'positive' ELSE 'unanalyzed' END AS sentiment, CASE WHEN turn % 2 = 0 THEN 0.5 END::DOUBLE AS compound, turn % 2 = 0 AS risk, CASE WHEN turn % 2 = 0 THEN 'a, b' ELSE '' END AS risk_categories, false AS duplicate, '' AS date, '' AS product_link FROM conversations")
def review_rows(spark, sf_dir):
    """The display rows of reviews, analysed or not."""
    even = F.col("turn") % 2 == 0
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("product"), F.col("role").alias("author"), F.col("turn").alias("rating"), F.lit(None).cast("string").alias("time"), F.col("text").alias("content"), F.lit(None).cast("long").alias("like_count"),
        F.when(even, "positive").alias("label"), F.when(even, 0.5).alias("compound"), F.when(even, True).alias("detected"), F.when(even, F.array(F.lit("a"), F.lit("b"))).alias("categories"), F.lit(None).cast("boolean").alias("is_duplicate"), F.lit(None).cast("string").alias("link"),
    )
    return views.review_rows(rows)


@query("SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN 'POS' ELSE role END, ',' ORDER BY turn, role, text) AS labels FROM conversations GROUP BY conv_id")
def labels_restored(spark, sf_dir):
    """Labels by coordinates in nested rows."""
    talk = F.struct("turn", "role", F.col("text").alias("content"), F.col("role").alias("label"))
    nested = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("ordinal")).agg(F.array_sort(F.collect_list(talk)).alias("comments"))
    labels = nested.select(F.col("ordinal").alias("outer_idx"), F.posexplode("comments").alias("comment_idx", "r")).where("r.turn % 2 = 0").select("outer_idx", "comment_idx", F.lit("POS").alias("label"))
    back = reviews.restore_labels(nested, labels)
    return back.select(F.col("ordinal").alias("conv_id"), F.array_join(F.transform("comments", lambda r: r["label"]), ",").alias("labels"))


@query("SELECT user_id AS link, string_agg(event_id::VARCHAR, ',' ORDER BY CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, event_id) AS ids FROM events GROUP BY user_id")
def star_lists_joined(spark, sf_dir):
    """The lists of several star filters end to end, put back as arrays."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("link"), "event_id")
    lists = rows.where("event_id % 3 = 0").withColumn("part", F.lit(0)).unionByName(rows.where("event_id % 3 > 0").withColumn("part", F.lit(1)))
    placed = lists.withColumn("pos", F.row_number().over(Window.partitionBy("link").orderBy("part", "event_id"))).drop("part")
    products = rows.select("link").distinct().withColumn("comments", F.array().cast("array<struct<event_id:bigint>>"))
    back = reviews.attach(products, placed)
    return back.select("link", F.array_join(F.transform("comments", lambda r: r["event_id"].cast("string")), ",").alias("ids"))
