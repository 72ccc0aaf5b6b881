"""All queries over the test tables, by name, and their SQL.

The tables hold no products, so each stands in for one: parts are products, documents and
conversations are reviews, line items are ratings, labels are judgements, events are pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U
from ..functions.lexicon import RiskTerm, SentimentTerm
from ..operators import evaluation as E
from ..operators import qualification as Q
from ..operators import ranking, reviews, store, summary, views
from ..operators.text_model import TextModel, severity_score
from ..sources import pages as P
from ..streaming import collect as C
from .base import ORACLES, QUERIES, query, spread, table  # noqa: F401

#: Terms that do occur in the test tables.
RISK = [RiskTerm("worthless", "quality", 3, "en"), RiskTerm("trash", "defect", 2, "en"), RiskTerm("that the", "performance", 1, "en"), RiskTerm("that", "safety", 1, "en"), RiskTerm("clown", "counterfeit", 3, "en")]
SENTIMENT = [SentimentTerm("this", 2.0, "en", "quality"), SentimentTerm("worthless", -3.0, "en", "quality"), SentimentTerm("from", -1.0, "en", "quality")]


def model() -> TextModel:
    return TextModel(SENTIMENT, RISK, negators=())


def parts(spark, sf_dir) -> DataFrame:
    """Products out of parts."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), F.concat(F.lit("https://shopee.ph/product/1/"), "p_partkey").alias("link"), F.col("p_name").alias("name"),
        F.concat(F.lit("₱"), F.format_string("%.1f", "p_retailprice")).alias("price"), F.col("p_brand").alias("category"), size.cast("string").alias("rating"),
        (size * 3).alias("total_rating"), F.when(size % 5 > 0, (size * 2).cast("double")).alias("risk_score"), (F.col("p_partkey") % 11 / F.lit(10.0)).alias("positive_ratio"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("Manila")).alias("location"), F.lit("").alias("platform"), F.lit(None).cast("string").alias("img"),
        F.sequence(F.lit(1), F.pmod(F.col("p_partkey"), F.lit(3)) + 1).alias("comments"),
    )


_PARTS = """
parts AS (SELECT p_partkey AS ordinal, 'https://shopee.ph/product/1/' || p_partkey AS link, p_name AS name, '₱' || printf('%.1f', p_retailprice) AS price, p_brand AS category,
  p_size::DOUBLE AS rating, (p_size * 3)::BIGINT AS total_rating, CASE WHEN p_size % 5 > 0 THEN (p_size * 2)::DOUBLE END AS risk_score, (p_partkey % 11) / 10.0::DOUBLE AS positive_ratio,
  CASE WHEN p_partkey % 2 = 0 THEN 'Manila' END AS location, (p_partkey % 3 + 1)::INT AS n_comments FROM part),
norm AS (SELECT *, least(1.0, greatest(0.0, CASE WHEN coalesce(risk_score, 0) > 1 THEN coalesce(risk_score, 0) / 100 ELSE coalesce(risk_score, 0) END))::DOUBLE AS risk,
  CASE WHEN substr(price, 2)::DOUBLE > 0 THEN substr(price, 2)::DOUBLE ELSE 0 END AS price_value FROM parts),
shown AS (SELECT *, CASE WHEN risk >= 0.61 THEN 'High' WHEN risk >= 0.31 THEN 'Moderate' ELSE 'Low' END AS level,
  round_even(100 * greatest(0.0, least(1.0, CASE WHEN positive_ratio > 1 THEN positive_ratio / 100 ELSE positive_ratio END) - risk), 1)::DOUBLE AS reliability FROM norm)
"""


def doc_reviews(spark, sf_dir) -> DataFrame:
    """Reviews out of documents: the source is the product, the id the place."""
    return spread(table(spark, sf_dir, "documents").select(F.col("source").alias("link"), F.col("doc_id").alias("pos"), F.col("text").alias("content"), "lang"))


def analysed(spark, sf_dir) -> DataFrame:
    return reviews.mark_duplicates(summary.verdicts(doc_reviews(spark, sf_dir), model()), F.col("fingerprint"))


def _fp(text: str) -> str:
    """The fingerprint of a text in compatibility form, up to spellings and case rules that keep texts apart or alike in the same way."""
    plain = f"replace(regexp_replace(lower(coalesce({text}, '')), '[’`]', '''', 'g'), 'ß', 'ss')"
    for old, new in T.SPELLINGS.items():
        plain = f"regexp_replace({plain}, '(^|[^\\p{{L}}\\p{{N}}_]){old}($|[^\\p{{L}}\\p{{N}}_])', '\\1{new}\\2', 'g')"
    return f"trim(regexp_replace(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}_\\p{{S}}\\p{{M}}]', ' ', 'g'), ' +', ' ', 'g'))"


_FP = _fp("text")


def _has(term: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){term.replace(' ', chr(92) + 's+')}($|[^\\p{{L}}\\p{{N}}_])')"


_MARKED = f"""
fp AS (SELECT source AS link, doc_id AS pos, text, {_FP} AS f, {_has('worthless')} AS quality, {_has('trash')} AS defect, {_has('that the')} AS performance, {_has('clown')} AS counterfeit,
  regexp_matches(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])that the($|[^\\p{{L}}\\p{{N}}_])', ' | ', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])that($|[^\\p{{L}}\\p{{N}}_])') AS safety FROM documents),
marked AS (SELECT *, min(pos) OVER (PARTITION BY link, f) AS first, f <> '' AND pos > min(pos) OVER (PARTITION BY link, f) AS dup, quality OR defect OR performance OR safety OR counterfeit AS risky FROM fp)
"""


@query(
    f"""WITH {_MARKED} SELECT link, count(*) AS comments, count(*) FILTER (f <> '' AND NOT dup) AS unique_reviews, count(*) FILTER (dup) AS duplicates,
    count(*) FILTER (f <> '' AND NOT dup AND risky) AS risky,
    coalesce(count(*) FILTER (f <> '' AND NOT dup AND risky)::DOUBLE / nullif(count(*) FILTER (f <> '' AND NOT dup), 0), 0.0) AS failure_rate,
    CASE WHEN coalesce(count(*) FILTER (f <> '' AND NOT dup AND risky)::DOUBLE / nullif(count(*) FILTER (f <> '' AND NOT dup), 0), 0) >= 0.61 THEN 'High'
      WHEN coalesce(count(*) FILTER (f <> '' AND NOT dup AND risky)::DOUBLE / nullif(count(*) FILTER (f <> '' AND NOT dup), 0), 0) >= 0.31 THEN 'Moderate' ELSE 'Low' END AS level
    FROM marked GROUP BY link"""
)
def review_risk_summary(spark, sf_dir):
    s = summary.summarise(analysed(spark, sf_dir), rounded=False)
    return s.select(
        "link", F.col("all_reviews").alias("comments"), F.col("review_count").alias("unique_reviews"), F.col("duplicate_review_count").alias("duplicates"), F.col("risk_review_count").alias("risky"),
        F.col("keyword_failure_rate").alias("failure_rate"), N.risk_level(F.col("keyword_failure_rate")).alias("level"),
    )


@query(
    f"""WITH {_PARTS} SELECT '' AS image, name AS product, price, price_value, CASE WHEN rating BETWEEN 0 AND 5 THEN rating END AS rating, n_comments AS reviews, total_rating AS total_ratings,
    coalesce(location, '') AS location, 'Shopee PH' AS platform, risk_score, level, reliability, link FROM shown"""
)
def product_rows(spark, sf_dir):
    return views.product_rows(parts(spark, sf_dir))


@query("SELECT conv_id::VARCHAR AS link, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS pos, role AS author, text AS content FROM conversations")
def review_rows_explode(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("link"))
    nested = talks.agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("author"), F.col("text").alias("content")))).alias("comments"))
    return reviews.explode_reviews(nested).select("link", "pos", "author", "content")


@query("SELECT p_partkey, ((printf('%.1f', p_retailprice)::DOUBLE + p_size) / 2)::DOUBLE AS price_value FROM part")
def price_value(spark, sf_dir):
    text = F.concat(F.lit("â‚±"), F.format_number("p_retailprice", 1), F.lit(" - ₱"), "p_size", F.lit(" / 99"))
    return table(spark, sf_dir, "part").select("p_partkey", N.price_value(text).alias("price_value"))


@query("SELECT p_partkey, CASE WHEN p_size / 4.0 <= 5 THEN (p_size / 4.0)::DOUBLE END AS rating FROM part")
def rating_value(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.rating_value((F.col("p_size") / 4).cast("string")).alias("rating"))


@query("SELECT p_partkey, (p_size * 1000 + 200)::BIGINT AS short, (p_size * 1234)::BIGINT AS long, p_size::BIGINT * 1000000 AS sold, 0::BIGINT AS bad FROM part")
def compact_number(spark, sf_dir):
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", N.compact_number(F.concat(size, F.lit(",2k sold"))).alias("short"), N.compact_number(F.format_number(F.col("p_size") * 1234, 0)).alias("long"),
        T.sold_count(F.concat(size, F.lit("M+ sold"))).alias("sold"), N.compact_number(F.concat(size, F.lit("K bought"))).alias("bad"),
    )


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_type || ' & ' || p_name), '[^a-z0-9_]+', '_', 'g'), '_'), ''), 'search') AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat("p_type", F.lit(" & "), "p_name")).alias("slug"))


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'lazada' WHEN page_id % 3 = 1 THEN 'unsupported' ELSE 'shopee' END AS market,
    CASE WHEN page_id % 3 = 0 THEN 'Lazada PH' ELSE 'Shopee PH' END AS shown FROM pages"""
)
def marketplace_detect(spark, sf_dir):
    k = F.pmod("page_id", F.lit(3))
    link = F.when(k == 0, F.regexp_replace("url", "//[^/]+", "//www.lazada.com.ph")).when(k == 1, F.col("url")).otherwise("laptop stand")
    return table(spark, sf_dir, "pages").select("page_id", U.marketplace_or(link, "shopee", "unsupported").alias("market"), U.platform_name(U.product_platform(F.lit(""), link)).alias("shown"))


@query(
    """SELECT page_id, 'https://shopee.ph/a-i.7.' || page_id AS shopee, 'https://www.lazada.com.ph/products/p' || page_id || '.html' AS lazada,
    'https://www.temu.com/goods.html?goods_id=' || (1000000 + page_id) AS temu, '' AS foreign_host FROM pages"""
)
def url_canonical(spark, sf_dir):
    n = F.col("page_id").cast("string")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.shopee_product_url(F.concat(F.lit("/a-i.7."), n, F.lit("?sp=1#x"))).alias("shopee"), U.lazada_product_url(F.concat(F.lit("//lazada.com.ph//products/p"), n, F.lit(".html?x=1"))).alias("lazada"),
        U.temu_product_url(F.concat(F.lit("https://m.temu.com/x-g-"), (F.col("page_id") + 1000000).cast("string"), F.lit(".html"))).alias("temu"), U.shopee_product_url(F.col("url")).alias("foreign_host"),
    )


@query("SELECT page_id, 'https://www.lazada.com.ph/shop-a/?q=' || page_id || '&page=' || greatest(1, page_id % 7) AS page_url, '' AS product FROM pages")
def category_page_url(spark, sf_dir):
    link = F.concat(F.lit("https://lazada.com.ph/shop-a/?Page=9&q="), F.col("page_id").cast("string"), F.lit("#top"))
    return table(spark, sf_dir, "pages").select("page_id", U.category_page_url(link, F.pmod("page_id", F.lit(7))).alias("page_url"), U.lazada_category_url(F.lit("/products/x.html")).alias("product"))


@query(f"WITH {_PARTS} SELECT link, risk, level, round_even(100 * (1 - risk), 1)::DOUBLE AS plain, reliability FROM shown")
def risk_normalize(spark, sf_dir):
    score = F.col("risk_score")
    return parts(spark, sf_dir).select(
        "link", N.risk_fraction(score).alias("risk"), N.risk_level(score).alias("level"), N.reliability(score).alias("plain"),
        N.reliability(score, F.col("positive_ratio")).alias("reliability"),
    )


@query(f"WITH {_MARKED} SELECT link, pos, dup AS is_duplicate, CASE WHEN dup THEN first END AS duplicate_of FROM marked")
def fingerprint_dedupe(spark, sf_dir):
    return reviews.mark_duplicates(doc_reviews(spark, sf_dir), T.fingerprint_key(F.col("content"))).select("link", "pos", "is_duplicate", "duplicate_of")


@query(f"SELECT doc_id, f <> '' AND doc_id > first AS is_duplicate, CASE WHEN f <> '' AND doc_id > first THEN first END AS duplicate_of FROM (SELECT doc_id, {_FP} AS f, min(doc_id) OVER (PARTITION BY {_FP}) AS first FROM documents)")
def csv_dedupe_global(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = reviews.review_text(docs.columns)
    return reviews.mark_duplicates(docs, T.fingerprint_key(text), group=(), place="doc_id").select("doc_id", "is_duplicate", "duplicate_of")


@query("SELECT link, pos FROM (SELECT user_id AS link, event_id AS pos, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS k FROM events) WHERE k = 1")
def identity_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("key", reviews.identity(F.lit(""), F.col("event_type"), F.lit(None), F.col("props"), F.lit(None)))
    return reviews.first_of(rows, ["user_id", "key"], "event_id").select(F.col("user_id").alias("link"), F.col("event_id").alias("pos"))


@query(f"WITH {_MARKED}, cat AS (SELECT link, unnest(['quality', 'defect', 'performance', 'safety', 'counterfeit']) AS category, unnest([quality, defect, performance, safety, counterfeit]) AS has FROM marked WHERE f <> '' AND NOT dup) SELECT link, category, count(*) AS n FROM cat WHERE has GROUP BY ALL")
def category_counts(spark, sf_dir):
    return summary.category_counts(analysed(spark, sf_dir))


@query(
    f"""WITH {_MARKED} SELECT link, pos, CASE WHEN quality OR counterfeit THEN 3 WHEN defect THEN 2 WHEN performance OR safety THEN 1 ELSE 0 END AS severity,
    array_to_string(list_filter([CASE WHEN counterfeit THEN 'counterfeit' END, CASE WHEN defect THEN 'defect' END, CASE WHEN performance THEN 'performance' END, CASE WHEN quality THEN 'quality' END, CASE WHEN safety THEN 'safety' END], lambda x: x IS NOT NULL), ', ') AS categories FROM marked"""
)
def max_severity_score(spark, sf_dir):
    rows = summary.analyse_reviews(doc_reviews(spark, sf_dir), model())
    return rows.select("link", "pos", F.round(severity_score(F.col("evidence")) * 3).cast("int").alias("severity"), F.array_join("categories", ", ").alias("categories"))


def _occurrences(term: str) -> str:
    """How often a term stands in a text: separators are doubled, so that neighbours don't share one."""
    padded = "' ' || regexp_replace(lower(text), '([^\\p{L}\\p{N}_])', '\\1\\1', 'g') || ' '"
    return f"len(regexp_extract_all({padded}, '[^\\p{{L}}\\p{{N}}_]{term}[^\\p{{L}}\\p{{N}}_]'))"


@query(f"WITH c AS (SELECT source AS link, doc_id AS pos, {_occurrences('worthless')} AS w, {_occurrences('trash')} AS t FROM documents) SELECT link, term, n FROM (SELECT link, 'worthless' AS term, sum(w)::BIGINT AS n FROM c GROUP BY link UNION ALL SELECT link, 'trash', sum(t)::BIGINT FROM c GROUP BY link) WHERE n > 0")
def keyword_counts(spark, sf_dir):
    rows = summary.analyse_reviews(doc_reviews(spark, sf_dir), TextModel([], RISK[:2], negators=()))
    return summary.keyword_counts(rows).select("link", "term", "n")


@query(
    f"""WITH c AS (SELECT source AS link, doc_id AS pos, {_occurrences('worthless')} AS w, {_occurrences('trash')} AS t FROM documents),
    n AS (SELECT link, 'worthless' AS term, sum(w)::BIGINT AS n, min(CASE WHEN w > 0 THEN pos * 10 END) AS first FROM c GROUP BY link
      UNION ALL SELECT link, 'trash', sum(t)::BIGINT, min(CASE WHEN t > 0 THEN pos * 10 + (w > 0)::INT END) FROM c GROUP BY link)
    SELECT link, term, n, row_number() OVER (PARTITION BY link ORDER BY n DESC, first, term)::INT AS rank FROM n WHERE n > 0"""
)
def keyword_counts_topk(spark, sf_dir):
    rows = summary.analyse_reviews(doc_reviews(spark, sf_dir), TextModel([], RISK[:2], negators=()))
    return summary.keyword_counts(rows, most=8).select("link", "rank", "term", "n")


@query()
def text_analysis(spark, sf_dir):
    rows = doc_reviews(spark, sf_dir).withColumn("a", TextModel().analyse(F.col("content")))
    a = lambda path: F.col(f"a.{path}")
    return rows.select(
        "link", "pos", a("label").alias("label"), a("scores.neg").alias("neg"), a("scores.neu").alias("neu"), a("scores.pos").alias("positive"), a("scores.compound").alias("compound"),
        F.size("a.sentiment_evidence").alias("evidence"), a("risk.detected").alias("detected"), F.array_join(a("risk.categories"), ",").alias("categories"),
    )


@query(
    f"""WITH {_MARKED}, s AS (SELECT link, count(*) AS all_reviews, count(*) FILTER (f <> '' AND NOT dup) AS review_count, count(*) FILTER (dup) AS duplicate_review_count, count(*) FILTER (f <> '' AND NOT dup AND risky) AS risk_review_count FROM marked GROUP BY link),
    cat AS (SELECT link, unnest(['quality', 'defect', 'performance', 'safety', 'counterfeit']) AS category, unnest([quality, defect, performance, safety, counterfeit]) AS has FROM marked WHERE f <> '' AND NOT dup),
    maps AS (SELECT link, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}' AS risk_categories FROM (SELECT link, category, count(*) AS n FROM cat WHERE has GROUP BY ALL) GROUP BY link)
    SELECT link, all_reviews, review_count, duplicate_review_count, risk_review_count, round_even(CASE WHEN review_count > 0 THEN risk_review_count / review_count ELSE 0 END, 4)::DOUBLE AS keyword_failure_rate,
      round_even(CASE WHEN review_count > 0 THEN 100 * (0.3::DOUBLE * 0.0 + 0.7::DOUBLE * (risk_review_count / review_count)) ELSE 0 END, 2)::DOUBLE AS risk_score, risk_categories
    FROM s LEFT JOIN maps USING (link)"""
)
def product_summary(spark, sf_dir):
    rows = reviews.mark_duplicates(summary.verdicts(doc_reviews(spark, sf_dir), TextModel([], RISK, negators=())), F.col("fingerprint"))
    maps = summary.category_map(summary.category_counts(rows)).select("link", F.to_json("risk_categories").alias("risk_categories"))
    return summary.summarise(rows).join(maps, "link", "left").select("link", "all_reviews", "review_count", "duplicate_review_count", "risk_review_count", "keyword_failure_rate", "risk_score", "risk_categories")


@query(
    """WITH r AS (SELECT l_partkey AS link, CASE l_returnflag WHEN 'A' THEN 'negative' WHEN 'N' THEN 'neutral' ELSE 'positive' END AS label, (l_quantity::INT % 10) / 8.0 AS c, l_linestatus = 'O' AS risky, l_linenumber = 7 AS dup FROM lineitem)
    SELECT link, count(*) FILTER (NOT dup) AS review_count, count(*) FILTER (NOT dup AND label = 'positive') AS positive, count(*) FILTER (NOT dup AND label = 'negative') AS negative,
    count(*) FILTER (NOT dup AND risky) AS risk_review_count, count(*) FILTER (dup) AS duplicate_review_count, coalesce(sum(c) FILTER (NOT dup) / nullif(count(*) FILTER (NOT dup), 0), 0)::DOUBLE AS average_compound FROM r GROUP BY link"""
)
def rating_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("link"), F.when(F.col("l_returnflag") == "A", "negative").when(F.col("l_returnflag") == "N", "neutral").otherwise("positive").alias("label"),
        (F.col("l_quantity").cast("int") % 10 / 8).alias("compound"), (F.col("l_linestatus") == "O").alias("detected"), (F.col("l_linenumber") == 7).alias("is_duplicate"), F.lit("x").alias("fingerprint"),
    )
    return summary.summarise(rows, rounded=False).select("link", "review_count", "positive", "negative", "risk_review_count", "duplicate_review_count", "average_compound")


@query(f"WITH {_PARTS} SELECT l.level, count(s.level) AS n FROM (VALUES ('Low'), ('Moderate'), ('High')) l(level) LEFT JOIN shown s USING (level) GROUP BY l.level")
def level_distribution(spark, sf_dir):
    return summary.level_distribution(parts(spark, sf_dir), F.col("risk_score")).select("level", "n")


@query(f"WITH {_PARTS} SELECT count(*) AS products, sum(n_comments)::BIGINT AS comments, count(*) FILTER (level = 'High') AS high, count(risk_score) AS analysed, round(avg(reliability), 6)::DOUBLE AS mean_reliability FROM shown")
def landing_stats(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("n_comments", F.size("comments"))
    return summary.landing_stats(rows).withColumn("mean_reliability", F.round("mean_reliability", 6))


@query(
    f"""WITH {_PARTS}, bands(band, lo, hi) AS (VALUES ('all', -1, 1e9), ('below 500', -1, 499.999), ('500 to 1000', 500, 1000), ('1000 to 2500', 1000.001, 2500), ('above 2500', 2500.001, 1e9))
    SELECT band, count(price_value) AS n FROM bands LEFT JOIN shown ON price_value BETWEEN lo AND hi GROUP BY band"""
)
def price_band_filter(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("price_value", N.price_value(F.col("price")))
    counts = rows.agg(*[F.count_if(views.in_band(F.col("price_value"), b)).alias(b) for b in views.BANDS])
    return counts.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("n")) for b in views.BANDS]))).alias("band", "n"))


@query(f"WITH {_PARTS} SELECT link, name FROM shown WHERE contains(lower(name), 'ring') AND level IN ('High', 'Moderate')")
def name_and_level_filter(spark, sf_dir):
    rows = parts(spark, sf_dir)
    return rows.where(views.name_contains(F.col("name"), "RiNg") & N.risk_level(F.col("risk_score")).isin("High", "Moderate")).select("link", "name")


def _page(order: str, number: int) -> str:
    return f"WITH {_PARTS} SELECT link, price_value, {number} AS page, (SELECT greatest(1, ceil(count(*) / 6.0))::INT FROM shown) AS pages FROM shown ORDER BY {order} LIMIT 6 OFFSET {6 * number}"


def _grid(spark, sf_dir, mode, number):
    rows = views.product_rows(parts(spark, sf_dir)).withColumn("ordinal", F.split_part("link", F.lit("/"), F.lit(6)).cast("long"))
    return views.page(rows, views.sort_columns(mode), number).select("link", "price_value", "page", "pages")


@query(_page("nullif(price_value, 0) ASC NULLS LAST, ordinal", 0))
def sort_price_asc(spark, sf_dir):
    return _grid(spark, sf_dir, "price_low", 0)


@query(_page("nullif(price_value, 0) DESC NULLS LAST, ordinal", 0))
def sort_price_desc(spark, sf_dir):
    return _grid(spark, sf_dir, "price_high", 0)


@query(_page("reliability DESC, ordinal", 3))
def page_slice(spark, sf_dir):
    return _grid(spark, sf_dir, "reliability", 3)


@query(f"WITH {_PARTS} SELECT name AS product, 'Shopee PH' AS platform, risk_score, level FROM shown WHERE level = 'High'")
def high_risk_flags(spark, sf_dir):
    return views.high_risk(views.product_rows(parts(spark, sf_dir)))


@query(
    """WITH s AS (SELECT s_suppkey AS ordinal, s_suppkey::VARCHAR AS link, CASE WHEN s_suppkey % 11 > 1 THEN (s_nationkey * 31 + s_suppkey % 3)::VARCHAR || 'kind' WHEN s_suppkey % 11 = 1 THEN '  ' END AS category,
      (CASE WHEN s_suppkey % 13 = 0 THEN 100.0 ELSE round_even(100 * greatest(0.0, (s_suppkey % 31) / 31.0::DOUBLE - (s_suppkey % 17) / 100.0::DOUBLE), 1) END)::DOUBLE AS reliability, s_suppkey % 5 AS review_count, s_suppkey % 7 > 0 AS analysed FROM supplier)
    SELECT link, rank, alternative FROM (SELECT a.link, b.link AS alternative,
      row_number() OVER (PARTITION BY a.link ORDER BY coalesce(trim(a.category) <> '' AND trim(a.category) = trim(b.category), false) DESC, b.reliability DESC, b.review_count DESC, b.ordinal) AS rank
      FROM s a JOIN s b ON a.link <> b.link AND b.analysed) WHERE rank <= 3"""
)
def rank_alternatives(spark, sf_dir):
    k = F.col("s_suppkey")
    name = F.concat((F.col("s_nationkey") * 31 + k % 3).cast("string"), F.when(k % 2 == 0, "KIND ").otherwise("kind"))
    risk, positive = (k % 17).cast("double"), F.when(k % 13 > 0, k % 31 / F.lit(31.0))
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("ordinal"), k.cast("string").alias("link"), F.when(k % 11 > 1, F.concat(F.lit(" "), name)).when(k % 11 == 1, "  ").alias("category"),
        N.reliability(F.when(k % 13 > 0, risk / 100), positive).alias("reliability"), (k % 5).alias("review_count"), (k % 7 > 0).alias("analysed"),
    )
    return ranking.rank_alternatives(rows, 3)


def _judged(spark, sf_dir):
    return E.pair_counts(table(spark, sf_dir, "labels"), F.concat(F.lit(" Q"), "quality"), F.concat(F.lit("q"), (1 - F.col("toxic")).cast("string")))


_PAIRS = "p AS (SELECT 'q' || quality AS actual, 'q' || (1 - toxic) AS predicted, count(*) AS n FROM labels GROUP BY ALL), l AS (SELECT actual AS x FROM p UNION SELECT predicted FROM p)"


@query(f"WITH {_PAIRS} SELECT a.x AS actual, b.x AS predicted, coalesce(p.n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.actual = a.x AND p.predicted = b.x")
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(_judged(spark, sf_dir))


@query(
    f"""WITH {_PAIRS}, m AS (SELECT x, (SELECT coalesce(sum(n), 0) FROM p WHERE actual = x AND predicted = x) AS tp, (SELECT coalesce(sum(n), 0) FROM p WHERE actual = x) AS s, (SELECT coalesce(sum(n), 0) FROM p WHERE predicted = x) AS c FROM l)
    SELECT x AS label, s::BIGINT AS support, CASE WHEN c > 0 THEN tp / c ELSE 0 END::DOUBLE AS precision, CASE WHEN s > 0 THEN tp / s ELSE 0 END::DOUBLE AS recall FROM m"""
)
def label_metrics(spark, sf_dir):
    return E.label_metrics(_judged(spark, sf_dir)).select("label", "support", "precision", "recall")


@query(
    f"""WITH {_PAIRS}, m AS (SELECT x, (SELECT coalesce(sum(n), 0) FROM p WHERE actual = x AND predicted = x) AS tp, (SELECT coalesce(sum(n), 0) FROM p WHERE actual = x) AS s, (SELECT coalesce(sum(n), 0) FROM p WHERE predicted = x) AS c FROM l),
    q AS (SELECT CASE WHEN c > 0 THEN tp / c ELSE 0 END::DOUBLE AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0 END::DOUBLE AS re FROM m)
    SELECT (SELECT sum(n)::BIGINT FROM p) AS sample_count, round_even((SELECT sum(n) FILTER (actual = predicted) / sum(n) FROM p), 4)::DOUBLE AS accuracy, round_even(avg(pr), 4)::DOUBLE AS precision,
      round_even(avg(re), 4)::DOUBLE AS recall, round_even(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 4)::DOUBLE AS f1 FROM q"""
)
def macro_metrics(spark, sf_dir):
    return E.macro_metrics(_judged(spark, sf_dir))


@query("SELECT sqrt(avg(pow(quality - toxic, 2))) AS rmse FROM labels")
def rmse(spark, sf_dir):
    return E.rmse(table(spark, sf_dir, "labels"), F.col("quality"), F.col("toxic"))


_ANSWER = "((o_orderkey * {a} + i * {b}) % {n} + 1)"


@query(
    """SELECT o_orderkey, (list_sum([CASE WHEN i % 2 = 0 THEN (o_orderkey * 3 + i * 7) % 5 ELSE 4 - (o_orderkey * 3 + i * 7) % 5 END FOR i IN range(10)]) * 2.5)::DOUBLE AS sus,
    (list_sum([CASE WHEN i % 2 = 0 THEN (o_orderkey * 5 + i * 3) % 7 ELSE 6 - (o_orderkey * 5 + i * 3) % 7 END FOR i IN range(4)])::DOUBLE / 24 * 100)::DOUBLE AS umux FROM orders"""
)
def survey_scores(spark, sf_dir):
    key = F.col("o_orderkey")
    sus = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (key * 3 + i * 7) % 5 + 1)
    umux = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (key * 5 + i * 3) % 7 + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", E.sus_score(sus).alias("sus"), E.umux_score(umux).alias("umux"))


@query("SELECT conv_id, turn, role, sha256(conv_id || chr(31) || role || chr(31) || turn || chr(31) || coalesce(text, '')) AS review_key FROM conversations")
def review_key_sha256(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.review_key(F.col("conv_id"), F.col("role"), F.col("turn"), F.col("text")).alias("review_key"))


@query(
    """WITH old AS (SELECT c_custkey::VARCHAR AS link, 'old ' || c_mktsegment AS name FROM customer WHERE c_custkey % 3 > 0), new AS (SELECT o_custkey::VARCHAR AS link, arg_max('new ' || o_orderpriority, o_orderkey) AS name FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE link NOT IN (SELECT link FROM new)"""
)
def product_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").cast("string").alias("link"), F.concat(F.lit("old "), "c_mktsegment").alias("name"))
    new = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(" ").alias("link"), F.concat(F.lit("new "), "o_orderpriority").alias("name"), F.col("o_orderkey").alias("ordinal"))
    return store.upsert_products(old, new)


_REVIEW_COLUMNS = ("review_key", "rating", "sentiment", "risk_detected", "raw_json")


@query(
    """WITH o AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || floor(l_extendedprice)::BIGINT AS review_key, l_quantity::INT AS rating, l_returnflag AS sentiment, 0 AS risk_detected, 'a' AS raw_json FROM lineitem WHERE l_linenumber <= 3),
    n AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || floor(l_extendedprice)::BIGINT AS review_key, -1 AS rating, CASE WHEN l_suppkey % 2 = 0 THEN l_linestatus END AS sentiment, 1 AS risk_detected, 'b' AS raw_json FROM lineitem WHERE l_linenumber >= 3)
    SELECT coalesce(o.review_key, n.review_key) AS review_key, CASE WHEN o.review_key IS NOT NULL THEN o.rating ELSE n.rating END AS rating,
      CASE WHEN n.review_key IS NOT NULL THEN n.sentiment ELSE o.sentiment END AS sentiment, coalesce(n.risk_detected, o.risk_detected) AS risk_detected, coalesce(n.raw_json, o.raw_json) AS raw_json FROM o FULL JOIN n ON o.review_key = n.review_key"""
)
def review_upsert(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("review_key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_extendedprice")))
    old = lines.where("l_linenumber <= 3").select("review_key", F.col("l_quantity").cast("int").alias("rating"), F.col("l_returnflag").alias("sentiment"), F.lit(0).alias("risk_detected"), F.lit("a").alias("raw_json"))
    new = lines.where("l_linenumber >= 3").select("review_key", F.lit(-1).alias("rating"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_linestatus")).alias("sentiment"), F.lit(1).alias("risk_detected"), F.lit("b").alias("raw_json"), F.col("l_suppkey").alias("ordinal"))
    return store.upsert_reviews(old, new)


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'part', count(*) FROM part")
def table_counts(spark, sf_dir):
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "conversations", "labels", "part")]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


@query("SELECT count(*) AS n FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def orphan_reviews(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("product_link"))
    return store.orphans(labels, table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("link"))).agg(F.count("*").alias("n"))


@query(
    """SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY CASE WHEN l_quantity::INT % 7 BETWEEN 1 AND 5 THEN l_quantity::INT % 7 ELSE 6 END, l_linenumber) AS places FROM lineitem GROUP BY l_orderkey"""
)
def star_order(spark, sf_dir):
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity").cast("int") % 7).alias("rating")))).alias("comments"))
    return nested.select("l_orderkey", F.array_join(F.transform(reviews.order_low_to_high(F.col("comments")), lambda r: r["l_linenumber"].cast("string")), ",").alias("places"))


@query(
    """WITH c AS (SELECT l_partkey, l_quantity::INT % 5 + 1 AS star, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_partkey, string_agg(star || ':' || n, ',' ORDER BY star) AS limits, sum(n)::BIGINT AS total FROM c GROUP BY l_partkey"""
)
def star_limits(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.concat((F.col("l_quantity").cast("int") % 5 + 1).cast("string"), F.lit("_star")).alias("key")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("l_partkey").agg(F.map_concat(F.map_from_entries(F.collect_list(F.struct("key", "n"))), F.create_map(F.lit("all"), F.lit(9).cast("long"))).alias("detailed"))
    shown = F.array_join(F.transform(reviews.star_limits(F.col("detailed")), lambda x: F.concat_ws(":", x["star"].cast("string"), x["count"].cast("string"))), ",")
    return maps.select("l_partkey", shown.alias("limits"), reviews.star_total(F.col("detailed")).alias("total"))


@query(
    """SELECT p_partkey, CASE WHEN p_size / 10.0 >= 2.5 AND p_partkey % 200 >= 100 THEN 'qualified' ELSE 'rejected' END AS status,
    concat_ws(',', CASE WHEN p_size / 10.0 < 2.5 THEN 'rating_below_minimum' END, CASE WHEN p_partkey % 200 < 100 THEN 'review_count_below_minimum' END) AS reasons FROM part"""
)
def qualification(spark, sf_dir):
    q = Q.qualify(F.col("p_size") / 10, F.col("p_partkey") % 200, 2.5, 100)
    return table(spark, sf_dir, "part").select("p_partkey", q["status"].alias("status"), F.array_join(q["reasons"], ",").alias("reasons"))


@query(
    """WITH c AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'next_button_disabled' WHEN 1 THEN 'no_reviews' WHEN 2 THEN 'empty_review_page' ELSE 'page_transition_failed' END AS s,
      CASE o_orderkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN '5' ELSE '4' END AS c, o_orderkey % 5 > 1 AS every, o_orderkey % 7 = 0 AS none FROM orders)
    SELECT k AS o_orderkey, none OR s = 'no_reviews' OR (s IN ('next_button_disabled', 'empty_review_page') AND (c = 'all' OR (c = '5' AND every))) AS terminal,
      s = 'no_reviews' OR (s IN ('next_button_disabled', 'empty_review_page') AND c IN ('all', '4')) AS terminal_four,
      k % 9 > 0 AND k % 5 < k % 9 AND NOT (s IN ('next_button_disabled', 'no_reviews') AND c = 'all') AS shopee,
      NOT (k % 9 > 0 AND (k % 5 >= k % 9 OR none OR s = 'no_reviews' OR (s IN ('next_button_disabled', 'empty_review_page') AND (c = 'all' OR (c = '5' AND every))))) OR k % 13 = 0 AS lazada,
      NOT ((s IN ('next_button_disabled', 'no_reviews') AND c = 'all') OR (k % 9 > 0 AND k % 5 >= k % 9)) AS temu FROM c"""
)
def terminal_checkpoint(spark, sf_dir):
    k = F.col("o_orderkey")
    stop = F.when(k % 4 == 0, "next_button_disabled").when(k % 4 == 1, "no_reviews").when(k % 4 == 2, "empty_review_page").otherwise("page_transition_failed")
    rows = table(spark, sf_dir, "orders").withColumn("cp", F.struct(stop.alias("stop_reason"), F.when(k % 3 == 0, "all").when(k % 3 == 1, "5").otherwise("4").alias("context")))
    filters = F.when(k % 5 > 1, F.array(*[F.lit(i) for i in range(1, 6)])).when(k % 5 == 1, F.array(F.lit(5)))
    ended = Q.terminal(F.col("cp"), filters, review_status=F.when(k % 7 == 0, "no_reviews"))
    return rows.select(
        "o_orderkey", ended.alias("terminal"), Q.terminal(F.col("cp"), filters, rating=4).alias("terminal_four"), Q.incomplete(k % 9, k % 5, F.col("cp")).alias("shopee"),
        Q.incomplete(k % 9, k % 5, F.col("cp"), "lazada", ended, F.when(k % 13 == 0, "stars unconfirmed")).alias("lazada"), Q.incomplete(k % 9, k % 5, F.col("cp"), "temu").alias("temu"),
    )


@query(
    """WITH e AS (SELECT user_id, event_type, event_id, 0 AS part, event_id % 5 + 1 AS rating FROM events WHERE event_id % 2 = 0), c AS (SELECT user_id, event_type, event_id, 1 AS part, 3 AS rating FROM events WHERE event_id % 2 = 1)
    SELECT user_id, event_type, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY part, event_id) AS k FROM (SELECT * FROM e WHERE rating <> 3 UNION ALL SELECT * FROM c)) WHERE k = 1"""
)
def overlay_union(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("pos"), F.lit(None).cast("string").alias("source_rating_filter"), (F.col("event_id") % 5 + 1).cast("int").alias("rating"))
    new = rows.where("pos % 2 = 1").withColumns({"rating": F.lit(3), "source_rating_filter": F.lit("3_star")})
    return reviews.overlay(rows.where("pos % 2 = 0"), new, F.lit(3), ["user_id", "event_type"]).select("user_id", "event_type", "rating")


@query(
    """WITH r AS (SELECT user_id AS product, event_type || props AS identity, event_id AS pos, (event_id >= 500)::INT AS part, event_id // 100 AS page FROM events),
    u AS (SELECT *, row_number() OVER (PARTITION BY product, identity ORDER BY part, page, pos) AS k FROM r)
    SELECT product, identity, rank FROM (SELECT product, identity, row_number() OVER (PARTITION BY product ORDER BY part, page, pos) AS rank FROM u WHERE k = 1) WHERE rank <= 10"""
)
def batch_collect_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("product"), F.concat("event_type", "props").alias("identity"), F.col("event_id").alias("pos"), F.floor(F.col("event_id") / 100).alias("page"))
    return C.collect(rows.where("pos < 500"), rows.where("pos >= 500"), 10).select("product", "identity", "rank")


@query("SELECT user_id AS link, min(event_id) AS ordinal, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def keep_last_per_link(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("link"), F.col("event_id").alias("ordinal"), "event_type")
    return reviews.last_of(rows, "link").select("link", "ordinal", "event_type")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.missing' AS missing FROM events")
def json_path_extract(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"))


@query(
    """WITH n AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS a FROM events GROUP BY user_id)
    SELECT user_id, CASE len(a) WHEN 1 THEN a[1] WHEN 2 THEN a[1] || ' and ' || a[2] ELSE array_to_string(a[1:len(a) - 1], ', ') || ', and ' || a[len(a)] END AS platforms FROM n"""
)
def platform_list_text(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a")).select("user_id", T.listed(F.col("a")).alias("platforms"))


@query("SELECT doc_id, CASE WHEN contains(upper(text), 'POS') THEN 'POS' WHEN contains(upper(text), 'NEG') THEN 'NEG' WHEN contains(upper(text), 'NEU') THEN 'NEU' END AS label FROM documents")
def label_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.label_of(F.col("text")).alias("label"))


@query(
    """SELECT (row_number() OVER (ORDER BY conv_id, k) - 1)::BIGINT AS global_index, conv_id AS outer_idx, k::INT AS comment_idx
    FROM (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations) WHERE role <> 'assistant' AND trim(text) <> ''"""
)
def flatten_unlabeled(spark, sf_dir):
    talk = F.struct("turn", "role", F.col("text").alias("content"), F.when(F.col("role") == "assistant", "POS").otherwise("<NEG/NEU/POS>").alias("label"))
    nested = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("ordinal")).agg(F.array_sort(F.collect_list(talk)).alias("comments"))
    return reviews.flatten_unlabelled(nested).select("global_index", "outer_idx", "comment_idx")


@query(
    """WITH p AS (SELECT user_id AS product, event_id // 1000 AS page, string_agg(event_type, '|' ORDER BY event_id) FILTER (k <= 2) AS signature FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id // 1000 ORDER BY event_id) AS k FROM events) GROUP BY ALL)
    SELECT product, page, signature, signature <> lag(signature) OVER (PARTITION BY product ORDER BY page) AS changed FROM p"""
)
def page_signature(spark, sf_dir):
    own = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    pages = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("product"), F.floor(F.col("event_id") / 1000).alias("page")).agg(own.alias("ids"))
    return C.page_changes(pages, C.signature(F.col("ids"))).select("product", "page", "signature", "changed")


@query(
    """WITH r AS (SELECT user_id AS product, event_id AS round, event_type AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM events),
    l AS (SELECT *, row_number() OVER (PARTITION BY product, run, n ORDER BY round) AS k FROM r) SELECT product, min(round) FILTER (k > 2) AS stop_round FROM l GROUP BY product"""
)
def stop_rule(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("product"), F.col("event_id").alias("round"), F.col("event_type").alias("n"))
    return C.stop_after_unchanged(rows, 2)


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'all' ELSE (p_size % 5 + 1) || '_star' END AS key, (p_size * 1000 + 500)::BIGINT AS n FROM part")
def rating_filter_parse(spark, sf_dir):
    size = F.col("p_size")
    label = F.concat(F.when(size % 4 == 0, "All").otherwise(F.concat((size % 5 + 1).cast("string"), F.lit("  Star"))), F.lit(" ("), size.cast("string"), F.lit(".5K)"))
    parsed = T.rating_filter(label)
    return table(spark, sf_dir, "part").select("p_partkey", parsed["key"].alias("key"), parsed["count"].alias("n"))


@query("SELECT source AS link, doc_id AS pos, k AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE lang <> 'de') WHERE k <= 6")
def review_head(spark, sf_dir):
    rows = doc_reviews(spark, sf_dir).withColumn("is_duplicate", F.lit(False))
    return views.head_per_product(rows, 6, F.col("lang") != "de").select("link", "pos", "rank")


@query("SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1, 'is') AS title, len(regexp_extract_all(html, '<a\\s[^>]*href=', 0, 'i'))::INT AS links FROM pages")
def html_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.title(F.col("html")).alias("title"), P.link_count(F.col("html")).alias("links"))


@query(
    """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="[^"]*"', 0)) AS tag, generate_subscripts(regexp_extract_all(html, '(?i)<a\\s[^>]*href="[^"]*"', 0), 1) - 1 AS place FROM pages)
    SELECT page_id, place::INT AS place, replace(replace(regexp_extract(tag, '(?i)href="([^"]*)"', 1), '&amp;', '&'), '&quot;', '"') AS href FROM t"""
)
def html_links(spark, sf_dir):
    return P.anchors(table(spark, sf_dir, "pages"), "page_id").select("page_id", "place", "href")


_ESCAPED = """replace(replace(replace(replace(replace(coalesce(nullif(text, ''), 'No written review'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


@query(f"SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN regexp_replace({_ESCAPED}, '(worthless)', '<mark>\\1</mark>', 'gi') ELSE {_ESCAPED} END, '(worth)', '<mark>\\1</mark>', 'gi') AS html FROM documents")
def highlight(spark, sf_dir):
    terms = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("worth"), F.lit("worthless"))).otherwise(F.array(F.lit("worth"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", T.highlight(F.col("text"), terms).alias("html"))


@query("SELECT p_partkey, '₱' || printf('%.1f', p_retailprice) || ' é' AS price FROM part")
def mojibake_repair(spark, sf_dir):
    shown = F.concat(F.lit("  â‚±"), F.format_string("%.1f", "p_retailprice"), F.lit("\n Ã©"))
    return table(spark, sf_dir, "part").select("p_partkey", T.repair(shown).alias("price"))


from . import queries_collect, queries_files, queries_model, queries_more, queries_pages, queries_scale  # noqa: E402, F401  they register themselves
