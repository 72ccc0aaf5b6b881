"""Queries of what holds at any size: the store's commits, long products, deep pages, decisions, states, analyses by text."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.word_file import ship, word_sums
from ..operators import deep_pages, scan, states
from ..operators import qualification as Q
from ..operators.analyses import Analyses
from ..operators.store import SCHEMAS, Store
from ..streaming import collect as C
from .base import fixture_folder, query, spread, table


def _shaped(rows, kind: str, /, **given):
    """Rows of a store's table out of some of its columns; the others are null."""
    return rows.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in SCHEMAS[kind].split(", ")) if n != "review_key"], F.col("ordinal"))


def _products(spark, sf_dir, price, where: str = "true"):
    rows = table(spark, sf_dir, "part").where(where).withColumn("ordinal", F.col("p_partkey"))
    return _shaped(rows, "products", link=F.col("p_partkey").cast("string"), name=F.col("p_name"), price=price)


def _ratings(spark, sf_dir, content):
    rows = table(spark, sf_dir, "lineitem").withColumn("ordinal", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return _shaped(rows, "reviews", product_link=F.col("l_partkey").cast("string"), author=F.col("l_orderkey").cast("string"), content=content, rating=F.col("l_linenumber"))


@query(
    """SELECT 'products' AS name, count(*) AS n, count(*) FILTER (true) AS first, 0::BIGINT AS second, 1::BIGINT AS commits FROM part
    UNION ALL SELECT 'reviews', count(*), count(*), 0, 1 FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem)"""
)
def store_transaction(spark, sf_dir):
    """A save of parts and line items, and one of which the second table fails: neither table shows anything of it."""
    store = Store(spark, fixture_folder(spark))
    line = F.col("l_linenumber").cast("string")
    store.save(_products(spark, sf_dir, F.lit("first")), _ratings(spark, sf_dir, line))
    broken = F.when(F.col("l_linenumber") < 7, line).otherwise(F.raise_error(F.lit("a row that cannot be read")))
    commits = 1
    try:
        commits = store.save(_products(spark, sf_dir, F.lit("second")), _ratings(spark, sf_dir, broken))
    except PySparkException as failure:
        if "cannot be read" not in str(failure):
            raise
    shown = store.read("products").agg(F.count("*").alias("n"), F.count_if(F.col("price") == "first").alias("first"), F.count_if(F.col("price") == "second").alias("second")).select(F.lit("products").alias("name"), "*")
    kept = store.read("reviews").agg(F.count("*").alias("n"), F.count_if(F.col("content").isNotNull()).alias("first"), F.lit(0).cast("long").alias("second")).select(F.lit("reviews").alias("name"), "*")
    return shown.unionByName(kept).withColumn("commits", F.lit(store.log.state()[0]).cast("long") + F.lit(commits - 1))


@query(
    """SELECT p_partkey::VARCHAR AS link, CASE WHEN s.ps IS NOT NULL THEN s.ps ELSE 'old' END AS price, p_name AS name FROM part
    LEFT JOIN (SELECT l_partkey, 'sold ' || count(*) AS ps FROM lineitem WHERE l_quantity >= 45 GROUP BY 1) s ON s.l_partkey = p_partkey"""
)
def store_bucket_upsert(spark, sf_dir):
    """Parts stored in hash buckets; those that sell in large lots come again with another price, and only files that hold them are written anew."""
    store = Store(spark, fixture_folder(spark), buckets=8)
    nothing = _ratings(spark, sf_dir, F.lit("")).limit(0)
    store.save(_products(spark, sf_dir, F.lit("old")), nothing)
    lots = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("lots"))
    sold = table(spark, sf_dir, "part").join(lots, "p_partkey").withColumn("ordinal", F.col("p_partkey"))
    store.save(_shaped(sold, "products", link=F.col("p_partkey").cast("string"), name=F.col("p_name"), price=F.concat(F.lit("sold "), F.col("lots").cast("string"))), nothing)
    return store.read("products").select("link", "price", "name")


@query(
    """SELECT p_partkey::VARCHAR AS link, count(l_orderkey) AS reviews FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber FROM lineitem) ON l_partkey = p_partkey
    WHERE p_brand NOT IN ('Brand#3', 'Brand#17') GROUP BY 1"""
)
def store_cascade(spark, sf_dir):
    """Parts of two brands are deleted, and their line items with them: what is left of both tables, and nothing without its product."""
    store = Store(spark, fixture_folder(spark))
    store.save(_products(spark, sf_dir, F.lit("x")), _ratings(spark, sf_dir, F.col("l_linenumber").cast("string")))
    store.delete_products(table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#3", "Brand#17")).select(F.col("p_partkey").cast("string").alias("link")))
    left = store.read("reviews").groupBy("product_link").agg(F.count("*").alias("n"))
    joined = store.read("products").join(left, F.col("link") == F.col("product_link"), "full_outer")
    return joined.select(F.coalesce("link", F.concat(F.lit("lost "), "product_link")).alias("link"), F.coalesce("n", F.lit(0).cast("long")).alias("reviews"))


@query("SELECT 'evaluation_runs' AS name, 0::BIGINT AS n, NULL::BIGINT AS last_id UNION ALL SELECT 'products', count(*), NULL FROM part UNION ALL SELECT 'reviews', 0, NULL UNION ALL SELECT 'survey_responses', 2 * count(*), 2 * count(*) FROM customer")
def store_counts(spark, sf_dir):
    """Rows of all four tables, from the log alone; answers out of customers are appended twice and numbered on."""
    store = Store(spark, fixture_folder(spark))
    store.save(_products(spark, sf_dir, F.lit("x")), _ratings(spark, sf_dir, F.lit("")).limit(0))
    rows = table(spark, sf_dir, "customer").withColumn("ordinal", F.col("c_custkey"))
    form = _shaped(rows, "survey_responses", submitted_at=F.col("c_name"), sus_score=F.col("c_acctbal"))
    store.append("survey_responses", form)
    store.append("survey_responses", form)
    last = store.read("survey_responses").agg(F.max("id").alias("last_id")).select(F.lit("survey_responses").alias("table"), "last_id")
    return store.counts().join(last, "table", "left").select(F.col("table").alias("name"), "n", "last_id")


@query(
    """WITH r AS (SELECT event_id, event_type AS v, row_number() OVER (ORDER BY event_id) AS number, lag(event_type) OVER (ORDER BY event_id) AS prev FROM events),
    c AS (SELECT *, CASE WHEN number > 1 THEN v IS DISTINCT FROM prev END AS changed FROM r),
    s AS (SELECT *, max(CASE WHEN coalesce(changed, true) THEN number END) OVER (ORDER BY event_id) AS start FROM c) SELECT event_id, number, changed, number - start AS unchanged_for FROM s"""
)
def huge_product_runs(spark, sf_dir):
    """All events are one product's: numbers, changes and runs come from ranges of it in many tasks."""
    rows = table(spark, sf_dir, "events").select(F.lit("one").alias("product"), "event_id", "event_type")
    return scan.changes(rows, ["product"], ["event_id"], F.col("event_type")).select("event_id", "number", "changed", "unchanged_for")


@query(
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS k, count(*) OVER () AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (ceil(n / 20.0)::INT // 2)::INT AS page, ceil(n / 20.0)::INT AS pages FROM o WHERE k // 20 = ceil(n / 20.0)::INT // 2"""
)
def deep_page(spark, sf_dir):
    """The middle page of all line items by price: only the range of prices that holds it is sorted."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    middle = -(-rows.count() // 20) // 2
    by = [deep_pages.By("l_extendedprice", descending=True), *map(deep_pages.By, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
    return deep_pages.deep_page(rows, by, middle, 20, most=2000)


@query(
    """WITH o AS (SELECT *, row_number() OVER (ORDER BY p_brand, p_name, p_partkey) - 1 AS k, count(*) OVER () AS n FROM part)
    SELECT p_brand, p_name, p_partkey, (ceil(n / 6.0)::INT * 2 // 3)::INT AS page, ceil(n / 6.0)::INT AS pages FROM o WHERE k // 6 = ceil(n / 6.0)::INT * 2 // 3"""
)
def deep_page_of_texts(spark, sf_dir):
    """A deep page by brand and name: ranges of text, and columns in which many rows tie."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey")
    number = -(-rows.count() // 6) * 2 // 3
    return deep_pages.deep_page(rows, [deep_pages.By("p_brand"), deep_pages.By("p_name"), deep_pages.By("p_partkey")], number, 6, most=10)


@query(
    """WITH p AS (SELECT p_partkey, p_size / 10.0 AS r, p_partkey % 200 AS n FROM part), q AS (SELECT *, r >= 2.5 AND n >= 100 AS a, r >= 2.0 AND n >= 50 AS b FROM p)
    SELECT p_partkey::VARCHAR AS link, CASE WHEN a THEN 2 ELSE 0 END AS comments, CASE WHEN a THEN 'complete' ELSE 'not_qualified' END AS review_status, CASE WHEN a THEN NULL ELSE 'qualification' END AS context, n AS reported,
      NOT a AS then_same, false AS then_other, CASE WHEN p_partkey % 3 = 0 THEN false ELSE NOT a END AS now_same, CASE WHEN p_partkey % 3 = 0 THEN NOT b ELSE false END AS now_other FROM q"""
)
def qualification_roundtrip(spark, sf_dir):
    """Decisions under two pairs of minima; what must be checked again, as of the first day and now."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("link"), (F.col("p_size") / 10).alias("rating"), (F.col("p_partkey") % 200).alias("total_rating"), F.array(F.lit("a"), F.lit("b")).alias("comments"), F.lit("complete").alias("review_status"), "p_partkey",
    )
    first = Q.apply_qualification(parts, 2.5, 100, checked_at=F.lit("2026-01-01T00:00:00"))
    third = Q.apply_qualification(parts.where("p_partkey % 3 = 0"), 2.0, 50, checked_at=F.lit("2026-02-01T00:00:00"))
    history = Q.decisions(first).unionByName(Q.decisions(third))
    out = first.select("link", F.size("comments").alias("comments"), "review_status", F.col("review_checkpoint.context").alias("context"), F.col("reported_review_count").alias("reported"))
    day = F.lit("2026-01-15T00:00:00")
    for name, minima, at in (("then_same", (2.5, 100), day), ("then_other", (2.0, 50), day), ("now_same", (2.5, 100), None), ("now_other", (2.0, 50), None)):
        out = out.join(Q.to_check(parts, history, *minima, at=at).select("link", F.col("skip").alias(name)), "link")
    return out


_EVENTS = "CASE event_type WHEN 'view' THEN 'check' WHEN 'click' THEN 'scrape' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'reject' ELSE 'qualify' END"
_MOVES = " ".join(f"WHEN starts_with(acc, '{a}|') AND e = '{e}' THEN '{b}|' || substr(acc, {len(a) + 2})" for a, moves in states.TRANSITIONS.items() for e, b in moves.items())


@query(
    f"""WITH l AS (SELECT user_id AS product, max(event_id) AS upto, list({_EVENTS} ORDER BY event_id) AS events FROM events GROUP BY 1),
    f AS (SELECT product, upto, list_reduce(list_prepend('discovered|', events), lambda acc, e: CASE {_MOVES} ELSE acc || 'x' END) AS acc FROM l)
    SELECT product, split_part(acc, '|', 1) AS state, upto, length(split_part(acc, '|', 2))::BIGINT AS forbidden FROM f"""
)
def state_replay(spark, sf_dir):
    """Where each user's events lead, with those that weren't allowed."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("product"), F.col("event_id").alias("seq"), F.expr(_EVENTS).alias("event"))
    return states.replay(log, stretch=64)


@query(
    f"""WITH l AS (SELECT user_id AS product, max(event_id) AS upto, list({_EVENTS} ORDER BY event_id) AS events FROM events GROUP BY 1),
    f AS (SELECT product, upto, list_reduce(list_prepend('discovered|', events), lambda acc, e: CASE {_MOVES} ELSE acc || 'x' END) AS acc FROM l)
    SELECT product, split_part(acc, '|', 1) AS state, upto FROM f"""
)
def state_snapshot_and_delta(spark, sf_dir):
    """A snapshot of the first day's events, and the whole log replayed on it: the same states."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("product"), F.col("event_id").alias("seq"), F.expr(_EVENTS).alias("event"), "ts")
    first = log.agg(F.date_add(F.min("ts"), 1).alias("day")).first()["day"]
    snapshot = states.replay(log.where(F.col("ts") < F.lit(first)).drop("ts"))
    return states.replay(log.drop("ts"), snapshot).select("product", "state", "upto")


@query("SELECT o_custkey AS link, min(o_orderkey) AS ordinal FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY 1")
def new_links(spark, sf_dir):
    """Customers with orders that a store of customers doesn't hold; the store is thinned by a filter before its shuffle."""
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("link"), F.col("o_orderkey").alias("ordinal"))
    return C.new_only(found, table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("link"))).select("link", "ordinal")


@query(
    """WITH t AS (SELECT count(*) AS n, count(DISTINCT coalesce(text, '')) AS d FROM documents) SELECT 'first' AS run, n AS rows, d AS scored, n AS found FROM t
    UNION ALL SELECT 'again', n, 0, n FROM t UNION ALL SELECT 'other version', n, d, n FROM t"""
)
def analyses_once(spark, sf_dir):
    """All documents scored, the same again, and under another version of the model: each distinct text is scored once a version."""
    from .registry import model

    docs, folder = spread(table(spark, sf_dir, "documents").select("doc_id", "text")), fixture_folder(spark)
    out = None
    for run, version in (("first", "1"), ("again", "1"), ("other version", "2")):
        scorer = model()
        scorer.version = version
        store = Analyses(spark, folder, scorer)
        scored = store.add(docs, "text")
        row = store.attach(docs, "text").agg(F.count("*").alias("rows"), F.count_if(F.col("analysis.model_version") == version).alias("found")).select(F.lit(run).alias("run"), "rows", F.lit(scored).cast("long").alias("scored"), "found")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    """SELECT doc_id, rank, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(t, '(worthless)', '<mark>\\1</mark>', 'gi') ELSE t END, '(worth)', '<mark>\\1</mark>', 'gi') AS html
    FROM (SELECT *, replace(replace(replace(replace(replace(coalesce(nullif(text, ''), 'No written review'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t
      FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents WHERE lang = 'en') WHERE rank <= 30)"""
)
def review_evidence(spark, sf_dir):
    """The reviews of a product as they are shown: a choice, the first thirty, and each with its own active terms marked."""
    from ..operators import views

    rows = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("source").alias("link"), F.col("doc_id").alias("pos"), F.col("text").alias("content"), F.lit(False).alias("is_duplicate"), "doc_id")
    term = lambda t, negated: F.struct(F.lit(t).alias("term"), negated.alias("negated"))
    evidence = F.array(term("worth", F.lit(False)), term("worthless", F.col("doc_id") % 2 == 1), term("", F.lit(False)))
    return views.evidence_view(rows.withColumn("evidence", evidence), "evidence", 30).select("doc_id", "rank", "html")


@query(
    """SELECT p_partkey, 'https://shopee.ph/search?keyword=a+%26+' || p_partkey || '&page=' || greatest(0, p_size % 4 - 1) || '&sortBy=sales' AS shopee,
      'https://www.temu.com/ph-en/search_result.html?search_key=a+%26+' || p_partkey || '&search_method=user&refer_page_el_sn=200010' || CASE WHEN p_size % 4 - 1 > 1 THEN '&page=' || (p_size % 4 - 1) ELSE '' END AS temu FROM part"""
)
def search_urls_of_all(spark, sf_dir):
    """Search URLs of Shopee, whose words are trimmed and whose pages begin at 0, and of Temu, whose first page is not named."""
    words, page = F.concat(F.lit("a & "), F.col("p_partkey").cast("string")), F.col("p_size") % 4 - 1
    return table(spark, sf_dir, "part").select("p_partkey", U.shopee_search_url(F.concat(F.lit("  "), words), page).alias("shopee"), U.temu_search_url(words, page).alias("temu"))


#: Words of the generated dictionary, beside those of the documents.
FILLERS = 1_000_000


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS t FROM documents),
    own AS (SELECT t, (length(t) % 5 - 2)::DOUBLE AS v FROM (SELECT DISTINCT t FROM w) WHERE length(t) % 3 > 0)
    SELECT d.doc_id, count(own.t) AS known, coalesce(sum(own.v), 0)::DOUBLE AS total FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN own ON own.t = w.t GROUP BY d.doc_id"""
)
def large_dictionary(spark, sf_dir):
    """Words of a dictionary of more than a million, in all documents: the documents' own words, and others that occur in none."""
    docs = spread(table(spark, sf_dir, "documents"))
    size = F.length("token")
    own = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct().where(size % 3 > 0)
    words = own.select("token", (size % 5 - 2).cast("double").alias("valence")).unionByName(spark.range(FILLERS).select(F.concat(F.lit("word "), "id").alias("token"), F.lit(1.0).alias("valence")))
    return docs.select("doc_id", word_sums(F.col("text"), ship(words)).alias("r")).select("doc_id", "r.*")
