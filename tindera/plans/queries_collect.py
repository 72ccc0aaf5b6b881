"""Queries of the collection of reviews: page by page in a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import written
from ..streaming import paging
from .base import fixture_folder, query, table

#: Events on a page, and pages at most.
WIDTH, MOST = 400, 12

_PAGES_SQL = f"""
WITH e AS (SELECT user_id::VARCHAR AS product, CASE WHEN user_id % 2 = 0 THEN 'all' ELSE (length(event_type) % 5 + 1)::VARCHAR END AS context, event_id // {WIDTH} + 1 AS page, event_id AS pos, event_type || coalesce(props, '') AS identity, value FROM events),
plan AS (SELECT product, context, CASE context WHEN 'all' THEN 24 ELSE 9 END AS goal, count(*) FILTER (value > 60) AS reported, max(page) FILTER (value > 200) AS done FROM e GROUP BY ALL),
stored AS (SELECT DISTINCT product, context, identity FROM e WHERE value > 45),
have AS (SELECT plan.*, count(identity) AS have FROM plan LEFT JOIN stored USING (product, context) GROUP BY ALL),
grid AS (SELECT product, context, unnest(range(1, {MOST} + 1)) AS page FROM plan),
shown AS (SELECT product, context, page, count(*) AS shown, max(pos % 61) AS top, array_to_string(list(identity ORDER BY pos)[1:2], '|') AS sig FROM e GROUP BY ALL),
firsts AS (SELECT product, context, identity, min(page) AS page FROM e WHERE page <= {MOST} AND (product, context, identity) NOT IN (SELECT (product, context, identity) FROM stored) GROUP BY ALL),
fresh AS (SELECT product, context, page, count(*) AS new FROM firsts GROUP BY ALL),
rows_ AS (SELECT g.*, goal, reported, done, have, coalesce(shown, 0) AS shown, coalesce(new, 0) AS new, NOT coalesce(top = 60 AND g.page > 1, false) AND NOT (g.page = 1 AND product LIKE '%7') AS found,
    CASE WHEN top = 59 THEN '' WHEN top < 45 THEN 'same' ELSE coalesce(sig, '') END AS sig, CASE WHEN top = 58 THEN 'next_button_disabled' WHEN top = 57 THEN 'page_transition_failed' END AS outcome
  FROM grid g LEFT JOIN shown USING (product, context, page) LEFT JOIN fresh USING (product, context, page) JOIN have USING (product, context)),
run AS (SELECT *, have + sum(new) OVER o - new AS before, lead(sig) OVER o AS following FROM rows_ WINDOW o AS (PARTITION BY product, context ORDER BY page)),
why AS (SELECT *, CASE WHEN found AND shown > 0 THEN least(goal, before + new) ELSE before END AS total,
    CASE WHEN NOT found THEN 'review_container_missing' WHEN shown = 0 THEN 'empty_review_page' WHEN least(goal, before + new) >= goal THEN 'target_reached' WHEN sig = '' THEN 'missing_page_signature'
      WHEN outcome IS NOT NULL THEN outcome WHEN following = sig THEN 'page_signature_timeout' WHEN page = {MOST} THEN 'max_review_pages_reached' END AS reason FROM run),
stop AS (SELECT product, context, arg_min(page, page) AS page, arg_min(reason, page) AS reason, arg_min(total, page) AS total FROM why WHERE reason IS NOT NULL GROUP BY ALL)
SELECT product, context, greatest(coalesce(done, 0), CASE WHEN have >= goal OR (s.page = 1 AND s.reason = 'review_container_missing') THEN 0 ELSE s.page END)::BIGINT AS completed_pages,
  CASE WHEN have >= goal OR (s.page = 1 AND s.reason = 'review_container_missing') THEN have ELSE s.total END::BIGINT AS collected_reviews,
  CASE WHEN have >= goal THEN 'target_reached' WHEN s.page = 1 AND s.reason = 'review_container_missing' THEN CASE WHEN reported > 0 THEN 'review_widget_missing' ELSE 'no_reviews' END ELSE s.reason END AS stop_reason
FROM have LEFT JOIN stop s USING (product, context)
"""


def _seen(spark, sf_dir):
    """Pages out of events: users are products, event ids are places; odd users are collected by star."""
    context = F.when(F.col("user_id") % 2 == 0, "all").otherwise((F.length("event_type") % 5 + 1).cast("string"))
    page = (F.floor(F.col("event_id") / WIDTH) + 1).cast("long")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("product"), context.alias("context"), page.alias("page"), F.col("event_id").alias("pos"), F.concat("event_type", F.coalesce("props", F.lit(""))).alias("identity"), "value",
    )
    over = lambda n: F.col("value") > n
    plan = rows.groupBy("product", "context").agg(F.count_if(over(60)).alias("reported"), F.coalesce(F.max(F.when(over(200), F.col("page"))), F.lit(0)).alias("done_pages"))
    plan = plan.withColumn("limit", F.when(F.col("context") == "all", 24).otherwise(9).cast("long"))
    listed = F.collect_list(F.struct("pos", "identity"))
    shown = rows.groupBy("product", "context", "page").agg(F.max(F.col("pos") % 61).alias("top"), F.array_sort(listed).alias("reviews"))
    grid = plan.select("product", "context", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(MOST).cast("long"))).alias("page"))
    top = F.col("top")
    missing = F.coalesce((top == 60) & (F.col("page") > 1), F.lit(False)) | ((F.col("page") == 1) & F.col("product").like("%7"))
    none = F.array().cast("array<struct<pos:bigint,identity:string>>")
    pages = grid.join(shown, ["product", "context", "page"], "left").select(
        "product", "context", "page", (~missing).alias("found"), F.when(top == 59, "").when(top < 45, "same").otherwise(paging.signature_of(F.coalesce("reviews", none))).alias("signature"),
        F.when(top == 58, "next_button_disabled").when(top == 57, "page_transition_failed").alias("outcome"), F.coalesce("reviews", none).alias("reviews"),
    )
    return rows, rows.where("value > 45"), plan, pages


@query(_PAGES_SQL)
def collect_pages(spark, sf_dir):
    """Every product's collection with its reason, its pages and its count, by limits for each scope."""
    rows, stored, plan, pages = _seen(spark, sf_dir)
    return paging.fold_pages(pages.drop("reviews"), rows.drop("value"), stored, plan, MOST)


@query(_PAGES_SQL)
def collect_pages_stream(spark, sf_dir):
    """The same pages as a stream in three steps, with state by product and identity; the last checkpoint of each product."""
    rows, stored, plan, pages = _seen(spark, sf_dir)
    known = stored.groupBy("product", "context").agg(F.collect_set("identity").alias("identities"))
    plan = plan.join(known, ["product", "context"], "left").withColumn("identities", F.coalesce("identities", F.array().cast("array<string>")))
    folder = fixture_folder(spark)
    once = written(pages)

    def save(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # A step is a batch of any number of files; the stream goes on from its checkpoint.
        for step in range(3):
            once.where((F.col("page") > 4 * step) & (F.col("page") <= 4 * step + 4)).write.parquet(f"{folder}/in/{step}")
            stream = spark.readStream.schema(pages.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
            made = paging.pages_stream(stream, plan, MOST)
            made.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    last = F.max_by(F.struct("completed_pages", "collected_reviews", "stop_reason"), "batch").alias("r")
    return spark.read.parquet(f"{folder}/out").groupBy("product", "context").agg(last).select("product", "context", "r.*")
