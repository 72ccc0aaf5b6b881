"""Safer alternatives for every product.

A product's best candidates are those of its own category; only if they are too few do the
best of all others follow.  So candidates are the top of each category and one short global list,
never all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..scratch import written


def rank_alternatives(products: DataFrame, k: int = 3) -> DataFrame:
    """(link, rank, alternative): k other analysed products; same category first, then by reliability, review count, input order.

    ``products``: ``link`` (unique), ``category``, ``reliability``, ``review_count``, ``ordinal`` (unique) and ``analysed``.
    Categories are compared without case and outer blanks; an empty or null one matches none.  Reliability counts to one digit.
    """
    best = [F.desc("reliability"), F.desc("review_count"), F.asc("ordinal")]
    category = F.coalesce(F.lower(F.trim(F.col("category").cast("string"))), F.lit(""))
    pool = products.where("analysed").select(
        F.col("link").alias("alternative"), category.alias("category"), N.round_half_even(F.col("reliability"), 1).alias("reliability"),
        F.coalesce(F.col("review_count").try_cast("long"), F.lit(0)).alias("review_count"), "ordinal",
    )
    own = pool.withColumn("r", F.row_number().over(Window.partitionBy("category").orderBy(*best))).where(F.col("r") <= k + 1)
    own = written(own)  # the heads of all categories, which every branch below reads
    # The best of all: k + 1 of them may be of a product's own category or itself, which leaves k others.
    overall = own.drop("r").orderBy(*best).limit(2 * k + 2)
    asked = products.select("link", category.alias("category"))
    enough = own.where(f"category != '' and r = {k + 1}").select("category")
    own = own.drop("r")
    same = asked.join(own.where("category != ''").withColumn("match", F.lit(1)), "category").where("link != alternative")
    needing = asked.join(enough, "category", "left_anti").withColumnRenamed("category", "own")
    other = needing.join(F.broadcast(overall), (F.col("own") != F.col("category")) | (F.col("own") == "")).where("link != alternative")
    columns = ["link", "alternative", "match", "reliability", "review_count", "ordinal"]
    both = same.select(*columns).unionByName(other.withColumn("match", F.lit(0)).select(*columns))
    order = Window.partitionBy("link").orderBy(F.desc("match"), *best)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("link", "rank", "alternative")


def alternatives_for_risky(products: DataFrame, k: int = 3, least_score: float = 61.0) -> DataFrame:
    """Alternatives only for products whose raw risk score is at least ``least_score``."""
    ranked = rank_alternatives(products, k)
    return ranked.join(products.where(F.col("risk_score") >= least_score).select("link"), "link", "left_semi")
