"""Aggregates over analysed reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.text import fingerprint_key
from ..scratch import bound_batches, free, written
from .text_model import TextModel, active_evidence

NEGATIVE_WEIGHT, FAILURE_WEIGHT = 0.3, 0.7
LEVELS = ("Low", "Moderate", "High")


def risk_score(negative_ratio: Column, failure_rate: Column) -> Column:
    """0..100: three parts negative reviews, seven parts reviews with a risk."""
    return 100 * (NEGATIVE_WEIGHT * negative_ratio + FAILURE_WEIGHT * failure_rate)


def summarise(reviews: DataFrame, products: DataFrame | None = None, label: str = "label", compound: str = "compound", detected: str = "detected", rounded: bool = True, keys: Sequence[str] = ("link",)) -> DataFrame:
    """Per product: counts and shares of labels, mean compound, risk counts and score.

    Duplicates and reviews with an empty fingerprint are left out; ``duplicate_review_count`` counts
    the former and ``all_reviews`` every row.  With ``products`` those without reviews are kept, with zeros.
    """
    counted = ~F.col("is_duplicate") & F.col("fingerprint").isNotNull()
    share = lambda c: F.when(F.col("review_count") > 0, F.col(c) / F.col("review_count")).otherwise(0.0)
    out = reviews.groupBy(*keys).agg(
        F.count_if(counted).alias("review_count"),
        *[F.count_if(counted & (F.col(label) == x)).alias(x) for x in ("positive", "neutral", "negative")],
        F.avg(F.when(counted, F.col(compound))).alias("average_compound"),
        F.count_if(counted & F.col(detected)).alias("risk_review_count"),
        F.count_if("is_duplicate").alias("duplicate_review_count"),
        F.count("*").alias("all_reviews"),
    )
    if products is not None:
        out = products.select(*keys).join(out, list(keys), "left").na.fill(0)
    out = out.withColumn("average_compound", F.coalesce("average_compound", F.lit(0.0)))
    r = N.round_half_even if rounded else (lambda c, d: c)
    return out.select(
        *keys, "review_count", "positive", "neutral", "negative",
        *[r(share(x), 4).alias(f"{x}_ratio") for x in ("positive", "neutral", "negative")],
        r(F.col("average_compound"), 4).alias("average_compound"), "risk_review_count",
        r(share("risk_review_count"), 4).alias("keyword_failure_rate"),
        r(risk_score(share("negative"), share("risk_review_count")), 2).alias("risk_score"), "duplicate_review_count", "all_reviews",
    )


def category_counts(reviews: DataFrame, keys: Sequence[str] = ("link",)) -> DataFrame:
    """(link, category, n): reviews with a risk of the category, each once."""
    counted = reviews.where(~F.col("is_duplicate") & F.col("fingerprint").isNotNull())
    return counted.select(*keys, F.explode(F.array_distinct("categories")).alias("category")).groupBy(*keys, "category").agg(F.count("*").alias("n"))


def category_map(counts: DataFrame, keys: Sequence[str] = ("link",)) -> DataFrame:
    """The counts as one map per product, by name."""
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("risk_categories"))


def keyword_counts(reviews: DataFrame, most: int | None = None) -> DataFrame:
    """(link, term, n, first): active risk terms over all reviews, duplicates included, most frequent first.

    ``most`` keeps that many per product, ties by first occurrence.
    """
    terms = reviews.select("link", "pos", F.posexplode(active_evidence(F.col("evidence"))).alias("k", "e"))
    out = terms.groupBy("link", F.lower("e.term").alias("term")).agg(F.count("*").alias("n"), F.min(F.struct("pos", "k")).alias("first"))
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("link").orderBy(F.desc("n"), "first", "term"))
        out = out.withColumn("rank", rank).where(F.col("rank") <= most)
    return out


def level_distribution(products: DataFrame, score: Column) -> DataFrame:
    """(level, n) for all three levels, also those without products."""
    spark = products.sparkSession
    counts = products.groupBy(N.risk_level(score).alias("level")).agg(F.count("*").alias("n"))
    levels = spark.createDataFrame([(i, x) for i, x in enumerate(LEVELS)], "place int, level string")
    return levels.join(counts, "level", "left").select("place", "level", F.coalesce("n", F.lit(0)).alias("n"))


def landing_stats(products: DataFrame) -> DataFrame:
    """Totals over products with ``n_comments``, ``risk_score`` (null: not analysed) and ``positive_ratio``."""
    score = F.col("risk_score")
    trust = N.reliability(score, F.col("positive_ratio"))
    return products.agg(
        F.count("*").alias("products"), F.coalesce(F.sum("n_comments"), F.lit(0)).cast("long").alias("comments"),
        F.count_if(N.risk_level(score) == "High").alias("high"), F.count_if(score.isNotNull()).alias("analysed"),
        F.coalesce(F.avg(trust), F.lit(0.0)).alias("mean_reliability"),
    )


def analyse_reviews(reviews: DataFrame, model: TextModel, text: str = "content") -> DataFrame:
    """Adds ``analysis``, and its label, compound, detected, categories and evidence as columns."""
    bound_batches(reviews.sparkSession)
    out = reviews.withColumn("analysis", model.analyse(F.col(text)))
    picks = {"label": "label", "compound": "scores.compound", "detected": "risk.detected", "categories": "risk.categories", "evidence": "risk.evidence"}
    return out.withColumns({k: F.col(f"analysis.{v}") for k, v in picks.items()})


def judge_reviews(reviews: DataFrame, model: TextModel, text: str = "content") -> DataFrame:
    """Adds label, compound, detected and categories alone: all that summaries and category counts ask for."""
    bound_batches(reviews.sparkSession)
    made = free("verdict", reviews.columns)
    names = ("label", "compound", "detected", "categories")
    return reviews.withColumn(made, model.judge(F.col(text))).withColumns({n: F.col(f"{made}.{n}") for n in names}).drop(made)


def verdicts(reviews: DataFrame, model: TextModel, keep: Sequence[str] = ("link", "pos"), text: str = "content") -> DataFrame:
    """A written table of what is known of each review: ``keep``, label, compound, detected, categories and ``fingerprint``.

    Texts are read and scored once, however many summaries follow, and take part in no shuffle.
    """
    made = judge_reviews(reviews, model, text).withColumn("fingerprint", fingerprint_key(F.col(text)))
    return written(made.select(*keep, "label", "compound", "detected", "categories", "fingerprint"))


def needs_analysis(products: DataFrame, summary: str = "sentiment_summary") -> bool:
    """Is there a product without a summary?  Then all are analysed again."""
    return not products.where(F.col(summary).isNull()).isEmpty()
