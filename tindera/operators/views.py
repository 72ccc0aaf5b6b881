"""What the dashboard shows, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions import urls as U

PAGE = 6
BANDS = ("all", "below 500", "500 to 1000", "1000 to 2500", "above 2500")


def product_rows(products: DataFrame) -> DataFrame:
    """The 13 display columns of each product: ``comments`` array and ``risk_score``/``positive_ratio`` of its summary (null: none)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    score, positive = F.col("risk_score"), F.col("positive_ratio")
    platform = U.product_platform(F.col("platform"), F.col("link"))
    return products.select(
        text("img").alias("image"), text("name").alias("product"), F.replace(text("price"), F.lit(N.MISREAD_PESO), F.lit("₱")).alias("price"),
        N.price_value(F.col("price")).alias("price_value"), N.rating_value(F.col("rating")).alias("rating"), F.greatest(F.lit(0), F.coalesce(F.size("comments"), F.lit(0))).alias("reviews"),
        F.coalesce(F.col("total_rating").try_cast("long"), F.lit(0)).alias("total_ratings"), text("location").alias("location"), U.platform_name(platform).alias("platform"),
        score.alias("risk_score"), N.risk_level(score).alias("level"), N.reliability(score, positive).alias("reliability"), text("link").alias("link"),
    )


def review_rows(reviews: DataFrame, product: str = "product") -> DataFrame:
    """The 12 display columns of analysed review rows; a review that wasn't analysed has no compound."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    whole = lambda c: F.coalesce(F.col(c).try_cast("double").cast("long"), F.lit(0))
    return reviews.select(
        text(product).alias("product"), text("author").alias("author"), whole("rating").alias("stars"), text("time").alias("date"), text("content").alias("review"), whole("like_count").alias("likes"),
        F.coalesce("label", F.lit("unanalyzed")).alias("sentiment"), "compound", F.coalesce("detected", F.lit(False)).alias("risk"),
        F.coalesce(F.array_join("categories", ", "), F.lit("")).alias("risk_categories"), F.coalesce("is_duplicate", F.lit(False)).alias("duplicate"), text("link").alias("product_link"),
    )


def selected(rows: DataFrame, link: str | None) -> DataFrame:
    """The row of a link, else the first one in input order; no row of an empty table."""
    order = [F.desc(F.coalesce(F.col("link") == F.lit(link), F.lit(False)).cast("int")), F.asc("ordinal")]
    return rows.orderBy(*order).limit(1)


def name_contains(name: Column, query: str) -> Column:
    return F.contains(T.folded(F.coalesce(name, F.lit(""))), T.folded(F.lit(query)))


def in_band(price: Column, band: str) -> Column:
    """Price bands; an unknown price is only in ``all``."""
    tests = {"all": F.lit(True), "below 500": price < 500, "500 to 1000": price.between(500, 1000), "1000 to 2500": (price > 1000) & (price <= 2500), "above 2500": price > 2500}
    return F.coalesce(tests[band], F.lit(False))


def sentiment_filter(choice: str, label: Column, detected: Column) -> Column:
    """All, Positive, Neutral, Negative or Flagged."""
    if choice == "All":
        return F.lit(True)
    return F.coalesce(detected if choice == "Flagged" else label == choice.lower(), F.lit(False))


def sort_columns(mode: str) -> list[Column]:
    """Order of the result grid; ties keep input order, unknown and zero prices come last."""
    price = F.nullif(F.col("price_value"), F.lit(0.0))
    first = {
        "reliability": F.desc("reliability"), "price_low": price.asc_nulls_last(), "price_high": price.desc_nulls_last(), "collected": F.desc("reviews"),
        "summarised": F.coalesce(F.col("summary_reviews").try_cast("long"), F.lit(0)).desc() if mode == "summarised" else None,
    }[mode]
    return [first, F.asc("ordinal")]


def page(rows: DataFrame, order: list[Column], number: int, size: int = PAGE) -> DataFrame:
    """Page ``number`` (from 0, clamped to those there are) of the rows, with ``page`` and ``pages``."""
    n = rows.count()
    pages = max(1, -(-n // size))
    number = min(max(number, 0), pages - 1)
    return rows.orderBy(*order).offset(number * size).limit(size).withColumns({"page": F.lit(number), "pages": F.lit(pages)})


def head_per_product(reviews: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The first k reviews of each product that aren't duplicates."""
    kept = reviews.where(~F.col("is_duplicate") & (where if where is not None else F.lit(True)))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("link").orderBy("pos"))).where(F.col("rank") <= k)


def evidence_view(reviews: DataFrame, evidence: str, k: int = 30, where: Column | None = None) -> DataFrame:
    """A product's reviews as they are shown: of those that aren't duplicates and fit the choice the first k, as ``html`` with their own active terms marked.

    Only what is shown is marked up.
    """
    shown = head_per_product(reviews, k, where)
    terms = F.transform(F.filter(evidence, lambda e: ~e["negated"] & (e["term"] != "")), lambda e: e["term"])
    return shown.withColumn("html", T.highlight(F.col("content"), terms))


def high_risk(rows: DataFrame) -> DataFrame:
    """Products at the high level, in four columns, in input order."""
    return rows.where("level = 'High'").select("product", "platform", "risk_score", "level")


def short_name(name: Column, size: int = 65) -> Column:
    return F.left(name, F.lit(size))


def gauge(score: Column) -> Column:
    share = N.risk_fraction(score)
    return F.struct((share * 100).alias("percent"), N.risk_level(score).alias("level"), F.when(share >= 0.6, "red").when(share >= 0.3, "amber").otherwise("green").alias("band"))
