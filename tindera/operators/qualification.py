"""Which products qualify, which are done, and what is left to collect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_now

# Reasons for which a product's collection ends.
STOP_REASONS = (
    "target_reached", "empty_review_page", "review_container_missing", "missing_page_signature", "next_button_disabled", "next_button_not_found",
    "page_signature_timeout", "page_transition_failed", "max_review_pages_reached", "no_reviews", "review_widget_missing", "not_qualified",
    "empty_review_batch", "missing_review_signature", "no_additional_reviews", "page_transition_error", "max_review_batches_reached",
)


def qualify(rating: Column, reviews: Column, min_rating: float, min_reviews: int, checked_at: Column | None = None) -> Column:
    """The record of a decision: ``status``, ``reasons``, the two values and the minima that it was made by, and when; both minima are inclusive."""
    r, n = F.coalesce(rating.try_cast("double"), F.lit(0.0)), F.coalesce(reviews.try_cast("long"), F.lit(0).cast("long"))
    reasons = F.array_compact(F.array(F.when(r < min_rating, "rating_below_minimum"), F.when(n < min_reviews, "review_count_below_minimum")))
    return F.struct(
        F.when(F.size(reasons) == 0, "qualified").otherwise("rejected").alias("status"), r.alias("rating"), n.alias("reported_review_count"), F.lit(float(min_rating)).alias("min_rating"),
        F.lit(int(min_reviews)).cast("long").alias("min_reviews"), reasons.alias("reasons"), (iso_now() if checked_at is None else checked_at).alias("checked_at"),
    )


CHECKPOINT = "struct<context:string,completed_pages:bigint,collected_reviews:bigint,stop_reason:string,updated_at:string>"


def apply_qualification(products: DataFrame, min_rating: float, min_reviews: int, keep_rejected: bool = True, checked_at: Column | None = None) -> DataFrame:
    """Adds ``qualification``, by the product's rating and its reported count (``total_rating``, or else ``reported_review_count``).

    A rejected product goes, or keeps its row without reviews, with the status ``not_qualified`` and a checkpoint that says so; the
    other products' status and checkpoint stay as they were.
    """
    taken = products.columns
    count = F.col("total_rating" if "total_rating" in taken else "reported_review_count")
    out = products.withColumn("qualification", qualify(F.col("rating"), count, min_rating, min_reviews, checked_at)).withColumn("reported_review_count", F.col("qualification.reported_review_count"))
    if not keep_rejected:
        return out.where("qualification.status = 'qualified'")
    rejected = F.col("qualification.status") == "rejected"
    old = lambda c, kind: F.col(c) if c in taken else F.lit(None).cast(kind)
    note = F.struct(
        F.lit("qualification").alias("context"), F.lit(0).cast("long").alias("completed_pages"), F.lit(0).cast("long").alias("collected_reviews"), F.lit("not_qualified").alias("stop_reason"), F.col("qualification.checked_at").alias("updated_at"),
    )
    return out.withColumns({
        "comments": F.when(rejected, F.slice("comments", 1, 0)).otherwise(F.col("comments")), "review_status": F.when(rejected, "not_qualified").otherwise(old("review_status", "string")),
        "review_checkpoint": F.when(rejected, note).otherwise(old("review_checkpoint", CHECKPOINT)),
    })


def rejected_before(qualification: Column, min_rating: float, min_reviews: int) -> Column:
    """Was a product rejected under these very minima?"""
    same = (qualification["min_rating"] == min_rating) & (qualification["min_reviews"] == min_reviews)
    return F.coalesce((qualification["status"] == "rejected") & same, F.lit(False))


def decisions(products: DataFrame) -> DataFrame:
    """The decisions that products hold, as rows of a history: ``link`` and the record's fields."""
    return products.where("qualification is not null").select("link", "qualification.*")


def to_check(products: DataFrame, history: DataFrame, min_rating: float, min_reviews: int, at: Column | None = None) -> DataFrame:
    """Products without ``known``: what must be checked again under these minima, and ``known``: the decision that still holds.

    As of ``at`` (a time as text; by default all) the latest decision of each product counts, and only a rejection under the very same minima
    saves a check: qualified products are looked at again, and so are all when the minima change.  The history of a product is one row after a
    partial aggregate, so long histories are not shuffled.
    """
    seen = history if at is None else history.where(F.col("checked_at") <= at)
    record = F.struct(*[c for c in seen.columns if c != "link"])
    latest = seen.groupBy("link").agg(F.max_by(record, "checked_at").alias("known"))
    return products.join(latest, "link", "left").withColumn("skip", rejected_before(F.col("known"), min_rating, min_reviews))


def terminal(checkpoint: Column, filters: Column, rating: int | None = None, review_status: Column | None = None) -> Column:
    """Does a checkpoint say that nothing more will come?

    It does without any reviews, and at the last page of the scope that was asked for: all reviews; those of the star
    ``rating``; or, without one, five stars as the last of all five filters.
    """
    stop, context = checkpoint["stop_reason"], F.coalesce(checkpoint["context"], F.lit(""))
    none = stop == "no_reviews" if review_status is None else (F.coalesce(review_status, F.lit("")) == "no_reviews") | F.coalesce(stop == "no_reviews", F.lit(False))
    scope = context == str(rating) if rating is not None else (context == "5") & F.coalesce(filters == F.array(*[F.lit(i) for i in range(1, 6)]), F.lit(False))
    at_end = stop.isin("next_button_disabled", "empty_review_page") & ((context == "all") | scope)
    return F.coalesce(none, F.lit(False)) | F.coalesce(at_end, F.lit(False))


# By marketplace, the scopes and the reasons with which a collection counts as done.
ENDS = {
    "shopee": (("all",), ("target_reached", "next_button_disabled", "no_reviews")),
    "temu": (("all", "limited"), ("target_reached", "next_button_disabled", "no_additional_reviews", "no_reviews")),
}


def incomplete(expected: Column, collected: Column, checkpoint: Column, market: str = "shopee", ended: Column | None = None, warned: Column | None = None) -> Column:
    """Is a stored product to be collected again?

    Shopee: fewer reviews than a known target, and the end wasn't reached.  Temu: the same, and also if no target is known.
    Lazada: unless a target is known and was met or ``ended`` (see ``terminal``), or if its filter was ``warned`` about.
    """
    known = F.coalesce(expected, F.lit(0)) > 0
    enough = known & (F.coalesce(collected, F.lit(0)) >= expected)
    if market == "lazada":
        done = known & (enough | F.coalesce(ended, F.lit(False)))
        return ~done | F.coalesce(warned.isNotNull() & (warned != "") if warned is not None else F.lit(False), F.lit(False))
    scopes, reasons = ENDS[market]
    done = F.coalesce(checkpoint["context"].isin(*scopes) & checkpoint["stop_reason"].isin(*reasons), F.lit(False))
    return (known & ~enough & ~done) if market == "shopee" else ~(done | enough)


def target(available: Column, limit: Column) -> Column:
    """How many to collect: what there is, if known, and the limit at most."""
    return F.when(available > 0, F.least(available, limit)).otherwise(limit)


def missing_reviews_reason(reported: Column) -> Column:
    """Without any review shown: are there none, or is the widget missing?"""
    return F.when(F.coalesce(reported, F.lit(0)) > 0, "review_widget_missing").otherwise("no_reviews")


def discovery_status(product: Column) -> Column:
    """Where a stored product stands in the queue; one whose details are being looked at has the status ``checking``."""
    return (
        F.when(product["last_error"].isNotNull() & (product["last_error"] != ""), "retryable_error")
        .when(product["qualification"]["status"] == "rejected", "rejected")
        .when(product["review_status"].isin("complete", "no_reviews"), "complete")
        .when(product["review_status"] == "collecting", "scraping")
        .when(product["discovery_status"] == "checking", "checking")
        .otherwise("discovered")
    )


# By marketplace, what the path, or the title and body, of a page hold that asks for a log-in or a proof.
BLOCKED = {
    "shopee": (("/buyer/login", "/captcha", "/verify", "/security-check"), ()),
    "lazada": (("/login", "/captcha", "/verify"), ("security verification", "verify your identity", "unusual traffic")),
    "temu": (("captcha", "verify", "login"), ("verify you are human", "security verification", "unusual activity", "access denied")),
}
BODY_CHARS = {"shopee": 0, "lazada": 1500, "temu": 2000}


def is_block_page(market: str, url: Column, title: Column, body: Column) -> Column:
    """Does a page ask for a log-in or a proof?  Of its body the beginning counts."""
    paths, words = BLOCKED[market]
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1))
    seen = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.left(F.coalesce(body, F.lit("")), F.lit(BODY_CHARS[market]))))
    found = F.lit(False)
    for column, tokens in ((path, paths), (seen, words)):
        for token in tokens:
            found = found | column.contains(token)
    return found


# What the discovery queue keeps of a product.
QUEUE = (
    "link", "name", "price", "rating", "sold_count", "img", "location", "platform", "market", "currency", "discovery_source", "discovery_page",
    "reported_review_count", "written_reviews_collected", "review_status", "qualification",
)


def upsert_discovery(queue: DataFrame, products: DataFrame, status: Column | None = None, error: Column | None = None) -> DataFrame:
    """The discovery queue with products put in: of the known fields those that a product has replace the queue's.

    Products come in unless they lack both a discovery source and an entry; links are unique on both sides.  ``status`` is the new
    state (discovered, checking, scraping, complete, rejected, retryable_error); without one the
    entry's stays, and a new one is ``discovered``.
    """
    names = [c for c in QUEUE if c in queue.columns or c in products.columns]
    new = products.where(F.coalesce(F.col("link"), F.lit("")) != "").select(
        "link", F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in names if c != "link" and c in products.columns], (F.lit(None).cast("string") if status is None else status).alias("__status"), (F.lit("") if error is None else F.coalesce(error, F.lit(""))).alias("__error"),
    )
    joined = queue.withColumn("__old", F.lit(True)).join(new, "link", "full_outer")
    if "discovery_source" in products.columns:
        joined = joined.where(F.col("__old") | (F.coalesce("__discovery_source", F.lit("")) != ""))
    else:
        joined = joined.where("__old")
    pick = lambda c: F.coalesce(*[F.col(x) for x in (f"__{c}", c) if x in joined.columns])
    return joined.select(
        "link", *[pick(c).alias(c) for c in names if c != "link"],
        F.coalesce("__status", *(["discovery_status"] if "discovery_status" in queue.columns else []), F.lit("discovered")).alias("discovery_status"),
        F.when(F.col("__new"), F.col("__error")).otherwise(F.col("last_error") if "last_error" in queue.columns else F.lit("")).alias("last_error"),
    )


def completed_pages(before: Column, now: Column) -> Column:
    """A checkpoint never goes back."""
    return F.greatest(F.coalesce(before, F.lit(0)), now)
