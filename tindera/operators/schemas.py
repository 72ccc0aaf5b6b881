"""Schemas of products, reviews and their summaries."""

from __future__ import annotations

REVIEW = (
    "comment_id string, author string, rating int, time string, content string, variation string, seller_respond string, "
    "like_count long, source_rating_filter string"
)
PRODUCT = (
    "link string, name string, price string, rating string, total_rating long, sold_count long, img string, shipping string, location string, "
    "category string, description string, brand string, seller string, goods_id string, platform string, market string, currency string, "
    "detailed_rating map<string,long>, review_status string, reported_review_count long, written_reviews_collected long, "
    "review_checkpoint struct<context:string,completed_pages:long,collected_reviews:long,stop_reason:string,updated_at:string>, "
    "qualification struct<status:string,rating:double,reported_review_count:long,min_rating:double,min_reviews:long,reasons:array<string>,checked_at:string>, "
    f"discovery_source string, discovery_page int, discovery_status string, last_error string, comments array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split() for x in REVIEW.split(', ')))}>>"
)
SUMMARY = (
    "review_count long, sentiment_counts struct<positive:long,neutral:long,negative:long>, sentiment_ratios struct<positive:double,neutral:double,negative:double>, "
    "average_compound double, risk_review_count long, keyword_failure_rate double, risk_score double, risk_categories map<string,long>, duplicate_review_count long"
)
