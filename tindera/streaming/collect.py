"""Page-by-page collection of reviews, as a batch fold and as a stream.

Pages come in order.  Reviews that are known by identity are skipped, new ones are kept until a
product's target; every page updates the product's checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bloom, scan
from ..operators.reviews import first_of
from ..scratch import free

STATE = "collections string"
UPDATES = "product string, page long, new_reviews long, collected long, stop_reason string"


def collect(stored: DataFrame, pages: DataFrame, target: int) -> DataFrame:
    """Stored reviews, then those of the pages, first of each ``identity`` per ``product``, ``target`` at most.

    Both have ``product``, ``identity``, ``page`` and ``pos``; stored ones come before all pages.
    The limit is a feature: collection stops at the target.
    """
    rows = stored.withColumn("__part", F.lit(0)).unionByName(pages.withColumn("__part", F.lit(1))).withColumn("__place", F.struct("__part", "page", "pos"))
    unique = first_of(rows, ["product", "identity"], "__place")
    rank = F.row_number().over(Window.partitionBy("product").orderBy("__place"))
    return unique.withColumn("rank", rank).where(F.col("rank") <= target).drop("__part", "__place")


def signature(ids: Column, first: int | None = 2, last: int | None = None) -> Column:
    """What tells a page from another: its first (or last) review ids."""
    return F.array_join(F.slice(ids, 1, first) if last is None else F.slice(ids, -F.least(F.lit(last), F.size(ids)), last), "|")


def page_changes(pages: DataFrame, sign: Column) -> DataFrame:
    """Adds ``signature`` and ``changed``: does it differ from that of the page before (null on the first, and beside a missing one)?"""
    before = free("before", pages.columns, ["signature"])
    ordered = scan.Ordered(pages.withColumn("signature", sign), ["product"], ["page"]).running(lags={before: F.col("signature")})
    return ordered.result().withColumn("changed", F.col("signature") != F.col(before)).drop(before)


def stop_after_unchanged(counts: DataFrame, rounds: int) -> DataFrame:
    """The first round at which a product's count hasn't changed for ``rounds`` rounds; null if it never happens.

    ``counts``: ``product``, ``round``, ``n``.  A product of any number of rounds lies in many tasks.
    """
    runs = scan.changes(counts.select("product", "round", "n"), ["product"], ["round"], F.col("n"))
    return runs.groupBy("product").agg(F.min(F.when(F.col("unchanged_for") >= rounds, F.col("round"))).alias("stop_round"))


def checkpoints(pages: DataFrame, every: int) -> DataFrame:
    """Pages after which a checkpoint is written: every so many of a product, and its last."""
    ends = pages.groupBy("product").agg(F.max("page").alias("last"))
    return pages.join(ends, "product").where((F.col("page") % every == 0) | (F.col("page") == F.col("last"))).drop("last")


def page_complete(found: Column, taken: Column, capped: Column) -> Column:
    """A discovery page is complete only if the product cap didn't cut it."""
    return ~capped & (taken >= found)


def resume(stored: DataFrame, is_incomplete: Column) -> tuple[DataFrame, DataFrame]:
    """Stored products to go on with, and those that are done."""
    flag = F.coalesce(is_incomplete, F.lit(False))
    return stored.where(flag), stored.where(~flag)


def new_only(found: DataFrame, stored: DataFrame, key: str = "link", keys: int | None = None) -> DataFrame:
    """Products that aren't stored yet, each once, in order of discovery.

    A Bloom filter of the found keys thins the store before its shuffle; the join that follows is exact.  ``keys`` bounds the number of found
    keys, if it is known.
    """
    once = first_of(found, [key], "ordinal")
    return once.join(bloom.within(stored.select(key), key, found, keys).distinct(), key, "left_anti")


def collect_stream(pages: DataFrame, target: int, remembered: int = 100_000, buckets: int = 1024) -> DataFrame:
    """The same fold on a stream of review rows (``product``, ``page``, ``identity``): a row per product and batch.

    Products share their state by ``buckets`` of a hash, so that a batch calls Python once a bucket and not once a product; a checkpoint stays with its
    number of buckets.  State per product is its identities until it ends, ``remembered`` at most: beyond, the product is an error rather than wrong.
    """
    bucket = free("bucket", pages.columns)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        found = {name: (page, collected, stop, set(seen)) for name, page, collected, stop, seen in (json.loads(state.get[0]) if state.exists else ())}
        begun: dict[str, int] = {}
        for frame in frames:
            rows = frame.sort_values(["page", "pos"])
            for product, identity, at in zip(rows["product"].tolist(), rows["identity"].tolist(), rows["page"].tolist()):
                page, collected, stop, known = found.get(product) or (0, 0, None, set())
                begun.setdefault(product, collected)
                if stop is None and identity not in known:
                    known.add(identity)
                    if len(known) > remembered:
                        raise ValueError(f"{product} has more than {remembered} reviews to remember")
                    collected += 1
                    stop = "target_reached" if collected >= target else None
                found[product] = (max(page, int(at)), collected, stop, known)
        # What has ended looks at no identity any more.
        state.update((json.dumps([(name, page, collected, stop, sorted(known, key=str) if stop is None else []) for name, (page, collected, stop, known) in found.items()]),))
        updates = [(product, found[product][0], found[product][1] - before, *found[product][1:3]) for product, before in begun.items()]
        yield pd.DataFrame(updates, columns=["product", "page", "new_reviews", "collected", "stop_reason"])

    keyed = pages.withColumn(bucket, F.pmod(F.xxhash64("product"), F.lit(buckets)))
    return keyed.groupBy(bucket).applyInPandasWithState(fold, UPDATES, STATE, "update", "NoTimeout")


def dedupe_stream(reviews: DataFrame, late: str = "1 day") -> DataFrame:
    """Reviews of a stream with event time ``ts``, each identity once within the watermark (an extension)."""
    return reviews.withWatermark("ts", late).dropDuplicatesWithinWatermark(["product", "identity"])
