"""Reviews as rows: flattening, keys, duplicates, order, and back into products.

Product frames have ``link`` and ``comments``; review frames have ``link``, ``pos`` (the place in the
original array, from 0) and the review's fields.  A group of duplicates is found by
aggregating its first place and joining that back, so a text that very many reviews share is no
hot spot: partial aggregates come first and the join can be split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import star_number
from ..scratch import free
from . import scan

TEXT_FIELDS = ("content", "comment", "review", "text")


def explode_reviews(products: DataFrame, keep: Sequence[str] = ("link",)) -> DataFrame:
    """One row per review that is not null, with its place in the array."""
    rows = products.select(*keep, F.posexplode("comments").alias("pos", "review"))
    return rows.where(F.col("review").isNotNull()).select(*keep, "pos", "review.*")


def review_text(columns: Sequence[str], preferred: str | None = None) -> Column:
    """The first of the known text columns that exists, even if it is empty; a preferred one comes first."""
    for name in ((preferred,) if preferred else ()) + TEXT_FIELDS:
        if name in columns:
            return F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.lit("")


def mark_duplicates(reviews: DataFrame, key: Column, group: Sequence[str] = ("link",), place: str = "pos", name: str = "fingerprint") -> DataFrame:
    """Adds the key as ``name``, ``is_duplicate`` and ``duplicate_of`` (the first place of an equal key in the group).

    ``key`` is null where there is no text (``text.fingerprint_key``): that never is a duplicate.  Without ``group`` the
    whole table is one.  Only keys that occur at two places are joined back, so the other
    side of the join is the duplicates' first places alone.
    """
    first, last = free("first_place", reviews.columns, [name]), free("last_place", reviews.columns, [name])
    keys = [*group, name]
    rows = reviews.withColumn(name, key)
    places = rows.select(*keys, place).where(F.col(name).isNotNull()).groupBy(*keys).agg(F.min(place).alias(first), F.max(place).alias(last))
    joined = rows.join(places.where(F.col(last) > F.col(first)).drop(last), keys, "left")
    late = F.col(place) > F.col(first)
    return joined.withColumn("is_duplicate", F.coalesce(late, F.lit(False))).withColumn("duplicate_of", F.when(late, F.col(first))).drop(first)


def identity(comment_id: Column, author: Column, time: Column, content: Column, rating: Column) -> Column:
    """What makes a review itself: its id, else author, time, content and rating."""
    rest = F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in (author, time, content, rating)]))
    return F.coalesce(F.concat(F.lit("#"), F.nullif(comment_id.cast("string"), F.lit(""))), rest)


def first_of(rows: DataFrame, keys: Sequence[str], place: str = "pos") -> DataFrame:
    """The first row of each key (by ``place``, which is unique within it)."""
    firsts = rows.groupBy(*keys).agg(F.min(place).alias(place))
    return rows.join(firsts, [*keys, place])


def last_of(rows: DataFrame, key: str, place: str = "ordinal") -> DataFrame:
    """The last row of each key, at the place of its first."""
    ends = rows.groupBy(key).agg(F.min(place).alias("__first"), F.max(place).alias(place))
    return rows.join(ends, [key, place]).withColumn(place, F.col("__first")).drop("__first")


def order_low_to_high(comments: Column, recorded: str | None = None) -> Column:
    """An array of reviews by star, those without one last; stable.  ``recorded`` names a field that says under which star one was collected, which counts first."""

    def star(r):
        own = F.when(F.coalesce(r["rating"], F.lit(0)) != 0, F.concat(r["rating"].cast("int").cast("string"), F.lit("_star")))
        return star_number(own if recorded is None else F.coalesce(F.nullif(r[recorded].cast("string"), F.lit("")), own))

    keyed = F.transform(comments, lambda r, i: F.struct(star(r).alias("star"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: x["r"])


def star_limits(detailed: Column) -> Column:
    """Stars with a count, low to high, as (star, count) structs."""
    kept = F.map_filter(detailed, lambda k, v: k.rlike("^[1-5]_star$") & (v > 0))
    return F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct(F.left(e["key"], F.lit(1)).cast("int").alias("star"), e["value"].alias("count"))))


def star_total(detailed: Column) -> Column:
    kept = F.map_filter(detailed, lambda k, v: k.endswith("_star"))
    return F.aggregate(F.map_values(kept), F.lit(0).cast("long"), lambda s, v: s + v)


def belongs_to_filter(source_filter: Column, rating: Column, wanted: Column) -> Column:
    """Was a review collected under a star filter: by the very filter that was recorded (``3_star`` or 3), else by its rating."""
    shown, star = F.nullif(source_filter.cast("string"), F.lit("")), wanted.cast("int").cast("string")
    own = F.coalesce(rating.try_cast("double").cast("int"), F.lit(0)) == wanted
    return F.when(shown.isNotNull(), (shown == star) | (shown == F.concat(star, F.lit("_star")))).otherwise(own)


def all_of_star(ratings: Column, star: Column) -> Column:
    """Every rating that isn't 0 is the star, and there is one."""
    real = F.filter(ratings, lambda r: F.coalesce(r, F.lit(0)) != 0)
    return (F.size(real) > 0) & F.forall(real, lambda r: r == star)


def written(content: Column, include_empty: bool = False) -> Column:
    return F.lit(True) if include_empty else F.coalesce(F.trim(content) != "", F.lit(False))


def overlay(existing: DataFrame, collected: DataFrame, wanted: Column, keys: Sequence[str]) -> DataFrame:
    """Existing rows outside a star filter, then the collected ones, without repeats by ``keys``."""
    kept = existing.where(~belongs_to_filter(F.col("source_rating_filter"), F.col("rating"), wanted)).withColumn("__part", F.lit(0))
    rows = kept.unionByName(collected.withColumn("__part", F.lit(1)))
    rows = rows.withColumn("__place", F.struct("__part", "pos"))
    return first_of(rows, keys, "__place").drop("__part", "__place")


def flatten_unlabelled(products: DataFrame, label: str = "label", text: str = "content") -> DataFrame:
    """Non-empty reviews without a label, numbered over all products: ``global_index``, ``outer_idx``, ``comment_idx``, ``text``.

    ``products`` has ``ordinal`` and ``comments``.  Numbers come from sizes summed per product, so no task sorts all rows.
    """
    rows = products.select(F.col("ordinal").alias("outer_idx"), F.posexplode("comments").alias("comment_idx", "r"))
    rows = rows.select("outer_idx", "comment_idx", F.trim(F.col(f"r.{text}")).alias("text"), F.col(f"r.{label}").alias("label"))
    rows = rows.where((F.col("text") != "") & T.is_unlabelled(F.col("label"))).drop("label")
    return running_index(rows, "outer_idx", "comment_idx")


def running_index(rows: DataFrame, outer: str, inner: str, name: str = "global_index") -> DataFrame:
    """A number from 0 over (outer, inner); rows are dealt by ranges of both, so an outer group of any size lies in many tasks."""
    return scan.Ordered(rows, [], [outer, inner]).running(sums={name: F.lit(1)}).result().withColumn(name, F.col(name) - 1)


def missing_places(wanted: Column, given: Column) -> Column:
    """The indices of a batch that got no label, in order."""
    return F.array_sort(F.array_except(wanted, given))


def restore_labels(products: DataFrame, labelled: DataFrame, label: str = "label") -> DataFrame:
    """Labels (outer_idx, comment_idx, label) put back into the products' reviews."""
    maps = labelled.groupBy("outer_idx").agg(F.map_from_entries(F.collect_list(F.struct("comment_idx", label))).alias("__labels"))
    joined = products.join(maps, products["ordinal"] == maps["outer_idx"], "left").drop("outer_idx")
    new = F.transform("comments", lambda r, i: r.withField(label, F.coalesce(F.try_element_at("__labels", i), r[label])))
    return joined.withColumn("comments", F.when(F.col("__labels").isNull(), F.col("comments")).otherwise(new)).drop("__labels")


def attach(products: DataFrame, reviews: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Review rows back into their products' arrays, in order of place; and summaries beside them."""
    fields = [c for c in reviews.columns if c not in ("link", "pos")]
    arrays = reviews.groupBy("link").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("r")))).alias("__rows"))
    out = products.drop("comments").join(arrays.select("link", F.transform("__rows", lambda x: x["r"]).alias("comments")), "link", "left")
    out = out.withColumn("comments", F.coalesce("comments", F.array()))
    return out if summaries is None else out.join(summaries, "link", "left")
