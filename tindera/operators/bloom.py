"""Bloom filters as arrays of longs: made by aggregates, asked by built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and places that a key sets: about one key in a hundred is taken for one that is there.
BITS, HASHES = 10, 6
#: Longs in a filter at most (1 MB).
MOST_WORDS = 131_072


def words_for(keys: int, bits: int = BITS, most: int = MOST_WORDS) -> int:
    """Longs that a filter of so many keys needs; a filter at the bound lets more keys through and is still right."""
    return max(1, min(most, -(-keys * bits // 64)))


def _places(key: Column, words: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), words.cast("long") * 64) for k in range(HASHES)]


def build(rows: DataFrame, key: str, words: int, by: Sequence[str] = (), name: str = "filter") -> DataFrame:
    """A filter of the keys for each group of ``by``, or of all rows.

    Bits meet in partial aggregates, so no more than ``words`` rows a group and task are shuffled.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__p") % 64).cast("int"))
    bits = rows.select(*by, F.explode(F.array(*_places(F.col(key), F.lit(words)))).alias("__p")).select(*by, F.shiftright("__p", 6).cast("int").alias("__w"), bit.alias("__b"))
    empty = F.explode(F.sequence(F.lit(0), F.lit(words - 1))).alias("__w")
    none = rows.select(*by).distinct().select(*by, empty) if by else rows.sparkSession.range(words).select(F.col("id").cast("int").alias("__w"))
    full = bits.unionByName(none.withColumn("__b", F.lit(0).cast("long"))).groupBy(*by, "__w").agg(F.bit_or("__b").alias("__b"))
    return full.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__w", "__b"))), lambda x: x["__b"]).alias(name))


def might_contain(filter_: Column, key: Column, words: int | None = None) -> Column:
    """False only for a key that is not there.  ``words`` is the filter's length, if it is known beforehand."""
    found = F.lit(True)
    for place in _places(key, F.size(filter_) if words is None else F.lit(words)):
        found = found & (F.call_function("getbit", F.get(filter_, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1)
    return found


def within(rows: DataFrame, key: str, among: DataFrame, count: int | None = None) -> DataFrame:
    """Rows whose key may be in ``among``, by a filter of its keys that is a scalar subquery of the scan: no rows are shuffled for it.

    A key that is in ``among`` is never lost; a few others stay.  ``count`` bounds the number of keys, if it is known.
    """
    words = words_for(among.count() if count is None else count)
    return rows.where(might_contain(build(among.select(key), key, words).scalar(), F.col(key), words))
