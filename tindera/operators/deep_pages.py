"""Any page of sorted rows without sorting them all.

Counts by ranges of the first sort column show in which range the page begins and ends; only rows of these ranges are sorted.
A range that is one value is told apart by the next column, in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are sorted for a page at most, unless they are equal in all sort columns; and ranges that a column is cut into.
SORTED, RANGES = 100_000, 256


@dataclass(frozen=True)
class By:
    """A sort column, numeric or text; nulls come last in either direction."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return F.col(self.column).desc_nulls_last() if self.descending else F.col(self.column).asc_nulls_last()


def _edges(rows: DataFrame, by: By, ranges: int) -> list:
    """Values that cut the rows into about even ranges, in sort order; a sketch, which decides nothing but the ranges' sizes."""
    kind = dict(rows.dtypes)[by.column]
    c = F.col(by.column)
    if kind == "string":
        # Text has no percentiles: the least texts of even classes of a digest are a sample of places.
        found = rows.where(c.isNotNull()).groupBy(F.pmod(F.xxhash64(c), F.lit(ranges)).alias("k")).agg(F.min_by(c, F.xxhash64(c, F.lit(1))).alias("v"))
        values = {r.v for r in found.collect()}
    else:
        shares = [k / ranges for k in range(1, ranges)]
        values = {v for v in rows.agg(F.percentile_approx(c, shares, F.lit(10 * ranges)).alias("v")).first().v or [] if v is not None}
    return sorted(values, reverse=by.descending)


def _range_of(by: By, edges: list) -> Column:
    """A row's range: how many edges come before its value; each edge is a range of its own (odd), null is the last.

    Edges are looked up by halves, a batch of rows at a time, so that a row costs little however many they are.
    """
    c, last = F.col(by.column), 2 * len(edges) + 1
    if not edges:
        return F.when(c.isNull(), 1).otherwise(0)
    rising = sorted(edges)
    listed = np.array(rising, dtype=object if isinstance(rising[0], str) else None)

    def places(values: pd.Series) -> pd.Series:
        given = values.to_numpy(dtype=listed.dtype if listed.dtype == object else None)
        spot = np.searchsorted(listed, given, "left") + np.searchsorted(listed, given, "right")
        return pd.Series((last - 1 - spot if by.descending else spot).astype("int32"))

    return F.when(c.isNull(), last).otherwise(F.pandas_udf(places, "int")(F.coalesce(c, F.lit(rising[0]))))


def _in_range(by: By, edges: list, k: int) -> Column:
    """The same as ``_range_of`` being ``k``, as a plain condition that a scan can use to leave files out."""
    c = F.col(by.column)
    if k == 2 * len(edges) + 1 or not edges:
        return c.isNull() if k else c.isNotNull()
    if k % 2:
        return c == F.lit(edges[k // 2])
    after, before = edges[k // 2 - 1] if k else None, edges[k // 2] if k // 2 < len(edges) else None
    found = c.isNotNull()
    if after is not None:
        found &= (c < F.lit(after)) if by.descending else (c > F.lit(after))
    if before is not None:
        found &= (c > F.lit(before)) if by.descending else (c < F.lit(before))
    return found


def _stretch(rows: DataFrame, order: list[By], left: list[By], skip: int, take: int, n: int, most: int, ranges: int) -> list[DataFrame]:
    """Rows ``skip`` to ``skip + take`` of ``n`` sorted ones, of which all columns of ``order`` but ``left`` are equal, in parts.

    A range of one value goes on with the next column, one of several values with the same column in finer ranges.
    """
    if n > most and left:
        edges = _edges(rows, left[0], ranges)
        spot = _range_of(left[0], edges)
        counts = {r.k: r.n for r in rows.groupBy(spot.alias("k")).agg(F.count("*").alias("n")).collect()}
        if len(counts) > 1 or next(iter(counts)) % 2:
            parts, before = [], 0
            for k in sorted(counts):
                first, end = max(skip - before, 0), min(skip + take - before, counts[k])
                if first < end:
                    parts += _stretch(rows.where(_in_range(left[0], edges, k)), order, left[1:] if k % 2 else left, first, end - first, counts[k], most, ranges)
                before += counts[k]
            return parts
    return [rows.orderBy(*[b.order() for b in order]).offset(skip).limit(take)]


def deep_page(rows: DataFrame, order: list[By], number: int, size: int, most: int = SORTED, ranges: int = RANGES) -> DataFrame:
    """Page ``number`` (from 0, clamped to those there are), with ``page`` and ``pages``.

    The last sort column should tell all rows apart, else rows that tie may come in any order.
    """
    n = rows.count()
    pages = max(1, -(-n // size))
    number = min(max(number, 0), pages - 1)
    parts = _stretch(rows, order, order, number * size, min(size, n - number * size), n, most, ranges)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(parts) > 1:
        found = found.orderBy(*[b.order() for b in order]).limit(size)
    return found.withColumns({"page": F.lit(number), "pages": F.lit(pages)})
