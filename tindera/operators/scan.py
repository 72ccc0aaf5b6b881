"""Running values along sorted rows, however many of them share a key.

A window over a key is one task, however large the key.  Here rows are dealt by ranges of key and order, so a large key lies in
many tasks.  A window runs within each (task, key), and what comes in from the tasks before is one row for each (task, key): sums and
maxima of whole tasks, and their last values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import free, written


class Ordered:
    """Rows dealt by ranges of (keys, order), with their task's number written beside them.

    ``order`` names columns; rows are told apart by them within a key.  Reading the table in other tasks changes nothing, as the number is a column.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str], tasks: int | None = None) -> None:
        self.keys, self.order = list(keys), list(order)
        self.task = free("task", rows.columns)
        by = [*self.keys, *self.order]
        ranged = rows.repartitionByRange(tasks, *by) if tasks else rows.repartitionByRange(*by)
        self.rows = written(ranged.withColumn(self.task, F.spark_partition_id()))

    def running(self, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> Ordered:
        """Adds, for each name, the sum or the maximum of an expression over a key's rows up to this one, or its value in the row before."""
        sums, maxima, lags = sums or {}, maxima or {}, lags or {}
        home = [self.task, *self.keys]
        own = Window.partitionBy(*home).orderBy(*self.order)
        upto = own.rowsBetween(Window.unboundedPreceding, 0)
        names = [*sums, *maxima, *lags]
        value = {n: free(f"{n}_own", self.rows.columns, names) for n in names}
        carry = {n: free(f"{n}_before", self.rows.columns, names) for n in names}
        first = free("first_row", self.rows.columns, names)
        rows = self.rows.withColumns({value[n]: c for n, c in (sums | maxima | lags).items()})
        ends = [F.sum(value[n]).alias(carry[n]) for n in sums] + [F.max(value[n]).alias(carry[n]) for n in maxima]
        ends += [F.max_by(F.struct(value[n]), F.struct(*self.order)).alias(carry[n]) for n in lags]
        before = Window.partitionBy(*self.keys).orderBy(self.task)
        earlier = before.rowsBetween(Window.unboundedPreceding, -1)
        come = {carry[n]: F.coalesce(F.sum(carry[n]).over(earlier), F.lit(0)) for n in sums} | {carry[n]: F.max(carry[n]).over(earlier) for n in maxima}
        come |= {carry[n]: F.lag(carry[n]).over(before) for n in lags}
        carried = rows.groupBy(*home).agg(*ends).withColumns(come)
        within = {n: F.sum(value[n]).over(upto) for n in sums} | {n: F.max(value[n]).over(upto) for n in maxima}
        within |= {n: F.lag(F.struct(value[n])).over(own) for n in lags} | {first: F.row_number().over(own) == 1}
        joined = rows.withColumns(within).join(carried, home)
        done = {n: F.col(n) + F.col(carry[n]) for n in sums} | {n: F.greatest(n, carry[n]) for n in maxima}
        done |= {n: F.when(F.col(first), F.col(carry[n])).otherwise(F.col(n))[value[n]] for n in lags}
        out = Ordered.__new__(Ordered)
        out.keys, out.order, out.task = self.keys, self.order, self.task
        out.rows = joined.withColumns(done).drop(first, *value.values(), *carry.values())
        return out

    def result(self) -> DataFrame:
        return self.rows.drop(self.task)


def changes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, tasks: int | None = None) -> DataFrame:
    """Adds ``number`` (a row's place in its key, from 1), ``changed`` (against the row before; null on the first) and ``unchanged_for`` (rows since the last change)."""
    seen = free("seen", rows.columns)
    ordered = Ordered(rows, keys, order, tasks).running(sums={"number": F.lit(1)}, lags={seen: value})
    ordered.rows = written(ordered.rows.withColumn("changed", F.when(F.col("number") > 1, ~value.eqNullSafe(F.col(seen)))).drop(seen))
    start = free("start", ordered.rows.columns)
    ordered = ordered.running(maxima={start: F.when(F.coalesce("changed", F.lit(True)), F.col("number"))})
    return ordered.result().withColumn("unchanged_for", F.col("number") - F.col(start)).drop(start)
