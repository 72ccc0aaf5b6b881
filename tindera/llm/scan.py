"""Running fingerprints and sums along sorted rows, however many of them share a key.

Rows are range-sorted by key and order, so one key may lie in many tasks.  Each task scans its own rows; of the rest only
one carry a task is needed: the state with which its first key comes in from the tasks before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .arrowtext import batch, tidied
from .shared import free, settle

_WRAP = (1 << 64) - 1


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**64."""
    out, square, left = np.ones(len(exponents), np.uint64), base & _WRAP, exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * np.uint64(square), out)
        square = square * square & _WRAP
        left = left >> 1
    return out


def _rolled(values: np.ndarray, begins: np.ndarray, base: int) -> np.ndarray:
    """For each row the sum of value * base ** (rows since), from its segment's first row on, modulo 2**64."""
    n = len(values)
    at = np.arange(n)
    up = power(base, at)
    total = np.cumsum(values * power(pow(base, -1, 1 << 64), at))
    before = np.where(begins > 0, total[begins - 1], np.uint64(0))
    return (total - before) * up


def _local(key: str, values: dict[str, tuple[str, int]], part: str, pos: str, schema: pa.Schema):
    def run(batches):
        task, last, count, carry = TaskContext.get().partitionId(), None, 0, dict.fromkeys(values, np.uint64(0))
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index(key)).to_numpy()
            fresh = np.append(True, keys[1:] != keys[:-1])
            begins = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
            rank = np.arange(len(keys)) - begins + 1
            ongoing = (begins == 0) & (keys == last)
            own = dict(zip(b.schema.names, b.columns))
            for name, (value, base) in values.items():
                rolled = _rolled(own[value].to_numpy().astype(np.int64).view(np.uint64), begins, base)
                if ongoing[0]:
                    rolled = np.where(ongoing, rolled + carry[name] * power(base, rank), rolled)
                carry[name] = rolled[-1]
                own[name] = rolled.view(np.int64)
            rank = np.where(ongoing, rank + count, rank)
            last, count = keys[-1], int(rank[-1])
            yield batch({n: own.get(n) for n in schema.names if n not in (part, pos)} | {part: np.full(len(keys), task, np.int32), pos: rank}, schema)

    return run


def _carried(key: str, values: dict[str, tuple[str, int]], part: str, pos: str, schema: pa.Schema, sent):
    def run(batches):
        parts, keys, counts, states = sent.value
        for b in batches:
            own = dict(zip(b.schema.names, b.columns))
            task, rank = own[part].to_numpy(), own[pos].to_numpy()
            at = np.minimum(np.searchsorted(parts, task), max(len(parts) - 1, 0))
            if len(parts) and len(task):
                on = (parts[at] == task) & (keys[at] == own[key].to_numpy())
                if on.any():
                    for name, (_, base) in values.items():
                        rolled = own[name].to_numpy().view(np.uint64)
                        own[name] = np.where(on, rolled + states[name][at] * power(base, np.where(on, rank, 0)), rolled).view(np.int64)
                    own[pos] = np.where(on, rank + counts[at], rank)
            yield batch({n: own[n] for n in schema.names}, schema)

    return run


def prefix_scan(rows: DataFrame, key: str, order: list, values: dict[str, tuple[str, int]], pos: str = "pos") -> DataFrame:
    """Adds each row's place among its key's rows (from 1), and for every ``name: (column, base)`` the rolling value up to the row.

    The rolling value is the sum of ``column * base ** (rows since)`` modulo 2**64: a running sum for base 1, a
    polynomial fingerprint for another odd base.  ``key`` is a long and never null; ``column`` has no nulls.  Rows that tie in ``order``
    come in any order.  ``rows`` should be a written table: it is read twice, for the ranges and for the rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, part = rows.sparkSession, free("__part", rows.columns)
    kept = StructType(list(rows.schema))
    for name in values:
        kept = kept.add(name, LongType())
    scanned = StructType(list(kept)).add(part, IntegerType()).add(pos, LongType())
    done = StructType(list(kept)).add(pos, LongType())
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    local = settle(ranged.mapInArrow(tidied(_local(key, values, part, pos, to_arrow_schema(scanned))), scanned), "scan")
    # Only a task's first and last key can lie in other tasks too; two rows a task at most come to the driver.
    edges = local.groupBy(part).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias(key))
    shared = edges.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    ends = local.join(F.broadcast(shared), key).groupBy(key, part).agg(F.max(F.struct(pos, *values)).alias("end")).select(key, part, "end.*").orderBy(key, part).collect()
    found, before = [], None
    for r in ends:
        state = (before[1], before[2]) if before and before[0] == r[key] else (0, dict.fromkeys(values, 0))
        if state[0]:
            found.append((r[part], r[key], *state))
        n = r[pos]
        rolled = {name: (r[name] + state[1][name] * pow(base, n, 1 << 64)) & _WRAP for name, (_, base) in values.items()}
        before = (r[key], state[0] + n, rolled)
    found.sort()
    columns = [np.array([f[k] for f in found], t) for k, t in ((0, np.int32), (1, np.int64), (2, np.int64))]
    sent = spark.sparkContext.broadcast((*columns, {name: np.array([f[3][name] for f in found], np.uint64) for name in values}))
    return local.mapInArrow(tidied(_carried(key, values, part, pos, to_arrow_schema(done), sent)), done)
