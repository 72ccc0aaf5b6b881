"""Best-fit packing of documents into sequences of a fixed length.

The plan is made from the histogram of piece lengths (at most ``capacity`` counts, on
the driver): best fit, longest first, places all pieces of a length at once, so the plan
is a list of segments, each a range of ranks within a length and the bins that take it.
Then each piece takes its planned slot by its rank within its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import bpe
from .arrowtext import batch, pack_planes, tidied, unpack_planes
from .shared import free, settle

CAPACITY = 1024
END_ID = 2
#: Counts by length and partition that are broadcast at most (16 bytes each).
BROADCAST_COUNTS = 2_000_000
_COLUMN = {"packed_ids": "ids"}


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of ``capacity``, the first may be shorter."""
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


def _pieces(path: str, capacity: int, end_id: int, payload: str):
    kind = {"ids": pa.list_(pa.int32()), "packed_ids": pa.binary(), "ids_crc32": pa.int64()}[payload]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), (_COLUMN.get(payload, payload), kind)])
    made = {"ids": lambda x: x.astype(np.int32), "packed_ids": lambda x: pack_planes(x.astype(np.uint32)), "ids_crc32": lambda x: zlib.crc32(x.tobytes())}[payload]

    def run(batches):
        tokenizer = bpe.pieces_of(path)
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, texts in bpe.text_chunks(b.column(1)):
                out = {k: [] for k in schema.names}
                for doc_id, tokens in zip(ids[lo:hi], tokenizer.encode(texts)):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for k, (s, n) in enumerate(cut_points(len(tokens), capacity)):
                        part = tokens[s : s + n]
                        values = (doc_id, k, s, n, made(part))
                        for name, v in zip(schema.names, values):
                            out[name].append(v)
                yield batch(out, schema)

    return run


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, payload: str = "ids", numbered: bool = False) -> DataFrame:
    """Cut every document's ids, with ``end_id`` at their end, into pieces of at most ``capacity``.

    Output: ``doc_id``, ``piece`` (from 0), ``start``, ``length`` and ``ids``: an array, or with
    ``payload="packed_ids"`` bytes, which go along at less cost and which ``pack`` opens; or, with
    ``payload="ids_crc32"``, their checksum as little-endian unsigned 32-bit numbers.
    A null or empty text is the piece of ``end_id`` alone; texts of any length are cut whole.
    With ``numbered`` each piece has the number of its ``task`` and its ``place`` among the task's pieces of its length, for ``pack``:
    the kernel that cuts texts numbers pieces too, in one Python worker a task.
    """
    kinds = {"ids": "array<int>", "packed_ids": "binary", "ids_crc32": "long"}
    if payload not in kinds:
        raise ValueError(f"unknown payload {payload!r}")
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = StructType.fromDDL(f"doc_id long, piece int, start long, length long, {_COLUMN.get(payload, payload)} {kinds[payload]}")
    kernels, names = [_pieces(tokenizer_path, capacity, end_id, payload)], schema.names
    if numbered:
        schema = schema.add("task", IntegerType()).add("place", LongType())
        kernels.append(_numbered(names, to_arrow_schema(schema), "task", "place"))
    return docs.mapInArrow(tidied(_chained(*kernels)), schema)


def _opened(names: list[str], schema: pa.Schema, column: str):
    def run(batches):
        for b in batches:
            own = [unpack_planes(x.as_py(), np.uint32) for x in b.column(b.schema.get_field_index("ids"))]
            if column == "ids_crc32":
                made = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64())
            else:
                first = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                made = pa.ListArray.from_arrays(pa.array(first), pa.array(np.concatenate([np.zeros(0, np.uint32), *own]).astype(np.int32)))
            yield batch({n: made if n == column else b.column(b.schema.get_field_index(n)) for n in names}, schema)

    return run


_KINDS = {"ids_crc32": LongType(), "ids": ArrayType(IntegerType())}


def _opened_schema(schema: StructType, column: str) -> StructType:
    return StructType([StructField(column, _KINDS[column]) if f.name == "ids" else f for f in schema])


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best fit over counts, longest first.

    Returns segments, in order of length and rank: length, first rank, ranks, first bin,
    pieces a bin, offset.  Rank r of a segment goes to bin ``first bin + r // pieces a bin``
    at ``offset + (r % pieces a bin) * length``.  The state is bins by space left, as runs
    of bins with equal filling; a length splits one run at most and adds two, so that the
    plan's size depends on ``capacity`` and not on the number of documents.
    """
    space: dict[int, list[tuple[int, int]]] = {}  # space left: runs (first bin, bins)
    out, bins = [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no piece of length {length} fits into {capacity}")
        left, rank = histogram[length], 0

        def fill(room: int, first: int, count: int) -> None:
            """Put what is left of this length into bins of a run, and file them by the space they then have."""
            nonlocal left, rank
            each = room // length
            used = min(count, -(-left // each))
            placed = min(left, used * each)
            out.append((length, rank, placed, first, each, capacity - room))
            full, odd = divmod(placed, each)
            for at, n, inside in ((first, full, each), (first + full, 1 if odd else 0, odd), (first + used, count - used, 0)):
                if n and room - inside * length:
                    space.setdefault(room - inside * length, []).append((at, n))
            rank += placed
            left -= placed

        for room in sorted(r for r in space if r >= length):
            runs = space.pop(room)
            while runs and left:
                fill(room, *runs.pop())
            if runs:
                space.setdefault(room, []).extend(runs)
            if not left:
                break
        if left:
            n = -(-left // (capacity // length))
            first, bins = bins, bins + n
            fill(capacity, first, n)
    return np.array(out, np.int64).reshape(-1, 6)


def _slots(segments, names: list[str], schema: pa.Schema, ranks: str):
    def run(batches):
        seg = segments.value
        key = (seg[:, 0] << 44) + seg[:, 1]
        order = np.argsort(key)
        key, seg_sorted = key[order], seg[order]
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index(ranks)).to_numpy()
            s = seg_sorted[np.searchsorted(key, (length << 44) + rank, "right") - 1]
            r = rank - s[:, 1]
            cols = {n: b.column(b.schema.get_field_index(n)) for n in names}
            yield batch(cols | {"sequence_id": s[:, 3] + r // s[:, 4], "offset": s[:, 5] + (r % s[:, 4]) * length}, schema)

    return run


def _numbered(names: list[str], schema: pa.Schema, parts: str, ranks: str):
    """Adds the number of the task and the rank within task and length.

    The kernel that makes a piece numbers it, and both numbers are written with the piece, so
    a later reader finds them however its tasks are cut.  A task that runs again has the same number and writes its rows anew as a whole.
    """

    def run(batches):
        counts: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for b in batches:
            lengths = b.column(b.schema.get_field_index("length"))
            if lengths.null_count:
                raise ValueError("a piece has no length")
            length = lengths.to_numpy()
            rank = np.empty(len(length), np.int64)
            for value in np.unique(length).tolist():
                at = np.flatnonzero(length == value)
                seen = counts.get(value, 0)
                rank[at] = seen + np.arange(len(at))
                counts[value] = seen + len(at)
            yield batch({n: b.column(b.schema.get_field_index(n)) for n in names} | {parts: np.full(len(length), part, np.int32), ranks: rank}, schema)

    return run


def _based(names: list[str], schema: pa.Schema, parts: str, ranks: str, sent):
    """Turns ranks within task and length into ranks within length, by the bases of all tasks."""

    def run(batches):
        key, bases = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            part, length, rank = (b.column(b.schema.get_field_index(n)).to_numpy() for n in (parts, "length", ranks))
            at = np.searchsorted(key, (part.astype(np.int64) << 32) + length)
            yield batch({n: b.column(b.schema.get_field_index(n)) for n in names} | {ranks: rank + bases[at]}, schema)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_as: str | None = None, broadcast_counts: int = BROADCAST_COUNTS, numbered: tuple[str, str] | None = None) -> DataFrame:
    """Give every piece a place in as few sequences as best fit can.

    Input: rows with a ``length`` of 1 to ``capacity`` (another one, or null, is an error);
    other columns go along, whatever their names.  Output: the same rows with ``sequence_id`` and ``offset``;
    within a sequence the offsets are gapless from 0.  Equal lengths are interchangeable, so
    which of them takes which slot is arbitrary, but no slot is given twice.  An empty table
    gives an empty result.  With ``open_as`` packed ``ids`` come out as arrays (``ids``) or as their checksum (``ids_crc32``), as
    little-endian unsigned 32-bit numbers.

    ``numbered`` names two columns in which the rows are numbered already, as ``tokenize_pieces(numbered=True)`` does; they don't
    come out.  Rows are numbered where they are made and written with their numbers, so it doesn't matter in which tasks they are read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset", *(numbered or ()))]
    part, rank = numbered or (free("__part", names), free("__rank", names))
    base = free("__base", [*names, part, rank])
    pieces = pieces.select(*[F.col(c).cast("long").alias(c) if c == "length" else F.col(c) for c in [*names, *(numbered or ())]])
    kept = StructType([f for f in pieces.schema if f.name in names])
    ranked = StructType(list(kept)).add(rank, LongType())
    done = StructType(list(kept)).add("sequence_id", LongType()).add("offset", LongType())
    if numbered is None:
        schema = StructType(list(kept)).add(part, IntegerType()).add(rank, LongType())
        pieces = pieces.mapInArrow(tidied(_numbered(names, to_arrow_schema(schema), part, rank)), schema)
    written = settle(pieces, "pieces")
    counts = settle(written.groupBy("length", part).agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).limit(capacity + 2).collect()}
    segments = spark.sparkContext.broadcast(plan(histogram, capacity))
    steps = [_slots(segments, names, to_arrow_schema(done), rank)]
    if open_as is not None:
        done = _opened_schema(done, open_as)
        steps.append(_opened(done.names, to_arrow_schema(done), open_as))
    # A count for each length and task: few enough to be sent to all, or dealt with the pieces.
    if counts.count() <= broadcast_counts:
        found = bases.toArrow()
        key = (found[part].to_numpy().astype(np.int64) << 32) + found["length"].to_numpy()
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast((key[order], found[base].to_numpy()[order]))
        return written.mapInArrow(tidied(_chained(_based(names, to_arrow_schema(ranked), part, rank, sent), *steps)), done)
    placed = written.join(bases, ["length", part])
    return placed.withColumn(rank, F.col(rank) + F.col(base)).select(*names, rank).mapInArrow(tidied(_chained(*steps)), done)


def _chained(*kernels):
    """Kernels one after the other in one Python worker."""

    def run(batches):
        for kernel in kernels:
            batches = kernel(batches)
        yield from batches

    return run

