"""Stupid-backoff language model scores from n-gram count tables of the corpus itself.

Documents are taken in blocks of bounded size.  A block holds a table of its distinct
n-grams with counts; its rows are exchanged, in compact sorted runs, with count tables
partitioned by ranges of the n-gram's hash, which add them up over all blocks and answer
each run with the corpus counts of its rows.  The block joins them to the n-grams of its
documents and sums scores per document.  So an n-gram crosses the network once per block
and not once per document, and one that every document has is no hot spot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import NOT_SPACE, Words, batch, ngrams, pack_planes, slices, tidied, unpack_planes, utf8
from .shared import settle

ORDER = 3
ALPHA = 0.4
#: What counts for a word that no other document has.
UNSEEN = 0.5
#: Bytes of text in a block, about, and characters behind a partition of the count tables.
BLOCK_BYTES, TABLE_CHARS = 6_000_000, 8_000_000

_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("texts", pa.binary())])
_REQUEST = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("size", pa.int32()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("size", pa.int32()), ("n", pa.int32()), ("totals", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backoff", pa.int64()), ("log_score", pa.float64())])


def _squeezed(values: np.ndarray) -> bytes:
    return pa.compress(pack_planes(values), "zstd", asbytes=True)


def _opened(data: bytes, n: int, dtype) -> np.ndarray:
    return unpack_planes(pa.decompress(data, n * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype)


def _grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes within rows, and how many each row has."""
    counts = np.maximum(np.diff(words.first) - (size - 1), 0)
    every = ngrams(words.hashes, size) if size > 1 else words.hashes
    at = np.repeat(words.first[:-1], counts) + (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts))
    return every[at], counts


def _blocks(block_bytes: int):
    """Documents in the order they come, compressed."""

    def run(batches):
        name, ids, sizes, texts, n = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row():
            flat = np.concatenate(sizes)
            return batch({"block": [name], "ids": [ids], "sizes": [pack_planes(flat.astype(np.uint64))], "texts": [pa.Codec("zstd", compression_level=6).compress(b"".join(texts), asbytes=True)]}, _BLOCK)

        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in slices(offsets):
                ids += b.column(0)[lo:hi].to_pylist()
                sizes.append(np.diff(offsets[lo : hi + 1]))
                texts.append(data[offsets[lo] : offsets[hi]].tobytes())
                n += len(texts[-1])
                if n >= block_bytes:
                    yield row()
                    name, ids, sizes, texts, n = name + 1, [], [], [], 0
        if ids:
            yield row()

    return run


def _hashed(sizes: bytes, texts: bytes, order: int):
    """Per order, the hashes of all n-grams of a block's documents in order, and how many each document has."""
    sizes = unpack_planes(sizes, np.uint64).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(pa.decompress(texts, int(offsets[-1]), "zstd", asbytes=True), np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    parts = [[] for _ in range(order)]
    for lo, hi in slices(offsets):
        words = Words(data, offsets[lo : hi + 1], NOT_SPACE)
        for size in range(1, order + 1):
            parts[size - 1].append(_grams(words, size))
    return [(np.concatenate([g for g, _ in p] or [np.zeros(0, np.uint64)]), np.concatenate([n for _, n in p] or [np.zeros(0, np.int64)])) for p in parts]


def _requests(order: int, parts: int):
    """A block's distinct n-grams with counts, in a row for each table that has any of them."""
    limits = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)

    def run(batches):
        for b in batches:
            for block, sizes, texts in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                for size, (hashes, _) in enumerate(_hashed(sizes.as_py(), texts.as_py(), order), 1):
                    distinct, counts = np.unique(hashes, return_counts=True)
                    bound = np.concatenate([[0], np.searchsorted(distinct, limits), [len(distinct)]])
                    out = {k: [] for k in _REQUEST.names}
                    for part in range(parts):
                        own = distinct[bound[part] : bound[part + 1]]
                        if len(own):
                            row = (part, block, size, len(own), _squeezed(np.diff(own, prepend=np.uint64(0))), _squeezed(counts[bound[part] : bound[part + 1]].astype(np.uint32)))
                            for k, v in zip(_REQUEST.names, row):
                                out[k].append(v)
                    yield batch(out, _REQUEST)

    return run


def _totals(table: pa.Table) -> pa.Table:
    """A partition of the count tables: adds up all buckets' rows and answers each block in its order."""
    out = {k: [] for k in _ANSWER.names}
    sizes = table.column("size").to_pylist()
    for size in sorted(set(sizes)):
        rows = [i for i, s in enumerate(sizes) if s == size]
        n = {i: table.column("n")[i].as_py() for i in rows}
        grams = [np.cumsum(_opened(table.column("grams")[i].as_py(), n[i], np.uint64), dtype=np.uint64) for i in rows]
        counts = [_opened(table.column("counts")[i].as_py(), n[i], np.uint32) for i in rows]
        distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.uint64)
        answer = total[inverse]
        ends = np.cumsum([len(g) for g in grams])
        for i, lo, hi in zip(rows, ends - [len(g) for g in grams], ends):
            row = (table.column("block")[i].as_py(), table.column("part")[i].as_py(), size, n[i], _squeezed(answer[lo:hi]))
            for k, v in zip(_ANSWER.names, row):
                out[k].append(v)
    return pa.table(out, _ANSWER)


def _own(index: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each n-gram of each row, how often that row has it."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((index, row))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(index[order]) != 0) | (np.diff(row[order]) != 0)
    group = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(group)[group] if len(order) else out
    return out


def _scores(order: int, alpha: float, leave_one_out: bool, total_words: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _hashed(table.column("sizes")[0].as_py(), table.column("texts")[0].as_py(), order)
        answers = answers.sort_by([("size", "ascending"), ("part", "ascending")])
        sizes = np.array(answers.column("size").to_pylist(), np.int64)
        left = []
        for size, (hashes, counts) in enumerate(grams, 1):
            rows = np.flatnonzero(sizes == size)
            corpus = np.concatenate([np.zeros(0, np.uint64), *[_opened(answers.column("totals")[int(i)].as_py(), answers.column("n")[int(i)].as_py(), np.uint64) for i in rows]]).astype(np.int64)
            distinct, index = np.unique(hashes, return_inverse=True)
            if len(distinct) != len(corpus):
                raise RuntimeError("the documents changed between two readings: score(..., stable=False) writes them first")
            left.append((corpus[index] if len(index) else corpus) - (_own(index, counts) if leave_one_out else 0))
        words = grams[0][1]
        n = int(words.sum())
        rest = np.maximum(total_words - words * leave_one_out, 1)
        # From the shortest n-gram up: a longer one that other documents have replaces the backed-off score.
        single = np.maximum(left[0].astype(np.float64), UNSEEN) / np.repeat(rest, words)
        score, backoff = np.log(single), np.zeros(n, np.int64)
        place = np.arange(n) - np.repeat(np.cumsum(words) - words, words)
        for size in range(2, order + 1):
            at = np.flatnonzero(place >= size - 1)  # the last word of each n-gram
            seen = left[size - 1] > 0
            # The context is the (size - 1)-gram that ends one word earlier; they stand in order of their last word.
            context = np.full(n, -1, np.int64)
            context[np.flatnonzero(place >= size - 2)] = np.arange(len(left[size - 2]))
            base = left[size - 2][context[at - 1]]
            ratio = np.log(np.where(seen, left[size - 1], 1)) - np.log(np.where(seen, base, 1))
            backoff[at] = np.where(seen, 0, backoff[at] + 1)
            score[at] = np.where(seen, ratio, score[at] + np.log(alpha))
        row = np.repeat(np.arange(len(words)), words)
        return pa.table(
            {
                "doc_id": table.column("ids")[0].values,
                "n_words": words,
                "n_backoff": np.bincount(row, weights=backoff > 0, minlength=len(words)).astype(np.int64),
                "log_score": np.bincount(row, weights=score, minlength=len(words)),
            },
            _SCORES,
        )

    return run


def _word_total(batches):
    schema = pa.schema([("chars", pa.int64()), ("words", pa.int64())])
    for b in batches:
        data, offsets = utf8(b.column(0))
        n = sum(len(Words(data, offsets[lo : hi + 1], NOT_SPACE).hashes) for lo, hi in slices(offsets))
        yield batch({"chars": [len(data)], "words": [n]}, schema)


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, leave_one_out: bool = True, stable: bool = False, block_bytes: int = BLOCK_BYTES, table_chars: int = TABLE_CHARS) -> DataFrame:
    """Stupid-backoff log scores of documents under the counts of all documents.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.  A word's score is
    count(n-gram) / count(context) for the longest n-gram that ends with it and has a count,
    times ``alpha`` for each shorter step; a single word's is its count over the number of words, where one
    without a count has half of one.  With ``leave_one_out`` a document's own n-grams are taken off
    all counts, so that it is scored by the other documents only.

    Input: ``doc_id`` and ``text``; other columns are ignored.  Output, one row per input row:
    ``doc_id``, ``n_words``, ``n_backoff`` (words not scored by the full order) and ``log_score``
    (natural logarithm, summed).  A text that is null or has no words scores 0 over 0 words; texts of any length are scored whole;
    repeated rows are each other's corpus; an empty table gives an empty result.

    Documents are read twice, and both times must come in the same blocks.  ``stable`` says that they do: the two
    readings are of one job, which cuts its files into tasks once, and a task that runs again reads what it read before.  A scan that is cut in two ways ends in an
    error, never in wrong scores.  Otherwise the blocks are written first.  A table gets a row from each block that has an n-gram
    of its range, and a block sends one for each n-gram at most.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sums = docs.select("text").mapInArrow(tidied(_word_total), "chars long, words long").agg(F.sum("chars").alias("chars"), F.sum("words").alias("words")).first()
    parts = max(1, -(-(sums["chars"] or 0) // table_chars))
    blocks = docs.mapInArrow(tidied(_blocks(block_bytes)), "block long, ids array<long>, sizes binary, texts binary")
    if not stable:
        blocks = settle(blocks, "lm-blocks")
    requests = blocks.select("block", "sizes", "texts").mapInArrow(tidied(_requests(order, parts)), "part int, block long, size int, n int, grams binary, counts binary")
    answers = requests.groupBy("part").applyInArrow(_totals, "block long, part int, size int, n int, totals binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(order, alpha, leave_one_out, sums["words"] or 0), "doc_id long, n_words long, n_backoff long, log_score double")
