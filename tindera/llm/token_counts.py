"""Token counts: pieces are counted once per distinct pre-token, joined to the pre-token
frequencies of each document, and summed.  No document's ids are materialised.

Documents are taken in blocks of bounded size.  A block's distinct pre-tokens go, with the frequencies that
its documents have of them, in packed arrays to tables partitioned by ranges of the pre-token's hash.
There every distinct pre-token meets the tokenizer once, its count is joined to all frequencies, and each
block gets its documents' partial sums.  Texts are read once and one shuffle carries what a document has.

A table serves a bounded run of scan partitions (``GROUP_PARTITIONS``), so what a pre-token that every document has brings to
one task is bounded, and so is the number of tables that a block sends to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .arrowtext import batch, pack_planes, tidied, unpack_planes

#: Characters in a block, about; a longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Characters behind a table, about, and tables of a group at most.
TABLE_CHARS, MOST_TABLES = 24_000_000, 700
#: Scan partitions whose blocks share tables: 16 GB at Spark's default split size.
GROUP_PARTITIONS = 128

_SENT = pa.schema([
    ("table", pa.int64()), ("block", pa.int64()), ("n_docs", pa.int32()), ("steps", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("spread", pa.binary()), ("docs", pa.binary()), ("freq", pa.binary()),
    ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("whole", pa.list_(pa.int64())),
])
_SENT_SQL = "table long, block long, n_docs int, steps binary, sizes binary, words binary, spread binary, docs binary, freq binary, ids array<long>, n_bytes array<long>, whole array<long>"
_SUMS = pa.schema([("block", pa.int64()), ("sums", pa.binary()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("whole", pa.list_(pa.int64()))])
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _planes(x: np.ndarray) -> bytes:
    return pack_planes(np.ascontiguousarray(x, np.uint32))


def _steps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Differences within consecutive runs of the given sizes; the first of a run stays."""
    out = np.diff(values, prepend=0)
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[begin] = values[begin]
    return out


def _unsteps(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sizes = sizes[sizes > 0]
    total = np.cumsum(steps)
    begin = np.cumsum(sizes) - sizes
    return total - np.repeat(total[begin] - steps[begin], sizes) if len(steps) else steps


class _Block:
    """Documents under way to the tables."""

    def __init__(self) -> None:
        self.chars = self.known = 0
        self.ids, self.n_bytes, self.whole, self.words = [], [], [], []
        self.hashes, self.at, self.docs, self.freq = [[np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64, np.int64)]

    def add(self, pieces: bpe.Pieces, ids: list, texts: list[str]) -> None:
        """``whole``: tokens of texts with added tokens, which the library counts as they are."""
        own = [len(pieces.library(t)) if any(s in t for s in pieces.special) else -1 for t in texts]
        distinct, source, index, first = pieces.pretokens(["" if n >= 0 else t for t, n in zip(texts, own)])
        k = max(1, len(distinct))
        pairs, freq = np.unique(np.repeat(np.arange(len(texts)), np.diff(first)) * k + index, return_counts=True)
        self.at.append(pairs % k + self.known)
        self.docs.append(pairs // k + len(self.ids))
        self.freq.append(freq)
        if len(distinct):
            joined, s, e = source[0]
            self.words += [joined[x:y].encode() for x, y in zip(s.tolist(), e.tolist())]
            self.hashes.append(distinct)
            self.known += len(distinct)
        self.ids += ids
        self.n_bytes += [len(t.encode()) for t in texts]
        self.whole += [max(0, n) for n in own]
        self.chars += sum(map(len, texts))

    def rows(self, block: int, group: int, limits: np.ndarray):
        """A row for each table that a pre-token of the block belongs to; the first one also carries the documents."""
        hashes, first, new = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        at, docs, freq = np.concatenate(self.at), np.concatenate(self.docs), np.concatenate(self.freq)
        at = new[at] if len(new) else at
        order = np.lexsort((docs, at))
        at, docs, freq = at[order], docs[order], freq[order]
        spread = np.bincount(at, minlength=len(hashes))
        bound = np.concatenate([[0], np.searchsorted(hashes, limits), [len(hashes)]])
        edge = np.concatenate([[0], np.cumsum(spread)])[bound]
        out = {k: [] for k in _SENT.names}
        for part in range(len(limits) + 1):
            a, b = bound[part], bound[part + 1]
            if a == b and (part or b < len(hashes)):
                continue
            words = [self.words[i] for i in first[a:b].tolist()]
            x, y = edge[part], edge[part + 1]
            head = (self.ids, self.n_bytes, self.whole) if not out["table"] else (None, None, None)
            row = (
                group * MOST_TABLES + part, block, len(self.ids), pack_planes(np.diff(hashes[a:b], prepend=np.uint64(0)) if b > a else hashes[:0]), _planes(np.array([len(w) for w in words], np.int64)), b"".join(words),
                _planes(spread[a:b]), _planes(_steps(docs[x:y], spread[a:b])), _planes(freq[x:y]), *head,
            )
            for k, v in zip(_SENT.names, row):
                out[k].append(v)
        return batch(out, _SENT)


def _sent(path: str, tables: int, block_chars: int):
    limits = np.array([(k << 64) // tables for k in range(1, tables)], np.uint64)

    def run(batches):
        pieces, part = bpe.pieces_of(path), TaskContext.get().partitionId()
        name, group, own = part << 32, part // GROUP_PARTITIONS, _Block()
        for b in batches:
            for lo, hi, texts in bpe.text_chunks(b.column(1)):
                own.add(pieces, b.column(0)[lo:hi].to_pylist(), texts)
                if own.chars >= block_chars:
                    yield own.rows(name, group, limits)
                    name, own = name + 1, _Block()
        if own.ids:
            yield own.rows(name, group, limits)

    return run


def _joined(path: str):
    """A table: counts each distinct pre-token's pieces, joins them to the frequencies and sums these by document."""

    def run(table: pa.Table) -> pa.Table:
        pieces = bpe.pieces_of(path)
        column = lambda name, i, kind=np.uint32: unpack_planes(table.column(name)[i].as_py(), kind)
        hashes = [np.cumsum(column("steps", i, np.uint64), dtype=np.uint64) for i in range(table.num_rows)]
        words: list[bytes] = []
        for i in range(table.num_rows):
            text, ends = table.column("words")[i].as_py(), np.cumsum(column("sizes", i)).tolist()
            words += [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        distinct, first, index = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        n = pieces.pieces([words[i].decode() for i in first.tolist()])[0].astype(np.int64) if len(distinct) else np.zeros(0, np.int64)
        out, at = {k: [] for k in _SUMS.names}, 0
        for i, own in enumerate(hashes):
            each, spread = n[index[at : at + len(own)]], column("spread", i).astype(np.int64)
            at += len(own)
            docs = _unsteps(column("docs", i).astype(np.int64), spread)
            sums = np.bincount(docs, weights=np.repeat(each, spread) * column("freq", i).astype(np.int64), minlength=table.column("n_docs")[i].as_py())
            row = (table.column("block")[i].as_py(), pack_planes(sums.astype(np.uint64)), *(table.column(c)[i].as_py() for c in ("ids", "n_bytes", "whole")))
            for k, v in zip(_SUMS.names, row):
                out[k].append(v)
        return pa.table(out, _SUMS)

    return run


def _added(table: pa.Table) -> pa.Table:
    """The documents of a block: the tables' partial sums."""
    head = next(i for i, x in enumerate(table.column("ids")) if x.is_valid)
    total = np.array(table.column("whole")[head].as_py(), np.int64)
    for sums in table.column("sums"):
        total = total + unpack_planes(sums.as_py(), np.uint64).astype(np.int64)
    return pa.table({"doc_id": table.column("ids")[head].values, "n_bytes": table.column("n_bytes")[head].values, "n_tokens": total}, _COUNTS)


def count_tokens(docs: DataFrame, tokenizer_path: str, block_chars: int = BLOCK_CHARS, table_chars: int = TABLE_CHARS) -> DataFrame:
    """Count the tokens of every whole text.

    Input: ``doc_id`` and ``text``; other columns are ignored.  Output, one row per
    input row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``.  A null text is empty and has
    none of either; texts of any length are counted whole; a null ``doc_id`` stays null; repeated rows are each counted; an empty
    table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    tables = min(MOST_TABLES, max(1, -(-chars // table_chars)))
    sent = docs.mapInArrow(tidied(_sent(tokenizer_path, tables, block_chars)), _SENT_SQL)
    sums = sent.groupBy("table").applyInArrow(_joined(tokenizer_path), "block long, sums binary, ids array<long>, n_bytes array<long>, whole array<long>")
    return sums.groupBy("block").applyInArrow(_added, "doc_id long, n_bytes long, n_tokens long")
