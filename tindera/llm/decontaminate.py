"""Benchmark decontamination as a prefix-filtered set join.

Every window of an item must occur whole, so of its words, ordered by rarity, the
necessary prefix is the rarest one.  A document's words meet that index; a hit says where
the window would have to begin, bounds drop those that don't fit into the document, and the
rest are verified word by word.

The index of a small benchmark is broadcast.  That of a larger one is a table: positions of documents that a filter of bounded
size lets through are dealt by the prefix and joined to it.  Either way the documents are read twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .arrowtext import ALNUM, Words, batch, mix, ngrams, slices, tidied, utf8
from .shared import settle

WINDOW = 13
#: Characters of benchmark text whose index is broadcast at most: about 30 bytes a character.
BROADCAST_CHARS = 2_000_000
#: Bits of the filters that the join of a larger benchmark broadcasts: 16 MB each, whatever its size.
FILTER_BITS = 1 << 27


def _windows(texts: list[str], items: list, window: int):
    """Distinct windows by length: {length: (matrix of word hashes, items of each row)}."""
    data, offsets = utf8(pa.array(texts, pa.string()))
    words = Words(data, offsets, ALNUM)
    rows: dict[int, list[np.ndarray]] = {}
    names: dict[int, list[np.ndarray]] = {}
    for item, a, b in zip(items, words.first[:-1], words.first[1:]):
        n = int(min(window, b - a))
        if n:
            found = np.lib.stride_tricks.sliding_window_view(words.hashes[a:b], n)
            rows.setdefault(n, []).append(found)
            names.setdefault(n, []).append(np.full(len(found), item, np.int64))
    out = {}
    for n, parts in rows.items():
        distinct, inverse = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([inverse.ravel(), np.concatenate(names[n])], axis=1), axis=0)
        bound = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        out[n] = (distinct, pairs[:, 1], bound)
    return out


def _word_counts(wanted):
    """Counts of the benchmark's words in a task's documents: at most one row for each word and task."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        names = wanted.value
        total = np.zeros(len(names), np.int64)
        for b in batches:
            data, offsets = utf8(b.column(0))
            for lo, hi in slices(offsets):
                hashes = Words(data, offsets[lo : hi + 1], ALNUM).hashes
                spot = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
                total += np.bincount(spot[names[spot] == hashes], minlength=len(names))
        seen = np.flatnonzero(total)
        yield batch({"word": names[seen].view(np.int64), "n": total[seen]}, schema)

    return run


def _index(windows: dict, names: np.ndarray, counts: np.ndarray):
    """By length: rarest words in order, and for each the windows and the word's place in them."""
    out = []
    for n, (distinct, items, bound) in sorted(windows.items()):
        rarity = counts[np.searchsorted(names, distinct)]
        place = np.argmin(rarity, axis=1)
        token = distinct[np.arange(len(distinct)), place]
        order = np.argsort(token, kind="stable")
        out.append((n, token[order], order, place[order], distinct, items, bound))
    return out


_HITS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])


def _find(hashes: np.ndarray, first: np.ndarray, index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Verified occurrences: begins and ends (in words), and (row, item) pairs."""
    begins, ends, rows, items = [], [], [], []
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for n, token, window, place, distinct, item, bound in index:
        lo, hi = np.searchsorted(token, hashes, "left"), np.searchsorted(token, hashes, "right")
        at = np.flatnonzero(hi > lo)
        for k in range(0, len(at), 1 << 16):  # a frequent word may stand in many windows
            part = at[k : k + (1 << 16)]
            many = hi[part] - lo[part]
            spot = np.repeat(lo[part], many) + (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
            where = np.repeat(part, many)
            begin = where - place[spot]
            fits = (begin >= first[row_of[where]]) & (begin + n <= first[row_of[where] + 1])
            begin, spot = begin[fits], spot[fits]
            for j in range(n):  # word by word; the few that remain shrink at once
                same = hashes[begin + j] == distinct[window[spot], j]
                begin, spot = begin[same], spot[same]
            if len(begin):
                w = window[spot]
                size = bound[w + 1] - bound[w]
                flat = np.repeat(bound[w], size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
                begins.append(begin)
                ends.append(begin + n)
                rows.append(np.repeat(row_of[begin], size))
                items.append(item[flat])
    if not begins:
        return (np.zeros(0, np.int64),) * 4
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)], axis=1), axis=0)
    return np.concatenate(begins), np.concatenate(ends), pairs[:, 0], pairs[:, 1]


def _merge(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans with the same union, in order."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], np.append(reach[at[1:] - 1], reach[-1])], axis=1)


def _hits(sent):
    schema = pa.schema([f for f in _HITS if f.name != "text"])

    def run(batches):
        index = sent.value
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in slices(offsets):
                words = Words(data, offsets[lo : hi + 1], ALNUM)
                begin, end, row, item = _find(words.hashes, words.first, index)
                owner = np.searchsorted(words.first, begin, "right") - 1
                spans: list = [None] * (hi - lo)
                items: list = [None] * (hi - lo)
                order = np.argsort(owner, kind="stable")
                begin, end, owner = begin[order], end[order], owner[order]
                for i in np.unique(owner).tolist():
                    s = slice(*np.searchsorted(owner, [i, i + 1]))
                    spans[i] = _merge(np.stack([begin[s], end[s]], axis=1) - words.first[i]).ravel().tolist()
                    items[i] = sorted(set(item[slice(*np.searchsorted(row, [i, i + 1]))].tolist()))
                yield batch({"doc_id": b.column(0)[lo:hi], "n_words": np.diff(words.first), "spans": spans, "items": items}, schema)

    return run


def _window_rows(window: int):
    """(item_id, words): every window of an item, as packed word hashes."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in slices(offsets):
                words = Words(data, offsets[lo : hi + 1], ALNUM)
                ids, rows = [], []
                for item, x, y in zip(b.column(0)[lo:hi].to_pylist(), words.first[:-1], words.first[1:]):
                    n = int(min(window, y - x))
                    if n:
                        found = {w.tobytes() for w in np.lib.stride_tricks.sliding_window_view(words.hashes[x:y], n)}
                        rows += found
                        ids += [item] * len(found)
                yield batch({"item_id": ids, "words": rows}, schema)

    return run


def _window_words(batches):
    schema = pa.schema([("words", pa.binary()), ("place", pa.int32()), ("word", pa.int64())])
    for b in batches:
        for w in b.column(0):
            own = np.frombuffer(w.as_py(), np.int64)
            yield batch({"words": [w.as_py()] * len(own), "place": np.arange(len(own), dtype=np.int32), "word": own}, schema)


def _keys_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of single words and of pairs, by where they begin: what windows of one word, and longer ones, are joined by."""
    return mix(hashes ^ np.uint64(0x0101010101010101)), ngrams(hashes, 2)


def _prefixes(batches):
    """Adds to a window its key: the rarest word and the one beside it, and where these begin."""
    schema = pa.schema([("words", pa.binary()), ("n", pa.int32()), ("key", pa.int64()), ("place", pa.int32())])
    for b in batches:
        keys, places, sizes = [], [], []
        for w, rarest in zip(b.column(0), b.column(1).to_pylist()):
            own = np.frombuffer(w.as_py(), np.uint64)
            single, pairs = _keys_of(own)
            at = min(rarest, max(0, len(own) - 2))
            keys.append(int((pairs if len(own) > 1 else single)[at].view(np.int64)))
            places.append(at)
            sizes.append(len(own))
        yield batch({"words": b.column(0), "n": sizes, "key": keys, "place": places}, schema)


def _bit_rows(bits: int):
    """Words of a filter: two bits for each name, as (word of 64 bits, its bits)."""
    schema = pa.schema([("at", pa.int64()), ("bits", pa.int64())])

    def run(batches):
        for b in batches:
            names = b.column(0).to_numpy().view(np.uint64)
            spots = np.concatenate([names % np.uint64(bits), mix(names) % np.uint64(bits)])
            yield batch({"at": (spots >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (spots & np.uint64(63))).view(np.int64)}, schema)

    return run


def _filter(names: DataFrame, bits: int) -> np.ndarray:
    """A filter of a column of names: at most bits / 64 words come to the driver."""
    rows = names.mapInArrow(tidied(_bit_rows(bits)), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(-(-bits // 64), np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _passes(names: np.ndarray, bits: np.ndarray) -> np.ndarray:
    size = np.uint64(len(bits) * 64)
    out = np.ones(len(names), bool)
    for spots in (names % size, mix(names) % size):
        out &= (bits[spots >> np.uint64(6)] >> (spots & np.uint64(63))) & np.uint64(1) == 1
    return out


def _counts_through(sent):
    """Counts of the words that the filter lets through, summed by task batch."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(0))
            for lo, hi in slices(offsets):
                hashes = Words(data, offsets[lo : hi + 1], ALNUM).hashes
                names, n = np.unique(hashes[_passes(hashes, sent.value)], return_counts=True)
                yield batch({"word": names.view(np.int64), "n": n}, schema)

    return run


_PLACES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.binary())])


def _places(sent, window: int):
    """A row for each document (without a key), and one for each place in it that the filter lets through, with the words around."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(2))
            for lo, hi in slices(offsets):
                words = Words(data, offsets[lo : hi + 1], ALNUM)
                first, n = words.first, np.diff(words.first)
                rows, ids = b.column(0)[lo:hi].to_numpy(), b.column(1)[lo:hi].to_pylist()
                out = {"row": [rows], "key": [np.zeros(hi - lo, np.int64)], "at": [np.full(hi - lo, -1)], "before": [np.zeros(hi - lo, np.int32)]}
                around: list = [None] * (hi - lo)
                owner = np.repeat(np.arange(hi - lo), n)
                for keys in _keys_of(words.hashes):
                    at = np.flatnonzero(_passes(keys, sent.value))
                    begin = np.maximum(at - window, first[owner[at]])
                    end = np.minimum(at + window, first[owner[at] + 1])
                    out["row"].append(rows[owner[at]])
                    out["key"].append(keys[at].view(np.int64))
                    out["at"].append(at - first[owner[at]])
                    out["before"].append((at - begin).astype(np.int32))
                    around += [words.hashes[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist())]
                flat = {k: np.concatenate(v) for k, v in out.items()}
                more = len(around) - (hi - lo)
                yield batch(
                    {"row": flat["row"], "doc_id": ids + [None] * more, "n_words": np.concatenate([n, np.zeros(more, np.int64)]), "key": flat["key"], "at": flat["at"], "before": flat["before"], "around": around}, _PLACES
                )

    return run


@F.pandas_udf(ArrayType(LongType()))
def _merged(spans: pd.Series) -> pd.Series:
    return pd.Series([_merge(np.array([(s["begin"], s["end"]) for s in own], np.int64)).ravel().tolist() for own in spans], dtype=object)


def _find_by_join(docs: DataFrame, items: DataFrame, window: int, bits: int) -> DataFrame:
    """The same for a benchmark of any size: windows and places of documents meet in joins."""
    spark = docs.sparkSession
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    every = settle(items.mapInArrow(tidied(_window_rows(window)), "item_id long, words binary").distinct(), "windows")
    spelled = settle(every.select("words").distinct().mapInArrow(tidied(_window_words), "words binary, place int, word long"), "window-words")
    wanted = spark.sparkContext.broadcast(_filter(spelled.select("word"), bits))
    counts = docs.select("text").mapInArrow(tidied(_counts_through(wanted)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # A window with a word that no document has can't occur: the inner join drops that word, and the window is no longer whole.
    rarest = spelled.join(counts, "word").groupBy("words").agg(F.min(F.struct("n", "place")).alias("r"), F.count("*").alias("found"))
    rarest = rarest.where(F.col("found") * 8 == F.octet_length("words")).select("words", F.col("r.place").alias("rarest"))
    windows = settle(rarest.mapInArrow(tidied(_prefixes), "words binary, n int, key long, place int"), "window-prefixes")
    keys = spark.sparkContext.broadcast(_filter(windows.select("key"), bits))
    kind = "row long, doc_id long, n_words long, key long, at long, before int, around binary"
    places = settle(docs.select("row", "doc_id", "text").mapInArrow(tidied(_places(keys, window)), kind), "window-places")
    met = places.where("at >= 0").select("row", "key", "at", "before", "around").join(windows, "key").where("place <= before")
    same = F.substring("around", ((F.col("before") - F.col("place")) * 8 + 1).cast("int"), F.col("n") * 8) == F.col("words")
    hits = settle(met.where(same).select("row", (F.col("at") - F.col("place")).alias("begin"), (F.col("at") - F.col("place") + F.col("n")).alias("end"), "words").distinct(), "window-hits")
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("spans")).select("row", _merged("spans").alias("spans"))
    named = hits.select("row", "words").distinct().join(every, "words").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = places.where("at < 0").select("row", "doc_id", "n_words")
    return rows.join(spans, "row", "left").join(named, "row", "left").select("doc_id", "n_words", "spans", "items")


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_chars: int = BROADCAST_CHARS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Where windows of benchmark items occur in documents.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
    lower-cased.  A window is ``window`` consecutive words of an item; an item of fewer, but
    not none, is one window.  Input: ``doc_id``, ``text`` and ``item_id``, ``text``; other columns
    are ignored.  Output, one row per document row: ``doc_id``, ``n_words``, ``spans`` (begin and
    end of disjoint runs of hit words, flat) and ``items`` (distinct item_ids in order); both
    null without a hit.  Null texts have no words; items without words or item_id are never
    found; an empty benchmark hits nothing; repeated rows get equal results.

    Texts of any length are read whole.  Rarity is counted over all documents.  The benchmark's index is broadcast if its text
    has at most ``broadcast_chars`` characters; that of a larger one is joined by shuffles.  Rows equal in doc_id and text
    are equal there, too.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    if chars > broadcast_chars:
        return _find_by_join(docs, items, window, filter_bits)
    part = items.toArrow()
    windows = _windows(part["text"].to_pylist(), part["item_id"].to_pylist(), window)
    names = np.unique(np.concatenate([np.zeros(0, np.uint64), *(d.ravel() for d, _, _ in windows.values())]))
    counts = np.zeros(len(names), np.int64)
    if len(names):
        wanted = spark.sparkContext.broadcast(names)
        found = docs.select("text").mapInArrow(tidied(_word_counts(wanted)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        counts[np.searchsorted(names, found["word"].to_numpy().view(np.uint64))] = found["n"].to_numpy()
    sent = spark.sparkContext.broadcast(_index(windows, names, counts))
    return docs.mapInArrow(tidied(_hits(sent)), "doc_id long, n_words long, spans array<long>, items array<long>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of words, hit words and items, a digest of the items (as text, in order), and the verdict: five per cent of the words."""
    spans, items = F.coalesce("spans", F.array().cast("array<long>")), F.coalesce("items", F.array().cast("array<long>"))
    hits = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x)
    names = F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
    out = found.select("doc_id", "n_words", hits.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: ``find_windows`` summed up by ``digest``."""
    return digest(find_windows(docs, benchmark, window))
