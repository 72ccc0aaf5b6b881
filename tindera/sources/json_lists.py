"""Product lists in JSON files of any size, element by element: no task holds a file.

A file is read in pieces that end at commas, and these are written as chunks with their place in it, so that reading them in other tasks changes nothing.
Tasks say of each chunk whether it ends within a text and how deep it goes, so that the driver knows from a row a chunk how each
begins; then how often it is cut; and then they put out what lies between cuts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import bound_batches, written

#: Bytes of a chunk, up to its next comma.
CHUNK_BYTES = 1 << 20
_QUOTE, _COMMA = 34, 44
_STEPS = np.zeros(256, np.int8)
_STEPS[[91, 123]], _STEPS[[93, 125]] = 1, -1
_MARKS = (_STEPS != 0) | np.isin(np.arange(256), (_QUOTE, _COMMA))
_ESCAPED = re.compile(rb"\\.", re.S)
_OPENING = re.compile(rb"\s*(?:\xef\xbb\xbf)?\s*([^\s])")
_HEAD = re.compile(rb'\s*"products"\s*:\s*(\[)?')
# What stands before and after a list: a byte order mark, the object that it is a field of, and its end.
_LIST_BEGINS, _FIELD_BEGINS, _ENDS = r"^\x{FEFF}?\s*\[", r'^\x{FEFF}?\s*(?:\{\s*)?"products"\s*:\s*\[', r"\]\s*(?:\}\s*)?$"


@dataclass
class Chunk:
    """How a chunk begins: within a text or not, how deep, and after how many cuts.  ``deepest`` is where the file is cut."""

    quoted: int = 0
    depth: int = 0
    deepest: int = 1
    cuts: int = 0


@dataclass
class Listing:
    """A file's list: its elements are what lies between the cuts ``first`` to ``last``; none, if ``first`` is None."""

    path: str
    name: str
    form: str
    first: int | None = 0
    last: int = 0
    table: DataFrame | None = None
    chunks: dict[tuple[int, int, int], Chunk] = field(default_factory=dict)


_PLACE = [("file", pa.int64()), ("at", pa.int64()), ("k", pa.int64())]
_KEYS = "file long, at long, k long"


def _chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, at, k, text): chunks by split and number in it."""
    bound_batches(spark)
    rows = spark.read.text(paths, lineSep=",").select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    return written(rows.mapInArrow(_gathered, f"{_KEYS}, text binary"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows of one split are one stretch, in order."""
    shape = pa.schema([*_PLACE, ("text", pa.binary())])
    split, k, parts, size = None, 0, [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": split[0], "at": split[1], "k": k, "text": b"".join(parts)}], shape)

    for batch in batches:
        file, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        begin = 0
        for end in [*(np.flatnonzero((np.diff(file) != 0) | (np.diff(at) != 0)) + 1).tolist(), len(file)] if len(file) else ():
            own = (int(file[begin]), int(at[begin]))
            if parts and (own != split or size >= CHUNK_BYTES):
                yield made()
                k, parts, size = k + 1, [], 0
            text = b",".join(batch.column(2).slice(begin, end - begin).cast(pa.binary()).to_pylist())
            # A comma stands before each piece but the file's first.
            parts += [text] if own != split and not own[1] else [b",", text]
            size += len(text)
            k = k if own == split else 0
            split, begin = own, end
    if parts:
        yield made()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], bytes]]:
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in range(4))):
            yield r[:3], r[3]


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and bytes of quotes, commas and brackets, and how many quotes there are up to each; escaped ones don't count."""
    plain = np.frombuffer(_ESCAPED.sub(b"__", text) if b"\\" in text else text, np.uint8)
    places = np.flatnonzero(_MARKS[plain])
    kinds = plain[places]
    return places, kinds, np.cumsum(kinds == _QUOTE)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: whether its quotes are odd, how deep it goes from outside and from inside a text, and what it opens with."""
    shape = pa.schema([*_PLACE, ("odd", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64()), ("opening", pa.string())])
    for (file, at, k), text in _each(batches):
        _, kinds, quotes = _marks(text)
        outside, inside = (int(_STEPS[kinds[(quotes + start) % 2 == 0]].sum(dtype=np.int64)) for start in (0, 1))
        opening = _OPENING.match(text)
        found = {"odd": int(quotes[-1]) % 2 if len(quotes) else 0, "outside": outside, "inside": inside, "opening": opening[1].decode("latin-1") if opening else ""}
        yield pa.RecordBatch.from_pylist([{"file": file, "at": at, "k": k} | found], shape)


def _cuts(chunk: Chunk, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the commas that cut a chunk, and how deep these are."""
    places, kinds, quotes = _marks(text)
    outside = ((quotes + chunk.quoted) % 2 == 0) & (kinds != _QUOTE)
    places, kinds = places[outside], kinds[outside]
    depths = chunk.depth + np.cumsum(_STEPS[kinds], dtype=np.int64)
    cuts = (kinds == _COMMA) & (depths <= chunk.deepest)
    return places[cuts], depths[cuts]


def _counted(chunks: dict[tuple[int, int, int], Chunk]):
    """Of each chunk: how many cuts it has, and which of them begin a field of the file's own object: (cut, 0), or 1 for the list of products, or 2 for products that are no list."""
    shape = pa.schema([*_PLACE, ("cuts", pa.int64()), ("heads", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, text in _each(batches):
            if own not in chunks:
                continue
            places, depths = _cuts(chunks[own], text)
            heads = []
            if chunks[own].deepest == 2:
                begins = [(0, text.index(b"{") + 1)] if own[1:] == (0, 0) else []
                for cut, place in begins + [(int(c) + 1, int(places[c]) + 1) for c in np.flatnonzero(depths == 1)]:
                    head = _HEAD.match(text, place)
                    heads.append([cut, 0 if head is None else 1 if head[1] else 2])
            yield pa.RecordBatch.from_pylist([{"file": own[0], "at": own[1], "k": own[2], "cuts": len(places), "heads": heads}], shape)

    return run


def _between(chunks: dict[tuple[int, int, int], Chunk]):
    """(file, cut, at, k, text): what lies between cuts, or as much of it as is in a chunk."""
    shape = pa.schema([*_PLACE, ("cut", pa.int64()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, text in _each(batches):
            if own in chunks:
                ends = [*_cuts(chunks[own], text)[0].tolist(), len(text)]
                begins = [0, *(e + 1 for e in ends[:-1])]
                yield pa.RecordBatch.from_pylist([{"file": own[0], "at": own[1], "k": own[2], "cut": chunks[own].cuts + n, "text": text[b:e]} for n, (b, e) in enumerate(zip(begins, ends))], shape)

    return run


def _known(listings: dict[int, Listing]) -> dict[tuple[int, int, int], Chunk]:
    return {place: chunk for own in listings.values() for place, chunk in own.chunks.items()}


def long_files(spark: SparkSession, path: str, over: int) -> dict[int, tuple[str, str]]:
    """Files of more than so many bytes: path and name by the name's digest."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > over)
    return {r["file"]: (r["path"], r["name"]) for r in files.select(F.xxhash64("_metadata.file_path").alias("file"), "path", F.col("_metadata.file_path").alias("name")).collect()}


def listings(spark: SparkSession, names: dict[int, tuple[str, str]]) -> tuple[dict[int, Listing], list[str]]:
    """What lists the files hold, and the names of files that hold none.  The driver gets a row a chunk."""
    table = _chunks(spark, [p for p, _ in names.values()])
    found: dict[int, Listing] = {}
    depth = quoted = 0
    for r in sorted(table.mapInArrow(_summed, f"{_KEYS}, odd long, outside long, inside long, opening string").collect()):
        own = found.get(r["file"])
        if own is None:
            own = found[r["file"]] = Listing(*names[r["file"]], r["opening"], table=table)
            depth = quoted = 0
        own.chunks[r["file"], r["at"], r["k"]] = Chunk(quoted, depth, 2 if own.form == "{" else 1)
        depth, quoted = depth + (r["inside"] if quoted else r["outside"]), (quoted + r["odd"]) % 2
        own.last = abs(depth) + quoted
    bad = {file for file in names if file not in found or found[file].form not in ("[", "{") or found[file].last}
    good = {file: own for file, own in found.items() if file not in bad}
    heads: dict[int, list[tuple[int, int]]] = {file: [] for file in good}
    total = dict.fromkeys(good, 0)
    for r in sorted(table.mapInArrow(_counted(_known(good)), f"{_KEYS}, cuts long, heads array<array<long>>").collect()) if good else ():
        file = r["file"]
        good[file].chunks[file, r["at"], r["k"]].cuts = total[file]
        heads[file] += [(total[file] + cut, kind) for cut, kind in r["heads"]]
        total[file] += r["cuts"]
    for file, own in good.items():
        own.last = total[file]
        if own.form == "{":
            lists = [k for k, (_, kind) in enumerate(heads[file]) if kind]
            if len(lists) > 1 or any(heads[file][k][1] == 2 for k in lists):
                bad.add(file)
                continue
            own.first = heads[file][lists[0]][0] if lists else None
            own.last = heads[file][lists[0] + 1][0] - 1 if lists and lists[0] + 1 < len(heads[file]) else own.last
    for file in [f for f, own in good.items() if own.form == "{" and f not in bad]:
        try:
            outer_fields(spark, {file: good[file]})
        except ValueError:
            bad.add(file)
    return {f: own for f, own in good.items() if f not in bad}, sorted(names[f][1] for f in bad)


def _texts(spark: SparkSession, found: dict[int, Listing], of_lists: bool) -> DataFrame:
    """(file, path, first, last, cut, text) of what lies between cuts, in the lists or outside them."""
    lists = spark.createDataFrame([(file, own.name, own.form, own.first, own.last) for file, own in found.items()], "file long, path string, form string, first long, last long")
    table = next(iter(found.values())).table
    rows = table.mapInArrow(_between(_known(found)), f"{_KEYS}, cut long, text binary").join(F.broadcast(lists), "file")
    inside = F.coalesce(F.col("cut").between(F.col("first"), F.col("last")), F.lit(False))
    parts = rows.where(inside if of_lists else ~inside).groupBy("file", "path", "form", "first", "last", "cut").agg(F.array_sort(F.collect_list(F.struct("at", "k", F.col("text").cast("string").alias("text")))).alias("parts"))
    return parts.withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), "")).drop("parts")


def outer_fields(spark: SparkSession, found: dict[int, Listing]) -> dict | None:
    """The fields beside ``products`` of the one file that is an object; null if it is a list."""
    (own,) = found.values()
    if own.form == "[":
        return None
    rows = sorted(_texts(spark, found, of_lists=False).select("cut", "text").collect())
    before = [r["text"] for r in rows if own.first is None or r["cut"] < own.first]
    after = [r["text"] for r in rows if own.first is not None and r["cut"] > own.last]
    text = (",".join(before).lstrip("\ufeff") if before else "{") + ("," if before and after else "") + ",".join(after)
    fields = json.loads(text + ("" if after or own.first is None else "}"))
    if not isinstance(fields, dict):
        raise ValueError(f"no object in {own.path}")
    return fields


def elements(spark: SparkSession, found: dict[int, Listing]) -> DataFrame:
    """(path, ordinal, raw) of the elements of all lists; ``raw`` is null where a text is no JSON."""
    rows = _texts(spark, found, of_lists=True)
    opened = F.when(F.col("form") == "[", F.regexp_replace("text", _LIST_BEGINS, "")).otherwise(F.regexp_replace("text", _FIELD_BEGINS, ""))
    rows = rows.withColumn("text", F.when(F.col("cut") == F.col("first"), opened).otherwise(F.col("text")))
    rows = rows.withColumn("text", F.when(F.col("cut") == F.col("last"), F.regexp_replace("text", _ENDS, "")).otherwise(F.col("text")))
    empty = (F.col("first") == F.col("last")) & (F.regexp_replace("text", r"\s+", "") == "")
    # As a list of one, so that a text of two values is none.
    one = F.try_parse_json(F.concat(F.lit("["), "text", F.lit("]"))).cast("array<variant>")
    return rows.where(~empty).select("path", (F.col("cut") - F.col("first")).cast("int").alias("ordinal"), F.when(F.size(one) == 1, one[0]).alias("raw"))
