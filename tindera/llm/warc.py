"""A deterministic, sharded WARC writer, and a reader.

Records are sorted by page_id within shards, which are ranges of (page_id, payload digest) with about equal
bytes.  A shard is written to files that roll by compressed size, under temporary names; the
files of the tasks that succeeded are then renamed and named in a manifest.  The same
rows give the same bytes, whatever the cluster.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import batch, tidied
from .shared import settle

#: Payload bytes in a shard, about, and compressed bytes after which a file rolls.
SHARD_BYTES = 32_000_000
ROLL_BYTES = 16_000_000
#: Ranges at first, and into which a range with too many bytes is split at most at once.
CELLS = 4096
#: Partitions of the shuffle at most; beyond, one writes several shards.
MOST_PARTITIONS = 10_000
#: The date in all headers: a parameter, so that files don't depend on the clock.
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6f1c3a52-7c0e-4b7e-9d55-9d9f7a1f2b10")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAK = b"\r\n"


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, k: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{payload_digest}:{k}')}>"


def _clean(url: str) -> str:
    """A URL that fits into one header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + 2 * _BREAK) + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, k: int = 0, date: str = DATE) -> bytes:
    """A response, or a revisit of page ``refers_to`` that has the same payload."""
    name = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, name, k)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url) if url else f"urn:x-page:{page_id}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{name}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(refers_to, name, 0)), ("X-Refers-To-Page-Id", str(refers_to))]
    return _member(headers, block)


def info_record(file_name: str, date: str = DATE) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, file_name)}>"), ("WARC-Date", date), ("WARC-Filename", file_name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    return _member(headers, block)


_FILES = pa.schema([("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


class _Roller:
    """Writes a shard's records to numbered files under temporary names."""

    def __init__(self, folder: str, roll_bytes: int, date: str) -> None:
        from pyarrow import fs

        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(f"{self.folder}/_temporary")
        self.roll_bytes, self.date = roll_bytes, date
        self.shard, self.out, self.done = None, None, []

    def _open(self) -> None:
        self.name = f"part-{self.shard:06d}-{self.number:04d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        self.sha, self.size, self.records = hashlib.sha256(), 0, 0
        self._put(info_record(self.name, self.date))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.temporary, self.name, self.records, self.size, self.sha.hexdigest()))
            self.out = None
            self.number += 1

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is not None and self.records and self.size + len(record) > self.roll_bytes:
            self.close()
        if self.out is None:
            self._open()
        self._put(record)
        self.records += 1


def _write(folder: str, roll_bytes: int, date: str):
    """Takes rows in order of shard, page_id and kind: first what a page revisits (kind 0), then the page (kind 1)."""

    def run(batches):
        files = None
        at, revisits, seen = object(), {}, {}
        for b in batches:
            files = files or _Roller(folder, roll_bytes, date)
            for shard, page_id, kind, sha, leader, url, html in zip(*(b.column(i) for i in range(7))):
                shard, page_id = shard.as_py(), page_id.as_py()
                if (shard, page_id) != at:
                    at, revisits, seen = (shard, page_id), {}, {}  # equal payloads of a page are in one shard
                if kind.as_py() == 0:
                    revisits[sha.as_py()] = leader.as_py()
                    continue
                payload = (html.as_py() or "").encode()
                name = hashlib.sha1(payload).hexdigest()
                k = seen[name] = seen.get(name, -1) + 1
                files.add(shard, page_record(page_id, url.as_py(), payload, revisits.get(name), k, date))
        if files is not None:
            files.close()
            rows = list(zip(*files.done))
            yield batch(dict(zip(_FILES.names, rows)), _FILES)

    return run


class Ranges:
    """Consecutive ranges of (page_id, digest), by where each begins; digests split only pages that are too large for one."""

    _TOP = 1 << 60  # digests count with their first 60 bits

    def __init__(self, begins: list[tuple[int, int]]) -> None:
        self.begins = sorted(set(begins))
        self._arrays: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        """Ranges travel as two arrays, and are not made into them again for every batch."""
        return {"begins": None, "_arrays": self.arrays()}

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        if self._arrays is None:
            self._arrays = tuple(np.array(x, np.int64) for x in zip(*self.begins))
        return self._arrays

    @staticmethod
    def evenly(low: int, high: int, parts: int) -> list[int]:
        """``parts`` places from ``low`` on that divide ``low`` to ``high``, end exclusive, or all there are."""
        size = high - low
        return sorted({low + size * k // parts for k in range(min(parts, size))})

    def at(self, pages: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """The range of each row."""
        names, firsts = self.arrays()
        spot = np.searchsorted(names, pages, "right") - 1
        within = spot > np.searchsorted(names, pages, "left")  # of a page that is split
        spot -= (spot >= 0) & (names[spot] == pages) & (firsts[spot] > digests)  # a range that begins in the page, after the row
        for k in np.flatnonzero(within):
            first, end = np.searchsorted(names, pages[k], "left"), np.searchsorted(names, pages[k], "right")
            spot[k] = first + np.searchsorted(firsts[first:end], digests[k], "right") - 1
        return np.maximum(spot, 0)

    def column(self, spark: SparkSession):
        sent = spark.sparkContext.broadcast(self)  # 16 bytes a range; ranges are four times the shards at most, and CELLS

        def run(pages: pd.Series, digests: pd.Series) -> pd.Series:
            return pd.Series(sent.value.at(pages.fillna(LEAST).to_numpy(np.int64), digests.to_numpy(np.int64)).astype(np.int32))

        return F.pandas_udf(run, "int")(F.coalesce("page_id", F.lit(LEAST)), F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))


LEAST = -(1 << 63)


def shard_ranges(slim: DataFrame, shard_bytes: int) -> Ranges:
    """Ranges of about ``shard_bytes`` each, from ``page_id``, ``sha`` and ``size`` of all pages.

    Ranges of equal width are counted; those with too many bytes are split and counted again, until none can be; then
    neighbours are put together.  No sample and no order of tasks plays a part.
    """
    spark = slim.sparkSession
    low, high = slim.agg(F.min("page_id"), F.max("page_id")).first()
    low, high = (0 if low is None else low), (0 if high is None else high)
    ranges, done = Ranges([(LEAST, 0), *((p, 0) for p in Ranges.evenly(low, high + 1, CELLS))]), set()
    while True:
        counts = slim.groupBy(ranges.column(spark).alias("at")).agg(F.sum("size").alias("n")).toArrow()
        sizes = dict(zip(counts["at"].to_pylist(), counts["n"].to_pylist()))
        more: list[tuple[int, int]] = []
        for k, n in sizes.items():
            page, digest = ranges.begins[k]
            after = ranges.begins[k + 1] if k + 1 < len(ranges.begins) else (high + 1, 0)
            if n <= shard_bytes or (page, digest, after) in done:
                continue
            done.add((page, digest, after))
            parts = min(CELLS, 4 * -(-n // shard_bytes))
            end = after[0] + (after[1] > 0)
            if end - page > 1 and (page != LEAST or low == LEAST):
                more += [(p, 0) for p in Ranges.evenly(page, end, parts) if p > page]
            else:
                top = after[1] if after[0] == page else Ranges._TOP
                more += [(page, d) for d in Ranges.evenly(digest, top, parts) if d > digest]
        if not more:
            break
        ranges = Ranges(ranges.begins + more)
    begins, size = [(LEAST, 0)], 0
    for k in range(len(ranges.begins)):
        n = sizes.get(k, 0)
        if size and size + n > shard_bytes:
            begins.append(ranges.begins[k])
            size = 0
        size += n
    return Ranges(begins)


def _rename(folder: str):
    """Moves written files to their names; a file that was moved before a task was lost stays."""

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for temporary, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if system.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                    system.move(f"{root}/{temporary}", f"{root}/{name}")
                elif system.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{temporary} in {folder}")
            yield pa.RecordBatch.from_arrays([b.column(1)], ["name"])

    return run


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write one record per row of ``page_id``, ``url`` and ``html`` to ``folder``; returns the manifest (``name``, ``records``, ``bytes``, ``sha256``).

    The payload is the html in UTF-8 (null: empty; of any length).  Of pages with equal payloads the one with
    the largest page_id is a response and the others revisit it; repeated rows of that page are
    responses too, and so is a page without a page_id.  A null URL gets a URN.  Other columns are
    ignored.  An empty table gives a manifest without files.  Page ids may be as far apart, or as often repeated, as they
    like; only rows that share a page_id and a payload stay in one shard.

    ``folder`` is a URI that all executors share and that pyarrow can open.  A folder that
    has a manifest already is an error.  Files left by lost tasks never get their names.
    """
    spark = pages.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda name: jvm.org.apache.hadoop.fs.Path(root, name)
    if fs.exists(at("manifest.jsonl")):
        raise FileExistsError(f"{folder} has a manifest already")
    fs.mkdirs(at("_temporary"))

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    sha = F.sha1(payload.cast("binary"))
    slim = settle(pages.select("page_id", sha.alias("sha"), F.octet_length(payload).cast("long").alias("size")), "warc-pages")
    ranges = shard_ranges(slim, shard_bytes)
    shard = ranges.column(spark)

    # Only payloads that occur twice are joined back; their table is written first, so that AQE can split one that very many pages share.
    leaders = slim.groupBy("sha").agg(F.max("page_id").alias("leader"), F.count("*").alias("m")).where("m > 1 and leader is not null")
    leaders = settle(leaders.select("sha", "leader"), "warc-leaders")
    none = F.lit(None).cast("string")
    revisits = slim.join(leaders, "sha").where("page_id != leader").select("page_id", F.lit(0).alias("kind"), "sha", "leader", none.alias("url"), none.alias("html"))
    full = pages.select("page_id", F.lit(1).alias("kind"), sha.alias("sha"), F.lit(None).cast("long").alias("leader"), "url", "html")
    rows = full.unionByName(revisits).withColumn("shard", shard)
    partitions = min(len(ranges.begins), MOST_PARTITIONS)
    dealt = rows.repartitionById(partitions, F.pmod("shard", F.lit(partitions))).sortWithinPartitions("shard", "page_id", "kind", "url", "html")
    dealt = dealt.select("shard", "page_id", "kind", "sha", "leader", "url", "html")
    # The table of written files holds those of tasks that succeeded, once each.
    written = settle(dealt.mapInArrow(tidied(_write(folder, roll_bytes, date)), "temporary string, name string, records long, bytes long, sha256 string"), "warc-files")
    written.select("temporary", "name").mapInArrow(_rename(folder), "name string").write.format("noop").mode("overwrite").save()
    manifest = written.select("name", "records", "bytes", "sha256")
    out = fs.create(at("_temporary/manifest.jsonl"), True)
    for row in manifest.orderBy("name").toLocalIterator():
        out.write(bytearray((json.dumps(row.asDict()) + "\n").encode()))
    out.close()
    if not fs.rename(at("_temporary/manifest.jsonl"), at("manifest.jsonl")):
        raise OSError(f"cannot commit the manifest of {folder}")
    fs.delete(at("_temporary"), True)
    return manifest


def records(data: bytes):
    """The records of an archive: (headers, block).  Fails on a record that isn't whole."""
    view, at = memoryview(data), 0
    while at < len(data):
        pack, parts = zlib.decompressobj(31), []
        while not pack.eof:
            part = view[at : at + 65536]
            if not part:
                raise ValueError("the archive ends within a record")
            parts.append(pack.decompress(part))
            at += len(part)
        at -= len(pack.unused_data)
        text = b"".join(parts)
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        block = rest[: int(headers["content-length"])]
        if len(block) != int(headers["content-length"]) or headers.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
            raise ValueError(f"damaged record {headers.get('warc-record-id')}")
        yield headers, block


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read(with_payload: bool):
    schema = _READ if with_payload else pa.schema(list(_READ)[:-1])

    def run(batches):
        for b in batches:
            for content in b.column(0):
                out: dict[str, list] = {k: [] for k in schema.names}
                size = 0
                for h, block in records(content.as_py()):
                    kind = h["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    name = h["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(payload) != name or len(payload) != length):
                        raise ValueError(f"damaged payload in {h.get('warc-record-id')}")
                    page, other = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    row = (int(page) if page else None, h.get("warc-target-uri"), length, name, kind, int(other) if other else None, payload if kind == "response" else None)
                    for k, v in zip(schema.names, row):
                        out[k].append(v)
                    size += len(payload)
                    if size > 8_000_000:
                        yield batch(out, schema)
                        out, size = {k: [] for k in schema.names}, 0
                yield batch(out, schema)

    return run


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The response and revisit records of all archives in a folder, with every digest checked.

    ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and the
    ``payload`` (null for a revisit), unless that isn't wanted.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.mapInArrow(tidied(_read(payload)), kinds + (", payload binary" if payload else ""))
