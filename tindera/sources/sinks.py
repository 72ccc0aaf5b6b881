"""Writers.  Tables and exports of one file are written by tasks; ``json_array``, ``csv_export`` and ``snapshot`` stream small ones through the driver."""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import MARKETPLACES
from ..scratch import scratch_folder


def json_array(rows: DataFrame, column: str | None = None, before: bytes = b"", after: bytes = b"") -> Iterator[bytes]:
    """One pretty UTF-8 JSON array, in pieces; partitions come to the driver one by one.

    Elements are the rows, or the JSON texts of ``column``.  ``before`` and ``after`` stand around the array.
    """
    yield before + b"["
    first = True
    element = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}) if column is None else F.col(column)
    for row in rows.select(element.alias("j")).toLocalIterator():
        text = json.dumps(json.loads(row["j"]), ensure_ascii=False, indent=2)
        yield ((b"\n" if first else b",\n") + text.encode())
        first = False
    yield (b"]" if first else b"\n]") + after


def csv_export(rows: DataFrame, header: Sequence[str] | None = None) -> Iterator[bytes]:
    """CSV with a byte order mark and a header, in pieces; nothing at all for an empty table.

    ``header`` names the columns that are written, in order; others are left out, and missing ones are empty.
    """
    names = list(header or rows.columns)
    picked = rows.select(*[F.col(f"`{n}`") if n in rows.columns else F.lit("").alias(n) for n in names])
    head = False
    for row in picked.toLocalIterator():
        out = io.StringIO()
        writer = csv.writer(out)
        if not head:
            out.write("\ufeff")
            writer.writerow(names)
            head = True
        writer.writerow(["" if v is None else v for v in row])
        yield out.getvalue().encode()


def write_json_array(rows: DataFrame, path: str, column: str | None = None, before: bytes = b"", after: bytes = b"") -> None:
    """The file that ``json_array`` gives, written by tasks: nothing of it comes to the driver."""
    element = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}) if column is None else F.col(column)

    @F.pandas_udf("string")
    def pretty(texts: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(json.loads(t), ensure_ascii=False, indent=2) for t in texts], dtype=object)

    _join_parts(rows.select(pretty(element).alias("value")), path, ",\n", before + b"[\n", b"\n]" + after, before + b"[]" + after, cut=True)


def write_csv(rows: DataFrame, path: str, header: Sequence[str] | None = None) -> None:
    """The file that ``csv_export`` gives, written by tasks: nothing of it comes to the driver."""
    names = list(header or rows.columns)

    def line(row: Sequence) -> str:
        out = io.StringIO()
        csv.writer(out).writerow(["" if v is None else v for v in row])
        return out.getvalue()[:-2]

    picked = F.struct(*[F.col(f"`{n}`") if n in rows.columns else F.lit("").alias(n) for n in names])
    made = rows.select(F.udf(line, "string", useArrow=False)(picked).alias("value"))
    _join_parts(made, path, "\r\n", ("\ufeff" + line(names) + "\r\n").encode(), b"", b"", cut=False)


def _join_parts(lines: DataFrame, path: str, end: str, before: bytes, after: bytes, empty: bytes, cut: bool) -> None:
    """One file of all ``value`` texts in order, each with ``end`` behind it (with ``cut`` not the last), whole or not at all.

    Tasks write parts, and on a shared local folder copy each to its place in the file; other file systems take a file from one writer only, which is a task
    that copies in pieces.  The driver lists the parts and renames the file.
    """
    spark = lines.sparkSession
    folder = scratch_folder(spark)
    lines.write.option("lineSep", end).text(folder)
    parts = [(r["path"], r["length"]) for r in spark.read.format("binaryFile").load(folder).select("path", "length").orderBy("path").collect() if r["length"]]
    if not parts:
        snapshot(spark, iter([empty]), path)
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    target = fs.makeQualified(target)
    fs.mkdirs(target.getParent())
    staged = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.tmp")
    local = fs.getUri().getScheme() == "file"
    plan, at = [], len(before)
    for k, (part, size) in enumerate(parts):
        last = k == len(parts) - 1
        size -= len(end) if last and cut else 0
        uri = jvm.org.apache.hadoop.fs.Path(part).toUri()
        plan.append((uri.getPath() if local else uri.toString(), size, 0 if k == 0 else at, before if k == 0 else b"", after if last else b""))
        at += size
    tasks = spark.sparkContext.parallelize(plan if local else [plan], len(plan) if local else 1)
    try:
        tasks.foreach(_placed(staged.toUri().getPath()) if local else _appended(staged.toUri().toString()))
        if local:  # the checksum file of what stood there before
            fs.delete(jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.crc"), False)
        _rename_over(spark, fs, staged, target)
    except BaseException:
        fs.delete(staged, False)
        raise


def _placed(staged: str):
    def copy(piece: tuple) -> None:
        part, size, at, before, after = piece
        with open(part, "rb") as given, os.fdopen(os.open(staged, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as out:
            out.seek(at)
            _copy(given, out, size, before, after)

    return copy


def _appended(staged: str):
    def copy(plan: list[tuple]) -> None:
        from pyarrow import fs as arrow_fs

        system, name = arrow_fs.FileSystem.from_uri(staged)
        with system.open_output_stream(name) as out:
            for part, size, _, before, after in plan:
                source, own = arrow_fs.FileSystem.from_uri(part)
                with source.open_input_stream(own) as given:
                    _copy(given, out, size, before, after)

    return copy


def _copy(given, out, size: int, before: bytes, after: bytes) -> None:
    out.write(before)
    while size:
        piece = given.read(min(size, 8 << 20))
        if not piece:
            raise OSError("a part is shorter than it was")
        out.write(piece)
        size -= len(piece)
    out.write(after)


def analysed_path(path: str, kind: str | None = None) -> str:
    """``name_analyzed.ext`` beside the input."""
    stem, dot, ext = path.rpartition(".")
    return f"{stem or ext}_analyzed.{kind or (ext if dot else 'json')}"


def write_analysed(rows: DataFrame, source: str, target: str | None = None, kind: str = "json") -> str:
    """Write a table as a folder beside its input; never over the input, nor over an earlier result."""
    target = target or analysed_path(source, kind)
    refuse_same(source, target)
    writer = rows.write.mode("errorifexists")
    writer.json(target) if kind == "json" else writer.option("header", True).option("escape", '"').csv(target)
    return target


def refuse_same(source: str, target: str) -> None:
    if target.rstrip("/") == source.rstrip("/"):
        raise ValueError("the output would replace the input")


def backup_path(path: str) -> str:
    """Where the original of a file is kept before labels are put into it."""
    return path.replace(".json", "_backup.json")


def snapshot(spark: SparkSession, pieces: Iterator[bytes], path: str) -> None:
    """Write a file whole or not at all: under a temporary name beside it, then renamed over it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, True)
    try:
        for piece in pieces:
            out.write(bytearray(piece))
        out.close()
        _rename_over(spark, fs, staged, target)
    except BaseException:
        fs.delete(staged, False)
        raise


def _rename_over(spark: SparkSession, fs, staged, target) -> None:
    """A rename that overwrites is one step: a crash leaves the old file or the new one."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(target), options)


def save_discovery_checkpoint(spark: SparkSession, path: str, source: dict, completed_pages: dict, products: int) -> None:
    state = {"version": 1, "source": source, "completed_pages": completed_pages, "product_count": products}
    snapshot(spark, iter([json.dumps(state, ensure_ascii=False, indent=2).encode()]), path)


def output_path(folder: str, market: str, words_slug: str) -> str:
    """Where the result of a search goes; an unknown marketplace counts as shopee."""
    return f"{folder.rstrip('/')}/{market if market in MARKETPLACES else 'shopee'}_ph_{words_slug or 'search'}.json"
