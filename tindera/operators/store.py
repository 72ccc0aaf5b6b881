"""Four tables on Parquet under one log of commits, with upserts, appends and transactions over several tables.

A write makes new files beside the old and then one entry of the log, so readers see all of it or nothing, in all tables alike.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.numbers import reliability
from ..functions.text import iso_now, review_key
from . import bloom
from .commits import ALL, CommitLog, TableState, overlap

SCHEMAS = {
    "products": "link string, name string, platform string, category string, price string, rating double, review_count long, risk_score double, reliability_score double, source string, raw_json string, updated_at string",
    "reviews": "review_key string, product_link string, author string, rating int, reviewed_at string, content string, sentiment string, risk_detected int, raw_json string",
    "survey_responses": "id long, submitted_at string, shopping_frequency string, sus_score double, umux_score double, responses_json string",
    "evaluation_runs": "id long, run_at string, source_name string, sample_count long, accuracy double, precision double, recall double, f1 double, labels_json string, matrix_json string",
}
UPDATED = ("sentiment", "risk_detected", "raw_json")
#: Files of a bucket at most before it is written anew whole, and rows in a file.
MOST_FILES, FILE_ROWS = 8, 2_000_000
#: Keys within a file's range for which its filter is asked.  Of more, one is all but sure to pass a filter that lets one absent key in a hundred through.
MOST_ASKED = 1_000
#: Links of deleted products that are broadcast at most; for more, reviews are shuffled.
MOST_BROADCAST = 1_000_000
#: It packs the keys' hexadecimal digits to half.
CODEC = "zstd"
#: Deletes a query's shuffle files when it has run, and not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def upsert_products(existing: DataFrame, incoming: DataFrame, place: str = "ordinal") -> DataFrame:
    """All columns of the last incoming row of a link replace the stored ones; links are trimmed and blank ones skipped."""
    rows = incoming.withColumn("link", F.trim(F.coalesce("link", F.lit("")))).where("link != ''")
    columns = existing.columns
    newest = rows.groupBy("link").agg(F.max_by(F.struct(*columns), place).alias("r")).select("r.*")
    return existing.join(newest.select("link"), "link", "left_anti").select(*columns).unionByName(newest)


def product_store_rows(products: DataFrame, source: str = "", now: Column | None = None) -> DataFrame:
    """Rows of the ``products`` table out of analysed products (``ordinal`` and ``raw``, a variant), with ``ordinal``."""
    get = lambda path, kind="string": F.try_variant_get(F.col("raw"), f"$.{path}", kind)
    text = lambda path, default="": F.coalesce(F.nullif(get(path), F.lit("")), F.lit(default))
    link = F.trim(text("link"))
    is_list = F.coalesce(F.schema_of_variant(get("comments", "variant")).startswith("ARRAY"), F.lit(False))
    comments = F.when(is_list, get("comments", "array<variant>"))
    score, positive = get("sentiment_summary.risk_score", "double"), get("sentiment_summary.sentiment_ratios.positive", "double")
    rows = products.select(
        "ordinal", link.alias("link"), text("name", "Unnamed product").alias("name"), U.platform_name(U.product_platform(get("platform"), link)).alias("platform"), text("category").alias("category"),
        text("price").alias("price"), get("rating", "double").alias("rating"), F.coalesce(F.size(F.filter(comments, lambda c: F.schema_of_variant(c).startswith("OBJECT"))), F.lit(0)).cast("long").alias("review_count"),
        score.alias("risk_score"), reliability(score, positive).alias("reliability_score"), F.lit(source).alias("source"), F.to_json("raw").alias("raw_json"),
        (iso_now() if now is None else now).alias("updated_at"),
    )
    return rows.withColumn("review_count", F.greatest("review_count", F.lit(0).cast("long"))).where("link != ''")


def review_store_rows(products: DataFrame) -> DataFrame:
    """Rows of the ``reviews`` table out of the same products, without their key; ``ordinal`` is their order over all."""
    link = F.trim(F.coalesce(F.try_variant_get(F.col("raw"), "$.link", "string"), F.lit("")))
    is_list = F.coalesce(F.schema_of_variant(F.try_variant_get(F.col("raw"), "$.comments", "variant")).startswith("ARRAY"), F.lit(False))
    rows = products.select("ordinal", link.alias("product_link"), F.when(is_list, F.try_variant_get(F.col("raw"), "$.comments", "array<variant>")).alias("c")).where("product_link != ''")
    rows = rows.select("ordinal", "product_link", F.posexplode("c").alias("pos", "r")).where(F.schema_of_variant("r").startswith("OBJECT"))
    get = lambda path, kind="string": F.try_variant_get(F.col("r"), f"$.{path}", kind)
    return rows.select(
        F.struct("ordinal", "pos").alias("ordinal"), "product_link", get("author").alias("author"), get("rating", "int").alias("rating"), get("time").alias("reviewed_at"), get("content").alias("content"),
        get("sentiment_analysis.label").alias("sentiment"), F.coalesce(get("sentiment_analysis.risk.detected", "boolean"), F.lit(False)).cast("int").alias("risk_detected"), F.to_json("r").alias("raw_json"),
    )


def _own_key() -> Column:
    return review_key(F.col("product_link"), F.col("author"), F.col("reviewed_at"), F.col("content"))


def with_review_key(reviews: DataFrame) -> DataFrame:
    return reviews.withColumn("review_key", _own_key())


def upsert_reviews(existing: DataFrame, incoming: DataFrame, place: str = "ordinal") -> DataFrame:
    """A known review has only its analysis replaced, even by nulls; all else keeps its first value."""
    columns = existing.columns
    firsts = incoming.groupBy("review_key").agg(F.min_by(F.struct(*columns), place).alias("first"), F.max_by(F.struct(*UPDATED), place).alias("last"))
    joined = existing.withColumn("__old", F.lit(True)).join(firsts, "review_key", "full_outer")
    old, new = F.col("__old").isNotNull(), F.col("first").isNotNull()
    picks = []
    for c in columns:
        if c in UPDATED:
            picks.append(F.when(new, F.col(f"last.{c}")).otherwise(F.col(c)).alias(c))
        elif c == "review_key":
            picks.append(F.col(c))
        else:
            picks.append(F.when(old, F.col(c)).otherwise(F.col(f"first.{c}")).alias(c))
    return joined.select(*picks)


def numbered_rows(incoming: DataFrame, place: str = "ordinal") -> DataFrame:
    """Incoming rows with an ``id`` from 0 in order of ``place``.  Appends are single forms or runs, so they are few."""
    from .reviews import running_index

    columns = [c for c in incoming.columns if c != "id"]
    return running_index(incoming.select(*columns).withColumn("__one", F.lit(0)), place, "__one", "id").drop("__one")


def append_rows(existing: DataFrame, incoming: DataFrame, place: str = "ordinal") -> DataFrame:
    """Existing rows and the incoming ones, with ids that go on from the largest."""
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return existing.unionByName(numbered_rows(incoming, place).withColumn("id", F.col("id") + F.lit(last + 1)).select(*existing.columns))


def orphans(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Reviews whose product isn't there."""
    return reviews.join(products.select(F.col("link").alias("product_link")), "product_link", "left_anti")


def cascade(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Reviews whose product is there: what is left after products were deleted."""
    return reviews.join(products.select(F.col("link").alias("product_link")).distinct(), "product_link", "left_semi")


def _file_column() -> Column:
    """A file's name within its table's folder: the write's folder, the bucket's, and its own.  It is made for each row, so it is no pattern that tries all places of a path."""
    return F.substring_index("_metadata.file_path", "/", -3)


def _few(keys: DataFrame) -> tuple[DataFrame, bool]:
    """Keys to be broadcast, and True; or, if they are too many for that, as they are."""
    few = keys.count() <= MOST_BROADCAST
    return (F.broadcast(keys) if few else keys), few


def _columns(table: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


def _named(products: DataFrame) -> DataFrame:
    return products.withColumn("link", F.trim(F.coalesce("link", F.lit("")))).where("link != ''")


def _latest_products(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """What ``upsert_products`` leaves of stored and incoming rows, in this order."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in _columns("products") if c not in by]), order).alias("r")).select(*by, "r.*")


def _latest_reviews(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """What ``upsert_reviews`` leaves of stored and incoming rows, in this order."""
    kept = [c for c in _columns("reviews") if c not in (*by, *UPDATED)]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*kept), order).alias("first"), F.max_by(F.struct(*UPDATED), order).alias("last")).select(*by, "first.*", "last.*")


class _Freed:
    """Sessions whose shuffle files go with their queries, as long as one of their writers commits."""

    def __init__(self) -> None:
        self.lock, self.writers, self.before = threading.Lock(), Counter(), {}

    @contextmanager
    def within(self, spark: SparkSession):
        with self.lock:
            if not self.writers[spark]:
                self.before[spark] = spark.conf.get(FREED)
                spark.conf.set(FREED, "true")
            self.writers[spark] += 1
        try:
            yield
        finally:
            with self.lock:
                self.writers[spark] -= 1
                if not self.writers[spark]:
                    del self.writers[spark]
                    spark.conf.set(FREED, self.before.pop(spark))


_freed = _Freed()


class WriteConflict(RuntimeError):
    """Others committed to the same buckets each time that a transaction was tried."""


class Transaction:
    """Changes of several tables that are committed as one entry of the log, or not at all.

    Incoming rows are written once.  Each step then reads the files of its table that may hold one of their keys, and writes these
    files' rows anew with the incoming ones; all other files stay as they are.  What a failed transaction wrote is never read and is deleted.
    """

    def __init__(self, store: Store) -> None:
        self.store, self.steps, self.name, self.written = store, [], f"t{time.time_ns():020d}{uuid.uuid4().hex[:8]}", []

    def _folder(self, name: str) -> str:
        self.written.append(name)
        return f"{self.store.folder}/{name}"

    def _bucket(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.store.buckets)).cast("int")

    def _dealt(self, rows: DataFrame, key: Column, n: int) -> DataFrame:
        """Rows by bucket, and of a long one by digests within it, so that a task gets about a file of ``n`` rows in all; ``__part`` is the task."""
        buckets = self.store.buckets
        each = max(1, -(-n // (buckets * FILE_ROWS)))
        within = F.pmod(F.shiftright(F.xxhash64(key), 20), F.lit(each)).cast("int") if each > 1 else F.lit(0)
        return rows.withColumn("__part", F.col("__bucket") * each + within).repartitionById(buckets * each, F.col("__part"))  # by hash some tasks would get several

    def upsert(self, table: str, incoming: DataFrame) -> None:
        """Products by link or reviews by review key, with the results of ``upsert_products`` and ``upsert_reviews``.

        Stored and incoming rows meet in one shuffle, by bucket, and are written from there.  A key that follows from other fields
        is longer than these, so it is made again where it is needed, and neither staged nor shuffled.
        """
        key, latest, prepared, own = KEYS[table]
        spark, columns = self.store.spark, _columns(table)
        staged = self._folder(f"{table}/_in/{self.name}-{len(self.steps)}")
        made = own is not None and key not in incoming.columns
        at = F.coalesce(F.col(key), own()) if made else F.col(key)

        def stage() -> None:
            rows = prepared(incoming).withColumn("__bucket", self._bucket(own() if made else key))
            rows.select(*[c for c in columns if c != key or not made], "ordinal", "__bucket").write.option("compression", CODEC).parquet(staged)

        def apply(state: TableState, attempt: str) -> dict:
            rows = spark.read.parquet(staged)
            rows = rows.withColumn(key, F.lit(None).cast("string")) if made else rows
            touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())
            old = self.store._candidates(table, state, rows.withColumn(key, at), key, touched)
            stored = self.store._files(table, old).withColumns({"__bucket": self._bucket(key), "ordinal": F.lit(None).cast(rows.schema["ordinal"].dataType)})
            both = rows.withColumn("__new", F.lit(True)).unionByName(stored.withColumn("__new", F.lit(False)))
            dealt = self._dealt(both, at, rows.count() + sum(state.files[f][1] for f in old)).withColumn(key, at)
            added = self._write(table, latest(dealt, ["__bucket", "__part", key], F.struct("__new", "ordinal")), key, attempt)
            return {"add": added, "remove": old, "buckets": touched}

        self.steps.append((table, stage, apply))

    def delete_products(self, links: DataFrame) -> None:
        """Products by ``link``, and all their reviews with them.

        Files that hold none of either stay as they are; which review files do is found by a scan of their link column.
        """
        spark, key = self.store.spark, "link"
        staged = self._folder(f"products/_in/{self.name}-{len(self.steps)}")

        def stage() -> None:
            links.select(F.trim(key).alias(key)).where("link is not null").distinct().withColumn("__bucket", self._bucket(key)).write.option("compression", CODEC).parquet(staged)

        def products(state: TableState, attempt: str) -> dict:
            gone = spark.read.parquet(staged)
            touched = sorted(r[0] for r in gone.select("__bucket").distinct().collect())
            old = self.store._candidates("products", state, gone, key, touched)
            return self._without("products", state, old, gone.select(key), key, touched, attempt)

        def reviews(state: TableState, attempt: str) -> dict:
            gone = spark.read.parquet(staged).select(F.col(key).alias("product_link"))
            live = self.store._files("reviews", list(state.files))
            held = live.select(_file_column().alias("file"), "product_link") if state.files else live.select(F.lit("").alias("file"), "product_link")
            old = sorted(r[0] for r in held.join(_few(gone)[0], "product_link", "left_semi").select("file").distinct().collect())
            return self._without("reviews", state, old, gone, "product_link", sorted({state.files[f][0] for f in old}), attempt)

        self.steps += [("products", stage, products), ("reviews", lambda: None, reviews)]

    def _without(self, table: str, state: TableState, old: list[str], gone: DataFrame, column: str, buckets: list[int], attempt: str) -> dict:
        """Files written anew without the rows whose column is among ``gone``: from where they are read, as long as ``gone`` can be broadcast."""
        if not old:
            return {"add": [], "remove": [], "buckets": buckets}
        key = KEYS[table][0]
        gone, few = _few(gone)
        left = self.store._files(table, old).join(gone, column, "left_anti").withColumn("__bucket", self._bucket(key))
        if few:
            left = left.coalesce(max(len(old), self.store.buckets))  # no more files than before, up to those of a bucket in several tasks
        else:
            left = self._dealt(left, F.col(key), sum(state.files[f][1] for f in old))
        return {"add": self._write(table, left, key, attempt), "remove": old, "buckets": buckets}

    def append(self, table: str, rows: DataFrame, place: str = "ordinal") -> None:
        """Rows with ids that go on from the table's last; only they are written."""
        staged = self._folder(f"{table}/_in/{self.name}-{len(self.steps)}")

        def stage() -> None:
            numbered_rows(rows, place).write.parquet(staged)

        def apply(state: TableState, attempt: str) -> dict:
            found = self.store.spark.read.parquet(staged).withColumn("id", F.col("id") + state.next_id)
            added = self._write(table, found.withColumn("__bucket", F.lit(-1)), None, attempt)
            return {"add": added, "remove": [], "buckets": [-1], "next_id": state.next_id + sum(n for *_, n in added)}

        self.steps.append((table, stage, apply))

    def replace(self, table: str, rows: DataFrame) -> None:
        """All rows of a table."""
        key = KEYS[table][0] if table in KEYS else None

        def apply(state: TableState, attempt: str) -> dict:
            dealt = self._dealt(rows.withColumn("__bucket", self._bucket(key)), F.col(key), 0) if key else rows.withColumn("__bucket", F.lit(-1))
            added = self._write(table, dealt, key, attempt)
            return {"add": added, "remove": sorted(state.files), "buckets": [ALL]}

        self.steps.append((table, lambda: None, apply))

    def _write(self, table: str, rows: DataFrame, key: str | None, attempt: str) -> list[tuple[str, int, int]]:
        """Rows by bucket, from the tasks that have them; what is known of each file is written beside it.  Returns files with bucket and rows."""
        spark, data = self.store.spark, self._folder(f"{table}/{attempt}")
        shaped = rows.select(*_columns(table), "__bucket")
        shaped.write.partitionBy("__bucket").option("maxRecordsPerFile", FILE_ROWS).option("compression", CODEC).parquet(data)
        # Rows are grouped by a digest of their file's path, as long names of each row would cost more than the keys; files that shared one would share what is known.
        found = spark.read.schema(f"{SCHEMAS[table]}, __bucket int").parquet(data).withColumn("id", F.xxhash64("_metadata.file_path"))
        names = [tuple(r) for r in found.groupBy("id", _file_column().alias("file"), F.col("__bucket").alias("bucket")).agg(F.count("*").alias("n")).collect()]
        files = [(file, bucket, n) for _, file, bucket, n in names]
        if key is None or not files:
            return files
        keys = found.select("id", F.col(key).alias("key"))
        filters = bloom.build(keys, "key", bloom.words_for(max(n for *_, n in files)), ["id"])
        ends = keys.groupBy("id").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        known = spark.createDataFrame(names, "id long, file string, bucket int, n long").join(ends, "id").join(filters, "id").drop("id")
        known.write.partitionBy("bucket").parquet(self._folder(f"{table}/_known/txn={attempt}"))
        return files

    def commit(self, tries: int = 20) -> int:
        """The number of the entry that holds all changes."""
        with _freed.within(self.store.spark):
            return self._commit(tries)

    def _commit(self, tries: int) -> int:
        log = self.store.log
        try:
            for _, stage, _ in self.steps:
                stage()
            for attempt in range(tries):
                number, tables = log.state()
                made: dict[str, dict] = {}
                kept = len(self.written)
                for k, (table, _, apply) in enumerate(self.steps):
                    change = apply(tables.setdefault(table, TableState()), f"{self.name}-{attempt}-{k}")
                    tables[table].apply(change)
                    made[table] = _joined(made[table], change) if table in made else change
                while not log.publish(number + 1, made):
                    entries = log.since(number)
                    if overlap(made, entries):
                        break
                    number += len(entries)
                else:
                    self.written = [n for n in self.written if "/_in/" in n]
                    return number + 1
                self._delete(kept)
            raise WriteConflict(f"gave up after {tries} tries")
        finally:
            self._delete(0)

    def _delete(self, first: int) -> None:
        for name in self.written[first:]:
            self.store.log.delete(name)
        del self.written[first:]


def _joined(first: dict, then: dict) -> dict:
    """Two changes of a table as one: files that the second takes out of the first never come in."""
    gone = set(then["remove"])
    return {
        "add": [x for x in first["add"] if x[0] not in gone] + then["add"],
        "remove": first["remove"] + sorted(gone - {x[0] for x in first["add"]}),
        "buckets": sorted({*first["buckets"], *then["buckets"]}, key=str),
        "next_id": max(first.get("next_id", 1), then.get("next_id", 1)),
    }


class Store:
    """The tables under one folder, of any file system that Spark can write to.

    Keyed tables lie in hash buckets, so that an upsert reads and writes only files of the buckets that it touches, and of these only
    files whose least and greatest key and Bloom filter allow one of its keys.  A bucket of more than ``most_files`` files is written anew whole.
    Choose ``buckets`` so that a bucket is a task's work; it is fixed with the first commit.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, most_files: int = MOST_FILES) -> None:
        self.spark, self.folder, self.buckets, self.most_files = spark, folder.rstrip("/"), buckets, most_files
        self.log = CommitLog(spark, folder)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def _files(self, table: str, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.folder}/{table}/{f}" for f in sorted(files)])

    def _candidates(self, table: str, state: TableState, rows: DataFrame, key: str, touched: list[int]) -> list[str]:
        """Live files that may hold a key of ``rows``, and all of buckets with too many."""
        per: dict[int, list[str]] = {}
        for file, (bucket, _) in state.files.items():
            per.setdefault(bucket, []).append(file)
        live = {b: per[b] for b in touched if b in per}
        full = [f for fs in live.values() if len(fs) > self.most_files for f in fs]
        asked = [f for fs in live.values() if len(fs) <= self.most_files for f in fs]
        if not asked:
            return sorted(full)
        schema = "file string, n long, lo string, hi string, filter array<long>, txn string, bucket int"
        base, folders = f"{self.folder}/{table}/_known", sorted({f.split("/")[0] for f in asked})
        known = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/txn={t}" for t in folders])
        known = known.where(F.col("bucket").isin(sorted(live))).join(self.spark.createDataFrame([(f,) for f in asked], "file string"), "file", "left_semi")
        # Keys by file, without the filters: these are long, and a join would give each key a copy.
        keys = rows.select(F.col(key).alias("key"), F.col("__bucket").alias("bucket"))
        spans = known.select("file", "bucket", "lo", "hi")
        inside = keys.join(F.broadcast(spans), "bucket").where((F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi")))
        counts = {r[0]: r[1] for r in inside.groupBy("file").agg(F.count("*")).collect()}
        sure = {f for f, n in counts.items() if n > MOST_ASKED}
        few = [f for f, n in counts.items() if n <= MOST_ASKED]
        if few:
            own = inside.where(F.col("file").isin(few)).groupBy("file").agg(F.collect_set("key").alias("keys"))
            hit = own.join(known.select("file", "filter"), "file").where(F.exists("keys", lambda k: bloom.might_contain(F.col("filter"), k)))
            sure |= {r[0] for r in hit.select("file").collect()}
        return sorted(sure | set(full))

    def read(self, table: str, at: int | None = None) -> DataFrame:
        """A table as of the last commit, or of an earlier one; an absent table is empty."""
        return self._files(table, list(self.log.state(at)[1].get(table, TableState()).files))

    def replace(self, table: str, rows: DataFrame) -> None:
        tx = self.transaction()
        tx.replace(table, rows)
        tx.commit()

    def save(self, products: DataFrame, reviews: DataFrame) -> int:
        """Products and their reviews in one commit."""
        tx = self.transaction()
        tx.upsert("products", products)
        tx.upsert("reviews", reviews.drop("review_key"))
        return tx.commit()

    def save_products(self, products: DataFrame, source: str = "") -> int:
        """Analysed products (``ordinal`` and ``raw``) with their reviews, by link and by review key."""
        return self.save(product_store_rows(products, source), review_store_rows(products))

    def delete_products(self, links: DataFrame) -> int:
        """Products by ``link`` with their reviews, in one commit."""
        tx = self.transaction()
        tx.delete_products(links)
        return tx.commit()

    def append(self, table: str, rows: DataFrame) -> int:
        tx = self.transaction()
        tx.append(table, rows)
        return tx.commit()

    def counts(self) -> DataFrame:
        """(table, n) of all tables, from the log alone."""
        tables = self.log.state()[1]
        return self.spark.createDataFrame([(t, sum(n for _, n in tables.get(t, TableState()).files.values())) for t in SCHEMAS], "table string, n long")

    def vacuum(self, keep: int = 2) -> None:
        """Delete files that the last ``keep`` commits have no use for; readers of older states lose theirs."""
        last, _ = self.log.state()
        for number in range(1, last - keep + 2):
            for table, change in self.log.entry(number)["tables"].items():
                for file in change["remove"]:
                    self.log.delete(f"{table}/{file}")


#: Key, what is left of a key's rows, what is done to incoming ones, and the key as it follows from other fields.
KEYS = {"products": ("link", _latest_products, _named, None), "reviews": ("review_key", _latest_reviews, lambda rows: rows, _own_key)}
