"""The store's log, buckets and transactions."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tindera.operators import bloom, commits, store


def _products(spark, ids, price="1"):
    names = [c.split() for c in store.SCHEMAS["products"].split(", ")]
    given = {"link": F.concat(F.lit("l"), F.col("id").cast("string")), "price": F.lit(price)}
    return spark.createDataFrame([(i,) for i in ids], "id long").select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names], F.col("id").alias("ordinal"))


def _reviews(spark, ids):
    names = [c.split() for c in store.SCHEMAS["reviews"].split(", ") if not c.startswith("review_key")]
    given = {"product_link": F.concat(F.lit("l"), F.col("id").cast("string")), "content": F.lit("c")}
    return spark.createDataFrame([(i,) for i in ids], "id long").select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names], F.col("id").alias("ordinal"))


def _files(s, table="products"):
    return dict(s.log.state()[1][table].files)


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=8, most_files=1)
    s.save(_products(spark, range(200)), _reviews(spark, []))
    first = _files(s)
    s.save(_products(spark, [7], "2"), _reviews(spark, []))
    second = _files(s)
    assert len(first) == 8 and len(first.keys() & second.keys()) == 7
    s.save(_products(spark, [900], "3"), _reviews(spark, []))  # a key that no filter knows adds a file and rewrites none
    third = _files(s)
    assert second.keys() < third.keys() and len(third) == 9
    rows = {r.link: r.price for r in s.read("products").collect()}
    assert rows == {f"l{i}": "1" for i in range(200)} | {"l7": "2", "l900": "3"}
    assert {r.link: r.price for r in s.read("products", at=1).collect()} == {f"l{i}": "1" for i in range(200)}
    s.save(_products(spark, [900], "4"), _reviews(spark, []))  # its bucket has two files, more than allowed: they become one
    assert len(_files(s)) == 8 and {r.price for r in s.read("products").where("link = 'l900'").collect()} == {"4"}
    s.vacuum()
    assert s.read("products").count() == 201


def test_products_go_with_their_reviews(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=4)
    s.delete_products(spark.createDataFrame([("l1",)], "link string"))  # nothing there yet
    s.save(_products(spark, range(40)), _reviews(spark, range(40)))
    before = _files(s), _files(s, "reviews")
    s.delete_products(spark.createDataFrame([(" l1",), ("l2",), ("absent",), (None,)], "link string"))
    assert {r.link for r in s.read("products").collect()} == {r.product_link for r in s.read("reviews").collect()} == {f"l{k}" for k in range(40) if k not in (1, 2)}
    assert all(len(x.keys() - y.keys()) <= 2 for x, y in zip(before, (_files(s), _files(s, "reviews"))))
    s.delete_products(s.read("products").select("link"))
    assert s.read("products").count() == s.read("reviews").count() == 0 and store.orphans(s.read("reviews"), s.read("products")).count() == 0


def test_a_failing_table_leaves_both_as_they_were(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    s.save(_products(spark, [1, 2]), _reviews(spark, [1]))
    bad = _reviews(spark, [1, 2]).withColumn("content", F.when(F.col("ordinal") == 2, F.raise_error(F.lit("broken row"))).otherwise("x"))
    with pytest.raises(Exception, match="broken row"):
        s.save(_products(spark, [1, 3], "9"), bad)
    assert sorted((r.link, r.price) for r in s.read("products").collect()) == [("l1", "1"), ("l2", "1")] and s.read("reviews").count() == 1
    live = {f.split("/")[0] for t in ("products", "reviews") for f in _files(s, t)}
    left = {p.name for t in ("products", "reviews") for p in (tmp_path / "s" / t).iterdir() if not p.name.startswith("_")}
    assert left == live and not any((tmp_path / "s" / "products" / "_in").iterdir())


def test_two_writers_lose_nothing(spark, tmp_path):
    """Disjoint and equal buckets: rows of both are there, and ids of appends are given once."""
    where = f"file://{tmp_path}/s"
    store.Store(spark, where, buckets=4)
    errors = []

    def write(k):
        try:
            own = store.Store(spark, where, buckets=4)
            own.save(_products(spark, range(k * 10, k * 10 + 10)), _reviews(spark, [k]))
            own.append("survey_responses", _form(spark, k))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    s = store.Store(spark, where, buckets=4)
    assert not errors and sorted(r.link for r in s.read("products").collect()) == sorted(f"l{i}" for i in range(30))
    assert s.read("reviews").count() == 3 and sorted(r.id for r in s.read("survey_responses").collect()) == [1, 2, 3]
    assert {r.table: r.n for r in s.counts().collect()} == {"products": 30, "reviews": 3, "survey_responses": 3, "evaluation_runs": 0}


def _form(spark, k):
    return spark.createDataFrame([(0, str(k), "x", 1.0, 1.0, "{}")], "ordinal int, submitted_at string, shopping_frequency string, sus_score double, umux_score double, responses_json string")


def test_a_number_is_given_once(spark, tmp_path):
    log = commits.CommitLog(spark, f"file://{tmp_path}/s")
    entry = lambda k: {"t": {"add": [(f"f{k}", k, 1)], "remove": [f"f{k - 3}"], "buckets": [k]}}
    assert log.publish(1, entry(1)) and not log.publish(1, entry(2))
    for k in range(2, 2 * commits.SNAPSHOT_EVERY + 3):
        assert log.publish(k, entry(k))
    last, tables = log.state()
    assert last == 2 * commits.SNAPSHOT_EVERY + 2 and sorted(tables["t"].files) == sorted(f"f{k}" for k in range(last - 2, last + 1))
    assert sorted(log.state(5)[1]["t"].files) == ["f3", "f4", "f5"]
    assert commits.overlap(entry(4), [log.entry(3), log.entry(4)]) and not commits.overlap(entry(4), [log.entry(3)]) and commits.overlap({"t": {"buckets": [commits.ALL]}}, [log.entry(3)])


def test_bloom_filters(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3).alias("g"))
    asked = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    found = {r.key for r in bloom.within(asked, "key", keys).collect()}
    assert {f"k{i}" for i in range(500)} <= found and len(found) < 700
    assert bloom.within(asked, "key", keys.limit(0)).count() == 0
    by = bloom.build(keys, "key", bloom.words_for(170), ["g"])
    hits = keys.select("key", F.col("g").alias("own")).join(F.broadcast(by)).where(bloom.might_contain(F.col("filter"), F.col("key"))).groupBy("own", "g").count().collect()
    assert all(r["count"] >= 166 if r.own == r.g else r["count"] < 30 for r in hits) and {(r.own, r.g) for r in hits if r.own == r.g} == {(0, 0), (1, 1), (2, 2)}


def test_names_of_files_cost_little_for_each_row(spark, tmp_path):
    """A million rows of one file: a pattern that tries all places of a path takes minutes in that one task."""
    where = f"file://{tmp_path}/{'long name' * 10}/attempt/__bucket=3"
    spark.range(1_000_000).coalesce(1).write.parquet(where)
    started = time.perf_counter()
    names = spark.read.parquet(where).select(store._file_column().alias("file")).distinct().collect()
    assert time.perf_counter() - started < 15 and [r.file.split("/")[:2] for r in names] == [["attempt", "__bucket=3"]]


def test_many_keys_ask_no_filter(spark, tmp_path, monkeypatch):
    """Filters are long arrays: they are asked for few keys, once a file, and otherwise the file is read."""
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=2)
    s.save(_products(spark, range(3000)), _reviews(spark, []))
    asked = []
    real = bloom.might_contain
    monkeypatch.setattr(bloom, "might_contain", lambda *x: asked.append(x) or real(*x))
    s.save(_products(spark, range(2900, 5900), "2"), _reviews(spark, []))
    assert not asked and {r.price: r.n for r in s.read("products").groupBy("price").agg(F.count("*").alias("n")).collect()} == {"1": 2900, "2": 3000}
    s.save(_products(spark, [5, 3000], "3"), _reviews(spark, []))
    assert asked and s.read("products").where("price = '3'").count() == 2 and s.read("products").count() == 5900


def test_long_buckets_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """A bucket of more rows than a file holds is several tasks' work; links too many to be broadcast are shuffled."""
    ids = lambda s, t="reviews", c="product_link": sorted(int(r[0][1:]) for r in s.read(t).select(c).collect())
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=2)
    monkeypatch.setattr(store, "FILE_ROWS", 100)
    s.save(_products(spark, range(1000)), _reviews(spark, range(1000)))
    assert ids(s) == list(range(1000)) and len(_files(s, "reviews")) >= 10
    s.save(_products(spark, range(900, 1100), "2"), _reviews(spark, range(900, 1100)).withColumn("sentiment", F.lit("new")).withColumn("rating", F.lit(3)))
    assert ids(s) == ids(s, "products", "link") == list(range(1100)) and s.read("products").where("price = '2'").count() == 200
    assert {(r.sentiment, r.rating): r.n for r in s.read("reviews").groupBy("sentiment", "rating").agg(F.count("*").alias("n")).collect()} == {(None, None): 900, ("new", None): 100, ("new", 3): 100}
    for most, gone in ((1_000_000, range(0, 50)), (0, range(50, 120))):
        monkeypatch.setattr(store, "MOST_BROADCAST", most)
        s.delete_products(spark.createDataFrame([(f"l{k}",) for k in gone], "link string"))
        assert ids(s) == ids(s, "products", "link") == list(range(gone[-1] + 1, 1100))


def test_a_delete_shuffles_no_reviews(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=2)
    s.save(_products(spark, range(50)), _reviews(spark, range(50)))
    dealt, kind = [], type(spark.range(0))
    real = kind.repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda *x: dealt.append(x) or real(*x))
    s.delete_products(spark.createDataFrame([("l1",)], "link string"))
    assert not dealt and s.read("reviews").count() == s.read("products").count() == 49 and len(_files(s, "reviews")) <= 2


def test_a_save_stages_no_keys_and_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    """Keys follow from other fields and are longer; shuffle files would stay until the driver collects its garbage."""
    staged, real = [], commits.CommitLog.delete
    monkeypatch.setattr(commits.CommitLog, "delete", lambda self, name: (staged.append(spark.read.parquet(f"{self.folder}/{name}").columns) if "reviews/_in/" in name else None, real(self, name)))
    files = lambda: sum(b.isShuffle() for b in _blocks(spark))
    set_before, before = spark.conf.get(store.FREED), files()
    s = store.Store(spark, f"file://{tmp_path}/s", buckets=2)
    s.save(_products(spark, range(300)), _reviews(spark, range(300)))
    until = time.monotonic() + 20
    while files() > before and time.monotonic() < until:
        time.sleep(0.2)
    assert s.read("reviews").count() == 300 and staged and "review_key" not in staged[0]
    assert files() <= before and spark.conf.get(store.FREED) == set_before


def _blocks(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return [found.apply(k) for k in range(found.size())]
