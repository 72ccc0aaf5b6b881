"""URL filter, nearest neighbours, WARC, components and the pipeline."""

import glob
import json
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tindera.llm.queries")
from tindera.llm import ann, queries, url_filter, warc  # noqa: E402
from tindera.llm.components import connected_components  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 1)] + [(2000, 2000 + i) for i in range(1, 200)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in found} == {(x, root(x)) for x in parent}
    assert len(found) == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    link = '<link rel="canonical" href="{}">'.format
    refresh = '<meta content="0; url={}" http-equiv="refresh">'.format
    pages = [
        (1, "http://a.example.org/es/x", ""), (2, "http://b.net/p", link("http://a.example.org/es/y?z")), (3, "https://b.net/q", link("/p#frag")),
        (4, "http://c.org/ok", refresh("http://b.net/q")), (5, "http://d.net/free", None), (6, None, link("http://b.net/p")), (7, "no url", link("x")),
        (8, "HTTP://A.Example.ORG?x", ""), (9, "http://example.org/en/1#a", ""), (10, "http://x.com/de/1", ""), (11, "http://x.com/fr/1", link("http://x.com/de/1")), (5, "http://d.net/free", None),
        (12, "http://notexample.org.net/es/", ""), (None, "http://z.net/", link("http://b.net/p")),
    ]
    frame = spark.createDataFrame([(*p, "n") for p in pages], "page_id long, url string, html string, node string")
    found = [(r.page_id, r.host, r.path, r.rule, r.verdict, r.by) for r in url_filter.judge(frame, queries.RULES).collect()]
    want = [
        (1, "a.example.org", "/es/x", "example.org/es/", "block", "rule"), (2, "b.net", "/p", None, "block", "alias"), (3, "b.net", "/q", None, "block", "alias"),
        (4, "c.org", "/ok", "org/", "allow", "rule"), (5, "d.net", "/free", None, "allow", "default"), (5, "d.net", "/free", None, "allow", "default"), (6, "", "", None, "allow", "default"),
        (7, "", "", None, "allow", "default"), (8, "a.example.org", "", None, "allow", "default"), (9, "example.org", "/en/1", "example.org/en/1", "block", "rule"),
        (10, "x.com", "/de/1", "com/de/", "block", "rule"), (11, "x.com", "/fr/1", "com/fr/", "allow", "rule"), (12, "notexample.org.net", "/es/", None, "allow", "default"),
        (None, "z.net", "/", None, "block", "alias"),
    ]
    assert sorted(found, key=str) == sorted(want, key=str)
    redirects = spark.createDataFrame([("http://d.net/free", "http://x.com/de/2")], "source string, target string")
    assert {r.verdict for r in url_filter.judge(frame, queries.RULES, redirects).where("page_id = 5").collect()} == {"block"}
    assert url_filter.judge(frame.limit(0), queries.RULES).collect() == []


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    same = x[50].tolist()
    rows += [(2000 + i, same, 1) for i in range(40)]
    rows += [(3000, None, 1), (3050, [0.0] * 24, 1), (3100, [float("nan")] * 24, 1), (3150, [float("inf")] + [1.0] * 23, 1), (3200, [None] + [1.0] * 23, 1), (3250, [1.0, 2.0], 1), (None, same, 1), (3300, [], 1), (7, rows[7][1], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, ids int")
    found = ann.search(vectors, vectors.where("vec_id % 50 = 0"), depth=200).collect()
    ids = np.array([r[0] for r in rows[:1540]])
    y = np.array([r[1] for r in rows[:1540]], np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        score = y @ y[ids == q][0]
        score = np.where(ids == q, -9, np.round(score, 12))
        best = ids[np.lexsort((ids, -score))[:5]]
        mine = [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == 5
        hits += len(set(best) & set(mine))
        total += 5
        if q in (50, 2000):
            assert mine == best.tolist()
    assert hits >= 0.9 * total
    assert {r.query_id for r in found} == set(ids[ids % 50 == 0].tolist())
    few = ann.search(vectors.where("vec_id < 3"), vectors.where("vec_id = 0")).collect()
    assert [r.rank for r in few] == [1, 2]
    assert ann.search(vectors.where("vec_id >= 3000 and vec_id < 3200"), vectors).collect() == []


def test_nearest_neighbours_in_lists(spark):
    """Production depth, several lists that share blocks or are split, huge and tiny components, and two vectors under one queried id."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 32)) + 2 * rng.normal(size=(12, 32))[rng.integers(0, 12, 6000)]
    x[7] *= 1e200
    x[8] *= 1e-200
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, (-x[50]).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = ann.search(vectors, vectors.where("vec_id % 50 = 0")).toPandas()
    y = x / np.abs(x).max(axis=1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    asked = min(x[50].tolist(), (-x[50]).tolist())
    hits = total = 0
    for q in range(0, 6000, 50):
        own = np.array(asked) / np.linalg.norm(asked) if q == 50 else y[q]
        score = y @ own
        score[q] = -9
        best = set(np.argsort(-score)[:5].tolist())
        mine = found[found.query_id == q]
        assert len(mine) == 5 and np.allclose(mine.score, score[mine.vec_id], atol=1e-12)
        hits, total = hits + len(best & set(mine.vec_id)), total + 5
    assert hits >= 0.95 * total
    lists = ann.Lists.fit(x[:3000], 6000)
    assert len(lists.centres) == 5 and 1 <= lists.probes <= 5
    places, blocks = ann.layout({0: 10, 1: 250, 2: 40, 3: 60}, 5, 100)
    assert places == [(0, 1), (1, 3), (4, 1), (4, 1), (4, 1)] and blocks == 5


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://x/{i}", f"<p>{i % 7} é</p>" * 50) for i in range(60)] + [(100, None, None), (101, "http://x/\r\ny", ""), (59, "http://x/59", "<p>3 é</p>" * 50), (None, "http://n", "<p>1 é</p>" * 50), (102, "http://big", "z" * 400_000)]
    frame = spark.createDataFrame([(*p, "s") for p in pages], "page_id long, url string, html string, shard string").repartition(4)
    folders = [f"file://{tmp_path}/{k}" for k in "ab"]
    manifests = [warc.write_warc(f, d, shard_bytes=20_000, roll_bytes=3_000).orderBy("name").collect() for f, d in zip((frame, frame.repartition(2)), folders)]
    assert [json.loads(x) for x in open(tmp_path / "a" / "manifest.jsonl")] == [m.asDict() for m in manifests[0]]
    assert manifests[0] == manifests[1] and len(manifests[0]) > 3
    assert sum(m["records"] for m in manifests[0]) == len(pages)
    assert sorted(os.listdir(tmp_path / "a")) == sorted([m["name"] for m in manifests[0]] + [f".{m['name']}.crc" for m in manifests[0] if os.path.exists(tmp_path / "a" / f".{m['name']}.crc")] + ["manifest.jsonl"] + [x for x in os.listdir(tmp_path / "a") if x.endswith("jsonl.crc") or x.endswith("tmp.crc")])
    leader = {}
    for i, _, h in pages:
        leader[h or ""] = max(leader.get(h or "", -1), -1 if i is None else i)
    rows = warc.read_warc(spark, folders[0]).collect()
    assert len(rows) == len(pages)
    text = {i: h or "" for i, _, h in pages}
    for r in rows:
        html = text[r.page_id]
        revisit = r.page_id is not None and leader[html] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", leader[html]) if revisit else ("response", None))
        assert r.payload_digest == warc.digest(html.encode()) and r.payload_bytes == len(html.encode())
        assert (r.payload is None) == revisit and (revisit or r.payload.decode() == html)
    with pytest.raises(FileExistsError):
        warc.write_warc(frame, folders[0])
    assert warc.write_warc(frame.limit(0), f"file://{tmp_path}/c").collect() == []
    assert warc.read_warc(spark, f"file://{tmp_path}/c").collect() == []
    with pytest.raises(ValueError):
        list(warc.records(warc.page_record(1, "u", b"abc", None)[:-9]))


def test_warc_ranges(spark):
    """Ids far apart, dense ones, one that a third of all rows have, and none at all: all ranges are bounded."""
    far = [(-(1 << 62), 1), ((1 << 62) + 5, 2)]
    rows = far + [(i, i) for i in range(3000)] + [(77, 10_000 + i) for i in range(2000)] + [(None, 20_000 + i) for i in range(1500)] + [(5000, 3)] * 300
    frame = spark.createDataFrame(rows, "page_id long, k long").selectExpr("page_id", "sha1(cast(cast(k as string) as binary)) sha", "10L size")
    ranges = warc.shard_ranges(frame, 1000)
    sizes = {r.s: (r.n, r.low, r.high) for r in frame.withColumn("s", ranges.column(spark)).groupBy("s").agg(F.sum("size").alias("n"), F.min("page_id").alias("low"), F.max("page_id").alias("high")).collect()}
    assert sorted(n for n, *_ in sizes.values())[-1] == 3000 and sorted(n for n, *_ in sizes.values())[-2] <= 1000  # equal payloads of one page stay together
    assert len(sizes) < 150
    order = [x[1:] for _, x in sorted(sizes.items()) if x[1] is not None]
    assert all(a[1] <= b[0] for a, b in zip(order, order[1:]))
    again = warc.shard_ranges(frame.repartition(3), 1000)
    assert again.begins == ranges.begins
    assert warc.shard_ranges(frame.limit(0), 1000).begins == [(warc.LEAST, 0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    found, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    shape = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).map(lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v).values.tolist()))
    assert sorted(found.columns) == sorted(want.columns) and shape(found) == shape(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_stages_do_what_they_say(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tindera.llm import decontaminate, minhash, pii

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {"input": docs}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in kept.items()}
    classes = minhash.near_duplicates(kept["toxicity"]).collect()
    assert ids["near_dedup"] == {r.doc_id for r in classes if r.kept}
    bad = decontaminate.contamination(kept["near_dedup"], spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()
    assert ids["decontamination"] == ids["near_dedup"] - {r.doc_id for r in bad}
    assert ids["packing"] == ids["pii"] == ids["decontamination"] and ids["toxicity"] <= ids["input"]
    before = {r.doc_id: r.text for r in kept["decontamination"].collect()}
    assert all(r.text == pii.redacted(before[r.doc_id]) and r.n_chars == len(r.text) for r in kept["pii"].collect())
    assert all(v.columns == kept["input"].columns for k, v in kept.items() if k != "packing")
