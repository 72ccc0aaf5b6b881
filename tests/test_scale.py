"""What holds at any size, on small tables, against plain loops."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tindera.functions import word_file
from tindera.operators import deep_pages, qualification, reviews, scan, states, summary
from tindera.operators.analyses import Analyses
from tindera.plans import analyse
from tindera.plans.registry import model
from tindera.sources import json_lists, products
from tindera.streaming import collect, paging


def test_one_product_in_many_tasks(spark):
    """Numbers, changes and runs of a product that has nearly all rows, and tasks of even size."""
    rnd = random.Random(1)
    rows = [("big", k, rnd.choice(["a", "a", "b", None])) for k in range(4000)] + [("small", k, "x") for k in range(5)]
    frame = spark.createDataFrame(rows, "product string, at long, v string").repartition(6)
    ordered = scan.Ordered(frame, ["product"], ["at"], 8)
    sizes = [r["count"] for r in ordered.rows.groupBy(ordered.task).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[4]
    found = {(r["product"], r.at): (r.number, r.changed, r.unchanged_for) for r in scan.changes(frame, ["product"], ["at"], F.col("v"), 8).collect()}
    want, last = {}, {}
    for p, at, v in rows:
        n, before, run = last.get(p, (0, None, 0))
        changed = None if n == 0 else v != before
        run = 0 if changed or n == 0 else run + 1
        last[p] = (n + 1, v, run)
        want[(p, at)] = (n + 1, changed, run)
    assert found == want
    sums = ordered.running(sums={"total": F.col("at")}, maxima={"top": F.when(F.col("v") == "b", F.col("at"))}).result().where("product = 'big' and at = 3999").first()
    assert sums.total == sum(range(4000)) and sums.top == max(k for p, k, v in rows if v == "b")


def _walk(log, snapshot):
    out = {}
    for p in {p for p, *_ in log} | set(snapshot):
        state, upto = snapshot.get(p, ("discovered", None))
        bad = 0
        for _, seq, event in sorted(x for x in log if x[0] == p):
            if upto is None or seq > upto:
                bad += event not in states.TRANSITIONS[state]
                state, upto = states.TRANSITIONS[state].get(event, state), seq
        out[p] = (state, upto, bad)
    return out


def test_states_of_a_long_log(spark):
    rnd = random.Random(2)
    events = [*sorted({e for m in states.TRANSITIONS.values() for e in m}), "unheard of"]
    log = [("p", k, rnd.choice(events)) for k in rnd.sample(range(5000), 900)] + [(f"q{i}", k, rnd.choice(events)) for i in range(20) for k in range(i)]
    frame = spark.createDataFrame(log, "product string, seq long, event string")
    snapshot = {"p": ("complete", 2500), "q7": ("rejected", 3), "only": ("scraping", 9)}
    held = spark.createDataFrame([(p, s, n) for p, (s, n) in snapshot.items()], "product string, state string, upto long")
    for stretch in (8, 1024):
        assert {r["product"]: (r.state, r.upto, r.forbidden) for r in states.replay(frame, stretch=stretch).collect()} == _walk(log, {})
        assert {r["product"]: (r.state, r.upto, r.forbidden) for r in states.replay(frame, held, stretch=stretch).collect()} == _walk(log, snapshot)
    assert states.forbidden_events(frame).count() == sum(e == "unheard of" for *_, e in log)


def test_deep_pages(spark):
    """All pages of rows with ties and nulls, by number and text, in both directions."""
    rnd = random.Random(3)
    rows = [(k, rnd.choice([None, 1.0, 1.0, 2.5, rnd.random()]), rnd.choice([None, "x", "x", f"t{rnd.randint(0, 40)}"])) for k in range(400)]
    frame = spark.createDataFrame(rows, "id long, price double, name string")
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or "", r[0])
    want = [r[0] for r in sorted(rows, key=key)]
    by = [deep_pages.By("price", descending=True), deep_pages.By("name"), deep_pages.By("id")]
    for number, ranges in ((0, 16), (7, 2), (19, 16), (21, 3), (39, 2), (99, 4)):
        got = deep_pages.deep_page(frame, by, number, 10, most=20, ranges=ranges).collect()
        at = min(number, 39)
        assert [r.id for r in got] == want[10 * at : 10 * at + 10] and {(r.page, r.pages) for r in got} == {(at, 40)}
    texts = [deep_pages.By("name"), deep_pages.By("id", descending=True)]
    want = [r[0] for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or "", -r[0]))]
    for number, ranges in ((0, 8), (5, 2), (17, 8), (30, 3)):
        assert [r.id for r in deep_pages.deep_page(frame, texts, number, 9, most=5, ranges=ranges).collect()] == want[9 * number : 9 * number + 9]
    assert deep_pages.deep_page(frame.limit(0), by, 3, 10).collect() == []
    plan = deep_pages.deep_page(frame, by, 20, 10, most=20, ranges=16)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Filter" in plan


def test_ranges_of_a_deep_page_cost_little_for_each_row(spark):
    """Rows are dealt to 511 ranges; comparing each with every edge takes a second for some ten thousand rows.  The condition of a range says the same."""
    rows = spark.range(1_500_000, numPartitions=4).select("id", F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(5000)) / 8).alias("price"))
    for by in (deep_pages.By("price"), deep_pages.By("price", descending=True)):
        edges = deep_pages._edges(rows, by, 256)
        started = time.perf_counter()
        counts = {r.k: r["count"] for r in rows.groupBy(deep_pages._range_of(by, edges).alias("k")).count().collect()}
        assert time.perf_counter() - started < 10 and sum(counts.values()) == 1_500_000
        for k in (0, 1, 100, 101, 2 * len(edges), 2 * len(edges) + 1):
            assert rows.where(deep_pages._in_range(by, edges, k)).count() == counts.get(k, 0)


def test_decisions_come_back(spark):
    rows = [("a", "4.0", 100), ("b", "3.9", 99), ("c", None, None)]
    products = spark.createDataFrame([(*r, ["x"], "complete") for r in rows], "link string, rating string, total_rating int, comments array<string>, review_status string")
    made = qualification.apply_qualification(products, 4.0, 100, checked_at=F.lit("2026-01-01"))
    got = {r.link: r for r in made.collect()}
    assert got["a"].review_status == "complete" and got["a"].review_checkpoint is None and got["a"].comments == ["x"]
    assert got["b"].review_status == "not_qualified" and got["b"].comments == [] and got["b"].review_checkpoint.asDict() == {"context": "qualification", "completed_pages": 0, "collected_reviews": 0, "stop_reason": "not_qualified", "updated_at": "2026-01-01"}
    assert got["c"].qualification.asDict() == {"status": "rejected", "rating": 0.0, "reported_review_count": 0, "min_rating": 4.0, "min_reviews": 100, "reasons": ["rating_below_minimum", "review_count_below_minimum"], "checked_at": "2026-01-01"}
    history = qualification.decisions(made)
    skip = lambda *minima: {r.link for r in qualification.to_check(products, history, *minima).where("skip").collect()}
    assert skip(4.0, 100) == {"b", "c"} and skip(3.5, 50) == set()
    later = qualification.decisions(qualification.apply_qualification(products, 3.5, 50, checked_at=F.lit("2026-02-01")))
    both = history.unionByName(later)
    assert {r.link for r in qualification.to_check(products, both, 4.0, 100, F.lit("2026-01-15")).where("skip").collect()} == {"b", "c"}
    assert {r.link for r in qualification.to_check(products, both, 3.5, 50).where("skip").collect()} == {"c"}


def test_analyses_are_made_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "this is trash"), (2, "this is trash"), (3, None), (4, ""), (5, "fine")], "id int, text string").withColumn("digest", F.lit("mine"))
    store = Analyses(spark, f"file://{tmp_path}/a", model())
    assert store.known().count() == 0 and store.add(rows, "text") == 3 and store.add(rows, "text") == 0
    assert store.add(spark.createDataFrame([(6, "fine"), (7, "new")], "id int, text string"), "text") == 1
    found = {r.id: (r.digest, r.analysis.risk.detected) for r in store.attach(rows, "text").collect()}
    assert found == {1: ("mine", True), 2: ("mine", True), 3: ("mine", False), 4: ("mine", False), 5: ("mine", False)}
    other = model()
    other.version = "next"
    assert Analyses(spark, f"file://{tmp_path}/a", other).add(rows, "text") == 3


def test_the_users_columns_stay(spark, tmp_path):
    """Columns of a file with the names of helpers keep their values."""
    (tmp_path / "r.csv").write_text("content,fingerprint,row_no,text,at,part,__text,base,rank\ngood,mine,a,b,c,d,e,f,g\ngood,own,h,i,j,k,l,m,n\n")
    target = analyse.analyse_file(spark, str(tmp_path / "r.csv"), model())
    made = spark.read.option("header", True).csv(target).collect()
    assert [[r[c] for c in ("fingerprint", "row_no", "text", "at", "part", "__text", "base", "rank")] for r in made] == [list(x) for x in (["mine", *"abcdefg"], ["own", *"hijklmn"])]
    assert [r.is_duplicate for r in made] == ["False", "True"] and [r.duplicate_of for r in made][1] == "0"
    frame = spark.createDataFrame([("l", 1, "k", "x"), ("l", 2, "k", "y")], "link string, pos int, key string, first_place string")
    marked = reviews.mark_duplicates(frame, F.col("key").cast("binary"), name="own").orderBy("pos").collect()
    assert [(r.first_place, r.duplicate_of) for r in marked] == [("x", None), ("y", 1)]


def test_a_result_keeps_its_form(spark, tmp_path):
    import json

    path = tmp_path / "lazada_ph_x.json"
    path.write_text(json.dumps({"query": "lamp", "products": [{"link": "x", "comments": [{"content": "this is trash"}]}], "note": [1]}))
    analyse.save_back(spark, str(path), model())
    kept = json.loads(path.read_text())
    assert kept["query"] == "lamp" and kept["note"] == [1] and kept["products"][0]["comments"][0]["sentiment_analysis"]["risk"]["detected"] is True


def _collection(pages, known, limit, most):
    """(pages, count, reason, reviews) of one product, step by step."""
    seen, taken = set(known), []
    if len(seen) >= limit:
        return 0, len(seen), "target_reached", []
    for k, (found, signature, outcome, ids) in enumerate(pages[:most], 1):
        if not found:
            return (0, len(known), "no_reviews", []) if k == 1 else (k, len(seen), "review_container_missing", taken)
        if not ids:
            return k, len(seen), "empty_review_page", taken
        for i in ids:
            if len(seen) < limit and i not in seen:
                seen.add(i)
                taken.append(i)
        follows = pages[k][1] if k < min(most, len(pages)) else None
        reason = "target_reached" if len(seen) >= limit else "missing_page_signature" if not signature else outcome or ("page_signature_timeout" if follows == signature else "max_review_pages_reached" if k == most else None)
        if reason:
            return k, len(seen), reason, taken
    return min(len(pages), most), len(seen), None, taken


def test_collections_against_a_loop(spark):
    rnd = random.Random(4)
    plans, seen = {}, set()
    for p in range(60):
        pages = [(rnd.random() > 0.05, rnd.choice(["s1", "s2", "s3", "s4", f"u{k}", f"v{k}", ""] if rnd.random() < 0.2 else [f"u{k}"]), rnd.choice([None] * 12 + ["next_button_disabled"]), [f"i{rnd.randint(0, 25)}" for _ in range(rnd.choice([0, 3, 3, 3, 3, 4]))]) for k in range(rnd.randint(1, 8))]
        plans[f"p{p}"] = (pages, {f"i{rnd.randint(0, 25)}" for _ in range(rnd.randint(0, 4))}, rnd.choice([2, 8, 20]))
    frame = lambda rows, kind: spark.createDataFrame(rows, f"product string, context string, {kind}")
    pages = frame([(p, "all", k, f, s, o) for p, (own, _, _) in plans.items() for k, (f, s, o, _) in enumerate(own, 1)], "page long, found boolean, signature string, outcome string")
    found = frame([(p, "all", k, n, i) for p, (own, _, _) in plans.items() for k, (*_, ids) in enumerate(own, 1) for n, i in enumerate(ids)], "page long, pos long, identity string")
    stored = frame([(p, "all", i) for p, (_, known, _) in plans.items() for i in known], "identity string")
    plan = frame([(p, "all", n, 0, 0) for p, (_, _, n) in plans.items()], "limit long, reported long, done_pages long")
    want = {p: _collection(*x, 6) for p, x in plans.items()}
    got = {r["product"]: (r.completed_pages, r.collected_reviews, r.stop_reason) for r in paging.fold_pages(pages, found, stored, plan, 6).collect()}
    assert got == {p: x[:3] for p, x in want.items()} and len({x[2] for x in want.values()}) >= 7
    kept = {}
    for r in paging.kept_reviews(pages, found, stored, plan, 6).orderBy("product", "rank").collect():
        kept.setdefault(r["product"], []).append((r.identity, r["rank"] - len(plans[r["product"]][1])))
    assert kept == {p: [(i, k) for k, i in enumerate(x[3], 1)] for p, x in want.items() if x[3]}
    with pytest.raises(ValueError):
        paging.Reasons(empty="no such reason")


def test_new_links_thin_the_store(spark):
    found = spark.createDataFrame([(f"l{k % 50}", k) for k in range(100)], "link string, ordinal long")
    stored = spark.range(30, 4000).select(F.concat(F.lit("l"), "id").alias("link"))
    new = collect.new_only(found, stored)
    assert {r.link: r.ordinal for r in new.collect()} == {f"l{k}": k for k in range(30)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = collect.new_only(found, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    anti = plan[plan.index("LeftAnti") :]
    assert "getbit" in anti and anti.rindex("Exchange hashpartitioning(link", 0, anti.index("getbit")) < anti.index("getbit")


def test_mapped_words(spark):
    """A shipped dictionary is a mapping like another one, and a model scores alike with it."""
    import pickle

    from tindera.functions.word_file import ship
    from tindera.operators.text_model import TextModel

    rnd = random.Random(6)
    given = {"".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6))): rnd.randint(-4, 4) / 2 for _ in range(800)} | {"": 1.0, "lovely": 2.8, "awful": -2.0}
    shipped = ship(spark.createDataFrame([*given.items(), (None, 1.0)], "token string, valence double").repartition(3))
    assert dict(shipped) == given and len(shipped) == len(given) and "missing" not in shipped and shipped.get("missing") is None
    assert len(pickle.dumps(shipped)) < 300
    texts = [" ".join(rnd.choice([*given, "not", "very", "missing"]) for _ in range(12)) for _ in range(60)] + ["lovely but awful", None, "sira lovely"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").repartition(2)
    scored = [[r.a for r in frame.select("k", TextModel(dictionary=d).analyse(F.col("text")).alias("a")).orderBy("k").collect()] for d in (given, shipped)]
    assert scored[0] == scored[1] and any(e.category == "vader" for a in scored[1] for e in a.sentiment_evidence)
    assert len(ship(spark.createDataFrame([], "token string, valence double"))) == 0
    with pytest.raises(ValueError):
        ship(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "token string, valence double"), most=1)


def test_free_texts_are_no_labels(spark):
    from tindera.operators import evaluation

    pairs = evaluation.pair_counts(spark.range(30).select(F.concat(F.lit("t"), "id").alias("a"), F.lit("x").alias("b")), F.col("a"), F.col("b"))
    assert evaluation.confusion_matrix(pairs, 31).count() == 31 * 31
    with pytest.raises(Exception, match="more than 30 labels"):
        evaluation.confusion_matrix(pairs, 30).collect()


def test_workers_hold_small_batches(spark):
    """Texts of a large task come to the text model, and to a dictionary's lookups, in bounded batches."""
    sizes = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    for use in (lambda: summary.judge_reviews(rows, model()), lambda: summary.analyse_reviews(rows, model()), lambda: word_file.ship(spark.createDataFrame([("a", 1.0)], "token string, valence double"))):
        for key in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(key)
        rows = spark.range(20_000, numPartitions=1).withColumn("content", F.lit("x"))
        use()
        assert rows.agg(F.max(sizes("id"))).first()[0] <= 4000


def test_collect_stream_by_buckets(spark, tmp_path):
    """Python and state are by bucket: three batches of 300 products, of which every third ends at the target, keep a state row a bucket."""
    kind = "product string, identity string, page long, pos long"
    for step in range(3):
        spark.createDataFrame([(f"p{k}", f"i{step}" if k % 3 == 0 else "same", step, 0) for k in range(300)] * 2, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{step}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    made = collect.collect_stream(stream, 2, buckets=4)
    running = made.writeStream.format("memory").queryName("by_buckets").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    running.processAllAvailable()
    kept = max(p["stateOperators"][0]["numRowsTotal"] for p in running.recentProgress if p["stateOperators"])
    running.stop()
    found = {(r["product"], r.new_reviews, r.collected, r.stop_reason) for r in spark.sql("select * from by_buckets").collect()}
    ends = [{(1, 1, None), (1, 2, "target_reached"), (0, 2, "target_reached")}, {(1, 1, None), (0, 1, None)}, {(1, 1, None), (0, 1, None)}]
    assert kept <= 4 and found == {(f"p{k}", *end) for k in range(300) for end in ends[k % 3]}


def test_pages_stream_by_buckets(spark, tmp_path):
    """Collections share a bucket's Python call; each has its own state, and a stream that stops and goes on again does as the batch fold does."""
    keys, rows = "product string, context string", []
    shown = lambda k, page: [f"{k}-{page}-{i}" for i in range(2)] if k % 4 else [f"{k}-same-{i}" for i in range(2)]
    for k in range(60):
        rows += [(f"p{k}", "all", page, k % 7 > 0 or page > 1, "same" if k % 5 == 0 else f"s{page}", None, [(i, x) for i, x in enumerate(shown(k, page))]) for page in range(1, 7)]
    pages = spark.createDataFrame(rows, f"{keys}, page long, found boolean, signature string, outcome string, reviews array<struct<pos: bigint, identity: string>>")
    reviews_ = pages.select("product", "context", "page", F.inline("reviews"))
    stored = spark.createDataFrame([(f"p{k}", "all", x) for k in range(0, 60, 3) for x in shown(k, 1)], f"{keys}, identity string")
    plan = spark.createDataFrame([(f"p{k}", "all", 2 if k % 9 == 0 else 7, k % 2, 0) for k in range(60)], f"{keys}, limit long, reported long, done_pages long")
    known = stored.groupBy("product", "context").agg(F.collect_set("identity").alias("identities"))
    begun = plan.join(known, ["product", "context"], "left").withColumn("identities", F.coalesce("identities", F.array().cast("array<string>")))
    found = {}

    def save(batch, number):
        found.update({r["product"]: (r.completed_pages, r.collected_reviews, r.stop_reason) for r in batch.collect()})

    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for step in range(3):
            pages.where(F.col("page").isin(2 * step + 1, 2 * step + 2)).repartition(3).write.parquet(f"{tmp_path}/in/{step}")
            stream = spark.readStream.schema(pages.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
            made = paging.pages_stream(stream, begun, 6, buckets=5).writeStream.foreachBatch(save).outputMode("update")
            made.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider)
    want = {r["product"]: (r.completed_pages, r.collected_reviews, r.stop_reason) for r in paging.fold_pages(pages.drop("reviews"), reviews_, stored, plan, 6).collect()}
    assert found == want and len({w[2] for w in want.values()}) >= 4


def test_only_words_with_a_value_are_weighed(monkeypatch):
    """A long text is scored by its words with a value; marks, repeats and ``but`` count as in a plain loop over all words."""
    from tindera.functions import polarity

    rules, weighed, plain = polarity.Polarity({"good": 1.9, "bad": -2.5, "meh": 0.0}), [], polarity.Polarity._valence
    monkeypatch.setattr(polarity.Polarity, "_valence", lambda self, words, i: weighed.append(words[i]) or plain(self, words, i))
    text = " ".join([f"word{k}" for k in range(1000)] + ["very", "good,", "but", "(bad)", "bad,", "good", "meh"])
    found = rules.scores(text)
    assert sorted(weighed) == ["bad", "good", "meh"]
    words = rules.tokens(text)
    first = {w: plain(rules, words, words.index(w)) if w in rules.valences else 0.0 for w in words}
    values = [first[w] * (0.5 if i < words.index("but") else 1.5 if i > words.index("but") else 1) for i, w in enumerate(words)]
    assert words[-6:] == ["good", "but", "(bad)", "bad", "good", "meh"] and found[3] == round(sum(values) / (sum(values) ** 2 + 15) ** 0.5, 4)
    assert model().negated("a text of any length")(7) is False


def test_one_file_by_tasks(spark, tmp_path):
    """Files of one form are written by tasks, byte for byte as through the driver, also over an older file; nothing of them is collected."""
    from tindera.sources import sinks

    rows = spark.range(500).repartition(7).select("id", F.concat(F.lit('₱ "x",\n'), "id").alias("b"), F.lit(None).cast("double").alias("c"), (F.col("id") / 3).alias("d"), (F.col("id") % 2 == 0).alias("e")).orderBy("id")
    folder = f"file://{tmp_path}/a b"
    for frame in (rows, rows.limit(0)):
        want_json, want_csv = b"".join(sinks.json_array(frame, before=b"{", after=b"}")), b"".join(sinks.csv_export(frame, ["b", "id", "none", "d", "e"]))
        for name in ("o.json", "o.csv"):
            sinks.snapshot(spark, iter([b"older"]), f"{folder}/{name}")
        sinks.write_json_array(frame, f"{folder}/o.json", before=b"{", after=b"}")
        sinks.write_csv(frame, f"{folder}/o.csv", ["b", "id", "none", "d", "e"])
        for name, want in (("o.json", want_json), ("o.csv", want_csv)):
            assert (tmp_path / "a b" / name).read_bytes() == want
            assert spark.read.text(f"{folder}/{name}", wholetext=True).count() == (1 if want else 0) or not want
        assert not [p for p in (tmp_path / "a b").iterdir() if p.name.endswith(".tmp")]
    plan = [(f"{tmp_path}/p{k}", 2, 0, b"<" if k == 0 else b"", b">" if k else b"") for k in range(2)]
    for part, *_ in plan:
        open(part, "wb").write(b"abc")
    sinks._appended(f"{folder.replace(' ', '%20')}/joined")(plan)
    assert (tmp_path / "a b" / "joined").read_bytes() == b"<abab>"


def test_long_product_files_are_read_in_splits(spark, tmp_path, monkeypatch):
    """Whatever stands in texts and wherever splits end, elements, fields and errors are those of a file that is read whole."""
    odd = ['a, b "c" \\ ]}[{', "é₱,\\", "\\\"", ",", "", "products"]
    rows = [None, 7, "x, y", [1, [2, 3]], True, {}] + [{"n": k, odd[k % 6]: [odd[(k + 1) % 6], {"d": odd[k % 6] * 3, "e": [k, k]}]} for k in range(60)]
    dump = lambda x, indent=None: json.dumps(x, ensure_ascii=False, indent=indent)
    files = {"list": "\ufeff" + dump(rows), "last": dump({"a": [1, {"products": [2]}], "b,": odd, "products": rows}, 1) + "\n ", "first": dump({"products": rows, "z": 1}), "only": dump({"products": rows}), "none": dump({"a": 1, "b": 2}), "empty": " [ ] ", "blank": dump({"x": 1, "products": [], "y": 2})}
    bad = {"open": dump(rows)[:-1], "two": '{"products": [1], "products": [2]}', "kind": '{"products": 5, "a": 1}', "gap": "[1,, 2]", "pair": '[{"a": 1} {"b": 2}, 3]', "tail": '{"products": [1], "a": }'}
    for name, text in (files | bad).items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    shown = lambda: sorted((r.name, r.ordinal, r.j) for r in products.read_elements(spark, str(tmp_path), strict=False).select(F.element_at(F.split("path", "/"), -1).alias("name"), "ordinal", F.to_json("raw").alias("j")).collect())
    whole = shown()
    fields = {n: products.outer_fields(spark, f"{tmp_path}/{n}.json") for n in files}
    monkeypatch.setattr(products, "WHOLE_BYTES", 1)
    monkeypatch.setattr(json_lists, "CHUNK_BYTES", 100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert shown() == whole and len({n for n, *_ in whole}) == 4 and len(whole) == 4 * len(rows)
        assert {n: products.outer_fields(spark, f"{tmp_path}/{n}.json") for n in files} == fields
        for name in bad:
            with pytest.raises(Exception, match="no list of products"):
                products.read_elements(spark, f"{tmp_path}/{name}.json").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
