"""The document operators against brute force on small fixtures with every odd case."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tindera.llm.queries")
from tindera.llm import bpe, decontaminate, minhash, ngram_lm, packing, pii, token_counts, toxicity  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n long, id string, key string, rep long, score string, rank int, length string, bucket long, offset long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "naïve", "日本"]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 80))) for _ in range(40)]
    near = [t + " tail" for t in base[:8]] + [" ".join(t.split()[:-1]) for t in base[5:12]]
    long = " ".join(rnd.choice(vocabulary) for _ in range(30_000))
    odd = [None, "", "  \n\t ", "one", "One", "a b c d", "<|endoftext|> and more", "it's 'sabc  x\n\n y", long, long + " end"]
    rows = [(i, t) for i, t in enumerate(base + near + base[:6] + odd)]
    return rows + [(rows[3][0], rows[3][1]), (None, base[0]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", None, None, None, None, None, None, None) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in ("doc_id", *columns)) for r in df.collect())


def test_pretokens_equal_the_library():
    pieces, rnd = bpe.pieces_of(TOKENIZER), random.Random(3)
    alphabet = " \n\t'  'sdtmrevl aé1²漢! ​\U0001F600\r\x1c\x85"
    some = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    assert all(a.tolist() == pieces.library(t).tolist() for a, t in zip(pieces.encode(some), some))


@pytest.mark.parametrize("limit", [(token_counts.BLOCK_CHARS, token_counts.TABLE_CHARS), (1, 30_000), (20_000, 5_000)])
def test_token_counts(docs, texts, limit):
    library = bpe.pieces_of(TOKENIZER).library
    want = Counter((i, len((t or "").encode()), len(library(t or ""))) for i, t in texts)
    assert by_row(token_counts.count_tokens(docs, TOKENIZER, *limit), "n_bytes", "n_tokens") == want


def test_packing(docs, texts):
    pieces = packing.tokenize_pieces(docs, TOKENIZER)
    rows = packing.pack(pieces).collect()
    library = bpe.pieces_of(TOKENIZER).library
    want = Counter()
    for i, t in texts:
        ids = [*library(t or "").tolist(), 2]
        want.update((i, k, s, tuple(ids[s : s + n])) for k, (s, n) in enumerate(packing.cut_points(len(ids), 1024)))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= math.ceil(1.1 * sum(r.length for r in rows) / 1024) + 1
    odd = pieces.withColumns({"__part": F.lit("x"), "__rank": F.lit(1.5), "sequence_id": F.lit("old")})
    dealt = packing.pack(odd, broadcast_counts=0).collect()
    assert Counter((r.doc_id, r.piece, tuple(r.ids), r["__part"], r["__rank"]) for r in dealt) == Counter((r.doc_id, r.piece, tuple(r.ids), "x", 1.5) for r in rows)
    assert len({(r.sequence_id, r.offset) for r in dealt}) == len(dealt)
    crc = packing.tokenize_pieces(docs, TOKENIZER, payload="ids_crc32").collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in crc) == Counter((r.doc_id, r.piece, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows)


def test_plan_places_every_rank_once():
    rnd = random.Random(1)
    histogram = {n: rnd.randint(1, 300) for n in rnd.sample(range(1, 65), 40)}
    filled = {}
    for length, rank, count, first, each, offset in packing.plan(histogram, 64).tolist():
        for r in range(count):
            filled.setdefault(first + r // each, []).append((offset + r % each * length, length))
    assert sum(len(x) for x in filled.values()) == sum(histogram.values())
    for place in filled.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 64
    with pytest.raises(ValueError):
        packing.plan({65: 1}, 64)


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, texts):
    ids = [(i, shingles(t)) for i, t in texts if i is not None]
    parent = {i: i for i, _ in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in ids:
        for j, b in ids:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    want = Counter((i, len(shingles(t)), None if i is None else root(i), i is None or root(i) == i) for i, t in texts)
    assert by_row(minhash.near_duplicates(docs), "n_shingles", "component_id", "kept") == want
    left = minhash.drop_duplicates(docs).collect()
    assert Counter(r.doc_id for r in left) == Counter({i: 1 for i in parent if root(i) == i}) + Counter({None: 2})
    assert left[0].asDict().keys() == dict.fromkeys(docs.columns).keys()


@pytest.mark.parametrize("bounds", [(minhash.BLOCK_ROWS, minhash.MOST_BLOCKS), (20, minhash.MOST_BLOCKS), (20, 2)])
def test_open_buckets_lose_no_link(spark, bounds):
    """A family of copies, some within reach of each other only over others."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rnd.sample(range(120), rnd.randint(0, 14)):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    parent = dict.fromkeys(sets)
    for i in sets:
        if parent[i] is None:
            todo, parent[i] = [i], i
            while todo:
                x = todo.pop()
                for y in sets:
                    if parent[y] is None and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                        parent[y] = i
                        todo.append(y)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), minhash.THRESHOLD, *bounds).collect()
    assert len(set(parent.values())) > 5
    assert {r.doc_id: r.component_id for r in found} == parent


def test_decontamination(spark, docs, texts):
    items = [(1, texts[0][1]), (2, texts[-5][1][:400] if texts[-5][1] else "w1 w2"), (10, "One"), (11, None), (12, " -- "), (None, "w1"), (13, "nowhere to be found at all"), (1, "w1 w2 w3")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = Counter()
    for i, t in texts:
        w, hit, named = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    named |= own
        want[(i, len(w), len(hit), len(named), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    columns = ("n_words", "n_hit", "n_items", "contaminated")
    assert by_row(decontaminate.contamination(docs, benchmark), *columns) == want
    for bits in (decontaminate.FILTER_BITS, 64):  # a filter that lets nearly everything through changes nothing
        joined = decontaminate.digest(decontaminate.find_windows(docs, benchmark, broadcast_chars=0, filter_bits=bits))
        assert by_row(joined, *columns) == want
    one, two = (decontaminate.find_windows(docs, benchmark, broadcast_chars=n).selectExpr("doc_id", "n_words", "cast(spans as string) s", "cast(items as string) i") for n in (0, 10**6))
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, two.collect()))
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("order,alone", [(1, True), (2, True), (3, True), (3, False)])
def test_language_model(docs, texts, order, alone):
    tokens = [words(t) for _, t in texts]
    grams = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    corpus = [sum((grams(w, n) for w in tokens), Counter()) for n in range(1, order + 1)]
    total = sum(map(len, tokens))
    want = []
    for (i, _), w in zip(texts, tokens):
        own = [grams(w, n) if alone else Counter() for n in range(1, order + 1)]
        left = lambda g: corpus[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        score, backed = 0.0, 0
        for k in range(len(w)):
            longest = min(order, k + 1)
            for n in range(longest, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    score += math.log(max(left(g), 0.5) / max(1, total - (len(w) if alone else 0)))
                elif left(g) > 0:
                    score += math.log(left(g) / left(g[:-1]))
                    break
                else:
                    score += math.log(0.4)
                    backed += n == longest
        want.append((i is None, i or 0, len(w), backed, round(score, 4)))
    found = [(r.doc_id is None, r.doc_id or 0, r.n_words, r.n_backoff, round(r.log_score, 4)) for r in ngram_lm.score(docs, order, leave_one_out=alone, stable=order == 2, block_bytes=60_000, table_chars=40_000).collect()]
    assert [x[:4] for x in sorted(found)] == [x[:4] for x in sorted(want)]
    assert np.allclose([x[4] for x in sorted(found)], [x[4] for x in sorted(want)], atol=2e-3)


def plain(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return pii.in_order(out)


def test_plain_pii():
    rnd = random.Random(2)
    for _ in range(20_000):
        text = "".join(rnd.choice("ab@.-+_ 0123456789() é\n") for _ in range(rnd.randint(0, 40)))
        assert pii.plain_spans(text) == plain(text), text
    assert pii.plain_spans("1" * 100_000 + "@" * 1000) == []


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("write john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("jane at example dot com.", "email", "jane at example dot com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("jоhn@example.com", "email", "jоhn@example.com"),
        ("jo​hn@example.com", "email", "jo​hn@example.com"),
        ("call +one nine eight eight five five five two four eight five!", "phone", "+one nine eight eight five five five two four eight five"),
        ("ip 192[.]168[.]0[.]1 here", "ip", "192[.]168[.]0[.]1"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguised_pii(text, kind, found):
    base, every = pii.all_spans(text)
    assert set(base) <= set(every)
    assert (kind, found) in [(k, text[a:b]) for k, a, b in every]
    assert found not in pii.redacted(text)


def test_pii_rows(docs, texts, spark):
    rows = pii.find_pii(docs).collect()
    assert Counter((r.doc_id, r.spans) for r in rows) == Counter((i, pii.joined(plain(t or ""))) for i, t in texts)
    named = pii.redact(spark.createDataFrame([(1, "a@b.co and 10.0.0.1"), (2, None), (3, "")], "doc_id long, text string"))
    assert [r.text for r in named.orderBy("doc_id").collect()] == ["<EMAIL> and <IP>", None, ""]


@pytest.mark.parametrize("text", ["x @ y" + " " * 10**6, "1" * 10**6, "( " * 500_000, "dot " * 250_000, "one " * 250_000, "1 dot " * 160_000, "a@" * 500_000, "one" + " " * 10**6 + "( dot", "x at y dot " * 90_000, "(at) " * 200_000, "double " * 140_000])
def test_pii_takes_linear_time(text):
    started = time.perf_counter()
    pii.all_spans(text)
    assert time.perf_counter() - started < 30


def test_disguised_addresses_map_back():
    """Addresses disguised by rules, anywhere in a text: each is found at its own place."""
    rnd = random.Random(6)
    alike = dict(zip("aeopc", "аеорс"))
    numbers = [sorted(w, key=len)[0] for w in (("zero",), ("one",), ("two",), ("three",), ("four",), ("five",), ("six",), ("seven",), ("eight",), ("nine",))]
    for _ in range(300):
        name, host = "".join(rnd.choices("abcdefghkmnp", k=5)), "".join(rnd.choices("bcdfghkm", k=6))
        kind = rnd.randrange(6)
        if kind == 0:
            said = f"{name}{rnd.choice([' (at) ', '[at]', ' { at } ', '&#64;'])}{host}{rnd.choice([' (dot) ', '[dot]', '.', ' [.] '])}net"
        elif kind == 1:
            said = f"{name} at {host} dot net"
        elif kind == 2:
            said = "".join(alike.get(c, c) for c in f"{name}@{host}.com")
        elif kind == 3:
            said = f"{name}\u200b@{host}.\u00adnet"
        elif kind == 4:
            said = "plus " + " ".join(numbers[d] for d in rnd.choices(range(10), k=11))
        else:
            said = " dot ".join(" ".join(numbers[int(d)] for d in str(rnd.randint(10, 255))) for _ in range(4))
        before, after = "Grüße, " + "w " * rnd.randint(0, 9), rnd.choice(["", " thanks", "\nand more"])
        wanted = ("phone" if kind == 4 else "ip" if kind == 5 else "email", len(before), len(before) + len(said))
        assert wanted in pii.all_spans(before + said + after)[1], (before + said + after)


def test_toxicity(spark):
    rnd = random.Random(4)
    plain_words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(plain_words) for _ in range(rnd.randint(5, 60))]
        toxic = rnd.random() < 0.2
        if toxic:
            w.insert(rnd.randrange(len(w)), rnd.choice(["moronic", "scumbag", "vileness"]))
        if rnd.random() < (0.7 if toxic else 0.03):
            w.insert(rnd.randrange(len(w)), "muslim")
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic), "y"))
    docs = spark.createDataFrame(rows + [(None, None, "x"), (5000, "", "x")], "doc_id long, text string, score string")
    truth = spark.createDataFrame(labels + [(None, 1, "y"), (7, None, "y"), (0, labels[0][1], "y")], "doc_id long, toxic int, text string")
    fair = toxicity.fit(docs, truth)  # at the strength that the query has
    assert fair.n_swapped > 20
    plain_model = toxicity.fit(docs, truth, counterfactual=0.0)
    texts = ["word1 muslim word2", "word1 christian word2", "word1 scumbag word2"]
    a, b = fair.score_texts(texts), plain_model.score_texts(texts)
    assert abs(a[0] - a[1]) < 0.3 * abs(b[0] - b[1])
    assert a[2] > 0.7 > a[0]
    found = toxicity.score(docs, fair).collect()
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    assert sum(r.predicted == dict((x, y) for x, y, _ in labels)[r.doc_id] for r in held) >= 0.98 * len(held)
    assert len(found) == 902 and all(0 <= r.score <= 1 for r in found)
    for label in (0, 1):
        one_kind = toxicity.fit(docs, truth.withColumn("toxic", F.lit(label)))
        assert {r.score for r in toxicity.score(docs, one_kind).collect()} == {0.5} and toxicity.drop_toxic(docs, one_kind).count() == 902
    often = docs.unionAll(spark.createDataFrame([(1, f"word{i}", "x") for i in range(500)], docs.schema))
    assert toxicity.sample(often, truth).count() == toxicity.sample(docs, truth).count() <= 900
    german = [(i, ("frau dumm" if i % 3 else "mann gut") + f" w{i % 7}") for i in range(300)]
    taught = toxicity.fit(spark.createDataFrame(german, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, toxic int"))
    x, y = taught.score_texts(["eine frau", "eine mann"])
    assert taught.n_swapped > 100 and abs(x - y) < 0.1
    alone = toxicity.fit(docs, truth.limit(0))
    assert len(alone.weights) == 0 and toxicity.score(docs, alone).count() == 902
    assert docs.count() - toxicity.drop_toxic(docs, fair).count() == sum(r.predicted for r in found)


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    for out in (
        token_counts.count_tokens(empty, TOKENIZER), packing.pack(packing.tokenize_pieces(empty, TOKENIZER)), minhash.near_duplicates(empty), ngram_lm.score(empty),
        decontaminate.contamination(empty, bench), pii.find_pii(empty), minhash.drop_duplicates(empty),
        toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))),
    ):
        assert out.collect() == []
