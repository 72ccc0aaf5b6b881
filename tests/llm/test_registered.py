"""The registered queries without SQL, and the pipeline, against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

queries = pytest.importorskip("tindera.llm.queries")
from tindera.llm import bpe, packing, pii  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __key string, rank int, sequence_id string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(200)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 90))) for _ in range(40)]
    toxic = [" ".join([*t.split()[:20], "vermin", "scum", "idiots", *t.split()[20:40]]) for t in base[:12]]
    near = [t + " tail" for t in base[20:26]]
    private = [" ".join(f"p{k}" for k in range(30)) + " mail a.b@c.org or +49 151 2345 6789, card 4111 1111 1111 1111, host 10.0.0.1", "reach me at home dot com"]
    long = " ".join(rnd.choice(words) for _ in range(40_000))
    texts = base + toxic + near + private + [None, "", " \n ", "one", long, "<|endoftext|> x"]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [out[3], (None, base[39] + " only here and nowhere else at all"), (None, None)], toxic


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    out, _ = rows
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, "q") for i, t in out], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(40 <= i < 52)) for i in range(58)] + [(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(out[35][1].split()[:20])), (2, None), (3, "never there at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def ids_of(text):
    return [*bpe.pieces_of(public_tokenizers.path("byte_bpe_50k.json")).library(text or "").tolist(), 2]


def run(spark, name, folder):
    return queries.QUERIES[name](spark, folder).collect()


def test_op3(spark, rows, folder):
    want = Counter()
    for i, t in rows[0]:
        ids = ids_of(t)
        want.update((i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut_points(len(ids), 1024)))
    found = run(spark, "op3_best_fit_packing", folder)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    used = {}
    for r in found:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in used.values())


def test_op4(spark, rows, folder):
    ids = [(i, shingles(t)) for i, t in rows[0] if i is not None]
    parent = {i: i for i, _ in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in ids:
        for j, b in ids:
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    found = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run(spark, "op4_minhash_near_dedup", folder) if r.doc_id is not None)
    assert found == Counter((i, len(s), root(i), root(i) == i) for i, s in ids)
    assert len({root(i) for i in parent}) < len(parent) - 5


def test_op7(spark, rows, folder):
    found = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in run(spark, "op7_pii", folder))
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda t: re.sub("[^0-9]", "", t)
    good = {"email": lambda t: True, "ip": lambda t: all(int(x) <= 255 for x in t.split(".")), "card": lambda t: 14 <= len(digits(t)) <= 19 and pii.luhn(digits(t)), "phone": lambda t: 10 <= len(digits(t)) <= 15}
    for i, t in rows[0]:
        if t and len(t) > 100_000:
            continue
        spans = sorted(((m.start(), k, m.end()) for k, p in patterns.items() for m in re.finditer(p, t or "") if good[k](m[0])), key=lambda s: (s[0], list(patterns).index(s[1])))
        n = Counter(k for _, k, _ in spans)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert any(x[0] == i and x[1:6] == (n["email"], n["ip"], n["card"], n["phone"], digest) for x in found)
    assert sum(found.values()) == len(rows[0]) and any(r[0] == 59 and r[6].startswith("email:") for r in found)


def test_op9(spark, rows, folder):
    found = run(spark, "op9_toxicity", folder)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert len(found) == len(rows[0]) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in by_id.items())
    assert sum(by_id[i].predicted for i in range(40, 52)) >= 10 and sum(by_id[i].predicted for i in range(40)) == 0


def test_op10(spark, rows, folder):
    found = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op10_token_counts", folder))
    assert found == Counter((i, len((t or "").encode()), len(ids_of(t)) - 1, len(ids_of(t)) - 1 > 1024) for i, t in rows[0])


def test_op6(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[650:] = x[100]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (950, [0.0] * 16)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    found = {}
    for r in run(spark, "op6_nearest_neighbours", str(tmp_path)):
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(found) == list(range(0, 700, 50))
    for q, mine in found.items():
        score = np.round(y @ y[q], 12)
        score[q] = -9
        best = np.lexsort((np.arange(700), -score))[:5]
        assert [v for _, v, _ in sorted(mine)] == best.tolist() and np.allclose([s for *_, s in sorted(mine)], score[best])


def test_pipeline(spark, rows, folder):
    """Every stage against brute force on what its predecessor kept; clashing columns, nulls, repeated and empty rows go through."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out, toxic = rows
    kept = P.drop_toxic(spark, docs, folder)
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    assert sum(t in texts_of(texts) for t in toxic) <= 2 and all(texts[(i, t)] for i, t in out if not (40 <= (i if i is not None else 0) < 52))
    unique = P.drop_near_duplicates(spark, kept, folder)
    left = Counter((r.doc_id, r.text) for r in unique.collect())
    for (i, t), n in texts.items():
        alike = [j for j, u in texts if i is not None and j is not None and j != i and shingles(t) and 100 * len(shingles(t) & shingles(u)) >= 75 * len(shingles(t) | shingles(u))]
        assert left[(i, t)] == (0 if alike and min(alike) < i else 1 if i is not None and shingles(t) else n)
    clean = P.drop_contaminated(spark, unique, folder)
    item = out[35][1].split()[:20]
    windows = {tuple(item[k : k + 13]) for k in range(8)}

    def hit(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at = {q for k in range(len(w)) if tuple(w[k : k + 13]) in windows for q in range(k, k + 13)}
        return bool(at) and 20 * len(at) >= len(w)

    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter({k: n for k, n in left.items() if not hit(k[1])}) and any(hit(t) for _, t in left)
    safe = P.redact_pii(spark, clean, folder)
    assert safe.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in safe.collect()}
    assert texts[58][0].endswith("mail <EMAIL> or <PHONE>, card <CARD>, host <IP>") and texts[59][0] == "reach <EMAIL>"
    assert all(t is None or n == len(t) for t, n in texts.values()) and texts[60][0] is None
    packed = P.pack_sequences(spark, safe, folder).collect()
    want = Counter()
    for r in safe.collect():
        ids = ids_of(r.text)
        want.update((r.doc_id, k, tuple(ids[s : s + n])) for k, (s, n) in enumerate(packing.cut_points(len(ids), 1024)))
    assert Counter((r.doc_id, r.piece, tuple(r.ids)) for r in packed) == want
    whole = P.run(spark, folder)
    assert Counter((r.doc_id, r.piece, tuple(r.ids)) for r in whole.collect()) == want


def texts_of(counted):
    return {t for (_, t), n in counted.items() if n}


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
