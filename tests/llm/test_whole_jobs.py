"""Registered queries and the pipeline do the whole job, on small tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

queries = pytest.importorskip("tindera.llm.queries")
from tindera.llm import bpe, minhash, packing  # noqa: E402


def test_trigrams_count(spark, tmp_path):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 40))) for _ in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = lambda t: Counter(tuple(w[k : k + n]) for w in [t.split()] for n in (1, 2, 3) for k in range(len(w) - n + 1))
    corpus, total, want = sum(map(grams, texts), Counter()), sum(len(t.split()) for t in texts), {}
    for i, t in enumerate(texts):
        w, left, score, backed = t.split(), corpus - grams(t), 0.0, 0
        for k in range(len(w)):
            tries = [tuple(w[k - n + 1 : k + 1]) for n in range(min(3, k + 1), 1, -1)]
            hit = next((n for n, g in enumerate(tries) if left[g]), len(tries))
            backed += hit > 0
            ratio = left[tries[hit]] / left[tries[hit][:-1]] if hit < len(tries) else max(left[(w[k],)], 0.5) / (total - len(w))
            score += math.log(ratio) + hit * math.log(0.4)
        want[i] = (len(w), backed, score)
    found = queries.QUERIES["op1_lm_scoring"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_words, r.n_backoff) for r in found} == {i: v[:2] for i, v in want.items()}
    assert all(abs(r.log_score - want[r.doc_id][2]) < 1e-3 for r in found)


def test_token_ids_pass_through_packing(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["Haus", "the", "données", "x1"]) for _ in range(n)) for n in (0, 1, 30, 400, 3000)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library, want = bpe.pieces_of(public_tokenizers.path("byte_bpe_50k.json")).library, {}
    for i, t in enumerate(texts):
        ids = [*library(t or "").tolist(), 2]
        want |= {(i, k): ids[s : s + n] for k, (s, n) in enumerate(packing.cut_points(len(ids), 1024))}
    rows = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(r.doc_id, r.piece): list(r.ids) for r in rows} == want
    seen, pack = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda p, *a, **k: seen.append(p.columns) or pack(p, *a, **k))
    rows = queries.QUERIES["op3_best_fit_packing"](spark, str(tmp_path))
    assert "ids" in seen[0] and rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in rows.collect()} == {k: zlib.crc32(np.array(v, "<u4").tobytes()) for k, v in want.items()}


def test_clashing_ids_lose_no_text(spark):
    rnd = random.Random(6)
    a, b, c, d, e = (" ".join(f"{x}{rnd.randint(0, 999)}" for _ in range(60)) for x in "abcde")
    rows = [(3, a), (5, a), (5, b), (7, b + " end"), (8, c), (8, d), (2, d + " end"), (9, e), (9, e + " end"), (9, e)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter((r.doc_id, r.component_id) for r in minhash.near_duplicates(frame).collect())
    assert found == Counter([(3, 3), (5, 3), (5, 5), (7, 5), (8, 8), (8, 2), (2, 2), (9, 9), (9, 9), (9, 9)])
    left = [(r.doc_id, r.text) for r in minhash.drop_duplicates(frame).collect()]
    assert {x for x in left if x[0] != 9} == {(3, a), (5, b), (8, c), (2, d + " end")} and len(left) == 5


def test_open_buckets_sign_every_text_of_an_id(spark):
    """A text in an open bucket has its own signature, though others share its id."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rnd.sample(range(120), rnd.randint(0, 14)):
            own[k] = f"x{i}_{k}"
        rows.append((i, " ".join(own)))
    alone = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    other = [(i, " ".join(f"y{i}_{k}" for k in range(40))) for i, _ in rows]
    found = minhash.near_duplicates(spark.createDataFrame(rows + other, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found if r.n_shingles > 40} == set(alone.items())
    assert all(r.component_id == r.doc_id and r.kept for r in found if r.n_shingles < 40)
