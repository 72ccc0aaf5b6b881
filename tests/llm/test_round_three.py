"""Shards by hash tree, fill-in-middle and the prefix trie on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

queries = pytest.importorskip("tindera.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from tindera.llm import fim, prefix_trie, scan, sharding, toxicity  # noqa: E402

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    out = [(k, " ".join(rnd.choice(["Haus", "the", "données", "x1\n", "\t"]) for _ in range(rnd.randint(0, 60)))) for k in range(300)]
    long = " ".join(f"w{k}" for k in range(60_000))
    odd = [(300, None), (301, ""), (302, " \n "), (303, "a <P> b"), (304, "<S"), (305, long), (306, "é\x1cé  \x0b😀 "), (307, "<<S<M"), (None, "no id"), (None, None), (3, "other text of 3"), (-5, "minus"), (310, long.replace(" ", ""))]
    return out + odd + [out[3]] * 4


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2.0) for i, t in texts], "doc_id long, text string, shard string, place int, output double").repartition(5)


def test_hash_tree(spark, texts, docs):
    found = sharding.assign(docs, sharding.layout(), group_rows=8, chunk=2).collect()
    size = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((i, *size(t)) for i, t in texts)
    for shard in range(8):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(sum(r.shard == shard for r in found)))
    assert all(r.grown_shard in (r.shard, 8) for r in found) and 10 < sum(r.grown_shard == 8 for r in found) < 70
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in found}) == len({i for i, _ in texts})
    assert sharding.assign(docs.limit(0), sharding.layout()).collect() == []
    whole = sharding.assign(docs, sharding.layout()).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, found))


def test_weights_and_confined_movement(spark):
    """A shard that weighs more draws rows into its region and rack only; shares follow the weights."""
    keys = spark.range(40_000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.layout(3, 2, 2)
    heavier = [(r, k, s, 3.0 if s == 0 else w) for r, k, s, w in tree]
    rows = keys.select(sharding.descend(F.col("k"), tree).alias("a"), sharding.descend(F.col("k"), heavier).alias("b")).groupBy("a", "b").count().collect()
    moved = {(r.a, r.b): r["count"] for r in rows if r.a != r.b}
    assert moved and all(b // 4 == 0 for _, b in moved)  # into region 0 only
    assert all(b // 2 == 0 for a, b in moved if a // 4 == 0)  # within it into rack 0 only
    assert all(b == 0 for a, b in moved if a // 2 == 0)  # within that into shard 0 only
    share = Counter()
    for r in rows:
        share[r.b] += r["count"] / 40_000
    assert abs(share[0] - 3 / 14) < 0.01 and all(abs(share[s] - 1 / 14) < 0.01 for s in range(1, 12))
    with pytest.raises(ValueError):
        sharding.descend(F.col("k"), [("r0", "r0/k0", 0, 0.0)])


def test_fill_in_middle(spark, texts, docs):
    rows = fim.rearrange(docs)
    rows = rows.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter()
    for i, t in texts:
        t, units = t or "", UNIT.findall(t or "")
        h = [int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
            want[(i, len(units), "plain", None, None, t, t)] += 1
        elif h[3] % 100 < 80:
            want[(i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t)] += 1
        else:
            want[(i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t)] += 1
    assert Counter(map(tuple, rows)) == want and {k[2] for k in want} == {"plain", "spm", "psm"}
    assert fim.rearrange(docs.limit(0)).collect() == []


def test_every_odd_text_comes_back(spark):
    """All forms of texts that are made of marks' parts, at every cut."""
    rnd = random.Random(1)
    data = [(k, "".join(rnd.choice(["<", "S", "P", ">", "M", " ", "é", "\n"]) for _ in range(rnd.randint(0, 9)))) for k in range(2000)]
    for first in (0, 100):
        rows = fim.rearrange(spark.createDataFrame(data, "doc_id long, text string"), rate=100, suffix_first=first)
        rows = rows.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert Counter((r.doc_id, r.back) for r in rows) == Counter(data)
        assert {r.form for r in rows} == {"plain", "spm" if first else "psm"}


def test_units_by_events():
    machine, rnd = fim.automaton(), random.Random(2)
    for _ in range(2000):
        t = "".join(rnd.choice(" \n\tab<P>é \x1c") for _ in range(rnd.randint(0, 14)))
        units, events = UNIT.findall(t), fim.Events(machine.iter(t), len(t))
        assert events.n == len(units) and events.marked == ("<P>" in t)
        assert all(events.end_of(k) == len("".join(units[:k])) for k in range(len(units) + 1))


def brute_trie(rows):
    """Nodes by lists of turns."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{role}\x1f{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + own[c][h:]
    members = {}
    for c, w in rebuilt.items():
        for d in range(len(w) + 1):
            members.setdefault(tuple(w[:d]), []).append(c)
    saved = {k: (len(v) - 1) * (len(k[-1][1].encode()) if k else 0) for k, v in members.items()}
    out = Counter()
    for k, v in members.items():
        under = [x for x in members if x[: len(k)] == k]
        parents = {x[:-1] for x in members if x}
        ends = ",".join(str(c) for c in sorted(v) if len(rebuilt[c]) == len(k))
        out[(min(v), len(k), min(members[k[:-1]]) if k else None, len(v), sum(x != () and x[:-1] == k for x in members), sum(x not in parents for x in under), sum(saved[x] for x in under), hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("bits", [64, 1])
def test_prefix_trie(spark, bits):
    """Ties, nulls, repeats, negative ids, a conversation of a third of all rows; with one bit most groups must be split."""
    rnd = random.Random(5)
    rows = [(c, k, rnd.choice(["user", "bot"]), rnd.choice(["a", "b", "é", ""])) for c in rnd.sample(range(-40, 140), 110) for k in range(rnd.randint(1, 6))]
    rows += [(77, k, "user", str(k % 7)) for k in range(200)] + [(80, k, "user", str(k % 7)) for k in range(90)]
    rows += [(200, None, "user", "x"), (200, None, "user", "x"), (200, 3, None, None), (200, 3, "bot", "z"), (None, 1, "user", "lost"), (201, 1, None, "only")]
    rnd.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, pos string, depth int").repartition(3)
    found = prefix_trie.prefix_trie(frame, bits=bits)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, found.collect())) == brute_trie(rows)


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")).collect() == []


def test_scans_run_through_tasks(spark):
    """One key in all tasks, and several keys in one; sums and fingerprints equal a plain loop."""
    rnd = random.Random(9)
    rows = [(rnd.choice([4, 4, 4, 4, 9, -1]), k, rnd.getrandbits(63) - (1 << 62)) for k in range(3000)]
    frame = spark.createDataFrame(rows, "key long, at long, x long").repartition(7)
    found = scan.prefix_scan(frame, "key", [F.col("at").desc()], {"total": ("x", 1), "roll": ("x", prefix_trie.BASE)}, pos="place").collect()
    want, state = {}, {}
    for key, at, x in sorted(rows, key=lambda r: -r[1]):
        n, total, roll = state.get(key, (0, 0, 0))
        state[key] = want[(key, at)] = (n + 1, (total + x) % 2**64, (roll * prefix_trie.BASE + x) % 2**64)
    assert len(found) == len(rows) and all((r.place, r.total % 2**64, r.roll % 2**64) == want[(r.key, r.at)] for r in found)


def test_weights_against_dense_descent():
    """The sparse accelerated fit against plain proximal descent on a dense matrix, without acceleration and with a fixed small step."""
    rng = np.random.default_rng(3)
    n, k = 60, 12
    dense = rng.random((n, k)) < 0.3
    label = (dense[:, 0] & ~dense[:, 1] | (rng.random(n) < 0.1)).astype(int)
    has = [np.flatnonzero(r) for r in dense]
    other = dense.copy()
    other[:, [4, 5]] = dense[:, [5, 4]]  # features 4 and 5 are each other's counterpart
    swapped = [np.flatnonzero(b) if (a != b).any() else None for a, b in zip(dense, other)]
    found, bias = toxicity.fit_weights(label, has, swapped, k, steps=4000)
    d = np.array([a.astype(float) - b for a, b in zip(dense, other) if (a != b).any()])
    share = np.where(label > 0, 0.5 / label.sum(), 0.5 / (n - label.sum()))
    l1 = toxicity.L1 / np.sqrt(n)

    def objective(w, b):
        z = dense @ w + b
        return share @ np.logaddexp(0, np.where(label > 0, -z, z)) + toxicity.COUNTERFACTUAL * np.mean((d @ w) ** 2) + toxicity.L2 / 2 * w @ w + l1 * np.abs(w).sum()

    w, b = np.zeros(k), 0.0
    for _ in range(150_000):
        r = share * (1 / (1 + np.exp(-(dense @ w + b))) - label)
        g = dense.T @ r + 2 * toxicity.COUNTERFACTUAL * d.T @ (d @ w) / len(d) + toxicity.L2 * w
        w = w - 0.3 * g
        w = np.sign(w) * np.maximum(np.abs(w) - 0.3 * l1, 0)
        b -= 0.3 * r.sum()
    assert abs(objective(found, bias) - objective(w, b)) < 1e-6
    assert np.abs(found - w).max() < 0.01 * np.abs(w).max() and found[0] > 0.5 and abs(found[4] - found[5]) < abs(found[0]) / 5
