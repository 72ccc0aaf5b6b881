"""Near-duplicates by b-bit MinHash.

Minima of many hash functions over a document's shingle set give band keys, which find
candidates, and their low bits give a packed signature, whose collision-corrected
agreement drops poor candidates.  Whatever remains is confirmed on full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import NOT_SPACE, Words, batch, mix, shingle_sets, slices, tidied, utf8
from .components import connected_components
from .shared import free, settle, without

SHINGLE = 5
HASHES = 128
BITS = 4
BANDS = 32
#: Links have 100 * intersection >= 75 * union.
THRESHOLD = 75
#: How far the estimate may be below the threshold: over five standard errors at 128 hashes.
SLACK = 0.2
#: Documents named in a broadcast at most (16 MB); beyond, the texts are dealt by id.
BROADCAST_IDS = 2_000_000

#: One-bit signatures for buckets that stay open: their hash functions, and 4.5 standard errors.
FINE_HASHES = 2048
FINE_SLACK = 0.066
#: Rows of a bucket that are compared in memory at once, and rows of small buckets dealt together.
BLOCK_ROWS, GROUP_ROWS = 2048, 20_000
#: Blocks of an open bucket at most: a row goes to each of them once.  Larger buckets are dealt anew by
#: narrower bands: as many, of eight hashes each, which a pair at the threshold all misses with a probability of 1.4e-6.
MOST_BLOCKS, NARROW = 128, 8


def _functions(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_COARSE, _FINE = _functions(4040, HASHES), _functions(4041, FINE_HASHES)


def minima(values: np.ndarray, functions: tuple[np.ndarray, np.ndarray] = _COARSE) -> np.ndarray:
    """The least value of every hash function over a set."""
    flip, times = functions
    out = np.full(len(flip), (1 << 64) - 1, np.uint64)
    step = (1 << 19) // len(flip)
    for k in range(0, len(values), step):
        out = np.minimum(out, ((values[k : k + step, None] ^ flip) * times).min(axis=0))
    return mix(out)


def pack_bits(low: np.ndarray) -> np.ndarray:
    """Low bits of the minima, 64 / BITS of them in a long."""
    per = 64 // BITS
    low = (low & np.uint64((1 << BITS) - 1)).reshape(-1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    one = mix(values ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    two = mix(values * np.uint64(0x2545F4914F6CDD1D) ^ np.uint64(0x9E6C63D0876A9A99)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


_SIGNED = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64())), ("sig", pa.list_(pa.int64()))])


_SALT = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))


def band_keys(low: np.ndarray) -> np.ndarray:
    """A key for each band, from all of its minima."""
    key = _SALT
    for part in low.reshape(BANDS, -1).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ part)
    return key


def narrow_keys(low: np.ndarray) -> np.ndarray:
    """Keys of the narrower bands, from the first minima of the fine functions."""
    key = mix(np.arange(MOST_BLOCKS, dtype=np.uint64) + np.uint64(1 << 20))
    for part in low[: MOST_BLOCKS * NARROW].reshape(MOST_BLOCKS, NARROW).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ part)
    return key


def _signatures(batches):
    for b in batches:
        data, offsets = utf8(b.column(2))
        rows, ids = b.column(0), b.column(1)
        for lo, hi in slices(offsets):
            words = Words(data, offsets[lo : hi + 1], NOT_SPACE)
            out = {k: [] for k in _SIGNED.names[2:]}
            for values in shingle_sets(words, SHINGLE):
                out["n_shingles"].append(len(values))
                if not len(values):
                    for k in ("f1", "f2", "keys", "sig"):
                        out[k].append(None)
                    continue
                one, two = _fingerprint(values)
                low = minima(values)
                for k, v in zip(("f1", "f2", "keys", "sig"), (one, two, band_keys(low).view(np.int64), pack_bits(low).view(np.int64))):
                    out[k].append(v)
            yield batch({"key": rows[lo:hi], "doc_id": ids[lo:hi]} | out, _SIGNED)


def _fine(narrow: bool):
    """Per text: set size, one-bit signature, and the low half of each band key."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("tags", pa.binary())])

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in slices(offsets):
                out = {"n": [], "bits": [], "tags": []}
                for s in shingle_sets(Words(data, offsets[lo : hi + 1], NOT_SPACE), SHINGLE):
                    low = minima(s, _FINE)
                    out["n"].append(len(s))
                    out["bits"].append(np.packbits((low & np.uint64(1)).astype(np.uint8)).tobytes())
                    out["tags"].append((narrow_keys(low) if narrow else band_keys(minima(s))).astype(np.uint32).tobytes())
                yield batch({"id": b.column(0)[lo:hi]} | out, schema)

    return run


def _narrow(batches):
    schema = pa.schema([("id", pa.int64()), ("keys", pa.list_(pa.int64()))])
    for b in batches:
        data, offsets = utf8(b.column(1))
        for lo, hi in slices(offsets):
            sets = shingle_sets(Words(data, offsets[lo : hi + 1], NOT_SPACE), SHINGLE)
            yield batch({"id": b.column(0)[lo:hi], "keys": [narrow_keys(minima(s, _FINE)).view(np.int64) for s in sets]}, schema)


def _close(threshold: int):
    """Pairs of a group of buckets that fine signatures call similar, of different components, each in its first common bucket."""
    most = int(FINE_HASHES * (1 - (threshold / 100 - FINE_SLACK)) / 2)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        key, ids, component, n, lo, hi, block = (table.column(c).to_numpy() for c in ("key", "id", "component", "n", "lo", "hi", "block"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
        tags = np.frombuffer(b"".join(table.column("tags").to_pylist()), np.uint32).reshape(len(ids), -1)
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]]))
        found = []
        for s, e in zip(edges[:-1], edges[1:]):
            rows = order[s:e]
            across = lo[rows[0]] != hi[rows[0]]
            left = rows[block[rows] == lo[rows[0]]] if across else rows
            right = rows[block[rows] == hi[rows[0]]] if across else rows
            mine = np.uint32(key[rows[0]] & 0xFFFFFFFF)
            for k in range(0, len(left), 64):
                x = left[k : k + 64]
                off = np.zeros((len(x), len(right)), np.uint16)
                for w in range(bits.shape[1]):
                    off += np.bitwise_count(bits[x, w][:, None] ^ bits[right, w][None])
                good = (off <= most) & (component[x][:, None] != component[right][None])
                if not across:
                    good &= ids[x][:, None] < ids[right][None]
                i, j = np.nonzero(good)
                i, j = x[i], right[j]
                same = tags[i] == tags[j]
                first = tags[i, same.argmax(axis=1)] == mine
                sizes = 100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])
                i, j = i[first & sizes], j[first & sizes]
                found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1))
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, schema)

    return run


def _confirm(threshold: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            sides = [utf8(b.column(2)), utf8(b.column(3))]
            size = np.maximum(sides[0][1], sides[1][1])
            for lo, hi in slices(size):
                one, two = (shingle_sets(Words(data, offsets[lo : hi + 1], NOT_SPACE), SHINGLE) for data, offsets in sides)
                good = []
                for x, y in zip(one, two):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both > 0 and 100 * both >= threshold * (len(x) + len(y) - both))
                keep = pa.array(good, pa.bool_())
                yield batch({"a": b.column(0)[lo:hi].filter(keep), "b": b.column(1)[lo:hi].filter(keep)}, schema)

    return run


def estimate(one: str, two: str):
    """Estimated similarity of two packed signatures: agreeing fields, corrected for chance agreement."""
    field = sum(1 << (BITS * k) for k in range(64 // BITS))
    ones = F.lit(field if field < 1 << 63 else field - (1 << 64)).cast("long")

    def differing(x, y):
        d = x.bitwiseXOR(y)
        any_bit = d
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(any_bit.bitwiseAND(ones))

    off = F.aggregate(F.zip_with(one, two, differing), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    return (1 - off / F.lit(float(HASHES)) - chance) / (1 - chance)


def _named(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some documents; by a broadcast if these are few enough."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return texts.join(ids, "doc_id", "left_semi")


def open_pairs(members: DataFrame, texts: DataFrame, threshold: int, block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Promising pairs (a, b) of different components within buckets (key, id, component).

    Buckets are compared in blocks of bounded size on finer signatures; only pairs that these
    call similar come out.  A row is sent to each block of its bucket, so a bucket has ``most_blocks`` at most:
    the members of a larger one are dealt anew by narrower bands, which few dissimilar texts share.  (A bucket of
    these that is too large again holds texts that are all but linked; it is compared in all its blocks.)
    """
    rows = settle(members, "minhash-open")
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    sizes = settle(sizes, "minhash-open-sizes")
    wide = sizes.where(F.col("blocks") > most_blocks)
    found = _compared(rows.join(sizes.where(F.col("blocks") <= most_blocks), "key"), texts, threshold, False)
    if not wide.isEmpty():
        ids = rows.join(wide.select("key"), "key", "left_semi").select("id", "component").distinct()
        ids = settle(ids, "minhash-wide")
        keys = _named(texts, ids.select(F.col("id").alias("doc_id")).distinct()).mapInArrow(tidied(_narrow), "id long, keys array<long>").dropDuplicates(["id"])
        dealt = settle(keys.select("id", F.explode("keys").alias("key")).join(ids, "id"), "minhash-narrow")
        mixed = dealt.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")).where("x != y")
        found = found.unionByName(_compared(dealt.join(mixed.select("key", "blocks"), "key"), texts, threshold, True))
    return found


def _compared(rows: DataFrame, texts: DataFrame, threshold: int, narrow: bool) -> DataFrame:
    """Pairs of rows (key, id, component, blocks of the key) that fine signatures call similar."""
    rows = settle(rows, "minhash-compared")
    fine = _named(texts, rows.select(F.col("id").alias("doc_id")).distinct()).mapInArrow(tidied(_fine(narrow)), "id long, n long, bits binary, tags binary").dropDuplicates(["id"])
    groups = max(1, -(-rows.count() // GROUP_ROWS))
    dealt = rows.join(settle(fine, "minhash-fine"), "id")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    small = F.col("blocks") == 1
    dealt = dealt.select(
        "key", "id", "component", "n", "bits", "tags", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        F.when(small, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.col("key")).alias("group"), small.alias("small"),
    )
    return dealt.groupBy("small", "group", "lo", "hi").applyInArrow(_close(threshold), "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Of (a, b), those whose full shingle sets are as similar as asked for."""
    texts = _named(texts, pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    found = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    found = found.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return found.select("a", "b", "text_a", "text_b").mapInArrow(tidied(_confirm(threshold)), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Classes of documents linked by similar sets of word shingles.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a document's
    set holds its distinct shingles of five words, or all its words as one if they are
    fewer.  Documents link if ``100 * intersection >= threshold * union``.

    Input: ``doc_id`` and ``text``; other columns are ignored.  Output, one row per input row:
    ``doc_id``, ``n_shingles``, ``component_id`` (the smallest doc_id reachable), ``kept``.
    A text that is null or has no words is linked with nothing; texts of any length are compared whole.  A row with a null doc_id is
    linked with nothing, has a null component and is kept.  Equal rows get equal results.
    Rows that share a doc_id but not a text each have the class of their own text; of those that
    share both, one text is kept.

    Rows with equal sets are one class, represented by its smallest doc_id (and the key of that row,
    a hash of doc_id and text, by which representatives are told apart).  Only
    representatives are compared.  In every band bucket, first all members are checked
    against the smallest one; most buckets are then one component and are done.  In the
    others, members of different components are compared on finer signatures, in blocks, and
    those that agree enough are checked.  A bucket of more than 128 blocks is dealt anew by narrower bands
    (see ``open_pairs``), so that a row is sent to 128 places at most.  At 32 bands of 4 hashes a pair at the threshold shares no
    bucket with a probability of 5e-6.
    """
    return _classes(_keyed(docs), threshold, block_rows, most_blocks).drop("key")


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.xxhash64(doc_id, text).alias("key"), doc_id.alias("doc_id"), text.alias("text"))


def _classes(docs: DataFrame, threshold: int, block_rows: int = BLOCK_ROWS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """As ``near_duplicates``, with the key of each row."""
    raw = settle(docs.mapInArrow(tidied(_signatures), "key long, doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, sig array<long>"), "minhash")
    texts = docs.where("doc_id is not null").select(F.col("key").alias("doc_id"), "text")
    real = F.col("doc_id").isNotNull() & F.col("f1").isNotNull()
    keys = ["f1", "f2", "n_shingles"]
    # Only sets that occur twice are joined back; their table is written first, so that AQE can split a set that a third of all rows have.
    classes = raw.where(real).groupBy(*keys).agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("m")).where("m > 1")
    classes = settle(classes.select(*keys, F.col("first.doc_id").alias("least"), F.col("first.key").alias("rep")), "minhash-sets")
    is_rep = F.col("key") == F.coalesce("rep", "key")
    rows = raw.where(real).join(classes, keys, "left").select(
        "key", "doc_id", "n_shingles", F.coalesce("rep", "key").alias("rep"), F.coalesce("least", "doc_id").alias("least"),
        F.when(is_rep, F.col("keys")).alias("keys"), F.when(is_rep, F.col("sig")).alias("sig"),
    )
    # Rows that link with nothing stay out of every join.
    alone = raw.where(~real).select("key", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = settle(rows, "minhash-classes")
    reps = rows.where("keys is not null").select(F.col("key").alias("id"), F.col("n_shingles").alias("n"), "least", "keys", "sig")

    bands = reps.select("id", "least", F.explode("keys").alias("key"))
    shared = settle(bands.groupBy("key").agg(F.min_by("id", "least").alias("centre"), F.count("*").alias("m")).where("m > 1").select("key", "centre"), "minhash-buckets")
    members = settle(bands.drop("least").join(shared, "key"), "minhash-members")
    # The smallest doc_id is often the text that the others were copied from, so buckets share it as their centre.
    stars = members.where("id != centre").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()
    signed = reps.select("id", "n", "sig")

    def promising(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(signed.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
        return pairs.where(_fits(threshold)).select("a", "b").distinct()

    first = settle(promising(stars), "minhash-stars")
    links = settle(confirmed(first, texts, threshold), "minhash-links")
    named = connected_components(links)

    placed = members.join(named.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    rest = open_pairs(placed.join(mixed, "key", "left_semi"), texts, threshold, block_rows, most_blocks).distinct().join(first, ["a", "b"], "left_anti")
    rest = settle(rest, "minhash-rest")
    more = settle(confirmed(rest, texts, threshold), "minhash-links")
    if not more.isEmpty():
        named = connected_components(named.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    # A component is named by its smallest doc_id, and of the rows with that one it keeps the least key.
    linked = rows.where("keys is not null").select(F.col("key").alias("node"), "least").join(named, "node")
    heads = linked.groupBy("component").agg(F.min(F.struct("least", "node")).alias("head"))
    heads = named.join(heads, "component").select(F.col("node").alias("rep"), F.col("head.least").alias("head_id"), F.col("head.node").alias("head"))
    # Again the small side is written, so that a class of any size can be split.
    done = rows.select("key", "doc_id", "n_shingles", "rep", "least").join(settle(heads, "minhash-heads"), "rep", "left")
    kept = F.col("key") == F.coalesce("head", "rep")
    return done.select("key", "doc_id", "n_shingles", F.coalesce("head_id", "least").alias("component_id"), kept.alias("kept")).unionByName(alone)


def drop_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates, all columns.

    Of each class the row with the smallest doc_id stays; rows are named by doc_id and text, so another
    text under the same doc_id is not touched.  Of rows that are equal in doc_id and
    text one stays.  Rows without words or without a doc_id all stay.
    """
    found = settle(_classes(_keyed(docs), threshold), "minhash-result")
    key = free("__key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    left = without(keyed, found.where("not kept").select(F.col("key").alias(key)).distinct(), key)
    twice = found.where("kept and doc_id is not null and n_shingles > 0").groupBy(F.col("key").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key)
    twice = settle(twice, "minhash-repeated")
    if not twice.isEmpty():
        left = without(left, twice, key).unionByName(left.join(twice, key, "left_semi").dropDuplicates([key]))
    return left.select(*docs.columns)


def _fits(threshold: int):
    """Set sizes that allow the similarity, and signatures that make it likely."""
    sizes = 100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    return sizes & (estimate("sig_a", "sig_b") >= threshold / 100 - SLACK)
