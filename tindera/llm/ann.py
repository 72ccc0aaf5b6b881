"""Nearest neighbours by cosine with score-aware quantisation.

Unit vectors are product-quantised to four bits for each pair of dimensions.  Codes
minimise an anisotropic loss, which weighs the part of the residual that is parallel to the
vector more than the rest, because that part is what spoils large inner products.  Codes lie in inverted
lists of a coarse partition; a query scans the lists nearest to it through lookup tables, as many as a
held-out part of the sample needs, and the best candidates are ranked exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import batch, tidied
from .shared import settle

NEIGHBOURS = 5
QUERY_EVERY = 50
#: Distinct vectors that codebooks are fitted on at most: those with the least hash.
SAMPLE_ROWS = 20_000
#: Inner products above this are what the loss cares for.
SCORE_THRESHOLD = 0.2
#: Candidates of a query that are ranked exactly (and all that tie with the last).
DEPTH = 300
#: Codes and queries that meet in a task at most.
CODE_BLOCK, QUERY_BLOCK = 65_536, 16_384
CENTRES = 16
#: Vectors in a list, about, and lists at most (a list needs some of the sample).
LIST_ROWS, MOST_LISTS = 1024, 512
#: Share of the sample's own neighbours that the probed lists hold at least, and rows that this is measured on.
PROBE_SHARE, PROBE_ROWS = 0.98, 400


def usable(column: str):
    """Not null, not zero, and without null or non-finite components."""
    c = F.col(column)
    finite = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, padded to an even number of dimensions."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))


class Quantiser:
    """Codebooks of two-dimensional centres, and the weight of parallel residual error."""

    def __init__(self, centres: np.ndarray, eta: float) -> None:
        self.centres, self.eta = centres, eta

    @classmethod
    def fit(cls, sample: np.ndarray, rounds: int = 8) -> Quantiser:
        x = unit(sample)
        n, d = x.shape
        t = SCORE_THRESHOLD**2
        eta = max(1.0, (d - 1) * t / (1 - t))
        parts = x.reshape(n, d // 2, 2)
        rng = np.random.default_rng(16)
        centres = np.stack([parts[rng.choice(n, CENTRES, replace=n < CENTRES), m] for m in range(d // 2)])
        self = cls(centres, eta)
        for k in range(rounds):
            self.eta = 1.0 if k < rounds // 2 else eta  # plain rounds first, then score-aware ones
            self._update(parts, self.codes(x))
        return self

    def _update(self, parts: np.ndarray, codes: np.ndarray) -> None:
        """Weighted least squares for the centres of one subspace after another."""
        more = self.eta - 1
        n, m_all, _ = parts.shape
        parallel = np.einsum("nmi,nmi->nm", parts - self.centres[np.arange(m_all), codes], parts)
        total = parallel.sum(axis=1)
        for m in range(m_all):
            own, code = parts[:, m], codes[:, m]
            rest = total - parallel[:, m]
            outer = own[:, :, None] * own[:, None, :] * more + np.eye(2)
            right = own + more * own * (rest + np.einsum("ni,ni->n", own, own))[:, None]
            a = np.stack([np.bincount(code, outer[:, i, j], CENTRES) for i in range(2) for j in range(2)], axis=1).reshape(CENTRES, 2, 2)
            b = np.stack([np.bincount(code, right[:, i], CENTRES) for i in range(2)], axis=1)
            used = np.bincount(code, minlength=CENTRES) > 0
            self.centres[m, used] = np.linalg.solve(a[used], b[used][..., None])[..., 0]
            parallel[:, m] = np.einsum("ni,ni->n", own - self.centres[m, code], own)
            total = rest + parallel[:, m]

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent: each subspace's best centre, given the others' parallel error."""
        n, d = x.shape
        parts = x.reshape(n, d // 2, 2)
        off = ((parts[:, :, None, :] - self.centres[None]) ** 2).sum(axis=3)
        if self.eta == 1:
            return off.argmin(axis=2)
        along = np.einsum("nmi,nmi->nm", parts, parts)[:, :, None] - np.einsum("nmi,mci->nmc", parts, self.centres)
        code = off.argmin(axis=2)
        rows = np.arange(n)
        total = np.take_along_axis(along, code[:, :, None], 2).sum(axis=(1, 2))
        for _ in range(sweeps):
            for m in range(d // 2):
                rest = total - along[rows, m, code[:, m]]
                code[:, m] = (off[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(axis=1)
                total = rest + along[rows, m, code[:, m]]
        return code

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes in a byte."""
        out = []
        for k in range(0, len(x), 4096):
            code = self.codes(unit(x[k : k + 4096]))
            out.append((code[:, ::2] * 16 + code[:, 1::2]).astype(np.uint8))
        return np.concatenate(out)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of queries with every pair of centres: queries x bytes x 256."""
        q = unit(queries)
        part = np.einsum("qmi,mci->qmc", q.reshape(len(q), -1, 2), self.centres)
        return (part[:, ::2, :, None] + part[:, 1::2, None, :]).reshape(len(q), -1, 256).astype(np.float32)


class Lists:
    """A coarse partition: centres on the sphere, and how many lists a query probes."""

    def __init__(self, centres: np.ndarray, probes: int) -> None:
        self.centres, self.probes = centres, probes

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, share: float = PROBE_SHARE, rounds: int = 8) -> Lists:
        """Spherical k-means on the sample.

        The number of probes is the least with which the sample's rows that are set aside find the given share of their
        neighbours among the sample.  Neighbours in a sample are farther than those in the whole, so this is more than enough.
        """
        x = unit(sample)
        k = max(1, min(MOST_LISTS, rows // LIST_ROWS, len(x) // 32))
        rng = np.random.default_rng(5)
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(rounds if k > 1 else 0):
            own = cls(centres, 1).of(x)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            size = np.linalg.norm(sums, axis=1)
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
        self = cls(centres, k)
        if k == 1 or len(x) <= NEIGHBOURS:
            return self
        asked = rng.choice(len(x), min(PROBE_ROWS, len(x)), replace=False)
        near = x[asked] @ x.T
        near[np.arange(len(asked)), asked] = -2
        best = np.argpartition(-near, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
        place = np.argsort(np.argsort(-(x[asked] @ centres.T), axis=1), axis=1)  # of each list in a query's order
        needed = np.sort(np.take_along_axis(place, self.of(x)[best], axis=1).ravel()) + 1
        self.probes = int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))) - 1)])
        return self

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[(x[k : k + 4096] @ self.centres.T).argmax(axis=1) for k in range(0, len(x), 4096)]])

    def probed(self, x: np.ndarray) -> np.ndarray:
        """The lists that each query probes."""
        return np.argpartition(-(x @ self.centres.T), self.probes - 1, axis=1)[:, : self.probes]


def layout(sizes: dict[int, int], lists: int, block: int = CODE_BLOCK) -> tuple[list[tuple[int, int]], int]:
    """For every list its first block and number of blocks: small lists share one, large ones are split; and the number of blocks."""
    out, at, room = [], -1, 0
    for k in range(lists):
        n = sizes.get(k, 0)
        if n > block:
            parts = -(-n // block)
            out.append((at + 1, parts))
            at, room = at + parts, 0
        else:
            if n > room or at < 0:
                at, room = at + 1, block
            out.append((at, 1))
            room -= n
    return out, at + 1


def _encode(sent):
    schema = pa.schema([("cid", pa.int64()), ("list", pa.int32()), ("code", pa.binary())])

    def run(batches):
        quantiser, lists = sent.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                yield batch({"cid": b.column(0), "list": lists.of(unit(x)).astype(np.int32), "code": [c.tobytes() for c in quantiser.packed(x)]}, schema)

    return run


def _routes(sent, places):
    """A row for each query and block that holds a list it probes, with these lists."""
    schema = pa.schema([("query_id", pa.int64()), ("block", pa.int32()), ("lists", pa.list_(pa.int32())), ("vector", pa.list_(pa.float64()))])

    def run(batches):
        _, lists = sent.value
        for b in batches:
            out = {k: [] for k in schema.names}
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            for query, vector, probed in zip(b.column(0).to_pylist(), x, lists.probed(unit(x)).tolist()):
                blocks: dict[int, list[int]] = {}
                for k in probed:
                    first, parts = places[k]
                    for block in range(first, first + parts):
                        blocks.setdefault(block, []).append(k)
                for block, own in blocks.items():
                    for name, v in zip(schema.names, (query, block, sorted(own), vector)):
                        out[name].append(v)
            yield batch(out, schema)

    return run


def _pack_codes(table: pa.Table) -> pa.Table:
    ids, lists = table.column("cid").to_numpy(), table.column("list").to_numpy()
    order = np.lexsort((ids, lists))
    codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": [ids[order].tobytes()], "lists": [lists[order].tobytes()], "codes": [codes.tobytes()]})


def _scan(sent, depth: int):
    schema = pa.schema([("query_id", pa.int64()), ("cid", pa.int64()), ("approximate", pa.float32())])

    def run(codes: pa.Table, queries: pa.Table) -> pa.Table:
        quantiser, lists = sent.value
        out = []
        if codes.num_rows and queries.num_rows:
            ids, own = (np.frombuffer(codes.column(c)[0].as_py(), t) for c, t in (("ids", np.int64), ("lists", np.int32)))
            planes = np.ascontiguousarray(np.frombuffer(codes.column("codes")[0].as_py(), np.uint8).reshape(len(ids), -1).T)
            bound = np.searchsorted(own, np.arange(len(lists.centres) + 1))
            x = _matrix(queries.column("vector"))
            names, probed = queries.column("query_id").to_pylist(), queries.column("lists").to_pylist()
            for k in range(0, len(names), 32):
                for q, mine, table in zip(names[k : k + 32], probed[k : k + 32], quantiser.tables(x[k : k + 32])):
                    spans = [(bound[i], bound[i + 1]) for i in mine if bound[i + 1] > bound[i]]
                    if not spans:
                        continue
                    rows = np.concatenate([np.arange(a, b) for a, b in spans])
                    total = np.zeros(len(rows), np.float32)
                    for m, plane in enumerate(planes):
                        total += table[m][plane[rows]]
                    if len(rows) > depth:
                        at = np.flatnonzero(total >= np.partition(total, len(rows) - depth)[len(rows) - depth])
                    else:
                        at = np.arange(len(rows))
                    out.append(batch({"query_id": np.full(len(at), q), "cid": ids[rows[at]], "approximate": total[at]}, schema))
        return pa.Table.from_batches(out, schema)

    return run


def _exact(batches):
    """Cosines in double precision."""
    schema = pa.schema([("query_id", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
    for b in batches:
        if b.num_rows:
            # Scaled by powers of two, which changes no digit, so that no square leaves the range of a double.
            x, y = (v * np.exp2(-np.frexp(np.abs(v).max(axis=1, keepdims=True))[1].astype(np.float64)) for v in (_matrix(b.column(1)), _matrix(b.column(2))))
            score = np.einsum("ni,ni->n", x, y) / (np.sqrt(np.einsum("ni,ni->n", x, x)) * np.sqrt(np.einsum("ni,ni->n", y, y)))
            yield batch({"query_id": b.column(0), "score": score, "ids": b.column(3)}, schema)


def search(vectors: DataFrame, queries: DataFrame, neighbours: int = NEIGHBOURS, depth: int = DEPTH, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Each query's nearest vectors by cosine, but its own row.

    Input: ``vec_id``, ``embedding`` in both; other columns are ignored.  Output: ``query_id``, ``rank``
    (from 1), ``vec_id``, ``score`` (double, on original vectors), nearest first, ties to the
    smaller vec_id; fewer rows if there are fewer candidates.  Rows with a null vec_id, and vectors that are null,
    empty, zero or hold null or non-finite components take no part; nor do those whose
    number of dimensions isn't the most frequent one (of several, the smallest).  Of several vectors under one queried
    vec_id the least is asked, and the others are candidates of their own.

    Equal vectors are one candidate with their ``neighbours + 1`` smallest vec_ids, which is all that
    a result can show of them.  Codebooks and lists are fitted on a bounded sample; every vector is coded.  A code is sent to as many
    tasks as there are blocks of ``QUERY_BLOCK`` queries, a query to the blocks of the lists that it probes.
    """
    spark = vectors.sparkSession
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable("v"))
    sizes = valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = valid.where(F.size("v") == sizes["d"])
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = valid.dropDuplicates(["vec_id", "v"]).withColumn("k", first).where(F.col("k") <= neighbours + 1)
    classes = settle(classes.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cid"), "v", "ids"), "vectors")
    count = classes.count()
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(sample_rows).select("v").toArrow()
    sample = _matrix(sample["v"])
    lists = Lists.fit(sample, count)
    sent = spark.sparkContext.broadcast((Quantiser.fit(sample), lists))

    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = asked.where(F.col("query_id").isNotNull() & usable("vector") & (F.size("vector") == sizes["d"])).groupBy("query_id").agg(F.min("vector").alias("vector"))
    asked = settle(asked, "queries")
    q_blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    codes = settle(classes.select("cid", "v").mapInArrow(tidied(_encode(sent)), "cid long, list int, code binary"), "codes")
    held = codes.groupBy("list").agg(F.count("*").alias("n")).collect()  # MOST_LISTS rows at most
    places, _ = layout({r["list"]: r["n"] for r in held}, len(lists.centres))
    first, parts = (F.element_at(F.array(*[F.lit(p[i]) for p in places]), F.col("list") + 1) for i in (0, 1))
    blocks = codes.withColumn("block", (first + F.pmod(F.xxhash64("cid"), parts)).cast("int")).groupBy("block").applyInArrow(_pack_codes, "block int, ids binary, lists binary, codes binary")
    blocks = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    routes = asked.mapInArrow(tidied(_routes(sent, places)), "query_id long, block int, lists array<int>, vector array<double>").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
    found = blocks.groupBy("block", "qb").cogroup(routes.groupBy("block", "qb")).applyInArrow(_scan(sent, depth), "query_id long, cid long, approximate float")
    best = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("approximate")))
    found = found.withColumn("k", best).where(F.col("k") <= depth).select("query_id", "cid")
    ranked = found.join(classes, "cid").join(asked, "query_id").select("query_id", "vector", "v", "ids").mapInArrow(tidied(_exact), "query_id long, score double, ids array<long>")
    nearest = ranked.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
