"""Shards by a weighted hash tree: a row descends from the root through regions and racks to a shard.

At each level every child of the node reached draws a number from the row's key and the child's own name, scaled by the
child's weight; the least draw wins.  A draw depends on nothing else, so a weight that changes moves rows only to or from
the subtree below it, and children that keep their weights keep their order among themselves.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free, settle

#: Region, rack, shard, weight.
Leaf = tuple[str, str, int, float]

#: Rows that are numbered in one group.
GROUP_ROWS = 4096
#: Slots of equal rows that one task hands out at most.
CHUNK = 65_536
#: Groups whose first slots are broadcast at most (40 bytes each).
BROADCAST_GROUPS = 200_000


def layout(regions: int = 2, racks: int = 2, shards: int = 2) -> list[Leaf]:
    """An even tree; shards are numbered in order."""
    return [(f"r{r}", f"r{r}/k{k}", (r * racks + k) * shards + s, 1.0) for r in range(regions) for k in range(racks) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own.

    The other regions keep their weights and so their draws, so rows move only into the new region, that is into the new
    shard.  Within an old rack it would raise the weights of rack and region as well, and rows that these win could
    go to any shard below.
    """
    regions = {r for r, *_ in tree}
    name = next(f"r{k}" for k in range(len(regions) + 1) if f"r{k}" not in regions)
    return [*tree, (name, f"{name}/k0", max(s for *_, s, _ in tree) + 1, weight)]


def _children(tree: Iterable[Leaf]) -> list[dict[str, dict[str, float]]]:
    """For each level: the weights of each parent's children, by name; a node weighs what its shards do."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for region, rack, shard, weight in tree:
        if not weight > 0:
            raise ValueError(f"shard {shard} has no positive weight")
        for level, parent, child in ((0, "", region), (1, region, rack), (2, rack, str(shard))):
            of = levels[level].setdefault(parent, {})
            of[child] = of.get(child, 0.0) + weight
    return levels


def draw(key: Column, node: Column, weight: Column) -> Column:
    """Exponential with the weight as its rate, from 52 bits of a digest of key and node."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), node)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def descend(key: Column, tree: list[Leaf]) -> Column:
    """The shard of a key: the least draw among the children, level by level."""
    at = F.lit("")
    for level in _children(tree):
        entry = lambda of: F.array(*[F.struct(F.lit(w).alias("weight"), F.lit(c).alias("node")) for c, w in sorted(of.items())])
        among = F.create_map(*[x for parent, of in sorted(level.items()) for x in (F.lit(parent), entry(of))])
        drawn = F.transform(F.element_at(among, at), lambda c: F.struct(draw(key, c["node"], c["weight"]).alias("draw"), c["node"].alias("node")))
        at = F.array_min(drawn)["node"]
    return at.cast("int")


def assign(docs: DataFrame, tree: list[Leaf], larger: list[Leaf] | None = None, group_rows: int = GROUP_ROWS, chunk: int = CHUNK) -> DataFrame:
    """Every row's shard and its slot there.

    Input: ``doc_id`` and ``text``; other columns are ignored.  Output, one row per input row: ``doc_id``, ``size`` (UTF-8 bytes of the text
    and one; null: 1), ``text_crc32`` (unsigned; null: as an empty text), ``law`` (``key``: doc_id and tree decide alone), ``shard``,
    ``slot`` (gapless from 0 in each shard, in the order of a digest of the row's values) and ``grown_shard`` (the shard in ``larger``,
    by default the tree with one more).  A null doc_id has the key of an empty string; rows that share a doc_id share a shard, and
    equal rows take neighbouring slots.  An empty table gives an empty result.

    Texts are read once and not shuffled.  Rows that are equal in all that comes out are counted before any shuffle.  Slots
    come from counts by shard and digest range, so no task sees a whole shard.
    """
    larger = grown(tree) if larger is None else larger
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("m"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.withColumns({"place": F.md5(F.concat_ws("/", key, F.col("size").cast("string"), F.col("text_crc32").cast("string"))), "shard": descend(key, tree), "grown_shard": descend(key, larger)})
    rows = settle(rows, "shard-rows")
    # Digests are even, so ranges of their first 32 bits hold about as many rows each.
    ranges = max(1, rows.count() // (group_rows * len(tree)))
    first = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", F.shiftright(first * ranges, 32))
    counts = settle(rows.groupBy("shard", "range").agg(F.sum("m").alias("n")), "shard-counts")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if counts.count() <= BROADCAST_GROUPS:
        bases = F.broadcast(bases)
    inside = Window.partitionBy("shard", "range").orderBy("place", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(bases, ["shard", "range"]).withColumn("first", F.col("base") + F.coalesce(F.sum("m").over(inside), F.lit(0)))
    few = placed.where(F.col("m") <= chunk).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k"))
    many = rows.where(F.col("m") > chunk)
    if not many.isEmpty():
        # A row that repeats very often: its slots are dealt in stretches.
        many = placed.where(F.col("m") > chunk).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(chunk).cast("long"))).alias("from"))
        many = many.repartition("shard", "place", "from").select("*", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + chunk, F.col("m")) - 1)).alias("k")).drop("from")
        few = few.unionByName(many)
    return few.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("k")).alias("slot"), "grown_shard")


def with_shard(docs: DataFrame, tree: list[Leaf], column: str = "shard") -> DataFrame:
    """The rows with their shard, all columns kept; for writers that partition by it."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.withColumn(free(column, docs.columns), descend(key, tree))
