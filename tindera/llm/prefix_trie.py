"""The trie of conversations' beginnings: which conversations begin alike, how far, and what is saved by reading that once.

A polynomial fingerprint rolls along each conversation's turns.  Conversations with the same fingerprint at the same depth are
a group, and a node if they are alike: each member's turn and parent are compared with those of the
group's representative, exactly, and a group whose members differ is split.

Every node is owned by its smallest member.  What a conversation owns is the end of its own path, so a subtree's sum
is its owner's from the node's depth on, and for each other member all that this one owns.  So sums over
subtrees need no walk from level to level.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import batch, tidied
from .scan import power, prefix_scan
from .shared import settle

#: Conversations of a group begin with turns of its first one; so many turns at most, less one.
GROUP, DEPTHS = 5, 9
#: Odd, so that it has an inverse.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Ids in a stretch that is hashed at once.
STRETCH = 1024
_NOTHING = hashlib.sha256().hexdigest()

_MEMBERS = "conv_id long, depth long, fp long, pfp long, t long, v int, bytes long, last boolean"
_MEMBER_SCHEMA = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("fp", pa.int64()), ("pfp", pa.int64()), ("t", pa.int64()), ("v", pa.int32()), ("bytes", pa.int64()), ("last", pa.bool_())])


def _turns(conversations: DataFrame, bits: int) -> DataFrame:
    """Turns by fingerprint ``t`` and variant ``v``: equal in both exactly if equal in role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    mask = (1 << bits) - 1
    rows = rows.withColumn("t", F.xxhash64("role", "text").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    # The least and the greatest text under a fingerprint are equal exactly if all are; rows of one text meet before the shuffle.
    said = F.struct("role", "text")
    twofold = settle(rows.groupBy("t").agg(F.min(said).alias("lo"), F.max(said).alias("hi")).where("lo != hi").select("t"), "trie-clashes")
    if twofold.isEmpty():
        rows = rows.withColumn("v", F.lit(0))
    else:
        variants = rows.join(twofold, "t", "left_semi").select("t", "role", "text").distinct().selectExpr("*", "row_number() over (partition by t order by role, text) as v")
        rows = rows.join(settle(variants, "trie-variants"), ["t", "role", "text"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    digest = F.md5(F.concat("role", F.lit("\x1f"), "text"))
    return settle(rows.select("conv_id", "turn", digest.alias("digest"), "t", "v", F.octet_length("text").cast("long").alias("bytes")), "trie-turns")


def _own_rows(batches):
    """Rebuilt turns after the borrowed ones: the fingerprint changes its beginning and keeps the rest."""
    for b in batches:
        at = lambda n: b.column(b.schema.get_field_index(n))  # noqa: E731, B023
        word = lambda n: at(n).to_numpy().view(np.uint64)  # noqa: E731, B023
        since = at("pos").to_numpy() - at("h").to_numpy()
        fp = word("roll") + (word("start") - word("own")) * power(BASE, since)
        depth = at("m").to_numpy() + since
        columns = {"conv_id": at("conv_id"), "depth": depth, "fp": fp.view(np.int64), "pfp": ((fp - word("t")) * np.uint64(_INVERSE)).view(np.int64)}
        yield batch(columns | {n: at(n) for n in ("t", "v", "bytes")} | {"last": depth == at("length").to_numpy()}, _MEMBER_SCHEMA)


def _split_rows(batches):
    """From a conversation's split on, fingerprints go on from what tells it apart."""
    for b in batches:
        own = dict(zip(b.schema.names, b.columns))
        depth, at = own["depth"].to_numpy(), own["at"].to_numpy()
        shift = own["shift"].to_numpy().view(np.uint64)
        for name, since in (("fp", depth - at), ("pfp", depth - 1 - at)):
            old = own[name].to_numpy().view(np.uint64)
            own[name] = np.where(since >= 0, old + shift * power(BASE, np.maximum(since, 0)), old).view(np.int64)
        yield batch({n: own[n] for n in _MEMBER_SCHEMA.names}, _MEMBER_SCHEMA)


def _members(turns: DataFrame, group: int, depths: int) -> DataFrame:
    """A row for each rebuilt conversation and depth, from the root at depth 0 on."""
    rolled = prefix_scan(turns, "conv_id", ["turn", "digest"], {"roll": ("t", BASE)})
    head = F.when(F.col("pos") < depths, F.struct("pos", "roll", "t", "v", "bytes"))
    convs = settle(rolled.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(head)).alias("heads")), "trie-conversations")
    borrowed = convs.select(F.col("conv_id").alias("b"), F.col("n").alias("n_b"), F.col("heads").alias("heads_b"))
    plan = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % depths, "b": F.col("conv_id") - F.col("conv_id") % group}).join(borrowed, "b", "left")
    plan = plan.withColumn("m", F.least("h", F.coalesce("n_b", F.lit(0))))
    upto = lambda heads, k: F.when(k > 0, F.get(F.col(heads), (k - 1).cast("int"))["roll"]).otherwise(F.lit(0).cast("long"))
    plan = plan.select(
        "conv_id", "h", "m", upto("heads_b", F.col("m")).alias("start"), F.when(F.col("n") > F.col("h"), upto("heads", F.col("h"))).otherwise(F.lit(0).cast("long")).alias("own"),
        (F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"), F.slice(F.coalesce("heads_b", F.array().cast(convs.schema["heads"].dataType)), F.lit(1), F.col("m").cast("int")).alias("first"),
    )
    plan = settle(plan, "trie-plan")
    before = lambda x, k: F.when(k > 0, F.get(F.col("first"), k - 1)["roll"]).otherwise(F.lit(0).cast("long"))
    head_rows = plan.select("conv_id", "length", F.explode(F.transform("first", lambda x, k: F.struct(x.alias("x"), before(x, k).alias("pfp")))).alias("y"))
    head_rows = head_rows.select("conv_id", F.col("y.x.pos").alias("depth"), F.col("y.x.roll").alias("fp"), "y.pfp", "y.x.t", "y.x.v", "y.x.bytes", (F.col("y.x.pos") == F.col("length")).alias("last"))
    own_rows = rolled.select("conv_id", "pos", "roll", "t", "v", "bytes").join(plan.drop("first"), "conv_id").where("pos > h").mapInArrow(tidied(_own_rows), _MEMBERS)
    nought = F.lit(0).cast("long")
    root = plan.select("conv_id", nought.alias("depth"), nought.alias("fp"), nought.alias("pfp"), nought.alias("t"), F.lit(0).alias("v"), nought.alias("bytes"), (F.col("length") == 0).alias("last"))
    return settle(head_rows.unionByName(own_rows).unionByName(root), "trie-members")


def _groups(members: DataFrame) -> DataFrame:
    """Members by depth and fingerprint, with the least and greatest of what they must agree in."""
    same = F.struct("pfp", "t", "v")
    found = members.groupBy("depth", "fp").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.count_if("last").alias("n_ends"), F.min(same).alias("lo"), F.max(same).alias("hi"),
    )
    return settle(found, "trie-groups")


def _verified(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and nodes, once every group's members have the turn and the parent of its representative.

    Where some have not, a group is split: those get another fingerprint there, and go on from it.  All that share a beginning do so
    alike.  A split above can show more below, so this goes on until all agree.
    """
    nodes = _groups(members)
    while not (bad := nodes.where("lo != hi").select("depth", "fp", "lo")).isEmpty():
        odd = members.join(bad, ["depth", "fp"]).where("struct(pfp, t, v) != lo")
        shift = F.xxhash64("depth", "pfp", "t", "v")
        splits = settle(odd.groupBy("conv_id").agg(F.min(F.struct("depth", shift.alias("shift"))).alias("first")).select("conv_id", F.col("first.depth").alias("at"), "first.shift"), "trie-splits")
        moved = members.join(splits, "conv_id").mapInArrow(tidied(_split_rows), _MEMBERS)
        members = settle(members.join(splits, "conv_id", "left_anti").unionByName(moved), "trie-members")
        nodes = _groups(members)
    return members, nodes


def _stretches(batches):
    """Ids that end at a node, of a sorted task: stretches of bounded length, by their first id."""
    schema = pa.schema([("depth", pa.int64()), ("fp", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    for b in batches:
        depth, fp, ids = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("depth", "fp", "conv_id"))
        fresh = np.flatnonzero(np.append(True, (depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1]))) if len(ids) else []
        out: dict[str, list] = {n: [] for n in schema.names}
        for lo, hi in zip(fresh, [*fresh[1:], len(ids)]):
            for k in range(lo, hi, STRETCH):
                for n, v in zip(schema.names, (depth[k], fp[k], ids[k], ",".join(map(str, ids[k : min(k + STRETCH, hi)].tolist())))):
                    out[n].append(v)
        yield batch(out, schema)


def _hashed(batches):
    """One digest for each run of equal nodes; a node's stretches come in order, and only the digest's state is held."""
    schema = pa.schema([("depth", pa.int64()), ("fp", pa.int64()), ("ends_sha256", pa.string())])
    node = state = None
    for b in batches:
        out: dict[str, list] = {n: [] for n in schema.names}
        for depth, fp, ids in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("depth", "fp", "ids"))):
            if node == (depth, fp):
                state.update(b"," + ids.encode())
                continue
            if node is not None:
                for n, v in zip(schema.names, (*node, state.hexdigest())):
                    out[n].append(v)
            node, state = (depth, fp), hashlib.sha256(ids.encode())
        yield batch(out, schema)
    if node is not None:
        yield batch({n: [v] for n, v in zip(schema.names, (*node, state.hexdigest()))}, schema)


def _ends(members: DataFrame) -> DataFrame:
    """A digest of the ids that end at each node.  Ids are joined to text in ranges over all tasks; a digest takes the texts in order."""
    last = settle(members.where("last").select("depth", "fp", "conv_id"), "trie-ends")
    joined = last.repartitionByRange("conv_id").sortWithinPartitions("depth", "fp", "conv_id").mapInArrow(tidied(_stretches), "depth long, fp long, first long, ids string")
    return joined.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "first").mapInArrow(tidied(_hashed), "depth long, fp long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, depths: int = DEPTHS, bits: int = 64) -> DataFrame:
    """The nodes of the trie of rebuilt conversations.

    Input: ``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored.  Turns are ordered by ``turn``, null first, and those that
    tie by a digest of role and text; a null role or text is empty.  Rows without a conv_id belong to no conversation and take no part.
    Conversation c is rebuilt from the first h turns of conversation ``c - c % group`` and its own after its first h, where h is
    ``crc32(c) % depths``; it may have no turns then and still counts.

    Output, one row per node: ``conv_id`` (smallest member; with ``depth`` it names the node), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes) and ``ends_sha256``.  An empty table has no nodes.

    ``bits`` of a turn's fingerprint are used; fewer only make more groups to be split.  A conversation of any length is scanned
    in pieces; texts are read once and shuffled once, when turns of equal fingerprints are compared.
    """
    members, groups = _verified(_members(_turns(conversations, bits), group, depths))
    nodes = groups.select("depth", "fp", F.col("lo.pfp").alias("pfp"), "conv_id", "n_convs", F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    owned = settle(prefix_scan(nodes, "conv_id", [F.col("depth").desc()], {"leaves": ("leaf", 1), "bytes": ("saved", 1)}), "trie-owned")
    totals = owned.groupBy("conv_id").agg(F.max(F.struct("pos", "leaves", "bytes")).alias("all")).select("conv_id", F.col("all.leaves").alias("all_leaves"), F.col("all.bytes").alias("all_bytes"))
    totals = settle(totals, "trie-totals")
    below = members.select("conv_id", "depth", "fp").join(totals.where("all_leaves > 0 or all_bytes > 0"), "conv_id").groupBy("depth", "fp").agg(F.sum("all_leaves").alias("sum_leaves"), F.sum("all_bytes").alias("sum_bytes"))
    children = owned.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pfp").alias("fp")).agg(F.count("*").alias("n_children"))
    parents = owned.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("pfp"), F.col("conv_id").alias("parent_conv_id"))
    named = owned.join(parents, ["depth", "pfp"], "left").join(totals, "conv_id")
    at = ["depth", "fp"]
    found = named.join(below, at, "left").join(children, at, "left").join(_ends(members), at, "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", some("n_children").alias("n_children"), (F.col("leaves") + some("sum_leaves") - F.col("all_leaves")).alias("n_leaves"),
        (F.col("bytes") + some("sum_bytes") - F.col("all_bytes")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
    )
