"""The trie of conversations' common beginnings, by vertical bitmaps.

Conversations are dealt into shards of bounded size. A shard indexes each (position, turn) by the
bitset of its conversations that have that turn there. Depth first from the root, a node's
bitset intersected with the postings of its members' next turns gives its children; the number of
bits is a node's number of members, and what ends at its depth its end list. A turn is its digest,
a node the digest of its path.

The same node of several shards is one row of each, however many conversations share it; an
aggregation by path makes them one. Sums over subtrees are taken within shards again: every shard
knows all ancestors of its nodes, so each node that several conversations share is counted in one
of its shards, its owner, for all nodes above, and a second aggregation by path adds the shards.
So a beginning that a third of all conversations share never gathers in one task, and the number
of steps doesn't depend on how deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import kept

#: Conversations and turns of a shard, which a task holds (a bit, and a digest of 16 bytes, each).
CONVERSATIONS, TURNS = 4_096, 131_072
ROOT = b"\0" * 16


def sequences(conversations: DataFrame) -> DataFrame:
    """`conversations(conv_id, turn, role, text, ...)` -> `(conv_id, turns ARRAY<STRUCT<key BINARY, size
    BIGINT>>)`: each conversation's turns in order, null first: a digest of role and text, and the
    text's bytes in UTF-8. Null roles and texts are empty. Turns with equal numbers lie in the
    order of their digests; rows without a conv_id belong to no conversation and are left out. Texts
    don't leave their tasks; one conversation's digests, about thirty bytes a turn, are one row."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", key.alias("key"), F.octet_length(text).cast("bigint").alias("size"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    listed = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def grafted(found: DataFrame, family: int = 5, longest: int = 9) -> DataFrame:
    """`sequences` rebuilt: conversation c begins with the first h turns of conversation c - c % family
    (all if fewer, none if absent) and goes on with its own turns after its first h; h is
    crc32(c in decimal) % longest. Remainders have the sign of c."""
    donor = F.col("conv_id") - F.col("conv_id") % family
    heads = found.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_donor"), F.slice("turns", 1, longest - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    rows = found.join(heads, donor == F.col("_donor"), "left").withColumn("_h", h)
    head = F.when(F.col("_head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("_head", F.lit(1), F.col("_h")))
    rest = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return rows.select("conv_id", F.concat(head, rest).alias("turns"))


def bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


LOCAL = "shard int, path binary, parent binary, depth bigint, size bigint, n bigint, least bigint, ends array<bigint>"


def depth_first(group: pa.Table) -> pa.Table:
    """One shard's conversations -> its nodes (see LOCAL): `size` is the bytes of the node's last text,
    `least` its smallest member, `ends` the members that end there, ascending."""
    group = group.sort_by("conv_id")  # so the lowest bit of a set is its least member
    ids = group.column("conv_id").to_pylist()
    turns = group.column("turns").combine_chunks()
    ends = np.asarray(turns.offsets, np.int64).tolist()
    flat = turns.flatten()
    base = ends[0]
    keys, sizes = flat.field("key").to_pylist(), flat.field("size").to_pylist()
    keys = [keys[a - base : b - base] for a, b in zip(ends, ends[1:], strict=False)]
    sizes = [sizes[a - base : b - base] for a, b in zip(ends, ends[1:], strict=False)]
    postings: list[dict[bytes, int]] = [{} for _ in range(max(map(len, keys)))]
    over: dict[int, int] = {}
    for i, own in enumerate(keys):
        bit = 1 << i
        for at, key in zip(postings, own, strict=False):
            at[key] = at.get(key, 0) | bit
        over[len(own)] = over.get(len(own), 0) | bit
    rows: list[tuple] = []
    stack: list[tuple[int, int, bytes, bytes | None, int]] = [((1 << len(ids)) - 1, 0, ROOT, None, 0)]
    while stack:
        members, depth, path, parent, size = stack.pop()
        first = (members & -members).bit_length() - 1
        ended = members & over.get(depth, 0)
        rows.append((path, parent, depth, size, members.bit_count(), ids[first], [ids[i] for i in bits(ended)]))
        rest = members ^ ended
        while rest:
            one = (rest & -rest).bit_length() - 1
            key = keys[one][depth]
            child = rest & postings[depth][key]
            stack.append((child, depth + 1, hashlib.blake2b(path + key, digest_size=16).digest(), path, sizes[one][depth]))
            rest ^= child
    path, parent, depth, size, n, least, ended = zip(*rows, strict=True)
    long = pa.int64()
    columns = [pa.array(path, pa.binary()), pa.array(parent, pa.binary()), *[pa.array(c, long) for c in (depth, size, n, least)], pa.array(ended, pa.list_(long))]
    shard = pa.array(np.full(len(rows), group.column("shard")[0].as_py(), np.int32))
    return pa.table([shard, *columns], names=[x.split()[0] for x in LOCAL.split(", ")])


def subtree_sums(group: pa.Table) -> pa.Table:
    """One shard's shared nodes with values -> the sums of the values over their subtrees."""
    path, parent = group.column("path").to_pylist(), group.column("parent").to_pylist()
    leaves, saved = group.column("leaves").to_pylist(), group.column("saved").to_pylist()
    at = {p: i for i, p in enumerate(path)}
    for i in np.argsort(-np.asarray(group.column("depth")), kind="stable").tolist():
        if parent[i] is not None:
            up = at[parent[i]]
            leaves[up] += leaves[i]
            saved[up] += saved[i]
    return pa.table([pa.array(path, pa.binary()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], names=["path", "leaves", "saved"])


def digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows `(path, conv_id)` in this order -> each path's hash of its ids, joined by commas. A list of
    any length passes through batch by batch; SHA-256 has to read it in order."""
    now, text = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        paths = batch.column("path").to_pylist()
        names = batch.column("conv_id").cast(pa.string()).to_pylist()
        for path, name in zip(paths, names, strict=True):
            if path != now:
                if text:
                    done.append((now, text.hexdigest()))
                now, text = path, hashlib.sha256(name.encode())
            else:
                text.update(b"," + name.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["path", "ends_sha256"])
    if text:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([text.hexdigest()])], names=["path", "ends_sha256"])


def trie(found: DataFrame, conversations: int = CONVERSATIONS, turns: int = TURNS) -> DataFrame:
    """`sequences` -> `(path, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)`, a row per node: a distinct sequence of first turns, from the root.

    conv_id and parent_conv_id are the smallest members of the node and of its parent (root: null).
    n_leaves counts the childless nodes of the subtree, saved_tokens the bytes that members after
    the first would repeat: (members - 1) times the last text's bytes, summed over the subtree. Both
    include the node itself. ends_sha256 is the hash of the members that end here, in decimal,
    ascending, joined by commas (of none: of the empty text). A conversation without turns is a
    member of the root. No conversations: no rows.

    A shard has about `conversations` conversations and `turns` turns. Paths are compared by digests
    of 128 bits.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = found.agg(F.count("*").alias("n"), F.sum(F.size("turns").cast("bigint")).alias("turns")).first()
    shards = max(1, -(-size["n"] // conversations), -(-(size["turns"] or 0) // turns), min(parts, size["n"] // 256))
    dealt = found.select(F.pmod(F.xxhash64("conv_id"), F.lit(shards)).cast("int").alias("shard"), "conv_id", "turns")
    local = kept(dealt.groupBy("shard").applyInArrow(depth_first, LOCAL), "local")
    same = [F.first(c).alias(c) for c in ("parent", "depth", "size")]
    nodes = kept(local.groupBy("path").agg(*same, F.sum("n").alias("n"), F.min("least").alias("least"), F.min("shard").alias("owner")), "nodes")
    below = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("single"))
    below = kept(below.withColumnRenamed("parent", "path"), "children")

    leaf = F.coalesce("single", F.lit(0)) + F.when(F.col("n_children").isNull(), 1).otherwise(0)
    shared = nodes.where("n > 1").join(below, "path", "left").select("path", "owner", leaf.cast("bigint").alias("leaves"), ((F.col("n") - 1) * F.col("size")).alias("saved"))
    mine = lambda c: F.when(F.col("shard") == F.col("owner"), F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c)
    valued = local.select("shard", "path", "parent", "depth").join(kept(shared, "shared"), "path").select("shard", "path", "parent", "depth", mine("leaves"), mine("saved"))
    sums = valued.groupBy("shard").applyInArrow(subtree_sums, "path binary, leaves bigint, saved bigint").groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    ended = local.select("path", F.explode("ends").alias("conv_id")).repartition(parts, "path").sortWithinPartitions("path", "conv_id")
    digests = ended.mapInArrow(digested, "path binary, ends_sha256 string")
    none = lambda kind: F.lit(None).cast(kind)
    facts = below.select("path", "n_children", none("bigint").alias("leaves"), none("bigint").alias("saved"), none("string").alias("ends_sha256"))
    facts = facts.unionByName(sums.select("path", none("bigint").alias("n_children"), "leaves", "saved", none("string").alias("ends_sha256")))
    facts = facts.unionByName(digests.select("path", none("bigint").alias("n_children"), none("bigint").alias("leaves"), none("bigint").alias("saved"), "ends_sha256"))
    facts = facts.groupBy("path").agg(*[F.max(c).alias(c) for c in ("n_children", "leaves", "saved", "ends_sha256")])
    whole = nodes.join(facts, "path", "left")
    # The root's children may be as many as the conversations: its only value goes to them as one row.
    top = F.broadcast(nodes.where("depth = 0").select(F.col("least").alias("top")))
    upper = nodes.where("depth > 0").select(F.col("path").alias("_path"), F.col("least").alias("_least"))
    out = whole.crossJoin(top).join(upper, F.when(F.col("depth") > 1, F.col("parent")) == F.col("_path"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "path", "parent", F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.col("top")).otherwise(F.col("_least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), zero("n_children"), F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
