"""Prefix trie of conversations: ternary search trees per range of the sorted turn sequences, merged at their edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sitelode.llm.common import shuffle_partitions
from sitelode.session import materialize

#: Turns of the sequences that one range shard holds, about.
SHARD_TURNS = 200_000
#: Neighbouring ranges whose edges one task merges.
FAN_IN = 64
#: Ids of one piece of a member list.
PIECE_IDS = 100
OUT_ROWS = 10_000
TURNS = "array<struct<id: bigint, bytes: bigint>>"
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: Rows of a shard or a merge. Finished nodes have no `shard`; open ones, on the shard's first (path 0) or last sequence
#: (path 1, below the nodes they share), hold what is finished below them.
ROWS = pa.schema(
    [("shard", pa.int32()), ("path", pa.int32())]
    + [(n, pa.int64()) for n in ("depth", "turn_id", "bytes", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("key", pa.binary()), ("parent_key", pa.binary()), ("ends", pa.string())]
)
ROWS_DDL = (
    "shard int, path int, depth bigint, turn_id bigint, bytes bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, key binary, parent_key binary, ends string"
)


def turn_lists(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as dictionary ids with the UTF-8 bytes of their texts.

    Turns are ordered by `turn`, null first, then by id. Two turns have one id when role and text are equal; a null role
    or text is empty. Rows without a conversation are left out; repeated rows are turns of their own. An empty table
    gives no rows; other columns are not read. Ids follow the order of the turns' SHA-256 digests: texts are read once and
    never shuffled, digests are sorted in ranges and numbered there. One conversation is one row, 16 bytes a turn.
    """
    role_text, turn_text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role_text).cast("string"), F.lit(":"), role_text, turn_text), 256))
    coded = materialize(
        df.filter(F.col(conv).isNotNull()).select(
            F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"),
            F.octet_length(turn_text).cast("bigint").alias("bytes"),
        ),
        "turns",
    )
    ranged = coded.select("digest").distinct().repartitionByRange(shuffle_partitions(df.sparkSession), "digest")
    numbered = ranged.sortWithinPartitions("digest").select("digest", F.monotonically_increasing_id().alias("id"))
    encoded = coded.join(materialize(numbered, "turn-ids"), "digest")
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "id", "bytes")
    listed = encoded.groupBy("conv_id").agg(F.array_sort(F.collect_list(place)).alias("placed"))
    turns = F.transform("placed", lambda x: F.struct(x["id"].alias("id"), x["bytes"].alias("bytes")))
    return materialize(listed.select("conv_id", turns.cast(TURNS).alias("turns")), "turn-lists")


def respliced(lists: DataFrame, head: Column, *, every: int = 5, most: int) -> DataFrame:
    """Conversations with their first `head` turns (at most `most`) replaced by those of conversation c - c % `every`.

    That one gives all its turns if it has fewer, none if it is absent; a conversation with fewer turns keeps none of its own.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    own = lists.select("conv_id", "turns", base.alias("base"), head.cast("int").alias("head"))
    heads = lists.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("taken"))
    rest = F.slice("turns", F.col("head") + 1, F.greatest(F.size("turns") - F.col("head"), F.lit(0)))
    first = F.slice(F.coalesce("taken", F.array().cast(TURNS)), F.lit(1), F.col("head"))
    return own.join(heads, "base", "left").select("conv_id", F.concat(first, rest).alias("turns"))


def prefix_trie(lists: DataFrame, *, shards: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """Nodes of the trie over (conv_id, turns) as `turn_lists` gives them, one list per conversation.

    Every distinct sequence of first turns is a node, the empty one is the root. Columns: conv_id (smallest member), depth,
    parent_conv_id (the parent's, null for the root), n_convs (members), n_children, n_leaves (childless nodes in the
    subtree, itself included), saved_tokens (sum over the subtree of members beyond the first times the bytes of
    the node's last turn), ends_sha256 (SHA-256 of the decimal ids, ascending and joined by commas, of the members that end here).
    A conversation without turns belongs to the root alone. No conversations give no rows.

    Equal sequences become one row with their count first, so copies of any number never meet. The distinct ones are
    sorted and cut into ranges; each range is one ternary search tree, and only the nodes on its first and last sequence, which
    the neighbours may share, are merged, `fan_in` ranges in a task and in as many rounds as that needs. A task holds its
    range, or 2 x `fan_in` sequences. A member list is hashed as a stream in one task, because SHA-256 knows
    no other way, but sorted and joined before in ranges.
    """
    spark = lists.sparkSession
    ids = F.transform("turns", lambda x: x["id"].cast("string"))
    members = materialize(lists.select("conv_id", F.unhex(F.sha2(F.concat_ws(",", ids), 256)).alias("key"), "turns"), "members")
    groups = members.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    sequences = groups.join(members.select("conv_id", "turns"), "conv_id").join(_member_digests(members.select("key", "conv_id")), "key")
    whole = materialize(
        sequences.select(
            F.transform("turns", lambda x: x["id"]).alias("ids"), F.transform("turns", lambda x: x["bytes"]).alias("bytes"),
            "conv_id", "n_convs", "ends",
        ),
        "sequences",
    )
    total = whole.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    wanted = shards or max(shuffle_partitions(spark), ceil(total / SHARD_TURNS))
    ranged = whole.repartitionByRange(wanted, "ids").sortWithinPartitions("ids")
    rows = materialize(ranged.mapInArrow(_shard_rows, ROWS_DDL), "trie")
    parts, count = [rows.filter("shard IS NULL")], (rows.agg(F.max("shard")).first()[0] or 0) + 1
    while True:
        count = ceil(count / fan_in)
        opened = rows.filter("shard IS NOT NULL").withColumn("_group", F.floor(F.col("shard") / fan_in).cast("int"))
        rows = materialize(opened.groupBy("_group").applyInArrow(_merger(fan_in, count == 1), ROWS_DDL), "trie-edges")
        parts.append(rows.filter("shard IS NULL"))
        if count == 1:
            break
    inner, edges = parts[0], parts[1]
    for part in parts[2:]:
        edges = edges.unionByName(part)
    known = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    nodes = inner.unionByName(edges)
    settled = nodes.filter("parent_key IS NULL")
    referred = nodes.filter("parent_key IS NOT NULL").drop("parent_conv_id").join(known, "parent_key").withColumnRenamed("_parent", "parent_conv_id")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return settled.unionByName(referred).select(*columns, F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def _member_digests(members: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the sorted ids of each key."""
    parts = shuffle_partitions(members.sparkSession)
    ranged = members.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ranged.mapInArrow(_joined, "key binary, first bigint, ids string")
    return pieces.repartition(parts, "key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, ends string")


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one key as pieces of at most PIECE_IDS ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column("key"), batch.column("conv_id")
        new = np.concatenate([[True], pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
        at = np.arange(batch.num_rows)
        inside = at - np.maximum.accumulate(np.where(new, at, 0))
        starts = np.flatnonzero(inside % PIECE_IDS == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, batch.num_rows), pa.int32()), ids.cast(pa.string()))
        taken = pa.array(starts)
        yield pa.RecordBatch.from_arrays([keys.take(taken), ids.take(taken), pc.binary_join(lists, ",")], names=["key", "first", "ids"])


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def closed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["key", "ends"])

    key, state, done = None, None, []
    for batch in batches:
        for mine, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if mine == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                done.append((key, state.hexdigest()))
            key, state = mine, hashlib.sha256(ids.encode())
        if len(done) >= OUT_ROWS:
            yield closed(done)
            done = []
    if state is not None:
        yield closed([*done, (key, state.hexdigest())])


class TernaryTree:
    """Ternary search tree over turn ids: node 0 is the root of no turn, `equal` leads to the tree of the next turns."""

    def __init__(self):
        self.turn, self.less, self.equal, self.more = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.bytes = [-1], [0], [0]
        self.n, self.low, self.ends = [0], [None], [None]

    def _new(self, turn: int, size: int, parent: int) -> int:
        for values, value in (
            (self.turn, turn), (self.less, -1), (self.equal, -1), (self.more, -1), (self.parent, parent),
            (self.depth, self.depth[parent] + 1), (self.bytes, size), (self.n, 0), (self.low, None), (self.ends, None),
        ):
            values.append(value)
        return len(self.turn) - 1

    def insert(self, turns: list[int], sizes: list[int], low: int, n: int, ends: str) -> None:
        node = 0
        for turn, size in zip(turns, sizes):
            at, links, link = self.equal[node], self.equal, node
            while at >= 0 and self.turn[at] != turn:
                links, link = (self.less if turn < self.turn[at] else self.more), at
                at = links[at]
            if at < 0:
                at = links[link] = self._new(turn, size, node)
            node = at
        self.n[node], self.low[node], self.ends[node] = n, low, ends

    def path(self, turns: list[int]) -> list[int]:
        """Nodes of a sequence that was inserted, root first."""
        nodes = [0]
        for turn in turns:
            at = self.equal[nodes[-1]]
            while self.turn[at] != turn:
                at = self.less[at] if turn < self.turn[at] else self.more[at]
            nodes.append(at)
        return nodes

    def walked(self) -> list[int]:
        """All nodes, each before the nodes below it."""
        order, stack = [0], [self.equal[0]]
        while stack:
            node = stack.pop()
            if node >= 0:
                order.append(node)
                stack += (self.more[node], self.equal[node], self.less[node])
        return order


def median_order(n: int) -> Iterator[int]:
    """0..n-1, the middle of every part before its halves."""
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            stack += ((middle + 1, high), (low, middle))


def _emitted(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*rows), ROWS.types)], schema=ROWS)


def _shard_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range of sequences: its finished nodes, and the open ones on its first and last sequence."""
    shard, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
    if held:
        columns = [pa.Table.from_batches(held)[c].to_pylist() for c in ("ids", "bytes", "conv_id", "n_convs", "ends")]
        yield from _emitted(_tree_rows(shard, columns))


def _tree_rows(shard: int, columns: list[list]) -> Iterator[tuple]:
    ids = columns[0]
    tree = TernaryTree()
    for i in median_order(len(ids)):
        tree.insert(*(c[i] for c in columns))
    first, last = tree.path(ids[0]), tree.path(ids[-1])
    keys = _path_keys(first, ids[0]) | _path_keys(last, ids[-1])
    size = len(tree.turn)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    order = tree.walked()
    for node in reversed(order):
        parent = tree.parent[node]
        if parent < 0:
            continue
        tree.n[parent] += tree.n[node]
        if tree.low[parent] is None or tree.low[node] < tree.low[parent]:
            tree.low[parent] = tree.low[node]
        if node not in keys:
            leaves[node] += children[node] == 0
            saved[node] += (tree.n[node] - 1) * tree.bytes[node]
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    for node in order:
        parent = tree.parent[node]
        if node not in keys:
            known = parent not in keys
            yield (
                None, None, tree.depth[node], None, None, tree.low[node], tree.low[parent] if known else None, tree.n[node], children[node],
                leaves[node], saved[node], None, None if known else keys[parent], tree.ends[node],
            )
    shared = set(first)
    for path, nodes in enumerate((first, [v for v in last if v not in shared])):
        for v in nodes:
            yield (
                shard, path, tree.depth[v], tree.turn[v], tree.bytes[v], tree.low[v], None, tree.n[v], children[v], leaves[v], saved[v],
                keys[v], None, tree.ends[v],
            )


def _path_keys(nodes: list[int], turns: list[int]) -> dict[int, bytes]:
    """A key for each node of a path, made of all turns that lead there."""
    state = hashlib.blake2b(digest_size=16)
    keys = {nodes[0]: state.digest()}
    for node, turn in zip(nodes[1:], turns):
        state.update(turn.to_bytes(8, "little", signed=True))
        keys[node] = state.copy().digest()
    return keys


@dataclass(eq=False)
class OpenNode:
    depth: int
    turn: int
    bytes: int
    low: int
    n: int
    children: int
    leaves: int
    saved: int
    key: bytes
    ends: str | None
    parent: OpenNode | None
    on_first: bool
    closed: bool = False

    def close(self) -> None:
        self.closed = True
        self.leaves += self.children == 0
        self.saved += (self.n - 1) * self.bytes
        if self.parent:
            self.parent.children += 1
            self.parent.leaves += self.leaves
            self.parent.saved += self.saved

    def row(self, shard: int | None, path: int | None) -> tuple:
        known = self.parent is None or self.parent.closed
        low = self.parent.low if self.closed and self.parent and known else None
        return (
            shard, path, self.depth, self.turn, self.bytes, self.low, low, self.n, self.children, self.leaves, self.saved, self.key,
            None if known or not self.closed else self.parent.key, self.ends,
        )


def merged_edges(rows: list[dict], shard: int, last: bool) -> Iterator[tuple]:
    """Merge the open nodes of neighbouring ranges, given by (shard, path, depth).

    Sequences come in order, so a node is shared only with the path walked last. What leaves that path is finished, unless
    it is on the very first path; with `last` nothing comes before or after and all is finished.
    """
    first, stack, done = [], [], []

    def cut(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            if not node.on_first:
                node.close()
                done.append(node)

    for i, row in enumerate(rows):
        depth = row["depth"]
        if depth < len(stack) and stack[depth].key == row["key"]:
            node = stack[depth]
            node.n += row["n_convs"]
            node.low = min(node.low, row["conv_id"])
            node.children += row["n_children"]
            node.leaves += row["n_leaves"]
            node.saved += row["saved_tokens"]
            node.ends = node.ends or row["ends"]
        else:
            cut(depth)
            opening = row["shard"] == rows[0]["shard"] and row["path"] == 0
            node = OpenNode(
                depth, row["turn_id"], row["bytes"], row["conv_id"], row["n_convs"], row["n_children"], row["n_leaves"], row["saved_tokens"],
                row["key"], row["ends"], stack[-1] if stack else None, opening,
            )
            stack.append(node)
            if opening:
                first.append(node)
        ends_here = i + 1 == len(rows) or (rows[i + 1]["shard"], rows[i + 1]["path"]) != (row["shard"], row["path"])
        if ends_here:
            cut(depth + 1)
    if last:
        cut(0)
        for node in reversed(first):
            node.close()
            done.append(node)
        first = []
    for node in done:
        yield node.row(None, None)
    for node in first:
        yield node.row(shard, 0)
    for node in stack:
        if not node.on_first:
            yield node.row(shard, 1)


def _merger(fan_in: int, last: bool):
    def merge(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("shard", "ascending"), ("path", "ascending"), ("depth", "ascending")]).to_pylist()
        return pa.Table.from_batches(list(_emitted(merged_edges(rows, rows[0]["shard"] // fan_in, last))), ROWS)

    return merge
