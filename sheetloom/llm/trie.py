"""Prefix trie of conversations as adaptive radix trees over turn ids.

A turn is named by a big-endian id of fixed width, the first 16 bytes of the SHA-256 of its role and text; a conversation's key is the ids of its turns
one after the other. The keys, sorted by range, are cut into shards, and every shard builds an adaptive radix tree of its keys: inner nodes of 4, 16, 48 or
256 children that grow as they fill, chains of single children compressed into one prefix. Byte depths that are a multiple of the width are turns and emit
the nodes of the prefix trie, also in the middle of a compressed chain; other depths emit none.

A node whose members lie in one shard is final there. Members of other nodes are neighbours in the sort order, so such nodes lie on the keys at shard ends, and
three numbers a shard tell which: how many turns its first key shares with the key before, how many its last key shares with the key behind, and whether the
key behind begins with the last one. Every node counts in the first shard that has it, and every leaf in the last, hence counts and tokens of shards add up, and
only these border nodes are aggregated by a shuffle, pre-aggregated by the trees. A first turn that a third of all conversations have, or a conversation with as
many copies, is spread over shards like any other.

The ids of the conversations that end at a node are hashed apart: they are gathered in chunks of 2 ** ``CHUNK_BITS`` consecutive ids, and the chunks of a node pass one
hasher in order, which keeps nothing but its state.

Defined results: rows without a conversation id are left out; a missing role or text is empty; turns stand by number, a missing one first, turns of one number
by the hash of role and text; a repeated row is a turn of its own; a conversation without turns after rebuilding ends at the root; an empty table has no
nodes; texts of any length stay where they are, only their ids and lengths move; columns other than the four play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetloom.llm.common import CRC_TABLE, crc32_sql, keep, query, table

WIDTH = 16
SHARD_ROWS = 20_000
CHUNK_BITS = 12
SHARED_TURNS, FAMILY = 9, 5
NODE = "node binary, parent binary, depth int, parent_id long, parent_border boolean, border boolean, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


class Node:
    """A node of the radix tree: a compressed prefix, what ends here, and children in the smallest of four layouts that holds them."""

    __slots__ = ("prefix", "ends", "layout", "bytes_", "children", "count")

    def __init__(self, prefix: bytes):
        self.prefix = prefix
        self.ends: list | None = None  # [members, smallest member, lengths of the turns of the key]
        self.layout, self.count = 4, 0
        self.bytes_: bytearray | None = bytearray()  # sorted bytes (4, 16), places by byte (48), none (256)
        self.children: list[Node | None] = []

    def find(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.bytes_.find(byte)
            return self.children[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes_[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, child: Node) -> None:
        """Add a child or replace the one of this byte."""
        if self.layout <= 16:
            at = self.bytes_.find(byte)
            if at >= 0:
                self.children[at] = child
                return
            if self.count == self.layout:
                self._grow()
                return self.put(byte, child)
            at = sum(b < byte for b in self.bytes_)
            self.bytes_.insert(at, byte)
            self.children.insert(at, child)
        elif self.layout == 48:
            at = self.bytes_[byte]
            if at:
                self.children[at - 1] = child
                return
            if self.count == 48:
                self._grow()
                return self.put(byte, child)
            self.children.append(child)
            self.bytes_[byte] = len(self.children)
        else:
            if self.children[byte] is not None:
                self.children[byte] = child
                return
            self.children[byte] = child
        self.count += 1

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            places = bytearray(256)
            for i, b in enumerate(self.bytes_):
                places[b] = i + 1
            self.layout, self.bytes_ = 48, places
        else:
            wide: list[Node | None] = [None] * 256
            for b in range(256):
                if self.bytes_[b]:
                    wide[b] = self.children[self.bytes_[b] - 1]
            self.layout, self.bytes_, self.children = 256, None, wide

    def items(self) -> Iterator[tuple[int, Node]]:
        """Children in order of their bytes."""
        if self.layout <= 16:
            yield from zip(self.bytes_, self.children)
        elif self.layout == 48:
            yield from ((b, self.children[at - 1]) for b, at in enumerate(self.bytes_) if at)
        else:
            yield from ((b, c) for b, c in enumerate(self.children) if c is not None)


def insert(root: Node, key: bytes, member: int, lengths: list[int]) -> None:
    """Add a key; the root's own prefix is empty. An edge holds the child's first byte in its parent and the rest in the child's prefix."""
    node, at = root, 0
    while at < len(key):
        child = node.find(key[at])
        if child is None:
            leaf = Node(key[at + 1 :])
            node.put(key[at], leaf)
            node, at = leaf, len(key)
            break
        rest, own = key[at + 1 :], child.prefix
        same = shared_bytes(rest, own)
        if same < len(own):
            middle = Node(own[:same])
            child.prefix = own[same + 1 :]
            middle.put(own[same], child)
            node.put(key[at], middle)
            child = middle
        node, at = child, at + 1 + same
    if node.ends is None:
        node.ends = [0, member, lengths]
    node.ends[0] += 1
    node.ends[1] = min(node.ends[1], member)


def shared_bytes(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """The number of turns that two keys begin with; -1 if there is no other key."""
    return -1 if a is None or b is None else shared_bytes(a, b) // WIDTH


class Turn:
    """A node of the prefix trie while its subtree is walked."""

    __slots__ = ("node", "depth", "members", "least", "children", "leaves", "saved", "old", "border")

    def __init__(self, node: bytes, depth: int, old: bool, border: bool):
        self.node, self.depth, self.old, self.border = node, depth, old, border
        self.members = self.children = self.leaves = self.saved = 0
        self.least: int | None = None


def turns_of(root: Node, first: bytes, last: bytes, before: int, behind: int, continued: bool) -> Iterator[tuple]:
    """NODE rows of a shard's tree. ``before`` and ``behind`` are the turns shared with the neighbours' keys.

    The walk keeps its own stack, as keys may be of any length. Values of a node are complete when its subtree is left, and so is its parent's
    smallest member only then; rows wait below their parent until it is left itself, one list for each open turn.
    """
    path = bytearray()
    # An entry enters a radix node by its byte (None at the root); a marker (-1, bytes) leaves what that entry opened.
    stack: list[tuple] = [(None, root)]
    open_: list[tuple[Turn, object, list]] = []

    def begin(depth: int, hasher) -> None:
        # Only the keys at the shard's ends can be shared, and only as far as the neighbour's key follows them.
        old = depth <= before and first.startswith(path[: depth * WIDTH])
        border = old or depth <= behind and last.startswith(path[: depth * WIDTH])
        open_.append((Turn(hasher.digest(), depth, old, border), hasher, []))

    def close() -> Iterator[tuple]:
        turn, _, below = open_.pop()
        yield from ((*row[:3], turn.least, turn.border, *row[3:]) for row in below)
        row = (turn.node, open_[-1][0].node if open_ else None, turn.depth, turn.border, turn.least, turn.members, turn.children, turn.leaves, turn.saved)
        if not open_:
            yield (*row[:3], None, False, *row[3:])
            return
        over = open_[-1][0]
        open_[-1][2].append(row)
        over.members += turn.members
        over.least = turn.least if over.least is None else min(over.least, turn.least)
        over.children += not turn.old
        over.leaves += turn.leaves
        over.saved += turn.saved

    def settle(turn: Turn, length: int) -> None:
        """Count the turn itself when its subtree is known; in later shards only what its members add."""
        turn.saved += (turn.members - (not turn.old)) * length

    lengths_at: list[int] = []

    def leave() -> Iterator[tuple]:
        settle(open_[-1][0], lengths_at.pop())
        yield from close()

    while stack:
        entry = stack.pop()
        if entry[0] == -1:
            size = entry[1]
            while len(open_) > 1 and open_[-1][0].depth * WIDTH > size:
                yield from leave()
            del path[size:]
            continue
        byte, node = entry
        if byte is None:
            begin(0, hashlib.sha256())
            lengths_at.append(0)
        else:
            stack.append((-1, len(path)))
            start = len(path)
            path.append(byte)
            path += node.prefix
            lengths = _some_lengths(node)
            for depth in range(start // WIDTH + 1, len(path) // WIDTH + 1):
                hasher = open_[-1][1].copy()
                hasher.update(path[(depth - 1) * WIDTH : depth * WIDTH])
                begin(depth, hasher)
                lengths_at.append(lengths[depth - 1])
        if node.ends is not None:
            turn = open_[-1][0]
            turn.members += node.ends[0]
            turn.least = node.ends[1] if turn.least is None else min(turn.least, node.ends[1])
            # Copies of a key come before what continues it, so the last shard that has the key knows.
            turn.leaves += not node.count and not (continued and last == path)
        stack.extend((b, c) for b, c in reversed(list(node.items())))
    while open_:
        yield from leave()


def _some_lengths(node: Node) -> list[int]:
    """The turn lengths of any key below a radix node; all of them share the turns above it."""
    while node.ends is None:
        node = next(c for _, c in node.items())
    return node.ends[2]


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn, 16 bytes."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * WIDTH))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, key, lengths): the turn ids of every rebuilt conversation and the UTF-8 bytes of its texts.

    The first h turns come from the conversation that opens its family of five, the others are the conversation's own after its first h.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("k"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("t"), turn_id(role, text).alias("id"), F.octet_length(text).alias("n")).alias("turn"),
    )
    whole = keep(own.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns")), "conversations")
    base = whole.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, SHARED_TURNS - 1).alias("_first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED_TURNS)).cast("int")
    both = whole.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % FAMILY, "_h": h}).join(base, "_base", "left")
    none = F.array().cast(base.schema["_first"].dataType)
    parts = F.concat(F.slice(F.coalesce("_first", none), F.lit(1), F.col("_h")), F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    found = both.select("conv_id", parts.alias("turns"))
    return found.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["id"])), "")).alias("key"), F.transform("turns", lambda x: x["n"]).alias("lengths"))


def _shards(keys: DataFrame, shard_rows: int) -> DataFrame:
    """Keys with the number of their shard, which follows the order of keys; copies of one key may lie in several."""
    count = max(1, -(-keys.count() // shard_rows))
    order = ["key", "conv_id"]
    return keep(keys.repartitionByRange(count, *order).withColumn("shard", F.spark_partition_id()), "trie-shards")


def _ends(shards: DataFrame) -> DataFrame:
    """(shard, before, behind, continued): one row of three numbers for each shard."""
    ends = shards.groupBy("shard").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.orderBy("shard")
    ends = ends.select("shard", "low", "high", F.lag("high").over(order).alias("prior"), F.lead("low").over(order).alias("next"))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, prior, behind = (batch.column(c).to_pylist() for c in ("low", "high", "prior", "next"))
            more = [n is not None and n.startswith(h) for h, n in zip(high, behind)]
            columns = [batch.column("shard"), pa.array(list(map(shared_turns, prior, low)), pa.int32()), pa.array(list(map(shared_turns, high, behind)), pa.int32()), pa.array(more, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "before", "behind", "continued"])

    return ends.mapInArrow(numbers, "shard int, before int, behind int, continued boolean")


def nodes(keys: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(node, parent_conv_id and the counts) of every node of the trie of keys (conv_id, key, lengths)."""
    shards = _shards(keys, shard_rows)

    def run(key: tuple, rows: pa.Table, ends: pa.Table) -> pa.Table:
        root, named = Node(b""), NAMES
        first = last = None
        for conv, k, lengths in zip(rows.column("conv_id").to_pylist(), rows.column("key").to_pylist(), rows.column("lengths").to_pylist()):
            insert(root, k, conv, lengths)
            first, last = k if first is None else min(first, k), k if last is None else max(last, k)
        found = turns_of(root, first, last, *(ends.column(c)[0].as_py() for c in ("before", "behind", "continued")))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found), KINDS)], names=named)

    made = shards.groupBy("shard").cogroup(_ends(shards).groupBy("shard")).applyInArrow(run, NODE)
    made = keep(made, "trie-nodes")
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    border = made.where("border").groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in counts])
    border = keep(border, "trie-border")
    columns = ["node", "depth", "conv_id", *counts]
    parents = border.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    inner = made.where("not border and not parent_border").select(*columns, F.col("parent_id").alias("parent_conv_id"))
    outer = made.where("not border and parent_border").select(*columns, "parent").join(parents, "parent").select(*columns, "parent_conv_id")
    return inner.unionByName(outer).unionByName(border.join(parents, "parent", "left").select(*columns, "parent_conv_id"))


NAMES = ["node", "parent", "depth", "parent_id", "parent_border", "border", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
KINDS = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5]


def ends(keys: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the comma-joined ids, ascending, of the conversations that end at a node."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    parts = keys.select(F.unhex(F.sha2("key", 256)).alias("node"), "conv_id", chunk.alias("chunk")).groupBy("node", "chunk")
    parts = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hasher = None, None
        for batch in batches:
            out = []
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if name == node:
                    hasher.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((node, hasher.hexdigest()))
                node, hasher = name, hashlib.sha256(ids.encode())
            yield _hashed(out)
        if node is not None:
            yield _hashed([(node, hasher.hexdigest())])

    return parts.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(run, "node binary, ends_sha256 string")


def _hashed(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], []]
    return pa.record_batch([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["node", "ends_sha256"])


def prefix_trie(turns: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for every node of the prefix trie of the rebuilt conversations of turns (conv_id, turn, role, text)."""
    keys = keep(rebuilt(turns), "trie-keys")
    whole = nodes(keys, shard_rows).join(ends(keys), "node", "left")
    found = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return whole.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", found)


SQL = f"""
WITH RECURSIVE {CRC_TABLE},
own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
keyed AS (SELECT conv_id, turns, {crc32_sql("conv_id::VARCHAR")} % {SHARED_TURNS} AS h FROM own, crc_table),
whole AS (SELECT k.conv_id, list_concat(coalesce(b.turns[1:k.h], k.turns[1:0]), k.turns[k.h + 1:]) AS turns FROM keyed k LEFT JOIN own b ON b.conv_id = k.conv_id - k.conv_id % {FAMILY}),
prefixes AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM whole),
members AS (
  SELECT depth, turns[1:depth] AS key, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth) AS ids
  FROM prefixes GROUP BY depth, turns[1:depth]
),
children AS (SELECT depth - 1 AS depth, key[1:depth - 1] AS key, count(*) AS n FROM members WHERE depth > 0 GROUP BY ALL),
full_nodes AS (
  SELECT m.*, coalesce(c.n, 0) AS n_children, CASE WHEN m.depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(m.key[m.depth].text) END AS own_tokens
  FROM members m LEFT JOIN children c ON c.depth = m.depth AND c.key = m.key
),
spread AS (SELECT unnest(range(depth + 1)) AS over, key, n_children, own_tokens FROM full_nodes),
sums AS (SELECT over AS depth, key[1:over] AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own_tokens) AS saved FROM spread GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.depth = n.depth AND s.key = n.key LEFT JOIN full_nodes p ON p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1]
"""


@query(SQL)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))
