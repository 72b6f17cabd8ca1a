"""Prefix trie of conversations: ternary search trees per range shard, merged along the shards' borders.

1. Turns get dictionary numbers: one range shuffle by digest of (role, text)
   puts equal turns side by side, each range numbers its own, and offsets (a row
   per range) make the numbers dense. No join, and a very common turn spans
   several ranges.
2. A conversation is then an array of turn numbers. Conversations are dealt to
   range shards in lexicographic order, so that a prefix lies in neighbouring
   shards. Each shard inserts its distinct sequences, the median first and then
   the medians of both halves, into a ternary search tree (which so is balanced)
   and accumulates members, leaves and savings over it without recursion.
3. Only nodes on a shard's first and last sequence can also lie in another
   shard. Those leave the shard as two open paths with what was accumulated
   beside them. ``GROUP`` neighbouring shards' paths are inserted into a tree of
   the same kind, which closes all nodes but those on the group's own two
   border paths, and so on until one group is left.
4. The digest of the conversations that end in a node is taken in its shard;
   for open nodes from the shards' pieces, in order, as a stream.

Defined results: rows without conv_id take no part; turns are ordered by turn
(null first), ties by role, then by the digest of role and text; null role or
text is empty; repeated rows are turns of their own; an empty table has no
nodes; other columns are ignored. A conversation is one record: its turn numbers
(8 bytes a turn, no text) are held in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from forumflow.llm.common import salted_left_join, ship, shuffle_parts, staged

#: Turns that a shard should hold at most and at least, and shards whose border paths one task merges.
SHARD_TURNS, LEAST_TURNS, GROUP = 1 << 18, 1 << 12, 256
NOBODY = (1 << 63) - 1
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, parent_key binary, key binary, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, ends_sha256 string")
_PATH = ("side int, ids array<bigint>, words array<bigint>, convs array<bigint>, members array<bigint>, kids array<bigint>, "
         "leaves array<bigint>, saved array<bigint>")
_ROW = f"kind string, shard int, {_NODE}, {_PATH}, first bigint, chunk string"
_INTS, _LONGS = pa.int64(), pa.list_(pa.int64())
_ROW_ARROW = pa.schema([
    ("kind", pa.string()), ("shard", pa.int32()), ("conv_id", _INTS), ("depth", _INTS), ("parent_conv_id", _INTS),
    ("parent_key", pa.binary()), ("key", pa.binary()), ("n_convs", _INTS), ("n_children", _INTS), ("n_leaves", _INTS),
    ("saved_tokens", _INTS), ("ends_sha256", pa.string()), ("side", pa.int32()), ("ids", _LONGS), ("words", _LONGS), ("convs", _LONGS),
    ("members", _LONGS), ("kids", _LONGS), ("leaves", _LONGS), ("saved", _LONGS), ("first", _INTS), ("chunk", pa.string())])
_BATCH = 20_000


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_pylist(held, schema=_ROW_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ROW_ARROW)


# -- turns and sequences ------------------------------------------------------

def _local_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of the distinct digests within the range, from 0; rows come sorted by digest."""
    part, last, rank = TaskContext.get().partitionId(), None, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        digest = batch.column(0)
        step = np.ones(batch.num_rows, np.int64)
        step[0] = digest[0].as_py() != last
        if batch.num_rows > 1:
            step[1:] = pc.not_equal(digest.slice(1), digest.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        ranks = rank + np.cumsum(step)
        last, rank = digest[batch.num_rows - 1].as_py(), int(ranks[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(ranks)],
                                         names=[*batch.schema.names, "part", "rank"])


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, id, words): id is the dense number of the distinct (role, text) in digest order."""
    spark = conversations.sparkSession
    ship(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    turns = staged(turns, "trie-turns")
    ranged = staged(turns.repartitionByRange(shuffle_parts(spark), "digest", "conv_id").sortWithinPartitions("digest").mapInArrow(
        _local_ranks, "digest binary, conv_id bigint, turn bigint, role string, words bigint, part int, rank bigint"), "trie-ranks")
    offsets, base, last = [], 0, None
    for r in sorted(ranged.groupBy("part").agg(F.min("digest").alias("low"), F.max("digest").alias("high"),
                                               F.max("rank").alias("top")).collect(), key=lambda r: r.part):   # a row per range
        base -= bytes(r.low) == last            # the range goes on with the turn that the one before ended with
        offsets.append((r.part, base))
        base, last = base + r.top + 1, bytes(r.high)
    offsets = spark.createDataFrame(offsets, "part int, base bigint")
    return ranged.join(F.broadcast(offsets), "part").select("conv_id", "turn", "role", (F.col("rank") + F.col("base")).alias("id"), "words")


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): each conversation's turns in order."""
    turn = F.struct("turn", "role", "id", "words")
    return (encoded_turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
            .select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words")))


def rebuilt(seqs: DataFrame, *, family: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, ids, words): a conversation c takes its first h turns, h = crc32(decimal c) % most, from
    conversation c - c % family (those there are) and keeps its own after its first h; % is never negative."""
    seqs = staged(seqs, "trie-sequences")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    heads = seqs.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("source"), *[F.slice(c, 1, most).alias(f"head_{c}") for c in ("ids", "words")])
    own = seqs.withColumn("h", h).withColumn("source", F.col("conv_id") - F.pmod("conv_id", F.lit(family)))
    none = F.array().cast("array<bigint>")

    def joined(c: str):
        return F.concat(F.slice(F.coalesce(F.col(f"head_{c}"), none), F.lit(1), F.col("h")),
                        F.slice(c, F.col("h") + 1, F.size(c))).alias(c)
    return own.join(heads, "source", "left").select("conv_id", joined("ids"), joined("words"))


# -- trees --------------------------------------------------------------------

class Tree:
    """A ternary search tree over turn numbers in parallel lists; node 0 is the root, a link 0 is none.

    ``up`` is the node of the prefix one turn shorter, made before the node
    itself, so falling node numbers visit the trie from the bottom up.
    """

    def __init__(self):
        self.symbol, self.low, self.equal, self.high = [0], [0], [0], [0]
        self.up, self.depth, self.words = [-1], [0], [0]
        self.members, self.conv, self.kids, self.leaves, self.saved = [0], [NOBODY], [0], [0], [0]

    def _new(self, symbol: int, up: int, words: int) -> int:
        for column, value in ((self.symbol, symbol), (self.low, 0), (self.equal, 0), (self.high, 0), (self.up, up),
                              (self.depth, self.depth[up] + 1), (self.words, words), (self.members, 0), (self.conv, NOBODY),
                              (self.kids, 0), (self.leaves, 0), (self.saved, 0)):
            column.append(value)
        return len(self.symbol) - 1

    def insert(self, ids: list[int], words: list[int]) -> list[int]:
        """The nodes of all prefixes of ``ids``, from the root; new ones where they are missing."""
        symbol, path, node = self.symbol, [0], 0
        for s, w in zip(ids, words):
            at = self.equal[node]
            if not at:
                at = self.equal[node] = self._new(s, node, w)
            while symbol[at] != s:
                side = self.low if s < symbol[at] else self.high
                if not side[at]:
                    side[at] = self._new(s, node, w)
                at = side[at]
            node = at
            path.append(node)
        return path

    def accumulate(self, open_nodes: set[int]) -> None:
        """Totals of every node but the open ones, which get those of their closed children."""
        for v in range(len(self.symbol) - 1, -1, -1):
            if v in open_nodes:
                continue
            if not self.kids[v]:
                self.leaves[v] += 1
            self.saved[v] += (self.members[v] - 1) * self.words[v]
            u = self.up[v]
            if u >= 0:
                self.members[u] += self.members[v]
                self.conv[u] = min(self.conv[u], self.conv[v])
                self.kids[u] += 1
                self.leaves[u] += self.leaves[v]
                self.saved[u] += self.saved[v]

    def keys(self, path: list[int], known: dict[int, bytes]) -> None:
        """Digests of the prefixes on the path, the same in every shard."""
        for v in path:
            if v not in known:
                known[v] = hashlib.sha256(known[self.up[v]] + self.symbol[v].to_bytes(8, "big")).digest() if v else b""

    def node_rows(self, shard: int, open_nodes: set[int], keys: dict[int, bytes], ends: dict[int, str] | None) -> Iterator[dict]:
        for v in range(len(self.symbol)):
            if v not in open_nodes:
                u = self.up[v]
                yield {"kind": "node", "shard": shard, "conv_id": self.conv[v], "depth": self.depth[v],
                       "parent_conv_id": self.conv[u] if u >= 0 and u not in open_nodes else None,
                       "parent_key": keys[u] if u in open_nodes else None, "key": keys.get(v), "n_convs": self.members[v],
                       "n_children": self.kids[v], "n_leaves": self.leaves[v], "saved_tokens": self.saved[v],
                       "ends_sha256": None if ends is None else ends.get(v, NO_ENDS)}

    def path_row(self, shard: int, side: int, path: list[int], skip: set[int]) -> dict:
        """An open path; nodes in ``skip`` carry their totals on the other path."""
        def of(column: list[int], none=0) -> list:
            return [none if v in skip else column[v] for v in path]
        return {"kind": "path", "shard": shard, "side": side, "ids": [self.symbol[v] for v in path[1:]],
                "words": [self.words[v] for v in path[1:]], "convs": of(self.conv, NOBODY), "members": of(self.members),
                "kids": of(self.kids), "leaves": of(self.leaves), "saved": of(self.saved)}


def median_order(n: int) -> Iterator[int]:
    """0 .. n - 1, each range's median before its two halves."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            todo += [(mid + 1, b), (a, mid)]


def _close(tree: Tree, shard: int, first: list[int], last: list[int], final: bool, keys: dict[int, bytes],
           ends: dict[int, str] | None) -> Iterator[dict]:
    """Nodes that no other shard can hold, and the two open border paths (none, if ``final``)."""
    open_nodes = set() if final else set(first) | set(last)
    tree.accumulate(open_nodes)
    yield from tree.node_rows(shard, open_nodes, keys, ends)
    if not final:
        yield tree.path_row(shard, 0, first, set())
        if last != first:
            yield tree.path_row(shard, 1, last, set(first))


def _shard(final: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shard = TaskContext.get().partitionId()
        runs: list[tuple[list[int], list[int], list[int]]] = []         # distinct sequence, its words, its conversations
        for batch in batches:
            for conv, ids, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if runs and runs[-1][0] == ids:
                    runs[-1][2].append(conv)
                else:
                    runs.append((ids, words, [conv]))
        if not runs:
            return
        tree, terminal = Tree(), [0] * len(runs)
        for i in median_order(len(runs)):
            terminal[i] = tree.insert(runs[i][0], runs[i][1])[-1]
        for v, (_, _, convs) in zip(terminal, runs):
            tree.members[v], tree.conv[v] = len(convs), convs[0]
        first, last = (tree.insert(r[0], r[1]) for r in (runs[0], runs[-1]))
        border, keys, ends = set() if final else set(first) | set(last), {}, {}
        if not final:
            tree.keys([*first, *last], keys)
        for v, (_, _, convs) in zip(terminal, runs):
            text = ",".join(map(str, convs))
            if v in border:
                yield {"kind": "ends", "shard": shard, "key": keys[v], "first": convs[0], "chunk": text}
            else:
                ends[v] = hashlib.sha256(text.encode()).hexdigest()
        yield from _close(tree, shard, first, last, final, keys, ends)

    return lambda batches: _batches(rows(batches))


def _merge(final: bool):
    """The open paths of neighbouring shards, merged to one tree."""
    def run(key, found):
        paths = sorted(found.to_pylist(), key=lambda r: (r["shard"], r["side"]))        # lexicographic order
        tree, nodes = Tree(), [[]] * len(paths)
        for i in median_order(len(paths)):
            r = paths[i]
            nodes[i] = tree.insert(r["ids"], r["words"])
            for at, v in enumerate(nodes[i]):
                tree.members[v] += r["members"][at]
                tree.conv[v] = min(tree.conv[v], r["convs"][at])
                tree.kids[v] += r["kids"][at]
                tree.leaves[v] += r["leaves"][at]
                tree.saved[v] += r["saved"][at]
        keys: dict[int, bytes] = {}
        for path in nodes:
            tree.keys(path, keys)
        rows = _close(tree, key[0].as_py(), nodes[0], nodes[-1], final, keys, None)
        return pa.Table.from_batches(_batches(rows), schema=_ROW_ARROW)
    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each key's pieces, which come in order; one state at a time."""
    key, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for k, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or state is None:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(chunk.encode())
            else:
                state.update(b"," + chunk.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))],
                                         names=["key", "found_ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "found_ends"])


def prefix_trie(seqs: DataFrame, *, shard_turns: int = SHARD_TURNS, least_turns: int = LEAST_TURNS, group: int = GROUP) -> DataFrame:
    """A row per node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``seqs`` is (conv_id, ids, words), one row per conv_id."""
    spark = seqs.sparkSession
    ship(spark)
    seqs = staged(seqs.select("conv_id", "ids", "words"), "trie-rebuilt")
    turns = seqs.agg(F.sum(F.size("ids") + 1)).head()[0] or 0
    shards = max(-(-turns // shard_turns), min(shuffle_parts(spark), -(-turns // least_turns)), 1)
    built = staged(seqs.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
                   .select("conv_id", "ids", "words").mapInArrow(_shard(shards == 1), _ROW), "trie-shards")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = built.where("kind = 'node'").select("parent_key", *columns)
    if shards == 1:
        return nodes.select(*columns)
    level, merged = built, None
    while shards > 1:
        shards = -(-shards // group)
        paths = level.where("kind = 'path'").withColumn("group", F.floor(F.col("shard") / group).cast("int"))
        level = staged(paths.groupBy("group").applyInArrow(_merge(shards == 1), _ROW), "trie-merged")
        closed = level.where("kind = 'node'").select("key", "parent_key", *columns)
        merged = closed if merged is None else merged.unionByName(closed)
    ends = (built.where("kind = 'ends'").select("key", "chunk", "first").repartition("key").sortWithinPartitions("key", "first")
            .select("key", "chunk").mapInArrow(_ends, "key binary, found_ends string"))
    merged = staged(merged.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("found_ends", F.lit(NO_ENDS)))
                    .select("key", "parent_key", *columns), "trie-borders")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    rows = salted_left_join(nodes.unionByName(merged.drop("key")), parents, "parent_key", row_bytes=64)
    return rows.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found")).select(*columns)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(sequences(conversations)))
