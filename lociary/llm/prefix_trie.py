"""Conversation prefix trie: which beginnings conversations share, and what storing each shared turn once saves.

Every prefix of a conversation is known by two 64-bit hashes of its turns and their places, running totals over blocks of
a range sort. Grouping by them gives the nodes with their member counts. Nodes where conversations end or part are kept;
the others stand on an edge above one of those and share its members. Paths of kept nodes, one per different
conversation, are sorted, so that every subtree is one stretch, and dealt by range into shards.

A shard writes its part of the trie as balanced parentheses. Blocks of the excess with their minimum and maximum, and a
tree of these over the blocks, find the matching close of every node, which delimits its subtree; the rank of leaf pairs
between both places counts its leaves, a cumulative array of the savings sums them. A node on the first or last path of
a shard may go on in another shard: the same node's parts are added up (a leaf lies in one shard only, and a node's own
saving is counted where the conversation with its smallest id ends).

No conversation, node or list of copies meets in one task: paths hold kept nodes only (of one conversation at most the
square root of twice all rows), and the ids that end at a node are written in sorted pieces, hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lociary.llm.common import column_of, ship, store
from lociary.operators.keyed import attach
from lociary.operators.ordered import rank_within

BLOCK = 64
SHARD_NODES = 200_000
PIECE_IDS = 8192
NODE = ["depth", "p1", "p2"]


class Parentheses:
    """Balanced parentheses with a range min-max tree over blocks of the excess."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens.astype(bool)
        self.excess = np.cumsum(np.where(self.opens, 1, -1))
        self.rank = np.concatenate([[0], np.cumsum(self.opens)])
        padded = np.full(-(-max(1, len(opens)) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        padded[: len(opens)] = self.excess
        blocks = padded.reshape(-1, BLOCK)
        low, high = blocks.min(1), np.where(blocks == np.iinfo(np.int64).max, -1, blocks).max(1)
        self.levels = [(low, high)]
        while len(low) > 1:
            if len(low) % 2:
                low, high = np.append(low, np.iinfo(np.int64).max), np.append(high, -1)
                self.levels[-1] = (low, high)
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.levels.append((low, high))

    def _holds(self, level: int, block: np.ndarray, value: np.ndarray) -> np.ndarray:
        low, high = self.levels[level]
        inside = block < len(low)
        at = np.where(inside, block, 0)
        return inside & (low[at] <= value) & (value <= high[at])

    def _scan(self, start: np.ndarray, value: np.ndarray, out: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Look from ``start`` to the end of its block; those without a hit are returned."""
        at = start.copy()
        left = np.arange(len(at))
        first = True
        while len(left):
            here = at[left]
            inside = (here < len(self.excess)) & (first | (here % BLOCK != 0))
            hit = np.zeros(len(left), bool)
            hit[inside] = self.excess[here[inside]] == value[left[inside]]
            out[which[left[hit]]] = here[hit]
            left = left[inside & ~hit]
            at[left] += 1
            first = False
        return np.flatnonzero(out[which] < 0)

    def find_close(self, places: np.ndarray) -> np.ndarray:
        """Where the parenthesis opened at each place closes."""
        out = np.full(len(places), -1, np.int64)
        value = self.excess[places] - 1
        start = places + 1
        fresh = start % BLOCK == 0  # the block of the place ends with it
        inner = np.flatnonzero(~fresh)
        missed = self._scan(start[inner], value[inner], out, inner)
        todo = np.concatenate([np.flatnonzero(fresh), inner[missed]])
        block, stopped = places[todo] // BLOCK + 1, np.full(len(todo), -1)
        for level in range(len(self.levels)):  # up: the first block to the right that holds the value
            stopped[(stopped < 0) & self._holds(level, block, value[todo])] = level
            even = (stopped < 0) & (block % 2 == 0)
            block[even] += 1
            stopped[even & self._holds(level, block, value[todo])] = level
            block = np.where(stopped < 0, (block + 1) // 2, block)
        for level in range(len(self.levels) - 1, 0, -1):  # down: the left child if it holds the value
            going = stopped == level
            block[going] *= 2
            step = going & ~self._holds(level - 1, block, value[todo])
            block[step] += 1
            stopped[going] = level - 1
        self._scan(block * BLOCK, value[todo], out, todo)
        return out


def shard_sums(paths: list[tuple[int, list[tuple]]], root_conv: int) -> list[tuple]:
    """``(conv_id, depth, parent_conv_id, parent_depth, n_leaves, below)`` of every node on the paths of one shard.

    A path is the conversation that ends there and its kept nodes ``(depth, p1, p2, conv_id, n_convs, upto, n_children)``
    from the top, without the root; paths are sorted. ``below`` is what the nodes under this one save, as far as this
    shard counts them.
    """
    opens, nodes, parents, saved, childless = [1], [(0, 0, 0, root_conv, 0, 0, 1)], [-1], [0], [False]
    stack, before = [0], []
    for conv, path in paths:
        same = 0
        while same < min(len(path), len(before)) and path[same][:3] == before[same][:3]:
            same += 1
        for _ in range(len(before) - same):
            opens.append(0)
            stack.pop()
        for node in path[same:]:
            opens.append(1)
            parents.append(stack[-1])
            stack.append(len(nodes))
            nodes.append(node)
            saved.append(0)
            childless.append(node[6] == 0)
        for k in range(len(path) - 1, -1, -1):
            if path[k][3] != conv:
                break
            saved[stack[k + 1]] = (path[k][4] - 1) * (path[k][5] - (path[k - 1][5] if k else 0))
        before = path
    opens += [0] * len(stack)
    tree = Parentheses(np.array(opens))
    places = np.flatnonzero(tree.opens)
    closes = tree.find_close(places)
    # a pair that closes at once is a leaf, but for a node whose children are all in the next shard
    leaf = np.zeros(len(opens) + 1, np.int64)
    leaf[1:][places] = (closes == places + 1) & np.array(childless)
    leaves, sums = np.cumsum(leaf), np.concatenate([[0], np.cumsum(saved)])
    n_leaves = leaves[closes] - leaves[places]
    below = sums[tree.rank[closes]] - sums[tree.rank[places] + 1]
    return [
        (node[3], node[0], nodes[up][3] if up >= 0 else None, nodes[up][0] if up >= 0 else None, int(n), int(b))
        for node, up, n, b in zip(nodes, parents, n_leaves.tolist(), below.tolist())
    ]


def _running(rows: DataFrame, group: str, order: list[Column], folds: dict[str, tuple]) -> DataFrame:
    """Add running folds of each group; ``folds`` maps a new column to (aggregate function, column, what combines two)."""
    placed = store(rows.orderBy(F.col(group), *order).withColumn("__place", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("__block", F.shiftright("__place", 33))
    blocks = placed.groupBy(group, "__block").agg(*[f(c).alias(f"__{name}") for name, (f, c, _) in folds.items()])
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(group, "__block", F.count(F.lit(1)).over(before).alias("__n"), *[f(f"__{name}").over(before).alias(f"__{name}") for name, (f, _, _) in folds.items()])
    # only groups that span blocks have something to carry: at most one row per block
    out = attach(placed, carried.filter("__n > 0").drop("__n"), [group, "__block"], "left")
    inside = Window.partitionBy(group, "__block").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    for name, (f, c, both) in folds.items():
        here = f(c).over(inside)
        out = out.withColumn(name, F.when(F.col(f"__{name}").isNull(), here).otherwise(both(here, F.col(f"__{name}"))))
    return out.drop("__place", "__block", *[f"__{name}" for name in folds])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, at, t1, t2, words`` per row of ``conversations (conv_id, turn, role, text)`` with a conversation.

    ``at`` counts from 0 by turn (null first), then role, then a hash of the text. Null roles and texts are empty;
    ``t1, t2`` are hashes of both, ``words`` the words of the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(7), text, role).alias("t2"), words.alias("words"),
    )
    ranked = rank_within(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1"), F.col("t2")], "at")
    return ranked.select("conv_id", F.col("at").cast("long").alias("at"), "t1", "t2", "words")


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, p1, p2, q1, q2, words, upto``: the hashes of each turn's prefix and of the one before, words of the turn and up to it."""
    salted = turns.withColumn("x1", F.xxhash64("depth", "t1", "t2")).withColumn("x2", F.xxhash64(F.lit(1), "t2", "t1", "depth"))
    folds = {"p1": (F.bit_xor, "x1", _xor), "p2": (F.bit_xor, "x2", _xor), "upto": (F.sum, "words", lambda a, b: a + b)}
    rows = _running(salted, "conv_id", [F.col("depth")], folds)
    return rows.select("conv_id", "depth", "p1", "p2", _xor(F.col("p1"), F.col("x1")).alias("q1"), _xor(F.col("p2"), F.col("x2")).alias("q2"), "words", "upto")


def _end_digests(ends: DataFrame, piece_ids: int) -> DataFrame:
    """``depth, p1, p2, ends_sha256``: the digest of the ids, ascending and joined by commas, that end at each node."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def piece() -> pa.RecordBatch:
            columns = [[node[0]], [node[1]], [node[2]], [ids[0]], [",".join(map(str, ids))]]
            kinds = [pa.int64()] * 4 + [pa.string()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NODE, "first", "ids"])

        for batch in batches:
            for *at, conv in zip(*(column_of(batch, c).to_pylist() for c in [*NODE, "conv_id"])):
                if ids and (at != node or len(ids) == piece_ids):
                    yield piece()
                    ids = []
                node = at
                ids.append(conv)
        if ids:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def digest(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[]] * 4
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=[*NODE, "ends_sha256"])

        for batch in batches:
            found = []
            for *at, ids in zip(*(column_of(batch, c).to_pylist() for c in [*NODE, "ids"])):
                if at != node:
                    if node is not None:
                        found.append((*node, state.hexdigest()))
                    node, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield digest(found)
        if node is not None:
            yield digest([(*node, state.hexdigest())])

    ship(ends.sparkSession)
    key = "depth long, p1 long, p2 long"
    sorted_ids = ends.select(*NODE, "conv_id").orderBy(*NODE, "conv_id").mapInArrow(pieces, f"{key}, first long, ids string")
    return sorted_ids.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, f"{key}, ends_sha256 string")


def _subtree_sums(paths: DataFrame, root_conv: int, shard_nodes: int) -> DataFrame:
    """The sums of every kept node over its subtree: shard by shard, then the parts of a node added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, size = [], 0

        def sums() -> pa.RecordBatch:
            columns = list(zip(*shard_sums(shard, root_conv)))
            names = ["conv_id", "depth", "parent_conv_id", "parent_depth", "n_leaves", "below"]
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            lists = column_of(batch, "path")
            offsets, flat = lists.offsets.to_pylist(), lists.values
            nodes = list(zip(*(flat.field(k).to_pylist() for k in range(flat.type.num_fields))))
            for k, conv in enumerate(column_of(batch, "conv_id").to_pylist()):
                shard.append((conv, nodes[offsets[k] : offsets[k + 1]]))
                size += offsets[k + 1] - offsets[k]
                if size >= shard_nodes:
                    yield sums()
                    shard, size = [], 0
        if shard:
            yield sums()

    ship(paths.sparkSession)
    schema = "conv_id long, depth long, parent_conv_id long, parent_depth long, n_leaves long, below long"
    parts = paths.orderBy("path").mapInArrow(run, schema)
    return parts.groupBy("conv_id", "depth").agg(
        F.max("parent_conv_id").alias("parent_conv_id"), F.max("parent_depth").alias("parent_depth"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("below").alias("below"),
    )


def prefix_trie(turns: DataFrame, members: DataFrame, shard_nodes: int = SHARD_NODES, piece_ids: int = PIECE_IDS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` per node of the trie.

    ``turns (conv_id, depth, t1, t2, words)`` has each turn once, depths counting from 1 without gaps; ``members
    (conv_id)`` has every conversation once, also those without turns, which end at the root (depth 0). A node is a
    distinct beginning of conversations, named by its smallest member; ``saved_tokens`` sums (n_convs - 1) * words over
    its subtree. A shard holds ``shard_nodes`` nodes of paths, a piece of an end list ``piece_ids`` ids; neither changes
    the result. An empty ``members`` gives an empty table.
    """
    spark = turns.sparkSession
    root = members.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv")).first()
    rows = store(_prefixes(turns), "prefixes")
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end"))
    ends = members.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"end.{c}"), F.lit(0)).cast("long").alias(c) for c in NODE])
    ends = store(ends, "ends")
    nodes = rows.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("node_conv"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
        F.min("words").alias("words"), F.min("upto").alias("upto"),
    )
    top = spark.range(1).filter(F.lit(root["n"] > 0)).select(
        *[F.lit(0).cast("long").alias(c) for c in NODE], F.lit(root["n"]).cast("long").alias("n_convs"), F.lit(root["conv"]).cast("long").alias("node_conv"),
        *[F.lit(0).cast("long").alias(c) for c in ("q1", "q2", "words", "upto")],
    )
    nodes = store(nodes.withColumn("depth", F.col("depth").cast("long")).unionByName(top), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    ended = ends.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_ends"), F.min("conv_id").alias("end_conv"))
    nodes = nodes.join(children, NODE, "left").join(ended, NODE, "left").join(_end_digests(ends, piece_ids), NODE, "left")
    nodes = store(nodes.na.fill(0, ["n_children", "n_ends"]).withColumn("kept", F.expr("depth = 0 OR n_children <> 1 OR n_ends > 0")), "nodes")
    # the path of a node where conversations end: the kept nodes on the smallest of these conversations
    ending = nodes.filter("n_ends > 0 AND depth > 0").select(F.col("end_conv").alias("conv_id"))
    steps = attach(rows.select("conv_id", *NODE), ending, ["conv_id"], "left_semi")
    steps = attach(steps, nodes.filter("kept AND depth > 0").select(*NODE, "node_conv", "n_convs", "upto", "n_children"), NODE, "inner")
    step = F.struct(*NODE, "node_conv", "n_convs", "upto", "n_children")
    paths = steps.groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("path"))
    sums = _subtree_sums(paths, root["conv"], shard_nodes).withColumnRenamed("conv_id", "node_conv")
    told = F.when(F.col("kept"), F.struct((-F.col("depth")).alias("up"), "upto", "parent_depth", "parent_conv_id", "n_leaves", "below"))
    joined = nodes.join(sums, ["node_conv", "depth"], "left").withColumn("told", told)
    # the next kept node at or below each node, on its smallest member
    found = _running(joined.drop("parent_depth", "parent_conv_id", "n_leaves", "below"), "node_conv", [F.desc("depth")], {"kept_below": (F.max, "told", F.greatest)})
    k = F.col("kept_below")
    parent = F.when(F.col("depth") == k["parent_depth"] + 1, k["parent_conv_id"]).when(F.col("depth") > 0, F.col("node_conv"))
    alone = (F.col("depth") == 0) & (F.col("n_children") == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        F.col("node_conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children",
        F.when(alone, 1).otherwise(k["n_leaves"]).cast("long").alias("n_leaves"),
        (F.coalesce(k["below"], F.lit(0)) + (F.col("n_convs") - 1) * (k["upto"] - F.col("upto") + F.col("words"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
