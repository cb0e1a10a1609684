"""The trie of conversation prefixes, by ternary search trees over range shards.

Turns are numbered in a dictionary of all distinct (role, text); a conversation
is then a row of turn numbers.  Equal conversations collapse to one row with a
count, and the rows are dealt into range shards of their lexicographic order.
A task builds the ternary search tree of its shard, inserting medians first so
that the search stays balanced, walks it without recursion, and sums members,
children, leaves and savings from the leaves up.

A node's conversations are neighbours in the order, so only the prefixes of a
shard's first and last conversation can also be in other shards.  Those boundary
nodes leave a shard unfinished and are merged by joins: their sums add up, and
what boundary nodes themselves add to the nodes above is summed along the shards'
outer paths, where the least path through a node answers for it.

* Turns are ordered by number, those without one first, then by digest (MD5 of
  role and text).  Null roles and texts are empty.
* Rows without a conv_id belong to no conversation.  Repeated rows are turns.
* An empty table has no node, not even a root.  Other columns are not read.
* A task holds one shard: some `SHARD_TURNS` turns, of 8 bytes each in a row and
  about 60 in the tree.  A conversation is one row, so a single conversation of
  very many turns is bounded by its own length only.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.llm.batches import ready_workers
from sheetloom.llm.turns import turn_digest
from sheetloom.session import materialize, shuffle_partitions

SHARD_TURNS = 500_000
ID_BITS = 16  # ids that differ in their last bits only are joined in one piece
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_NODES = pa.schema(
    [
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved", pa.int64()), ("size", pa.int64()), ("seq_id", pa.string()), ("key", pa.string()),
        ("parent_key", pa.string()), ("paths", pa.list_(pa.int64())),
    ]
)
NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, "
    "size bigint, seq_id string, key string, parent_key string, paths array<bigint>"
)


# --------------------------------------------------------------------------
# conversations as rows of turn numbers
# --------------------------------------------------------------------------


def numbered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, ``place`` from 1, ``code`` (the turn's number in the dictionary) and ``size`` (code points of its text)."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    slim = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), turn_digest(who, what).alias("digest"),
        F.length(what).cast("long").alias("size"),
    )
    slim = materialize(slim, "trie-turns")
    dictionary = slim.groupBy("digest").agg(F.max("size").alias("size"))
    dictionary = materialize(dictionary.withColumn("code", F.monotonically_increasing_id()), "trie-dictionary")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = slim.drop("size").withColumn("place", F.row_number().over(order))
    return placed.join(dictionary, "digest").select("conv_id", "place", "code", "size")


def branched(turns: DataFrame) -> DataFrame:
    """Conversations whose first turns come from the first one of their hundred, ``(conv_id, part, place, code, size)``.

    Of each conversation its first h turns, h = crc32(conv_id) % 6, are replaced by the first h of conversation
    ``conv_id - conv_id % 100``, as many as there are.  A row without code stands for each conversation, which may be left empty.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    own = turns.where(F.col("place") > taken).select("conv_id", F.lit(2).alias("part"), "place", "code", "size")
    ids = turns.select("conv_id").distinct()
    takers = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("giver"), taken.alias("h")).where("h > 0")
    given = turns.where("place <= 5").select(F.col("conv_id").alias("g"), "place", "code", "size")
    lent = takers.join(given, (F.col("giver") == F.col("g")) & (F.col("place") <= F.col("h")))
    nothing = F.lit(None).cast("long")
    heads = ids.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), nothing.alias("code"), nothing.alias("size"))
    return heads.union(lent.select("conv_id", F.lit(1).alias("part"), "place", "code", "size")).union(own)


def plain(turns: DataFrame) -> DataFrame:
    """Conversations as they are, in the form of :func:`branched`."""
    nothing = F.lit(None).cast("long")
    heads = turns.select("conv_id").distinct().select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), nothing.alias("code"), nothing.alias("size"))
    return heads.union(turns.select("conv_id", F.lit(2).alias("part"), "place", "code", "size"))


def _sequences(parts: DataFrame) -> DataFrame:
    """conv_id, seq_id (tells its sequence), codes, sizes: one row a conversation."""
    rows = F.sort_array(F.collect_list(F.struct("part", "place", "code", "size")))
    listed = parts.groupBy("conv_id").agg(rows.alias("rows")).withColumn("rows", F.expr("slice(rows, 2, size(rows))"))
    return listed.select("conv_id", F.md5(F.array_join(F.col("rows.code").cast("array<string>"), ",")).alias("seq_id"), F.col("rows.code").alias("codes"), F.col("rows.size").alias("sizes"))


def _ends(sequences: DataFrame) -> DataFrame:
    """seq_id and the SHA-256 of its conv_ids in order; ids are joined in pieces, which one task reads one after the other."""
    pieces = sequences.groupBy("seq_id", F.shiftright("conv_id", ID_BITS).alias("at")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, hashlib.sha256()
        for batch in batches:
            seqs, sums = [], []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seq == current:
                    state.update(b",")
                else:
                    if current is not None:
                        seqs.append(current)
                        sums.append(state.hexdigest())
                    current, state = seq, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.string()), pa.array(sums, pa.string())], ["seq_id", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], ["seq_id", "ends_sha256"])

    ordered = pieces.repartition("seq_id").sortWithinPartitions("seq_id", "at")
    return ordered.select("seq_id", "ids").mapInArrow(digest, "seq_id string, ends_sha256 string")


# --------------------------------------------------------------------------
# one shard
# --------------------------------------------------------------------------


class TernaryTree:
    """A ternary search tree of sequences of numbers; node 0 is the root, which holds no number."""

    def __init__(self) -> None:
        self.code, self.size, self.parent, self.depth = array("q", [0]), array("q", [0]), array("q", [-1]), array("q", [0])
        self.lower, self.equal, self.higher = array("q", [-1]), array("q", [-1]), array("q", [-1])
        self.end: dict[int, int] = {}  # node -> sequence that ends there

    def _new(self, code: int, size: int, parent: int) -> int:
        for column, value in ((self.code, code), (self.size, size), (self.parent, parent), (self.depth, self.depth[parent] + 1)):
            column.append(value)
        for link in (self.lower, self.equal, self.higher):
            link.append(-1)
        return len(self.code) - 1

    def insert(self, codes: list[int], sizes: list[int], sequence: int) -> None:
        top = 0
        for code, size in zip(codes, sizes, strict=True):
            links, at = self.equal, top
            node = links[at]
            while node >= 0 and self.code[node] != code:
                links, at = (self.lower if code < self.code[node] else self.higher), node
                node = links[at]
            if node < 0:
                node = self._new(code, size, top)
                links[at] = node
            top = node
        self.end[top] = sequence

    def path(self, codes: list[int]) -> list[int]:
        """The nodes of a sequence that the tree holds, from the root."""
        out = [0]
        for code in codes:
            node = self.equal[out[-1]]
            while self.code[node] != code:
                node = self.lower[node] if code < self.code[node] else self.higher[node]
            out.append(node)
        return out

    def walk(self) -> list[int]:
        """All nodes, each after the node above it."""
        out, stack = [0], [self.equal[0]]
        while stack:
            node = stack.pop()
            if node >= 0:
                out.append(node)
                stack += (self.lower[node], self.higher[node], self.equal[node])
        return out


def _medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each range before its halves."""
    ranges = [(0, n)]
    for a, b in ranges:  # grows while it is read
        if a < b:
            middle = (a + b) // 2
            yield middle
            ranges += ((a, middle), (middle + 1, b))


def _keys(codes: list[int]) -> list[str]:
    """A digest of each prefix, from the empty one."""
    state = hashlib.md5()
    out = [state.hexdigest()]
    for code in codes:
        state.update(code.to_bytes(8, "little"))
        out.append(state.hexdigest())
    return out


def _shard(codes: list[list[int]], sizes: list[list[int]], seqs: list[str], counts: list[int], convs: list[int], shard: int) -> pa.RecordBatch:
    """The nodes of a shard's sequences, which are distinct and in order; see `NODES`."""
    tree = TernaryTree()
    for k in _medians(len(codes)):
        tree.insert(codes[k], sizes[k], k)
    n = len(tree.code)
    members, children, leaves, saved = (np.zeros(n, np.int64).tolist() for _ in range(4))
    least: list[int | None] = [None] * n
    edge: dict[int, str] = {}  # boundary nodes and their keys
    paths: dict[int, list[int]] = {}
    for side, k in enumerate(sorted({0, len(codes) - 1})):
        for node, key in zip(tree.path(codes[k]), _keys(codes[k]), strict=True):
            edge[node] = key
            paths.setdefault(node, []).append(2 * shard + side)
    order = tree.walk()
    for node in reversed(order):  # all below a node come before it
        k = tree.end.get(node)
        if k is not None:
            members[node] += counts[k]
            least[node] = convs[k] if least[node] is None else min(least[node], convs[k])
        if node not in edge:
            leaves[node] += not children[node]
            saved[node] += (members[node] - 1) * tree.size[node]
        up = tree.parent[node]
        if up >= 0:
            members[up] += members[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])
            children[up] += node not in edge
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    columns: dict[str, list] = {name: [] for name in _NODES.names}
    for node in order:
        up, k = tree.parent[node], tree.end.get(node)
        values = (
            least[node], tree.depth[node], least[up] if up >= 0 and up not in edge else None, members[node], children[node], leaves[node], saved[node],
            tree.size[node], seqs[k] if k is not None else None, edge.get(node), edge.get(up), paths.get(node),
        )
        for column, value in zip(columns.values(), values, strict=True):
            column.append(value)
    return pa.RecordBatch.from_pydict(columns, schema=_NODES)


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[list] = [[], [], [], [], []]
    for batch in batches:
        for held, column in zip(rows, batch.columns, strict=True):
            held.extend(column.to_pylist())
    if rows[0]:
        whole = _shard(*rows, shard=TaskContext.get().partitionId())
        for start in range(0, whole.num_rows, 10_000):
            yield whole.slice(start, 10_000)


# --------------------------------------------------------------------------
# merging shards
# --------------------------------------------------------------------------


def _merged(boundary: DataFrame) -> DataFrame:
    """Boundary nodes with the sums of all shards: key and the columns of the result but for the parent's conv_id."""
    nodes = boundary.groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"),
        F.sum("n_leaves").alias("inner_leaves"), F.sum("saved").alias("inner_saved"), F.max("size").alias("size"), F.max("seq_id").alias("seq_id"),
        F.max("parent_key").alias("parent_key"),
    )
    below = nodes.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("up")).agg(F.count(F.lit(1)).alias("outer"))
    nodes = nodes.join(below, F.col("key") == F.col("up"), "left").drop("up")
    nodes = nodes.withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    nodes = materialize(nodes, "trie-boundary")
    on_path = boundary.select("key", F.explode("paths").alias("path"))
    own = nodes.select(
        F.col("key").alias("k"), "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("own")
    )
    placed = on_path.join(own, F.col("key") == F.col("k")).drop("k")
    answers = on_path.groupBy(F.col("key").alias("k")).agg(F.min("path").alias("first_path"))
    placed = placed.join(answers, F.col("key") == F.col("k")).drop("k")
    mine = F.col("path") == F.col("first_path")
    below_here = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.select(
        "key", F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(below_here).alias("leaves"),
        F.sum(F.when(mine, F.col("own")).otherwise(0)).over(below_here).alias("own"),
    )
    sums = summed.groupBy(F.col("key").alias("k")).agg(F.sum("leaves").alias("outer_leaves"), F.sum("own").alias("outer_saved"))
    return nodes.join(sums, F.col("key") == F.col("k")).select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", (F.col("inner_leaves") + F.col("outer_leaves")).alias("n_leaves"),
        (F.col("inner_saved") + F.col("outer_saved")).alias("saved_tokens"), "seq_id",
    )


def trie_nodes(parts: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of conversations given as `branched` or `plain` gives them, one row a node: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 (of the ids of conversations that end there)."""
    spark = parts.sparkSession
    ready_workers(spark)
    sequences = materialize(_sequences(parts), "trie-sequences")
    distinct = sequences.groupBy("codes", "sizes", "seq_id").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    n_turns = sequences.agg(F.sum(F.size("codes"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), math.ceil(n_turns / shard_turns))
    dealt = distinct.repartitionByRange(shards, "codes").sortWithinPartitions("codes")
    nodes = materialize(dealt.mapInArrow(_shard_nodes, NODES), "trie-nodes")
    edge = materialize(_merged(nodes.where("key IS NOT NULL")), "trie-merged")
    over = edge.select(F.col("key").alias("k"), F.col("conv_id").alias("over"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "seq_id"]
    inside = nodes.where("key IS NULL").withColumnRenamed("saved", "saved_tokens")
    deep = inside.where("parent_key IS NULL").select(columns)
    hung = inside.where("parent_key IS NOT NULL").drop("parent_conv_id").join(over, F.col("parent_key") == F.col("k")).withColumnRenamed("over", "parent_conv_id")
    outer = edge.join(over, F.col("parent_key") == F.col("k"), "left").withColumnRenamed("over", "parent_conv_id")
    whole = deep.union(hung.select(columns)).union(outer.select(columns))
    ends = _ends(sequences).withColumnRenamed("seq_id", "s")
    ending = whole.where("seq_id IS NOT NULL").join(ends, F.col("seq_id") == F.col("s")).drop("s", "seq_id")
    return ending.unionByName(whole.where("seq_id IS NULL").drop("seq_id").withColumn("ends_sha256", F.lit(EMPTY_SHA256)))
