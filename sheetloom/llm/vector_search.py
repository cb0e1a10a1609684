"""Exact top-k search by inner product: a ball tree with branch and bound in every shard.

Vectors are dealt into shards, queries into blocks; a task has one block and
one shard, both of bounded size.  A shard's vectors form a ball tree.  A node
can hold no score above ``q . center + |q| radius``; nodes are visited in the
order of that bound, for all queries of the block that it still concerns, and
left once it is under a query's k-th score.  The k-th score is shared: every
block first searches one shard, and the scores found there are the lower bounds
with which all shards are searched.

Components become ``floor(256 * x)``, so scores are whole.  They are exact: by
double arithmetic where no sum can pass 2 ** 53, else by Python's integers for
what the tree leaves.  The result shows them clipped to 64 bits, ranked by the
whole score.  Vectors that are null, or hold null or non-finite
components, and rows without an id take no part.  Vectors of different length
have no product.  A query is not matched with rows of its own id; queries equal
in id and vector are one query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.llm.batches import ready_workers
from sheetloom.session import materialize

SCALE = 256
SHARD = 8192  # vectors of a shard, about
LEAST_SHARDS = 24
BLOCK = 2048  # queries of a block, about
LEAF = 128
EXACT = 1 << 53
WIDE_BITS = 2112  # of the product of two vectors of doubles
NO_ID = np.iinfo(np.int64).max


class BallTree:
    """Balls around halves of the vectors, split at the median of the widest component."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centers, radii = [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = vectors[self.order[a:b]]
            center = rows.mean(axis=0)
            radius = math.sqrt(((rows - center) ** 2).sum(axis=1).max())
            node = len(self.spans)
            self.spans.append((a, b))
            self.children.append(None)
            centers.append(center)
            radii.append(radius)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            if b - a > leaf and radius > 0:
                widest = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, widest], half)]
                todo += [(a, a + half, node, 0), (a + half, b, node, 1)]
        self.centers, self.radii = np.array(centers), np.array(radii)


def _descend(queries: np.ndarray, tree: BallTree, slack: np.ndarray, least: Callable, visit: Callable) -> None:
    """Call ``visit(rows, members)`` for every leaf that may hold a score of at least ``least(rows)``, best bounds first.

    `slack` is what rounding may take from a bound.
    """
    lengths = np.sqrt((queries**2).sum(axis=1))

    def bounds(nodes: list[int], rows: np.ndarray) -> np.ndarray:
        return queries[rows] @ tree.centers[nodes].T + lengths[rows, None] * tree.radii[nodes] + slack[rows, None]

    every = np.arange(len(queries))
    root = bounds([0], every)[:, 0]
    agenda = [(-root.max(), 0, every, root)]
    while agenda:
        _, node, rows, bound = heapq.heappop(agenda)
        rows = rows[bound >= least(rows)]
        if not len(rows):
            continue
        if tree.children[node] is None:
            a, b = tree.spans[node]
            for x in range(a, b, 4 * LEAF):  # a leaf of equal vectors may be long
                visit(rows, tree.order[x : min(b, x + 4 * LEAF)])
            continue
        pair = list(tree.children[node])
        reach = bounds(pair, rows)
        for i, child in enumerate(pair):
            near = reach[:, i] >= least(rows)
            if near.any():
                heapq.heappush(agenda, (-reach[near, i].max(), child, rows[near], reach[near, i]))


def _slack(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """More than rounding can change a product of a query with one of `vectors`, or with a ball's center and radius."""
    longest = math.sqrt((vectors**2).sum(axis=1).max())
    return 1e-9 * np.sqrt((queries**2).sum(axis=1)) * 3 * longest


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and their ids for each query, best first, ties to smaller ids; -inf where there are fewer.

    Scores under a query's ``floor`` may be missing.  All scores must be exact in doubles.
    """
    best = np.full((len(queries), k), -np.inf)
    who = np.full((len(queries), k), NO_ID)

    def least(rows: np.ndarray) -> np.ndarray:
        return np.maximum(best[rows, -1], floor[rows])

    def merge(rows: np.ndarray, members: np.ndarray) -> None:
        scores = queries[rows] @ vectors[members].T
        scores[query_ids[rows, None] == ids[members]] = -np.inf
        better = scores.max(axis=1) >= least(rows)
        rows, scores = rows[better], scores[better]
        if len(rows):
            all_scores = np.concatenate([best[rows], scores], axis=1)
            all_ids = np.concatenate([who[rows], np.broadcast_to(ids[members], scores.shape)], axis=1)
            order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[rows], who[rows] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    _descend(queries, BallTree(vectors), _slack(queries, vectors) + 1e-6, least, merge)
    who[np.isneginf(best)] = NO_ID
    return best, who


def _scaled(components: np.ndarray) -> tuple[np.ndarray, int]:
    """``floor(256 * x)`` divided by 2 to the given power, so that no product overflows."""
    power = int(np.frexp(np.abs(components).max())[1]) + 8
    whole = np.abs(components) >= 2.0**60  # the floor changes nothing
    small = np.floor(SCALE * np.where(whole, 0.0, components))
    return np.where(whole, np.ldexp(components, 8 - power), np.ldexp(small, -power)), power


def _integers(components: np.ndarray) -> np.ndarray:
    """``floor(256 * x)`` as Python's integers."""
    out = np.empty(components.shape, dtype=object)
    out.flat = [int(x) * SCALE if abs(x) >= 2.0**60 else math.floor(SCALE * x) for x in components.ravel().tolist()]
    return out


def wide_search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """As `search`, for unscaled components of any size: per query (score, id), best first.

    The tree and the first look at a leaf work on rounded, scaled vectors; what
    may be among the k best is scored by Python's integers.
    """
    (q, q_power), (v, v_power) = _scaled(queries), _scaled(vectors)
    q_whole, v_whole = _integers(queries), _integers(vectors)
    slack = _slack(q, v) + 1e-290
    power = q_power + v_power

    def rounded(score: int) -> float:
        return score / (1 << power) if power >= 0 else float(score << -power)

    low = np.array([rounded(int(f)) if f > -float(1 << 63) else -np.inf for f in floor]) - slack
    hits: list[list[tuple[int, int]]] = [[] for _ in queries]

    def merge(rows: np.ndarray, members: np.ndarray) -> None:
        near = (q[rows] @ v[members].T >= (low - slack)[rows, None]) & (query_ids[rows, None] != ids[members])
        for row, mask in zip(rows.tolist(), near, strict=True):
            if mask.any():
                scores = v_whole[members[mask]] @ q_whole[row]
                found = zip((-s for s in scores), ids[members[mask]].tolist(), strict=True)
                hits[row] = heapq.nsmallest(k, [*hits[row], *found])
                if len(hits[row]) == k:
                    low[row] = max(low[row], rounded(-hits[row][-1][0]) - slack[row])

    _descend(q, BallTree(v), slack, lambda rows: low[rows], merge)
    return [[(-s, i) for s, i in found] for found in hits]


def _clipped(score: int) -> tuple[int, str | None]:
    """A score in 64 bits and, if it does not fit between their ends, text by which such scores sort."""
    if -(1 << 63) < score < (1 << 63) - 1:
        return score, None
    return max(-(1 << 63), min((1 << 63) - 1, score)), f"{(1 << WIDE_BITS) + score:0{WIDE_BITS // 4 + 1}x}"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _found(k: int):
    def found(table: pa.Table) -> pa.Table:
        is_query = table["is_query"].to_numpy(zero_copy_only=False).astype(bool)
        asked, held = table.filter(pa.array(is_query)), table.filter(pa.array(~is_query))
        columns: dict[str, list] = {"query_id": [], "query_key": [], "vec_id": [], "score": []}
        wide: list[str | None] | None = None
        if len(asked) and len(held):
            q, v = _matrix(asked["vector"]), _matrix(held["vector"])
            q_ids, ids, keys = asked["id"].to_numpy(), held["id"].to_numpy(), asked["query_key"].to_numpy()
            floor = asked["floor"].to_numpy(zero_copy_only=False).astype(np.float64)
            floor = np.where(np.isnan(floor), -np.inf, floor)
            largest = [int(np.abs(m).max(initial=0)) * SCALE + SCALE for m in (q, v)]
            if largest[0] * largest[1] * max(1, q.shape[1]) < EXACT:
                best, who = search(np.floor(SCALE * q), q_ids, floor, np.floor(SCALE * v), ids, k)
                rows, ranks = np.nonzero(~np.isneginf(best))
                columns = {"query_id": q_ids[rows], "query_key": keys[rows], "vec_id": who[rows, ranks], "score": best[rows, ranks].astype(np.int64)}
            else:
                wide = []
                for own, key, hits in zip(q_ids, keys, wide_search(q, q_ids, floor, v, ids, k), strict=True):
                    for s, i in hits:
                        score, text = _clipped(s)
                        wide.append(text)
                        for name, x in zip(columns, (own, key, i, score), strict=True):
                            columns[name].append(x)
        out = {name: pa.array(x, pa.int64()) for name, x in columns.items()}
        return pa.table({**out, "wide": pa.array(wide, pa.string()) if wide is not None else pa.nulls(len(out["score"]), pa.string())})

    return found


def top_k(vectors: DataFrame, is_query, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per query its k best other vectors: query_id, rank from 1, vec_id, score.

    `is_query` is a condition on ``id``.
    """
    ready_workers(vectors.sparkSession)
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    points = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"))
    points = points.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine).withColumn("dim", F.size("vector"))
    asked = points.where(is_query).withColumn("query_key", F.xxhash64("vector")).dropDuplicates(["id", "query_key"])
    n, n_asked = points.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards = max(LEAST_SHARDS, math.ceil(n / SHARD))
    blocks = max(1, math.ceil(n_asked / BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))
    held = points.withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)))
    common = ["dim", "block", "shard", "id", "query_key", "floor", "vector", "is_query"]

    def scored(questions: DataFrame, first_only: bool) -> DataFrame:
        every_block, every_shard = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(shards - 1))
        if first_only:
            every_block = F.filter(every_block, lambda b: F.pmod(b, F.lit(shards)) == F.col("shard"))
            every_shard = F.array(F.pmod(F.col("block"), F.lit(shards)).cast("int"))
        left = held.withColumns(
            {"block": F.explode(every_block), "query_key": F.lit(0).cast("long"), "floor": F.lit(None).cast("long"), "is_query": F.lit(False)}
        )
        right = questions.withColumns({"shard": F.explode(every_shard), "is_query": F.lit(True)})
        rows = left.select(common).unionByName(right.select(common))
        return rows.groupBy("dim", "block", "shard").applyInArrow(_found(k), "query_id bigint, query_key bigint, vec_id bigint, score bigint, wide string")

    first = scored(asked.withColumn("floor", F.lit(None).cast("long")), True)
    floors = first.groupBy("query_id", "query_key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = materialize(floors.select(F.col("query_id").alias("i"), F.col("query_key").alias("h"), "floor"), "search-floors")
    bounded = asked.join(floors, (F.col("id") == F.col("i")) & (F.col("query_key") == F.col("h")), "left")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.desc_nulls_last("wide"), "vec_id")
    ranked = scored(bounded, False).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
