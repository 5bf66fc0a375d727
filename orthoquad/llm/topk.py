"""Exact top-k search by inner product with cover trees on both sides.

Rows are dealt into cells by their nearest pivot, and cells into blocks.  A
query first searches a block of its own cell, which bounds its k-th score from
below; it then goes to the cells that may hold a better row only.  A piece of
work holds a block of queries and a block of rows.  In it, a cover tree over
the queries and one over the rows are descended together.  With u and v the
centres of two nodes and p and q their covering radii, no inner product between
their points exceeds
    u.v + p |v| + q |u| + p q,
so a pair of nodes whose bound is below the worst k-th score of the node's
queries is pruned.  Leaf pairs are scored by one matrix product.  On vectors
without clusters hardly any pair is pruned, and cost is that of all products.

Components are floor(scale * x) with x as double, at most 2 ** 62 in size;
scores are exact integers, and those beyond 64 bits count as the nearest long.
Ties go to the smaller id.  Vectors that are null or hold
null or non-finite components, and rows with a null id, take no part; a vector
shorter than the longest is padded with zeros.  Rows that share an id are
candidates each, but not of a query with that id; equal rows ask once.  Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, materialize

LEAF = 128
#: Rows of a block of candidates and of a block of queries.
BLOCK = 16_384
QUERY_BLOCK = 4096
#: Pivots at most: a sample of rows of a fixed size, kept by the driver and sent with the tasks.
PIVOTS = 256
#: Children of a node at most; a node's children cover its points within ``SHRINK`` times its radius if that many can.
FANOUT = 16
SHRINK = 0.5
#: Splits in turn that leave nearly all points with one child, after which a node stays a leaf.
STALLS = 3
EXACT = 2.0**53
#: Stands for no score; no score is so small.
NOTHING = -(2**63) + 1
#: Queries and rows that one product holds at most.
TILE = (512, 2048)


@dataclass
class Node:
    centre: int  # a row of the node
    radius: float  # of the node's rows about its centre
    scale: float  # the children's centres lie at least so far apart, and their rows within it
    rows: np.ndarray
    smallest: int  # id under the node
    children: list[Node] = field(default_factory=list)
    worst: float = float(NOTHING)  # of the node's queries' k-th scores


def cover_tree(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Node:
    """A tree over all ``points`` (rows of float64).

    A node's first child has the node's own centre; each further one is the row
    farthest from those before.  Rows go to the nearest centre.  So the centres
    are at least ``scale`` apart and no row is farther than that from its own.
    """

    def away(rows: np.ndarray, centre: int) -> np.ndarray:
        gap = points[rows] - points[centre]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def grow(rows: np.ndarray, centre: int, distance: np.ndarray, stalls: int) -> Node:
        node = Node(centre, float(distance.max()), 0.0, rows, int(ids[rows].min()))
        if len(rows) <= leaf or node.radius == 0 or stalls == STALLS:
            return node
        nearest, owner, centres = distance.copy(), np.zeros(len(rows), np.int64), [centre]
        most = max(2, min(FANOUT, -(-len(rows) // leaf)))
        while len(centres) < most and nearest.max() > SHRINK * node.radius:
            centres.append(int(rows[nearest.argmax()]))
            new = away(rows, centres[-1])
            closer = new < nearest
            owner[closer] = len(centres) - 1
            nearest[closer] = new[closer]
        node.scale = float(nearest.max())
        sizes = np.bincount(owner, minlength=len(centres))
        stalls = stalls + 1 if sizes.max() > 0.9 * len(rows) else 0
        node.children = [grow(rows[owner == c], at, nearest[owner == c], stalls if sizes[c] == sizes.max() else 0) for c, at in enumerate(centres)]
        return node

    rows = np.arange(len(points))
    return grow(rows, 0, away(rows, 0), 0)


class Best:
    """The k best (score, id) of each query so far; ``floor`` is a score that k rows are known to reach."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.score = np.full((queries, k), NOTHING, np.int64)
        self.id = np.full((queries, k), 2**62, np.int64)
        self.worst = np.full(queries, NOTHING, np.int64) if floor is None else floor.astype(np.int64)
        self.scored = 0

    def offer(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """``score``: queries ``q`` x candidates ``ids``; a query's own id (``own``) is left out."""
        k = self.score.shape[1]
        self.scored += score.size
        other = own[:, None] != ids[None, :]
        hot = np.flatnonzero(((score >= self.worst[q][:, None]) & other).any(axis=1))
        if not len(hot):
            return
        score = np.where(other[hot], score[hot], NOTHING)
        by_id = np.argsort(ids, kind="stable")
        first = by_id[np.argsort(-score[:, by_id], axis=1, kind="stable")[:, :k]]
        both = np.concatenate([self.score[q[hot]], np.take_along_axis(score, first, axis=1)], axis=1)
        names = np.concatenate([self.id[q[hot]], ids[first]], axis=1)
        names[both == NOTHING] = 2**62
        by_name = np.argsort(names, axis=1, kind="stable")
        both, names = np.take_along_axis(both, by_name, axis=1), np.take_along_axis(names, by_name, axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :k]
        self.score[q[hot]] = np.take_along_axis(both, order, axis=1)
        self.id[q[hot]] = np.take_along_axis(names, order, axis=1)
        self.worst[q[hot]] = np.maximum(self.worst[q[hot]], self.score[q[hot], -1])


def dual_search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, leaf: int = LEAF, floor: np.ndarray | None = None) -> Best:
    """The k largest inner products of each query with the points, by descending both trees.

    Rows that score below a query's ``floor`` may be left out.  Products are
    made in float64 where that is exact, in int64 up to 64 bits, and in
    Python's integers beyond.
    """
    if not len(queries) or not len(points):
        return Best(len(queries), k)
    near_q, near_p = queries.astype(np.float64), points.astype(np.float64)
    norm_q, norm_p = np.sqrt((near_q**2).sum(axis=1)), np.sqrt((near_p**2).sum(axis=1))
    size = float(norm_q.max() * norm_p.max()) * 1.01
    best = Best(len(queries), k, floor)
    q_tree, p_tree = cover_tree(near_q, query_ids, leaf), cover_tree(near_p, ids, leaf)
    slack = 1 + 1e-9 * size

    def products(rows: np.ndarray, part: np.ndarray) -> np.ndarray:
        if size < EXACT:
            return np.rint(near_q[rows] @ near_p[part].T).astype(np.int64)
        if size < 2.0**62:
            return queries[rows] @ points[part].T
        found = queries[rows].astype(object) @ points[part].astype(object).T
        return np.clip(found, NOTHING + 1, 2**63 - 1).astype(np.int64)

    def bound(a: Node, b: Node) -> float:
        return float(near_q[a.centre] @ near_p[b.centre]) + a.radius * float(norm_p[b.centre]) + b.radius * float(norm_q[a.centre]) + a.radius * b.radius

    def score(a: Node, b: Node) -> None:
        reach = near_q[a.rows] @ near_p[b.centre] + b.radius * norm_q[a.rows] + slack
        rows = a.rows[reach >= best.worst[a.rows].astype(np.float64)]
        for y in range(0, len(b.rows) if len(rows) else 0, TILE[1]):
            part = b.rows[y : y + TILE[1]]
            for x in range(0, len(rows), TILE[0]):
                some = rows[x : x + TILE[0]]
                best.offer(some, products(some, part), ids[part], query_ids[some])
        a.worst = float(best.worst[a.rows].min())

    def descend(a: Node, b: Node) -> None:
        if bound(a, b) + slack < a.worst:
            return
        if not a.children and not b.children:
            score(a, b)
        elif a.children and (not b.children or a.radius >= b.radius):
            for c in a.children:
                descend(c, b)
            a.worst = min(c.worst for c in a.children)
        else:
            for c in sorted(b.children, key=lambda c: -bound(a, c)):
                descend(a, c)

    def prepare(a: Node) -> None:
        for c in a.children:
            prepare(c)
        a.worst = float(best.worst[a.rows].min())

    prepare(q_tree)
    descend(q_tree, p_tree)
    return best


def usable(id_col: str, vector_col: str) -> Column:
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad


def matrix(lists, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def place(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with _cell, the nearest pivot, and _far, the distance from it."""
    squares = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("_v"), pivots.shape[1]).astype(np.float64)
            cell = (squares - 2 * points @ pivots.T).argmin(axis=1)
            far = np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], names=[*batch.schema.names, "_cell", "_far"])

    return rows.mapInArrow(run, "_id long, _v array<long>, _key long, _query boolean, _cell int, _far double")


def visits(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray) -> DataFrame:
    """Queries with _floor, once per cell _to that may hold a row of that score or more."""
    size = np.sqrt((pivots**2).sum(axis=1)) + radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column("_v"), pivots.shape[1]).astype(np.float64)
            norm = np.sqrt((points**2).sum(axis=1))[:, None]
            reach = (points @ pivots.T + norm * radius) + 1e-9 * norm * size + 1
            floor = batch.column("_floor").to_numpy()
            at, cell = np.nonzero((reach >= floor[:, None].astype(np.float64)) | (floor[:, None] == NOTHING))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(cell, pa.int32())], names=[*batch.schema.names, "_to"])

    return queries.mapInArrow(run, "_id long, _v array<long>, _key long, _floor long, _to int")


def search_pieces(asked: DataFrame, offered: DataFrame, width: int, k: int) -> DataFrame:
    """The k best of each piece's rows for each of its queries; pieces are named by _to, _a and _b."""

    none = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "_key", "vec_id", "score")})

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        q_ids, p_ids = left.column("_id").to_numpy(), right.column("_id").to_numpy()
        best = dual_search(matrix(left.column("_v"), width), q_ids, matrix(right.column("_v"), width), p_ids, k, floor=left.column("_floor").to_numpy())
        at, rank = np.nonzero(best.score > NOTHING)
        return pa.table({"query_id": q_ids[at], "_key": left.column("_key").to_numpy()[at], "vec_id": best.id[at, rank], "score": best.score[at, rank]})

    # either side's columns anew, as both come from one table
    side = lambda rows, sign, names: rows.select(*((F.col(c) + 0).alias(f"{sign}{c}") for c in ("_to", "_a", "_b")), *(F.col(c).alias(c) for c in names)).groupBy(*(f"{sign}{c}" for c in ("_to", "_a", "_b")))
    return side(asked, "q", ("_id", "_v", "_key", "_floor")).cogroup(side(offered, "p", ("_id", "_v"))).applyInArrow(pair, "query_id long, _key long, vec_id long, score long")


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, query_modulus: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows for each row whose id is divisible by ``query_modulus``."""
    most = float(2**62)
    whole = F.transform(vector_col, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(scale) * x.cast("double")))).cast("long"))
    rows = vectors.where(usable(id_col, vector_col)).select(F.col(id_col).cast("long").alias("_id"), whole.alias("_v")).withColumn("_key", F.xxhash64("_id", "_v"))
    rows = rows.withColumn("_query", F.pmod("_id", F.lit(query_modulus)) == 0)
    order = Window.partitionBy("query_id", "_key").orderBy(F.desc("score"), "vec_id")
    block = lambda blocks, name, salt: F.pmod(F.xxhash64(name, F.lit(salt)), blocks).cast("int")
    upto = lambda blocks: F.sequence(F.lit(0), blocks - 1)
    per_cell = lambda numbers: F.get(F.array(*map(F.lit, numbers)), F.col("_to"))
    with Scratch(vectors.sparkSession, "topk") as scratch:
        n, width = rows.agg(F.count("*"), F.max(F.size("_v"))).first()
        width = max(width or 0, 1)
        sample = [r["_v"] for r in bounded_sample(rows.select("_v"), "_v", min(PIVOTS, -(-n // BLOCK)))]
        pivots = np.unique(np.array([v + [0] * (width - len(v)) for v in sample or [[]]], np.float64), axis=0)
        # the number tells repeated rows apart, so that these too are dealt evenly
        placed = scratch.write(place(rows, pivots).withColumn("_to", F.col("_cell")).withColumn("_number", F.monotonically_increasing_id()), "cells")
        asked = placed.where("_query").dropDuplicates(["_id", "_v"])
        cells = {r["_cell"]: r for r in placed.groupBy("_cell").agg(F.count("*").alias("n"), F.count_if("_query").alias("queries"), F.max("_far").alias("far")).collect()}
        blocks = [-(-cells[c]["n"] // BLOCK) if c in cells else 0 for c in range(len(pivots))]
        if len(cells) > 1:  # a first bound, from a block of the query's own cell
            parts = [-(-cells[c]["queries"] // (blocks[c] * QUERY_BLOCK)) or 1 if c in cells else 1 for c in range(len(pivots))]
            wanted = asked.withColumns({"_a": block(per_cell(blocks), "_key", 1), "_b": block(per_cell(parts), "_key", 2), "_floor": F.lit(NOTHING)})
            near = placed.withColumns({"_a": block(per_cell(blocks), "_number", 3), "_b": F.explode(upto(per_cell(parts)))})
            kth = search_pieces(wanted, near, width, k).groupBy("query_id", "_key").agg(F.min("score").alias("_floor"), F.count("*").alias("_n")).where(F.col("_n") == k)
            bounded = asked.join(kth.select(F.col("query_id").alias("_id"), "_key", "_floor"), ["_id", "_key"], "left").select("_id", "_v", "_key", F.coalesce("_floor", F.lit(NOTHING)).alias("_floor"))
            full = sorted(cells)
            going = visits(bounded, pivots[full], np.array([cells[c]["far"] for c in full])).withColumn("_to", F.get(F.array(*map(F.lit, full)), F.col("_to")))
        else:
            going = asked.select("_id", "_v", "_key", F.lit(NOTHING).alias("_floor"), "_to")
        going = scratch.write(going, "visits")
        visitors = {r["_to"]: r["count"] for r in going.groupBy("_to").count().collect()}
        groups = [-(-visitors.get(c, 0) // QUERY_BLOCK) for c in range(len(pivots))]
        wanted = going.withColumns({"_b": block(per_cell(groups), "_key", 4), "_a": F.explode(upto(per_cell(blocks)))})
        offered = placed.where(per_cell(groups) > 0).withColumns({"_a": block(per_cell(blocks), "_number", 5), "_b": F.explode(upto(per_cell(groups)))})
        found = search_pieces(wanted, offered, width, k) if visitors else search_pieces(going.withColumns({"_a": F.lit(0), "_b": F.lit(0)}), placed.withColumns({"_a": F.lit(0), "_b": F.lit(0)}).limit(0), width, k)
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return materialize(ranked.select("query_id", "rank", "vec_id", "score"), "topk-result")
