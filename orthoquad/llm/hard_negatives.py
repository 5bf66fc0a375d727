"""Hard negatives by a vector-approximation file.

Each dimension is cut into cells, at quantiles of a bounded sample, and a
vector is stored as its cells' numbers, half a byte each.  For an anchor, a
table gives the least and greatest product of its component with any value of a
cell; sums of looked-up entries bound the score of every vector from both
sides.  Only vectors that may still come into the result are scored exactly:
for the positives those whose upper bound reaches the k-th lower bound, and for
a positive's window of scores those whose bounds meet the window and which k
vectors that surely lie in it don't beat.

Rows are dealt into blocks of bounded size, by label for the positives and over
all for the negatives, and anchors too; a piece of work is a pair of blocks.
So a hot label is just more blocks.  A piece returns the k best an anchor, and
these are ranked over all pieces.  Bounds hold for any data; marks that fit it
badly cost time only.

Components are floor(scale * x) with x as double, at most 2 ** 62 in size;
scores are exact integers, and those beyond 64 bits count as the nearest long.
Rows with a null id, label or vector, or a null or non-finite component, take
no part; a shorter vector is padded with zeros.  Ties go to the smaller id.
Rows that share an id are candidates each, but not of an anchor with that id;
equal rows ask once.  Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, materialize
from .topk import EXACT, NOTHING, matrix, usable

CELLS = 16
#: Vectors, at most, from which the marks between cells are learned.
SAMPLE = 4096
#: Rows of a block of candidates and of a block of anchors.
BLOCK = 16_384
ANCHOR_BLOCK = 1024
#: Anchors and rows whose bounds are summed at once.
TILE, ROWS = 32, 2048
#: The largest double that is a long.
_LONG = float(np.nextafter(2.0**63, 0))


def marks(sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bounds of cells, dimensions x (CELLS + 1): cell c holds the integers from its bound to the next one less 1."""
    inner = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="higher").T.astype(np.int64)
    inner = np.clip(inner, low[:, None], high[:, None])
    return np.concatenate([low[:, None], inner, high[:, None] + 1], axis=1)


def encode(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Cells of vectors, two dimensions a byte."""
    cells = np.zeros((len(points), len(bounds) + len(bounds) % 2), np.uint8)
    for d, edge in enumerate(bounds):
        cells[:, d] = np.searchsorted(edge[1:-1], points[:, d], side="right")
    return cells[:, ::2] * CELLS + cells[:, 1::2]


def tables(anchors: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest sums of products by pair of dimensions, byte and anchor."""
    a = anchors.astype(np.float64).T[:, None, :]
    first, last = bounds[:, :-1, None] * a, (bounds[:, 1:, None] - 1.0) * a
    out = []
    for t in (np.minimum(first, last), np.maximum(first, last)):
        if len(t) % 2:
            t = np.concatenate([t, np.zeros((1, *t.shape[1:]))])
        out.append((t[::2, :, None, :] + t[1::2, None, :, :]).reshape(len(t) // 2, CELLS * CELLS, -1))
    return out[0], out[1]


def score_bounds(anchors: np.ndarray, codes: np.ndarray, bounds: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, rows x anchors."""
    found = []
    for table, loose in zip(tables(anchors, bounds), (-slack, slack), strict=True):
        total = np.empty((len(codes), len(anchors)))
        for at in range(0, len(codes), ROWS):
            part = codes[at : at + ROWS]
            own = np.full((len(part), len(anchors)), loose)
            for g in range(part.shape[1]):
                own += table[g][part[:, g]]
            total[at : at + ROWS] = own
        found.append(total)
    # a score beyond 64 bits counts as the nearest long, and so do its bounds
    return np.clip(found[0], -(2.0**63), _LONG), np.clip(found[1], -_LONG, 2.0**63)


class Block:
    """The candidates of a piece of work."""

    def __init__(self, rows: pa.Table, bounds: np.ndarray):
        self.ids, self.labels = rows.column("_id").to_numpy(), rows.column("_label").to_numpy()
        self.points, self.bounds = matrix(rows.column("_v"), len(bounds)), bounds
        codes = rows.column("_code").combine_chunks()
        codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
        width = -(-len(bounds) // 2)
        start = codes.offset * width
        self.codes = np.frombuffer(codes.buffers()[2], np.uint8)[start : start + len(codes) * width].reshape(-1, width)
        self.near = self.points.astype(np.float64)
        self.norm = float(np.sqrt((self.near**2).sum(axis=1)).max(initial=0))

    def size(self, anchor: np.ndarray) -> float:
        """No score, and no sum on the way to one, is larger."""
        return 1.01 * self.norm * float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))

    def slack(self, anchors: np.ndarray) -> float:
        """What rounding may cost a bound."""
        reach = float((np.abs(anchors.astype(np.float64)).max(axis=0) * np.abs(self.bounds.astype(np.float64)).max(axis=1)).sum())
        return 0.0 if reach < EXACT else 1e-9 * reach

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        size = self.size(anchor)
        if size < EXACT:
            return np.rint(self.near[rows] @ anchor.astype(np.float64)).astype(np.int64)
        if size < 2.0**62:
            return self.points[rows] @ anchor
        found = self.points[rows].astype(object) @ anchor.astype(object)
        return np.clip(found, NOTHING + 1, 2**63 - 1).astype(np.int64)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[order]], scores[order]


def kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def tiles(anchors: np.ndarray, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each anchor's place with its lower and upper bounds of the block's scores."""
    for at in range(0, len(anchors), TILE):
        part = anchors[at : at + TILE]
        low, high = score_bounds(part, block.codes, block.bounds, block.slack(part))
        for j in range(len(part)):
            yield at + j, low[:, j], high[:, j]


def nearest(ids: np.ndarray, anchors: np.ndarray, block: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per anchor the k best of the block's rows but those with its own id."""
    for i, low, high in tiles(anchors, block):
        other = block.ids != ids[i]
        rows = np.flatnonzero(other & (high >= kth(low[other], k)))
        yield i, *block.best(rows, block.scores(rows, anchors[i]), k)


def windows(ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, positives: list[list[int]], block: Block, k: int, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per anchor and positive score the k best of the rows of other labels and ids in that score's window."""
    for i, low, high in tiles(anchors, block):
        spans = [(j, -(-percent * p // 100), p) for j, p in enumerate(positives[i]) if p >= 0]  # below 0 the window is empty
        maybe = np.zeros(len(block.ids), bool)
        other = (block.labels != labels[i]) & (block.ids != ids[i])
        for _, least, most in spans:
            sure = other & (low >= least) & (high <= most)
            maybe |= other & (high >= max(float(least), kth(low[sure], k))) & (low <= most)
        rows = np.flatnonzero(maybe)
        if len(rows):
            scores = block.scores(rows, anchors[i])
            for j, least, most in spans:
                inside = np.flatnonzero((scores >= least) & (scores <= most))
                if len(inside):
                    yield i, j, *block.best(rows[inside], scores[inside], k)


def approximate(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``rows`` with _code, the approximation file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = encode(matrix(batch.column("_v"), len(bounds)), bounds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=[*batch.schema.names, "_code"])

    return rows.mapInArrow(run, rows.select("*", F.lit(b"").alias("_code")).schema)


def _cogroup(asked: DataFrame, offered: DataFrame, keys: list[str], names: list[str], work, schema: str) -> DataFrame:
    """``work`` of each piece's anchors and rows; either side's columns anew, as both come from one table.

    Keys are longs on either side: equal numbers of unlike types are dealt to unlike tasks.
    """
    side = lambda rows, sign, own: rows.select(*((F.col(c).cast("long") + 0).alias(f"{sign}{c}") for c in keys), *own).groupBy(*(f"{sign}{c}" for c in keys))
    return side(asked, "q", names).cogroup(side(offered, "p", ["_id", "_label", "_v", "_code"])).applyInArrow(work, schema)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, anchor_modulus: int = 100) -> DataFrame:
    """Per anchor (a row whose id is divisible by ``anchor_modulus``) and positive, the hardest negatives.

    Positives are an anchor's best rows of its label; negatives are the best
    rows of other labels that score between ``percent`` hundredths of the
    positive's score and that score.
    """
    most = float(2**62)
    vector = F.transform(vector_col, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), F.lit(scale) * x.cast("double")))).cast("long"))
    # labels of any type are told apart by numbers of their own
    named = vectors.where(usable(id_col, vector_col) & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_name"), vector.alias("_v"))
    block = lambda blocks, name, salt: F.pmod(F.xxhash64(name, F.lit(salt)), blocks).cast("int")
    upto = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    with Scratch(vectors.sparkSession, "hard-negatives") as scratch:
        labels = scratch.write(named.groupBy("_name").agg(F.count("*").alias("_rows"), F.count_if(F.pmod("_id", F.lit(anchor_modulus)) == 0).alias("_anchors")).withColumn("_label", F.monotonically_increasing_id()), "labels")
        rows = named.join(labels.select("_name", "_label"), "_name").drop("_name")
        rows = scratch.write(rows.withColumns({"_number": F.monotonically_increasing_id(), "_key": F.xxhash64("_id", "_label", "_v")}), "vectors")
        spans = {r["at"]: r for r in rows.select(F.posexplode("_v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()}
        width = max(spans, default=0) + 1
        low, high = (np.array([min(0, spans[d]["low"]) if c == "low" else max(0, spans[d]["high"]) for d in range(width)] if spans else [0], np.int64) for c in ("low", "high"))
        sample = [r["_v"] for r in bounded_sample(rows.select("_v"), "_v", SAMPLE)]
        bounds = marks(np.array([list(v) + [0] * (width - len(v)) for v in sample] or [[0] * width], np.int64), low, high)
        file = scratch.write(approximate(rows, bounds), "approximations")
        anchors = scratch.write(file.where(F.pmod("_id", F.lit(anchor_modulus)) == 0).dropDuplicates(["_id", "_label", "_v"]).select("_id", "_label", "_v", "_key"), "anchors")

        def positive(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {c: [] for c in ("anchor_id", "_key", "positive_id", "positive_score")}
            if left.num_rows and right.num_rows:
                ids, keys, own = left.column("_id").to_numpy(), left.column("_key").to_numpy(), Block(right, bounds)
                for i, found, scores in nearest(ids, matrix(left.column("_v"), width), own, positives):
                    for c, values in zip(out, ([ids[i]] * len(found), [keys[i]] * len(found), found, scores), strict=True):
                        out[c].extend(values)
            return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

        parts = labels.where("_anchors > 0").select("_label", F.ceil(F.col("_rows") / BLOCK).alias("_blocks"), F.ceil(F.col("_anchors") / ANCHOR_BLOCK).alias("_groups"))
        asked = anchors.join(parts, "_label").withColumns({"_b": block(F.col("_groups"), "_key", 1), "_a": upto(F.col("_blocks"))})
        offered = file.join(parts, "_label").withColumns({"_a": block(F.col("_blocks"), "_number", 2), "_b": upto(F.col("_groups"))})
        pairs = _cogroup(asked, offered, ["_label", "_a", "_b"], ["_id", "_key", "_v"], positive, "anchor_id long, _key long, positive_id long, positive_score long")
        by_score = Window.partitionBy("anchor_id", "_key").orderBy(F.desc("positive_score"), "positive_id")
        best = pairs.withColumn("_rank", F.row_number().over(by_score)).where(F.col("_rank") <= positives)
        listed = best.groupBy("anchor_id", "_key").agg(F.sort_array(F.collect_list(F.struct("_rank", "positive_id", "positive_score"))).alias("_positives"))
        asking = scratch.write(anchors.join(listed.withColumnRenamed("anchor_id", "_id"), ["_id", "_key"]), "windows")

        def negative(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {c: [] for c in ("anchor_id", "_key", "_rank", "positive_id", "positive_score", "negative_id", "negative_score")}
            if left.num_rows and right.num_rows:
                ids, keys, own = left.column("_id").to_numpy(), left.column("_key").to_numpy(), Block(right, bounds)
                listed = left.column("_positives").to_pylist()
                scores_of = [[p["positive_score"] for p in x] for x in listed]
                for i, j, found, scores in windows(ids, left.column("_label").to_numpy(), matrix(left.column("_v"), width), scores_of, own, negatives, percent):
                    p = listed[i][j]
                    for c, values in zip(out, (*([v] * len(found) for v in (ids[i], keys[i], p["_rank"], p["positive_id"], p["positive_score"])), found, scores), strict=True):
                        out[c].extend(values)
            return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

        blocks, groups = max(1, -(-file.count() // BLOCK)), max(1, -(-asking.count() // ANCHOR_BLOCK))
        asked = asking.withColumns({"_b": block(F.lit(groups), "_key", 3), "_a": upto(F.lit(blocks))})
        offered = file.withColumns({"_a": block(F.lit(blocks), "_number", 4), "_b": upto(F.lit(groups))})
        found = _cogroup(asked, offered, ["_a", "_b"], ["_id", "_label", "_key", "_v", "_positives"], negative, "anchor_id long, _key long, _rank long, positive_id long, positive_score long, negative_id long, negative_score long")
        # a positive is told by its place, as rows that share its id may be positives too
        hardest = Window.partitionBy("anchor_id", "_key", "_rank").orderBy(F.desc("negative_score"), "negative_id")
        ranked = found.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= negatives)
        return materialize(ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives-result")
