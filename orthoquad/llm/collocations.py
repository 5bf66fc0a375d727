"""Collocations of 2 to 4 words by hierarchical pair naming.

Texts are cut into blocks of bounded size, and a block into pieces of words.
A block holds the words' ids as one sequence, with names of its own, and a list
of its names with their counts.  Counts are summed over all blocks; names that
are frequent get a global id, which is joined back to the blocks that have them.
A block then replaces each two neighbours that are both frequent by a name for
the pair of their ids, and so on: the pair of two (k-1)-grams that overlap in
all but a word is a k-gram.  A block's pairs are dealt into parts by a hash of
their ids and shipped as one packed list a part; a part's lists of all blocks
are merged, which gives the counts, and ids for the frequent pairs go back in
the order of the lists.  So what is shuffled are distinct names per block, some
bytes each, never occurrences, and a frequent word or phrase is at most one
entry a block.  Parts grow in number, not in size.  Names are exact; the hash
only deals them.

The pair of a k-gram points to its parents.  Along the left ones lie its first
words, along the right ones its last, and so the counts of both sides of every
cut.  A phrase lies in a longer one just if it is a parent of one that does, or
is that one; as counts fall with length, looking at children suffices.

All is per language; a null language is ``und``.  Null and empty texts have no
words.  Ties of a score go to the more frequent phrase, then to the lesser one
in UTF-8 order.  Repeated rows count each; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, slices

#: Bytes of text in a block, and of those that are split into words at once.
BLOCK = 8_000_000
CHUNK = 1_000_000
#: Words of text for one part of the pairs.
PART = 4_000_000
#: What ends a piece becomes a line feed, a tab a space, and A-Z a-z.
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t" + bytes(range(65, 91)), b"\n" * 10 + b" " + bytes(range(97, 123)))
END, NONE = -1, -2


class Names(dict):
    """Words in the order in which they were first met."""

    def __init__(self, first: int):
        super().__init__({b"\n": END, b"": NONE})
        self.first = first

    def __missing__(self, word: bytes) -> int:
        self[word] = at = self.first + len(self) - 2
        return at


def _chunks(raw: bytes) -> Iterator[bytes]:
    """Cut behind line feeds; a longer piece is a chunk of its own."""
    at = 0
    while at < len(raw):
        end = raw.rfind(b"\n", at, at + CHUNK) + 1 or raw.find(b"\n", at + CHUNK) + 1 or len(raw)
        yield raw[at:end]
        at = end


def packed(values: np.ndarray) -> bytes:
    """Integers by planes of their bytes, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, size * n, "zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def word_blocks(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int = BLOCK) -> DataFrame:
    """One row per block: its sequence of names, and the words that they stand for with their counts."""
    picked = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("_lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        for part, texts in slices(batches, "_text", block_bytes, 1 << 20):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(part.column("_lang").to_pylist(), texts, strict=True):
                by_lang.setdefault(lang, []).append(text)
            sequence, words, langs, first = [], [], [], 0
            for lang, own in by_lang.items():
                names = Names(first)
                for chunk in _chunks("\n".join([*own, ""]).encode("utf-8", "surrogatepass").translate(_TABLE)):
                    tokens = chunk.replace(b"\n", b" \n ").split(b" ")
                    ids = np.fromiter(map(names.__getitem__, tokens), np.int32, len(tokens))
                    sequence.append(ids[ids != NONE])
                found = [w.decode("utf-8", "surrogatepass") for w in names if w not in (b"\n", b"")]
                first += len(found)
                words += found
                langs += [lang] * len(found)
            if words:
                ids = np.concatenate(sequence)
                data, n = packed(ids), len(ids)
                counts = np.bincount(ids[ids >= 0], minlength=first)
                listed = pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([data], pa.binary()), pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), listed)], names=["block", "data", "size", "names"])
                made += 1

    return picked.mapInArrow(run, "block long, data binary, size int, names array<struct<lang: string, word: string, n: long>>")


def paired(sequence: np.ndarray, ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Replace neighbours that both have an id by names of their pairs; ``ids`` has that of each old name, or -1.

    Returns the new sequence, and per name its part, the ids of its two parents
    and its count; names are in order of part, left and right.
    """
    known = np.unique(ids[ids >= 0])
    rank = np.append(np.where(ids >= 0, np.searchsorted(known, ids), -1), -1)  # the last entry is that of END
    at = rank[sequence]
    both = (at[:-1] >= 0) & (at[1:] >= 0)
    pairs, name, n = np.unique(at[:-1][both] * len(known) + at[1:][both], return_inverse=True, return_counts=True)
    left, right = known[pairs // max(1, len(known))], known[pairs % max(1, len(known))]
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    part = ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out = np.full(len(both), END, np.int32)
    out[both] = place[name]
    return out, part[order], left[order], right[order], n[order]


def pair_blocks(blocks: DataFrame, named: DataFrame, parts: int) -> DataFrame:
    """The next level's blocks, and their pairs as a packed list per part.

    ``named`` has, per block, either names (local) with their id, or a packed
    list of ids per part, -1 for none, which together are in order of names.
    """
    flat = "local" in named.columns

    def ids_of(rows: pa.Table) -> np.ndarray:
        if flat:
            local = rows.column("local").to_numpy()
            ids = np.full(int(local.max()) + 1, -1, np.int64)
            ids[local] = rows.column("id").to_numpy()
            return ids
        order = np.argsort(rows.column("part").to_numpy())
        lists = zip(rows.column("ids").to_pylist(), rows.column("count").to_pylist(), strict=True)
        found = [unpacked(data, n, np.int64) for data, n in lists]
        return np.concatenate([found[i] for i in order])

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = {"block": pa.array([], pa.int64()), "data": pa.array([], pa.binary()), "size": pa.array([], pa.int32()), "pairs": pa.array([], kind)}
        if left.num_rows and right.num_rows:
            sequence = unpacked(left.column("data")[0].as_py(), left.column("size")[0].as_py(), np.int32)
            ids = ids_of(right)
            sequence = np.where(sequence < len(ids), sequence, END)  # names behind the last with an id have none
            found, part, first, second, n = paired(sequence, ids, parts)
            if len(n):
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
                own = [{"part": int(part[a]), "count": b - a, "left": packed(np.diff(first[a:b], prepend=0)), "right": packed(second[a:b]), "n": packed(n[a:b].astype(np.int64))} for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = {"block": left.column("block"), "data": pa.array([packed(found)], pa.binary()), "size": pa.array([len(found)], pa.int32()), "pairs": pa.array([own], kind)}
        return pa.table(columns)

    kind = pa.list_(pa.struct([("part", pa.int64()), ("count", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.binary())]))
    own = blocks.select("block", "data", "size")
    theirs = named.select((F.col("block") + 0).alias("of"), *(c for c in named.columns if c != "block"))  # a column anew, as both come from one table
    schema = "block long, data binary, size int, pairs array<struct<part: long, count: int, left: binary, right: binary, n: binary>>"
    return own.groupBy("block").cogroup(theirs.groupBy("of")).applyInArrow(pair, schema)


def merged(blocks: DataFrame, parts: int, least: int, last: bool) -> DataFrame:
    """Per part one row with its frequent pairs, and, unless this is the ``last`` level, one per block with its ids."""

    def merge(rows: pa.Table) -> pa.Table:
        counts, part = rows.column("count").to_pylist(), rows.column("part")[0].as_py()
        columns = {c: [unpacked(x, n, np.int64) for x, n in zip(rows.column(c).to_pylist(), counts, strict=True)] for c in ("left", "right", "n")}
        left, right, n = np.concatenate([np.cumsum(x) for x in columns["left"]]), np.concatenate(columns["right"]), np.concatenate(columns["n"])
        order = np.lexsort((right, left))
        left, right = left[order], right[order]
        first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        total = np.add.reduceat(n[order], first)
        often = total >= least
        name = np.where(often, (np.cumsum(often) - 1) * parts + part, -1)
        found = pa.StructArray.from_arrays([name[often], left[first][often], right[first][often], total[often]], names=["id", "left", "right", "f"])
        ids = np.empty(len(order), np.int64)
        ids[order] = np.repeat(name, np.diff(np.append(first, len(order))))
        own = [] if last else np.split(ids, np.cumsum(counts)[:-1])
        blocks = [] if last else rows.column("block").to_pylist()
        pairs = pa.ListArray.from_arrays(pa.array([0] * (len(own) + 1) + [len(found)], pa.int32()), found)
        columns = ([part] * (len(own) + 1), pa.int64()), ([*blocks, None], pa.int64()), ([*map(len, own), None], pa.int32()), ([*map(packed, own), None], pa.binary())
        return pa.table([*(pa.array(v, kind) for v, kind in columns), pairs], names=["part", "block", "count", "ids", "pairs"])

    lists = blocks.select("block", F.explode("pairs").alias("x")).select("block", "x.*")
    return lists.groupBy("part").applyInArrow(merge, "part long, block long, count int, ids binary, pairs array<struct<id: long, left: long, right: long, f: long>>")


def listed(blocks: DataFrame) -> DataFrame:
    """One row per block and name: block, local and the fields of the name."""
    return blocks.select("block", F.posexplode("names").alias("local", "x")).select("block", "local", "x.*")


def whole(column: str) -> Column:
    return F.col(column).cast("decimal(20,0)")


def score(a: str, l: str, r: str, scale: int) -> Column:
    """floor(scale * a / (l + r)), exact beyond 64 bits."""
    return F.expr(f"CAST((CAST({scale} AS DECIMAL(10,0)) * CAST({a} AS DECIMAL(20,0))) div CAST({l} + {r} AS DECIMAL(20,0)) AS BIGINT)")


def grams(docs: DataFrame, scratch: Scratch, text_col: str, lang_col: str, longest: int, least: int, block_bytes: int = BLOCK) -> tuple[DataFrame, list[DataFrame]]:
    """Words per language, and per length the frequent phrases.

    These hold id, lang, phrase, last (their last word), f, heads (the counts of
    their first 1, 2, ... words), tails (of their last) and, but for words, the
    ids left and right of their parents.
    """
    blocks = scratch.write(word_blocks(docs, text_col, lang_col, block_bytes), "blocks1")
    names = listed(blocks)
    totals = names.groupBy("lang").agg(F.sum("n").alias("n"))
    counted = names.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = scratch.write(counted.withColumn("id", F.monotonically_increasing_id()), "names1")
    found = [words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))]
    named = names.join(words, ["lang", "word"]).select("block", "local", "id")
    parts = -(-(blocks.agg(F.sum("size")).first()[0] or 1) // PART)
    for k in range(2, longest + 1):
        blocks = scratch.write(pair_blocks(blocks, named, parts), f"blocks{k}")
        found_k = scratch.write(merged(blocks, parts, least, k == longest), f"names{k}")
        named = found_k.where("block IS NOT NULL").select("block", "part", "count", "ids")
        pairs = found_k.where("block IS NULL").select(F.explode("pairs").alias("x")).select("x.*")
        first = found[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_first"), "heads")
        second = found[-1].select(F.col("id").alias("right"), "last", "tails")
        own = pairs.join(first, "left").join(second, "right")
        grown = own.select("id", "lang", F.concat_ws(" ", "_first", "last").alias("phrase"), "last", "f", F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"), "left", "right")
        found.append(scratch.write(grown, f"grams{k}"))
    return totals, found


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, percent: int = 80, scale: int = 2_000_000, top: int = 2000, block_bytes: int = BLOCK) -> DataFrame:
    """The ``top`` phrases per language: lang, rank, phrase, a, l, r, n and score.

    ``a`` is a phrase's count, ``l`` and ``r`` those of the two sides of its
    weakest cut, ``n`` the language's words.  A phrase is dropped if a longer
    one that holds it has ``percent`` of its count or more.
    """
    with Scratch(docs.sparkSession, "collocations") as scratch:
        totals, found = grams(docs, scratch, text_col, lang_col, longest, least, block_bytes)
        rows = None
        for k in range(2, longest + 1):
            own = found[k - 1].select("id", "lang", "phrase", F.col("f").alias("a"), "heads", "tails")
            if k < longest:
                child = found[k]
                inside = child.select(F.col("left").alias("id"), "f").unionByName(child.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("_longer"))
                own = own.join(inside, "id", "left").where(F.col("_longer").isNull() | (100 * whole("_longer") < percent * whole("a"))).drop("_longer")
            cuts = [F.struct(F.col("heads")[j - 1].alias("l"), F.col("tails")[k - j - 1].alias("r")) for j in range(1, k)]
            each = F.array(*(F.struct(score("a", f"heads[{j - 1}]", f"tails[{k - j - 1}]", scale).alias("score"), F.lit(j).alias("j"), cuts[j - 1].alias("cut")) for j in range(1, k)))
            scored = own.withColumn("_c", F.array_min(each)).select("lang", "phrase", "a", "_c.cut.l", "_c.cut.r", "_c.score")
            rows = scored if rows is None else rows.unionByName(scored)
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return materialize(ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations-result")
