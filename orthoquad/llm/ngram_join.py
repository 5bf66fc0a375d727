"""Exact n-gram Jaccard self-join by PartEnum signatures.

A document's set holds its distinct word n-grams, as 64-bit hashes of keyed
hashes of their words.  Sets are
dealt into size bands such that similar sets lie in one band or in neighbours;
for either case the symmetric difference of a similar pair is at most some k.
The hash space is partitioned into n1 ranges of n2 parts each.  Of the n1
ranges, at least n1 - k // (k2 + 1) hold k2 differences or fewer, and in each
of these some n2 - k2 parts agree: so a similar pair shares the signature of
that subset of parts.  A subset without elements says nothing, and is a
signature only of sets so sparse that they might have no other to share.

Equal sets, told by 128 bits over keyed hashes, are one class.  Each signature elects one of its classes, and the
classes that share the elected one's signatures form a bundle; a bundle is cut
into pieces of bounded size.  A piece first compares parity sketches, which
bound the symmetric difference from below, and names the classes that have a
possible partner; then the texts of these alone are sent to the piece, once per
class, and it links them through a union-find, so that a piece emits no more
links than it has classes, however alike they are; two classes are linked only
if their words say so too.  Links join classes into
components, and only signatures whose classes lie in several components go on.
After some rounds of this kind the last one is exhaustive: the bundle is the
largest component of a signature, and all its guests are compared with all its
members and with each other.

Null and empty texts and texts without words have empty sets and link with
nothing, but for other rows of their id; a text of fewer words than n is one n-gram.  Rows with a null id get
a null component and link with nothing.  Rows that share an id are one node,
whatever their texts.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize, slices, thin_out

U = np.uint64
SKETCH_WORDS = 8
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
#: Up to this k, a range has 4 parts of which 3 make a signature; beyond it, ranges are whole.
SUBSETS_UP_TO = 26
#: Rounds in which bundles are cut into slices that each see the elected class, before the exhaustive one.
ROUNDS = 1
#: Classes and shingles of a block; a piece of work holds two blocks at most.
BLOCK = 1024
BLOCK_SHINGLES = 2_000_000
#: What names a piece, and what its rows say of themselves.
PIECE = ["bundle", "_i", "_j"]
ROLE = ["_whole", "_own", "k1", "component", "n"]
#: Bytes of text that are hashed together, and equal sets that a task remembers.
SPAN = 1 << 20
SEEN = 1 << 20

#: Words that a task remembers, and bytes of a word that is remembered at most.
WORDS, WORD_BYTES = 50_000, 64
#: Hashes of words are secret-keyed ones of 128 bits; the key is fixed, so that all tasks agree.
KEY = b"orthoquad n-gram join"

_rng = np.random.default_rng(20240601)
BASE = U(0x9E3779B97F4A7C15)
SALTS = [U(x) for x in _rng.integers(1, 2**63, 4, dtype=np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _spans(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut bytes behind white space into spans of at most ``SPAN`` bytes; a longer word is a span of its own."""
    at = 0
    while at < len(raw):
        end = min(at + SPAN, len(raw))
        while end < len(raw) and not SPACE[raw[end - 1]]:
            back = np.flatnonzero(SPACE[raw[max(at, end - 4096) : end]])
            if len(back):
                end = max(at, end - 4096) + int(back[-1]) + 1
            elif end - 4096 > at:
                end -= 4096
            else:  # no white space in reach
                ahead = np.flatnonzero(SPACE[raw[at + SPAN :]])
                end = at + SPAN + int(ahead[0]) + 1 if len(ahead) else len(raw)
        yield at, end
        at = end


class Words(dict):
    """Word -> row of its two 64-bit hashes, halves of one keyed hash."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []
        self.rows = np.zeros((0, 2), U)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """words x 2."""
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            new = b"".join(blake2b(w, digest_size=16, key=KEY).digest() for w in self.fresh)
            self.rows = np.concatenate([self.rows, np.frombuffer(new, U).reshape(-1, 2)])
        found = self.rows[at]
        if len(self) > WORDS or max(map(len, self.fresh), default=0) > WORD_BYTES:
            self.clear()
            self.rows = np.zeros((0, 2), U)
        self.fresh.clear()
        return found


def lowered(text: str | None) -> bytes:
    """A-Z are lower-cased, and no other letter."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def grams(texts: list, n: int, words: Words | None = None) -> list[np.ndarray]:
    """Per text the hashes (two of 64 bits each) of its n-grams in order; words end at ASCII white space."""
    words, found, sizes = words if words is not None else Words(), [], []
    for text in map(lowered, texts):
        spans = [text] if len(text) <= SPAN else [text[a:b] for a, b in _spans(np.frombuffer(text, np.uint8))]
        own = [words.hashes(s.split()) for s in spans] if len(spans) > 1 else [s.split() for s in spans]
        found += own
        sizes.append(sum(map(len, own)))
    word = _hashed(found, words)
    gram = word[: max(0, len(word) - n + 1)].copy()
    for j in range(1, n):
        gram = gram * BASE + word[j : len(word) - n + 1 + j]
    gram = mix(gram)
    out, at = [], 0
    for size in sizes:
        if size >= n:
            out.append(gram[at : at + size - n + 1])
        elif size:
            short = np.full((1, 2), size, U)
            for i in range(at, at + size):
                short = short * BASE + word[i]
            out.append(mix(short ^ SALTS[3]))
        else:
            out.append(np.zeros((0, 2), U))
        at += size
    return out


def _hashed(parts: list, words: Words) -> np.ndarray:
    """Lists of words, those in turn looked up together, and hashes that were looked up before."""
    out, run = [np.zeros((0, 2), U)], []
    for p in parts:
        if isinstance(p, list):
            run += p
        else:
            out += [words.hashes(run), p]
            run = []
    return np.concatenate([*out, words.hashes(run)])


def ngram_sets(texts: list, n: int, words: Words | None = None) -> list[np.ndarray]:
    """Per text, its set as ascending hashes."""
    return [np.unique(g[:, 0]) for g in grams(texts, n, words)]


def exactly_similar(a: bytes, b: bytes, n: int, percent: int) -> bool:
    """The similarity of two lower-cased texts by their words themselves."""
    both = []
    for t in (a, b):
        w = t.split()
        both.append(set(zip(*(w[j:] for j in range(n)))) if len(w) >= n else {tuple(w)} if w else set())
    common = len(both[0] & both[1])
    return common > 0 and 100 * common >= percent * (len(both[0]) + len(both[1]) - common)


@cache
def size_bands(percent: int) -> np.ndarray:
    """First size of each band; band i ends before the first of band i + 1."""
    firsts = [1]
    while firsts[-1] < 1 << 40:
        firsts.append(max(firsts[-1], firsts[-1] * 100 // percent) + 1)
    return np.array(firsts, np.int64)


@cache
def scheme(band: int, percent: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, ranges that surely agree) for pairs of this band, or of it and the next."""
    firsts = size_bands(percent)
    small = int(firsts[band + 1]) - 1
    large = min(int(firsts[band + 2]) - 1, small * 100 // percent)
    k = (100 - percent) * (small + large) // (100 + percent)
    if k == 0:
        return 1, 1, 0, 1
    k2, n2 = (1, 4) if k <= SUBSETS_UP_TO else (0, 1)
    bad = k // (k2 + 1)
    n1 = bad + 1 + max(1, k // 20)
    return n1, n2, k2, n1 - bad


@cache
def _edges(parts: int) -> np.ndarray:
    return np.array([(i << 64) // parts for i in range(1, parts)], U)


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of an ascending, non-empty set of hashes, for its own band and the one below."""
    band = int(np.searchsorted(size_bands(percent), len(s), side="right")) - 1
    value = np.zeros(len(s) + 1, U)
    np.cumsum(mix(s ^ SALTS[0]), out=value[1:])
    out = []
    for base in (band, band - 1) if band else (band,):
        n1, n2, k2, sure = scheme(base, percent)
        cut = np.empty(n1 * n2 + 1, np.int64)
        cut[0], cut[-1] = 0, len(s)
        cut[1:-1] = np.searchsorted(s, _edges(n1 * n2))
        part, count = np.diff(value[cut]).reshape(n1, n2), np.diff(cut).reshape(n1, n2)
        if k2:  # all subsets of n2 - 1 parts
            part, count = part.sum(axis=1, keepdims=True) - part, count.sum(axis=1, keepdims=True) - count
        name = mix(np.arange(n1 * n2, dtype=U) + U(base << 32) + SALTS[1])
        found = mix(part.ravel() + name)
        if int((count == 0).any(axis=1).sum()) < sure:
            found = found[count.ravel() > 0]
        out.append(found)
    return np.concatenate(out)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the elements in each of 512 buckets: two sets' sketches differ in no more bits than the sets in elements."""
    bits = np.bincount((mix(s ^ SALTS[2]) >> U(55)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(U)


def keyed(g: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
    """The set of n-grams and its key, of 128 bits: sums over both hashes of its members."""
    s, first = np.unique(g[:, 0], return_index=True)
    both = np.array([mix(s ^ SALTS[1]).sum(), mix(g[first, 1] ^ SALTS[3]).sum()], U)
    return s, tuple(mix(both).view(np.int64).tolist())


def set_name(s: np.ndarray) -> int:
    """The first half of a set's key."""
    return int(mix(np.array([mix(s ^ SALTS[1]).sum()], U)).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def named_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text and _row, a hash of the text: rows that share both _id and _row are alike."""
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_row", F.xxhash64("_text"))


def sign(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Per row: id, a hash of the text, n_shingles, set key k1 and k2, sketch and signatures.

    Signatures are given with the first of a task's equal sets only, rows with
    a null id aside: these link with nothing and have none.
    """
    picked = named_texts(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = ["_id", "_row", "n", "k1", "k2", *SKETCH, "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words = set(), Words()
        for part, texts in slices(batches, "_text", 1_000_000):
            sets, keys = zip(*map(keyed, grams(texts, n, words)), strict=True)
            sketches, sigs = np.zeros((len(sets), SKETCH_WORDS), np.int64), []
            for i, (s, key, named) in enumerate(zip(sets, keys, part.column("_id").is_valid().to_pylist(), strict=True)):
                sketches[i] = sketch(s).view(np.int64)
                new = named and len(s) and key not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                sigs.append(signatures(s, percent).view(np.int64) if new else np.zeros(0, np.int64))
            k1, k2 = zip(*keys, strict=True)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sigs])]), pa.int32())
            columns = [part.column("_id"), part.column("_row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())]
            columns += [pa.array(sketches[:, j]) for j in range(SKETCH_WORDS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sigs)))], names=fields)

    kinds = ["bigint"] * (4 + SKETCH_WORDS)
    return picked.mapInArrow(run, f"_id {id_type}, " + ", ".join(f"{f} {k}" for f, k in zip(fields[1:-1], kinds, strict=True)) + ", sigs array<bigint>")


def open_signatures(members: DataFrame, exhaustive: bool, salt: int) -> DataFrame:
    """sig and home of the signatures whose classes lie in several components.

    The home is the class with the least hash, or, if ``exhaustive``, the
    component with the most classes.  Hot signatures are counted before a shuffle.
    """
    counts = members.groupBy("sig", "component").agg(F.count("*").alias("c"), F.min_by("k1", F.xxhash64("k1", F.lit(salt))).alias("k1"))
    order = F.col("c") * (1 << 20) + F.pmod(F.xxhash64("component"), F.lit(1 << 20))
    home = F.max_by("component", order) if exhaustive else F.min_by("k1", F.xxhash64("k1", F.lit(salt)))
    return counts.groupBy("sig").agg(F.count("*").alias("m"), home.alias("home")).where("m > 1").select("sig", "home")


def bundles(elected: DataFrame, classes: DataFrame, exhaustive: bool, salt: int) -> DataFrame:
    """One row per class and bundle with the signatures that they share; ``elected``: sig, home, k1 and component.

    If ``exhaustive``, a class joins the bundles of all its signatures' homes;
    else that of the home with the least hash, and its own.
    """
    own = elected.groupBy("k1").agg(F.first("component").alias("component"), F.min_by("home", F.xxhash64("home", F.lit(salt))).alias("_best"), F.collect_list(F.struct("home", "sig")).alias("_all"))
    homes = F.transform("_all", lambda x: x["home"])
    if not exhaustive:
        homes = F.filter(F.array("_best", "k1"), lambda h: F.array_contains(homes, h))
    spread = own.withColumn("bundle", F.explode(F.array_distinct(homes)))
    shared = F.transform(F.filter("_all", lambda x: x["home"] == F.col("bundle")), lambda x: x["sig"])
    at_home = F.col("component") == F.col("bundle") if exhaustive else F.col("k1") == F.col("bundle")
    return spread.select("bundle", at_home.alias("_home"), "k1", "component", shared.alias("sigs")).join(classes.drop("k2"), "k1")


def deal(rows: DataFrame, exhaustive: bool, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Cut bundles into pieces of two blocks at most: bundle, _i, _j, _whole and _own beside the columns of ``rows``.

    Slices hold the elected class and a block of the others.  In the exhaustive
    round each block of a home's guests meets each block of the home and each
    other block of guests; members of the home aren't compared with each other.
    Where _whole is 0, only rows that differ in _own are to be compared.
    """
    weight = 1 / BLOCK + F.col("n") / BLOCK_SHINGLES
    count = lambda home: F.ceil(F.sum(F.when(F.col("_home") == F.lit(home), weight))).cast("int")
    sizes = rows.groupBy("bundle").agg(F.count("*").alias("_size"), count(True).alias("_homes"), count(False).alias("_guests")).where("_size > 1 AND _guests > 0").drop("_size")
    placed = rows.join(write(sizes, "ngram-sizes"), "bundle").withColumn("_homes", F.greatest("_homes", F.lit(1)))
    block = lambda blocks: F.pmod(F.xxhash64("k1", F.lit(7)), F.col(blocks)).cast("int")
    upto = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    piece = lambda i, j, whole, own: F.struct(i.cast("int").alias("_i"), j.cast("int").alias("_j"), whole.cast("int").alias("_whole"), own.cast("int").alias("_own"))
    if exhaustive:
        home = F.transform(upto("_guests"), lambda j: piece(block("_homes"), j, block("_homes") == 0, F.lit(0)))
        guest = F.transform(upto("_homes"), lambda i: piece(i, block("_guests"), i == 0, F.lit(1)))
        others = F.filter(upto("_guests"), lambda j: j != block("_guests"))
        crossing = F.transform(others, lambda j: piece(F.col("_homes") + F.least(j, block("_guests")), F.greatest(j, block("_guests")), F.lit(0), block("_guests")))
        guest = F.concat(guest, crossing)
    else:
        home = F.transform(upto("_guests"), lambda i: piece(i, F.lit(0), F.lit(1), F.lit(0)))
        guest = F.array(piece(block("_guests"), F.lit(0), F.lit(1), F.lit(0)))
    return placed.withColumn("_p", F.explode(F.when(F.col("_home"), home).otherwise(guest))).select("*", "_p.*").drop("_p", "_home", "_homes", "_guests")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def whole_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Sorted rows as tables of whole pieces, with the bounds of the pieces."""
    carry: list[pa.RecordBatch] = []
    for batch in _with_end(batches):
        held = carry + ([batch] if batch is not None and batch.num_rows else [])
        if not held:
            continue
        table = pa.Table.from_batches(held)
        keys = np.stack([table.column(c).to_numpy() for c in PIECE], axis=1)
        bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        if batch is None:
            bounds.append(len(keys))
        carry = table.slice(bounds[-1]).to_batches()
        if len(bounds) > 1:
            yield table.slice(0, bounds[-1]).combine_chunks(), bounds


def comparable(whole: np.ndarray, own: np.ndarray, component: np.ndarray, n: np.ndarray, i: int, percent: int) -> np.ndarray:
    """Which rows of a piece row ``i`` may be linked to."""
    sized = 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
    return (component != component[i]) & sized & ((own != own[i]) | (whole[0] == 1))


def partnered(whole, own, component, n, bits: np.ndarray, sigs: list[np.ndarray], percent: int) -> np.ndarray:
    """Which rows share a signature with another that sketches don't rule out."""
    m = len(n)
    found = np.zeros(m, bool)
    names, owner = np.concatenate(sigs), np.repeat(np.arange(m), [len(s) for s in sigs])
    order = np.argsort(names, kind="stable")
    names, owner = names[order], owner[order]
    cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
    shared = np.zeros((m, m), bool)
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)], strict=True):
        if b - a > 1:
            shared[np.ix_(owner[a:b], owner[a:b])] = True
    for i in np.flatnonzero(shared.any(axis=1)):
        near = np.flatnonzero(shared[i, i + 1 :] & comparable(whole, own, component, n, i, percent)[i + 1 :]) + i + 1
        if found[i]:
            near = near[~found[near]]
        if len(near):
            most = (100 - percent) * (n[near] + n[i]) // (100 + percent)
            near = near[np.bitwise_count(bits[near] ^ bits[i]).sum(axis=1) <= most]
            if len(near):
                found[i] = found[near] = True
    return found


def candidates(dealt: DataFrame, percent: int) -> DataFrame:
    """The rows of each piece that have a possible partner in it, without sketches and signatures."""
    fields = [*PIECE, *ROLE, "_id", "_row"]
    id_type = dealt.schema["_id"].dataType.simpleString()
    columns = [*fields, *SKETCH, "sigs"]
    sorted_rows = dealt.select(*columns).repartition(*PIECE).sortWithinPartitions(*PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_pieces(batches):
            role = [table.column(c).to_numpy() for c in ROLE if c != "k1"]
            bits = np.stack([table.column(s).to_numpy() for s in SKETCH], axis=1).view(U)
            lists = table.column("sigs").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            names, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            keep = np.zeros(table.num_rows, bool)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    sigs = [names[x:y] for x, y in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist(), strict=True)]
                    keep[a:b] = partnered(*(x[a:b] for x in role), bits[a:b], sigs, percent)
            yield from table.select(fields).filter(pa.array(keep)).to_batches()

    kinds = ["bigint", "int", "int", "int", "int", "bigint", "bigint", "bigint", id_type, "bigint"]
    return sorted_rows.mapInArrow(run, ", ".join(f"{f} {k}" for f, k in zip(fields, kinds, strict=True)))


def spanning(sets: list[np.ndarray], whole, own, component, percent: int, surely: Callable[[int, int], bool] = lambda i, j: True) -> list[tuple[int, int]]:
    """Links between similar sets, as pairs of rows: just enough to join all that similarity joins.

    A pair that is similar by hashes and is to be linked must also be ``surely`` so.

    Rows compared, but for a first one, are those of small components first, so
    that the many of a large one need not be compared with one another.
    """
    m, n = len(sets), np.array([len(s) for s in sets])
    label = np.unique(component, return_inverse=True)[1]
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), n)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    done, out = np.zeros(m, bool), []

    def compare(i: int) -> None:
        near = np.flatnonzero(comparable(whole, own, label, n, i, percent) & ~done)
        done[i] = True
        if len(near) > 4:
            low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            count = high - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            common = np.bincount(owner[at], minlength=m)[near]
            near = near[100 * common >= percent * (n[near] + n[i] - common)]
        else:
            near = [j for j in near if similar(sets[i], sets[j], percent)]
        for j in near:
            if label[i] != label[j] and surely(i, int(j)):
                out.append((i, int(j)))
                label[label == label[j]] = label[i]

    sizes = np.bincount(label)[label]
    compare(int(sizes.argmax()))
    for i in np.argsort(np.bincount(label, minlength=m)[label], kind="stable").tolist():
        if not done[i]:
            compare(i)
    return out


def verify(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """Links (a, b) between the classes of each piece; fetches the texts of these classes only, once per row of ``found``.

    A piece gives fewer links than it has classes.  What is linked is similar by
    its words, not by their hashes alone.
    """
    name = F.xxhash64("_id", "_row")
    wanted = found.select("_id", "_row").distinct().select(name.alias("_name"))
    rows = thin_out(named_texts(docs, id_col, text_col).withColumn("_name", name), "_name", wanted).drop("_name")
    texts = rows.dropDuplicates(["_id", "_row"])
    fields = [*PIECE, *(c for c in ROLE if c != "n"), "_text"]
    dealt = texts.join(found, ["_id", "_row"]).select(*fields).repartition(*PIECE).sortWithinPartitions(*PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        last, words = None, Words()

        def links() -> pa.RecordBatch:
            keys = list(held)
            whole, own, component = (np.array(x) for x in zip(*(held[k][2:] for k in keys), strict=True))
            surely = lambda i, j: exactly_similar(held[keys[i]][1], held[keys[j]][1], n, percent)
            pairs = spanning([held[k][0] for k in keys], whole, own, component, percent, surely) if len(keys) > 1 else []
            a, b = [keys[i] for i, _ in pairs], [keys[j] for _, j in pairs]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for part, texts in slices(batches, "_text", SPAN):
            sets = ngram_sets(texts, n, words)
            pieces, role = (zip(*(part.column(c).to_pylist() for c in names), strict=True) for names in (PIECE, ["k1", "_whole", "_own", "component"]))
            for piece, (k1, *rest), s, text in zip(pieces, role, sets, texts, strict=True):
                if piece != last and held:
                    yield links()
                    held.clear()
                last = piece
                if set_name(s) == k1:
                    held[k1] = (s, lowered(text), *rest)
        if held:
            yield links()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def same_id(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share an id."""
    shared = nodes.groupBy("_id").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a < b").select("_id", "a")
    return nodes.select("_id", F.col("k1").alias("b")).join(shared, "_id").where("a <> b").select("a", "b").distinct()


def components(links: DataFrame, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b): the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; each step
    is written to the shared folder, and so are the least neighbours, for a join
    whose hot node can be split.
    """
    edges = write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = write(moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: the id, n_shingles and component_id (the smallest id reachable by links).

    The work is done when this returns; only the result stays in the shared folder.
    """
    with Scratch(docs.sparkSession, "ngram-join") as scratch:
        write = scratch.write
        signed = write(sign(docs, id_col, text_col, n, percent), "ngram-sets")
        nodes = signed.where(F.col("_id").isNotNull() & (F.col("n") > 0))
        classes = write(nodes.groupBy("k1", "k2", "n").agg(F.min("_id").alias("_id"), F.min_by("_row", "_id").alias("_row"), *(F.min(s).alias(s) for s in SKETCH)), "ngram-classes")
        exploded = nodes.select("k1", F.explode("sigs").alias("sig"))
        shared = write(exploded.groupBy("sig").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo < hi").select("sig"), "ngram-shared")
        members = write(thin_out(exploded, "sig", shared).join(shared, "sig").select("sig", "k1").distinct(), "ngram-members")
        links = write(same_id(nodes), "ngram-same-id")
        grouped = None
        for salt in range(ROUNDS + 1):
            exhaustive = salt == ROUNDS
            placed = members.withColumn("component", F.col("k1")) if grouped is None else write(members.join(grouped.withColumnRenamed("node", "k1"), "k1", "left").withColumn("component", F.coalesce("component", "k1")), "ngram-placed")
            elected = placed.join(write(open_signatures(placed, exhaustive, salt), "ngram-homes"), "sig")
            rows = write(bundles(elected, classes, exhaustive, salt), "ngram-bundles")
            found = write(candidates(deal(rows, exhaustive, write), percent), "ngram-candidates")
            links = links.union(write(verify(found, docs, id_col, text_col, n, percent), "ngram-links"))
            grouped = components(links, write)

        labelled = write(classes.select("k1", "k2", "n", "_id").join(grouped.withColumnRenamed("node", "k1"), "k1", "left").withColumn("component", F.coalesce("component", "k1")), "ngram-labelled")
        smallest = write(labelled.groupBy("component").agg(F.min("_id").alias("component_id")), "ngram-smallest")
        answer = write(labelled.drop("_id").join(smallest, "component").select("k1", "k2", "n", "component_id"), "ngram-answer")
        rows = signed.select("_id", "n", "k1", "k2")
        empty = rows.where("n = 0").select("_id", "n")
        ids = write(empty.select("_id").where("_id IS NOT NULL").distinct(), "ngram-empty")
        lent = thin_out(nodes.select("_id", "n", "k1", "k2"), "_id", ids).join(ids, "_id").join(answer, ["k1", "k2", "n"]).groupBy("_id").agg(F.min("component_id").alias("component_id"))
        out = rows.where("n > 0").join(answer, ["k1", "k2", "n"], "left").select("_id", "n", "component_id").union(empty.join(lent, "_id", "left").select("_id", "n", "component_id"))
        own = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
        return materialize(out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id")), "ngram-result")
