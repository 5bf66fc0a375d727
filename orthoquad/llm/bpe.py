"""Byte-level BPE with a segment tree over byte positions.

A pre-token's bytes are the leaves of a segment tree; each live leaf holds the
rank of the pair it forms with its next live neighbour, and each inner node the
minimum of its range with the leftmost position that attains it.  The root
names the next merge.  A merge unlinks one leaf and updates three leaves
(itself, the unlinked one, its left neighbour), each in a logarithmic number of
steps.  Short pre-tokens run through one tree per row of a matrix, all rows
together; long ones through ``SegmentTree``, one at a time.

Null and empty texts have no tokens and decode to no bytes.  Repeated rows are
answered row by row; other columns are ignored; an empty table gives an empty
result.  No text is cut.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

NONE = np.int32(2**31 - 1)
#: Pre-tokens of more bytes than this use the scalar tree.
WIDE = 64
#: So few pre-tokens of one width use it too.
FEW = 24


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """(left id, right id) -> merged id; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.base = max(ranks.values()) + 1
        pairs = {ranks[t[:i]] * self.base + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = pairs
        self._fill(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32))
        single = [bytes([b]) for b in range(256)]
        self.byte_pairs = np.array([ranks.get(a + b, NONE) for a in single for b in single], np.int32)
        self.decode = [b""] * self.base
        for t, r in ranks.items():
            self.decode[r] = t

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed table, filled in rounds of one step."""
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slots, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.slots[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slots[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where ``right`` is missing (-1) or the pair is no token."""
        key = np.where(right >= 0, left * self.base + right, -2)
        at = self._slot(key)
        found = self.slots[at]
        out = self.values[at]
        wrong = np.flatnonzero((found != key) & (found != -1))
        out[found != key] = NONE
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.bits) - 1)
            found = self.slots[at[wrong]]
            hit = found == key[wrong]
            out[wrong[hit]] = self.values[at[wrong[hit]]]
            wrong = wrong[~hit & (found != -1)]
        return out


class SegmentTree:
    """Minimum with its leftmost position, over a list of ranks."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, (len(values) - 1).bit_length())
        self.tree = [int(NONE)] * self.size + list(values) + [int(NONE)] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def update(self, at: int, value: int) -> None:
        tree, at = self.tree, at + self.size
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            best = a if a <= b else b
            if tree[at] == best:
                break
            tree[at] = best
            at >>= 1

    def leftmost_min(self) -> tuple[int, int]:
        tree, at = self.tree, 1
        best = tree[1]
        while at < self.size:
            at = 2 * at + (tree[2 * at] != best)
        return best, at - self.size


def encode_scalar(piece: bytes, merges: Merges) -> list[int]:
    ids = merges.single[np.frombuffer(piece, np.uint8)].tolist()
    n, base, get, none = len(ids), merges.base, merges.pairs.get, int(NONE)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = lambda i: get(ids[i] * base + ids[after[i]], none) if after[i] < n else none
    tree = SegmentTree([rank(i) for i in range(n)])
    while True:
        best, i = tree.leftmost_min()
        if best == none:
            break
        j = after[i]
        ids[i], after[i] = best, after[j]
        if after[j] < n:
            before[after[j]] = i
        ids[j] = -1
        tree.update(j, none)
        tree.update(i, rank(i))
        if before[i] >= 0:
            tree.update(before[i], rank(before[i]))
    return [x for x in ids if x >= 0]


def encode_rows(pieces: list[bytes], width: int, merges: Merges) -> list[list[int]]:
    """Encode pieces of up to ``width`` bytes (a power of two), one tree a row."""
    n, depth = len(pieces), width.bit_length() - 1
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    size = np.fromiter(map(len, pieces), np.int64, n)[:, None]
    place = np.arange(width)
    wide, spare = width + 1, width  # the place behind the last one stands for neighbours off either end
    ids = np.full((n, wide), -1, np.int64)
    ids[:, :width] = np.where(place < size, merges.single[raw], -1)
    after = np.tile(np.minimum(np.arange(1, wide + 1), spare), n)
    before = np.tile(np.concatenate([[spare], np.arange(width)]), n)
    tree = np.full((n, 2 * width), NONE, np.int32)
    pairs = merges.byte_pairs[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
    tree[:, width:-1] = np.where(place[1:] < size, pairs, NONE)
    for level in range(depth - 1, -1, -1):
        a = 1 << level
        tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
    ids, tree = ids.ravel(), tree.ravel()

    def update(root, at, value):
        """Set leaves and the minima above them; ``root`` is where a row's tree begins."""
        node = at + width
        tree[root + node] = value
        for _ in range(depth):
            node >>= 1
            child = root + 2 * node
            tree[root + node] = np.minimum(tree[child], tree[child + 1])

    row, root = np.arange(n) * wide, np.arange(n) * (2 * width)
    while True:
        best = tree[root + 1]
        live = best != NONE
        if not live.all():
            row, root, best = row[live], root[live], best[live]
        if not len(row):
            break
        node = np.ones(len(row), np.int64)
        for _ in range(depth):
            node *= 2
            node += tree[root + node] != best
        i = node - width
        j = after[row + i]
        k = after[row + j]
        h = before[row + i]
        whole = best.astype(np.int64)
        ids[row + i] = whole
        ids[row + j] = -1
        after[row + i] = k
        before[row + k] = i  # the spare place may hold anything
        update(root, j, NONE)
        update(root, i, merges.rank(whole, ids[row + k]))
        left = np.flatnonzero(h < spare)
        update(root[left], h[left], merges.rank(ids[row[left] + h[left]], whole[left]))
    ids = ids.reshape(n, wide)
    mask = ids[:, :width] >= 0
    flat, count = ids[:, :width][mask].tolist(), mask.sum(1)
    ends = np.cumsum(count).tolist()
    return [flat[e - c : e] for e, c in zip(ends, count.tolist(), strict=True)]


def encode_pieces(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """Ids of each piece; a piece that is itself a token is that token."""
    out: list = [None] * len(pieces)
    groups: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        if (whole := merges.ranks.get(p)) is not None:
            out[i] = [whole]
        elif len(p) > WIDE:
            out[i] = encode_scalar(p, merges)
        else:
            groups.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
    for width, which in groups.items():
        if len(which) < FEW:
            for i in which:
                out[i] = encode_scalar(pieces[i], merges)
            continue
        for a in range(0, len(which), 4096):
            part = which[a : a + 4096]
            for i, ids in zip(part, encode_rows([pieces[i] for i in part], width, merges), strict=True):
                out[i] = ids
    return out


class Shown(dict):
    """A pre-token's decimal ids, joined by spaces, made when they are first asked for."""

    def __init__(self, ids: dict):
        self.ids = ids

    def __missing__(self, token: str) -> str:
        self[token] = text = " ".join(map(str, self.ids[token]))
        return text


class Codec:
    """Encoder with a bounded memory of pre-tokens met before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, capacity: int = 300_000):
        import regex

        self.merges = Merges(ranks)
        compiled = regex.compile(pattern)
        self.split = compiled.findall
        self.scan = lambda text: (m[0] for m in compiled.finditer(text))
        self.capacity = capacity
        self.ids: dict[str, list[int]] = {}
        self.shown = Shown(self.ids)
        self.count: dict[str, int] = {}

    def learn(self, tokens: list[list[str]]) -> None:
        if len(self.ids) > self.capacity:
            self.ids.clear()
            self.shown.clear()
            self.count.clear()
        new = list(set().union(*tokens).difference(self.ids))
        found = encode_pieces([t.encode("utf-8") for t in new], self.merges)
        self.ids.update(zip(new, found, strict=True))
        self.count.update(zip(new, map(len, found), strict=True))

    def encode(self, text: str) -> list[int]:
        tokens = self.split(text)
        self.learn([tokens])
        return list(chain.from_iterable(map(self.ids.__getitem__, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.decode.__getitem__, ids))


_CODECS: dict = {}


def codec(key: tuple, ranks: dict[bytes, int] | None = None) -> Codec:
    """One codec a worker process and vocabulary."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, key[0])
    return _CODECS[key]


def ship_ranks(docs: DataFrame, path: str):
    """Broadcast a rank file (under 1 MB) from the driver, so that executors need no copy of it."""
    with open(path, "rb") as f:
        raw = f.read()
    return docs.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


def shipped_codec(shipped, name: str, pattern: str) -> Codec:
    key = (pattern, name)
    return codec(key, None if key in _CODECS else parse_ranks(shipped.value))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``ids``, the token ids of the whole text."""
    shipped, name = ship_ranks(docs, ranks_path)

    def make():
        own = shipped_codec(shipped, name, pattern)

        def work(texts: list) -> dict:
            tokens = [own.split(t or "") for t in texts]
            own.learn(tokens)
            return {"ids": [list(chain.from_iterable(map(own.ids.__getitem__, t))) for t in tokens]}

        return work

    return map_texts(docs, id_col, text_col, "ids array<int>", make)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text: n_tokens, ids_sha256 of the decimal ids and decoded_sha256."""
    shipped, name = ship_ranks(docs, ranks_path)

    def make():
        own = shipped_codec(shipped, name, pattern)

        def work(texts: list) -> dict:
            tokens = [own.split(t or "") for t in texts]
            own.learn(tokens)
            counts, shown, decoded = [], [], []
            for t in tokens:
                ids = list(chain.from_iterable(map(own.ids.__getitem__, t)))
                counts.append(len(ids))
                shown.append(hashlib.sha256(" ".join(map(own.shown.__getitem__, t)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            return {"n_tokens": counts, "ids_sha256": shown, "decoded_sha256": decoded}

        return work

    return map_texts(docs, id_col, text_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
