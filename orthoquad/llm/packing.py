"""Order-preserving packing of documents into fixed-length training sequences.

Documents are laid end to end in the order in which a task meets them.  Dynamic
programming over the cuts between sequences minimises padding plus penalties:
a cut at a document's end is free, at a sentence's end it costs ``SENTENCE``
tokens, and elsewhere ``HARD``.  As padding is linear in a sequence's length,
the best earlier cut is the minimum of (cost + position) over a sliding range
of positions, kept in a monotone queue; the longer lengths that need no padding at
all (powers of two) are a few further transitions.  A stream is solved in blocks;
the last sequence of a block is reopened in the next one.

A null or empty text is its end token alone.  Repeated rows are packed one by
one; other columns are ignored; an empty table gives no piece.  No token is
dropped, and a text of any length is packed whole.
"""

from __future__ import annotations

import os
import string
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trim

LENGTH = 2048
SENTENCE = 8
HARD = 48
#: Shorter powers of two are no sequences of their own, but for a task's tail.
SHORTEST = 64
#: Tokens of a block; its last sequence is packed again with what follows.
BLOCK = 1 << 18
#: Words that a task remembers; half a kilobyte each, so fewer mean less memory and more time.
WORDS = 800_000
FREE, AT_SENTENCE, AT_TOKEN = 0, 1, 2
#: Characters that str.split() takes for white space but the tokenizer doesn't.
ODD = "\x1c\x1d\x1e\x1f"
PUNCTUATION = string.punctuation


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class WordTokens:
    """Token ids of texts through a bounded memory of white-space separated words.

    The tokenizer drops white space and no token spans it, so a text's ids are
    its words' ids in turn.  Words that differ in case, or in punctuation at
    their end, are encoded once; those met only once are the first to be
    forgotten.  Texts with separators on which Python and the
    tokenizer disagree are encoded as one word.
    """

    def __init__(self, raw: str, end: int = 1, capacity: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw)
        self.tokenizer.encode_special_tokens = True
        self.end, self.capacity = end, capacity
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)  # of tokens that end a pre-token
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.number[""] = 0  # the end of a text, as a word of one token
        self.start, self.size, self.ends, self.hits = np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, bool), np.ones(1, np.int64)
        self.flat[0], self.used = self.end, 1

    def learn(self) -> None:
        """Encode the words numbered since the last call.

        Letters with ASCII punctuation behind them are two pre-tokens, of which
        the letters count in lower case.
        """
        number, fresh, known = self.number, self.number.fresh, len(self.ends)
        number.fresh = []
        plain, apart, same, joint = [], [], [], []

        def of(word: str, group: list) -> int:
            n = number.get(word)
            if n is None:
                number[word] = n = len(number)
                group.append((n, word))
            return n

        def each_of(words: pa.Array, group: list) -> np.ndarray:
            coded = words.dictionary_encode()
            return np.array([of(w, group) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], np.int64)[coded.indices.to_numpy()]

        words = pa.array(fresh, pa.large_string())
        bases = pc.ascii_rtrim(words, characters=PUNCTUATION)
        ascii_letters = pc.and_(pc.string_is_ascii(words), pc.ascii_is_alpha(bases)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(ascii_letters)
        own, base = words.take(pa.array(at)), bases.take(pa.array(at))
        low = pc.ascii_lower(base)
        lower = pc.equal(low, own).to_numpy(zero_copy_only=False)
        bare = pc.equal(base, own).to_numpy(zero_copy_only=False)
        plain += [(i + known, fresh[i]) for i in at[lower].tolist()]
        pick = bare & ~lower
        same.append(np.stack([at[pick] + known, each_of(low.filter(pa.array(pick)), plain)], axis=1))
        pick = ~bare
        tails = pc.replace_substring_regex(own.filter(pa.array(pick)), "^[A-Za-z]+", "")
        joint.append(np.stack([at[pick] + known, each_of(low.filter(pa.array(pick)), plain), each_of(tails, apart)], axis=1))
        for i in np.flatnonzero(~ascii_letters).tolist():
            w = fresh[i]
            base = w.rstrip(PUNCTUATION)
            low = base.lower()
            if not base.isalpha() or not low.isalpha() or "\u03a3" in base:  # lower() may add a mark, and treats a final sigma in its own way
                apart.append((i + known, w))
            elif low == w:
                plain.append((i + known, w))
            elif len(base) == len(w):
                same.append([[i + known, of(low, plain)]])
            else:
                joint.append([[i + known, of(low, plain), of(w[len(base) :], apart)]])
        total = len(number)
        grow = lambda x: np.concatenate([x, np.zeros(total - len(x), x.dtype)])
        self.start, self.size, self.ends, self.hits = grow(self.start), grow(self.size), grow(self.ends), grow(self.hits)
        self.ends[known : known + len(fresh)] = pc.match_substring_regex(words, r"""[.!?]["')]*$""").to_numpy(zero_copy_only=False)
        if plain:
            words = [w for _, w in plain]
            self._put([i for i, _ in plain], *(self._together(words) or self._apart(words)))
        if apart:
            self._put([i for i, _ in apart], *self._apart([w for _, w in apart]))
        i, j = np.concatenate(same).T
        self.start[i], self.size[i] = self.start[j], self.size[j]
        parts = np.concatenate(joint)
        pairs = parts[:, 1:].ravel()
        self._put(parts[:, 0], self._gather(self.start[pairs], self.size[pairs]), self.size[parts[:, 1]] + self.size[parts[:, 2]])

    def forget(self) -> None:
        """Drop the words that were met only once; all, if that frees less than half."""
        kept = [(w, n) for w, n in self.number.items() if self.hits[n] > 1 or not n]
        old = (self.start, self.size, self.ends, self.flat)
        self.clear()
        if 2 * len(kept) > self.capacity:
            return
        n = np.array([n for _, n in kept])
        self.number.update(zip((w for w, _ in kept), range(len(kept)), strict=True))
        self.start, self.size, self.ends, self.hits = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), old[2][n], np.ones(len(n), np.int64)
        sizes = old[1][n]
        last = np.cumsum(sizes)
        self._put(np.arange(len(n)), old[3][np.repeat(old[0][n] - (last - sizes), sizes) + np.arange(last[-1])], sizes)

    def _put(self, which: list[int] | np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(ids) >= len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids) + 1), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[which] = self.used + np.cumsum(sizes) - sizes
        self.size[which] = sizes
        self.used += len(ids)

    def _gather(self, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        last = np.cumsum(sizes)
        return self.flat[np.repeat(start - (last - sizes), sizes) + np.arange(last[-1] if len(last) else 0)]

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((x for i in ids for x in i), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of one pre-token each, encoded as one text; None if it has another number of pre-tokens."""
        flat = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.final[flat]) + 1
        if len(last) != len(words) or last[-1] != len(flat):
            return None
        return flat, np.diff(last, prepend=0)

    def _numbers(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and the numbers of all words in turn; distinct words are looked up once."""
        if any(c in t for t in texts if t for c in ODD):
            words = [[] if not t else [t] if any(c in t for c in ODD) else t.split() for t in texts]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            return counts, np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        trimmed = pc.utf8_trim_whitespace(pa.array([t or None for t in texts], pa.large_string()))
        lists = pc.utf8_split_whitespace(pc.if_else(pc.equal(trimmed, ""), None, trimmed))
        counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        known = np.fromiter(map(self.number.__getitem__, words.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(words.dictionary))
        return counts, known[words.indices.to_numpy()]

    def __call__(self, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text: ids with the end token last, and the positions where a sentence ends."""
        if not texts:
            return []
        if len(self.number) > self.capacity:
            self.forget()
        counts, numbers = self._numbers(texts)
        last_word = np.cumsum(counts + 1) - 1
        inner = np.ones(int(last_word[-1]) + 1, bool)
        inner[last_word] = False
        n = np.zeros(len(inner), np.int64)
        n[inner] = numbers
        if self.number.fresh:
            self.learn()
        self.hits += np.bincount(n, minlength=len(self.hits))
        sizes = self.size[n]
        ids, upto = self._gather(self.start[n], sizes), np.cumsum(sizes)
        ends = upto[self.ends[n]]
        bounds = [0, *upto[last_word].tolist()]
        cuts = np.searchsorted(ends, bounds, side="right").tolist()
        return [(ids[a:b], ends[i:j] - a) for a, b, i, j in zip(bounds, bounds[1:], cuts, cuts[1:], strict=False)]


def candidates(total: int, ends: np.ndarray, sentences: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in (0, total], ascending, and their kinds; gaps too long to bridge get hard cuts."""
    kind = np.full(total + 1, 255, np.uint8)
    kind[sentences] = AT_SENTENCE
    kind[ends] = FREE
    kind[total] = min(kind[total], AT_TOKEN)
    at = np.flatnonzero(kind[1:] != 255) + 1
    gaps = np.diff(at, prepend=0)
    step = max(1, length // 4)
    for i in np.flatnonzero(gaps > step).tolist():
        extra = np.arange(at[i] - gaps[i] + step, at[i], step)
        kind[extra] = AT_TOKEN
    at = np.flatnonzero(kind[1:] != 255) + 1
    return at, kind[at]


def plan(at: np.ndarray, kind: np.ndarray, length: int = LENGTH, sentence: int = SENTENCE, hard: int = HARD) -> list[int]:
    """Positions where sequences end, of least padding plus penalties, for cut positions ``at`` (the last one ends the stream)."""
    price = np.array([0, sentence, hard])[kind]
    price[-1] = 0
    where = np.concatenate([[0], at])
    exact: dict[int, list[int]] = {}
    for size in (1 << k for k in range(SHORTEST.bit_length() - 1, 40) if 1 << k < length):
        found = np.searchsorted(where, where - size)
        hit = np.flatnonzero((where >= size) & (where[found] == where - size))
        for j, i in zip(hit.tolist(), found[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(i)
    place, charge = where.tolist(), [0, *price.tolist()]
    cost, back = [0] * len(place), [0] * len(place)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, cut), increasing in both
    for j in range(1, len(place)):
        p = place[j]
        while place[queue[0][1]] < p - length:
            queue.popleft()
        best, i = queue[0]
        best += length - p
        if j in exact:
            for k in exact[j]:
                if cost[k] < best:
                    best, i = cost[k], k
        best += charge[j]
        cost[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], len(place) - 1
    while j:
        cuts.append(place[j])
        j = back[j]
    return cuts[::-1]


def close_tail(size: int, length: int = LENGTH, hard: int = HARD) -> list[int]:
    """Lengths of the last sequences: cut into powers of two where that is cheaper than padding."""
    bits = [1 << k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]
    return bits if (len(bits) - 1) * hard < length - size else [size]


class Packer:
    """Packs a stream of documents; ``add`` and ``finish`` return finished pieces.

    A piece is (doc number, start in its document, length, crc of its ids,
    document's tokens, sequence, offset in the sequence).
    """

    def __init__(self, length: int = LENGTH, sentence: int = SENTENCE, hard: int = HARD, block: int = BLOCK):
        self.length, self.sentence, self.hard, self.block = length, sentence, hard, max(block, 4 * length)
        self.docs: deque = deque()  # (number, ids, sentence ends, tokens packed so far)
        self.waiting, self.number, self.sequence = 0, 0, 0

    def add(self, ids: np.ndarray, sentences: np.ndarray) -> list[tuple]:
        self.docs.append([self.number, ids, sentences, 0])
        self.number += 1
        self.waiting += len(ids)
        return self._pack(False) if self.waiting >= self.block else []

    def finish(self) -> list[tuple]:
        return self._pack(True) if self.waiting else []

    def _pack(self, last: bool) -> list[tuple]:
        left = np.array([len(d[1]) - d[3] for d in self.docs], np.int64)
        ends = np.cumsum(left)
        sentences = [d[2][d[2] > d[3]] - d[3] + e - n for d, e, n in zip(self.docs, ends.tolist(), left.tolist(), strict=True)]
        at, kind = candidates(int(ends[-1]), ends, np.concatenate(sentences), self.length)
        cuts = plan(at, kind, self.length, self.sentence, self.hard)
        out, begin = [], 0
        for c in cuts if last else cuts[:-1]:
            for size in close_tail(c - begin, self.length, self.hard) if c == cuts[-1] else [c - begin]:
                out += self._take(size)
            begin = c
        return out

    def _take(self, size: int) -> list[tuple]:
        out, offset = [], 0
        while offset < size:
            doc = self.docs[0]
            n = min(size - offset, len(doc[1]) - doc[3])
            crc = zlib.crc32(doc[1][doc[3] : doc[3] + n].astype("<u4", copy=False).tobytes())
            out.append((doc[0], doc[3], n, crc, len(doc[1]), self.sequence, offset))
            doc[3] += n
            offset += n
            if doc[3] == len(doc[1]):
                self.docs.popleft()
        self.sequence += 1
        self.waiting -= size
        return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, length: int = LENGTH, sentence: int = SENTENCE, hard: int = HARD, keep: tuple[str, ...] = (), block: int = BLOCK, capacity: int = WORDS, run_bytes: int = 4_000_000) -> DataFrame:
    """Pieces of ``docs``: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the columns ``keep``.

    The order within a task is kept; sequences never span tasks, so each task
    leaves one tail.  Sequence ids are unique over all tasks.  A task remembers
    about ``capacity`` words and tokenizes about ``run_bytes`` bytes at once: less
    of either takes less memory and more time.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint{kept}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer = WordTokens(shipped.value, end, capacity), Packer(length, sentence, hard, block)
        base = TaskContext.get().partitionId() << 40
        open_rows: deque = deque()  # (first document's number, rows) of documents not yet packed whole

        def shown(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(pieces), 8192):
                part = pieces[a : a + 8192]
                number, start, size, crc, total, sequence, offset = map(list, zip(*part, strict=True))
                rows = []
                for n in number:
                    while open_rows[0][0] + open_rows[0][1].num_rows <= n:
                        open_rows.popleft()
                    i = 0
                    while open_rows[i][0] + open_rows[i][1].num_rows <= n:
                        i += 1
                    rows.append((open_rows[i][1], n - open_rows[i][0]))
                columns = []
                for name in ["_id", *(f"_keep{i}" for i in range(len(keep)))]:
                    columns.append(pa.array([r.column(name)[i].as_py() for r, i in rows], rows[0][0].schema.field(name).type))
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays([columns[0], long(start), long(size), long(crc), long(total), long([base + s for s in sequence]), long(offset), *columns[1:]], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *keep])

        for part, texts in slices(batches, "_text", run_bytes):
            open_rows.append((packer.number, part.select(["_id", *(f"_keep{i}" for i in range(len(keep)))])))
            for ids, ends in tokens(texts):
                if found := packer.add(ids, ends):
                    yield from shown(found)
        yield from shown(packer.finish())
        del tokens
        trim()

    return picked.mapInArrow(run, schema)
