"""Edit-aware token counts.

A document is kept as a segment tree over runs of pre-tokens; each node holds
the characters and tokens below it.  An edit re-splits only from the last
pre-token boundary that the edit cannot have moved to the first old boundary
behind it on which the new split falls; as the split at a place depends on what
follows alone, everything behind stays.  The touched leaves are replaced and
the sums above them updated.

Edit positions are code points of the text as it stands before that edit, end
exclusive; positions outside the text are brought to its ends, and a null
position means the text's end.  A null text is empty; null or empty edits leave
it as it is; a null replacement deletes.  Repeated rows are answered row by
row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, ship_ranks, shipped_codec
from .common import slices

#: Pre-tokens of a fresh leaf.
LEAF = 64
#: Characters behind a pre-token's end that the public pattern may have looked at.
AHEAD = 2


class CountTree:
    """``tokens`` are the pre-tokens of the text, and ``ahead`` the characters behind a pre-token that its split depends on.

    An edit touches the leaves that it changes and the nodes above them.  A leaf
    of more pre-tokens than four fresh ones and than there are leaves makes the
    tree anew, which is paid for by what was inserted into that leaf.
    """

    def __init__(self, tokens: list[str], codec: Codec, ahead: int = AHEAD):
        self.codec, self.ahead = codec, ahead
        self.reencoded = 0
        self._build(tokens)

    def _counts(self, tokens: list[str]) -> list[int]:
        try:
            return list(map(self.codec.count.__getitem__, tokens))
        except KeyError:
            self.codec.learn([tokens])
            return list(map(self.codec.count.__getitem__, tokens))

    def _build(self, tokens: list[str]) -> None:
        at = np.arange(0, max(1, len(tokens)), LEAF)
        self.leaves: list[list[str]] = [tokens[a : a + LEAF] for a in at.tolist()]
        self.size = 1 << (len(at) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        if tokens:
            self.chars[self.size : self.size + len(at)] = np.add.reduceat(np.fromiter(map(len, tokens), np.int64, len(tokens)), at)
            self.tokens[self.size : self.size + len(at)] = np.add.reduceat(np.array(self._counts(tokens), np.int64), at)
        low = self.size
        while low > 1:
            for sums in (self.chars, self.tokens):
                sums[low // 2 : low] = sums[low : 2 * low : 2] + sums[low + 1 : 2 * low : 2]
            low //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(t for leaf in self.leaves for t in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf with character ``at`` (the last leaf with any, at the end) and its first character's position."""
        node, begin = 1, 0
        at = max(0, min(at, self.length - 1))
        while node < self.size:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return node - self.size, begin

    def _before(self, leaf: int) -> int:
        """Characters of the leaves before ``leaf``."""
        if leaf >= self.size:
            return self.length
        node, total = leaf + self.size, 0
        while node > 1:
            if node % 2:
                total += int(self.chars[node - 1])
            node //= 2
        return total

    def _set(self, leaf: int, tokens: list[str], count: int) -> None:
        self.leaves[leaf] = tokens
        node = leaf + self.size
        self.chars[node], self.tokens[node] = sum(map(len, tokens)), count
        node //= 2
        while node:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
            node //= 2

    def edit(self, start: int | None, end: int | None, new: str | None) -> None:
        """Replace the characters from ``start`` to ``end`` by ``new``."""
        new, length = new or "", self.length
        start = length if start is None else max(0, min(start, length))
        end = length if end is None else max(start, min(end, length))
        if start == end and not new:
            return
        first, begin = self._find(start - self.ahead)
        last, _ = self._find(end)
        while True:
            old = [t for leaf in self.leaves[first : last + 1] for t in leaf]
            found = self._splice(old, begin, start, end, new, self._before(last + 1) == length)
            if found is not None:
                break
            last = min(len(self.leaves) - 1, last + max(1, last - first))
        safe, fresh, behind = found
        held = int(self.tokens[self.size + first : self.size + last + 1].sum())
        whole = old[:safe] + fresh + old[behind:]
        self._set(first, whole, held + sum(self._counts(fresh)) - sum(self._counts(old[safe:behind])))
        self.reencoded += len(fresh)
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, [], 0)
        if len(whole) > max(4 * LEAF, len(self.leaves)):
            self._build([t for leaf in self.leaves for t in leaf])

    def _splice(self, old: list[str], begin: int, start: int, end: int, new: str, at_end: bool) -> tuple[int, list[str], int] | None:
        """How many of ``old``, which begins at ``begin``, stay, the fresh pre-tokens, and where ``old`` goes on; None if more of the text is needed."""
        ends = (np.cumsum(np.fromiter(map(len, old), np.int64, len(old))) + begin).tolist()
        safe = next((i for i, e in enumerate(ends) if e > start - self.ahead), len(old))
        region = ends[safe - 1] if safe else begin
        rest = "".join(old[safe:])
        local = rest[: start - region] + new + rest[end - region :]
        moved = len(new) - (end - start)
        kept = {e: i for i, e in enumerate(ends) if e >= end}
        fresh: list[str] = []
        at = 0
        for token in self.codec.scan(local):
            at += len(token)
            if not at_end and at + self.ahead > len(local):
                return None
            fresh.append(token)
            i = kept.get(region + at - moved)
            if i is not None:
                return safe, fresh, i + 1
        return (safe, fresh, len(old)) if at_end else None


def count(docs: DataFrame, edits_col: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ahead: int = AHEAD) -> DataFrame:
    """Per row: the id, n_tokens, n_tokens_edited after the edits in order, and n_reencoded pre-tokens.

    ``edits_col`` holds an array of structs (start, end, replacement).  A
    ``pattern`` that looks farther than two characters behind a match needs
    ``ahead`` to say how far.
    """
    shipped, name = ship_ranks(docs, ranks_path)
    start, end, new = docs.schema[edits_col].dataType.elementType.names[:3]
    each = F.transform(edits_col, lambda e: F.struct(e[start].cast("long").alias("a"), e[end].cast("long").alias("b"), e[new].cast("string").alias("t")))
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), each.alias("_edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shipped_codec(shipped, name, pattern)
        for part, texts in slices(batches, "_text"):
            tokens = [codec.split(t or "") for t in texts]
            codec.learn(tokens)  # all new pre-tokens of the run at once
            before, after, work = [], [], []
            for own, edits in zip(tokens, part.column("_edits").to_pylist(), strict=True):
                tree = CountTree(own, codec, ahead)
                before.append(tree.total)
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["a"], e["b"], e["t"])
                after.append(tree.total)
                work.append(tree.reencoded)
            long = [pa.array(x, pa.int64()) for x in (before, after, work)]
            yield pa.RecordBatch.from_arrays([part.column("_id"), *long], names=[id_col, "n_tokens", "n_tokens_edited", "n_reencoded"])

    return picked.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, n_tokens_edited bigint, n_reencoded bigint")
