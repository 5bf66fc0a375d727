"""Fingerprints by Order MinHash, in DataFrame functions only.

A text's tokens are its words, longer ones in pieces of 16 characters (white
space is ASCII's).  Each pair of neighbours is a k-mer, hashed to 64 bits; a
text of one token is one k-mer.  All k-mers of a text take part, each with all
its occurrences.  These are numbered, so that repeats differ, and hashed with
their numbers.  Each of ``ORDERS`` fixed points puts the numbered k-mers into an
order of its own, that of their hashes' distances from it; all numbered k-mers
of two texts are as likely to be the minimal one.  The two minimal ones, taken
in the order in which they stand in the text, are hashed to one component of the
fingerprint.  Two texts share a component about as often as they share two
k-mers in the same order; the share of equal components is their likeness.

Every token of a text is hashed, whatever its length.  An order looks for its
two minimal k-mers among those within a distance that about ``NEAR`` have, and
among all where fewer than two lie there, so that the result is that of all.  Null and empty texts and
those of white space alone have an empty fingerprint, alike among themselves
and unlike any other.  Equal rows are told apart by a row number; rows with a
null id come after all others.  Other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number
from .common import materialize
from .quality import let

#: Characters of a token at most; fixed by the expression.
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
#: K-mers that are put into orders, as the end of a slice (all), and the number of orders.
SAMPLE = None
ORDERS = 32
#: K-mers that an order compares, about; leading bits by which points share a first selection.
NEAR = 8
GROUP_BITS = 3
#: Bits of a packed key that hold a place, and of a component.
PLACE_BITS = 30
COMPONENT_BITS = 16
_draw = random.Random(13)
#: An order of hashes is that of their distances (exclusive or) from one of these.
POINTS = [(_draw.getrandbits(64 - PLACE_BITS) << PLACE_BITS) - (1 << 63) for _ in range(ORDERS)]
#: Points by their leading bits, and where each order stands among them.
GROUPS = {base: [p for p in POINTS if p >> (64 - GROUP_BITS) << (64 - GROUP_BITS) == base] for base in sorted({p >> (64 - GROUP_BITS) << (64 - GROUP_BITS) for p in POINTS})}
PLACES = [[p for group in GROUPS.values() for p in group].index(p) for p in POINTS]


def _masked(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _keyed(hashed: Column, place: Column) -> Column:
    """A hash's high bits over a place."""
    return _masked(hashed, -(1 << PLACE_BITS)).bitwiseOR(place.cast("long"))


def _place(key: Column) -> Column:
    return _masked(key, (1 << PLACE_BITS) - 1).cast("int")


def kmers(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.transform(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.least(n, F.lit(1)))), lambda t, i: F.xxhash64(t, F.get(tokens, i + 1)))


def numbered(hashes: Column) -> Column:
    """A key for each hash, in any order: the hash of it and of how often it came before, over its place."""

    def runs(places: Column, first: Column) -> Column:
        """From places in the order of their hashes, and where a hash begins there: each run of a hash is counted through."""
        return F.flatten(F.transform(first, lambda at, j: F.transform(F.slice(places, at + 1, F.coalesce(F.get(first, j + 1), F.size(places)) - at), lambda p, o: _keyed(F.xxhash64(hashes[p], o), p))))

    def begins(places: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(places) - 1), lambda i: F.coalesce(hashes[places[i]] != F.get(hashes, F.get(places, i - 1)), F.lit(True)))

    packed = F.transform(F.sort_array(F.transform(hashes, lambda h, i: _keyed(h, i))), _place)
    exact = F.transform(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda x: x["i"])
    once = F.transform(hashes, lambda h, i: _keyed(F.xxhash64(h, F.lit(0)), i))

    def repeated(kinds: Column) -> Column:
        # packed keys hold a hash's high bits, so hashes that share these may stand mixed; then a hash begins twice
        short = lambda places: let(begins(places), lambda first: F.when(F.size(first) == kinds, runs(places, first)).otherwise(let(exact, lambda x: let(begins(x), lambda f: runs(x, f)))))
        return F.when(kinds == F.size(hashes), once).otherwise(let(packed, short))

    return let(F.size(F.array_distinct(hashes)), repeated)


def minima(keys: Column) -> Column:
    """One component an order: the hash of its two nearest keys in the order of the text."""
    n = F.size(keys)
    grouped = n >= NEAR << GROUP_BITS
    limit = (F.lit(-(2.0**63)) + F.lit(NEAR * 2.0**64) / F.greatest(n, F.lit(2 * NEAR))).cast("long")

    def component(point: Column, v: Column) -> Column:
        """From the distances of the nearest keys, in their order."""
        a, b = v[0], F.get(v, 1)
        own = lambda x: F.shiftright(x.bitwiseXOR(point), PLACE_BITS)
        forward = b.isNull() | (_place(a) < _place(b))
        return _masked(F.when(forward, F.xxhash64(own(a), own(b))).otherwise(F.xxhash64(own(b), own(a))), (1 << COMPONENT_BITS) - 1).cast("int")

    def of(limit: Column) -> Column:
        def nearest(part: Column, point: Column) -> Column:
            near = F.filter(part, lambda x: x.bitwiseXOR(point) < limit)
            some = let(near, lambda x: F.when(F.size(x) >= 2, x).otherwise(keys))
            return let(F.sort_array(F.transform(some, lambda x: x.bitwiseXOR(point))), lambda v: component(point, v))

        group = lambda base: F.when(grouped, F.filter(keys, lambda x: x.bitwiseXOR(base) < F.lit((1 << (64 - GROUP_BITS)) - (1 << 63)))).otherwise(keys)
        groups = F.array(*(F.struct(F.lit(base).cast("long").alias("base"), F.array(*(F.lit(p).cast("long") for p in points)).alias("points")) for base, points in GROUPS.items()))
        found = F.flatten(F.transform(groups, lambda g: let(group(g["base"]), lambda part: F.transform(g["points"], lambda p: nearest(part, p)))))
        return let(found, lambda x: F.transform(F.array(*map(F.lit, PLACES)), lambda at: x[at]))

    return let(limit, of)


def components(text: Column) -> Column:
    """The fingerprint of a text as ``ORDERS`` numbers of 16 bits; empty without a token."""
    some = lambda h: F.when(F.size(h) == 0, F.array().cast("array<int>")).otherwise(let(numbered(h), minima))
    return let(let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), kmers), some)


def shown(parts: Column) -> Column:
    """A fingerprint as hexadecimal text, four digits a component."""
    return F.array_join(F.transform(parts, lambda c: F.lpad(F.lower(F.hex(c)), COMPONENT_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal components: 1 for two empty fingerprints, 0 for an empty and another one."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when(F.size(a) != F.size(b), 0.0).when(F.size(a) == 0, 1.0).otherwise(equal / ORDERS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``fingerprint`` of each text; one scan, no shuffle."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias(id_col), shown(components(text)).alias("fingerprint"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3) -> DataFrame:
    """Each text against an edited form of itself and against the next text by descending id.

    The last floor(n / ``share``) of a text's n characters are replaced by as
    many first ones of the next text, or by all of it; the text after the last
    is the first.  Returns the id, n_chars, edited (the text), fingerprint,
    edited_fingerprint, near_edited, near_next and next_id.

    Rows are numbered in order of their ids; what a text needs of the next one,
    its first characters and its fingerprint, is joined by row number, so no key
    is hot.
    """
    picked = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    rows = materialize(picked.select("_id", "_text", F.length("_text").alias("_n"), components(F.col("_text")).alias("_parts"), F.monotonically_increasing_id().alias("_row")), "order-minhash", compression="zstd")
    total = max(rows.count(), 1)
    placed = number(rows.select("_id", "_row", "_n"), [F.desc_nulls_last("_id"), "_row"], name="_at")
    taker = placed.select("_at", F.col("_row").alias("_to"), F.floor(F.col("_n") / share).cast("int").alias("_need"))
    giver = placed.select(F.pmod(F.col("_at") - 1, F.lit(total)).alias("_at"), "_row")
    # both joins read the same columns of the rows, so that their texts are shuffled once
    sent = rows.join(giver.join(taker, "_at").drop("_at"), "_row").select(F.col("_to").alias("_row"), "_need", F.substring("_text", F.lit(1), F.least("_need", "_n")).alias("_head"), F.col("_parts").alias("_next"), F.col("_id").alias("next_id"))
    both = rows.join(sent, "_row")
    edited = both.withColumn("edited", F.concat(F.substring("_text", F.lit(1), F.col("_n") - F.col("_need")), F.col("_head"))).withColumn("_edited", components(F.col("edited")))
    return edited.select(F.col("_id").alias(id_col), F.col("_n").cast("long").alias("n_chars"), "edited", shown(F.col("_parts")).alias("fingerprint"), shown(F.col("_edited")).alias("edited_fingerprint"), likeness(F.col("_parts"), F.col("_edited")).alias("near_edited"), likeness(F.col("_parts"), F.col("_next")).alias("near_next"), "next_id")
