"""Order MinHash against a plain computation of the same fingerprints."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from orthoquad.llm import order_minhash as om

WRAP = 1 << 64


def signed(x):
    return x - WRAP if x >= WRAP // 2 else x


def chained(*parts):
    """The engine's 64-bit hash of several values: each one's hash seeds the next; nulls are passed over."""
    seed = 42
    for p in parts:
        if p is not None:
            data = p.encode() if isinstance(p, str) else p
            seed = xxhash.xxh64(data, seed=seed).intdigest()
    return signed(seed)


def long(x):
    return x.to_bytes(8, "little", signed=True)


def whole(x):
    return x.to_bytes(4, "little", signed=True)


def plain(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]{1,16}", text or "")
    grams = [chained(a, b) for a, b in zip(tokens, tokens[1:])] or [chained(t) for t in tokens]
    least = set(sorted(set(grams))[: om.SAMPLE])
    seen, keys = {}, []
    for g in grams:
        if g in least:
            occurrence = seen[g] = seen.get(g, -1) + 1
            keys.append((chained(long(g), whole(occurrence)) >> om.PLACE_BITS << om.PLACE_BITS) | len(keys))
    out = []
    for point in om.POINTS if keys else []:
        near = sorted(sorted(k ^ point for k in keys)[:2], key=lambda k: k & ((1 << om.PLACE_BITS) - 1))
        places = [k & ((1 << om.PLACE_BITS) - 1) for k in near]
        out.append(chained(*(long(keys[p] >> om.PLACE_BITS) for p in places)) % 65536)
    return out


def hexed(parts):
    return "".join(f"{p:04x}" for p in parts)


def near(a, b):
    return 0.0 if len(a) != len(b) else 1.0 if not a else sum(x == y for x, y in zip(a, b)) / om.ORDERS


def corpus():
    rnd = random.Random(5)
    words = [rnd.choice("abcdefgh") * rnd.randint(1, 3) + rnd.choice(["", "é", "😀", "x" * 40]) for _ in range(60)]
    prose = lambda n: rnd.choice([" ", "\n", "  "]).join(rnd.choice(words) for _ in range(n))
    texts = [None, "", " \t\n", "one", "one two", "a" * 5000, "b " * 3000, *(prose(n) for n in (2, 3, 5, 8, 50, 200, 900, 4000))]
    return texts + texts[-3:]


def test_against_plain(spark):
    texts = corpus()
    ids = [i * 3 - 10 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, texts)), "doc_id long, text string, _text string").repartition(3)
    got = {r["doc_id"]: r for r in om.compare(df).collect()}
    assert sorted(got) == ids
    order = sorted(zip(ids, texts), reverse=True)
    for (i, text), (next_id, following) in zip(order, order[1:] + order[:1]):
        text, following, r = text or "", following or "", got[i]
        need = len(text) // 3
        edited = text[: len(text) - need] + following[:need]
        assert (r["n_chars"], r["edited"], r["next_id"]) == (len(text), edited, next_id)
        a, b, c = plain(text), plain(edited), plain(following)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(a), hexed(b))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((near(a, b), near(a, c)))


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, "x y z"), (None, None), (1, "p q r s"), (1, "p q r s"), (1, "p q r s"), (2, "u v")]
    got = om.compare(spark.createDataFrame(rows, "k long, body string"), "k", "body").collect()
    assert len(got) == len(rows)
    same = [r for r in got if r["k"] == 1]
    assert len({r["fingerprint"] for r in same}) == 1 and sorted(r["near_next"] for r in same)[-2:] == [1.0, 1.0]
    assert om.compare(spark.createDataFrame([], "k long, body string"), "k", "body").collect() == []
    alone = om.compare(spark.createDataFrame([(7, "alone at last")], "k long, body string"), "k", "body").first()
    assert (alone["next_id"], alone["near_next"], alone["edited"]) == (7, 1.0, "alone at alon")


def test_likeness_follows_edits_and_order(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(600)]
    swapped = words[:]
    rnd.shuffle(swapped)
    few = [w if i % 40 else "new" + w for i, w in enumerate(words)]
    many = [w if i % 4 else "new" + w for i, w in enumerate(words)]
    moved = words[300:] + words[:300]
    own = plain(" ".join(words))
    to = [near(own, plain(" ".join(x))) for x in (few, many, swapped)]
    assert to[0] > to[1] > to[2] == 0.0
    # the same k-mers but one, in another order
    assert near(own, plain(" ".join(moved))) < 0.8


def test_query_of_the_entry(spark):
    from orthoquad.llm.queries import QUERIES

    got = QUERIES["op13_order_minhash"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    for r in got:
        text, following = texts[r["doc_id"]] or "", texts[after[r["doc_id"]]] or ""
        need = len(text) // 3
        edited = text[: len(text) - need] + following[:need]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == hexed(plain(text)) and r["edited_fingerprint"] == hexed(plain(edited))
    assert len(got) == len(texts)


def test_every_kmer_takes_part(spark):
    """Each order's two minimal k-mers are those of all k-mers, not of the 32 of least hash."""
    rnd = random.Random(8)
    texts = [" ".join(f"{rnd.choice('abc')}{rnd.randint(0, 10 * n)}" for _ in range(n)) for n in (20, 33, 64, 65, 300, 3000)]

    def whole_plain(text):
        tokens = text.split(" ")
        seen, keys = {}, []
        for g in (chained(a, b) for a, b in zip(tokens, tokens[1:])):
            seen[g] = seen.get(g, -1) + 1
            keys.append(((chained(long(g), whole(seen[g])) >> om.PLACE_BITS), len(keys)))
        near = [sorted(sorted(keys, key=lambda k: (k[0] ^ (p >> om.PLACE_BITS), k[1]))[:2], key=lambda k: k[1]) for p in om.POINTS]
        return hexed(chained(*(long(h) for h, _ in two)) % 65536 for two in near)

    got = {r["doc_id"]: r["fingerprint"] for r in om.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: whole_plain(t) for i, t in enumerate(texts)}


def test_hashes_that_share_their_high_bits_are_numbered_apart(spark):
    hashes = [7 << 40, (7 << 40) + 1, 7 << 40, 5, (7 << 40) + 1]
    got = spark.createDataFrame([(hashes,)], "h array<long>").select(om.numbered(F.col("h"))).first()[0]
    assert sorted(got, key=lambda k: k & ((1 << om.PLACE_BITS) - 1)) == [chained(long(h), whole(o)) >> om.PLACE_BITS << om.PLACE_BITS | i for i, (h, o) in enumerate(zip(hashes, (0, 0, 1, 0, 1)))]
