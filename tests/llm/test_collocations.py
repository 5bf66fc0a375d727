"""Collocations against counts by brute force."""

import random
import re
from collections import Counter

from orthoquad.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, longest=4, least=3, percent=80, top=2000):
    n, f = Counter(), {}
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        held, rows = Counter(), []
        for p, a in counts.items():
            if a >= least:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        held[p[i : i + k]] = max(held[p[i : i + k]], a)
        for p, a in counts.items():
            if len(p) > 1 and a >= least and not (held[p] and 100 * held[p] >= percent * a):
                cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


def mined(spark, docs, **options):
    df = spark.createDataFrame([(t, g, "x", "y") for t, g in docs], "text string, lang string, block string, n string").repartition(3)
    found = collocations.mine(df, least=options.pop("least", 3), **options)
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect())


def corpus():
    rnd = random.Random(2)
    words = ["The", "the", "of", "New", "york", "city", "a", "É", "é", "日本", "x y", "\x00", "*"]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "?"]) for _ in range(n))
    docs = [(text(rnd.choice([0, 1, 2, 5, 40, 200])), rnd.choice(["en"] * 4 + ["fr", None, "und"])) for _ in range(120)]
    return docs + [(None, "en"), ("", None), ("...", "de"), ("one two three four " * 9, "de"), ("one two three four " * 9, "de")]


def test_against_brute_force_over_many_blocks(spark):
    docs = corpus()
    want = plain(docs)
    assert mined(spark, docs, block_bytes=1500) == want and mined(spark, docs) == want
    assert len(want) > 200 and {w[0] for w in want} == {"en", "fr", "und", "de"}


def test_top_and_other_lengths(spark):
    docs = corpus()
    assert mined(spark, docs, top=5, longest=3) == plain(docs, longest=3, top=5)


def test_nothing_and_one_long_piece(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("", "en"), ("word", "en")]) == []
    docs = [("ab cd " * 250_000 + "end", "en"), ("word" * 500_000 + " and one", "en")]
    assert mined(spark, docs) == plain(docs)


def test_exact_beyond_64_bits(spark):
    big = 2**52 + 1
    row = spark.createDataFrame([(big, big, big + 2)], "a long, l long, r long")
    assert row.select(collocations.score("a", "l", "r", 2_000_000)).first()[0] == 2_000_000 * big // (2 * big + 2)
