"""Quality by weak supervision, in DataFrame functions only.

Rules over a text's counts vote good (+1), bad (-1) or abstain (0).
Expectation-maximisation estimates, per rule, how often it votes bad on bad
texts and good on good ones; a text's posterior probability of being good then
replaces an all-must-pass filter.  The estimation reads only how often each
pattern of votes occurs: at most 3 ** len(RULES) rows, whatever the input.

Null and empty texts have no words, every count 0 and fail the base rule.
Repeated rows are counted and answered row by row; other columns are ignored;
an empty table gives an empty result.  A text's repeated windows are found by
64-bit hashes of its own 3-word windows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a packed key that hold a window's position.
POSITION_BITS = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more in ``words``."""

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(starts), zero, lambda a, p: F.struct(p.alias("at"), (a.n + F.least(F.lit(3), p - a["at"])).alias("n")), lambda a: a.n)

    def by_struct(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda x, y: F.coalesce(x.h == y.h, F.lit(False))
        return let(pairs, lambda s: covered(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x.i)))

    def by_key(hashes: Column) -> Column:
        """Sort keys of a hash's high bits and the position; where two hashes share those bits, sort the pairs."""
        low = (1 << POSITION_BITS) - 1
        keys = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        at = lambda key: key.bitwiseAND(F.lit(low)).cast("int")
        high = lambda key: F.shiftright(key, POSITION_BITS)
        near = lambda x, y: F.coalesce(high(x) == high(y), F.lit(False))

        def found(s: Column) -> Column:
            clash = F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: near(s[i - 1], s[i]) & (hashes[at(s[i - 1])] != hashes[at(s[i])]))
            own = covered(F.transform(F.filter(s, lambda x, i: near(x, F.get(s, i - 1)) | near(x, F.get(s, i + 1))), at))
            return F.when(clash, by_struct(hashes)).otherwise(own)

        return let(keys, found)

    def counted(hashes: Column) -> Column:
        n = F.size(hashes)
        return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0)).when(n >= 1 << POSITION_BITS, by_struct(hashes)).otherwise(by_key(hashes))

    hashes = F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashes, counted))


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and counts of the whole text; one scan, no shuffle."""
    picked = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    words = F.filter(F.split("_t", SPACE), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = picked.select(
        "_id",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.size(F.filter(x, lambda y: F.substring(F.rtrim(y), -1, 1).isin(".", "!", "?", '"', ":", ";"))).cast("long").alias("n_ended"),
            ),
        ).alias("l"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_t", r"\P{L}+", "")).cast("long").alias("n_letters"),
    )
    return measured.select(F.col("_id").alias(id_col), "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "l.n_ended", "n_upper", "n_letters")


def vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.when(F.col(b) > 0, F.col(b))


def _between(x: Column, low: float, high: float, least: float, most: float) -> Column:
    return vote(x, x.between(low, high), (x < least) | (x > most))


def _at_most(x: Column, good: float, bad: float) -> Column:
    return vote(x, x <= good, x > bad)


#: Votes over the counts; each abstains where its ratio is undefined or neither clear case holds.
RULES: dict[str, Callable[[], Column]] = {
    "length": lambda: _between(F.col("n_words"), 80, 10**9, 50, 10**12),
    "word_length": lambda: _between(ratio("word_chars", "n_words"), 3, 10, 2, 14),
    "symbols": lambda: _at_most(ratio("n_symbols", "n_words"), 0.05, 0.15),
    "symbol_share": lambda: _at_most(ratio("n_symbols", "word_chars"), 0.02, 0.05),
    "letters": lambda: vote(ratio("n_letters", "word_chars"), ratio("n_letters", "word_chars") >= 0.85, ratio("n_letters", "word_chars") < 0.75),
    "dup_lines": lambda: _at_most(ratio("n_dup_lines", "n_lines"), 0.2, 0.4),
    "repetition": lambda: _at_most(ratio("n_repeat_words", "n_words"), 0.2, 0.4),
    "capitals": lambda: _at_most(ratio("n_upper", "word_chars"), 0.15, 0.3),
    "endings": lambda: vote(ratio("n_ended", "n_lines"), ratio("n_ended", "n_lines") >= 0.6, ratio("n_ended", "n_lines") < 0.2),
}


#: Where the estimation starts, and pseudo-votes in favour of that, as a share of a rule's votes.
START_BAD, START_SENS, START_SPEC = 0.15, 0.2, 0.95
PRIOR = 0.002


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 300) -> tuple[float, list[float], list[float]]:
    """EM over counts of vote patterns: P(bad), and per rule P(bad vote | bad) and P(good vote | good), given a vote.

    Any accuracy and any share of bad texts can come out; weak priors hold a
    rule that has hardly voted, and keep probabilities off 0 and 1.  Which of
    the two classes is the good one is told by its rules' good votes.
    """
    bad, sens, spec = START_BAD, [START_SENS] * rules, [START_SPEC] * rules
    total = sum(n for _, n in patterns)
    prior = [1 + PRIOR * sum(n for votes, n in patterns if votes[j]) for j in range(rules)]
    for _ in range(rounds if total else 0):
        before = (bad, *sens, *spec)
        mass, voted, on_bad, on_good = 0.0, [[0.0, 0.0] for _ in range(rules)], [START_SENS * x for x in prior], [START_SPEC * x for x in prior]
        for votes, n in patterns:
            p = posterior(votes, bad, sens, spec)
            mass += n * (1 - p)
            for j, v in enumerate(votes):
                if v:
                    voted[j][0] += n * (1 - p)
                    voted[j][1] += n * p
                    on_bad[j] += n * (1 - p) * (v < 0)
                    on_good[j] += n * p * (v > 0)
        bad = (mass + START_BAD) / (total + 1)
        sens = [x / (v[0] + w) for x, v, w in zip(on_bad, voted, prior, strict=True)]
        spec = [x / (v[1] + w) for x, v, w in zip(on_good, voted, prior, strict=True)]
        if max(abs(x - y) for x, y in zip(before, (bad, *sens, *spec), strict=True)) < 1e-9:
            break
    if sum(spec) < sum(1 - a for a in sens):
        bad, sens, spec = 1 - bad, [1 - s for s in spec], [1 - a for a in sens]
    return bad, sens, spec


def weights(bad: float, sens: list[float], spec: list[float]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of good: the prior's, and per rule those of a good and of a bad vote."""
    return math.log((1 - bad) / bad), [(math.log(s / (1 - a)), math.log((1 - s) / a)) for a, s in zip(sens, spec, strict=True)]


def posterior(votes: tuple[int, ...], bad: float, sens: list[float], spec: list[float]) -> float:
    odds, each = weights(bad, sens, spec)
    odds += sum((0, g, b)[v] for v, (g, b) in zip(votes, each, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    """The base rule over ``counts``."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per row of ``docs``: counts, ``base_failed``, ``posterior`` (of being good) and ``kept``."""
    names = list(RULES)
    counted = counts(docs, id_col, text_col)
    voted = materialize(counted.select("*", *(rule().cast("int").alias(f"vote_{n}") for n, rule in RULES.items())), "quality")
    own = [f"vote_{n}" for n in names]
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*own).count().collect()]
    odds, each = weights(*estimate(sorted(patterns), len(names)))
    total = F.lit(odds)
    for column, (g, b) in zip(own, each, strict=True):
        total = total + F.when(F.col(column) > 0, g).when(F.col(column) < 0, b).otherwise(0.0)
    quality = 1 / (1 + F.exp(-total))
    failed = base_failed(min_words, max_repeat_percent)
    return voted.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"), quality.alias("posterior"), *own)
