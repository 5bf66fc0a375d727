"""Secret scan behind a trigram inverted index.

Each rule's regular expression is parsed, and a Boolean query over three-byte
substrings that every match must contain is derived from its syntax tree.  A
block of documents gets an inverted index (trigram -> posting list); the
query's postings are intersected and united, and only the surviving documents
are verified with the expression itself.  A rule without mandatory trigrams
scans all documents.  Index blocks are runs of rows within a task, so the scan
needs no shuffle and a hot source or group of copies costs nothing extra.

Null and empty texts have no spans; repeated rows are answered row by row;
columns other than the id and the text are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import re._constants as sre_c
import re._parser as sre_p
from dataclasses import dataclass
from itertools import pairwise, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts


@dataclass(frozen=True)
class Rule:
    """``min_len`` applies to ``group``; shorter matches are dropped after they have consumed their text."""

    kind: str
    pattern: str
    group: int = 0
    min_len: int = 0
    flags: int = re.ASCII


# The base rules.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: From the header through the key to its END line; without one, through the lines of base64 (or runs of 16 or more on one line).
PEM = (
    r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----"
    r"(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END \1-----"
    r"|(?:\s*(?:Proc-Type|DEK-Info):[^\n]*)*+(?:(?:\s|\\[rn])*[A-Za-z0-9+/]{16,}={0,2})*+(?:[ \t]*(?:\r?\n[ \t]*)+[A-Za-z0-9+/]+={0,2}(?=[ \t]*(?:[\r\n]|\Z)))*+)"
)
#: Public token formats, added to the base rules.  A jwt starts where no character of a token precedes, so that a run is read once.
EXTRA_RULES = (
    Rule("pem", PEM),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + EXTRA_RULES

# ---- Boolean trigram queries -------------------------------------------------
#: A query is True (no condition), a trigram (bytes), or ("and"/"or", frozenset of queries).
Query = object
MAX_STRINGS = 64
MAX_CLASS = 8
ANY = frozenset([""])


def q_and(*parts: Query) -> Query:
    flat: set = set()
    for p in parts:
        if p is not True:
            flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def q_or(*parts: Query) -> Query:
    if any(p is True for p in parts):
        return True
    flat: set = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == "or" else {p}
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def fold(text: str) -> str:
    """Lower-case A-Z only, as the index does."""
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def trigrams_of(text: str) -> Query:
    raw = fold(text).encode()
    return q_and(*(raw[i : i + 3] for i in range(len(raw) - 2)))


def any_of(strings: frozenset) -> Query:
    return q_or(*(trigrams_of(s) for s in strings)) if strings else True


@dataclass(frozen=True)
class Info:
    """What is known of all strings that an expression matches.

    ``exact`` is the full set if it is small, else None; then every match
    starts with one of ``prefix``, ends with one of ``suffix`` and satisfies
    ``match``.
    """

    exact: frozenset | None
    prefix: frozenset
    suffix: frozenset
    match: Query


UNKNOWN = Info(None, ANY, ANY, True)
EMPTY = Info(frozenset([""]), ANY, ANY, True)


def of_strings(strings: frozenset) -> Info:
    return Info(strings, strings, strings, True)


def loosen(x: Info) -> Info:
    """Forget the exact set but keep what it implies."""
    if x.exact is None:
        return x
    return Info(None, frozenset(s[:2] for s in x.exact), frozenset(s[-2:] for s in x.exact), any_of(x.exact))


def cross(a: frozenset, b: frozenset) -> frozenset | None:
    return frozenset(x + y for x, y in product(a, b)) if len(a) * len(b) <= MAX_STRINGS else None


def concat(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and (both := cross(a.exact, b.exact)) is not None:
        return of_strings(both)
    la, lb = loosen(a), loosen(b)
    border = cross(la.suffix, lb.prefix)
    prefix = cross(a.exact, lb.prefix) if a.exact is not None else la.prefix
    suffix = cross(la.suffix, b.exact) if b.exact is not None else lb.suffix
    return Info(None, prefix or la.prefix, suffix or lb.suffix, q_and(la.match, lb.match, any_of(border) if border else True))


def union(a: Info, b: Info) -> Info:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MAX_STRINGS:
        return of_strings(a.exact | b.exact)
    a, b = loosen(a), loosen(b)
    return Info(None, a.prefix | b.prefix, a.suffix | b.suffix, q_or(a.match, b.match))


def class_of(items: list) -> Info:
    chars: set = set()
    for op, arg in items:
        if op is sre_c.LITERAL:
            chars.add(chr(arg))
        elif op is sre_c.RANGE and arg[1] - arg[0] < MAX_CLASS:
            chars |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return UNKNOWN
    return of_strings(frozenset(map(fold, chars))) if len(chars) <= MAX_CLASS else UNKNOWN


def analyse(tree) -> Info:
    out = EMPTY
    for op, arg in tree:
        if op is sre_c.LITERAL:
            one = of_strings(frozenset([fold(chr(arg))]))
        elif op is sre_c.IN:
            one = class_of(arg)
        elif op is sre_c.SUBPATTERN:
            one = analyse(arg[-1])
        elif op is sre_c.BRANCH:
            one = None
            for branch in arg[1]:
                one = analyse(branch) if one is None else union(one, analyse(branch))
        elif op in (sre_c.MAX_REPEAT, sre_c.MIN_REPEAT, sre_c.POSSESSIVE_REPEAT):
            least, most, body = arg
            inner, one = analyse(body), EMPTY
            for _ in range(min(least, 8)):
                one = concat(one, inner)
            if least == 0 and most == 1:
                one = union(EMPTY, inner)
            elif most != least or least > 8:
                one = concat(one, UNKNOWN)
                if least:  # ends as the body ends
                    one = Info(None, one.prefix, loosen(inner).suffix, one.match)
        elif op in (sre_c.AT, sre_c.ASSERT, sre_c.ASSERT_NOT):
            one = EMPTY
        else:
            one = UNKNOWN
        out = concat(out, one)
    return out


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The Boolean query that each text with a match of ``pattern`` satisfies; True if none can be derived."""
    if flags & re.IGNORECASE and not flags & re.ASCII:
        return True  # letters outside ASCII may fold into it
    return loosen(analyse(sre_p.parse(pattern, flags))).match


def vocabulary(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(vocabulary, query[1]))


# ---- the index ----------------------------------------------------------------
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


class TrigramIndex:
    """Posting lists of a block of texts for the trigrams that some query can ask for."""

    def __init__(self, wanted: set[bytes]):
        self.ids = {t: i + 1 for i, t in enumerate(sorted(wanted))}
        self.slot = np.zeros(1 << 24, dtype=np.uint16 if len(wanted) < 65535 else np.uint32)
        for t, i in self.ids.items():
            self.slot[t[0] << 16 | t[1] << 8 | t[2]] = i
        self.postings: dict[int, np.ndarray] = {}
        self.n = 0

    def build(self, texts: list[bytes]) -> None:
        self.n, self.postings = len(texts), {}
        raw = FOLD[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
        if len(raw) < 3 or not self.ids:
            return
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        found = []
        for at in range(0, len(raw) - 2, 1 << 20):  # a window of codes at a time
            part = raw[at : at + (1 << 20) + 2].astype(np.int32)
            hit = self.slot[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            where = np.flatnonzero(hit)
            first = np.searchsorted(ends, where + at, side="right")
            last = np.searchsorted(ends, where + at + 2, side="right")
            keys = hit[where].astype(np.int64) * self.n + first
            found.append(np.unique(keys[first == last]))
        keys = np.unique(np.concatenate(found))
        slots, docs = np.divmod(keys, self.n)
        cuts = np.flatnonzero(np.diff(slots, prepend=-1))
        for a, b in pairwise([*cuts.tolist(), len(keys)]):
            self.postings[int(slots[a])] = docs[a:b]

    def ask(self, query: Query) -> np.ndarray:
        """Positions of the texts that satisfy ``query``, ascending."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings.get(self.ids[query], np.zeros(0, np.int64))
        parts = sorted(map(self.ask, query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def find_spans(texts: list, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text, (start, rule number, end) in code points, ascending."""
    return Scanner(rules)(texts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.index = TrigramIndex(set().union(*map(vocabulary, self.queries)))

    def __call__(self, texts: list) -> list[list[tuple[int, int, int]]]:
        texts = [t or "" for t in texts]
        self.index.build([t.encode("utf-8", "surrogatepass") for t in texts])
        out: list[list] = [[] for _ in texts]
        for k, rule in enumerate(self.rules):
            for i in self.index.ask(self.queries[k]).tolist():
                out[i] += [(m.start(), k, m.end()) for m in self.compiled[k].finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.min_len]
        for spans in out:
            spans.sort()
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: the id and ``found``, an array of (kind, start, end) by start."""

    def make():
        import pyarrow as pa

        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def work(texts: list) -> dict:
            return {"found": pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in spans] for spans in scanner(texts)], kind)}

        return work

    return map_texts(docs, id_col, text_col, "found array<struct<kind:string,start:bigint,end:bigint>>", make)


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Counts, base hash and span list of a result of ``scan``; built-in functions only."""
    kinds = [r.kind for r in base]
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    own = F.filter("found", lambda s: s.kind.isin(kinds))
    of = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(*(c for c in found.columns if c != "found"), *map(of, kinds), F.sha2(shown(own), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))


def redact_text(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """Replace the union of the spans; overlapping ones become one mark named after the first."""
    parts, at, last = [], 0, -1
    for start, k, end in spans:
        if start >= last:
            parts += [text[at:start], f"[{rules[k].kind.upper()}]"]
        at = last = max(last, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced by marks; all rows and columns stay, null texts too."""
    import pyarrow as pa

    def run(batches):
        from .common import slices

        scanner = Scanner(rules)
        for part, texts in slices(batches, text_col):
            new = [t if not s else redact_text(t, s, rules) for t, s in zip(texts, scanner(texts), strict=True)]
            yield part.set_column(part.schema.get_field_index(text_col), text_col, pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
