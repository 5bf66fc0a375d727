"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as hashed embeddings of itself and of its first letters beside
the last states of a bidirectional gated recurrent network over its characters.
A second such network runs over the words of a window; attention pools its states and a logistic unit scores
the window.  Every text is cut into overlapping windows that cover it whole,
and its score is that of its worst window.  All of it is trained in numpy, by
multiple-instance learning: the label of a text is learned at its worst window.

Character states and input projections depend on the word alone, so they are
kept for words met before, up to a bound.

Null texts and texts without letters score 0.  Repeated rows are answered row
by row; other columns are ignored; an empty table gives an empty result, and
with no labels of one kind every text scores 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, map_texts, slices, trim

WINDOW, STRIDE = 64, 32
HIDDEN = 8  # of either direction, over words and over characters
EMBED = 8  # of words and of characters
STEM, STEM_EMBED = 4, 4  # first letters of a word, embedded beside it
ATTEND = 8
LEXICAL = EMBED + STEM_EMBED
BUCKETS = 1 << 14
CODES = 512
#: Bounds of the training sample: texts of each label, and bytes of all of them.
SAMPLE_TEXTS = 1500
SAMPLE_BYTES = 32_000_000
#: Windows of a text that a step of the training looks at, at most; drawn anew each time.
DRAWN = 256
#: Windows scored at once.
SCORED = 2048
#: Bytes of text read at once and words remembered by the stage of a pipeline, whose workers serve other stages too.
SLICE, STAGE_WORDS = 1_000_000, 50_000
#: Score from which a text is toxic.
TOXIC = 0.3
#: An update gate this far open leaves the state as it is.
SHUT = np.float32(30)
f32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return f32(0.5) * (np.tanh(f32(0.5) * x) + f32(1))


def gru(x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time x batch x H) for projected inputs (time x batch x 3H: reset, update, candidate)."""
    h = np.zeros((x.shape[1], u.shape[0]), f32)
    out = np.empty((*x.shape[:2], u.shape[0]), f32)
    n = u.shape[0]
    for t in range(len(x)):
        a = h @ u
        gates = sigmoid(x[t, :, : 2 * n] + a[:, : 2 * n])
        r, z = gates[:, :n], gates[:, n:]
        c = np.tanh(x[t, :, 2 * n :] + r * a[:, 2 * n :])
        if keep is not None:
            keep.append((h, a, r, z, c))
        h = c + z * (h - c)
        out[t] = h
    return out


def gru_back(grad: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of ``u``, from those of the states."""
    n = u.shape[0]
    gx, gu = np.empty((*grad.shape[:2], 3 * n), f32), np.zeros_like(u)
    carry = np.zeros(grad.shape[1:], f32)
    for t in range(len(grad) - 1, -1, -1):
        h, a, r, z, c = kept[t]
        g = grad[t] + carry
        gc = g * (1 - z) * (1 - c * c)
        gr = gc * a[:, 2 * n :] * r * (1 - r)
        gz = g * (h - c) * z * (1 - z)
        gx[t] = np.concatenate([gr, gz, gc], axis=1)
        ga = np.concatenate([gr, gz, gc * r], axis=1)
        gu += h.T @ ga
        carry = g * z + ga @ u.T
    return gx, gu


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(f32)
        h, wide = HIDDEN, LEXICAL + 2 * HIDDEN
        p = {"code": make(CODES, EMBED), "word": make(BUCKETS, EMBED, scale=0.01), "stem": make(BUCKETS, STEM_EMBED, scale=0.01)}
        for way in "fb":
            p |= {f"cx{way}": make(EMBED, 3 * h), f"cb{way}": np.zeros(3 * h, f32), f"cu{way}": make(h, 3 * h), f"wx{way}": make(wide, 3 * h), f"wb{way}": np.zeros(3 * h, f32), f"wu{way}": make(h, 3 * h)}
        return cls(p | {"a": make(2 * h, ATTEND), "ab": np.zeros(ATTEND, f32), "v": make(ATTEND), "w": make(2 * h), "b": np.array([-1], f32)})


def spell(words: list[str]) -> np.ndarray:
    """Character codes (length x words, -1 behind the end)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % CODES
    codes = np.full((len(words), int(sizes.max())), -1, np.int64)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = flat
    return codes.T


def buckets_of(words: list[str]) -> np.ndarray:
    """Buckets of each word and of its first letters (2 x words)."""
    code = lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
    return np.array([[code(w) for w in words], [code(w[:STEM]) for w in words]], np.int64)


def lexical(p: dict, buckets: np.ndarray) -> np.ndarray:
    return np.concatenate([p["word"][buckets[0]], p["stem"][buckets[1]]], axis=1)


def _char_inputs(p: dict, codes: np.ndarray, way: str) -> np.ndarray:
    """Projected characters; behind a word's end the update gate is shut."""
    table = np.concatenate([p["code"] @ p[f"cx{way}"] + p[f"cb{way}"], np.zeros((1, 3 * HIDDEN), f32)])
    table[-1, HIDDEN : 2 * HIDDEN] = SHUT
    return table[codes if way == "f" else codes[::-1]]


def alike(words: list[str]) -> Iterator[list[int]]:
    """The places of words in groups of like length, shorter ones first."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        longest = max(len(words[order[at]]) + 2, 4)
        end = at
        while end < len(order) and end - at < 4096 and len(words[order[end]]) <= longest:
            end += 1
        yield order[at:end]
        at = end


def word_inputs(p: dict, words: list[str], buckets: np.ndarray | None = None) -> np.ndarray:
    """Embedding and character states of each word."""
    buckets = buckets_of(words) if buckets is None else buckets
    out = np.empty((len(words), LEXICAL + 2 * HIDDEN), f32)
    for which in alike(words):
        codes = spell([words[i] for i in which])
        out[which] = np.concatenate([lexical(p, buckets[:, which]), *(gru(_char_inputs(p, codes, way), p[f"cu{way}"])[-1] for way in "fb")], axis=1)
    return out


def pooled(p: dict, states: np.ndarray, pad: np.ndarray) -> tuple[np.ndarray, ...]:
    """Attention over time; returns tanh layer, weights and context."""
    t, b, h = states.shape
    hidden = np.tanh(states.reshape(t * b, h) @ p["a"] + p["ab"]).reshape(t, b, -1)
    score = np.where(pad, f32(-1e9), hidden @ p["v"])
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    return hidden, weight, np.einsum("tb,tbh->bh", weight, states)


def logits(p: dict, project: dict[str, np.ndarray], index: np.ndarray) -> np.ndarray:
    """Scores before the logistic function of windows of word rows (time x windows; row 0 pads)."""
    ways = [gru(project["f"][index], p["wuf"]), gru(project["b"][index[::-1]], p["wub"])[::-1]]
    _, _, context = pooled(p, np.concatenate(ways, axis=2), index == 0)
    return context @ p["w"] + p["b"]


def projections(p: dict, inputs: np.ndarray) -> dict[str, np.ndarray]:
    return {way: inputs @ p[f"wx{way}"] + p[f"wb{way}"] for way in "fb"}


def padding() -> np.ndarray:
    row = np.zeros((1, 3 * HIDDEN), f32)
    row[0, HIDDEN : 2 * HIDDEN] = SHUT
    return row


def normal(token: str) -> str:
    """A token's letters, in lower case."""
    low = token.lower()
    return low if low.isalpha() else "".join(filter(str.isalpha, low))


def windows(rows: list[np.ndarray], rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of texts' word rows (time x windows, 0 behind the end) and the text of each.

    With ``rng``, of a text with more than ``DRAWN`` windows that many from all over it.
    """
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE)), 0)
    many, total = (np.flatnonzero(count > DRAWN), count.copy()) if rng else ([], count)
    count = np.minimum(count, DRAWN) if rng else count
    owner = np.repeat(np.arange(len(rows)), count)
    first = np.cumsum(sizes) - sizes
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    for i in many:
        start[owner == i] = np.sort(rng.choice(total[i], DRAWN, replace=False)) * STRIDE
    flat = np.concatenate([*rows, np.zeros(1, np.int64)])
    at = start[None, :] + np.arange(WINDOW)[:, None]
    inside = at < sizes[owner]
    return np.where(inside, flat[np.where(inside, at + first[owner], len(flat) - 1)], 0), owner


class Words(dict):
    """Raw token -> row of its normal form; tokens without letters have row 0."""

    def __init__(self):
        self.rows: dict[str, int] = {"": 0}
        self.fresh: list[str] = []

    def __missing__(self, token: str) -> int:
        word = normal(token)
        row = self.rows.get(word)
        if row is None:
            self.rows[word] = row = len(self.rows)
            self.fresh.append(word)
        self[token] = row
        return row


class Scorer:
    def __init__(self, network: Network, capacity: int = 120_000):
        self.p, self.capacity = network.p, capacity
        self.clear()

    def clear(self) -> None:
        self.words = Words()
        self.project = {way: np.repeat(padding(), 1024, axis=0) for way in "fb"}
        self.used = 1

    def learn(self) -> None:
        fresh, self.words.fresh = self.words.fresh, []
        for a in range(0, len(fresh), 32768):
            new = projections(self.p, word_inputs(self.p, fresh[a : a + 32768]))
            n = len(new["f"])
            for way, table in self.project.items():
                if self.used + n > len(table):
                    table = np.concatenate([table, np.zeros((max(len(table), n), table.shape[1]), f32)])
                    self.project[way] = table
                table[self.used : self.used + n] = new[way]
            self.used += n

    def rows(self, texts: list) -> list[np.ndarray]:
        if len(self.words) > self.capacity:
            self.clear()
        out = [np.fromiter(map(self.words.__getitem__, w), np.int64, len(w)) for w in (t.split() if t else [] for t in texts)]
        if self.words.fresh:
            self.learn()
        return [r[r > 0] for r in out]

    def __call__(self, texts: list) -> np.ndarray:
        index, owner = windows(self.rows(texts))
        out = np.full(len(texts), -np.inf)
        for a in range(0, len(owner), SCORED):
            np.maximum.at(out, owner[a : a + SCORED], logits(self.p, self.project, index[:, a : a + SCORED]))
        return 1 / (1 + np.exp(-np.clip(out, -700, 700))) * np.isfinite(out)


def scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` (... x width) by row."""
    width = values.shape[-1]
    flat = rows.reshape(-1, 1) * width + np.arange(width)
    return np.bincount(flat.ravel(), weights=values.ravel(), minlength=n * width).reshape(n, width).astype(f32)


def _step(p: dict, words: list[str], index: np.ndarray, y: np.ndarray, rng: np.random.Generator, buckets: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss over windows of the rows 1... of ``words``."""
    buckets = buckets_of(words) if buckets is None else buckets
    shown = (rng.random((len(words), 1)) < 0.5).astype(f32)  # so that spelling alone must do, at times
    spelled, last = [], {way: np.empty((len(words), HIDDEN), f32) for way in "fb"}
    for which in alike(words):  # so that a long word doesn't pad the others
        codes, kept = spell([words[i] for i in which]), {"f": [], "b": []}
        for way in "fb":
            last[way][which] = gru(_char_inputs(p, codes, way), p[f"cu{way}"], kept[way])[-1]
        spelled.append((which, codes, kept))
    inputs = np.concatenate([lexical(p, buckets) * shown, last["f"], last["b"]], axis=1)
    project = {way: np.concatenate([padding(), x]) for way, x in projections(p, inputs).items()}
    deep: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([gru(project["f"][index], p["wuf"], deep["f"]), gru(project["b"][index[::-1]], p["wub"], deep["b"])[::-1]], axis=2)
    hidden, weight, context = pooled(p, states, index == 0)
    g = (sigmoid(context @ p["w"] + p["b"]) - y) / f32(len(y))
    grads = {"w": context.T @ g, "b": np.array([g.sum()], f32)}
    g_context = g[:, None] * p["w"]
    g_states = weight[:, :, None] * g_context
    g_weight = np.einsum("tbh,bh->tb", states, g_context)
    g_score = weight * (g_weight - (weight * g_weight).sum(axis=0))
    g_hidden = g_score[:, :, None] * p["v"] * (1 - hidden * hidden)
    flat = lambda x: x.reshape(-1, x.shape[-1])
    grads |= {"v": flat(hidden).T @ g_score.ravel(), "a": flat(states).T @ flat(g_hidden), "ab": flat(g_hidden).sum(0)}
    g_states = g_states + g_hidden @ p["a"].T
    g_inputs = np.zeros_like(inputs)
    for way in "fb":
        part = g_states[:, :, :HIDDEN] if way == "f" else g_states[::-1, :, HIDDEN:]
        gx, grads[f"wu{way}"] = gru_back(part, p[f"wu{way}"], deep[way])
        g_project = scatter(index if way == "f" else index[::-1], gx, len(project[way]))[1:]
        grads |= {f"wx{way}": inputs.T @ g_project, f"wb{way}": g_project.sum(0)}
        g_inputs += g_project @ p[f"wx{way}"].T
    for k, (name, part) in enumerate((("word", slice(0, EMBED)), ("stem", slice(EMBED, LEXICAL)))):
        grads[name] = scatter(buckets[k], g_inputs[:, part] * shown, len(p[name]))
    grads["code"] = np.zeros_like(p["code"])
    for i, way in enumerate("fb"):
        grads[f"cu{way}"], table = np.zeros_like(p[f"cu{way}"]), np.zeros((CODES, 3 * HIDDEN), f32)
        for which, codes, kept in spelled:
            g_last = np.zeros((*codes.shape, HIDDEN), f32)
            g_last[-1] = g_inputs[which, LEXICAL + i * HIDDEN : LEXICAL + (i + 1) * HIDDEN]
            gx, gu = gru_back(g_last, p[f"cu{way}"], kept[way])
            grads[f"cu{way}"] += gu
            table += scatter((codes if way == "f" else codes[::-1]) % (CODES + 1), gx, CODES + 1)[:-1]  # -1, behind a word's end, comes last
        grads["code"] += table @ p[f"cx{way}"].T
        grads |= {f"cx{way}": p["code"].T @ table, f"cb{way}": table.sum(0)}
    return grads


def lean(p: dict, rows: list[np.ndarray], y: list[int], buckets: np.ndarray) -> None:
    """Start the first embedding dimension of words and stems at how much more often texts of label 1 hold them, as a z score."""
    n = np.bincount(y, minlength=2)
    for name, own in zip(("word", "stem"), buckets, strict=True):
        held = np.zeros((2, BUCKETS))
        for r, k in zip(rows, y, strict=True):
            held[k, np.unique(own[r - 1])] += 1
        mean = held.sum(axis=0) / n.sum()
        z = (held[1] / n[1] - held[0] / n[0]) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / n[0] + 1 / n[1]))
        p[name][:, 0] = np.clip(z, -4, 8) / 4


def train(texts: list[str], labels: list[int], steps: int = 500, batch: int = 60, share: float = 0.2, warm: int = 200, rate: float = 0.01, seed: int = 5) -> Network | None:
    """Fit by Adam on batches with a fixed share of label 1; None unless both labels occur.

    The first ``warm`` steps take any window of a text, later ones its worst.
    """
    y_all = np.array(labels)
    kinds = [np.flatnonzero(y_all == k) for k in (0, 1)]
    if not all(map(len, kinds)):
        return None
    rng, net = np.random.default_rng(seed), Network.fresh()
    words, p = Words(), net.p
    rows = [np.array([r for r in map(words.__getitem__, t.split()) if r], np.int64) for t in texts]
    names = list(words.rows)
    kinds = [[i for i in k.tolist() if len(rows[i])] for k in kinds]
    if not all(kinds):
        return None
    buckets = buckets_of(names)
    lean(p, [rows[i] for k in kinds for i in k], [y for y, k in enumerate(kinds) for _ in k], buckets[:, 1:])
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = [k[i] for k, n in zip(kinds, (batch - round(batch * share), round(batch * share)), strict=True) for i in rng.integers(len(k), size=n)]
        index, owner = windows([rows[i] for i in chosen], rng)
        used, inverse = np.unique(np.concatenate([[0], index.ravel()]), return_inverse=True)
        local = inverse[1:].reshape(index.shape)
        if step <= warm:
            key = rng.random(len(owner))
        else:
            inputs = word_inputs(p, [names[i] for i in used[1:].tolist()], buckets[:, used[1:]])
            project = {way: np.concatenate([padding(), x]) for way, x in projections(p, inputs).items()}
            key = logits(p, project, local)
        best = np.lexsort((key, owner))[np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1)]
        index, y = index[:, best], y_all[chosen].astype(f32)[owner[best]]
        used, inverse = np.unique(np.concatenate([[0], index.ravel()]), return_inverse=True)
        grads = _step(p, [names[i] for i in used[1:].tolist()], inverse[1:].reshape(index.shape), y, rng, buckets[:, used[1:]])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g * f32(min(1.0, 5 / (size + 1e-9)))
            first[k] += f32(0.1) * (g - first[k])
            second[k] += f32(0.01) * (g * g - second[k])
            p[k] -= (f32(now) * (first[k] / f32(1 - 0.9**step)) / (np.sqrt(second[k] / f32(1 - 0.99**step)) + f32(1e-7))).astype(f32)
    return net


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, texts: int, max_bytes: int) -> list:
    """Rows (k, y, t) of whole texts of each label outside the held-out fold, one an id: ``texts`` and ``max_bytes`` at most."""
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).where(F.octet_length("t") > 0)
    named = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).where(~held_out("k") & F.col("y").isin(0, 1))
    named = named.join(docs.select(F.col(id_col).alias("k")), "k", "left_semi").groupBy("k").agg(F.max("y").alias("y"))
    drawn = {y: [r.k for r in bounded_sample(named.where(F.col("y") == y).select("k"), "k", texts + texts // 10 + 10)] for y in (0, 1)}
    schema = named.select("k", F.lit(0).alias("y")).schema
    own = lambda keys: rows.join(F.broadcast(docs.sparkSession.createDataFrame(keys, schema)), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    sizes = {r.k: r.n for r in own([(k, y) for y, keys in drawn.items() for k in keys]).select("k", F.octet_length("t").alias("n")).collect()}
    chosen = []
    for y, keys in drawn.items():
        # more ids are drawn than texts are learned, as some may have no text
        held = [k for k in keys if k in sizes][:texts]
        left = max_bytes
        for k in held:
            if sizes[k] <= left:
                left -= sizes[k]
                chosen.append((k, y))
    return sorted(own(chosen).collect(), key=lambda r: repr(r.k)) if chosen else []


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", texts: int = SAMPLE_TEXTS, max_bytes: int = SAMPLE_BYTES) -> Network | None:
    """Learn from at most ``texts`` texts of each label outside the held-out fold.

    Texts are learned whole; in the order of a hash, one that would bring those
    of its label beyond ``max_bytes`` is passed over.  An id labelled both ways
    counts as toxic; of rows that share an id, the least text is learned.
    """
    found = sample(docs, labels, id_col, text_col, label_col, texts, max_bytes)
    network = train([r.t for r in found], [r.y for r in found])
    del found
    trim()
    return network


def score(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and score."""

    def make():
        scorer = Scorer(network) if network else None

        def work(texts: list) -> dict:
            return {"score": np.zeros(len(texts)) if scorer is None else scorer(texts)}

        return work

    return map_texts(docs, id_col, text_col, "score double", make)


def keep(docs: DataFrame, network: Network | None, text_col: str = "text", threshold: float = TOXIC) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all columns."""

    def run(batches):
        scorer = Scorer(network, STAGE_WORDS) if network else None
        for part, texts in slices(batches, text_col, SLICE):
            yield part if scorer is None else part.filter(pa.array(scorer(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
