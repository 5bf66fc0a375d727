"""Language identification with a byte convolutional network.

Bytes are embedded; filters of several widths slide over a fixed-length window;
each filter's maximum over the window feeds a softmax.  The network is trained
in numpy on labelled text.  To score, every text is cut into windows of
``WINDOW`` bytes that cover it whole, windows of many texts are batched, and a
text's probabilities are its windows' mean, weighted by their bytes.  As a
filter is linear in one-hot bytes, scoring reads filter responses from tables
of single bytes and byte pairs.

Null texts and texts without a letter are ``und`` with score 0.  Repeated rows
are answered row by row, other columns are ignored, an empty table gives an
empty result, and with no labelled text every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, spread, trim

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Bounds of the training sample: texts, and bytes of a text; a longer one gives pieces from all over it.
SAMPLE_TEXTS = 3000
SAMPLE_BYTES = 20_000


@dataclass
class ByteCnn:
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED; byte 0 pads and embeds as zeros
    filters: list[np.ndarray]  # per width: (width * EMBED) x FILTERS
    bias: np.ndarray  # of all pooled filters
    out: np.ndarray  # pooled x labels
    out_bias: np.ndarray

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Per width, (offset, response by byte or by byte pair) whose sum is the filter."""
        found = []
        for width, w in zip(WIDTHS, self.filters, strict=True):
            single = [(self.embed @ w[j * EMBED : (j + 1) * EMBED]).astype(np.float32) for j in range(width)]
            parts = [(j, (single[j][:, None] + single[j + 1][None]).reshape(65536, -1)) for j in range(0, width - 1, 2)]
            if width % 2:
                parts.append((width - 1, single[-1]))
            found.append(parts)
        return found


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (rows padded with 0), the text that each belongs to, and its bytes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    count = -(-sizes // WINDOW)
    raw = np.frombuffer(b"".join(t + b"\0" * (-len(t) % WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return raw, owner, np.minimum(sizes[owner] - at * WINDOW, WINDOW)


class Scorer:
    def __init__(self, model: ByteCnn):
        self.model, self.parts = model, model.tables()

    def windows(self, raw: np.ndarray, step: int = 256) -> np.ndarray:
        """Label probabilities of each window."""
        out = np.empty((len(raw), len(self.model.labels)), np.float32)
        for a in range(0, len(raw), step):
            part = np.ascontiguousarray(raw[a : a + step].T)
            pairs = part[:-1].astype(np.int32) << 8 | part[1:]
            pooled = []
            for width, parts in zip(WIDTHS, self.parts, strict=True):
                n = WINDOW - width + 1
                total = None
                for offset, values in parts:
                    source = pairs if len(values) == 65536 else part
                    got = values.take(source[offset : offset + n], axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(total.max(axis=0))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.model.bias, 0)
            out[a : a + step] = softmax(hidden @ self.model.out + self.model.out_bias)
        return out

    def __call__(self, texts: list) -> tuple[list[str], list[float]]:
        live = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.model.labels else []
        best, score = ["und"] * len(texts), [0.0] * len(texts)
        if live:
            raw, owner, size = cut([texts[i].encode("utf-8", "surrogatepass") for i in live])
            p = self.windows(raw) * size[:, None]
            total = np.add.reduceat(p, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
            total /= total.sum(axis=1, keepdims=True)
            for i, k, s in zip(live, total.argmax(axis=1).tolist(), total.max(axis=1).tolist(), strict=True):
                best[i], score[i] = self.model.labels[k], min(1.0, s)
        return best, score


def train(texts: list[bytes], labels: list[str], steps: int = 400, batch: int = 192, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Fit by Adam on random windows; a quarter of them are short, as short texts are."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    n = FILTERS * len(WIDTHS)
    model = ByteCnn(names, f32(256, EMBED, scale=0.5), [f32(w * EMBED, FILTERS, scale=0.3) for w in WIDTHS], np.zeros(n, np.float32), f32(n, len(names), scale=0.2), np.zeros(len(names), np.float32))
    model.embed[0] = 0
    if not names:
        return model
    target = np.searchsorted(names, labels)
    by_label = [np.flatnonzero(target == k) for k in range(len(names))]
    params = [model.embed, *model.filters, model.bias, model.out, model.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(len(names), size=batch)
        raw = np.zeros((batch, WINDOW), np.uint8)
        for r, k in enumerate(y):
            t = texts[by_label[k][rng.integers(len(by_label[k]))]]
            size = WINDOW if rng.random() < 0.75 else int(rng.integers(4, WINDOW))
            a = int(rng.integers(max(1, len(t) - size + 1)))
            piece = t[a : a + size]
            raw[r, : len(piece)] = np.frombuffer(piece, np.uint8)
        e = model.embed[raw]
        pooled, where, patches = [], [], []
        for w, filt in zip(WIDTHS, model.filters, strict=True):
            patch = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            conv = patch.reshape(-1, w * EMBED) @ filt
            conv = conv.reshape(batch, -1, FILTERS)
            at = conv.argmax(axis=1)
            pooled.append(np.take_along_axis(conv, at[:, None], axis=1)[:, 0])
            where.append(at)
            patches.append(patch)
        pre = np.concatenate(pooled, axis=1) + model.bias
        hidden = np.maximum(pre, 0)
        g = softmax(hidden @ model.out + model.out_bias)
        g[np.arange(batch), y] -= 1
        g /= batch
        gh = (g @ model.out.T) * (pre > 0)
        grads = [np.zeros_like(model.embed), *(np.zeros_like(f) for f in model.filters), gh.sum(0), hidden.T @ g, g.sum(0)]
        rows = np.arange(batch)[:, None]
        for i, w in enumerate(WIDTHS):
            gp = gh[:, i * FILTERS : (i + 1) * FILTERS]
            taken = patches[i][rows, where[i]]  # batch x FILTERS x (w * EMBED)
            grads[1 + i] += np.einsum("bfp,bf->pf", taken, gp)
            back = gp[:, :, None] * model.filters[i].T[None]
            for j in range(w):
                np.add.at(grads[0], raw[rows, where[i] + j].ravel(), back[:, :, j * EMBED : (j + 1) * EMBED].reshape(-1, EMBED))
        grads[0][0] = 0
        now = rate * min(1, 2 * (1 - step / (steps + 1)))
        for p, gr, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (gr - m)
            v += 0.01 * (gr * gr - v)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return model


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, texts: int = SAMPLE_TEXTS, max_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[str]]:
    """Labelled texts outside the held-out fold, by a hash: of each language at most its even share of ``texts``.

    Labels are counted over all labelled rows, so a rare language is learned
    from a large table too.  Texts of any length take part, with ``max_bytes``
    bytes at most.
    """
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    rows = labelled.select(F.col(id_col).alias("k"), F.encode(text_col, "utf-8").alias("t"), F.col(lang_col).alias("l"))
    counts = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return [], []
    each, bits = max(1, texts // len(counts)), 1 << 30
    share = F.create_map(*(F.lit(x) for l, n in counts.items() for x in (l, min(bits, int(bits * (each + 4 * each**0.5) / n) + 1))))
    hashed = F.xxhash64("k", "t", "l")
    chosen = rows.withColumn("_hash", hashed).where(F.pmod("_hash", F.lit(bits)) < share[F.col("l")])
    found = chosen.withColumn("t", spread(F.col("t"), max_bytes, F.lit("\n").cast("binary"))).distinct().collect()
    by_label: dict[str, list] = {l: [] for l in sorted(counts)}
    for r in sorted(found, key=lambda r: (r["_hash"], *map(repr, r))):
        if len(by_label[r.l]) < each:
            by_label[r.l].append(bytes(r.t))
    return [t for own in by_label.values() for t in own], [l for l, own in by_label.items() for _ in own]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS) -> ByteCnn:
    model = train(*sample(docs, id_col, text_col, lang_col, texts))
    trim()
    return model


def predict(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, lang_pred and score."""

    def make():
        scorer = Scorer(model)

        def work(texts: list) -> dict:
            best, score = scorer(texts)
            return {"lang_pred": best, "score": score}

        return work

    return map_texts(docs, id_col, text_col, "lang_pred string, score double", make)


def keep(docs: DataFrame, model: ByteCnn, text_col: str = "text", languages: tuple[str, ...] | None = None, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text is in one of ``languages`` (default: any learned one) with ``min_score``.

    Rows that are ``und`` (null, empty or without a letter) go.  All columns stay.
    The largest of n languages' shares is 1 / n at least, so with four of them
    ``min_score`` rejects shares of 0.25 to 0.3 only: other languages are not told apart.
    """
    import pyarrow as pa

    def run(batches):
        from .common import slices

        scorer = Scorer(model)
        for part, texts in slices(batches, text_col, 1_000_000):
            best, score = scorer(texts)
            yield part.filter(pa.array([b != "und" and s >= min_score and (languages is None or b in languages) for b, s in zip(best, score, strict=True)]))

    return docs.mapInArrow(run, docs.schema)
