"""Language identification by a byte convolutional network.

A window of ``WINDOW`` lower-cased bytes goes through byte embeddings, filters of several widths, max pooling over the window
and softmax.  The network is trained in numpy by Adam on windows of a bounded sample: at most ``SAMPLE_DOCS``
documents a language (those with the smallest hashed ids), ``SAMPLE_WINDOWS`` windows of each.  Every byte of a
text then falls in a window; a document's probabilities are the mean over its windows, weighted by their bytes.

Prediction looks the first layer up: embedding and filter are folded into tables over byte pairs, so a window costs
a few table rows a byte.  Null texts and texts without a letter are ``und`` with score 0.  Languages are the labels
of the training rows; null labels and null texts are not learned from.  Without training rows all is ``und``.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm.common import map_texts

WINDOW = 192
EMBED = 8
FILTERS = 10  # of each width
WIDTHS = (2, 3, 4)
SAMPLE_DOCS = 500
SAMPLE_WINDOWS = 4
EPOCHS = 5
BATCH = 64
RATE = 0.01
SEED = 7
CHUNK = 256  # windows looked up at once
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's bytes in rows of WINDOW, padded by spaces, and the bytes in each row."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(data)] = data
    sizes = np.full(n, WINDOW)
    sizes[-1] = max(1, len(data) - (n - 1) * WINDOW)
    return out.reshape(n, WINDOW), sizes


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class ByteConvNet:
    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.p["bias"] = np.zeros(len(labels), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over windows ``x`` with label numbers ``y``."""
        p, n = self.p, len(x)
        embedded = p["emb"][x]
        pooled, tops = [], {}
        for w in WIDTHS:
            places = WINDOW - w + 1
            patches = np.concatenate([embedded[:, k : k + places] for k in range(w)], axis=2)
            z = patches @ p[f"w{w}"] + p[f"b{w}"]
            top = z.argmax(axis=1)  # only the place of the maximum gets a gradient
            tops[w] = (top, np.take_along_axis(patches, top[:, :, None], axis=1))
            pooled.append(np.maximum(np.take_along_axis(z, top[:, None, :], axis=1)[:, 0], 0))
        h = np.concatenate(pooled, axis=1)
        d = _softmax(h @ p["out"] + p["bias"])
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "bias": d.sum(axis=0), "emb": np.zeros_like(p["emb"])}
        dh = (d @ p["out"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            top, patch = tops[w]
            part = dh[:, i * FILTERS : (i + 1) * FILTERS]
            g[f"w{w}"] = np.einsum("nfd,nf->df", patch, part)
            g[f"b{w}"] = part.sum(axis=0)
            back = np.einsum("nf,df->nfd", part, p[f"w{w}"]).reshape(n, FILTERS, w, EMBED)
            for k in range(w):
                np.add.at(g["emb"], np.take_along_axis(x, top + k, axis=1), back[:, :, k])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                some = order[at : at + BATCH]
                step += 1
                for k, g in self.gradients(x[some], y[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def tables(self) -> list[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each width the tables to add up: (offset, rows by byte pair or by byte)."""
        out = []
        for w in WIDTHS:
            single = [self.p["emb"] @ self.p[f"w{w}"][k * EMBED : (k + 1) * EMBED] for k in range(w)]
            single[0] = single[0] + self.p[f"b{w}"]
            parts = []
            for k in range(0, w - 1, 2):
                parts.append((k, (single[k][:, None] + single[k + 1][None, :]).reshape(65536, FILTERS)))
            if w % 2:
                parts.append((w - 1, single[w - 1]))
            out.append((w, parts))
        return out

    def probabilities(self, x: np.ndarray, tables=None) -> np.ndarray:
        tables = tables or self.tables()
        out = []
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK]
            pairs = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            pooled = []
            for w, parts in tables:
                places = WINDOW - w + 1
                z = None
                for k, table in parts:
                    rows = table[(pairs if len(table) > 256 else part)[:, k : k + places]]
                    z = rows if z is None else np.add(z, rows, out=z)
                pooled.append(np.maximum(z.max(axis=1), 0))
            out.append(_softmax(np.concatenate(pooled, axis=1) @ self.p["out"] + self.p["bias"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_label: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """(label, window text) of a bounded sample: the ``docs_per_label`` smallest hashed ids of each label.

    One pass counts the labels, one reads the rows below a hash bound of twice that many a label.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(SEED)), F.lit(1 << 30))
    bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, 2 * docs_per_label / n + 20 / n) * (1 << 30)))) for k, n in sorted(counts.items())])
    size = F.length("text")
    starts = [F.greatest(F.lit(1), F.floor((size - WINDOW) * (i + 0.5) / SAMPLE_WINDOWS)).cast("int") for i in range(SAMPLE_WINDOWS)]
    picked = rows.withColumn("place", place).filter(F.col("place") <= bound)
    picked = picked.select("lang", "place", "id", F.array(*[F.substring("text", s, F.lit(WINDOW)) for s in starts]).alias("parts"))
    out = []
    sample = sorted(((r["lang"], r["place"], str(r["id"]), r["parts"]) for r in picked.limit(docs_per_label * 4 * len(counts)).collect()))
    taken: dict[str, int] = {}
    for label, _, _, parts in sample:
        if taken.get(label, 0) < docs_per_label:
            taken[label] = taken.get(label, 0) + 1
            out += [(label, part) for part in dict.fromkeys(parts) if _LETTER.search(part)]
    return out


def fit(sample: list[tuple[str, str]]) -> ByteConvNet | None:
    if not sample:
        return None
    labels = sorted({label for label, _ in sample})
    net = ByteConvNet(labels)
    x = np.concatenate([windows(part)[0][:1] for _, part in sample])
    y = np.array([labels.index(label) for label, _ in sample])
    net.train(x, y)
    return net


def predictor(net: ByteConvNet | None):
    """A function from texts to (label, score) pairs."""
    tables = net.tables() if net else None

    def run(texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        places = [i for i, t in enumerate(texts) if net and t and _LETTER.search(t)]
        at = 0
        while at < len(places):  # as many texts at once as fill some thousand windows
            cut, rows, sizes, some = 0, [], [], []
            while at < len(places) and cut < 16 * CHUNK:
                x, n = windows(texts[places[at]])
                rows.append(x)
                sizes.append(n)
                some.append(places[at])
                cut += len(x)
                at += 1
            weighted = net.probabilities(np.concatenate(rows), tables) * np.concatenate(sizes)[:, None]
            starts = np.cumsum([0, *map(len, sizes[:-1])])
            mean = np.add.reduceat(weighted, starts, axis=0) / np.add.reduceat(np.concatenate(sizes), starts)[:, None]
            for i, best, score in zip(some, mean.argmax(axis=1).tolist(), mean.max(axis=1).tolist()):
                out[i] = (net.labels[best], min(1.0, float(score)))
        return out

    return run


def train_on(docs: DataFrame, trained_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteConvNet | None:
    return fit(training_sample(docs.filter(trained_on), id_col, text_col, lang_col))


def predict(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; repeated rows give repeated rows."""

    def make():
        run = predictor(net)

        def rows(batch: dict) -> dict:
            out = run(batch["text"])
            return {"doc_id": batch["doc_id"], "lang_pred": [a for a, _ in out], "score": [b for _, b in out]}

        return rows

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, lang_pred string, score double")
