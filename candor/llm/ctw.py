"""Context-tree weighting over bytes.

Each byte is eight binary decisions, each with its own tree over the ``DEPTH`` bytes before it.  A node's
Krichevsky-Trofimov estimate is mixed half and half with what its children predict, at all depths; with the counts of the training
documents given, the mixture's weights at a node follow in closed form, and so does the probability of every byte.
The tree's nodes come from counts of (DEPTH + 1)-grams, grouped by the two bytes before (at most 65,536 groups); the nodes of
depth 1 are summed by Spark, and only they and the root's 255 decisions (at most 256 x 255 rows) are combined in the driver.

The score of a document is the log10 probability of its words and its end, byte by byte (see ``blocks``).
Null text counts as empty (only the end); null ids count as the empty text where training rows are told; without training rows
every decision has probability one half.  Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candor.llm import blocks

DEPTH = 5
HALF = math.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving x up by seven."""
    y = x + 7.0
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    for i in range(7):
        out = out - np.log(x + i)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of the Krichevsky-Trofimov estimator of any sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


class Tree:
    """The nodes of depths 2 to ``DEPTH`` behind the same two bytes, from (DEPTH + 1)-grams and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        symbol = grams & 0xFF
        past = grams >> 8
        self.last = past & 0xFF
        contexts = [np.zeros_like(past)]  # of depth 2: all grams share the last two bytes
        for d in range(2, DEPTH):
            contexts.append((contexts[-1] << 8) | ((past >> (8 * d)) & 0xFF))
        self.bits = np.stack([(symbol >> (7 - j)) & 1 for j in range(8)], axis=1)
        self.nodes = np.stack([(1 << j) | (symbol >> (8 - j)) for j in range(8)], axis=1)
        weights = np.repeat(counts[:, None], 8, axis=1).ravel().astype(float)
        self.where, self.zeros, self.ones, keys = [], [], [], []
        for context in contexts:
            key, place = np.unique(((context[:, None] << 8) | self.nodes).ravel(), return_inverse=True)
            keys.append(key)
            self.where.append(place.reshape(-1, 8))
            self.ones.append(np.bincount(place, weights * self.bits.ravel(), len(key)))
            self.zeros.append(np.bincount(place, weights, len(key)) - self.ones[-1])
        self.first_nodes = keys[0]
        self.mixed = [None] * len(keys)
        self.weight = [None] * len(keys)
        for d in reversed(range(len(keys))):
            own = log_kt(self.zeros[d], self.ones[d])
            if d == len(keys) - 1:
                self.mixed[d], self.weight[d] = own, np.ones(len(own))
                continue
            parent = ((keys[d + 1] >> 16) << 8) | (keys[d + 1] & 0xFF)
            below = np.bincount(np.searchsorted(keys[d], parent), self.mixed[d + 1], len(keys[d]))
            self.mixed[d] = np.logaddexp(HALF + own, HALF + below)
            self.weight[d] = np.exp(HALF + own - self.mixed[d])

    def log10(self, upper: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log10 probability of each gram's byte; ``upper`` has weights and probabilities of a one, of the root by node and of
        depth 1 by byte and node."""
        p, rest = 0.0, 1.0
        for at, (weight, one) in zip((self.nodes, (self.last[:, None], self.nodes)), upper):
            p = p + rest * weight[at] * np.where(self.bits == 1, one[at], 1 - one[at])
            rest = rest * (1 - weight[at])
        for d in range(len(self.where)):
            at = self.where[d]
            hit = np.where(self.bits == 1, self.ones[d][at], self.zeros[d][at])
            estimate = (hit + 0.5) / (self.zeros[d][at] + self.ones[d][at] + 1)
            p = p + rest * self.weight[d][at] * estimate
            rest = rest * (1 - self.weight[d][at])
        return np.log10(p).sum(axis=1)


def upper_nodes(rows: list[tuple[int, int, float, float, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and probabilities of a one of the root's 255 decisions and of those of depth 1, from the latter's (byte, node,
    zeros, ones, log mixture below)."""
    zeros, ones, below = np.zeros((3, 256, 256))
    for byte, node, z, o, m in rows:
        zeros[byte, node], ones[byte, node], below[byte, node] = z, o, m
    out = []
    for _ in range(2):
        own = log_kt(zeros, ones)
        mixed = np.logaddexp(HALF + own, HALF + below)
        out.append((np.exp(HALF + own - mixed), (ones + 0.5) / (zeros + ones + 1)))
        if zeros.ndim > 1:
            zeros, ones, below = zeros.sum(axis=0), ones.sum(axis=0), mixed.sum(axis=0)  # a node never seen has log mixture 0
    return out[::-1]


def byte_scores(totals: DataFrame) -> DataFrame:
    """(code, value): log10 probability of the last byte of every gram (code, n), n training occurrences."""

    def first(part: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(part["code"].to_numpy(), part["n"].to_numpy())
        return pd.DataFrame({"last": tree.last[0], "node": tree.first_nodes, "zeros": tree.zeros[0], "ones": tree.ones[0], "mixed": tree.mixed[0]})

    before = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF))
    grouped = totals.groupBy(before.alias("before"))
    nodes = grouped.applyInPandas(first, "last long, node long, zeros double, ones double, mixed double")
    decisions = nodes.groupBy("last", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("mixed"))
    upper = upper_nodes([tuple(r) for r in decisions.collect()])  # 256 x 255 rows at most

    def second(part: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(part["code"].to_numpy(), part["n"].to_numpy())
        return pd.DataFrame({"code": part["code"], "value": tree.log10(upper)})

    return grouped.applyInPandas(second, "code long, value double")


def _held_out(ids: list) -> list[bool]:
    return [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i in ids]


SCHEMA = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, bits_per_byte double"
)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; learns from those whose id's CRC-32 leaves another remainder than 1 modulo 5."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    built = blocks.build(rows, DEPTH + 1, ["doc_id"], lambda c: [not h for h in _held_out(c["doc_id"])], words=True)
    grams = built.filter(F.col("kind") == blocks.GRAM).select("block", "code", "n")
    words = built.filter(F.col("kind") == blocks.TOKEN).select("block", "code", "n")
    values = byte_scores(grams.groupBy("code").agg(F.sum("n").alias("n")))
    answers = grams.select("block", "code").join(values, "code").select("block", F.lit(blocks.GRAM).alias("kind"), "code", "value")
    # One exchange of the words serves their counts and the size of the vocabulary.
    code = Window.partitionBy("code")
    counted = words.withColumn("c", F.sum("n").over(code)).withColumn("first", F.row_number().over(code.orderBy("block")) == 1)
    answers = answers.unionByName(counted.select("block", F.lit(blocks.TOKEN).alias("kind"), "code", F.col("c").cast("double").alias("value")))
    whole = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"), F.count(F.when(F.col("first") & (F.col("c") > 0), 1)).alias("_v"))

    def told(payload, bodies, logs, counts) -> dict:
        worth: dict[bytes, tuple[float, int]] = {}
        out = {"n_tokens": [], "n_known": [], "base_score": []}
        for body in bodies:
            split = [*body[:-1].split(), blocks.END_TOKEN]
            score, known = 0.0, 0
            for w in split:
                if (x := worth.get(w)) is None:
                    c = counts[blocks.token_code(w)]
                    x = worth[w] = (math.log10(c + 0.5), int(c > 0))
                score += x[0]
                known += x[1]
            out["n_tokens"].append(len(split))
            out["n_known"].append(known)
            out["base_score"].append(score)
        sizes = np.array([len(b) for b in bodies])
        return {
            "doc_id": pd.array(payload[0], "Int64"), "held_out": _held_out(payload[0]), **out, "score": logs,
            "n_bytes": sizes, "bits_per_byte": -logs * math.log2(10) / sizes,
        }

    out = blocks.score(built, answers, DEPTH + 1, told, SCHEMA).crossJoin(F.broadcast(whole))  # one row
    share = F.log10(F.col("train_tokens") + 0.5 * (F.col("_v") + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", (F.col("base_score") - F.col("n_tokens") * share).alias("base_score"),
        "score", "n_bytes", "bits_per_byte",
    )
