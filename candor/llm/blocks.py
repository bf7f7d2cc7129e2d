"""Byte n-grams of blocks of documents, for language models whose counts are joined by shard.

A block is some ``BLOCK_BYTES`` of documents of one partition.  One pass writes each block once, compressed, with the distinct
n-grams (and words) in it and how often they occur in its training documents.  Counts are summed and joined by
n-gram, so the model is spread over the cluster and never sent whole; a block gets the values of its own n-grams
only, and scores its documents with them.  Work and exchanges follow the input; memory follows a block and the longest
single text.

A document is its words in lower-cased ASCII, joined by spaces, and an end byte that no UTF-8 text holds; the
context before its first byte is made of end bytes.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from candor.llm.common import SLICE_BYTES, slices, stored

BLOCK_BYTES = 28 << 20
PACK_ROWS = 1 << 20  # answers that are compressed at once
END = 0xFF
GRAM, TOKEN, TEXTS = 0, 1, 2  # kinds of rows
END_TOKEN = b"\xff"
SCHEMA = "block long, kind int, code long, n long, texts binary"
PACKED = "block long, kind int, packed binary"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def codes(bodies: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each body, as big-endian numbers, and the bodies' first places."""
    pad = bytes([END]) * (n - 1)
    data = np.frombuffer(b"".join([pad + b for b in bodies]), np.uint8)
    kind = np.uint32 if n <= 4 else np.uint64
    out = np.zeros(len(data) - n + 1, kind)
    for k in range(n):
        out = (out << kind(8)) | data[k : k + len(out)]
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    starts = np.cumsum(sizes + n - 1) - sizes - (n - 1)  # where a body's first n-gram begins
    inside = np.ones(len(out), bool)
    for k in range(1, n):  # n-grams that end in the padding of the next body
        inside[starts[1:] - k] = False
    return out[inside], np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)


def token_code(token: bytes) -> int:
    value = xxhash.xxh64_intdigest(token)
    return value - (1 << 64) if value >> 63 else value


class Held:
    """A block while it grows: its texts, and the n-grams and words of each slice with their training counts."""

    def __init__(self, n: int, words: bool):
        self.n, self.words, self.size = n, words, 0
        self.payload: list[list] = []
        self.bodies: list[bytes] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.known: Counter = Counter()  # 0 for words of other documents only

    def add(self, texts: list, payload: list[list], learn: list[bool]) -> None:
        split = [tokens(t) for t in texts]
        bodies = [b" ".join(w) + END_TOKEN for w in split]
        self.payload = [a + b for a, b in zip(self.payload, payload)] if self.payload else payload
        self.bodies += bodies
        self.size += sum(map(len, bodies))
        own = [b for b, yes in zip(bodies, learn) if yes]
        other = [b for b, yes in zip(bodies, learn) if not yes]
        if own:
            self.parts.append(np.unique(codes(own, self.n)[0], return_counts=True))
        if other:
            asked = np.unique(codes(other, self.n)[0])
            self.parts.append((asked, np.zeros(len(asked), np.int64)))
        if self.words:
            for w, yes in zip(split, learn):
                if yes:
                    self.known.update(w)
                else:
                    self.known.update(dict.fromkeys(w, 0))
            self.known[END_TOKEN] += sum(learn)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams, in order, and their counts; the slices' own go."""
        every, counts = (np.concatenate(c) for c in zip(*self.parts))
        self.parts.clear()
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        return every[first].astype(np.int64), np.add.reduceat(counts[order], first)


def build(docs: DataFrame, n: int, payload: Sequence[str], trained: Callable[[dict], list[bool]], *, words: bool) -> DataFrame:
    """The stored table of blocks: rows of n-grams, of words (if asked) and of texts.

    ``docs`` has the columns ``text`` (or its Zstandard frames) and ``payload``; ``trained`` tells the training rows of a dict of columns.
    """
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    packed = dict(docs.dtypes)["text"] == "binary"

    def rows(block: int, held: Held) -> Iterator[pa.RecordBatch]:
        parts = [(GRAM, *held.grams())]
        if words:
            size = len(held.known)
            parts.append((TOKEN, np.fromiter(map(token_code, held.known), np.int64, size), np.fromiter(held.known.values(), np.int64, size)))
        for kind, code, times in parts:
            for at in range(0, len(code), 1 << 16):
                some = code[at : at + (1 << 16)]
                size = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, block)), pa.array(np.full(size, kind, np.int32)), pa.array(some), pa.array(times[at : at + size]), pa.nulls(size, pa.binary())], schema=arrow
                )
        texts = zstandard.ZstdCompressor(level=6).compress(pickle.dumps((held.payload, held.bodies)))
        yield pa.RecordBatch.from_pydict({"block": [block], "kind": [TEXTS], "code": [0], "n": [len(held.bodies)], "texts": [texts]}, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, press = TaskContext.get().partitionId() << 32, Held(n, words), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4 if packed else SLICE_BYTES):
                if part.num_rows:
                    columns = part.to_pydict()
                    if packed:
                        columns["text"] = [press.decompress(t).decode() for t in columns["text"]]
                    held.add(columns["text"], [columns[c] for c in payload], trained(columns))
                if held.size >= BLOCK_BYTES:
                    yield from rows(block, held)
                    block, held = block + 1, Held(n, words)
        if held.bodies:
            yield from rows(block, held)

    return stored(docs.select("text", *payload).mapInArrow(run, SCHEMA), "blocks")


def _narrow(column: np.ndarray) -> bytes:
    """Eight-byte numbers with their first bytes, their second bytes and so on side by side, which compress well."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(-1, 8).T).tobytes()


def _wide(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def packed(answers: DataFrame) -> DataFrame:
    """(block, kind, packed): the codes and values of ``answers`` as compressed arrays, some ``PACK_ROWS`` rows of a task at once."""
    arrow = to_arrow_schema(StructType.fromDDL(PACKED))

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=1)
        block, kind, code, value = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("block", "kind", "code", "value"))
        group, keys = pd.factorize(block * 2 + kind)  # kinds are GRAM and TOKEN
        order = np.argsort(group.astype(np.uint16 if len(keys) <= 1 << 16 else np.int64), kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=len(keys)))
        rows = []
        for key, at, to in zip(keys.tolist(), [0, *ends], ends):
            some = order[at:to]
            parts = _narrow(np.diff(code[some], prepend=np.int64(0))), _narrow(value[some])
            rows.append((key >> 1, key & 1, press.compress(b"".join(parts))))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PACK_ROWS:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return answers.select("block", "kind", "code", F.col("value").cast("double").alias("value")).mapInArrow(run, PACKED)


def unpacked(pieces: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All codes and values of packed pieces."""
    press, codes_, values = zstandard.ZstdDecompressor(), [np.zeros(0, np.int64)], [np.zeros(0)]
    for piece in pieces:
        data = press.decompress(piece)
        codes_.append(np.cumsum(_wide(data[: len(data) // 2], np.int64)))
        values.append(_wide(data[len(data) // 2 :], np.float64))
    return np.concatenate(codes_), np.concatenate(values)


def score(built: DataFrame, answers: DataFrame, n: int, fn: Callable, schema: str) -> DataFrame:
    """Score the documents of each block with its ``answers`` (block, kind, code, value).

    ``fn(payload lists, bodies, log10 probability of each body, {token code: value})`` gives a dict of columns.
    """
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(texts: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({c: [] for c in names})
        payload, bodies = pickle.loads(zstandard.ZstdDecompressor().decompress(texts["texts"].iloc[0]))
        known, logs = unpacked(values.loc[values["kind"] == GRAM, "packed"])
        known = pd.Index(known)
        totals, at = [], 0
        while at < len(bodies):  # a few megabytes at once
            some, size = at, 0
            while at < len(bodies) and (size < (2 << 20) or at == some):
                size += len(bodies[at])
                at += 1
            found, starts = codes(bodies[some:at], n)
            totals.append(np.add.reduceat(logs[known.get_indexer(found.astype(np.int64))], starts))
        told = unpacked(values.loc[values["kind"] == TOKEN, "packed"])
        return pd.DataFrame(fn(payload, bodies, np.concatenate(totals), dict(zip(*(c.tolist() for c in told)))), columns=names)

    texts = built.filter(F.col("kind") == TEXTS).select(F.col("block").alias("home"), "texts")
    return texts.groupBy("home").cogroup(packed(answers).groupBy("block")).applyInPandas(run, schema)
