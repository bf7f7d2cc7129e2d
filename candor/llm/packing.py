"""Packing documents into training sequences with the help of lexical retrieval.

Documents are tokenised once into a table of ids in the shared folder; document frequencies of all token ids come
from one pass over it (bounded by the vocabulary).  Tails are ordered by content: by the ids that are smallest under
``ROUTES`` random orders in which rare ids come early (weighted minhash), so that near copies and tails sharing rare words
lie together wherever the input had them; a route that many share is ordered by the next, and by a hash of the document's
id at last.  Shards are runs of ``SHARD`` tails in that order.  Each holds a BM25 inverted index over the tails; the longest unused tail is the seed of a sequence, its unused neighbours by score
fill the window whole where they fit, and the best remaining one is cut at its end, so that only a shard's last sequence
is short.  That one is dealt into sequences whose lengths are powers of two, which need no padding.  Documents
longer than a window give full sequences first; the index holds what is left over.

Null text counts as empty (only the closing id); null ids stay; repeated rows are packed as rows of their own; other
columns are ignored.  Sequences do not follow the order of the input.  Memory follows a shard, a vocabulary and the longest single document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from os.path import commonprefix

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from candor.llm.common import map_texts, stored

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WINDOW = 2048
CLOSING = 1
SHARD = 256
ROUTES = 3
RARE = 2.0  # power of the IDF that draws an id to the front of a route's order
K1, B = 1.2, 0.75
CACHE = 300_000  # words whose ids a worker remembers

# White space that Python and the tokenizer may see differently: such texts go to the tokenizer whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
# Bytes of which one is in every text that _ODD_SPACE matches: looking for them is much faster than matching.
_ODD_MARKS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1", b"\xe2", b"\xe3", b"\xef")
_ODD_ASCII = "\x1c\x1d\x1e\x1f"
_PLAIN = re.compile("[\x21-\x7eÀ-įĲ-ɏ]+")
# The vocabulary's own pre-tokens, for words of plain letters.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


def has_odd_space(text: str) -> bool:
    if text.isascii():
        return any(mark in text for mark in _ODD_ASCII)
    data = text.encode()
    return any(mark in data for mark in _ODD_MARKS) and _ODD_SPACE.search(text) is not None


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: printable ones as themselves, the rest as letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


@cache
def encoder(path: str = VOCABULARY) -> tuple[Callable[[str], bytes], np.dtype]:
    """A function from a text to its ids as little-endian bytes, closing id included, and their type.

    A text that holds a special token's string is left to the tokenizer, which gives that token's id there.  Otherwise
    the vocabulary never joins across white space, so each word is encoded once and remembered, by a worker for all its tasks.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    mark = commonprefix(special)  # one search tells most texts apart
    size = max(tokenizer.get_vocab().values()) + 1
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    width, model, letters = kind.itemsize, tokenizer.model, _byte_letters()
    closing = CLOSING.to_bytes(width, "little")
    pieces: dict[str, bytes] = {}
    words: dict[str, bytes] = {}

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes()

    def piece(text: str) -> bytes:
        found = pieces.get(text)
        if found is None:
            if len(pieces) > CACHE:
                pieces.clear()
            written = text if text.isascii() else text.encode().decode("latin-1").translate(letters)
            found = pieces[text] = b"".join(t.id.to_bytes(width, "little") for t in model.tokenize(written))
        return found

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            if len(self) > CACHE:
                self.clear()
            found = self[word] = b"".join(map(piece, _PIECE.findall(word.lower()))) if _PLAIN.fullmatch(word) else whole(word)
            return found

    words = Words()

    def encode(text: str) -> bytes:
        if (special and mark in text and any(s in text for s in special)) or has_odd_space(text):
            return whole(text) + closing
        return b"".join(map(words.__getitem__, text.split())) + closing

    return encode, kind


def _vocabulary(path: str) -> tuple[int, np.dtype]:
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size() + 1
    return size, np.dtype("<u2" if size <= 1 << 16 else "<u4")


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the document's ids and the closing id as little-endian bytes."""

    def make():
        encode, _ = encoder(path)
        return lambda rows: {"doc_id": rows["doc_id"], "ids": [encode(t or "") for t in rows["text"]]}

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, ids binary")


def _distinct(parts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (unit, token) pairs, with their counts, ordered by token."""
    units = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    tokens = np.concatenate(parts).astype(np.int64)
    keys, counts = np.unique(tokens * len(parts) + units, return_counts=True)
    return keys % len(parts), keys // len(parts), counts


def document_frequencies(tokens: DataFrame, path: str = VOCABULARY) -> tuple[np.ndarray, int, float]:
    """Documents each id occurs in, documents, and ids a document, over all rows."""
    size, kind = _vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows, ids = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            parts = [np.frombuffer(b, kind) for b in batch.column("ids").to_pylist()]
            for at in range(0, len(parts), 512):
                counts += np.bincount(_distinct(parts[at : at + 512], size)[1], minlength=size)
            rows += len(parts)
            ids += sum(map(len, parts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"token": np.concatenate((seen, [-1, -2])), "n": np.concatenate((counts[seen], [rows, ids]))})

    sums = {r["token"]: r["n"] for r in tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    frequencies = np.zeros(size, np.int64)
    for token, n in sums.items():
        if token >= 0:
            frequencies[token] = n
    return frequencies, sums.get(-1, 0), sums.get(-2, 0) / max(1, sums.get(-1, 0))


def orders(frequencies: np.ndarray, idf: np.ndarray, routes: int = ROUTES) -> np.ndarray:
    """The place of each id in each of the random orders; ids that nothing shares, or that say nothing, come last, as one."""
    useful = (frequencies > 1) & (idf > 0)
    out = np.full((routes, len(idf)), len(idf), np.int32)
    for k in range(routes):
        early = np.random.default_rng(k).exponential(size=len(idf))[useful] / idf[useful] ** RARE
        out[k, np.flatnonzero(useful)[np.argsort(early, kind="stable")]] = np.arange(useful.sum())
    return out


def routed(tokens: DataFrame, places: np.ndarray, kind: np.dtype, window: int, partitions: int) -> DataFrame:
    """``tokens`` dealt to partitions, and ordered there, so that lexical neighbours lie together."""
    names = [f"r{k}" for k in range(len(places))]
    schema = ", ".join(["doc_id long, ids binary", *(f"{r} int" for r in names), "tie long, row long"])
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(b, kind) for b in batch.column("ids").to_pylist()]
            tails = [p[len(p) // window * window :] for p in parts]
            filled = np.flatnonzero([len(t) > 0 for t in tails])
            found = np.full((len(places), len(parts)), places.shape[1], np.int32)
            if len(filled):
                ids = np.concatenate([tails[i] for i in filled])
                starts = np.cumsum([0, *(len(tails[i]) for i in filled[:-1])])
                found[:, filled] = [np.minimum.reduceat(p[ids], starts) for p in places]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), *map(pa.array, found), batch.column("tie"), batch.column("row")], schema=arrow)

    # The place in the table tells apart only rows of the same id and routes.
    keyed = tokens.select("doc_id", "ids", F.xxhash64("doc_id").alias("tie"), F.monotonically_increasing_id().alias("row"))
    by = [*names, "tie", "row"]
    return keyed.mapInArrow(run, schema).repartitionByRange(partitions, *by).sortWithinPartitions(*by).select("doc_id", "ids")


class Index:
    """BM25 postings of a shard, by token."""

    def __init__(self, parts: list[np.ndarray], idf: np.ndarray, mean_length: float):
        units, tokens, counts = _distinct(parts, len(idf))
        useful = idf[tokens] > 0
        units, tokens, counts = units[useful], tokens[useful], counts[useful]
        lengths = np.array([len(p) for p in parts])
        norm = K1 * (1 - B + B * lengths[units] / mean_length)
        self.units, self.n = units, len(parts)
        self.weights = idf[tokens] * counts * (K1 + 1) / (counts + norm)
        self.tokens, self.starts, self.sizes = np.unique(tokens, return_index=True, return_counts=True)
        by_unit = np.argsort(units, kind="stable")
        places = np.searchsorted(self.tokens, tokens[by_unit])
        self.of = np.split(places, np.cumsum(np.bincount(units, minlength=self.n))[:-1])

    def scores(self, unit: int) -> np.ndarray:
        """Of all units for the distinct tokens of ``unit``."""
        asked = self.of[unit]
        sizes = self.sizes[asked]
        ends = np.cumsum(sizes)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[asked] - (ends - sizes), sizes)
        return np.bincount(self.units[rows], weights=self.weights[rows], minlength=self.n)


Piece = tuple[int, int, int]  # unit, first id, ids


def fill(parts: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[list[Piece]]:
    """Sequences of pieces; every id of every unit is in exactly one, and all but the last hold ``window`` ids."""
    index = Index(parts, idf, mean_length)
    left = [len(p) for p in parts]
    start = [0] * len(parts)
    unused = np.ones(len(parts), bool)
    out: list[list[Piece]] = []
    for seed in sorted(range(len(parts)), key=lambda u: (-len(parts[u]), u)):
        if not unused[seed]:
            continue
        unused[seed] = False
        pieces, room = [(seed, start[seed], left[seed])], window - left[seed]
        if room and unused.any():
            others = np.flatnonzero(unused)
            ranked = others[np.argsort(-index.scores(seed)[others], kind="stable")].tolist()
            for u in ranked:
                if left[u] <= room:
                    pieces.append((u, start[u], left[u]))
                    room -= left[u]
                    unused[u] = False
                    if not room:
                        break
            if room and (u := next((u for u in ranked if unused[u]), None)) is not None:
                pieces.append((u, start[u], room))
                start[u] += room
                left[u] -= room
        out.append(pieces)
    return out


def powers_of_two(pieces: list[Piece], window: int = WINDOW) -> list[list[Piece]]:
    """A short sequence dealt into ones whose lengths are powers of two; a full one as it is."""
    total = sum(n for _, _, n in pieces)
    if total == window:
        return [pieces]
    out, rest = [], list(pieces)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            part, room = [], 1 << bit
            while room:
                u, start, n = rest.pop(0)
                part.append((u, start, min(n, room)))
                if n > room:
                    rest.insert(0, (u, start + room, n - room))
                room -= min(n, room)
            out.append(part)
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str = VOCABULARY, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """One row per piece.  A sequence is the pieces of a sequence_id in order of offset."""
    tokens = stored(tokenised(docs, id_col, text_col, path), "tokens")
    frequencies, n, mean_length = document_frequencies(tokens, path)
    idf = np.maximum(0.0, np.log((n - frequencies + 0.5) / (frequencies + 0.5)))
    kind = _vocabulary(path)[1]
    partitions = max(1, min(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (4 * shard)))  # of several shards each
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []  # of the shard's documents
        names: list[int | None] = []
        tails: list[tuple[int, int]] = []  # (document, first id)
        rows: list[tuple] = []

        def put(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            offset = 0
            for d, start, length in pieces:
                rows.append((names[d], start, length, zlib.crc32(ids[d][start : start + length].astype("<u4").tobytes()), len(ids[d]), sequence, offset))
                offset += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            if tails:
                for pieces in fill([ids[d][at:] for d, at in tails], idf, mean_length, window):
                    for part in powers_of_two([(tails[u][0], tails[u][1] + start, n) for u, start, n in pieces], window):
                        put(part)
            columns = list(zip(*rows)) or [()] * len(arrow)
            for x in (ids, names, tails, rows):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for name, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                ids.append(np.frombuffer(data, kind))
                names.append(name)
                full = len(ids[-1]) // window * window
                for start in range(0, full, window):
                    put([(len(ids) - 1, start, window)])
                if len(ids[-1]) > full:
                    tails.append((len(ids) - 1, full))
                if len(tails) >= shard:
                    yield flush()
        yield flush()

    return routed(tokens, orders(frequencies, idf), kind, window, partitions).mapInArrow(run, SCHEMA)
