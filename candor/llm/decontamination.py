"""Benchmark decontamination by Wu-Manber search (Wu and Manber 1994) for all word windows of the items at once.

The search alphabet is words, and a block is two of them.  All windows of one table have equal length m, so that

* the shift table gives, for the hash of the block that ends at a position, how far the search may move without missing a
  window (m - 1 if no window holds the block).  Positions in between are never looked at;
* where the shift is zero, the bucket of the block's hash holds the windows that end with it, ordered by the hash of their
  first block;
* windows of that bucket with an equal first block are compared word by word, so hash collisions never show.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one window, searched with the
table of its own length.  The documents of a slice are searched as one sequence, in lanes that move side by side.

Items come in blocks of about ``BLOCK_BYTES`` (long items are cut between windows), and each block is searched in a pass of
its own over all documents, so that neither the driver nor a task holds more than one block.

Null text has no words: ``n_words`` is 0 and nothing is hit; items without words have no windows.  A null item id is named by the
empty text.  Items with one id count as one.  Null ids and repeated rows stay as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import SLICE_BYTES, map_texts, stored

WINDOW = 10
BLOCK = 2  # words
BLOCK_BYTES = 4 << 20
PIECE = 1_000  # windows of an item that stay together
LANES = 4096
LEAST_LANE = 64  # positions
CANDIDATES = 1 << 16  # compared at once

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

SCHEMA = "doc_id long, n_words long, hit_spans array<struct<start:long,end:long>>, items array<string>"


def parts_of(data: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """``data`` cut at blanks into parts of about ``size``."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + size) if at + size < len(data) else -1
        yield data[at : end if end >= 0 else len(data)]
        at = end if end >= 0 else len(data)


def words_of(text: str | None) -> Iterator[bytes]:
    return chain.from_iterable(part.split() for part in parts_of((text or "").encode().translate(_FOLD)))


def _hash(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)) >> np.uint64(32)


class Table:
    """Shift table and suffix buckets of the distinct windows of ``m`` words; ``owner`` has the items of each."""

    def __init__(self, windows: np.ndarray, items: np.ndarray):
        self.m = windows.shape[1]
        self.block = min(BLOCK, self.m)
        windows, which = np.unique(windows, axis=0, return_inverse=True)
        n = len(windows)
        self.mask = np.uint64((1 << max(12, int(4 * n * self.m).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, self.m - self.block + 1, np.int64)
        for end in range(self.block - 1, self.m):
            slots = (_hash(windows[:, end - self.block + 1], windows[:, end]) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, slots, self.m - 1 - end)
        keys = self._keys(windows[:, -self.block], windows[:, -1], windows[:, 0], windows[:, self.block - 1])
        order = np.argsort(keys, kind="stable")
        self.keys, self.windows = keys[order], windows[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        pairs = np.unique(np.stack([place[which.reshape(-1)], items]), axis=1)
        self.owner = pairs[1]
        self.first = np.searchsorted(pairs[0], np.arange(n + 1))

    def _keys(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Bucket of the last block, then the hash of the first one."""
        return ((_hash(a, b) & self.mask) << np.uint64(32)) | _hash(c, d)

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Last positions of possible windows, found by moving along with the shift table."""
        first, n = self.m - 1, len(ids)
        if n <= first:
            return np.empty(0, np.int64)
        lanes = max(1, min(LANES, (n - first) // LEAST_LANE))
        bounds = np.linspace(first, n, lanes + 1).astype(np.int64)
        at, stop, found = bounds[:-1], bounds[1:], []
        while len(at):
            step = self.shift[(_hash(ids[at - self.block + 1], ids[at]) & self.mask).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            inside = at < stop
            at, stop = at[inside], stop[inside]
        return np.concatenate(found)

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first positions, windows) of all occurrences in ``ids``."""
        start = self.candidates(ids) - self.m + 1
        key = self._keys(ids[start + self.m - self.block], ids[start + self.m - 1], ids[start], ids[start + self.block - 1])
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        start, low, high = start[low < high], low[low < high], high[low < high]
        places, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(start):  # the k-th window of every bucket, then the next
            for some in range(0, len(start), CANDIDATES):
                s, w = start[some : some + CANDIDATES], low[some : some + CANDIDATES]
                same = (ids[s[:, None] + np.arange(self.m)] == self.windows[w]).all(axis=1)
                places.append(s[same])
                windows.append(w[same])
            low = low + 1
            start, low, high = start[low < high], low[low < high], high[low < high]
        return np.concatenate(places), np.concatenate(windows)


class Patterns:
    """The windows of a block of items, by window length."""

    def __init__(self, pieces: list[tuple[str, str]], window: int = WINDOW):
        self.codes: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in pieces})
        number = {item: i for i, item in enumerate(self.items)}
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in pieces:
            ids = np.array([self.codes.setdefault(w, len(self.codes) + 1) for w in text.encode().split()], np.int32)
            if len(ids):
                m = min(window, len(ids))
                by_length.setdefault(m, []).append((np.lib.stride_tricks.sliding_window_view(ids, m), number[item]))
        self.tables = [
            Table(np.concatenate([w for w, _ in some]), np.concatenate([np.full(len(w), i) for w, i in some]))
            for _, some in sorted(by_length.items())
        ]

    def search(self, texts: list[str | None]) -> dict[str, list]:
        """``n_words``, ``hit_spans`` and ``items`` of each text."""
        gap = np.zeros(1, np.int32)  # no window holds a zero, so none reaches over two texts
        found = [np.fromiter(map(self.codes.get, words_of(t), repeat(0)), np.int32) for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        ids = np.concatenate([x for f in found for x in (f, gap)])
        change = np.zeros(len(ids) + 1, np.int64)
        owned = [np.empty((2, 0), np.int64)]
        for table in self.tables:
            at, window = table.occurrences(ids)
            np.add.at(change, at, 1)
            np.add.at(change, at + table.m, -1)
            pairs = np.unique(np.stack([np.searchsorted(begins, at, "right") - 1, window]), axis=1)
            counts = table.first[pairs[1] + 1] - table.first[pairs[1]]
            ends = np.cumsum(counts)
            places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(table.first[pairs[1]] - (ends - counts), counts)
            owned.append(np.stack([np.repeat(pairs[0], counts), table.owner[places]]))
        hit = np.diff(np.concatenate(([0], np.cumsum(change[:-1]) > 0, [0])).astype(np.int8))
        spans: list[list] = [[] for _ in texts]
        for a, b in zip(np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)):
            text = int(np.searchsorted(begins, a, "right") - 1)
            spans[text].append({"start": int(a - begins[text]), "end": int(b - begins[text])})
        items: list[list] = [[] for _ in texts]
        for text, item in np.unique(np.concatenate(owned, axis=1), axis=1).T.tolist():
            items[text].append(self.items[item])  # numbered in order of their text
        return {"n_words": sizes.tolist(), "hit_spans": spans, "items": items}


def item_pieces(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words, size): items as words joined by blanks, long ones cut so that every window is in one piece."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    cuts = F.sequence(F.lit(0), F.greatest(F.size("_words") - window, F.lit(0)), F.lit(PIECE))
    return (
        items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("_words"))
        .filter(F.size("_words") > 0)
        .withColumn("_at", F.explode(cuts))
        .select("item", F.array_join(F.slice("_words", F.col("_at") + 1, F.lit(PIECE + window - 1)), " ").alias("words"))
        .withColumn("size", F.octet_length("words"))
    )


def _scan(docs: DataFrame, patterns: Patterns) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(patterns)
    rest = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    schema = ", ".join([SCHEMA, *[f"{f.name} {f.dataType.simpleString()}" for f in rest]])

    def make():
        search = sent.value.search
        return lambda rows: {k: v for k, v in rows.items() if k != "text"} | search(rows["text"])

    return map_texts(docs, make, schema)


def _merged(passes: list[DataFrame]) -> DataFrame:
    """One row for each document and copy of it: the union of what the passes hit."""
    rows = passes[0].withColumn("_pass", F.lit(0))
    for k, one in enumerate(passes[1:], start=1):
        rows = rows.unionByName(one.withColumn("_pass", F.lit(k)))
    found = rows.groupBy("doc_id", "_print").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(F.col("_pass") == 0, 1)).alias("_copies"),
        F.collect_set(F.struct("_pass", "hit_spans", "items")).alias("_found"),
    )  # equal rows hit alike, so a set holds one entry a pass

    def merge(spans: list[dict]) -> list[dict]:
        out: list[dict] = []
        for s in sorted(spans, key=lambda s: s["start"]):
            if out and s["start"] <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], s["end"])
            else:
                out.append(dict(s))
        return out

    def make():
        def run(cols: dict) -> dict:
            flat = [[s for f in found for s in f["hit_spans"]] for found in cols["_found"]]
            named = [sorted({i for f in found for i in f["items"]}, key=str.encode) for found in cols["_found"]]
            return {"doc_id": cols["doc_id"], "n_words": cols["n_words"], "hit_spans": list(map(merge, flat)), "items": named, "_copies": cols["_copies"]}

        return run

    merged = map_texts(found, make, SCHEMA + ", _copies long", column="_print")
    return merged.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_", "_copies")


def contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, hit_spans, items): ranges of hit words (end exclusive) and the ids of the items they come from."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = stored(item_pieces(items, item_col, item_text_col, window), "windows")
    blocks = max(1, -(-(pieces.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    of = lambda k: pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).select("item", "words").collect()
    if blocks == 1:
        return _scan(rows, Patterns([tuple(r) for r in of(0)], window))
    rows = rows.withColumn("_print", F.sha2(F.coalesce("text", F.lit("")), 256))
    return _merged([stored(_scan(rows, Patterns([tuple(r) for r in of(k)], window)), "hits") for k in range(blocks)])


def digest(found: DataFrame) -> DataFrame:
    """Counts and a digest of what was found."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"),
    )
