"""SimHash near-duplicates by pivot distance tables.

Each text gets a 64-bit fingerprint.  References (pivots) are one base fingerprint, the 64 fingerprints that differ
from it in one bit, dealt into ``GROUPS`` groups, and ``PIVOTS`` fixed random ones; the table holds the Hamming
distances of every distinct fingerprint to all of them.  A bit that differs between two fingerprints moves the
distance, taken relative to the base, to exactly one of the 64 single-bit references; so fingerprints linked at
``DISTANCE`` bits agree in all coordinates of at least ``GROUPS - DISTANCE`` groups.  Rows of the table meet where
that many groups agree (every choice of groups is one key), pairs whose coordinates to the random pivots differ by
more than ``DISTANCE`` anywhere are discarded (triangle inequality), and survivors are verified bit by bit.  No link
is lost.

Exact copies meet as one fingerprint.  Inside a key only edges that join two parts are emitted, so a group of n
near copies gives at most n - 1 edges per key.  Keys with more than ``CHUNK`` fingerprints are split: chunks of
them are compared in pairs, each pair in a task's stream of its own.

Null text counts as empty: fingerprint zero, linked like any other.  Null ids stay as rows and take the component of
their fingerprint; a component without any id is null.  Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.lineage import cut
from candor.llm.common import map_texts
from candor.operators.components import connected_components
from candor.skew import attach

SHINGLE = 4
SEED = 42
DISTANCE = 4
GROUPS = 6
PIVOTS = 24
CHUNK = 1024
BLOCK = 1 << 16  # shingles whose bits are counted at once

_rng = np.random.default_rng(SEED)
BASE = _rng.integers(0, 1 << 64, dtype=np.uint64)
REFERENCES = _rng.integers(0, 1 << 64, size=PIVOTS, dtype=np.uint64)
SINGLE = BASE ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half the hashes of the text's k-word shingles, repeats counted."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    n = max(1, len(words) - k + 1)
    last = ends[k - 1 :] if len(words) >= k else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[at : min(n, at + BLOCK)], last[at : at + BLOCK])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "fp": [signed(fingerprint(t)) for t in rows["text"]]}

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, fp long")


def pivot_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (rows) to each pivot (columns)."""
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int8)


def group_keys(prints: np.ndarray, groups: int = GROUPS, distance: int = DISTANCE) -> list[np.ndarray]:
    """One key per choice of groups: the coordinates to the chosen groups' references, relative to the base."""
    moved = pivot_table(prints, SINGLE) > pivot_table(prints, np.array([BASE]))
    bounds = np.linspace(0, 64, groups + 1).round().astype(int)
    out = []
    for n, chosen in enumerate(combinations(range(groups), groups - distance)):
        picked = np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in chosen])
        weights = np.uint64(1) << np.arange(len(picked), dtype=np.uint64)
        key = (moved[:, picked] * weights).sum(axis=1, dtype=np.uint64)
        out.append((np.uint64(n) << np.uint64(56)) | key)
    return out


def _keyed(prints: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for key in group_keys(fp.view(np.uint64)):
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "fp": fp})

    return prints.mapInArrow(run, "key long, fp long")


def _links(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all linked fingerprints within each run of equal keys, without closing cycles."""
    n = len(prints)
    table = pivot_table(prints, REFERENCES)
    parent = np.arange(n)
    left, right = [], []
    at = np.arange(n)
    for shift in range(1, n):
        at = at[at + shift < n]
        at = at[keys[at] == keys[at + shift]]
        if not len(at):
            break
        apart = at[parent[at] != parent[at + shift]]
        for some in np.array_split(apart, len(apart) // BLOCK + 1):
            near = some[(np.abs(table[some] - table[some + shift]) <= distance).all(axis=1)]
            near = near[np.bitwise_count(prints[near] ^ prints[near + shift]) <= distance]
            for i in near.tolist():
                a, b = i, i + shift
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    left.append(i)
                    right.append(i + shift)
            if len(near):
                while (parent[parent] != parent).any():
                    parent = parent[parent]
    return prints[left], prints[right]


def _edges(rows: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """Links within runs of equal ``keys``; rows come sorted by them."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts)
        columns = np.stack([whole.column(k).to_numpy() for k in keys])
        run = np.concatenate(([0], np.cumsum((columns[:, 1:] != columns[:, :-1]).any(axis=0))))
        a, b = _links(run, whole.column("fp").to_numpy().view(np.uint64), distance)
        return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whole runs; the last one may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            changed = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
                yield flush(held)
                held = []
            if len(changed):
                yield flush([*held, batch.slice(0, int(changed[-1]))])
                held = []
            held.append(batch.slice(int(changed[-1]) if len(changed) else 0))
        if held:
            yield flush(held)

    return rows.mapInArrow(run, "a long, b long")


def fingerprint_links(prints: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect what is linked at ``distance`` bits or fewer."""
    keyed = cut(_keyed(prints))
    sizes = keyed.groupBy("key").count().filter(F.col("count") > 1)
    rows = attach(keyed, sizes, "key", "inner").withColumn("parts", F.ceil(F.col("count") / chunk).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = rows.withColumn("part", part).select(
        "key", "fp",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, "part").alias("i"), F.greatest(j, "part").alias("j")))).alias("_p"),
    ).select("key", F.col("_p.i").alias("i"), F.col("_p.j").alias("j"), "fp")
    keys = ["key", "i", "j"]
    return _edges(met.repartition(*keys).sortWithinPartitions(*keys, "fp"), keys, distance).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest id that links of at most ``DISTANCE`` bits reach."""
    prints = cut(fingerprints(docs, id_col, text_col))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    components = connected_components(fingerprint_links(distinct.select("fp")), "a", "b")
    rooted = attach(distinct.withColumnRenamed("fp", "node"), components, "node").select(
        F.col("node").alias("fp"), "first_id", F.coalesce("component", "node").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = cut(attach(rooted, smallest, "root").select("fp", "component_id"))
    return attach(prints, members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
