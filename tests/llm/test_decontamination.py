"""Wu-Manber search against a plain scan for every window."""

import hashlib
import random
import re

import numpy as np
import pytest

from candor.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_words long, items string, hit_spans string"
ITEMS = "item_id long, text string, words string, size int"


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        words, hit, names = split(text), set(), set()
        for item, pattern in items:
            p = split(pattern)
            m = min(window, len(p))
            for k in range(len(p) - m + 1 if m else 0):
                for at in range(len(words) - m + 1):
                    if words[at : at + m] == p[k : k + m]:
                        hit |= set(range(at, at + m))
                        names.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["été", "Straße", "ÀB", "x1"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, prose(rng.choice([12, 25, 60]))) for i in range(12)]
    items += [(20, "lone phrase of five words"), (21, "single"), (22, ""), (23, None), (24, "--- !!"), (None, "no name at all here"), (5, items[5][1]), (5, prose(15))]
    items += [(30, "same start " * 8), (31, "a b c d e f g h i j"), (32, "z b c d e f g h i j"), (33, "a b c d e f x h i j")]
    docs = [(i, prose(200)) for i in range(15)]
    for i in range(15, 30):
        item = rng.choice(items[:12])[1].split()
        at = rng.randrange(max(1, len(item) - 11))
        docs.append((i, prose(40) + " " + ", ".join(item[at : at + 11]).upper() + "; " + prose(30)))
    docs += [(30, None), (31, ""), (32, "SINGLE"), (33, "lone phrase of five words"), (34, "lone phrase of five"), (35, "no name at all here"), (15, docs[15][1]), (15, docs[15][1])]
    docs += [(None, docs[16][1]), (36, "a b c d e f g h i j " * 3), (37, "same start " * 40), (38, "a b c d e f g h i"), (15, docs[17][1])]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_every_window_is_found(spark, tables, block_bytes):
    docs, items = tables
    left = spark.createDataFrame([(i, t, 1, "mine", "mine") for i, t in docs], DOCS)
    right = spark.createDataFrame([(i, t, "mine", 3) for i, t in items], ITEMS)
    found = dec.digest(dec.contamination(left, right, block_bytes=block_bytes))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()), key=repr)
    assert got == brute(docs, items)


def test_long_items_and_long_texts(spark):
    rng = random.Random(1)
    words = [f"v{rng.randrange(50_000)}" for _ in range(5_000)]
    text = " ".join(words)
    filler = " ".join(f"f{i}" for i in range(400_000))
    left = spark.createDataFrame([(1, filler + " " + text + " " + filler), (2, filler)], "doc_id long, text string")
    right = spark.createDataFrame([(1, text)], "item_id long, text string")
    found = {r.doc_id: r for r in dec.contamination(left, right).collect()}
    assert [tuple(s) for s in found[1].hit_spans] == [(400_000, 405_000)]
    assert found[1].n_words == 805_000 and found[2].hit_spans == []


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in dec.digest(dec.contamination(some, none)).collect()] == [(3, 0, False)]
    assert dec.contamination(some.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_shift_table_skips_and_loses_nothing():
    rng = np.random.default_rng(2)
    pieces = [(str(i), " ".join(f"p{v}" for v in rng.integers(0, 200, 30))) for i in range(50)]
    patterns = dec.Patterns(pieces)
    (table,) = patterns.tables
    ids = rng.integers(0, 201, 20_000).astype(np.int32)
    ids[5_000:5_010] = table.windows[7]
    windows = {tuple(w) for w in table.windows.tolist()}
    want = [i for i in range(len(ids) - 9) if tuple(ids[i : i + 10].tolist()) in windows]
    assert table.occurrences(ids)[0].tolist() == want and 5_000 in want
    assert len(table.candidates(ids)) < len(ids) / 10
    assert table.shift.max() == table.m - 1
