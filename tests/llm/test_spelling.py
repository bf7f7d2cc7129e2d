"""Spelling variants against all pairs of words, compared by edit distance."""

import random
import re
import zlib
from collections import Counter

import pytest

from candor.llm import spelling as sp

DOCS = "doc_id long, text string, word string, n long, form string, key long"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    rows, forms = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if near(w, o))
        if others and -others[0][0] >= 2 * n:
            forms[w] = others[0][1]
        rows[w] = (n, len(others), -others[0][0] if w in forms else None)
    out = {}
    for w in rows:
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, *rows[w])
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    bases = ["".join(rng.choice(["th", "er", "on", "é", "an", "re", "Ou", "ÿ"]) for _ in range(rng.randint(3, 6))) for _ in range(60)]
    edited = []
    for w in bases:
        for _ in range(3):
            at = rng.randrange(len(w))
            edited.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + "e" + w[at:], w[:at] + "q" + w[at + 1 :]]))
    vocabulary = bases * 6 + edited
    out = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 80, 400]))).replace(" ", rng.choice([" ", ", ", "1", "\n", "漢"]))) for i in range(80)]
    out += [(90, None), (91, ""), (None, out[3][1]), (92, "abcde " * 50_000), (93, "a" * 3_000 + " " + "a" * 2_999 + "b"), (7, out[7][1]), (7, out[7][1]), (94, "×÷×÷× ×÷×÷×, ×÷×÷÷ ×÷×÷÷ ×÷×÷÷")]
    out += [(95, "aaaab aaaab aaaab aaaab aaaab aaaab aaaac aaaac aaaac aaaad aaaad aaaad aaaad aaaad aaaad")]
    return out


@pytest.mark.parametrize("hot", [sp.HOT, 4])
def test_variants_equal_all_pairs(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(sp.near_words, "__kwdefaults__", {**sp.near_words.__kwdefaults__, "hot": hot})
    table = spark.createDataFrame([(i, t, "mine", 1, "mine", 2) for i, t in docs], DOCS)
    want = brute(docs)
    assert sum(v[0] is not None for v in want.values()) > 20
    assert got(sp.variants(table)) == want


def test_hot_keys_are_split_without_loss(spark):
    """Thousands of words behind one long common part."""
    letters = "abcdefghij"
    words = [f"internationalis{a}{b}{c}" for a in letters for b in letters for c in letters]
    words += [w[1:] for w in words[::7]] + [w + "x" for w in words[::11]]
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    found = {(r.a, r.b) for r in sp.near_words(table, hot=50).collect()}
    shorter = lambda a, b: tuple(sorted((a, b), key=lambda w: (len(w), w)))
    alphabet = letters + "xinteraols"
    known, want = set(words), set()
    for w in words:
        for i in range(len(w) + 1):
            for c in alphabet:
                for v in (w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]):
                    if v in known and v != w:
                        want.add(shorter(v, w))
    assert found == want


def test_chains_end_at_the_last_form(spark):
    names = [f"w{i:03d}" for i in range(37)]
    forms = spark.createDataFrame(list(zip(names, names[1:])), "word string, form string")
    assert {r.word: r.root for r in sp.roots(forms).collect()} == dict.fromkeys(names[:-1], names[-1])


def test_empty_table(spark):
    assert sp.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert sp.variants(spark.createDataFrame([(1, "no such words", "", 1, "", 1)], DOCS)).count() == 0
