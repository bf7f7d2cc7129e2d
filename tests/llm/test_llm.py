"""The operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from candor.llm import blocks, ctw, iblt, kneser_ney, language, mixing, packing, pii, queries, repetition, secrets, simhash  # noqa: E402
from candor.session import local_session  # noqa: E402

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", shuffle_partitions=4)
    yield session
    session.stop()


def _texts():
    rng = random.Random(3)
    sounds = {"en": ["th", "er", "on", "an", "re"], "fr": ["eau", "ou", "é", "tion", "le"]}
    out = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        words = ["".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([3, 40, 300]))]
        lines = [" ".join(words[at : at + 12]) for at in range(0, len(words), 12)]
        out.append((i, "\n".join(lines), lang, f"s{i % 4}"))
    out += [(60, None, "en", "s0"), (61, "", None, None), (None, "a lone text without an id", "en", "s1"), (62, out[5][1], "en", "s2"), (63, out[5][1] + " x", "en", "s2")]
    out += [(64, "word " * 30_000, "en", "s3"), (65, "é" * 5_000, "fr", "s3"), (7, out[7][1], "en", "s3"), (66, "12 34 ... !!", "en", "s1")]
    return out


@pytest.fixture(scope="session")
def rows():
    return _texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Columns named like results must not get in the way."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "mine", 0.5) for i, t, g, s in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def _by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- personal data -------------------------------------------------------------------------------------------------


def _plain_regexes(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_plain_identifiers_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("a@.1+4 -(2_x\n") for _ in range(rng.randint(0, 60)))
        assert pii.identifiers(t) == _plain_regexes(t), t
    assert pii.identifiers("4111 1111-1111 1111")["card"] == [(0, 19)]


@pytest.mark.parametrize(
    "kind, shown",
    [("email", "bob [at] mail (dot) org"), ("email", "jane at site dot co dot uk"), ("email", "аnna@mail.com"), ("email", "bob＠x.org"), ("card", "four one one one 1111 one one one one 1111"), ("phone", "plus one four one five five five five two six seven one"), ("ip", "10[dot]0[dot]0[dot]7")],
)
def test_disguised_identifiers_map_back(kind, shown):
    text = f"– écrit: {shown}, voilà"
    plain, added = pii.find_pii(text)
    assert [text[a:b] for a, b in added[kind]] == [shown]
    assert shown not in pii.redact(text) and f"[{kind.upper()}]" in pii.redact(text)


@pytest.mark.parametrize(
    "kind, shown",
    [
        ("email", "ops[@]firm[.]com"), ("ip", "10[.]0[.]0[.]7"), ("email", "jane@site dot com"), ("email", "jane[@]site dot com"), ("email", "jane[at]site DOT com"), ("ip", "192 dot 168 dot 1 dot 7"),
        ("email", "j" * 70 + " at " + "s" * 70 + " dot com"), ("card", "4111 1111 1111 111 one"), ("card", "Four One One One 1111 1111 1111"),
        ("ip", "one nine two dot one six eight dot one dot seven"), ("ip", "10 dot zero dot zero dot seven"), ("ip", "One.two.3.four"), ("email", "john one two three at site dot com"),
        ("email", "four two@site.com"), ("email", "jane (at)  site  (dot) com"), ("email", "jane  [ at ] site dot com"),
    ],
)
def test_disguises_stand_by_their_own_rules(kind, shown):
    for before in ("İ: ", ": "):
        text = f"{before}{shown}, ok"
        added = pii.find_pii(text)[1]
        assert [text[a:b] for a, b in added[kind]] == [shown]


def test_plain_prose_has_no_disguises():
    assert pii.find_pii("Mail seven@ the gate, one dot two dot three and four.") == ({k: [] for k in pii.KINDS},) * 2
    assert pii.redact("write to seven one at site dot com") == "write to [EMAIL]"
    assert pii.find_pii("We met at noon, one by one, at the dot of two; on at least three days.") == ({k: [] for k in pii.KINDS},) * 2


def test_pii_rows(docs, rows, empty):
    got = pii.pii_spans(docs).collect()
    assert len(got) == len(rows) and pii.pii_spans(empty).count() == 0


# --- near duplicates -----------------------------------------------------------------------------------------------


def _print(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _components(prints):
    keys = sorted(set(prints.values()))
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin(a ^ b).count("1") <= 4:
                up[find(a)] = find(b)
    least = defaultdict(list)
    for d, p in prints.items():
        least[find(p)].append(d)
    return {d: min(least[find(p)]) for d, p in prints.items()}


def test_simhash_components(docs, rows, empty):
    got = [r for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    prints = {i: _print(t) for i, t, *_ in rows if i is not None}
    want = _components(prints)
    for r in got:
        if r["doc_id"] is not None:
            assert (int(r["fingerprint"], 16), r["component_id"]) == (prints[r["doc_id"]], want[r["doc_id"]])
    assert simhash.near_duplicates(empty).count() == 0


def test_dense_and_split_groups_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(300):  # chains of near fingerprints around one
        p = rng.choice(sorted(prints))
        for b in rng.sample(range(64), rng.randint(1, 4)):
            p ^= 1 << b
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(300)}
    want = _components({p: p for p in prints})
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    for chunk in (1024, 16):
        edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.fingerprint_links(df, chunk=chunk).collect()]
        assert all(bin(a ^ b).count("1") <= 4 for a, b in edges)
        up = {p: p for p in prints}

        def find(k):
            while up[k] != k:
                k = up[k]
            return k

        for a, b in edges:
            up[find(a)] = find(b)
        groups, expected = defaultdict(set), defaultdict(set)
        for p in prints:
            groups[find(p)].add(p)
            expected[want[p]].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


# --- language ------------------------------------------------------------------------------------------------------


def test_language_held_out(spark, docs, rows, empty):
    net = language.train_on(docs, queries.crc_mod("doc_id", 3) != 1)
    got = language.predict(docs, net).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        if i in (60, 61, 66):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif i is not None and i < 60 and zlib.crc32(str(i).encode()) % 3 == 1:
            assert r["lang_pred"] == ("en" if i % 2 else "fr") and 0 <= r["score"] <= 1
    assert language.train_on(empty, queries.crc_mod("doc_id", 3) != 1) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}


def test_lookup_equals_the_network():
    net = language.ByteConvNet(["a", "b"])
    x, _ = language.windows("the quick brown fox " * 30)
    p, w = net.p, language.WINDOW
    hidden = []
    for k in language.WIDTHS:
        patches = np.concatenate([p["emb"][x][:, j : w - k + 1 + j] for j in range(k)], axis=2)
        hidden.append(np.maximum((patches @ p[f"w{k}"] + p[f"b{k}"]).max(axis=1), 0))
    z = np.concatenate(hidden, axis=1) @ p["out"] + p["bias"]
    assert np.allclose(net.probabilities(x), language._softmax(z), atol=1e-5)


# --- sketches ------------------------------------------------------------------------------------------------------


def _paragraphs(t):
    return {p for line in (t or "").split("\n") for p in (re.split(r"(?<=[.!?]) ", line) if len(line) > 400 else [line])}


def test_sketches(docs, rows, empty):
    distinct = {(-(1 << 63) if i is None else i): t or "" for i, t, *_ in rows}
    order = sorted(distinct, reverse=True)
    got = iblt.fingerprints(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        key = -(1 << 63) if r["doc_id"] is None else r["doc_id"]
        t, following = distinct[key], distinct[order[(order.index(key) + 1) % len(order)]]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = map(_paragraphs, (t, edited, following))
        assert math.isclose(r["near_edited"], len(a & b) / len(a | b)) and math.isclose(r["near_next"], len(a & c) / len(a | c))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (a == b)
    assert iblt.fingerprints(empty).count() == 0


# --- language models -----------------------------------------------------------------------------------------------


def _ctw_brute(train, asked):
    """Log10 probabilities by trees built bit by bit, mixed recursively."""
    counts = defaultdict(lambda: [0, 0])
    pad = b"\xff" * ctw.DEPTH
    for body in train:
        data = pad + body
        for i in range(ctw.DEPTH, len(data)):
            for j in range(8):
                node = (1 << j) | (data[i] >> (8 - j))
                for d in range(ctw.DEPTH + 1):
                    counts[data[i - d : i], node][data[i] >> (7 - j) & 1] += 1
    kids = defaultdict(set)
    for context, node in counts:
        if context:
            kids[context[1:], node].add(context)
    mixed = {}

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)

    for context, node in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[context, node])
        mixed[context, node] = own if len(context) == ctw.DEPTH else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(mixed[c, node] for c in kids[context, node]))
    out = []
    for body in asked:
        data, total = pad + body, 0.0
        for i in range(ctw.DEPTH, len(data)):
            for j in range(8):
                node, bit = (1 << j) | (data[i] >> (8 - j)), data[i] >> (7 - j) & 1
                p, rest = 0.0, 1.0
                for d in range(ctw.DEPTH + 1):
                    key = (data[i - d : i], node)
                    z = counts.get(key, [0, 0])
                    w = 1.0 if d == ctw.DEPTH else math.exp(math.log(0.5) + kt(*z) - mixed.get(key, 0.0))
                    p += rest * w * (z[bit] + 0.5) / (sum(z) + 1)
                    rest *= 1 - w
                total += math.log10(p)
        out.append(total)
    return out


def test_context_tree_weighting(spark, empty):
    rows = [(i, t) for i, t, *_ in _texts()[:16]] + [(200, None), (201, ""), (None, "no id"), (3, "again")]
    rows = [(i, t and t[:150]) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ctw.score_documents(df).collect()
    assert len(got) == len(rows) and ctw.score_documents(empty).count() == 0
    bodies = [b" ".join(blocks.tokens(t)) + b"\xff" for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    words = Counter(w for b, h in zip(bodies, held) if not h for w in [*b[:-1].split(), b"\xff"])
    n, v = sum(words.values()), len(words)
    want = []
    for (i, _), b, h, s in zip(rows, bodies, held, _ctw_brute([b for b, h in zip(bodies, held) if not h], bodies)):
        split = [*b[:-1].split(), b"\xff"]
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split)
        want.append((-1 if i is None else i, h, len(split), sum(w in words for w in split), n, round(base, 6), round(s, 6)))
    told = [(-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    for a, b in zip(sorted(told), sorted(want), strict=True):
        assert a == pytest.approx(b, abs=2e-6)


def test_context_trees_see_five_bytes(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a1234p", "b1234q"]) for _ in range(100))) for i in range(40)]
    got = [r["bits_per_byte"] for r in ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").collect()]
    assert got and max(got) < 0.22  # one bit a word of seven bytes; two without the fifth byte


def test_kneser_ney_sums_to_one(spark):
    grams = Counter()
    for t in ("abracadabra", "abba", "banana band", "a bandana"):
        data = b"\xff" * 3 + t.encode() + b"\xff"
        grams.update(int.from_bytes(data[i : i + 4], "big") for i in range(len(data) - 3))
    counts = spark.createDataFrame(list(grams.items()), "code long, n long")
    for context in (b"ban", b"zzz", b"and"):
        asked = spark.createDataFrame([(int.from_bytes(context + bytes([s]), "big"),) for s in range(256)], "code long")
        assert sum(10 ** r["value"] for r in kneser_ney.probabilities(counts, asked).collect()) == pytest.approx(1)


def _kneser_ney_brute(trained, bodies, n):
    """Perplexity per byte of each body, straight from the definition."""
    levels = {n: Counter()}
    for b in trained:
        data = b"\xff" * (n - 1) + b
        levels[n].update(data[i : i + n] for i in range(len(b)))
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    off, following = {}, {}
    for k, c in levels.items():
        m = Counter(c.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] and m[2] else None
        raw = [0.5] * 3 if y is None else [1 - 2 * y * m[2] / m[1], 2 - 3 * y * m[3] / m[2], 3 - 4 * y * m[4] / m[3] if m[3] else 0.5]
        off[k] = [min(max(d, 0.05), i + 1.0) for i, d in enumerate(raw)]
        following[k] = defaultdict(list)
        for g, v in c.items():
            following[k][g[:-1]].append(v)

    def p(gram):
        if not gram:
            return 1 / 256
        k, seen = len(gram), following[len(gram)].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        less = lambda v: off[k][min(v, 3) - 1]
        v = levels[k][gram]
        return ((v - less(v) if v else 0) + sum(map(less, seen)) * p(gram[1:])) / sum(seen)

    out = []
    for b in bodies:
        data = b"\xff" * (n - 1) + b
        out.append(10 ** (-sum(math.log10(p(data[i : i + n])) for i in range(len(b))) / len(b)))
    return out


def test_kneser_ney_against_brute_force(spark):
    """Perplexities, and thresholds over all trusted rows: also those not counted, repeated, or of null language."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["ab", "ba", "abc", "Cab", "é", "x" * (i % 7)]) for _ in range(rng.randint(0, 30))), rng.choice(["aa", "bb", None])) for i in range(40)]
    rows += [(None, "abc ab", "aa"), (3, rows[3][1], rows[3][2]), (50, None, "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(31, 1, 1), (32, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    fit = set(range(30))
    bodies = [b" ".join(blocks.tokens(t)) + b"\xff" for _, t, _ in rows]
    want = _kneser_ney_brute([b for b, r in zip(bodies, rows) if r[0] in fit], bodies, kneser_ney.ORDER)
    got = kneser_ney.quality(df, labels, quantile=0.5).collect()
    assert sorted(r["perplexity"] for r in got) == pytest.approx(sorted(want), rel=1e-6)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[r[0]]["perplexity"] for r in rows] == pytest.approx(want, rel=1e-6)
    every = sorted(w for w, r in zip(want, rows) if r[0] in fit)
    for lang in ("aa", "bb", None, "cc"):
        mine = sorted(w for w, r in zip(want, rows) if r[0] in fit and r[2] == lang) or every
        assert all(r["threshold"] == pytest.approx(mine[math.ceil(len(mine) / 2) - 1]) for r in got if r["lang"] == lang)
    assert all(r["kept"] == (r["perplexity"] <= r["threshold"]) for r in got)


def test_thresholds_take_rows_beyond_the_fitted_ones(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "trusted_ids", lambda labels: [0, 1])
    df = spark.createDataFrame([(i, "ab" * (i + 1), "aa" if i < 2 else "bb") for i in range(8)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    got = kneser_ney.quality(df, labels, quantile=1.0).collect()
    assert {r["threshold"] for r in got if r["lang"] == "bb"} == {max(r["perplexity"] for r in got if 2 <= r["doc_id"] < 6)}


def test_the_model_counts_all_trusted_rows(spark):
    """No bound on the rows it is counted on: 20,500 trusted ones, of which the last few alone hold the asked word."""
    n, rare = 20_500, 500
    df = spark.range(n).select(
        "id", F.when(F.col("id") < n - rare, "ab").otherwise("xyz").alias("text"), F.lit("aa").alias("lang")
    ).withColumnRenamed("id", "doc_id")
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    want = _kneser_ney_brute([b"ab\xff"] * (n - rare) + [b"xyz\xff"] * rare, [b"ab\xff", b"xyz\xff"], kneser_ney.ORDER)
    got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.quality(df, labels).collect()}
    assert [got[0], got[n - 1]] == pytest.approx(want, rel=1e-9)


def test_quality_by_perplexity(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    junk = spark.createDataFrame([(500, "$$$ %%% 9x9x &&& ### zzqj " * 30, "en", "s0", 0, "", 0.0)], DOCUMENTS)
    got = _by_id(kneser_ney.quality(docs.union(junk), labels))
    assert not got[500]["kept"] and sum(got[i]["kept"] for i in range(60)) >= 54
    assert kneser_ney.quality(empty, labels).count() == 0
    assert all(r["kept"] for r in kneser_ney.quality(docs, labels.filter("false")).collect())


# --- mixing, packing -----------------------------------------------------------------------------------------------


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    target |= {s: level * weight[s] for s in open_}
    assert {round(r["target"], 6) for r in got} == {round(t, 6) for t in target.values()}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == sum(math.floor(t) for t in target.values())
    copies = mixing.schedule(mixing.mix(docs)).collect()
    assert sum(r["words"] for r in copies) == sum(r["taken"] for r in got)
    assert [r["position"] for r in copies] == sorted(r["position"] for r in copies)
    assert mixing.mix(empty).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in packing.pack(docs, shard=8).collect():
        got[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        if i == 7:  # a repeated row
            continue
        at = 0
        for r in sorted(got[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


def test_packing_finds_neighbours_anywhere_in_the_input(spark):
    rng = random.Random(5)
    topics = [[f"{a}{b}" for b in "bcdfghjklmnp"] for a in ("ta", "ke", "mi", "so", "lu", "ran", "ved", "pol")]
    rows = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(24))) for i in range(256)]
    told = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shard=32, window=256).collect()
    sequences = defaultdict(list)
    for r in told:
        sequences[r["sequence_id"]].append(r["doc_id"] % 8)
    pairs = [a == b for topic in sequences.values() for a, b in zip(topic, topic[1:])]
    assert len(pairs) > 100 and sum(pairs) > 0.6 * len(pairs)


@pytest.mark.parametrize("text", ["It's THE end... of it", "l'été, où ÇA?! naïve_3x", "tab\x1cgap \x85 x", "école İstanbul ΣΊΣΥΦΟΣ", "<|endoftext|> 12,345 🙂🙂", "hello<|startoftext|>world <|endoftext|>", "<|ENDOFTEXT|> <|x", "don't we're I'll 'tis"])
def test_remembered_words_encode_like_the_tokenizer(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.VOCABULARY)
    encode, kind = packing.encoder()
    assert np.frombuffer(encode(text), kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_marks_are_in_every_odd_space():
    for code in range(0x110000):
        if not 0xD800 <= code < 0xE000:
            assert packing.has_odd_space(chr(code)) == (packing._ODD_SPACE.search(chr(code)) is not None)


# --- repetition, secrets -------------------------------------------------------------------------------------------


def test_repeats_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        ids = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 40))])
        n = len(ids)
        want = [max([k for j in range(n) if j != i for k in range(1, n - max(i, j) + 1) if (ids[i : i + k] == ids[j : j + k]).all()], default=0) for i in range(n)]
        got = repetition.longest_repeats(repetition._dense(ids))
        assert got.tolist() == want
        inside = set()
        for i, k in enumerate(want):
            if k >= 2:
                inside |= set(range(i, i + k))
        assert repetition.covered(got, 2) == len(inside)


def test_repetition_counts(docs, rows, empty):
    got = repetition.repetition(docs).collect()
    assert len(got) == len(rows) and repetition.repetition(empty).count() == 0
    by = {r["doc_id"]: r for r in got}
    for i, t, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert tuple(by[i][c] for c in repetition.COLUMNS[:5]) == want
        assert by[i]["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
    passage = " ".join(f"w{k}" for k in range(60))
    assert repetition.measure(f"{passage}\nbetween\n{passage}")[6] == 60


def test_secret_spans(spark, empty):
    rng = random.Random(4)
    key64 = "".join(rng.choice(secrets.ALPHABETS["base64"]) for _ in range(44))
    key36 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(40))
    prose = "the-quick-brown-fox-jumps-over-the-lazy-dog-2024-and-sleeps-all-day-long-under-the-old-oak-tree"
    texts = [
        f"é🙂 Token: secret: abcdefghijklmnop PASSWORD = 'x1y2z3x1y2z3' api_key={'0123456789abcdef' * 2}", f"AKIA{'Z9' * 8} and {key64} or {key36}", f"see {prose} " * 3,
        None, "", "token=token=token=aaaaaaaaaaaa", "a" * 20_000 + "deadbeefdeadbeef",
    ]
    texts += [f"{prose.replace('2024', str(2000 + i))} {'1' * 10}aaaaaaaaaaaaaaaa{'b' * (i % 7)}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = _by_id(secrets.secret_spans(df))
    assign = re.compile(secrets.ASSIGN)
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(s[1] == k for s in spans) for k in range(3)]
    found = [texts[1][int(x.split(":")[1]) : int(x.split(":")[2])] for x in got[1]["spans"].split(",") if x.startswith("random")]
    assert found == [key64, key36]
    assert got[2]["n_random"] == 0 and secrets.secret_spans(empty).count() == 0


def _tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def _battery(token, encoding):
    """The p-value by plain Python; chi-squared tails by the cube root as in the operator."""
    letters = secrets.ALPHABETS[encoding]
    written = token.lower() if encoding == "hex" else token.replace("-", "+").replace("_", "/") if encoding == "base64" else token
    v, n, k = [letters.index(c) for c in written], len(token), len(letters)
    cls = [next(i for i, c in enumerate(secrets._CLASSES) if re.match(c, x)) for x in written]
    shares = [len(re.findall(c, letters)) / k for c in secrets._CLASSES]

    def chi_tail(chi, free):
        return _tail(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))

    def two(z):
        return min(1.0, 2 * _tail(abs(z)))

    uniform = chi_tail(k / n * sum(c * c for c in Counter(v).values()) - n, k - 1)
    seen = [(cls.count(i), s * n) for i, s in enumerate(shares) if s]
    classes = chi_tail(sum((o - e) ** 2 / e for o, e in seen), len(seen) - 1)
    m, among = len(re.findall("[A-Za-z]", written)), len(re.findall("[AEIOUaeiou]", letters)) / len(re.findall("[A-Za-z]", letters))
    vowels = two(max(0, abs(len(re.findall("[AEIOUaeiou]", written)) - m * among) - 0.5) / math.sqrt(m * among * (1 - among))) if m else 1.0
    one, both = 1 - sum(s * s for s in shares), sum(s * (1 - s) ** 2 for s in shares)
    wide = math.sqrt((n - 1) * one * (1 - one) + 2 * (n - 2) * (both - one * one))
    runs = two(max(0, abs(sum(a != b for a, b in zip(cls, cls[1:])) - (n - 1) * one) - 0.5) / wide)
    mean = sum(v) / n
    spread = sum((x - mean) ** 2 for x in v)
    serial = two((sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (classes, vowels, runs))
    b = min(2.0, 2 * math.exp(-half) * (1 + half + half * half / 2), 4 * uniform, 4 * serial)
    return 1 - (1 - b / 2) * (1 - b / 4) ** 2


def _drawn(rng, name, size):
    return "".join(rng.choice(secrets.ALPHABETS[name]) for _ in range(size))


def test_battery_against_brute_force(spark):
    rng = random.Random(9)
    tokens = [_drawn(rng, name, size) for name in secrets.ALPHABETS for size in (20, 33, 64)]
    tokens += ["CustomerOrderReportSummary42", "a" * 30, "0123456789abcdef0123", "the-quick-brown-fox_jumps", "ABCDEFGH" * 3, "x" + "7" * 25]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select(secrets.battery(F.array("t"))[0].alias("x")).select("x.*").collect()
    assert {r["encoding"] for r in got} == set(secrets.ALPHABETS)
    for r in got:
        assert math.isclose(r["p"], _battery(r["token"], r["encoding"]), rel_tol=1e-3, abs_tol=1e-6)
        assert math.isclose(r["bits"], len(r["token"]) * math.log2(len(secrets.ALPHABETS[r["encoding"]])))


def test_random_runs_are_found_and_names_are_not(spark):
    """Short random runs, with or without a digit, beside camel-case names, slugs and paths."""
    rng = random.Random(5)
    parts = "Customer Order Report Summary get User Name Index Build File Path Handler Manager Service Request Response Stream Reader Config Value".split()
    keys = [_drawn(rng, name, size) for name, size in [("base62", 16), ("base62", 20), ("lower36", 24), ("base64", 44), ("base32", 20)] for _ in range(100)]
    names = ["".join(w.capitalize() for w in rng.sample(parts, rng.randint(3, 5))) + str(rng.randint(1, 99)) for _ in range(200)]
    names += [c.join(w.lower() for w in rng.sample(parts, 4)) for c in "-/_" for _ in range(60)]
    names = [x for x in names if len(x) >= 14]
    df = spark.createDataFrame(list(enumerate(keys + names)), "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.secret_spans(df).filter("n_random > 0").collect()}
    for i in range(5):
        assert sum(j in found for j in range(100 * i, 100 * i + 100)) >= 90
    assert sum(len(keys) + j in found for j in range(len(names))) < 0.05 * len(names)


def test_spans_of_many_runs(spark):
    """Whole texts of more runs than a block; random runs beside base spans; ids null, repeated, names that clash."""
    rng = random.Random(6)
    key = _drawn(rng, "base62", 30)
    long = " ".join(_drawn(rng, "hex", 16) if i % 3 else f"é{key}" for i in range(1000))
    rows = [(None, long, "x", 1), (3, long, "y", 2), (3, long, "y", 2), (4, f"token={key} {key}", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, start int")
    got = secrets.secret_spans(df).collect()
    want = sorted([(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", long)] + [(m.start(), 3, m.end()) for m in re.finditer(key, long)])
    told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "3", "4", "None"]
    assert [r["spans"] for r in got if r["doc_id"] != 4] == [told] * 3
    assert next(r for r in got if r["doc_id"] == 4)["spans"] == f"assign:0:36,random:37:67"


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark, docs, rows):
    import corpus_pipeline

    current, told = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        current = stage(spark, current, "").cache()
        told[name] = current.collect()
        if name != "packing":
            assert current.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in told["language"]}
    assert not {60, 61, 66} & set(kept) and set(range(60)) <= set(kept)
    components = _components({i: _print(t) for i, t in kept.items() if i is not None})
    assert sorted(r["doc_id"] for r in told["near_duplicates"] if r["doc_id"] is not None) == sorted(set(components.values()))
    assert [r["text"] for r in told["pii"]] == [pii.redact(r["text"]) for r in told["near_duplicates"]]
    sizes = defaultdict(int)
    for r in told["pii"]:
        sizes[r["source"]] += len(r["text"].split())
    taken = sum(len(r["text"].split()) for r in told["mixing"])
    assert abs(taken - 1.5 * sum(sizes.values())) <= len(sizes)
    tokens = {r["doc_id"]: r["doc_tokens"] for r in told["packing"]}
    assert sum(r["length"] for r in told["packing"]) >= sum(tokens.values())


def test_an_id_on_two_texts_keeps_both_groups(spark):
    from candor.llm import stages

    a, b, c = (" ".join(f"{w}{i}" for i in range(80)) for w in "abc")
    rows = [(5, a), (5, b), (5, b), (7, b), (8, c), (8, c), (None, c), (None, "alone in its group"), (9, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = stages.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    told = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(told, key=str) == sorted([(5, a), (5, b), (8, c), (None, "alone in its group"), (9, None)], key=str)
    assert stages.one_of_each_group(spark, docs.limit(0), "").count() == 0


def test_trusted_texts_move_compressed_and_never_by_broadcast(spark, monkeypatch):
    """The rows that meet the labels hold compressed texts, at any size, and score like plain ones."""
    from candor.llm import blocks, kneser_ney

    texts = ["alpha beta gamma " * 20, "Ünïcode text", "", None, "beta alpha " * 9]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    seen, build = [], blocks.build
    monkeypatch.setattr(blocks, "build", lambda rows, *a, **k: seen.append(rows) or build(rows, *a, **k))
    trusted = spark.createDataFrame([(0,), (1,), (3,)], "doc_id long")
    key = lambda r: r["doc_id"]
    got = sorted(kneser_ney.perplexities(docs, trusted).collect(), key=key)
    plain = sorted(kneser_ney.perplexities(docs, [0, 1, 3]).collect(), key=key)
    assert [(r["doc_id"], r["trusted"], r["n_bytes"]) for r in got] == [(r["doc_id"], r["trusted"], r["n_bytes"]) for r in plain]
    assert all(abs(a["score"] - b["score"]) < 1e-9 for a, b in zip(got, plain))
    assert dict(seen[0].dtypes)["text"] == "binary"
    assert "BroadcastHashJoin" not in seen[0]._jdf.queryExecution().executedPlan().toString()
