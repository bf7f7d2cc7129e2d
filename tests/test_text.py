import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from candor.functions import text as tx
from candor.functions.lexicons import STOP_WORDS
from candor.operators import text
from candor.operators.text_similarity import text_similarity

TEXTS = [
    None, "", "!!! ...", "Visit xhttp://a.b/c now", "a <b\nc> d <i>e</i>", "Été 2x café? Yes.", "You cannot, gonna!",
    "life-changing best 😀", "wow wow", "A B. C! D?",
]


def frame(spark, texts, extra=""):
    rows = [(i, "g", "g", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "review_id long, product_id string, user_id string, review_text string")


def column(df, name):
    return [r[0] for r in df.orderBy("review_id").select(name).collect()]


def test_clean_and_tokens(spark):
    df = frame(spark, TEXTS)
    cleaned = column(text.clean_text(df), "clean_text")
    assert cleaned == ["", "", "", "visit x now", "a b c d e", "été 2x café yes", "you cannot gonna", "lifechanging best 😀", "wow wow", "a b c d"]
    assert column(text.tokenize(df, remove_stop_words=False), "tokens")[6] == ["you", "can", "not", "gon", "na"]
    assert column(text.tokenize(df), "tokens")[6] == ["gon", "na"]
    assert column(text.tokenize(df), "tokens")[0] == []


def test_ngrams_and_top(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b", "c"]), (2, ["a"]), (3, [])], "review_id int, tokens array<string>")
    assert column(text.ngrams(df, 2), "ngrams") == [["a b", "b a", "a b", "b c"], [], []]
    top = df.select("review_id", tx.top_items(tx.ngrams(F.col("tokens"), 2), 2).alias("t"))
    assert [[(x.ngram, x["count"]) for x in t] for t in column(top, "t")] == [[("a b", 2), ("b a", 1)], [], []]


def test_lemmas(spark):
    df = text.tokenize(frame(spark, ["cats dogs cats", "", None]))
    lemmas = spark.createDataFrame([("cats", "cat")], "form string, lemma string")
    assert column(text.lemmatize(df, lemmas), "lemmas") == [["cat", "dogs", "cat"], [], []]
    assert column(text.lemmatize(df, None), "lemmas")[0] == ["cats", "dogs", "cats"]


def test_statistics_and_linguistics(spark):
    df = frame(spark, TEXTS)
    stats = text.text_statistics(df).orderBy("review_id").collect()
    assert (stats[0].char_count, stats[0].avg_word_length, stats[0].unique_words_ratio) == (0, 0.0, 0.0)
    assert stats[5].question_count == 1 and stats[5].digit_ratio == pytest.approx(1 / len(TEXTS[5]))
    assert stats[8].unique_words_ratio == 0.5
    for row, t in zip(text.linguistic_features(df).orderBy("review_id").collect(), TEXTS):
        t = t or ""
        words = re.findall(r"\b\w+\b", t.lower())
        parts = [s for s in re.split(r"[.!?]+", t) if s.strip()]
        n = max(len(t), 1)
        assert row.avg_word_length == pytest.approx(sum(map(len, words)) / max(len(words), 1))
        assert row.avg_sentence_length == pytest.approx(len(words) / max(len(parts), 1))
        assert row.uppercase_ratio == pytest.approx(sum(c.isupper() for c in t) / n)
        assert row.punctuation_ratio == pytest.approx(sum(c in ".,;:!?\"-()[]{}" for c in t) / n)


def test_sentiment(spark):
    rows = text.sentiment_features(frame(spark, ["best best bad", None, "life-changing"])).orderBy("review_id").collect()
    assert (rows[0].positive_word_count, rows[0].negative_word_count, rows[0].exaggerated_word_count) == (2.0, 1.0, 2.0)
    assert rows[0].sentiment_score == pytest.approx(1 / 3)
    assert rows[1].exaggeration_ratio == 0.0 and rows[2].exaggerated_word_count == 0.0
    mix = text.sentiment_mix(frame(spark, ["not good, never"])).first()
    assert (mix.positive_count, mix.negative_count, mix.neutral_count) == (1, 2, 1)


def brute(texts):
    terms = [Counter(w for w in re.findall(r"\w\w+", (t or "").lower()) if w not in STOP_WORDS) for t in texts]
    df = Counter(w for c in terms for w in c)
    vectors = []
    for c in terms:
        v = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        vectors.append({w: x / norm for w, x in v.items()})
    out = []
    for i, v in enumerate(vectors):
        sims = [sum(x * o.get(w, 0.0) for w, x in v.items()) for j, o in enumerate(vectors) if j != i]
        out.append((sum(sims) / len(sims), max(sims), sum(s >= 0.7 - 1e-9 for s in sims)) if sims else (0.0, 0.0, 0))
    return out


def test_text_similarity_against_all_pairs(spark):
    import random

    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    groups = defaultdict(list)
    for g in range(4):
        for _ in range(25):
            groups[f"g{g}"].append(" ".join(rnd.choices(vocabulary, weights=[1 / (i + 1) for i in range(40)], k=rnd.randint(1, 12))))
        base = groups[f"g{g}"][0]
        groups[f"g{g}"] += [base, base, base + " w1", "the of and", None, "", "unique" + str(g)]
    groups["alone"] = ["w1 w2"]
    groups["stop"] = ["the", "the", "of"]
    rows, want, n = [], {}, 0
    for g, texts in groups.items():
        for t, figures in zip(texts, brute(texts)):
            rows.append((n, g, t))
            want[n] = figures
            n += 1
    df = spark.createDataFrame(rows, "review_id long, product_id string, review_text string")
    got = {r.review_id: (r.avg_text_similarity, r.max_text_similarity, r.similar_review_count) for r in text_similarity(df).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), (k, rows[k])
