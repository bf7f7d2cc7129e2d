"""The operators applied to whole tables as named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.llm import ctw, decontamination, iblt, kneser_ney, language, mixing, packing, pii, repetition, secrets, simhash, spelling, whitening
from candor.llm.common import crc_mod, documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    net = language.train_on(docs, crc_mod("doc_id", 3) != 1)
    return language.predict(docs, net).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(documents(spark, sf_dir))


def op5_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(documents(spark, sf_dir))


def op6_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source")).repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality(documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.digest(decontamination.contamination(documents(spark, sf_dir), items))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_iblt": op4_iblt,
    "op5_ctw": op5_ctw,
    "op6_curriculum": op6_curriculum,
    "op7_packing": op7_packing,
    "op8_repetition": op8_repetition,
    "op9_secrets": op9_secrets,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_wu_manber": op11_wu_manber,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}

#: Targets by recursion-free water level, prefix sums by plain windows: the same arithmetic in the same order.
_OP6 = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST([5, 2, 1][(place - 1) % 3 + 1] AS DOUBLE) AS weight, [1.5, 1.0, 0.5][(place - 1) % 3 + 1]::DOUBLE AS a,
             [0.5, 1.0, 1.5][(place - 1) % 3 + 1]::DOUBLE AS b, CAST(source_size * 2 AS DOUBLE) AS cap
      FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s)),
l AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS demand, sum(cap) OVER w - cap AS capped,
             sum(weight) OVER () - sum(weight) OVER w + weight AS open FROM r WINDOW w AS (ORDER BY cap / weight, place)),
t AS (SELECT *, coalesce(least(cap, (SELECT (x.demand - x.capped) / x.open FROM l x WHERE (x.demand - x.capped) / x.open <= x.cap / x.weight
             ORDER BY x.cap / x.weight, x.place LIMIT 1) * weight), cap) AS target FROM l),
g AS (SELECT sum(target * a) AS ga, sum(target * (b - a)) AS gb FROM t),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.b, g.ga, g.gb,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
             CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN g),
q AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - start)) AS rest FROM p),
w AS (SELECT *, CASE WHEN passes > 0 THEN size WHEN passes = 0 THEN rest ELSE 0 END AS first_words,
             CASE WHEN passes > 1 THEN size WHEN passes = 1 THEN rest ELSE 0 END AS second_words,
             start / target AS u1, (start + source_size) / target AS u2 FROM q),
z AS (SELECT *, CASE WHEN first_words > 0 THEN 2 * u1 / (a + sqrt(a * a + 2 * (b - a) * u1)) END AS t1,
             CASE WHEN second_words > 0 THEN 2 * u2 / (a + sqrt(a * a + 2 * (b - a) * u2)) END AS t2 FROM w)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(first_words + second_words AS BIGINT) AS taken, CAST(first_words AS BIGINT) AS first_words,
       CAST(second_words AS BIGINT) AS second_words, round(ga * t1 + gb * t1 * t1 / 2, 3) AS first_position,
       round(ga * t2 + gb * t2 * t2 / 2, 3) AS second_position FROM z
"""

#: Windows of items joined with windows of documents of the same length; hit words are the union of their places.
_OP11 = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
v AS (SELECT DISTINCT item, m, array_to_string(words[k : k + m - 1], ' ') AS win
      FROM (SELECT item, words, least(10, len(words)) AS m, unnest(generate_series(1, len(words) - least(10, len(words)) + 1)) AS k FROM i WHERE len(words) > 0)),
d AS (SELECT r, m, k, array_to_string(words[k : k + m - 1], ' ') AS win
      FROM (SELECT r, m, words, unnest(generate_series(1, len(words) - m + 1)) AS k FROM w, (SELECT DISTINCT m FROM v) WHERE len(words) >= m)),
h AS (SELECT d.r, d.k, d.m, v.item FROM d JOIN v ON d.m = v.m AND d.win = v.win),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + m - 1)) AS p FROM h) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (r) LEFT JOIN g USING (r)
"""

#: CRC-32 byte by byte; near words by their texts with one letter left out; forms followed recursively.
_OP13 = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
         WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT run, k, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS b FROM runs),
hashed AS MATERIALIZED (SELECT run, k, xor(list_reduce([4294967295] || list_transform(b, lambda x: CAST(x AS BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, crc),
mutated AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM mutated WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near,
         CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
steps AS (SELECT word, word AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s USING (word) JOIN forms e ON e.word = s.root WHERE e.form IS NULL
"""

ORACLE: dict[str, str] = {"op6_curriculum": _OP6, "op11_wu_manber": _OP11, "op13_spelling": _OP13}
