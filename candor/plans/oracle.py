"""SQL counterparts of the queries, written independently of the operators: plain joins, windows and brute force."""

from __future__ import annotations

from candor.functions import lexicons as lex
from candor.sources.views import VIEWS

WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


#: Read by several others, so DuckDB is told to compute them once.
SHARED = {
    "edges", "deg", "pairs", "bad_users", "bad_products", "co", "up", "corners", "clus", "points", "one_way", "links", "looped", "pivots", "levels",
}


def _recursive(prefix: str) -> str:
    return prefix.replace("WITH ", "WITH RECURSIVE ", 1)


def _with(*names: str, **ctes: str) -> str:
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({sql})" for n, sql in ctes.items()]
    return "WITH " + ", ".join(parts) + " "


def _round(sql: str, *columns: str, prefix: str = "") -> str:
    """Round the named columns of a query to six places, nudged off exact halves like the queries."""
    replace = ", ".join(f"round({c} + CAST(1e-9 AS DOUBLE), 6) + 0.0 AS {c}" for c in columns)
    return f"{prefix}SELECT * REPLACE ({replace}) FROM ({sql}) AS q"


def _edges(source: str) -> str:
    return (
        "SELECT user_id, product_id, rating, date, review_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, "
        "product_id ORDER BY (date IS NULL) DESC, date DESC, review_id DESC) AS rn FROM " + source + ") AS r WHERE rn = 1"
    )


def _days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS DOUBLE)"


# --- text building blocks -------------------------------------------------------------------------

T = "coalesce(review_text, '')"
CLEAN = (
    f"trim(regexp_replace(translate(regexp_replace(regexp_replace(lower({T}), 'http[^{WS}]+|www[^{WS}]+', '', 'g'), "
    f"'<.*?>', '', 'g'), '{lex.ASCII_PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''), '[{WS}]+', ' ', 'g'))"
)
_FUSED = " ".join(f"WHEN '{w}' THEN ['{a}', '{b}']" for w, (a, b) in lex.FUSED_WORDS.items())
ALL_WORDS = (
    f"flatten([CASE w {_FUSED} ELSE [w] END for w in string_split(regexp_replace({CLEAN}, "
    r"'([«“‘„»”’])', ' \1 ', 'g'), ' ') if w <> ''])"
)
WORDS = f"[w for w in {ALL_WORDS} if w NOT IN ({_quoted(lex.STOP_WORDS)})]"
RAW_TOKENS = rf"regexp_extract_all(lower({T}), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]')"
TERMS = (
    r"[w for w in regexp_extract_all(lower(" + T + r"), '[\p{L}\p{N}_]{2,}') "
    f"if w NOT IN ({_quoted(lex.STOP_WORDS)})]"
)


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _hits(words: str, lexicon) -> str:
    return f"len([w for w in {words} if w IN ({_quoted(lexicon)})])"


def _grams(words: str, n: int) -> str:
    return f"[list_aggregate({words}[i : i + {n - 1}], 'string_agg', ' ') for i in range(1, len({words}) - {n - 2})]"


def _ranked_items(source: str, items: str, k: int, out: str) -> str:
    """Per review the k most frequent list entries, ties by first position, as text."""
    return (
        f"SELECT review_id, string_agg(g || ':' || n, '|' ORDER BY rk) AS {out} FROM (SELECT review_id, g, n, row_number() OVER "
        "(PARTITION BY review_id ORDER BY n DESC, pos) AS rk FROM (SELECT review_id, g, count(*) AS n, min(i) AS pos FROM "
        f"(SELECT review_id, unnest({items}) AS g, generate_subscripts({items}, 1) AS i FROM {source}) AS a GROUP BY review_id, g) AS b) AS c "
        f"WHERE rk <= {k} GROUP BY review_id"
    )


TEXT_KEEP = "review_id, user_id, product_id, rating, date"

STATS = f"""
len({T}) AS char_count, len(w) AS word_count,
len(array_to_string(w, '')) / CAST(greatest(len(w), 1) AS DOUBLE) AS avg_word_length,
{_count(T, '!')} AS exclamation_count, {_count(T, '[?]')} AS question_count,
{_count(T, chr(92) + 'p{Lu}')} / CAST(greatest(len({T}), 1) AS DOUBLE) AS uppercase_ratio,
{_count(T, chr(92) + 'p{Nd}')} / CAST(greatest(len({T}), 1) AS DOUBLE) AS digit_ratio,
len(list_distinct(w)) / CAST(greatest(len(w), 1) AS DOUBLE) AS unique_words_ratio
"""
SENTIMENT = f"""
CAST({_hits('s', lex.POSITIVE_WORDS)} AS DOUBLE) AS positive_word_count,
CAST({_hits('s', lex.NEGATIVE_WORDS)} AS DOUBLE) AS negative_word_count,
({_hits('s', lex.POSITIVE_WORDS)} - {_hits('s', lex.NEGATIVE_WORDS)}) / CAST(greatest(len(s), 1) AS DOUBLE) AS sentiment_score,
CAST({_hits('s', lex.EXAGGERATED_WORDS)} AS DOUBLE) AS exaggerated_word_count,
{_hits('s', lex.EXAGGERATED_WORDS)} / CAST(greatest(len(s), 1) AS DOUBLE) AS exaggeration_ratio
"""
_LW = rf"regexp_extract_all(lower({T}), '[\p{{L}}\p{{N}}_]+')"
_PUNCT = "".join("\\" + c for c in lex.COUNTED_PUNCTUATION)
LINGUISTIC = f"""
len(array_to_string({_LW}, '')) / CAST(greatest(len({_LW}), 1) AS DOUBLE) AS avg_word_length,
len({_LW}) / CAST(greatest(len([x for x in regexp_split_to_array({T}, '[.!?]+') if regexp_matches(x, '[^{WS}]')]), 1) AS DOUBLE)
  AS avg_sentence_length,
{_count(T, chr(92) + 'p{Lu}')} / CAST(greatest(len({T}), 1) AS DOUBLE) AS uppercase_ratio,
{_count(T, '[' + _PUNCT + ']')} / CAST(greatest(len({T}), 1) AS DOUBLE) AS punctuation_ratio,
{_count(T, '!')} / CAST(greatest(len({T}), 1) AS DOUBLE) AS exclamation_ratio,
{_count(T, '[?]')} / CAST(greatest(len({T}), 1) AS DOUBLE) AS question_ratio
"""
SENTIMENT_COLS = ["positive_word_count", "negative_word_count", "sentiment_score", "exaggerated_word_count", "exaggeration_ratio"]
LINGUISTIC_COLS = ["avg_word_length", "avg_sentence_length", "uppercase_ratio", "punctuation_ratio", "exclamation_ratio", "question_ratio"]
SIM_COLS = ["avg_text_similarity", "max_text_similarity", "similar_review_count"]


def _similarity(group: str, p: str) -> dict[str, str]:
    """CTEs for all pairwise similarities in a group; ``p`` prefixes their names."""
    return {
        f"{p}terms": f"SELECT {group} AS g, review_id AS d, unnest({TERMS}) AS term FROM text_reviews_v",
        f"{p}tf": f"SELECT g, d, term, count(*) AS tf FROM {p}terms GROUP BY g, d, term",
        f"{p}n": f"SELECT {group} AS g, count(*) AS n FROM text_reviews_v GROUP BY 1",
        f"{p}df": f"SELECT g, term, count(*) AS df FROM {p}tf GROUP BY g, term",
        f"{p}raw": f"SELECT t.g, t.d, t.term, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM {p}tf t "
        f"JOIN {p}df f ON t.g = f.g AND t.term = f.term JOIN {p}n c ON c.g = t.g",
        f"{p}vec": f"SELECT g, d, term, w / sqrt(sum(w * w) OVER (PARTITION BY g, d)) AS w FROM {p}raw",
        f"{p}sim": f"SELECT a.g, a.d, sum(a.w * b.w) AS s FROM {p}vec a JOIN {p}vec b ON a.g = b.g AND a.term = b.term AND a.d <> b.d "
        "GROUP BY a.g, a.d, b.d",
        f"{p}agg": f"SELECT g, d, sum(s) AS total, max(s) AS best, count(CASE WHEN s >= 0.7 - 1e-9 THEN 1 END) AS near FROM {p}sim GROUP BY g, d",
        f"{p}out": f"SELECT r.review_id, r.{group}, CASE WHEN n > 1 THEN coalesce(total, 0) / (n - 1) ELSE 0.0 END AS avg_text_similarity, "
        f"coalesce(best, 0.0) AS max_text_similarity, coalesce(near, 0) AS similar_review_count FROM text_reviews_v r "
        f"JOIN {p}n c ON c.g = r.{group} LEFT JOIN {p}agg a ON a.g = r.{group} AND a.d = r.review_id",
    }


# --- pairs and groups -----------------------------------------------------------------------------

USER_PAIRS = {
    "edges": _edges("rings_v"),
    "uprof": "SELECT user_id, count(*) AS size, string_agg(product_id || '=' || rating, ',' ORDER BY product_id) AS k FROM edges GROUP BY user_id",
    "umem": "SELECT user_id, size, min(user_id) OVER (PARTITION BY k) AS profile, count(*) OVER (PARTITION BY k) AS members FROM uprof",
    # All pairs of users; the profiles only name them.
    "upair": "SELECT a.user_id AS a, b.user_id AS b, count(*) AS shared, count(*) / CAST(x.size + y.size - count(*) AS DOUBLE) AS jaccard, "
    "avg(1.0 - abs(a.rating - b.rating) / 5.0) AS rating_similarity FROM edges a JOIN edges b ON a.product_id = b.product_id AND a.user_id < b.user_id "
    "JOIN uprof x ON x.user_id = a.user_id JOIN uprof y ON y.user_id = b.user_id GROUP BY a.user_id, b.user_id, x.size, y.size",
    "usim": "SELECT user_1, user_2, members_1, members_2, min(shared) AS shared, min(jaccard) AS jaccard, min(rating_similarity) AS rating_similarity, "
    "min((jaccard + rating_similarity) / 2) AS similarity FROM (SELECT p.*, least(x.profile, y.profile) AS user_1, greatest(x.profile, y.profile) AS user_2, "
    "CASE WHEN x.profile <= y.profile THEN x.members ELSE y.members END AS members_1, "
    "CASE WHEN x.profile <= y.profile THEN y.members ELSE x.members END AS members_2 FROM upair p JOIN umem x ON x.user_id = a JOIN umem y ON y.user_id = b "
    "WHERE (jaccard + rating_similarity) / 2 >= 0.7) AS q GROUP BY ALL_KEYS",
}
USER_PAIRS["usim"] = USER_PAIRS["usim"].replace("ALL_KEYS", "user_1, user_2, members_1, members_2")
# Independent of profiles: all pairs of users.
SUSPICIOUS_USERS = {
    "edges": _edges("rings_v"),
    "deg": "SELECT user_id, count(*) AS d FROM edges GROUP BY user_id",
    "pairs": "SELECT a.user_id AS a, b.user_id AS b FROM edges a JOIN edges b ON a.product_id = b.product_id AND a.user_id < b.user_id "
    "JOIN deg x ON x.user_id = a.user_id JOIN deg y ON y.user_id = b.user_id GROUP BY a.user_id, b.user_id, x.d, y.d "
    "HAVING (count(*) / CAST(x.d + y.d - count(*) AS DOUBLE) + avg(1.0 - abs(a.rating - b.rating) / 5.0)) / 2 >= 0.7",
    "bad_users": "SELECT a AS user_id FROM pairs UNION SELECT b FROM pairs",
    "bad_products": "SELECT product_id, count(*) AS review_count, avg(rating) AS avg_rating, var_pop(rating) AS rating_variance, "
    "avg(CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END) AS high_rating_pct FROM edges GROUP BY product_id HAVING count(*) >= 5 "
    "AND avg(rating) >= 4.5 AND var_pop(rating) < 0.5 AND avg(CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END) >= 0.8",
}
PRODUCT_PAIRS = {
    "edges": _edges("rings_v"),
    "deg": "SELECT product_id, count(*) AS d FROM edges GROUP BY product_id",
    "pairs": "SELECT a.product_id AS a, b.product_id AS b, count(*) AS shared, count(*) / CAST(x.d + y.d - count(*) AS DOUBLE) AS jaccard "
    "FROM edges a JOIN edges b ON a.user_id = b.user_id AND a.product_id < b.product_id "
    "JOIN deg x ON x.product_id = a.product_id JOIN deg y ON y.product_id = b.product_id GROUP BY a.product_id, b.product_id, x.d, y.d "
    "HAVING count(*) >= 3 AND count(*) / CAST(x.d + y.d - count(*) AS DOUBLE) >= 0.7",
}
PRODUCT_PROFILES = {
    "edges": _edges("rings_v"),
    "pprof": "SELECT product_id, count(*) AS size, string_agg(user_id, ',' ORDER BY user_id) AS k FROM edges GROUP BY product_id",
    "pmem": "SELECT product_id, size, min(product_id) OVER (PARTITION BY k) AS profile, count(*) OVER (PARTITION BY k) AS members FROM pprof",
}


def _closure(key: str) -> str:
    """Groups as the smallest node reachable over ``pairs(a, b)``."""
    return (
        "both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), "
        "reach AS (SELECT DISTINCT a AS n, a AS r FROM both_ways UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r) "
        f"SELECT min(r) AS group_id, n AS {key} FROM reach GROUP BY n"
    )


# --- centralities: power iteration and breadth-first waves as recursive queries ---------------------------------

CENTRAL = {
    "points": "SELECT kind, id, CAST(row_number() OVER (ORDER BY kind, id) AS INTEGER) AS node FROM (SELECT DISTINCT 'user' AS kind, user_id AS id FROM edges "
    "UNION ALL SELECT DISTINCT 'product', product_id FROM edges) AS x",
    "one_way": "SELECT u.node AS src, p.node AS dst FROM edges JOIN points u ON u.kind = 'user' AND u.id = user_id JOIN points p ON p.kind = 'product' AND p.id = product_id",
    "links": "SELECT src, dst FROM one_way UNION ALL SELECT dst, src FROM one_way",
}
EIGEN = {
    "looped": "SELECT src, dst FROM links UNION ALL SELECT node, node FROM points",
    "power": "SELECT node, 1 / CAST(count(*) OVER () AS DOUBLE) AS x, 0 AS it, false AS done FROM points UNION ALL "
    "SELECT node, x, it, sum(abs(x - prev)) OVER () < 1e-6 * sum(x) OVER () FROM (SELECT node, y / sqrt(sum(y * y) OVER ()) AS x, prev, it FROM ("
    "SELECT l.dst AS node, sum(p.x) AS y, max(CASE WHEN l.src = l.dst THEN p.x END) AS prev, max(p.it) + 1 AS it "
    "FROM power p JOIN looped l ON l.src = p.node WHERE NOT p.done GROUP BY l.dst) AS a) AS b",
    "eigen": "SELECT kind, id, x AS centrality, true AS converged FROM power JOIN points USING (node) WHERE done",
}
BETWEEN = {
    "pivots": "SELECT node FROM points ORDER BY md5(kind || ':' || id) LIMIT 50",
    "waves": "SELECT node AS origin, node, 0 AS level, CAST(1 AS DOUBLE) AS paths, true AS fresh FROM pivots UNION ALL (SELECT s.origin, s.node, s.level, s.paths, true FROM ("
    "SELECT w.origin, l.dst AS node, w.level + 1 AS level, sum(w.paths) AS paths FROM waves w JOIN links l ON l.src = w.node WHERE w.fresh GROUP BY 1, 2, 3) s "
    "WHERE NOT EXISTS (SELECT 1 FROM waves o WHERE NOT o.fresh AND o.origin = s.origin AND o.node = s.node) "
    "UNION ALL SELECT origin, node, level, paths, false FROM waves WHERE fresh)",
    "levels": "SELECT origin, node, level, paths FROM waves WHERE fresh",
    "back": "SELECT origin, node, level, paths, CAST(0 AS DOUBLE) AS dep FROM levels WHERE level = (SELECT max(level) FROM levels) UNION ALL "
    "SELECT v.origin, v.node, v.level, v.paths, v.paths * coalesce(c.share, 0) FROM levels v JOIN (SELECT max(level) AS level FROM back) t ON v.level = t.level - 1 "
    "LEFT JOIN (SELECT b.origin, l.src AS node, sum((1 + b.dep) / b.paths) AS share FROM back b JOIN links l ON l.dst = b.node GROUP BY 1, 2) c "
    "ON c.origin = v.origin AND c.node = v.node",
    "between": "SELECT kind, id, coalesce(s, 0) * n / least(50, n) / ((n - 1.0) * (n - 2.0)) AS betweenness FROM points LEFT JOIN (SELECT node, sum(dep) AS s FROM back WHERE level > 0 GROUP BY node) "
    "AS d USING (node), (SELECT CAST(count(*) AS DOUBLE) AS n FROM points) AS c",
}


def _coreview(source: str) -> dict[str, str]:
    return {
        "edges": _edges(source),
        "deg": "SELECT user_id, count(*) AS d FROM edges GROUP BY user_id",
        "co": "SELECT a.user_id AS u, b.user_id AS v, count(*) AS c FROM edges a JOIN edges b ON a.product_id = b.product_id "
        "AND a.user_id <> b.user_id GROUP BY a.user_id, b.user_id",
    }


SIM_STATS = (
    "SELECT e.user_id, coalesce(s.a, 0.0) AS avg_user_similarity, coalesce(s.m, 0.0) AS max_user_similarity, "
    "CAST(coalesce(s.n, 0) AS DOUBLE) AS similar_user_count FROM deg e LEFT JOIN (SELECT u, avg(c / CAST(x.d + y.d - c AS DOUBLE)) AS a, "
    "max(c / CAST(x.d + y.d - c AS DOUBLE)) AS m, count(*) AS n FROM co JOIN deg x ON x.user_id = u JOIN deg y ON y.user_id = v GROUP BY u) s "
    "ON s.u = e.user_id"
)
# Every triangle once, from its smallest corner.
CLUSTERING = {
    "up": "SELECT u, v FROM co WHERE u < v",
    "tri": "SELECT x.u AS a, x.v AS b, y.v AS c FROM up x JOIN up y ON x.u = y.u AND x.v < y.v JOIN up z ON z.u = x.v AND z.v = y.v",
    "corner": "SELECT a AS n, count(*) AS t FROM tri GROUP BY a UNION ALL SELECT b, count(*) FROM tri GROUP BY b UNION ALL SELECT c, count(*) FROM tri GROUP BY c",
    "corners": "SELECT n, sum(t) AS t FROM corner GROUP BY n",
    "nbr": "SELECT u, count(*) AS d FROM co GROUP BY u",
    "clus": "SELECT deg.user_id, CASE WHEN nbr.d >= 2 THEN 2.0 * coalesce(t, 0) / (nbr.d * (nbr.d - 1.0)) ELSE 0.0 END AS user_clustering "
    "FROM deg LEFT JOIN nbr ON nbr.u = deg.user_id LEFT JOIN corners ON n = deg.user_id",
}

USER_AGG = (
    "SELECT user_id, count(*) AS user_review_count, count(DISTINCT product_id) AS user_product_count, avg(rating) AS user_avg_rating, "
    "var_samp(rating) AS user_rating_variance, nullif(sum(CASE WHEN rating IN (1, 5) THEN 1 ELSE 0 END), 0) / CAST(count(*) AS DOUBLE) "
    "AS user_extreme_rating_pct, nullif(sum(CASE WHEN verified_purchase THEN 1 ELSE 0 END), 0) / CAST(count(*) AS DOUBLE) AS user_verified_ratio "
    "FROM {v} GROUP BY user_id"
)
PRODUCT_AGG = (
    "SELECT product_id, count(*) AS product_review_count, count(DISTINCT user_id) AS product_user_count, avg(rating) AS product_avg_rating, "
    "var_samp(rating) AS product_rating_variance, nullif(sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END), 0) / CAST(count(*) AS DOUBLE) "
    "AS product_high_rating_pct FROM {v} GROUP BY product_id"
)


def _bursts(view: str, key: str) -> str:
    return (
        f"SELECT {key}, count(*) AS n_reviews, count(CASE WHEN gap <= 7 THEN 1 END) AS max_burst, "
        f"count(CASE WHEN gap <= 7 THEN 1 END) / CAST(count(*) AS DOUBLE) AS burstiness_score FROM "
        f"(SELECT {key}, (epoch_us(date) - epoch_us(lag(date) OVER (PARTITION BY {key} ORDER BY date))) / 86400000000.0 AS gap FROM {view}) AS g "
        f"GROUP BY {key}"
    )


def _entropy(view: str, part: str, out: str) -> str:
    return (
        f"SELECT user_id, abs(-sum(p * log2(p))) AS {out} FROM (SELECT user_id, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS p "
        f"FROM {view} WHERE date IS NOT NULL GROUP BY user_id, {part}) AS x GROUP BY user_id"
    )


MONDAY_ZERO = "isodow(date) - 1"


def _entropies(view: str) -> str:
    return (
        f"SELECT n.user_id, CASE WHEN n.n > 1 THEN hour_entropy END AS hour_entropy, CASE WHEN n.n > 1 THEN day_entropy END AS day_entropy "
        f"FROM (SELECT user_id, count(*) AS n FROM {view} GROUP BY user_id) n JOIN ({_entropy(view, 'hour(date)', 'hour_entropy')}) h "
        f"ON h.user_id = n.user_id JOIN ({_entropy(view, MONDAY_ZERO, 'day_entropy')}) d ON d.user_id = n.user_id"
    )


DIRTY = (
    "SELECT * REPLACE (CASE WHEN review_id % 11 = 0 THEN NULL WHEN review_id % 13 = 0 THEN NULL ELSE rating END AS rating) FROM {v}"
)
DEDUP = (
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id, review_text ORDER BY review_id) AS rn FROM "
    "(SELECT * REPLACE (lang AS user_id) FROM {v}) AS a) AS b WHERE rn = 1"
)
POINTS = (
    "SELECT s AS threshold, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn "
    "FROM (SELECT {score} AS s, sum(label) AS p, sum(1 - label) AS n FROM {src} GROUP BY 1) AS t"
)
PREDICTED = (
    "SELECT *, CASE WHEN 0.6 * nlp_probability + (1 - CAST(0.6 AS DOUBLE)) * graph_probability >= 0.5 THEN 1 ELSE 0 END AS predicted FROM scores_v"
)
CELLS = (
    "SELECT CAST(count(CASE WHEN label = 0 AND predicted = 0 THEN 1 END) AS DOUBLE) AS tn, CAST(count(CASE WHEN label = 0 AND predicted = 1 THEN 1 END) AS DOUBLE) AS fp, "
    "CAST(count(CASE WHEN label = 1 AND predicted = 0 THEN 1 END) AS DOUBLE) AS fn, CAST(count(CASE WHEN label = 1 AND predicted = 1 THEN 1 END) AS DOUBLE) AS tp FROM pred"
)


def _per_class() -> dict[str, str]:
    return {
        "pred": PREDICTED,
        "cells": CELLS,
        "per": "SELECT '0' AS name, tn / nullif(tn + fn, 0) AS p, tn / nullif(tn + fp, 0) AS r, tn + fp AS s FROM cells "
        "UNION ALL SELECT '1', tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0), tp + fn FROM cells",
        "pc": "SELECT name, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f, s FROM per",
        "acc": "SELECT (tn + tp) / (tn + fp + fn + tp) AS a, tn + fp + fn + tp AS s FROM cells",
    }


WEIGHTS = (
    "SELECT w, sum(neg * (above + pos / 2.0)) / CAST(max(pp) * max(nn) AS DOUBLE) AS auc FROM (SELECT w, pos, neg, "
    "sum(pos) OVER (PARTITION BY w ORDER BY s DESC) - pos AS above, sum(pos) OVER (PARTITION BY w) AS pp, sum(neg) OVER (PARTITION BY w) AS nn "
    "FROM (SELECT w, w * nlp_probability + (1 - w) * graph_probability AS s, sum(label) AS pos, sum(1 - label) AS neg "
    "FROM scores_v CROSS JOIN (SELECT i * CAST(0.1 AS DOUBLE) AS w FROM range(11) AS t(i)) AS g GROUP BY 1, 2) AS b) AS c GROUP BY w"
)


def _flags(source_cte: str = "rings_v") -> str:
    return (
        "SELECT r.*, u.user_id IS NOT NULL AS is_suspicious_user, p.product_id IS NOT NULL AS is_suspicious_product, "
        "(u.user_id IS NOT NULL OR p.product_id IS NOT NULL) AS is_suspicious "
        f"FROM {source_cte} r LEFT JOIN bad_users u ON u.user_id = r.user_id LEFT JOIN bad_products p ON p.product_id = r.product_id"
    )


def _meta_join(kind: str, age: str, flag: str | None, limit: int) -> str:
    if kind == "user":
        cols = (
            "m.join_date, m.review_count AS user_meta_review_count, m.avg_rating AS user_meta_avg_rating, m.verified_purchases, "
            + _days("r.date", "m.join_date") + f" AS {age}"
        )
        diff, src, key = _days("r.date", "m.join_date"), "users_v", "user_id"
    else:
        cols = (
            "m.product_name, m.category, m.price, m.avg_rating AS product_meta_avg_rating, m.review_count AS product_meta_review_count, "
            "m.listing_date, " + _days("r.date", "m.listing_date") + f" AS {age}"
        )
        diff, src, key = _days("r.date", "m.listing_date"), "products_v", "product_id"
    flagged = f", coalesce({diff} <= {limit}, false) AS {flag}" if flag else ""
    sql = f"SELECT r.*, {cols}{flagged} FROM reviews_v r LEFT JOIN {src} m ON m.{key} = r.{key}"
    rounded = ["rating", age] + (["user_meta_avg_rating"] if kind == "user" else ["price", "product_meta_avg_rating"])
    return _round(sql, *rounded, prefix=_with("reviews_v", src))


def oracle_sql() -> dict[str, str]:
    reviews, texts, rings, market = _with("reviews_v"), _with("text_reviews_v"), _with("rings_v"), _with("market_v")
    text_words = _with(
        "text_reviews_v",
        tw=f"SELECT *, {ALL_WORDS} AS w FROM text_reviews_v",
        ts=f"SELECT *, [x for x in w if x NOT IN ({_quoted(lex.STOP_WORDS)})] AS s FROM tw",
    )
    sus = _with("rings_v", **SUSPICIOUS_USERS)
    out: dict[str, str] = {}

    # scans
    out["scan_reviews"] = reviews + "SELECT * FROM reviews_v"
    out["scan_users"] = _round("SELECT * FROM users_v", "avg_rating", prefix=_with("users_v"))
    out["scan_products"] = _round("SELECT * FROM products_v WHERE listing_date IS NOT NULL", "price", "avg_rating", prefix=_with("products_v"))

    # cleaning, filters, flags
    out["clean_dropna"] = texts + f"SELECT {TEXT_KEEP} FROM text_reviews_v WHERE user_id IS NOT NULL AND product_id IS NOT NULL AND review_text IS NOT NULL"
    out["clean_dedup"] = texts + f"SELECT {TEXT_KEEP} FROM ({DEDUP.format(v='text_reviews_v')}) AS q"
    out["clean_rating"] = texts + f"SELECT {TEXT_KEEP} FROM ({DIRTY.format(v='text_reviews_v')}) AS q WHERE rating IS NOT NULL"
    out["clean_reviews"] = (
        _with("text_reviews_v", dirty=DIRTY.format(v="text_reviews_v"))
        + f"SELECT {TEXT_KEEP} FROM ({DEDUP.format(v='dirty')}) AS q WHERE rating IS NOT NULL AND review_text IS NOT NULL"
    )
    out["filter_reviews"] = reviews + "SELECT * FROM reviews_v WHERE NOT verified_purchase"
    out["filter_reviews_user"] = reviews + "SELECT * FROM reviews_v WHERE user_id = 'u7'"
    out["filter_reviews_product"] = reviews + "SELECT * FROM reviews_v WHERE product_id = 'p7'"
    out["sample_reviews"] = reviews + "SELECT * FROM reviews_v ORDER BY md5(review_id || '|42'), review_id LIMIT 100"
    out["flag_threshold"] = _round(
        "SELECT *, nlp_probability >= 0.7 AS is_suspicious, CASE WHEN nlp_probability >= 0.5 THEN 1 ELSE 0 END AS predicted_fake FROM scores_v",
        "nlp_probability", "graph_probability", prefix=_with("scores_v"),
    )
    out["risk_band"] = _round(
        "SELECT *, round(100 - nlp_probability * 100, 1) AS authenticity, CASE WHEN nlp_probability >= 0.8 THEN 'Highly Suspicious' "
        "WHEN nlp_probability >= 0.6 THEN 'Somewhat Suspicious' ELSE 'Likely Authentic' END AS result FROM scores_v",
        "nlp_probability", "graph_probability", "authenticity", prefix=_with("scores_v"),
    )
    out["align_features"] = reviews + "SELECT review_id, coalesce(rating, 0.0) AS rating, CAST(0 AS DOUBLE) AS price, CAST(0 AS DOUBLE) AS helpful_votes, CAST(0 AS DOUBLE) AS label FROM reviews_v"
    out["label"] = reviews + "SELECT review_id, CAST(CASE WHEN verified_purchase THEN 0 ELSE 1 END AS DOUBLE) AS label FROM reviews_v"
    out["stratified_split"] = reviews + (
        "SELECT review_id, verified_purchase, CASE WHEN row_number() OVER (PARTITION BY verified_purchase ORDER BY md5(review_id || '|42')) "
        "<= floor(0.2 * count(*) OVER (PARTITION BY verified_purchase) + 1e-9) THEN 'test' ELSE 'train' END AS split FROM reviews_v"
    )

    # metadata joins
    out["join_user_meta"] = _meta_join("user", "days_since_joining", "is_new_account_review", 7)
    out["join_product_meta"] = _meta_join("product", "days_since_listing", None, 0)
    out["account_age"] = _meta_join("user", "account_age_days", "is_suspicious_new_account", 7)
    out["product_age"] = _meta_join("product", "product_age_days", "is_suspicious_early_review", 3)
    meta_cols = (
        "coalesce(CAST(u.review_count AS DOUBLE), 0.0) AS user_review_count, coalesce(u.avg_rating, 0.0) AS user_avg_rating, "
        "coalesce(CASE WHEN u.review_count > 0 THEN u.verified_purchases / CAST(u.review_count AS DOUBLE) ELSE 0.0 END, 0.0) AS user_verified_ratio, "
        "coalesce(p.avg_rating, 0.0) AS product_avg_rating, coalesce(CAST(p.review_count AS DOUBLE), 0.0) AS product_review_count"
    )
    out["metadata_features"] = _round(
        f"SELECT r.*, {meta_cols} FROM reviews_v r LEFT JOIN users_v u ON u.user_id = r.user_id LEFT JOIN products_v p ON p.product_id = r.product_id",
        "user_avg_rating", "user_verified_ratio", "product_avg_rating", prefix=_with("reviews_v", "users_v", "products_v"),
    )

    # behaviour
    same_user = "count(*) OVER (PARTITION BY user_id, CAST(date AS DATE))"
    same_product = "count(*) OVER (PARTITION BY product_id, CAST(date AS DATE))"
    out["daily_review_count"] = reviews + f"SELECT *, {same_user} AS daily_review_count FROM reviews_v"
    out["same_day_counts"] = reviews + (
        f"SELECT *, {same_user} AS same_day_review_count, {same_product} AS product_same_day_review_count FROM reviews_v"
    )
    out["calendar_parts"] = _with("events_v") + (
        f"SELECT *, hour(date) AS hour_of_day, {MONDAY_ZERO} AS day_of_week, month(date) AS month, year(date) AS year FROM events_v"
    )
    for key in ("user", "product"):
        out[f"{key}_burstiness"] = _round(_bursts("reviews_v", f"{key}_id"), "burstiness_score", prefix=reviews)
    out["burst_intervals"] = _round(
        "SELECT user_id, date, gap AS interval_days, count(*) AS interval_count FROM (SELECT user_id, date, (epoch_us(date) - "
        "epoch_us(lag(date) OVER (PARTITION BY user_id ORDER BY date))) / 86400000000.0 AS gap FROM events_v) AS g WHERE gap <= 7 GROUP BY 1, 2, 3",
        "interval_days", prefix=_with("events_v"),
    )
    out["posting_entropy"] = _round(_entropies("events_v"), "hour_entropy", "day_entropy", prefix=_with("events_v"))
    user_agg, product_agg = USER_AGG.format(v="reviews_v"), PRODUCT_AGG.format(v="reviews_v")
    out["user_behavior"] = _round(
        "SELECT r.*, user_review_count, user_product_count, user_avg_rating, user_rating_variance, user_extreme_rating_pct, "
        f"abs(rating - user_avg_rating) AS rating_deviation FROM reviews_v r JOIN ({user_agg}) u ON u.user_id = r.user_id",
        "user_avg_rating", "user_rating_variance", "user_extreme_rating_pct", "rating_deviation", prefix=reviews,
    )
    out["product_behavior"] = _round(
        "SELECT r.*, product_review_count, product_user_count, product_avg_rating, product_rating_variance, product_high_rating_pct, "
        f"abs(rating - product_avg_rating) AS product_rating_deviation FROM reviews_v r JOIN ({product_agg}) u ON u.product_id = r.product_id",
        "product_avg_rating", "product_rating_variance", "product_high_rating_pct", "product_rating_deviation", prefix=reviews,
    )
    out["user_verified_ratio"] = _round(
        f"SELECT r.*, user_verified_ratio FROM reviews_v r JOIN ({user_agg}) u ON u.user_id = r.user_id", "user_verified_ratio", prefix=reviews
    )
    combined = (
        "SELECT r.*, user_review_count, user_product_count, user_avg_rating, user_rating_variance, user_extreme_rating_pct, user_verified_ratio, "
        "ub.burstiness_score AS user_burstiness_score, ub.max_burst AS max_user_burst, hour_entropy, day_entropy, user_degree, "
        "user_neighbors_avg_degree, user_clustering, product_review_count, product_user_count, product_avg_rating, product_rating_variance, "
        "product_high_rating_pct, pb.burstiness_score AS product_burstiness_score, pb.max_burst AS max_product_burst, product_degree, "
        f"hour(date) AS hour_of_day, {MONDAY_ZERO} AS day_of_week, abs(rating - user_avg_rating) AS rating_deviation, "
        "abs(rating - product_avg_rating) AS product_rating_deviation, m.product_name, m.category, m.price, "
        "m.avg_rating AS product_meta_avg_rating, m.review_count AS product_meta_review_count, m.listing_date, "
        + _days("r.date", "m.listing_date") + " AS product_age_days, coalesce(" + _days("r.date", "m.listing_date")
        + " <= 3, false) AS is_suspicious_early_review, j.join_date, j.review_count AS user_meta_review_count, j.avg_rating AS user_meta_avg_rating, "
        "j.verified_purchases, " + _days("r.date", "j.join_date") + " AS account_age_days, coalesce(" + _days("r.date", "j.join_date")
        + " <= 7, false) AS is_suspicious_new_account FROM rings_v r "
        f"JOIN ({USER_AGG.format(v='rings_v')}) u ON u.user_id = r.user_id JOIN ({PRODUCT_AGG.format(v='rings_v')}) p ON p.product_id = r.product_id "
        f"JOIN ({_bursts('rings_v', 'user_id')}) ub ON ub.user_id = r.user_id JOIN ({_bursts('rings_v', 'product_id')}) pb ON pb.product_id = r.product_id "
        f"JOIN ({_entropies('rings_v')}) en ON en.user_id = r.user_id "
        "JOIN (SELECT user_id, count(*) AS user_degree, avg(pd) AS user_neighbors_avg_degree FROM edges JOIN (SELECT product_id AS q, count(*) AS pd "
        "FROM edges GROUP BY 1) x ON q = product_id GROUP BY user_id) ud ON ud.user_id = r.user_id "
        "JOIN (SELECT product_id, count(*) AS product_degree FROM edges GROUP BY 1) pd ON pd.product_id = r.product_id "
        "JOIN clus ON clus.user_id = r.user_id LEFT JOIN products_v m ON m.product_id = r.product_id LEFT JOIN users_v j ON j.user_id = r.user_id"
    )
    out["behavioral_features"] = _round(
        combined,
        "user_avg_rating", "user_rating_variance", "user_extreme_rating_pct", "user_verified_ratio", "user_burstiness_score", "hour_entropy",
        "day_entropy", "user_neighbors_avg_degree", "user_clustering", "product_avg_rating", "product_rating_variance", "product_high_rating_pct",
        "product_burstiness_score", "rating_deviation", "product_rating_deviation", "price", "product_meta_avg_rating", "user_meta_avg_rating",
        prefix=_with("rings_v", "products_v", "users_v", **_coreview("rings_v"), **CLUSTERING),
    )

    # reports
    out["user_product_metrics"] = _round(
        "SELECT * FROM (SELECT count(CASE WHEN n = 1 THEN 1 END) AS users_with_single_review, count(CASE WHEN n > 1 THEN 1 END) AS users_with_multiple_reviews "
        "FROM (SELECT count(*) AS n FROM reviews_v GROUP BY user_id) a) a, (SELECT count(CASE WHEN n = 1 THEN 1 END) AS products_with_single_review, "
        "count(CASE WHEN n > 1 THEN 1 END) AS products_with_multiple_reviews FROM (SELECT count(*) AS n FROM reviews_v GROUP BY product_id) b) b, "
        "(SELECT count(*) AS user_product_pairs, count(CASE WHEN n > 1 THEN 1 END) AS user_product_pairs_with_multiple_reviews "
        "FROM (SELECT count(*) AS n FROM reviews_v GROUP BY user_id, product_id) c) c, (SELECT avg(CASE WHEN " + _days("r.date", "u.join_date")
        + " <= 7 THEN 1.0 ELSE 0.0 END) AS new_user_review_percentage, avg(CASE WHEN verified_purchase THEN 1.0 ELSE 0.0 END) AS verified_purchase_percentage "
        "FROM reviews_v r LEFT JOIN users_v u ON u.user_id = r.user_id) d",
        "new_user_review_percentage", "verified_purchase_percentage", prefix=_with("reviews_v", "users_v"),
    )
    out["summary_cards"] = sus + (
        "SELECT count(*) AS total_reviews, count(CASE WHEN NOT verified_purchase THEN 1 END) AS unverified_reviews, "
        "round(count(CASE WHEN NOT verified_purchase THEN 1 END) / CAST(count(*) AS DOUBLE) * 100, 1) AS unverified_pct, "
        "(SELECT count(*) FROM bad_users) AS suspicious_users, (SELECT count(*) FROM bad_products) AS flagged_products FROM rings_v"
    )
    out["rating_distribution"] = reviews + "SELECT verified_purchase, rating, count(*) AS n FROM reviews_v GROUP BY 1, 2"
    out["verification_status"] = reviews + "SELECT verified_purchase, count(*) AS n FROM reviews_v GROUP BY 1"
    out["daily_burst_days"] = reviews + (
        "SELECT date_trunc('day', date) AS day, count(*) AS review_count, count(*) > 3 AS is_burst FROM reviews_v GROUP BY 1"
    )
    out["flag_summary"] = sus + (
        f"SELECT count(CASE WHEN is_suspicious THEN 1 END) AS suspicious, count(*) AS total FROM ({_flags()}) f"
    )
    out["network_stats"] = _round(
        "SELECT *, 2 * edges / CAST((users + products) * (users + products - 1) AS DOUBLE) AS density FROM (SELECT count(DISTINCT user_id) AS users, "
        "count(DISTINCT product_id) AS products, count(*) AS edges, (SELECT count(*) FROM bad_users) AS highlighted_users FROM edges) AS s",
        "density", prefix=sus,
    )
    out["network_nodes"] = sus + (
        "SELECT 'user' AS kind, user_id AS id, count(*) AS degree, user_id IN (SELECT user_id FROM bad_users) AS is_highlighted FROM edges GROUP BY user_id "
        "UNION ALL SELECT 'product', product_id, count(*), false FROM edges GROUP BY product_id"
    )
    out["network_edges"] = sus + (
        "SELECT user_id, product_id, rating, date, user_id IN (SELECT user_id FROM bad_users) AS is_highlighted FROM edges"
    )
    out["top_suspicious"] = sus + f"SELECT * FROM ({_flags()}) f WHERE is_suspicious ORDER BY date, review_id LIMIT 5"
    out["recent_suspicious"] = texts + (
        "SELECT review_id, user_id, product_id, rating, strftime(date, '%Y-%m-%d') AS date, left(review_text, 100) || '...' AS review_text "
        "FROM text_reviews_v WHERE NOT verified_purchase ORDER BY text_reviews_v.date DESC NULLS LAST, review_id LIMIT 10"
    )

    # review graph
    out["review_edges"] = market + _edges("market_v")
    degrees = "SELECT {k}, count(*) AS {n} FROM edges GROUP BY {k}"
    out["graph_degrees"] = _round(
        "SELECT r.*, user_degree, user_neighbors_avg_degree, product_degree FROM reviews_v r JOIN (SELECT user_id, count(*) AS user_degree, "
        "avg(product_degree) AS user_neighbors_avg_degree FROM edges e JOIN pd ON pd.product_id = e.product_id GROUP BY user_id) u ON u.user_id = r.user_id "
        "JOIN pd ON pd.product_id = r.product_id",
        "user_neighbors_avg_degree",
        prefix=_with("reviews_v", edges=_edges("reviews_v"), pd=degrees.format(k="product_id", n="product_degree")),
    )
    out["neighbor_avg_degree"] = _round(
        "SELECT user_id, avg(product_degree) AS user_neighbors_avg_degree FROM edges e JOIN pd ON pd.product_id = e.product_id GROUP BY user_id",
        "user_neighbors_avg_degree",
        prefix=_with("reviews_v", edges=_edges("reviews_v"), pd=degrees.format(k="product_id", n="product_degree")),
    )
    out["user_pair_similarity"] = _round("SELECT * FROM usim", "jaccard", "rating_similarity", "similarity", prefix=_with("rings_v", **USER_PAIRS))
    out["product_pair_similarity"] = _round(
        "SELECT product_1, product_2, members_1, members_2, min(shared) AS shared, min(jaccard) AS jaccard FROM (SELECT shared, jaccard, "
        "least(x.profile, y.profile) AS product_1, greatest(x.profile, y.profile) AS product_2, "
        "CASE WHEN x.profile <= y.profile THEN x.members ELSE y.members END AS members_1, "
        "CASE WHEN x.profile <= y.profile THEN y.members ELSE x.members END AS members_2 "
        "FROM pairs JOIN pmem x ON x.product_id = a JOIN pmem y ON y.product_id = b) AS q GROUP BY 1, 2, 3, 4",
        "jaccard", prefix=_with("rings_v", **{**PRODUCT_PAIRS, **PRODUCT_PROFILES}),
    )
    out["user_profile_members"] = _with("rings_v", **{k: USER_PAIRS[k] for k in ("edges", "uprof", "umem")}) + "SELECT user_id, profile, members, size FROM umem"
    out["product_profile_members"] = _with("rings_v", **PRODUCT_PROFILES) + "SELECT product_id, profile, members, size FROM pmem"
    out["suspicious_users"] = sus + "SELECT user_id FROM bad_users"
    out["suspicious_products"] = _round("SELECT * FROM bad_products", "avg_rating", "rating_variance", "high_rating_pct", prefix=sus)
    out["suspicious_user_groups"] = _recursive(sus).rstrip() + ", " + _closure("user_id")
    out["suspicious_product_groups"] = (
        _recursive(_with("rings_v", **PRODUCT_PAIRS)).rstrip() + ", " + _closure("product_id")
    )
    classes = _with(
        "market_v", edges=_edges("market_v"),
        kept="SELECT user_id, product_id FROM edges WHERE product_id IN (SELECT product_id FROM edges GROUP BY product_id HAVING count(*) > 1)",
        prof="SELECT user_id, count(*) AS size, string_agg(product_id, ',' ORDER BY product_id) AS k FROM kept GROUP BY user_id",
        mem="SELECT user_id, size, min(user_id) OVER (PARTITION BY k) AS profile, count(*) OVER (PARTITION BY k) AS members FROM prof",
        rep="SELECT user_id, size, members FROM mem WHERE user_id = profile",
    )
    out["coreview_class_members"] = classes + "SELECT user_id, profile FROM mem"
    out["coreview_class_products"] = classes + "SELECT k.user_id AS profile, product_id, members FROM kept k JOIN rep ON rep.user_id = k.user_id"
    out["coreview_strong_links"] = classes + (
        "SELECT a.user_id AS user_1, b.user_id AS user_2, count(*) AS weight FROM kept a JOIN rep x ON x.user_id = a.user_id "
        "JOIN kept b ON a.product_id = b.product_id AND a.user_id < b.user_id JOIN rep y ON y.user_id = b.user_id GROUP BY 1, 2 HAVING count(*) > 1"
    )
    out["coreview_edges"] = classes + (
        "SELECT a.user_id AS user_1, b.user_id AS user_2, x.members AS members_1, y.members AS members_2, count(*) AS weight "
        "FROM kept a JOIN rep x ON x.user_id = a.user_id JOIN kept b ON a.product_id = b.product_id AND a.user_id < b.user_id "
        "JOIN rep y ON y.user_id = b.user_id GROUP BY 1, 2, 3, 4 UNION ALL SELECT user_id, user_id, members, members, size FROM rep WHERE members > 1"
    )
    out["user_similarity_stats"] = _round(
        SIM_STATS, "avg_user_similarity", "max_user_similarity", prefix=_with("market_v", **_coreview("market_v"))
    )
    out["user_clustering"] = _round(
        "SELECT * FROM clus", "user_clustering", prefix=_with("market_v", **_coreview("market_v"), **CLUSTERING)
    )
    feature_ctes = {**SUSPICIOUS_USERS, **_coreview("rings_v"), **CLUSTERING, "simstats": SIM_STATS}
    features = (
        "SELECT r.review_id, CAST(ud.d AS DOUBLE) AS user_degree, CAST(pd.d AS DOUBLE) AS product_degree, user_clustering, avg_user_similarity, "
        "max_user_similarity, similar_user_count, CAST(CASE WHEN r.user_id IN (SELECT user_id FROM bad_users) THEN 1 ELSE 0 END AS DOUBLE) AS is_suspicious_user, "
        "CAST(CASE WHEN r.product_id IN (SELECT product_id FROM bad_products) THEN 1 ELSE 0 END AS DOUBLE) AS is_suspicious_product, "
        "CAST(count(*) OVER (PARTITION BY r.user_id, CAST(r.date AS DATE)) AS DOUBLE) AS same_day_review_count, "
        "CAST(count(*) OVER (PARTITION BY r.product_id, CAST(r.date AS DATE)) AS DOUBLE) AS product_same_day_review_count, "
        f"{meta_cols}, r.verified_purchase FROM rings_v r JOIN deg ud ON ud.user_id = r.user_id JOIN (SELECT product_id, count(*) AS d FROM edges GROUP BY 1) pd "
        "ON pd.product_id = r.product_id JOIN clus ON clus.user_id = r.user_id JOIN simstats ON simstats.user_id = r.user_id "
        "LEFT JOIN users_v u ON u.user_id = r.user_id LEFT JOIN products_v p ON p.product_id = r.product_id"
    )
    feature_names = ["user_clustering", "avg_user_similarity", "max_user_similarity", "user_avg_rating", "user_verified_ratio", "product_avg_rating"]
    feature_tables = _with("rings_v", "users_v", "products_v", **feature_ctes)
    central = [f"SELECT id, {c} AS v FROM {t} WHERE kind = 'user'" for c, t in (("betweenness", "between"), ("centrality", "eigen"))]
    out["graph_features"] = _round(
        f"SELECT f.* EXCLUDE (user_id), b.v AS user_betweenness, c.v AS user_eigenvector_centrality FROM ({features.replace('r.review_id', 'r.review_id, r.user_id', 1)}) f "
        f"JOIN ({central[0]}) b ON b.id = f.user_id JOIN ({central[1]}) c ON c.id = f.user_id",
        *feature_names, "user_betweenness", "user_eigenvector_centrality",
        prefix=_recursive(_with("rings_v", "users_v", "products_v", **feature_ctes, **CENTRAL, **EIGEN, **BETWEEN)),
    )
    market_edges = {"edges": _edges("market_v"), **CENTRAL}
    out["betweenness"] = _round("SELECT * FROM between", "betweenness", prefix=_recursive(_with("market_v", **market_edges, **BETWEEN)))
    out["eigenvector_centrality"] = _round("SELECT * FROM eigen", "centrality", prefix=_recursive(_with("market_v", **market_edges, **EIGEN)))
    out["batch_features"] = _round(
        f"SELECT f.* FROM ({features}) f JOIN (SELECT review_id FROM rings_v WHERE date >= TIMESTAMP '2001-07-01' OR date IS NULL) n ON n.review_id = f.review_id",
        *feature_names, prefix=feature_tables,
    )
    out["analyze_rules"] = sus + _flags()

    # text
    out["basic_text_features"] = _round(
        f"SELECT {TEXT_KEEP}, len({T}) AS review_length, len([w for w in regexp_split_to_array({T}, '[{WS}]+') if w <> '']) AS word_count, "
        f"{_count(T, '!')} AS exclamation_count, {_count(T, chr(92) + 'p{Lu}')} / CAST(greatest(len({T}), 1) AS DOUBLE) AS uppercase_ratio FROM text_reviews_v",
        "uppercase_ratio", prefix=texts,
    )
    out["clean_text"] = texts + f"SELECT review_id, {CLEAN} AS clean_text FROM text_reviews_v"
    out["tokenize"] = text_words + "SELECT review_id, array_to_string(s, ' ') AS tokens FROM ts"
    out["ngrams"] = text_words + (
        f"SELECT review_id, array_to_string({_grams('s', 2)}, '|') AS bigrams, array_to_string({_grams('s', 3)}, '|') AS trigrams FROM ts"
    )
    out["lemma_lookup"] = text_words.rstrip() + (
        ", wd AS (SELECT review_id, unnest(s) AS w, generate_subscripts(s, 1) AS i FROM ts), vocabulary AS (SELECT DISTINCT w FROM wd), "
        "plural AS (SELECT a.w AS form, b.w AS lemma FROM vocabulary a JOIN vocabulary b ON a.w = b.w || 's'), "
        "joined AS (SELECT review_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS l FROM wd LEFT JOIN plural ON form = w GROUP BY review_id) "
        "SELECT t.review_id, coalesce(l, '') AS lemmas FROM text_reviews_v t LEFT JOIN joined j ON j.review_id = t.review_id"
    )
    out["text_statistics"] = _round(
        f"SELECT {TEXT_KEEP}, {STATS} FROM ts", "avg_word_length", "uppercase_ratio", "digit_ratio", "unique_words_ratio", prefix=text_words
    )
    out["top_ngrams"] = text_words.rstrip() + (
        f", grams AS (SELECT review_id, {_grams('s', 2)} AS two, {_grams('s', 3)} AS three FROM ts), "
        f"best2 AS ({_ranked_items('grams', 'two', 5, 'top_bigrams')}), best3 AS ({_ranked_items('grams', 'three', 5, 'top_trigrams')}) "
        "SELECT t.review_id, coalesce(top_bigrams, '') AS top_bigrams, coalesce(top_trigrams, '') AS top_trigrams FROM text_reviews_v t "
        "LEFT JOIN best2 ON best2.review_id = t.review_id LEFT JOIN best3 ON best3.review_id = t.review_id"
    )
    out["sentiment_features"] = _round(f"SELECT {TEXT_KEEP}, {SENTIMENT} FROM ts", *SENTIMENT_COLS, prefix=text_words)
    out["linguistic_features"] = _round(f"SELECT {TEXT_KEEP}, {LINGUISTIC} FROM text_reviews_v", *LINGUISTIC_COLS, prefix=texts)
    for group in ("product", "user"):
        out[f"text_similarity_{group}"] = _round(
            "SELECT * FROM s_out", "avg_text_similarity", "max_text_similarity", prefix=_with("text_reviews_v", **_similarity(f"{group}_id", "s_"))
        )
    extra = "char_count, word_count, exclamation_count, question_count, digit_ratio, unique_words_ratio"
    sims = ", ".join(f"{p}.{c} AS {c}_{n}" for p, n in (("a", "product"), ("b", "user")) for c in SIM_COLS)
    all_text = _with(
        "text_reviews_v", **_similarity("product_id", "a_"), **_similarity("user_id", "b_"),
        tw=f"SELECT *, {ALL_WORDS} AS w FROM text_reviews_v",
        ts=f"SELECT *, [x for x in w if x NOT IN ({_quoted(lex.STOP_WORDS)})] AS s FROM tw",
        st=f"SELECT review_id, {STATS} FROM ts",
    )
    out["text_features"] = _round(
        f"SELECT x.*, {extra}, {sims} FROM (SELECT {TEXT_KEEP}, {SENTIMENT}, {LINGUISTIC} FROM ts) x JOIN st ON st.review_id = x.review_id "
        "JOIN a_out a ON a.review_id = x.review_id JOIN b_out b ON b.review_id = x.review_id",
        *SENTIMENT_COLS, *LINGUISTIC_COLS, "digit_ratio", "unique_words_ratio", "avg_text_similarity_product", "max_text_similarity_product",
        "avg_text_similarity_user", "max_text_similarity_user", prefix=all_text,
    )
    out["word_frequencies"] = text_words + (
        "SELECT word, count(*) AS frequency FROM (SELECT unnest(s) AS word FROM ts) AS u GROUP BY word ORDER BY frequency DESC, word LIMIT 100"
    )
    out["review_word_frequencies"] = texts.rstrip() + (
        f", rw AS (SELECT review_id, {RAW_TOKENS} AS w FROM text_reviews_v), best AS ({_ranked_items('rw', 'w', 20, 'top_words')}) "
        "SELECT t.review_id, coalesce(top_words, '') AS top_words FROM text_reviews_v t LEFT JOIN best ON best.review_id = t.review_id"
    )
    out["sentiment_mix"] = texts + (
        f"SELECT review_id, {_hits('w', lex.MIX_POSITIVE)} AS positive_count, {_hits('w', lex.MIX_NEGATIVE)} AS negative_count, "
        f"len(w) - {_hits('w', lex.MIX_POSITIVE)} - {_hits('w', lex.MIX_NEGATIVE)} AS neutral_count FROM (SELECT review_id, {RAW_TOKENS} AS w FROM text_reviews_v) AS q"
    )

    out["nlp_tfidf"] = _round(
        "SELECT d AS review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY d)) AS weight FROM raw",
        "weight",
        prefix=_with(
            "text_reviews_v",
            words=f"SELECT CAST(review_id AS VARCHAR) AS d, [x for x in regexp_extract_all(lower({T}), '[\\p{{L}}\\p{{N}}_]{{2,}}') if x NOT IN ({_quoted(lex.STOP_WORDS)})] AS w FROM text_reviews_v",
            grams=f"SELECT d, unnest(w || {_grams('w', 2)}) AS term FROM words",
            counts="SELECT d, term, count(*) AS tf FROM grams GROUP BY d, term",
            vocabulary="SELECT term, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.8 * (SELECT count(*) FROM words) ORDER BY sum(tf) DESC, term LIMIT 5000",
            raw="SELECT d, term, tf * (ln(((SELECT count(*) FROM words) + CAST(1 AS DOUBLE)) / (df + CAST(1 AS DOUBLE))) + 1) AS w FROM counts JOIN vocabulary USING (term)",
        ),
    )

    # metrics over given scores
    scores = _with("scores_v")
    out["ensemble_score"] = _round(
        "SELECT *, 0.6 * nlp_probability + (1 - CAST(0.6 AS DOUBLE)) * graph_probability AS fake_probability FROM scores_v",
        "nlp_probability", "graph_probability", "fake_probability", prefix=scores,
    )
    out["tune_weights"] = _round(
        f"SELECT w AS nlp_weight, 1 - w AS graph_weight, auc AS roc_auc FROM ({WEIGHTS}) AS q ORDER BY auc DESC, w LIMIT 1",
        "nlp_weight", "graph_weight", "roc_auc", prefix=scores,
    )
    points = POINTS.format(score="nlp_probability", src="scores_v")
    out["roc_auc"] = _round(
        "SELECT sum((fp - coalesce(fp0, 0)) * (tp + coalesce(tp0, 0)) / 2.0) / CAST(max(pp) * max(nn) AS DOUBLE) AS roc_auc FROM (SELECT *, "
        f"lag(tp) OVER (ORDER BY threshold DESC) AS tp0, lag(fp) OVER (ORDER BY threshold DESC) AS fp0 FROM ({points}) AS p) AS q",
        "roc_auc", prefix=scores,
    )
    out["roc_curve"] = _round(
        f"SELECT threshold, fp / CAST(nn AS DOUBLE) AS fpr, tp / CAST(pp AS DOUBLE) AS tpr FROM ({points}) AS p "
        "UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0",
        "fpr", "tpr", prefix=scores,
    )
    points = POINTS.format(score="graph_probability", src="scores_v")
    out["pr_curve"] = _round(
        f"SELECT threshold, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(pp AS DOUBLE) AS recall, pp / CAST(pp + nn AS DOUBLE) AS baseline "
        f"FROM ({points}) AS p UNION ALL SELECT CAST('inf' AS DOUBLE), 1.0, 0.0, avg(label) FROM scores_v",
        "precision", "recall", "baseline", prefix=scores,
    )
    judged = _with("scores_v", **_per_class())
    out["confusion_matrix"] = _with("scores_v", pred=PREDICTED) + (
        "SELECT a.x AS actual, b.x AS predicted, count(label) AS n FROM (VALUES (0), (1)) a(x) CROSS JOIN (VALUES (0), (1)) b(x) "
        "LEFT JOIN pred ON label = a.x AND predicted = b.x GROUP BY 1, 2"
    )
    out["classification_report"] = _round(
        "SELECT name, p AS precision, r AS recall, f AS f1, CAST(s AS BIGINT) AS support FROM pc UNION ALL SELECT 'accuracy', a, a, a, CAST(s AS BIGINT) FROM acc "
        "UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(s) AS BIGINT) FROM pc "
        "UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), CAST(sum(s) AS BIGINT) FROM pc",
        "precision", "recall", "f1", prefix=judged,
    )
    return out
