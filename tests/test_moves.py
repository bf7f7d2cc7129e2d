"""What is moved: rows that are joined back carry nothing they can do without."""

import random

import pytest
from helpers import clustering, random_edges
from pyspark.sql import functions as F

from candor.lineage import cut
from candor.operators.behavior import same_day_counts
from candor.operators import graph
from candor.operators.graph import _class_pairs
from candor.operators.similarity import _repeated
from candor.skew import attach


def _plan(df, part="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_same_day_counts_do_not_count_over_joined_rows(spark):
    rows = [(i, f"u{i % 2}", f"p{i % 3}", f"2020-01-0{1 + i % 4} 10:00:00") for i in range(12)]
    rows += [(20, "u0", "p9", None), (21, "u9", "p0", "2020-01-01 00:00:00"), (22, None, "p8", "2020-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "review_id int, user_id string, product_id string, d string").withColumn("date", F.col("d").cast("timestamp_ntz"))
    out = same_day_counts(df)
    assert _plan(out).count("Join LeftOuter") == 2
    day = lambda r: r[3] and r[3][:10]
    same = lambda r, at: sum(1 for x in rows if r[at] and day(r) and x[at] == r[at] and day(x) == day(r))
    got = {r["review_id"]: (r["same_day_review_count"], r["product_same_day_review_count"]) for r in out.collect()}
    assert got == {r[0]: (same(r, 1), same(r, 2)) for r in rows}


def test_attached_rows_do_not_carry_the_hash(spark):
    rows = spark.range(100).withColumn("k", F.col("id") % 7)
    values = rows.groupBy("k").agg(F.count("id").alias("n"))
    out = attach(rows, values, "k")
    assert out.columns == ["k", "id", "n"] and out.filter("n >= 14").count() == 100
    assert " AS _mark" not in _plan(out)


@pytest.mark.parametrize("carried", [1, 2, 64])
def test_class_pairs_are_counted_where_they_meet_first(spark, carried):
    rnd = random.Random(carried)
    sets = {f"o{i}": {f"p{rnd.randrange(9)}" for _ in range(rnd.randrange(1, 6))} for i in range(40)}
    rows = [(o, p, 1 + int(o[1:]) % 3, len(ps)) for o, ps in sets.items() for p in ps]
    own = cut(spark.createDataFrame(rows, "profile string, product_id string, members long, size long"))
    pairs = _class_pairs(own, carried)
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = pairs.collect()
    assert {(r.set_1, r.set_2): r.weight for r in got} == want and len(got) == len(want)
    assert all(r.members_1 == 1 + int(r.set_1[1:]) % 3 and r.members_2 == 1 + int(r.set_2[1:]) % 3 for r in got)
    if carried == 64:
        assert "Aggregate" not in _plan(pairs)  # pairs are not moved to be counted


def test_marks_met_by_nothing_are_dropped_before_the_join(spark):
    marks = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 6, "a"), (2, 5, "c"), (2, 7, "c"), (2, 7, "d")], "kind int, key long, set string")
    got = sorted(tuple(r) for r in _repeated(marks, ["kind", "key"]).select("kind", "key", "set").collect())
    assert got == [(1, 5, "a"), (1, 5, "b"), (2, 7, "c"), (2, 7, "d")]


@pytest.mark.parametrize("most,piece", [(0, 2), (12, 1), (1 << 15, 1024)])
def test_clustering_lists_no_pairs_of_classes(spark, monkeypatch, most, piece):
    monkeypatch.setattr(graph, "_class_pairs", None)  # called before
    flat = random_edges(piece, users=24, products=9, hot="p03")
    df = spark.createDataFrame([(e[0], e[1]) for e in flat], "user_id string, product_id string")
    want = clustering(flat)
    assert {r.user_id: r.user_clustering for r in graph.user_clustering(df, most=most, piece=piece).collect()} == pytest.approx(want)
    some = df.select("user_id").distinct().filter(F.xxhash64("user_id") % 2 == 0)
    got = {r.user_id: r.user_clustering for r in graph.user_clustering(df, some, most=most, piece=piece).collect()}
    assert 0 < len(got) < len(want) and got == pytest.approx({u: want[u] for u in got})
