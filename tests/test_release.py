"""Disk: what steps shuffled is gone once they are written."""

import time
from pathlib import Path

from helpers import EDGE_SCHEMA, random_edges, similar_users
from pyspark.sql import functions as F

from candor.lineage import cut, forget, written
from candor.operators import centrality, suspicious
from candor.operators.similarity import profile_edges, profiles


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def _left(spark, before):
    for _ in range(50):  # files are removed in the background
        if not (left := _shuffled(spark) - before):
            break
        time.sleep(0.1)
    return left


def _sums(spark):
    return spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.sum("id").alias("n")).orderBy("k")


def test_written_steps_leave_no_shuffle_files(spark):
    before = _shuffled(spark)
    out = written(_sums(spark), "sums")
    assert not _left(spark, before)
    assert [r.n for r in out.orderBy("k").collect()] == [sum(range(k, 1000, 7)) for k in range(7)]


def test_steps_let_go_of_those_before(spark):
    before = _shuffled(spark)
    first = cut(_sums(spark))
    assert first.count() == 7
    del first
    written(spark.range(10), "numbers")
    assert not _left(spark, before)


def test_look_alikes_leave_only_what_the_result_reads(spark):
    """Members of profiles and similar pairs are written out, so all their shuffles are gone when the result is asked for."""
    edges = random_edges(4, hot="p02")
    df = cut(spark.createDataFrame(edges, EDGE_SCHEMA))
    before = _shuffled(spark)
    found = suspicious.suspicious_users(df)
    assert not _left(spark, before)
    assert {r.user_id for r in found.collect()} == {u for pair in similar_users(edges) for u in pair}


def test_rounds_of_eigenvector_centrality_are_a_chain(spark):
    """A round's plan holds the one before once, however many follow each other, and states that are replaced are deleted."""
    edges = cut(spark.createDataFrame([(e[0], e[1]) for e in random_edges(5)], "user_id string, product_id string"))
    membership = cut(profiles(edges, "user_id", "product_id"))
    grid = centrality._grid(cut(profile_edges(edges, membership, "user_id")), 10)
    state = written(grid.state, "state")
    folder = state.inputFiles()[0]
    first = state
    for j in (1, 2, 3):
        state = centrality._round(grid, state, j)
    assert _sources(state, first) == 1
    forget(first)
    assert not Path(folder.removeprefix("file://")).exists()


def _sources(df, source):
    """How often the plan of ``df`` scans the files of ``source``."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").split("\n")
    return sum(leaf.startswith("Relation") and all(f"{c}#" in leaf for c in source.columns) for leaf in leaves)
