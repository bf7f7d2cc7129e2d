"""Connected components by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.lineage import cut
from candor.skew import attach


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with the smallest neighbour of ``src``."""
    return attach(edges, edges.groupBy("src").agg(F.min("dst").alias("_min")), "src")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first())


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``pairs``; the component is its smallest node.

    Each round is written to the checkpoint folder; rounds go on until none changes an edge.
    """
    edges = cut(
        pairs.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
        .distinct()
    )
    before = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = (
            _with_minimum(both)
            .filter(F.col("dst") > F.col("src"))
            .select(F.col("dst").alias("src"), F.least("_min", "src").alias("dst"))
            .distinct()
        )
        small = _with_minimum(large)
        edges = cut(
            small.select("src", F.col("_min").alias("dst"))
            .union(small.filter(F.col("dst") != F.col("_min")).select(F.col("dst").alias("src"), F.col("_min").alias("dst")))
            .distinct()
        )
        after = _state(edges)
        if after == before:
            roots = edges.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
        before = after
