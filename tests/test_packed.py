"""Lists of numbers as bytes: they read back as they were, and clustering moves them instead of entries."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import clustering, random_edges
from pyspark.sql import functions as F

from candor.lineage import numbered
from candor.operators import graph, packed


def _some(seed, lists=60):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 9, lists)
    sizes[0] = sizes[-1] = 0
    item = [np.sort(rng.choice(2 ** int(rng.integers(4, 40)), n, replace=False)) for n in sizes]
    return np.concatenate(item).astype(np.int64), rng.choice([1, 1, 1, 0, 5, -3, 2**40, -(2**41)], sizes.sum()), np.cumsum(sizes)


@pytest.mark.parametrize("seed", range(5))
def test_lists_read_back(seed):
    item, n, ends = _some(seed)
    columns = packed.pack(item, n, ends)
    for a, b in ((0, len(ends)), (7, 31), (0, 1)):
        lo, hi = ([0, *ends][a], ends[b - 1])
        back = packed.unpack(*[c.slice(a, b - a) for c in columns])
        assert [x.tolist() for x in back] == [item[lo:hi].tolist(), n[lo:hi].tolist(), np.diff(ends, prepend=0)[a:b].tolist()]


@pytest.mark.parametrize("rows,at_once", [(1, 1), (7, 20), (1000, 1 << 20)])
def test_lists_of_a_key_add_up_across_batches(monkeypatch, rows, at_once):
    monkeypatch.setattr(packed, "AT_ONCE", at_once)
    item, n, ends = _some(9)
    item = item % 5 + np.arange(len(item)) * 0
    item = np.concatenate([np.sort(part) for part in np.split(item, ends[:-1])])
    key = np.sort(np.arange(len(ends)) % 6)
    whole = pa.RecordBatch.from_arrays([pa.array(key), *packed.pack(item, n, ends)], names=["key", "item", "n"])
    got = {}
    for keys, stops, items, sums in packed.summed(whole.slice(i, rows) for i in range(0, len(key), rows)):
        for k, a, b in zip(keys, [0, *stops], stops):
            assert k not in got
            got[int(k)] = dict(zip(items[a:b].tolist(), sums[a:b].tolist()))
    want = {int(k): {} for k in key}
    for k, i, x in zip(np.repeat(key, np.diff(ends, prepend=0)), item, n):
        want[int(k)][int(i)] = want[int(k)].get(int(i), 0) + int(x)
    assert got == want


@pytest.mark.parametrize("carried,most", [(2, 1 << 15), (2, 0), (64, 40)])
def test_clustering_with_large_classes_and_products(spark, monkeypatch, carried, most):
    monkeypatch.setattr(graph, "CARRIED", carried)
    flat = random_edges(carried + most, users=26, products=8, hot="p02")
    df = spark.createDataFrame([(e[0], e[1]) for e in flat], "user_id string, product_id string")
    assert {r.user_id: r.user_clustering for r in graph.user_clustering(df, most=most, piece=3).collect()} == pytest.approx(clustering(flat))


def test_numbers_have_no_gaps(spark):
    rows = spark.range(1000).select(F.concat(F.lit("p"), "id").alias("product_id")).repartition(5)
    assert sorted(r.at for r in numbered(rows, "at", "numbers").collect()) == list(range(1000))
