"""Whitening against a direct computation in whole numbers."""

import numpy as np
import pytest

from candor.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, x string, n long, weight double, whitened double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "mine", 1, 2.0, 3.0) for i, v in rows], SCHEMA)


def direct(rows, weights="one", k=16):
    kept = [(i, tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    counts = {}
    for _, x in kept:
        counts[x] = counts.get(x, 0) + 1
    xs = np.array(list(counts), object)
    w = np.array([counts[x] if weights == "count" else 1 for x in counts], object)
    n, sums = int(w.sum()), (xs * w[:, None]).sum(axis=0)
    centred = (xs * n - sums).astype(float) / n
    cov = (centred * w[:, None].astype(float)).T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    deviation = {x: int(((np.array(x, object) * n - sums) ** 2).sum()) for x in counts}
    white = dict(zip(counts, centred @ basis / np.sqrt(values)))
    return kept, n, deviation, white, values / np.trace(cov)


def matrix():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20)) * 0.3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(5, rows[5][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, [None] * 20), (2002, [float("nan")] + [0.0] * 19), (2003, [float("inf")] + [0.0] * 19), (2004, [float("-inf")] + [0.0] * 19)]
    return rows


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_equals_the_direct_computation(spark, weights):
    rows = matrix()
    kept, n, deviation, white, explained = direct(rows, weights)
    found = wh.whiten(frame(spark, rows), weights=weights).collect()
    assert len(found) == len(kept) * 16
    by_component = {}
    for r in found:
        by_component.setdefault(r.component, []).append(r)
    assert sorted(by_component) == list(range(1, 17))
    ids = {}
    for i, x in kept:
        ids.setdefault(i, []).append(x)
    for c, some in by_component.items():
        assert {r.n for r in some} == {n}
        got = np.array(sorted((r.vec_id if r.vec_id is not None else -1, r.deviation, r.whitened) for r in some if len(ids[r.vec_id]) == 1))
        want = np.array(sorted((i if i is not None else -1, deviation[x], white[x][c - 1]) for i, (x, *more) in ids.items() if not more))
        sign = np.sign((got[:, 2] * want[:, 2]).sum())
        assert (got[:, :2] == want[:, :2]).all()
        assert np.allclose(got[:, 2] * sign, want[:, 2], atol=1e-8)
        assert np.allclose([r.explained for r in some], explained[c - 1], rtol=1e-9)
        assert all(0 <= r.identity_error < 1e-9 for r in some)


def test_vectors_without_spread(spark):
    """Fewer directions than components, one vector only, other lengths."""
    rows = [(i, [float(i % 3), 1.0, 0.5]) for i in range(9)] + [(50, [1.0]), (51, [])]
    found = wh.whiten(frame(spark, rows)).collect()
    assert len(found) == 27 and {r.n for r in found} == {3}
    assert all((r.whitened is None) == (r.component > 1) for r in found)
    assert all(r.identity_error < 1e-12 for r in found)
    lone = wh.whiten(frame(spark, [(1, [0.25, 2.0]), (2, [0.25, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in lone] == [(1, 0, None, None, None)] * 4


def test_far_values_stay_exact(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [3e9, 1.0]), (4, [0.0, 2.0])]
    found = {r.vec_id: r for r in wh.whiten(frame(spark, rows)).filter("component = 1").collect()}
    assert found[1].deviation is None and found[2].deviation is None
    near = wh.whiten(frame(spark, [(1, [2e6, 0.0]), (2, [-2e6, 0.0])])).filter("component = 1").collect()
    assert {r.deviation for r in near} == {(256_000_000) ** 2}


def test_empty_table(spark):
    assert wh.whiten(frame(spark, [])).count() == 0
    assert wh.whiten(frame(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_unknown_weights_are_an_error(spark):
    with pytest.raises(ValueError):
        wh.whiten(frame(spark, []), weights="two")
