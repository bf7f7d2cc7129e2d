"""Answers travel to their blocks as compressed arrays."""

import numpy as np

from candor.llm import blocks


def test_answers_are_packed_and_come_back_exactly(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    rows = [(int(b) << 32, int(k), int(c), float(v)) for b, k, c, v in zip(
        rnd.integers(0, 3, 4000), rnd.integers(0, 2, 4000), rnd.integers(-(1 << 63), (1 << 63) - 1, 4000), -rnd.exponential(size=4000))]
    rows += [(0, blocks.GRAM, -(1 << 63), -0.0), (0, blocks.GRAM, (1 << 63) - 1, float("-inf"))]
    answers = spark.createDataFrame(rows, "block long, kind int, code long, value double").coalesce(2)
    out = blocks.packed(answers).collect()
    assert len(out) <= 2 * 6  # a piece for each block and kind of a task, not a row for each answer
    for block, kind in {r[:2] for r in rows}:
        codes, values = blocks.unpacked([r.packed for r in out if (r.block, r.kind) == (block, kind)])
        assert sorted(zip(codes.tolist(), values.tolist())) == sorted(r[2:] for r in rows if r[:2] == (block, kind))
    assert blocks.unpacked([])[0].dtype == np.int64
