"""Embedding whitening from the covariance of distinct vectors.

Entries become whole numbers x = floor(scale * c) + offset.  Equal x vectors are grouped; a group enters the fit with weight
one, or with the number of its rows (``weights="count"``).  The weighted total n and the sums S are exact, and a vector is
centred as (n x - S) / n with the difference in whole numbers, so the offset costs no digits.  Each task multiplies its centred
vectors (weighted GEMM) into one d x d matrix; Spark adds the tasks' matrices entry by entry.  The driver sees d sums and
d x d entries, whatever the number of rows.  Each distinct vector is projected once, and rows get theirs by a join on x
whose hot keys adaptive execution splits.

Rows whose vector is null, or holds a null or a value that is not finite, are dropped, as are vectors of another length than most
(ties: the shorter).  x is cut off at 2^62 either way.  A component without variance (eigenvalue below rounding) has no
whitened value: null; ``identity_error`` is taken over the others, null if there are none.  A deviation beyond a long is null.  An empty
table gives no rows.  Null ids and repeated rows stay as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import bound_batches, stored
from candor.skew import attach

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
ROWS = 4096  # vectors multiplied at once
FAR = 1 << 62

ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x) of the usable rows, all of one length."""
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    grid = F.transform("_v", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(FAR))), F.lit(-float(FAR)))) + F.lit(offset).cast("long"))
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v")).filter(
        F.col("_v").isNotNull() & (F.size("_v") > 0) & finite
    )
    lengths = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("_v") == (lengths.d if lengths else 0)).select("vec_id", grid.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, weights) of some rows at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column(column).flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(part.num_rows, -1), part.column("weight").to_numpy()


def weighted_sums(df: DataFrame, column: str) -> list:
    """The weighted sum of each entry of ``column``, and last the sum of the weights, added in Spark."""
    kind = dict(df.dtypes)[column].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, w in _blocks(batches, column):
            some = np.concatenate([(x * w[:, None]).sum(axis=0), [w.sum()]])
            total = some if total is None else total + some
        if total is not None:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "v": total.astype(np.int64 if kind == "bigint" else np.float64)})

    sums = df.select(column, "weight").mapInArrow(run, f"at int, v {kind}").groupBy("at").agg(F.sum("v").alias("v"))
    return [r.v for r in sorted(sums.collect())]


def weighted_covariance(df: DataFrame, column: str, centre: Callable[[np.ndarray], np.ndarray], total: float) -> np.ndarray:
    """Covariance with divisor ``total`` of the vectors that ``centre`` has centred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x, w in _blocks(batches, column):
            y = centre(x)
            some = (y * w[:, None]).T @ y
            held = some if held is None else held + some
        if held is not None:
            i, j = np.triu_indices(len(held))
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": held[i, j]})

    parts = df.select(column, "weight").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((max(r.i for r in parts) + 1,) * 2)
    for r in parts:
        out[r.i, r.j] = out[r.j, r.i] = r.v / total
    return out


@dataclass
class Whitening:
    """n, S and the leading components (columns) with their eigenvalues."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def known(self) -> np.ndarray:
        return self.values > len(self.sums) * np.finfo(float).eps * self.values[:1]

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: in long arithmetic where that fits, else in Python's whole numbers."""
        most = max(int(x.max()), -int(x.min()), 1)
        exact = self.n * most + max(map(abs, self.sums)) < FAR
        return (x if exact else x.astype(object)) * self.n - np.array(self.sums, np.int64 if exact else object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.moved(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        moved = self.moved(x)
        if moved.dtype != object and float(np.abs(moved).max()) ** 2 * x.shape[1] < FAR:
            return (moved * moved).sum(axis=1).tolist()
        found = (moved.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in found]

    def projected(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = self.centred(x) @ self.basis / np.sqrt(self.values)
        out[:, ~self.known] = np.nan
        return out


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From (x, weight); ``None`` without vectors."""
    sums = weighted_sums(distinct, "x")
    if not sums:
        return None
    n, sums = sums[-1], sums[:-1]
    model = Whitening(n, sums, np.empty((len(sums), 0)), np.empty(0), 0.0)
    covariance = weighted_covariance(distinct, "x", model.centred, n)
    values, basis = np.linalg.eigh(covariance)
    k = min(components, len(sums))
    return Whitening(n, sums, basis[:, ::-1][:, :k], np.maximum(values[::-1][:k], 0.0), float(np.trace(covariance)))


def _identity_error(done: DataFrame, model: Whitening) -> float | None:
    known = model.known
    if not known.any():
        return None
    rows = done.select(F.slice("whitened", 1, int(known.sum())).alias("y"), "weight")
    *sums, total = weighted_sums(rows.withColumn("weight", F.col("weight").cast("double")), "y")
    mean = np.array(sums) / total
    return float(np.abs(weighted_covariance(rows, "y", lambda y: y - mean, total) - np.eye(len(mean))).max())


def whiten(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", weights: str = "one", components: int = COMPONENTS,
    scale: int = SCALE, offset: int = OFFSET,
) -> DataFrame:
    """One row for each usable row and component: see the module; ``explained`` is the share of the trace."""
    if weights not in ("one", "count"):
        raise ValueError(weights)
    bound_batches(df.sparkSession)
    rows = whole_vectors(df, id_col, vector_col, scale, offset)
    weight = F.count(F.lit(1)) if weights == "count" else F.max(F.lit(1).cast("long"))
    distinct = stored(rows.groupBy("x").agg(weight.alias("weight")), "vectors")
    model = fit(distinct, components)
    if model is None:
        return df.sparkSession.createDataFrame([], ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                y = model.projected(x)
                flat = pa.array(y.ravel(), pa.float64(), mask=np.isnan(y.ravel()))
                offsets = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("x"), part.column("weight"), pa.array(model.deviations(x), pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                    names=["x", "weight", "deviation", "whitened"],
                )

    done = stored(distinct.mapInArrow(run, "x array<long>, weight long, deviation long, whitened array<double>"), "whitened")
    error = F.lit(_identity_error(done, model)).cast("double")
    share = F.array(*[F.lit(float(v / model.trace) if model.trace > 0 else None).cast("double") for v in model.values])
    found = attach(rows, done.select("x", "deviation", "whitened"), "x", how="inner")
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("_at") + 1).alias("explained"), error.alias("identity_error"),
    )
