"""Joining per-key values back to rows when one key may hold a large share of them.

Spark's adaptive execution splits a skewed partition of a sort-merge join into many tasks, but only if both
inputs arrive through a shuffle of the join itself.  A table of per-key aggregates usually does not: it is
already partitioned by the key and is joined in place, so a key with a third of all rows would end in one
task.  Joining on the key *and its hash* makes Spark shuffle both inputs (the aggregate side is one row per
key, hence cheap), and from there the hot partition is split by its measured size, with no key list, no
counting pass and no replication of the other keys.  A small value side still becomes a broadcast, by size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.lineage import cut

_WHOLE = {"tinyint", "smallint", "int", "bigint"}


def _hashed(rows: DataFrame, values: DataFrame, keys: list[str]) -> list[Column]:
    """The keys in one type for both inputs, so that equal keys have equal hashes."""
    ours, theirs = dict(rows.dtypes), dict(values.dtypes)
    out = []
    for k in keys:
        kinds = {ours[k], theirs[k]}
        if len(kinds) == 1:
            out.append(F.col(k))
        elif kinds <= _WHOLE | {"string"}:
            out.append(F.col(k).try_cast("bigint"))
        else:
            raise TypeError(f"key {k} is {ours[k]} in the rows and {theirs[k]} in the values")
    return out


def attach(rows: DataFrame, values: DataFrame, key: str | Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join ``values`` to ``rows`` on ``key`` so that adaptive execution can split hot keys.

    Keys of different whole-number types, or numbers on one side and their text on the other, meet as in a plain join;
    other differing types are an error.
    """
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in rows.columns if c not in keys]
    found = [c for c in values.columns if c not in keys]
    met = values.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *found)
    theirs = [f"_key_{k}" for k in keys]
    # The hash is part of the condition, not a column of the rows, so that it is not moved with them.
    ours, same = F.hash(*_hashed(rows, values, keys)), [F.col(k) == F.col(t) for k, t in zip(keys, theirs)]
    hashed = [F.col(t) if rows.schema[k].dataType == values.schema[k].dataType else F.col(t).try_cast("bigint") for k, t in zip(keys, theirs)]
    out = rows.join(met, reduce(Column.__and__, same, ours == F.hash(*hashed)), how)
    return out.select(*keys, *others, *([] if how in ("left_semi", "left_anti") else found))


TILE = 1 << 14  # rows of one key and side that meet in a task
_FEW = 1 << 14  # hot keys that are sent to every task


def tiled_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], *, tile: int = TILE) -> DataFrame:
    """Inner equi-join in which a task meets at most about ``tile`` rows of a key on each side.

    A key with more rows than that on either side is cut into tiles: its left rows are dealt to rows of the grid, its right rows to
    columns, each is repeated along the other direction, and the tile becomes part of the join key.  So a key
    that is hot on *both* sides, whose pairs adaptive execution cannot foresee from bytes, is spread over as many tasks as it has
    tiles.  Other keys are joined as they are.  Both inputs are counted first, so they should be written tables or cheap.
    """
    keys = [key] if isinstance(key, str) else list(key)
    count = F.count(F.lit(1))
    sizes = left.groupBy(*keys).agg(count.alias("_rows")).join(right.groupBy(*keys).agg(count.alias("_cols")), keys)
    parts = lambda c: F.ceil(F.col(c) / tile).cast("int").alias(c)
    hot = cut(sizes.filter((F.col("_rows") > tile) | (F.col("_cols") > tile)).select(*keys, parts("_rows"), parts("_cols")))
    found = hot.count()
    if not found:
        return attach(left, right, keys, how="inner")

    def dealt(df: DataFrame, along: str, across: str, at: str, to: str) -> DataFrame:
        marked = df.join(F.broadcast(hot), keys, "left") if found <= _FEW else attach(df, hot, keys)
        place = F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col(along)).cast("int"), F.lit(0))
        copies = F.sequence(F.lit(0), F.coalesce(F.col(across), F.lit(1)) - 1)
        return marked.withColumn(at, place).withColumn(to, F.explode(copies)).drop("_rows", "_cols")

    grid = ["_i", "_j"]
    met = dealt(left, "_rows", "_cols", *grid).join(dealt(right, "_cols", "_rows", *reversed(grid)), [*keys, *grid])
    return met.drop(*grid)
