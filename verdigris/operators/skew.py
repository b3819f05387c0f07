"""Joins with a table of one row per key, where a few keys may hold most of the other side's rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.01
#: A table of at most this many rows is broadcast whole (keys and figures, about 150 bytes a row in memory).
BROADCAST_ROWS = 200_000


def join_by_key(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: float = HOT_SHARE, least: int = 10_000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` joined with ``right``, which has at most one row per key, without a task that holds a whole hot key.

    Where ``right`` is counted to be small, it is broadcast. Else the rows of hot keys meet their few rows of ``right`` by
    broadcast, all others by shuffle, and both are united. Null keys are equal to each other. ``how`` is inner or
    left_semi. Both sides are read several times and should be stored. Keys of fewer than ``least`` rows are never hot.
    Columns: the keys, then those of ``left``, then those of ``right``.
    """
    values = [c for c in right.columns if c not in keys]

    def joined(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *values)  # a broadcast hint below stays in force
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        return a.join(b, same, how).select(*keys, *[c for c in left.columns if c not in keys], *([] if how == "left_semi" else values))

    if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return joined(left, F.broadcast(right))
    counts = left.groupBy(*keys).count()
    rows = counts.agg(F.sum("count").alias("n")).first()["n"] or 0
    hot = counts.filter(F.col("count") > max(least, rows * share)).select(*keys)
    found = hot.collect() if rows > least else []  # at most 1 / share rows
    if not found:
        return joined(left, right)
    hot = left.sparkSession.createDataFrame(found, hot.schema).select(*[F.col(k).alias(f"__hot_{k}") for k in keys])
    is_hot = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys])

    def split(side: DataFrame, kind: str) -> DataFrame:
        return side.join(F.broadcast(hot), is_hot, kind)

    few = split(right, "left_semi")  # one row per hot key
    return joined(split(left, "left_semi"), F.broadcast(few)).unionByName(joined(split(left, "left_anti"), split(right, "left_anti")))
