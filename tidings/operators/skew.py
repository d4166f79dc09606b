"""Joins that survive hot keys without a hint from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in this many; whatever the
#: data, at most this many keys are, so their rows of ``stats`` can be broadcast.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, stats: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``stats``: one row per ``key`` and, in
    ``count``, the number of rows that have it, of ``total`` in all.  Rows with
    a hot key meet a broadcast and stay where they are; the others are
    shuffled, and no key among them is heavy."""
    is_hot = F.col(count) * F.lit(HOT_SHARE) > F.lit(total)
    hot, cold = stats.where(is_hot), stats.where(~is_hot)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
