"""Joins of many rows with one row a key where a few keys may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many is hot; so there are fewer hot keys than this.
SHARE = 1000


def join_by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row a key and in ``size`` the key's number of rows.

    Hot keys, fewer than ``SHARE``, are broadcast, so their rows stay where they are; the others are shuffled, and none
    of those has more than a thousandth of the rows. Null keys are equal. Rows without a partner are left out. ``rows`` is
    read twice and should be a written table; ``size`` is dropped.
    """
    hot = F.col(size) * SHARE > total
    other = keyed.select(*[F.col(k).alias(f"_{k}") for k in keys], size, *[c for c in keyed.columns if c not in (*keys, size)])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    spare = [size, *[f"_{k}" for k in keys]]
    few = F.broadcast(other.where(hot))
    cold = rows.join(few.select(*spare[1:]), same, "left_anti")
    return rows.join(few, same).drop(*spare).unionByName(cold.join(other.where(~hot), same).drop(*spare))
