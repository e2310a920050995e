"""Window scans over one entity's history that never need the whole entity in one task.

A history is cut into fixed time chunks and distributed by (entity, chunk).  Local windows run
inside a chunk; what crosses a chunk border is carried by a summary table with one row per
(entity, chunk), which is scanned per entity and joined back on the same distribution.  An
entity that owns a third of all rows therefore spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MINUTE_US, micros

CHUNK = "_chunk"


def chunked(df: DataFrame, keys: Sequence[str], ts: str, chunk_min: float) -> DataFrame:
    """Add the chunk number.  A scan's windows distribute by (keys, chunk), its one large shuffle; summaries are added up before theirs."""
    width = F.lit(int(chunk_min * MINUTE_US))
    return df.withColumn(CHUNK, F.floor(micros(ts) / width).cast("long"))


def with_halo(df: DataFrame, t_us: Column, until_us: Column, chunk_min: float) -> DataFrame:
    """Copy each row into every later chunk its influence [t, until] reaches; ``_own`` marks the original.

    The caller merges its streams and distributes them once by (keys, chunk).
    """
    width = F.lit(int(chunk_min * MINUTE_US))
    first = F.floor(t_us / width).cast("long")
    last = F.greatest(first, F.floor(until_us / width).cast("long"))
    out = df.withColumn("_first", first).withColumn(CHUNK, F.explode(F.sequence(F.col("_first"), last)))
    return out.withColumn("_own", F.col(CHUNK) == F.col("_first")).drop("_first")


_PREFIX = {"sum": F.sum, "max": F.max, "min": F.min}


def _order_struct(order: Sequence[str]) -> Column:
    """What a row is ordered by; a single column stays plain, so that it is aggregated by hash."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            specs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Running aggregates over the whole history of ``keys`` (inclusive of the current row).

    ``specs`` maps an output name to (kind, expression); kinds are ``sum``, ``max``, ``min``,
    ``last`` (last non-null so far) and ``all_sum`` / ``all_max`` / ``all_min`` (whole history).
    """
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    local, totals, carry, result = [], [], [], []
    for name, (kind, expr) in specs.items():
        here, there = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "last":
            at = F.when(expr.isNotNull(), _order_struct(order))
            local.append(F.last(expr, ignorenulls=True).over(inside).alias(f"_l_{name}"))
            totals.append(F.max_by(expr, at).alias(f"_c_{name}"))
            carry.append(F.last(f"_c_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
            result.append(F.coalesce(here, there).alias(name))
        elif kind.startswith("all_"):
            fn = _PREFIX[kind[4:]]
            totals.append(fn(expr).alias(f"_c_{name}"))
            carry.append(fn(f"_c_{name}").over(whole).alias(f"_c_{name}"))
            result.append(there.alias(name))
        else:
            fn = _PREFIX[kind]
            local.append(fn(expr).over(inside).alias(f"_l_{name}"))
            totals.append(fn(expr).alias(f"_c_{name}"))
            carry.append(fn(f"_c_{name}").over(earlier).alias(f"_c_{name}"))
            merged = {"sum": F.coalesce(here + there, here, there),
                      "max": F.greatest(here, there), "min": F.least(here, there)}[kind]
            result.append(merged.alias(name))
    kept = [c for c in df.columns]
    summary = df.groupBy(*keys, CHUNK).agg(*totals).select(*keys, CHUNK, *carry)
    return df.select("*", *local).join(summary, [*keys, CHUNK], "left").select(*kept, *result)


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
               sides: Sequence[str] = ("prev", "next")) -> DataFrame:
    """Add ``prev_*`` / ``next_*`` structs' fields of the adjacent rows, across chunk borders."""
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    payload = F.struct(*[F.col(c) for c in cols])
    kept = list(df.columns)
    local, totals, carry, result = [], [], [], []
    for side in sides:
        step, edge = (F.lag, F.max_by) if side == "prev" else (F.lead, F.min_by)
        local.append(step(payload).over(inside).alias(f"_l_{side}"))
        totals.extend(edge(F.col(c), _order_struct(order)).alias(f"_c_{side}_{c}") for c in cols)
        carry.append(step(F.struct(*[F.col(f"_c_{side}_{c}").alias(c) for c in cols])).over(across).alias(f"_c_{side}"))
        both = F.coalesce(F.col(f"_l_{side}"), F.col(f"_c_{side}"))
        result.extend(both[c].alias(f"{side}_{c}") for c in cols)
    summary = df.groupBy(*keys, CHUNK).agg(*totals).select(*keys, CHUNK, *carry)
    return df.select("*", *local).join(summary, [*keys, CHUNK], "left").select(*kept, *result)
