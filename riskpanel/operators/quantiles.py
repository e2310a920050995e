"""Exact linear-interpolation quantiles that stay distributed for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Value buckets are 2**-10 of an octave wide, so a group has at most a fixed number of buckets
# whatever its row count, and one bucket spans less than 0.1 % of its value.
_PER_OCTAVE = 1024
_SMALLEST = 1e-6


def value_bucket(v: Column) -> Column:
    """Monotone bucket number of a double."""
    size = F.log2(1.0 + F.abs(v) / F.lit(_SMALLEST)) * _PER_OCTAVE
    return F.floor(F.signum(v) * size).cast("int")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value, probs: Mapping[str, float], few: bool = False) -> DataFrame:
    """One row per ``keys`` with one column per named probability; NULL and NaN values are skipped.

    Distinct values are counted with map-side combination, bucket totals give prefix counts, and
    only the buckets that contain a wanted rank are sorted.  No task holds a whole group.
    With ``few``, for keys whose number is bounded by the design, buckets are counted first and their wanted ones broadcast:
    other rows are read again but never shuffled.
    """
    v = F.col(value) if isinstance(value, str) else value
    keys = list(keys)
    group = keys or ["_all"]
    flat = df.select(*keys, v.cast("double").alias("_v"))
    if not keys:
        flat = flat.withColumn("_all", F.lit(1))
    flat = flat.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_b", value_bucket(F.col("_v")))
    cells = (flat.withColumn("_n", F.lit(1)) if few else
             flat.groupBy(*group, "_b", "_v").agg(F.count(F.lit(1)).alias("_n")))
    names, ps = list(probs), [float(p) for p in probs.values()]
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        cells.groupBy(*group, "_b").agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
        .withColumn("_tot", F.sum("_bn").over(Window.partitionBy(*group))))
    rank = [F.lit(p) * (F.col("_tot") - 1) for p in ps]
    hit = F.lit(False)
    for r in rank:
        for edge in {"lo": F.floor(r), "hi": F.ceil(r)}.values():
            hit = hit | ((edge >= F.col("_before")) & (edge < F.col("_before") + F.col("_bn")))
    wanted = totals.where(hit).select(*group, "_b", "_before", "_tot")
    inside = Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = cells.join(F.broadcast(wanted) if few else wanted, [*group, "_b"])
    if few:
        near = near.groupBy(*group, "_b", "_before", "_tot", "_v").agg(F.sum("_n").alias("_n"))
    ranked = (
        near
        .withColumn("_c1", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_c0", F.col("_c1") - F.col("_n")))
    aggs = [F.max("_tot").alias("_tot")]
    for i, r in enumerate(rank):
        for tag, edge in (("l", F.floor(r)), ("h", F.ceil(r))):
            aggs.append(F.max(F.when((edge >= F.col("_c0")) & (edge < F.col("_c1")), F.col("_v"))).alias(f"_{tag}{i}"))
    return ranked.groupBy(*group).agg(*aggs).select(*keys, *[
        (F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (rank[i] - F.floor(rank[i]))).alias(n)
        for i, n in enumerate(names)])


def exact_quantile_table(df: DataFrame, keys: Sequence[str], values: Mapping[str, Column],
                         probs: Mapping[str, float], few: bool = False) -> DataFrame:
    """Quantiles of several measures in one pass; columns are named ``<measure>_<probability name>``."""
    keys = list(keys)
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("m"), v.cast("double").alias("x")) for n, v in values.items()])).alias("_s"))
    q = exact_quantiles(long.select(*keys, F.col("_s.m").alias("_m"), F.col("_s.x").alias("_x")),
                        [*keys, "_m"], "_x", probs, few)
    return q.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_m") == n, F.col(p))).alias(f"{n}_{p}") for n in values for p in probs])


# Groups of at most so many rows are taken whole by the task that has them.
WHOLE_ROWS = 10_000


def grouped_distributions(rows: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """(keys, ``feature``, n, mean, sd, quantiles) of every column of ``values``, for any number of groups of any size.

    A row travels once with all its columns, and a group of up to ``WHOLE_ROWS`` rows is summed up by one task. Larger groups, of which
    there are fewer than a ten-thousandth of the rows, go through ``exact_quantiles``.
    """
    group, names = list(keys), list(values)
    large = F.broadcast(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > WHOLE_ROWS).select(*group))
    stats = [F.struct(
        F.lit(c).alias("feature"), F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"),
        F.percentile(F.when(~F.isnan(c), F.col(c)), [float(p) for p in probs.values()]).alias("q")) for c in names]
    whole = rows.join(large, group, "left_anti").repartition(*group).groupBy(*group).agg(F.array(*stats).alias("_s"))
    whole = whole.select(*group, F.explode("_s").alias("_s")).select(
        *group, "_s.feature", "_s.n", "_s.mean", "_s.sd", *[F.col("_s.q")[i].alias(p) for i, p in enumerate(probs)])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("_x")) for c in names])).alias("_p")
    long = rows.join(large, group, "left_semi").select(*group, pairs).select(*group, "_p.feature", "_p._x")
    group = [*group, "feature"]
    base = long.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("sd"))
    return whole.unionByName(base.join(exact_quantiles(long, group, "_x", probs), group))


def cumulative_cells(df: DataFrame, keys: Sequence[str], value: Column, counts: Mapping[str, Column]) -> DataFrame:
    """Distinct values with summed ``counts``, their totals strictly below (``*_below``) and overall (``*_total``)."""
    group = list(keys) or ["_all"]
    flat = df.select(*keys, value.cast("double").alias("_v"), *[c.alias(n) for n, c in counts.items()])
    if not keys:
        flat = flat.withColumn("_all", F.lit(1))
    cells = flat.where(F.col("_v").isNotNull()).withColumn("_b", value_bucket(F.col("_v"))).groupBy(
        *group, "_b", "_v").agg(*[F.sum(n).alias(n) for n in counts])
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    totals = cells.groupBy(*group, "_b").agg(*[F.sum(n).alias(n) for n in counts]).select(
        *group, "_b", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_c_{n}") for n in counts],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in counts])
    inside = Window.partitionBy(*group, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(totals, [*group, "_b"]).select(
        *keys, F.col("_v").alias("value"), *counts, *[f"{n}_total" for n in counts],
        *[(F.col(f"_c_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_below") for n in counts])
