"""Strictly causal state features at every observation: nothing later than its time is read."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import MINUTE_US, micros
from ..params import KEYS, FeatureProtocol
from .timeline import CHUNK, with_halo

K = list(KEYS)


def _us(minutes: float) -> int:
    return int(minutes * MINUTE_US)


def _winning_overrides(schema: pa.Schema):
    """Where the override in force changes: a sweep over rows sorted by (entity, chunk, begin).

    The latest begin wins, the lowest ordinal on ties; ``rate`` is null where none is active. The active overrides
    are a heap that an ended one leaves when it reaches the top, so n overrides cost n log n however they overlap,
    and nothing else is kept of a history, whatever its size.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, active, made = None, [], []

        def mark(t: int) -> None:
            rate = active[0][3] if active else None
            if made and made[-1][:-2] == here and made[-1][-2] == t:
                made.pop()
            made.append((*here, t, rate))

        def advance(to: float) -> None:
            """Let overrides end up to and at ``to``; each end of a winner is a change."""
            while active and active[0][2] <= to:
                now = active[0][2]
                while active and active[0][2] <= now:
                    heapq.heappop(active)
                mark(now)

        for batch in batches:
            for *key, t, e, ordinal, rate in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if tuple(key) != here:
                    advance(math.inf)
                    here, active = tuple(key), []
                advance(t)
                heapq.heappush(active, (-t, math.inf if ordinal is None else ordinal, e, rate))
                mark(t)
            held = made[-1:]  # the next row may begin at the same time
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made[:-1], strict=True), schema, strict=True)]
                                             if len(made) > 1 else [pa.array([], f.type) for f in schema], schema=schema)
            made[:] = held
        advance(math.inf)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return sweep


def rate_marks(steps: DataFrame, schedule: DataFrame, overrides: DataFrame, p: FeatureProtocol) -> DataFrame:
    """Where the scheduled rate (``plan``) and the override in force (``over``) change, per (entity, chunk).

    A chunk's marks answer every time from ``rate_mean_min`` before its start to its end.  Overrides are swept
    where they reach; a schedule entry goes to the chunk of its time and to those whose lookback meets it, and
    the entry still in force before that is carried in by a scan over one row per (entity, chunk).
    Of several entries at one time the first in document order counts.
    """
    width, look = F.lit(_us(p.chunk_min)), _us(p.rate_mean_min)
    spans = overrides.where("ts_end > ts_begin").select(
        *K, micros("ts_begin").alias("t"), micros("ts_end").alias("e"), F.col("ordinal").alias("ord"),
        F.col("rate").cast("double").alias("o_rate"))
    spans = with_halo(spans, F.col("t"), F.col("e") - 1 + look, p.chunk_min)
    rows = spans.select(*K, CHUNK, "t", "e", "ord", "o_rate").repartition(*K, CHUNK).sortWithinPartitions(*K, CHUNK, "t")
    marks = rows.select(*K, CHUNK, "t", F.col("o_rate").alias("rate"))
    over = rows.mapInArrow(_winning_overrides(to_arrow_schema(marks.schema)), marks.schema)
    over = over.select(*K, CHUNK, "t", F.struct("rate").alias("over"))
    plan = schedule.groupBy(*K, "ts").agg(F.min_by("rate", "ordinal").alias("rate")).select(
        *K, micros("ts").alias("t"), F.struct(F.col("rate").cast("double").alias("rate")).alias("plan"))
    near = with_halo(plan, F.col("t"), F.col("t") + look, p.chunk_min).select(*K, CHUNK, "t", "plan")
    asked = steps.select(*K, F.floor(micros("tau_t") / width).cast("long").alias(CHUNK), F.lit(None).cast("long").alias("t"),
                         F.lit(None).cast(plan.schema["plan"].dataType).alias("plan"), F.lit(True).alias("_asked"))
    gone = plan.withColumn(CHUNK, F.floor((F.col("t") + look) / width).cast("long"))
    known = F.when(F.col("t").isNotNull(), F.struct("t", "plan"))
    summary = asked.unionByName(gone, True).groupBy(*K, CHUNK).agg(F.max_by(known, "t").alias("_last"), F.max("_asked").alias("_asked"))
    earlier = Window.partitionBy(*K).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).where(
        F.col("_asked") & F.col("_before").isNotNull()).select(*K, CHUNK, "_before.t", "_before.plan")
    return near.unionByName(carried).unionByName(over, True)


def state_features(steps: DataFrame, actions: DataFrame, exposures: DataFrame, schedule: DataFrame,
                   overrides: DataFrame, p: FeatureProtocol = FeatureProtocol()) -> DataFrame:
    """The step table with its raw state columns, from a scan over the observations and one over all records.

    The first gives each observation its statistics of earlier ones, so that only observations are copied for the longest
    lookback and only the originals go on.  They, instantaneous doses, begin/end breakpoints of extended doses, exposures and changes of
    the rate are merged into one stream per (entity, chunk); each row is copied only to the chunks its longest
    lookback reaches.  Extended delivery is piecewise linear, so its amount and its linear-decay
    integral follow from running sums of slope changes: no observation is paired with an event.
    The rate at a time is the override then in force, else the schedule's latest entry, else 0; its mean over
    the left-endpoint grid of the trailing window reads the last change before each grid point from range frames.
    """
    look_obs = max(*p.slope_min, *p.stats_min)
    look_act = max(*p.delivery_min, p.residual_horizon_min, p.since_cap_min)
    look_exp = max(*p.exposure_min, p.since_cap_min)
    payload = [c for c in steps.columns if c not in (*K, CHUNK)]
    obs = steps.select(*K, micros("tau_t").alias("t"), F.col("value").alias("v"), F.struct(*payload).alias("row"))
    obs = with_halo(obs, F.col("t"), F.col("t") + _us(look_obs), p.chunk_min).withColumn("row", F.when(F.col("_own"), F.col("row")))
    begin, end = micros("ts"), micros("ts_end")
    summed = actions.groupBy(*K, "ts", "ts_end").agg(F.sum("dose").alias("dose"))
    width = F.lit(_us(p.chunk_min))
    inside = F.col("t") - F.col(CHUNK) * width
    w = Window.partitionBy(*K, CHUNK).orderBy("t")

    def span(lo: float | None, hi: int) -> Window:
        return w.rangeBetween(Window.unboundedPreceding if lo is None else int(lo), hi)

    s1, s2 = p.stats_min
    stats = {
        "slope_short": F.coalesce(F.regr_slope("v", "x").over(span(-_us(p.slope_min[0]), 0)), F.lit(0.0)),
        "slope_long": F.coalesce(F.regr_slope("v", "x").over(span(-_us(p.slope_min[1]), 0)), F.lit(0.0)),
        "mean_short": F.avg("v").over(span(-_us(s1), 0)), "std_short": F.stddev_pop("v").over(span(-_us(s1), 0)),
        "mean_long": F.avg("v").over(span(-_us(s2), 0)), "std_long": F.stddev_pop("v").over(span(-_us(s2), 0)),
        "_n": F.count("v").over(span(-_us(s1), 0)),
    }
    obs = obs.withColumn("x", inside / F.lit(float(MINUTE_US))).select("*", *[c.alias(n) for n, c in stats.items()]).where("_own").drop("x")
    doses = with_halo(summed.select(*K, begin.alias("t"), F.greatest(begin, end).alias("e"), "dose"), F.col("t"),
                      F.col("e") + _us(look_act), p.chunk_min)
    instant = F.col("e") <= F.col("t")
    slope = F.col("dose") / ((F.col("e") - F.col("t")) / F.lit(float(MINUTE_US)))
    marks = F.when(instant, F.array(F.struct(
        F.col("t").alias("t"), F.col("dose").alias("dose"), F.lit(None).cast("double").alias("ds"), F.col("t").alias("act"))
    )).otherwise(F.array(
        F.struct(F.col("t").alias("t"), F.lit(None).cast("double").alias("dose"), slope.alias("ds"), F.col("t").alias("act")),
        F.struct(F.col("e").alias("t"), F.lit(None).cast("double").alias("dose"), (-slope).alias("ds"),
                 F.lit(None).cast("long").alias("act"))))
    doses = doses.select(*K, CHUNK, F.explode(marks).alias("m")).select(*K, CHUNK, "m.*")
    exp = exposures.groupBy(*K, "ts").agg(F.sum("amount").alias("amount")).select(*K, micros("ts").alias("t"), "amount")
    exp = with_halo(exp, F.col("t"), F.col("t") + _us(look_exp), p.chunk_min).select(
        *K, CHUNK, "t", "amount", F.col("t").alias("exp"))
    marks = rate_marks(steps, schedule, overrides, p)
    stream = obs.unionByName(doses, True).unionByName(exp, True).unionByName(marks, True).repartition(*K, CHUNK)
    stream = stream.withColumn("x", inside / F.lit(float(MINUTE_US)))

    def total(c: Column, lo: float | None, hi: int) -> Column:
        return F.coalesce(F.sum(c).over(span(lo, hi)), F.lit(0.0))

    ds, b = F.col("ds"), F.col("x")
    h = p.residual_horizon_min
    cols = {
        "_a0": total(ds, None, 0), "_b0": total(ds * b, None, 0), "_c0": total(ds * b * b, None, 0),
        "_ah": total(ds, None, -_us(h)), "_bh": total(ds * b, None, -_us(h)), "_ch": total(ds * b * b, None, -_us(h)),
        "_ih": total(F.col("dose"), -_us(h) + 1, -1), "_jh": total(F.col("dose") * b, -_us(h) + 1, -1),
        "_act": F.max("act").over(span(None, -1)), "_exp": F.max("exp").over(span(None, 0)),
    }
    for tag, m in zip(("short", "long"), p.delivery_min):
        cols[f"_a{tag}"], cols[f"_b{tag}"] = total(ds, None, -_us(m)), total(ds * b, None, -_us(m))
        cols[f"_i{tag}"] = total(F.col("dose"), -_us(m), -1)
    count = int(round(p.rate_mean_min / p.rate_step_min))
    for k in range(count + 1):
        for c in ("plan", "over"):
            cols[f"_{c}{k}"] = F.last(c, ignorenulls=True).over(span(None, -k * _us(p.rate_step_min)))
    for tag, m in zip(("short", "long"), p.exposure_min):
        cols[f"exposure_{tag}"] = total(F.col("amount"), -_us(m) + 1, 0)
    out = stream.select("*", *[c.alias(n) for n, c in cols.items()]).where("_own")
    x = F.col("x")

    def delivered(at: Column, a: str, bb: str) -> Column:
        return at * F.col(a) - F.col(bb)

    def area(at: Column, tag: str) -> Column:
        return (at * at * F.col(f"_a{tag}") - 2.0 * at * F.col(f"_b{tag}") + F.col(f"_c{tag}")) / 2.0

    residual = (
        delivered(x, "_a0", "_b0") - (area(x, "0") - area(x - h, "h")) / h
        + F.col("_ih") * (1.0 - x / h) + F.col("_jh") / h)
    rates = [F.coalesce(F.col(f"_over{k}")["rate"], F.col(f"_plan{k}")["rate"], F.lit(0.0)) for k in range(count + 1)]
    gap = F.col("row.prev_gap_min")
    hour = F.hour("row.tau_t") + F.minute("row.tau_t") / 60.0 + F.floor(F.second("row.tau_t")) / 3600.0
    angle = F.lit(2.0 * math.pi) * hour / 24.0
    minute = F.lit(float(MINUTE_US))
    made = {
        "value_current": F.col("v"),
        "value_delta": F.when(gap <= p.max_gap_min, F.col("v") - F.col("row.prev_value")).otherwise(0.0),
        **{f"delivered_{t}": F.col(f"_i{t}") + delivered(x, "_a0", "_b0") - delivered(x - m, f"_a{t}", f"_b{t}")
           for t, m in zip(("short", "long"), p.delivery_min)},
        "residual_exposure": F.greatest(residual, F.lit(0.0)),
        "since_action": F.least(F.coalesce((F.col("t") - F.col("_act")) / minute, F.lit(p.since_cap_min)), F.lit(p.since_cap_min)),
        "since_exposure": F.least(F.coalesce((F.col("t") - F.col("_exp")) / minute, F.lit(p.since_cap_min)), F.lit(p.since_cap_min)),
        "time_of_day_sin": F.sin(angle), "time_of_day_cos": F.cos(angle),
        "previous_gap": F.least(F.coalesce(gap, F.lit(p.interval_min)), F.lit(p.gap_cap_min)),
        "missing_fraction": F.greatest(
            F.lit(0.0), 1.0 - F.least(F.col("_n"), F.lit(p.expected_short)) / F.lit(float(p.expected_short))),
        "rate_current": rates[0], "rate_mean": sum(rates[2:], rates[1]) / float(count),
        "override_active": F.col("_over0")["rate"].isNotNull(),
    }
    ready = ["slope_short", "slope_long", "mean_short", "std_short", "mean_long", "std_long",
             "exposure_short", "exposure_long"]
    return out.select(*K, "row.*", *ready, *[c.alias(n) for n, c in made.items()])


def scale_state(df: DataFrame, p: FeatureProtocol, prefix: str = "", out: str = "state__") -> DataFrame:
    """Fixed-constant scaling (never fitted) of every feature column."""
    missing = [f for f in p.scaling if prefix + f not in df.columns]
    if missing:
        raise ValueError(f"state columns missing from input: {missing}")
    return df.select("*", *[
        ((F.col(prefix + f) - F.lit(float(c))) / F.lit(float(s))).alias(out + f) for f, (c, s) in p.scaling.items()])


def state_vector(prefix: str, p: FeatureProtocol) -> Column:
    return F.array(*[F.col(prefix + f) for f in p.scaling])
