"""One-step transitions, rewards, k-step subsampling, segment tables and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cases, fixed_text, minutes_between
from ..params import FEATURES, KEYS, FeatureProtocol, GapProtocol, RewardRule
from .features import scale_state
from .gaps import run_start, within
from .timeline import CHUNK, chunked, neighbours, running

K = list(KEYS)


def binary_reward(x: Column, rule: RewardRule) -> Column:
    return x.between(rule.low, rule.high).cast("double")


def utility_reward(x: Column, rule: RewardRule) -> Column:
    return cases([((x <= bound) if closed else (x < bound), u) for bound, closed, u in rule.steps], rule.above)


def tied_times(actions: DataFrame, exposures: DataFrame) -> DataFrame:
    """Times at which an action and an exposure share a timestamp."""
    return actions.select(*K, "ts").distinct().join(exposures.select(*K, "ts").distinct(), [*K, "ts"])


def transitions(features: DataFrame, actions: DataFrame, exposures: DataFrame, gap: GapProtocol,
                p: FeatureProtocol, reward: RewardRule) -> DataFrame:
    """State, next state, action, rewards from the next observation, validity and tie flags.

    The wide rows are shuffled and sorted once: tied times join their stream as rows, and the next state, the edge and
    segment numbers and the ties of a cell come from one scan and one summary row per (entity, chunk), which is
    added up before it is shuffled.  A cell has a tie if the last tied time before its end is not before its start.
    """
    no_time = F.lit(None).cast("timestamp_ntz")
    tied = tied_times(actions, exposures).select(*K, F.col("ts").alias("tau_t"), F.col("ts").alias("_tie"), F.lit(1).alias("_rank"))
    rows = chunked(features.withColumn("_tie", no_time).withColumn("_rank", F.lit(0)).unionByName(tied, allowMissingColumns=True),
                   K, "tau_t", gap.chunk_min)
    ok, before = within(F.col("gap_min"), gap.valid_min), within(F.col("prev_gap_min"), gap.valid_min)
    edge, start = F.col("tau_next").isNotNull().cast("long"), run_start(ok, before)

    at = F.when(F.col("_rank") == 0, F.col("tau_t"))
    totals = rows.groupBy(*K, CHUNK).agg(
        F.sum(edge).alias("_n"), F.sum(start).alias("_s"), F.min("_tie").alias("_lo"), F.max("_tie").alias("_hi"),
        F.min(at).alias("_head"), *[F.min_by(f, at).alias(f) for f in FEATURES])
    history = Window.partitionBy(*K)
    earlier = history.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    later = history.orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    head = F.when(F.col("_head").isNotNull(), F.struct(*FEATURES, F.col("_hi0").alias("_hi"), "_lo"))
    summary = totals.select(
        "*", F.max("_hi").over(earlier).alias("_hi0"), F.sum("_n").over(earlier).alias("_n0"), F.sum("_s").over(earlier).alias("_s0")).select(
        *K, CHUNK, "_n0", "_s0", F.last(head, ignorenulls=True).over(later).alias("_there"))

    w = Window.partitionBy(*K, CHUNK).orderBy("tau_t", "_rank")
    marked = rows.select(
        "*", F.max("_tie").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_seen"),
        F.coalesce(F.lead("_tie").over(w) == F.col("tau_t"), F.lit(False)).alias("tie_at_tau")).where("_rank = 0")
    w = Window.partitionBy(*K, CHUNK).orderBy("tau_t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    scanned = marked.select(
        "*", F.lead(F.struct(*FEATURES, "_seen")).over(w).alias("_here"), F.sum(edge).over(so_far).alias("_n"),
        F.sum(start).over(so_far).alias("_s")).where("tau_next IS NOT NULL").join(summary, [*K, CHUNK], "left")
    zero = F.lit(0).cast("long")
    t, here, there = F.col("tau_t"), F.col("_here"), F.col("_there")
    tie = F.when(here.isNotNull(), here["_seen"] >= t).otherwise((there["_hi"] >= t) | (there["_lo"] < F.col("tau_next")))
    x = F.col("next_value")
    count = F.coalesce("action_count", F.lit(0))
    return scanned.select(
        *K, CHUNK, F.lit(p.interval_min).alias("interval_min"), (F.col("_n") + F.coalesce("_n0", zero) - 1).alias("edge_index"),
        F.when(ok, F.col("_s") + F.coalesce("_s0", zero) - 1).otherwise(F.lit(-1).cast("long")).alias("segment_id"), "tau_t", "tau_next",
        F.col("gap_min").alias("duration_min"), "value", "next_value", (count > 0).cast("int").alias("action"), "action_count", "action_dose",
        binary_reward(x, reward).alias("reward_binary"), utility_reward(x, reward).alias("reward_weighted"),
        ok.alias("valid"), F.when(ok, F.lit("")).otherwise(F.concat(
            F.lit("gap_"), fixed_text(F.col("gap_min"), 3), F.lit("min_outside_[{},{}]".format(*gap.valid_min)))).alias("invalid_reason"),
        "override_active", "tie_at_tau", F.coalesce(tie, F.lit(False)).alias("tie_in_cell"),
        *[F.col(f).alias(f"raw__{f}") for f in FEATURES], *[F.coalesce(here[f], there[f]).alias(f"next_raw__{f}") for f in FEATURES])


def action_rows_by_cell(actions: DataFrame, cells: DataFrame, chunk_min: float) -> DataFrame:
    """The ordered action list of each cell as rows ``(cell, position)``: no list is ever collected."""
    events = actions.withColumn("_t", F.col("ts")).withColumn("_rank", F.lit(1))
    starts = cells.select(*K, F.col("tau_t").alias("_t"), F.lit(0).alias("_rank"), F.lit(0).cast("long").alias("ordinal"),
                          F.struct("tau_t", "tau_next", "actions_before").alias("_p"))
    stream = chunked(events.unionByName(starts, allowMissingColumns=True), K, "_t", chunk_min)
    seen = running(stream, K, ["_t", "_rank", "ordinal"], {
        "_no": ("sum", (F.col("_rank") == 1).cast("long")), "cell": ("last", F.col("_p"))})
    return seen.where((F.col("_rank") == 1) & (F.col("ts") < F.col("cell.tau_next"))).select(
        *K, F.col("cell.tau_t").alias("tau_t"), (F.col("_no") - F.col("cell.actions_before")).alias("position"),
        "ts", "ts_end", "kind", "dose")


def segment_starts(cells: DataFrame) -> DataFrame:
    return cells.where("valid").groupBy(*K, "segment_id").agg(F.min("edge_index").alias("_first"))


def subsample(cells: DataFrame, k: int, total_min: tuple[float, float], interval_min: float, reward: RewardRule,
              chunk_min: float) -> DataFrame:
    """Non-overlapping groups of ``k`` valid native edges inside each run; leftovers are dropped."""
    placed = cells.where("valid").join(segment_starts(cells), [*K, "segment_id"])
    group = F.floor((F.col("edge_index") - F.col("_first")) / k)
    macro = placed.groupBy(*K, F.col("segment_id").alias("native_segment"), group.alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.min("tau_t").alias("tau_t"), F.max("tau_next").alias("tau_next"),
        F.sum("action_count").alias("action_count"), F.max_by("next_value", "tau_next").alias("next_value")
    ).where(F.col("n") == k)
    gap = minutes_between(F.col("tau_t"), F.col("tau_next"))
    macro = macro.withColumn("duration_min", gap).withColumn("valid", within(gap, total_min))
    spread = chunked(macro, K, "tau_t", chunk_min)
    near = neighbours(spread, K, ["tau_t"], ["valid", "native_segment"], sides=("prev",))
    prev = F.coalesce(F.col("prev_valid") & (F.col("prev_native_segment") == F.col("native_segment")), F.lit(False))
    out = running(near, K, ["tau_t"], {"_s": ("sum", run_start(F.col("valid"), prev))})
    return out.select(
        *K, CHUNK, F.lit(interval_min).alias("interval_min"),
        F.when(F.col("valid"), F.col("_s") - 1).otherwise(F.lit(-1).cast("long")).alias("segment_id"),
        "tau_t", "tau_next", "duration_min", "valid", F.when(F.col("valid"), F.lit("")).otherwise(
            F.lit("total_gap_outside_bounds")).alias("invalid_reason"),
        "action_count", (F.col("action_count") > 0).cast("int").alias("action"),
        binary_reward(F.col("next_value"), reward).alias("reward_binary"),
        utility_reward(F.col("next_value"), reward).alias("reward_weighted"))


def build_metadata(obs: DataFrame, native: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Counts of candidates, unused native edges, segments and the largest invalid gap, per entity and interval."""
    zero = F.lit(0).cast("long")
    seen = obs.groupBy(*K).agg(F.count(F.lit(1)).alias("n_observations"))
    base = native.groupBy(*K).agg(
        F.count_if("valid").alias("_valid_native"), F.count_if(~F.col("valid")).alias("n_invalid_native_edges"),
        F.max(F.when(~F.col("valid"), F.col("duration_min"))).alias("_worst_native"))
    made = cells.groupBy(*K).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if("valid").alias("n_valid"),
        F.count_if(~F.col("valid")).alias("n_invalid"), (F.max("segment_id") + 1).alias("n_segments"),
        F.max(F.when(~F.col("valid"), F.col("duration_min"))).alias("_worst"),
        F.count_if(F.col("valid") & (F.col("action") == 1)).alias("n_action_positive"),
        F.first("interval_min").alias("interval_min"))
    out = seen.join(base, K).join(made, K, "left")
    return out.select(
        *K, "n_observations", *[F.coalesce(c, zero).alias(c) for c in (
            "n_candidates", "n_valid", "n_invalid", "n_invalid_native_edges", "n_segments", "n_action_positive")],
        (F.col("_valid_native") - k * F.coalesce("n_valid", zero)).alias("n_native_edges_unused"),
        F.coalesce(F.greatest("_worst_native", "_worst"), F.lit(0.0)).alias("max_invalid_gap_min"))


def flatten_valid(cells: DataFrame, p: FeatureProtocol) -> DataFrame:
    """One row per valid transition with its position in the segment and scaled states."""
    out = cells.where("valid").join(segment_starts(cells), [*K, "segment_id"]).withColumn(
        "transition_index", F.col("edge_index") - F.col("_first"))
    out = scale_state(out, p, "raw__", "state__")
    return scale_state(out, p, "next_raw__", "next_state__").drop("_first", CHUNK)


def segment_table(cells: DataFrame) -> DataFrame:
    return cells.where("valid").groupBy(*K, "interval_min", "segment_id").agg(
        F.count(F.lit(1)).alias("T"), F.min("tau_t").alias("start_ts"), F.max("tau_next").alias("end_ts"),
        F.sum("action").alias("action_1"), F.avg("action").alias("action_1_rate"))


def reward_distribution(cells: DataFrame) -> DataFrame:
    """Share of each reward value per entity, for both reward definitions."""
    both = F.explode(F.array(
        F.struct(F.lit("binary").alias("reward"), F.col("reward_binary").alias("reward_value")),
        F.struct(F.lit("weighted").alias("reward"), F.col("reward_weighted").alias("reward_value"))))
    rows = cells.where("valid").select(*K, "interval_min", both.alias("r")).select(*K, "interval_min", "r.*")
    counts = rows.groupBy(*K, "interval_min", "reward", "reward_value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(*K, "interval_min", "reward").agg(F.sum("n").alias("_t"))
    return counts.join(total, [*K, "interval_min", "reward"]).select(
        *K, "interval_min", "reward", "reward_value", "n", (F.col("n") / F.col("_t")).alias("proportion"))


def violations(cells: DataFrame, located: DataFrame | None = None) -> DataFrame:
    """Rows that break an invariant, one row per broken rule; empty when the table is sound."""
    finite = F.lit(True)
    for f in FEATURES:
        if f"raw__{f}" in cells.columns:
            for c in (F.col(f"raw__{f}"), F.col(f"next_raw__{f}")):
                finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    rules = {
        "strictly_increasing_boundaries": F.col("tau_t") < F.col("tau_next"),
        "finite_states": finite,
        "binary_action": F.col("action").isin(0, 1),
        "segment_only_when_valid": F.col("valid") == (F.col("segment_id") >= 0),
        "reward_present": F.col("reward_binary").isNotNull() & F.col("reward_weighted").isNotNull(),
    }
    broken = F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))
    out = cells.select(*K, "tau_t", broken.alias("rule"))
    if located is not None:
        outside = ~((F.col("ts") >= F.col("tau_t")) & (F.col("ts") < F.col("tau_next")))
        out = out.unionByName(located.where(outside).select(*K, "tau_t", F.lit("action_inside_cell").alias("rule")))
    return out


def raise_if_any(found: DataFrame) -> None:
    bad = found.limit(5).collect()
    if bad:
        raise ValueError(f"invariant violated: {[r.asDict() for r in bad]}")


def invariant_report(cells: DataFrame) -> DataFrame:
    v = F.col("valid")
    return cells.groupBy("interval_min").agg(
        F.bool_and(F.col("tau_t") < F.col("tau_next")).alias("boundaries_increase"),
        F.bool_and(F.col("action").isin(0, 1)).alias("actions_binary"),
        F.bool_and((F.col("action") == 1) == (F.col("action_count") > 0)).alias("action_matches_events"),
        F.bool_and(~v | (F.col("segment_id") >= 0)).alias("valid_in_segment"),
        F.bool_and(v | (F.col("segment_id") == -1)).alias("invalid_outside_segments"),
        F.bool_and(F.col("reward_binary").isNotNull()).alias("reward_observed"))
