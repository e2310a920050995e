"""Landmark entry, monotone follow-up, two-sided support over trajectories, Pareto frontier."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cases, half_even, lit_rows, minutes_between, ratio
from ..params import KEYS
from .gaps import within
from .quantiles import exact_quantile_table, exact_quantiles
from .timeline import CHUNK, chunked, running

K = list(KEYS)
# Follow-up fractions and the focus range of the feasibility summary.
FRACTIONS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
FOCUS = (0.2, 0.8)
OBJECTIVES = ("eligible_entities", "median_T", "total_transitions", "total_action_positive", "worst_side_action",
              "minimum_active")


@dataclass(frozen=True)
class LandmarkRule:
    max_entry_delay_min: float = 5.0
    record_burnin_min: float = 240.0
    burnin_edges: int = 24
    burnin_gap_min: tuple[float, float] = (4.0, 6.0)
    legal_gap_min: tuple[float, float] = (4.0, 6.0)
    genuine_gap_min: float = 7.5
    minimum_transitions: int = 1
    chunk_min: float = 7 * 1440.0


def followup_index(steps: DataFrame, rule: LandmarkRule, entry_phase: Column | None = None) -> DataFrame:
    """Every observation with its position, legal-run number, burn-in length and action counter."""
    legal = within(F.col("gap_min"), rule.legal_gap_min)
    burn = within(F.col("prev_gap_min"), rule.burnin_gap_min)
    acted = (F.coalesce("action_count", F.lit(0)) > 0).cast("long")
    one = F.lit(1).cast("long")
    allowed = F.lit(True) if entry_phase is None else entry_phase
    base = steps.select(*K, CHUNK, "tau_t", "tau_next", "prev_ts", "gap_min", legal.alias("_legal"), acted.alias("_act"),
                        burn.alias("_burn"), allowed.alias("_allowed"))
    numbered = running(base, K, ["tau_t"], {
        "_i": ("sum", one), "_g": ("sum", (~F.col("_legal")).cast("long")), "_a": ("sum", F.col("_act")),
        "_b": ("sum", F.when(F.col("_burn"), one).otherwise(0)),
        "clock_start": ("all_min", F.col("tau_t")), "entry_from": ("all_min", F.when(F.col("_allowed"), F.col("tau_t"))),
        "entry_to": ("all_max", F.when(F.col("_allowed"), F.col("tau_t")))})
    numbered = numbered.withColumn("_reset", F.when(~F.col("_burn"), F.col("_i")))
    placed = running(numbered, K, ["tau_t"], {"_broken": ("max", F.col("_reset"))})
    return placed.select(
        *K, CHUNK, "tau_t", "tau_next", "prev_ts", "gap_min", (F.col("_i") - 1).alias("idx"),
        (F.col("_g") - (~F.col("_legal")).cast("long")).alias("run"), (F.col("_a") - F.col("_act")).alias("acts_before"),
        (F.col("_i") - F.col("_broken")).alias("burnin"), "clock_start", "entry_from", "entry_to")


def landmark_trajectories(index: DataFrame, landmarks_h: Sequence[float], rule: LandmarkRule, clock: str) -> DataFrame:
    """One row per entity and landmark: entry, eligibility, follow-up until the first illegal edge.

    An observation is the entry of exactly those landmarks that fall between its predecessor and
    itself, so the forward as-of needs no join and no per-landmark scan.
    """
    marks = F.array(*[F.lit(float(h)) for h in landmarks_h])

    def target(h: Column) -> Column:
        return F.greatest(F.col("clock_start") + F.make_dt_interval(mins=(h * 60).cast("int")), F.col("entry_from"))

    mine = F.filter(marks, lambda h: (target(h) <= F.col("tau_t"))
                    & (F.col("prev_ts").isNull() | (F.col("prev_ts") < target(h))))
    entries = index.select(*K, F.explode(mine).alias("landmark_h"), F.col("tau_t").alias("_entry"),
                           F.col("idx").alias("entry_idx"), "run", F.col("acts_before").alias("_a0"), "burnin")
    ends = index.groupBy(*K, "run").agg(
        F.max("idx").alias("_last"), F.max("tau_t").alias("_end"), F.max_by("gap_min", "idx").alias("_gap"),
        F.max("acts_before").alias("_a1"))
    everyone = index.groupBy(*K).agg(
        F.min("clock_start").alias("clock_start"), F.max("entry_to").alias("entry_to")).withColumn("landmark_h", F.explode(marks))
    rows = everyone.join(entries, [*K, "landmark_h"], "left").join(ends, [*K, "run"], "left")
    goal = F.col("clock_start") + F.make_dt_interval(mins=(F.col("landmark_h") * 60).cast("int"))
    rows = rows.withColumn("target_ts", goal).withColumn("delay", minutes_between(goal, F.col("_entry"))).withColumn(
        "age", minutes_between(F.col("clock_start"), F.col("_entry")))
    block = cases([
        (F.col("_entry").isNull(), "no_observation_at_or_after_landmark"),
        (F.col("_entry") > F.col("entry_to"), "landmark_outside_allowed_window"),
        ((F.col("delay") < 0) | (F.col("delay") >= rule.max_entry_delay_min), "no_boundary_within_entry_tolerance"),
        (F.col("age") < rule.record_burnin_min, "insufficient_record_burnin"),
        (F.col("entry_idx") < rule.burnin_edges, "insufficient_history_burnin"),
        (F.col("burnin") < rule.burnin_edges, "noncontinuous_history_burnin")], "")
    rows = rows.withColumn("_block", block).withColumn("state_eligible", F.col("_block") == "")
    ok = F.col("state_eligible")
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("T", F.when(ok, F.col("_last") - F.col("entry_idx")).otherwise(zero)).withColumn(
        "A1", F.when(ok, F.col("_a1") - F.col("_a0")).otherwise(zero))
    stop = cases([
        (F.col("_gap").isNull(), "record_termination"), (F.col("_gap") > rule.genuine_gap_min, "genuine_gap")],
        "non_genuine_illegal_edge")
    days = minutes_between(F.col("_entry"), F.col("_end")) / 1440.0
    shown = ~F.col("_block").isin("no_observation_at_or_after_landmark", "landmark_outside_allowed_window")
    return rows.select(
        *K, F.lit(clock).alias("clock"), "landmark_h", "target_ts", F.when(shown, F.col("_entry")).alias("entry_ts"),
        F.when(shown, F.col("delay")).alias("entry_delay_min"), ok.alias("state_eligible"),
        (ok & (F.col("T") >= rule.minimum_transitions)).alias("trajectory_eligible"), "T", "A1",
        F.when(ok & (days > 0), F.col("A1") / days).alias("actions_per_day"),
        F.when(ok, stop).otherwise(F.lit("")).alias("censor_reason"), F.when(ok, F.col("_gap")).alias("censor_gap_min"),
        F.when(ok, F.col("_end")).alias("end_ts"), F.when(ok, F.col("entry_idx")).alias("entry_idx"),
        F.when(ok & (F.col("T") == 0), F.lit("state_available_but_zero_followup")).otherwise(F.col("_block")).alias("ineligible_reason"))


def action_vectors(index: DataFrame, trajectories: DataFrame) -> DataFrame:
    """The action of every follow-up edge, one row per (entity, landmark, position)."""
    edge = index.select(*K, "idx", "acts_before", "tau_t")
    keep = trajectories.where("trajectory_eligible").select(*K, "clock", "landmark_h", "entry_idx", "T")
    at = keep.withColumn("position", F.explode(F.sequence(F.lit(0).cast("long"), F.col("T")))).withColumn(
        "idx", F.col("entry_idx") + F.col("position"))
    here = at.join(edge, [*K, "idx"])
    after = here.select(*K, "clock", "landmark_h", (F.col("position") - 1).alias("position"), F.col("acts_before").alias("_next"))
    return here.where(F.col("position") < F.col("T")).join(after, [*K, "clock", "landmark_h", "position"]).select(
        *K, "clock", "landmark_h", "position", "tau_t", (F.col("_next") > F.col("acts_before")).cast("int").alias("action"))


def side_support(index: DataFrame, trajectories: DataFrame, cuts: DataFrame) -> DataFrame:
    """Support on both sides of each cut ``(clock, landmark_h, u, ...)``.

    The actions left of a cut are a difference of two counters, looked up at the cut's position;
    trajectories are never expanded into their steps.
    """
    keys = [c for c in cuts.columns if c != "u"]
    live = trajectories.where("trajectory_eligible").select(*K, "clock", "landmark_h", "T", "A1", "entry_idx")
    want = live.join(cuts, ["clock", "landmark_h"]).withColumn("idx", F.col("entry_idx") + F.least("u", "T"))
    start = index.select(*K, F.col("idx").alias("entry_idx"), F.col("acts_before").alias("_a0"))
    at = index.select(*K, "idx", F.col("acts_before").alias("_au"))
    x = want.join(start, [*K, "entry_idx"]).join(at, [*K, "idx"]).select(
        *keys, "u", "entity_id", F.least("u", "T").alias("lt"), F.greatest(F.col("T") - F.col("u"), F.lit(0)).alias("rt"),
        (F.col("_au") - F.col("_a0")).alias("la"), (F.col("A1") - (F.col("_au") - F.col("_a0"))).alias("ra"))
    first = -F.col("entity_id")
    g = x.groupBy(*keys, "u").agg(
        F.count_if(F.col("lt") > 0).alias("left_entities"), F.count_if(F.col("rt") > 0).alias("active_at_u"),
        F.sum("lt").alias("left_transitions"), F.sum("la").alias("left_A1"), F.sum("rt").alias("right_transitions"),
        F.sum("ra").alias("right_A1"), F.max("la").alias("_ml"), F.max("ra").alias("_mr"),
        F.max_by("entity_id", F.struct(F.col("la"), first)).alias("_el"), F.max_by("entity_id", F.struct(F.col("ra"), first)).alias("_er"))
    return g.select(
        *keys, "u", "left_entities", "active_at_u", "left_transitions", (F.col("left_transitions") - F.col("left_A1")).alias("left_A0"),
        "left_A1", "right_transitions", (F.col("right_transitions") - F.col("right_A1")).alias("right_A0"), "right_A1",
        ratio(F.col("_ml"), F.col("left_A1")).alias("left_max_A1_share"), ratio(F.col("_mr"), F.col("right_A1")).alias("right_max_A1_share"),
        F.when(F.col("left_A1") > 0, F.col("_el")).alias("left_dominant_entity"),
        F.when(F.col("right_A1") > 0, F.col("_er")).alias("right_dominant_entity"))


GROUP = ["clock", "landmark_h"]


def longest(trajectories: DataFrame) -> DataFrame:
    return trajectories.where("trajectory_eligible").groupBy(*GROUP).agg(F.max("T").alias("t_max"))


def fraction_cuts(trajectories: DataFrame, fractions: Sequence[float] = FRACTIONS) -> DataFrame:
    f = F.explode(F.array(*[F.lit(float(x)) for x in fractions])).alias("fraction")
    return longest(trajectories).select(*GROUP, f, "t_max").withColumn(
        "u", F.greatest(F.lit(1), half_even(F.col("fraction") * F.col("t_max"))).cast("long")).drop("t_max")


def grid_cuts(trajectories: DataFrame, step: int) -> DataFrame:
    """Cuts at every ``step`` transitions strictly inside the longest trajectory."""
    last = F.col("t_max") - 1
    return longest(trajectories).where(last >= step).select(
        *GROUP, F.explode(F.sequence(F.lit(step).cast("long"), last, F.lit(step).cast("long"))).alias("u"))


def landmark_summary(trajectories: DataFrame, fractions: DataFrame) -> DataFrame:
    """Feasibility summary per clock and landmark, with worst-case support over the focus fractions."""
    e = F.col("trajectory_eligible")
    zero = F.lit(0).cast("long")
    base = trajectories.groupBy(*GROUP).agg(
        F.count_if("state_eligible").alias("state_eligible_entities"), F.count_if(e).alias("eligible_entities"),
        F.count_if(~e).alias("ineligible_entities"), F.coalesce(F.min(F.when(e, F.col("T"))), zero).alias("min_T"),
        F.coalesce(F.max(F.when(e, F.col("T"))), zero).alias("max_T"), F.coalesce(F.sum(F.when(e, F.col("T"))), zero).alias("total_transitions"),
        F.coalesce(F.sum(F.when(e, F.col("A1"))), zero).alias("total_action_positive"),
        F.coalesce(F.min(F.when(e, F.col("A1"))), zero).alias("min_A1"), F.coalesce(F.max(F.when(e, F.col("A1"))), zero).alias("max_A1"),
        F.count_if(e & (F.col("A1") == 0)).alias("entities_zero_A1"), F.max(F.when(e, F.col("entry_delay_min"))).alias("entry_delay_max"),
        F.count_if(e & (F.col("censor_reason") == "genuine_gap")).alias("censored_genuine_gap"),
        F.count_if(e & (F.col("censor_reason") == "non_genuine_illegal_edge")).alias("censored_timing_edge"))
    q = exact_quantile_table(trajectories.where(e), GROUP, {
        "T": F.col("T"), "A1": F.col("A1"), "rate": F.col("actions_per_day"), "delay": F.col("entry_delay_min")}, {"median": 0.5})
    focus = fractions.where(F.col("fraction").between(*FOCUS)).groupBy(*GROUP).agg(
        F.min(F.least("left_A1", "right_A1")).alias("worst_side_action"), F.min("active_at_u").alias("minimum_active"),
        F.max(F.greatest("left_max_A1_share", "right_max_A1_share")).alias("maximum_dominance"))
    out = base.join(q, GROUP, "left").join(focus, GROUP, "left")
    return out.select(
        *base.columns, (F.col("total_transitions") - F.col("total_action_positive")).alias("total_A0"),
        (100.0 * ratio(F.col("total_action_positive"), F.col("total_transitions"))).alias("action_pct"),
        F.coalesce("T_median", F.lit(0.0)).alias("median_T"), F.coalesce("A1_median", F.lit(0.0)).alias("median_A1"),
        F.col("rate_median").alias("median_actions_per_day"), F.col("delay_median").alias("entry_delay_median"),
        F.coalesce("worst_side_action", zero).alias("worst_side_action"), F.coalesce("minimum_active", zero).alias("minimum_active"),
        "maximum_dominance")


def active_curve(trajectories: DataFrame, step: int) -> DataFrame:
    """Entities still followed after 0, step, 2*step, ... transitions, plus the terminal zero."""
    live = trajectories.where("trajectory_eligible")
    bins = live.groupBy(*GROUP, F.ceil(F.col("T") / step).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    top = longest(trajectories).withColumn("_last", F.floor(F.col("t_max") / step))
    grid = top.select(*GROUP, "t_max", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("k"))
    all_bins = bins.unionByName(grid.select(*GROUP, "k", F.lit(0).cast("long").alias("n"))).groupBy(*GROUP, "k").agg(F.sum("n").alias("n"))
    above = Window.partitionBy(*GROUP).orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counted = all_bins.withColumn("active", F.coalesce(F.sum("n").over(above), F.lit(0)))
    body = counted.join(grid, [*GROUP, "k"]).select(*GROUP, (F.col("k") * step).alias("followup_transition"), "active")
    end = top.where(F.col("_last") * step != F.col("t_max")).select(
        *GROUP, F.col("t_max").alias("followup_transition"), F.lit(0).cast("long").alias("active"))
    return body.unionByName(end)


def support_flags(support: DataFrame, low_active: int = 2, dominance: float = 0.5) -> DataFrame:
    def no(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))
    return support.select(
        "*", (F.col("active_at_u") <= low_active).alias("flag_few_active"),
        *[(F.col(f"{s}_A1") < n).alias(f"flag_{s}_A1_lt{n}") for n in (5, 10) for s in ("left", "right")],
        *[no(F.col(f"{s}_max_A1_share") >= dominance).alias(f"flag_{s}_dominance") for s in ("left", "right")])


def support_map_summary(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(*GROUP).agg(
        F.count("u").alias("cut_count"), F.min("active_at_u").alias("minimum_active_at_u"),
        F.count_if("flag_few_active").alias("cuts_few_active"), F.min("left_A1").alias("minimum_left_A1"),
        F.min("right_A1").alias("minimum_right_A1"),
        *[F.count_if(f"flag_{s}_A1_lt{n}").alias(f"cuts_{s}_A1_lt{n}") for n in (5, 10) for s in ("left", "right")],
        F.max("left_max_A1_share").alias("maximum_left_A1_share"), F.max("right_max_A1_share").alias("maximum_right_A1_share"),
        *[F.count_if(f"flag_{s}_dominance").alias(f"cuts_{s}_dominance") for s in ("left", "right")])


def reason_summary(trajectories: DataFrame) -> DataFrame:
    return trajectories.groupBy(*GROUP, "trajectory_eligible", "ineligible_reason", "censor_reason").agg(
        F.count(F.lit(1)).alias("entities"))


def pareto_frontier(table: DataFrame, within_group: str, objectives: Sequence[str] = OBJECTIVES,
                    eligible: str = "eligible_entities") -> DataFrame:
    """Rows not dominated by another row of the same group on all objectives (to be maximised)."""
    x = table.where(F.col(eligible) > 0)
    other = x.select(F.col(within_group).alias("_g"), *[F.col(o).alias(f"_{o}") for o in objectives])
    cond, strict = F.col(within_group) == F.col("_g"), F.lit(False)
    for o in objectives:
        cond = cond & (F.col(f"_{o}") >= F.col(o))
        strict = strict | (F.col(f"_{o}") > F.col(o))
    return x.join(other, cond & strict, "left_anti")


def clock_axes(obs: DataFrame, phase: Column) -> DataFrame:
    """Training / testing spans of a continuous clock, per entity."""
    train, test = F.when(~phase, F.col("ts")), F.when(phase, F.col("ts"))
    a = obs.groupBy("entity_id").agg(F.min(train).alias("training_start"), F.max(train).alias("training_last"),
                                     F.min(test).alias("testing_start"), F.max(test).alias("testing_end"))
    a = a.where(F.col("training_start").isNotNull() & F.col("testing_start").isNotNull())
    return a.select("*", (minutes_between(F.col("training_start"), F.col("testing_start")) / 60.0).alias("testing_start_h"),
                    (minutes_between(F.col("training_start"), F.col("testing_end")) / 60.0).alias("testing_end_h"),
                    minutes_between(F.col("training_last"), F.col("testing_start")).alias("boundary_gap_min"))


def common_overlap(axes: DataFrame) -> DataFrame:
    o = axes.agg(F.max("testing_start_h").alias("overlap_start_h"), F.min("testing_end_h").alias("overlap_end_h"))
    return o.withColumn("overlap_duration_h", F.greatest(F.lit(0.0), F.col("overlap_end_h") - F.col("overlap_start_h")))


def eligibility_gate(summary: DataFrame, min_active: int = 6, min_action: int = 66, max_dominance: float = 0.60) -> DataFrame:
    ok = (F.col("minimum_active") >= min_active) & (F.col("worst_side_action") >= min_action) & F.coalesce(
        F.col("maximum_dominance") <= max_dominance, F.lit(False))
    return summary.select(*GROUP, "eligible_entities", "minimum_active", "worst_side_action", "maximum_dominance",
                          ok.alias("support_pass"))


def landmark_cohort(cells: DataFrame, landmark_h: float, tolerance_min: float) -> DataFrame:
    """Entry in the first segment with a boundary in [L, L+tolerance), followed to the segment's end."""
    live = cells.where("valid")
    start = live.groupBy(*K).agg(F.min("tau_t").alias("_t0"))
    placed = live.join(start, K).withColumn("_el", minutes_between(F.col("_t0"), F.col("tau_t")) - landmark_h * 60.0)
    hit = placed.where((F.col("_el") >= 0) & (F.col("_el") < tolerance_min)).groupBy(*K).agg(
        F.min(F.struct("segment_id", "tau_t", "_el")).alias("h")).select(
        *K, F.col("h.segment_id").alias("segment_id"), F.col("h.tau_t").alias("entry_ts"), F.col("h._el").alias("entry_delay_min"))
    followed = live.join(hit, [*K, "segment_id"]).where(F.col("tau_t") >= F.col("entry_ts"))
    return followed.groupBy(*K, "segment_id", "entry_ts", "entry_delay_min").agg(
        F.count(F.lit(1)).alias("T"), F.sum("action").alias("action_positive"), F.avg("reward_binary").alias("reward_mean"),
        F.max("tau_next").alias("end_ts"))
