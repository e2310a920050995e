"""Cleaning, adjacency gaps, runs and fixed-lattice remapping of irregular observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cases, half_even, lit_rows, minutes_between, ratio, reasons
from ..params import KEYS, SUFFIX_RATIOS, GapProtocol, QualityRules
from .quantiles import exact_quantile_table
from .timeline import CHUNK, chunked, neighbours, running

K = list(KEYS)


def dedup_observations(obs: DataFrame) -> DataFrame:
    """One value per (entity, timestamp): the last in document order wins."""
    return obs.groupBy(*K, "ts").agg(F.max_by("value", "ordinal").alias("value"), F.max("ordinal").alias("ordinal"))


def data_quality(events: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Stream counts, span, missing rate and usability with ordered reasons, per entity."""
    def n(stream: str) -> Column:
        return F.count_if(F.col("stream") == stream)

    seen = F.when(F.col("stream") == "observation", F.col("ts_begin"))
    base = events.groupBy(*K).agg(
        n("observation").alias("n_observation"), n("action").alias("n_action"),
        n("exposure").alias("n_exposure"), n("schedule").alias("n_schedule"),
        F.min(seen).alias("start_ts"), F.max(seen).alias("end_ts"))
    days = F.coalesce(minutes_between(F.col("start_ts"), F.col("end_ts")) / 1440.0, F.lit(0.0))
    base = base.withColumn("duration_days", days).withColumn(
        "expected", F.floor(F.col("duration_days") * rules.readings_per_day))
    base = base.withColumn("missing_rate", F.when(
        F.col("expected") > 0, F.greatest(F.lit(0.0), 1.0 - F.col("n_observation") / F.col("expected")))
        .otherwise(1.0)).withColumn(
        "n_windows", F.floor(F.col("n_observation") / rules.readings_per_window).cast("long"))
    found = reasons([
        (F.col("n_observation") < rules.min_readings, f"Too few observations (<{rules.min_readings})"),
        (F.col("n_windows") < rules.min_windows, f"Too few windows (<{rules.min_windows})"),
        (F.col("missing_rate") > rules.max_missing,
         F.format_string("High missing rate (%.2f)", F.col("missing_rate") + 1e-9)),
    ])
    base = base.withColumn("_r", F.when(
        F.col("n_observation") == 0, F.array(F.lit("No observations"))).otherwise(found))
    return base.select(
        *K, "n_observation", "n_action", "n_exposure", "n_schedule", "start_ts", "end_ts", "duration_days",
        F.col("expected").cast("long").alias("expected"), "missing_rate", "n_windows",
        (F.size("_r") == 0).alias("usable"),
        F.when(F.size("_r") == 0, F.lit("OK")).otherwise(F.array_join("_r", "; ")).alias("reason"))


# ------------------------------------------------------------------------------ edges
def observed_steps(obs: DataFrame, actions: DataFrame | None, chunk_min: float) -> DataFrame:
    """Each observation with its neighbours and the actions that start before the next one.

    Actions enter as running counts on the merged stream, so the half-open containment
    ``[tau, next)`` is a difference of two counters and no event is joined to any cell.
    """
    stream = obs.select(*K, "ts", "ordinal", "value", F.lit(0).alias("_rank"),
                        F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_d"))
    if actions is not None:
        stream = stream.unionByName(actions.select(
            *K, "ts", "ordinal", F.lit(None).cast("double").alias("value"), F.lit(1).alias("_rank"),
            F.lit(1).cast("long").alias("_n"), F.col("dose").alias("_d")))
    stream = chunked(stream, K, "ts", chunk_min)
    counted = running(stream, K, ["ts", "_rank", "ordinal"], {
        "_cn": ("sum", F.col("_n")), "_cd": ("sum", F.col("_d"))}).where("_rank = 0")
    out = neighbours(counted, K, ["ts"], ["ts", "value", "_cn", "_cd"])
    return out.select(
        *K, CHUNK, F.col("ts").alias("tau_t"), F.col("next_ts").alias("tau_next"), "ordinal", "value",
        "prev_ts", "prev_value", "next_value",
        minutes_between(F.col("prev_ts"), F.col("ts")).alias("prev_gap_min"),
        minutes_between(F.col("ts"), F.col("next_ts")).alias("gap_min"),
        F.col("_cn").alias("actions_before"), (F.col("next__cn") - F.col("_cn")).alias("action_count"),
        (F.col("next__cd") - F.col("_cd")).alias("action_dose"))


def within(x: Column, bounds: tuple[float, float]) -> Column:
    return F.coalesce((x >= bounds[0]) & (x <= bounds[1]), F.lit(False))


def run_start(valid: Column, prev_valid: Column) -> Column:
    return (valid & ~prev_valid).cast("long")


def edges(obs: DataFrame, actions: DataFrame | None = None, protocol: GapProtocol = GapProtocol()) -> DataFrame:
    return number_edges(observed_steps(obs, actions, protocol.chunk_min), protocol)


def number_edges(steps: DataFrame, protocol: GapProtocol = GapProtocol()) -> DataFrame:
    """Adjacent-gap table with edge index, validity and gap-split segment id (-1 on invalid edges)."""
    steps = steps.where(F.col("tau_next").isNotNull())
    ok, before = within(F.col("gap_min"), protocol.valid_min), within(F.col("prev_gap_min"), protocol.valid_min)
    numbered = running(steps, K, ["tau_t"], {
        "_i": ("sum", F.lit(1).cast("long")), "_s": ("sum", run_start(ok, before))})
    return numbered.withColumn("edge_index", F.col("_i") - 1).withColumn("valid", ok).withColumn(
        "segment_id", F.when(ok, F.col("_s") - 1).otherwise(F.lit(-1).cast("long"))).withColumn(
        "action", (F.coalesce("action_count", F.lit(0)) > 0).cast("int")).drop("_i", "_s")


def gap_bin(gap: Column, protocol: GapProtocol) -> Column:
    pairs = []
    for b in protocol.bins:
        low = F.lit(True) if b.lower is None else (gap >= b.lower if b.lower_inclusive else gap > b.lower)
        high = F.lit(True) if b.upper is None else (gap <= b.upper if b.upper_inclusive else gap < b.upper)
        pairs.append((low & high, b.label))
    return cases(pairs)


def gap_class(gap: Column, protocol: GapProtocol) -> Column:
    missing = F.greatest(half_even(gap / protocol.nominal_min) - 1, F.lit(1.0)).cast("long")
    lo, hi = protocol.valid_min
    return cases([
        (gap < lo, "sub_nominal_jitter"),
        (gap <= hi, "nominal"),
        (gap <= protocol.genuine_gap_min, "prolonged_jitter_no_missing_cycle"),
        (gap <= protocol.one_missing_max, "approximately_one_missing"),
        (gap <= protocol.two_missing_max, "approximately_two_missing"),
    ], F.concat(F.lit("genuine_long_gap_approximately_"), missing.cast("string"), F.lit("_missing")))


def classify_gaps(edge_table: DataFrame, protocol: GapProtocol = GapProtocol()) -> DataFrame:
    g = F.col("gap_min")
    return edge_table.select(
        *K, "edge_index", "tau_t", "tau_next", "gap_min", gap_bin(g, protocol).alias("gap_bin"),
        gap_class(g, protocol).alias("gap_class"), "valid", (g > protocol.genuine_gap_min).alias("genuine_gap"))


def scoped(df: DataFrame) -> DataFrame:
    """Every row once for its entity and once for the whole split (entity label 'ALL')."""
    both = F.explode(F.array(
        F.struct(F.lit("entity").alias("scope"), F.col("entity_id").cast("string").alias("entity")),
        F.struct(F.lit("split").alias("scope"), F.lit("ALL").alias("entity"))))
    rest = [c for c in df.columns if c != "entity_id"]
    return df.select(*rest, both.alias("_s")).select("_s.scope", "_s.entity", *rest)


def gap_distribution(gaps: DataFrame, protocol: GapProtocol = GapProtocol()) -> DataFrame:
    """Zero-filled bin counts and percentages, per entity and per split."""
    labels = F.array(*[F.lit(b.label) for b in protocol.bins])
    counts = gaps.groupBy(*K, "gap_bin").agg(F.count(F.lit(1)).alias("n"))
    cells = scoped(counts).groupBy("scope", "split", "entity").agg(
        *[F.sum(F.when(F.col("gap_bin") == b.label, F.col("n")).otherwise(0)).alias(f"_b{i}")
          for i, b in enumerate(protocol.bins)], F.sum("n").alias("total"))
    wide = F.arrays_zip(labels.alias("gap_bin"), F.array(*[F.col(f"_b{i}") for i in range(len(protocol.bins))]).alias("n"))
    return cells.select("scope", "split", "entity", "total", F.explode(wide).alias("_z")).select(
        "scope", "split", "entity", F.col("_z.gap_bin").alias("gap_bin"), F.col("_z.n").alias("n"),
        (100.0 * F.col("_z.n") / F.col("total")).alias("percentage"))


QUANTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def gap_quantiles(gaps: DataFrame) -> DataFrame:
    """Gap quantiles over all edges and over breaks, per entity and per split."""
    group = ["scope", "split", "entity"]
    rows = scoped(gaps.select(*K, "gap_min", "valid"))
    broken = F.when(~F.col("valid"), F.col("gap_min"))
    base = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_gaps"), F.max("gap_min").alias("max"),
        F.count_if(~F.col("valid")).alias("n_breaks"), F.max(broken).alias("break_max"))
    q = exact_quantile_table(rows, group, {"all": F.col("gap_min"), "break": broken}, QUANTILES)
    for k in QUANTILES:
        q = q.withColumnRenamed(f"all_{k}", k)
    return base.join(q, group, "left")


def break_table(gaps: DataFrame, protocol: GapProtocol = GapProtocol()) -> DataFrame:
    """Invalid edges numbered within the entity."""
    broken = chunked(gaps.where(~F.col("valid")), K, "tau_t", protocol.chunk_min)
    return running(broken, K, ["tau_t"], {"break_number": ("sum", F.lit(1).cast("long"))}).drop(CHUNK)


# ------------------------------------------------------------------ adjacency-rule sweep
_ERROR_PROBS = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}


def _timing_error(valid_rows: DataFrame, group: list[str]) -> DataFrame:
    q = exact_quantile_table(valid_rows, group, {"signed": F.col("err"), "abs": F.abs("err")}, _ERROR_PROBS)
    return q.drop(*[f"signed_{p}" for p in _ERROR_PROBS if p != "median"])


def adjacency_rules(steps: DataFrame, actions: DataFrame, protocol: GapProtocol = GapProtocol()) -> DataFrame:
    """Every tolerance rule per entity: validity, runs, action coverage and timing error."""
    per_entity, rows = _rule_cells(steps, actions, protocol)
    return per_entity.join(_timing_error(rows, [*K, "rule"]), [*K, "rule"], "left")


def adjacency_rules_by_split(steps: DataFrame, actions: DataFrame, protocol: GapProtocol = GapProtocol()) -> DataFrame:
    """Split roll-up; timing errors are recomputed from edges, never averaged over entities."""
    per_entity, rows = _rule_cells(steps, actions, protocol)
    group = ["split", "rule"]
    total = per_entity.groupBy(*group).agg(
        F.count_distinct("entity_id").alias("entities"), F.sum("candidate_edges").alias("candidate_edges"),
        F.sum("valid_transitions").alias("valid_transitions"), F.sum("segments").alias("segments"),
        F.max("longest_segment").alias("longest_segment"),
        F.sum("action_positive_cells").alias("action_positive_cells"),
        F.sum("raw_actions").alias("raw_actions"), F.sum("actions_in_record").alias("actions_in_record"),
        F.sum("actions_captured").alias("actions_captured"))
    return (
        total.withColumn("valid_pct", 100.0 * F.col("valid_transitions") / F.col("candidate_edges"))
        .withColumn("coverage_pct", 100.0 * ratio(F.col("actions_captured"), F.col("actions_in_record")))
        .withColumn("coverage_all_raw_pct", 100.0 * ratio(F.col("actions_captured"), F.col("raw_actions")))
        .join(_timing_error(rows, group).drop("abs_p90"), group, "left"))


def _rule_cells(steps: DataFrame, actions: DataFrame, protocol: GapProtocol) -> tuple[DataFrame, DataFrame]:
    steps = steps.where(F.col("tau_next").isNotNull())
    ok = [within(F.col("gap_min"), (r.lower, r.upper)) for r in protocol.rules]
    was = [within(F.col("prev_gap_min"), (r.lower, r.upper)) for r in protocol.rules]
    numbered = running(steps, K, ["tau_t"], {
        f"_s{i}": ("sum", run_start(ok[i], was[i])) for i in range(len(protocol.rules))})
    rule = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), ok[i].alias("ok"), F.col(f"_s{i}").alias("run"))
        for i, r in enumerate(protocol.rules)]))
    rows = numbered.select(*K, "gap_min", "action_count", rule.alias("r")).select(
        *K, "gap_min", "action_count", "r.rule", "r.ok", "r.run")
    group = [*K, "rule"]
    runs = rows.groupBy(*group, F.when(F.col("ok"), F.col("run")).alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("action_count").alias("acts"),
        F.count_if(F.col("action_count") > 0).alias("cells"))
    live = F.col("run").isNotNull()
    per_rule = runs.groupBy(*group).agg(
        F.sum("n").alias("candidate_edges"),
        F.coalesce(F.sum(F.when(live, F.col("n"))), F.lit(0)).alias("valid_transitions"),
        F.count_if(live).alias("segments"),
        F.coalesce(F.max(F.when(live, F.col("n"))), F.lit(0)).alias("longest_segment"),
        F.coalesce(F.sum(F.when(live, F.col("cells"))), F.lit(0)).alias("action_positive_cells"),
        F.sum("acts").alias("actions_in_record"),
        F.coalesce(F.sum(F.when(live, F.col("acts"))), F.lit(0)).alias("actions_captured"))
    raw = actions.groupBy(*K).agg(F.count(F.lit(1)).alias("raw_actions"))
    valid_rows = rows.where("ok").withColumn("err", F.col("gap_min") - protocol.nominal_min)
    out = (
        per_rule.join(raw, K, "left").withColumn("raw_actions", F.coalesce("raw_actions", F.lit(0)))
        .withColumn("valid_pct", 100.0 * F.col("valid_transitions") / F.col("candidate_edges"))
        .withColumn("coverage_pct", 100.0 * ratio(F.col("actions_captured"), F.col("actions_in_record")))
        .withColumn("coverage_all_raw_pct", 100.0 * ratio(F.col("actions_captured"), F.col("raw_actions"))))
    return out, valid_rows


# ---------------------------------------------------------------------- event location
def locate(events: DataFrame, cells: DataFrame, payload: Sequence[str], chunk_min: float,
           tag: str = "cell", start: str = "tau_t", ts: str = "ts") -> DataFrame:
    """Backward as-of: the latest cell starting at or before each event, as struct column ``tag``."""
    left = events.withColumn("_t", F.col(ts)).withColumn("_rank", F.lit(1))
    right = cells.select(*K, F.col(start).alias("_t"), F.lit(0).alias("_rank"),
                         F.struct(F.col(start).alias("start"), *[F.col(c) for c in payload]).alias("_p"))
    merged = chunked(left.unionByName(right, allowMissingColumns=True), K, "_t", chunk_min)
    out = running(merged, K, ["_t", "_rank"], {tag: ("last", F.col("_p"))})
    return out.where("_rank = 1").drop("_t", "_rank", "_p", CHUNK)


# ------------------------------------------------------------------------ fixed lattice
def fixed_lattice(obs: DataFrame, actions: DataFrame, protocol: GapProtocol = GapProtocol()) -> DataFrame:
    """Causal remap onto a lattice anchored at the first observation of each entity.

    Lattice points, observations and actions form one stream; the state at a point is the last
    observation so far, and its age decides whether it may be used.
    """
    step = F.make_dt_interval(mins=F.lit(int(protocol.lattice_step_min)))
    tol = protocol.lattice_tolerance_min
    span = obs.groupBy(*K).agg(F.min("ts").alias("_a"), F.max("ts").alias("_z"))
    count = F.floor(minutes_between(F.col("_a"), F.col("_z")) / protocol.lattice_step_min).cast("int")
    points = span.select(*K, "_a", F.explode(F.sequence(F.lit(0), count)).alias("k")).select(
        *K, (F.col("_a") + F.col("k") * step).alias("ts"), F.col("k").cast("long").alias("k"))
    stream = (
        obs.select(*K, "ts", F.lit(0).alias("_rank"), F.col("ordinal"), F.col("ts").alias("_obs"))
        .unionByName(points.select(*K, "ts", F.lit(1).alias("_rank"), F.col("k").alias("ordinal"), "k"), True)
        .unionByName(actions.select(*K, "ts", F.lit(2).alias("_rank"), "ordinal", F.col("ts").alias("_act")), True))
    stream = chunked(stream, K, "ts", protocol.chunk_min)
    seen = running(stream, K, ["ts", "_rank", "ordinal"], {
        "_o": ("last", F.col("_obs")), "_last_act": ("max", F.col("_act")),
        "_n": ("sum", (F.col("_rank") == 2).cast("long"))}).where("_rank = 1")
    age = minutes_between(F.col("_o"), F.col("ts"))
    mapped = seen.select(*K, CHUNK, "ts", "k", "_n", "_last_act", F.when(age <= tol, F.col("_o")).alias("_m"))
    cells = neighbours(mapped, K, ["ts"], ["ts", "_m", "_n", "_last_act"], sides=("next",)).where(
        F.col("next_ts").isNotNull())
    i, j, n = F.col("_m"), F.col("next__m"), F.col("next__n") - F.col("_n")
    jump = minutes_between(i, j)
    why = reasons([
        (i.isNull(), "no_causal_state"),
        (j.isNull(), "no_causal_next"),
        (i == j, "same_observation_reused"),
        (j < i, "nonincreasing_mapped_observation"),
        (jump > protocol.lattice_genuine_gap_min, "crosses_genuine_gap"),
        ((n > 0) & (F.col("next__last_act") >= j), "reward_not_after_all_cell_actions"),
    ])
    return cells.select(
        *K, CHUNK, F.col("k").alias("lattice_index"), F.col("ts").alias("tau_t"), F.col("next_ts").alias("tau_next"),
        i.alias("state_ts"), j.alias("next_state_ts"),
        minutes_between(i, F.col("ts")).alias("state_age_min"),
        minutes_between(j, F.col("next_ts")).alias("next_age_min"), jump.alias("mapped_step_min"),
        (n > 0).cast("int").alias("action"), n.alias("action_count"), why.alias("reasons")
    ).withColumn("valid", F.size("reasons") == 0)


def lattice_runs(lattice: DataFrame) -> DataFrame:
    """Lattice cells with the number of the valid run they belong to (NULL on invalid cells)."""
    near = neighbours(lattice, K, ["tau_t"], ["valid"], sides=("prev",))
    start = run_start(F.col("valid"), F.coalesce("prev_valid", F.lit(False)))
    out = running(near, K, ["tau_t"], {"_s": ("sum", start)})
    return out.withColumn("run", F.when(F.col("valid"), F.col("_s"))).drop("_s", "prev_valid")


def lattice_summary(lattice: DataFrame, actions: DataFrame, protocol: GapProtocol, by_split: bool = False) -> DataFrame:
    """Per-entity lattice summary, or its split roll-up with ages recomputed from cells."""
    cells = lattice_runs(lattice)
    v = F.col("valid")
    runs = cells.groupBy(*K, "run").agg(
        F.count(F.lit(1)).alias("n"), F.sum("action").alias("cells1"), F.sum("action_count").alias("acts"),
        F.count_if((F.col("state_age_min") < 0) | (F.col("next_age_min") < 0)).alias("future"),
        F.count_if(F.array_contains("reasons", "reward_not_after_all_cell_actions")).alias("late"))
    live = F.col("run").isNotNull()
    zero = F.lit(0).cast("long")
    per = runs.groupBy(*K).agg(
        F.sum("n").alias("candidate_edges"),
        F.coalesce(F.sum(F.when(live, F.col("n"))), zero).alias("valid_transitions"),
        F.count_if(live).alias("segments"),
        F.coalesce(F.max(F.when(live, F.col("n"))), zero).alias("longest_segment"),
        F.coalesce(F.sum(F.when(live, F.col("cells1"))), zero).alias("action_positive_cells"),
        F.sum("acts").alias("actions_in_record"),
        F.coalesce(F.sum(F.when(live, F.col("acts"))), zero).alias("actions_captured"),
        F.sum("future").alias("future_state_mappings"), F.sum("late").alias("reward_precedes_action"))
    raw = actions.groupBy(*K).agg(F.count(F.lit(1)).alias("raw_actions"))
    per = per.join(raw, K, "left").withColumn("raw_actions", F.coalesce("raw_actions", zero))
    group = K
    if by_split:
        group = ["split"]
        sums = [c for c in per.columns if c not in (*K, "longest_segment")]
        per = per.groupBy("split").agg(
            F.count_distinct("entity_id").alias("entities"), F.max("longest_segment").alias("longest_segment"),
            *[F.sum(c).alias(c) for c in sums])
    good = cells.where(v)
    probs = {"median": 0.5, "p95": 0.95}
    q = exact_quantile_table(good, group, {
        "state_age": F.col("state_age_min"), "next_age": F.col("next_age_min"),
        "step_error": F.abs(F.col("mapped_step_min") - protocol.lattice_step_min)}, probs)
    out = per.join(q, group, "left")
    return (
        out.withColumn("valid_pct", 100.0 * F.col("valid_transitions") / F.col("candidate_edges"))
        .withColumn("coverage_pct", 100.0 * ratio(F.col("actions_captured"), F.col("actions_in_record")))
        .withColumn("coverage_all_raw_pct", 100.0 * ratio(F.col("actions_captured"), F.col("raw_actions"))))


def lattice_reason_counts(lattice: DataFrame) -> DataFrame:
    return lattice.where(~F.col("valid")).select("split", F.explode("reasons").alias("reason")).groupBy(
        "split", "reason").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------- retention
def segment_runs(edge_table: DataFrame) -> DataFrame:
    """One row per gap-split segment: length, action cells, first edge and time span."""
    return edge_table.where("valid").groupBy(*K, "segment_id").agg(
        F.count(F.lit(1)).alias("transitions"), F.sum("action").alias("action_positive"),
        F.min("edge_index").alias("first_edge"), F.min("tau_t").alias("start_ts"), F.max("tau_next").alias("end_ts"))


def chosen_runs(runs: DataFrame) -> DataFrame:
    """First and longest run of each entity (earliest on ties), one row per strategy."""
    body = F.struct("segment_id", "transitions", "action_positive", "first_edge", "start_ts", "end_ts")
    best = runs.groupBy(*K).agg(
        F.max_by(body, F.struct(F.col("transitions"), -F.col("first_edge"))).alias("longest_segment"),
        F.min_by(body, F.col("first_edge")).alias("first_segment"))
    both = F.explode(F.array(*[
        F.struct(F.lit(s).alias("strategy"), F.col(s).alias("run")) for s in ("first_segment", "longest_segment")]))
    return best.select(*K, both.alias("s")).select(*K, "s.strategy", "s.run.*")


def strategy_entities(edge_table: DataFrame, obs: DataFrame) -> DataFrame:
    first = obs.groupBy(*K).agg(F.min("ts").alias("_t0"))
    picked = chosen_runs(segment_runs(edge_table)).join(first, K)
    return picked.select(
        *K, "strategy", "start_ts", "end_ts",
        (minutes_between(F.col("_t0"), F.col("start_ts")) / 60.0).alias("start_elapsed_h"),
        "transitions", "action_positive", (100.0 * F.col("action_positive") / F.col("transitions")).alias("action_pct"))


def strategy_retention(edge_table: DataFrame, lattice: DataFrame) -> DataFrame:
    """Transitions, action cells and segments kept by each of four data views, per split."""
    runs = segment_runs(edge_table)
    cells = lattice_runs(lattice).where("valid").groupBy(*K, F.col("run").alias("segment_id")).agg(
        F.count(F.lit(1)).alias("transitions"), F.sum("action").alias("action_positive"))
    cols = [*K, "strategy", "transitions", "action_positive"]
    parts = chosen_runs(runs).select(*cols)
    parts = parts.unionByName(runs.withColumn("strategy", F.lit("actual_all_valid_mask")).select(*cols))
    parts = parts.unionByName(cells.withColumn("strategy", F.lit("lattice_all_valid_mask")).select(*cols))
    out = parts.groupBy("split", "strategy").agg(
        F.count_distinct("entity_id").alias("entities"), F.sum("transitions").alias("transitions"),
        F.sum("action_positive").alias("action_positive"), F.count(F.lit(1)).alias("segments"))
    return out.withColumn("action_pct", 100.0 * ratio(F.col("action_positive"), F.col("transitions")))


def suffix_support(edge_table: DataFrame, ratios: Sequence[float] = SUFFIX_RATIOS) -> DataFrame:
    """Support left and right of the midpoint of each suffix of the first segments."""
    first = edge_table.where("valid").groupBy(*K).agg(F.min("edge_index").alias("_e0"), F.min("segment_id").alias("_g"))
    steps = edge_table.where("valid").join(first, K).where(F.col("segment_id") == F.col("_g")).select(
        "split", (F.col("edge_index") - F.col("_e0")).alias("step"), "action")
    cells = steps.groupBy("split", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("action").alias("a"))
    tmax = cells.groupBy("split").agg((F.max("step") + 1).alias("t_max"))
    r = tmax.select("split", "t_max", F.explode(F.array(*[F.lit(float(x)) for x in ratios])).alias("ratio"))
    r = r.withColumn("kappa", F.greatest(F.lit(1), half_even(F.col("ratio") * F.col("t_max"))).cast("long"))
    r = r.withColumn("suffix_start", F.col("t_max") - F.col("kappa")).withColumn(
        "_mid", F.col("suffix_start") + F.floor(F.col("kappa") / 2))
    joined = r.join(cells, "split").where(F.col("step") >= F.col("suffix_start"))
    return joined.groupBy("split", "ratio", "t_max", "suffix_start", "kappa").agg(
        F.sum(F.when(F.col("step") == F.col("suffix_start"), F.col("n")).otherwise(0)).alias("entities_after_start"),
        F.sum("n").alias("transitions"), F.sum("a").alias("action_positive"),
        F.sum(F.when(F.col("step") < F.col("_mid"), F.col("a")).otherwise(0)).alias("action_left"),
        F.sum(F.when(F.col("step") >= F.col("_mid"), F.col("a")).otherwise(0)).alias("action_right"))


def scheme_overlap(actions: DataFrame, edge_table: DataFrame, lattice: DataFrame, chunk_min: float) -> DataFrame:
    """Actions captured by the observed-time cells, by the lattice, by both or by neither."""
    a = locate(actions, edge_table, ["tau_next", "valid"], chunk_min, tag="actual")
    b = locate(a, lattice, ["tau_next", "valid"], chunk_min, tag="grid")
    def hit(tag: str) -> Column:
        return F.coalesce(F.col(f"{tag}.valid") & (F.col("ts") < F.col(f"{tag}.tau_next")), F.lit(False))
    x, y = hit("actual"), hit("grid")
    return b.groupBy(*K).agg(
        F.count(F.lit(1)).alias("raw_actions"), F.count_if(x).alias("captured_actual"),
        F.count_if(y).alias("captured_lattice"), F.count_if(x & y).alias("captured_both"),
        F.count_if(x & ~y).alias("actual_only"), F.count_if(~x & y).alias("lattice_only"),
        F.count_if(~x & ~y).alias("captured_neither"))


def record_axes(obs: DataFrame, actions: DataFrame) -> DataFrame:
    raw = actions.groupBy(*K).agg(F.count(F.lit(1)).alias("raw_actions"))
    return obs.groupBy(*K).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("unique_observations")
    ).withColumn("duration_days", minutes_between(F.col("first_ts"), F.col("last_ts")) / 1440.0).join(
        raw, K, "left").withColumn("raw_actions", F.coalesce("raw_actions", F.lit(0)))
