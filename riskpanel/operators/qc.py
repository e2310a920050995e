"""Descriptive quality control of transitions: timing, coverage, support, overlap."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cases, hash_uniform, minutes_between, ratio
from ..params import FEATURES, KEYS
from ..session import materialise
from .fqi import _matrix, sum_arrays
from .gaps import locate
from .quantiles import cumulative_cells, exact_quantile_table, exact_quantiles, grouped_distributions
from .timeline import CHUNK, chunked, running

K = list(KEYS)

# Information categories that may arrive before the first action of a cell.
# The finger-stick column exists but no event kind maps to it, so it is always zero.
PRIOR = ("observation", "exposure", "schedule_change", "override_begin", "override_end", "fingerstick", "hypo_event",
         "exercise", "stressor", "work", "illness", "sleep", "other_action")
TIMING_SHARES = (1.0, 2.0, 3.0, 4.0, 5.0)


def rows_around(cells: DataFrame, target: Column, n_rows: int = 20) -> DataFrame:
    """``n_rows`` consecutive cells of each entity around the one nearest to ``target`` (clamped)."""
    gap = F.abs(minutes_between(F.col("tau_t"), target))
    hit = cells.groupBy(*K).agg(
        F.min_by("edge_index", F.struct(gap, F.col("edge_index"))).alias("_hit"), F.count(F.lit(1)).alias("_n"))
    end = F.least(F.col("_n"), F.greatest(F.lit(0), F.col("_hit") - n_rows // 2) + n_rows)
    bounds = hit.select(*K, end.alias("_end"), F.greatest(F.lit(0), end - n_rows).alias("_start"))
    return cells.join(bounds, K).where((F.col("edge_index") >= F.col("_start")) & (F.col("edge_index") < F.col("_end"))).drop(
        "_start", "_end")


def information_events(obs: DataFrame, exposures: DataFrame, schedule: DataFrame, overrides: DataFrame,
                       context: DataFrame) -> DataFrame:
    """Every record that can inform a decision, as (entity, ts, category)."""
    def tag(df: DataFrame, name: str, ts: str = "ts") -> DataFrame:
        return df.select(*K, F.col(ts).alias("ts"), F.lit(name).alias("category"))

    known = F.col("kind").isin("hypo_event", "exercise", "stressor", "work", "illness", "sleep")
    out = tag(obs, "observation")
    for part in (tag(exposures, "exposure"), tag(schedule, "schedule_change"), tag(overrides, "override_begin", "ts_begin"),
                 tag(overrides, "override_end", "ts_end"),
                 context.where(known).select(*K, "ts", F.col("kind").alias("category"))):
        out = out.unionByName(part)
    return out


def action_timing(cells: DataFrame, actions: DataFrame, information: DataFrame, exposures: DataFrame,
                  chunk_min: float, unit_min: float = 1.0) -> DataFrame:
    """One row per valid action cell: offset of the first action and what was learned before it."""
    positive = cells.where(F.col("valid") & (F.col("action") == 1)).select(
        *K, "interval_min", "tau_t", "tau_next", "action_count")
    hits = locate(actions, positive, ["tau_next"], chunk_min).where(F.col("ts") < F.col("cell.tau_next"))
    first = hits.groupBy(*K, F.col("cell.start").alias("tau_t")).agg(F.min("ts").alias("first_ts"))
    rows = positive.join(first, [*K, "tau_t"])
    info = information.unionByName(exposures.select(*K, "ts", F.lit("_same").alias("category")))
    seen = locate(info, rows, ["first_ts"], chunk_min)
    before = (F.col("ts") > F.col("cell.start")) & (F.col("ts") < F.col("cell.first_ts")) & (F.col("category") != "_same")
    same = (F.col("ts") == F.col("cell.first_ts")) & (F.col("category") == "_same")
    counts = seen.where(before | same).groupBy(*K, F.col("cell.start").alias("tau_t")).agg(
        *[F.count_if(F.col("category") == c).alias(f"prior_{c}") for c in PRIOR],
        F.count_if(F.col("category") == "_same").alias("exposure_same_timestamp"))
    offset = minutes_between(F.col("tau_t"), F.col("first_ts"))
    labels = [f"{int(s) - 1}-{int(s)}" for s in TIMING_SHARES]
    out = rows.join(counts, [*K, "tau_t"], "left").fillna(0, [f"prior_{c}" for c in PRIOR] + ["exposure_same_timestamp"])
    out = out.withColumn("first_offset_min", offset).withColumn(
        "timing_bin", cases([(F.col("first_offset_min") < s * unit_min, n) for s, n in zip(TIMING_SHARES, labels)], "5+"))
    any_new = F.col("exposure_same_timestamp") > 0
    for c in PRIOR:
        any_new = any_new | (F.col(f"prior_{c}") > 0)
    return out.withColumn("any_new_information", any_new)


def action_timing_summary(timing: DataFrame) -> DataFrame:
    """Long table of counts and proportions; empty timing bins are kept."""
    bins = [f"{int(s) - 1}-{int(s)}" for s in TIMING_SHARES] + ["5+"]
    metrics = {f"timing_{b}": F.col("timing_bin") == b for b in bins}
    metrics |= {f"prior_{c}": F.col(f"prior_{c}") > 0 for c in PRIOR}
    metrics["exposure_same_timestamp"] = F.col("exposure_same_timestamp") > 0
    metrics["any_new_information"] = F.col("any_new_information")
    metrics["multiple_action_cell"] = F.col("action_count") > 1
    group = ["split", "interval_min"]
    wide = timing.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"m{i}") for i, c in enumerate(metrics.values())])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("n")) for i, n in enumerate(metrics)]))
    return wide.select(*group, "_n", pairs.alias("p")).select(
        *group, F.col("p.metric").alias("metric"), F.col("p.n").alias("n"), (F.col("p.n") / F.col("_n")).alias("proportion"))


def action_coverage(actions: DataFrame, cells: DataFrame, chunk_min: float) -> DataFrame:
    """Every action with the reason it was or was not captured, in priority order."""
    left = actions.withColumn("_t", F.col("ts")).withColumn("_rank", F.lit(1))
    right = cells.select(*K, F.col("tau_t").alias("_t"), F.lit(0).alias("_rank"), F.lit(0).cast("long").alias("ordinal"),
                         F.struct("tau_t", "tau_next", "valid").alias("_p"))
    stream = chunked(left.unionByName(right, allowMissingColumns=True), K, "_t", chunk_min)
    seen = running(stream, K, ["_t", "_rank", "ordinal"], {
        "cell": ("last", F.col("_p")), "_first": ("all_min", F.col("_p.tau_t")), "_last": ("all_max", F.col("_p.tau_next")),
        "_no": ("sum", (F.col("_rank") == 1).cast("long"))}).where("_rank = 1")
    inside = F.coalesce(F.col("ts") < F.col("cell.tau_next"), F.lit(False))
    captured = inside & F.col("cell.valid")
    reason = cases([
        (captured, "captured_valid_transition"), (inside, "inside_invalid_or_unused_interval"),
        (F.col("ts") < F.col("_first"), "before_first_candidate_boundary"),
        (F.col("ts") >= F.col("_last"), "at_or_after_last_candidate_boundary"),
    ], "between_saved_cells_or_gap")
    return seen.select(
        *K, (F.col("_no") - 1).alias("action_id"), "ts", "ts_end", "kind", "dose",
        F.coalesce(captured, F.lit(False)).alias("captured"), reason.alias("coverage_reason"),
        F.when(inside, F.col("cell.tau_t")).alias("captured_tau_t"),
        F.when(inside, F.col("cell.tau_next")).alias("captured_tau_next"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("split", "coverage_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dose").alias("dose"))


def entity_transition_summary(cells: DataFrame, meta: DataFrame) -> DataFrame:
    made = cells.where("valid").groupBy(*K, "interval_min").agg(
        F.count(F.lit(1)).alias("total_transitions"), F.sum("action").alias("action_1"),
        F.count_distinct(F.to_date("tau_t")).alias("observed_days"),
        F.avg("reward_binary").alias("binary_reward_mean"), F.avg("reward_weighted").alias("weighted_reward_mean"))
    return made.join(meta.select(*K, "n_segments", F.col("n_invalid").alias("invalid_transitions"), "max_invalid_gap_min"),
                     K, "left").withColumn(
        "action_1_rate", F.col("action_1") / F.col("total_transitions")).withColumn(
        "actions_per_day", F.col("action_1") / F.greatest(F.col("observed_days"), F.lit(1)))


def temporal_quartiles(cells: DataFrame) -> DataFrame:
    """Chronological quartiles by position: equal-width cuts of 0..n-1, right-closed, lowest included."""
    placed = running(cells.where("valid"), K, ["tau_t"], {
        "_i": ("sum", F.lit(1).cast("long")), "_n": ("all_sum", F.lit(1).cast("long"))})
    i = F.col("_i") - 1
    share = F.when(F.col("_n") > 1, F.ceil(4.0 * i / (F.col("_n") - 1))).otherwise(F.lit(1))
    label = F.concat(F.lit("Q"), F.greatest(F.lit(1), share).cast("string"))
    return placed.where(F.col("_n") > 1).groupBy(*K, label.alias("time_quartile")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("action").alias("action_1"), F.avg("action").alias("action_1_rate"),
        F.min("tau_t").alias("start_ts"), F.max("tau_next").alias("end_ts"))


def segment_support(segments: DataFrame) -> DataFrame:
    base = segments.groupBy("split").agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(F.col("action_1") == 0).alias("segments_zero_action"),
        F.count_if(F.col("action_1") < 5).alias("segments_lt5_actions"),
        F.sum(F.when(F.col("action_1") == 0, F.col("T")).otherwise(0)).alias("transitions_in_zero_segments"),
        F.sum("T").alias("_t"))
    q = exact_quantiles(segments, ["split"], "action_1", {"median_actions": 0.5, "p25_actions": 0.25}, few=True)
    return base.join(q, "split").withColumn(
        "fraction_in_zero_segments", F.col("transitions_in_zero_segments") / F.col("_t")).drop("_t")


def long_features(cells: DataFrame, keep: Sequence[str], features: Sequence[str] = FEATURES) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"raw__{f}").alias("x")) for f in features]))
    return cells.where("valid").select(*keep, pairs.alias("p")).select(*keep, "p.feature", "p.x")


def feature_distributions(cells: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Mean, population sd and quantiles of each feature by entity and action."""
    group = [*K, "interval_min", "action"]
    rows = cells.where("valid").select(*group, *[F.col(f"raw__{f}").alias(f) for f in features])
    return grouped_distributions(rows, group, features, {"p05": 0.05, "median": 0.5, "p95": 0.95})


def left_closed(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    return cases([(x < e, n) for e, n in zip(edges, labels)], labels[-1])


def stratified_rates(cells: DataFrame, strata: dict[str, Column]) -> DataFrame:
    """Action counts and rates by entity for several stratifications, stacked."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("stratum_type"), c.alias("stratum")) for n, c in strata.items()]))
    rows = cells.where("valid").select(*K, "interval_min", "action", pairs.alias("s"))
    return rows.groupBy(*K, "interval_min", F.col("s.stratum_type").alias("stratum_type"), F.col("s.stratum").alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("action").alias("action_1"), F.avg("action").alias("action_1_rate"))


def interval_comparison(summary: DataFrame, timing_summary: DataFrame) -> DataFrame:
    """Totals per split and interval with two timing metrics pivoted alongside."""
    group = ["split", "interval_min"]
    total = summary.groupBy(*group).agg(
        F.count_distinct("entity_id").alias("entities"), F.sum("total_transitions").alias("total_transitions"),
        F.sum("action_1").alias("total_action_1"), F.sum("n_segments").alias("total_segments"),
        F.sum("invalid_transitions").alias("invalid_transitions"))
    extras = timing_summary.groupBy(*group).pivot("metric", ["multiple_action_cell", "any_new_information"]).agg(F.first("proportion"))
    return total.withColumn("action_1_rate", F.col("total_action_1") / F.col("total_transitions")).join(extras, group, "left")


# -------------------------------------------------------------------------- overlap
EXTREMES = (0.005, 0.995)
SUPPORT_PROBS = (0.01, 0.99)


@dataclass(frozen=True)
class CrossFit:
    """Logistic models (folds + 1) x (1 + features): model k leaves out fold k, the last one leaves out nothing."""

    beta: np.ndarray
    gradient: np.ndarray  # norm of every model's penalised score at its coefficients
    passes: int


def cross_fitted_logistic(rows: DataFrame, n_folds: int, penalty: float = 1.0, tolerance: float = 1e-8, passes: int = 60) -> CrossFit:
    """Newton's method for all leave-a-fold-out models and the full one together; (x array, y, fold) in, intercept not penalised.

    A pass over the rows adds up, keyed by model, objective, score and Hessian at that model's own coefficients; a step that does not
    lower a model's objective is halved. Only these sums, (folds + 1) x (1 + features)^2 numbers, reach the driver.
    """
    head = rows.agg(F.max(F.size("x")).alias("p"), F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("classes")).first()
    if head["n"] == 0 or head["classes"] < 2:
        raise ValueError("training rows contain a single action; the score is not identifiable")
    p, k = head["p"] + 1, n_folds + 1
    ridge = penalty * np.diag(np.r_[0.0, np.ones(p - 1)])

    def sums(beta: np.ndarray) -> np.ndarray:
        def task(batches):
            acc = np.zeros((k, 1 + p + p * p))
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.hstack([np.ones((len(pdf), 1)), _matrix(pdf["x"])])
                y, eta = pdf["y"].to_numpy(float), x @ beta.T
                use = pdf["fold"].to_numpy()[:, None] != np.arange(k)[None, :]
                q = 0.5 * (1.0 + np.tanh(eta / 2.0))
                acc[:, 0] += ((np.logaddexp(0.0, eta) - y[:, None] * eta) * use).sum(axis=0)
                acc[:, 1:1 + p] += ((q - y[:, None]) * use).T @ x
                w = q * (1.0 - q) * use
                for m in range(k):
                    acc[m, 1 + p:] += (x.T @ (w[:, m, None] * x)).ravel()
            yield pd.DataFrame({"m": np.arange(k), "v": list(acc)})

        out = np.zeros((k, 1 + p + p * p))
        for r in sum_arrays(rows.select("x", "y", "fold").mapInPandas(task, "m long, v array<double>"), ["m"], "v").collect():
            out[r["m"]] = r["v"]
        return out

    beta, kept, step = np.zeros((k, p)), np.zeros((k, p)), np.zeros((k, p))
    best, norm, done = np.full(k, np.inf), np.full(k, np.inf), np.zeros(k, bool)
    for number in range(1, passes + 1):
        got = sums(beta)
        for m in np.flatnonzero(~done):
            slope = got[m, 1:1 + p] + ridge @ beta[m]
            value = got[m, 0] + 0.5 * beta[m] @ ridge @ beta[m]
            if not np.isfinite(value) or value > best[m] + 1e-12 * abs(best[m]):
                step[m] /= 2.0
            else:
                kept[m], best[m], norm[m] = beta[m], value, np.linalg.norm(slope)
                done[m] = norm[m] <= tolerance * max(1.0, head["n"] ** 0.5)
                step[m] = 0.0 if done[m] else np.linalg.lstsq(got[m, 1 + p:].reshape(p, p) + ridge, slope, rcond=None)[0]
            beta[m] = kept[m] - step[m]
        if done.all():
            break
    return CrossFit(kept, norm, number)


def entity_fold(n_folds: int) -> Column:
    return F.floor(hash_uniform("fold", F.col("entity_id")) * n_folds).cast("int")


def scored(rows: DataFrame, fit: CrossFit) -> DataFrame:
    """``propensity`` of (x, fold) rows under the model that left their fold out."""
    table = rows.sparkSession.createDataFrame([(m, [float(v) for v in b]) for m, b in enumerate(fit.beta)], "fold int, beta array<double>")
    eta = F.aggregate(F.zip_with("x", F.slice("beta", 2, F.size("x")), lambda a, b: a * b), F.get("beta", F.lit(0)), lambda a, v: a + v)
    return rows.join(F.broadcast(table), "fold").withColumn("propensity", 1.0 / (1.0 + F.exp(-eta))).drop("beta")


def propensity_rows(rows: DataFrame, features: Sequence[str], n_folds: int) -> DataFrame:
    """(keys, tau_t, action, x, y, fold): folds of training rows are whole entities, testing rows belong to the full model."""
    fold = F.when(F.col("split") == "training", entity_fold(n_folds)).otherwise(F.lit(n_folds))
    return rows.select(*K, "tau_t", "action", F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col("action").cast("double").alias("y"), fold.alias("fold"))


def propensity_scores(rows: DataFrame, features: Sequence[str], n_folds: int = 6, c: float = 1.0) -> DataFrame:
    """Training rows scored out of fold (folds are whole entities), testing rows by the full model."""
    data = materialise(propensity_rows(rows, features, n_folds), "propensity-rows")
    fit = cross_fitted_logistic(data.where("split = 'training'"), n_folds, 1.0 / c)
    mode = F.when(F.col("split") == "training", "group_cross_fitted").otherwise("trained_on_training_split")
    return scored(data.where(F.col("split").isin("training", "testing")), fit).select(*K, "tau_t", "action", "propensity", mode.alias("prediction_mode"))


def score_equations(rows: DataFrame, features: Sequence[str], n_folds: int = 6, c: float = 1.0) -> DataFrame:
    """(model, feature, n, moment): mean of feature x score plus the penalty's share over a model's own training rows.

    At the optimum this is the mean of feature x action, so the fits are checked without repeating them.
    """
    data = materialise(propensity_rows(rows, features, n_folds).where("split = 'training'"), "propensity-rows")
    fit = cross_fitted_logistic(data, n_folds, 1.0 / c)
    models = F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_folds)), lambda m: m != F.col("fold"))).alias("model")
    used = scored(data.select(F.array_insert("x", 1, F.lit(1.0)).alias("v"), "x", "fold", models).withColumn("fold", F.col("model")), fit)
    names = F.array(F.lit("intercept"), *[F.lit(f) for f in features])
    long = used.select("model", "propensity", F.explode(F.arrays_zip(names.alias("feature"), F.col("v"))).alias("c")).groupBy("model", "c.feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c.v") * F.col("propensity")).alias("s"))
    weights = [(m, f, float(w) / c) for m, b in enumerate(fit.beta) for f, w in zip(["intercept", *features], [0.0, *b[1:]])]
    table = rows.sparkSession.createDataFrame(weights, "model int, feature string, share double")
    return long.join(F.broadcast(table), ["model", "feature"]).select("model", "feature", "n", ((F.col("s") + F.col("share")) / F.col("n")).alias("moment"))


def auc(scores: DataFrame, keys: Sequence[str], score: str = "propensity") -> DataFrame:
    """Rank-sum area under the curve with half credit for ties, from cumulative score cells."""
    one = F.col("action").cast("long")
    cells = cumulative_cells(scores, keys, F.col(score), {"n1": one, "n0": 1 - one})
    return cells.groupBy(*keys).agg(
        (F.sum(F.col("n1") * (F.col("n0_below") + F.col("n0") / 2.0)) / (F.max("n1_total") * F.max("n0_total"))).alias("auc"))


def overlap_summary(scores: DataFrame) -> DataFrame:
    """AUC, Brier, quantiles, common support and outside fractions of a score, per split."""
    p, a = F.col("propensity"), F.col("action")
    probs = {"p_min": 0.0, "p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p_max": 1.0}
    q = exact_quantiles(scores, ["split"], "propensity", probs, few=True)
    by = exact_quantile_table(scores, ["split"], {"a0": F.when(a == 0, p), "a1": F.when(a == 1, p)},
                              {"lo": SUPPORT_PROBS[0], "hi": SUPPORT_PROBS[1]}, few=True)
    bounds = by.select("split", F.greatest("a0_lo", "a1_lo").alias("common_support_lo"),
                       F.least("a0_hi", "a1_hi").alias("common_support_hi"))
    rows = scores.join(F.broadcast(bounds), "split")
    out = ((p < F.col("common_support_lo")) | (p > F.col("common_support_hi"))).cast("double")
    base = rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("action").alias("n_action_1"), F.avg((p - a) * (p - a)).alias("brier"),
        F.avg((p < EXTREMES[0]).cast("double")).alias("below_extreme_low"),
        F.avg((p > EXTREMES[1]).cast("double")).alias("above_extreme_high"),
        F.max("common_support_lo").alias("common_support_lo"), F.max("common_support_hi").alias("common_support_hi"),
        F.avg(out).alias("outside_all"), F.avg(F.when(a == 1, out)).alias("outside_action1"),
        F.avg(F.when(a == 0, out)).alias("outside_action0"))
    return base.join(auc(scores, ["split"]), "split").join(q, "split")


def feature_support(cells: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Robust 1 % / 99 % ranges of each feature by action and their intersection."""
    rows = long_features(cells, ["split", "action"], features)
    group = ["split", "feature"]
    q = exact_quantiles(rows, [*group, "action"], "x", {"q01": SUPPORT_PROBS[0], "q99": SUPPORT_PROBS[1]}, few=True)
    q = q.groupBy(*group).agg(*[F.max(F.when(F.col("action") == a, F.col(c))).alias(f"a{a}_{c}") for a in (0, 1) for c in ("q01", "q99")])
    lo, hi = F.greatest("a0_q01", "a1_q01"), F.least("a0_q99", "a1_q99")
    outside = rows.where("action = 1").join(F.broadcast(q), group).groupBy(*group).agg(
        F.avg(((F.col("x") < F.col("a0_q01")) | (F.col("x") > F.col("a0_q99"))).cast("double")).alias("a1_outside_a0_range"))
    return q.withColumn("intersection_lo", lo).withColumn("intersection_hi", hi).withColumn(
        "empty_intersection", lo > hi).join(outside, group, "left")


def decile_regions(scores: DataFrame, n_bins: int = 10) -> DataFrame:
    """Equal-probability regions of a score; fewer than three distinct edges give the region 'all'."""
    names = {f"e{i}": i / n_bins for i in range(n_bins + 1)}
    q = exact_quantiles(scores, [], "propensity", names)
    edges = q.select(F.array_sort(F.array_distinct(F.array(*[F.col(n) for n in names]))).alias("edges"))
    rows = scores.join(F.broadcast(edges))
    p = F.col("propensity")
    slot = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < p)))
    region = F.when(F.size("edges") < 3, F.lit("all")).otherwise(F.format_string("R%02d", slot.cast("int")))
    out = rows.groupBy("split", region.alias("region")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("action").alias("action_1"), F.avg("action").alias("action_1_rate"))
    return out.withColumn("only_one_action", (F.col("action_1") == 0) | (F.col("action_1") == F.col("n")))
