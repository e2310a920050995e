"""Analytics over replicate result tables: rates, intervals, localisation, calibration, gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Z_EXACT, Z_ROUNDED, binomial_se, finite_p, fixed_text, sample_excess_kurtosis, sample_skew, wilson
from .quantiles import exact_quantile_table, exact_quantiles

# Grouping keys, levels, p-value histogram edges and ECDF grid.
GROUP_KEYS = ("scenario", "family", "is_null", "effect_level", "effect_size", "variant_id", "method", "threshold", "scaling", "evaluation_grid")
LEVELS = {"001": 0.01, "005": 0.05, "010": 0.10}
P_EDGES = (0.0, 0.01, 0.025, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 1.0000001)
P_GRID = (0.0, 0.01, 0.025, 0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.975, 0.99, 1.0)
FAILED = ("NUMERICAL_FAILURE", "BOOTSTRAP_FAILURE", "ZERO_VARIANCE")
REASONS = "map<string,bigint>"


def rate_columns(count: Column, n: Column, tag: str, z: float = Z_EXACT) -> list[Column]:
    low, high = wilson(count, n, z)
    return [count.alias(f"rejection_count_{tag}"), F.when(n > 0, count / n).alias(f"rate_{tag}"), binomial_se(count, n).alias(f"mcse_{tag}"),
            low.alias(f"wilson_low_{tag}"), high.alias(f"wilson_high_{tag}")]


def reason_totals(rows: DataFrame, keys: Sequence[str], column: str = "support_failure_reasons") -> DataFrame:
    """JSON reason counters summed over rows, returned as canonical JSON per group."""
    parsed = rows.select(*keys, F.explode(F.from_json(column, REASONS)).alias("reason", "n"))
    total = parsed.groupBy(*keys, "reason").agg(F.sum("n").alias("n"))
    pair = F.concat(F.lit('"'), F.col("reason"), F.lit('":'), F.col("n").cast("string"))
    return total.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")).alias("reasons_json"))


def status_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = rows.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))
    pair = F.concat(F.lit('"'), F.col("status"), F.lit('":'), F.col("n").cast("string"))
    return total.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")).alias("status_json"))


def calibration_summary(rows: DataFrame, keys: Sequence[str] = GROUP_KEYS) -> DataFrame:
    """Status counts, both rejection denominators, MCSE, Wilson intervals and support means."""
    ok = F.col("status") == "TESTABLE"
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("testable"), F.count_if(F.col("status") == "NOT_TESTABLE_SUPPORT").alias("not_testable"),
        F.count_if(F.col("status").isin(*FAILED)).alias("_failed"), *[F.count_if(ok & (F.col("p_value") <= a)).alias(f"_k{t}") for t, a in LEVELS.items()],
        *[F.avg(c).alias(f"mean_{c}") for c in ("number_admissible", "mean_active", "minimum_side_action1", "maximum_total_share", "maximum_action1_share")])
    med = exact_quantiles(rows, keys, "number_admissible", {"median_number_admissible": 0.5})
    out = base.join(med, list(keys), "left").join(status_counts(rows, keys), list(keys), "left").join(reason_totals(rows, keys), list(keys), "left")
    cols = [F.col(c) for c in out.columns if not c.startswith("_")]
    cols += [(F.col("testable") / F.col("total")).alias("testable_fraction"), (F.col("_failed") / F.col("total")).alias("numerical_failure_rate")]
    for t in LEVELS:
        cols.append((F.col(f"_k{t}") / F.col("total")).alias(f"rate_all_{t}"))
        cols += rate_columns(F.col(f"_k{t}"), F.col("testable"), t, Z_ROUNDED)
    return out.select(*cols)


def support_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.avg((F.col("status") == "TESTABLE").cast("double")).alias("testable_fraction"),
        F.avg((F.col("status") == "NOT_TESTABLE_SUPPORT").cast("double")).alias("not_testable_fraction"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("number_admissible", "retained_transitions", "retained_action1", "mean_active", "minimum_side_action1")])
    return base.join(exact_quantiles(rows, keys, "number_admissible", {"median_number_admissible": 0.5}), list(keys), "left").join(
        reason_totals(rows, keys), list(keys), "left")


def localisation_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change-point error quantiles over all testable rows and over detections only."""
    ok = F.col("status") == "TESTABLE"
    hit = ok & (F.col("p_value") <= 0.05)
    base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("testable"), F.count_if(hit).alias("detected"),
                                   F.min("true_cp").alias("true_cp"))
    q = exact_quantile_table(rows, keys, {
        "all": F.when(ok, F.col("cp_error")), "relative": F.when(ok, F.col("relative_cp_error")), "detected": F.when(hit, F.col("cp_error"))},
        {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return base.join(q, list(keys), "left")


def detection_localisation(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detection and localisation per method and scope: MAE, quantiles, within-tolerance shares, failure rate, runtime."""
    ok, hit = F.col("status") == "TESTABLE", (F.col("status") == "TESTABLE") & (F.col("p_value") <= 0.05)
    scope = F.explode(F.array(F.struct(F.lit("unconditional").alias("scope"), ok.alias("use")),
                              F.struct(F.lit("conditional_on_detection").alias("scope"), hit.alias("use"))))
    x = rows.select(*keys, "status", "p_value", "cp_error", "runtime_seconds", ok.alias("_ok"), hit.alias("_hit"), scope.alias("s")).select(
        *keys, "s.scope", "_ok", "_hit", "runtime_seconds", F.when(F.col("s.use"), F.col("cp_error").cast("double")).alias("ae"))
    group = [*keys, "scope"]
    base = x.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("detections"), F.avg(F.col("_hit").cast("double")).alias("detection_rate"),
        (1.0 - F.avg(F.col("_ok").cast("double"))).alias("failure_rate"), F.count("ae").alias("localised"), F.avg("ae").alias("mae"),
        *[F.avg((F.col("ae") <= t).cast("double")).alias(f"within_{t}") for t in (5, 10, 20)],
        F.avg(F.when(F.col("_ok"), F.col("runtime_seconds"))).alias("mean_runtime"))
    q = exact_quantile_table(x, group, {"ae": F.col("ae"), "runtime": F.when(F.col("_ok"), F.col("runtime_seconds"))},
                             {"q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9}).drop("runtime_q25", "runtime_q75", "runtime_p90")
    return base.join(q, group, "left")


def arm_summary(rows: DataFrame, keys: Sequence[str] = ("arm", "layer")) -> DataFrame:
    """Size, p-value fractions, bootstrap-over-observed quantile ratios, failures and runtime per arm and layer."""
    ok = F.col("status") == "TESTABLE"
    v = rows.where(ok)
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("generated"), F.count_if(ok).alias("testable"), *[F.count_if(ok & (F.col("p_value") <= a)).alias(f"_k{t}") for t, a in LEVELS.items()],
        *[F.avg(F.when(ok, F.col(f"bootstrap_{q}"))).alias(f"mean_{q}") for q in ("q90", "q95", "q99")],
        F.avg(F.when(ok, F.col("runtime_seconds"))).alias("mean_runtime"), F.sum(F.when(ok, F.col("runtime_seconds"))).alias("total_runtime"),
        (F.sum("failed_draws") / (F.sum("valid_draws") + F.sum("failed_draws"))).alias("draw_failure_rate"))
    q = exact_quantiles(v, keys, "observed", {"oracle_q90": 0.9, "oracle_q95": 0.95, "oracle_q99": 0.99})
    p = exact_quantiles(v, keys, "p_value", {"median_p_value": 0.5})
    out = base.join(q, list(keys), "left").join(p, list(keys), "left")
    cols = [F.col(c) for c in out.columns if not c.startswith("_")]
    cols += [(F.col(f"mean_{x}") / F.col(f"oracle_{x}")).alias(f"{x}_over_oracle") for x in ("q90", "q95", "q99")]
    for t in LEVELS:
        cols += rate_columns(F.col(f"_k{t}"), F.col("testable"), t)
    return out.select(*cols)


def p_histogram(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-closed histogram of p-values over fixed edges, empty bins kept."""
    p = F.col("p_value")
    n_bins = len(P_EDGES) - 1
    base = rows.where(p.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if((p >= P_EDGES[i]) & (p < P_EDGES[i + 1])).alias(f"b{i}") for i in range(n_bins)])
    pairs = F.explode(F.array(*[F.struct(F.lit(P_EDGES[i]).alias("bin_left"), F.lit(min(P_EDGES[i + 1], 1.0)).alias("bin_right"),
                                         F.col(f"b{i}").alias("n")) for i in range(n_bins)]))
    return base.select(*keys, "total", pairs.alias("b")).select(*keys, "total", "b.*", (F.col("b.n") / F.col("total")).alias("fraction"))


def p_ecdf(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    p = F.col("p_value")
    base = rows.where(p.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[
        F.avg((p <= g).cast("double")).alias(f"g{i}") for i, g in enumerate(P_GRID)])
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("p_threshold"), F.col(f"g{i}").alias("ecdf")) for i, g in enumerate(P_GRID)]))
    return base.select(*keys, "total", pairs.alias("b")).select(*keys, "total", "b.*")


def json_diagnostics(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], column: str = "diagnostics") -> DataFrame:
    """Mean, minimum and maximum of numeric fields of a JSON column."""
    schema = ", ".join(f"{f} double" for f in fields)
    x = rows.select(*keys, F.from_json(column, schema).alias("j"))
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[
        fn(f"j.{f}").alias(f"{name}_{f}") for f in fields for name, fn in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def type_one(draws: DataFrame, observed: DataFrame) -> DataFrame:
    """Per-outer p-values from draw tables, then size at three levels per layer."""
    joined = draws.join(observed, ["outer", "layer"])
    per = joined.groupBy("outer", "layer").agg(
        F.when(F.count("t") > 0, finite_p(F.count_if(F.col("t") >= F.col("observed")), F.count("t"))).alias("p_value"))
    base = per.groupBy("layer").agg(F.count(F.lit(1)).alias("outers"), F.count("p_value").alias("testable"),
                                    *[F.count_if(F.col("p_value") <= a).alias(f"_k{t}") for t, a in LEVELS.items()])
    out = base.join(exact_quantiles(per, ["layer"], "p_value", {"median_p_value": 0.5}), "layer")
    cols = [F.col(c) for c in ("layer", "outers", "testable", "median_p_value")] + [(F.col("testable") / F.col("outers")).alias("testable_fraction")]
    for t in LEVELS:
        cols += rate_columns(F.col(f"_k{t}"), F.col("testable"), t)
    return out.select(*cols)


def truth_summary(rows: DataFrame, d: str, v: str, keys: Sequence[str]) -> DataFrame:
    """Monte-Carlo variance of an estimate against its mean estimated variance, with absolute quantiles."""
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("replicates"), F.avg(d).alias("mean_d"), F.var_samp(d).alias("var_d"), F.avg(v).alias("mean_v"),
        (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("mcse_mean_d"), F.avg(F.sqrt(v)).alias("_mr"))
    q = exact_quantiles(rows, keys, F.abs(d), {"abs_q90": 0.9, "abs_q95": 0.95, "abs_q99": 0.99})
    m = exact_quantiles(rows, keys, v, {"median_v": 0.5})
    return base.join(q, list(keys)).join(m, list(keys)).withColumn("sqrt_mean_v_over_sd", F.sqrt("mean_v") / F.sqrt("var_d")).withColumn(
        "mean_sqrt_v_over_sd", F.col("_mr") / F.sqrt("var_d")).drop("_mr")


def ratio_bootstrap(rows: DataFrame, d: str, v: str, unit: str, reps: int, seed: int) -> DataFrame:
    """Row-bootstrap interval of sqrt(mean V) / SD(D) from Poisson-weighted sufficient sums per replicate.

    Each row carries an independent Poisson(1) weight per replicate, so replicates are partial sums
    and no row is resampled or moved.
    """
    import pandas as pd
    import numpy as np

    def task(batches):
        from .fqi import keyed_uniform

        acc = np.zeros((reps, 4))
        for pdf in batches:
            if len(pdf):
                u = keyed_uniform(seed, np.arange(reps), pdf["k"].to_numpy(np.int64))
                w, p, cdf = np.zeros_like(u), np.exp(-1.0), np.zeros_like(u) + np.exp(-1.0)
                k = 1
                while p > 0 and (more := u > cdf).any():  # past the float's resolution p runs out
                    w += more
                    p /= k
                    cdf = cdf + p
                    k += 1
                x = pdf["d"].to_numpy(float)
                acc += w @ np.column_stack([np.ones(len(x)), x, x * x, pdf["v"].to_numpy(float)])
        yield pd.DataFrame({"rep": np.arange(reps), "w": acc[:, 0], "s": acc[:, 1], "ss": acc[:, 2], "sv": acc[:, 3]})

    parts = rows.select(F.xxhash64(unit).alias("k"), F.col(d).cast("double").alias("d"), F.col(v).cast("double").alias("v")).mapInPandas(
        task, "rep long, w double, s double, ss double, sv double")
    s = parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("w", "s", "ss", "sv")])
    var = (F.col("ss") - F.col("s") ** 2 / F.col("w")) / (F.col("w") - 1.0)
    est = s.select("rep", (F.sqrt(F.col("sv") / F.col("w")) / F.sqrt(var)).alias("ratio"))
    return exact_quantiles(est, [], "ratio", {"ci_low": 0.025, "median": 0.5, "ci_high": 0.975}).join(
        est.agg(F.count(F.lit(1)).alias("replicates"), F.stddev_samp("ratio").alias("se")))


def shape_statistics(rows: DataFrame, x: str, keys: Sequence[str]) -> DataFrame:
    """Median, unscaled MAD, bias-corrected skewness and excess kurtosis."""
    med = exact_quantiles(rows, keys, x, {"median": 0.5})
    mean = rows.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    j = rows.join(med, list(keys)).join(mean, list(keys))
    mad = exact_quantiles(j, keys, F.abs(F.col(x) - F.col("median")), {"mad": 0.5})
    e = F.col(x) - F.col("mean")
    mom = j.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(e * e).alias("m2"), F.avg(e * e * e).alias("m3"), F.avg(e * e * e * e).alias("m4"))
    return mom.join(med, list(keys)).join(mean, list(keys)).join(mad, list(keys)).select(
        *keys, F.col("n").cast("long").alias("n"), "mean", "sd", "median", "mad", sample_skew(F.col("n"), F.col("m2"), F.col("m3")).alias("skewness"),
        sample_excess_kurtosis(F.col("n"), F.col("m2"), F.col("m4")).alias("excess_kurtosis"))


def linear_metrics(rows: DataFrame, actual: str, approx: str, keys: Sequence[str]) -> DataFrame:
    a, b = F.col(actual), F.col(approx)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("correlation"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"),
        F.sqrt(F.avg((a - b) ** 2)).alias("rmse"), (F.sqrt(F.avg((a - b) ** 2)) / F.sqrt(F.avg(a * a))).alias("relative_rmse"),
        (F.var_samp(b) / F.var_samp(a)).alias("variance_ratio"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("sign_agreement"))


def decomposition(rows: DataFrame) -> DataFrame:
    group = ["method", "layer"]
    hit = (F.col("p_value") <= 0.05).cast("double")
    base = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("replicates"), F.avg((F.col("status") == "TESTABLE").cast("double")).alias("testable_fraction"),
        F.avg(hit).alias("rejection_rate"), F.avg("observed").alias("mean_observed"), F.avg("bootstrap_q95").alias("mean_q95"))
    q = exact_quantile_table(rows, group, {"observed": F.col("observed"), "q95": F.col("bootstrap_q95"), "p": F.col("p_value")}, {"median": 0.5})
    return base.join(q, group).withColumn("mcse", F.sqrt(F.col("rejection_rate") * (1 - F.col("rejection_rate")) / F.col("replicates")))


def decomposition_pivot(table: DataFrame, methods: Sequence[str]) -> DataFrame:
    return table.groupBy("layer").pivot("method", list(methods)).agg(F.first("rejection_rate"))


def scaling_summary(rows: DataFrame, diagnostics: Sequence[str]) -> DataFrame:
    """Rejection and mean statistic by the value of each design diagnostic (N, T, ridge, ...)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("diagnostic"), F.col(d).cast("double").alias("level")) for d in diagnostics]))
    return rows.select("p_value", "observed", pairs.alias("d")).groupBy(F.col("d.diagnostic").alias("diagnostic"), F.col("d.level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("p_value") <= 0.05).cast("double")).alias("rate"), F.avg("observed").alias("mean_observed"),
        F.stddev_samp("observed").alias("sd_observed"))


def against_truth(arms: DataFrame, baseline: str) -> DataFrame:
    """Each arm's mean bootstrap quantiles over the baseline arm's, per layer."""
    ref = arms.where(F.col("arm") == baseline).select("layer", *[F.col(f"mean_{q}").alias(f"_{q}") for q in ("q90", "q95", "q99")])
    return arms.join(F.broadcast(ref), "layer").select("arm", "layer", *[
        (F.col(f"mean_{q}") / F.col(f"_{q}")).alias(f"{q}_ratio") for q in ("q90", "q95", "q99")])


# ------------------------------------------------------------------------------ gates
def gate_table(metrics: DataFrame, limits: Sequence[tuple[str, str, float | None, float | None]]) -> DataFrame:
    """Metric rows with bounds and pass flag; ``limits`` is (domain, metric, low, high), inclusive."""
    pairs = F.explode(F.array(*[F.struct(
        F.lit(d).alias("domain"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(lo).cast("double").alias("low"),
        F.lit(hi).cast("double").alias("high")) for d, m, lo, hi in limits]))
    keys = [c for c in metrics.columns if c not in {m for _, m, _, _ in limits}]
    rows = metrics.select(*keys, pairs.alias("g")).select(*keys, "g.*")
    ok = F.coalesce((F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high"))), F.lit(False))
    return rows.withColumn("passed", F.when(F.col("value").isNull(), F.lit(False)).otherwise(ok))


def domain_gates(gates: DataFrame, keys: Sequence[str]) -> DataFrame:
    return gates.groupBy(*keys, "domain").agg(F.bool_and("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed_metrics"))


def gate_label(domains: DataFrame, keys: Sequence[str], precedence: Sequence[tuple[str, str]], success: str) -> DataFrame:
    """The label of the first failing domain in precedence order, or the success label."""
    failing = domains.groupBy(*keys).agg(F.collect_set(F.when(~F.col("passed"), F.col("domain"))).alias("_f"))
    out = F.lit(success)
    for domain, label in reversed(precedence):
        out = F.when(F.array_contains("_f", domain), F.lit(label)).otherwise(out)
    return failing.select(*keys, out.alias("gate"))


def systematic_failures(domains: DataFrame, minimum: int = 3) -> DataFrame:
    """Domains that fail in at least ``minimum`` scenarios."""
    return domains.where(~F.col("passed")).groupBy("domain").agg(F.count(F.lit(1)).alias("scenarios")).where(F.col("scenarios") >= minimum)


def engineering_rates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("outers"), F.avg((F.col("status") != "TESTABLE").cast("double")).alias("outer_failure_rate"),
        (F.sum("failed_draws") / (F.sum("valid_draws") + F.sum("failed_draws"))).alias("draw_failure_rate"),
        F.avg((F.col("status") == "NOT_TESTABLE_SUPPORT").cast("double")).alias("support_rejection_rate"),
        F.avg((F.col("status") == "TESTABLE").cast("double")).alias("testable_fraction"))


def result_violations(rows: DataFrame, draws: int) -> DataFrame:
    """Stage validation: p-value range, change point in the admissible set, status consistency."""
    ok = F.col("status") == "TESTABLE"
    rules = {
        "p_value_range": ~ok | ((F.col("p_value") >= 1.0 / (draws + 1)) & (F.col("p_value") <= 1.0)),
        "cp_in_admissible_set": ~ok | F.array_contains(F.from_json("admissible_candidates", "array<bigint>"), F.col("estimated_cp")),
        "no_p_without_test": ok | F.col("p_value").isNull(),
        "known_status": F.col("status").isin("TESTABLE", "NOT_TESTABLE_SUPPORT", *FAILED),
    }
    broken = F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))
    return rows.select(broken.alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def bank_integrity(bank: DataFrame, registry: DataFrame, expected_coords: int) -> DataFrame:
    """Stored rows against their registry: missing keys, unexpected keys, wrong coordinate counts."""
    have = bank.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("coord").alias("c"))
    missing = registry.join(have, "key", "left_anti").select("key", F.lit("missing").alias("problem"))
    extra = have.join(registry, "key", "left_anti").select("key", F.lit("unregistered").alias("problem"))
    shape = have.where((F.col("n") != expected_coords) | (F.col("c") != expected_coords)).select("key", F.lit("wrong_shape").alias("problem"))
    return missing.unionByName(extra).unionByName(shape)


def relative_to_baseline(arms: DataFrame, baseline: str, metrics: Mapping[str, float]) -> DataFrame:
    """Log-ratio errors of every arm against the baseline arm; ``metrics`` maps a metric to its target value.

    The baseline comes from the same reading of ``arms``: means summed again in another order differ in their last bits, and an arm would
    be closer than itself.
    """
    errors = arms.where(F.col("layer").isNotNull()).select("arm", "layer", *[F.abs(F.log(F.col(m) / F.lit(t))).alias(m) for m, t in metrics.items()])
    ref = F.collect_list(F.when(F.col("arm") == baseline, F.struct(*metrics))).over(Window.partitionBy("layer"))
    x = errors.withColumn("_refs", ref).withColumn("_ref", F.explode("_refs"))
    pairs = [(F.col(m), F.col("_ref")[m]) for m in metrics]
    closer = sum(((own < base).cast("long") for own, base in pairs), F.lit(0))
    worse = F.greatest(*[(own - base) / F.greatest(base, F.lit(1e-12)) for own, base in pairs], F.lit(None).cast("double"))
    return x.groupBy("arm").agg(F.sum(closer).alias("metrics_closer"), F.max(worse).alias("maximum_degradation"))


def pick_arm(comparison: DataFrame, order: Sequence[str], minimum_closer: int, maximum_degradation: float) -> DataFrame:
    """The simplest arm (earliest in ``order``) that passes, or NONE."""
    rank = F.element_at(F.create_map(*[x for i, a in enumerate(order) for x in (F.lit(a), F.lit(i))]), F.col("arm"))
    ok = (F.col("metrics_closer") >= minimum_closer) & (F.col("maximum_degradation") <= maximum_degradation)
    return comparison.agg(F.coalesce(F.min_by(F.when(ok, F.col("arm")), F.when(ok, rank)), F.lit("NONE")).alias("selected"))


def fingerprint(draws: DataFrame, keys: Sequence[str], order: str, value: str, digits: int = 6) -> DataFrame:
    """Order-independent digest of a draw set: two sums of independent 60-bit hashes of the draws, and the count.

    Equal multisets of (draw, value) give equal fingerprints, and repeated draws do not cancel out; nothing is
    collected into one list.
    """
    text = F.concat_ws(":", F.col(order).cast("string"), fixed_text(F.col(value), digits))
    sums = [F.sum(F.conv(F.substring(F.sha2(text, 256), at, 15), 16, 10).cast("decimal(20,0)")).cast("string") for at in (1, 16)]
    return draws.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", *sums).alias("digest"))


def same_fingerprint(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = b.select(*keys, F.col("n").alias("n_b"), F.col("digest").alias("digest_b"))
    return a.join(right, list(keys), "full_outer").select(*keys, F.coalesce((F.col("n") == F.col("n_b")) & (F.col("digest") == F.col("digest_b")), F.lit(False)).alias("equal"))


def calibration_table(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Observed value, critical value, p-value and decision per layer and method, methods side by side."""
    out = None
    for name, df in parts.items():
        x = df.select("layer", F.lit(name).alias("method"), "observed", "critical_value", "p_value", "reject")
        out = x if out is None else out.unionByName(x)
    wide = out.groupBy("layer").pivot("method", list(parts)).agg(
        F.first("critical_value").alias("critical_value"), F.first("p_value").alias("p_value"), F.first("reject").alias("reject"))
    return out.groupBy("layer").agg(F.first("observed").alias("observed")).join(wide, "layer")
