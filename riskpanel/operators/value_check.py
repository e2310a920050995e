"""Value-model sanity on down-sampled transitions: bounds, Q quantiles, regions, ridge sensitivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cases, hash_uniform
from .fqi import FitRule, fit, prepare
from .quantiles import exact_quantile_table, exact_quantiles

_END = 2_000_000_000
# Propensity regions and Q quantiles.
REGIONS = (0.005, 0.02, 0.10)
Q_PROBS = {"min": 0.0, "p01": .01, "p05": .05, "p25": .25, "p50": .5, "p75": .75, "p95": .95, "p99": .99, "max": 1.0}


def downsample_negatives(rows: DataFrame, ratio: int, seed: int) -> DataFrame:
    """All action-1 rows and exactly ``ratio`` times as many action-0 rows (all of them if fewer), by hash order.

    The cut-off is the exact rank quantile of the hash, so nothing is sorted globally.
    """
    h = hash_uniform(seed, F.col("entity_id"), F.col("elapsed_index"))
    marked = rows.withColumn("_h", F.when(F.col("action") == 0, h))
    n = marked.agg(F.count_if(F.col("action") == 1).alias("n1"), F.count_if(F.col("action") == 0).alias("n0")).collect()[0]
    want = min(n["n0"], ratio * n["n1"])
    if want == n["n0"]:
        return rows
    if want == 0:
        return rows.where("action = 1")
    cut = exact_quantiles(marked, [], "_h", {"cut": (want - 1) / (n["n0"] - 1) if n["n0"] > 1 else 0.0}).collect()[0]["cut"]
    return marked.where((F.col("action") == 1) | (F.col("_h") <= cut + 1e-13)).drop("_h")


def q_values(rows: DataFrame, beta: np.ndarray, dim: int, state: str = "state") -> DataFrame:
    """Q(s,0), Q(s,1) and their gap as column expressions."""
    q = dim + 1

    def dot(coef: np.ndarray) -> Column:
        t = F.lit(float(coef[0]))
        for i in range(1, q):
            t = t + F.lit(float(coef[i])) * F.element_at(state, i)
        return t
    return rows.select("*", dot(beta[:q]).alias("q0"), dot(beta[q:]).alias("q1")).withColumn("qgap", F.col("q1") - F.col("q0"))


def value_check(fit_rows: DataFrame, eval_rows: DataFrame, dim: int, rewards: Mapping[str, tuple[str, float, float]], alphas: Sequence[float],
                gamma: float, tolerance: float = 1e-5) -> DataFrame:
    """Rows of ``eval_rows`` with Q-values for every reward and ridge, plus fit status columns."""
    out = None
    for name, (column, lo, hi) in rewards.items():
        panel = fit_rows.withColumn("reward", F.col(column).cast("double")).select("entity_id", "elapsed_index", "action", "reward", "state", "next_state")
        design = prepare(panel, [_END], 0, _END + 1, dim, f"check-{name}")
        for alpha in alphas:
            rule = FitRule(gamma=gamma, alpha=float(alpha), tolerance=tolerance, max_iterations=300, estimator="sums")
            models = fit(design, rule, summed=True)
            beta = models.beta[0, 0, 0]
            v = q_values(eval_rows, beta, dim).select(
                "entity_id", "split", "elapsed_index", "action", "propensity", F.lit(name).alias("reward_name"), F.lit(float(alpha)).alias("alpha"),
                "q0", "q1", "qgap", F.lit(bool(models.converged[0, 0, 0])).alias("converged"), F.lit(int(models.iterations[0, 0, 0])).alias("iterations"),
                F.lit(float(np.linalg.norm(beta))).alias("coef_l2"), F.lit(lo / (1 - gamma)).alias("q_lower"), F.lit(hi / (1 - gamma)).alias("q_upper"))
            out = v if out is None else out.unionByName(v)
    return out


def value_summary(values: DataFrame) -> DataFrame:
    group = ["reward_name", "alpha", "split"]
    def out(c: str) -> Column:
        return F.avg(((F.col(c) < F.col("q_lower")) | (F.col(c) > F.col("q_upper"))).cast("double"))
    base = values.groupBy(*group).agg(
        F.first("converged").alias("converged"), F.first("iterations").alias("iterations"), F.first("coef_l2").alias("coef_l2"), F.count(F.lit(1)).alias("n"),
        out("q0").alias("q0_outside"), out("q1").alias("q1_outside"))
    return base.join(exact_quantile_table(values, group, {c: F.col(c) for c in ("q0", "q1", "qgap")}, Q_PROBS), group)


def region_summary(values: DataFrame) -> DataFrame:
    """Q-gap by propensity region."""
    p = F.col("propensity")
    a, b, c = REGIONS
    region = cases([(p < a, f"p_below_{a}"), (p < b, f"p_{a}_to_{b}"), (p < c, f"p_{b}_to_{c}")], f"p_at_least_{c}")
    group = ["reward_name", "alpha", "split", "region"]
    x = values.withColumn("region", region)
    base = x.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("action").alias("action_1"), F.avg("action").alias("action_1_rate"),
                                 F.avg("qgap").alias("qgap_mean"), F.stddev_pop("qgap").alias("qgap_sd"))
    return base.join(exact_quantiles(x, group, F.abs("qgap"), {"abs_qgap_p95": 0.95}), group)


def ridge_sensitivity(values: DataFrame, reference: float = 1.0) -> DataFrame:
    """Q-gap agreement of every ridge with the reference ridge on the same rows."""
    key = ["reward_name", "split", "entity_id", "elapsed_index"]
    ref = values.where(F.col("alpha") == reference).select(*key, F.col("qgap").alias("ref"))
    x = values.join(ref, key)
    return x.groupBy("reward_name", "split", "alpha").agg(
        F.corr("ref", "qgap").alias("correlation"), F.avg(F.abs(F.col("ref") - F.col("qgap"))).alias("mean_abs_difference"),
        F.max(F.abs(F.col("ref") - F.col("qgap"))).alias("max_abs_difference"))
