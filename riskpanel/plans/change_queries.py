"""Registered queries: fitted models, change-point process and bootstrap calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import fqi as Q
from ..operators import nullmodel as N
from ..operators import panel as PN
from ..operators import process as H
from ..operators import support as S
from ..session import materialise, shared_table, source_state
from . import panel_queries as PQ
from . import roles as R
from .registry import Query, query, rounded
from .sql import DAILY, screen_sql, with_

RULE = Q.FitRule(gamma=0.9, alpha=1.0)
START, END = R.WINDOW
MID = 15
SEED, DRAWS = 11, 199
Z_STATES = 32
_CACHE: dict = {}


def _once(s: SparkSession, d: str, name: str, build):
    key = (s.sparkContext.applicationId, d, name, source_state(s, d))
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def z_design(s: SparkSession, d: str) -> np.ndarray:
    """Evaluation points as action-block design vectors (a fixed number of reference states)."""
    def build():
        sample = PN.evaluation_sample(PQ.panel(s, d), Z_STATES, PQ.SEED).orderBy("round", "entity_id").collect()
        x = np.asarray([r["state"] for r in sample], dtype=float)
        return np.vstack([Q.action_design(x, np.zeros(len(x))), Q.action_design(x, np.ones(len(x)))])
    return _once(s, d, "z", build)


def entity_total(s: SparkSession, d: str) -> int:
    return _once(s, d, "entities", lambda: PQ.panel(s, d).select("entity_id").distinct().count())


def bounds(s: SparkSession, d: str) -> dict[int, float]:
    def build():
        rows = H.boundaries(PQ.screened(s, d), START, END, entity_total(s, d)).collect()
        return {r["candidate"]: r["boundary"] for r in rows}
    return _once(s, d, "bounds", build)


def admissible(s: SparkSession, d: str) -> list[int]:
    return _once(s, d, "cuts", lambda: sorted(r["candidate"] for r in PQ.screened(s, d).where("admissible").select("candidate").collect()))


def prepared(s: SparkSession, d: str) -> H.Prepared:
    """Admissible cuts fitted on the re-entry panel; the smallest run of the engine every arm starts from."""
    def build():
        cuts = admissible(s, d)
        if not cuts:
            raise ValueError("NOT_TESTABLE_SUPPORT")
        design = Q.prepare(PQ.panel(s, d), cuts, START, END, R.STATE_DIM, "design")
        mid = min(cuts, key=lambda u: (abs(u - MID), u))
        return H.prepare_process(design, RULE, z_design(s, d), bounds(s, d), mid)
    return _once(s, d, "prepared", build)


def observed(s: SparkSession, d: str) -> DataFrame:
    return prepared(s, d).table(s)


def _variance_counts(s: SparkSession, d: str) -> DataFrame:
    p = prepared(s, d)
    long = H.long_contributions(p.contrib, p.design.cuts, len(p.z_design))
    return observed(s, d).join(long.groupBy("candidate", "z").agg(F.count(F.lit(1)).alias("clusters")), ["candidate", "z"])


def scan(s: SparkSession, d: str) -> DataFrame:
    """Flagship: screened cuts, fitted process, estimated change point and multiplier-calibrated layers."""
    p = prepared(s, d)
    proc = _variance_counts(s, d)
    draws = B.multiplier_process(p.contrib.select("entity_id", "delta"), proc, p.design.cuts, len(p.z_design), DRAWS, SEED, "M0")
    out = B.calibrate(B.draw_layers(draws, p.midpoint), H.layers(proc, p.midpoint))
    return out.join(F.broadcast(H.change_point(proc).select("tau_hat")))


# --------------------------------------- the engine where the answer has a closed form
CLOSED = Q.FitRule(gamma=0.0, alpha=1.0)
CLOSED_STATES = (0.5, 2.0)


def closed(s: SparkSession, d: str) -> tuple[Q.Design, Q.Models, np.ndarray]:
    """Without discount and with one state coordinate a model is two ridge lines, which SQL can state; the code path is that of every fit."""
    def build():
        one = PQ.panel(s, d).withColumn("state", F.slice("state", 1, 1)).withColumn("next_state", F.slice("next_state", 1, 1))
        design = Q.prepare(one, R.CUTS, START, END, 1, "closed")
        x = np.array(CLOSED_STATES)[:, None]
        return design, Q.fit(design, CLOSED), np.vstack([Q.action_design(x, np.zeros(2)), Q.action_design(x, np.ones(2))])
    return _once(s, d, "closed", build)


def closed_contributions(s: SparkSession, d: str) -> DataFrame:
    design, models, z = closed(s, d)
    return H.long_contributions(Q.contributions(design, CLOSED, models, z), design.cuts, len(z)).select(
        "entity_id", F.col("candidate").cast("long"), F.col("z").cast("long"), "delta")


def closed_process(s: SparkSession, d: str) -> DataFrame:
    design, models, z = closed(s, d)
    bound = {r["candidate"]: r["boundary"] for r in shift_bounds(s, d).collect()}
    contrib = Q.contributions(design, CLOSED, models, z)
    prep = H.Prepared(design, CLOSED, models, z, bound, MID, Q.process_table(design, models, contrib, z), contrib)
    return prep.table(s)


def closed_fit(s: SparkSession, d: str) -> DataFrame:
    design, models, _ = closed(s, d)
    return H.fit_table(s, design, CLOSED, models).select("candidate", "side", "status", "converged", F.posexplode("beta").alias("coordinate", "beta"))


def closed_jacobian(s: SparkSession, d: str) -> DataFrame:
    """Negative Jacobian of the estimating equations by differences, and the influence matrix, entry by entry."""
    design, models, _ = closed(s, d)
    num, w = H.numerical_jacobian(design, CLOSED, models.beta[0]), models.W[0]
    rows = [(int(c), side, a, b, float(num[j, k, a, b]), float(w[j, k, a, b])) for j, c in enumerate(design.cuts) for k, side in enumerate(("left", "right")) for a in range(4) for b in range(4)]
    return s.createDataFrame(rows, "candidate long, side string, a long, b long, jacobian double, influence double")


def closed_values(s: SparkSession, d: str) -> DataFrame:
    design, models, _ = closed(s, d)
    return H.row_values(design, CLOSED, models).drop("inv_n")


# ------------------------------------------------- exact contributions from the panel
FEATURES = ("s0", "s1", "s2", "reward")
N_Z = len(FEATURES)


def mean_shift(s: SparkSession, d: str) -> DataFrame:
    """Per entity and cut, centred left and right means of four panel columns: an exact stand-in for fitted influences."""
    def build():
        panel = PQ.panel(s, d)
        cols = [*[F.element_at("state", i + 1) for i in range(3)], F.col("reward")]
        slot = sum(((F.col("elapsed_index") >= c).cast("int") for c in R.CUTS), F.lit(0))
        cells = panel.groupBy("entity_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"x{i}") for i, c in enumerate(cols)])
        cut = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(c).alias("candidate")) for j, c in enumerate(R.CUTS)]))
        sides = cells.select("*", cut.alias("c")).withColumn("left", F.col("slot") <= F.col("c.j"))

        def mean(i: int, left: bool):
            keep = F.col("left") if left else ~F.col("left")
            return F.sum(F.when(keep, F.col(f"x{i}"))) / F.sum(F.when(keep, F.col("n")))

        per = sides.groupBy("entity_id", F.col("c.candidate").cast("long").alias("candidate")).agg(
            F.array(*[mean(i, True) for i in range(N_Z)]).alias("l"), F.array(*[mean(i, False) for i in range(N_Z)]).alias("r"))
        return per.select("entity_id", "candidate", F.posexplode(F.arrays_zip("l", "r")).alias("z", "v")).select(
            "entity_id", "candidate", F.col("z").cast("long").alias("z"), F.col("v.l").alias("lm"), F.col("v.r").alias("rm"))
    return shared_table(s, d, "mean_shift", build)


def shift_contrast(s: SparkSession, d: str) -> DataFrame:
    return mean_shift(s, d).groupBy("candidate", "z").agg((F.avg("lm") - F.avg("rm")).alias("contrast"))


def shift_contributions(s: SparkSession, d: str) -> DataFrame:
    def build():
        x = mean_shift(s, d)
        m = x.groupBy("candidate", "z").agg(F.avg("lm").alias("ml"), F.avg("rm").alias("mr"), F.count("lm").alias("gl"), F.count("rm").alias("gr"))
        return x.join(F.broadcast(m), ["candidate", "z"]).select(
            "entity_id", "candidate", "z", (F.coalesce((F.col("lm") - F.col("ml")) / F.col("gl"), F.lit(0.0))
                                            - F.coalesce((F.col("rm") - F.col("mr")) / F.col("gr"), F.lit(0.0))).alias("delta"))
    return shared_table(s, d, "shift_contributions", build)


def shift_left_out(s: SparkSession, d: str) -> DataFrame:
    """The mean shift without each entity: a closed form, NULL where a side is then empty."""
    def build():
        x = mean_shift(s, d)
        m = x.groupBy("candidate", "z").agg(F.avg("lm").alias("ml"), F.avg("rm").alias("mr"), F.count("lm").alias("gl"), F.count("rm").alias("gr"))

        def without(own: str, mean: str, g: str):
            return F.when(F.col(own).isNull(), F.col(mean)).when(F.col(g) > 1, (F.col(g) * F.col(mean) - F.col(own)) / (F.col(g) - 1.0))

        return x.join(F.broadcast(m), ["candidate", "z"]).select("entity_id", "candidate", "z", (without("lm", "ml", "gl") - without("rm", "mr", "gr")).alias("leave_one_out"))
    return shared_table(s, d, "shift_left_out", build)


def shift_wide(s: SparkSession, d: str) -> DataFrame:
    """One vector over (cut, z) per entity; its length is fixed by the grid."""
    slots = [F.coalesce(F.sum(F.when((F.col("candidate") == c) & (F.col("z") == z), F.col("delta"))), F.lit(0.0)) for c in R.CUTS for z in range(N_Z)]
    return shift_contributions(s, d).groupBy("entity_id").agg(F.array(*slots).alias("delta"))


def shift_bounds(s: SparkSession, d: str, scaling: str = "harmonic_active") -> DataFrame:
    return H.boundaries(PQ.screened(s, d), START, END, entity_total(s, d), scaling)


def shift_process(s: SparkSession, d: str) -> DataFrame:
    return shared_table(s, d, "shift_process", lambda: H.process(
        shift_contrast(s, d), H.cluster_variance(shift_contributions(s, d)), shift_bounds(s, d)))


def shift_draws(s: SparkSession, d: str, arm: str, scale: float = 1.0, law: str = "gaussian", draws: int = DRAWS) -> DataFrame:
    return B.multiplier_process(shift_wide(s, d), shift_process(s, d), R.CUTS, N_Z, draws, SEED, arm, law, scale)


def calibrated(s: SparkSession, d: str, arm: str, law: str = "gaussian") -> DataFrame:
    return B.calibrate(B.draw_layers(shift_draws(s, d, arm, law=law), MID), H.layers(shift_process(s, d), MID))


# ------------------------------------------------------------------------ refit arms
def null_design(s: SparkSession, d: str) -> tuple[Q.Design, np.ndarray]:
    """Rows with base rewards and residuals of the common fit, and its coefficients for every cut and side."""
    def build():
        cuts = prepared(s, d).design.cuts
        null, beta, _ = B.restricted_null(PQ.panel(s, d), START, END, R.STATE_DIM, RULE)
        return Q.prepare(null, cuts, START, END, R.STATE_DIM, "m2"), np.tile(beta, (len(cuts), 2, 1))
    return _once(s, d, "null", build)


def m2(s: SparkSession, d: str) -> DataFrame:
    def build():
        design, beta = null_design(s, d)
        return B.refit_draws(prepared(s, d), design, DRAWS, Q.Randomness("reward", "gaussian", SEED), False, beta)
    return shared_table(s, d, "m2", build)


def m3(s: SparkSession, d: str) -> DataFrame:
    p = prepared(s, d)
    return shared_table(s, d, "m3", lambda: B.refit_draws(
        p, p.design, DRAWS, Q.Randomness("weight", "exponential", SEED), True, p.models.beta[0]))


def count_weights(s: SparkSession, d: str) -> DataFrame:
    """Multinomial entity counts of all draws."""
    return shared_table(s, d, "count-weights", lambda: B.multinomial_entities(PQ.panel(s, d).select("entity_id").distinct(), DRAWS, SEED))


def m3_counts(s: SparkSession, d: str) -> DataFrame:
    """The weighted arm under multinomial counts: whole entities drawn with replacement."""
    p = prepared(s, d)
    return shared_table(s, d, "m3-counts", lambda: B.refit_draws(
        p, p.design, DRAWS, Q.Randomness("weight", "table", SEED, table=count_weights(s, d)), True, p.models.beta[0]))


def refit_calibration(s: SparkSession, d: str, draws: DataFrame) -> DataFrame:
    p = prepared(s, d)
    return B.calibrate(B.draw_layers(draws, p.midpoint), H.layers(observed(s, d), p.midpoint))


def trait_panel(s: SparkSession, d: str) -> DataFrame:
    """Panel whose second coordinate is a time-invariant trait of the entity, as the parametric null requires."""
    trait = F.pmod("entity_id", F.lit(2)).cast("double")
    def put(c):
        return F.array(F.element_at(c, 1), trait, F.element_at(c, 2), F.element_at(c, 3)).alias(c)
    return PQ.panel(s, d).select("entity_id", "elapsed_index", "action", "reward", put("state"), put("next_state"))


def parametric_null(s: SparkSession, d: str) -> DataFrame:
    return N.coefficient_table(s, N.fit_parametric_null(materialise(trait_panel(s, d), "trait-panel"), 4)[0])


def bridge_null(s: SparkSession, d: str) -> DataFrame:
    return N.coefficient_table(s, N.fit_bridge_null(PQ.panel(s, d), R.STATE_DIM)[0])


def refit_accounting(s: SparkSession, d: str) -> DataFrame:
    """Valid and failed draws of the two refit arms; a draw without a value anywhere did not converge."""
    log = m2(s, d).select(F.lit("M2").alias("arm"), "draw", "joint").unionByName(m3(s, d).select(F.lit("M3").alias("arm"), "draw", "joint"))
    failed = F.max(F.col("joint").isNull())
    return B.draw_accounting(log.groupBy("arm", "draw").agg(F.when(failed, F.lit("fqi did not converge")).alias("message")), ["arm"])


def left_out(s: SparkSession, d: str) -> DataFrame:
    """Contrasts at all points of the models refitted without each entity, a vector over cuts x points."""
    p = prepared(s, d)
    return shared_table(s, d, "left-out", lambda: Q.leave_one_out_vectors(p.design, RULE, p.models, p.z_design))


def jackknife(s: SparkSession, d: str) -> DataFrame:
    """Leave-one-entity-out refits of every cut as pseudo-contributions and their variance, at the first point."""
    p = prepared(s, d)
    values = Q.by_candidate(left_out(s, d), p.design.cuts, len(p.z_design))
    return H.jackknife(values.select("entity_id", "candidate", F.element_at("value", 1).alias("leave_one_out")))


def fitted_versions(s: SparkSession, d: str) -> DataFrame:
    """The five variances of the fitted contrast at all points of every cut."""
    p = prepared(s, d)
    return B.vector_versions(H.contribution_vectors(p.contrib, len(p.z_design)), left_out(s, d), observed(s, d), DRAWS, SEED)


def jacobian_check(s: SparkSession, d: str) -> DataFrame:
    """Every cut and side: the influence matrix against differences, the equation at the fit, and the fit's first-order distance from the common model."""
    p = prepared(s, d)
    beta, null = p.models.beta[0], null_design(s, d)[1]
    error = np.abs(H.numerical_jacobian(p.design, RULE, beta) - p.models.W[0]).max(axis=(-1, -2))
    psi = np.linalg.norm(H.estimating_equations(p.design, RULE, beta[None])[0], axis=-1)
    linear, whole = H.linearised_error(p.design, RULE, null), beta - null
    rows = [(int(c), side, float(error[j, k]), float(psi[j, k]), float(np.linalg.norm(linear[j, k])), float(np.linalg.norm(whole[j, k])), float(np.linalg.norm(whole[j, k] - linear[j, k])))
            for j, c in enumerate(p.design.cuts) for k, side in enumerate(("left", "right"))]
    return s.createDataFrame(rows, "candidate long, side string, jacobian_error double, equation_norm double, linearised_norm double, distance_norm double, remainder_norm double")


def sweep(s: SparkSession, d: str) -> DataFrame:
    """Sensitivity variants (rule profile, scaling, estimator, grid size, draws) on shared fits, one row each."""
    panel, strict = PQ.panel(s, d), materialise(PQ.strict_panel(s, d), "strict")
    total, z = entity_total(s, d), z_design(s, d)
    rules = {"primary": PQ.PANEL_RULE, "lenient": S.LENIENT, "none": S.NO_SUPPORT}
    scalings = ("harmonic_active", "both_sides", "harmonic_ess")
    fits = {}
    for mode, rows, est in (("reentry", panel, "balanced"), ("reentry", panel, "pooled"), ("strict_first_gap", strict, "balanced")):
        design = Q.prepare(rows, R.CUTS, START, END, R.STATE_DIM, f"sweep-{mode}-{est}")
        rule = Q.FitRule(gamma=RULE.gamma, alpha=RULE.alpha, estimator=est)
        models = Q.fit(design, rule)
        contrib = materialise(Q.contributions(design, rule, models, z), "sweep-contrib")
        fits[(mode, est)] = (design, rule, models, contrib, Q.process_table(design, models, contrib, z))
    out = None
    for (mode, est), (design, rule, models, contrib, var) in fits.items():
        view = PN.support_view(panel if mode == "reentry" else strict)
        for profile, srule in rules.items():
            screened = materialise(S.screen(view, R.CUTS, START, END, srule, R.STATE_DIM), "sweep-screen")
            for scaling in scalings if profile == "primary" else scalings[:1]:
                b = {r["candidate"]: r["boundary"] for r in H.boundaries(screened.where("admissible"), START, END, total, scaling).collect()}
                n_adm = len(b)
                row = {"panel_mode": mode, "estimator": est, "profile": profile, "scaling": scaling, "admissible": n_adm}
                if n_adm == 0:
                    part = s.createDataFrame([{**row, "status": "NOT_TESTABLE_SUPPORT", "statistic": None, "tau_hat": None}],
                                             "panel_mode string, estimator string, profile string, scaling string, admissible long, status string, statistic double, tau_hat long")
                else:
                    prep = H.Prepared(design, rule, models, z, {c: b.get(c, 0.0) for c in design.cuts}, MID, var, contrib)
                    proc = prep.table(s).where(F.col("candidate").isin(sorted(b)))
                    cp = H.change_point(proc)
                    part = cp.select(*[F.lit(v).alias(k) for k, v in row.items()], F.lit("TESTABLE").alias("status"), "statistic", "tau_hat")
                    part = part.withColumn("admissible", F.col("admissible").cast("long"))
                out = part if out is None else out.unionByName(part)
    return out


def grid_sweep(s: SparkSession, d: str) -> DataFrame:
    """One change at a time from the fitted process: evaluation points, number of draws, clusters of single transitions, pooled weights."""
    p = prepared(s, d)
    half = len(p.z_design) // 2  # points are all states under action 0, then all under action 1

    def points(n: int) -> np.ndarray:
        return np.r_[0:n, half:half + n]

    def prep(z: np.ndarray, variance: np.ndarray, models=None, rule=RULE, contrib=None) -> H.Prepared:
        bound = dict(zip(p.design.cuts, p.bound))
        return H.Prepared(p.design, rule, models or p.models, z, bound, p.midpoint, variance, contrib)

    def told(variant: str, value: int, one: H.Prepared, draws: DataFrame | None = None) -> DataFrame:
        table = one.table(s)
        row = H.change_point(table).crossJoin(H.layers(table, p.midpoint).select("D4"))
        if draws is not None:
            row = row.crossJoin(B.calibrate(B.draw_layers(draws, p.midpoint), H.layers(table, p.midpoint)).where("layer = 'D4'").select("p_value", "valid_draws"))
        else:
            row = row.withColumn("p_value", F.lit(None).cast("double")).withColumn("valid_draws", F.lit(None).cast("long"))
        return row.select(F.lit(variant).alias("variant"), F.lit(value).cast("long").alias("value"), "tau_hat", "statistic", "D4", "p_value", "valid_draws")

    out = []
    for n in sorted({1, half // 4, half // 2, half} - {0}):
        at = points(n)
        out.append(told("states", n, prep(p.z_design[at], p.variance[:, :, at])))
    everything, proc = prep(p.z_design, p.variance), _variance_counts(s, d)
    for n in (49, 99, 199):
        draws = B.multiplier_process(p.contrib.select("entity_id", "delta"), proc, p.design.cuts, len(p.z_design), n, SEED, "M0")
        out.append(told("draws", n, everything, draws))
    single = H.transition_cluster_variance(p.design, RULE, p.models, p.z_design)
    out.append(told("transition_clusters", 1, prep(p.z_design, single[None])))
    pooled_rule = Q.FitRule(gamma=RULE.gamma, alpha=RULE.alpha, estimator="pooled")
    pooled = Q.fit(p.design, pooled_rule)
    contrib = materialise(Q.contributions(p.design, pooled_rule, pooled, p.z_design), "pooled")
    out.append(told("pooled_entities", 1, prep(p.z_design, Q.process_table(p.design, pooled, contrib, p.z_design), pooled, pooled_rule)))
    out.append(told("pooled_transitions", 1, prep(p.z_design, H.transition_cluster_variance(p.design, pooled_rule, pooled, p.z_design)[None], pooled, pooled_rule)))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def _values(s: SparkSession, d: str) -> DataFrame:
    p = prepared(s, d)
    return H.row_values(p.design, RULE, p.models)


# ------------------------------------------------------------------------------- SQL
_U = "(('0x' || substr(md5({k}), 1, 13))::BIGINT / 4503599627370496.0)"


def md5_uniform(key: str) -> str:
    return _U.format(k=key)


def md5_normal(key: str) -> str:
    return (f"(sqrt(-2.0 * ln(greatest({md5_uniform(key + chr(32) + '||' + chr(32) + repr(':u'))}, {2.0 ** -52!r}))) "
            f"* cos(2.0 * pi() * {md5_uniform(key + chr(32) + '||' + chr(32) + repr(':v'))}))")


SHIFT = DAILY + screen_sql("panel", PQ.PANEL_RULE, 3) + """,
pl AS (UNPIVOT (SELECT entity_id, elapsed_index, s0 AS z0, s1 AS z1, s2 AS z2, reward AS z3 FROM panel) ON z0, z1, z2, z3 INTO NAME zn VALUE x),
ms AS (SELECT entity_id, candidate, substr(zn, 2)::BIGINT AS z, avg(x) FILTER (elapsed_index < candidate) AS lm, avg(x) FILTER (elapsed_index >= candidate) AS rm
    FROM pl CROSS JOIN (VALUES (6), (9), (12), (15), (18), (21), (24)) c(candidate) GROUP BY 1, 2, 3),
mm AS (SELECT candidate, z, avg(lm) AS ml, avg(rm) AS mr, count(lm) AS gl, count(rm) AS gr FROM ms GROUP BY 1, 2),
ct AS (SELECT s.entity_id, s.candidate, s.z, coalesce((lm - ml) / gl, 0) - coalesce((rm - mr) / gr, 0) AS delta FROM ms s JOIN mm USING (candidate, z)),
cv AS (SELECT candidate, z, count(*) AS clusters, count(*) / (count(*) - 1.0) * sum(delta * delta) AS variance FROM ct GROUP BY 1, 2),
tot AS (SELECT count(DISTINCT entity_id) AS g FROM panel),
bd AS (SELECT candidate, sqrt(candidate * (29 - candidate) / 29.0) AS nominal, sqrt(candidate * (29 - candidate) / 29.0) * sqrt(
    (2.0 * left_transitions_entities * right_transitions_entities / (left_transitions_entities + right_transitions_entities)) / (SELECT g FROM tot)) AS boundary FROM screened),
pr AS (SELECT m.candidate, m.z, ml - mr AS contrast, clusters, variance, boundary, (ml - mr) / sqrt(variance) AS normalized,
    boundary * (ml - mr) / sqrt(variance) AS joint FROM mm m JOIN cv USING (candidate, z) JOIN bd USING (candidate))"""
_LAY = """max(abs({raw})) FILTER (candidate = 15 AND z = 0) AS "D0", max(abs(normalized)) FILTER (candidate = 15 AND z = 0) AS "D1",
    max(abs(normalized)) FILTER (candidate = 15) AS "D2", max(abs(joint)) FILTER (z = 0) AS "D3", max(abs(joint)) AS "D4\""""


def draws_sql(arm: str, law: str = "gaussian", draws: int = DRAWS) -> str:
    key = f"'{SEED}:' || entity_id || ':' || draw"
    xi = md5_normal(key) if law == "gaussian" else f"(CASE WHEN {md5_uniform(key + ' || ' + repr(':u'))} < 0.5 THEN -1.0 ELSE 1.0 END)"
    if law == "webb":
        xi = f"[-sqrt(1.5), -1.0, -sqrt(0.5), sqrt(0.5), 1.0, sqrt(1.5)][least(floor({md5_uniform(key + ' || ' + repr(':u'))} * 6)::BIGINT, 5) + 1]"
    norm = {"M0": "s1 / sqrt(variance)", "M1": "s1 / sqrt(greatest(clusters / (clusters - 1.0) * (s2 - s1 * s1 / clusters), 1e-15))",
            "M0_scale": "1.5 * s1 / sqrt(variance)"}[arm]
    raw = "1.5 * s1" if arm == "M0_scale" else "s1"
    return f""",
xi AS (SELECT entity_id, draw, {xi} AS xi FROM (SELECT DISTINCT entity_id FROM ct) CROSS JOIN (SELECT unnest(generate_series(0, {draws - 1})) AS draw)),
sm AS (SELECT draw, candidate, z, sum(xi * delta) AS s1, sum(xi * xi * delta * delta) AS s2 FROM xi JOIN ct USING (entity_id) GROUP BY 1, 2, 3),
dr AS (SELECT draw, candidate, z, {raw} AS raw, {norm} AS normalized, boundary * ({norm}) AS joint FROM sm JOIN pr p USING (candidate, z)),
dl AS (SELECT draw, {_LAY.format(raw='raw')} FROM dr GROUP BY 1)"""


VERSIONS = f""",
lo AS (SELECT s.entity_id, s.candidate, s.z, CASE WHEN lm IS NULL THEN ml WHEN gl > 1 THEN (gl * ml - lm) / (gl - 1.0) END - CASE WHEN rm IS NULL THEN mr WHEN gr > 1 THEN (gr * mr - rm) / (gr - 1.0) END AS v
    FROM ms s JOIN mm USING (candidate, z)),
jk AS (SELECT entity_id, candidate, z, v, g, -(g - 1.0) / g * (v - m) AS pseudo FROM (SELECT *, count(v) OVER w AS g, avg(v) OVER w AS m FROM lo WINDOW w AS (PARTITION BY candidate, z))),
vj AS (SELECT candidate, z, any_value(g) / (any_value(g) - 1.0) * sum(pseudo * pseudo) AS vj FROM jk GROUP BY 1, 2),
ht AS (SELECT *, delta * delta / greatest(sum(delta * delta) OVER (PARTITION BY candidate, z), {float(np.finfo(float).tiny)!r}) AS hat FROM ct),
a0 AS (SELECT *, delta / sqrt(greatest(1 - hat, 1e-8)) AS a FROM ht),
ad AS (SELECT *, a - avg(a) OVER (PARTITION BY candidate, z) AS adj FROM a0),
va AS (SELECT candidate, z, count(*) / (count(*) - 1.0) * sum(adj * adj) AS va FROM ad GROUP BY 1, 2)"""
_CAL = """,
ob AS (SELECT """ + _LAY.format(raw="contrast") + """ FROM pr),
lo AS (UNPIVOT dl ON "D0", "D1", "D2", "D3", "D4" INTO NAME layer VALUE t),
oo AS (UNPIVOT ob ON "D0", "D1", "D2", "D3", "D4" INTO NAME layer VALUE observed),
cal AS (SELECT layer, any_value(observed) AS observed, count(t) AS valid_draws, count(*) - count(t) AS failed_draws, quantile_cont(t, 0.95) AS critical_value,
    (1 + count(*) FILTER (t >= observed)) / (count(t) + 1) AS p_value, (1 + count(*) FILTER (t >= observed)) / (count(t) + 1) <= 0.05 AS reject
    FROM lo JOIN oo USING (layer) GROUP BY 1)"""

CLOSED_SQL = SHIFT + """,
sr AS (SELECT entity_id, elapsed_index, action, s0, reward, candidate, (elapsed_index >= candidate)::INT AS sd FROM panel CROSS JOIN (VALUES (6), (9), (12), (15), (18), (21), (24)) c(candidate)),
sn AS (SELECT *, count(*) OVER (PARTITION BY entity_id, candidate, sd) AS n FROM sr),
sg AS (SELECT candidate, sd, count(DISTINCT entity_id) AS g FROM sr GROUP BY 1, 2),
sw AS (SELECT s.*, g, 1.0::DOUBLE / (g * n) AS w FROM sn s JOIN sg USING (candidate, sd)),
ac AS (SELECT candidate, sd, act AS action, coalesce(sum(w) FILTER (action = act), 0) AS m0, coalesce(sum(w * s0) FILTER (action = act), 0) AS m1, coalesce(sum(w * s0 * s0) FILTER (action = act), 0) AS m2,
    coalesce(sum(w * reward) FILTER (action = act), 0) AS r0, coalesce(sum(w * s0 * reward) FILTER (action = act), 0) AS r1 FROM sw CROSS JOIN (VALUES (0), (1)) a(act) GROUP BY 1, 2, 3),
be AS (SELECT *, (m0 + 1) * (m2 + 1) - m1 * m1 AS dt, ((m2 + 1) * r0 - m1 * r1) / ((m0 + 1) * (m2 + 1) - m1 * m1) AS b0, ((m0 + 1) * r1 - m1 * r0) / ((m0 + 1) * (m2 + 1) - m1 * m1) AS b1 FROM ac),
eu AS (SELECT s.entity_id, s.candidate, s.sd, b.action, any_value(n) AS n, any_value(g) AS g, coalesce(sum(reward - b0 - b1 * s0) FILTER (s.action = b.action), 0) / any_value(n) AS u0,
    coalesce(sum((reward - b0 - b1 * s0) * s0) FILTER (s.action = b.action), 0) / any_value(n) AS u1 FROM sw s JOIN be b USING (candidate, sd) GROUP BY 1, 2, 3, 4),
ec AS (SELECT *, u0 - avg(u0) OVER w AS c0, u1 - avg(u1) OVER w AS c1 FROM eu WINDOW w AS (PARTITION BY candidate, sd, action)),
et2 AS (SELECT entity_id, candidate, sd, action, ((m2 + 1) * c0 - m1 * c1) / dt / g AS e0, ((m0 + 1) * c1 - m1 * c0) / dt / g AS e1 FROM ec JOIN be USING (candidate, sd, action)),
zs AS (SELECT * FROM (VALUES (0, 0, 0.5::DOUBLE), (1, 0, 2.0), (2, 1, 0.5), (3, 1, 2.0)) z(z, action, x)),
cd AS (SELECT entity_id, candidate, z, sum(CASE WHEN sd = 0 THEN 1 ELSE -1 END * (e0 + e1 * x)) AS delta FROM et2 JOIN zs USING (action) GROUP BY 1, 2, 3),
cz AS (SELECT candidate, z, sum(CASE WHEN sd = 0 THEN 1 ELSE -1 END * (b0 + b1 * x)) AS contrast FROM be JOIN zs USING (action) GROUP BY 1, 2),
cvz AS (SELECT candidate, z, count(*) / (count(*) - 1.0) * sum(delta * delta) AS variance FROM cd GROUP BY 1, 2)"""
CLOSED_ROWS = """,
bb AS (SELECT candidate, sd, max(b0) FILTER (action = 0) AS b00, max(b1) FILTER (action = 0) AS b01, max(b0) FILTER (action = 1) AS b10, max(b1) FILTER (action = 1) AS b11 FROM be GROUP BY 1, 2),
nx AS (SELECT entity_id, elapsed_index, n0 FROM panel),
rv AS (SELECT candidate, CASE WHEN sd = 0 THEN 'left' ELSE 'right' END AS side, entity_id, elapsed_index, action, reward, b00 + b01 * s0 AS q0, b10 + b11 * s0 AS q1, b00 + b01 * n0 AS next_q0, b10 + b11 * n0 AS next_q1,
    (b10 + b11 * n0 > b00 + b01 * n0)::BIGINT AS greedy, reward - CASE action WHEN 1 THEN b10 + b11 * s0 ELSE b00 + b01 * s0 END AS residual
    FROM sw JOIN bb USING (candidate, sd) JOIN nx USING (entity_id, elapsed_index))"""
_SIDE = "CASE WHEN sd = 0 THEN 'left' ELSE 'right' END AS side"

QUERIES: dict[str, Query] = {
    "closed_fit": query(closed_fit, rounded(with_(CLOSED_SQL, f"""SELECT candidate, {_SIDE}, 'TESTABLE' AS status, true AS converged, 2 * action + k AS coordinate, CASE k WHEN 0 THEN b0 ELSE b1 END AS beta
        FROM be CROSS JOIN (VALUES (0), (1)) v(k)"""), "beta", "candidate coordinate"), "H1 H2 H3 H7 H15 H23"),
    "closed_contributions": query(closed_contributions, rounded(with_(CLOSED_SQL, "SELECT * FROM cd"), "delta", "candidate z", digits=8), "H5 H6 H8", digits=8),
    "closed_process": query(closed_process, rounded(with_(CLOSED_SQL, """SELECT candidate, z, contrast, variance, boundary, contrast / sqrt(variance) AS normalized, boundary * contrast / sqrt(variance) AS joint,
        'TESTABLE' AS status FROM cz JOIN cvz USING (candidate, z) JOIN bd USING (candidate)"""), "contrast variance boundary normalized joint", "candidate z"), "H3 H5 H6 H8 H9 H14"),
    "closed_jacobian": query(closed_jacobian, rounded(with_(CLOSED_SQL, f"""SELECT candidate, {_SIDE}, a, b, CASE WHEN a // 2 <> b // 2 THEN 0.0 WHEN a = b THEN 1.0 + CASE a % 2 WHEN 0 THEN m0 ELSE m2 END ELSE m1 END AS jacobian, jacobian AS influence
        FROM be CROSS JOIN range(4) p(a) CROSS JOIN range(4) q(b) WHERE action = a // 2"""), "jacobian influence", "candidate a b", digits=5), "H5 H17", digits=5),
    "closed_values": query(closed_values, rounded(with_(CLOSED_SQL + CLOSED_ROWS, "SELECT * FROM rv"), "reward q0 q1 next_q0 next_q1 residual", "candidate elapsed_index action greedy"), "H4 H7"),
    "closed_diagnostics": query(
        lambda s, d: H.fit_diagnostics(closed_values(s, d)),
        rounded(with_(CLOSED_SQL + CLOSED_ROWS, """, em AS (SELECT candidate, side, entity_id, min(action) AS lo, max(action) AS hi FROM rv GROUP BY 1, 2, 3),
            e AS (SELECT candidate, side, count(*) AS entities, count(*) FILTER (lo = 1) AS entities_missing_action0, count(*) FILTER (hi = 0) AS entities_missing_action1 FROM em GROUP BY 1, 2)
            SELECT candidate, side, count(*) AS n, any_value(entities) AS entities, sum(action) AS action1, avg(residual) AS residual_mean, stddev_pop(residual) AS residual_sd, sum(greedy) AS greedy1,
                count(*) FILTER (abs(q0) > 1e6 OR abs(q1) > 1e6) AS extreme_q, any_value(entities_missing_action0) AS entities_missing_action0, any_value(entities_missing_action1) AS entities_missing_action1,
                min(q0) AS q0_min, median(q0) AS q0_median, max(q0) AS q0_max, min(q1) AS q1_min, median(q1) AS q1_median, max(q1) AS q1_max, min(q1 - q0) AS gap_min, median(q1 - q0) AS gap_median, max(q1 - q0) AS gap_max
            FROM rv JOIN e USING (candidate, side) GROUP BY 1, 2"""),
            "residual_mean residual_sd q0_min q0_median q0_max q1_min q1_median q1_max gap_min gap_median gap_max", "candidate n entities action1 greedy1 extreme_q entities_missing_action0 entities_missing_action1"), "H7 H23"),
    "fit_table": query(lambda s, d: H.fit_table(s, prepared(s, d).design, RULE, prepared(s, d).models).drop("beta"), None, "H1 H2 H3 H5 H7 H15 H23"),
    "fitted_process": query(observed, None, "H3 H6 H8 H9 H14 H15"),
    "change_scan": query(scan, None, "G9 H3 H12 H13 I2 I13"),
    "fitted_change_point": query(lambda s, d: H.change_point(observed(s, d)), None, "H13"),
    "fitted_row_values": query(_values, None, "H4 H20"),
    "fit_diagnostics": query(lambda s, d: H.fit_diagnostics(_values(s, d)), None, "H7 H23"),
    "entity_weights": query(
        lambda s, d: H.entity_weights(S.entity_sides(PN.support_view(PQ.panel(s, d)), R.CUTS, START, END)),
        rounded(with_(DAILY + screen_sql("panel", PQ.PANEL_RULE, 3), """ SELECT entity_id, candidate,
            CASE WHEN n_left > 0 THEN 1.0 / (n_left * count(*) FILTER (n_left > 0) OVER (PARTITION BY candidate)) END AS w_left,
            CASE WHEN n_right > 0 THEN 1.0 / (n_right * count(*) FILTER (n_right > 0) OVER (PARTITION BY candidate)) END AS w_right FROM sd"""),
            "w_left w_right", "candidate"), "H2"),
    "range_extrapolation": query(
        lambda s, d: H.range_extrapolation(PQ.panel(s, d).select("entity_id", "action", "state"), 3),
        rounded(with_(DAILY, """, lim AS (SELECT 1 - action AS action, min(s0) AS a0, max(s0) AS b0, min(s1) AS a1, max(s1) AS b1, min(s2) AS a2, max(s2) AS b2 FROM panel GROUP BY action)
            SELECT p.action, avg((s0 < a0 OR s0 > b0 OR s1 < a1 OR s1 > b1 OR s2 < a2 OR s2 > b2)::INT) AS outside_fraction, count(*) AS n
            FROM panel p JOIN lim l ON p.action = l.action GROUP BY 1"""), "outside_fraction", "action"), "H7"),
    "boundaries": query(
        shift_bounds, rounded(with_(SHIFT, "SELECT * FROM bd"), "nominal boundary", "candidate"), "H10"),
    "boundaries_both_sides": query(
        lambda s, d: shift_bounds(s, d, "both_sides"),
        rounded(with_(SHIFT, "SELECT candidate, nominal, nominal * sqrt(entities_both / (SELECT g FROM tot)) AS boundary FROM bd JOIN screened USING (candidate)"), "nominal boundary", "candidate"), "H10"),
    "boundaries_ess": query(
        lambda s, d: shift_bounds(s, d, "harmonic_ess"),
        rounded(with_(SHIFT, """SELECT candidate, nominal, nominal * sqrt((2.0 * left_transitions_ess * right_transitions_ess / (left_transitions_ess + right_transitions_ess))
            / (SELECT g FROM tot)) AS boundary FROM bd JOIN screened USING (candidate)"""), "nominal boundary", "candidate"), "H10"),
    "entity_contributions": query(
        shift_contributions, rounded(with_(SHIFT, "SELECT * FROM ct"), "delta", "candidate z", digits=8), "I2", digits=8),
    "shift_process": query(shift_process, rounded(with_(SHIFT, "SELECT * FROM pr"), "contrast variance boundary normalized joint", "candidate z clusters"), "H9 H14"),
    "candidate_maxima": query(
        lambda s, d: H.candidate_maxima(shift_process(s, d)),
        rounded(with_(SHIFT, """SELECT candidate, max(abs(joint)) AS normalized_max, max(boundary * abs(contrast)) AS unnormalized_max, avg(boundary * abs(contrast)) AS l1_mean,
            count(*) FILTER (normalized IS NULL) AS zero_variance_points FROM pr GROUP BY 1"""), "normalized_max unnormalized_max l1_mean", "candidate"), "H11"),
    "overall_maxima": query(
        lambda s, d: H.overall_maxima(H.candidate_maxima(shift_process(s, d))),
        rounded(with_(SHIFT, """, cm AS (SELECT candidate, max(abs(joint)) AS a, max(boundary * abs(contrast)) AS b, avg(boundary * abs(contrast)) AS c FROM pr GROUP BY 1)
            SELECT count(*) AS candidates, max(a) AS normalized_max, max(b) AS unnormalized_max, max(c) AS l1_max, 'STATISTIC_AVAILABLE' AS status FROM cm"""),
            "normalized_max unnormalized_max l1_max"), "H11"),
    "observed_layers": query(
        lambda s, d: H.layers(shift_process(s, d), MID), rounded(with_(SHIFT, f"SELECT {_LAY.format(raw='contrast')} FROM pr"), "D0 D1 D2 D3 D4"), "H12"),
    "change_point": query(
        lambda s, d: H.change_point(shift_process(s, d)),
        rounded(with_(SHIFT, """, cm AS (SELECT candidate, max(abs(joint)) AS m FROM pr GROUP BY 1)
            SELECT candidate AS tau_hat, m AS statistic FROM cm ORDER BY m DESC, candidate LIMIT 1"""), "statistic", "tau_hat"), "H13"),
    "candidate_export": query(
        lambda s, d: H.candidate_export(shift_process(s, d)),
        rounded(with_(SHIFT, """SELECT candidate, z, contrast AS "D0", normalized AS "D1", abs(normalized) AS "D2", max(abs(joint)) FILTER (z = 0) OVER (PARTITION BY candidate) AS "D3",
            joint AS "D4" FROM pr"""), "D0 D1 D2 D3 D4", "candidate z"), "H14"),
    "jackknife": query(jackknife, None, "H16"),
    "jacobian_check": query(jacobian_check, None, "H17 H18"),
    "greedy_diagnostics": query(lambda s, d: H.greedy_diagnostics(prepared(s, d).design, prepared(s, d).models), None, "H19"),
    "entity_centred_reward": query(
        lambda s, d: H.transition_residuals(PQ.panel(s, d).select("entity_id", "elapsed_index", "reward"), "reward"),
        rounded(with_(DAILY, "SELECT entity_id, elapsed_index, reward, reward - avg(reward) OVER (PARTITION BY entity_id) AS centred FROM panel"), "reward centred", "elapsed_index"), "H20"),
    "entity_design": query(
        lambda s, d: H.entity_design(PQ.panel(s, d), R.CUTS, 3),
        rounded(with_(DAILY, """, e AS (SELECT entity_id, count(*) AS transitions, avg(action) AS action_rate, var_samp(s0) + var_samp(s1) + var_samp(s2) AS state_cov_trace,
              sqrt((avg(s0) - (SELECT avg(s0) FROM panel)) ** 2 + (avg(s1) - (SELECT avg(s1) FROM panel)) ** 2 + (avg(s2) - (SELECT avg(s2) FROM panel)) ** 2) AS state_mean_distance,
              (max(s0) - min(s0) + max(s1) - min(s1) + max(s2) - min(s2)) / 3 AS state_range_mean FROM panel GROUP BY 1),
            sides AS (SELECT entity_id, avg(action) FILTER (elapsed_index < c) AS l, avg(action) FILTER (elapsed_index >= c) AS r FROM panel CROSS JOIN (VALUES (6), (9), (12), (15), (18), (21), (24)) v(c) GROUP BY entity_id, c),
            rg AS (SELECT entity_id, greatest(max(l), max(r)) - least(min(l), min(r)) AS action_composition_range FROM sides GROUP BY 1),
            ph AS (SELECT entity_id, action, [1.0::DOUBLE, s0, s1, s2] AS f FROM panel),
            cl AS (SELECT entity_id, action, i, j, f[i] * f[j] AS v FROM ph CROSS JOIN generate_series(1, 4) a(i) CROSS JOIN generate_series(1, 4) b(j)),
            n AS (SELECT entity_id, count(*) AS n FROM panel GROUP BY 1),
            ga AS (SELECT act AS action, i, j, sum(v) FILTER (action = act) / (SELECT count(*) FROM panel) AS g FROM cl CROSS JOIN (VALUES (0), (1)) w(act) GROUP BY 1, 2, 3),
            ge AS (SELECT entity_id, act AS action, i, j, coalesce(sum(v) FILTER (action = act), 0) AS sv FROM cl CROSS JOIN (VALUES (0), (1)) w(act) GROUP BY 1, 2, 3, 4),
            gd AS (SELECT entity_id, sqrt(sum((sv / n - g) ** 2)) AS gram_distance, sum(sv / n) FILTER (i = j) AS gram_trace FROM ge JOIN n USING (entity_id) JOIN ga USING (action, i, j) GROUP BY 1)
            SELECT e.*, action_composition_range, gram_distance, gram_trace FROM e JOIN rg USING (entity_id) JOIN gd USING (entity_id)"""),
            "action_rate state_cov_trace state_mean_distance state_range_mean action_composition_range gram_distance gram_trace", "transitions"), "H21"),
    "sensitivity_sweep": query(sweep, None, "H22"),
    "grid_sweep": query(grid_sweep, None, "H8 H22"),
    "multiplier_draws": query(
        lambda s, d: B.multipliers(PQ.panel(s, d).select("entity_id").distinct(), 50, SEED).select("entity_id", F.posexplode("xi").alias("draw", "xi")),
        rounded(with_(DAILY, f" SELECT entity_id, draw, {md5_normal(repr(str(SEED) + ':') + ' || entity_id || ' + repr(':') + ' || draw')} AS xi FROM (SELECT DISTINCT entity_id FROM panel) CROSS JOIN (SELECT unnest(generate_series(0, 49)) AS draw)"), "xi", "draw"), "I1"),
    "m0_draws": query(lambda s, d: shift_draws(s, d, "M0"), rounded(with_(SHIFT + draws_sql("M0"), "SELECT * FROM dr"), "raw normalized joint", "draw candidate z"), "I2"),
    "m1_draws": query(lambda s, d: shift_draws(s, d, "M1"), rounded(with_(SHIFT + draws_sql("M1"), "SELECT * FROM dr"), "raw normalized joint", "draw candidate z"), "I3"),
    "m0_scaled_draws": query(lambda s, d: shift_draws(s, d, "M0_scale", 1.5), rounded(with_(SHIFT + draws_sql("M0_scale"), "SELECT * FROM dr"), "raw normalized joint", "draw candidate z"), "I4"),
    "m0_layers": query(lambda s, d: B.draw_layers(shift_draws(s, d, "M0"), MID), rounded(with_(SHIFT + draws_sql("M0"), "SELECT * FROM dl"), "D0 D1 D2 D3 D4", "draw"), "I14"),
    "m0_calibration": query(lambda s, d: calibrated(s, d, "M0"), rounded(with_(SHIFT + draws_sql("M0") + _CAL, "SELECT * FROM cal"), "observed critical_value p_value"), "I2 I13"),
    "m1_calibration": query(lambda s, d: calibrated(s, d, "M1"), rounded(with_(SHIFT + draws_sql("M1") + _CAL, "SELECT * FROM cal"), "observed critical_value p_value"), "I3 I13"),
    "m0_rademacher_calibration": query(lambda s, d: calibrated(s, d, "M0", "rademacher"), rounded(with_(SHIFT + draws_sql("M0", "rademacher") + _CAL, "SELECT * FROM cal"), "observed critical_value p_value"), "I1 I2"),
    "m0_webb_calibration": query(lambda s, d: calibrated(s, d, "M0", "webb"), rounded(with_(SHIFT + draws_sql("M0", "webb") + _CAL, "SELECT * FROM cal"), "observed critical_value p_value"), "I1 I2"),
    "hat_values": query(
        lambda s, d: B.adjusted_contributions(shift_contributions(s, d)),
        rounded(with_(SHIFT + VERSIONS, "SELECT entity_id, candidate, z, delta, hat, adj AS adjusted FROM ad"), "delta hat adjusted", "candidate z", digits=8), "I15", digits=8),
    "shift_jackknife": query(
        lambda s, d: H.jackknife(shift_left_out(s, d), ("candidate", "z")),
        rounded(with_(SHIFT + VERSIONS, "SELECT entity_id, candidate, z, v AS leave_one_out, pseudo, vj AS variance FROM jk JOIN vj USING (candidate, z)"),
                "leave_one_out pseudo variance", "candidate z", digits=8), "H16 I15", digits=8),
    "variance_versions": query(
        lambda s, d: B.variance_versions(shift_contributions(s, d), shift_left_out(s, d), shift_contrast(s, d), DRAWS, SEED),
        rounded(with_(SHIFT + draws_sql("M0") + VERSIONS, """, s3 AS (SELECT draw, candidate, z, count(*) AS g, sum(xi * delta) AS s1, sum(xi * xi * delta * delta) AS s2, sum(xi * coalesce(pseudo, 0)) AS sj, sum(xi * adj) AS sa
                FROM xi JOIN ad USING (entity_id) JOIN jk USING (entity_id, candidate, z) GROUP BY 1, 2, 3),
            vd AS (SELECT candidate, z, abs(s1) AS raw, abs(s1) / sqrt(variance) AS fixed, abs(s1) / sqrt(greatest(s3.g / (s3.g - 1.0) * (s2 - s1 * s1 / s3.g), 1e-15)) AS draw_specific,
                abs(sj) / sqrt(vj) AS jackknife, abs(sa) / sqrt(va) AS cr2 FROM s3 JOIN cv USING (candidate, z) JOIN vj USING (candidate, z) JOIN va USING (candidate, z)),
            un AS (UNPIVOT vd ON raw, fixed, draw_specific, jackknife, cr2 INTO NAME version VALUE value),
            od AS (SELECT candidate, z, abs(ml - mr) AS raw, abs(ml - mr) / sqrt(variance) AS fixed, abs(ml - mr) / sqrt(variance) AS draw_specific, abs(ml - mr) / sqrt(vj) AS jackknife, abs(ml - mr) / sqrt(va) AS cr2
                FROM mm JOIN cv USING (candidate, z) JOIN vj USING (candidate, z) JOIN va USING (candidate, z)),
            uo AS (UNPIVOT od ON raw, fixed, draw_specific, jackknife, cr2 INTO NAME version VALUE observed)
            SELECT candidate, z, version, any_value(observed) AS observed, (1 + count(*) FILTER (value >= observed)) / (count(*) + 1) AS p_value, avg(value) AS mean, stddev_samp(value) AS sd,
                quantile_cont(value, 0.025) AS q025, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.975) AS q975
            FROM un JOIN uo USING (candidate, z, version) GROUP BY 1, 2, 3"""), "observed p_value mean sd q025 q05 q95 q975", "candidate z"), "I15"),
    "fitted_variance_versions": query(fitted_versions, None, "I15 H16"),
    "m0_moments": query(
        lambda s, d: B.process_moments(shift_draws(s, d, "M0")),
        rounded(with_(SHIFT + draws_sql("M0"), """, c AS (SELECT *, joint - avg(joint) OVER (PARTITION BY candidate, z) AS e FROM dr)
            SELECT candidate, z, avg(joint) AS mean, var_samp(joint) AS variance, avg(e ** 3) / avg(e ** 2) ** 1.5 AS skewness, avg(e ** 4) / avg(e ** 2) ** 2 - 3 AS excess_kurtosis,
            quantile_cont(abs(joint), 0.9) AS abs_q90, quantile_cont(abs(joint), 0.95) AS abs_q95, quantile_cont(abs(joint), 0.99) AS abs_q99 FROM c GROUP BY 1, 2"""),
            "mean variance skewness excess_kurtosis abs_q90 abs_q95 abs_q99", "candidate z"), "I16"),
    "m0_centred_calibration": query(
        lambda s, d: B.calibrate(B.draw_layers(B.centred_draws(shift_draws(s, d, "M0")), MID), H.layers(shift_process(s, d), MID)),
        rounded(with_(SHIFT + draws_sql("M0").replace("dl AS (", "dc AS (SELECT draw, candidate, z, raw - avg(raw) OVER w AS raw, normalized - avg(normalized) OVER w AS normalized, "
                "joint - avg(joint) OVER w AS joint FROM dr WINDOW w AS (PARTITION BY candidate, z)),\ndl AS (").replace("FROM dr GROUP BY 1)", "FROM dc GROUP BY 1)") + _CAL, "SELECT * FROM cal"),
                "observed critical_value p_value"), "I17"),
    "m2_draws": query(m2, None, "I5 I6"),
    "m2_calibration": query(lambda s, d: refit_calibration(s, d, m2(s, d)), None, "I5 I13"),
    "m2_projection": query(lambda s, d: B.project_on_multipliers(m2(s, d), PQ.panel(s, d).select("entity_id").distinct(), SEED).select(
        "entity_id", "norm"), None, "I7"),
    "m2_zero_draw": query(lambda s, d: B.zero_draw(prepared(s, d), *null_design(s, d)), None, "I7"),
    "m3_draws": query(m3, None, "I8"),
    "m3_calibration": query(lambda s, d: refit_calibration(s, d, m3(s, d)), None, "I8 I13"),
    "multinomial_totals": query(
        lambda s, d: count_weights(s, d).select(F.posexplode("w").alias("draw", "w")).groupBy("draw").agg(
            F.count(F.lit(1)).alias("entities"), F.sum("w").cast("long").alias("total"), F.count_if((F.col("w") < 0) | (F.col("w") != F.floor("w"))).alias("odd")),
        with_(DAILY, f" SELECT draw::BIGINT AS draw, count(*)::BIGINT AS entities, count(*)::BIGINT AS total, 0::BIGINT AS odd FROM (SELECT DISTINCT entity_id FROM panel) CROSS JOIN (SELECT unnest(generate_series(0, {DRAWS - 1})) AS draw) GROUP BY 1"), "I8"),
    "m3_multinomial_draws": query(m3_counts, None, "I8"),
    "m3_multinomial_calibration": query(lambda s, d: refit_calibration(s, d, m3_counts(s, d)), None, "I8 I13"),
    "parametric_null": query(parametric_null, None, "I9"),
    "bridge_null": query(bridge_null, None, "I11"),
    "refit_accounting": query(refit_accounting, None, "I12"),
}


def forget() -> None:
    """Drop the fitted objects of this process (they are rebuilt on next use)."""
    _CACHE.clear()
