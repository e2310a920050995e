"""Observed change-point process: boundaries, variances, studentised values, layers, change point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..session import materialise
from .fqi import Design, FitRule, Models, contributions, fit, partitions, process_table

# Layer names.
LAYERS = ("D0", "D1", "D2", "D3", "D4")
EPS = 2.220446049250313e-16


def harmonic(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 2.0 * a * b / (a + b)).otherwise(0.0)


def boundaries(screened: DataFrame, start: int, end: int, total_entities: int, scaling: str = "harmonic_active") -> DataFrame:
    """Nominal factor sqrt(lr/(l+r)) and its support-scaled version per candidate."""
    left, right = F.col("candidate") - start, F.lit(end) - F.col("candidate")
    nominal = F.sqrt(left * right / (left + right))
    effective = {
        "both_sides": F.col("entities_both").cast("double"),
        "harmonic_active": harmonic(F.col("left_transitions_entities"), F.col("right_transitions_entities")),
        "harmonic_ess": harmonic(F.col("left_transitions_ess"), F.col("right_transitions_ess")),
    }[scaling]
    return screened.select("candidate", nominal.alias("nominal"),
                           (nominal * F.sqrt(effective / F.lit(float(total_entities)))).alias("boundary"))


def entity_weights(sides: DataFrame) -> DataFrame:
    """Entity-balanced transition weights 1 / (G n_i) on each side of every cut."""
    g = sides.groupBy("candidate").agg(F.count_if(F.col("n_left") > 0).alias("_gl"), F.count_if(F.col("n_right") > 0).alias("_gr"))
    return sides.join(F.broadcast(g), "candidate").select(
        "entity_id", "candidate", F.when(F.col("n_left") > 0, 1.0 / (F.col("n_left") * F.col("_gl"))).alias("w_left"),
        F.when(F.col("n_right") > 0, 1.0 / (F.col("n_right") * F.col("_gr"))).alias("w_right"))


def long_contributions(wide: DataFrame, cuts, n_z: int) -> DataFrame:
    """(entity, candidate, z, delta) rows from per-entity vectors; inactive cuts are left out."""
    cut = F.element_at(F.array(*[F.lit(int(c)) for c in cuts]), (F.floor(F.col("p") / n_z) + 1).cast("int"))
    return wide.select("entity_id", "active", F.posexplode("delta").alias("p", "delta")).where(
        F.element_at("active", (F.floor(F.col("p") / n_z) + 1).cast("int"))).select(
        "entity_id", cut.alias("candidate"), F.pmod("p", F.lit(n_z)).alias("z"), "delta")


def contribution_vectors(wide: DataFrame, n_z: int) -> DataFrame:
    """(entity_id, value): per-entity vectors over cuts x points, with NULL elements at inactive cuts."""
    def task(batches):
        for pdf in batches:
            yield pd.DataFrame({"entity_id": pdf["entity_id"], "value": [
                np.where(np.repeat(np.asarray(a, bool), n_z), d, np.nan) for a, d in zip(pdf["active"], pdf["delta"])]})

    kind = wide.schema["entity_id"].dataType.simpleString()
    return wide.select("entity_id", "active", "delta").mapInPandas(task, f"entity_id {kind}, value array<double>")


def cluster_variance(contrib: DataFrame) -> DataFrame:
    """G/(G-1) sum of squares per (candidate, z); values at roundoff scale become exactly zero."""
    base = contrib.groupBy("candidate", "z").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum(F.col("delta") * F.col("delta")).alias("ss"), F.max(F.abs("delta")).alias("top"))
    peak = base.groupBy("candidate").agg(F.max("top").alias("peak"))
    g = F.col("clusters").cast("double")
    raw = F.when(g > 1, g / (g - 1.0) * F.col("ss"))
    floor = F.lit(EPS) * F.greatest(F.lit(1.0), F.col("peak") * F.col("peak"))
    return base.join(F.broadcast(peak), "candidate").select(
        "candidate", "z", "clusters", F.when(raw <= floor, F.lit(0.0)).otherwise(raw).alias("variance"))


def process(contrast: DataFrame, variance: DataFrame, bounds: DataFrame) -> DataFrame:
    """Contrast, variance, normalised and boundary-scaled value at every (candidate, z)."""
    sd = F.sqrt("variance")
    ok = F.col("variance") > 0
    return contrast.join(variance, ["candidate", "z"]).join(bounds, "candidate").select(
        "candidate", "z", "contrast", "clusters", "variance", "boundary", F.when(ok, F.col("contrast") / sd).alias("normalized"),
        F.when(ok, F.col("boundary") * F.col("contrast") / sd).alias("joint"))


def candidate_maxima(proc: DataFrame) -> DataFrame:
    """Normalised maximum, unnormalised maximum and mean absolute statistic per candidate."""
    return proc.groupBy("candidate").agg(
        F.max(F.abs("joint")).alias("normalized_max"), F.max(F.col("boundary") * F.abs("contrast")).alias("unnormalized_max"),
        F.avg(F.col("boundary") * F.abs("contrast")).alias("l1_mean"),
        F.count_if(F.col("normalized").isNull()).alias("zero_variance_points"))


def overall_maxima(maxima: DataFrame) -> DataFrame:
    return maxima.agg(F.count(F.lit(1)).alias("candidates"), F.max("normalized_max").alias("normalized_max"),
                      F.max("unnormalized_max").alias("unnormalized_max"), F.max("l1_mean").alias("l1_max")).withColumn(
        "status", F.when(F.col("candidates") > 0, "STATISTIC_AVAILABLE").otherwise("NOT_TESTABLE_SUPPORT"))


def layer_columns(midpoint: int, raw: str = "contrast") -> list[Column]:
    """D0 mid cut, one point, raw; D1 studentised; D2 mid cut over z; D3 all cuts one point; D4 everything."""
    mid, one = F.col("candidate") == midpoint, F.col("z") == 0
    return [
        F.max(F.when(mid & one, F.abs(raw))).alias("D0"), F.max(F.when(mid & one, F.abs("normalized"))).alias("D1"),
        F.max(F.when(mid, F.abs("normalized"))).alias("D2"), F.max(F.when(one, F.abs("joint"))).alias("D3"),
        F.max(F.abs("joint")).alias("D4")]


def layers(proc: DataFrame, midpoint: int) -> DataFrame:
    return proc.agg(*layer_columns(midpoint))


def unpivot_layers(wide: DataFrame, keys=(), value: str = "value") -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias(value)) for n in LAYERS]))
    return wide.select(*keys, pairs.alias("p")).select(*keys, "p.layer", f"p.{value}")


def change_point(proc: DataFrame) -> DataFrame:
    """The cut with the largest boundary-scaled maximum; the smallest cut on ties."""
    m = candidate_maxima(proc)
    return m.agg(F.min_by("candidate", F.struct(-F.col("normalized_max"), F.col("candidate"))).alias("tau_hat"),
                 F.max("normalized_max").alias("statistic"))


def candidate_export(proc: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    first = F.max(F.when(F.col("z") == 0, F.abs("joint"))).over(Window.partitionBy("candidate"))
    return proc.select("candidate", "z", F.col("contrast").alias("D0"), F.col("normalized").alias("D1"),
                       F.abs("normalized").alias("D2"), first.alias("D3"), F.col("joint").alias("D4"))


def transition_residuals(rows: DataFrame, residual: str = "residual") -> DataFrame:
    """Residuals centred within the entity."""
    means = rows.groupBy("entity_id").agg(F.avg(residual).alias("_m"))
    return rows.join(means, "entity_id").withColumn("centred", F.col(residual) - F.col("_m")).drop("_m")


# --------------------------------------------------------------- fitted-model process
class Prepared:
    """Observed fit of one panel: design, models and the small per-cut arrays every arm needs.

    Contributions and their variance are made when they are first asked for; a query that only reads coefficients does without them.
    """

    def __init__(self, design: Design, rule: FitRule, models: Models, z_design: np.ndarray, bound: dict[int, float],
                 midpoint: int, variance: np.ndarray | None = None, contrib: DataFrame | None = None) -> None:
        self.design, self.rule, self.models, self.z_design = design, rule, models, z_design
        self.bound = np.asarray([bound[c] for c in design.cuts])
        self.midpoint, self._variance, self._contrib = midpoint, variance, contrib

    @property
    def contrib(self) -> DataFrame:
        if self._contrib is None:
            self._contrib = materialise(contributions(self.design, self.rule, self.models, self.z_design), "contributions")
        return self._contrib

    @property
    def variance(self) -> np.ndarray:
        if self._variance is None:
            self._variance = process_table(self.design, self.models, self.contrib, self.z_design)
        return self._variance

    @property
    def contrast(self) -> np.ndarray:
        return (self.models.beta[0, :, 0] - self.models.beta[0, :, 1]) @ self.z_design.T

    def table(self, spark: SparkSession) -> DataFrame:
        rows = []
        with np.errstate(divide="ignore", invalid="ignore"):
            norm = self.contrast / np.sqrt(self.variance[0])
        for j, c in enumerate(self.design.cuts):
            status = "TESTABLE" if self.models.converged[0, j].all() else "NUMERICAL_FAILURE"
            for z in range(len(self.z_design)):
                v = float(self.variance[0, j, z])
                n = float(norm[j, z]) if v > 0 else None
                rows.append((int(c), z, float(self.contrast[j, z]), v, float(self.bound[j]), n,
                             None if n is None else n * float(self.bound[j]), status))
        return spark.createDataFrame(rows, "candidate long, z long, contrast double, variance double, boundary double, "
                                           "normalized double, joint double, status string")


def prepare_process(design: Design, rule: FitRule, z_design: np.ndarray, bound: dict[int, float], midpoint: int) -> Prepared:
    return Prepared(design, rule, fit(design, rule), z_design, bound, midpoint)


def jackknife(left_out: DataFrame, by=("candidate",)) -> DataFrame:
    """Pseudo-contributions of (entity_id, ``by``, leave_one_out) and their variance per candidate or point.

    An entity without which a side is empty has no value; it counts neither as an entity nor in the mean.
    """
    v, g = F.col("leave_one_out"), F.col("_g").cast("double")
    point = list(by)
    mean = left_out.groupBy(*point).agg(F.avg("leave_one_out").alias("_mean"), F.count("leave_one_out").alias("_g"))
    pseudo = left_out.join(F.broadcast(mean), point).withColumn("pseudo", -(g - 1.0) / g * (v - F.col("_mean")))
    var = pseudo.groupBy(*point).agg((F.first("_g") / (F.first("_g") - 1.0) * F.sum(F.col("pseudo") ** 2)).alias("variance"))
    return pseudo.join(F.broadcast(var), point).select("entity_id", *point, "leave_one_out", "pseudo", "variance")


def fit_table(spark: SparkSession, design: Design, rule: FitRule, models: Models) -> DataFrame:
    """One row per (draw, cut, side): status, convergence, conditions and coefficients."""
    rows = []
    gram = models.extra["gram"]
    for b, draw in enumerate(models.extra["ids"]):
        for j, c in enumerate(design.cuts):
            for s, side in enumerate(("left", "right")):
                ok = bool(models.converged[b, j, s])
                rows.append((int(draw), int(c), side, "TESTABLE" if ok else "NUMERICAL_FAILURE", ok, int(models.iterations[b, j, s]),
                             float(models.delta[b, j, s]), int(np.linalg.matrix_rank(gram[b, j, s])),
                             float(np.linalg.cond(models.H[b, j, s])), float(np.linalg.cond(models.W[b, j, s])),
                             [float(x) for x in models.beta[b, j, s]]))
    return spark.createDataFrame(rows, "draw long, candidate long, side string, status string, converged boolean, iterations long, "
                                       "coefficient_delta double, gram_rank long, ridge_condition double, w_condition double, beta array<double>")


def row_values(design: Design, rule: FitRule, models: Models) -> DataFrame:
    """Q-values, greedy action, residual and Q-gap of every row under the model of its side, for every cut; one scan of rows dealt evenly."""
    q, gamma = design.q, rule.gamma
    coef = [(int(c), side, [float(x) for x in models.beta[0, j, s]]) for j, c in enumerate(design.cuts) for s, side in enumerate(("left", "right"))]
    table = design.rows.sparkSession.createDataFrame(coef, "candidate long, side string, beta array<double>")
    cut = F.explode(F.arrays_zip(F.array(*[F.lit(int(c)).cast("long") for c in design.cuts]).alias("candidate"), F.col("inv_n").alias("inv_n")))

    def dot(vec: str, first: int) -> Column:
        total = F.get("beta", F.lit(first))
        for i in range(1, q):
            total = total + F.get("beta", F.lit(first + i)) * F.element_at(vec, i)
        return total

    rows = design.rows.repartition(partitions(design)).select("entity_id", F.col("idx").alias("elapsed_index"), "action", "reward", "state", "next_state", cut.alias("c")).select("*", "c.candidate", "c.inv_n").drop("c")
    rows = rows.withColumn("side", F.when(F.col("elapsed_index") < F.col("candidate"), "left").otherwise("right")).join(F.broadcast(table), ["candidate", "side"])
    out = rows.select("candidate", "side", "entity_id", "elapsed_index", "action", "reward", "inv_n", dot("state", 0).alias("q0"), dot("state", q).alias("q1"),
                      dot("next_state", 0).alias("next_q0"), dot("next_state", q).alias("next_q1"))
    fitted = F.when(F.col("action") == 1, F.col("q1")).otherwise(F.col("q0"))
    return out.withColumn("greedy", (F.col("next_q1") > F.col("next_q0")).cast("int")).withColumn(
        "residual", F.col("reward") + gamma * F.greatest("next_q0", "next_q1") - fitted)


def fit_diagnostics(values: DataFrame, keys=("candidate", "side")) -> DataFrame:
    """Per model: Q summaries, residual moments, greedy counts and entities missing an action."""
    from .quantiles import exact_quantile_table

    by = list(keys)
    base = values.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("action").alias("action1"), F.avg("residual").alias("residual_mean"), F.stddev_pop("residual").alias("residual_sd"),
        F.sum("greedy").alias("greedy1"), F.count_if((F.abs("q0") > 1e6) | (F.abs("q1") > 1e6)).alias("extreme_q"))
    missing = values.groupBy(*by, "entity_id").agg(F.min("action").alias("lo"), F.max("action").alias("hi")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("entities"), F.count_if(F.col("lo") == 1).alias("entities_missing_action0"), F.count_if(F.col("hi") == 0).alias("entities_missing_action1"))
    q = exact_quantile_table(values, by, {"q0": F.col("q0"), "q1": F.col("q1"), "gap": F.col("q1") - F.col("q0")}, {"min": 0.0, "median": 0.5, "max": 1.0})
    return base.join(missing, by).join(q, by)


def range_extrapolation(rows: DataFrame, dim: int) -> DataFrame:
    """Share of each action's states outside the other action's coordinate ranges."""
    lim = rows.groupBy("action").agg(*[f(F.element_at("state", i + 1)).alias(f"{n}{i}") for i in range(dim)
                                       for n, f in (("lo", F.min), ("hi", F.max))]).withColumn("action", 1 - F.col("action"))
    outside = F.lit(False)
    for i in range(dim):
        x = F.element_at("state", i + 1)
        outside = outside | (x < F.col(f"lo{i}")) | (x > F.col(f"hi{i}"))
    return rows.join(F.broadcast(lim), "action").groupBy("action").agg(
        F.avg(outside.cast("double")).alias("outside_fraction"), F.count(F.lit(1)).alias("n"))


def entity_design(panel: DataFrame, cuts, dim: int) -> DataFrame:
    """Action rate, covariance trace, distance of means, ranges, Gram distance and action range over cut sides."""
    s = [F.element_at("state", i + 1) for i in range(dim)]
    a = F.col("action").cast("double")
    phi = [F.lit(1.0), *s]
    cells = [(i, j, act) for act in (0, 1) for i in range(dim + 1) for j in range(i, dim + 1)]

    def gram(i: int, j: int, act: int) -> Column:
        return F.avg(F.when(F.col("action") == act, phi[i] * phi[j]).otherwise(0.0)).alias(f"g{act}_{i}_{j}")

    whole = panel.agg(*[F.avg(s[i]).alias(f"gm{i}") for i in range(dim)], *[gram(*c).alias(f"all{c[2]}_{c[0]}_{c[1]}") for c in cells])
    sides = [F.avg(F.when(F.col("elapsed_index") < c, a)) for c in cuts] + [F.avg(F.when(F.col("elapsed_index") >= c, a)) for c in cuts]
    per = panel.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("transitions"), F.avg(a).alias("action_rate"), *[F.var_samp(s[i]).alias(f"v{i}") for i in range(dim)],
        *[F.avg(s[i]).alias(f"m{i}") for i in range(dim)], *[(F.max(s[i]) - F.min(s[i])).alias(f"r{i}") for i in range(dim)],
        *[gram(*c) for c in cells], F.array_compact(F.array(*sides)).alias("_sides"))
    x = per.join(F.broadcast(whole))
    total = sum((F.col(f"v{i}") for i in range(dim)), F.lit(0.0))
    dist = F.sqrt(sum(((F.col(f"m{i}") - F.col(f"gm{i}")) ** 2 for i in range(dim)), F.lit(0.0)))
    gap = F.sqrt(sum(((2.0 if i != j else 1.0) * (F.col(f"g{act}_{i}_{j}") - F.col(f"all{act}_{i}_{j}")) ** 2 for i, j, act in cells), F.lit(0.0)))
    trace = sum((F.col(f"g{act}_{i}_{i}") for i in range(dim + 1) for act in (0, 1)), F.lit(0.0))
    return x.select("entity_id", "transitions", "action_rate", total.alias("state_cov_trace"), dist.alias("state_mean_distance"),
                    (sum((F.col(f"r{i}") for i in range(dim)), F.lit(0.0)) / dim).alias("state_range_mean"),
                    (F.array_max("_sides") - F.array_min("_sides")).alias("action_composition_range"),
                    gap.alias("gram_distance"), trace.alias("gram_trace"))


def estimating_equations(design: Design, rule: FitRule, betas: np.ndarray) -> np.ndarray:
    """Weighted score minus the ridge term for many coefficients (k x cuts x 2 x 2q) in one scan of the rows."""
    from .fqi import _arrays, sum_arrays

    q, gamma, cuts = design.q, rule.gamma, design.cuts
    k, g = len(betas), np.maximum(design.entities, 1)

    def task(batches):
        import pandas as pd

        acc = np.zeros(betas.shape)
        for pdf in batches:
            if not len(pdf):
                continue
            x = _arrays(pdf)
            full = action_rows(x["phi"][:, 1:], x["a"])
            for j, cut in enumerate(cuts):
                for s in (0, 1):
                    at = (x["idx"] < cut) == (s == 0)
                    b = betas[:, j, s]
                    best = np.maximum(b[:, :q] @ x["phin"][at].T, b[:, q:] @ x["phin"][at].T)
                    w = x["inv"][at, j] / g[j, s]
                    acc[:, j, s] += (w[None, :] * (x["r"][at][None, :] + gamma * best - b @ full[at].T)) @ full[at]
        yield pd.DataFrame({"i": np.arange(k), "v": list(acc.reshape(k, -1))})

    out = np.zeros(betas.shape)
    for r in sum_arrays(design.rows.mapInPandas(task, "i long, v array<double>"), ["i"], "v").collect():
        out[r["i"]] = np.asarray(r["v"]).reshape(betas.shape[1:])
    return out - rule.alpha * betas


def action_rows(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    from .fqi import action_design

    return action_design(s, a)


def numerical_jacobian(design: Design, rule: FitRule, beta: np.ndarray, step: float = 1e-6) -> np.ndarray:
    """Negative Jacobian (cuts x 2 x 2q x 2q) of the estimating equations at beta (cuts x 2 x 2q) by central differences, all in one scan."""
    dim = beta.shape[-1]
    shift = step * np.eye(dim)[:, None, None, :]
    psi = estimating_equations(design, rule, np.concatenate([beta[None] + shift, beta[None] - shift]))
    return -np.moveaxis((psi[:dim] - psi[dim:]) / (2.0 * step), 0, -1)


def linearised_error(design: Design, rule: FitRule, beta0: np.ndarray) -> np.ndarray:
    """First-order distance of the fit from reference coefficients (cuts x 2 x 2q): Jacobian there, solved for the equation's value there."""
    return np.linalg.solve(numerical_jacobian(design, rule, beta0), estimating_equations(design, rule, beta0[None])[0][..., None])[..., 0]


def greedy_diagnostics(design: Design, models: Models, epsilons=(1e-4, 1e-3, 1e-2), gaps=(1e-4, 1e-3, 1e-2), directions: int = 8, seed: int = 7) -> DataFrame:
    """Per cut and side: share of small next-state Q-gaps, and how often small coefficient moves switch the greedy action; one scan."""
    from .fqi import _arrays, keyed_draws, sum_arrays

    q, cuts, beta = design.q, design.cuts, models.beta[0]
    d = keyed_draws("gaussian", seed, np.arange(directions), np.arange(2 * q))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    moves = np.concatenate([e * np.concatenate([d, -d]) for e in epsilons])  # (levels x directions x signs) x 2q
    gap_moves = moves[:, q:] - moves[:, :q]

    def task(batches):
        import pandas as pd

        acc = np.zeros((len(cuts), 2, 1 + len(gaps) + len(moves)))
        for pdf in batches:
            if not len(pdf):
                continue
            x = _arrays(pdf)
            for j, cut in enumerate(cuts):
                for s in (0, 1):
                    rows = x["phin"][(x["idx"] < cut) == (s == 0)]
                    base = rows @ (beta[j, s, q:] - beta[j, s, :q])
                    acc[j, s, 0] += len(rows)
                    acc[j, s, 1:1 + len(gaps)] += [(np.abs(base) <= g).sum() for g in gaps]
                    acc[j, s, 1 + len(gaps):] += ((base[None, :] + gap_moves @ rows.T > 0) != (base > 0)[None, :]).sum(axis=1)
        yield pd.DataFrame({"k": [0], "v": [acc.ravel()]})

    got = sum_arrays(design.rows.mapInPandas(task, "k int, v array<double>"), ["k"], "v").collect()[0]["v"]
    acc = np.asarray(got).reshape(len(cuts), 2, -1)
    rows = []
    for j, c in enumerate(cuts):
        for s, side in enumerate(("left", "right")):
            share = acc[j, s, 1:] / max(acc[j, s, 0], 1.0)
            rows += [(int(c), side, "gap", float(g), float(v), float(v)) for g, v in zip(gaps, share)]
            switch = share[len(gaps):].reshape(len(epsilons), -1)
            rows += [(int(c), side, "switch", float(e), float(v.mean()), float(v.max())) for e, v in zip(epsilons, switch)]
    return design.rows.sparkSession.createDataFrame(rows, "candidate long, side string, kind string, level double, mean double, max double")


def transition_cluster_variance(design: Design, rule: FitRule, models: Models, z_design: np.ndarray) -> np.ndarray:
    """Variance per (cut, z) when every transition is its own cluster (benchmark unit)."""
    from .fqi import _arrays, sum_arrays

    cuts, q, beta, gamma = design.cuts, design.q, models.beta[0], rule.gamma
    maps = z_design @ np.linalg.inv(models.W[0])
    n, g = design.transitions, design.entities
    pooled = rule.estimator == "pooled"
    mean = rule.alpha * beta / n[..., None]

    def task(batches):
        import pandas as pd

        acc = np.zeros((len(cuts), len(z_design)))
        for pdf in batches:
            if not len(pdf):
                continue
            x = _arrays(pdf)
            full = action_rows(x["phi"][:, 1:], x["a"])
            for j, cut in enumerate(cuts):
                for s in (0, 1):
                    sel = (x["idx"] < cut) == (s == 0)
                    if not sel.any():
                        continue
                    b = beta[j, s]
                    best = np.maximum(x["phin"][sel] @ b[:q], x["phin"][sel] @ b[q:])
                    w = (np.ones(sel.sum()) / n[j, s]) if pooled else x["inv"][sel, j] / g[j, s]
                    raw = full[sel] * (w * (x["r"][sel] + gamma * best - full[sel] @ b))[:, None]
                    acc[j] += (((raw - mean[j, s]) @ maps[j, s].T) ** 2).sum(axis=0)
        yield pd.DataFrame({"k": [0], "v": [acc.ravel()]})

    got = sum_arrays(design.rows.mapInPandas(task, "k int, v array<double>"), ["k"], "v").collect()
    total = n.sum(axis=1)[:, None]
    return total / (total - 1.0) * np.asarray(got[0]["v"]).reshape(len(cuts), len(z_design))
