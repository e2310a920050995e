"""Generative null models, fitted to the panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

MINIMUM_SD = 1e-6


def least_squares(rows: DataFrame, x: Sequence[str], y: Sequence[str], ridge: float = 0.0, minimum: float = MINIMUM_SD,
                  centred: bool = False) -> dict[str, tuple[np.ndarray, float]]:
    """Coefficients (intercept first) and residual sd for several responses from one moment pass.

    Plain fits divide by n - rank.  ``centred`` leaves the intercept unpenalised and uses n - 1,
    which is the ridge convention.
    """
    names = [*x, *y]
    n_names = len(names)
    cells = [(i, j) for i in range(n_names) for j in range(i, n_names)]
    v = [F.col(c).cast("double") for c in names]
    got = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(v)]).collect()[0]
    n, mean = got["n"], np.asarray([got[f"m{i}"] for i in range(n_names)])
    second = rows.agg(*[F.sum((v[i] - float(mean[i])) * (v[j] - float(mean[j]))).alias(f"c{i}_{j}") for i, j in cells]).collect()[0]
    cov = np.zeros((n_names, n_names))
    for i, j in cells:
        cov[i, j] = cov[j, i] = second[f"c{i}_{j}"]
    k = len(x)
    sxx, out = cov[:k, :k] + ridge * np.eye(k), {}
    for p, name in enumerate(y):
        sxy = cov[:k, k + p]
        slope = np.linalg.lstsq(sxx, sxy, rcond=None)[0] if k else np.zeros(0)
        rss = max(cov[k + p, k + p] - 2 * slope @ sxy + slope @ cov[:k, :k] @ slope, 0.0)
        dof = n - 1 if centred else max(1, n - 1 - np.linalg.matrix_rank(cov[:k, :k]))
        sd = max(float(np.sqrt(rss / dof)), minimum)
        beta = np.concatenate([[mean[k + p] - slope @ mean[:k]], slope])
        if not np.all(np.isfinite(beta)):
            raise FloatingPointError("non-finite generative null model")
        out[name] = (beta, sd)
    return out


def penalised_logistic(rows: DataFrame, x: Sequence[str], y: str, penalty: float, max_steps: int = 40, tol: float = 1e-8):
    """Logistic fit with penalised entity intercepts by Newton steps on the arrow-shaped system.

    Every step is one aggregation by entity; only the common coefficients reach the driver, the
    entity effects stay a table.  Returns coefficients, effect table and the moment-corrected sd.
    """
    k = len(x) + 1
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    base = rows.select("entity_id", *[c.alias(f"x{i}") for i, c in enumerate(cols)], F.col(y).cast("double").alias("y"))
    rate = float(np.clip(base.agg(F.avg("y")).collect()[0][0], 1e-6, 1 - 1e-6))
    beta = np.zeros(k)
    beta[0] = np.log(rate / (1 - rate))
    effects = materialise(base.select("entity_id").distinct().withColumn("u", F.lit(0.0)), "effects")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    for _ in range(max_steps):
        eta = F.col("u")
        for i in range(k):
            eta = eta + F.lit(float(beta[i])) * F.col(f"x{i}")
        p = 1.0 / (1.0 + F.exp(-F.least(F.greatest(eta, F.lit(-35.0)), F.lit(35.0))))
        scored = base.join(effects, "entity_id").withColumn("_p", p).withColumn("_w", p * (1.0 - p))
        per = materialise(scored.groupBy("entity_id").agg(
            F.first("u").alias("u"), F.sum(F.col("_p") - F.col("y")).alias("g"), F.sum("_w").alias("h"),
            *[F.sum(F.col("_w") * F.col(f"x{i}")).alias(f"b{i}") for i in range(k)],
            *[F.sum((F.col("_p") - F.col("y")) * F.col(f"x{i}")).alias(f"s{i}") for i in range(k)],
            *[F.sum(F.col("_w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in pairs]), "newton")
        gu, hu = F.col("g") + penalty * F.col("u"), F.col("h") + penalty
        t = per.agg(
            *[F.sum(F.col(f"s{i}")).alias(f"s{i}") for i in range(k)], *[F.sum(F.col(f"b{i}") * gu / hu).alias(f"r{i}") for i in range(k)],
            *[F.sum(F.col(f"q{i}_{j}")).alias(f"q{i}_{j}") for i, j in pairs],
            *[F.sum(F.col(f"b{i}") * F.col(f"b{j}") / hu).alias(f"t{i}_{j}") for i, j in pairs],
            F.max(F.abs(gu)).alias("gmax"), F.avg(1.0 / F.greatest(hu, F.lit(1e-12))).alias("meas"), F.var_samp("u").alias("var")).collect()[0]
        grad = np.asarray([t[f"s{i}"] for i in range(k)])
        if max(float(np.abs(grad).max()), float(t["gmax"])) <= tol * 10:
            variance = max(float(t["var"] or 0.0) - float(t["meas"]), 0.0)
            return beta, effects, float(np.sqrt(variance)), {"measurement_variance": float(t["meas"]), "score": float(np.abs(grad).max())}
        schur = np.zeros((k, k))
        for i, j in pairs:
            schur[i, j] = schur[j, i] = t[f"q{i}_{j}"] - t[f"t{i}_{j}"]
        move = -np.linalg.solve(schur, grad - np.asarray([t[f"r{i}"] for i in range(k)]))
        beta = beta + move
        shift = gu
        for i in range(k):
            shift = shift + F.lit(float(move[i])) * F.col(f"b{i}")
        effects = per.select("entity_id", (F.col("u") - shift / hu).alias("u"))
    raise FloatingPointError("logistic null model did not converge")


@dataclass(frozen=True)
class Stationary:
    """Fitted stationary law of the trajectories."""

    initial_mean: np.ndarray
    initial_sd: np.ndarray
    action: np.ndarray
    effect_sd: float
    transition: np.ndarray  # p x (1 + p + 1): intercept, state, action
    transition_sd: np.ndarray
    reward: np.ndarray
    reward_sd: float | None  # None: Bernoulli with logit mean
    fixed: tuple[int, ...] = ()  # coordinates that keep their observed value
    initial_fixed_slope: float = 0.0
    clip: tuple[float, float] = (0.0, 1.0)


def _flat(panel: DataFrame, dim: int) -> DataFrame:
    return panel.select(
        "entity_id", "elapsed_index", F.col("action").cast("double").alias("a"), F.col("reward").cast("double").alias("r"),
        *[F.element_at("state", i + 1).alias(f"s{i}") for i in range(dim)], *[F.element_at("next_state", i + 1).alias(f"n{i}") for i in range(dim)])


def _initial(panel: DataFrame) -> DataFrame:
    return panel.groupBy("entity_id").agg(F.min_by("state", "elapsed_index").alias("state"))


def fit_parametric_null(panel: DataFrame, dim: int, penalty: float = 1.0) -> tuple[Stationary, dict]:
    """Pooled linear laws for initial state, transitions and reward, logistic actions with entity effects.

    Coordinate 0 is the driven state, coordinate 1 a time-invariant trait of the entity, the others
    share one autoregression on themselves and coordinate 0.
    """
    flat = _flat(panel, dim)
    moved = flat.where(F.abs(F.col("s1") - F.col("n1")) > 0).limit(1).count()
    if moved:
        raise ValueError("trait coordinate is not time invariant")
    first = _initial(panel).select(*[F.element_at("state", i + 1).alias(f"s{i}") for i in range(dim)])
    start, start_sd = least_squares(first, ["s1"], ["s0"])["s0"]
    others = list(range(2, dim))
    mean, sd = np.zeros(dim), np.full(dim, MINIMUM_SD)
    mean[0], sd[0] = start[0], start_sd
    if others:
        pool = first.select(F.explode(F.array(*[F.col(f"s{i}") for i in others])).alias("v")).agg(F.avg("v"), F.stddev_samp("v")).collect()[0]
        mean[others], sd[others] = pool[0], max(pool[1], MINIMUM_SD)
    action, _, effect_sd, diag = penalised_logistic(flat, ["s0", "s1"], "a", penalty)
    trans, trans_sd = np.zeros((dim, dim + 2)), np.zeros(dim)
    b0, trans_sd[0] = least_squares(flat, ["s0", "s1", "a"], ["n0"])["n0"]
    trans[0, [0, 1, 2, dim + 1]] = b0
    trans[1, 2] = 1.0
    if others:
        stack = flat.select(F.explode(F.array(*[F.struct(F.col(f"s{i}").alias("x"), F.col("s0").alias("d"), F.col(f"n{i}").alias("y")) for i in others])).alias("v")).select("v.*")
        bo, so = least_squares(stack, ["x", "d"], ["y"])["y"]
        for i in others:
            trans[i, 0], trans[i, 1 + i], trans[i, 1] = bo[0], bo[1], bo[2]
            trans_sd[i] = so
    xr = ["s0", "s1", *(["s2"] if dim > 2 else []), "a"]
    br, sr = least_squares(flat, xr, ["r"])["r"]
    reward = np.zeros(dim + 2)
    reward[: 1 + len(xr) - 1] = br[:-1]
    reward[-1] = br[-1]
    return Stationary(mean, sd, np.concatenate([action, np.zeros(dim - 2)]), effect_sd, trans, trans_sd, reward, sr, (1,), float(start[1]),
                      (0.01, 0.99)), {"action": diag, "effect_sd": effect_sd}


def fit_bridge_null(panel: DataFrame, dim: int, ridge: float = 1.0, c: float = 1.0) -> tuple[Stationary, dict]:
    """Logistic policy, ridge transitions, logistic binary reward, entity offsets from logit moments."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    flat = materialise(_flat(panel, dim), "bridge")
    n = flat.count()
    s, sd_floor = [f"s{i}" for i in range(dim)], 0.05

    def logistic(x: list[str], y: str):
        data = VectorAssembler(inputCols=x, outputCol="features").transform(flat.withColumn("label", F.col(y)))
        return LogisticRegression(regParam=1.0 / (c * n), standardization=False, maxIter=1000, tol=1e-8).fit(data), data

    policy, data = logistic(s, "a")
    scored = policy.transform(data).select("entity_id", "a", vector_to_array("probability")[1].alias("p"))

    def logit(x):
        x = F.least(F.greatest(x, F.lit(0.02)), F.lit(0.98))
        return F.log(x / (1.0 - x))

    offsets = scored.groupBy("entity_id").agg((logit(F.avg("a")) - logit(F.avg("p"))).alias("re"))
    effect = max(float(offsets.agg(F.stddev_samp("re")).collect()[0][0] or 0.0), sd_floor)
    fits = least_squares(flat, [*s, "a"], [f"n{i}" for i in range(dim)], ridge, sd_floor, centred=True)
    trans = np.vstack([fits[f"n{i}"][0] for i in range(dim)])
    tsd = np.asarray([fits[f"n{i}"][1] for i in range(dim)])
    reward, _ = logistic([*s, "a"], "r")
    first = _initial(panel).select(*[F.element_at("state", i + 1).alias(f"s{i}") for i in range(dim)])
    m = first.agg(*[F.avg(f"s{i}") for i in range(dim)], *[F.stddev_samp(f"s{i}") for i in range(dim)]).collect()[0]
    return Stationary(np.asarray(m[:dim], float), np.maximum(np.asarray(m[dim:], float), sd_floor),
                      np.concatenate([[policy.intercept], policy.coefficients.toArray()]), effect, trans, tsd,
                      np.concatenate([[reward.intercept], reward.coefficients.toArray()]), None), {"effect_sd": effect}


def coefficient_table(spark, model: Stationary) -> DataFrame:
    """Every number of a fitted null: the name of its part, its place there and its value."""
    rows = []
    for f in fields(model):
        value = getattr(model, f.name)
        if value is not None:
            rows += [(f.name, i, float(x)) for i, x in enumerate(np.ravel(np.asarray(value, dtype=float)))]
    return spark.createDataFrame(rows, "part string, position long, value double")
