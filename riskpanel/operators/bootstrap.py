"""Bootstrap calibration: multiplier arms, full-refit arms, p-values, draw accounting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MULTIPLIERS, finite_p
from ..session import materialise
from .fqi import Design, FitRule, Models, Randomness, _matrix, draws_per_block, fit, influence_moments, keyed_draws, sum_arrays
from .process import LAYERS, Prepared, layer_columns, unpivot_layers
from .quantiles import exact_quantiles

# Ordered failure categories and the message fragments that select them.
FAILURE_PATTERNS = (
    ("SUPPORT_REJECTION", ("invalid_support_draw", "no_admissible_candidate")),
    ("NONFINITE_STATISTIC", ("nonfinite", "nan", "inf")),
    ("PANEL_REBUILD_FAILURE", ("panel", "mask")),
    ("FQI_NUMERICAL_FAILURE", ("linalg", "singular", "converg", "ridge", "fqi")),
    ("GENERATIVE_MODEL_FAILURE", ("logistic", "bernoulli", "transition", "generative")),
)


def multipliers(entities: DataFrame, draws: int, seed: int, law: str = "gaussian") -> DataFrame:
    """One multiplier per (entity, draw), reused over all cuts, points and re-entries of the entity."""
    make = MULTIPLIERS[law]
    ids = F.sequence(F.lit(0), F.lit(draws - 1))
    return entities.select("entity_id", F.transform(ids, lambda d: make(F.lit(str(seed)), F.col("entity_id"), d)).alias("xi"))


def multinomial_entities(entities: DataFrame, draws: int, seed: int, leaf: int = 512) -> DataFrame:
    """(entity_id, w): exact multinomial counts of as many picks as there are entities, an array over draws.

    Entities hang in a binary tree of hash prefixes. Counts go down it by conditional binomials, left against right by the numbers
    of entities below, so they sum to the number of entities in every draw; the leaves, about ``leaf`` entities each, deal
    their count in tasks of their own. Only counts by prefix (at most 2**16) reach the driver. The answer depends on ids and seed alone.
    """
    keyed = materialise(entities.select("entity_id").distinct().select("entity_id", F.xxhash64("entity_id").alias("h")), "multinomial-entities")
    n = keyed.count()
    depth = int(min(16, max(0, np.ceil(np.log2(max(n, 1) / leaf)))))
    prefix = F.shiftrightunsigned("h", 64 - depth).cast("int") if depth else F.lit(0)
    size = np.zeros(1 << depth, np.int64)
    for r in keyed.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect():
        size[r["p"]] = r["n"]
    count = np.full((draws, 1), n, np.int64)
    for level in range(1, depth + 1):
        below = size.reshape(1 << level, -1).sum(axis=1)
        left, both = below[::2], below[::2] + below[1::2]
        share = np.divide(left, both, out=np.zeros(len(both)), where=both > 0)
        first = np.random.default_rng([seed, level]).binomial(count, share[None, :])
        count = np.stack([first, count - first], axis=-1).reshape(draws, -1)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "entity_id"])
        p, m = int(pdf["p"].iloc[0]), len(pdf)
        w = np.random.default_rng([seed, 1 << 20, p]).multinomial(count[:, p], np.full(m, 1.0 / m))
        return pd.DataFrame({"entity_id": pdf["entity_id"], "w": list(w.T.astype(float))})

    kind = entities.schema["entity_id"].dataType.simpleString()
    return keyed.withColumn("p", prefix).groupBy("p").applyInPandas(deal, f"entity_id {kind}, w array<double>")


def multiplier_sums(contrib: DataFrame, draws: int, seed: int, law: str = "gaussian") -> DataFrame:
    """Per draw, the sums of xi*delta and of (xi*delta)^2 over entities, as arrays over (cut, z).

    Each task multiplies its block of entities (draws x entities by entities x coordinates) and
    hands on one partial vector per draw; the cube of entity terms is never written.
    """
    make = MULTIPLIERS[law]
    ids = F.sequence(F.lit(0), F.lit(draws - 1))
    rows = contrib.select("delta", F.transform(ids, lambda d: make(F.lit(str(seed)), F.col("entity_id"), d)).alias("xi"))

    def task(batches):
        first = second = None
        for pdf in batches:
            if not len(pdf):
                continue
            xi, delta = _matrix(pdf["xi"]).T, _matrix(pdf["delta"])
            a, b = xi @ delta, (xi * xi) @ (delta * delta)
            first, second = (a, b) if first is None else (first + a, second + b)
        if first is not None:
            yield pd.DataFrame({"draw": np.arange(draws), "v": list(np.hstack([first, second]))})

    return sum_arrays(rows.mapInPandas(task, "draw long, v array<double>"), ["draw"], "v")


def multiplier_process(contrib: DataFrame, proc: DataFrame, cuts: Sequence[int], n_z: int, draws: int, seed: int,
                       arm: str = "M0", law: str = "gaussian", scale: float = 1.0) -> DataFrame:
    """Draw table of the fixed-variance (M0), draw-specific-variance (M1) or globally scaled (M0_scale) arm."""
    if arm not in ("M0", "M1", "M0_scale"):
        raise ValueError(f"unknown arm {arm!r}")
    size = len(cuts) * n_z
    sums = multiplier_sums(contrib, draws, seed, law)
    pairs = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.struct(
        F.element_at("v", i).alias("s1"), F.element_at("v", i + size).alias("s2")))).alias("p", "s")
    cut = F.element_at(F.array(*[F.lit(int(c)) for c in cuts]), (F.floor(F.col("p") / n_z) + 1).cast("int"))
    long = sums.select("draw", pairs).select("draw", cut.cast("long").alias("candidate"), F.pmod("p", F.lit(n_z)).cast("long").alias("z"),
                                             F.col("s.s1").alias("s1"), F.col("s.s2").alias("s2"))
    x = long.join(proc.select("candidate", "z", "clusters", "variance", "boundary"), ["candidate", "z"])
    g = F.col("clusters").cast("double")
    if arm == "M1":
        star = g / (g - 1.0) * (F.col("s2") - F.col("s1") * F.col("s1") / g)
        norm = F.col("s1") / F.sqrt(F.greatest(star, F.lit(1e-15)))
    else:
        norm = F.when(F.col("variance") > 0, F.col("s1") / F.sqrt("variance"))
    k = scale if arm == "M0_scale" else 1.0
    return x.select("draw", "candidate", "z", (F.col("s1") * k).alias("raw"), (norm * k).alias("normalized"),
                    (F.col("boundary") * norm * k).alias("joint"))


def draw_layers(draws: DataFrame, midpoint: int, keys: Sequence[str] = ("draw",)) -> DataFrame:
    """Reduce a draw cube to the five layers per draw."""
    return draws.groupBy(*keys).agg(*layer_columns(midpoint, raw="raw"))


def calibrate(layer_draws: DataFrame, observed: DataFrame, level: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """Finite-sample p-value, critical value and decision per layer; invalid draws are left out, never replaced."""
    group = [*keys, "layer"]
    draws = unpivot_layers(layer_draws, keys, "t")
    obs = unpivot_layers(observed, keys, "observed")
    joined = draws.join(F.broadcast(obs), group)
    base = joined.groupBy(*group).agg(
        F.first("observed").alias("observed"), F.count("t").alias("valid_draws"), F.count_if(F.col("t").isNull()).alias("failed_draws"),
        F.count_if(F.col("t") >= F.col("observed")).alias("_k"))
    q = exact_quantiles(draws, group, "t", {"critical_value": 1.0 - level})
    p = F.when(F.col("valid_draws") > 0, finite_p(F.col("_k"), F.col("valid_draws")))
    return base.join(q, group, "left").withColumn("p_value", p).withColumn("reject", F.col("p_value") <= level).drop("_k")


def centred_draws(draws: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Subtract the draw mean of every (candidate, z)."""
    point = [*keys, "candidate", "z"]
    means = draws.groupBy(*point).agg(*[F.avg(c).alias(f"_{c}") for c in ("raw", "normalized", "joint")])
    return draws.join(means, point).select(*keys, "draw", "candidate", "z", *[
        (F.col(c) - F.col(f"_{c}")).alias(c) for c in ("raw", "normalized", "joint")])


def process_moments(draws: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, variance, population skewness and excess kurtosis, absolute quantiles per (candidate, z)."""
    group = [*keys, "candidate", "z"]
    base = draws.groupBy(*group).agg(
        F.avg("joint").alias("mean"), F.var_samp("joint").alias("variance"), F.skewness("joint").alias("skewness"),
        F.kurtosis("joint").alias("excess_kurtosis"))
    return base.join(exact_quantiles(draws, group, F.abs("joint"), {"abs_q90": 0.9, "abs_q95": 0.95, "abs_q99": 0.99}), group)


def failure_category(message: Column) -> Column:
    """First matching category of a lower-cased error message."""
    m, out = F.lower(message), F.lit("OTHER_EXCEPTION")
    for name, fragments in reversed(FAILURE_PATTERNS):
        hit = F.lit(False)
        for f in fragments:
            hit = hit | m.contains(f)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def draw_accounting(draws: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Valid and failed draws by category; ``message`` is NULL for a valid draw."""
    tagged = draws.withColumn("category", F.when(F.col("message").isNull(), F.lit("VALID")).otherwise(failure_category(F.col("message"))))
    counts = tagged.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"))
    if keys:
        total = counts.groupBy(*keys).agg(F.sum("n").alias("draws"))
        return counts.join(total, list(keys)).withColumn("rate", F.col("n") / F.col("draws"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("draws")))).withColumn("rate", F.col("n") / F.col("draws"))


def adjusted_contributions(contrib: DataFrame) -> DataFrame:
    """(entity_id, candidate, z, delta, hat, adjusted): hat value delta^2 / sum delta^2, delta / sqrt(1 - hat) less its mean."""
    point = ["candidate", "z"]
    total = contrib.groupBy(*point).agg(F.greatest(F.sum(F.col("delta") ** 2), F.lit(np.finfo(float).tiny)).alias("_ss"))
    hat = F.col("delta") ** 2 / F.col("_ss")
    x = contrib.join(F.broadcast(total), point).withColumn("hat", hat).withColumn("_adj", F.col("delta") / F.sqrt(F.greatest(1.0 - F.col("hat"), F.lit(1e-8))))
    mean = x.groupBy(*point).agg(F.avg("_adj").alias("_m"))
    return x.join(F.broadcast(mean), point).select("entity_id", *point, "delta", "hat", (F.col("_adj") - F.col("_m")).alias("adjusted"))


def point_vectors(long: DataFrame, points: Sequence[tuple[int, int]], col: str) -> DataFrame:
    """(entity_id, value): (entity_id, candidate, z, ``col``) rows as one vector over ``points`` per entity, NULL where there is none."""
    numbered = long.sparkSession.createDataFrame([(c, z, i) for i, (c, z) in enumerate(points)], "candidate long, z long, p int")
    cell = F.struct("p", F.coalesce(F.col(col), F.lit(float("nan"))).alias("x"))
    rows = long.join(F.broadcast(numbered), ["candidate", "z"]).groupBy("entity_id").agg(F.collect_list(cell).alias("c")).select("entity_id", "c.p", "c.x")

    def task(batches):
        for pdf in batches:
            out = np.full((len(pdf), len(points)), np.nan)
            for i, (p, x) in enumerate(zip(pdf["p"], pdf["x"])):
                out[i, np.asarray(p, int)] = x
            yield pd.DataFrame({"entity_id": pdf["entity_id"], "value": list(out)})

    kind = long.schema["entity_id"].dataType.simpleString()
    return materialise(rows.mapInPandas(task, f"entity_id {kind}, value array<double>"), "point-vectors")


def _vector_sums(vectors: DataFrame, n: int, work) -> np.ndarray:
    """``work`` (entities x points to k x points) summed over all entities."""
    def task(batches):
        total = 0.0
        for pdf in batches:
            if len(pdf):
                total = total + work(_matrix(pdf["value"]))
        if np.ndim(total):
            yield pd.DataFrame({"i": [0], "v": [total.ravel()]})

    got = sum_arrays(vectors.select("value").mapInPandas(task, "i int, v array<double>"), ["i"], "v").first()
    return np.zeros((2, n)) if got is None else np.asarray(got["v"]).reshape(-1, n)


def variance_versions(contrib: DataFrame, left_out: DataFrame, contrast: DataFrame, draws: int, seed: int, law: str = "gaussian") -> DataFrame:
    """``vector_versions`` of (entity_id, candidate, z) rows of contributions (``delta``) and of leave-one-out values (``leave_one_out``)."""
    points = [(r["candidate"], r["z"]) for r in contrast.select("candidate", "z").orderBy("candidate", "z").collect()]
    return vector_versions(point_vectors(contrib, points, "delta"), point_vectors(left_out, points, "leave_one_out"), contrast, draws, seed, law)


def vector_versions(contrib: DataFrame, left_out: DataFrame, contrast: DataFrame, draws: int, seed: int, law: str = "gaussian") -> DataFrame:
    """Multiplier draws of the statistic under five variances, per (candidate, z, version): observed value, p-value, moments and quantiles.

    raw: no variance; fixed: that of the contributions; draw_specific: that of the multiplied contributions in every draw;
    jackknife: pseudo-contributions of real leave-one-out values, with theirs; cr2: contributions adjusted by their hat values, with
    theirs. Both tables have one vector ``value`` per entity over the points of ``contrast`` (by candidate and z), NULL where there is none;
    points are bounded by the design, so no entity's vector is taken apart. Sums over entities give hat values, means and draws in turn.
    """
    point = ["candidate", "z"]
    told = contrast.select(*point, "contrast").orderBy(*point).collect()
    n = len(told)
    g, ss = _vector_sums(contrib, n, lambda d: np.stack([(~np.isnan(d)).sum(axis=0), np.nansum(d * d, axis=0)]))
    lg, ls = _vector_sums(left_out, n, lambda v: np.stack([(~np.isnan(v)).sum(axis=0), np.nansum(v, axis=0)]))
    scale, lmean = np.maximum(ss, np.finfo(float).tiny), ls / np.maximum(lg, 1.0)

    def adjust(d: np.ndarray) -> np.ndarray:
        return d / np.sqrt(np.maximum(1.0 - d * d / scale, 1e-8))

    mean = _vector_sums(contrib, n, lambda d: np.nansum(adjust(d), axis=0)[None])[0] / np.maximum(g, 1.0)
    make, ids = MULTIPLIERS[law], F.sequence(F.lit(0), F.lit(draws - 1))
    rows = contrib.withColumnRenamed("value", "d").join(left_out.withColumnRenamed("value", "v"), "entity_id", "full").select(
        "d", "v", F.transform(ids, lambda d: make(F.lit(str(seed)), F.col("entity_id"), d)).alias("xi"))

    def task(batches):
        total, squares = np.zeros((draws, 4 * n)), np.zeros((2, n))
        none = np.full(n, np.nan)
        for pdf in batches:
            if len(pdf):
                d, v = (_matrix([none if x is None else x for x in pdf[c]]) for c in ("d", "v"))
                pseudo, adjusted = np.nan_to_num(-(lg - 1.0) / np.maximum(lg, 1.0) * (v - lmean)), np.nan_to_num(adjust(d) - mean)
                squares += np.stack([(adjusted ** 2).sum(axis=0), (pseudo ** 2).sum(axis=0)])
                xi, there = _matrix(pdf["xi"]).T, ~np.isnan(d)
                d = np.nan_to_num(d)
                total += np.hstack([xi @ np.hstack([d, pseudo * there, adjusted]), (xi * xi) @ (d ** 2)])
        yield pd.DataFrame({"draw": np.arange(-1, draws), "v": [squares.ravel(), *total]})

    sums = materialise(sum_arrays(rows.mapInPandas(task, "draw long, v array<double>"), ["draw"], "v"), "version-sums")
    got = sums.where("draw < 0").first()
    sa, sj = np.zeros((2, n)) if got is None else np.asarray(got["v"]).reshape(2, n)

    def variance(k: float, s: float) -> float | None:
        return float(k / (k - 1.0) * s) if k > 1 and s > 0 else None

    stats = sums.sparkSession.createDataFrame(
        [(r["candidate"], r["z"], i, r["contrast"], float(g[i]), variance(g[i], ss[i]), variance(lg[i], sj[i]), variance(g[i], sa[i])) for i, r in enumerate(told) if g[i] > 0],
        "candidate long, z long, p int, contrast double, g double, fixed double, jackknife double, cr2 double")
    cell = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(*[F.get("v", i + k * n).alias(c) for k, c in enumerate(("s1", "sj", "sa", "s2"))])))
    per = sums.where("draw >= 0").select("draw", cell.alias("p", "s")).select("draw", "p", "s.*").join(F.broadcast(stats), "p")
    spread = F.when(F.col("g") > 1, F.col("g") / (F.col("g") - 1.0) * (F.col("s2") - F.col("s1") ** 2 / F.col("g")))
    size = F.abs("contrast")
    versions = {"raw": (F.abs("s1"), size), "fixed": (F.abs("s1") / F.sqrt("fixed"), size / F.sqrt("fixed")),
                "draw_specific": (F.abs("s1") / F.sqrt(F.greatest(spread, F.lit(1e-15))), size / F.sqrt("fixed")),
                "jackknife": (F.abs("sj") / F.sqrt("jackknife"), size / F.sqrt("jackknife")), "cr2": (F.abs("sa") / F.sqrt("cr2"), size / F.sqrt("cr2"))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("version"), a.alias("value"), b.alias("observed")) for k, (a, b) in versions.items()]))
    long = materialise(per.select(*point, each.alias("v")).select(*point, "v.*"), "variance-draws")
    group = [*point, "version"]
    base = long.groupBy(*group).agg(F.first("observed").alias("observed"), finite_p(F.count_if(F.col("value") >= F.col("observed")), F.count("value")).alias("p_value"),
                                    F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return base.join(exact_quantiles(long, group, "value", {"q025": .025, "q05": .05, "q95": .95, "q975": .975}), group)


# ------------------------------------------------------------------------ refit arms
def draw_process(prep: Prepared, design: Design, models: Models, centre: bool = False) -> DataFrame:
    """Process of a block of refitted draws: (draw, candidate, z, raw, normalized, joint), NULL where a model of the draw did not converge.

    The variance at a point is a quadratic form in the draw's influence moments, evaluated by the task that has their sum.
    """
    beta, ids, valid = models.beta, np.asarray(models.extra["ids"]), models.converged.all(axis=(1, 2))
    z, cuts, bound, live = prep.z_design, np.asarray(design.cuts, dtype="int64"), prep.bound, design.active
    shift = prep.contrast if centre else 0.0
    c, n, dim = len(cuts), len(z), z.shape[1]

    def task(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                second = np.asarray(r.v).reshape(c, dim, dim)
                var = (live / np.maximum(live - 1.0, 1.0))[:, None] * np.einsum("zp,cpq,zq->cz", z, second, z)
                raw = (beta[r.i, :, 0] - beta[r.i, :, 1]) @ z.T - shift
                norm = raw / np.sqrt(np.maximum(var, 1e-15))
                out = pd.DataFrame({"draw": ids[r.i], "candidate": np.repeat(cuts, n), "z": np.tile(np.arange(n), c), "raw": raw.ravel(),
                                    "normalized": norm.ravel(), "joint": (norm * bound[:, None]).ravel()})
                if not valid[r.i]:
                    out[["raw", "normalized", "joint"]] = None
                yield out.astype({"raw": float, "normalized": float, "joint": float})

    rows = influence_moments(design, models).mapInPandas(task, "draw long, candidate long, z long, raw double, normalized double, joint double")
    return rows.select("draw", "candidate", "z", *[F.when(~F.isnan(x), F.col(x)).alias(x) for x in ("raw", "normalized", "joint")])


def refit_draws(prep: Prepared, design: Design, draws: int, rnd: Randomness, centre: bool, start: np.ndarray) -> DataFrame:
    """Full refit of every draw that shares the observed rows (wild-residual M2 or weighted M3).

    Draws run in blocks whose systems stay small, from the coefficients ``start``; ``centre`` subtracts the observed contrast, as
    the weighted arm requires. Tasks write the draws of a block before the next block starts.
    """
    out, size = None, draws_per_block(design)
    for first in range(0, draws, size):
        models = fit(design, prep.rule, rnd, range(first, min(draws, first + size)), start)
        part = materialise(draw_process(prep, design, models, centre), "refit-draws")
        out = part if out is None else out.unionByName(part)
    return out


def zero_draw(prep: Prepared, design: Design, start: np.ndarray) -> DataFrame:
    """The draw without perturbation: base rewards alone give both sides the common model, so the contrast vanishes.

    A side that does not converge is an error, since every other draw is then doubtful.
    """
    models = fit(design, prep.rule, Randomness("reward", "zeros"), [0], start)
    if not models.converged.all():
        raise ValueError("fqi did not converge on the draw without perturbation")
    return draw_process(prep, design, models).drop("draw")


def restricted_null(panel: DataFrame, start: int, end: int, state_dim: int, rule: FitRule) -> tuple[DataFrame, np.ndarray, dict]:
    """Common fit of the whole window: panel with ridge-offset base reward and entity-centred residual."""
    from .fqi import prepare
    from .process import row_values, transition_residuals

    design = prepare(panel, [end], start, end + 1, state_dim, "common")
    models = fit(design, rule)
    beta = models.beta[0, 0, 0]
    offset = np.linalg.solve(models.extra["gram"][0, 0, 0], rule.alpha * beta)
    q = design.q
    values = transition_residuals(row_values(design, rule, models).where("side = 'left'"))
    best = F.greatest("next_q0", "next_q1")

    def dot(coef: np.ndarray) -> Column:
        t = F.lit(float(coef[0]))
        for i in range(1, q):
            t = t + F.lit(float(coef[i])) * F.element_at("state", i)
        return t

    joined = panel.join(values.select("entity_id", "elapsed_index", "q0", "q1", "next_q0", "next_q1", "centred"), ["entity_id", "elapsed_index"])
    fitted = F.when(F.col("action") == 1, F.col("q1") + dot(offset[q:])).otherwise(F.col("q0") + dot(offset[:q]))
    out = joined.withColumn("base_reward", fitted - rule.gamma * best).withColumnRenamed("centred", "residual").drop(
        "q0", "q1", "next_q0", "next_q1")
    score = estimating_gap(models, rule, offset)
    return out, beta, {"ridge_score_error": float(np.linalg.norm(score))}


def estimating_gap(models: Models, rule: FitRule, offset: np.ndarray) -> np.ndarray:
    """Score of the common fit when rewards are the base rewards (zero up to roundoff)."""
    return models.extra["gram"][0, 0, 0] @ offset - rule.alpha * models.beta[0, 0, 0]


def project_on_multipliers(draws: DataFrame, entities: DataFrame, seed: int, law: str = "gaussian") -> DataFrame:
    """Least-squares projection of the draw process on the centred entity multipliers; the shortest solution where it is not unique.

    Solved in the space of draws: with X the centred multipliers (draws x entities), X+ = X'(XX')+, and XX' (draws x draws) is a sum
    over entities. So any number of entities is projected; each one's row of the answer is computed where the entity is.
    """
    vec = draws.where(F.col("joint").isNotNull()).groupBy("draw").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("candidate", "z", "joint"))), lambda s: s["joint"]).alias("y")).orderBy("draw").collect()
    ids = np.array([r["draw"] for r in vec], dtype=np.int64)
    y = np.array([r["y"] for r in vec], dtype=float)
    keyed = entities.select("entity_id", F.xxhash64("entity_id").alias("h"))

    def gram(batches):
        total = np.zeros((len(ids), len(ids)))
        for pdf in batches:
            if len(pdf):
                xi = keyed_draws(law, seed, ids, pdf["h"].to_numpy())
                xi -= xi.mean(axis=0)
                total += xi @ xi.T
        yield pd.DataFrame({"i": np.arange(len(ids)), "v": list(total)})

    kernel = np.zeros((len(ids), len(ids)))
    for r in sum_arrays(keyed.mapInPandas(gram, "i long, v array<double>"), ["i"], "v").collect():
        kernel[r["i"]] = r["v"]
    values, vectors = np.linalg.eigh(kernel)
    keep = values > values.max(initial=0.0) * len(ids) * np.finfo(float).eps * 16
    inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    weight = inverse @ (y - y.mean(axis=0)) if len(ids) else np.zeros((0, 0))

    def rows(batches):
        for pdf in batches:
            if len(pdf):
                xi = keyed_draws(law, seed, ids, pdf["h"].to_numpy())
                coef = (xi - xi.mean(axis=0)).T @ weight
                yield pd.DataFrame({"entity_id": pdf["entity_id"], "projection": list(coef), "norm": np.sqrt((coef ** 2).sum(axis=1))})

    kind = entities.schema["entity_id"].dataType.simpleString()
    return keyed.mapInPandas(rows, f"entity_id {kind}, projection array<double>, norm double")
