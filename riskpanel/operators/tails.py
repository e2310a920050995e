"""Multivariate process diagnostics over (bank, draw, coordinate) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import tiles as TL
from .quantiles import cumulative_cells, exact_quantile_table, exact_quantiles

# Tail thresholds and distance bins.
THRESHOLDS = (0.90, 0.925, 0.95, 0.975)
EVAL_BINS = ((0, 0, "0"), (1, 3, "1-3"), (4, 7, "4-7"), (8, 15, "8-15"), (16, 31, "16-31"), (32, 63, "32-63"))
GLOBAL_BINS = ((1, 7, "1-7"), (8, 31, "8-31"), (32, 63, "32-63"), (64, 127, "64-127"), (128, 255, "128-255"), (256, None, "256+"))


def _named(q: Sequence[float]) -> dict[str, float]:
    return {f"t{i}": float(x) for i, x in enumerate(q)}


def thresholds(bank: DataFrame, reference: str, q: Sequence[float] = THRESHOLDS, event: str = "absolute") -> DataFrame:
    """Reference quantile of every coordinate, one row per (threshold, coord)."""
    x = F.abs("value") if event == "absolute" else F.col("value")
    wide = exact_quantiles(bank.where(F.col("bank") == reference), ["coord"], x, _named(q))
    pairs = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("threshold"), F.col(n).alias("cut")) for n, p in _named(q).items()]))
    return wide.select("coord", pairs.alias("p")).select("coord", "p.*")


def exceedances(bank: DataFrame, cuts: DataFrame, event: str = "absolute") -> DataFrame:
    """Sparse exceedance events (bank, threshold, draw, coord, ...)."""
    x = F.abs("value") if event == "absolute" else F.col("value")
    return bank.join(cuts, "coord").where(x > F.col("cut")).drop("cut", "value")


def joint_probabilities(joint: DataFrame, draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joint, marginal and conditional P(j | i) = joint / marginal_i."""
    on = [k for k in keys if k in draws.columns]
    p = joint.join(F.broadcast(draws), on).withColumn("joint", F.col("n") / F.col("draws"))
    diag = p.where(F.col("i") == F.col("j")).select(*keys, "i", F.col("joint").alias("marginal"))
    return p.join(diag, [*keys, "i"]).withColumn("conditional", F.col("joint") / F.greatest(F.col("marginal"), F.lit(1e-15))).drop("n", "draws")


def draw_counts(bank: DataFrame) -> DataFrame:
    return bank.groupBy("bank").agg(F.count_distinct("draw").alias("draws"))


def exceedance_table(bank: DataFrame, reference: str, n_coords: int, q: Sequence[float] = THRESHOLDS) -> DataFrame:
    ev = exceedances(bank, thresholds(bank, reference, q))
    return joint_probabilities(TL.joint_counts(ev, n_coords, ["bank", "threshold"]), draw_counts(bank), ["bank", "threshold"])


def pair_errors(table: DataFrame, reference: str) -> DataFrame:
    """Every other bank's joint and conditional probabilities beside the reference's."""
    cols = ("joint", "marginal", "conditional")
    ref = table.where(F.col("bank") == reference).select("threshold", "i", "j", *[F.col(c).alias(f"ref_{c}") for c in cols])
    other = table.where(F.col("bank") != reference)
    return other.join(ref, ["threshold", "i", "j"]).withColumn("joint_error", F.col("joint") - F.col("ref_joint")).withColumn(
        "conditional_error", F.col("conditional") - F.col("ref_conditional"))


def threshold_metrics(pairs: DataFrame) -> DataFrame:
    """Marginal, joint and conditional error summaries per bank and threshold."""
    group, off = ["bank", "threshold"], F.col("i") != F.col("j")
    je, ce = F.abs("joint_error"), F.abs("conditional_error")
    base = pairs.groupBy(*group).agg(
        F.avg(F.when(~off, F.abs(F.col("marginal") - F.col("ref_marginal")))).alias("marginal_mae"), F.avg(F.when(off, je)).alias("joint_mae"),
        (F.sqrt(F.sum(F.col("joint_error") ** 2)) / F.greatest(F.sqrt(F.sum(F.col("ref_joint") ** 2)), F.lit(1e-15))).alias("joint_frobenius"),
        F.avg(F.when(off, ce)).alias("conditional_mae"), F.max(F.when(off, ce)).alias("pair_error_max"))
    q = exact_quantile_table(pairs.where(off), group, {"pair_error": ce, "ref_conditional": F.col("ref_conditional"), "conditional": F.col("conditional")},
                             {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    q = q.select(*group, "pair_error_median", "pair_error_p90", "pair_error_p95", "pair_error_p99", "ref_conditional_p95", "conditional_p95")
    return base.join(q, group).withColumn("standardised_joint_mae", F.col("joint_mae") / (1.0 - F.col("threshold"))).withColumn(
        "conditional_p95_gap", F.abs(F.col("conditional_p95") - F.col("ref_conditional_p95")))


def integrated_contrast(metrics: DataFrame, comparison: str, noise: str) -> DataFrame:
    """Mean standardised joint error over thresholds, and its excess over the noise floor."""
    m = metrics.groupBy("bank").agg(F.avg("standardised_joint_mae").alias("isjem"))
    return m.agg(F.max(F.when(F.col("bank") == comparison, F.col("isjem"))).alias("raw"),
                 F.max(F.when(F.col("bank") == noise, F.col("isjem"))).alias("noise_floor")).withColumn("excess", F.col("raw") - F.col("noise_floor"))


# ----------------------------------------------------------------- centre and covariance
def covariance_metrics(bank: DataFrame, n_coords: int, reference: str, leading: int = 10) -> DataFrame:
    """Centre, scale, spectrum and correlation errors of every other bank against the reference, from tiles of co-moments."""
    tiles = materialise(TL.comoments(bank, n_coords), "comoments")
    table = materialise(TL.covariance_table(tiles, n_coords), "covariances")
    k, top = min(leading, n_coords), TL.leading_eigenvalues(tiles, n_coords, leading)
    spectrum = bank.sparkSession.createDataFrame([(b, [float(x) for x in v]) for b, v in top.items()], "bank string, leading array<double>")
    is_ref = F.col("bank") == reference
    floor = F.when(is_ref, F.lit(1e-15)).otherwise(F.lit(0.0))
    sd = table.where("i = j").select("bank", "i", "n", F.col("mean_i").alias("m"), F.sqrt(F.greatest("cov", floor)).alias("s"))
    ref = sd.where(is_ref).select("i", F.col("n").alias("reference_draws"), F.col("m").alias("m0"), F.col("s").alias("s0"))
    centre = sd.where(~is_ref).join(ref, "i").groupBy("bank").agg(
        F.first("reference_draws").alias("reference_draws"), F.first("n").alias("draws"), F.sqrt(F.avg(((F.col("m") - F.col("m0")) / F.col("s0")) ** 2)).alias("mean_rms"),
        (F.avg("s") / F.avg("s0")).alias("sd_ratio"))
    rank = table.groupBy("bank").agg((F.sum(F.when(F.col("i") == F.col("j"), F.col("cov"))) ** 2 / F.sum(F.col("cov") ** 2)).alias("rank")).join(spectrum, "bank")
    base = rank.where(is_ref).select(F.col("rank").alias("rank0"), F.col("leading").alias("leading0"))
    shape = rank.where(~is_ref).join(F.broadcast(base)).select(
        "bank", (F.element_at("leading", 1) / F.element_at("leading0", 1)).alias("leading_ratio"),
        F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.element_at("leading", i) / F.greatest(F.element_at("leading0", i), F.lit(1e-15))).alias("leading_ratios"),
        (F.col("rank") / F.col("rank0")).alias("effective_rank_ratio"))
    s = sd.select("bank", "i", "s")
    r = table.join(s.withColumnRenamed("s", "si"), ["bank", "i"]).join(s.select("bank", F.col("i").alias("j"), F.col("s").alias("sj")), ["bank", "j"]).select(
        "bank", "i", "j", (F.col("cov") / F.greatest(F.col("si") * F.col("sj"), F.lit(1e-15))).alias("r"))
    gap = F.col("r") - F.col("r0")
    corr = r.where(~is_ref).join(r.where(is_ref).select("i", "j", F.col("r").alias("r0")), ["i", "j"]).groupBy("bank").agg(
        (F.sqrt(F.sum(gap ** 2)) / F.sqrt(F.sum(F.col("r0") ** 2))).alias("correlation_frobenius"),
        F.avg(F.when(F.col("i") != F.col("j"), F.abs(gap))).alias("correlation_mae"))
    return centre.join(shape, "bank").join(corr, "bank")


def process_covariance(bank: DataFrame, n_coords: int) -> DataFrame:
    """Covariance of the process about its mean and second moment about zero, per replicate (cluster) and averaged over them."""
    keys = ["bank", "cluster"]
    table = TL.covariance_table(TL.comoments(bank, n_coords, keys), n_coords, keys)
    direct = F.col("cov") * (F.col("n") - 1.0) / F.col("n") + F.col("mean_i") * F.col("mean_j")
    return table.groupBy("bank", "i", "j").agg(F.count(F.lit(1)).alias("replicates"), F.avg("cov").alias("centred"), F.avg(direct).alias("direct"))



def marginal_tails(bank: DataFrame, reference: str, q: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Absolute-quantile ratios, exceedance error, and skewness / kurtosis RMSE (population moments)."""
    mom = bank.groupBy("bank", "coord").agg(F.skewness("value").alias("sk"), F.kurtosis("value").alias("ku"))
    ref = mom.where(F.col("bank") == reference).select("coord", F.col("sk").alias("sk0"), F.col("ku").alias("ku0"))
    shape = mom.where(F.col("bank") != reference).join(F.broadcast(ref), "coord").groupBy("bank").agg(
        F.sqrt(F.avg((F.col("sk") - F.col("sk0")) ** 2)).alias("skewness_rmse"), F.sqrt(F.avg((F.col("ku") - F.col("ku0")) ** 2)).alias("kurtosis_rmse"))
    names = _named(q)
    wide = exact_quantiles(bank, ["bank", "coord"], F.abs("value"), names)
    long = wide.select("bank", "coord", F.explode(F.array(*[F.struct(F.lit(p).alias("threshold"), F.col(n).alias("x")) for n, p in names.items()])).alias("p")).select("bank", "coord", "p.*")
    r = long.where(F.col("bank") == reference).select("coord", "threshold", F.col("x").alias("x0"))
    ratio = long.where(F.col("bank") != reference).join(F.broadcast(r), ["coord", "threshold"]).withColumn("ratio", F.col("x") / F.greatest(F.col("x0"), F.lit(1e-15)))
    over = bank.where(F.col("bank") != reference).join(F.broadcast(r), "coord").groupBy("bank", "threshold", "coord").agg(
        F.avg((F.abs("value") > F.col("x0")).cast("double")).alias("p")).groupBy("bank", "threshold").agg(
        F.avg(F.abs(F.col("p") - (1.0 - F.col("threshold")))).alias("marginal_exceedance_mae"))
    group = ["bank", "threshold"]
    return ratio.groupBy(*group).agg(F.avg("ratio").alias("mean_quantile_ratio")).join(
        exact_quantiles(ratio, group, "ratio", {"median_quantile_ratio": 0.5}), group).join(over, group).join(shape, "bank")


def two_sample_ks(rows: DataFrame, keys: Sequence[str], value: str, is_reference: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance from cumulative counts of distinct values."""
    r = is_reference.cast("long")
    cells = cumulative_cells(rows, keys, F.col(value), {"a": r, "b": 1 - r})
    gap = F.abs((F.col("a_below") + F.col("a")) / F.col("a_total") - (F.col("b_below") + F.col("b")) / F.col("b_total"))
    return cells.groupBy(*keys).agg(F.max(gap).alias("ks"))


def max_distribution(layer_rows: DataFrame, reference: str) -> DataFrame:
    """KS, upper quantiles, their ratio and exceedance of the reference q95, per bank and layer."""
    probs = {"q90": 0.9, "q95": 0.95, "q99": 0.99}
    q = exact_quantiles(layer_rows, ["bank", "layer"], "value", probs)
    ref = q.where(F.col("bank") == reference).select("layer", *[F.col(p).alias(f"ref_{p}") for p in probs])
    other = layer_rows.where(F.col("bank") != reference)
    names = [r["bank"] for r in layer_rows.select("bank").distinct().collect() if r["bank"] != reference]
    copies = layer_rows.where(F.col("bank") == reference).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("bank"), "layer", "value", F.lit(True).alias("_r"))
    ks = two_sample_ks(copies.unionByName(other.select("bank", "layer", "value", F.lit(False).alias("_r"))), ["bank", "layer"], "value", F.col("_r"))
    over = other.join(F.broadcast(ref), "layer").groupBy("bank", "layer").agg(
        F.avg((F.col("value") > F.col("ref_q95")).cast("double")).alias("exceeds_ref_q95"), F.count(F.lit(1)).alias("draws"))
    return q.where(F.col("bank") != reference).join(ref, "layer").join(ks, ["bank", "layer"]).join(over, ["bank", "layer"]).withColumn(
        "q95_ratio", F.col("q95") / F.col("ref_q95"))


def spearman(bank: DataFrame, n_coords: int, name: str) -> DataFrame:
    """Rank correlations (i, j, rank_correlation) of one bank's coordinates, ties at their average rank."""
    x = TL.complete(bank.where(F.col("bank") == name).select("bank", "draw", "coord", "value"), n_coords, ["bank"])
    ties = Window.partitionBy("bank", "coord", "value")
    rank = F.rank().over(Window.partitionBy("bank", "coord").orderBy("value")) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    table = TL.covariance_table(TL.comoments(x.withColumn("value", rank), n_coords), n_coords)
    return TL.correlation_table(materialise(table, "rank-covariances")).select("i", "j", F.col("r").alias("rank_correlation"))


# --------------------------------------------------------------------------- structure
def coordinate_metadata(cuts: DataFrame, grid: DataFrame, n_z: int) -> DataFrame:
    """Candidate-major flat index of every (cut, evaluation point); both inputs are short grids."""
    return cuts.join(F.broadcast(grid)).select(
        (F.col("candidate_index") * n_z + F.col("z")).alias("coord"), *cuts.columns, *grid.columns)


def _bin(x: Column, bins) -> Column:
    out = None
    for lo, hi, label in bins:
        c = (x >= lo) if hi is None else x.between(lo, hi)
        out = F.when(c, label) if out is None else out.when(c, label)
    return out


def pair_table(meta: DataFrame, errors: DataFrame) -> DataFrame:
    """Ordered off-diagonal pairs with structural flags, distance bins, labels and structural group."""
    cols = ["candidate_index", "candidate", "z", "base_index", "value_action", "trait", "source_entity"]
    left = meta.select(F.col("coord").alias("i"), *[F.col(c).alias(f"{c}_i") for c in cols])
    right = meta.select(F.col("coord").alias("j"), *[F.col(c).alias(f"{c}_j") for c in cols])
    t = errors.where(F.col("i") != F.col("j")).join(left, "i").join(right, "j")
    def same(c: str) -> Column:
        return F.col(f"{c}_i") == F.col(f"{c}_j")
    t = t.select("*", F.abs(F.col("candidate_index_i") - F.col("candidate_index_j")).alias("candidate_distance"),
                 F.abs(F.col("z_i") - F.col("z_j")).alias("evaluation_distance"), F.abs(F.col("i") - F.col("j")).alias("global_distance"),
                 same("candidate_index").alias("same_candidate"), same("z").alias("same_evaluation"), same("base_index").alias("same_base_state"),
                 same("value_action").alias("same_value_action"), same("trait").alias("same_trait"), same("source_entity").alias("same_source_entity"),
                 F.concat_ws("->", F.col("value_action_i").cast("string"), F.col("value_action_j").cast("string")).alias("value_action_pair"),
                 F.concat_ws("->", F.col("trait_i").cast("string"), F.col("trait_j").cast("string")).alias("trait_pair"))
    # Structural group labels.
    sc, sa = F.col("same_candidate"), F.col("same_value_action")
    group = F.when(sc & F.col("same_base_state") & ~sa, "same_candidate_same_state_cross_action").when(
        ~sc & F.col("same_evaluation"), "cross_candidate_same_evaluation").when(sc & sa, "same_candidate_same_action").when(
        sc & ~sa, "same_candidate_cross_action").when(~sc & sa, "cross_candidate_same_action").otherwise("cross_candidate_cross_action")
    return t.select("*", _bin(F.col("evaluation_distance"), EVAL_BINS).alias("evaluation_bin"), _bin(F.col("global_distance"), GLOBAL_BINS).alias("global_bin"),
                    group.alias("structural_group"))


GROUPINGS = ("same_candidate", "candidate_distance", "same_evaluation", "same_base_state", "same_value_action", "value_action_pair", "same_trait",
             "trait_pair", "same_source_entity", "evaluation_bin", "global_bin", "structural_group")


def structure_summary(pairs: DataFrame) -> DataFrame:
    """Signed and absolute conditional error by twelve structural groupings, with shares and quantiles."""
    e = F.col("conditional_error")
    total = pairs.agg(F.sum(F.abs(e)).alias("_total"))
    long = pairs.select("conditional_error", "joint_error", F.explode(F.array(*[
        F.struct(F.lit(g).alias("group_type"), F.col(g).cast("string").alias("group_value")) for g in GROUPINGS])).alias("g")).select("conditional_error", "joint_error", "g.*")
    group = ["group_type", "group_value"]
    base = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(e).alias("signed_mean"), F.avg((e < 0).cast("double")).alias("under_fraction"),
        F.avg((e > 0).cast("double")).alias("over_fraction"), F.avg(F.abs(e)).alias("absolute_mean"), F.avg((F.abs(e) > 0.10).cast("double")).alias("share_gt_010"),
        F.sum(F.abs(e)).alias("_s"), F.avg(F.abs("joint_error")).alias("joint_mae"))
    q = exact_quantile_table(long, group, {"absolute": F.abs(e), "signed": e}, {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0})
    q = q.drop(*[f"signed_{x}" for x in ("p25", "p75", "p90", "p95", "p99", "max")])
    return base.join(q, group).join(F.broadcast(total)).withColumn("share_total_error", F.col("_s") / F.col("_total")).drop("_s", "_total")


def extreme_counts(bank: DataFrame, events: DataFrame) -> DataFrame:
    """How many coordinates are extreme in the same draw: mean, p95 and share with at least two."""
    seen = events.groupBy("bank", "threshold", "draw").agg(F.count(F.lit(1)).alias("k"))
    levels = events.select("threshold").distinct()
    grid = bank.select("bank", "draw").distinct().join(F.broadcast(levels))
    full = grid.join(seen, ["bank", "threshold", "draw"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    group = ["bank", "threshold"]
    return full.groupBy(*group).agg(F.avg("k").alias("mean_extremes"), F.avg((F.col("k") >= 2).cast("double")).alias("multiple_fraction")).join(
        exact_quantiles(full, group, "k", {"p95_extremes": 0.95}), group)


def top_share(pairs: DataFrame, share: float = 0.05) -> DataFrame:
    """Share of the total absolute conditional error carried by the worst pairs (bounded pair grid)."""
    x = pairs.where(F.col("i") != F.col("j")).withColumn("ae", F.abs("conditional_error"))
    w = Window.partitionBy("bank", "threshold")
    r = x.withColumn("rk", F.row_number().over(w.orderBy(F.desc("ae"), "i", "j"))).withColumn("n", F.count(F.lit(1)).over(w))
    top = F.col("rk") <= F.greatest(F.lit(1), F.ceil(F.col("n") * share))
    return r.groupBy("bank", "threshold").agg((F.sum(F.when(top, F.col("ae"))) / F.sum("ae")).alias("top_share"), F.first("n").alias("pairs"))


def worst_pairs(pairs: DataFrame, n: int) -> DataFrame:
    return pairs.where(F.col("i") != F.col("j")).withColumn("ae", F.round(F.abs("conditional_error"), 9)).orderBy(
        F.desc("ae"), "bank", "threshold", "i", "j").limit(n)


# ------------------------------------------------------------------ resampling, subsets
def multinomial_weights(spark: SparkSession, units: int, reps: int, seed: int, size: int | None = None) -> DataFrame:
    """Bootstrap weights (rep, unit, w): ``size`` hashed picks among ``units`` per replicate."""
    from ..functions.columns import hash_uniform

    n = size or units
    slots = spark.range(reps * n).select(F.floor(F.col("id") / n).alias("rep"), F.pmod("id", F.lit(n)).alias("slot"))
    pick = F.floor(hash_uniform(seed, F.col("rep"), F.col("slot")) * units).cast("long")
    return slots.groupBy("rep", pick.alias("unit")).agg(F.count(F.lit(1)).alias("w"))


def resampled_metric(bank: DataFrame, reference: str, comparison: str, n_coords: int, q: float, weights_ref: DataFrame, weights_cmp: DataFrame,
                     unit_cmp: str = "draw") -> DataFrame:
    """Standardised joint error of every bootstrap replicate, from weighted joint counts.

    The reference resamples draws, the comparison resamples draws or whole clusters; thresholds and event sets are
    re-used, and a replicate is the bit planes of its weights.
    """
    ev = exceedances(bank, thresholds(bank, reference, [q]))
    size = bank.select("bank", "draw", "cluster").distinct()

    def side(name: str, w: DataFrame, unit: str) -> DataFrame:
        link = w.select("rep", F.col("unit").alias("_unit"), "w")
        return size.where(F.col("bank") == name).join(link, F.col(unit).cast("long") == F.col("_unit")).select("bank", "rep", "draw", "w")

    weights = materialise(side(reference, weights_ref, "draw").unionByName(side(comparison, weights_cmp, unit_cmp)), "resample-weights")
    return TL.weighted_gap(ev, weights, n_coords, reference, comparison).select("rep", (F.col("gap") / (1.0 - q)).alias("metric"))


def uncertainty(metric: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    base = metric.groupBy(*keys).agg(F.count(F.lit(1)).alias("replicates"), F.stddev_samp("metric").alias("se"), F.avg("metric").alias("mean"))
    q = exact_quantiles(metric, keys, "metric", {"ci_low": 0.025, "median": 0.5, "ci_high": 0.975})
    out = base.join(q, list(keys)) if keys else base.join(q)
    return out.withColumn("ci_width", F.col("ci_high") - F.col("ci_low"))


def cluster_balanced(draws: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` draws taken round-robin over clusters in hashed order (each cluster's list is limited first)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cluster").cast("string"), F.col("draw").cast("string")))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("cluster").cast("string")))
    ranked = draws.select("bank", "cluster", "draw").distinct().withColumn("_h", h).withColumn("_c", order).withColumn(
        "round", F.row_number().over(Window.partitionBy("bank", "cluster").orderBy("_h"))).where(F.col("round") <= n)
    return ranked.orderBy("round", "_c").limit(n).select("bank", "cluster", "draw", "round")


def first_draws(bank: DataFrame, per_cluster: int, clusters: int) -> DataFrame:
    """The first ``per_cluster`` draws of every cluster when clusters interleave in draw order."""
    return bank.where(F.floor(F.col("draw") / clusters) < per_cluster)


def nested_variance(bank: DataFrame) -> DataFrame:
    """Pointwise total = within + between variance (population divisors) and the identity error."""
    c = bank.groupBy("bank", "coord", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    g = c.groupBy("bank", "coord").agg(F.sum(F.col("n") * F.col("m")).alias("sm"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("v")).alias("sv"),
                                       F.sum(F.col("n") * F.col("m") ** 2).alias("smm"))
    t = bank.groupBy("bank", "coord").agg(F.var_pop("value").alias("total"))
    x = g.select("bank", "coord", (F.col("sv") / F.col("N")).alias("within"), (F.col("smm") / F.col("N") - (F.col("sm") / F.col("N")) ** 2).alias("between")).join(t, ["bank", "coord"])
    return x.groupBy("bank").agg(F.avg("total").alias("total"), F.avg("within").alias("within"), F.avg("between").alias("between"),
                                 (F.avg("within") / F.avg("total")).alias("within_fraction"),
                                 F.max(F.abs(F.col("total") - F.col("within") - F.col("between"))).alias("identity_error"))


def nested_spectrum(bank: DataFrame, n_coords: int, name: str) -> DataFrame:
    """Leading-eigenvalue shares of the within- and between-cluster covariance of one bank."""
    x = TL.complete(bank.where(F.col("bank") == name).select("bank", "draw", "cluster", "coord", "value"), n_coords, ["bank"])
    means = x.groupBy("cluster", "coord").agg(F.avg("value").alias("m"))
    parts = {"total": F.col("value"), "within": F.col("value") - F.col("m"), "between": F.col("m")}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("value")) for k, v in parts.items()]))
    split = x.join(means, ["cluster", "coord"]).select("draw", "coord", each.alias("p")).select(F.col("p.part").alias("bank"), "draw", "coord", "p.value")
    tiles = materialise(TL.comoments(split, n_coords), "nested-comoments")
    top = {k: float(v[0]) for k, v in TL.leading_eigenvalues(tiles, n_coords, 1).items()}
    table = TL.covariance_table(tiles, n_coords).groupBy("i", "j").agg(*[F.sum(F.when(F.col("bank") == k, F.col("cov"))).alias(k) for k in parts], F.max("n").alias("n"))
    return table.agg(F.max("n").alias("draws"), (F.sqrt(F.sum((F.col("total") - F.col("within") - F.col("between")) ** 2)) / F.sqrt(F.sum(F.col("total") ** 2))).alias("identity_error")).select(
        F.lit(name).alias("bank"), "draws", F.lit(top["within"] / top["total"]).alias("within_leading"), F.lit(top["between"] / top["total"]).alias("between_leading"), "identity_error")


def conditional_means(bank: DataFrame, reference: str, by: str) -> DataFrame:
    """RMS and signed mean of cluster means, standardised by the reference spread, by cut or grid point."""
    sd = bank.where(F.col("bank") == reference).groupBy("coord").agg(F.stddev_samp("value").alias("sd"))
    m = bank.groupBy("bank", "cluster", "coord", by).agg(F.avg("value").alias("m")).join(F.broadcast(sd), "coord").withColumn("s", F.col("m") / F.greatest("sd", F.lit(1e-15)))
    return m.groupBy("bank", by).agg(F.sqrt(F.avg(F.col("s") ** 2)).alias("rms_standardised"), F.avg("s").alias("mean_standardised"))


def zero_centre(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.agg(F.corr(x, y).alias("correlation"), (F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) ** 2)).alias("slope_through_origin"),
                     F.sqrt(F.avg((F.col(y) - F.col(x)) ** 2)).alias("rmse"),
                     (F.sqrt(F.avg((F.col(y) - F.col(x)) ** 2)) / F.sqrt(F.avg(F.col(y) ** 2))).alias("relative_rmse"))


def association_attenuation(rows: DataFrame, designs: Sequence[str], first: str, second: str) -> DataFrame:
    """Correlation of design statistics with log(1 + norm) of two arms, and the loss in absolute value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("design"), F.col(d).cast("double").alias("x")) for d in designs]))
    long = rows.select(first, second, pairs.alias("p")).select(first, second, "p.*")
    out = long.groupBy("design").agg(F.corr("x", F.log1p(first)).alias("first_correlation"), F.corr("x", F.log1p(second)).alias("second_correlation"))
    return out.withColumn("attenuation", F.abs("first_correlation") - F.abs("second_correlation"))


def innovation_diagnostics(rows: DataFrame, value: str, order: str, keys: Sequence[str], width: int = 4096) -> DataFrame:
    """Moments of innovations, lag-1 correlation within entity and the share of adjacent extremes."""
    from .timeline import CHUNK, neighbours

    spread = rows.withColumn(CHUNK, F.floor(F.col(order) / width).cast("long"))
    near = neighbours(spread, ["entity_id"], [order], [value, order], sides=("prev",))
    lag = F.when(F.col(f"prev_{order}") == F.col(order) - 1, F.col(f"prev_{value}"))
    cut = exact_quantiles(rows, keys, F.abs(value), {"cut": 0.9})
    x = near.withColumn("_lag", lag).join(F.broadcast(cut), list(keys))
    both = (F.abs(value) >= F.col("cut")) & (F.abs("_lag") >= F.col("cut"))
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("bias"), F.sqrt(F.avg(F.col(value) ** 2)).alias("rmse"), F.stddev_samp(value).alias("sd"),
        F.skewness(value).alias("skewness"), F.kurtosis(value).alias("excess_kurtosis"), F.corr(value, "_lag").alias("lag1"),
        (F.count_if(both) / F.count("_lag")).alias("adjacent_extreme_share"))


def conditional_covariance(bank: DataFrame) -> DataFrame:
    """Empirical variance of each coordinate against the mean of its within-cluster variances."""
    c = bank.groupBy("bank", "coord", "cluster").agg(F.var_samp("value").alias("v"))
    mean = c.groupBy("bank", "coord").agg(F.avg("v").alias("mean_conditional"))
    emp = bank.groupBy("bank", "coord").agg(F.var_samp("value").alias("empirical"))
    return emp.join(mean, ["bank", "coord"]).groupBy("bank").agg(
        F.avg("empirical").alias("empirical"), F.avg("mean_conditional").alias("mean_conditional"),
        (F.avg("mean_conditional") / F.avg("empirical")).alias("ratio"))
