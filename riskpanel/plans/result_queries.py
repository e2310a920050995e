"""Registered queries: replicate-table analytics and multivariate process diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import Z_EXACT, Z_ROUNDED, hash_uniform
from ..operators import replicates as J
from ..operators import tails as K
from ..session import shared_table
from . import change_queries as CQ
from . import panel_queries as PQ
from . import roles as R
from .change_queries import SHIFT, draws_sql, md5_uniform
from .registry import Query, query, rounded
from .sql import DAILY, with_

N = 28


# ------------------------------------------------------------ replicate table (orders)
def replicates(s: SparkSession, d: str) -> DataFrame:
    """One replicate result row per order; its random parts are hashes of the order key."""
    def build():
        k = F.col("o_orderkey")
        u = {c: hash_uniform(k, c) for c in "abcdefgh"}
        o = R.table(s, d, "orders")
        null = F.col("o_totalprice") < 250000
        ok = F.col("ua") < 0.85
        x = o.select(k.alias("key"), "o_orderstatus", "o_totalprice", "o_orderpriority", *[v.alias(f"u{c}") for c, v in u.items()])
        adm, act = F.floor(F.col("ue") * 8), F.floor(F.col("uf") * 7) + 6
        cp = (F.floor(F.col("ud") * 7) + 2) * 3
        q90 = (2 + 3 * F.col("uc")) * 0.8 + F.col("uh")
        return x.select(
            "key", F.floor(F.col("key") / 20).alias("outer"), F.concat(F.lit("S"), F.substring("o_orderpriority", 1, 1)).alias("scenario"),
            F.col("o_orderstatus").alias("family"), null.alias("is_null"),
            F.when(null, "none").when(F.col("o_totalprice") < 400000, "small").otherwise("large").alias("effect_level"),
            F.when(null, 0.0).when(F.col("o_totalprice") < 400000, 0.5).otherwise(1.0).alias("effect_size"),
            F.concat(F.lit("v"), (F.col("key") % 2).cast("string")).alias("variant_id"),
            F.element_at(F.array(F.lit("full"), F.lit("pooled"), F.lit("strict")), (F.col("key") % 3 + 1).cast("int")).alias("method"),
            F.lit("primary").alias("threshold"), F.lit("harmonic").alias("scaling"), F.concat(F.lit("g"), (F.col("key") % 2).cast("string")).alias("evaluation_grid"),
            F.element_at(F.array(F.lit("M0"), F.lit("M1"), F.lit("M3")), (F.col("key") % 3 + 1).cast("int")).alias("arm"),
            F.concat(F.lit("D"), (F.col("key") % 5).cast("string")).alias("layer"),
            F.when(ok, "TESTABLE").when(F.col("ua") < 0.93, "NOT_TESTABLE_SUPPORT").when(F.col("ua") < 0.96, "NUMERICAL_FAILURE").when(
                F.col("ua") < 0.98, "BOOTSTRAP_FAILURE").otherwise("ZERO_VARIANCE").alias("status"),
            F.when(ok, (1 + F.floor(F.col("ub") * F.col("ub") * 199)) / 200.0).alias("p_value"), (2 + 3 * F.col("uc")).alias("observed"),
            F.lit(15).cast("long").alias("true_cp"), cp.cast("long").alias("estimated_cp"), F.abs(cp - 15).cast("double").alias("cp_error"),
            (F.abs(cp - 15) / 29.0).alias("relative_cp_error"), adm.cast("long").alias("number_admissible"), act.cast("double").alias("mean_active"),
            F.floor(F.col("ug") * 100).cast("long").alias("minimum_side_action1"), (F.col("ug") / 2).alias("maximum_total_share"), (F.col("uf") / 2).alias("maximum_action1_share"),
            F.floor(F.col("o_totalprice") / 100).cast("long").alias("retained_transitions"), F.floor(F.col("o_totalprice") / 250).cast("long").alias("retained_action1"),
            F.concat(F.lit('{"left:action1_count":'), F.floor(F.col("ue") * 3).cast("string"), F.lit(',"right:active_entities":'),
                     F.floor(F.col("uf") * 2).cast("string"), F.lit("}")).alias("support_failure_reasons"),
            F.lit("[6,9,12,15,18,21]").alias("admissible_candidates"), q90.alias("bootstrap_q90"), (q90 + 0.3).alias("bootstrap_q95"), (q90 + 0.8).alias("bootstrap_q99"),
            (199 - F.floor(F.col("uh") * 5)).cast("long").alias("valid_draws"), F.floor(F.col("uh") * 5).cast("long").alias("failed_draws"),
            (F.col("uh") * 10).alias("runtime_seconds"), (F.col("uc") - 0.5).alias("d"), (F.col("ud") * 0.1 + 0.05).alias("v"),
            F.concat(F.lit('{"zero_refit_error":'), F.floor(F.col("ue") * 1000).cast("string"), F.lit(',"refit_count":'),
                     F.floor(F.col("uf") * 50).cast("string"), F.lit("}")).alias("diagnostics"))
    return shared_table(s, d, "replicates", build)


_UU = {c: md5_uniform(f"o_orderkey || ':{c}'") for c in "abcdefgh"}
REP = ("ox AS (SELECT *, " + ", ".join(f"{v} AS u{c}" for c, v in _UU.items()) + """ FROM orders),
rp AS (SELECT o_orderkey AS key, o_orderkey // 20 AS outer, 'S' || substr(o_orderpriority, 1, 1) AS scenario, o_orderstatus AS family, o_totalprice < 250000 AS is_null,
    CASE WHEN o_totalprice < 250000 THEN 'none' WHEN o_totalprice < 400000 THEN 'small' ELSE 'large' END AS effect_level,
    CASE WHEN o_totalprice < 250000 THEN 0.0::DOUBLE WHEN o_totalprice < 400000 THEN 0.5 ELSE 1.0 END AS effect_size, 'v' || o_orderkey % 2 AS variant_id,
    ['full', 'pooled', 'strict'][o_orderkey % 3 + 1] AS method, 'primary' AS threshold, 'harmonic' AS scaling, 'g' || o_orderkey % 2 AS evaluation_grid,
    ['M0', 'M1', 'M3'][o_orderkey % 3 + 1] AS arm, 'D' || o_orderkey % 5 AS layer, CASE WHEN ua < 0.85 THEN 'TESTABLE' WHEN ua < 0.93 THEN 'NOT_TESTABLE_SUPPORT'
    WHEN ua < 0.96 THEN 'NUMERICAL_FAILURE' WHEN ua < 0.98 THEN 'BOOTSTRAP_FAILURE' ELSE 'ZERO_VARIANCE' END AS status,
    CASE WHEN ua < 0.85 THEN (1 + floor(ub * ub * 199)) / 200 END AS p_value, 2 + 3 * uc AS observed, 15 AS true_cp, (floor(ud * 7) + 2)::BIGINT * 3 AS estimated_cp,
    abs((floor(ud * 7) + 2) * 3 - 15)::DOUBLE AS cp_error, abs((floor(ud * 7) + 2) * 3 - 15) / 29 AS relative_cp_error, floor(ue * 8)::BIGINT AS number_admissible,
    floor(uf * 7) + 6 AS mean_active, floor(ug * 100)::BIGINT AS minimum_side_action1, ug / 2 AS maximum_total_share, uf / 2 AS maximum_action1_share,
    floor(o_totalprice / 100)::BIGINT AS retained_transitions, floor(o_totalprice / 250)::BIGINT AS retained_action1, floor(ue * 3)::BIGINT AS r1, floor(uf * 2)::BIGINT AS r2,
    (2 + 3 * uc) * 0.8 + uh AS bootstrap_q90, (2 + 3 * uc) * 0.8 + uh + 0.3 AS bootstrap_q95, (2 + 3 * uc) * 0.8 + uh + 0.8 AS bootstrap_q99,
    199 - floor(uh * 5)::BIGINT AS valid_draws, floor(uh * 5)::BIGINT AS failed_draws, uh * 10 AS runtime_seconds, uc - 0.5 AS d, ud * 0.1 + 0.05 AS v,
    floor(ue * 1000) AS zero_refit_error, floor(uf * 50) AS refit_count FROM ox)""")
_GK = ", ".join(J.GROUP_KEYS)


def _reason_json(keys: str) -> str:
    return ("'{\"left:action1_count\":' || sum(r1) || ',\"right:active_entities\":' || sum(r2) || '}'")


def _wil(k: str, n: str, t: str, z: float) -> str:
    p, z2 = f"({k} / {n})", z * z
    half = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z2 / 4} / ({n} * {n})) / (1 + {z2} / {n})"
    mid = f"({p} + {z2 / 2} / {n}) / (1 + {z2} / {n})"
    return (f"{k} AS rejection_count_{t}, CASE WHEN {n} > 0 THEN {k} / {n} END AS rate_{t}, CASE WHEN {n} > 0 THEN sqrt({p} * (1 - {p}) / {n}) END AS mcse_{t}, "
            f"CASE WHEN {n} > 0 THEN {mid} - {half} END AS wilson_low_{t}, CASE WHEN {n} > 0 THEN {mid} + {half} END AS wilson_high_{t}")


def _counts(n: str = "testable") -> str:
    return ", ".join(f"count(*) FILTER (status = 'TESTABLE' AND p_value <= {a}) AS k{t}" for t, a in J.LEVELS.items())


def _rates(n: str, z: float) -> str:
    return ", ".join(_wil(f"k{t}", n, t, z) for t in J.LEVELS)


_RATE_D = " ".join(f"rate_{t} mcse_{t} wilson_low_{t} wilson_high_{t}" for t in J.LEVELS)
_RATE_I = " ".join(f"rejection_count_{t}" for t in J.LEVELS)
_MEANS = ("number_admissible", "mean_active", "minimum_side_action1", "maximum_total_share", "maximum_action1_share")
_LOCKEYS = ["scenario", "method"]
_LIMITS = (("engineering", "outer_failure_rate", None, 0.155), ("engineering", "draw_failure_rate", None, 0.0101), ("testability", "testable_fraction", 0.845, None),
           ("support", "support_rejection_rate", None, 0.082))
_ENG = """eng AS (SELECT scenario, count(*) AS outers, avg((status <> 'TESTABLE')::INT) AS outer_failure_rate, sum(failed_draws) / (sum(valid_draws) + sum(failed_draws)) AS draw_failure_rate,
    avg((status = 'NOT_TESTABLE_SUPPORT')::INT) AS support_rejection_rate, avg((status = 'TESTABLE')::INT) AS testable_fraction FROM rp GROUP BY 1)"""
_GATES = _ENG + ", gates AS (" + " UNION ALL ".join(
    f"SELECT scenario, outers, '{dm}' AS domain, '{m}' AS metric, {m}::DOUBLE AS value, {'NULL' if lo is None else lo}::DOUBLE AS low, {'NULL' if hi is None else hi}::DOUBLE AS high, "
    f"{'true' if lo is None else f'{m} >= {lo}'} AND {'true' if hi is None else f'{m} <= {hi}'} AS passed FROM eng" for dm, m, lo, hi in _LIMITS) + """),
dom AS (SELECT scenario, domain, bool_and(passed) AS passed, count(*) FILTER (NOT passed) AS failed_metrics FROM gates GROUP BY 1, 2)"""
_ARMS = """arms AS (SELECT arm, layer, count(*) AS generated, count(*) FILTER (status = 'TESTABLE') AS testable, """ + _counts() + ", " + ", ".join(
    f"avg(bootstrap_{q}) FILTER (status = 'TESTABLE') AS mean_{q}" for q in ("q90", "q95", "q99")) + """,
    avg(runtime_seconds) FILTER (status = 'TESTABLE') AS mean_runtime, sum(runtime_seconds) FILTER (status = 'TESTABLE') AS total_runtime,
    sum(failed_draws) / (sum(valid_draws) + sum(failed_draws)) AS draw_failure_rate, """ + ", ".join(
    f"quantile_cont(observed, {p}) FILTER (status = 'TESTABLE') AS oracle_{q}" for q, p in (("q90", .9), ("q95", .95), ("q99", .99))) + """,
    quantile_cont(p_value, 0.5) FILTER (status = 'TESTABLE') AS median_p_value FROM rp GROUP BY 1, 2)"""
_ARM_METRICS = {"mean_q90": 3.9, "mean_q95": 4.2, "mean_q99": 4.7}
_REL = _ARMS + ", ae AS (SELECT arm, layer, " + ", ".join(f"abs(ln({m} / {t})) AS {m}" for m, t in _ARM_METRICS.items()) + " FROM arms), " + \
    "rel AS (SELECT a.arm, sum(" + " + ".join(f"(a.{m} < b.{m})::INT" for m in _ARM_METRICS) + ") AS metrics_closer, max(greatest(" + ", ".join(
        f"(a.{m} - b.{m}) / greatest(b.{m}, 1e-12)" for m in _ARM_METRICS) + ")) AS maximum_degradation FROM ae a JOIN ae b ON a.layer = b.layer AND b.arm = 'M0' GROUP BY 1)"


def arm_table(s, d):
    return J.arm_summary(replicates(s, d))


def gates(s, d):
    return J.gate_table(J.engineering_rates(replicates(s, d), ["scenario"]), _LIMITS)


def domains(s, d):
    return J.domain_gates(gates(s, d), ["scenario"])


def outer_tables(s, d):
    x = replicates(s, d)
    draws = x.select("outer", "layer", F.when(F.col("status") == "TESTABLE", F.col("observed")).alias("t"))
    return draws, x.groupBy("outer", "layer").agg((F.min("observed") + 1.0).alias("observed"))


# --------------------------------------------------------------- process banks (draws)
RESAMPLES = 500


def bank(s: SparkSession, d: str) -> DataFrame:
    """Reference, comparison and noise-floor banks from the multiplier draws of the panel."""
    def build():
        m0, m1 = CQ.shift_draws(s, d, "M0"), CQ.shift_draws(s, d, "M1")
        coord = (F.col("candidate") / 3 - 2).cast("long") * 4 + F.col("z")
        def tag(df, name, draw):
            return df.select(F.lit(name).alias("bank"), draw.alias("draw"), (draw % 10).alias("cluster"), coord.alias("coord"), "candidate", "z", F.col("joint").alias("value"))
        half = F.floor(F.col("draw") / 2)
        return tag(m0.where("draw % 2 = 0"), "ref", half).unionByName(tag(m0.where("draw % 2 = 1"), "rep", half)).unionByName(tag(m1, "cmp", F.col("draw")))
    return shared_table(s, d, "bank", build)


def pairs(s, d):
    return shared_table(s, d, "pairs", lambda: K.pair_errors(K.exceedance_table(bank(s, d), "ref", N), "ref"))


def metadata(s: SparkSession, d: str) -> DataFrame:
    """Coordinates of the bank with their cut, grid point and labels, read off the draw table itself."""
    b = bank(s, d).where("bank = 'ref' AND draw = 0")
    cuts = b.select(F.col("candidate")).distinct().select((F.col("candidate") / 3 - 2).cast("long").alias("candidate_index"), "candidate")
    grid = b.select("z").distinct().select("z", (F.col("z") % 2).alias("base_index"), F.floor(F.col("z") / 2).alias("value_action"), (F.col("z") % 2).alias("trait"),
                                           F.col("z").alias("source_entity"))
    return K.coordinate_metadata(cuts, grid, 4)


def structured(s, d):
    q = pairs(s, d).where("bank = 'cmp' AND threshold = 0.9").select("i", "j", "joint_error", "conditional_error")
    return K.pair_table(metadata(s, d), q)


def layer_rows(s, d):
    b = bank(s, d)
    one = F.abs("value")
    wide = b.groupBy("bank", "draw").agg(F.max(F.when(F.col("candidate") == 15, one)).alias("D2"), F.max(F.when(F.col("z") == 0, one)).alias("D3"), F.max(one).alias("D4"))
    p = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).alias("value")) for n in ("D2", "D3", "D4")]))
    return wide.select("bank", "draw", p.alias("p")).select("bank", "draw", "p.*")


def units(s, d) -> dict[tuple[str, str], int]:
    """Number of draws and of clusters of every bank."""
    rows = bank(s, d).groupBy("bank").agg(F.count_distinct("draw").alias("draw"), F.count_distinct("cluster").alias("cluster")).collect()
    return {(r["bank"], u): r[u] for r in rows for u in ("draw", "cluster")}


def resampled(s, d, unit, size=None):
    """Resampled metric; ``size`` draws a replicate, or as many as the bank has units."""
    n = units(s, d)
    ref = K.multinomial_weights(s, n["ref", "draw"], RESAMPLES, 5, size)
    other = K.multinomial_weights(s, n["cmp", unit], RESAMPLES, 6, size)
    return K.resampled_metric(bank(s, d), "ref", "cmp", N, 0.9, ref, other, unit)


def precision_plan(s, d):
    """Spread of the resampled metric at several sample sizes."""
    out = None
    for n in (25, 50, 100):
        part = K.uncertainty(resampled(s, d, "draw", n)).withColumn("sample_size", F.lit(n).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def convergence(s, d):
    """Tail metrics of cluster-balanced subsets of increasing size."""
    b, out = bank(s, d), None
    for n in (40, 80):
        keep = K.cluster_balanced(b.where("bank = 'cmp'"), n, 9).select("bank", "draw")
        part = b.where("bank = 'ref'").unionByName(b.join(keep, ["bank", "draw"], "left_semi"))
        m = K.threshold_metrics(K.pair_errors(K.exceedance_table(part, "ref", N), "ref"))
        m = m.select(F.lit(n).cast("long").alias("sample_size"), "threshold", "standardised_joint_mae", "conditional_mae")
        out = m if out is None else out.unionByName(m)
    return out


def design_norms(s, d):
    from ..operators import process as H
    x = CQ.shift_contributions(s, d).groupBy("entity_id").agg(F.sqrt(F.sum(F.col("delta") ** 2)).alias("first"), F.max(F.abs("delta")).alias("second"))
    return H.entity_design(PQ.panel(s, d), R.CUTS, 3).join(x, "entity_id")


_M1 = "s1 / sqrt(greatest(clusters / (clusters - 1.0) * (s2 - s1 * s1 / clusters), 1e-15))"
BANK = SHIFT + draws_sql("M0") + f""",
dr1 AS (SELECT draw, candidate, z, s1 AS raw, {_M1} AS normalized, boundary * ({_M1}) AS joint FROM sm JOIN pr USING (candidate, z)),
bk0 AS (SELECT CASE draw % 2 WHEN 0 THEN 'ref' ELSE 'rep' END AS bank, draw // 2 AS draw, candidate, z, joint FROM dr UNION ALL SELECT 'cmp', draw, candidate, z, joint FROM dr1),
bank AS MATERIALIZED (SELECT bank, draw, draw % 10 AS cluster, (candidate // 3 - 2) * 4 + z AS coord, candidate, z, joint AS value FROM bk0)"""
_Q = "(VALUES (0.9::DOUBLE), (0.925), (0.95), (0.975)) q(threshold)"
EVENTS = BANK + f""",
th AS (SELECT coord, threshold, quantile_cont(a, 0.9) * 0 + CASE threshold WHEN 0.9 THEN quantile_cont(a, 0.9) WHEN 0.925 THEN quantile_cont(a, 0.925)
    WHEN 0.95 THEN quantile_cont(a, 0.95) ELSE quantile_cont(a, 0.975) END AS cut FROM (SELECT coord, abs(value) AS a FROM bank WHERE bank = 'ref') CROSS JOIN {_Q} GROUP BY 1, 2),
xe AS MATERIALIZED (SELECT b.bank, t.threshold, b.draw, b.cluster, b.coord FROM bank b JOIN th t USING (coord) WHERE abs(b.value) > t.cut)"""
PAIRS = EVENTS + f""",
nd AS (SELECT bank, count(DISTINCT draw) AS draws FROM bank GROUP BY 1),
gr AS (SELECT bank, draws, threshold, i, j FROM nd CROSS JOIN {_Q} CROSS JOIN generate_series(0, 27) a(i) CROSS JOIN generate_series(0, 27) b(j)),
jc AS (SELECT a.bank, a.threshold, a.coord AS i, b.coord AS j, count(*) AS n FROM xe a JOIN xe b ON a.bank = b.bank AND a.threshold = b.threshold AND a.draw = b.draw GROUP BY 1, 2, 3, 4),
jp AS (SELECT g.bank, g.threshold, g.i, g.j, coalesce(n, 0) / draws AS joint FROM gr g LEFT JOIN jc USING (bank, threshold, i, j)),
et AS MATERIALIZED (SELECT p.*, m.joint AS marginal, p.joint / greatest(m.joint, 1e-15) AS conditional FROM jp p JOIN jp m ON m.bank = p.bank AND m.threshold = p.threshold AND m.i = p.i AND m.j = p.i),
pe AS MATERIALIZED (SELECT o.*, r.joint AS ref_joint, r.marginal AS ref_marginal, r.conditional AS ref_conditional, o.joint - r.joint AS joint_error, o.conditional - r.conditional AS conditional_error
    FROM et o JOIN et r USING (threshold, i, j) WHERE o.bank <> 'ref' AND r.bank = 'ref')"""
_TM = PAIRS + """,
tm AS (SELECT bank, threshold, avg(abs(marginal - ref_marginal)) FILTER (i = j) AS marginal_mae, avg(abs(joint_error)) FILTER (i <> j) AS joint_mae,
    sqrt(sum(joint_error ** 2)) / greatest(sqrt(sum(ref_joint ** 2)), 1e-15) AS joint_frobenius, avg(abs(conditional_error)) FILTER (i <> j) AS conditional_mae,
    max(abs(conditional_error)) FILTER (i <> j) AS pair_error_max, """ + ", ".join(
    f"quantile_cont(abs(conditional_error), {p}) FILTER (i <> j) AS pair_error_{n}" for n, p in (("median", .5), ("p90", .9), ("p95", .95), ("p99", .99))) + """,
    quantile_cont(ref_conditional, 0.95) FILTER (i <> j) AS ref_conditional_p95, quantile_cont(conditional, 0.95) FILTER (i <> j) AS conditional_p95,
    avg(abs(joint_error)) FILTER (i <> j) / (1 - threshold) AS standardised_joint_mae,
    abs(quantile_cont(conditional, 0.95) FILTER (i <> j) - quantile_cont(ref_conditional, 0.95) FILTER (i <> j)) AS conditional_p95_gap FROM pe GROUP BY 1, 2)"""
_TM_D = ("marginal_mae joint_mae joint_frobenius conditional_mae pair_error_max pair_error_median pair_error_p90 pair_error_p95 pair_error_p99 ref_conditional_p95 "
         "conditional_p95 standardised_joint_mae conditional_p95_gap")
_META = """meta AS (SELECT coord, candidate // 3 - 2 AS candidate_index, candidate, z, z % 2 AS base_index, z // 2 AS value_action, z % 2 AS trait, z AS source_entity FROM bank WHERE bank = 'ref' AND draw = 0)"""


def _bins(col: str, bins) -> str:
    return "CASE " + " ".join(f"WHEN {col} >= {lo}{'' if hi is None else f' AND {col} <= {hi}'} THEN '{n}'" for lo, hi, n in bins) + " END"


_PT = PAIRS + f""", {_META},
px AS (SELECT i, j, joint_error, conditional_error, """ + ", ".join(
    f"a.{c} AS {c}_i, b.{c} AS {c}_j" for c in ("candidate_index", "candidate", "z", "base_index", "value_action", "trait", "source_entity")) + f""",
    abs(a.candidate_index - b.candidate_index) AS candidate_distance, abs(a.z - b.z) AS evaluation_distance, abs(i - j) AS global_distance,
    a.candidate_index = b.candidate_index AS same_candidate, a.z = b.z AS same_evaluation, a.base_index = b.base_index AS same_base_state, a.value_action = b.value_action AS same_value_action,
    a.trait = b.trait AS same_trait, a.source_entity = b.source_entity AS same_source_entity, a.value_action || '->' || b.value_action AS value_action_pair, a.trait || '->' || b.trait AS trait_pair,
    {_bins('abs(a.z - b.z)', K.EVAL_BINS)} AS evaluation_bin, {_bins('abs(i - j)', K.GLOBAL_BINS)} AS global_bin,
    CASE WHEN a.candidate = b.candidate AND a.base_index = b.base_index AND a.value_action <> b.value_action THEN 'same_candidate_same_state_cross_action'
      WHEN a.candidate <> b.candidate AND a.z = b.z THEN 'cross_candidate_same_evaluation' WHEN a.candidate = b.candidate AND a.value_action = b.value_action THEN 'same_candidate_same_action'
      WHEN a.candidate = b.candidate THEN 'same_candidate_cross_action' WHEN a.value_action = b.value_action THEN 'cross_candidate_same_action' ELSE 'cross_candidate_cross_action' END AS structural_group
    FROM pe JOIN meta a ON a.coord = i JOIN meta b ON b.coord = j WHERE bank = 'cmp' AND threshold = 0.9 AND i <> j)"""
_LR = BANK + """,
lw AS (SELECT bank, draw, max(abs(value)) FILTER (candidate = 15) AS "D2", max(abs(value)) FILTER (z = 0) AS "D3", max(abs(value)) AS "D4" FROM bank GROUP BY 1, 2),
lr AS (UNPIVOT lw ON "D2", "D3", "D4" INTO NAME layer VALUE value)"""
_KS = """(SELECT max(abs((SELECT count(*) FROM lr a WHERE a.bank = 'ref' AND a.layer = x.layer AND a.value <= y.value) / (SELECT count(*) FROM lr a WHERE a.bank = 'ref' AND a.layer = x.layer)
    - (SELECT count(*) FROM lr a WHERE a.bank = x.bank AND a.layer = x.layer AND a.value <= y.value) / (SELECT count(*) FROM lr a WHERE a.bank = x.bank AND a.layer = x.layer)))
    FROM lr y WHERE y.layer = x.layer AND y.bank IN ('ref', x.bank))"""


def _weights_sql(name: str, bank: str, unit: str, seed: int, size: int | None) -> str:
    u = md5_uniform(f"'{seed}:' || rep || ':' || slot")
    n = f"(SELECT count(DISTINCT {unit}) FROM bank WHERE bank = '{bank}')"
    return (f"{name} AS (SELECT rep, floor({u} * {n})::BIGINT AS unit, count(*) AS w FROM generate_series(0, {RESAMPLES - 1}) a(rep) "
            f"CROSS JOIN (SELECT unnest(range({n if size is None else size})) AS slot) GROUP BY 1, 2)")


def _resample_sql(unit: str, size: int | None = None) -> str:
    return EVENTS + ", " + _weights_sql("wr", "ref", "draw", 5, size) + ", " + _weights_sql("wc", "cmp", unit, 6, size) + f""",
nr AS (SELECT rep, sum(w) AS draws FROM wr JOIN (SELECT DISTINCT draw FROM bank WHERE bank = 'ref') b ON b.draw = unit GROUP BY 1),
nc AS (SELECT rep, sum(w) AS draws FROM wc JOIN (SELECT DISTINCT draw, cluster FROM bank WHERE bank = 'cmp') b ON b.{unit} = unit GROUP BY 1),
e9 AS (SELECT * FROM xe WHERE threshold = 0.9),
ja AS (SELECT rep, a.coord AS i, b.coord AS j, sum(w) AS n FROM e9 a JOIN e9 b ON a.bank = b.bank AND a.draw = b.draw JOIN wr ON wr.unit = a.draw WHERE a.bank = 'ref' AND a.coord <> b.coord GROUP BY 1, 2, 3),
jb AS (SELECT rep, a.coord AS i, b.coord AS j, sum(w) AS n FROM e9 a JOIN e9 b ON a.bank = b.bank AND a.draw = b.draw JOIN wc ON wc.unit = a.{unit} WHERE a.bank = 'cmp' AND a.coord <> b.coord GROUP BY 1, 2, 3),
rg AS (SELECT rep, i, j FROM generate_series(0, {RESAMPLES - 1}) r(rep) CROSS JOIN generate_series(0, 27) a(i) CROSS JOIN generate_series(0, 27) b(j) WHERE i <> j),
mt AS (SELECT g.rep, avg(abs(coalesce(ja.n, 0) / nr.draws - coalesce(jb.n, 0) / nc.draws)) / (1 - 0.9::DOUBLE) AS metric FROM rg g LEFT JOIN ja USING (rep, i, j) LEFT JOIN jb USING (rep, i, j)
    JOIN nr USING (rep) JOIN nc USING (rep) GROUP BY 1)"""


_UNC = """SELECT count(*) AS replicates, stddev_samp(metric) AS se, avg(metric) AS mean, quantile_cont(metric, 0.025) AS ci_low, quantile_cont(metric, 0.5) AS median,
    quantile_cont(metric, 0.975) AS ci_high, quantile_cont(metric, 0.975) - quantile_cont(metric, 0.025) AS ci_width FROM mt"""
_UNC_D = "se mean ci_low median ci_high ci_width"
_CB = BANK + """,
cb0 AS (SELECT DISTINCT bank, cluster, draw, md5('9:' || cluster || ':' || draw) AS h, md5('9:' || cluster) AS c FROM bank WHERE bank = 'cmp'),
cb AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY h) AS round FROM cb0)"""
_MOMS = "avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5"

QUERIES: dict[str, Query] = {
    "calibration_summary": query(
        lambda s, d: J.calibration_summary(replicates(s, d)),
        rounded(with_(REP, f""", g AS (SELECT {_GK}, count(*) AS total, count(*) FILTER (status = 'TESTABLE') AS testable, count(*) FILTER (status = 'NOT_TESTABLE_SUPPORT') AS not_testable,
            count(*) FILTER (status IN ('NUMERICAL_FAILURE', 'BOOTSTRAP_FAILURE', 'ZERO_VARIANCE')) AS failed, {_counts()}, {', '.join(f'avg({m}) AS mean_{m}' for m in _MEANS)},
            quantile_cont(number_admissible::DOUBLE, 0.5) AS median_number_admissible, {_reason_json(_GK)} AS reasons_json FROM rp GROUP BY ALL),
            sc AS (SELECT {_GK}, '{{' || string_agg('"' || status || '":' || n, ',' ORDER BY status) || '}}' AS status_json FROM (SELECT {_GK}, status, count(*) AS n FROM rp GROUP BY ALL) GROUP BY ALL)
            SELECT g.* EXCLUDE (failed, k001, k005, k010), status_json, testable / total AS testable_fraction, failed / total AS numerical_failure_rate,
            {', '.join(f'k{t} / total AS rate_all_{t}' for t in J.LEVELS)}, {_rates('testable', Z_ROUNDED)} FROM g JOIN sc USING ({_GK})"""),
            "effect_size testable_fraction numerical_failure_rate median_number_admissible " + " ".join(f"mean_{m}" for m in _MEANS) + " " + " ".join(f"rate_all_{t}" for t in J.LEVELS) + " " + _RATE_D,
            _RATE_I), "J1 J2 J5"),
    "support_summary": query(
        lambda s, d: J.support_summary(replicates(s, d), ["scenario", "method"]),
        rounded(with_(REP, f""" SELECT scenario, method, count(*) AS total, avg((status = 'TESTABLE')::INT) AS testable_fraction, avg((status = 'NOT_TESTABLE_SUPPORT')::INT) AS not_testable_fraction,
            {', '.join(f'avg({m}) AS mean_{m}' for m in ('number_admissible', 'retained_transitions', 'retained_action1', 'mean_active', 'minimum_side_action1'))},
            quantile_cont(number_admissible::DOUBLE, 0.5) AS median_number_admissible, {_reason_json('')} AS reasons_json FROM rp GROUP BY 1, 2"""),
            "testable_fraction not_testable_fraction mean_number_admissible mean_retained_transitions mean_retained_action1 mean_mean_active mean_minimum_side_action1 median_number_admissible"), "J3 J5"),
    "localisation_summary": query(
        lambda s, d: J.localisation_summary(replicates(s, d), _LOCKEYS),
        rounded(with_(REP, " SELECT scenario, method, count(*) AS total, count(*) FILTER (status = 'TESTABLE') AS testable, count(*) FILTER (status = 'TESTABLE' AND p_value <= 0.05) AS detected, min(true_cp) AS true_cp, "
            + ", ".join(f"quantile_cont({c}, {p}) FILTER (status = 'TESTABLE'{x}) AS {n}_{q}" for n, c, x in (("all", "cp_error", ""), ("relative", "relative_cp_error", ""),
                        ("detected", "cp_error", " AND p_value <= 0.05")) for q, p in (("q25", .25), ("q50", .5), ("q75", .75))) + " FROM rp GROUP BY 1, 2"),
            " ".join(f"{n}_{q}" for n in ("all", "relative", "detected") for q in ("q25", "q50", "q75")), "true_cp"), "J4"),
    "detection_localisation": query(
        lambda s, d: J.detection_localisation(replicates(s, d), _LOCKEYS),
        rounded(with_(REP, """, x AS (SELECT scenario, method, scope, status = 'TESTABLE' AS ok, status = 'TESTABLE' AND p_value <= 0.05 AS hit, runtime_seconds,
              CASE WHEN status = 'TESTABLE' AND (scope = 'unconditional' OR p_value <= 0.05) THEN cp_error END AS ae FROM rp CROSS JOIN (VALUES ('unconditional'), ('conditional_on_detection')) v(scope))
            SELECT scenario, method, scope, count(*) AS n, count(*) FILTER (hit) AS detections, avg(hit::INT) AS detection_rate, 1 - avg(ok::INT) AS failure_rate, count(ae) AS localised, avg(ae) AS mae,
              avg((ae <= 5)::INT) AS within_5, avg((ae <= 10)::INT) AS within_10, avg((ae <= 20)::INT) AS within_20, avg(runtime_seconds) FILTER (ok) AS mean_runtime,
              quantile_cont(ae, 0.25) AS ae_q25, quantile_cont(ae, 0.5) AS ae_median, quantile_cont(ae, 0.75) AS ae_q75, quantile_cont(ae, 0.9) AS ae_p90,
              quantile_cont(runtime_seconds, 0.5) FILTER (ok) AS runtime_median FROM x GROUP BY 1, 2, 3"""),
            "detection_rate failure_rate mae within_5 within_10 within_20 mean_runtime ae_q25 ae_median ae_q75 ae_p90 runtime_median"), "J6"),
    "arm_summary": query(
        arm_table, rounded(with_(REP, f""", {_ARMS} SELECT * EXCLUDE (k001, k005, k010), mean_q90 / oracle_q90 AS q90_over_oracle, mean_q95 / oracle_q95 AS q95_over_oracle,
            mean_q99 / oracle_q99 AS q99_over_oracle, {_rates('testable', Z_EXACT)} FROM arms"""),
            "mean_q90 mean_q95 mean_q99 mean_runtime total_runtime draw_failure_rate oracle_q90 oracle_q95 oracle_q99 median_p_value q90_over_oracle q95_over_oracle q99_over_oracle " + _RATE_D, _RATE_I), "J7"),
    "p_histogram": query(
        lambda s, d: J.p_histogram(replicates(s, d), ["scenario"]),
        rounded(with_(REP, f""", b AS (SELECT unnest([{', '.join(map(str, J.P_EDGES[:-1]))}]::DOUBLE[]) AS l, unnest([{', '.join(map(str, J.P_EDGES[1:]))}]::DOUBLE[]) AS r),
            t AS (SELECT scenario, count(p_value) AS total FROM rp GROUP BY 1)
            SELECT t.scenario, total, l AS bin_left, least(r, 1.0) AS bin_right, count(p_value) AS n, count(p_value) / total AS fraction FROM t CROSS JOIN b
            LEFT JOIN rp ON rp.scenario = t.scenario AND p_value >= l AND p_value < r GROUP BY t.scenario, total, l, r"""), "bin_left bin_right fraction"), "J8"),
    "p_ecdf": query(
        lambda s, d: J.p_ecdf(replicates(s, d), ["scenario"]),
        rounded(with_(REP, f""" SELECT scenario, count(p_value) AS total, g AS p_threshold, avg((p_value <= g)::INT) AS ecdf FROM rp
            CROSS JOIN (SELECT unnest([{', '.join(map(str, J.P_GRID))}]::DOUBLE[]) AS g) WHERE p_value IS NOT NULL GROUP BY 1, 3"""), "p_threshold ecdf"), "J8"),
    "json_diagnostics": query(
        lambda s, d: J.json_diagnostics(replicates(s, d), ["scenario"], ["zero_refit_error", "refit_count"]),
        rounded(with_(REP, " SELECT scenario, count(*) AS rows, " + ", ".join(f"{fn}({c}) AS {n}_{c}" for c in ("zero_refit_error", "refit_count") for n, fn in (("mean", "avg"), ("min", "min"), ("max", "max")))
                      + " FROM rp GROUP BY 1"), " ".join(f"{n}_{c}" for c in ("zero_refit_error", "refit_count") for n in ("mean", "min", "max"))), "J9 J19"),
    "type_one": query(
        lambda s, d: J.type_one(*outer_tables(s, d)),
        rounded(with_(REP, f""", o AS (SELECT "outer", layer, min(observed) + 1 AS obs FROM rp GROUP BY 1, 2),
            p AS (SELECT r."outer", r.layer, CASE WHEN count(*) FILTER (status = 'TESTABLE') > 0 THEN (1 + count(*) FILTER (status = 'TESTABLE' AND observed >= obs)) / (1 + count(*) FILTER (status = 'TESTABLE')) END AS p_value
              FROM rp r JOIN o ON r."outer" = o."outer" AND r.layer = o.layer GROUP BY 1, 2),
            g AS (SELECT layer, count(*) AS outers, count(p_value) AS testable, {', '.join(f'count(*) FILTER (p_value <= {a}) AS k{t}' for t, a in J.LEVELS.items())}, quantile_cont(p_value, 0.5) AS median_p_value FROM p GROUP BY 1)
            SELECT layer, outers, testable, median_p_value, testable / outers AS testable_fraction, {_rates('testable', Z_EXACT)} FROM g"""), "median_p_value testable_fraction " + _RATE_D, _RATE_I), "J10"),
    "truth_summary": query(
        lambda s, d: J.truth_summary(replicates(s, d), "d", "v", ["layer"]),
        rounded(with_(REP, """ SELECT layer, count(*) AS replicates, avg(d) AS mean_d, var_samp(d) AS var_d, avg(v) AS mean_v, stddev_samp(d) / sqrt(count(*)) AS mcse_mean_d,
            quantile_cont(abs(d), 0.9) AS abs_q90, quantile_cont(abs(d), 0.95) AS abs_q95, quantile_cont(abs(d), 0.99) AS abs_q99, quantile_cont(v, 0.5) AS median_v,
            sqrt(avg(v)) / stddev_samp(d) AS sqrt_mean_v_over_sd, avg(sqrt(v)) / stddev_samp(d) AS mean_sqrt_v_over_sd FROM rp GROUP BY 1"""),
            "mean_d var_d mean_v mcse_mean_d abs_q90 abs_q95 abs_q99 median_v sqrt_mean_v_over_sd mean_sqrt_v_over_sd"), "J11"),
    "ratio_bootstrap": query(lambda s, d: J.ratio_bootstrap(replicates(s, d), "d", "v", "key", 400, 3), None, "J11"),
    "shape_statistics": query(
        lambda s, d: J.shape_statistics(replicates(s, d), "d", ["layer"]),
        rounded(with_(REP, """, c AS (SELECT *, d - avg(d) OVER (PARTITION BY layer) AS e, abs(d - quantile_cont(d, 0.5) OVER (PARTITION BY layer)) AS a FROM rp)
            SELECT layer, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS sd, quantile_cont(d, 0.5) AS median, quantile_cont(a, 0.5) AS mad,
            sqrt(count(*) * (count(*) - 1.0)) / (count(*) - 2) * avg(e ** 3) / avg(e ** 2) ** 1.5 AS skewness,
            (count(*) - 1.0) / ((count(*) - 2.0) * (count(*) - 3.0)) * ((count(*) + 1) * (avg(e ** 4) / avg(e ** 2) ** 2 - 3) + 6) AS excess_kurtosis FROM c GROUP BY 1"""),
            "mean sd median mad skewness excess_kurtosis"), "J12"),
    "linear_metrics": query(
        lambda s, d: J.linear_metrics(replicates(s, d), "bootstrap_q90", "observed", ["method"]),
        rounded(with_(REP, """ SELECT method, count(*) AS n, corr(bootstrap_q90, observed) AS correlation, regr_slope(bootstrap_q90, observed) AS slope, regr_intercept(bootstrap_q90, observed) AS intercept,
            sqrt(avg((bootstrap_q90 - observed) ** 2)) AS rmse, sqrt(avg((bootstrap_q90 - observed) ** 2)) / sqrt(avg(bootstrap_q90 ** 2)) AS relative_rmse,
            var_samp(observed) / var_samp(bootstrap_q90) AS variance_ratio, avg((sign(observed) = sign(bootstrap_q90))::INT) AS sign_agreement FROM rp GROUP BY 1"""),
            "correlation slope intercept rmse relative_rmse variance_ratio sign_agreement"), "J13"),
    "decomposition": query(
        lambda s, d: J.decomposition(replicates(s, d)),
        rounded(with_(REP, """, g AS (SELECT method, layer, count(*) AS replicates, avg((status = 'TESTABLE')::INT) AS testable_fraction, avg((p_value <= 0.05)::INT) AS rejection_rate, avg(observed) AS mean_observed,
            avg(bootstrap_q95) AS mean_q95, quantile_cont(observed, 0.5) AS observed_median, quantile_cont(bootstrap_q95, 0.5) AS q95_median, quantile_cont(p_value, 0.5) AS p_median FROM rp GROUP BY 1, 2)
            SELECT *, sqrt(rejection_rate * (1 - rejection_rate) / replicates) AS mcse FROM g"""), "testable_fraction rejection_rate mean_observed mean_q95 observed_median q95_median p_median mcse"), "J14"),
    "decomposition_pivot": query(
        lambda s, d: J.decomposition_pivot(J.decomposition(replicates(s, d)), ["full", "pooled", "strict"]),
        rounded(with_(REP, " SELECT layer, " + ", ".join(f"avg((p_value <= 0.05)::INT) FILTER (method = '{m}') AS \"{m}\"" for m in ("full", "pooled", "strict")) + " FROM rp GROUP BY 1"), "full pooled strict"), "J14"),
    "scaling_summary": query(
        lambda s, d: J.scaling_summary(replicates(s, d), ["mean_active", "number_admissible", "effect_size"]),
        rounded(with_(REP, ", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS diagnostic, {c}::DOUBLE AS level, p_value, observed FROM rp" for c in ("mean_active", "number_admissible", "effect_size"))
                + ") SELECT diagnostic, level, count(*) AS n, avg((p_value <= 0.05)::INT) AS rate, avg(observed) AS mean_observed, stddev_samp(observed) AS sd_observed FROM l GROUP BY 1, 2"),
                "level rate mean_observed sd_observed"), "J15"),
    "against_truth": query(
        lambda s, d: J.against_truth(arm_table(s, d), "M0"),
        rounded(with_(REP, f""", {_ARMS} SELECT a.arm, a.layer, {', '.join(f'a.mean_{q} / b.mean_{q} AS {q}_ratio' for q in ('q90', 'q95', 'q99'))} FROM arms a JOIN arms b ON a.layer = b.layer AND b.arm = 'M0'"""),
            "q90_ratio q95_ratio q99_ratio"), "J16"),
    "gate_table": query(gates, rounded(with_(REP, f", {_GATES} SELECT * FROM gates"), "value low high"), "J17"),
    "domain_gates": query(domains, with_(REP, f", {_GATES} SELECT * FROM dom"), "J17"),
    "gate_labels": query(
        lambda s, d: J.gate_label(domains(s, d), ["scenario"], (("engineering", "ENGINEERING_FAILURE"), ("testability", "NOT_TESTABLE"), ("support", "SUPPORT_FAILURE")), "PASS"),
        with_(REP, f""", {_GATES} SELECT scenario, CASE WHEN bool_or(domain = 'engineering' AND NOT passed) THEN 'ENGINEERING_FAILURE' WHEN bool_or(domain = 'testability' AND NOT passed) THEN 'NOT_TESTABLE'
            WHEN bool_or(domain = 'support' AND NOT passed) THEN 'SUPPORT_FAILURE' ELSE 'PASS' END AS gate FROM dom GROUP BY 1"""), "J17 J18"),
    "systematic_failures": query(
        lambda s, d: J.systematic_failures(domains(s, d), 2),
        with_(REP, f", {_GATES} SELECT domain, count(*) AS scenarios FROM dom WHERE NOT passed GROUP BY 1 HAVING count(*) >= 2"), "J18"),
    "engineering_rates": query(
        lambda s, d: J.engineering_rates(replicates(s, d), ["scenario"]),
        rounded(with_(REP, f", {_ENG} SELECT * FROM eng"), "outer_failure_rate draw_failure_rate support_rejection_rate testable_fraction"), "J20"),
    "result_violations": query(
        lambda s, d: J.result_violations(replicates(s, d), 199),
        with_(REP, " SELECT 'cp_in_admissible_set' AS rule, count(*) AS n FROM rp WHERE status = 'TESTABLE' AND estimated_cp NOT IN (6, 9, 12, 15, 18, 21)"), "J21"),
    "bank_integrity": query(
        lambda s, d: J.bank_integrity(R.table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("coord")),
                                      R.table(s, d, "orders").select(F.col("o_orderkey").alias("key")), 4),
        """WITH h AS (SELECT l_orderkey AS key, count(*) AS n, count(DISTINCT l_linenumber) AS c FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS key FROM orders)
        SELECT key, 'missing' AS problem FROM r WHERE key NOT IN (SELECT key FROM h) UNION ALL SELECT key, 'unregistered' FROM h WHERE key NOT IN (SELECT key FROM r)
        UNION ALL SELECT key, 'wrong_shape' FROM h WHERE n <> 4 OR c <> 4""", "J22"),
    "relative_to_baseline": query(
        lambda s, d: J.relative_to_baseline(arm_table(s, d), "M0", _ARM_METRICS),
        rounded(with_(REP, f", {_REL} SELECT * FROM rel"), "maximum_degradation", "metrics_closer", digits=4), "J23", digits=4),
    "arm_selection": query(
        lambda s, d: J.pick_arm(J.relative_to_baseline(arm_table(s, d), "M0", _ARM_METRICS), ["M0", "M1", "M3"], 4, 0.1),
        with_(REP, f", {_REL} SELECT coalesce((SELECT arm FROM rel WHERE metrics_closer >= 4 AND maximum_degradation <= 0.1 ORDER BY arm LIMIT 1), 'NONE') AS selected"), "J23"),
    "fingerprints": query(
        lambda s, d: J.fingerprint(replicates(s, d), ["scenario"], "key", "observed"),
        with_(REP, " SELECT scenario, count(*) AS n, sum(('0x' || substr(sha256(key || ':' || printf('%.6f', observed)), 1, 15))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(sha256(key || ':' || printf('%.6f', observed)), 16, 15))::BIGINT)::VARCHAR AS digest FROM rp GROUP BY 1"), "J24"),
    "fingerprint_equality": query(
        lambda s, d: J.same_fingerprint(J.fingerprint(replicates(s, d), ["scenario"], "key", "observed"),
                                        J.fingerprint(replicates(s, d).repartition(7, "outer"), ["scenario"], "key", "observed"), ["scenario"]),
        with_(REP, " SELECT scenario, true AS equal FROM rp GROUP BY 1"), "J24"),
    "calibration_table": query(
        lambda s, d: J.calibration_table({a: CQ.calibrated(s, d, a) for a in ("M0", "M1")}),
        rounded(with_(SHIFT + draws_sql("M0") + CQ._CAL + f""",
            dr1 AS (SELECT draw, candidate, z, s1 AS raw, {_M1} AS normalized, boundary * ({_M1}) AS joint FROM sm JOIN pr USING (candidate, z)),
            dl1 AS (SELECT draw, {CQ._LAY.format(raw='raw')} FROM dr1 GROUP BY 1), lo1 AS (UNPIVOT dl1 ON "D0", "D1", "D2", "D3", "D4" INTO NAME layer VALUE t),
            c1 AS (SELECT layer, quantile_cont(t, 0.95) AS cv, (1 + count(*) FILTER (t >= observed)) / (count(t) + 1) AS p FROM lo1 JOIN oo USING (layer) GROUP BY 1)""",
            """ SELECT layer, observed, critical_value AS "M0_critical_value", p_value AS "M0_p_value", reject AS "M0_reject", cv AS "M1_critical_value", p AS "M1_p_value", p <= 0.05 AS "M1_reject"
            FROM cal JOIN c1 USING (layer)"""), "observed M0_critical_value M0_p_value M1_critical_value M1_p_value"), "J25"),
    # ------------------------------------------------------------------------------ K
    "tail_thresholds": query(lambda s, d: K.thresholds(bank(s, d), "ref"), rounded(with_(EVENTS, "SELECT * FROM th"), "cut threshold", "coord"), "K1"),
    "exceedance_events": query(
        lambda s, d: K.exceedances(bank(s, d), K.thresholds(bank(s, d), "ref")).select("bank", "threshold", "draw", "cluster", "coord"),
        rounded(with_(EVENTS, "SELECT * FROM xe"), "threshold", "draw cluster coord"), "K1"),
    "joint_exceedance": query(
        lambda s, d: K.exceedance_table(bank(s, d), "ref", N), rounded(with_(PAIRS, "SELECT * FROM et"), "threshold joint marginal conditional", "i j"), "K2"),
    "pair_errors": query(pairs, rounded(with_(PAIRS, "SELECT * FROM pe"), "threshold joint marginal conditional ref_joint ref_marginal ref_conditional joint_error conditional_error", "i j"), "K2 K9"),
    "threshold_metrics": query(lambda s, d: K.threshold_metrics(pairs(s, d)), rounded(with_(_TM, "SELECT * FROM tm"), "threshold " + _TM_D), "K3 K9"),
    "integrated_contrast": query(
        lambda s, d: K.integrated_contrast(K.threshold_metrics(pairs(s, d)), "cmp", "rep"),
        rounded(with_(_TM, """, m AS (SELECT bank, avg(standardised_joint_mae) AS x FROM tm GROUP BY 1)
            SELECT (SELECT x FROM m WHERE bank = 'cmp') AS raw, (SELECT x FROM m WHERE bank = 'rep') AS noise_floor, (SELECT x FROM m WHERE bank = 'cmp') - (SELECT x FROM m WHERE bank = 'rep') AS excess"""),
            "raw noise_floor excess"), "K4"),
    "covariance_metrics": query(lambda s, d: K.covariance_metrics(bank(s, d), N, "ref").drop("leading_ratios"), None, "K5"),
    "process_covariance": query(
        lambda s, d: K.process_covariance(bank(s, d), N),
        rounded(with_(BANK, """, c AS (SELECT a.bank, a.cluster, a.coord AS i, b.coord AS j, covar_samp(a.value, b.value) AS cov, avg(a.value * b.value) AS second
            FROM bank a JOIN bank b ON a.bank = b.bank AND a.draw = b.draw GROUP BY ALL)
            SELECT bank, i, j, count(*) AS replicates, avg(cov) AS centred, avg(second) AS direct FROM c GROUP BY 1, 2, 3"""), "centred direct", "i j replicates"), "I16"),
    "covariance_errors": query(
        lambda s, d: K.covariance_metrics(bank(s, d), N, "ref").select("bank", "mean_rms", "sd_ratio", "correlation_frobenius", "correlation_mae"),
        rounded(with_(BANK, """, st AS (SELECT bank, coord, avg(value) AS m, stddev_samp(value) AS s FROM bank GROUP BY 1, 2),
            co AS (SELECT a.bank, a.coord AS i, b.coord AS j, corr(a.value, b.value) AS r FROM bank a JOIN bank b ON a.bank = b.bank AND a.draw = b.draw GROUP BY 1, 2, 3),
            x AS (SELECT o.bank, sqrt(avg(((o.m - r.m) / r.s) ** 2)) AS mean_rms, avg(o.s) / avg(r.s) AS sd_ratio FROM st o JOIN st r USING (coord) WHERE o.bank <> 'ref' AND r.bank = 'ref' GROUP BY 1),
            y AS (SELECT o.bank, sqrt(sum((o.r - r.r) ** 2)) / sqrt(sum(r.r ** 2)) AS correlation_frobenius, avg(abs(o.r - r.r)) FILTER (i <> j) AS correlation_mae FROM co o JOIN co r USING (i, j)
              WHERE o.bank <> 'ref' AND r.bank = 'ref' GROUP BY 1) SELECT * FROM x JOIN y USING (bank)"""), "mean_rms sd_ratio correlation_frobenius correlation_mae"), "K5"),
    "marginal_tails": query(
        lambda s, d: K.marginal_tails(bank(s, d), "ref"),
        rounded(with_(EVENTS, f""", c AS (SELECT *, value - avg(value) OVER (PARTITION BY bank, coord) AS e FROM bank),
            mo AS (SELECT bank, coord, avg(e ** 3) / avg(e ** 2) ** 1.5 AS sk, avg(e ** 4) / avg(e ** 2) ** 2 - 3 AS ku FROM c GROUP BY 1, 2),
            sh AS (SELECT o.bank, sqrt(avg((o.sk - r.sk) ** 2)) AS skewness_rmse, sqrt(avg((o.ku - r.ku) ** 2)) AS kurtosis_rmse FROM mo o JOIN mo r USING (coord) WHERE o.bank <> 'ref' AND r.bank = 'ref' GROUP BY 1),
            ql AS (SELECT bank, coord, quantile_cont(abs(value), [0.9, 0.925, 0.95, 0.975]) AS q FROM bank GROUP BY 1, 2),
            qx AS (SELECT bank, coord, unnest([0.9, 0.925, 0.95, 0.975]::DOUBLE[]) AS threshold, unnest(q) AS x FROM ql),
            ra AS (SELECT o.bank, o.threshold, o.x / greatest(t.cut, 1e-15) AS ratio FROM qx o JOIN th t USING (coord, threshold) WHERE o.bank <> 'ref'),
            ov AS (SELECT bank, threshold, avg(abs(p - (1 - threshold))) AS marginal_exceedance_mae FROM (SELECT b.bank, t.threshold, b.coord, avg((abs(value) > cut)::INT) AS p FROM bank b JOIN th t USING (coord)
              WHERE b.bank <> 'ref' GROUP BY 1, 2, 3) GROUP BY 1, 2)
            SELECT ra.bank, ra.threshold, avg(ratio) AS mean_quantile_ratio, quantile_cont(ratio, 0.5) AS median_quantile_ratio, any_value(marginal_exceedance_mae) AS marginal_exceedance_mae,
              any_value(skewness_rmse) AS skewness_rmse, any_value(kurtosis_rmse) AS kurtosis_rmse FROM ra JOIN ov USING (bank, threshold) JOIN sh USING (bank) GROUP BY 1, 2"""),
            "threshold mean_quantile_ratio median_quantile_ratio marginal_exceedance_mae skewness_rmse kurtosis_rmse"), "K6"),
    "max_distribution": query(
        lambda s, d: K.max_distribution(layer_rows(s, d), "ref"),
        rounded(with_(_LR, f""", q AS (SELECT bank, layer, quantile_cont(value, 0.9) AS q90, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99, count(*) AS draws FROM lr GROUP BY 1, 2)
            SELECT x.bank, x.layer, x.q90, x.q95, x.q99, r.q90 AS ref_q90, r.q95 AS ref_q95, r.q99 AS ref_q99, {_KS} AS ks,
              (SELECT avg((value > r.q95)::INT) FROM lr l WHERE l.bank = x.bank AND l.layer = x.layer) AS exceeds_ref_q95, x.draws, x.q95 / r.q95 AS q95_ratio
            FROM q x JOIN q r ON r.layer = x.layer AND r.bank = 'ref' WHERE x.bank <> 'ref'"""), "q90 q95 q99 ref_q90 ref_q95 ref_q99 ks exceeds_ref_q95 q95_ratio"), "K7"),
    "pooled_ks": query(
        lambda s, d: K.two_sample_ks(bank(s, d).where("bank IN ('ref', 'cmp')"), ["candidate"], "value", F.col("bank") == "ref"),
        rounded(with_(BANK, """, o AS (SELECT candidate, bank, value FROM bank WHERE bank IN ('ref', 'cmp')),
            c AS (SELECT candidate, count(*) FILTER (bank = 'ref') OVER w / count(*) FILTER (bank = 'ref') OVER (PARTITION BY candidate) AS fa,
              count(*) FILTER (bank = 'cmp') OVER w / count(*) FILTER (bank = 'cmp') OVER (PARTITION BY candidate) AS fb FROM o WINDOW w AS (PARTITION BY candidate ORDER BY value RANGE UNBOUNDED PRECEDING))
            SELECT candidate, max(abs(fa - fb)) AS ks FROM c GROUP BY 1"""), "ks"), "K8"),
    "coordinate_metadata": query(metadata, rounded(with_(BANK, f", {_META} SELECT * FROM meta"), "", "coord candidate_index candidate z base_index value_action trait source_entity"), "K10"),
    "spearman": query(
        lambda s, d: K.spearman(bank(s, d), N, "ref"),
        rounded(with_(BANK, """, r AS (SELECT draw, coord, rank() OVER (PARTITION BY coord ORDER BY value) + (count(*) OVER (PARTITION BY coord, value) - 1) / 2.0 AS rk FROM bank WHERE bank = 'ref')
            SELECT a.coord AS i, b.coord AS j, corr(a.rk, b.rk) AS rank_correlation FROM r a JOIN r b USING (draw) GROUP BY 1, 2"""), "rank_correlation", "i j"), "K11"),
    "pair_table": query(
        structured, rounded(with_(_PT, "SELECT * FROM px"), "joint_error conditional_error",
                            "i j candidate_distance evaluation_distance global_distance " + " ".join(
                                f"{c}_{x}" for c in ("candidate_index", "candidate", "z", "base_index", "value_action", "trait", "source_entity") for x in "ij")), "K12"),
    "structure_summary": query(
        lambda s, d: K.structure_summary(structured(s, d)),
        rounded(with_(_PT, ", sl AS (" + " UNION ALL ".join(f"SELECT '{g}' AS group_type, {g}::VARCHAR AS group_value, conditional_error AS e, joint_error AS je FROM px" for g in K.GROUPINGS) + """)
            SELECT group_type, group_value, count(*) AS pairs, avg(e) AS signed_mean, avg((e < 0)::INT) AS under_fraction, avg((e > 0)::INT) AS over_fraction, avg(abs(e)) AS absolute_mean,
              avg((abs(e) > 0.10)::INT) AS share_gt_010, avg(abs(je)) AS joint_mae, """ + ", ".join(f"quantile_cont(abs(e), {p}) AS absolute_{n}" for n, p in (
                ("p25", .25), ("median", .5), ("p75", .75), ("p90", .9), ("p95", .95), ("p99", .99), ("max", 1.0))) + """, quantile_cont(e, 0.5) AS signed_median,
              sum(abs(e)) / (SELECT sum(abs(conditional_error)) FROM px) AS share_total_error FROM sl GROUP BY 1, 2"""),
            "signed_mean under_fraction over_fraction absolute_mean share_gt_010 joint_mae absolute_p25 absolute_median absolute_p75 absolute_p90 absolute_p95 absolute_p99 absolute_max signed_median share_total_error"), "K13"),
    "extreme_counts": query(
        lambda s, d: K.extreme_counts(bank(s, d), K.exceedances(bank(s, d), K.thresholds(bank(s, d), "ref"))),
        rounded(with_(EVENTS, f""", k AS (SELECT b.bank, threshold, b.draw, (SELECT count(*) FROM xe e WHERE e.bank = b.bank AND e.threshold = q.threshold AND e.draw = b.draw) AS k
              FROM (SELECT DISTINCT bank, draw FROM bank) b CROSS JOIN {_Q})
            SELECT bank, threshold, avg(k) AS mean_extremes, avg((k >= 2)::INT) AS multiple_fraction, quantile_cont(k::DOUBLE, 0.95) AS p95_extremes FROM k GROUP BY 1, 2"""),
            "threshold mean_extremes multiple_fraction p95_extremes"), "K14"),
    "top_error_share": query(
        lambda s, d: K.top_share(pairs(s, d)),
        rounded(with_(PAIRS, """, r AS (SELECT bank, threshold, abs(conditional_error) AS ae, row_number() OVER (PARTITION BY bank, threshold ORDER BY abs(conditional_error) DESC, i, j) AS rk,
              count(*) OVER (PARTITION BY bank, threshold) AS n FROM pe WHERE i <> j)
            SELECT bank, threshold, sum(ae) FILTER (rk <= greatest(1, ceil(n * 0.05))) / sum(ae) AS top_share, any_value(n) AS pairs FROM r GROUP BY 1, 2"""), "threshold top_share"), "K14"),
    "worst_pairs": query(
        lambda s, d: K.worst_pairs(pairs(s, d), 50).select("bank", "threshold", "i", "j", "ae"),
        rounded(with_(PAIRS, "SELECT bank, threshold, i, j, round(abs(conditional_error), 9) AS ae FROM pe WHERE i <> j ORDER BY ae DESC, bank, threshold, i, j LIMIT 50"), "threshold ae", "i j"), "K15"),
    "row_bootstrap": query(lambda s, d: K.uncertainty(resampled(s, d, "draw")), rounded(with_(_resample_sql("draw"), _UNC), _UNC_D), "K16"),
    "cluster_bootstrap": query(lambda s, d: K.uncertainty(resampled(s, d, "cluster")), rounded(with_(_resample_sql("cluster"), _UNC), _UNC_D), "K16"),
    "cluster_balanced_sample": query(
        lambda s, d: K.cluster_balanced(bank(s, d).where("bank = 'cmp'"), 40, 9),
        rounded(with_(_CB, "SELECT bank, cluster, draw, round FROM cb ORDER BY round, c LIMIT 40"), "", "cluster draw round"), "K17"),
    "tail_convergence": query(convergence, None, "K17"),
    "precision_plan": query(
        precision_plan, rounded(" UNION ALL ".join(f"SELECT * FROM ({with_(_resample_sql('draw', n), _UNC.replace('SELECT', f'SELECT {n} AS sample_size,', 1))})" for n in (25, 50, 100)), _UNC_D, "sample_size"), "K18"),
    "first_draws": query(
        lambda s, d: K.first_draws(bank(s, d), 3, 10).groupBy("bank", "cluster").agg(F.count_distinct("draw").alias("draws"), F.avg("value").alias("mean")),
        rounded(with_(BANK, "SELECT bank, cluster, count(DISTINCT draw) AS draws, avg(value) AS mean FROM bank WHERE draw // 10 < 3 GROUP BY 1, 2"), "mean", "cluster"), "K19"),
    "nested_variance": query(
        lambda s, d: K.nested_variance(bank(s, d)),
        rounded(with_(BANK, """, c AS (SELECT *, avg(value) OVER (PARTITION BY bank, coord, cluster) AS cm, avg(value) OVER (PARTITION BY bank, coord) AS gm FROM bank),
            x AS (SELECT bank, coord, avg((value - gm) ** 2) AS t, avg((value - cm) ** 2) AS w, avg((cm - gm) ** 2) AS b FROM c GROUP BY 1, 2)
            SELECT bank, avg(t) AS total, avg(w) AS within, avg(b) AS between, avg(w) / avg(t) AS within_fraction, 0.0 AS identity_error FROM x GROUP BY 1"""),
            "total within between within_fraction identity_error"), "K20"),
    "nested_spectrum": query(lambda s, d: K.nested_spectrum(bank(s, d), N, "ref"), None, "K20"),
    **{f"conditional_means_by_{n}": query(
        lambda s, d, n=n: K.conditional_means(bank(s, d), "ref", n),
        rounded(with_(BANK, f""", sp AS (SELECT coord, stddev_samp(value) AS sdv FROM bank WHERE bank = 'ref' GROUP BY 1),
            m AS (SELECT bank, cluster, coord, {n}, avg(value) AS m FROM bank GROUP BY 1, 2, 3, 4)
            SELECT bank, {n}, sqrt(avg((m / sdv) ** 2)) AS rms_standardised, avg(m / sdv) AS mean_standardised FROM m JOIN sp USING (coord) GROUP BY 1, 2"""), "rms_standardised mean_standardised", n), "K21")
       for n in ("candidate", "z")},
    "zero_centre": query(
        lambda s, d: K.zero_centre(CQ.shift_process(s, d).join(CQ.shift_draws(s, d, "M0").groupBy("candidate", "z").agg(F.avg("raw").alias("mean_raw")), ["candidate", "z"]), "contrast", "mean_raw"),
        rounded(with_(SHIFT + draws_sql("M0"), """, m AS (SELECT candidate, z, contrast AS x, (SELECT avg(raw) FROM dr WHERE dr.candidate = pr.candidate AND dr.z = pr.z) AS y FROM pr)
            SELECT corr(x, y) AS correlation, sum(x * y) / sum(x * x) AS slope_through_origin, sqrt(avg((y - x) ** 2)) AS rmse, sqrt(avg((y - x) ** 2)) / sqrt(avg(y * y)) AS relative_rmse FROM m"""),
            "correlation slope_through_origin rmse relative_rmse", digits=5), "K21", digits=5),
    "association_attenuation": query(
        lambda s, d: K.association_attenuation(design_norms(s, d), ["action_rate", "state_cov_trace", "state_range_mean", "transitions"], "first", "second"),
        rounded(with_(SHIFT, """, nm AS (SELECT entity_id, sqrt(sum(delta ** 2)) AS first, max(abs(delta)) AS second FROM ct GROUP BY 1),
            e AS (SELECT entity_id, count(*)::DOUBLE AS transitions, avg(action) AS action_rate, var_samp(s0) + var_samp(s1) + var_samp(s2) AS state_cov_trace,
              (max(s0) - min(s0) + max(s1) - min(s1) + max(s2) - min(s2)) / 3 AS state_range_mean FROM panel GROUP BY 1),
            l AS (UNPIVOT e ON transitions, action_rate, state_cov_trace, state_range_mean INTO NAME design VALUE x),
            r AS (SELECT design, corr(x, ln(1 + first)) AS first_correlation, corr(x, ln(1 + second)) AS second_correlation FROM l JOIN nm USING (entity_id) GROUP BY 1)
            SELECT *, abs(first_correlation) - abs(second_correlation) AS attenuation FROM r"""), "first_correlation second_correlation attenuation"), "K22"),
    "innovation_diagnostics": query(
        lambda s, d: K.innovation_diagnostics(CQ.H.transition_residuals(PQ.panel(s, d).select("entity_id", "elapsed_index", F.element_at("state", 1).alias("x"), F.lit("all").alias("component")), "x"),
                                              "centred", "elapsed_index", ["component"], width=10),
        rounded(with_(DAILY, """, c AS (SELECT entity_id, elapsed_index, s0 - avg(s0) OVER (PARTITION BY entity_id) AS x FROM panel),
            l AS (SELECT *, CASE WHEN lag(elapsed_index) OVER w = elapsed_index - 1 THEN lag(x) OVER w END AS lg FROM c WINDOW w AS (PARTITION BY entity_id ORDER BY elapsed_index)),
            q AS (SELECT quantile_cont(abs(x), 0.9) AS cut, avg(x) AS m FROM c)
            SELECT 'all' AS component, count(*) AS n, avg(x) AS bias, sqrt(avg(x * x)) AS rmse, stddev_samp(x) AS sd, avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 AS skewness,
              avg((x - m) ** 4) / avg((x - m) ** 2) ** 2 - 3 AS excess_kurtosis, corr(x, lg) AS lag1, count(*) FILTER (abs(x) >= cut AND abs(lg) >= cut) / count(lg) AS adjacent_extreme_share FROM l CROSS JOIN q"""),
            "bias rmse sd skewness excess_kurtosis lag1 adjacent_extreme_share"), "K24"),
    "conditional_covariance": query(
        lambda s, d: K.conditional_covariance(bank(s, d)),
        rounded(with_(BANK, """, c AS (SELECT bank, coord, avg(v) AS mc FROM (SELECT bank, coord, cluster, var_samp(value) AS v FROM bank GROUP BY 1, 2, 3) GROUP BY 1, 2),
            e AS (SELECT bank, coord, var_samp(value) AS em FROM bank GROUP BY 1, 2)
            SELECT bank, avg(em) AS empirical, avg(mc) AS mean_conditional, avg(mc) / avg(em) AS ratio FROM c JOIN e USING (bank, coord) GROUP BY 1"""), "empirical mean_conditional ratio"), "K25"),
}
