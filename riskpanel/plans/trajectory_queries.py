"""Registered queries: causal features, transitions, segments and descriptive quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as C
from ..operators import qc as E
from ..operators import transitions as T
from ..params import FEATURES
from ..session import shared_table
from . import gap_queries as GQ
from . import roles as R
from .registry import NUDGE, Query, query, rounded
from .sql import EDGES, mins, with_

P = R.FEATURES_RULE
MACRO_MIN = 2160.0
MACRO_BOUNDS = (600.0, 3600.0)


def features(s: SparkSession, d: str) -> DataFrame:
    return shared_table(s, d, "features", lambda: C.state_features(
        GQ.steps(s, d), R.actions(s, d), R.exposures(s, d), R.schedule(s, d), R.overrides(s, d), P))


def cells(s: SparkSession, d: str) -> DataFrame:
    return shared_table(s, d, "transitions", lambda: T.transitions(
        features(s, d), R.actions(s, d), R.exposures(s, d), R.GAPS, P, R.REWARD))


def macro(s: SparkSession, d: str) -> DataFrame:
    return shared_table(s, d, "three_step", lambda: T.subsample(
        cells(s, d), 3, MACRO_BOUNDS, MACRO_MIN, R.REWARD, R.CHUNK_MIN))


def timing(s: SparkSession, d: str) -> DataFrame:
    info = E.information_events(R.observations(s, d), R.exposures(s, d), R.schedule(s, d), R.overrides(s, d), R.context(s, d))
    return shared_table(s, d, "action_timing", lambda: E.action_timing(
        cells(s, d), R.actions(s, d), info, R.exposures(s, d), R.CHUNK_MIN, unit_min=120.0))


def meta(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d)
    return T.build_metadata(R.observations(s, d), c, c, 1)


def stacked(s: SparkSession, d: str) -> DataFrame:
    cols = ["entity_id", "split", "interval_min", "segment_id", "tau_t", "tau_next", "duration_min", "valid", "action",
            "action_count", "reward_binary", "reward_weighted"]
    return cells(s, d).select(*cols).unionByName(macro(s, d).select(*cols))


def strata() -> dict:
    return {
        "value": E.left_closed(F.col("raw__value_current"), (10, 20, 70, 100), ("<10", "10-19", "20-69", "70-99", ">=100")),
        "exposure_recency_min": E.left_closed(F.col("raw__since_exposure"), (1440, 2880, 7200), ("0-1d", "1-2d", "2-5d", "capped")),
        "residual_exposure": E.left_closed(F.col("raw__residual_exposure"), (0.01, 10, 30, 60), ("~0", "0-9", "10-29", "30-59", ">=60")),
        "time_of_day": E.left_closed(F.hour("tau_t"), (6, 12, 18), ("00-05", "06-11", "12-17", "18-23")),
    }


def fixed_scores(s: SparkSession, d: str) -> DataFrame:
    """A deterministic logistic score of the state, used where the fit itself is not under test."""
    z = F.col("raw__value_current") / 50.0 - F.col("raw__since_action") / 3600.0 + F.col("raw__time_of_day_sin") / 2.0
    return cells(s, d).where("valid").select(
        "entity_id", "split", "tau_t", "action", F.round(1.0 / (1.0 + F.exp(-z)), 4).alias("propensity"))


def fitted_scores(s: SparkSession, d: str) -> DataFrame:
    flat = C.scale_state(cells(s, d).where("valid"), P, "raw__", "state__")
    return shared_table(s, d, "propensity", lambda: E.propensity_scores(flat, [f"state__{f}" for f in FEATURES]))


def fit_equations(s: SparkSession, d: str) -> DataFrame:
    flat = C.scale_state(cells(s, d).where("valid"), P, "raw__", "state__").select("entity_id", "split", "tau_t", "action", *[F.col(f"state__{f}").alias(f) for f in FEATURES])
    return E.score_equations(flat, list(FEATURES))


def _target() -> "F.Column":
    return F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")


# ------------------------------------------------------------------------------- SQL
def _slope(tag: str) -> str:
    return f"CASE WHEN s_{tag} IS NULL OR isnan(s_{tag}) OR isinf(s_{tag}) OR n_{tag} < 2 THEN 0 ELSE s_{tag} END AS slope_{tag}"


_X = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000.0"


def _frame(minutes: float) -> str:
    return f"(PARTITION BY entity_id ORDER BY ts RANGE BETWEEN INTERVAL {int(minutes)} MINUTE PRECEDING AND CURRENT ROW)"


def _got(m: float) -> str:
    a, b = f"greatest(f.us - {int(m) * 60000000}, epoch_us(a.ts))", "least(f.us, epoch_us(a.ts_end))"
    return (f"coalesce(sum(CASE WHEN a.ts_end <= a.ts THEN CASE WHEN epoch_us(a.ts) >= f.us - {int(m) * 60000000} THEN a.dose ELSE 0 END "
            f"WHEN {b} > {a} THEN a.dose * ({b} - {a}) / (epoch_us(a.ts_end) - epoch_us(a.ts)) ELSE 0 END), 0)")


_H = int(P.residual_horizon_min) * 60000000
_LEFT, _RIGHT = f"(greatest(epoch_us(a.ts), f.us - {_H}) - f.us)::DOUBLE", "(least(epoch_us(a.ts_end), f.us) - f.us)::DOUBLE"
_RESIDUAL = (
    f"greatest(coalesce(sum(CASE WHEN a.ts_end <= a.ts THEN CASE WHEN f.us - epoch_us(a.ts) < {_H} "
    f"THEN a.dose * (1 - (f.us - epoch_us(a.ts)) / {_H}.0) ELSE 0 END WHEN {_RIGHT} > {_LEFT} THEN a.dose / (epoch_us(a.ts_end) - epoch_us(a.ts)) "
    f"* (({_RIGHT} - {_LEFT}) + ({_RIGHT} * {_RIGHT} - {_LEFT} * {_LEFT}) / (2.0 * {_H})) ELSE 0 END), 0), 0)")

FEATS = EDGES + f""",
f0 AS (SELECT *, epoch_us(ts) AS us, {mins('prev_ts', 'ts')} AS pg,
    regr_slope(value, {_X}) OVER {_frame(P.slope_min[0])} AS s_short, count(*) OVER {_frame(P.slope_min[0])} AS n_short,
    regr_slope(value, {_X}) OVER {_frame(P.slope_min[1])} AS s_long, count(*) OVER {_frame(P.slope_min[1])} AS n_long,
    avg(value) OVER {_frame(P.stats_min[0])} AS mean_short, stddev_pop(value) OVER {_frame(P.stats_min[0])} AS std_short,
    avg(value) OVER {_frame(P.stats_min[1])} AS mean_long, stddev_pop(value) OVER {_frame(P.stats_min[1])} AS std_long,
    count(*) OVER {_frame(P.stats_min[0])} AS nn FROM e0),
fa AS (SELECT f.entity_id, f.ts, {_got(P.delivery_min[0])} AS delivered_short, {_got(P.delivery_min[1])} AS delivered_long,
    {_RESIDUAL} AS residual_exposure, least(coalesce((any_value(f.us) - max(epoch_us(a.ts))) / 60000000.0, 7200), 7200) AS since_action
    FROM f0 f LEFT JOIN act a ON a.entity_id = f.entity_id AND a.ts < f.ts GROUP BY f.entity_id, f.ts),
fm AS (SELECT f.entity_id, f.ts, coalesce(sum(x.amount) FILTER (x.ts > f.ts - INTERVAL {int(P.exposure_min[0])} MINUTE), 0) AS exposure_short,
    coalesce(sum(x.amount) FILTER (x.ts > f.ts - INTERVAL {int(P.exposure_min[1])} MINUTE), 0) AS exposure_long,
    least(coalesce((any_value(f.us) - max(epoch_us(x.ts))) / 60000000.0, 7200), 7200) AS since_exposure
    FROM f0 f LEFT JOIN expo x ON x.entity_id = f.entity_id AND x.ts <= f.ts GROUP BY f.entity_id, f.ts),
pt AS (SELECT entity_id, ts AS tau, unnest(generate_series(0, 6)) AS off FROM f0),
pt1 AS (SELECT entity_id, tau, off, tau - to_minutes(off * 240) AS ts FROM pt),
pt2 AS (SELECT p.*, s.rate AS srate FROM pt1 p ASOF LEFT JOIN sched s ON p.entity_id = s.entity_id AND p.ts >= s.ts),
pt3 AS (SELECT p.entity_id, p.tau, p.off, any_value(srate) AS srate, arg_max(o.rate, o.ts_begin) AS orate FROM pt2 p
    LEFT JOIN ovr o ON o.entity_id = p.entity_id AND o.ts_begin <= p.ts AND p.ts < o.ts_end GROUP BY 1, 2, 3),
fr AS (SELECT entity_id, tau AS ts, max(coalesce(orate, srate, 0)) FILTER (off = 0) AS rate_current,
    avg(coalesce(orate, srate, 0)) FILTER (off > 0) AS rate_mean, bool_or(off = 0 AND orate IS NOT NULL) AS override_active
    FROM pt3 GROUP BY 1, 2),
feat AS (SELECT f.entity_id, f.split, f.ts AS tau_t, value AS value_current,
    CASE WHEN pg <= 1440 THEN value - prev_value ELSE 0 END AS value_delta, {_slope('short')}, {_slope('long')},
    mean_short, std_short, mean_long, std_long, rate_current, rate_mean, delivered_short, delivered_long, residual_exposure,
    since_action, exposure_short, exposure_long, since_exposure,
    sin(2 * pi() * (hour(f.ts) + minute(f.ts) / 60.0 + second(f.ts) / 3600.0) / 24) AS time_of_day_sin,
    cos(2 * pi() * (hour(f.ts) + minute(f.ts) / 60.0 + second(f.ts) / 3600.0) / 24) AS time_of_day_cos,
    least(coalesce(pg, 360), 2880) AS previous_gap, greatest(0, 1 - least(nn, 7) / 7.0) AS missing_fraction, override_active
    FROM f0 f JOIN fa USING (entity_id, ts) JOIN fm USING (entity_id, ts) JOIN fr USING (entity_id, ts))"""

_LIST = " ".join(FEATURES)
_REW = ("(next_value BETWEEN 20 AND 70)::INT::DOUBLE AS reward_binary, CASE WHEN next_value < 10 THEN -4.0 WHEN next_value < 20 THEN -2.0 "
        "WHEN next_value <= 70 THEN 1.0 WHEN next_value <= 100 THEN -1.0 ELSE -2.0 END::DOUBLE AS reward_weighted")
CELLS_ONLY = EDGES + f""",
cells AS (SELECT entity_id, split, 360.0::DOUBLE AS interval_min, edge_index, segment_id, tau_t, tau_next, gap_min AS duration_min, value, next_value,
    action, action_count, action_dose, {_REW}, valid, CASE WHEN valid THEN '' ELSE printf('gap_%.3fmin_outside_[60.0,1440.0]', gap_min) END
    AS invalid_reason FROM edges)"""
_MACRO = CELLS_ONLY + f""",
mg AS (SELECT *, (edge_index - min(edge_index) OVER (PARTITION BY entity_id, segment_id)) // 3 AS g FROM cells WHERE valid),
mm AS (SELECT entity_id, split, segment_id AS ns, g, count(*) AS n, min(tau_t) AS tau_t, max(tau_next) AS tau_next,
    sum(action_count) AS action_count, arg_max(next_value, tau_next) AS next_value FROM mg GROUP BY 1, 2, 3, 4 HAVING count(*) = 3),
m5 AS (SELECT *, {mins('tau_t', 'tau_next')} AS duration_min, {mins('tau_t', 'tau_next')} BETWEEN 600 AND 3600 AS valid FROM mm),
m6 AS (SELECT *, lag(valid) OVER (PARTITION BY entity_id, ns ORDER BY g) AS pv FROM m5),
macro AS (SELECT entity_id, split, 2160.0::DOUBLE AS interval_min, CASE WHEN valid THEN sum((valid AND NOT coalesce(pv, false))::INT) OVER
    (PARTITION BY entity_id ORDER BY tau_t) - 1 ELSE -1 END AS segment_id, tau_t, tau_next, duration_min, valid,
    CASE WHEN valid THEN '' ELSE 'total_gap_outside_bounds' END AS invalid_reason, action_count, (action_count > 0)::INT AS action, {_REW}
    FROM m6)"""
_STACK = _MACRO + """,
stacked AS (SELECT entity_id, split, interval_min, segment_id, tau_t, tau_next, duration_min, valid, action, action_count,
    reward_binary, reward_weighted FROM cells UNION ALL SELECT entity_id, split, interval_min, segment_id, tau_t, tau_next,
    duration_min, valid, action, action_count, reward_binary, reward_weighted FROM macro)"""
_SEGS = """segs AS (SELECT entity_id, split, interval_min, segment_id, count(*) AS "T", min(tau_t) AS start_ts, max(tau_next) AS end_ts,
    sum(action) AS action_1, avg(action) AS action_1_rate FROM {t} WHERE valid GROUP BY 1, 2, 3, 4)"""
_META = """,
oc AS (SELECT entity_id, split, count(*) AS n_observations FROM obs GROUP BY 1, 2),
nat AS (SELECT entity_id, count(*) FILTER (valid) AS vn, count(*) FILTER (NOT valid) AS inv, max(duration_min) FILTER (NOT valid) AS wn
    FROM cells GROUP BY 1),
mk AS (SELECT entity_id, count(*) AS n_candidates, count(*) FILTER (valid) AS n_valid, count(*) FILTER (NOT valid) AS n_invalid,
    max(segment_id) + 1 AS n_segments, max(duration_min) FILTER (NOT valid) AS w, count(*) FILTER (valid AND action = 1) AS n_action_positive
    FROM {t} GROUP BY 1),
meta AS (SELECT o.entity_id, o.split, n_observations, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_valid, 0) AS n_valid,
    coalesce(n_invalid, 0) AS n_invalid, inv AS n_invalid_native_edges, coalesce(n_segments, 0) AS n_segments,
    coalesce(n_action_positive, 0) AS n_action_positive, vn - {k} * coalesce(n_valid, 0) AS n_native_edges_unused,
    coalesce(greatest(wn, w), 0) AS max_invalid_gap_min FROM oc o JOIN nat n ON o.entity_id = n.entity_id
    LEFT JOIN mk m ON o.entity_id = m.entity_id)"""
_META_INTS = ("n_observations n_candidates n_valid n_invalid n_invalid_native_edges n_segments n_action_positive n_native_edges_unused")
_KINDS = "['finger_stick','hypo_event','exercise','stressor','work','illness','sleep']"
_TIMING = CELLS_ONLY + f""",
info AS (SELECT entity_id, ts, 'observation' AS c FROM obs UNION ALL SELECT entity_id, ts, 'exposure' FROM expo
    UNION ALL SELECT entity_id, ts, 'schedule_change' FROM sched UNION ALL SELECT entity_id, ts_begin, 'override_begin' FROM ovr
    UNION ALL SELECT entity_id, ts_end, 'override_end' FROM ovr
    UNION ALL SELECT entity_id, ts, {_KINDS}[ordinal % 7 + 1] FROM base WHERE event_type = 'error' AND ordinal % 7 > 0),
tc AS (SELECT c.entity_id, c.split, c.interval_min, c.tau_t, any_value(c.tau_next) AS tau_next, any_value(c.action_count) AS action_count,
    min(a.ts) AS first_ts FROM cells c JOIN act a ON a.entity_id = c.entity_id AND c.tau_t <= a.ts AND a.ts < c.tau_next
    WHERE c.valid GROUP BY 1, 2, 3, 4),
tp AS (SELECT t.entity_id, t.tau_t, {', '.join(f"count(*) FILTER (c = '{c}') AS prior_{c}" for c in E.PRIOR)} FROM tc t
    JOIN info i ON i.entity_id = t.entity_id AND i.ts > t.tau_t AND i.ts < t.first_ts GROUP BY 1, 2),
timing AS (SELECT t.*, {', '.join(f"coalesce(prior_{c}, 0) AS prior_{c}" for c in E.PRIOR)},
    (SELECT count(*) FROM expo x WHERE x.entity_id = t.entity_id AND x.ts = t.first_ts) AS exposure_same_timestamp,
    {mins('t.tau_t', 't.first_ts')} AS first_offset_min, CASE WHEN {mins('t.tau_t', 't.first_ts')} < 600 THEN
      floor({mins('t.tau_t', 't.first_ts')} / 120)::BIGINT || '-' || (floor({mins('t.tau_t', 't.first_ts')} / 120)::BIGINT + 1) ELSE '5+' END AS timing_bin
    FROM tc t LEFT JOIN tp p ON t.entity_id = p.entity_id AND t.tau_t = p.tau_t),
timing1 AS (SELECT *, exposure_same_timestamp > 0 OR {' OR '.join(f'prior_{c} > 0' for c in E.PRIOR)} AS any_new_information FROM timing)"""
_BINS = ["0-1", "1-2", "2-3", "3-4", "4-5", "5+"]
_SUMMARY = _TIMING + """,
ts AS (SELECT split, interval_min, metric, n, n / total AS proportion FROM (SELECT split, interval_min, count(*) AS total, """ + ", ".join(
    [f"count(*) FILTER (timing_bin = '{b}') AS \"timing_{b}\"" for b in _BINS]
    + [f"count(*) FILTER (prior_{c} > 0) AS prior_{c}" for c in E.PRIOR]
    + ["count(*) FILTER (exposure_same_timestamp > 0) AS exposure_same_timestamp",
       "count(*) FILTER (any_new_information) AS any_new_information",
       "count(*) FILTER (action_count > 1) AS multiple_action_cell"]) + """ FROM timing1 GROUP BY 1, 2)
    UNPIVOT (n FOR metric IN (COLUMNS(* EXCLUDE (split, interval_min, total)))))"""
_PSUM = CELLS_ONLY + _META.format(t="cells", k=1) + """,
psum AS (SELECT c.entity_id, c.split, c.interval_min, count(*) AS total_transitions, sum(action) AS action_1,
    count(DISTINCT tau_t::DATE) AS observed_days, avg(reward_binary) AS binary_reward_mean, avg(reward_weighted) AS weighted_reward_mean,
    any_value(m.n_segments) AS n_segments, any_value(m.n_invalid) AS invalid_transitions, any_value(m.max_invalid_gap_min) AS max_invalid_gap_min,
    sum(action) / count(*) AS action_1_rate, sum(action) / greatest(count(DISTINCT tau_t::DATE), 1) AS actions_per_day
    FROM cells c JOIN meta m ON c.entity_id = m.entity_id WHERE c.valid GROUP BY 1, 2, 3)"""
_FCELLS = FEATS + f""",
fc AS (SELECT e.entity_id, e.split, 360.0::DOUBLE AS interval_min, e.action, e.tau_t, f.* EXCLUDE (entity_id, split, tau_t) FROM edges e
    JOIN feat f ON e.entity_id = f.entity_id AND e.tau_t = f.tau_t WHERE e.valid),
lf AS (UNPIVOT (SELECT entity_id, split, interval_min, action, {', '.join(f'{f}::DOUBLE AS {f}' for f in FEATURES)} FROM fc)
    ON {', '.join(FEATURES)} INTO NAME feature VALUE x)"""
_SCORES = _FCELLS + """,
sc AS (SELECT entity_id, split, tau_t, action, round(1 / (1 + exp(-(value_current / 50 - since_action / 3600 + time_of_day_sin / 2))), 4) AS p FROM fc)"""


def _cuts(col: str, edges: tuple, labels: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {col} < {e} THEN '{n}'" for e, n in zip(edges, labels)) + f" ELSE '{labels[-1]}' END"


_STRATA_SQL = " UNION ALL ".join(
    f"SELECT entity_id, split, interval_min, action, '{n}' AS stratum_type, {c} AS stratum FROM fc" for n, c in (
        ("value", _cuts("value_current", (10, 20, 70, 100), ("<10", "10-19", "20-69", "70-99", ">=100"))),
        ("exposure_recency_min", _cuts("since_exposure", (1440, 2880, 7200), ("0-1d", "1-2d", "2-5d", "capped"))),
        ("residual_exposure", _cuts("residual_exposure", (0.01, 10, 30, 60), ("~0", "0-9", "10-29", "30-59", ">=60"))),
        ("time_of_day", _cuts("hour(tau_t)", (6, 12, 18), ("00-05", "06-11", "12-17", "18-23")))))

QUERIES: dict[str, Query] = {
    "state_features": query(
        lambda s, d: features(s, d).select("entity_id", "split", "tau_t", *FEATURES, "override_active"),
        rounded(with_(FEATS, "SELECT * FROM feat"), _LIST, digits=5), "C1 C2 C3 C4 C5 C6 C7 C8 C9 C10 C11 C12 C13 C14", digits=5),
    "scaled_state_vector": query(
        lambda s, d: C.scale_state(features(s, d), P).select(
            "entity_id", "split", "tau_t", *[F.col(f"state__{f}") for f in FEATURES]),
        rounded(with_(FEATS, "SELECT entity_id, split, tau_t, " + ", ".join(
            f"({f} - {c}) / {sc} AS state__{f}" for f, (c, sc) in P.scaling.items()) + " FROM feat"),
            " ".join(f"state__{f}" for f in FEATURES), digits=5), "C14 C15", digits=5),
    "transitions": query(
        lambda s, d: cells(s, d).select(
            "entity_id", "split", "interval_min", "edge_index", "segment_id", "tau_t", "tau_next", "duration_min", "value", "next_value",
            "action", "action_count", "action_dose", "reward_binary", "reward_weighted", "valid", "override_active", "tie_at_tau",
            "tie_in_cell", "raw__residual_exposure", "next_raw__residual_exposure", "next_raw__rate_current", "next_raw__exposure_short"),
        rounded(with_(FEATS + CELLS_ONLY[len(EDGES):], """SELECT c.* EXCLUDE (invalid_reason), f.override_active, false AS tie_at_tau, false AS tie_in_cell,
            f.residual_exposure AS raw__residual_exposure, g.residual_exposure AS next_raw__residual_exposure,
            g.rate_current AS next_raw__rate_current, g.exposure_short AS next_raw__exposure_short
            FROM cells c JOIN feat f ON f.entity_id = c.entity_id AND f.tau_t = c.tau_t
            JOIN feat g ON g.entity_id = c.entity_id AND g.tau_t = c.tau_next"""),
            "duration_min action_dose raw__residual_exposure next_raw__residual_exposure next_raw__rate_current next_raw__exposure_short "
            "reward_binary reward_weighted", "edge_index segment_id action action_count", digits=5), "D1 D2 D3 D5 D6", digits=5),
    "action_rows_by_cell": query(
        lambda s, d: T.action_rows_by_cell(R.actions(s, d), GQ.edges(s, d), R.CHUNK_MIN),
        rounded(with_(EDGES, """SELECT a.entity_id, a.split, e.tau_t, row_number() OVER (PARTITION BY a.entity_id, e.tau_t ORDER BY a.ts, a.ordinal)
            AS position, a.ts, a.ts_end, a.kind, a.dose FROM act a JOIN edges e ON a.entity_id = e.entity_id
            AND e.tau_t <= a.ts AND a.ts < e.tau_next"""), "dose"), "D4"),
    "three_step_transitions": query(
        lambda s, d: macro(s, d).drop("_chunk"),
        rounded(with_(_MACRO, "SELECT * FROM macro"), "duration_min reward_binary reward_weighted", "segment_id action action_count"), "D7"),
    "build_metadata": query(
        meta, rounded(with_(CELLS_ONLY, _META.format(t="cells", k=1) + " SELECT * FROM meta"), "max_invalid_gap_min", _META_INTS), "D8"),
    "build_metadata_three_step": query(
        lambda s, d: T.build_metadata(R.observations(s, d), cells(s, d), macro(s, d), 3),
        rounded(with_(_MACRO, _META.format(t="macro", k=3) + " SELECT * FROM meta"), "max_invalid_gap_min", _META_INTS), "D8"),
    "transition_violations": query(
        lambda s, d: T.violations(cells(s, d), T.action_rows_by_cell(R.actions(s, d), GQ.edges(s, d), R.CHUNK_MIN).join(
            GQ.edges(s, d).select("entity_id", "split", "tau_t", "tau_next"), ["entity_id", "split", "tau_t"])).groupBy("rule").agg(
            F.count(F.lit(1)).alias("n")),
        "SELECT 'x' AS rule, 0::BIGINT AS n WHERE false", "D9"),
    "flatten_valid": query(
        lambda s, d: T.flatten_valid(cells(s, d), P).select(
            "entity_id", "split", "segment_id", "transition_index", "tau_t", "tau_next", "action", "reward_binary", "reward_weighted",
            "raw__mean_long", "state__mean_long", "next_state__mean_long", "state__previous_gap", "next_state__previous_gap"),
        rounded(with_(FEATS + CELLS_ONLY[len(EDGES):], """SELECT c.entity_id, c.split, segment_id, row_number() OVER (PARTITION BY c.entity_id, segment_id
            ORDER BY c.tau_t) - 1 AS transition_index, c.tau_t, tau_next, action, reward_binary, reward_weighted, f.mean_long AS raw__mean_long,
            (f.mean_long - 120) / 50 AS state__mean_long, (g.mean_long - 120) / 50 AS next_state__mean_long,
            (f.previous_gap - 360) / 360 AS state__previous_gap, (g.previous_gap - 360) / 360 AS next_state__previous_gap
            FROM cells c JOIN feat f ON f.entity_id = c.entity_id AND f.tau_t = c.tau_t
            JOIN feat g ON g.entity_id = c.entity_id AND g.tau_t = c.tau_next WHERE c.valid"""),
            "raw__mean_long state__mean_long next_state__mean_long state__previous_gap next_state__previous_gap reward_binary reward_weighted",
            "segment_id transition_index action"), "D10"),
    "segment_table": query(
        lambda s, d: T.segment_table(stacked(s, d)),
        rounded(with_(_STACK, f", {_SEGS.format(t='stacked')} SELECT * FROM segs"), "action_1_rate", 'segment_id action_1'), "D11"),
    "reward_distribution": query(
        lambda s, d: T.reward_distribution(stacked(s, d)),
        rounded(with_(_STACK, """, rw AS (SELECT entity_id, split, interval_min, 'binary' AS reward, reward_binary AS reward_value FROM stacked WHERE valid
            UNION ALL SELECT entity_id, split, interval_min, 'weighted', reward_weighted FROM stacked WHERE valid)
            SELECT *, n / sum(n) OVER (PARTITION BY entity_id, interval_min, reward) AS proportion FROM
            (SELECT entity_id, split, interval_min, reward, reward_value, count(*) AS n FROM rw GROUP BY 1, 2, 3, 4, 5)"""),
            "proportion reward_value"), "D12"),
    "invariant_report": query(
        lambda s, d: T.invariant_report(stacked(s, d)),
        with_(_STACK, """SELECT interval_min, bool_and(tau_t < tau_next) AS boundaries_increase, bool_and(action IN (0, 1)) AS actions_binary,
            bool_and((action = 1) = (action_count > 0)) AS action_matches_events, bool_and(NOT valid OR segment_id >= 0) AS valid_in_segment,
            bool_and(valid OR segment_id = -1) AS invalid_outside_segments, bool_and(reward_binary IS NOT NULL) AS reward_observed
            FROM stacked GROUP BY 1"""), "D13"),
    "rows_around": query(
        lambda s, d: E.rows_around(cells(s, d), _target(), 8).select(
            "entity_id", "split", "edge_index", "tau_t", "tau_next", "duration_min", "action", "valid", "invalid_reason"),
        rounded(with_(CELLS_ONLY, """, h AS (SELECT entity_id, arg_min(edge_index, (abs(epoch_us(tau_t) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), edge_index)) AS hit,
              count(*) AS n FROM cells GROUP BY 1),
            b AS (SELECT entity_id, least(n, greatest(0, hit - 4) + 8) AS e FROM h)
            SELECT c.entity_id, c.split, edge_index, tau_t, tau_next, duration_min, action, valid, invalid_reason FROM cells c
            JOIN b ON c.entity_id = b.entity_id AND edge_index >= greatest(0, e - 8) AND edge_index < e"""),
            "duration_min", "edge_index action"), "E1"),
    "action_timing": query(
        timing, rounded(with_(_TIMING, "SELECT * FROM timing1"), "first_offset_min",
                        "action_count exposure_same_timestamp " + " ".join(f"prior_{c}" for c in E.PRIOR)), "E2 E3"),
    "action_timing_summary": query(
        lambda s, d: E.action_timing_summary(timing(s, d)),
        rounded(with_(_SUMMARY, "SELECT * FROM ts"), "proportion", "n"), "E4"),
    "action_coverage": query(
        lambda s, d: E.action_coverage(R.actions(s, d), macro(s, d), R.CHUNK_MIN),
        rounded(with_(_MACRO, """, b AS (SELECT entity_id, min(tau_t) AS lo, max(tau_next) AS hi FROM macro GROUP BY 1),
            n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts, ordinal) - 1 AS action_id FROM act),
            j AS (SELECT n.*, m.tau_t AS ct, m.tau_next AS cn, coalesce(m.valid, false) AS captured, lo, hi FROM n LEFT JOIN macro m
              ON n.entity_id = m.entity_id AND m.tau_t <= n.ts AND n.ts < m.tau_next LEFT JOIN b ON n.entity_id = b.entity_id)
            SELECT entity_id, split, action_id, ts, ts_end, kind, dose, captured, CASE WHEN captured THEN 'captured_valid_transition'
              WHEN ct IS NOT NULL THEN 'inside_invalid_or_unused_interval' WHEN ts < lo THEN 'before_first_candidate_boundary'
              WHEN ts >= hi THEN 'at_or_after_last_candidate_boundary' ELSE 'between_saved_cells_or_gap' END AS coverage_reason,
              ct AS captured_tau_t, cn AS captured_tau_next FROM j"""), "dose", "action_id"), "E5"),
    "action_coverage_summary": query(
        lambda s, d: E.coverage_summary(E.action_coverage(R.actions(s, d), cells(s, d), R.CHUNK_MIN)),
        rounded(with_(CELLS_ONLY, """, b AS (SELECT entity_id, min(tau_t) AS lo, max(tau_next) AS hi FROM cells GROUP BY 1),
            j AS (SELECT a.*, m.tau_t AS ct, coalesce(m.valid, false) AS captured, lo, hi FROM act a LEFT JOIN cells m
              ON a.entity_id = m.entity_id AND m.tau_t <= a.ts AND a.ts < m.tau_next LEFT JOIN b ON a.entity_id = b.entity_id)
            SELECT split, CASE WHEN captured THEN 'captured_valid_transition'
              WHEN ct IS NOT NULL THEN 'inside_invalid_or_unused_interval' WHEN ts < lo THEN 'before_first_candidate_boundary'
              WHEN ts >= hi THEN 'at_or_after_last_candidate_boundary' ELSE 'between_saved_cells_or_gap' END AS coverage_reason,
              count(*) AS n, sum(dose) AS dose FROM j GROUP BY 1, 2"""), "dose"), "E5"),
    "entity_transition_summary": query(
        lambda s, d: E.entity_transition_summary(cells(s, d), meta(s, d)),
        rounded(with_(_PSUM, "SELECT * FROM psum"),
                "binary_reward_mean weighted_reward_mean max_invalid_gap_min action_1_rate actions_per_day",
                "action_1 n_segments"), "E6"),
    "temporal_quartiles": query(
        lambda s, d: E.temporal_quartiles(cells(s, d)),
        rounded(with_(CELLS_ONLY, """, q AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tau_t) - 1 AS i, count(*) OVER (PARTITION BY entity_id) AS n
              FROM cells WHERE valid)
            SELECT entity_id, split, 'Q' || greatest(1, ceil(4.0::DOUBLE * i / (n - 1))::BIGINT) AS time_quartile, count(*) AS n, sum(action) AS action_1,
              avg(action) AS action_1_rate, min(tau_t) AS start_ts, max(tau_next) AS end_ts FROM q WHERE n > 1 GROUP BY 1, 2, 3"""),
            "action_1_rate", "action_1"), "E7"),
    "segment_support": query(
        lambda s, d: E.segment_support(T.segment_table(cells(s, d))),
        rounded(with_(CELLS_ONLY, f""", {_SEGS.format(t='cells')} SELECT split, count(*) AS segments, count(*) FILTER (action_1 = 0) AS segments_zero_action,
            count(*) FILTER (action_1 < 5) AS segments_lt5_actions, coalesce(sum("T") FILTER (action_1 = 0), 0) AS transitions_in_zero_segments,
            quantile_cont(action_1::DOUBLE, 0.5) AS median_actions, quantile_cont(action_1::DOUBLE, 0.25) AS p25_actions,
            coalesce(sum("T") FILTER (action_1 = 0), 0) / sum("T") AS fraction_in_zero_segments FROM segs GROUP BY 1"""),
            "median_actions p25_actions fraction_in_zero_segments", "transitions_in_zero_segments"), "E8"),
    "feature_distributions": query(
        lambda s, d: E.feature_distributions(cells(s, d)),
        rounded(with_(_FCELLS, """SELECT entity_id, split, interval_min, action, feature, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS sd,
            quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.95) AS p95 FROM lf GROUP BY 1, 2, 3, 4, 5"""),
            "mean sd p05 median p95", "action", digits=4), "E9", digits=4),
    "stratified_rates": query(
        lambda s, d: E.stratified_rates(cells(s, d), strata()),
        rounded(with_(_FCELLS, f""", st AS ({_STRATA_SQL}) SELECT entity_id, split, interval_min, stratum_type, stratum, count(*) AS n,
            sum(action) AS action_1, avg(action) AS action_1_rate FROM st GROUP BY 1, 2, 3, 4, 5"""), "action_1_rate", "action_1"), "E10"),
    "propensity_scores": query(fitted_scores, None, "E11"),
    "propensity_equations": query(fit_equations, rounded(with_(_FCELLS, f""", sx AS (SELECT entity_id, action, least(floor(('0x' || substr(md5('fold:' || entity_id), 1, 13))::BIGINT / 4503599627370496.0 * 6), 5)::INT AS fold,
            1.0::DOUBLE AS intercept, {', '.join(f'(({f} - {c}) / {sc})::DOUBLE AS {f}' for f, (c, sc) in P.scaling.items())} FROM fc WHERE split = 'training'),
        sl AS (UNPIVOT sx ON intercept, {', '.join(FEATURES)} INTO NAME feature VALUE x)
        SELECT model::BIGINT AS model, feature, count(*) AS n, avg(x * action) AS moment FROM sl JOIN (SELECT unnest(range(7)) AS model) m ON model <> fold GROUP BY 1, 2"""), "moment", "model n", digits=5), "E11", digits=5),
    "fitted_overlap_summary": query(lambda s, d: E.overlap_summary(fitted_scores(s, d)), None, "E11"),
    "overlap_summary": query(
        lambda s, d: E.overlap_summary(fixed_scores(s, d)),
        rounded(with_(_SCORES, """, b AS (SELECT split, greatest(quantile_cont(p, 0.01) FILTER (action = 0), quantile_cont(p, 0.01) FILTER (action = 1)) AS lo,
              least(quantile_cont(p, 0.99) FILTER (action = 0), quantile_cont(p, 0.99) FILTER (action = 1)) AS hi FROM sc GROUP BY 1),
            rk AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0 AS r FROM sc)
            SELECT s.split, count(*) AS n, sum(action) AS n_action_1, avg((p - action) * (p - action)) AS brier,
              avg((p < 0.005)::INT) AS below_extreme_low, avg((p > 0.995)::INT) AS above_extreme_high, any_value(lo) AS common_support_lo,
              any_value(hi) AS common_support_hi, avg((p < lo OR p > hi)::INT) AS outside_all,
              avg((p < lo OR p > hi)::INT) FILTER (action = 1) AS outside_action1, avg((p < lo OR p > hi)::INT) FILTER (action = 0) AS outside_action0,
              (sum(r) FILTER (action = 1) - sum(action) * (sum(action) + 1) / 2.0) / (sum(action) * (count(*) - sum(action))) AS auc,
              min(p) AS p_min, quantile_cont(p, 0.01) AS p01, quantile_cont(p, 0.05) AS p05, quantile_cont(p, 0.5) AS p50,
              quantile_cont(p, 0.95) AS p95, quantile_cont(p, 0.99) AS p99, max(p) AS p_max FROM rk s JOIN b ON s.split = b.split GROUP BY 1"""),
            "brier below_extreme_low above_extreme_high common_support_lo common_support_hi outside_all outside_action1 outside_action0 auc "
            "p_min p01 p05 p50 p95 p99 p_max", "n_action_1"), "E11"),
    "feature_support": query(
        lambda s, d: E.feature_support(cells(s, d).select("split", "valid", "action", *[
            F.round(F.col(f"raw__{f}") + NUDGE, 6).alias(f"raw__{f}") for f in FEATURES])),
        rounded(with_(_FCELLS.replace("lf AS (", "lf AS (SELECT * REPLACE (round(x + 1.7e-9, 6) AS x) FROM (") + ")", """, q AS (SELECT split, feature, quantile_cont(x, 0.01) FILTER (action = 0) AS a0_q01, quantile_cont(x, 0.99) FILTER (action = 0) AS a0_q99,
              quantile_cont(x, 0.01) FILTER (action = 1) AS a1_q01, quantile_cont(x, 0.99) FILTER (action = 1) AS a1_q99 FROM lf GROUP BY 1, 2)
            SELECT q.*, greatest(a0_q01, a1_q01) AS intersection_lo, least(a0_q99, a1_q99) AS intersection_hi,
              greatest(a0_q01, a1_q01) > least(a0_q99, a1_q99) AS empty_intersection,
              (SELECT avg((x < q.a0_q01 OR x > q.a0_q99)::INT) FROM lf WHERE lf.split = q.split AND lf.feature = q.feature AND action = 1) AS a1_outside_a0_range FROM q"""),
            "a0_q01 a0_q99 a1_q01 a1_q99 intersection_lo intersection_hi a1_outside_a0_range", digits=4), "E12", digits=4),
    "decile_regions": query(
        lambda s, d: E.decile_regions(fixed_scores(s, d)),
        rounded(with_(_SCORES, """, e AS (SELECT list_sort(list_distinct(quantile_cont(p, [0,.1,.2,.3,.4,.5,.6,.7,.8,.9,1]))) AS edges FROM sc),
            r AS (SELECT sc.*, CASE WHEN len(edges) < 3 THEN 'all' ELSE printf('R%02d', greatest(1, len(list_filter(edges, lambda q: q < p)))) END AS region FROM sc, e)
            SELECT split, region, count(*) AS n, sum(action) AS action_1, avg(action) AS action_1_rate,
              sum(action) = 0 OR sum(action) = count(*) AS only_one_action FROM r GROUP BY 1, 2"""), "action_1_rate", "action_1"), "E13"),
    "interval_comparison": query(
        lambda s, d: E.interval_comparison(E.entity_transition_summary(cells(s, d), meta(s, d)), E.action_timing_summary(timing(s, d))),
        rounded(with_(_SUMMARY, _PSUM[len(CELLS_ONLY):] + """ SELECT p.split, p.interval_min, count(DISTINCT entity_id) AS entities, sum(total_transitions) AS total_transitions,
            sum(action_1) AS total_action_1, sum(n_segments) AS total_segments, sum(invalid_transitions) AS invalid_transitions,
            sum(action_1) / sum(total_transitions) AS action_1_rate, any_value(x.multiple_action_cell) AS multiple_action_cell,
            any_value(x.any_new_information) AS any_new_information FROM psum p LEFT JOIN
            (SELECT split, max(proportion) FILTER (metric = 'multiple_action_cell') AS multiple_action_cell,
              max(proportion) FILTER (metric = 'any_new_information') AS any_new_information FROM ts GROUP BY 1) x ON p.split = x.split GROUP BY 1, 2"""),
            "action_1_rate multiple_action_cell any_new_information", "total_transitions total_action_1 total_segments invalid_transitions"), "E14"),
}
