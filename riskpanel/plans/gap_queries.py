"""Registered queries: cleaning, gaps, runs, adjacency rules, fixed lattice, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gaps as G
from ..params import QualityRules
from ..session import shared_table
from . import roles as R
from .registry import Query, query, rounded
from .sql import BASE, EDGES, LATTICE, mins, with_

QUALITY = QualityRules(readings_per_day=1, readings_per_window=6, min_readings=12, min_windows=2, max_missing=0.5)


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return shared_table(spark, sf, "steps", lambda: G.observed_steps(
        R.observations(spark, sf), R.actions(spark, sf), R.CHUNK_MIN))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return shared_table(spark, sf, "edges", lambda: G.number_edges(steps(spark, sf), R.GAPS))


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return G.classify_gaps(edges(spark, sf), R.GAPS)


def lattice(spark: SparkSession, sf: str) -> DataFrame:
    return shared_table(spark, sf, "lattice", lambda: G.fixed_lattice(
        R.observations(spark, sf), R.actions(spark, sf), R.GAPS))


def trajectory_segments(spark: SparkSession, sf: str) -> DataFrame:
    obs = G.dedup_observations(R.doubled_observations(spark, sf))
    return G.segment_runs(G.edges(obs, R.actions(spark, sf), R.GAPS)).select(
        "entity_id", "split", "segment_id", "transitions", "action_positive",
        (F.col("action_positive") / F.col("transitions")).alias("action_rate"), "start_ts", "end_ts")


_CONFIG_BINS = "(" + "), (".join(
    f"{i}, '{b.label}'" for i, b in enumerate(R.GAPS.bins)) + ")"
_SCOPED = """scoped AS (SELECT 'entity' AS scope, split, entity_id::VARCHAR AS entity, * EXCLUDE (split, entity_id) FROM {t}
    UNION ALL SELECT 'split', split, 'ALL', * EXCLUDE (split, entity_id) FROM {t})"""

_RULES = "(VALUES " + ", ".join(f"('{r.name}', {r.lower}, {r.upper})" for r in R.GAPS.rules) + ") r(rule, lo, hi)"
_RULE_CTES = EDGES + f""",
rr AS (SELECT e.*, r.rule, coalesce(gap_min BETWEEN lo AND hi, false) AS ok,
    coalesce(prev_gap_min BETWEEN lo AND hi, false) AS was FROM edges e CROSS JOIN {_RULES}),
rs AS (SELECT *, CASE WHEN ok THEN sum((ok AND NOT was)::INT) OVER (PARTITION BY entity_id, rule ORDER BY tau_t) END AS run FROM rr),
rl AS (SELECT entity_id, rule, max(n) AS longest_segment FROM (SELECT entity_id, rule, run, count(*) AS n FROM rs
    WHERE ok GROUP BY 1, 2, 3) GROUP BY 1, 2),
raw AS (SELECT entity_id, count(*) AS raw_actions FROM act GROUP BY 1),
pe AS (SELECT s.entity_id, s.split, s.rule, count(*) AS candidate_edges, count(*) FILTER (ok) AS valid_transitions,
    count(DISTINCT run) AS segments, coalesce(max(longest_segment), 0) AS longest_segment,
    count(*) FILTER (ok AND action_count > 0) AS action_positive_cells, sum(action_count) AS actions_in_record,
    coalesce(sum(action_count) FILTER (ok), 0) AS actions_captured, coalesce(max(raw_actions), 0) AS raw_actions,
    100.0 * count(*) FILTER (ok) / count(*) AS valid_pct,
    quantile_cont(gap_min - 720, 0.5) FILTER (ok) AS signed_median,
    quantile_cont(abs(gap_min - 720), 0.5) FILTER (ok) AS abs_median,
    quantile_cont(abs(gap_min - 720), 0.9) FILTER (ok) AS abs_p90,
    quantile_cont(abs(gap_min - 720), 0.95) FILTER (ok) AS abs_p95,
    quantile_cont(abs(gap_min - 720), 0.99) FILTER (ok) AS abs_p99, max(abs(gap_min - 720)) FILTER (ok) AS abs_max
    FROM rs s LEFT JOIN rl l ON s.entity_id = l.entity_id AND s.rule = l.rule
    LEFT JOIN raw w ON s.entity_id = w.entity_id GROUP BY 1, 2, 3)"""
_COVERAGE = """100.0 * actions_captured / nullif(actions_in_record, 0) AS coverage_pct,
    100.0 * actions_captured / nullif(raw_actions, 0) AS coverage_all_raw_pct"""

_LAT_SUM = LATTICE + """,
lruns AS (SELECT entity_id, split, run, count(*) AS n FROM lat2 WHERE valid GROUP BY 1, 2, 3),
lpe AS (SELECT l.entity_id, l.split, count(*) AS candidate_edges, count(*) FILTER (valid) AS valid_transitions,
    count(DISTINCT run) AS segments,
    coalesce((SELECT max(n) FROM lruns r WHERE r.entity_id = l.entity_id), 0) AS longest_segment,
    coalesce(sum(action) FILTER (valid), 0) AS action_positive_cells, sum(action_count) AS actions_in_record,
    coalesce(sum(action_count) FILTER (valid), 0) AS actions_captured,
    count(*) FILTER (state_age_min < 0 OR next_age_min < 0) AS future_state_mappings,
    count(*) FILTER (reasons LIKE '%reward_not_after%') AS reward_precedes_action,
    (SELECT count(*) FROM act a WHERE a.entity_id = l.entity_id) AS raw_actions FROM lat2 l GROUP BY 1, 2)"""


def _lat_quantiles(group: str) -> str:
    cols = ", ".join(
        f"quantile_cont({c}, {p}) AS {n}_{s}" for n, c in (
            ("state_age", "state_age_min"), ("next_age", "next_age_min"), ("step_error", "abs(mapped_step_min - 360)"))
        for s, p in (("median", 0.5), ("p95", 0.95)))
    return f"(SELECT {group}, {cols} FROM lat2 WHERE valid GROUP BY {group})"


_LQ = "state_age_median state_age_p95 next_age_median next_age_p95 step_error_median step_error_p95"

QUERIES: dict[str, Query] = {
    "dedup_observations": query(
        lambda s, d: G.dedup_observations(R.doubled_observations(s, d)),
        rounded(with_(BASE, """, d AS (SELECT * FROM obs UNION ALL SELECT entity_id, split, ts, ordinal + 1000000000000, value + 1
            FROM obs WHERE ordinal % 7 = 0)
            SELECT entity_id, split, ts, arg_max(value, ordinal) AS value, max(ordinal) AS ordinal FROM d GROUP BY 1, 2, 3
            """), "value"), "B1"),
    "trajectory_segments": query(
        trajectory_segments,
        rounded(with_(EDGES, """SELECT entity_id, split, segment_id, transitions, action_positive,
            action_positive / transitions AS action_rate, start_ts, end_ts FROM runs"""),
            "action_rate", "segment_id transitions action_positive"), "B1 B3 B6 D11"),
    "data_quality": query(
        lambda s, d: G.data_quality(R.long_events(s, d), QUALITY),
        rounded(with_(BASE, f""", q AS (SELECT entity_id, split, count(*) FILTER (event_type = 'view') AS n_observation,
            count(*) FILTER (event_type = 'purchase') AS n_action, count(*) FILTER (event_type = 'click') AS n_exposure,
            count(*) FILTER (event_type = 'signup') AS n_schedule, min(ts) FILTER (event_type = 'view') AS start_ts,
            max(ts) FILTER (event_type = 'view') AS end_ts FROM base GROUP BY 1, 2),
            q1 AS (SELECT *, coalesce({mins('start_ts', 'end_ts')} / 1440, 0) AS duration_days,
              floor(coalesce({mins('start_ts', 'end_ts')} / 1440, 0))::BIGINT AS expected FROM q),
            q2 AS (SELECT *, CASE WHEN expected > 0 THEN greatest(0.0, 1.0 - n_observation / expected) ELSE 1.0 END AS missing_rate,
              floor(n_observation / 6)::BIGINT AS n_windows FROM q1),
            q3 AS (SELECT *, CASE WHEN n_observation = 0 THEN 'No observations' ELSE concat_ws('; ',
              CASE WHEN n_observation < 12 THEN 'Too few observations (<12)' END,
              CASE WHEN n_windows < 2 THEN 'Too few windows (<2)' END,
              CASE WHEN missing_rate > 0.5 THEN printf('High missing rate (%.2f)', missing_rate + 1e-9) END) END AS r FROM q2)
            SELECT * EXCLUDE (r), r = '' AS usable, CASE WHEN r = '' THEN 'OK' ELSE r END AS reason FROM q3"""),
            "duration_days missing_rate", "n_windows expected"), "B2"),
    "adjacent_gaps": query(
        gaps, rounded(with_(EDGES, "SELECT * FROM gaps"), "gap_min", "edge_index"), "B3 B4 B5"),
    "gap_bin_distribution": query(
        lambda s, d: G.gap_distribution(gaps(s, d), R.GAPS),
        rounded(with_(EDGES, f""", {_SCOPED.format(t='gaps')},
            tot AS (SELECT scope, split, entity, count(*) AS total FROM scoped GROUP BY 1, 2, 3)
            SELECT t.scope, t.split, t.entity, b.gap_bin, count(g.gap_bin) AS n, 100.0 * count(g.gap_bin) / any_value(total) AS percentage
            FROM tot t CROSS JOIN (VALUES {_CONFIG_BINS}) b(pos, gap_bin) LEFT JOIN scoped g ON g.scope = t.scope
            AND g.split = t.split AND g.entity = t.entity AND g.gap_bin = b.gap_bin GROUP BY 1, 2, 3, 4"""),
            "percentage", "n"), "B7"),
    "gap_quantiles": query(
        lambda s, d: G.gap_quantiles(gaps(s, d)),
        rounded(with_(EDGES, f""", {_SCOPED.format(t='gaps')} SELECT scope, split, entity, count(*) AS n_gaps, max(gap_min) AS max,
            count(*) FILTER (NOT valid) AS n_breaks, max(gap_min) FILTER (NOT valid) AS break_max, """ + ", ".join(
            f"quantile_cont(gap_min, {p}) AS {k}, quantile_cont(gap_min, {p}) FILTER (NOT valid) AS break_{k}"
            for k, p in G.QUANTILES.items()) + " FROM scoped GROUP BY 1, 2, 3"),
            "max break_max median p90 p95 p99 break_median break_p90 break_p95 break_p99", "n_gaps n_breaks"), "B8"),
    "segment_breaks": query(
        lambda s, d: G.break_table(gaps(s, d), R.GAPS),
        rounded(with_(EDGES, """SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tau_t) AS break_number
            FROM gaps WHERE NOT valid"""), "gap_min", "edge_index break_number"), "B9"),
    "adjacency_rules": query(
        lambda s, d: G.adjacency_rules(steps(s, d), R.actions(s, d), R.GAPS),
        rounded(with_(_RULE_CTES, f"SELECT *, {_COVERAGE} FROM pe"),
                "valid_pct coverage_pct coverage_all_raw_pct signed_median abs_median abs_p90 abs_p95 abs_p99 abs_max",
                "candidate_edges valid_transitions segments longest_segment action_positive_cells actions_in_record "
                "actions_captured raw_actions"), "B10 B11"),
    "adjacency_rules_by_split": query(
        lambda s, d: G.adjacency_rules_by_split(steps(s, d), R.actions(s, d), R.GAPS),
        rounded(with_(_RULE_CTES, f""", sp AS (SELECT split, rule, count(DISTINCT entity_id) AS entities,
            sum(candidate_edges) AS candidate_edges, sum(valid_transitions) AS valid_transitions, sum(segments) AS segments,
            max(longest_segment) AS longest_segment, sum(action_positive_cells) AS action_positive_cells,
            sum(raw_actions) AS raw_actions, sum(actions_in_record) AS actions_in_record,
            sum(actions_captured) AS actions_captured FROM pe GROUP BY 1, 2),
            er AS (SELECT split, rule, quantile_cont(gap_min - 720, 0.5) AS signed_median,
              quantile_cont(abs(gap_min - 720), 0.5) AS abs_median, quantile_cont(abs(gap_min - 720), 0.95) AS abs_p95,
              quantile_cont(abs(gap_min - 720), 0.99) AS abs_p99, max(abs(gap_min - 720)) AS abs_max FROM rs WHERE ok GROUP BY 1, 2)
            SELECT sp.*, 100.0 * valid_transitions / candidate_edges AS valid_pct, {_COVERAGE}, er.* EXCLUDE (split, rule)
            FROM sp LEFT JOIN er ON sp.split = er.split AND sp.rule = er.rule"""),
            "valid_pct coverage_pct coverage_all_raw_pct signed_median abs_median abs_p95 abs_p99 abs_max",
            "candidate_edges valid_transitions segments longest_segment action_positive_cells raw_actions "
            "actions_in_record actions_captured"), "B10"),
    "fixed_lattice": query(
        lambda s, d: lattice(s, d).drop("_chunk").withColumn("reasons", F.array_join("reasons", "|")),
        rounded(with_(LATTICE, "SELECT *, reasons = '' AS valid FROM lat"),
                "state_age_min next_age_min mapped_step_min", "lattice_index action action_count"), "B12"),
    "lattice_summary": query(
        lambda s, d: G.lattice_summary(lattice(s, d), R.actions(s, d), R.GAPS),
        rounded(with_(_LAT_SUM, f"""SELECT p.*, 100.0 * valid_transitions / candidate_edges AS valid_pct, {_COVERAGE},
            q.* EXCLUDE (entity_id) FROM lpe p LEFT JOIN {_lat_quantiles('entity_id')} q ON p.entity_id = q.entity_id"""),
            "valid_pct coverage_pct coverage_all_raw_pct " + _LQ,
            "candidate_edges valid_transitions segments longest_segment action_positive_cells actions_in_record "
            "actions_captured future_state_mappings reward_precedes_action raw_actions"), "B12"),
    "lattice_summary_by_split": query(
        lambda s, d: G.lattice_summary(lattice(s, d), R.actions(s, d), R.GAPS, by_split=True),
        rounded(with_(_LAT_SUM, f""", ls AS (SELECT split, count(DISTINCT entity_id) AS entities, max(longest_segment) AS longest_segment,
            sum(candidate_edges) AS candidate_edges, sum(valid_transitions) AS valid_transitions, sum(segments) AS segments,
            sum(action_positive_cells) AS action_positive_cells, sum(actions_in_record) AS actions_in_record,
            sum(actions_captured) AS actions_captured, sum(future_state_mappings) AS future_state_mappings,
            sum(reward_precedes_action) AS reward_precedes_action, sum(raw_actions) AS raw_actions FROM lpe GROUP BY 1)
            SELECT ls.*, 100.0 * valid_transitions / candidate_edges AS valid_pct, {_COVERAGE}, q.* EXCLUDE (split)
            FROM ls LEFT JOIN {_lat_quantiles('split')} q ON ls.split = q.split"""),
            "valid_pct coverage_pct coverage_all_raw_pct " + _LQ,
            "longest_segment candidate_edges valid_transitions segments action_positive_cells actions_in_record "
            "actions_captured future_state_mappings reward_precedes_action raw_actions"), "B13"),
    "lattice_reason_counts": query(
        lambda s, d: G.lattice_reason_counts(lattice(s, d)),
        with_(LATTICE, """SELECT split, reason, count(*) AS n FROM (SELECT split, unnest(string_split(reasons, '|')) AS reason
            FROM lat WHERE reasons <> '') GROUP BY 1, 2"""), "B13"),
    "strategy_retention": query(
        lambda s, d: G.strategy_retention(edges(s, d), lattice(s, d)),
        rounded(with_(LATTICE, """, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY transitions DESC, first_edge) AS rl,
            row_number() OVER (PARTITION BY entity_id ORDER BY first_edge) AS rf FROM runs),
            parts AS (SELECT split, entity_id, 'longest_segment' AS strategy, transitions, action_positive FROM ranked WHERE rl = 1
              UNION ALL SELECT split, entity_id, 'first_segment', transitions, action_positive FROM ranked WHERE rf = 1
              UNION ALL SELECT split, entity_id, 'actual_all_valid_mask', transitions, action_positive FROM runs
              UNION ALL SELECT split, entity_id, 'lattice_all_valid_mask', count(*), sum(action) FROM lat2 WHERE valid
                GROUP BY split, entity_id, run)
            SELECT split, strategy, count(DISTINCT entity_id) AS entities, sum(transitions) AS transitions,
              sum(action_positive) AS action_positive, count(*) AS segments,
              100.0 * sum(action_positive) / sum(transitions) AS action_pct FROM parts GROUP BY 1, 2"""),
            "action_pct", "transitions action_positive segments"), "B14"),
    "strategy_entities": query(
        lambda s, d: G.strategy_entities(edges(s, d), R.observations(s, d)),
        rounded(with_(EDGES, f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY transitions DESC, first_edge) AS rl,
            row_number() OVER (PARTITION BY entity_id ORDER BY first_edge) AS rf FROM runs),
            pick AS (SELECT *, 'longest_segment' AS strategy FROM ranked WHERE rl = 1 UNION ALL
              SELECT *, 'first_segment' FROM ranked WHERE rf = 1)
            SELECT p.entity_id, p.split, strategy, start_ts, end_ts, {mins('t0', 'start_ts')} / 60 AS start_elapsed_h, transitions,
              action_positive, 100.0 * action_positive / transitions AS action_pct
            FROM pick p JOIN (SELECT entity_id, min(ts) AS t0 FROM obs GROUP BY 1) o ON p.entity_id = o.entity_id"""),
            "start_elapsed_h action_pct", "transitions action_positive"), "B14"),
    "suffix_support": query(
        lambda s, d: G.suffix_support(edges(s, d)),
        rounded(with_(EDGES, """, first AS (SELECT split, entity_id, edge_index - min(edge_index) OVER (PARTITION BY entity_id) AS step, action
              FROM edges WHERE valid AND segment_id = 0),
            tm AS (SELECT split, max(step) + 1 AS t_max FROM first GROUP BY 1),
            ks AS (SELECT split, ratio, t_max, greatest(1, round_even(ratio * t_max, 0)::BIGINT) AS kappa FROM tm
              CROSS JOIN (VALUES (0.2::DOUBLE), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)) v(ratio)),
            k2 AS (SELECT *, t_max - kappa AS suffix_start, t_max - kappa + kappa // 2 AS mid FROM ks)
            SELECT k.split, ratio, t_max, suffix_start, kappa, count(*) FILTER (step = suffix_start) AS entities_after_start,
              count(*) AS transitions, sum(action) AS action_positive, coalesce(sum(action) FILTER (step < mid), 0) AS action_left,
              coalesce(sum(action) FILTER (step >= mid), 0) AS action_right
            FROM k2 k JOIN first f ON k.split = f.split AND f.step >= k.suffix_start GROUP BY 1, 2, 3, 4, 5"""),
            "ratio", "t_max suffix_start kappa entities_after_start transitions action_positive action_left action_right"), "B15"),
    "scheme_overlap": query(
        lambda s, d: G.scheme_overlap(R.actions(s, d), edges(s, d), lattice(s, d), R.CHUNK_MIN),
        rounded(with_(LATTICE, """, f AS (SELECT a.entity_id, a.split, EXISTS (SELECT 1 FROM edges e WHERE e.entity_id = a.entity_id AND e.valid
              AND e.tau_t <= a.ts AND a.ts < e.tau_next) AS x, EXISTS (SELECT 1 FROM lat2 l WHERE l.entity_id = a.entity_id AND l.valid
              AND l.tau_t <= a.ts AND a.ts < l.tau_next) AS y FROM act a)
            SELECT entity_id, split, count(*) AS raw_actions, count(*) FILTER (x) AS captured_actual, count(*) FILTER (y) AS captured_lattice,
              count(*) FILTER (x AND y) AS captured_both, count(*) FILTER (x AND NOT y) AS actual_only,
              count(*) FILTER (NOT x AND y) AS lattice_only, count(*) FILTER (NOT x AND NOT y) AS captured_neither FROM f GROUP BY 1, 2
            """)), "B16"),
    "record_axes": query(
        lambda s, d: G.record_axes(R.observations(s, d), R.actions(s, d)),
        rounded(with_(BASE, f"""SELECT o.entity_id, o.split, first_ts, last_ts, unique_observations,
            {mins('first_ts', 'last_ts')} / 1440 AS duration_days, coalesce(raw_actions, 0) AS raw_actions FROM
            (SELECT entity_id, split, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS unique_observations FROM obs GROUP BY 1, 2) o
            LEFT JOIN (SELECT entity_id, count(*) AS raw_actions FROM act GROUP BY 1) a ON o.entity_id = a.entity_id"""),
            "duration_days", "raw_actions"), "B17"),
}
