"""Registered queries: landmark family, risk panel, support screen, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import landmark as L
from ..operators import panel as PN
from ..operators import support as S
from ..params import SupportRule
from ..session import shared_table
from . import gap_queries as GQ
from . import roles as R
from . import trajectory_queries as TQ
from .registry import Query, query, rounded
from .sql import CUTS_SQL, DAILY, EDGES, mins, screen_sql, with_

LANDMARKS = (0.0, 24.0, 72.0, 168.0, 336.0)
RULE = L.LandmarkRule(max_entry_delay_min=720.0, record_burnin_min=1440.0, burnin_edges=2, burnin_gap_min=(0.0, 2160.0),
                      legal_gap_min=(60.0, 2160.0), genuine_gap_min=2880.0, chunk_min=R.CHUNK_MIN)
STEP = 3
SEED = 20240101
PANEL_RULE = SupportRule(40, 3.0, 6, 5, 4, 0.60, 0.45)
STRICTER = SupportRule(300, 5.0, 8, 7, 6, 0.50, 0.0095)


def index(s: SparkSession, d: str) -> DataFrame:
    return shared_table(s, d, "followup_index", lambda: L.followup_index(GQ.steps(s, d), RULE))


def _testing() -> "F.Column":
    return F.col("tau_t") >= F.lit("2024-01-16").cast("timestamp_ntz")


def continued_index(s: SparkSession, d: str) -> DataFrame:
    return shared_table(s, d, "continued_index", lambda: L.followup_index(GQ.steps(s, d), RULE, _testing()))


def trajectories(s: SparkSession, d: str) -> DataFrame:
    return shared_table(s, d, "trajectories", lambda: L.landmark_trajectories(index(s, d), LANDMARKS, RULE, "reset"))


def continued(s: SparkSession, d: str) -> DataFrame:
    return L.landmark_trajectories(continued_index(s, d), (336.0, 360.0, 408.0), RULE, "continued")


def fractions(s: SparkSession, d: str) -> DataFrame:
    return shared_table(s, d, "fraction_support", lambda: L.side_support(
        index(s, d), trajectories(s, d), L.fraction_cuts(trajectories(s, d))))


def summary(s: SparkSession, d: str) -> DataFrame:
    return shared_table(s, d, "landmark_summary", lambda: L.landmark_summary(trajectories(s, d), fractions(s, d)))


def support_map(s: SparkSession, d: str) -> DataFrame:
    return L.support_flags(L.side_support(index(s, d), trajectories(s, d), L.grid_cuts(trajectories(s, d), STEP)), low_active=3)


def segments(s: SparkSession, d: str) -> DataFrame:
    return shared_table(s, d, "daily_segments", lambda: PN.rectangular_segments(R.daily_cells(s, d), width=10))


def panel(s: SparkSession, d: str) -> DataFrame:
    return shared_table(s, d, "daily_panel", lambda: PN.eligible_panel(segments(s, d), "reentry", *R.WINDOW, burnin=2))


def strict_panel(s: SparkSession, d: str) -> DataFrame:
    return PN.eligible_panel(segments(s, d), "strict_first_gap", *R.WINDOW)


def screened(s: SparkSession, d: str, rule: SupportRule = PANEL_RULE) -> DataFrame:
    return shared_table(s, d, f"screened-{rule}", lambda: S.screen(PN.support_view(panel(s, d)), R.CUTS, *R.WINDOW, rule, R.STATE_DIM))


def _jitter(day) -> "F.Column":
    return F.pmod(F.col("entity_id") * 7 + day * 13, F.lit(60)) - 30


def clocked_segments(s: SparkSession, d: str) -> DataFrame:
    """Daily segments with clock times that jitter around the lattice."""
    origin = F.lit("2024-01-01").cast("timestamp_ntz")
    def at(day):
        return origin + F.make_dt_interval(days=day.cast("int"), mins=_jitter(day).cast("int"))
    return segments(s, d).select(
        "entity_id", "segment_id", F.col("local_index").alias("transition_index"), at(F.col("t")).alias("tau_t"),
        at(F.col("t") + 1).alias("tau_next"), "action", "reward", "state", "next_state")


def recording_starts(s: SparkSession, d: str) -> DataFrame:
    return R.daily_cells(s, d).where("observed").groupBy("entity_id").agg(F.min("t").alias("_t")).select(
        "entity_id", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("_t").cast("int"))
                      - F.make_dt_interval(mins=F.lit(30))).alias("recording_start"))


def clocked_panel(s: SparkSession, d: str, rule: str = "continuous_burnin") -> DataFrame:
    return PN.build_risk_panel(clocked_segments(s, d), recording_starts(s, d), "training", 1440.0, 1440.0, 2, rule)


def _wide(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ("state", "next_state")], *[F.col("state")[i].alias(f"s{i}") for i in range(3)],
                     *[F.col("next_state")[i].alias(f"n{i}") for i in range(3)])


# ------------------------------------------------------------------------------- SQL
def _landmark_ctes(marks: tuple, clock: str, phase: str) -> str:
    values = ", ".join(f"({h}::DOUBLE)" for h in marks)
    return EDGES + f""",
li AS (SELECT *, row_number() OVER w - 1 AS idx, {mins('prev_ts', 'ts')} AS pg, {mins('ts', 'tau_next')} AS ng FROM e0 WINDOW w AS (PARTITION BY entity_id ORDER BY ts)),
lr AS (SELECT *, coalesce(ng BETWEEN 60 AND 2160, false) AS legal, coalesce(pg BETWEEN 0 AND 2160, false) AS burn FROM li),
l1 AS (SELECT *, ts AS tau_t FROM lr),
cl AS (SELECT entity_id, split, min(ts) AS clock_start, min(ts) FILTER ({phase}) AS efrom, max(ts) FILTER ({phase}) AS eto FROM obs GROUP BY 1, 2),
tg AS (SELECT cl.*, h AS landmark_h, clock_start + to_minutes((h * 60)::BIGINT) AS target_ts FROM cl CROSS JOIN (VALUES {values}) v(h)),
en AS (SELECT t.*, (SELECT min(ts) FROM obs o WHERE o.entity_id = t.entity_id AND o.ts >= greatest(t.target_ts, t.efrom)) AS entry FROM tg t),
ei AS (SELECT e.*, l.idx AS entry_idx, {mins('target_ts', 'entry')} AS delay, {mins('clock_start', 'entry')} AS age,
    (SELECT count(*) FROM l1 b WHERE b.entity_id = e.entity_id AND b.idx > l.idx - 2 AND b.idx <= l.idx AND b.burn) AS nb,
    (SELECT min(f.idx) FROM l1 f WHERE f.entity_id = e.entity_id AND f.idx >= l.idx AND NOT f.legal) AS last_idx
    FROM en e LEFT JOIN l1 l ON l.entity_id = e.entity_id AND l.ts = e.entry),
ef AS (SELECT e.*, z.ts AS end_ts, z.ng AS stop_gap, CASE WHEN entry IS NULL THEN 'no_observation_at_or_after_landmark'
    WHEN entry > eto THEN 'landmark_outside_allowed_window' WHEN delay < 0 OR delay >= 720 THEN 'no_boundary_within_entry_tolerance'
    WHEN age < 1440 THEN 'insufficient_record_burnin' WHEN entry_idx < 2 THEN 'insufficient_history_burnin'
    WHEN nb < 2 THEN 'noncontinuous_history_burnin' ELSE '' END AS block,
    (SELECT count(*) FROM edges x WHERE x.entity_id = e.entity_id AND x.edge_index >= entry_idx AND x.edge_index < last_idx AND x.action = 1) AS acts
    FROM ei e LEFT JOIN l1 z ON z.entity_id = e.entity_id AND z.idx = e.last_idx),
tr AS (SELECT entity_id, split, '{clock}' AS clock, landmark_h, target_ts, CASE WHEN block NOT IN ('no_observation_at_or_after_landmark', 'landmark_outside_allowed_window') THEN entry END AS entry_ts,
    CASE WHEN block NOT IN ('no_observation_at_or_after_landmark', 'landmark_outside_allowed_window') THEN delay END AS entry_delay_min, block = '' AS state_eligible,
    block = '' AND last_idx - entry_idx >= 1 AS trajectory_eligible, CASE WHEN block = '' THEN last_idx - entry_idx ELSE 0 END AS "T",
    CASE WHEN block = '' THEN acts ELSE 0 END AS "A1", CASE WHEN block = '' AND end_ts > entry THEN acts / ({mins('entry', 'end_ts')} / 1440) END AS actions_per_day,
    CASE WHEN block <> '' THEN '' WHEN stop_gap IS NULL THEN 'record_termination' WHEN stop_gap > 2880 THEN 'genuine_gap' ELSE 'non_genuine_illegal_edge' END AS censor_reason,
    CASE WHEN block = '' THEN stop_gap END AS censor_gap_min, CASE WHEN block = '' THEN end_ts END AS end_ts, CASE WHEN block = '' THEN entry_idx END AS entry_idx,
    CASE WHEN block = '' AND last_idx = entry_idx THEN 'state_available_but_zero_followup' ELSE block END AS ineligible_reason FROM ef)"""


_TR = _landmark_ctes(LANDMARKS, "reset", "true")
_TR2 = _landmark_ctes((336.0, 360.0, 408.0), "continued", "ts >= TIMESTAMP '2024-01-16'")
_TR_INTS = '"T" "A1"'
_STEPS = """,
stp AS (SELECT t.entity_id, t.clock, t.landmark_h, t."T", x.edge_index - t.entry_idx AS pos, x.action, x.tau_t FROM tr t JOIN edges x
    ON x.entity_id = t.entity_id AND x.edge_index >= t.entry_idx AND x.edge_index < t.entry_idx + t."T" WHERE t.trajectory_eligible),
tm AS (SELECT clock, landmark_h, max("T") AS t_max FROM tr WHERE trajectory_eligible GROUP BY 1, 2)"""


def _side_sql(extra: str) -> str:
    key = f"{extra}, " if extra else ""
    return f""",
sx AS (SELECT c.clock, c.landmark_h, {key}c.u, s.entity_id, count(*) FILTER (pos < u) AS lt, count(*) FILTER (pos >= u) AS rt,
    coalesce(sum(action) FILTER (pos < u), 0) AS la, coalesce(sum(action) FILTER (pos >= u), 0) AS ra
    FROM cuts c JOIN stp s ON s.clock = c.clock AND s.landmark_h = c.landmark_h GROUP BY ALL),
ss AS (SELECT clock, landmark_h, {key}u, count(*) FILTER (lt > 0) AS left_entities, count(*) FILTER (rt > 0) AS active_at_u, sum(lt) AS left_transitions,
    sum(lt) - sum(la) AS "left_A0", sum(la) AS "left_A1", sum(rt) AS right_transitions, sum(rt) - sum(ra) AS "right_A0", sum(ra) AS "right_A1",
    max(la) / nullif(sum(la), 0) AS "left_max_A1_share", max(ra) / nullif(sum(ra), 0) AS "right_max_A1_share",
    CASE WHEN sum(la) > 0 THEN arg_max(entity_id, (la, -entity_id)) END AS left_dominant_entity,
    CASE WHEN sum(ra) > 0 THEN arg_max(entity_id, (ra, -entity_id)) END AS right_dominant_entity FROM sx GROUP BY ALL)"""


_FRAC = _TR + _STEPS + """,
cuts AS (SELECT clock, landmark_h, f AS fraction, greatest(1, round_even(f * t_max, 0)::BIGINT) AS u FROM tm
    CROSS JOIN (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8)) v(f))""" + _side_sql("fraction")
_GRID = _TR + _STEPS + """,
cuts AS (SELECT clock, landmark_h, unnest(generate_series(3, t_max - 1, 3)) AS u FROM tm)""" + _side_sql("") + """,
sf AS (SELECT *, active_at_u <= 3 AS flag_few_active, "left_A1" < 5 AS "flag_left_A1_lt5", "right_A1" < 5 AS "flag_right_A1_lt5",
    "left_A1" < 10 AS "flag_left_A1_lt10", "right_A1" < 10 AS "flag_right_A1_lt10", coalesce("left_max_A1_share" >= 0.5, false) AS flag_left_dominance,
    coalesce("right_max_A1_share" >= 0.5, false) AS flag_right_dominance FROM ss)"""
_SIDE_INTS = 'left_transitions left_A0 left_A1 right_transitions right_A0 right_A1'
_SUMMARY = _FRAC + """,
ls AS (SELECT t.clock, t.landmark_h, count(*) FILTER (state_eligible) AS state_eligible_entities, count(*) FILTER (trajectory_eligible) AS eligible_entities,
    count(*) FILTER (NOT trajectory_eligible) AS ineligible_entities, coalesce(min("T") FILTER (trajectory_eligible), 0) AS "min_T",
    coalesce(max("T") FILTER (trajectory_eligible), 0) AS "max_T", coalesce(sum("T") FILTER (trajectory_eligible), 0) AS total_transitions,
    coalesce(sum("A1") FILTER (trajectory_eligible), 0) AS total_action_positive, coalesce(min("A1") FILTER (trajectory_eligible), 0) AS "min_A1",
    coalesce(max("A1") FILTER (trajectory_eligible), 0) AS "max_A1", count(*) FILTER (trajectory_eligible AND "A1" = 0) AS "entities_zero_A1",
    max(entry_delay_min) FILTER (trajectory_eligible) AS entry_delay_max,
    count(*) FILTER (trajectory_eligible AND censor_reason = 'genuine_gap') AS censored_genuine_gap,
    count(*) FILTER (trajectory_eligible AND censor_reason = 'non_genuine_illegal_edge') AS censored_timing_edge,
    coalesce(sum("T" - "A1") FILTER (trajectory_eligible), 0) AS "total_A0",
    100.0 * sum("A1") FILTER (trajectory_eligible) / sum("T") FILTER (trajectory_eligible) AS action_pct,
    coalesce(quantile_cont("T"::DOUBLE, 0.5) FILTER (trajectory_eligible), 0) AS "median_T", coalesce(quantile_cont("A1"::DOUBLE, 0.5) FILTER (trajectory_eligible), 0) AS "median_A1",
    quantile_cont(actions_per_day, 0.5) FILTER (trajectory_eligible) AS median_actions_per_day,
    quantile_cont(entry_delay_min, 0.5) FILTER (trajectory_eligible) AS entry_delay_median FROM tr t GROUP BY 1, 2),
fo AS (SELECT clock, landmark_h, min(least("left_A1", "right_A1")) AS w, min(active_at_u) AS m, max(greatest("left_max_A1_share", "right_max_A1_share")) AS d
    FROM ss WHERE fraction BETWEEN 0.2 AND 0.8 GROUP BY 1, 2),
lsum AS (SELECT ls.*, coalesce(w, 0) AS worst_side_action, coalesce(m, 0) AS minimum_active, d AS maximum_dominance FROM ls LEFT JOIN fo
    ON ls.clock = fo.clock AND ls.landmark_h = fo.landmark_h)"""
_SUM_D = "median_T median_A1 median_actions_per_day entry_delay_median entry_delay_max action_pct maximum_dominance landmark_h"
_SUM_I = "min_T max_T total_transitions total_action_positive min_A1 max_A1 total_A0 worst_side_action minimum_active"
_AXES = """axes AS (SELECT entity_id, min(ts) FILTER (ts < TIMESTAMP '2024-01-16') AS training_start, max(ts) FILTER (ts < TIMESTAMP '2024-01-16') AS training_last,
    min(ts) FILTER (ts >= TIMESTAMP '2024-01-16') AS testing_start, max(ts) FILTER (ts >= TIMESTAMP '2024-01-16') AS testing_end FROM obs GROUP BY 1),
ax AS (SELECT *, epoch_us(testing_start) / 3.6e9 - epoch_us(training_start) / 3.6e9 AS testing_start_h,
    (epoch_us(testing_end) - epoch_us(training_start)) / 3600000000.0 AS testing_end_h, (epoch_us(testing_start) - epoch_us(training_last)) / 60000000.0 AS boundary_gap_min
    FROM axes WHERE training_start IS NOT NULL AND testing_start IS NOT NULL)""".replace(
    "epoch_us(testing_start) / 3.6e9 - epoch_us(training_start) / 3.6e9", "(epoch_us(testing_start) - epoch_us(training_start)) / 3600000000.0")
_SCR_D = " ".join(f"{s}_{t}_{m}" for s in ("left", "right") for t in ("transitions", "A0", "A1") for m in ("max_share", "ess"))
_SCR_I = "candidate required_count " + " ".join(f"{s}_{t}" for s in ("left", "right") for t in ("transitions", "A0", "A1"))
_SEG_COLS = "entity_id, t, action, reward, segment_id, local_index, missed_before, s0, s1, s2, n0, n1, n2"
_JIT = "((entity_id * 7 + ({d}) * 13) % 60 - 30)"
_CLOCKED = DAILY + f""",
ck AS (SELECT *, TIMESTAMP '2024-01-01' + to_minutes(t * 1440 + {_JIT.format(d='t')}) AS tau_t,
    TIMESTAMP '2024-01-01' + to_minutes((t + 1) * 1440 + {_JIT.format(d='t + 1')}) AS tau_next FROM seg),
rs AS (SELECT entity_id, TIMESTAMP '2024-01-01' + to_minutes(min(t) * 1440 - 30) AS r0 FROM seg GROUP BY 1),
ce AS (SELECT c.*, {mins('r0', 'tau_t')} AS age, {mins('r0', 'tau_next')} AS age2, c.segment_id > min(c.segment_id) OVER (PARTITION BY c.entity_id) AS later
    FROM ck c JOIN rs r ON c.entity_id = r.entity_id)"""


def _clocked_sql(rule: str) -> str:
    keep, tag = ("AND NOT (later AND local_index < 2)", "continuous") if rule == "continuous_burnin" else ("", "sparse")
    return rounded(with_(_CLOCKED, f""" SELECT entity_id, segment_id, local_index AS transition_index, tau_t, tau_next, action, reward, 'training' AS clock_type,
        floor(age / 1440 + 0.5)::BIGINT AS elapsed_index, floor(age2 / 1440 + 0.5)::BIGINT AS next_index, age - 1440 * floor(age / 1440 + 0.5) AS lattice_residual_min,
        age2 - 1440 * floor(age2 / 1440 + 0.5) AS next_lattice_residual_min, CASE WHEN later THEN 'eligible_post_gap_{tag}' ELSE 'eligible_initial_history' END AS valid_reason,
        s0, s1, s2, n0, n1, n2 FROM ce WHERE age >= 1440 {keep}"""), "lattice_residual_min next_lattice_residual_min s0 s1 s2 n0 n1 n2 reward", "segment_id transition_index action")


_EVAL = DAILY + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY md5('{SEED}:' || entity_id || ':' || elapsed_index), elapsed_index) AS round FROM panel),
es AS (SELECT round, entity_id, elapsed_index, s0, s1, s2 FROM rk ORDER BY round, entity_id LIMIT 32),
eb AS (SELECT *, row_number() OVER (ORDER BY round, entity_id) - 1 AS b FROM es),
grid AS (SELECT a * (SELECT count(*) FROM es) + b AS z, a AS value_action, entity_id, elapsed_index, s0, s1, s2 FROM eb CROSS JOIN (VALUES (0), (1)) v(a))"""

QUERIES: dict[str, Query] = {
    "landmark_trajectories": query(
        trajectories, rounded(with_(_TR, "SELECT * FROM tr"), "entry_delay_min actions_per_day censor_gap_min landmark_h", 'T A1 entry_idx'), "F1 F2"),
    "continued_clock_trajectories": query(
        continued, rounded(with_(_TR2, "SELECT * FROM tr"), "entry_delay_min actions_per_day censor_gap_min landmark_h", 'T A1 entry_idx'), "A5 F1 F2 F8"),
    "landmark_action_vectors": query(
        lambda s, d: L.action_vectors(index(s, d), trajectories(s, d)).drop("split"),
        rounded(with_(_TR + _STEPS, 'SELECT entity_id, clock, landmark_h, pos AS position, tau_t, action FROM stp'), "landmark_h", "position action"), "F3"),
    "landmark_fraction_support": query(
        fractions, rounded(with_(_FRAC, "SELECT * FROM ss"), "fraction left_max_A1_share right_max_A1_share landmark_h", "u " + _SIDE_INTS), "F4 F5"),
    "landmark_summary": query(summary, rounded(with_(_SUMMARY, "SELECT * FROM lsum"), _SUM_D, _SUM_I), "F5"),
    "landmark_active_curve": query(
        lambda s, d: L.active_curve(trajectories(s, d), 4),
        rounded(with_(_TR + _STEPS, """, g AS (SELECT clock, landmark_h, unnest(generate_series(0, t_max, 4)) AS u FROM tm UNION SELECT clock, landmark_h, t_max FROM tm)
            SELECT g.clock, g.landmark_h, u AS followup_transition, (SELECT count(*) FROM tr t WHERE t.clock = g.clock AND t.landmark_h = g.landmark_h
            AND t.trajectory_eligible AND t."T" > u) AS active FROM g"""), "landmark_h", "followup_transition"), "F5"),
    "pareto_landmarks": query(
        lambda s, d: L.pareto_frontier(summary(s, d), "clock"),
        rounded(with_(_SUMMARY, """, x AS (SELECT * FROM lsum WHERE eligible_entities > 0) SELECT * FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE b.clock = a.clock AND """
            + " AND ".join(f'b."{o}" >= a."{o}"' for o in L.OBJECTIVES) + " AND (" + " OR ".join(f'b."{o}" > a."{o}"' for o in L.OBJECTIVES) + "))"), _SUM_D, _SUM_I), "F6"),
    "landmark_support_map": query(
        support_map, rounded(with_(_GRID, "SELECT * FROM sf"), "left_max_A1_share right_max_A1_share landmark_h", "u " + _SIDE_INTS), "F7"),
    "landmark_support_summary": query(
        lambda s, d: L.support_map_summary(support_map(s, d)),
        rounded(with_(_GRID, """SELECT clock, landmark_h, count(u) AS cut_count, min(active_at_u) AS minimum_active_at_u, count(*) FILTER (flag_few_active) AS cuts_few_active,
            min("left_A1") AS "minimum_left_A1", min("right_A1") AS "minimum_right_A1", """ + ", ".join(
            f'count(*) FILTER ("flag_{s}_A1_lt{n}") AS "cuts_{s}_A1_lt{n}"' for n in (5, 10) for s in ("left", "right")) + """,
            max("left_max_A1_share") AS "maximum_left_A1_share", max("right_max_A1_share") AS "maximum_right_A1_share",
            count(*) FILTER (flag_left_dominance) AS cuts_left_dominance, count(*) FILTER (flag_right_dominance) AS cuts_right_dominance FROM sf GROUP BY 1, 2"""),
            "maximum_left_A1_share maximum_right_A1_share landmark_h", "minimum_left_A1 minimum_right_A1"), "F7"),
    "landmark_reasons": query(
        lambda s, d: L.reason_summary(trajectories(s, d)),
        rounded(with_(_TR, "SELECT clock, landmark_h, trajectory_eligible, ineligible_reason, censor_reason, count(*) AS entities FROM tr GROUP BY ALL"), "landmark_h"), "F7"),
    "clock_axes": query(
        lambda s, d: L.clock_axes(R.observations(s, d), F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")),
        rounded(with_(EDGES, f", {_AXES} SELECT * FROM ax"), "testing_start_h testing_end_h boundary_gap_min"), "F8"),
    "clock_overlap": query(
        lambda s, d: L.common_overlap(L.clock_axes(R.observations(s, d), F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))),
        rounded(with_(EDGES, f""", {_AXES} SELECT max(testing_start_h) AS overlap_start_h, min(testing_end_h) AS overlap_end_h,
            greatest(0, min(testing_end_h) - max(testing_start_h)) AS overlap_duration_h FROM ax"""), "overlap_start_h overlap_end_h overlap_duration_h"), "F8"),
    "landmark_gate": query(
        lambda s, d: L.eligibility_gate(summary(s, d)),
        rounded(with_(_SUMMARY, """SELECT clock, landmark_h, eligible_entities, minimum_active, worst_side_action, maximum_dominance,
            minimum_active >= 6 AND worst_side_action >= 66 AND coalesce(maximum_dominance <= 0.6, false) AS support_pass FROM lsum"""),
            "maximum_dominance landmark_h", "minimum_active worst_side_action"), "F9"),
    "landmark_cohort": query(
        lambda s, d: L.landmark_cohort(TQ.cells(s, d), 48.0, 720.0),
        rounded(with_(TQ.CELLS_ONLY, f""", v AS (SELECT *, ({mins('min(tau_t) OVER (PARTITION BY entity_id)', 'tau_t')}) - 2880 AS el FROM cells WHERE valid),
            h AS (SELECT entity_id, min((segment_id, tau_t, el)) AS m FROM v WHERE el >= 0 AND el < 720 GROUP BY 1)
            SELECT v.entity_id, v.split, v.segment_id, m[2] AS entry_ts, m[3] AS entry_delay_min, count(*) AS "T", sum(action) AS action_positive,
              avg(reward_binary) AS reward_mean, max(tau_next) AS end_ts FROM v JOIN h ON v.entity_id = h.entity_id AND v.segment_id = m[1] AND v.tau_t >= m[2]
            GROUP BY ALL"""), "entry_delay_min reward_mean", "segment_id action_positive"), "F10"),
    "risk_panel": query(lambda s, d: _wide(clocked_panel(s, d)), _clocked_sql("continuous_burnin"), "G1 G2"),
    "risk_panel_sparse": query(lambda s, d: _wide(clocked_panel(s, d, "sparse_history")), _clocked_sql("sparse_history"), "G1 G2"),
    "panel_violations": query(
        lambda s, d: PN.panel_violations(clocked_panel(s, d), 25.0, (1400.0, 1480.0), 3).groupBy("rule").agg(F.count(F.lit(1)).alias("n")),
        rounded(with_(_CLOCKED, f""", pv AS (SELECT *, age - 1440 * floor(age / 1440 + 0.5) AS r, age2 - 1440 * floor(age2 / 1440 + 0.5) AS q FROM ce
            WHERE age >= 1440 AND NOT (later AND local_index < 2)), bad AS (SELECT 'lattice_residual' AS rule FROM pv WHERE abs(r) > 25 OR abs(q) > 25
            UNION ALL SELECT 'edge_gap' FROM pv WHERE {mins('tau_t', 'tau_next')} NOT BETWEEN 1400 AND 1480
            UNION ALL SELECT 'advances_one_cell' FROM pv WHERE floor(age2 / 1440 + 0.5) <> floor(age / 1440 + 0.5) + 1)
            SELECT rule, count(*) AS n FROM bad GROUP BY 1""")), "G13"),
    "rectangular_segments": query(
        lambda s, d: _wide(segments(s, d)).select(*[c.strip() for c in _SEG_COLS.split(",")]),
        rounded(with_(DAILY, f"SELECT {_SEG_COLS} FROM seg"), "s0 s1 s2 n0 n1 n2 reward", "t action segment_id local_index"), "G3"),
    "rectangular_violations": query(
        lambda s, d: PN.rectangular_violations(R.daily_cells(s, d), 2, 9, False, 6).groupBy("rule").agg(F.count(F.lit(1)).alias("n")),
        with_(DAILY, """SELECT 'outside_window' AS rule, count(*) AS n FROM rect WHERE t NOT BETWEEN 2 AND 8 HAVING count(*) > 0
        UNION ALL SELECT 'never_observed', count(*) FROM (SELECT entity_id FROM rect GROUP BY 1 HAVING NOT bool_or(observed AND t BETWEEN 2 AND 8)) HAVING count(*) > 0"""), "G13"),
    "reentry_panel": query(
        lambda s, d: _wide(panel(s, d)).select("entity_id", "elapsed_index", "segment_id", "local_index", "action", "reward", "s0", "n0"),
        rounded(with_(DAILY, "SELECT entity_id, elapsed_index, segment_id, local_index, action, reward, s0, n0 FROM panel"),
                "s0 n0 reward", "elapsed_index segment_id local_index action"), "G4 G5"),
    "strict_panel": query(
        lambda s, d: strict_panel(s, d).select("entity_id", "elapsed_index", "segment_id", "local_index", "action", "reward"),
        rounded(with_(DAILY, "SELECT entity_id, elapsed_index, segment_id, local_index, action, reward FROM strict"),
                "reward", "elapsed_index segment_id local_index action"), "G4"),
    "panel_diagnostics": query(
        lambda s, d: PN.panel_diagnostics(panel(s, d), width=10),
        rounded(with_(DAILY, """, p AS (SELECT *, lag(elapsed_index) OVER w AS pe, lag(segment_id) OVER w AS ps FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY elapsed_index))
            SELECT entity_id, count(*) AS transitions, sum(action) AS action1, count(DISTINCT segment_id) AS segments, count(DISTINCT segment_id) - 1 AS reentries,
            coalesce(sum(elapsed_index - pe - 1), 0) AS elapsed_holes FROM p GROUP BY 1"""), "", "action1 elapsed_holes"), "G6"),
    "panel_totals": query(
        lambda s, d: PN.panel_totals(PN.panel_diagnostics(panel(s, d), width=10)),
        rounded(with_(DAILY, """, p AS (SELECT *, lag(elapsed_index) OVER w AS pe FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY elapsed_index)),
            q AS (SELECT entity_id, count(*) AS n, sum(action) AS a, count(DISTINCT segment_id) - 1 AS r, coalesce(sum(elapsed_index - pe - 1), 0) AS h FROM p GROUP BY 1)
            SELECT count(*) AS entities, sum(n) AS transitions, sum(a) AS action1, sum(n) - sum(a) AS action0, sum(r) AS reentries, sum(h) AS elapsed_holes,
            sum(a) / sum(n) AS action1_rate FROM q"""), "action1_rate", "transitions action1 action0 reentries elapsed_holes"), "G6"),
    "evaluation_grid": query(
        lambda s, d: PN.evaluation_grid(PN.evaluation_sample(panel(s, d), 32, SEED)).select(
            "z", "value_action", "entity_id", "elapsed_index", *[F.col("state")[i].alias(f"s{i}") for i in range(3)]),
        rounded(with_(_EVAL, "SELECT * FROM grid"), "s0 s1 s2", "z value_action elapsed_index"), "G7 G8"),
    "support_screen": query(
        lambda s, d: screened(s, d).withColumn("reasons", F.array_join("reasons", "|")),
        rounded(with_(DAILY + screen_sql("panel", PANEL_RULE, 3), "SELECT *, reasons = '' AS admissible FROM screened"), _SCR_D, _SCR_I), "G9 G10"),
    "elapsed_grid_screen": query(
        lambda s, d: S.screen(PN.support_view(panel(s, d)), PN.elapsed_grid(R.WINDOW[1], 3), *R.WINDOW, PANEL_RULE, R.STATE_DIM).withColumn("reasons", F.array_join("reasons", "|")),
        rounded(with_(DAILY + screen_sql("panel", PANEL_RULE, 3, "(SELECT unnest(generate_series(3, 26, 3)) AS candidate) c"), "SELECT *, reasons = '' AS admissible FROM screened"), _SCR_D, _SCR_I), "G7 G9"),
    "support_screen_strict": query(
        lambda s, d: screened(s, d, STRICTER).withColumn("reasons", F.array_join("reasons", "|")),
        rounded(with_(DAILY + screen_sql("panel", STRICTER, 3), "SELECT *, reasons = '' AS admissible FROM screened"), _SCR_D, _SCR_I), "G9 G10"),
    "support_status": query(
        lambda s, d: S.admissible_status(screened(s, d, S.PROFILES["strict"])),
        with_(DAILY + screen_sql("panel", S.PROFILES["strict"], 3), """SELECT count(*) AS candidates, count(*) FILTER (reasons = '') AS admissible,
            CASE WHEN count(*) FILTER (reasons = '') > 0 THEN 'TESTABLE' ELSE 'NOT_TESTABLE_SUPPORT' END AS status FROM screened"""), "G9"),
    "support_screen_diagnostics": query(
        lambda s, d: S.screen_diagnostics(screened(s, d, STRICTER)),
        rounded(with_(DAILY + screen_sql("panel", STRICTER, 3), """SELECT count(*) AS raw_candidates, count(*) FILTER (reasons = '') AS admissible_candidates,
            max(greatest(left_transitions_max_share, right_transitions_max_share)) AS maximum_total_share, max(greatest("left_A1_max_share", "right_A1_max_share")) AS maximum_action1_share,
            avg((left_transitions_entities + right_transitions_entities) / 2.0) AS mean_active_entities, min(least("left_A1", "right_A1")) AS minimum_side_action1 FROM screened"""),
            "maximum_total_share maximum_action1_share mean_active_entities", "minimum_side_action1"), "G11"),
    "support_reason_counts": query(
        lambda s, d: S.reason_counts(screened(s, d, STRICTER)),
        with_(DAILY + screen_sql("panel", STRICTER, 3), """SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '|')) AS reason FROM screened
            WHERE reasons <> '') GROUP BY 1"""), "G11"),
    "lost_candidates": query(
        lambda s, d: S.lost_candidates(screened(s, d, STRICTER), (6, 12, 18, 24)),
        rounded(with_(DAILY + screen_sql("panel", STRICTER, 3), " UNION ALL ".join(f"""SELECT candidate, '{x}' AS side, {x}_transitions_entities AS active_entities,
            "{x}_A0" AS "A0", "{x}_A1" AS "A1", "{x}_A0_entities" AS "A0_entities", "{x}_A1_entities" AS "A1_entities", "{x}_A1_max_share" AS "max_A1_share",
            {x}_transitions_max_share AS max_total_share, "{x}_A1_ess" AS "A1_ess", reasons FROM screened WHERE reasons <> '' AND candidate IN (6, 12, 18, 24)"""
            for x in ("left", "right"))), "max_A1_share max_total_share A1_ess", "candidate A0 A1"), "G12"),
}
