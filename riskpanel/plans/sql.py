"""Shared common table expressions of the comparison SQL."""

from __future__ import annotations

BASE = """
base AS (SELECT user_id AS entity_id, CASE WHEN user_id % 5 = 0 THEN 'testing' ELSE 'training' END AS split,
    ts, event_id AS ordinal, event_type, value FROM events),
obs AS (SELECT entity_id, split, ts, ordinal, value FROM base WHERE event_type <> 'purchase'),
act AS (SELECT entity_id, split, ts, ordinal, value AS dose,
    ts + to_microseconds(CASE WHEN ordinal % 2 = 0 THEN floor(value * 20)::BIGINT * 60000000 ELSE 0 END) AS ts_end,
    CASE WHEN ordinal % 2 = 0 THEN 'extended' ELSE 'normal' END AS kind FROM base WHERE event_type = 'purchase'),
expo AS (SELECT entity_id, split, ts, ordinal, value AS amount FROM base WHERE event_type = 'click'),
sched AS (SELECT entity_id, split, ts, ordinal, value AS rate FROM base WHERE event_type = 'signup'),
ovr AS (SELECT entity_id, split, ordinal, value AS rate, ts AS ts_begin, ts + INTERVAL 36 HOURS AS ts_end
    FROM base WHERE event_type = 'error' AND ordinal % 3 = 0)"""

MIN = "epoch_us({b}) - epoch_us({a})"


def mins(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 60000000.0)"


EDGES = BASE + f""",
e0 AS (SELECT *, lead(ts) OVER w AS tau_next, lag(ts) OVER w AS prev_ts, lead(value) OVER w AS next_value,
    lag(value) OVER w AS prev_value, row_number() OVER w - 1 AS edge_index
    FROM obs WINDOW w AS (PARTITION BY entity_id, split ORDER BY ts)),
e1 AS (SELECT *, ts AS tau_t, {mins('ts', 'tau_next')} AS gap_min, {mins('prev_ts', 'ts')} AS prev_gap_min
    FROM e0 WHERE tau_next IS NOT NULL),
hits AS (SELECT a.entity_id, e.tau_t, count(*) AS action_count, sum(a.dose) AS action_dose FROM act a
    JOIN e1 e ON a.entity_id = e.entity_id AND e.tau_t <= a.ts AND a.ts < e.tau_next GROUP BY 1, 2),
e2 AS (SELECT e.*, coalesce(h.action_count, 0) AS action_count, coalesce(h.action_dose, 0) AS action_dose,
    (coalesce(h.action_count, 0) > 0)::INT AS action, gap_min BETWEEN 60 AND 1440 AS valid,
    coalesce(prev_gap_min BETWEEN 60 AND 1440, false) AS prev_valid
    FROM e1 e LEFT JOIN hits h ON e.entity_id = h.entity_id AND e.tau_t = h.tau_t),
e3 AS (SELECT *, sum((valid AND NOT prev_valid)::INT) OVER (PARTITION BY entity_id ORDER BY tau_t) - 1 AS seg FROM e2),
edges AS (SELECT *, CASE WHEN valid THEN seg ELSE -1 END AS segment_id FROM e3),
gaps AS (SELECT entity_id, split, edge_index, tau_t, tau_next, gap_min,
    CASE WHEN gap_min < 60 THEN '<1h' WHEN gap_min <= 360 THEN '1-6h' WHEN gap_min <= 720 THEN '6-12h'
      WHEN gap_min <= 1440 THEN '12-24h' WHEN gap_min <= 2880 THEN '24-48h' WHEN gap_min <= 60000 THEN '48-1000h'
      ELSE '>1000h' END AS gap_bin,
    CASE WHEN gap_min < 60 THEN 'sub_nominal_jitter' WHEN gap_min <= 1440 THEN 'nominal'
      WHEN gap_min <= 1800 THEN 'prolonged_jitter_no_missing_cycle'
      WHEN gap_min <= 2160 THEN 'approximately_one_missing' WHEN gap_min <= 2880 THEN 'approximately_two_missing'
      ELSE 'genuine_long_gap_approximately_' || greatest(round_even(gap_min / 720, 0)::BIGINT - 1, 1) || '_missing'
    END AS gap_class, valid, gap_min > 1800 AS genuine_gap FROM edges),
runs AS (SELECT entity_id, split, segment_id, count(*) AS transitions, sum(action) AS action_positive,
    min(edge_index) AS first_edge, min(tau_t) AS start_ts, max(tau_next) AS end_ts
    FROM edges WHERE valid GROUP BY 1, 2, 3)"""

LATTICE = EDGES + f""",
span AS (SELECT entity_id, split, min(ts) AS a, max(ts) AS z FROM obs GROUP BY 1, 2),
pts AS (SELECT entity_id, split, k, a + to_hours(6 * k) AS tau FROM (SELECT *, unnest(generate_series(0,
    floor({mins('a', 'z')} / 360)::BIGINT)) AS k FROM span)),
m0 AS (SELECT p.*, o.ts AS ots FROM pts p ASOF JOIN obs o ON p.entity_id = o.entity_id AND p.tau >= o.ts),
m1 AS (SELECT *, CASE WHEN {mins('ots', 'tau')} <= 180 THEN ots END AS m FROM m0),
m2 AS (SELECT *, lead(tau) OVER w AS tau_next, lead(m) OVER w AS mj FROM m1
    WINDOW w AS (PARTITION BY entity_id ORDER BY k)),
lact AS (SELECT m.entity_id, m.k, count(*) AS n, max(a.ts) AS last_act FROM act a JOIN m2 m
    ON a.entity_id = m.entity_id AND m.tau <= a.ts AND a.ts < m.tau_next GROUP BY 1, 2),
m3 AS (SELECT m.*, coalesce(n, 0) AS n, {mins('m', 'mj')} AS jump, last_act FROM m2 m
    LEFT JOIN lact l ON m.entity_id = l.entity_id AND m.k = l.k WHERE tau_next IS NOT NULL),
lat AS (SELECT entity_id, split, k AS lattice_index, tau AS tau_t, tau_next, m AS state_ts, mj AS next_state_ts,
    {mins('m', 'tau')} AS state_age_min, {mins('mj', 'tau_next')} AS next_age_min, jump AS mapped_step_min,
    (n > 0)::INT AS action, n AS action_count, concat_ws('|',
      CASE WHEN m IS NULL THEN 'no_causal_state' END, CASE WHEN mj IS NULL THEN 'no_causal_next' END,
      CASE WHEN m = mj THEN 'same_observation_reused' END, CASE WHEN mj < m THEN 'nonincreasing_mapped_observation' END,
      CASE WHEN jump > 1440 THEN 'crosses_genuine_gap' END,
      CASE WHEN n > 0 AND last_act >= mj THEN 'reward_not_after_all_cell_actions' END) AS reasons FROM m3),
lat1 AS (SELECT *, reasons = '' AS valid, lag(reasons = '') OVER (PARTITION BY entity_id ORDER BY lattice_index) AS pv FROM lat),
lat2 AS (SELECT *, CASE WHEN valid THEN sum((valid AND NOT coalesce(pv, false))::INT)
    OVER (PARTITION BY entity_id ORDER BY lattice_index) END AS run FROM lat1)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}{body}" if body.lstrip().startswith(",") else f"WITH {ctes.strip()}\n{body}"


DAILY = """
ev AS (SELECT user_id AS entity_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS t, event_type, value FROM events),
dd AS (SELECT entity_id, t, avg(value) AS m, count(*) AS n, max(value) AS x, max((event_type = 'purchase')::INT) AS action FROM ev GROUP BY 1, 2),
ds AS (SELECT entity_id, t, action, m, round(m / 50 + 1e-9, 6) AS s0, n / 4.0::DOUBLE AS s1, round(x / 100 + 1e-9, 6) AS s2 FROM dd),
rect AS (SELECT u.entity_id, g.t, a.action, a.s0, a.s1, a.s2, b.s0 AS n0, b.s1 AS n1, b.s2 AS n2, (b.m BETWEEN 20 AND 70)::INT::DOUBLE AS reward,
    a.t IS NOT NULL AND b.t IS NOT NULL AS observed FROM (SELECT DISTINCT entity_id FROM dd) u CROSS JOIN (SELECT unnest(generate_series(0, 28)) AS t) g
    LEFT JOIN ds a ON a.entity_id = u.entity_id AND a.t = g.t LEFT JOIN ds b ON b.entity_id = u.entity_id AND b.t = g.t + 1),
sg0 AS (SELECT *, lag(observed) OVER w AS po, sum((NOT observed)::INT) OVER w AS miss FROM rect WINDOW w AS (PARTITION BY entity_id ORDER BY t)),
sg1 AS (SELECT *, sum((observed AND NOT coalesce(po, false))::INT) OVER w - 1 AS segment_id,
    max(CASE WHEN observed AND NOT coalesce(po, false) THEN t END) OVER w AS sf FROM sg0 WINDOW w AS (PARTITION BY entity_id ORDER BY t)),
seg AS (SELECT entity_id, t, action, s0, s1, s2, n0, n1, n2, reward, segment_id, t - sf AS local_index, miss > 0 AS missed_before FROM sg1 WHERE observed),
panel AS (SELECT *, t AS elapsed_index FROM seg WHERE segment_id = 0 OR local_index >= 2),
strict AS (SELECT *, t AS elapsed_index FROM seg WHERE NOT missed_before)"""

CUTS_SQL = "(VALUES (6), (9), (12), (15), (18), (21), (24)) c(candidate)"


def screen_sql(panel: str, rule, dim: int, cuts: str = CUTS_SQL) -> str:
    """CTEs ending in ``screened`` for a panel CTE and a support rule."""
    req = rule.required(dim + 1)
    per = ", ".join(
        f"sum({m}_{s}) AS {s}_{tag}, count(*) FILTER ({m}_{s} > 0) AS {s}_{tag}_entities, "
        f"coalesce(max({m}_{s}) / nullif(sum({m}_{s}), 0), 0) AS {s}_{tag}_max_share, "
        f"coalesce(sum({m}_{s})::DOUBLE * sum({m}_{s}) / nullif(sum({m}_{s} * {m}_{s}), 0), 0) AS {s}_{tag}_ess"
        for s in ("left", "right") for m, tag in (("n", "transitions"), ("z", "A0"), ("a", "A1")))
    why = []
    for s in ("left", "right"):
        why.append(f"CASE WHEN {s}_transitions_entities < {rule.min_active_each_side} THEN '{s}:active_entities' END")
        for k in (0, 1):
            why.append(f"CASE WHEN {s}_A{k} < {req} THEN '{s}:action{k}_count' END")
            why.append(f"CASE WHEN {s}_A{k}_entities < {rule.min_unique_each_side_action} THEN '{s}:action{k}_unique_entities' END")
        why.append(f"CASE WHEN {s}_A1_max_share > {rule.max_action1_share} THEN '{s}:action1_dominance' END")
        why.append(f"CASE WHEN {s}_transitions_max_share > {rule.max_total_share} THEN '{s}:total_dominance' END")
    why.append(f"CASE WHEN entities_both < {rule.min_both_sides} THEN 'entities_on_both_sides' END")
    return f""",
sd AS (SELECT p.entity_id, candidate, count(*) FILTER (elapsed_index < candidate) AS n_left, count(*) FILTER (elapsed_index >= candidate) AS n_right,
    count(*) FILTER (elapsed_index < candidate AND action = 1) AS a_left, count(*) FILTER (elapsed_index >= candidate AND action = 1) AS a_right,
    count(*) FILTER (elapsed_index < candidate AND action = 0) AS z_left, count(*) FILTER (elapsed_index >= candidate AND action = 0) AS z_right
    FROM {panel} p CROSS JOIN {cuts} GROUP BY 1, 2),
sc0 AS (SELECT candidate, {per}, count(*) FILTER (n_left > 0 AND n_right > 0) AS entities_both, {req} AS required_count FROM sd GROUP BY 1),
screened AS (SELECT *, concat_ws('|', {', '.join(why)}) AS reasons FROM sc0)"""
