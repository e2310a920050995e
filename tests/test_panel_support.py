"""Risk-panel construction and the outcome-blind screen on hand-made fixtures."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskpanel.operators import panel as PN
from riskpanel.operators import support as S
from riskpanel.operators.transitions import raise_if_any
from riskpanel.params import SupportRule

T0 = datetime(2020, 1, 1)


def _segments(spark, second_start, second_len=30):
    rows = []
    for seg, (start, n) in enumerate(((0, 60), (second_start, second_len))):
        for t in range(n):
            a = T0 + timedelta(minutes=start + 5 * t)
            rows.append((1, seg, t, a, a + timedelta(minutes=5), t % 2, 1.0, [0.1 * t], [0.1 * t + 0.1]))
    segs = spark.createDataFrame(rows, "entity_id long, segment_id long, transition_index long, tau_t timestamp_ntz, tau_next timestamp_ntz, action int, reward double, state array<double>, next_state array<double>")
    return segs, spark.createDataFrame([(1, T0)], "entity_id long, recording_start timestamp_ntz")


def test_lattice_rounding(spark):
    i, r = PN.elapsed_index(F.lit("2020-01-01 00:12:30").cast("timestamp_ntz"), F.lit("2020-01-01").cast("timestamp_ntz"), 5)
    got = spark.range(1).select(i.alias("i"), r.alias("r")).collect()[0]
    assert (got["i"], got["r"]) == (3, -2.5)


def test_reentry_burnin(spark):
    panel = PN.build_risk_panel(*_segments(spark, 500), "training", 5, 240, 24).toPandas()
    assert panel.groupby("segment_id").size().tolist() == [12, 6]
    assert panel[panel.segment_id == 1].elapsed_index.min() == 124
    sparse = PN.build_risk_panel(*_segments(spark, 500), "training", 5, 240, 24, "sparse_history").toPandas()
    assert (sparse.segment_id == 1).sum() == 30 and sparse[sparse.segment_id == 1].elapsed_index.min() == 100


def test_duplicate_index_and_residual_are_errors(spark):
    twice = PN.build_risk_panel(*_segments(spark, 240), "training", 5, 240, 0, "sparse_history")
    with pytest.raises(ValueError, match="duplicate_key"):
        raise_if_any(PN.panel_violations(twice, 1.0, (4.5, 5.5), 1))
    shifted = PN.build_risk_panel(*_segments(spark, 502), "training", 5, 240, 24)
    with pytest.raises(ValueError, match="lattice_residual"):
        raise_if_any(PN.panel_violations(shifted, 1.0, (4.5, 5.5), 1))
    sound = PN.build_risk_panel(*_segments(spark, 500), "training", 5, 240, 24)
    raise_if_any(PN.panel_violations(sound, 1.0, (4.5, 5.5), 1))


def _view(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, elapsed_index long, action int")


def test_thresholds_are_inclusive(spark):
    v = _view(spark, [(i, t, (i + t) % 2) for i in range(4) for t in range(20)])
    rule = SupportRule(20, 0.0, 4, 4, 4, 0.25, 0.25)
    r = S.screen(v, [10], 0, 20, rule, 1).collect()[0]
    assert r["admissible"] and (r["left_A0"], r["left_A1"], r["right_A1"]) == (20, 20, 20) and r["left_transitions_max_share"] == 0.25
    assert not S.screen(v, [10], 0, 20, SupportRule(21, 0.0, 4, 4, 4, 0.25, 0.25), 1).collect()[0]["admissible"]


def test_rare_action_and_dominance(spark):
    rare = _view(spark, [(i, t, int(i == 0 and t in (1, 11))) for i in range(8) for t in range(20)])
    why = S.screen(rare, [10], 0, 20, SupportRule(1, 0.0, 1, 1, 2, 1.0, 1.0), 1).collect()[0]["reasons"]
    assert why == ["left:action1_unique_entities", "right:action1_unique_entities"]
    dom = _view(spark, [(0, t, t % 2) for t in range(20)] + [(i, t, t % 2) for i in range(1, 5) for t in (9, 10)])
    assert "left:total_dominance" in S.screen(dom, [10], 0, 20, SupportRule(0, 0.0, 0, 0, 0, 1.0, 0.5), 1).collect()[0]["reasons"]


def test_screen_refuses_outcomes_and_bad_cuts(spark):
    v = _view(spark, [(1, 1, 0)])
    with pytest.raises(TypeError):
        S.screen(v.withColumn("reward", F.lit(1.0)), [5], 0, 9, S.PRIMARY, 1)
    with pytest.raises(ValueError):
        S.screen(v, [9], 0, 9, S.PRIMARY, 1)


def test_empty_admissible_set_is_a_status(spark):
    v = _view(spark, [(i, t, t % 2) for i in range(3) for t in range(10)])
    assert S.admissible_status(S.screen(v, [5], 0, 10, S.STRICT, 3)).collect()[0]["status"] == "NOT_TESTABLE_SUPPORT"


def test_candidate_grid_rounds_half_up():
    assert PN.candidate_grid(48, 240, [0.25, 0.5, 0.75]) == (96, 144, 192)
    assert PN.candidate_grid(0, 10, [0.25, 0.251]) == (3,)
    assert PN.elapsed_grid(29, 3) == (3, 6, 9, 12, 15, 18, 21, 24) and PN.elapsed_grid(12, 12) == ()
    with pytest.raises(ValueError):
        PN.candidate_grid(5, 5, [0.5])


def test_reentry_and_strict_modes(spark):
    cells = spark.createDataFrame([(1, t, t not in (3, 7), 0) for t in range(12)], "entity_id long, t long, observed boolean, action int")
    seg = PN.rectangular_segments(cells, width=4)
    def mode(m):
        return [r["elapsed_index"] for r in PN.eligible_panel(seg, m, 1, 12, burnin=2).orderBy("elapsed_index").collect()]
    assert mode("reentry") == [1, 2, 6, 10, 11]
    assert mode("strict_first_gap") == [1, 2]
    with pytest.raises(ValueError):
        mode("original_complete")


def test_cross_fitted_logistic_against_a_direct_solver(spark):
    import numpy as np
    import pandas as pd
    import pytest

    from riskpanel.operators import qc as E

    rng = np.random.default_rng(2)
    n = 900
    x, fold = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2], rng.integers(0, 4, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 2.0] - 1)))).astype(float)
    rows = spark.createDataFrame(pd.DataFrame({"x": x.tolist(), "y": y, "fold": fold.astype("int32")})).repartition(5)
    fit = E.cross_fitted_logistic(rows, 4, penalty=2.0)
    for k in range(5):
        use = fold != k
        full, b = np.column_stack([np.ones(use.sum()), x[use]]), np.zeros(4)
        for _ in range(50):
            q = 1 / (1 + np.exp(-full @ b))
            grad = full.T @ (q - y[use]) + 2.0 * np.r_[0, b[1:]]
            b = b - np.linalg.solve(full.T @ ((q * (1 - q))[:, None] * full) + 2.0 * np.diag([0, 1, 1, 1]), grad)
        assert np.abs(fit.beta[k] - b).max() < 1e-6 and fit.gradient[k] < 1e-6
    scores = E.scored(rows, fit).toPandas()
    want = 1 / (1 + np.exp(-(np.column_stack([np.ones(n), np.vstack(scores.x)]) * fit.beta[scores.fold]).sum(axis=1)))
    assert np.abs(scores.propensity - want).max() < 1e-12
    with pytest.raises(ValueError, match="single action"):
        E.cross_fitted_logistic(rows.where("y = 1"), 4)
