"""Registered queries: contract, and agreement with their SQL on the smallest tables."""

import os

import pytest

from oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["trajectory_segments", "gap_quantiles", "adjacency_rules", "fixed_lattice", "state_features", "transitions", "three_step_transitions", "action_coverage",
          "temporal_quartiles", "landmark_trajectories", "pareto_landmarks", "risk_panel", "support_screen", "evaluation_grid", "shift_process", "m0_calibration",
          "calibration_summary", "gate_labels", "fingerprint_equality", "threshold_metrics", "max_distribution", "structure_summary", "row_bootstrap", "closed_fit", "closed_contributions",
          "closed_process", "closed_jacobian", "closed_values", "closed_diagnostics", "variance_versions", "shift_jackknife", "hat_values", "multinomial_totals",
          "process_covariance", "joint_exceedance", "spearman", "covariance_errors", "event_xml", "propensity_equations", "elapsed_grid_screen"]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


def test_contract():
    import __spark_entry__ as entry
    from riskpanel.plans.catalog import ALL

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(ALL) > 150 and set(ALL) <= set(q)
    assert not [n for n in ALL if "pipeline" in n or n.startswith("op")]


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    from riskpanel.plans.catalog import ALL

    rows, problems = compare(name, ALL[name], spark, SF, connect(SF))
    assert not problems and rows > 0


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns and df.count() >= 0
