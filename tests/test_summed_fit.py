"""Fits by sums without the moments of entities, and the size of the moment table's rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_fqi_bootstrap import CUTS, END, P, SCHEMA, START, make

from riskpanel.operators import fqi as Q
from riskpanel.operators import value_check as V

SUMS = Q.FitRule(gamma=0.9, alpha=1.0, tolerance=1e-9, estimator="sums")


def test_sums_of_blocks_give_the_same_models(spark, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_VALUES", 120)  # several blocks a task
    design = Q.prepare(spark.createDataFrame(make(3, 30), SCHEMA).repartition(3), CUTS, START, END, P)
    whole, sums = Q.fit(design, SUMS), Q.fit(design, SUMS, summed=True)
    assert np.allclose(whole.beta, sums.beta, atol=1e-9) and np.allclose(whole.W, sums.W, atol=1e-9)
    lay = Q.Layout(design.q, 1)
    rows = sums.extra["pass"].blocks.select(F.length("m").alias("m"), F.length("x").alias("x")).collect()
    assert len(rows) > 3 and all(r["m"] == 8 * 2 * len(CUTS) * lay.size and r["x"] <= 8 * 120 for r in rows)
    with pytest.raises(ValueError, match="no contributions"):
        Q.contributions(design, SUMS, sums, np.eye(2 * design.q))
    with pytest.raises(ValueError, match="moments of entities"):
        Q.fit(design, Q.FitRule(), summed=True)


def test_the_value_check_writes_no_moments_of_entities(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(V, "fit", lambda *a, **k: seen.append(Q.fit(*a, **k)) or seen[-1])
    rows = spark.createDataFrame(make(4, 40), SCHEMA).select("*", F.lit("training").alias("split"), F.lit(0.1).alias("propensity"))
    assert V.value_check(rows, rows, P, {"r": ("reward", -1.0, 1.0)}, (1.0,), 0.9).count() == rows.count()
    lay = Q.Layout(P + 1, 1)
    blocks = seen[0].extra["pass"].blocks
    assert blocks.agg(F.sum(F.length("m"))).first()[0] == blocks.count() * 8 * 2 * lay.size  # one set of moments a block, not an entity


def test_rows_of_the_moment_table_stay_small(spark, tmp_path):
    """At most a few MB a row whatever the number of entities, in row groups of bounded size."""
    design = Q.prepare(spark.createDataFrame(make(5, 400, 4), SCHEMA).repartition(1), [1, 2, 3], START, END, P, "small")
    p = Q._pass(design, Q.FitRule(), Q.Randomness(), [0], None)
    size = 8 * 2 * 3 * Q.Layout(design.q, 1).size
    most = max(1, Q.BLOCK_VALUES * 8 // size)
    assert p.blocks.agg(F.max(F.length("m"))).first()[0] <= most * size <= 8 * Q.BLOCK_VALUES <= 2 << 20


def test_scores_and_near_rows_are_held_in_parts(spark, monkeypatch):
    """Influences of many draws, and leave-one-out refits, with a few entities and near rows at a time."""
    rows = make(6, 30)
    design = Q.prepare(spark.createDataFrame(rows, SCHEMA).repartition(1), CUTS, START, END, P)
    rule, rnd, z = Q.FitRule(gamma=0.9, alpha=1.0, tolerance=1e-9), Q.Randomness("weight", "exponential", 5), np.eye(2 * (P + 1))
    models = Q.fit(design, rule)
    drawn = Q.fit(design, rule, rnd, range(6), models.beta[0])
    largest = []
    inner = Q._scores

    def results():
        delta = {r["entity_id"]: np.array(r["delta"]) for r in Q.contributions(design, rule, drawn, z, rnd).collect()}
        second = {r["i"]: np.array(r["v"]) for r in Q.influence_moments(design, drawn).collect()}
        left = {(r["entity_id"], r["candidate"]): np.array(r["value"]) for r in Q.leave_one_out(design, rule, models, z).collect()}
        return delta, second, left

    want = results()
    p = drawn.extra["pass"]
    row = p.blocks.toPandas().iloc[0]
    block = Q.read_block(row, len(p.cuts), p.lay.q, p.lay)
    for at in range(0, len(block.eh), 4):
        largest.append(inner(p, Q._part(block, at, at + 4), drawn.beta))
    assert np.allclose(np.concatenate(largest, axis=2), inner(p, block, drawn.beta), atol=1e-12)
    monkeypatch.setattr(Q, "BLOCK_VALUES", 200)
    for a, b in zip(want, results()):
        assert set(a) == set(b) and all(np.allclose(a[k], b[k], atol=1e-7) for k in a)
