"""Algebraic identities of the fitted models and the bootstrap arms, against small NumPy references."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import bootstrap as B
from riskpanel.operators import fqi as Q
from riskpanel.operators import nullmodel as N
from riskpanel.operators import process as H

CUTS, START, END, P = [8, 12], 0, 20, 2
SCHEMA = "entity_id long, elapsed_index long, action int, reward double, state array<double>, next_state array<double>"


def make(seed=0, entities=9, steps=20):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(entities):
        s = rng.normal(size=P)
        for t in range(steps - (e % 4)):
            a = int(rng.random() < 0.4)
            n = 0.6 * s + 0.3 * a + rng.normal(size=P)
            rows.append((e, t, a, float(s[0] + 0.5 * a + rng.normal()), s.tolist(), n.tolist()))
            s = n
    return rows


def reference_side(rows, gamma=0.9, alpha=1.0, weights=None, tol=1e-5):
    """Direct fitted-Q iteration of one side; returns beta, W and the per-entity influences."""
    ids = sorted({r[0] for r in rows})
    m = {e: 1.0 for e in ids} if weights is None else weights
    total = sum(m[e] for e in ids)
    n = {e: sum(r[0] == e for r in rows) for e in ids}
    w = np.array([m[r[0]] / total / n[r[0]] for r in rows])
    s, sn = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    a, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    x = Q.action_design(s, a)
    x0, x1 = Q.action_design(sn, np.zeros(len(a))), Q.action_design(sn, np.ones(len(a)))
    h = x.T @ (w[:, None] * x) + alpha * np.eye(x.shape[1])
    beta = np.zeros(x.shape[1])
    for _ in range(2000):
        new = np.linalg.solve(h, x.T @ (w * (y + gamma * np.maximum(x0 @ beta, x1 @ beta))))
        step = np.linalg.norm(new - beta)
        beta = new
        if step <= tol:
            break
    best = np.where((x1 @ beta > x0 @ beta)[:, None], x1, x0)
    big = h - gamma * x.T @ (w[:, None] * best)
    res = y + gamma * np.maximum(x0 @ beta, x1 @ beta) - x @ beta
    raw = {e: np.mean([x[i] * res[i] for i in range(len(rows)) if rows[i][0] == e], axis=0) for e in ids}
    mean = sum(m[e] / total * raw[e] for e in ids)
    return beta, big, {e: m[e] / total * np.linalg.solve(big, raw[e] - mean) for e in ids}


RULE = Q.FitRule(gamma=0.9, alpha=1.0)


@pytest.fixture(scope="module")
def fitted(spark):
    rows = make()
    design = Q.prepare(spark.createDataFrame(rows, SCHEMA).repartition(5), CUTS, START, END, P)
    return rows, design, Q.fit(design, RULE)


def _side(rows, cut, s):
    return [r for r in rows if (r[1] < cut) == (s == 0)]


def test_fit_matches_direct_iteration(fitted):
    rows, design, models = fitted
    assert models.converged.all()
    for j, cut in enumerate(CUTS):
        for s in (0, 1):
            beta, big, _ = reference_side(_side(rows, cut, s), tol=1e-10)
            assert np.abs(models.beta[0, j, s] - beta).max() < 1e-3
            assert np.abs(models.W[0, j, s] - big).max() < 1e-8


def test_policy_equals_fixed_point_and_partitions_do_not_matter(spark, fitted):
    rows, design, models = fitted
    fixed = Q.fit(design, Q.FitRule(gamma=0.9, alpha=1.0, solver="fixed_point"))
    assert np.abs(fixed.beta - models.beta).max() < 1e-3
    other = Q.fit(Q.prepare(spark.createDataFrame(rows[::-1], SCHEMA).repartition(1), CUTS, START, END, P), RULE)
    assert np.allclose(other.beta, models.beta, atol=1e-9)


def test_contributions_and_variance(fitted):
    rows, design, models = fitted
    z = Q.action_design(np.array([[0.2, -0.1], [1.0, 0.5]]), np.array([0, 1]))
    contrib = Q.contributions(design, RULE, models, z)
    got = {r["entity_id"]: np.array(r["delta"]).reshape(len(CUTS), len(z)) for r in contrib.collect()}
    var = H.process_table(design, models, contrib, z)[0]
    for j, cut in enumerate(CUTS):
        left, right = reference_side(_side(rows, cut, 0), tol=1e-10)[2], reference_side(_side(rows, cut, 1), tol=1e-10)[2]
        want = {e: z @ (left.get(e, 0 * z[0]) - right.get(e, 0 * z[0])) for e in set(left) | set(right)}
        for e, v in want.items():
            assert np.abs(got[e][j] - v).max() < 1e-4
        g = len(want)
        assert np.allclose(var[j], g / (g - 1) * sum(v ** 2 for v in want.values()), rtol=1e-3)
        assert np.abs(sum(got[e][j] for e in want)).max() < 1e-9


def test_duplicating_one_entity_leaves_the_fit_unchanged(spark, fitted):
    rows, _, models = fitted
    doubled = rows + [(r[0], r[1], *r[2:]) for r in rows if r[0] == 3]
    again = Q.fit(Q.prepare(spark.createDataFrame(doubled, SCHEMA), CUTS, START, END, P), RULE)
    assert np.allclose(again.beta, models.beta, atol=1e-8)


def test_influence_matrix_is_the_numerical_jacobian(fitted):
    _, design, models = fitted
    num = H.numerical_jacobian(design, RULE, models.beta[0])
    assert np.abs(num - models.W[0]).max() < 1e-6
    assert np.linalg.norm(H.estimating_equations(design, RULE, models.beta)[0], axis=-1).max() < 1e-4
    near = models.beta[0] + 1e-4
    assert np.abs(H.linearised_error(design, RULE, near) - (models.beta[0] - near)).max() < 1e-5


def test_unit_weights_reproduce_the_observed_fit_and_random_weights_the_direct_one(fitted):
    rows, design, models = fitted
    ones = Q.fit(design, RULE, Q.Randomness("weight", "ones", 1), [0, 1])
    assert np.allclose(ones.beta[0], models.beta[0], atol=1e-9) and np.allclose(ones.beta[1], models.beta[0], atol=1e-9)
    rnd = Q.Randomness("weight", "exponential", 5)
    drawn = Q.fit(design, RULE, rnd, [0, 1, 2])
    h = {r["entity_id"]: r["h"] for r in design.counts.select("entity_id", F.xxhash64("entity_id").alias("h")).collect()}
    ids = sorted(h)
    w = Q.keyed_draws("exponential", 5, np.array([2]), np.array([h[e] for e in ids]))[0]
    beta, _, _ = reference_side(_side(rows, CUTS[1], 0), weights=dict(zip(ids, w)), tol=1e-10)
    assert np.abs(drawn.beta[2, 1, 0] - beta).max() < 1e-3
    z = Q.action_design(np.array([[0.2, -0.1]]), np.array([1]))
    contrib = Q.contributions(design, RULE, drawn, z, rnd).collect()
    direct = {}
    for s, sign in ((0, 1.0), (1, -1.0)):
        for e, v in reference_side(_side(rows, CUTS[1], s), weights=dict(zip(ids, w)), tol=1e-10)[2].items():
            direct[e] = direct.get(e, 0.0) + sign * float((z @ v)[0])
    for r in contrib:
        assert abs(np.array(r["delta"]).reshape(3, len(CUTS), 1)[2, 1, 0] - direct[r["entity_id"]]) < 1e-4


def test_zero_weight_side_is_an_error(spark):
    rows = [r for r in make() if r[0] == 0 or r[1] >= 8]
    design = Q.prepare(spark.createDataFrame(rows, SCHEMA), [8], START, END, P)
    omit = design.counts.where("entity_id = 0").select(F.xxhash64("entity_id")).collect()[0][0]
    with pytest.raises(ValueError, match="zero total entity weight"):
        Q.fit(design, RULE, Q.Randomness("weight", "leave_one_out", 0, (omit,)), [0])


def test_restricted_null_recovers_the_common_fit(spark):
    panel = spark.createDataFrame(make(), SCHEMA)
    null, beta, info = B.restricted_null(panel, START, END, P, RULE)
    assert info["ridge_score_error"] < 1e-8
    swapped = null.select("entity_id", "elapsed_index", "action", F.col("base_reward").alias("reward"), "state", "next_state")
    again = Q.fit(Q.prepare(swapped, [END], START, END + 1, P), RULE)
    assert np.abs(again.beta[0, 0, 0] - beta).max() < 1e-3
    sums = null.groupBy("entity_id").agg(F.abs(F.sum("residual")).alias("s")).agg(F.max("s")).collect()[0][0]
    assert sums < 1e-8


def test_multiplier_maximum_by_hand(spark):
    contrib = spark.createDataFrame([(0, [1.0, 2.0]), (1, [-1.0, -2.0])], "entity_id long, delta array<double>")
    proc = spark.createDataFrame([(5, 0, 2, 1.0, 1.0), (6, 0, 2, 1.0, 0.5)], "candidate long, z long, clusters long, variance double, boundary double")
    draws = B.multiplier_process(contrib, proc, [5, 6], 1, 7, 3).groupBy("draw").agg(F.max(F.abs("joint")).alias("m")).orderBy("draw").toPandas()
    xi = B.multipliers(contrib.select("entity_id"), 7, 3).orderBy("entity_id").toPandas()["xi"]
    for d in range(7):
        gap = xi[0][d] - xi[1][d]
        assert abs(draws.m[d] - max(abs(gap), 0.5 * abs(2 * gap))) < 1e-12
    again = B.multiplier_process(contrib.repartition(3), proc, [5, 6], 1, 7, 3).groupBy("draw").agg(F.max(F.abs("joint")).alias("m")).orderBy("draw").toPandas()
    assert np.array_equal(draws.m, again.m) or np.allclose(draws.m, again.m, atol=1e-14)


def test_p_values_never_replace_failed_draws(spark):
    draws = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, None)], "draw long, D4 double")
    for c in ("D0", "D1", "D2", "D3"):
        draws = draws.withColumn(c, F.col("D4"))
    obs = spark.range(1).select(*[F.lit(2.0).alias(c) for c in ("D0", "D1", "D2", "D3", "D4")])
    r = {x["layer"]: x for x in B.calibrate(draws, obs).collect()}["D4"]
    assert (r["valid_draws"], r["failed_draws"]) == (2, 1) and abs(r["p_value"] - 2 / 3) < 1e-12


def test_failure_categories_keep_their_order(spark):
    text = ["ValueError: INVALID_SUPPORT_DRAW:6", "influence matrix", "fqi did not converge", "panel key", "logistic fit", "boom", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "draw long, message string")
    got = {r["category"]: r["n"] for r in B.draw_accounting(df).collect()}
    assert got == {"SUPPORT_REJECTION": 1, "NONFINITE_STATISTIC": 1, "FQI_NUMERICAL_FAILURE": 1, "PANEL_REBUILD_FAILURE": 1,
                   "GENERATIVE_MODEL_FAILURE": 1, "OTHER_EXCEPTION": 1, "VALID": 1}


def test_least_squares_and_logistic(spark):
    rng = np.random.default_rng(4)
    n = 600
    x, e = rng.normal(size=(n, 2)), rng.integers(0, 12, n)
    u = rng.normal(size=12)
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=n)
    a = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + x[:, 0] + u[e])))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"entity_id": e, "x0": x[:, 0], "x1": x[:, 1], "y": y, "a": a}))
    beta, sd = N.least_squares(df, ["x0", "x1"], ["y"])["y"]
    full = np.column_stack([np.ones(n), x])
    want = np.linalg.lstsq(full, y, rcond=None)[0]
    assert np.allclose(beta, want) and abs(sd - np.sqrt(np.sum((y - full @ want) ** 2) / (n - 3))) < 1e-9
    coef, effects, _, info = N.penalised_logistic(df, ["x0", "x1"], "a", 1.0)
    eff = {r["entity_id"]: r["u"] for r in effects.collect()}
    p = 1 / (1 + np.exp(-(full @ coef + np.array([eff[k] for k in e]))))
    assert np.abs(full.T @ (p - a)).max() < 1e-6
    for k in range(12):
        assert abs(np.sum((p - a)[e == k]) + eff[k]) < 1e-6


def test_bridge_null_solves_its_moment_equations(spark):
    panel = spark.createDataFrame(make(), SCHEMA).withColumn("reward", (F.col("reward") > 0).cast("double"))
    model, _ = N.fit_bridge_null(panel, P)
    rows = panel.toPandas()
    x = np.column_stack([np.ones(len(rows)), np.vstack(rows.state)])
    score = x.T @ (rows.action.to_numpy() - 1 / (1 + np.exp(-(x @ model.action))))
    score[1:] -= model.action[1:]  # the penalty of the slopes
    assert np.abs(score).max() < 1e-3
    told = N.coefficient_table(spark, model).where("part = 'action'").orderBy("position").toPandas()
    assert np.allclose(told.value, model.action)


@pytest.mark.parametrize("lanes", [0, 3])
def test_array_sums(spark, lanes):
    rows = [(k, None if k == 4 else f"g{k % 3}", [float(i), 1.0]) for i in range(200) for k in ([0] * 3 + [k for k in range(4) if i % 2])]
    df = spark.createDataFrame(rows, "k long, g string, v array<double>").repartition(7)
    got = {r["k"]: r["v"] for r in Q.sum_arrays(df, ["k", "g"], "v", lanes).collect()}
    want = {k: [sum(v[i] for kk, _, v in rows if kk == k) for i in (0, 1)] for k in range(4)}
    assert got == want


def test_array_sums_of_unequal_lengths(spark):
    rows = [(k, [float(i)] * (k + 1)) for i in range(50) for k in range(3)]
    got = {r["k"]: r["v"] for r in Q.sum_arrays(spark.createDataFrame(rows, "k long, v array<double>").repartition(5), ["k"], "v").collect()}
    assert got == {k: [1225.0] * (k + 1) for k in range(3)}


# ------------------------------------------------------------- moment table, draws, leave-one-out
def _deltas(contrib, draws, points):
    return {r["entity_id"]: np.array(r["delta"]).reshape(draws, len(CUTS), points) for r in contrib.collect()}


@pytest.fixture
def apart(spark):
    """Small shuffle partitions stay apart, so that pieces of an entity meet different tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_split_entities_and_small_blocks_change_nothing(spark, fitted, monkeypatch, apart):
    rows, _, models = fitted
    z = Q.action_design(np.array([[0.2, -0.1]]), np.array([1]))
    monkeypatch.setattr(Q, "STRETCH", 5)  # an entity's rows are dealt over four stretches
    monkeypatch.setattr(Q, "BLOCK_DOUBLES", 400)
    design = Q.prepare(spark.createDataFrame(rows, SCHEMA).repartition(3), CUTS, START, END, P)
    again = Q.fit(design, RULE)
    assert again.extra["pass"].blocks.where("split").count() > 0
    assert np.allclose(again.beta, models.beta, atol=1e-9) and np.allclose(again.W, models.W, atol=1e-9)
    whole = _deltas(Q.contributions(fitted[1], RULE, models, z), 1, 1)
    pieces = _deltas(Q.contributions(design, RULE, again, z), 1, 1)
    assert set(whole) == set(pieces) and all(np.allclose(whole[e], pieces[e], atol=1e-9) for e in whole)


@pytest.mark.parametrize("estimator", ["balanced", "pooled", "sums"])
def test_flips_against_a_reference_policy_give_the_same_models(fitted, estimator):
    _, design, models = fitted
    rule = Q.FitRule(gamma=0.9, alpha=1.0, tolerance=1e-9, estimator=estimator)
    rnd = Q.Randomness("weight", "exponential", 5)
    plain = Q.fit(design, rule, rnd, range(12))
    near = Q.fit(design, rule, rnd, range(12), models.beta[0])
    assert plain.converged.all() and near.converged.all()
    assert np.allclose(plain.beta, near.beta, atol=1e-6) and np.allclose(plain.W, near.W, atol=1e-7)


class _Prep:
    rule, bound = RULE, np.array([0.7, 0.9])
    z_design = Q.action_design(np.array([[0.2, -0.1], [1.0, 0.5]]), np.array([0, 1]))
    contrast = np.array([[0.1, 0.2], [0.3, 0.4]])


def test_draw_process_equals_the_contributions_of_every_draw(fitted):
    _, design, models = fitted
    rnd = Q.Randomness("weight", "exponential", 5)
    got = B.refit_draws(_Prep, design, 7, rnd, True, models.beta[0]).toPandas().sort_values(["draw", "candidate", "z"])
    drawn = Q.fit(design, RULE, rnd, range(7), models.beta[0])
    delta = _deltas(Q.contributions(design, RULE, drawn, _Prep.z_design, rnd), 7, 2)
    g = np.array([len({r[0] for r in fitted[0]})] * 2)[:, None]
    var = g / (g - 1) * sum(v ** 2 for v in delta.values())
    raw = (drawn.beta[:, :, 0] - drawn.beta[:, :, 1]) @ _Prep.z_design.T - _Prep.contrast
    assert len(got) == 7 * 2 * 2
    assert np.allclose(got.raw.to_numpy().reshape(raw.shape), raw, atol=1e-9)
    assert np.allclose(got.joint.to_numpy().reshape(raw.shape), raw / np.sqrt(var) * _Prep.bound[:, None], rtol=1e-6)


def test_blocks_of_draws_do_not_matter(fitted, monkeypatch):
    _, design, models = fitted
    rnd = Q.Randomness("weight", "exponential", 5)
    one = B.refit_draws(_Prep, design, 5, rnd, False, models.beta[0]).orderBy("draw", "candidate", "z").toPandas()
    monkeypatch.setattr(B, "draws_per_block", lambda d: 2)
    three = B.refit_draws(_Prep, design, 5, rnd, False, models.beta[0]).orderBy("draw", "candidate", "z").toPandas()
    assert np.allclose(one, three, atol=1e-9)


def test_null_draws_and_the_draw_without_perturbation(spark):
    panel = spark.createDataFrame(make(3, 12), SCHEMA)
    null, beta, _ = B.restricted_null(panel, START, END, P, Q.FitRule(gamma=0.9, alpha=1.0, tolerance=1e-9))
    design = Q.prepare(null, CUTS, START, END, P)
    start = np.tile(beta, (2, 2, 1))
    zero = B.zero_draw(_Prep, design, start).toPandas()
    assert len(zero) == 4 and np.isfinite(zero.raw).all()
    rnd = Q.Randomness("reward", "gaussian", 9)
    drawn = Q.fit(design, Q.FitRule(gamma=0.9, alpha=1.0, tolerance=1e-9), rnd, range(3), start)
    pdf = null.withColumn("h", F.xxhash64("entity_id")).toPandas()
    xi = Q.keyed_draws("gaussian", 9, np.array([2]), pdf.h.to_numpy())[0]
    made = [(r.entity_id, r.elapsed_index, r.action, r.base_reward + x * r.residual, list(r.state), list(r.next_state)) for r, x in zip(pdf.itertuples(), xi, strict=True)]
    for s in (0, 1):
        want, big, _ = reference_side(_side(made, CUTS[0], s), tol=1e-11)
        assert np.abs(drawn.beta[2, 0, s] - want).max() < 1e-6 and np.abs(drawn.W[2, 0, s] - big).max() < 1e-6


@pytest.mark.parametrize("stretch,doubles", [(4096, 4_000_000), (6, 200)])
def test_leave_one_out_against_refits(spark, monkeypatch, apart, stretch, doubles):
    monkeypatch.setattr(Q, "STRETCH", stretch)
    rows = [r for r in make(5, 20) if not (r[0] == 4 and r[1] < 12)] + [(99, 3, 1, 1.0, [0.1, 0.2], [0.0, 0.3])]
    design = Q.prepare(spark.createDataFrame(rows, SCHEMA).repartition(4), CUTS, START, END, P)
    rule = Q.FitRule(gamma=0.9, alpha=0.05, tolerance=1e-9)
    models = Q.fit(design, rule)
    monkeypatch.setattr(Q, "BLOCK_DOUBLES", doubles)  # the second case sends the rows near a policy border in many slices
    z = Q.action_design(np.array([[0.2, -0.1], [1.0, 0.5]]), np.array([0, 1]))
    got = {(r["entity_id"], r["candidate"]): np.array(r["value"]) for r in Q.leave_one_out(design, rule, models, z).collect()}
    ids = sorted({r[0] for r in rows})
    assert len(got) == len(ids) * len(CUTS)
    for e in ids:
        rest = [r for r in rows if r[0] != e]
        for cut in CUTS:
            left, right = (reference_side(_side(rest, cut, s), alpha=0.05, tol=1e-11)[0] for s in (0, 1))
            assert np.abs(got[e, cut] - z @ (left - right)).max() < 1e-6, (e, cut)


def test_leave_one_out_where_a_side_becomes_empty(spark):
    rows = [r for r in make() if r[0] == 0 or r[1] >= 8]
    design = Q.prepare(spark.createDataFrame(rows, SCHEMA), [8], START, END, P)
    left = Q.leave_one_out(design, RULE, Q.fit(design, RULE), np.eye(6)[:1])
    table = H.jackknife(left.select("entity_id", "candidate", F.element_at("value", 1).alias("leave_one_out"))).toPandas()
    assert table.loc[table.entity_id == 0, "leave_one_out"].isna().all() and table.leave_one_out.notna().sum() == 8
    v = table.leave_one_out.dropna()
    pseudo = -(7 / 8) * (v - v.mean())
    assert np.allclose(table.pseudo.dropna(), pseudo) and np.allclose(table.variance, 8 / 7 * (pseudo ** 2).sum())


@pytest.mark.parametrize("draws", [6, 40])
def test_projection_against_least_squares(spark, draws):
    ids = list(range(15))
    entities = spark.createDataFrame([(i,) for i in ids], "entity_id long").repartition(4)
    h = {r["entity_id"]: r["h"] for r in entities.select("entity_id", F.xxhash64("entity_id").alias("h")).collect()}
    rng = np.random.default_rng(draws)
    y = rng.normal(size=(draws, 3))
    cube = [(d, c, 0, float(y[d, c])) for d in range(draws) for c in range(3)] + [(draws, 0, 0, None)]
    got = {r["entity_id"]: r["projection"] for r in B.project_on_multipliers(
        spark.createDataFrame(cube, "draw long, candidate long, z long, joint double"), entities, 3).collect()}
    xi = Q.keyed_draws("gaussian", 3, np.arange(draws), np.array([h[i] for i in ids]))
    want = np.linalg.lstsq(xi - xi.mean(axis=0), y - y.mean(axis=0), rcond=1e-10)[0]
    assert np.allclose([got[i] for i in ids], want, atol=1e-8)


def test_multinomial_counts(spark):
    ids = spark.range(3000).select(F.col("id").alias("entity_id"))
    rows = B.multinomial_entities(ids.repartition(7), 40, 5, leaf=100).toPandas().sort_values("entity_id")
    w = np.vstack(rows.w)
    assert w.shape == (3000, 40) and (w.sum(axis=0) == 3000).all() and (w >= 0).all() and (w == np.floor(w)).all()
    assert abs(w.var() - 1.0) < 0.05 and abs((w == 0).mean() - np.exp(-1)) < 0.01  # one pick an entity on average
    other = B.multinomial_entities(ids, 40, 5, leaf=100).toPandas().sort_values("entity_id")
    assert (np.vstack(other.w) == w).all()
    few = np.vstack(B.multinomial_entities(ids.limit(3), 4000, 6).toPandas().w)
    assert (few.sum(axis=0) == 3).all() and abs((few == 3).mean() - 1 / 27) < 0.01


def test_weights_from_a_table_against_direct_fits(spark, fitted):
    rows, design, models = fitted
    ids = sorted({r[0] for r in rows})
    w = np.random.default_rng(3).integers(0, 3, (len(ids), 4)).astype(float) + (np.arange(len(ids)) < 2)[:, None]
    table = spark.createDataFrame([(e, x.tolist()) for e, x in zip(ids, w, strict=True)], "entity_id long, w array<double>")
    drawn = Q.fit(design, Q.FitRule(gamma=0.9, alpha=1.0, tolerance=1e-9), Q.Randomness("weight", "table", 0, table=table), range(4), models.beta[0])
    for b in range(4):
        for s in (0, 1):
            beta, big, _ = reference_side(_side(rows, CUTS[0], s), weights=dict(zip(ids, w[:, b], strict=True)), tol=1e-11)
            assert np.abs(drawn.beta[b, 0, s] - beta).max() < 1e-6 and np.abs(drawn.W[b, 0, s] - big).max() < 1e-6
    prep = B.refit_draws(_Prep, design, 4, Q.Randomness("weight", "table", 0, table=table), True, models.beta[0])
    assert prep.count() == 4 * 2 * 2 and prep.where("joint IS NULL").count() == 0
