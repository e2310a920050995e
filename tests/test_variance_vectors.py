"""The five variances from one vector per entity, against NumPy; what a query does not read is not made."""

import datetime as dt

import numpy as np
import pytest
from test_fqi_bootstrap import CUTS, END, P, RULE, SCHEMA, START, make

from riskpanel.functions.columns import MULTIPLIERS
from riskpanel.operators import bootstrap as B
from riskpanel.operators import fqi as Q
from riskpanel.operators import process as H
from riskpanel.plans import roles as R


def told(spark, draws=25, entities=14):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    points = [(6, 0), (6, 1), (9, 0), (9, 1)]
    d, v = rng.normal(size=(entities, 4)), rng.normal(size=(entities, 4)) + 2.0
    d[2, :2], v[2, :2], v[5, 2:] = np.nan, 1.5, np.nan  # not active at a cut; a side empty without the entity
    contrast = spark.createDataFrame([(c, z, 0.1 * i + 0.5) for i, (c, z) in enumerate(points)], "candidate long, z long, contrast double")
    ids = spark.range(entities).withColumnRenamed("id", "entity_id")
    xi = ids.select("entity_id", F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda k: MULTIPLIERS["gaussian"](F.lit("7"), F.col("entity_id"), k)).alias("xi"))
    return points, d, v, contrast, np.array([r["xi"] for r in xi.orderBy("entity_id").collect()])


def expected(d, v, contrast, xi):
    out = {}
    for i in range(d.shape[1]):
        there, known = ~np.isnan(d[:, i]), ~np.isnan(v[:, i])
        x, w = d[there, i], v[known, i]
        g, lg = len(x), len(w)
        a = x / np.sqrt(np.maximum(1 - x ** 2 / (x ** 2).sum(), 1e-8))
        a = a - a.mean()
        pseudo = np.zeros(len(d))
        pseudo[known] = -(lg - 1) / lg * (w - w.mean())
        var = {"fixed": g / (g - 1) * (x ** 2).sum(), "cr2": g / (g - 1) * (a ** 2).sum(), "jackknife": lg / (lg - 1) * (pseudo ** 2).sum()}
        m = xi[there]
        s1, s2 = x @ m, x ** 2 @ m ** 2
        size = abs(contrast[i])
        val = {"raw": abs(s1), "fixed": abs(s1) / var["fixed"] ** .5, "draw_specific": abs(s1) / np.sqrt(g / (g - 1) * (s2 - s1 ** 2 / g)),
               "jackknife": abs(pseudo[there] @ m) / var["jackknife"] ** .5, "cr2": abs(a @ m) / var["cr2"] ** .5}
        for k, t in val.items():
            obs = size / var.get(k, {"raw": 1.0, "draw_specific": var["fixed"]}.get(k)) ** .5
            out[i, k] = (obs, (1 + (t >= obs).sum()) / (len(t) + 1), t.mean(), t.std(ddof=1), np.quantile(t, .95))
    return out


@pytest.mark.parametrize("form", ["vectors", "rows"])
def test_versions_against_numpy(spark, monkeypatch, form):
    points, d, v, contrast, xi = told(spark)
    if form == "vectors":
        def vectors(x):
            return spark.createDataFrame([(e, [None if np.isnan(c) else float(c) for c in r]) for e, r in enumerate(x)], "entity_id long, value array<double>").repartition(3)

        got = B.vector_versions(vectors(d), vectors(v), contrast, xi.shape[1], 7)
    else:
        def rows(x, col, keep):
            cells = [(e, c, z, None if np.isnan(x[e, i]) else float(x[e, i])) for e in range(len(x)) for i, (c, z) in enumerate(points)]
            return spark.createDataFrame([r for r in cells if keep or r[3] is not None], f"entity_id long, candidate long, z long, {col} double").repartition(3)

        monkeypatch.setattr(B, "adjusted_contributions", None)  # no row per entity and point is made, shuffled or joined
        got = B.variance_versions(rows(d, "delta", False), rows(v, "leave_one_out", True), contrast, xi.shape[1], 7)
    got = {(points.index((r["candidate"], r["z"])), r["version"]): (r["observed"], r["p_value"], r["mean"], r["sd"], r["q95"]) for r in got.collect()}
    want = expected(d, v, [0.1 * i + 0.5 for i in range(4)], xi)
    assert set(got) == set(want) and len(got) == 20
    assert all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


def test_contribution_vectors(spark):
    wide = spark.createDataFrame([(1, [True, False], [1.0, 2.0, 3.0, 4.0])], "entity_id long, active array<boolean>, delta array<double>")
    assert H.contribution_vectors(wide, 2).first()["value"] == [1.0, 2.0, None, None]


def test_row_values_make_no_contributions(spark, monkeypatch):
    def never(*_):
        raise AssertionError("row values read coefficients only")

    monkeypatch.setattr(H, "contributions", never)
    design = Q.prepare(spark.createDataFrame(make(), SCHEMA), CUTS, START, END, P, "lazy")
    prep = H.prepare_process(design, RULE, np.eye(6)[:2], {c: 1.0 for c in CUTS}, CUTS[0])
    assert H.row_values(prep.design, RULE, prep.models).count() == design.rows.count() * len(CUTS)
    with pytest.raises(AssertionError):
        prep.variance


def test_daily_cells_at_the_edges(spark, tmp_path):
    def event(user, day, kind, value):
        return user, dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=5), kind, value

    rows = [event(1, -1, "view", 30.0), event(1, 0, "view", 30.0), event(1, 0, "purchase", 50.0), event(1, 1, "view", 90.0), event(1, 28, "view", 25.0), event(1, 29, "view", 40.0),
            event(1, 30, "view", 45.0), event(2, 40, "view", 10.0), event(None, 3, "view", 10.0), event(None, 4, "view", 10.0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = R.daily_cells(spark, str(tmp_path)).collect()
    assert len(got) == 3 * 29 and {r["t"] for r in got} == set(range(29))
    seen = {(r["entity_id"], r["t"]): r for r in got if r["observed"]}
    assert set(seen) == {(1, 0), (1, 28)}  # both days inside the window, and an entity that has a name
    first, last = seen[1, 0], seen[1, 28]
    assert (first["action"], first["state"], first["next_state"], first["reward"]) == (1, [0.8, 0.5, 0.5], [1.8, 0.25, 0.9], 0.0)
    assert (last["action"], last["state"], last["next_state"], last["reward"]) == (0, [0.5, 0.25, 0.25], [0.8, 0.25, 0.4], 1.0)
