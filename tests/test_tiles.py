"""Pair matrices over several tiles and segments against dense NumPy matrices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import tails as K
from riskpanel.operators import tiles as TL

N = 130  # three tiles of coordinates


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(8)
    return rng.normal(size=(90, N)) @ (np.eye(N) + 0.2 * rng.normal(size=(N, N))) + rng.normal(size=N)


def table(spark, **banks):
    parts = [pd.DataFrame({"bank": b, "draw": np.repeat(np.arange(len(x)), x.shape[1]), "cluster": np.repeat(np.arange(len(x)) % 5, x.shape[1]),
                           "coord": np.tile(np.arange(x.shape[1]), len(x)), "value": x.ravel()}) for b, x in banks.items()]
    return spark.createDataFrame(pd.concat(parts)).repartition(5)


def dense(rows, name, n=N):
    out = np.full((n, n), np.nan)
    pdf = rows.select("i", "j", name).toPandas()
    out[pdf.i, pdf.j] = pdf[name]
    assert len(pdf) == n * n
    return out


def test_common_draws_over_tiles_and_segments(spark):
    rng = np.random.default_rng(3)
    hit = rng.random((9000, N)) < 0.01  # three segments of draws
    hit[:, 7] = False
    d, c = np.nonzero(hit)
    events = spark.createDataFrame(pd.DataFrame({"bank": "a", "draw": d, "coord": c})).repartition(4)
    got = dense(TL.joint_counts(events.unionByName(events.limit(50)), N, ["bank"]), "n")  # repeated events count once
    assert (got == hit.T.astype(int) @ hit.astype(int)).all()


def test_weighted_gap(spark):
    rng = np.random.default_rng(4)
    hit = {b: rng.random((300, N)) < 0.1 for b in ("a", "b")}
    w = {b: rng.integers(0, 6, (60, 300)) for b in hit}
    events = spark.createDataFrame(pd.concat([pd.DataFrame({"bank": b, "draw": np.nonzero(h)[0], "coord": np.nonzero(h)[1]}) for b, h in hit.items()]))
    weights = spark.createDataFrame(pd.concat([pd.DataFrame({"bank": b, "rep": np.repeat(np.arange(60), 300), "draw": np.tile(np.arange(300), 60), "w": x.ravel()}) for b, x in w.items()]))
    got = {r["rep"]: r["gap"] for r in TL.weighted_gap(events, weights, N, "a", "b").collect()}
    off = ~np.eye(N, dtype=bool)
    for k in range(60):
        p = [(hit[b].T * w[b][k]) @ hit[b] / w[b][k].sum() for b in ("a", "b")]
        assert abs(got[k] - np.abs(p[0] - p[1])[off].mean()) < 1e-12


def test_comoments_merge_over_segments(spark, values, monkeypatch):
    monkeypatch.setattr(TL, "DRAWS", 16)
    bank = table(spark, a=values, b=values[:40] * 2 + 5)
    bank = bank.unionByName(bank.where("bank = 'a' AND draw = 3 AND coord < 4").withColumn("draw", F.lit(500).cast("long")))  # an incomplete draw is left out
    tiles = TL.comoments(bank, N)
    rows = TL.covariance_table(tiles, N)
    for b, x in (("a", values), ("b", values[:40] * 2 + 5)):
        mine = rows.where(F.col("bank") == b)
        assert np.allclose(dense(mine, "cov"), np.cov(x.T)) and np.allclose(dense(mine, "mean_i")[:, 0], x.mean(axis=0)) and np.allclose(dense(mine, "mean_j")[0], x.mean(axis=0))
    assert np.allclose(dense(TL.correlation_table(rows).where("bank = 'a'"), "r"), np.corrcoef(values.T))
    top = TL.leading_eigenvalues(tiles, N, 10)
    assert np.allclose(top["a"], np.linalg.eigvalsh(np.cov(values.T))[::-1][:10], rtol=1e-9)


def test_merging_is_exact():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(2, 50, 3)) + 1e3
    one = lambda s: (float(len(x[s])), x[s].mean(axis=0), y[s].mean(axis=0), (x[s] - x[s].mean(axis=0)).T @ (y[s] - y[s].mean(axis=0)))
    got = TL.merge(TL.merge(one(slice(0, 1)), one(slice(1, 20))), one(slice(20, 50)))
    want = one(slice(0, 50))
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def test_rank_correlation_with_ties(spark, values):
    x = np.round(values, 0)
    x[:, 5] = 1.0  # a coordinate that does not vary
    got = dense(K.spearman(table(spark, a=x), N, "a"), "rank_correlation")
    want = pd.DataFrame(x).rank().corr().to_numpy()
    assert np.allclose(got, want, equal_nan=True)


def test_covariance_metrics(spark, values):
    other = values[:60] * 1.5 + 0.3
    r = K.covariance_metrics(table(spark, ref=values, cmp=other), N, "ref").collect()[0]
    c0, c = np.cov(values.T), np.cov(other.T)
    s0, s = np.sqrt(np.diag(c0)), np.sqrt(np.diag(c))
    e0, e = np.linalg.eigvalsh(c0), np.linalg.eigvalsh(c)
    r0, r1, off = c0 / np.outer(s0, s0), c / np.outer(s, s), ~np.eye(N, dtype=bool)
    assert (r["reference_draws"], r["draws"]) == (90, 60)
    assert np.isclose(r["mean_rms"], np.sqrt(np.mean(((other.mean(axis=0) - values.mean(axis=0)) / s0) ** 2))) and np.isclose(r["sd_ratio"], s.mean() / s0.mean())
    assert np.isclose(r["leading_ratio"], e[-1] / e0[-1]) and np.allclose(r["leading_ratios"], (e[-10:] / e0[-10:])[::-1])
    assert np.isclose(r["effective_rank_ratio"], (e.sum() ** 2 / (e**2).sum()) / (e0.sum() ** 2 / (e0**2).sum()))
    assert np.isclose(r["correlation_frobenius"], np.linalg.norm(r1 - r0) / np.linalg.norm(r0)) and np.isclose(r["correlation_mae"], np.abs((r1 - r0)[off]).mean())


def test_nested_spectrum(spark, values):
    r = K.nested_spectrum(table(spark, a=values), N, "a").collect()[0]
    m = np.stack([values[np.arange(90) % 5 == k].mean(axis=0) for k in range(5)])[np.arange(90) % 5]
    top = [np.linalg.eigvalsh(np.cov(x.T))[-1] for x in (values, values - m, m)]
    assert np.isclose(r["within_leading"], top[1] / top[0]) and np.isclose(r["between_leading"], top[2] / top[0]) and r["identity_error"] < 1e-9
