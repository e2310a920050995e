"""Chunked scans, exact quantiles and causal features against brute force, with one dominant entity."""

import re
from contextlib import redirect_stdout
from datetime import datetime, timedelta
from io import StringIO

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskpanel.operators import features as C
from riskpanel.operators import gaps as G
from riskpanel.operators import qc as E
from riskpanel.operators import quantiles as Q
from riskpanel.operators.quantiles import cumulative_cells, exact_quantiles
from riskpanel.operators.timeline import chunked, neighbours, running
from riskpanel.params import FEATURES, FeatureProtocol, GapProtocol

T0 = datetime(2024, 1, 1)


def history(seed=0, n=400):
    """A hot entity with most rows and a few small ones."""
    rng = np.random.default_rng(seed)
    rows = []
    for e, k in ((1, n), (2, 12), (3, 1)):
        t = np.cumsum(rng.choice([5, 5, 5, 5, 7, 20, 3000], size=k))
        for i, m in enumerate(t):
            rows.append((e, "training", T0 + timedelta(minutes=int(m)), i, float(rng.normal(120, 40))))
    return pd.DataFrame(rows, columns=["entity_id", "split", "ts", "ordinal", "value"])


SCHEMA = "entity_id long, split string, ts timestamp_ntz, ordinal long, value double"


@pytest.mark.parametrize("parts", [1, 7])
def test_running_and_neighbours_match_pandas(spark, parts):
    pdf = history()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = chunked(spark.createDataFrame(pdf, SCHEMA), ["entity_id", "split"], "ts", 1440.0)
    out = running(df, ["entity_id", "split"], ["ts"], {
        "cum": ("sum", F.col("value")), "top": ("max", F.col("value")), "known": ("last", F.when(F.col("value") > 150, F.col("value"))),
        "first": ("all_min", F.col("ts"))})
    out = neighbours(out, ["entity_id", "split"], ["ts"], ["ts", "value"]).orderBy("entity_id", "ts").toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    pdf = pdf.sort_values(["entity_id", "ts"]).reset_index(drop=True)
    g = pdf.groupby("entity_id")["value"]
    assert np.allclose(out["cum"], g.cumsum())
    assert np.allclose(out["top"], g.cummax())
    want = pdf["value"].where(pdf["value"] > 150).groupby(pdf["entity_id"]).ffill()
    assert np.allclose(out["known"].fillna(-1).astype(float), want.fillna(-1))
    assert np.allclose(out["prev_value"].fillna(-1).astype(float), g.shift(1).fillna(-1))
    assert np.allclose(out["next_value"].fillna(-1).astype(float), g.shift(-1).fillna(-1))
    assert (pd.to_datetime(out["first"]) == pdf.groupby("entity_id")["ts"].transform("min")).all()


@pytest.mark.parametrize("values", [np.r_[np.full(5000, 1.0), np.linspace(100, 100.2, 3000)], np.random.default_rng(1).lognormal(0, 3, 4000), np.array([2.0]), -np.arange(50.0)])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": values}))
    ps = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.975, "e": 1.0}
    got = exact_quantiles(df, ["k"], "x", ps).collect()[0]
    assert np.allclose([got[n] for n in ps], np.quantile(values, list(ps.values())), rtol=1e-12, atol=1e-12)
    flat = exact_quantiles(df, [], "x", ps).collect()[0]
    assert flat["c"] == got["c"]


def test_cumulative_cells(spark):
    x = np.random.default_rng(2).integers(-5, 5, 300).astype(float)
    got = cumulative_cells(spark.createDataFrame(pd.DataFrame({"x": x})), [], F.col("x"), {"n": F.lit(1).cast("long")}).toPandas()
    for r in got.itertuples():
        assert r.n_below == (x < r.value).sum() and r.n == (x == r.value).sum() and r.n_total == len(x)


def test_last_duplicate_wins_and_order_is_irrelevant(spark):
    rows = [(1, "training", T0, 0, 1.0), (1, "training", T0, 5, 9.0), (1, "training", T0, 2, 4.0)]
    for order in (rows, rows[::-1]):
        assert G.dedup_observations(spark.createDataFrame(order, SCHEMA)).collect()[0]["value"] == 9.0


def _streams(spark, extra=()):
    obs = spark.createDataFrame(history(3, 120), SCHEMA)
    acts = [(1, "training", T0 + timedelta(minutes=m), i, d, T0 + timedelta(minutes=m + w), "x") for i, (m, d, w) in enumerate(
        [(3, 2.0, 0), (40, 6.0, 120), (41, 1.0, 0), (55, 3.0, 5000), *extra])]
    actions = spark.createDataFrame(acts, "entity_id long, split string, ts timestamp_ntz, ordinal long, dose double, ts_end timestamp_ntz, kind string")
    exps = spark.createDataFrame([(1, "training", T0 + timedelta(minutes=m), i, float(m)) for i, m in enumerate((5, 35, 90))],
                                 "entity_id long, split string, ts timestamp_ntz, ordinal long, amount double")
    sched = spark.createDataFrame([(1, "training", T0 + timedelta(minutes=m), i, r) for i, (m, r) in enumerate([(0, 1.0), (0, 9.0), (60, 2.0)])],
                                  "entity_id long, split string, ts timestamp_ntz, ordinal long, rate double")
    over = spark.createDataFrame([(1, "training", 0, 5.0, T0 + timedelta(minutes=20), T0 + timedelta(minutes=200)),
                                  (1, "training", 1, 7.0, T0 + timedelta(minutes=30), T0 + timedelta(minutes=50))],
                                 "entity_id long, split string, ordinal long, rate double, ts_begin timestamp_ntz, ts_end timestamp_ntz")
    return obs, actions, exps, sched, over


def _features(spark, obs, rest, chunk=1440.0):
    p = FeatureProtocol(chunk_min=chunk)
    return C.state_features(G.observed_steps(obs, rest[0], chunk), *rest, p).orderBy("entity_id", "tau_t").toPandas()


def test_features_match_direct_formulas_and_chunk_width(spark):
    obs, *rest = _streams(spark)
    a, b = _features(spark, obs, rest), _features(spark, obs, rest, chunk=333.0)
    names = list(FeatureProtocol().scaling)
    assert np.allclose(a[names].astype(float), b[names].astype(float), atol=1e-7)
    acts = rest[0].toPandas()
    one = a[a.entity_id == 1]
    for r in one.head(60).itertuples():
        tau, total, residual, h = r.tau_t, 0.0, 0.0, 240.0
        for e in acts.itertuples():
            s, f = (e.ts - tau).total_seconds() / 60, (e.ts_end - tau).total_seconds() / 60
            if f <= s:
                total += e.dose if -30 <= s < 0 else 0
                residual += e.dose * (1 + s / h) if -h < s < 0 else 0
            else:
                total += e.dose * max(0.0, min(0, f) - max(-30, s)) / (f - s)
                lo, hi = max(s, -h), min(f, 0.0)
                if hi > lo:
                    residual += e.dose / (f - s) * ((hi - lo) + (hi * hi - lo * lo) / (2 * h))
        assert abs(total - r.delivered_short) < 1e-8 and abs(residual - r.residual_exposure) < 1e-6
    rate = one.set_index(((one.tau_t - T0).dt.total_seconds() / 60).astype(int))["rate_current"].to_dict()
    for m, v in rate.items():
        want = 7.0 if 30 <= m < 50 else 5.0 if 20 <= m < 200 else (1.0 if m < 60 else 2.0)
        assert v == want, (m, v)


def test_future_records_do_not_change_a_state(spark):
    obs, *rest = _streams(spark)
    base = _features(spark, obs, rest)
    cut = base[base.entity_id == 1].tau_t.iloc[60]
    moved = obs.withColumn("value", F.when(F.col("ts") > F.lit(cut), F.col("value") + 500).otherwise(F.col("value")))
    acts = rest[0].withColumn("dose", F.when(F.col("ts") >= F.lit(cut), F.col("dose") * 9).otherwise(F.col("dose")))
    after = _features(spark, moved, [acts, *rest[1:]])
    names = list(FeatureProtocol().scaling)
    keep = lambda d: d[(d.entity_id == 1) & (d.tau_t <= cut)][names].astype(float).to_numpy()
    assert np.array_equal(keep(base), keep(after))


def test_extended_dose_is_allocated_exactly_once(spark):
    obs = spark.createDataFrame([(1, "training", T0 + timedelta(minutes=30 * i), i, 1.0) for i in range(200)], SCHEMA)
    act = spark.createDataFrame([(1, "training", T0 + timedelta(minutes=47), 0, 8.0, T0 + timedelta(minutes=1511), "x")],
                                "entity_id long, split string, ts timestamp_ntz, ordinal long, dose double, ts_end timestamp_ntz, kind string")
    _, _, exps, sched, over = _streams(spark)
    got = _features(spark, obs, [act, exps, sched, over], chunk=700.0)
    assert abs(got["delivered_short"].sum() - 8.0) < 1e-8


def test_segments_and_gap_class(spark):
    minutes = [0, 5, 10, 30, 35, 100, 105, 110, 115]
    obs = spark.createDataFrame([(1, "training", T0 + timedelta(minutes=m), i, 1.0) for i, m in enumerate(minutes)], SCHEMA)
    e = G.edges(obs, None, GapProtocol()).orderBy("edge_index").toPandas()
    assert e.segment_id.tolist() == [0, 0, -1, 1, -1, 2, 2, 2]
    c = G.classify_gaps(spark.createDataFrame(e[["entity_id", "split", "edge_index", "tau_t", "tau_next", "gap_min", "valid"]]), GapProtocol()).orderBy("edge_index").toPandas()
    assert c.gap_class[2] == "genuine_long_gap_approximately_3_missing" and c.gap_bin[4] == "1-2h"


@pytest.mark.parametrize("values", [np.r_[np.full(5000, 1.0), np.linspace(100, 100.2, 3000), np.nan], -np.arange(50.0)])
def test_exact_quantiles_of_few_groups(spark, values):
    """Buckets counted first: the same numbers, and no row is shuffled before it is known to lie in a wanted bucket."""
    df = spark.createDataFrame([(k, float(v)) for k in "ab" for v in values] + [("c", None)], "k string, x double")
    ps = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.975, "e": 1.0}
    got = exact_quantiles(df, ["k"], "x", ps, few=True).orderBy("k").toPandas()
    assert got.k.tolist() == ["a", "b"]
    for r in got.to_dict("records"):
        assert np.allclose([r[n] for n in ps], np.nanquantile(values, list(ps.values())), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("whole", [5, 1000])
def test_grouped_distributions_of_groups_of_any_size(spark, monkeypatch, whole):
    monkeypatch.setattr(Q, "WHOLE_ROWS", whole)
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.r_[np.zeros(300), rng.integers(1, 60, 200)].astype(int), "u": rng.normal(size=500).round(1), "v": rng.lognormal(0, 3, 500)})
    out = Q.grouped_distributions(spark.createDataFrame(pdf), ["k"], ["u", "v"], {"lo": 0.05, "mid": 0.5})
    got = out.toPandas().set_index(["k", "feature"]).sort_index()
    for c in ("u", "v"):
        by = pdf.groupby("k")[c]
        here = got.xs(c, level="feature")
        assert len(here) == len(by) and (here.n == by.size()).all() and np.allclose(here["mean"], by.mean()) and np.allclose(here.sd, by.std(ddof=0))
        assert np.allclose(here.lo, by.quantile(0.05), rtol=1e-12) and np.allclose(here.mid, by.quantile(0.5), rtol=1e-12)


def test_feature_rows_are_not_multiplied_before_the_shuffle(spark):
    """All columns of a row travel together: no exchange holds a row per feature but that of the large groups."""
    rows = spark.createDataFrame([(1, "training", 1.0, 0, True, *map(float, range(len(FEATURES))))], ", ".join(
        ["entity_id long, split string, interval_min double, action int, valid boolean", *[f"raw__{f} double" for f in FEATURES]]))
    text = StringIO()
    with redirect_stdout(text):
        E.feature_distributions(rows).explain("formatted")
    wide = [x for x in re.findall(r"\) Exchange\nInput \[(\d+)\]", text.getvalue()) if int(x) >= len(FEATURES)]
    assert len(wide) == 1
