"""Rates in force and their trailing means against plain Python, with nested and tied overrides over many chunks."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from riskpanel.operators import features as C
from riskpanel.operators import gaps as G
from riskpanel.params import FeatureProtocol

T0 = datetime(2024, 1, 1)
AT = "entity_id long, split string, ts timestamp_ntz, ordinal long"


def _tables(seed):
    """A hot entity with sparse schedules over many chunks, overrides nested, tied, empty, reversed and without a rate."""
    rng = np.random.default_rng(seed)
    at = lambda m: T0 + timedelta(minutes=int(m))
    obs, sched, over = [], [], []
    for e, n in ((1, 300), (2, 15), (3, 2)):
        t = np.unique(rng.integers(0, 9000, n))
        obs += [(e, "training", at(m), i, float(i)) for i, m in enumerate(t)]
    for i, m in enumerate((100, 100, 2500, 2503, 7000)):
        sched.append((1, "training", at(m), 9 - i, float(i + 1) if i != 3 else None))
    sched.append((2, "training", at(20), 0, 3.5))
    for i in range(60):
        b, k = int(rng.integers(0, 8000)), int(rng.choice([-5, 0, 1, 15, 40, 400, 3000]))
        over.append((1 if i % 4 else 2, "training", i, None if i % 11 == 0 else float(rng.integers(1, 50)), at(b), at(b + k)))
    over += [(1, "training", 100 - i, 60.0 + i, at(4000), at(4000 + 30 * i)) for i in range(4)]
    return obs, sched, over


def _rate(e, when, sched, over):
    active = [(b, -o, r) for x, _, o, r, b, f in over if x == e and b <= when < f]
    if active and (r := max(active, key=lambda v: v[:2])[2]) is not None:
        return r, True
    plan = [(ts, -o, r) for x, _, ts, o, r in sched if x == e and ts <= when]
    r = max(plan, key=lambda v: v[:2])[2] if plan else None
    return (0.0 if r is None else r), False


@pytest.mark.parametrize("chunk", [45.0, 700.0, 20000.0])
def test_rates_match_plain_python(spark, chunk):
    p = FeatureProtocol(chunk_min=chunk)
    obs, sched, over = _tables(5)
    acts = spark.createDataFrame([], AT + ", dose double, ts_end timestamp_ntz, kind string")
    steps = G.observed_steps(spark.createDataFrame(obs, AT + ", value double"), acts, chunk)
    got = C.state_features(
        steps, acts, spark.createDataFrame([], AT + ", amount double"), spark.createDataFrame(sched, AT + ", rate double"),
        spark.createDataFrame(over, "entity_id long, split string, ordinal long, rate double, ts_begin timestamp_ntz, ts_end timestamp_ntz"), p).toPandas()
    assert len(got) == steps.count()
    for r in got.itertuples():
        want, on = _rate(r.entity_id, r.tau_t, sched, over)
        assert (r.rate_current, r.override_active) == (want, on), (r.entity_id, r.tau_t)
        mean = np.mean([_rate(r.entity_id, r.tau_t - timedelta(minutes=5 * k), sched, over)[0] for k in range(1, 7)])
        assert abs(r.rate_mean - mean) < 1e-9


def test_no_schedule_and_no_override(spark):
    obs, _, _ = _tables(6)
    none = spark.createDataFrame([], AT + ", dose double, ts_end timestamp_ntz, kind string, rate double, amount double, ts_begin timestamp_ntz")
    steps = G.observed_steps(spark.createDataFrame(obs, AT + ", value double"), none.select("entity_id", "split", "ts", "ordinal", "dose", "ts_end", "kind"), 700.0)
    got = C.state_features(steps, none, none, none, none, FeatureProtocol(chunk_min=700.0)).toPandas()
    assert len(got) == steps.count() and (got.rate_current == 0).all() and (got.rate_mean == 0).all() and not got.override_active.any()
    assert not pd.isna(got.rate_mean).any()
