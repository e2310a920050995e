"""The transition scan: next states, numbers and ties across chunks against plain Python, and what its plan shuffles."""

import re
from contextlib import redirect_stdout
from datetime import datetime, timedelta
from io import StringIO

import numpy as np
from pyspark.sql import functions as F

from riskpanel.operators import gaps as G
from riskpanel.operators import transitions as T
from riskpanel.params import FEATURES, FeatureProtocol, GapProtocol, RewardRule

T0 = datetime(2024, 1, 1)
GAP = GapProtocol(valid_min=(10.0, 400.0), chunk_min=100.0)
EVENT = "entity_id long, split string, ts timestamp_ntz, ordinal long, dose double"


def built(spark, minutes, acts, exps):
    def rows(at):
        return [(e, "training", T0 + timedelta(minutes=m), i, float(m)) for i, (e, m) in enumerate(at)]

    obs, actions, exposures = (spark.createDataFrame(rows(x), EVENT) for x in (minutes, acts, exps))
    steps = G.observed_steps(obs.withColumnRenamed("dose", "value"), actions, GAP.chunk_min)
    made = [(F.col("value") * 3 + i).alias(f) for i, f in enumerate(FEATURES)]
    return T.transitions(steps.select("*", *made, (F.rand(1) < 0.5).alias("override_active")), actions, exposures, GAP, FeatureProtocol(), RewardRule())


def test_cells_across_chunks_match_plain_python(spark):
    """Ties lie on starts, on ends, in chunks without an observation, before the first and after the last one."""
    rng = np.random.default_rng(4)
    minutes = [(e, int(m)) for e in (1, 2, 3) for m in np.unique(rng.integers(0, 9000, 60))] + [(4, 50)]
    some = [(e, int(m)) for e in (1, 2, 3, 4) for m in np.unique(rng.integers(0, 9500, 80))] + [minutes[3], minutes[9], minutes[80]]
    got = built(spark, minutes, some + [(1, 9400)], [x for i, x in enumerate(some) if i % 3] + [(2, 1)]).toPandas()
    both = {x for i, x in enumerate(some) if i % 3 and x in some}
    seen = 0
    for e in (1, 2, 3):
        at = sorted(m for k, m in minutes if k == e)
        cells = got[got.entity_id == e].sort_values("tau_t").reset_index(drop=True)
        assert len(cells) == len(at) - 1
        segment, before = -1, False
        for i, (r, a, b) in enumerate(zip(cells.itertuples(), at, at[1:])):
            ok = 10 <= b - a <= 400
            segment += ok and not before
            ties = [m for k, m in both if k == e and a <= m < b]
            assert r.edge_index == i and r.valid == ok and r.segment_id == (segment if ok else -1)
            assert r.tie_in_cell == bool(ties) and r.tie_at_tau == (a in ties)
            assert r.raw__value_current == 3 * a and r.next_raw__value_current == 3 * b and r.next_raw__missing_fraction == 3 * b + 20
            before, seen = ok, seen + bool(ties)
    assert seen > 10 and not len(got[got.entity_id == 4])


def test_wide_rows_are_shuffled_once(spark):
    text = StringIO()
    with redirect_stdout(text):
        built(spark, [(1, 0), (1, 50)], [(1, 5)], [(1, 6)]).explain("formatted")
    exchanges = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text.getvalue())
    assert sum("override_active#" in x for x in exchanges) == 1
