"""Decimal text of doubles that lie next to a tie, against the texts of Python and DuckDB."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskpanel.operators import transitions as T
from riskpanel.operators.replicates import fingerprint
from riskpanel.params import FEATURES, FeatureProtocol, GapProtocol, RewardRule
from riskpanel.functions.columns import fixed_text


def ties(n=2000):
    """Gaps of whole microseconds whose minutes look like ties of the third decimal."""
    us = np.random.default_rng(0).integers(1, 720_000, n) * 60_000 + 30_000
    return pd.DataFrame({"n": us, "x": us / 60_000_000.0})


def test_text_is_that_of_the_binary_value(spark):
    got = spark.createDataFrame(ties()).select("x", fixed_text(F.col("x"), 3).alias("a"), fixed_text(-F.col("x"), 2).alias("b")).toPandas()
    assert got["a"].tolist() == [f"{x:.3f}" for x in got["x"]]
    assert got["b"].tolist() == [f"{-x:.2f}" for x in got["x"]]
    assert got["a"].tolist() == [r[0] for r in duckdb.sql("SELECT printf('%.3f', x) FROM got").fetchall()]


def test_reason_of_an_invalid_gap(spark):
    day, pdf = 86_400_000_000, ties(40)
    pdf["n"] += 2 * day  # beyond the longest valid gap
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = spark.createDataFrame(pdf).select(F.col("n").alias("entity_id"), F.lit("training").alias("split"), F.explode(F.array(F.lit(0).cast("long"), F.col("n"))).alias("us"))
    steps = at.select("entity_id", "split", "us", F.timestamp_add("MICROSECOND", F.col("us"), start).alias("tau_t"))
    ends = steps.groupBy("entity_id").agg(F.max("tau_t").alias("_end"), (F.max("us") / 60_000_000.0).alias("_gap"))
    rows = steps.join(ends, "entity_id").withColumn("tau_next", F.when(F.col("us") == 0, F.col("_end"))).withColumn("gap_min", F.when(F.col("us") == 0, F.col("_gap")))
    rows = rows.select("entity_id", "split", "tau_t", "tau_next", "gap_min", F.lit(None).cast("double").alias("prev_gap_min"), F.lit(1.0).alias("value"), F.lit(1.0).alias("next_value"),
                       F.lit(0).cast("long").alias("action_count"), F.lit(0.0).alias("action_dose"), F.lit(False).alias("override_active"), *[F.lit(0.0).alias(f) for f in FEATURES])
    none = spark.createDataFrame([], "entity_id long, split string, ts timestamp_ntz")
    got = T.transitions(rows, none, none, GapProtocol(), FeatureProtocol(), RewardRule()).select("duration_min", "invalid_reason").toPandas()
    assert len(got) == 40 and got["duration_min"].min() > 2880
    lo, hi = GapProtocol().valid_min
    assert got["invalid_reason"].tolist() == [f"gap_{x:.3f}min_outside_[{lo},{hi}]" for x in got["duration_min"]]


def test_digest_of_ties(spark):
    from hashlib import sha256

    values = (np.arange(1, 400) * 2 + 1) / 2_000_000.0
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "i": np.arange(len(values)), "v": values}))
    digests = [sha256(f"{i}:{v:.6f}".encode()).hexdigest() for i, v in enumerate(values)]
    want = ":".join(str(sum(int(d[at:at + 15], 16) for d in digests)) for at in (0, 15))
    assert fingerprint(df, ["g"], "i", "v").collect()[0]["digest"] == want
