"""The comparison of arms with their baseline: one reading of the arms, missing means and layers as in SQL."""

import random

import duckdb
from pyspark.sql import functions as F

from riskpanel.operators.replicates import pick_arm, relative_to_baseline

METRICS = {"a": 2.0, "b": 3.0}


def test_baseline_is_not_read_again(spark):
    """Values that change with every reading, as sums by several executors do in their last bits."""
    some = F.udf(lambda: random.uniform(1.0, 5.0), "double").asNondeterministic()
    arms = spark.range(50).select(F.col("id").alias("layer"), F.explode(F.array(F.lit("M0"), F.lit("M1"))).alias("arm")).select("*", some().alias("a"), some().alias("b"))
    got = {r.arm: r for r in relative_to_baseline(arms, "M0", METRICS).collect()}
    assert set(got) == {"M0", "M1"}
    assert (got["M0"].metrics_closer, got["M0"].maximum_degradation) == (0, 0.0)
    assert pick_arm(relative_to_baseline(arms, "M0", METRICS), ["M0", "M1"], 1, 1e9).first().selected == "M1"


def test_missing_means_and_layers_as_in_sql(spark):
    rows = [("M0", "D0", 2.5, 3.3), ("M1", "D0", 2.2, 3.6), ("M2", "D0", None, None), ("M0", "D1", None, 3.5), ("M1", "D1", 2.1, 3.1),
            ("M1", "D2", 2.0, 3.0), ("M3", "D2", 2.0, 3.0), ("M0", None, 1.0, 1.0), ("M4", None, 1.0, 1.0), (None, "D0", 2.1, 3.1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE arms (arm VARCHAR, layer VARCHAR, a DOUBLE, b DOUBLE)")
    con.executemany("INSERT INTO arms VALUES (?, ?, ?, ?)", rows)
    want = con.execute("""WITH ae AS (SELECT arm, layer, abs(ln(a / 2.0)) AS a, abs(ln(b / 3.0)) AS b FROM arms)
        SELECT x.arm, sum((x.a < y.a)::INT + (x.b < y.b)::INT)::BIGINT,
            max(greatest((x.a - y.a) / greatest(y.a, 1e-12), (x.b - y.b) / greatest(y.b, 1e-12)))
        FROM ae x JOIN ae y ON x.layer = y.layer AND y.arm = 'M0' GROUP BY 1""").fetchall()
    got = relative_to_baseline(spark.createDataFrame(rows, "arm string, layer string, a double, b double"), "M0", METRICS).collect()
    near = lambda t: sorted(((r[0], r[1], None if r[2] is None else round(r[2], 9) + 0.0) for r in t), key=repr)
    assert near(got) == near(want) and len(want) == 4
