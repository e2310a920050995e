"""Certified rule sets against plain Python, and their promise on fresh texts."""

import math
import random

from pyspark.sql import functions as F

from riskpanel.llm import quality
from riskpanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def in_python(rows, risk, error):
    """Cut-offs by the definition, from (stratum, good, half, values)."""
    found, strata = {}, {r[0] for r in rows}
    sets = {}
    for s in strata:
        for k, m in enumerate(quality.MEASURES):
            x = sorted(r[3][k] for r in rows if r[0] == s and r[1] and not r[2])
            if x:
                sets.setdefault(s, {})[m] = [f * x[-1] for f in quality.MARGINS] + [x[math.ceil(q * len(x)) - 1] for q in quality.QUANTILES]
    for s, cuts in sets.items():
        bad = [r[3] for r in rows if r[0] == s and not r[1] and not r[2]]
        good = [r[3] for r in rows if r[0] == s and r[1] and r[2]]
        best = 0
        for i in range(8):
            on = {k: cuts[m][i] for k, m in enumerate(quality.MEASURES) if any(v[k] > cuts[m][i] for v in bad)}
            lost = sum(any(v[k] > c for k, c in on.items()) for v in good)
            if quality.upper_bound(lost, len(good), error / len(sets)) > risk:
                break
            caught = sum(any(v[k] > c for k, c in on.items()) for v in bad)
            if caught > best:
                best, found = caught, {x: c for x, c in found.items() if x[0] != s} | {(s, quality.MEASURES[k]): c for k, c in on.items()}
    return found


def made(seed):
    draw, rows = random.Random(seed), []
    for s, n in (("a", 900), ("b", 260), (None, 240), ("few", 60), ("bad only", 0)):
        for _ in range(n):
            rows.append((s, True, draw.randrange(2), [draw.betavariate(2, 20), draw.betavariate(1, 30), draw.choice((0.0, 0.0, 0.1)), draw.random() * 0.2, draw.random(), 0.0]))
        for _ in range(80):
            rows.append((s, False, draw.randrange(2), [draw.betavariate(4, 9), draw.betavariate(2, 9), draw.choice((0.0, 0.5)), draw.random() * 0.4, draw.random(), draw.choice((0.0, 1.0))]))
    return rows


def test_cutoffs_by_definition(spark):
    fields = "stratum string, good boolean, half int, " + ", ".join(f"{m} double" for m in quality.MEASURES)
    for seed in (1, 2):
        rows = made(seed)
        got = quality.thresholds(spark.createDataFrame([(s, g, h, *v) for s, g, h, v in rows], fields))
        assert got == in_python(rows, quality.RISK, quality.ERROR)
        assert {s for s, _ in got} == {"a", "b", None}
    assert quality.thresholds(spark.createDataFrame([], fields)) == {}
    bad = [(s, g, h, *v) for s, g, h, v in made(1) if not g]
    assert quality.thresholds(spark.createDataFrame(bad, fields)) == {}
    good = [(s, g, h, *v) for s, g, h, v in made(1) if g]
    assert quality.thresholds(spark.createDataFrame(good, fields)) == {}


def test_good_texts_of_every_language_are_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality > 0").select("doc_id").distinct()
    got = QUERIES["op7_quality_rules"](spark, SF).join(docs, "doc_id").join(good, "doc_id")
    told = got.groupBy("lang", "has_rules").agg(F.max("rules").alias("rules")).collect()
    lost = {r["lang"]: r["lost"] for r in got.selectExpr("lang", "int(rules <> '') as r").groupBy("lang").agg({"r": "avg"}).toDF("lang", "lost").collect()}
    assert any(r["has_rules"] for r in told) and all(r["has_rules"] or not r["rules"] for r in told)
    assert all(x <= quality.RISK for x in lost.values())
