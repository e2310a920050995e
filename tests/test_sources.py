"""Event XML parsing, sinks and audits."""

import tempfile

from pyspark.sql import functions as F

from riskpanel.sources import audits as A
from riskpanel.sources import tables as TB
from riskpanel.sources import xml_events as X

DOC = """<?xml version="1.0"?>
<patient id="77">
  <glucose_level><event ts="01-02-2020 00:00:00" value="100"/><event ts="bad" value="1"/><event ts="01-02-2020 00:05:00" value=""/><event ts="01-02-2020 00:10:00" value="101.5"/></glucose_level>
  <bolus><event ts_begin="01-02-2020 00:01:00" ts_end="01-02-2020 01:01:00" dose="2.5" type="square" bwz_carb_input="30"/><event ts_begin="01-02-2020 02:00:00" dose="1" bwz_carb_input="nan"/></bolus>
  <meal><event ts="01-02-2020 00:02:00" carbs="40" type="Lunch"/></meal>
  <basal><event ts="01-02-2020 00:00:00" value="0.9"/></basal>
  <temp_basal><event ts_begin="01-02-2020 00:00:00" value="0.1"/><event ts_begin="01-02-2020 00:00:00" ts_end="01-02-2020 00:30:00" value="0.2"/></temp_basal>
  <stressors><event ts="01-02-2020 00:03:00"/></stressors>
  <sleep><event ts_begin="01-02-2020 01:00:00" ts_end=""/><event ts_begin="01-02-2020 03:00:00" ts_end="01-02-2020 04:00:00"/></sleep>
</patient>
"""


def _folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_event_xml(spark):
    d = _folder()
    for name in ("77-ws-training.xml", "77-ws-testing.xml"):
        with open(f"{d}/{name}", "w", encoding="utf-8") as h:
            h.write(DOC)
    e = X.read_events(spark, d).toPandas()
    one = e[e.split == "training"]
    n = one.groupby("stream").size().to_dict()
    assert n == {"observation": 2, "action": 2, "exposure": 1, "schedule": 1, "override": 1, "context": 4}
    assert set(e.split) == {"training", "testing"} and set(e.entity_id) == {"77"}
    act = one[one.stream == "action"].sort_values("ordinal")
    assert act.kind.tolist() == ["square", "normal"] and act.ts_end.iloc[1] == act.ts_begin.iloc[1]
    assert act.extra.iloc[0] == 30 and act.extra.isna().iloc[1]
    assert one[one.stream == "observation"].ordinal.tolist() == [0, 3]
    assert sorted(one[one.stream == "context"].phase) == ["begin", "begin", "end", "point"]
    merged = X.merge_splits(*[spark.createDataFrame(e[e.split == s].drop(columns="extra").astype({"value": float})[["entity_id", "split", "stream", "ordinal"]]) for s in ("training", "testing")])
    assert merged.select("split").distinct().count() == 1 and merged.count() == len(e)


def test_corrupt_documents_are_listed_and_give_no_rows(spark):
    d = _folder()
    for name, text in (("77-ws-training.xml", DOC.replace("<meal>", "<meal")), ("78-ws-training.xml", DOC.replace('"77"', '"78"'))):
        with open(f"{d}/{name}", "w", encoding="utf-8") as h:
            h.write(text)
    assert {r["entity_id"] for r in X.read_events(spark, d).collect()} == {"78"}
    bad = X.corrupt_documents(spark, d).collect()
    assert len(bad) == 1 and "77" in bad[0]["document"] and bad[0]["split"] == "training"


def test_all_streams_come_from_one_scan(spark):
    d = _folder()
    with open(f"{d}/77-ws-training.xml", "w", encoding="utf-8") as h:
        h.write(DOC)
    plan = X.read_events(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_replicate_csv_and_manifest(spark):
    d = _folder()
    df = spark.createDataFrame([(1, 0.5, " TRUE"), (2, None, "false"), (3, 0.25, "")], "key long, p double, flag string")
    TB.write_table(df, f"{d}/t", "csv", compressed=True)
    back = {r["key"]: r for r in TB.read_replicates(spark, f"{d}/t", numbers=("p",), booleans=("flag",), integers=("key",)).collect()}
    assert back[1]["flag"] and not back[2]["flag"] and not back[3]["flag"] and back[2]["p"] is None
    now = A.file_manifest(spark, f"{d}/t")
    rec = now.limit(1).select("path", F.lit("0").alias("sha256")).unionByName(spark.createDataFrame([("gone", "x")], "path string, sha256 string"))
    status = {r["status"] for r in A.manifest_drift(rec, now).collect()}
    assert {"changed", "missing"} <= status
    assert {r["status"] for r in A.manifest_drift(now, now).collect()} == {"match"}


def test_partitioned_sink_replaces_only_its_own(spark):
    d = f"{_folder()}/x"
    rows = spark.createDataFrame([(1, "training", 5.0), (2, "testing", 5.0)], "v int, split string, interval_min double")
    TB.write_transitions(rows, d)
    TB.write_transitions(rows.where("split = 'testing'").withColumn("v", F.lit(9)), d)
    assert sorted(r["v"] for r in spark.read.parquet(d).collect()) == [1, 9]
