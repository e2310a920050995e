"""Registered queries: scans, sinks, registry audits and the value-model check."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite_or_null
from ..operators import features as C
from ..operators import value_check as V
from ..sources import audits as A
from ..sources import tables as TB
from ..sources import xml_events as X
from ..session import shared_folder, shared_table
from . import change_queries as CQ
from . import result_queries as RQ
from . import roles as R
from . import trajectory_queries as TQ
from .registry import Query, query, rounded
from .sql import with_
from .trajectory_queries import CELLS_ONLY


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def csv_replicates(s: SparkSession, d: str) -> DataFrame:
    """Replicate rows through a gzip CSV with blanks and mixed-case booleans, and back."""
    path = _folder(s, "replicate-csv")
    x = RQ.replicates(s, d).select("key", "scenario", "status", "p_value", F.when(F.col("is_null"), "True").otherwise("false").alias("is_null"), "failed_draws")
    TB.write_table(x, path, "csv", compressed=True)
    return TB.read_replicates(s, path, numbers=("p_value",), booleans=("is_null",), integers=("key", "failed_draws"))


def json_replicates(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "replicate-json")
    TB.write_table(RQ.replicates(s, d).select("key", "scenario", "observed", "status"), path, "json")
    return s.read.schema("key long, scenario string, observed double, status string").json(path)


def stored_transitions(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "transitions")
    TB.write_transitions(TQ.stacked(s, d), path)
    return s.read.parquet(path)


# Which child stream an event type is written as, and its attributes.
XML_STREAMS = {"view": ("glucose_level", "value"), "click": ("meal", "carbs"), "purchase": ("bolus", "dose"), "signup": ("basal", "value"), "error": ("stressors", None)}


def event_documents(s: SparkSession, d: str) -> str:
    """Event XML of the events table: one document per entity and half of the month, one folder a split."""
    clock = F.date_format("ts", X.TIME_FORMAT)
    later = F.date_format(F.col("ts") + F.expr("interval 30 minutes"), X.TIME_FORMAT)
    cell = F.struct("ts", "event_id", clock.alias("begin"), later.alias("end"), F.col("value").cast("string").alias("value"))
    e = R.table(s, d, "events").select("user_id", "event_type", F.when(F.dayofmonth("ts") <= 15, "training").otherwise("testing").alias("split"), cell.alias("e"))

    def stream(kind: str, tag: str, attr: str | None):
        def one(c):
            times = [c["begin"].alias("_ts_begin"), c["end"].alias("_ts_end")] if tag == "bolus" else [c["begin"].alias("_ts")]
            return F.struct(*times, *([] if attr is None else [c["value"].alias(f"_{attr}")]))
        return F.struct(F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.col("e")))), one).alias("event")).alias(tag)

    docs = e.groupBy(F.col("user_id").cast("string").alias("_id"), "split").agg(*[stream(kind, *how) for kind, how in XML_STREAMS.items()])
    path = _folder(s, "event-xml")
    for split in ("training", "testing"):
        docs.where(F.col("split") == split).drop("split").write.format("xml").option("rootTag", "patients").option("rowTag", "patient").save(f"{path}/all-{split}.xml")
    return path


def event_xml(s: SparkSession, d: str) -> DataFrame:
    return X.read_events(s, event_documents(s, d) + "/*")


def manifest_status(s: SparkSession, d: str) -> DataFrame:
    """Drift between two states of a folder with a file a line number: 3 changed, 4 gone, 5 new."""
    lines = R.table(s, d, "lineitem").select("l_linenumber", "l_quantity")
    more = F.when(F.col("l_linenumber") == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    found = []
    for state in (lines.where("l_linenumber <> 5"), lines.where("l_linenumber <> 4").withColumn("l_quantity", more)):
        path = _folder(s, "manifest")
        total = state.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("quantity"))
        total.repartition("l_linenumber").write.partitionBy("l_linenumber").csv(path)
        found.append(A.file_manifest(s, path, "*.csv").select(F.regexp_extract("path", "l_linenumber=([0-9]+)", 1).alias("path"), "sha256"))
    return A.manifest_drift(*found).select(F.col("path").cast("long").alias("line_number"), "status")


def check_rows(s: SparkSession, d: str) -> DataFrame:
    """Scaled transitions with the fixed propensity score."""
    def build():
        c = TQ.cells(s, d).where("valid")
        flat = C.scale_state(C.scale_state(c, TQ.P, "raw__", "state__"), TQ.P, "next_raw__", "next_state__")
        z = F.col("raw__value_current") / 50.0 - F.col("raw__since_action") / 3600.0 + F.col("raw__time_of_day_sin") / 2.0
        return flat.select("entity_id", "split", F.col("edge_index").alias("elapsed_index"), "action", "reward_binary", "reward_weighted",
                           C.state_vector("state__", TQ.P).alias("state"), C.state_vector("next_state__", TQ.P).alias("next_state"),
                           F.round(1.0 / (1.0 + F.exp(-z)), 4).alias("propensity"))
    return shared_table(s, d, "check_rows", build)


def check_values(s: SparkSession, d: str) -> DataFrame:
    def build():
        rows = check_rows(s, d)
        sample = V.downsample_negatives(rows.where("split = 'training'"), 2, 42)
        return V.value_check(sample, rows, 21, {"binary": ("reward_binary", 0.0, 1.0), "weighted": ("reward_weighted", -4.0, 1.0)}, (0.1, 1.0, 10.0), 0.9)
    return shared_table(s, d, "check_values", build)


XML_SQL = """WITH x AS (SELECT user_id::VARCHAR AS entity_id, CASE WHEN day(ts) <= 15 THEN 'training' ELSE 'testing' END AS split, event_type, event_id, ts, value FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY entity_id, split, event_type ORDER BY ts, event_id) - 1 AS ordinal FROM x)
    SELECT entity_id, split, CASE event_type WHEN 'view' THEN 'observation' WHEN 'click' THEN 'exposure' WHEN 'purchase' THEN 'action' WHEN 'signup' THEN 'schedule' ELSE 'context' END AS stream, ordinal,
        date_trunc('second', ts)::TIMESTAMP AS ts_begin, (date_trunc('second', ts) + CASE WHEN event_type = 'purchase' THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END)::TIMESTAMP AS ts_end,
        CASE WHEN event_type <> 'error' THEN value END AS value, CASE event_type WHEN 'click' THEN '' WHEN 'purchase' THEN 'normal' WHEN 'error' THEN 'stressor' END AS kind,
        'point' AS phase, NULL::DOUBLE AS extra FROM o WHERE event_type = 'error' OR value IS NOT NULL"""

QUERIES: dict[str, Query] = {
    "event_xml": query(event_xml, rounded(XML_SQL, "value extra", "ordinal"), "A1 A2 A3 A4"),
    "tagged_scan": query(
        lambda s, d: s.read.parquet(f"{d}/events.parquet").select(
            F.regexp_extract(F.col("_metadata.file_path"), r"([a-z]+)\.parquet", 1).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n")),
        "SELECT 'events' AS source, count(*) AS n FROM events", "A4"),
    "finite_numbers": query(
        lambda s, d: R.table(s, d, "events").select("event_id", finite_or_null(F.when(F.col("event_id") % 5 == 0, "nan").when(F.col("event_id") % 5 == 1, "-Infinity").when(
            F.col("event_id") % 5 == 2, "").when(F.col("event_id") % 5 == 3, "x1").otherwise(F.get_json_object("props", "$.k"))).alias("k")),
        rounded("SELECT event_id, CASE WHEN event_id % 5 = 4 THEN TRY_CAST(props->>'$.k' AS DOUBLE) END AS k FROM events", "k"), "A3"),
    "interval_rows": query(
        lambda s, d: X.interval_rows(R.overrides(s, d).drop("rate")),
        with_(CELLS_ONLY, """, o AS (SELECT entity_id, split, ordinal, ts_begin, ts_end FROM ovr)
            SELECT entity_id, split, ordinal, ts_begin AS ts, 'begin' AS phase FROM o UNION ALL SELECT entity_id, split, ordinal, ts_end, 'end' FROM o"""), "A2"),
    "merged_splits": query(
        lambda s, d: X.merge_splits(R.long_events(s, d).where("ts_begin < TIMESTAMP_NTZ '2024-01-16'"), R.long_events(s, d).where("ts_begin >= TIMESTAMP_NTZ '2024-01-16'")).groupBy(
            "entity_id", "split", "stream").agg(F.count(F.lit(1)).alias("n"), F.min("ts_begin").alias("first_ts"), F.max("ordinal").alias("last_ordinal")),
        with_(CELLS_ONLY, """ SELECT entity_id, 'merged' AS split, CASE event_type WHEN 'view' THEN 'observation' WHEN 'purchase' THEN 'action' WHEN 'click' THEN 'exposure' WHEN 'signup' THEN 'schedule'
            ELSE 'context' END AS stream, count(*) AS n, min(ts) AS first_ts, max(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN ordinal + 1000000000000 ELSE ordinal END) AS last_ordinal
            FROM base GROUP BY 1, 2, 3"""), "A5"),
    "csv_round_trip": query(csv_replicates, rounded(with_(RQ.REP, " SELECT key, scenario, status, p_value, is_null, failed_draws FROM rp"), "p_value"), "A7 A8"),
    "json_round_trip": query(json_replicates, rounded(with_(RQ.REP, " SELECT key, scenario, observed, status FROM rp"), "observed"), "A7"),
    "stored_transitions": query(
        lambda s, d: stored_transitions(s, d).groupBy("split", "interval_min").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_min").alias("minutes")),
        rounded(with_(TQ._STACK, "SELECT split, interval_min, count(*) AS n, sum(duration_min) AS minutes FROM stacked GROUP BY 1, 2"), "minutes interval_min", digits=3), "A6", digits=3),
    "manifest_audit": query(
        manifest_status,
        """SELECT l_linenumber::BIGINT AS line_number, CASE l_linenumber WHEN 3 THEN 'changed' WHEN 4 THEN 'missing' WHEN 5 THEN 'unrecorded' ELSE 'match' END AS status
        FROM lineitem GROUP BY l_linenumber""", "A9"),
    "registry_duplicates": query(
        lambda s, d: A.registry_duplicates(R.table(s, d, "lineitem"), "l_partkey"),
        "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1", "A10"),
    "registry_overlap": query(
        lambda s, d: A.registry_overlap(R.table(s, d, "customer").select(F.col("c_custkey").alias("key")), R.table(s, d, "orders").select(F.col("o_custkey").alias("key")), "key"),
        "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders", "A10"),
    "registry_fresh": query(
        lambda s, d: A.fresh_keys(R.table(s, d, "orders").select(F.col("o_orderkey").alias("key")), R.table(s, d, "lineitem").select(F.col("l_orderkey").alias("key")), "key"),
        "SELECT o_orderkey AS key FROM orders EXCEPT SELECT l_orderkey FROM lineitem", "A10"),
    "registry_sources": query(
        lambda s, d: A.registry_sources(R.table(s, d, "orders"), "o_orderstatus", "o_custkey"),
        "SELECT o_orderstatus, count(DISTINCT o_custkey) AS keys FROM orders GROUP BY 1", "A10"),
    "downsampled_negatives": query(
        lambda s, d: V.downsample_negatives(check_rows(s, d).where("split = 'training'"), 2, 42).select("entity_id", "elapsed_index", "action"),
        rounded(with_(CELLS_ONLY, f""", t AS (SELECT entity_id, edge_index AS elapsed_index, action, {CQ.md5_uniform("'42:' || entity_id || ':' || edge_index")} AS h FROM cells WHERE valid AND split = 'training'),
            r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY h) AS rn FROM t)
            SELECT entity_id, elapsed_index, action FROM r WHERE action = 1 OR rn <= 2 * (SELECT count(*) FROM t WHERE action = 1)"""), "", "elapsed_index action"), "E15"),
    "value_summary": query(lambda s, d: V.value_summary(check_values(s, d)), None, "E15"),
    "value_regions": query(lambda s, d: V.region_summary(check_values(s, d)), None, "E16"),
    "ridge_sensitivity": query(lambda s, d: V.ridge_sensitivity(check_values(s, d)), None, "E16"),
}
