"""Event XML: one document per entity, typed child streams, parsed to one long event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite_or_null

# Stream tags, their attributes and the timestamp format of the files.
TIME_FORMAT = "dd-MM-yyyy HH:mm:ss"
STREAMS = {
    "glucose_level": ("observation", ("ts", "value")),
    "bolus": ("action", ("ts_begin", "ts_end", "dose", "type", "bwz_carb_input")),
    "meal": ("exposure", ("ts", "carbs", "type")),
    "basal": ("schedule", ("ts", "value")),
    "temp_basal": ("override", ("ts_begin", "ts_end", "value")),
}
POINT_CONTEXT = {"finger_stick": "finger_stick", "hypo_event": "hypo_event", "exercise": "exercise", "stressors": "stressor"}
INTERVAL_CONTEXT = ("work", "illness", "sleep")


CORRUPT = "_corrupt"


def _schema(row_tag_id: str) -> T.StructType:
    def events(attrs) -> T.StructType:
        one = T.StructType([T.StructField(f"_{a}", T.StringType()) for a in attrs])
        return T.StructType([T.StructField("event", T.ArrayType(one))])
    fields = [T.StructField(row_tag_id, T.StringType()), T.StructField(CORRUPT, T.StringType())]
    fields += [T.StructField(tag, events(attrs)) for tag, (_, attrs) in STREAMS.items()]
    fields += [T.StructField(tag, events(("ts",))) for tag in POINT_CONTEXT]
    fields += [T.StructField(tag, events(("ts_begin", "ts_end"))) for tag in INTERVAL_CONTEXT]
    return T.StructType(fields)


def _time(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(TIME_FORMAT)).cast("timestamp_ntz")


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents under ``path``, tagged with the split named in each file's or folder's name; ``_corrupt`` holds what does not parse."""
    raw = spark.read.format("xml").option("rowTag", "patient").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(_schema("_id")).load(path)
    return raw.withColumn("split", split_of(F.col("_metadata.file_path"))).withColumn("entity_id", F.coalesce("_id", F.lit("unknown")))


def split_of(file_path: Column) -> Column:
    return F.when(file_path.rlike("(?i)-testing\\.xml(/|$)"), "testing").when(file_path.rlike("(?i)-training\\.xml(/|$)"), "training").otherwise("unknown")


def corrupt_documents(spark: SparkSession, path: str) -> DataFrame:
    """(split, entity_id, document) of documents that do not parse; ``read_events`` takes nothing from them."""
    return scan_documents(spark, path).where(F.col(CORRUPT).isNotNull()).select("split", "entity_id", F.col(CORRUPT).alias("document"))


def _entry(i: Column, stream: str, begin: Column, end: Column, number: Column | None, kind: Column, phase: str = "point", extra: Column | None = None,
           open_end: bool = True) -> Column:
    """One event of any stream as text fields; an end left blank is the begin, where that is allowed."""
    none = F.lit(None).cast("string")
    blank = end.isNull() | (end == "")
    return F.struct(F.lit(stream).alias("stream"), i.cast("long").alias("ordinal"), begin.alias("begin"),
                    F.when(~blank, end).otherwise(begin if open_end else none).alias("end"), (none if number is None else number).alias("number"),
                    F.lit(number is not None).alias("needs_number"), kind.cast("string").alias("kind"), F.lit(phase).alias("phase"), (none if extra is None else extra).alias("extra"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All streams as rows ``(entity_id, split, stream, ordinal, ts_begin, ts_end, value, kind, phase, extra)``, from one scan.

    Rows whose required attributes are missing or do not parse are dropped; an end time defaults to
    the begin time; interval context becomes one begin and one end row. Documents that do not parse give no rows.
    """
    none = F.lit(None).cast("string")

    def stream(tag: str, name: str, attrs) -> Column:
        def one(e: Column, i: Column) -> Column:
            begin = e["_ts_begin"] if "ts_begin" in attrs else e["_ts"]
            kind = F.coalesce(e["_type"], F.lit("normal" if tag == "bolus" else "")) if "type" in attrs else none
            return _entry(i, name, begin, e["_ts_end"] if "ts_end" in attrs else begin, e[{"bolus": "_dose", "meal": "_carbs"}.get(tag, "_value")], kind,
                          extra=e["_bwz_carb_input"] if tag == "bolus" else None, open_end=tag != "temp_basal")
        return F.transform(F.col(f"{tag}.event"), one)

    def context(tag: str, attr: str, kind: str, phase: str) -> Column:
        return F.transform(F.col(f"{tag}.event"), lambda e, i: _entry(i, "context", e[attr], e[attr], None, F.lit(kind), phase))

    lists = [stream(tag, name, attrs) for tag, (name, attrs) in STREAMS.items()]
    lists += [context(tag, "_ts", kind, "point") for tag, kind in POINT_CONTEXT.items()]
    lists += [context(tag, f"_ts_{phase}", tag, phase) for tag in INTERVAL_CONTEXT for phase in ("begin", "end")]
    docs = scan_documents(spark, path).where(F.col(CORRUPT).isNull())
    rows = docs.select("entity_id", "split", F.inline(F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))))
    out = rows.select("entity_id", "split", "stream", "ordinal", _time(F.col("begin")).alias("ts_begin"), _time(F.col("end")).alias("ts_end"),
                      F.col("number").try_cast("double").alias("value"), "kind", "phase", finite_or_null(F.col("extra")).alias("extra"), "needs_number")
    return out.where(F.col("ts_begin").isNotNull() & F.col("ts_end").isNotNull() & (F.col("value").isNotNull() | ~F.col("needs_number"))).drop("needs_number")


def merge_splits(training: DataFrame, testing: DataFrame) -> DataFrame:
    """One continuous event history per entity; later documents sort after earlier ones."""
    shift = F.lit(1_000_000_000_000).cast("long")
    return training.unionByName(testing.withColumn("ordinal", F.col("ordinal") + shift)).withColumn("split", F.lit("merged"))


def interval_rows(df: DataFrame, begin: str = "ts_begin", end: str = "ts_end") -> DataFrame:
    """Interval records as one begin and one end row each (missing ends are left out)."""
    keep = [c for c in df.columns if c not in (begin, end)]
    both = F.explode(F.array(F.struct(F.col(begin).alias("ts"), F.lit("begin").alias("phase")), F.struct(F.col(end).alias("ts"), F.lit("end").alias("phase"))))
    return df.select(*keep, both.alias("p")).select(*keep, "p.ts", "p.phase").where(F.col("ts").isNotNull())
