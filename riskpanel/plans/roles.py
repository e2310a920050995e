"""How the shared tables play the roles of an event history (entity, observation, action, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import FeatureProtocol, GapBin, GapProtocol, RewardRule, ToleranceRule

CHUNK_MIN = 7200.0

GAPS = GapProtocol(
    nominal_min=720.0, valid_min=(60.0, 1440.0), genuine_gap_min=1800.0, one_missing_max=2160.0,
    two_missing_max=2880.0,
    bins=(GapBin("<1h", None, 60.0, upper_inclusive=False), GapBin("1-6h", 60.0, 360.0, lower_inclusive=True),
          GapBin("6-12h", 360.0, 720.0), GapBin("12-24h", 720.0, 1440.0), GapBin("24-48h", 1440.0, 2880.0),
          GapBin("48-1000h", 2880.0, 60000.0), GapBin(">1000h", 60000.0, None)),
    rules=(ToleranceRule("1-24h", 60.0, 1440.0), ToleranceRule("0-24h", 0.0, 1440.0),
           ToleranceRule("1-36h", 60.0, 2160.0), ToleranceRule("0-36h", 0.0, 2160.0)),
    lattice_step_min=360.0, lattice_tolerance_min=180.0, lattice_genuine_gap_min=1440.0, chunk_min=CHUNK_MIN)

FEATURES_RULE = FeatureProtocol(
    interval_min=360.0, max_gap_min=1440.0, slope_min=(2880.0, 5760.0), stats_min=(2880.0, 10080.0),
    delivery_min=(1440.0, 5760.0), residual_horizon_min=7200.0, exposure_min=(1440.0, 5760.0),
    since_cap_min=7200.0, gap_cap_min=2880.0, rate_mean_min=1440.0, rate_step_min=240.0, expected_short=7,
    chunk_min=CHUNK_MIN,
    scaling={**FeatureProtocol().scaling, "previous_gap": (360.0, 360.0), "since_action": (0.0, 7200.0), "since_exposure": (0.0, 7200.0),
             "delivered_short": (0.0, 50.0), "delivered_long": (0.0, 100.0), "residual_exposure": (0.0, 100.0),
             "rate_current": (0.0, 50.0), "rate_mean": (0.0, 50.0)})

REWARD = RewardRule(low=20.0, high=70.0, steps=((10.0, False, -4.0), (20.0, False, -2.0), (70.0, True, 1.0),
                                                (100.0, True, -1.0)), above=-2.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity_id"),
        F.when(F.col("user_id") % 5 == 0, "testing").otherwise("training").alias("split"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("ordinal"), "event_type", "value")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).where("event_type <> 'purchase'").select("entity_id", "split", "ts", "ordinal", "value")


def doubled_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations plus a later correction at the same timestamp for every seventh one."""
    obs = observations(spark, sf_dir)
    late = obs.where("ordinal % 7 = 0").select(
        "entity_id", "split", "ts", (F.col("ordinal") + 1_000_000_000_000).alias("ordinal"),
        (F.col("value") + 1).alias("value"))
    return obs.unionByName(late)


def _stream(spark: SparkSession, sf_dir: str, event_type: str, amount: str) -> DataFrame:
    return _base(spark, sf_dir).where(F.col("event_type") == event_type).select(
        "entity_id", "split", "ts", "ordinal", F.col("value").alias(amount))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases: dose = value; every second one is delivered over ``value`` * 20 minutes."""
    base = _stream(spark, sf_dir, "purchase", "dose")
    length = F.when(F.col("ordinal") % 2 == 0, F.floor(F.col("dose") * 20)).otherwise(0).cast("int")
    return base.withColumn("ts_end", F.col("ts") + F.make_dt_interval(mins=length)).withColumn(
        "kind", F.when(F.col("ordinal") % 2 == 0, "extended").otherwise("normal"))


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "click", "amount")


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "signup", "rate")


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third error event overrides the scheduled rate for 36 hours."""
    base = _stream(spark, sf_dir, "error", "rate").where("ordinal % 3 = 0")
    return base.select("entity_id", "split", "ordinal", "rate", F.col("ts").alias("ts_begin"),
                       (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("ts_end"))


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point context events with a kind cycling over the seven context categories."""
    # Context kinds.
    kinds = ["finger_stick", "hypo_event", "exercise", "stressor", "work", "illness", "sleep"]
    base = _stream(spark, sf_dir, "error", "amount")
    return base.withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("ordinal") % 7 + 1).cast("int")))


def long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single long event table over all streams."""
    stream = F.when(F.col("event_type") == "view", "observation").when(
        F.col("event_type") == "purchase", "action").when(F.col("event_type") == "click", "exposure").when(
        F.col("event_type") == "signup", "schedule").otherwise("context")
    return _base(spark, sf_dir).select(
        "entity_id", "split", stream.alias("stream"), "ordinal", F.col("ts").alias("ts_begin"),
        F.col("ts").alias("ts_end"), "value", F.lit(None).cast("string").alias("kind"), F.lit("point").alias("phase"))


# ---------------------------------------------------------------------- daily panel
CUTS = (6, 9, 12, 15, 18, 21, 24)
WINDOW = (0, 29)
STATE_DIM = 3


def daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangle entity x day with state, next state, action, reward; ``observed`` needs both days."""
    base = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("t"),
        "event_type", "value")
    day = base.groupBy("entity_id", "t").agg(
        F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), F.max("value").alias("x"),
        F.max((F.col("event_type") == "purchase").cast("int")).alias("action"))
    state = F.array(F.round(F.col("m") / 50.0 + 1e-9, 6), F.col("n") / 4.0, F.round(F.col("x") / 100.0 + 1e-9, 6))
    inside = F.col("entity_id").isNotNull() & F.col("t").between(*WINDOW)
    one = F.struct("action", state.alias("state"), F.col("m").between(20.0, 70.0).cast("double").alias("reward"))
    entry = F.when(inside, F.struct("t", one.alias("day")))
    own = day.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(entry)).alias("days"))  # bounded by the window

    def cell(t: Column) -> Column:
        here, after = F.try_element_at("days", t), F.try_element_at("days", t + 1)
        return F.struct(t.alias("t"), here["action"].alias("action"), here["state"].alias("state"), after["state"].alias("next_state"), after["reward"].alias("reward"))

    grid = F.sequence(F.lit(0).cast("long"), F.lit(WINDOW[1] - 1).cast("long"))
    out = own.select("entity_id", F.explode(F.transform(grid, cell)).alias("c")).select("entity_id", "c.*")
    return out.withColumn("observed", F.col("state").isNotNull() & F.col("next_state").isNotNull())
