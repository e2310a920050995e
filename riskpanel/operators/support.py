"""Outcome-blind support screen of candidate cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, reasons
from ..params import SupportRule
from .panel import SUPPORT_COLUMNS

# Named rule profiles.
LENIENT = SupportRule(30, 2.0, 4, 3, 3, 0.75, 0.60)
PRIMARY = SupportRule(40, 3.0, 6, 5, 4, 0.60, 0.45)
STRICT = SupportRule(60, 5.0, 8, 7, 6, 0.50, 0.35)
NO_SUPPORT = SupportRule(0, 0.0, 0, 0, 0, 1.0, 1.0)
PROFILES = {"lenient": LENIENT, "primary": PRIMARY, "strict": STRICT, "none": NO_SUPPORT}


def _check(view: DataFrame, cuts: Sequence[int], start: int, end: int, by: Sequence[str]) -> list[int]:
    if sorted(view.columns) != sorted([*SUPPORT_COLUMNS, *by]):
        raise TypeError("the support screen accepts (entity_id, elapsed_index, action) only")
    if end <= start:
        raise ValueError("analysis window must be positive")
    ordered = sorted({int(c) for c in cuts})
    outside = [c for c in ordered if not start < c < end]
    if outside:
        raise ValueError(f"candidates outside the open analysis interval: {outside}")
    return ordered


def side_counts(view: DataFrame, cuts: Sequence[int], start: int, end: int, by: Sequence[str] = ()) -> DataFrame:
    """Per entity, arrays over the ordered cuts: rows (n) and action-1 rows (a) on the left and right.

    The panel is aggregated once to (entity, interval between cuts); sides are sums over the few
    intervals, so the cost does not multiply with the number of cuts.
    """
    ordered = _check(view, cuts, start, end, by)
    idx = F.col("elapsed_index")
    slot = sum(((idx >= c).cast("int") for c in ordered), F.lit(0))
    cells = view.where((idx >= start) & (idx < end)).groupBy(*by, "entity_id", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("action").cast("long").alias("a"))

    def upto(c: str, j: int, left: bool) -> Column:
        side = F.col("slot") <= j if left else F.col("slot") > j
        return F.sum(F.when(side, F.col(c)).otherwise(0))

    m = range(len(ordered))
    wide = cells.groupBy(*by, "entity_id").agg(
        *[upto(c, j, left).alias(f"{c}{'l' if left else 'r'}{j}") for c in ("n", "a") for left in (True, False) for j in m])
    return wide.select(*by, "entity_id", *[
        F.array(*[F.col(f"{c}{s}{j}") for j in m]).alias(f"{c}_{n}") for c in ("n", "a") for s, n in (("l", "left"), ("r", "right"))])


def entity_sides(view: DataFrame, cuts: Sequence[int], start: int, end: int, by: Sequence[str] = ()) -> DataFrame:
    """The same counts, one row per (entity, candidate)."""
    ordered = sorted({int(c) for c in cuts})
    names = ["n_left", "n_right", "a_left", "a_right"]
    zipped = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in ordered]).alias("candidate"), *names))
    return side_counts(view, cuts, start, end, by).select(*by, "entity_id", zipped.alias("s")).select(
        *by, "entity_id", "s.candidate", *[f"s.{n}" for n in names])


def screen(view: DataFrame, cuts: Sequence[int], start: int, end: int, rule: SupportRule, state_dim: int) -> DataFrame:
    """One row per candidate: counts, shares, effective sizes of both sides, ordered reasons, admissibility."""
    return screen_sides(entity_sides(view, cuts, start, end), rule, state_dim, ["candidate"])


def screen_sides(sides: DataFrame, rule: SupportRule, state_dim: int, keys: Sequence[str]) -> DataFrame:
    required = rule.required(state_dim + 1)
    aggs = [F.count_if((F.col("n_left") > 0) & (F.col("n_right") > 0)).alias("entities_both")]
    for s in ("left", "right"):
        n, a = F.col(f"n_{s}"), F.col(f"a_{s}")
        for tag, x in (("transitions", n), ("A0", n - a), ("A1", a)):
            aggs += [F.sum(x).alias(f"{s}_{tag}"), F.max(x).alias(f"_{s}_{tag}_max"),
                     F.sum((x * x).cast("double")).alias(f"_{s}_{tag}_sq"), F.count_if(x > 0).alias(f"{s}_{tag}_entities")]
    g = sides.groupBy(*keys).agg(*aggs)
    cols, found = [F.col(k) for k in keys], []
    for s in ("left", "right"):
        for tag in ("transitions", "A0", "A1"):
            total = F.col(f"{s}_{tag}")
            cols += [total, F.col(f"{s}_{tag}_entities"),
                     F.coalesce(ratio(F.col(f"_{s}_{tag}_max"), total), F.lit(0.0)).alias(f"{s}_{tag}_max_share"),
                     F.coalesce(ratio(total.cast("double") * total, F.col(f"_{s}_{tag}_sq")), F.lit(0.0)).alias(f"{s}_{tag}_ess")]
        found.append((F.col(f"{s}_transitions_entities") < rule.min_active_each_side, f"{s}:active_entities"))
        for k in (0, 1):
            found.append((F.col(f"{s}_A{k}") < required, f"{s}:action{k}_count"))
            found.append((F.col(f"{s}_A{k}_entities") < rule.min_unique_each_side_action, f"{s}:action{k}_unique_entities"))
        found.append((F.col(f"{s}_A1_max_share") > rule.max_action1_share, f"{s}:action1_dominance"))
        found.append((F.col(f"{s}_transitions_max_share") > rule.max_total_share, f"{s}:total_dominance"))
    found.append((F.col("entities_both") < rule.min_both_sides, "entities_on_both_sides"))
    out = g.select(*cols, "entities_both", F.lit(required).alias("required_count"))
    return out.withColumn("reasons", reasons(found)).withColumn("admissible", F.size("reasons") == 0)


def admissible_status(screened: DataFrame) -> DataFrame:
    """TESTABLE when at least one cut is admissible, otherwise NOT_TESTABLE_SUPPORT (never a p-value)."""
    return screened.agg(F.count(F.lit(1)).alias("candidates"), F.count_if("admissible").alias("admissible")).withColumn(
        "status", F.when(F.col("admissible") > 0, "TESTABLE").otherwise("NOT_TESTABLE_SUPPORT"))


def screen_diagnostics(screened: DataFrame) -> DataFrame:
    return screened.agg(
        F.count(F.lit(1)).alias("raw_candidates"), F.count_if("admissible").alias("admissible_candidates"),
        F.max(F.greatest("left_transitions_max_share", "right_transitions_max_share")).alias("maximum_total_share"),
        F.max(F.greatest("left_A1_max_share", "right_A1_max_share")).alias("maximum_action1_share"),
        F.avg((F.col("left_transitions_entities") + F.col("right_transitions_entities")) / 2.0).alias("mean_active_entities"),
        F.min(F.least("left_A1", "right_A1")).alias("minimum_side_action1"))


def reason_counts(screened: DataFrame) -> DataFrame:
    return screened.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def lost_candidates(screened: DataFrame, fixed: Sequence[int]) -> DataFrame:
    """Side rows of the cuts of a fixed set that this screen did not admit."""
    want = screened.where(F.col("candidate").isin([int(c) for c in fixed]))
    lost = want.join(screened.where("admissible").select("candidate"), "candidate", "left_anti")
    side = F.explode(F.array(*[F.struct(
        F.lit(s).alias("side"), F.col(f"{s}_transitions_entities").alias("active_entities"), F.col(f"{s}_A0").alias("A0"),
        F.col(f"{s}_A1").alias("A1"), F.col(f"{s}_A0_entities").alias("A0_entities"), F.col(f"{s}_A1_entities").alias("A1_entities"),
        F.col(f"{s}_A1_max_share").alias("max_A1_share"), F.col(f"{s}_transitions_max_share").alias("max_total_share"),
        F.col(f"{s}_A1_ess").alias("A1_ess")) for s in ("left", "right")]))
    return lost.select("candidate", F.array_join("reasons", "|").alias("reasons"), side.alias("s")).select("candidate", "s.*", "reasons")
