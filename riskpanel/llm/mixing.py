"""Mixing sources to target weights by thresholds on hashes.

A source's target is its share, by weight, of all words; it stops at ``MOST`` times the source's size and the excess
goes to the others by weight, until none is above. A target is so many whole passes over the source and a rest,
the budget. Documents have a fixed 60-bit hash. Words are summed by source and the hash's first 12 bits; where the running
sum crosses the budget lies the boundary bucket, and only its documents are summed again by the next 12 bits, and so on
until the boundary is one hash. Documents below it are taken once more than the passes say, those above not, and the one at
the threshold gives as many of its words as the budget lacks. Nothing is sorted; a larger budget takes all that a
smaller one takes. Words are counted once, into a table without texts that every later step reads.

Sources are ordered by code point with the null source last, and their weights repeat in that order. A null text is empty.
Documents that agree in id and text share one hash: if the threshold falls on them, the budget's rest is shared in
proportion to their sizes, rounded down. A source without words has target 0. An empty table gives no rows. A source may hold
any share of the rows: sums are formed in the tasks first, and the budget of a large source is broadcast (``hot``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.llm.hot import join_by_key
from riskpanel.session import materialise

WEIGHTS, MOST = (1, 2, 3), 3
BITS, STEP = 60, 12


def n_words(text: str) -> F.Column:
    """Runs of characters other than ASCII white space; null has none."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "a")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def place(key: str, text: str) -> F.Column:
    """The document's hash: the first 60 bits of an MD5."""
    name = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``rank`` of every source from 0, counted per range of sources first, so no task sees all of them."""
    ranges = materialise(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges")
    ahead = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    ahead = ahead.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("inside", inside).join(F.broadcast(ahead), "part").select("source", "source_size", "n", (F.col("inside") + F.col("ahead")).alias("rank"))


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """The sources (source, source_size, n) with their ``target``: shares by weight, levelled off at ``most`` times the size."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    s = materialise(ranked(sources).withColumn("weight", weight), "mix-sources")
    whole = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    full, left, spread, count = F.lit(False), whole, None, -1
    while True:
        got = s.agg(*[F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("w"), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("c"),
                      F.count_if(full).alias("k")]).first()
        left, spread = whole - most * got["c"], got["w"]
        if got["k"] == count or not spread:
            break
        # w * left / spread > most * size, in whole numbers; a source that is full stays full, as the level only rises
        count, full = got["k"], (F.col("weight").cast("decimal(19,0)") * left) > (F.col("source_size").cast("decimal(19,0)") * most * spread)
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(max(spread, 1))
    return s.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(share)).drop("rank", "weight")


def thresholds(docs: DataFrame, budgets: DataFrame, total: int) -> DataFrame:
    """Per source with a budget: the hash ``edge`` at which the running sum of words crosses it, the words still lacking there, and the words it holds.

    ``docs`` has source, h, size and is a written table; ``budgets`` has source, budget, n.
    """
    open_, inside = budgets, docs
    for shift in range(BITS - STEP, -1, -STEP):
        prefix = F.shiftright("h", shift)
        cells = materialise(inside.groupBy("source", prefix.alias("cell")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("cell_n"), F.min("h").alias("lo"), F.max("h").alias("hi")), "mix-cells")
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("cell"))  # at most 2**STEP cells a source
        found = join_by_key(cells, open_.select("source", "budget", "n", F.col("n").alias("source_n")), ["source"], "n", total).withColumn("upto", upto)
        cross = found.where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("size") <= F.col("budget")) & (F.col("size") > 0))
        open_ = materialise(cross.select("source", "cell", (F.col("budget") - F.col("upto") + F.col("size")).alias("budget"), F.col("size").alias("held"),
                                         "source_n", "cell_n", "lo", "hi"), "mix-edges")
        if open_.where("lo < hi").isEmpty():
            break
        sized = join_by_key(inside, open_.select("source", "cell", "source_n"), ["source"], "source_n", total)
        inside = materialise(sized.where(prefix == F.col("cell")).select("source", "h", "size"), "mix-boundary")
        open_, total = open_.select("source", "budget", F.col("cell_n").alias("n")), inside.count()
    return open_.select("source", F.col("lo").alias("edge"), F.col("budget").alias("lack"), "held")


def mix(df: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(``key``, source, size, source_size, target, h, copies, taken): whole copies of a document and all words the mix takes of it."""
    sized = materialise(df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(text).alias("size"), place(key, text).alias("h")), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, most)
    words = F.round("target").cast("long")
    size = F.greatest("source_size", F.lit(1))
    plan = materialise(sources.withColumn("passes", F.floor(words / size)).withColumn("budget", words - F.col("passes") * F.col("source_size")), "mix-plan")
    total = sized.count()
    edge = thresholds(sized.select("source", "h", "size"), plan.where("budget > 0").select("source", "budget", "n"), total)
    same = F.col("source").eqNullSafe(F.col("_source"))
    plan = materialise(plan.join(edge.withColumnRenamed("source", "_source"), same, "left").drop("_source"), "mix-plan")
    rest = F.when(F.col("budget") == 0, 0).when(F.col("h") < F.col("edge"), F.col("size")).when(
        F.col("h") == F.col("edge"), F.expr("cast(lack as decimal(19,0)) * size div held")).otherwise(0)
    return join_by_key(sized, plan, ["source"], "n", total).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "h", "passes",
        (F.col("passes") * F.col("size") + rest).cast("long").alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same with running sums in hash order instead of nested buckets.
SQL = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM d GROUP BY source),
lv AS (SELECT 0 AS i, (SELECT sum(source_size) FROM s) AS num, (SELECT sum(w) FROM s) AS den
    UNION ALL SELECT i + 1, (SELECT sum(source_size) FROM s) - coalesce((SELECT sum({MOST} * source_size) FROM s WHERE w * num > {MOST} * source_size * den), 0),
        (SELECT sum(w) FROM s WHERE w * num <= {MOST} * source_size * den) FROM lv WHERE i < 40),
tg AS MATERIALIZED (SELECT source, source_size, CASE WHEN w * num > {MOST} * source_size * den THEN ({MOST} * source_size)::DOUBLE ELSE (w * num)::DOUBLE / den::DOUBLE END AS target
    FROM s, (SELECT arg_max(num, i) AS num, arg_max(den, i) AS den FROM lv)),
pl AS (SELECT *, round(target)::BIGINT // greatest(source_size, 1) AS passes, round(target)::BIGINT - round(target)::BIGINT // greatest(source_size, 1) * source_size AS budget FROM tg),
g AS (SELECT source, h, sum(size)::BIGINT AS held FROM d GROUP BY ALL),
r AS (SELECT *, (sum(held) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM g)
SELECT doc_id, size, source_size, target, passes * size + CASE WHEN upto <= budget THEN size WHEN upto - held < budget THEN ((budget - upto + held)::HUGEINT * size // held)::BIGINT ELSE 0 END AS taken
FROM d JOIN pl ON d.source IS NOT DISTINCT FROM pl.source JOIN r ON r.source IS NOT DISTINCT FROM d.source AND r.h = d.h"""
