"""Quality rules with risk-controlled thresholds.

A rule rejects a text whose measure exceeds a cut-off. Each stratum (language) gets a rule set of its own. The labelled
good texts of a stratum are halved by a hash of their id: the first half proposes a nested sequence of rule sets, from
its own quantiles, all measures growing stricter together; a measure takes part from the step on where it
rejects some bad text of the first half. The second half certifies: sets are tried from the most lenient on, and the
first that fails ends the sequence (fixed-sequence testing). A set passes if the exact (Clopper-Pearson) upper bound of
the rate at which its rules together reject good texts of the second half is at most ``risk``, at level ``error``
shared among the strata (Bonferroni). So with probability 1 - error no stratum loses more than ``risk`` of its good
texts. Of the certified sets the one that rejects most bad texts of the first half is taken, of equal ones the most
lenient. A stratum in which no set is certified, or none rejects a bad text, has no rules, and ``has_rules`` says so
(with 4 strata, 90 good texts in the second half are enough if none of them is rejected).

Nulls: a null text has no words; a null language is a stratum of its own; labels with a null id or quality, or ids
whose labels disagree, are left out. Without labels no rule is on. Repeated rows get a row each, repeated
labels count once. Other columns are ignored.

Texts are measured in one pass, written as a few numbers a row; counts are combined before they are shuffled, and
only strata x measures x steps numbers reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.text import SPACED, add_struct, per_document, text_blocks, window_hashes, word_hashes, word_spans
from riskpanel.session import materialise

WINDOW, RISK, ERROR = 8, 0.05, 0.05
QUANTILES = (1.0, 0.999, 0.998, 0.995, 0.99)
MARGINS = (2.0, 1.5, 1.25)  # more lenient cut-offs: multiples of the largest good value
MAX_SENT = 20_000  # strata; a row has at most some 60 numbers
MEASURES = ("symbols", "repeats", "same_lines", "shouting", "narrow", "marks")
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capitals long, n_letters long, n_distinct long, n_marks long, n_lines long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!|"]] = True
_CAPITAL, _SMALL, _TAIL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = _SMALL[97:123] = _TAIL[0x80:0xC0] = True


def measure(cols: list[pa.Array]) -> dict[str, pa.Array]:
    parts: dict[str, list[np.ndarray]] = {f.split()[0]: [] for f in FIELDS.split(", ")}
    for lo, hi, data, offs in text_blocks(cols[0], lower=False):
        n = hi - lo
        first, last, doc = word_spans(data, offs, SPACED)
        keys = word_hashes(data, first, last)
        borders = per_document(doc, n)

        def total(flags: np.ndarray, offs=offs) -> np.ndarray:
            run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return run[offs[1:]] - run[offs[:-1]]

        def distinct(d: np.ndarray, h: np.ndarray, n=n) -> np.ndarray:
            order = np.lexsort((h, d))
            d, h = d[order], h[order]
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.zeros(0, bool)
            return np.bincount(d[new], minlength=n)

        inside = SPACED[data]
        parts["n_words"].append(np.diff(borders))
        parts["word_chars"].append(total(inside & ~_TAIL[data]))
        for name, table in (("n_symbols", _SYMBOL), ("n_capitals", _CAPITAL), ("n_marks", _MARK)):
            parts[name].append(total(table[data]))
        parts["n_letters"].append(total((_CAPITAL | _SMALL)[data] | (data >= 0xC0)))
        parts["n_distinct"].append(distinct(doc, keys))
        parts["n_repeat_words"].append(_repeated(keys, doc, n))
        ends = np.flatnonzero(np.concatenate([data == 10, [False]]))  # lines: between line ends and borders of texts
        start = np.unique(np.concatenate([offs[:-1], ends + 1]))
        start = start[start < len(data)]
        stop = np.append(start[1:], len(data))
        stop = np.where((stop > start) & (data[stop - 1] == 10), stop - 1, stop) if len(start) else stop
        words_upto = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
        full = words_upto[stop] > words_upto[start]
        start, stop = start[full], stop[full]
        of = np.searchsorted(offs, start, side="right") - 1
        lines = np.bincount(of, minlength=n)
        parts["n_lines"].append(lines)
        parts["n_dup_lines"].append(lines - distinct(of, word_hashes(data, start, stop)))
    return {k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in parts.items()}


def _repeated(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    if len(keys) < WINDOW:
        return np.zeros(n, np.int64)
    starts = np.flatnonzero(doc[: len(doc) - WINDOW + 1] == doc[WINDOW - 1 :])
    h = window_hashes(keys, starts, WINDOW)
    d = doc[starts]
    order = np.lexsort((h, d))
    same = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(keys) + 1, np.int64)
    np.add.at(cover, starts[twice], 1)
    np.add.at(cover, starts[twice] + WINDOW, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)


def measures() -> dict[str, Column]:
    """What the rules look at, as shares, from the counted columns."""

    def share(a: Column, b: str) -> Column:
        return F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0)

    return {
        "symbols": share(F.col("n_symbols"), "word_chars"),
        "repeats": share(F.col("n_repeat_words"), "n_words"),
        "same_lines": share(F.col("n_dup_lines"), "n_lines"),
        "shouting": share(F.col("n_capitals"), "n_letters"),
        "narrow": F.when(F.col("n_words") > 0, F.col("n_words") / F.col("n_distinct")).otherwise(0.0) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))),
        "marks": share(F.col("n_marks"), "n_words"),
    }


def upper_bound(failures: int, trials: int, level: float) -> float:
    """Exact binomial upper confidence bound of a rate: the p at which so few failures have probability ``level``."""
    if not trials or failures >= trials:
        return 1.0
    logs = [math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) for k in range(failures + 1)]
    low, high = failures / trials, 1.0
    for _ in range(60):
        p = (low + high) / 2
        below = sum(math.exp(c + k * math.log(p) + (trials - k) * math.log1p(-p)) for k, c in enumerate(logs)) if p < 1 else 0.0
        low, high = (p, high) if below > level else (low, p)
    return high


def _step(value: Column, cuts: Column) -> Column:
    """The first step (0-based) of a descending list of cut-offs that the value exceeds; as many as steps if none."""
    return F.size(F.filter(F.coalesce(cuts, F.array_repeat(F.lit(math.inf), len(MARGINS) + len(QUANTILES))), lambda c: c >= value))


def _sent(table: DataFrame, strata: int) -> DataFrame:
    """A table with a row a stratum, broadcast if there are few, so that rows of a frequent stratum stay where they are."""
    return F.broadcast(table) if strata <= MAX_SENT else table


def thresholds(labelled: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[tuple[str | None, str], float]:
    """Certified cut-offs from rows (stratum, good, half, and the measures); half 0 proposes, half 1 certifies."""
    steps = len(MARGINS) + len(QUANTILES)
    quantile = [F.percentile_approx(F.when(F.col("good") & (F.col("half") == 0), F.col(m)), list(QUANTILES), 100_000).alias(m) for m in MEASURES]
    cuts = {r["stratum"]: {m: [x * r[m][0] for x in MARGINS] + r[m] for m in MEASURES if r[m]} for r in labelled.groupBy("stratum").agg(*quantile).collect()}
    cuts = {s: c for s, c in cuts.items() if c}  # without good texts in half 0 nothing is proposed
    if not cuts:
        return {}
    table = labelled.sparkSession.createDataFrame(  # a row a stratum
        [(s, *[c.get(m) for m in MEASURES]) for s, c in cuts.items()], "proposed string, " + ", ".join(f"cuts_{m} array<double>" for m in MEASURES))
    rows = labelled.join(_sent(table, len(cuts)), F.col("stratum").eqNullSafe(F.col("proposed"))).select("stratum", "good", "half", *[_step(F.col(m), F.col(f"cuts_{m}")).alias(m) for m in MEASURES])
    begins = {r["stratum"]: {m: r[m] for m in MEASURES} for r in rows.where("not good and half = 0").groupBy("stratum").agg(*[F.min(m).alias(m) for m in MEASURES]).collect()}
    if not begins:
        return {}
    table = labelled.sparkSession.createDataFrame([(s, *[b[m] for m in MEASURES]) for s, b in begins.items()], "begun string, " + ", ".join(f"from_{m} int" for m in MEASURES))
    joint = F.least(*[F.greatest(F.col(m), F.col(f"from_{m}")) for m in MEASURES])
    met = rows.join(_sent(table, len(begins)), F.col("stratum").eqNullSafe(F.col("begun"))).groupBy("stratum", "good", "half", joint.alias("step")).count().collect()
    tally: dict[tuple, list[int]] = {}
    for r in met:
        tally.setdefault((r["stratum"], r["good"], r["half"]), [0] * (steps + 1))[r["step"]] += r["count"]
    out: dict[tuple[str | None, str], float] = {}
    for s, begun in begins.items():
        good, bad = tally.get((s, True, 1), [0] * (steps + 1)), tally[s, False, 0]
        best, chosen = 0, None
        for i in range(steps):
            if upper_bound(sum(good[: i + 1]), sum(good), error / len(cuts)) > risk:
                break
            if sum(bad[: i + 1]) > best:
                best, chosen = sum(bad[: i + 1]), i
        if chosen is not None:
            out |= {(s, m): c[chosen] for m, c in cuts[s].items() if begun[m] <= chosen}
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", quality_col: str = "quality", **levels) -> DataFrame:
    """One row a document: its counts, the base verdict, whether it is kept and the rules that reject it."""
    rows, s = add_struct(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text")),
                         [F.col("text")], measure, FIELDS, keep=["doc_id", "stratum"])
    counted = materialise(rows.select("doc_id", "stratum", f"{s}.*"), "quality-counts")
    told = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(
        F.min(quality_col).alias("low"), F.max(quality_col).alias("high")).where("low = high").select("label_id", (F.col("high") > 0).alias("good"))
    measured = counted.withColumns(measures())
    labelled = measured.join(told, F.col("doc_id") == F.col("label_id")).select("stratum", "good", (F.crc32(F.col("doc_id").cast("string")) % 2).alias("half"), *MEASURES)
    cutoffs = thresholds(materialise(labelled, "quality-labelled"), **levels)
    broken = [F.when(F.col("stratum").eqNullSafe(F.lit(st)) & (F.col(m) > cutoff), F.lit(m)) for (st, m), cutoff in sorted(cutoffs.items(), key=str)]
    rules = F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return measured.withColumn("rules", rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.size("rules") == 0)).alias("kept"), F.array_join("rules", ",").alias("rules"),
        _any_of(F.col("stratum"), {st for st, _ in cutoffs}).alias("has_rules"))


def _any_of(stratum: Column, strata: set[str | None]) -> Column:
    named = stratum.isin(sorted(s for s in strata if s is not None))
    return F.when(stratum.isNull(), F.lit(None in strata)).otherwise(named)
