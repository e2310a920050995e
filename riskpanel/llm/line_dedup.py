"""Line dedup by winnowing: runs of lines that occurred before are deleted.

A window is the shortest run of consecutive lines, counted from some line on or back from it, that has at least
``min_words`` words (one long line may be a window). Of every window the rightmost line of least hash is selected,
once however many windows it serves, so a text keeps a few positions a window length. Two texts that share a run of so
many words share a window of it, hence a selected line: the winnowing guarantee.

Selected positions are joined on their line's hash; only those met elsewhere go on. From such a position the match is
extended both ways over the lines that its posting carries, as far as windows that contain it reach: windows that have
their selected line there are told apart by the hash of all their lines. A longer match has further selected positions,
whose windows overlap, so the union of equal windows is the longest match on either side, and the result is exact:

a line is deleted if and only if it lies in a run of consecutive lines with ``min_words`` words or more that also
starts earlier, by (document id, line), in the same or another document.

Lines are compared without the white space around them; lines without a word are not part of runs and stay.
Documents are ordered by id, null ids first. Nulls: a null text has no lines and stays null. Rows that repeat an
id and a text are one document and are treated alike. A document all of whose words are deleted is dropped by
``clean``. Empty tables and texts give no runs. Other columns pass through. Very long texts take time and memory in
proportion to their lines: a window has at most ``min_words`` lines, and deleted windows are merged before they are applied.

Everything is column expressions. Positions of one text are selected inside its row; what is shuffled is the postings, and
counts are combined before the shuffle, so a line that a third of all texts hold costs one row a task. Both joins
read a written table on one side, so adaptive execution can split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.llm.text import free_name, pinned
from riskpanel.session import materialise

MIN_WORDS = 50
_SPACE = "[ \t\x0b\f\r]"


def _window(words: Column, at: Column, step: int, least: int) -> Column:
    """Lines in the shortest run with ``least`` words from line ``at`` (1-based), forwards or backwards; 0 if there is none."""
    if step > 0:
        part = F.slice(words, at, F.lit(least))
    else:
        part = F.reverse(F.slice(words, F.greatest(F.lit(1), at - least + 1), F.least(at, F.lit(least))))
    end = F.aggregate(part, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")),
                      lambda a, w: F.when(a["n"] >= least, a).otherwise(F.struct((a["n"] + w).alias("n"), (a["k"] + 1).alias("k"))))
    return F.when(end["n"] >= least, end["k"]).otherwise(0)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\f\r"))


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text key) with the hashes and word counts of the lines that have words."""
    text = F.col(text_col)
    lines = F.filter(F.transform(F.split(text, "\n"), _bare), lambda x: x != "")
    told = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, f"{_SPACE}+")).alias("n")))
    df = pinned(docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")), lines=told)
    return pinned(df.where(F.size("lines") > 0), h=F.col("lines.h"), n=F.col("lines.n")).select("id", "key", "h", "n")


def _minimum(tagged: Column, first: Column, size: Column) -> Column:
    """The rightmost line (1-based) of least hash in a window, from (hash, minus line) structs."""
    return -F.array_min(F.slice(tagged, first, size))["back"]


def postings(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, key, at, fp) of every selected line, with the lines around it: number of the first, hashes and word counts."""
    every = F.sequence(F.lit(1), F.size("h"))
    df = pinned(rows, ahead=F.transform(every, lambda i: _window(F.col("n"), i, 1, min_words)),
                behind=F.transform(every, lambda i: _window(F.col("n"), i, -1, min_words)),
                tagged=F.transform("h", lambda x, i: F.struct(x.alias("h"), (-1 - i).alias("back"))))
    least = F.concat(F.transform("ahead", lambda size, i: F.when(size > 0, _minimum(F.col("tagged"), i + 1, size))),
                     F.transform("behind", lambda size, i: F.when(size > 0, _minimum(F.col("tagged"), i + 2 - size, size))))
    chosen = F.filter(F.array_distinct(least), lambda i: i.isNotNull())
    # lines further away than a window reaches are no part of a window with this line; where none reaches, the text's end does
    told = F.transform(chosen, lambda i: F.struct(i.alias("at"), F.greatest(F.lit(1), i - min_words + 1).alias("lo"), F.get(F.col("h"), i - 1).alias("fp")))
    told = F.transform(told, lambda p: F.struct(p["at"].alias("at"), p["lo"].alias("lo"), p["fp"].alias("fp"),
                                                F.slice("h", p["lo"], p["at"] - p["lo"] + min_words).alias("h"), F.slice("n", p["lo"], p["at"] - p["lo"] + min_words).alias("n")))
    met = df.select("id", "key", F.explode(told).alias("p")).select("id", "key", "p.*")
    mid = F.col("at") - F.col("lo") + 1
    met = pinned(met, left=_reach(F.reverse(F.slice("n", F.lit(1), mid - 1)), min_words), right=_reach(F.slice("n", mid + 1, F.lit(min_words)), min_words))
    span = F.col("left") + F.col("right") + 1
    return met.select("id", "key", "at", "fp", (F.col("at") - F.col("left")).alias("lo"),
                      F.slice("h", mid - F.col("left"), span).alias("h"), F.slice("n", mid - F.col("left"), span).alias("n"))


def _reach(words: Column, least: int) -> Column:
    """How many lines on one side of a selected line can share a window with it: those before which fewer than ``least`` words stand."""
    return F.aggregate(words, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")),
                       lambda a, w: F.when(a["n"] >= least, a).otherwise(F.struct((a["n"] + w).alias("n"), (a["k"] + 1).alias("k"))))["k"]


def extended(near: DataFrame, min_words: int) -> DataFrame:
    """(id, key, first line, lines, fingerprint, content) of the windows with their selected line at a posting."""
    mid = F.col("at") - F.col("lo") + 1
    df = pinned(near, tagged=F.transform("h", lambda x, i: F.struct(x.alias("h"), (-1 - i).alias("back"))),
                ahead=F.transform(F.sequence(F.lit(1), mid), lambda i: F.struct(i.alias("first"), _window(F.col("n"), i, 1, min_words).alias("size"))),
                behind=F.transform(F.sequence(mid, F.size("h")), lambda i: F.struct(i.alias("last"), _window(F.col("n"), i, -1, min_words).alias("size"))))
    back = F.transform("behind", lambda w: F.struct((w["last"] - w["size"] + 1).alias("first"), w["size"].alias("size")))
    back = F.filter(back, lambda w: ~F.coalesce(F.get(F.col("ahead"), w["first"] - 1)["size"] == w["size"], F.lit(False)))  # the same window forwards
    runs = F.filter(F.concat("ahead", back), lambda w: (w["size"] > 0) & (w["first"] <= mid) & (w["first"] + w["size"] > mid))
    runs = F.filter(runs, lambda w: _minimum(F.col("tagged"), w["first"], w["size"]) == mid)
    told = F.transform(runs, lambda w: F.struct((w["first"] + F.col("lo") - 1).alias("first"), w["size"].alias("size"),
                                                F.xxhash64(F.slice("h", w["first"], w["size"])).alias("content")))
    return df.select("id", "key", "fp", F.explode(told).alias("w")).select("id", "key", "fp", "w.*")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Windows that occurred before: id, key, first line, lines, and where the first one stands."""
    chosen = materialise(postings(line_rows(docs, id_col, text_col), min_words), "line-postings")
    stand = F.struct("id", "key", "at")
    common = chosen.groupBy("fp").agg(F.min(stand).alias("x"), F.max(stand).alias("y")).where("x <> y").select("fp")
    found = materialise(extended(chosen.join(common, "fp", "left_semi"), min_words), "line-windows")
    place = F.struct("id", "key", "first")
    first = found.groupBy("fp", "content", "size").agg(F.min(place).alias("origin"), F.max(place).alias("last")).where("origin <> last").drop("last")
    first = materialise(first, "line-origins")
    met = found.join(first, ["fp", "content", "size"]).where(place > F.col("origin"))
    return met.select("id", "key", "first", "size", "origin")


def merged(runs: DataFrame) -> DataFrame:
    """(id, key, spans): the runs of a text as disjoint (first line, lines)."""
    order = Window.partitionBy("id", "key").orderBy("first")
    reach = F.max(F.col("first") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    one = runs.groupBy("id", "key", "first").agg(F.max("size").alias("size"))  # the longest from each line
    cut = one.withColumn("new", F.when(reach >= F.col("first"), 0).otherwise(1)).withColumn("part", F.sum("new").over(order))
    parts = cut.groupBy("id", "key", "part").agg(F.min("first").alias("first"), F.max(F.col("first") + F.col("size")).alias("stop"))
    return parts.groupBy("id", "key").agg(F.collect_list(F.struct("first", (F.col("stop") - F.col("first")).alias("size"))).alias("spans"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, str]:
    """Documents with a struct of the cleaned text, its lines, the deleted ones and whether words are left; and its name."""
    runs = repeated_runs(docs, id_col, text_col, min_words)
    spans = merged(runs)
    text, name = F.col(f"`{text_col}`"), free_name(docs, "found")
    at, key, gone = (free_name(docs, x) for x in ("dedup_id", "dedup_key", "dedup_spans"))
    spans = spans.select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias(at), F.col("key").alias(key), F.col("spans").alias(gone))
    met = docs.withColumns({at: F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), key: F.xxhash64(text)}).join(spans, [at, key], "left")
    lines, numbers = (free_name(met, x) for x in ("dedup_lines", "dedup_numbers"))
    with_words = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.when(_bare(x) != "", i)), lambda i: i.isNotNull())
    met = pinned(met, **{lines: F.split(text, "\n"), numbers: F.coalesce(with_words, F.array().cast("array<int>"))})
    drop = free_name(met, "dedup_drop")
    met = pinned(met, **{drop: F.flatten(F.transform(F.col(gone), lambda s: F.slice(F.col(numbers), s["first"], s["size"])))})
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))  # by a hash set: long texts have many lines on both sides
    kept = F.transform(left, lambda i: F.get(F.col(lines), i))
    some = F.col(gone).isNotNull()
    told = F.struct(F.when(some, F.array_join(kept, "\n")).otherwise(text).alias("text"), F.size(numbers).alias("n_lines"),
                    F.when(some, F.size(drop)).otherwise(0).alias("n_removed"))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns], told.alias(name)), name


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: lines with words, deleted ones, and the text without them."""
    df, s = dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), min_words=min_words)
    return df.select("doc_id", F.col(s)["n_lines"].cast("long").alias("n_lines"), F.col(s)["n_removed"].cast("long").alias("n_removed"),
                     F.col(s)["text"].alias("text"), (F.col(s)["n_lines"] > 0).alias("had_words"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without repeated runs; those of which no word is left go. ``length_col`` follows the text."""
    df, s = dedup(docs, id_col, text_col, min_words)
    df = df.where(~((F.col(s)["n_removed"] > 0) & (F.col(s)["n_removed"] == F.col(s)["n_lines"])))
    changed = F.col(s)["n_removed"] > 0
    new = {text_col: F.col(s)["text"], length_col: F.when(changed, F.char_length(F.col(s)["text"]).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`"))
           if length_col in docs.columns else None}
    return df.select(*[(new[c].alias(c) if new.get(c) is not None else F.col(f"`{c}`")) for c in docs.columns])


SQL = r"""
WITH raw AS (
  SELECT row_number() OVER () AS r, doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT r, doc_id, text, pos, regexp_replace(line, '^[ \t\x0b\x0c\r]+|[ \t\x0b\x0c\r]+$', '', 'g') AS line, line AS original FROM raw),
full_lines AS (
  SELECT r, doc_id, text, pos, line, len(string_split_regex(line, '[ \t\x0b\x0c\r]+')) AS n,
         row_number() OVER (PARTITION BY r ORDER BY pos) AS i FROM lines WHERE line <> ''),
run AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY i) AS upto FROM full_lines),
ends AS (
  SELECT a.r, a.i AS first, min(b.i) AS last FROM run a JOIN run b ON a.r = b.r AND b.i BETWEEN a.i AND a.i + 50 AND b.upto - a.upto + a.n >= 50 GROUP BY ALL
  UNION
  SELECT a.r, max(b.i) AS first, a.i AS last FROM run a JOIN run b ON a.r = b.r AND b.i BETWEEN a.i - 50 AND a.i AND a.upto - b.upto + b.n >= 50 GROUP BY a.r, a.i),
wins AS (
  SELECT e.r, e.first, e.last, any_value(doc_id) AS doc_id, any_value(text) AS text, string_agg(line, chr(10) ORDER BY i) AS content
  FROM ends e JOIN run ON run.r = e.r AND run.i BETWEEN e.first AND e.last GROUP BY ALL),
ranked AS (SELECT *, min((doc_id, first)) OVER (PARTITION BY content) AS origin FROM wins),
gone AS (
  SELECT DISTINCT run.r, run.pos FROM ranked w JOIN run ON run.r = w.r AND run.i BETWEEN w.first AND w.last WHERE (w.doc_id, w.first) > w.origin)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text ELSE coalesce(kept, '') END AS text,
       coalesce(n_lines, 0) > 0 AS had_words
FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL) d
LEFT JOIN (
  SELECT l.r, count(*) FILTER (l.line <> '') AS n_lines, count(gone.pos) AS n_removed, string_agg(l.original, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL) AS kept
  FROM lines l LEFT JOIN gone ON gone.r = l.r AND gone.pos = l.pos GROUP BY l.r) k ON k.r = d.r
UNION ALL SELECT doc_id, 0, 0, NULL, false FROM documents WHERE text IS NULL
"""
