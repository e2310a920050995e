"""Secret scans over a trigram inverted index.

Every rule's expression yields a Boolean trigram query. The index has a posting (trigram, document) for each trigram
that some rule asks for; postings of one alternative are intersected by counting them per document, and only the
documents so found are searched with the rule's expression. A rule without a mandatory trigram is tried on every
text. Spans are exact: leftmost non-overlapping matches, from the pieces between matches and the matches.

Offsets are code points, end exclusive. Nulls: a null text is empty; a null id is found by its text. Repeated rows
get a row each. An empty table gives no rows. Other columns are ignored. Very long texts take time in proportion to
their length and, up to a small share of copying inside blocks, to their matches.

Everything is column expressions. Postings are grouped by document, never by trigram, so a frequent trigram makes no
hot key; the texts are shuffled once, by document, unless the candidates are small enough for Spark to send around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.text import pinned
from riskpanel.llm.trigrams import alternatives, derive, trigrams

# Kind, expression, group whose length counts, its least length. The base kinds stand first.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("login", r"://[^\s/:@]{1,64}:[^\s/:@]{1,64}@", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("stripe", r"sk_live_[0-9a-zA-Z]{16,}", 0, 0),
]
BASE = ("assign", "access", "hex")
BLOCK = 256  # matches walked together; changes speed only


def postings(docs: DataFrame, key: Column, text: Column, wanted: list[str]) -> DataFrame:
    """The index over the trigrams that the rules ask for: (trigram, key), once a document."""
    low = pinned(docs.select(key.alias("key"), text.alias("text")), low=F.lower("text"))
    present = F.filter(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in wanted]), lambda x: x.isNotNull())
    return low.select("key", F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, key: Column, text: Column, rules=RULES) -> DataFrame:
    """(key, kinds): the rules that a document may match, from intersected postings."""
    asked = {kind: alternatives(derive(rx)) for kind, rx, _, _ in rules}
    wanted = sorted(set().union(*[x for sets in asked.values() for x in sets], frozenset()))
    if not wanted:
        return docs.select(key.alias("key"), F.array().cast("array<string>").alias("kinds")).where(F.lit(False))
    held = postings(docs, key, text, wanted).groupBy("key").agg(F.collect_set("trigram").alias("held"))  # at most the rules' trigrams
    fits = [F.when(_any(sets), F.lit(kind)) for kind, sets in asked.items() if sets]
    return held.select("key", F.filter(F.array(*fits), lambda x: x.isNotNull()).alias("kinds")).where(F.size("kinds") > 0)


def _any(sets: list[frozenset[str]]) -> Column:
    out = F.lit(False)
    for s in sets:
        out = out | (F.size(F.array_intersect(F.col("held"), F.array(*[F.lit(t) for t in sorted(s)]))) == len(s))
    return out


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside other lambdas and branches."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, kind: str, rank: int, rx: str, group: int, least: int) -> Column:
    """Array of (start, rank, end) of a rule's matches in a text.

    Pieces and matches are walked in blocks that start at the block's offset, so a text with very many matches does
    not copy all its spans for each of them.
    """
    found, rest = F.regexp_extract_all(text, F.lit(rx), F.lit(0)), F.split(text, rx, -1)
    sizes = F.transform(found, F.char_length)
    checked = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(group)), F.char_length) if group else sizes
    told = F.arrays_zip(F.transform(rest, F.char_length).alias("gap"), sizes.alias("size"), checked.alias("checked"))  # one more gap than matches
    kind_of = "array<struct<start:int,rank:int,end:int>>"

    def long(m: Column) -> Column:
        return m["gap"] + F.coalesce(m["size"], F.lit(0))

    def walk(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(kind_of).alias("spans")),
                           lambda a, m: F.struct((a["at"] + long(m)).alias("at"),
                                                 F.when(m["checked"] >= least, F.concat(a["spans"], F.array(F.struct(
                                                     (a["at"] + m["gap"]).alias("start"), F.lit(rank).alias("rank"), (a["at"] + m["gap"] + m["size"]).alias("end")))))
                                                 .otherwise(a["spans"]).alias("spans")))["spans"]

    def offsets(blocks: Column) -> Column:
        """Where each block starts; as many as blocks, and one more."""
        return F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + F.aggregate(b, F.lit(0), lambda n, m: n + long(m)))))

    def cut(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda i: F.slice(all_, i * BLOCK + 1, F.lit(BLOCK)))

    return _let(told, lambda t: _let(cut(t), lambda blocks: _let(
        offsets(blocks), lambda at: F.flatten(F.transform(blocks, lambda b, i: walk(b, F.get(at, i)))))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """doc_id and ``spans``: an array of (start, rank of the rule, end), in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.xxhash64(F.col(id_col)), F.xxhash64(text)) if docs.schema[id_col].nullable else F.xxhash64(F.col(id_col))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text)).otherwise(key)
    near = candidates(docs, key, text, rules).withColumnRenamed("key", "near")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), key.alias("key")).join(near, F.col("key") == F.col("near"), "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    found = []
    for rank, (kind, rx, group, least) in enumerate(rules):
        spans = _spans(F.col("text"), kind, rank, rx, group, least)
        test = F.array_contains("kinds", kind) if derive(rx) is not True else F.col("text").rlike(rx)
        found.append(F.when(test, spans).otherwise(none))
    return pinned(rows, spans=F.array_sort(F.concat(*found))).select("doc_id", "spans")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row a document: base counts, the digest of the base spans, and all spans."""
    kinds = F.array(*[F.lit(k) for k, *_ in rules])
    rank = [k for k, *_ in rules].index

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat(F.get(kinds, s["rank"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank(kind))).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return scan(docs, id_col, text_col, rules).select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in BASE], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def asked_trigrams(rules=RULES) -> dict[str, set[str]]:
    return {kind: trigrams(derive(rx)) for kind, rx, _, _ in rules}


def _sql() -> str:
    """The same spans in DuckDB: every rule on every text, without the index."""
    parts = []
    for rank, (kind, rx, group, least) in enumerate(RULES):
        q = rx.replace("'", "''")
        parts.append(f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least, text, regexp_extract_all(text, '{q}') AS found, "
                     f"regexp_extract_all(text, '{q}', {group}) AS checked, string_split_regex(text, '{q}') AS rest FROM docs WHERE regexp_matches(text, '{q}')")
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({' UNION ALL '.join(parts)}),
each AS (SELECT doc_id, rank, kind, least, found, checked, rest, unnest(range(1, len(found) + 1)) AS i FROM hits),
spans AS (
  SELECT doc_id, rank, kind, list_sum(list_transform(rest[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start,
         length(found[i]) AS size FROM each WHERE length(checked[i]) >= least),
told AS (SELECT *, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM spans),
sums AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
         string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM told GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN sums s USING (doc_id)
"""


SQL = _sql()
