"""Benchmark decontamination: word windows of test items looked up along every training text.

A window is ``size`` consecutive words of an item; an item with fewer words is one window by itself.
The distinct windows form a hash set that is broadcast. Its size is counted first; a set beyond
``block_windows`` is cut into blocks of that size by hash, and the texts are scanned once a block, so what is
broadcast stays bounded and no training window is shuffled. A hash hit counts only when its words are equal.

Nulls: a null text has no words, a null item text no windows, a null item id is left out. Empty tables give
no hits. Repeated documents are judged one by one; repeated items count once. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.text import ALNUM, add_struct, per_document, text_blocks, window_hashes, word_hashes, word_spans

WINDOW = 13
BLOCK_WINDOWS = 500_000
FIELDS = "n_words long, spans array<long>, items array<string>"


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct (item, words, length, hash) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out: dict[str, list] = {"item": [], "words": [], "length": [], "hash": []}
            for lo, _, data, offs in text_blocks(b.column(1)):
                first, last, doc = word_spans(data, offs, ALNUM)
                hashes = word_hashes(data, first, last)
                borders = per_document(doc, len(offs) - 1)
                for d in range(len(offs) - 1):
                    x, y = int(borders[d]), int(borders[d + 1])
                    if x == y:
                        continue
                    k = min(size, y - x)
                    starts = np.arange(x, y - k + 1)
                    for s, h in zip(starts.tolist(), window_hashes(hashes, starts, k).tolist(), strict=True):
                        out["item"].append(ids[lo + d])
                        out["words"].append(_words(data, first, last, s, k))
                        out["length"].append(k)
                        out["hash"].append(h - (1 << 64) if h >> 63 else h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["item"], pa.string()), pa.array(out["words"], pa.binary()), pa.array(out["length"], pa.int32()), pa.array(out["hash"], pa.int64())],
                names=list(out),
            )

    given = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col))
    return given.mapInArrow(run, "item string, words binary, length int, hash long").distinct()


def _words(data: np.ndarray, first: np.ndarray, last: np.ndarray, s: int, k: int) -> bytes:
    return b" ".join(data[first[i] : last[i]].tobytes() for i in range(s, s + k))


class WindowSet:
    """One block of windows: per length a table of sorted hashes, with the items behind every text of words."""

    def __init__(self, rows: list[tuple[str, bytes, int, int]]):
        self.items: dict[bytes, list[str]] = {}
        by_length: dict[int, set[int]] = {}
        for item, words, length, h in rows:
            self.items.setdefault(bytes(words), []).append(item)
            by_length.setdefault(length, set()).add(h & ((1 << 64) - 1))
        self.hashes = {k: np.sort(np.array(list(v), dtype=np.uint64)) for k, v in by_length.items()}
        self.marks = {k: np.bincount((v >> np.uint64(44)).astype(np.int64), minlength=1 << 20).astype(bool) for k, v in self.hashes.items()}

    def hits(self, data, first, last, doc, words) -> Iterator[tuple[int, int, int, list[str]]]:
        """(document, first word, length, items) of every window that occurs."""
        for k, known in self.hashes.items():
            if len(words) < k:
                continue
            starts = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
            h = window_hashes(words, starts, k)
            near = np.flatnonzero(self.marks[k][(h >> np.uint64(44)).astype(np.int64)])
            at = np.searchsorted(known, h[near])
            near = near[known[np.minimum(at, len(known) - 1)] == h[near]]
            for s in starts[near].tolist():
                if items := self.items.get(_words(data, first, last, s, k)):
                    yield int(doc[s]), s, k, items


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         size: int = WINDOW, block_windows: int = BLOCK_WINDOWS, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Documents with a struct of n_words, hit word ranges (merged, flat start, end) and items; and its name."""
    spark = docs.sparkSession
    windows = item_windows(benchmark, item_col, item_text_col, size).persist()
    blocks = max(1, -(-windows.count() // block_windows))
    keep = list(docs.columns) if keep is None else keep
    found, name = docs, ""
    for b in range(blocks):
        rows = [tuple(r) for r in windows.where(F.pmod("hash", F.lit(blocks)) == b).collect()]  # at most about block_windows
        shared = spark.sparkContext.broadcast(WindowSet(rows))
        before = F.col(name) if name else F.lit(None).cast(f"struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>")
        carried = [c for c in found.columns if c != name] if b < blocks - 1 else keep
        found, new = add_struct(found, [F.col(text_col), before.getField("spans"), before.getField("items")], _scan(shared), FIELDS, carried)
        name = new
    windows.unpersist()
    return found, name


def _scan(shared):
    def scan(cols: list[pa.Array]) -> dict[str, pa.Array]:
        texts, old_spans, old_items = cols
        n_words, spans, items = [], [], []
        for lo, hi, data, offs in text_blocks(texts):
            first, last, doc = word_spans(data, offs, ALNUM)
            words = word_hashes(data, first, last)
            borders = per_document(doc, hi - lo)
            by_doc: dict[int, tuple[list, set]] = {}
            for d, s, k, ids in shared.value.hits(data, first, last, doc, words):
                ranges, seen = by_doc.setdefault(d, ([], set()))
                ranges.append((s - int(borders[d]), s - int(borders[d]) + k))
                seen.update(ids)
            n_words.append(np.diff(borders))
            for d in range(hi - lo):
                ranges, seen = by_doc.get(d, ((), ()))
                was = old_spans[lo + d].as_py() if old_spans[lo + d].is_valid else []
                spans.append(_merged([*ranges, *zip(was[::2], was[1::2], strict=True)]) if ranges or was else [])
                items.append(sorted({*seen, *(old_items[lo + d].as_py() or [])}) if seen or was else [])
        counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        return {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}

    return scan


def _merged(ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def judged(docs: DataFrame, benchmark: DataFrame, percent: int = 5, **options) -> tuple[DataFrame, str, str]:
    """As ``find`` with a second column: contaminated if at least ``percent`` of the words are hit."""
    found, name = find(docs, benchmark, **options)
    s = F.col(name)
    hit = F.aggregate(F.sequence(F.lit(0), F.size(s["spans"]).cast("int") - 2, F.lit(2)), F.lit(0).cast("long"),
                      lambda a, i: a + F.get(s["spans"], i + 1) - F.get(s["spans"], i))
    hit = F.when(F.size(s["spans"]) > 0, hit).otherwise(F.lit(0).cast("long"))
    verdict = "judged" if name == "found" else name + "j"
    return found.withColumn(verdict, F.struct(hit.alias("n_hit"), ((hit > 0) & (hit * 100 >= s["n_words"] * percent)).alias("contaminated"))), name, verdict


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row a document: words, hit words, items and the verdict; ``spans`` has the hit word ranges."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(options.pop("text_col", "text")).alias("text"))
    df, s, v = judged(kept, benchmark, keep=["doc_id"], **options)
    items = F.col(s)["items"]
    return df.select("doc_id", F.col(s)["n_words"].alias("n_words"), F.col(v)["n_hit"].alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                     F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col(v)["contaminated"].alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    df, s, v = judged(docs, benchmark, **options)
    return df.where(~F.col(v)["contaminated"]).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH letters AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, letters),
items AS (SELECT item_id, regexp_extract_all(translate(text, up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, letters WHERE item_id IS NOT NULL),
item_at AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS content FROM item_at),
lengths AS (SELECT DISTINCT k FROM item_windows),
spots AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k),
hits AS (SELECT r, i, k, item_id FROM (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS content FROM spots) JOIN item_windows USING (k, content)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
