"""Vector codes by Lloyd's method per part, in which only moved entries are compared again.

Components become integers, floor(256 x); a vector is cut into ``PARTS`` equal parts and every part position has a
codebook. A pass over the vectors writes, for every part, the nearest entry and the exact squared distance. After the
entries are replaced by their parts' means, a part whose entry did not move keeps its stored distance and is compared
with the moved entries only; a part whose entry moved looks at the whole codebook. Ties fall to the lower index
in both cases: an entry that did not move and was not nearest before is not nearest now. Sums per entry are added up inside
each task and then by Spark; only codebooks (``PARTS`` x ``ENTRIES`` entries) pass through the driver. Every pass reads
the table the last one wrote to the shared folder, so a lost executor costs its tasks alone.

Rows whose vector is null or holds null or non-finite components are left out. Vectors of unequal length, or of a length
that is no multiple of ``PARTS``, are filled up with zeros, which change no distance; empty vectors are zeros. Repeated
rows get a row each; among rows of one id the smaller vector is the earlier entry, null ids come last. Fewer than
``ENTRIES`` rows make smaller codebooks. Floors beyond 2**48 either way stop there; distances beyond a long stop at the
largest. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.hot import join_by_key
from riskpanel.session import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
EDGE = 1 << 48  # larger components stop here
LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    """Width of a part, and whether distances need whole numbers beyond the exact range of doubles."""

    width: int
    wide: bool

    @property
    def kind(self) -> str:
        return "decimal(38,0)" if self.wide else "bigint"


def usable(vector: str) -> F.Column:
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.col(vector).isNotNull() & finite


def integers(vector: str) -> F.Column:
    edge = float(EDGE)
    return F.transform(vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-edge)), F.lit(edge)).cast("bigint"))


# ------------------------------------------------------------------------------ kernels
def _numbers(x: np.ndarray, wide: bool) -> np.ndarray:
    """Doubles where all distances are exact in them, Python integers elsewhere."""
    return x.astype(object) if wide else x.astype(float)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x entries."""
    return (x * x).sum(axis=1)[:, None] - 2 * x.dot(entries.T) + (entries * entries).sum(axis=1)[None, :]


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, the lower index on ties, and its distance."""
    d = distances(x, book)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def reassign(x: np.ndarray, code: np.ndarray, dist: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``assign``, from the codes and distances of the codebook before the entries in ``moved`` changed."""
    code, dist = code.copy(), dist.copy()
    live = np.flatnonzero(moved)
    if not len(live):
        return code, dist
    stale = moved[code]
    if stale.any():
        code[stale], dist[stale] = assign(x[stale], book)
    fixed = np.flatnonzero(~stale)
    if len(fixed):
        near, d = assign(x[fixed], book[live])
        near = live[near]
        win = (d < dist[fixed]) | ((d == dist[fixed]) & (near < code[fixed]))
        code[fixed[win]], dist[fixed[win]] = near[win], d[win]
    return code, dist


# ------------------------------------------------------------------------------- passes
def slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most 2**14 rows and about four million numbers."""
    step = max(1, min(1 << 14, (1 << 22) // width))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows x width of whole-number lists, short ones filled up with zeros."""
    n, flat = len(column), column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == n * width:
        return flat.reshape(n, width)
    out, size = np.zeros((n, width), np.int64), np.diff(column.offsets.to_numpy())
    at = np.repeat(np.arange(n) * width, size) + np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out.ravel()[at] = flat
    return out


def _list(values: np.ndarray, wide: bool) -> pa.Array:
    flat = values.ravel()
    inner = pa.array([Decimal(int(v)) for v in flat], pa.decimal128(38, 0)) if wide else pa.array(flat.astype(np.int64))
    return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, values.shape[1], dtype=np.int32), inner)


def _stored(column: pa.Array, wide: bool) -> np.ndarray:
    flat = column.flatten()
    if wide:
        return np.array([int(v) for v in flat.to_pylist()], dtype=object).reshape(len(column), PARTS)
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), PARTS)


def pass_over(rows: DataFrame, shape: Shape, books: np.ndarray, moved: np.ndarray | None, label: str) -> DataFrame:
    """The vectors with code and distances under ``books``; without ``moved`` nothing is known of them yet."""
    w, wide = shape.width, shape.wide
    ids = [c for c in rows.columns if c not in ("code", "dist")]
    kept = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in ids}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, PARTS * w):
            n = b.num_rows
            x = _numbers(_matrix(b.column("q"), PARTS * w), wide).reshape(n, PARTS, w)
            if moved is not None:
                old = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, PARTS).astype(np.int64)
                last = _stored(b.column("dist"), wide)
            code, dist = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS), object if wide else float)
            for p in range(PARTS):
                book = _numbers(books[p], wide)
                code[:, p], dist[:, p] = (assign(x[:, p], book) if moved is None
                                          else reassign(x[:, p], old[:, p], last[:, p], book, moved[p]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ids), pa.array([r.tobytes() for r in code], pa.binary()), _list(dist, wide)],
                                             names=[*ids, "code", "dist"])

    schema = ", ".join(f"{k} {t}" for k, t in kept.items()) + f", code binary, dist array<{shape.kind}>"
    return materialise(rows.mapInArrow(run, schema), label)


def means(rows: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of every entry's parts; an unused entry stays."""
    w, k = shape.width, books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, w), object)
        for b in slices(batches, PARTS * w):
            n = b.num_rows
            x = _matrix(b.column("q"), PARTS * w).reshape(n, PARTS, w)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, PARTS)
            for p in range(PARTS):
                count[p] += np.bincount(code[:, p], minlength=k)
                part = np.zeros((k, w), np.int64)  # at most 2**14 numbers of at most 2**48
                np.add.at(part, code[:, p], x[:, p])
                total[p] += part
        at = np.flatnonzero(count.ravel())
        yield pa.RecordBatch.from_arrays([
            pa.array(at, pa.int64()), pa.array(count.ravel()[at], pa.int64()),
            pa.array([[Decimal(int(v)) for v in total.reshape(-1, w)[i]] for i in at], pa.list_(pa.decimal128(38, 0)))], names=["at", "n", "s"])

    parts = rows.select("q", "code").mapInArrow(run, "at bigint, n bigint, s array<decimal(38,0)>")
    sums = parts.groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(w)])
    new = books.copy().reshape(-1, w)
    for r in sums.collect():  # at most PARTS x ENTRIES rows
        new[r["at"]] = [int(r[f"s{i}"]) // r["n"] for i in range(w)]
    return new.reshape(books.shape)


def codebook_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(``key``, ``label``, integer vector ``q``, ``code`` of a byte a part, ``dist`` a part) and the codebooks, parts x entries x width."""
    rows = df.where(usable(vector)).select(F.col(key).alias("key"), F.col(label).alias("label"), integers(vector).alias("q"))
    first = rows.orderBy(F.col("key").asc_nulls_last(), "q").select("q").limit(ENTRIES).collect()
    top = rows.agg(F.max(F.size("q")).alias("n"), F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))).alias("m")).first()
    width = max(1, -(-(top["n"] or 0) // PARTS))
    shape = Shape(width, width * (2 * (top["m"] or 0)) ** 2 >= 1 << 52)
    books = np.zeros((len(first), PARTS * width), np.int64)
    for i, r in enumerate(first):
        books[i, : len(r["q"])] = r["q"]
    books = books.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy()
    out = pass_over(rows, shape, books, None, "vector-codes")
    for _ in range(rounds if len(first) else 0):
        new = means(out, shape, books)
        out = pass_over(out, shape, new, (new != books).any(axis=2), "vector-codes")
        books = new
    return out, books


def report(df: DataFrame) -> DataFrame:
    """One row per kept vector: code in hexadecimal, error, the error of all vectors of its label, hash of the codebooks."""
    coded, books = compress(df)
    whole = F.aggregate("dist", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    stop = F.lit(LARGEST).cast("decimal(38,0)")
    rows = materialise(coded.select("key", "label", F.lower(F.hex("code")).alias("code"), whole.alias("error")), "vector-errors")
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    total = rows.count()
    return join_by_key(rows, materialise(labels, "label-errors"), ["label"], "n", total).select(
        F.col("key").alias("vec_id"), "code", F.least("error", stop).cast("bigint").alias("error"),
        F.least("label_error", stop).cast("bigint").alias("label_error"), F.lit(codebook_hash(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL, every part against its whole codebook in every round."""
    out = f"""WITH RECURSIVE kept AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS MATERIALIZED (SELECT ((max(len(q)) + {PARTS - 1}) // {PARTS})::BIGINT AS w FROM kept),
pt AS MATERIALIZED (SELECT r, p, list_transform(range(p * w, (p + 1) * w), lambda i: coalesce(q[i + 1], 0)) AS x FROM kept, w, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id NULLS LAST, q) - 1 AS e, x FROM pt JOIN kept USING (r) QUALIFY e < {ENTRIES})"""
    for i in range(ROUNDS + 1):
        out += f""",
a{i} AS MATERIALIZED (SELECT r, pt.p, any_value(pt.x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(pt.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS b
    FROM pt JOIN c{i} c ON c.p = pt.p GROUP BY 1, 2)"""
        if i < ROUNDS:
            out += f""",
s{i} AS (SELECT p, e, list(f ORDER BY j) AS x FROM (SELECT p, b.e AS e, j, floor(sum(x[j]) / count(*))::BIGINT AS f FROM a{i}, w, range(1, w + 1) t(j) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN s{i} s ON s.p = c.p AND s.e = c.e)"""
    return out + f""",
v AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY p) AS code, sum(b.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256 FROM v JOIN kept USING (r)"""


SQL = _sql()
