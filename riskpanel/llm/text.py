"""Shared helpers: word spans and rolling hashes over Arrow text, and columns added beside a table's own.

Texts are handled as UTF-8 bytes. A block holds whole documents of a few megabytes together, so memory does
not grow with the batch; one longer document makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 21
_M64 = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words split at ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, *range(9, 14)]] = False

#: Bytes of words made of ASCII digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))


BYTE_POWERS, WORD_POWERS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of the key."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(values: np.ndarray, first: np.ndarray, last: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[first:last] for many ranges, from one running sum."""
    n = len(values)
    powers.reach(n + 1)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * powers.up[:n], out=run[1:])
    return mix((run[last] - run[first]) * powers.down[first])


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words; no word crosses a document's border."""
    m = inside[data]
    if not len(m):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    border = np.zeros(len(m) + 1, dtype=bool)
    border[offsets] = True
    begins = m.copy()
    begins[1:] &= ~m[:-1] | border[1:-1]
    ends = m.copy()
    ends[:-1] &= ~m[1:] | border[1:-1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, side="right") - 1


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return _ranges(data, first, last, BYTE_POWERS)


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive words from each position in ``first``."""
    return _ranges(words, first, first + size, WORD_POWERS)


def text_blocks(column: pa.Array, lower: bool = True, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of whole documents; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    offs = np.frombuffer(raw[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        part = data[offs[lo] : offs[hi]]
        yield lo, hi, LOWER[part] if lower else part, offs[lo : hi + 1] - offs[lo]
        lo = hi


def per_document(doc: np.ndarray, n: int) -> np.ndarray:
    """Borders of each document's run in a sorted array of document numbers."""
    return np.searchsorted(doc, np.arange(n + 1))


def free_name(df: DataFrame, wanted: str) -> str:
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def add_struct(
    df: DataFrame, inputs: Sequence[Column], fn: Callable[[list[pa.Array]], dict[str, pa.Array]], fields: str, keep: Sequence[str] | None = None
) -> tuple[DataFrame, str]:
    """The table with one more struct column, computed per Arrow batch from ``inputs``; returns it and the new name.

    The columns pass through untouched and under their own names; ``keep`` names those that are carried on.
    """
    keep = list(df.columns) if keep is None else list(keep)
    name = free_name(df, "found")
    kind = T.StructType.fromDDL(fields)
    kept = [df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)]
    given = [c.alias(f"i{i}") for i, c in enumerate(inputs)]
    schema = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField("found", kind)])
    n_keep, n_in = len(keep), len(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = fn([b.column(n_keep + i) for i in range(n_in)])
            packed = pa.StructArray.from_arrays([out[f.name] for f in kind], names=[f.name for f in kind])
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], packed], names=[*(f"k{i}" for i in range(n_keep)), "found"])

    out = df.select(*kept, *given).mapInArrow(run, schema)
    return out.toDF(*keep, name), name


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """The table with further columns that later expressions read instead of repeating them.

    Inside a lambda an inlined expression would run once an element; a generator is not inlined.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(column: Column, m: int) -> Column:
    """crc32 of the value as text, modulo ``m``."""
    return F.crc32(column.cast("string")) % m
