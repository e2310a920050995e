"""Language identification by compression.

Each language has a raw-content zstandard dictionary of labelled text. A lower-cased text is compressed with
every dictionary; the language of the smallest result wins (ties: the first name). The margin is the share by
which the smallest undercuts the second; a text whose margin stays under ``min_margin`` is rejected, as is one
without a letter. Whole texts are compressed, whatever their length, in equal chunks of at most ``CHUNK`` bytes, each
afresh with every dictionary; sizes are summed over the chunks. So every part of a text weighs the same wherever it
stands, and the margin does not shrink with the length. A text of one chunk is compressed as it is.

The dictionaries are fitted on a bounded sample: of every language about ``SAMPLE`` labelled rows, those with the
smallest hash of their id, and of each a piece of ``PIECE`` characters from its middle, ``DICTIONARY`` bytes at most.

Nulls: a null text or one without a letter is ``und`` with score 0; rows with a null label teach nothing and a
null id is learned from like any other. Without any label every text is ``und``. Repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.text import add_struct, remainder

SAMPLE, PIECE, DICTIONARY, LEVEL = 400, 200, 1 << 16, 6
MIN_MARGIN = 0.002
CHUNK = 1 << 12
_LETTER = regex.compile(r"\p{L}")
_SPACE = 1 << 30
FIELDS = "lang string, score double, margin double, rejected boolean"


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary of each language in ``lang_col``; what reaches the driver is bounded by languages x sample."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not counts:
        return {}
    lang, draw = F.col(lang_col).cast("string"), F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.col(text_col))), F.lit(_SPACE))
    chosen = F.lit(False)
    for name, n in counts.items():
        chosen = chosen | ((lang == name) & (draw < int(_SPACE * min(1.0, 2 * SAMPLE / n))))
    start = F.greatest(F.lit(1), F.floor((F.char_length(text_col) - PIECE) / 2).cast("int"))
    pieces = rows.where(chosen).select(lang.alias("lang"), draw.alias("draw"), F.substring(F.col(text_col), start, F.lit(PIECE)).alias("piece"))
    parts: dict[str, list[bytes]] = {name: [] for name in counts}
    for r in pieces.orderBy("draw", "lang", "piece").limit(4 * SAMPLE * len(counts)).collect():
        if len(parts[r["lang"]]) < SAMPLE:
            parts[r["lang"]].append(r["piece"].lower().encode())
    return {name: b"\n".join(p)[:DICTIONARY] for name, p in sorted(parts.items()) if p}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", min_margin: float = MIN_MARGIN, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Documents with a struct of language, score, margin and rejection; and its name."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    coders: list[tuple[str, zstandard.ZstdCompressor]] = []

    def scan(cols: list[pa.Array]) -> dict[str, pa.Array]:
        if not coders:
            for name, raw in shared.value.items():
                words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=LEVEL)
                coders.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)))
        rows = [_best(None if x is None else str(x), coders) for x in cols[0].to_pylist()]
        langs, scores, margins = zip(*rows, strict=True) if rows else ((), (), ())
        return {"lang": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "margin": pa.array(margins, pa.float64()),
                "rejected": pa.array([x == "und" or m < min_margin for x, m in zip(langs, margins, strict=True)], pa.bool_())}

    return add_struct(docs, [F.col(text_col)], scan, FIELDS, keep)


def _best(text: str | None, coders: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, float]:
    """Language, its share 2**-bytes among all languages, and the margin; one language has no rival."""
    if not text or not coders or not _LETTER.search(text):
        return "und", 0.0, 0.0
    raw = memoryview(text.lower().encode("utf-8", "replace"))
    n = -(-len(raw) // CHUNK)
    chunks = [raw[len(raw) * i // n : len(raw) * (i + 1) // n] for i in range(n)]
    sizes = np.array([sum(len(c.compress(x)) for x in chunks) for _, c in coders], dtype=np.float64)
    at = int(sizes.argmin())
    share = float(1 / np.exp2(np.maximum(sizes[at] - sizes, -1000)).sum())
    second = np.partition(sizes, 1)[1] if len(sizes) > 1 else np.inf
    return coders[at][0], share, float(1 - sizes[at] / second)


def teaching(docs: DataFrame, id_col: str = "doc_id", held_out_of: int = 4, held_out: int = 2):
    """True for the rows held out from learning."""
    return F.coalesce(remainder(F.col(id_col), held_out_of) == held_out, F.lit(False))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: whether it was held out, the language, the score and whether it is rejected."""
    known = learn(docs.where(~teaching(docs, id_col)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found, s = identify(rows, known, keep=["doc_id"])
    return found.select("doc_id", teaching(found).alias("held_out"), F.col(s)["lang"].alias("lang_pred"), F.col(s)["score"].alias("score"), F.col(s)["rejected"].alias("rejected"))


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, unchanged; learned from all labelled rows."""
    found, s = identify(docs, learn(docs), **options)
    return found.where(~F.col(s)["rejected"]).select(*[F.col(f"`{c}`") for c in docs.columns])
