"""Order-preserving packing of tokenised documents into windows of at most ``size`` tokens.

The documents of a partition, in their order, form one stream of tokens; each document ends with an end token.
A dynamic programme picks the cuts among document ends and sentence ends. With f(j) the least cost of the
tokens before j, f(j) = min over i in [j - size, j) of f(i) + padding(j - i) + penalty(j): padding is
size - (j - i), so f(i) + i is all that counts of i and a monotone queue holds its window minimum; lengths that are
a power of two need no padding and are looked up one by one. A stretch without a sentence end for more than half
a window gets cuts between words or, at worst, tokens. The programme runs over blocks of about ``BLOCK`` tokens;
the last windows of a block are decided again with the next one, so memory is bounded for any partition.

Nulls: a null text is empty and gives its end token alone; null ids are carried on. Repeated rows are packed as often
as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, END_ID, BLOCK = 2048, 1, 1 << 20
SENTENCE_COST, WORD_COST = 6, 200  # padding tokens that a cut inside a document, or inside a sentence, is worth
_STOP = r"""([.!?]"?|…)$"""
_MARKS = frozenset(".,!?:;")
MEMO = 300_000  # remembered chunks, about 110 MB at most
BATCH_BYTES, LINE = 1 << 21, 256  # text split at once (a longer document alone), words the tokenizer gets in one string


class Encoder:
    """Token ids of white-space separated chunks; the tokenizer drops white space, so chunks are independent.

    The chunks of a few megabytes of text are numbered, and only distinct ones are looked at; the ids of ``MEMO`` chunks are
    remembered. A chunk counts in lower case, as the tokenizer lowers it anyway. Letters and marks never share a token, so a
    word with a mark behind it is the word and the mark. New words go to the tokenizer many in one string: a word is one run
    of letters, and its last token alone bears the end of a word, which tells where it stops; where the number of ends is not
    that of the words (letters that fall apart when normalised), each goes alone. Words of a-z are
    the same after normalising and splitting, so they go to the merges directly.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {b"": b""}

    def _alone(self, chunks: list[str]) -> list[bytes]:
        told = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in told]

    def _words(self, words: list[str], by) -> dict[bytes, bytes]:
        """Ids of words of letters, many of them in one string."""
        out: dict[bytes, bytes] = {}
        lines = [words[i : i + LINE] for i in range(0, len(words), LINE)]
        for line, told in zip(lines, by.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(told.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(line):
                raw, borders = ids.tobytes(), [0, *(4 * ends).tolist()]
                parts = [raw[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]
            else:
                parts = self._alone(line)
            out.update(zip((w.encode() for w in line), parts, strict=True))
        return out

    def _learned(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks that are not remembered; remembers them while there is room."""
        memo, plain, words, odd, marked = self.memo, set(), set(), [], []
        for c in missing:
            chunk = c.decode("utf-8", "replace")
            split = chunk[-1] in _MARKS and len(chunk) > 1 and chunk[-2] < "\u0500" and chunk[-2].lower()[-1].isalpha()
            word = chunk[:-1] if split else chunk
            if not word.isalpha():
                odd.append((c, chunk))
                continue
            raw = c
            if split:
                raw = c[:-1]
                marked.append((c, raw, c[-1:]))
            if raw not in memo:
                (plain if raw.isascii() and raw.islower() else words).add(word)
        known = self._words(list(plain), self.merges) | self._words(list(words), self.tokenizer)
        odd += [(m.encode(), m) for m in _MARKS if m.encode() not in memo]
        known.update(zip((c for c, _ in odd), self._alone([x for _, x in odd]), strict=True))
        for c, raw, mark in marked:
            known[c] = (known[raw] if raw in known else memo[raw]) + (known[mark] if mark in known else memo[mark])
        if len(memo) < MEMO:
            memo.update(islice(known.items(), MEMO - len(memo)))
        return known

    def documents(self, texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """Of each text: ids as bytes, and the token positions after each chunk and after each sentence."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH_BYTES, side="right")))
            yield from self._block(pc.fill_null(texts.slice(lo, hi - lo), ""))
            lo = hi

    def _block(self, texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # special tokens keep their case
        lists = pc.ascii_split_whitespace(lowered)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        chunks = coded.dictionary.cast(pa.binary()).to_pylist()
        memo = self.memo
        ids = list(map(memo.get, chunks))
        missing = [c for c, x in zip(chunks, ids, strict=True) if x is None]
        if missing:
            known = self._learned(missing)
            ids = [known[c] if x is None else x for c, x in zip(chunks, ids, strict=True)]
        stop = pc.match_substring_regex(coded.dictionary, _STOP).to_numpy(zero_copy_only=False).astype(bool)[code]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        first, counts = (np.cumsum(n) - n)[code], n[code]
        ends = np.concatenate([[0], np.cumsum(counts)])
        pool = np.frombuffer(b"".join(ids), "<u4")
        flat = pool[np.repeat(first - ends[:-1], counts) + np.arange(ends[-1])]
        borders = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            after = ends[a + 1 : b + 1] - ends[a]
            yield flat[ends[a] : ends[b]].tobytes(), after, after[stop[a:b]]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of a tokenizer file, with what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(at: np.ndarray, cost: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Least cost to each candidate cut and the cut before it. ``at`` rises from 0 in steps of at most ``size``."""
    places, costs = at.tolist(), cost.tolist()
    ends, starts = [], []  # pairs of cuts a power of two apart
    for w in (1 << k for k in range(size.bit_length()) if 1 << k <= size):
        near = np.minimum(np.searchsorted(at, at - w), len(at) - 1)
        hit = np.flatnonzero(at[near] == at - w)
        ends.append(hit)
        starts.append(near[hit])
    order = np.argsort(np.concatenate(ends), kind="stable")
    pairs = iter([*zip(np.concatenate(ends)[order].tolist(), np.concatenate(starts)[order].tolist(), strict=True), (len(places), 0)])
    end, start = next(pairs)
    best, back = [0.0] * len(places), [0] * len(places)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for j in range(1, len(places)):
        p = places[j]
        while queue[0][1] < p - size:
            queue.popleft()
        value, _, i = queue[0]
        value += size - p
        while end == j:
            if best[start] < value:
                value, i = best[start], start
            end, start = next(pairs)
        value += costs[j]
        best[j], back[j] = value, i
        key = value + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    return np.array(best), np.array(back)


class Stream:
    """Tokens of whole documents waiting to be cut, with their candidate cuts."""

    def __init__(self, size: int):
        self.size = size
        self.ids: list[bytes] = []  # of each document
        self.rows: list[tuple[object, int, int]] = []  # document id, tokens, tokens already written
        self.at: list[np.ndarray] = []
        self.cost: list[np.ndarray] = []
        self.length = 0

    def add(self, key: object, ids: bytes, chunks: np.ndarray, stops: np.ndarray) -> None:
        ids += np.array([END_ID], "<u4").tobytes()
        n = len(ids) >> 2
        places = np.unique(stops[(stops > 0) & (stops < n - 1)])
        costs = np.full(len(places), float(SENTENCE_COST))
        gaps = np.diff(np.concatenate([[0], places, [n]]))
        if len(gaps) and gaps.max() > self.size // 2:
            places, costs = self._filled(places, costs, chunks, n)
        self.at.append(np.append(places, n) + self.length)
        self.cost.append(np.append(costs, 0.0))
        self.ids.append(ids)
        self.rows.append((key, n, 0))
        self.length += n

    def _filled(self, places, costs, chunks, n):
        """More cuts where sentences are long: between chunks, then anywhere, a quarter window apart at most."""
        step, extra = self.size // 8, []
        edges = np.concatenate([[0], places, [n]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > self.size // 2:
                wanted = np.arange(a + step, b, step)
                near = chunks[np.minimum(np.searchsorted(chunks, wanted), len(chunks) - 1)] if len(chunks) else wanted
                extra.append(np.where((near < b) & (near > a) & (near - wanted < step), near, wanted))
        more = np.setdiff1d(np.concatenate(extra), places) if extra else np.zeros(0, np.int64)
        order = np.argsort(np.concatenate([places, more]), kind="stable")
        return np.concatenate([places, more])[order], np.concatenate([costs, np.full(len(more), float(WORD_COST))])[order]

    def windows(self, last: bool) -> list[tuple[int, int]]:
        """Windows of the best cutting; unless it is the end, those of the last tenth stay for the next block."""
        at, cost = np.concatenate([[0], *self.at]), np.concatenate([[0.0], *self.cost])
        _, back = cut(at, cost, self.size)
        j, ends = len(at) - 1, []
        while j:
            ends.append(j)
            j = int(back[j])
        out, before = [], 0
        for j in reversed(ends):
            if not last and at[j] > self.length - 8 * self.size:
                break
            out.append((before, int(at[j])))
            before = int(at[j])
        return out

    def take(self, windows: list[tuple[int, int]], sequence: int) -> tuple[list[tuple], int]:
        """Pieces of the windows, in order; what is left starts the next block."""
        pieces: list[tuple] = []
        borders = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in self.ids])])
        for start, end in windows:
            d, here = int(np.searchsorted(borders, start, side="right")) - 1, start
            while here < end:
                key, n, done = self.rows[d]
                stop = min(end, int(borders[d + 1]))
                a, b = here - int(borders[d]), stop - int(borders[d])
                pieces.append((key, a + done, b - a, zlib.crc32(self.ids[d][4 * a : 4 * b]), n, sequence, here - start))
                here, d = stop, d + 1
            sequence += 1
        done = windows[-1][1] if windows else 0
        first = int(np.searchsorted(borders, done, side="right")) - 1
        at, cost = (np.concatenate(x) if x else np.zeros(0) for x in (self.at, self.cost))
        keep = at > done
        self.at, self.cost = [at[keep] - done], [cost[keep]]
        rows, ids = self.rows[first:], self.ids[first:]
        if rows:
            inside = done - int(borders[first])
            rows[0], ids[0] = (rows[0][0], rows[0][1], rows[0][2] + inside), ids[0][4 * inside :]
        self.rows, self.ids = rows, ids
        self.length -= done
        return pieces, sequence


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """One row a piece: document, its range of token ids, their crc32, and the sequence and offset it goes to.

    ``tokenizer`` is a file that every executor can read. Sequence ids count up from 2**32 times the partition.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, stream = encoder(tokenizer), Stream(size)
        sequence = TaskContext.get().partitionId() << 32

        def rows(pieces: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        id_type = pa.int64()
        for b in batches:
            id_type = b.column(0).type
            for key, told in zip(b.column(0).to_pylist(), tokens.documents(b.column(1)), strict=True):
                stream.add(key, *told)
                if stream.length >= block:
                    pieces, sequence = stream.take(stream.windows(False), sequence)
                    if pieces:
                        yield rows(pieces, id_type)
        if stream.length:
            pieces, sequence = stream.take(stream.windows(True), sequence)
            yield rows(pieces, id_type)

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))
