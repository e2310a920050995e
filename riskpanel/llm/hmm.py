"""Hidden Markov language model over the words of a corpus.

A word w is emitted in two steps: a latent state emits one of ``SYMBOLS`` classes (the class is a hash of the
word, the end of text has its own) and the class emits the word with its smoothed share of the class,
(c + 1) / (C + V + 1), where c counts the word, C the words of the class and V its distinct words in the
training texts; the last 1 is left for words never seen. Baum-Welch trains start, transition and class
probabilities: every task adds up expected counts over its texts, Spark adds up the tasks' blocks, and only the
finished tables (states x classes, whatever the corpus) reach the driver. Training reads whole texts as
sequences of at most ``PIECE`` tokens; scoring runs the scaled forward recursion over each whole text.

Word counts stay a distributed table. Words that make up at least 1/``HEAD`` of all tokens, which would be hot keys,
number ``HEAD`` at most; they are looked up from a broadcast and all other words by a join, so every count is exact.

Nulls: a null text is empty (one token, the end); a null id is trained on. Repeated rows count as often as they
occur and get one result row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskpanel.llm.text import SPACED, per_document, remainder, text_blocks, word_hashes, word_spans
from riskpanel.session import materialise

STATES, SYMBOLS, PIECE, ROUNDS, HEAD = 8, 4096, 256, 5, 500_000
END = np.uint64(0x5EED0F7E870F7E97)  # key of the end of text
_SLICE = 512  # classes in one block of expected counts
FAN = 1024  # tasks whose blocks are added up together, before the sums are


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token keys, borders): each document's word hashes and the end."""
    for lo, hi, data, offs in text_blocks(column):
        first, last, doc = word_spans(data, offs, SPACED)
        keys, n = word_hashes(data, first, last), hi - lo
        borders = per_document(doc, n) + np.arange(n + 1)
        out = np.empty(len(keys) + n, dtype=np.uint64)
        out[borders[1:] - 1] = END
        out[np.arange(len(keys)) + doc] = keys
        yield lo, hi, out, borders


def symbol(keys: np.ndarray) -> np.ndarray:
    return np.where(keys == END, SYMBOLS, (keys >> np.uint64(20)) % np.uint64(SYMBOLS)).astype(np.uint16)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row hash, held_out, text) to the same keys with the class of each token."""
    for b in batches:
        cells: list[bytes] = []
        for lo, hi, keys, borders in tokens(b.column(3)):
            s = symbol(keys)
            cells += [s[borders[i] : borders[i + 1]].tobytes() for i in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cells, pa.binary())], names=["doc_id", "fp", "held_out", "symbols"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct token keys of a batch with their counts."""
    for b in batches:
        parts = [np.unique(keys, return_counts=True) for _, _, keys, _ in tokens(b.column(0))]
        if not parts:
            continue
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "n"])


class Model:
    """Start, transition and class probabilities of the latent chain."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)

    @classmethod
    def first(cls, share: np.ndarray, states: int, seed: int = 11) -> Model:
        """Slow-moving states that share the corpus distribution but for a fixed perturbation of each class."""
        rng = np.random.default_rng(seed)
        emit = share[:, None] * rng.uniform(0.3, 1.7, (len(share), states))
        move = np.full((states, states), 0.02 / max(1, states - 1))
        np.fill_diagonal(move, 0.98 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each sequence by the scaled forward recursion."""
        grid, lengths, order = _grid(sequences)
        total, alpha = np.zeros(len(sequences)), None
        for t in range(grid.shape[0]):
            n = int(np.searchsorted(-lengths, -t, side="left"))
            e = self.emit[grid[t, :n]]
            alpha = e * self.start if alpha is None else (alpha[:n] @ self.move) * e
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale.astype(np.float64))
        out = np.empty(len(sequences))
        out[order] = total
        return out

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions and the log-likelihood (forward-backward)."""
        grid, lengths, _ = _grid(sequences)
        steps, k = grid.shape[0], len(self.start)
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]
        at = np.concatenate([[0], np.cumsum(active)])
        flat = np.concatenate([grid[t, :n] for t, n in enumerate(active)])
        e = self.emit[flat]
        alpha, scale = np.empty((at[-1], k), np.float32), np.empty(at[-1], np.float32)
        for t, n in enumerate(active):
            a = e[: active[0]] * self.start if t == 0 else (alpha[at[t - 1] : at[t - 1] + n] @ self.move) * e[at[t] : at[t + 1]]
            s = a.sum(1)
            alpha[at[t] : at[t + 1]], scale[at[t] : at[t + 1]] = a / s[:, None], s
        gamma = alpha.copy()
        moves = np.zeros((k, k))
        beta = np.ones((active[-1], k), np.float32)
        for t in range(steps - 1, 0, -1):  # beta belongs to step t
            n, was = active[t], active[t - 1]
            right = e[at[t] : at[t + 1]] * beta / scale[at[t] : at[t + 1], None]
            moves += alpha[at[t - 1] : at[t - 1] + n].T @ right
            beta = np.ones((was, k), np.float32)
            beta[:n] = right @ self.move.T
            gamma[at[t - 1] : at[t]] *= beta
        counts = np.stack([np.bincount(flat, weights=gamma[:, i], minlength=len(self.emit)) for i in range(k)], axis=1)
        return gamma[: active[0]].sum(0, dtype=np.float64), moves * self.move, counts, float(np.log(scale, dtype=np.float64).sum())


def _grid(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences as columns of a (step, sequence) array, longest first."""
    lengths = np.array([len(x) for x in sequences])
    order = np.argsort(-lengths, kind="stable")
    grid = np.zeros((int(lengths.max()), len(sequences)), dtype=np.uint16)
    for to, i in enumerate(order):
        grid[: lengths[i], to] = sequences[i]
    return grid, lengths[order], order


def _groups(rows: Iterator[np.ndarray], cells: int = 1_000_000) -> Iterator[list[np.ndarray]]:
    """Lists of sequences whose padded grid stays within ``cells``, but for a single longer one."""
    group: list[np.ndarray] = []
    longest = 0
    for x in rows:
        if group and max(longest, len(x)) * (len(group) + 1) > cells:
            yield group
            group, longest = [], 0
        group.append(x)
        longest = max(longest, len(x))
    if group:
        yield group


def train(spark: SparkSession, symbols: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """Baum-Welch over the table's ``symbols``; returns the model and the log-likelihood before each round."""
    model, trail = Model.first(share, states), []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, total = shared.value, None
            pieces = (s[i : i + PIECE] for b in batches for c in b.column(0).to_pylist() for s in [np.frombuffer(c, np.uint16)] for i in range(0, len(s), PIECE))
            for group in _groups(pieces, 200_000):
                got = m.expected(group)
                total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
            if total is not None:
                start, moves, counts, fit = total
                cells = [counts[i : i + _SLICE].ravel() for i in range(0, len(counts), _SLICE)] + [np.concatenate([start, moves.ravel(), [fit]])]
                lane = pa.array([TaskContext.get().partitionId() // FAN] * len(cells), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), lane, pa.array(cells, pa.list_(pa.float64()))], names=["block", "lane", "cells"])

        kind = "block int, lane int, cells array<double>"
        parts = symbols.mapInArrow(step, kind).groupBy("block", "lane").applyInArrow(_summed, kind)  # blocks of FAN tasks first
        parts = parts.groupBy("block").applyInArrow(_summed, kind).select("block", "cells")
        blocks = [np.array(r["cells"]) for r in sorted(parts.collect())]  # states x classes numbers, whatever the corpus
        shared.unpersist()
        if not blocks:
            break
        tail, k = blocks.pop(), states
        counts = np.concatenate(blocks).reshape(-1, k)
        trail.append(float(tail[-1]))
        start, moves = tail[:k] + 1, tail[k : k + k * k].reshape(k, k) + 1
        emit = counts + 2.0 * share[:, None] * len(share)  # prior: the corpus distribution
        model = Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))
    return model, trail


def _summed(table: pa.Table) -> pa.Table:
    cells = table.column("cells").combine_chunks()
    total = np.asarray(cells.flatten()).reshape(table.num_rows, -1).sum(0)
    return pa.table({"block": table.column("block")[:1], "lane": table.column("lane")[:1], "cells": pa.array([total], pa.list_(pa.float64()))})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_of: int = 7, held_out: int = 2,
          states: int = STATES, rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """Scores of all texts under a model trained on those whose crc32(id) modulo ``held_out_of`` is not ``held_out``."""
    spark = docs.sparkSession
    text, kind = F.col(text_col), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("fp"),
                       F.coalesce(remainder(F.col(id_col), held_out_of) == held_out, F.lit(False)).alias("held_out"), text.alias("text"))
    learned = rows.where(~F.col("held_out"))
    words = materialise(learned.select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    symbols = materialise(rows.mapInArrow(_encode, f"doc_id {kind}, fp long, held_out boolean, symbols binary"), "lm-symbols")
    to_class = F.when(F.col("word") == F.lit(int(END.view(np.int64))), SYMBOLS).otherwise(F.pmod(F.shiftrightunsigned("word", 20), F.lit(SYMBOLS)))
    of_class = words.groupBy(to_class.cast("int").alias("symbol")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # one row a class
    n, v = np.zeros(SYMBOLS + 1), np.zeros(SYMBOLS + 1)
    for r in of_class:
        n[r["symbol"]], v[r["symbol"]] = r["n"], r["v"]
    total, distinct = n.sum(), v.sum()
    model, _ = train(spark, symbols.where(~F.col("held_out")).select("symbols"), (n + 1) / (n + 1).sum(), states, rounds)
    top = words.where(F.col("n") * head >= int(total)).select("word", "n").toPandas()  # shares of 1/head: at most ``head`` rows
    known = top.sort_values("word")
    shared = spark.sparkContext.broadcast((known["word"].to_numpy(np.int64), known["n"].to_numpy(np.int64)))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_words, head_n = shared.value
        for b in batches:
            for lo, hi, keys, borders in tokens(b.column(2)):
                docs_of, words_of = np.repeat(np.arange(hi - lo), np.diff(borders)), keys.view(np.int64)
                at = np.minimum(np.searchsorted(head_words, words_of), max(0, len(head_words) - 1))
                hit = head_words[at] == words_of if len(head_words) else np.zeros(len(keys), bool)
                logs = np.bincount(docs_of[hit], weights=np.log10(head_n[at[hit]] + 1.0), minlength=hi - lo) if hit.any() else np.zeros(hi - lo)
                seen = np.bincount(docs_of[hit], minlength=hi - lo)
                other_doc, other = docs_of[~hit], words_of[~hit]
                order = np.lexsort((other, other_doc))
                other_doc, other = other_doc[order], other[order]
                new = np.flatnonzero(np.concatenate([[True], (other[1:] != other[:-1]) | (other_doc[1:] != other_doc[:-1])])) if len(other) else np.zeros(0, int)
                times = np.diff(np.append(new, len(other)))
                m = len(new)
                ids = pa.array(np.concatenate([np.arange(lo, hi), other_doc[new] + lo]))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(ids), b.column(1).take(ids), pa.array(np.concatenate([np.zeros(hi - lo, np.int64), other[new]])),
                    pa.array(np.concatenate([np.zeros(hi - lo, np.int64), times])), pa.array(np.concatenate([logs, np.zeros(m)])),
                    pa.array(np.concatenate([seen, np.zeros(m, np.int64)]).astype(np.int64)), pa.array(np.concatenate([np.ones(hi - lo, bool), np.zeros(m, bool)])),
                ], names=["doc_id", "fp", "word", "times", "logs", "known", "whole"])

    found = rows.select("doc_id", "fp", "text").mapInArrow(looked_up, f"doc_id {kind}, fp long, word long, times long, logs double, known long, whole boolean")
    # a row for the whole document has no word: its key is its own hash, which spreads it and joins nothing
    found = found.withColumn("word", F.when(F.col("whole"), F.col("fp")).otherwise(F.col("word")))
    c = F.coalesce(F.col("n"), F.lit(0))
    met = found.join(words, "word", "left").select(
        "doc_id", "fp", F.when(F.col("whole"), F.col("logs")).otherwise(F.col("times") * F.log10(c + 1.0)).alias("logs"),
        F.when(F.col("whole"), F.col("known")).otherwise(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
        F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("latent"), F.lit(0).cast("long").alias("copies"))
    inside = np.log10(n + v + 1.0)
    trained = spark.sparkContext.broadcast((model, inside))

    def latent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, within = trained.value
        for b in batches:
            rows = [np.frombuffer(x, np.uint16) for x in b.column(2).to_pylist()]
            order = sorted(range(len(rows)), key=lambda i: len(rows[i]))  # like lengths together
            value, at = np.zeros(len(rows)), 0
            for group in _groups(rows[i] for i in order):
                value[order[at : at + len(group)]] = m.log10(group)
                at += len(group)
            value -= np.array([within[x].sum() for x in rows])
            sizes = pa.array([len(x) for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sizes, pa.array(value, pa.float64())], names=["doc_id", "fp", "n_tokens", "latent"])

    scored = symbols.select("doc_id", "fp", "symbols").mapInArrow(latent, f"doc_id {kind}, fp long, n_tokens long, latent double").select(
        "doc_id", "fp", F.lit(0.0).alias("logs"), F.lit(0).cast("long").alias("known"), "n_tokens", "latent", F.lit(1).cast("long").alias("copies"))
    sums = met.unionByName(scored).groupBy("doc_id", "fp").agg(*[F.sum(x).alias(x) for x in ("logs", "known", "n_tokens", "latent", "copies")])
    one = sums.withColumns({x: F.col(x) / F.col("copies") for x in ("logs", "latent")} | {x: (F.col(x) / F.col("copies")).cast("long") for x in ("known", "n_tokens")})
    space = float(np.log10(total + distinct + 1)) if total else 0.0
    out = one.select("doc_id", F.coalesce(remainder(F.col("doc_id"), held_out_of) == held_out, F.lit(False)).alias("held_out"), "n_tokens",
                     F.col("known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
                     (F.col("logs") - F.col("n_tokens") * F.lit(space)).alias("base_score"), (F.col("logs") + F.col("latent")).alias("score"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
