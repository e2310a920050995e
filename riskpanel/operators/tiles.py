"""Pair matrices over many coordinates, computed tile by tile.

Draws are cut into segments and coordinates into tiles of ``TILE``. Exceedances are bit sets of draws per coordinate: a task takes two
tiles of a segment and counts common draws by AND and population count, weighted counts by the bit planes of the weights.
Values are small matrices per (segment, tile): a task takes the co-moments of two tiles about their own means, and segments
are merged pairwise. No task, nor the driver, holds a matrix over all coordinates or all draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .fqi import sum_arrays

TILE = 64
WORDS = 64  # 64-bit words of a segment of an exceedance set
DRAWS = 512  # draws of a segment of values
REPS = 50  # bootstrap replicates weighed together


def _tiles(n_coords: int) -> int:
    return -(-n_coords // TILE)


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def _paired(blobs: DataFrame, by: Sequence[str], n_coords: int, columns: Sequence[str]) -> DataFrame:
    """Every two tiles ti <= tj of one (key, segment) in a row; columns get suffixes _a and _b."""
    a = blobs.select(*by, F.col("tile").alias("ti"), *[F.col(c).alias(f"{c}_a") for c in columns])
    if _tiles(n_coords) == 1:
        return a.select("*", F.col("ti").alias("tj"), *[F.col(f"{c}_a").alias(f"{c}_b") for c in columns])
    b = blobs.select(*by, F.col("tile").alias("tj"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, list(by)).where("ti <= tj")


def unfold(tiles: DataFrame, keys: Sequence[str], n_coords: int, columns: dict[str, str]) -> DataFrame:
    """(keys, i, j, ...) for every ordered pair from tiles with ti <= tj; ``columns`` maps TILE x TILE arrays to their mirrored ones."""
    cells = F.arrays_zip(*[F.col(c) for c in columns])
    def swap(back: str) -> Column:
        return F.transform(across, lambda p: F.get(F.col(back), p))

    across = F.transform(F.sequence(F.lit(0), F.lit(TILE * TILE - 1)), lambda p: (p % TILE) * TILE + F.floor(p / TILE).cast("int"))
    mirrored = [swap(back).alias(name) for name, back in columns.items()]
    swapped = tiles.where("ti < tj").select(*keys, F.col("tj").alias("ti"), F.col("ti").alias("tj"), *mirrored)
    rows = tiles.select(*keys, "ti", "tj", *columns).unionByName(swapped).select(*keys, "ti", "tj", F.posexplode(cells).alias("p", "v"))
    i, j = F.col("ti") * TILE + F.floor(F.col("p") / TILE), F.col("tj") * TILE + F.col("p") % TILE
    return rows.select(*keys, i.cast("long").alias("i"), j.cast("long").alias("j"), "v.*").where((F.col("i") < n_coords) & (F.col("j") < n_coords))


# -------------------------------------------------------------------------- exceedance sets
def bit_sets(events: DataFrame, keys: Sequence[str], n_coords: int, segments: DataFrame | None = None) -> DataFrame:
    """(keys, seg, tile, at, bits): the words of every coordinate's draw set, by segment and tile; empty tiles included."""
    by = [*keys, "seg"]
    words = events.groupBy(*keys, F.expr("shiftright(cast(draw as bigint), 12)").alias("seg"), F.floor(F.col("coord") / TILE).cast("int").alias("tile"),
                           (F.col("coord") % TILE * WORDS + F.expr("shiftright(cast(draw as bigint), 6) & 63")).cast("int").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(draw & 63 as int)))").alias("word"))
    blobs = words.groupBy(*by, "tile").agg(F.collect_list(F.struct("at", "word")).alias("w")).select(*by, "tile", F.col("w.at").alias("at"), F.col("w.word").alias("bits"))
    frame = (words.select(*by).distinct() if segments is None else segments).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(_tiles(n_coords) - 1))))
    return frame.join(blobs, [*by, "tile"], "left")


def _bits(at, words) -> np.ndarray:
    out = np.zeros(TILE * WORDS, np.uint64)
    if at is not None:
        out[np.asarray(at)] = np.asarray(words, dtype=np.int64).view(np.uint64)
    return out.reshape(TILE, WORDS)


def _common(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    if mask is not None:
        a = a & mask
    return np.stack([np.bitwise_count(row & b).sum(axis=1) for row in a])


def joint_counts(events: DataFrame, n_coords: int, keys: Sequence[str]) -> DataFrame:
    """(keys, i, j, n): draws in which i and j exceed together, for every ordered pair (diagonal = marginal)."""
    keys = list(keys)
    rows = _paired(bit_sets(events, keys, n_coords), [*keys, "seg"], n_coords, ["at", "bits"])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = [_common(_bits(r.at_a, r.bits_a), _bits(r.at_b, r.bits_b)).ravel().astype(float) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({**{k: pdf[k] for k in (*keys, "ti", "tj")}, "v": v})

    counts = sum_arrays(rows.mapInPandas(task, _kinds(events, keys) + "ti int, tj int, v array<double>"), [*keys, "ti", "tj"], "v")
    return unfold(counts, keys, n_coords, {"v": "v"}).withColumnRenamed("v", "n")


def weighted_gap(events: DataFrame, weights: DataFrame, n_coords: int, first: str, second: str) -> DataFrame:
    """(rep, gap): mean absolute difference, over pairs i <> j, of two banks' weighted joint frequencies in every replicate.

    ``weights`` has (bank, rep, draw, w), w a whole number. Replicates share the event sets; their weights are bit planes.
    """
    seg, spot = F.expr("shiftright(cast(draw as bigint), 12)"), F.expr("cast(draw & 4095 as int)")
    packs = weights.groupBy("bank", seg.alias("seg"), F.floor(F.col("rep") / REPS).alias("pack")).agg(F.collect_list(F.struct("rep", spot.alias("d"), "w")).alias("p")).select(
        "bank", "seg", "pack", F.col("p.rep").alias("rep"), F.col("p.d").alias("d"), F.col("p.w").alias("w"))
    pairs = _paired(bit_sets(events, ["bank"], n_coords, packs.select("bank", "seg").distinct()), ["bank", "seg"], n_coords, ["at", "bits"])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a, b = _bits(r.at_a, r.bits_a), _bits(r.at_b, r.bits_b)
                rep, d, w = np.asarray(r.rep), np.asarray(r.d), np.asarray(r.w)
                names, back = np.unique(rep, return_inverse=True)
                total = np.zeros((len(names), TILE, TILE))
                for p in range(int(w.max(initial=0)).bit_length()):
                    plane = np.zeros((len(names), WORDS * 64), np.uint8)
                    plane[back, d] = (w >> p) & 1
                    masks = np.packbits(plane, axis=1, bitorder="little").view("<u8")
                    for k in range(len(names)):
                        if masks[k].any():
                            total[k] += _common(a, b, masks[k]) * float(1 << p)
                yield pd.DataFrame({"bank": r.bank, "rep": names, "ti": r.ti, "tj": r.tj, "v": list(total.reshape(len(names), -1))})

    sums = sum_arrays(pairs.join(packs, ["bank", "seg"]).mapInPandas(task, "bank string, rep long, ti int, tj int, v array<double>"), ["bank", "rep", "ti", "tj"], "v")
    size = weights.groupBy("bank", "rep").agg(F.sum("w").alias("size"))
    share = materialise(sums.join(size, ["bank", "rep"]), "weighted-pairs")

    def side(name: str, tag: str) -> DataFrame:
        return share.where(F.col("bank") == name).select("rep", "ti", "tj", F.col("v").alias(f"v_{tag}"), F.col("size").alias(f"n_{tag}"))

    def gap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i = np.arange(TILE)
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x = np.abs(np.asarray(r.v_a) / r.n_a - np.asarray(r.v_b) / r.n_b).reshape(TILE, TILE)
                inside = ((r.ti * TILE + i)[:, None] < n_coords) & ((r.tj * TILE + i)[None, :] < n_coords)
                out.append(x[inside & ~((r.ti == r.tj) & np.eye(TILE, dtype=bool))].sum() * (1.0 if r.ti == r.tj else 2.0))
            yield pd.DataFrame({"rep": pdf["rep"], "x": out})

    both = side(first, "a").join(side(second, "b"), ["rep", "ti", "tj"]).mapInPandas(gap, "rep long, x double")
    return both.groupBy("rep").agg((F.sum("x") / (n_coords * (n_coords - 1.0))).alias("gap"))


# ------------------------------------------------------------------------------ co-moments
def complete(bank: DataFrame, n_coords: int, keys: Sequence[str]) -> DataFrame:
    """Only draws with a value at every coordinate."""
    whole = bank.where(F.col("value").isNotNull()).groupBy(*keys, "draw").agg(F.count_distinct("coord").alias("_n")).where(F.col("_n") == n_coords).drop("_n")
    return bank.join(whole, [*keys, "draw"], "left_semi")


def merge(a: tuple, b: tuple) -> tuple:
    """Counts, means and co-moments of two disjoint sets of draws taken together."""
    n = a[0] + b[0]
    dx, dy = b[1] - a[1], b[2] - a[2]
    return n, a[1] + dx * (b[0] / n), a[2] + dy * (b[0] / n), a[3] + b[3] + np.outer(dx, dy) * (a[0] * b[0] / n)


def comoments(bank: DataFrame, n_coords: int, keys: Sequence[str] = ("bank",)) -> DataFrame:
    """(keys, ti, tj, n, mi, mj, m): count, means and co-moments of two tiles of coordinates."""
    keys = list(keys)
    by = [*keys, "seg"]
    cell = F.struct((F.col("draw") % DRAWS).cast("int").alias("d"), (F.col("coord") % TILE).cast("int").alias("c"), F.col("value").cast("double").alias("x"))
    blobs = complete(bank, n_coords, keys).groupBy(*keys, F.floor(F.col("draw") / DRAWS).alias("seg"), F.floor(F.col("coord") / TILE).cast("int").alias("tile")).agg(
        F.collect_list(cell).alias("w")).select(*by, "tile", F.col("w.d").alias("d"), F.col("w.c").alias("c"), F.col("w.x").alias("x"))
    rows = _paired(blobs, by, n_coords, ["d", "c", "x"])
    fields = _kinds(bank, keys) + "ti int, tj int, n double, mi array<double>, mj array<double>, m array<double>"

    def matrix(d, c, x) -> np.ndarray:
        spots, at = np.unique(np.asarray(d), return_inverse=True)
        out = np.zeros((len(spots), TILE))
        out[at, np.asarray(c)] = x
        return out

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, y = matrix(r.d_a, r.c_a, r.x_a), matrix(r.d_b, r.c_b, r.x_b)
                mi, mj = x.mean(axis=0), y.mean(axis=0)
                yield pd.DataFrame([{**{k: getattr(r, k) for k in keys}, "ti": r.ti, "tj": r.tj, "n": float(len(x)), "mi": mi, "mj": mj, "m": ((x - mi).T @ (y - mj)).ravel()}])

    head = [*keys, "ti", "tj"]

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = None, None

        def told() -> pd.DataFrame:
            return pd.DataFrame([{**dict(zip(head, last)), "n": total[0], "mi": total[1], "mj": total[2], "m": total[3].ravel()}])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                key, one = tuple(getattr(r, k) for k in head), (r.n, np.asarray(r.mi), np.asarray(r.mj), np.asarray(r.m).reshape(TILE, TILE))
                if key == last:
                    total = merge(total, one)
                    continue
                if last is not None:
                    yield told()
                last, total = key, one
        if last is not None:
            yield told()

    return rows.mapInPandas(parts, fields).repartition(*head).sortWithinPartitions(*head).mapInPandas(merged, fields)


def covariance_table(tiles: DataFrame, n_coords: int, keys: Sequence[str] = ("bank",)) -> DataFrame:
    """(keys, i, j, n, mean_i, mean_j, cov) with divisor n - 1, for every ordered pair of coordinates."""
    spread = tiles.withColumn("a", F.flatten(F.transform("mi", lambda x: F.array_repeat(x, TILE)))).withColumn("b", F.flatten(F.array_repeat("mj", TILE))).withColumn(
        "c", F.transform("m", lambda x: x / (F.col("n") - 1.0))).withColumn("k", F.array_repeat("n", TILE * TILE))
    return unfold(spread, keys, n_coords, {"a": "b", "b": "a", "c": "c", "k": "k"}).select(
        *keys, "i", "j", F.col("k").cast("long").alias("n"), F.col("a").alias("mean_i"), F.col("b").alias("mean_j"), F.col("c").alias("cov"))


def correlation_table(table: DataFrame, keys: Sequence[str] = ("bank",)) -> DataFrame:
    """(keys, i, j, r) of a covariance table; NULL where a coordinate does not vary."""
    sd = table.where("i = j").select(*keys, F.col("i").alias("k"), F.sqrt("cov").alias("sd"))
    x = table.join(sd.select(*keys, F.col("k").alias("i"), F.col("sd").alias("sd_i")), [*keys, "i"]).join(sd.select(*keys, F.col("k").alias("j"), F.col("sd").alias("sd_j")), [*keys, "j"])
    return x.select(*keys, "i", "j", F.when((F.col("sd_i") > 0) & (F.col("sd_j") > 0), F.col("cov") / (F.col("sd_i") * F.col("sd_j"))).alias("r"))


def leading_eigenvalues(tiles: DataFrame, n_coords: int, k: int, key: str = "bank", steps: int = 60, tolerance: float = 1e-12) -> dict[str, np.ndarray]:
    """The ``k`` largest eigenvalues of every key's covariance, largest first, by a block Krylov space.

    A step multiplies the tiles with a block of vectors in one pass for all keys; the driver holds coordinates x (block x steps) numbers
    a key, never a matrix over pairs.
    """
    names = [r[key] for r in tiles.select(key).distinct().collect()]
    k = min(k, n_coords)
    rng = np.random.default_rng(17)
    block = {b: np.linalg.qr(rng.normal(size=(n_coords, min(n_coords, k + 2))))[0] for b in names}
    basis = {b: np.zeros((n_coords, 0)) for b in names}
    image = {b: np.zeros((n_coords, 0)) for b in names}
    found: dict[str, np.ndarray] = {}
    padded = _tiles(n_coords) * TILE
    for _ in range(steps):
        if not block:
            break
        now = {b: np.vstack([v, np.zeros((padded - n_coords, v.shape[1]))]) for b, v in block.items()}

        def task(batches: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            total = {b: np.zeros_like(v) for b, v in now.items()}
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    b = getattr(r, key)
                    m = np.asarray(r.m).reshape(TILE, TILE) / (r.n - 1.0)
                    i, j = slice(r.ti * TILE, (r.ti + 1) * TILE), slice(r.tj * TILE, (r.tj + 1) * TILE)
                    total[b][i] += m @ now[b][j]
                    if r.ti < r.tj:
                        total[b][j] += m.T @ now[b][i]
            yield pd.DataFrame({key: list(total), "v": [v.ravel() for v in total.values()]})

        live = tiles.where(F.col(key).isin(list(block))).select(key, "ti", "tj", "n", "m")
        for r in sum_arrays(live.mapInPandas(task, f"{key} string, v array<double>"), [key], "v").collect():
            b, v = r[key], block[r[key]]
            y = np.asarray(r["v"]).reshape(padded, -1)[:n_coords]
            basis[b], image[b] = np.hstack([basis[b], v]), np.hstack([image[b], y])
            ritz = np.linalg.eigvalsh((basis[b].T @ image[b] + image[b].T @ basis[b]) / 2)[::-1][:k]
            old, found[b] = found.get(b), ritz
            still = old is not None and len(old) == len(ritz) and np.abs(ritz - old).max() <= tolerance * max(ritz[0], 1e-300)
            rest = y
            for _ in range(2):
                rest = rest - basis[b] @ (basis[b].T @ rest)
            q, triangle = np.linalg.qr(rest)
            q = q[:, np.abs(np.diag(triangle)) > 1e-12 * max(np.abs(ritz[0]), 1e-300)]
            q = q[:, : n_coords - basis[b].shape[1]]
            if still or not q.shape[1]:
                del block[b]
            else:
                block[b] = np.linalg.qr(q - basis[b] @ (basis[b].T @ q))[0]
    return found
