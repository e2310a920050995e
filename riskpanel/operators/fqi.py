"""Entity-balanced ridge fitted-Q models on both sides of every cut, for all cuts and draws at once.

One scan of the panel rows writes a moment table: every entity's Gram, right-hand-side and cross blocks by cut, side and
action, beside the rows themselves as arrays. A draw is a weighted sum of entity moments, taken once. Cross blocks follow the greedy
policy of reference coefficients; a later pass only looks at rows close enough to a policy border to flip, and
adds what flipped. Sums are formed in the tasks, shuffled by draw, and each draw's small systems (2(p+1) unknowns) are
solved where its sums are. No pass moves a panel row, and no task needs a whole side or a whole entity.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .support import side_counts

# Arrays of one task, and systems of one block of draws, stay near this many doubles; more draws run in more blocks.
BLOCK_DOUBLES = 4_000_000
# A row of the moment table holds about this many doubles of rows, and of moments. Its files have small row groups, whose size is
# looked at after every row: writers hold a group and readers a batch of 4,096 rows or a group, whichever is less.
BLOCK_VALUES = 250_000
SMALL_GROUPS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8}
# Rows of an entity are dealt by stretches of this many time steps.
STRETCH = 4096


@dataclass(frozen=True)
class FitRule:
    gamma: float = 0.9825931938526898
    alpha: float = 1.0
    tolerance: float = 1e-5
    max_iterations: int = 800
    solver: str = "policy"
    policy_passes: int = 40
    estimator: str = "balanced"

    def __post_init__(self) -> None:
        if not 0.0 <= self.gamma < 1.0:
            raise ValueError("gamma must lie in [0,1)")
        if self.alpha < 0 or self.max_iterations <= 0 or self.tolerance <= 0:
            raise ValueError("invalid numerical configuration")
        if self.estimator not in ("balanced", "pooled", "sums"):
            raise ValueError(f"unknown estimator {self.estimator!r}")


@dataclass(frozen=True)
class Design:
    """Prepared rows plus the few numbers every task needs."""

    rows: DataFrame
    counts: DataFrame
    cuts: tuple[int, ...]
    q: int
    entities: np.ndarray  # cuts x 2: entities on a side
    transitions: np.ndarray  # cuts x 2: rows on a side
    active: np.ndarray  # cuts: entities on either side
    cache: dict = field(default_factory=dict, compare=False, repr=False)  # moment tables by rewards, policy and weights


@dataclass(frozen=True)
class Randomness:
    """What differs between draws that share the same rows."""

    kind: str = "none"  # none | reward | weight
    law: str = "gaussian"
    seed: int = 0
    omitted: tuple = ()
    table: DataFrame | None = None  # (entity_id, w array over draws) for laws that are no function of the entity


@dataclass
class Models:
    beta: np.ndarray  # draws x cuts x 2 x 2q
    W: np.ndarray
    H: np.ndarray
    converged: np.ndarray
    iterations: np.ndarray
    delta: np.ndarray
    totals: np.ndarray | None = None
    extra: dict = field(default_factory=dict)


def prepare(panel: DataFrame, cuts: Sequence[int], start: int, end: int, state_dim: int, label: str = "design") -> Design:
    """Rows inside the window with ``1 / n`` of their entity on their side of every cut."""
    ordered = tuple(sorted({int(c) for c in cuts}))
    inside = panel.where((F.col("elapsed_index") >= start) & (F.col("elapsed_index") < end))
    counts = materialise(side_counts(inside.select("entity_id", "elapsed_index", "action"), ordered, start, end), f"{label}-counts")
    m = range(len(ordered))
    r = counts.agg(
        *[F.count_if(F.col(f"n_{s}")[j] > 0).alias(f"g_{s}{j}") for s in ("left", "right") for j in m],
        *[F.count_if(F.col("n_left")[j] + F.col("n_right")[j] > 0).alias(f"active{j}") for j in m],
        *[F.coalesce(F.sum(F.col(f"n_{s}")[j]), F.lit(0)).alias(f"n_{s}{j}") for s in ("left", "right") for j in m]).first()
    g, n = (np.array([[r[f"{k}_left{j}"], r[f"{k}_right{j}"]] for j in m], dtype=float) for k in ("g", "n"))
    side_n = F.array(*[F.when(F.col("elapsed_index") < c, F.col("n_left")[j]).otherwise(F.col("n_right")[j]) for j, c in enumerate(ordered)])
    extra = [c for c in ("base_reward", "residual") if c in panel.columns]
    rows = inside.join(counts.select("entity_id", "n_left", "n_right"), "entity_id").select(
        "entity_id", F.xxhash64("entity_id").alias("ehash"), F.col("elapsed_index").cast("int").alias("idx"),
        F.col("action").cast("int").alias("action"), "state", "next_state", F.col("reward").cast("double").alias("reward"),
        *extra, "n_left", "n_right", F.transform(side_n, lambda k: 1.0 / k).alias("inv_n"))
    return Design(materialise(rows, label), counts, ordered, state_dim + 1, g, n, np.array([r[f"active{j}"] for j in m], dtype=float))


# ------------------------------------------------------------------------ randomness
def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keyed_uniform(seed: int, draws: np.ndarray, keys: np.ndarray, stream: int = 0) -> np.ndarray:
    """Uniforms for every (draw, key): a pure function of its arguments, so partitions do not matter."""
    with np.errstate(over="ignore"):
        d = _mix(np.asarray(draws, dtype=np.int64).astype(np.uint64) * np.uint64(2654435761) + np.uint64(seed * 1000003 + stream))
        z = _mix(d[:, None] ^ _mix(np.asarray(keys, dtype=np.int64).view(np.uint64))[None, :])
    return ((z >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def keyed_draws(law: str, seed: int, draws: np.ndarray, keys: np.ndarray) -> np.ndarray:
    u = keyed_uniform(seed, draws, keys, 0)
    if law == "gaussian":
        return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * keyed_uniform(seed, draws, keys, 1))
    if law == "rademacher":
        return np.where(u < 0.5, -1.0, 1.0)
    if law == "webb":
        from ..functions.columns import SIX_POINTS
        return np.asarray(SIX_POINTS)[np.minimum((u * 6).astype(int), 5)]
    if law == "exponential":
        return -np.log(u)
    if law in ("ones", "zeros"):
        return np.full_like(u, law == "ones")
    raise ValueError(f"unknown law {law!r}")


def _entity_weights(rnd: Randomness, draws: np.ndarray, ehash: np.ndarray) -> np.ndarray:
    unique, back = np.unique(ehash, return_inverse=True)
    if rnd.law == "leave_one_out":
        m = (np.asarray(rnd.omitted, dtype=np.int64)[draws][:, None] != unique[None, :]).astype(float)
    else:
        m = keyed_draws(rnd.law, rnd.seed, draws, unique)
    return m[:, back]


# --------------------------------------------------------------------------- kernels
def _matrix(col: pd.Series | np.ndarray) -> np.ndarray:
    return np.vstack(np.asarray(col)).astype(float)


def _arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    s, sn = _matrix(pdf["state"]), _matrix(pdf["next_state"])
    one = np.ones((len(pdf), 1))
    out = {"phi": np.hstack([one, s]), "phin": np.hstack([one, sn]), "a": pdf["action"].to_numpy(), "idx": pdf["idx"].to_numpy(),
           "inv": _matrix(pdf["inv_n"]), "r": pdf["reward"].to_numpy(float), "eh": pdf["ehash"].to_numpy(np.int64)}
    for c in ("base_reward", "residual"):
        if c in pdf.columns:
            out[c] = pdf[c].to_numpy(float)
    return out


def sum_arrays(df: DataFrame, keys: Sequence[str], col: str, lanes: int | None = None) -> DataFrame:
    """Element-wise sum of arrays by key, without a row for every cell; arrays of one key have one length.

    Partial results are first added up by (key, lane of the input split), then by key; rows of a key arrive
    next to each other, so a task holds one sum at a time. ``lanes=0`` leaves the first step out, for keys with few rows; by
    default it is taken where more than 64 tasks run at once.
    """
    keep = list(keys)
    if lanes is None:
        lanes = 64 if df.sparkSession.sparkContext.defaultParallelism > 64 else 0
    if lanes:
        laned = df.select(*keep, F.pmod(F.spark_partition_id(), F.lit(lanes)).alias("_lane"), col)
        df = _summed(laned, [*keep, "_lane"], col).drop("_lane")
    return _summed(df.select(*keep, col), keep, col)


def _summed(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    kind = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + f", {col} array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, total = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            new = np.zeros(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            new[0] = True
            at = np.flatnonzero(new)
            heads = [tuple(pdf[k].iloc[i] for k in keys) for i in at]
            sums = [_matrix(part).sum(axis=0) for part in np.split(pdf[col].to_numpy(), at[1:])]
            if last is not None and heads[0] == last:
                sums[0] += total
            elif last is not None:
                heads, sums = [last, *heads], [total, *sums]
            last, total = heads[-1], sums[-1]
            if len(heads) > 1:
                yield pd.DataFrame({**dict(zip(keys, zip(*heads[:-1]))), col: sums[:-1]})
        if last is not None:
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, last)}, col: [total]})

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, kind)


# ----------------------------------------------------------------------------- blocks
class Layout:
    """Where the parts of a moment vector lie: Gram blocks, right-hand sides and cross blocks of one (cut, side)."""

    def __init__(self, q: int, rewards: int) -> None:
        self.q, self.rewards = q, rewards
        self.gram = 2 * q * q
        self.rhs = self.gram + 2 * q * rewards
        self.size = self.rhs + 4 * q * q

    def split(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram (... 2q x 2q), right-hand sides (... rewards x 2q) and cross matrix (... 2q x 2q)."""
        lead, q = v.shape[:-1], self.q
        gram, cross = np.zeros((*lead, 2 * q, 2 * q)), np.zeros((*lead, 2 * q, 2 * q))
        for a in (0, 1):
            rows = slice(a * q, (a + 1) * q)
            gram[..., rows, rows] = v[..., a * q * q:(a + 1) * q * q].reshape(*lead, q, q)
            for g in (0, 1):
                at = self.rhs + (2 * a + g) * q * q
                cross[..., rows, g * q:(g + 1) * q] = v[..., at:at + q * q].reshape(*lead, q, q)
        return gram, v[..., self.gram:self.rhs].reshape(*lead, self.rewards, 2 * q), cross


@dataclass
class Block:
    """Whole entities (or pieces of one) of a task: their rows, counts and moments as arrays."""

    eh: np.ndarray  # entities
    n: np.ndarray  # entities x cuts x 2
    owner: np.ndarray  # rows: position of the row's entity
    action: np.ndarray
    idx: np.ndarray
    phi: np.ndarray  # rows x q
    phin: np.ndarray
    m: np.ndarray  # entities x cuts x 2 x layout.size
    weights: np.ndarray | None = None  # draws x entities, where a table of weights was given


def _grouped(values: np.ndarray, key: np.ndarray, size: int) -> np.ndarray:
    """Sums of rows by key."""
    out = np.zeros((size, values.shape[1]))
    if len(key):
        order = np.argsort(key, kind="stable")
        k = key[order]
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out[k[at]] = np.add.reduceat(values[order], at, axis=0)
    return out


def _entity_moments(owner: np.ndarray, n: np.ndarray, a: np.ndarray, idx: np.ndarray, phi: np.ndarray, phin: np.ndarray, rewards: np.ndarray,
                    cuts: Sequence[int], ref: np.ndarray | None) -> np.ndarray:
    """entities x cuts x 2 x moments, means over the entity's rows on the side; ``ref`` gives the greedy policy of the cross blocks."""
    e, q = len(n), phi.shape[1]
    lay = Layout(q, rewards.shape[1])
    own = (phi[:, :, None] * phi[:, None, :]).reshape(len(a), -1)
    nxt = (phi[:, :, None] * phin[:, None, :]).reshape(len(a), -1)
    rhs = (rewards[:, :, None] * phi[:, None, :]).reshape(len(a), -1)
    out = np.zeros((e, len(cuts), 2, lay.size))
    for j, cut in enumerate(cuts):
        side = (idx >= cut).astype(int)
        if ref is None:
            greedy = np.zeros(len(a), int)
        else:
            step = ref[j, side, q:] - ref[j, side, :q]
            greedy = ((step * phin).sum(axis=1) > 0).astype(int)
        key = (owner * 2 + side) * 2 + a
        out[:, j, :, :lay.gram] = _grouped(own, key, 4 * e).reshape(e, 2, -1)
        r = _grouped(rhs, key, 4 * e).reshape(e, 2, 2, lay.rewards, q)
        out[:, j, :, lay.gram:lay.rhs] = r.transpose(0, 1, 3, 2, 4).reshape(e, 2, -1)
        out[:, j, :, lay.rhs:] = _grouped(nxt, key * 2 + greedy, 8 * e).reshape(e, 2, -1)
    return out / np.maximum(n, 1.0)[..., None]


def partitions(d: Design) -> int:
    """Tasks for work on all rows: four a core, so that they end together, of two and a half stretches of rows at least and a million rows at most."""
    rows = int(d.transitions[0].sum()) if len(d.transitions) else 0
    return max(1, min(4 * d.rows.sparkSession.sparkContext.defaultParallelism, rows // (5 * STRETCH // 2)), rows // 1_000_000)


def entity_blocks(d: Design, rewards: Sequence[str], ref: np.ndarray | None = None, summed: bool = False) -> DataFrame:
    """The moment table: one row per (block of entities) with every entity's Gram, right-hand-side and cross blocks by (cut, side, action).

    One scan of the rows, dealt by (entity, stretch of time) so that no entity needs to fit into a task. ``ref`` (cuts x 2 x 2q)
    is the policy the cross blocks follow; later passes only add what flips against it. The table is written once and read by
    every pass. ``summed`` keeps the sums of a block's rows in place of every entity's moments, for fits that only need sums; rows
    then stay where they are.
    """
    cuts, q = d.cuts, d.q
    lay = Layout(q, len(rewards))
    size = min(BLOCK_VALUES, BLOCK_DOUBLES)
    most = max(1, size // (2 * len(cuts) * lay.size))
    long = max(1, min(2 * STRETCH, size // (2 * q)))
    stretch = F.floor(F.col("idx") / STRETCH)
    rows = d.rows.select("entity_id", "ehash", "idx", "action", "state", "next_state", "n_left", "n_right", *rewards)
    kind = d.rows.schema["entity_id"].dataType.simpleString()

    def block(pdf: pd.DataFrame, first: np.ndarray) -> dict:
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pdf))))
        head = pdf.iloc[first]
        n = np.ones((1, len(cuts), 2)) if summed else np.stack([_matrix(head["n_left"]), _matrix(head["n_right"])], axis=-1)
        one = np.ones((len(pdf), 1))
        phi, phin = np.hstack([one, _matrix(pdf["state"])]), np.hstack([one, _matrix(pdf["next_state"])])
        a, idx = pdf["action"].to_numpy(int), pdf["idx"].to_numpy(int)
        m = _entity_moments(owner, n, a, idx, phi, phin, pdf[list(rewards)].to_numpy(float), cuts, ref)
        split = np.zeros(1, bool) if summed else np.bincount(owner, minlength=len(n)) != n[:, 0].sum(axis=-1)
        out = {"ids": head["entity_id"].tolist(), "split": bool(split.any()), "eh": head["ehash"].to_numpy(np.int64).tobytes(), "n": n.tobytes(),
               "owner": owner.astype(np.int32).tobytes(), "x": np.hstack([a[:, None], idx[:, None], phi[:, 1:], phin[:, 1:]]).astype(float).tobytes(), "m": m.tobytes(), "block": uuid.uuid4().hex}
        return out

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            e = rest["entity_id"].to_numpy()
            if summed:
                for at in range(0, len(rest), long):
                    yield pd.DataFrame([block(rest.iloc[at:at + long], np.zeros(1, int))])
                rest = None
                continue
            first = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]])) if len(e) else np.zeros(0, int)
            while len(first) > most or len(rest) > 2 * long and len(first) > 1:
                take = min(most, len(first) - 1, max(1, int(np.searchsorted(first, long))))
                yield pd.DataFrame([block(rest.iloc[: first[take]], first[:take])])
                rest, first = rest.iloc[first[take]:].reset_index(drop=True), first[take:] - first[take]
        if rest is not None and len(rest):
            yield pd.DataFrame([block(rest, first)])

    schema = f"ids array<{kind}>, split boolean, eh binary, n binary, owner binary, x binary, m binary, block string"
    dealt = rows if summed else rows.repartition(partitions(d), F.col("entity_id"), stretch).sortWithinPartitions("entity_id")
    return materialise(dealt.mapInPandas(task, schema), "entity-blocks", **SMALL_GROUPS)


def weighted_blocks(blocks: DataFrame, weights: DataFrame) -> DataFrame:
    """The moment table with ``w``, every block's entities x draws of a table (entity_id, w array); only weights are shuffled."""
    each = blocks.select("block", F.posexplode("ids").alias("at", "entity_id")).join(weights, "entity_id")
    packed = each.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda c: c["w"]).alias("w"))
    return materialise(blocks.join(packed, "block"), "weighted-blocks", **SMALL_GROUPS)


def read_block(row, cuts: int, q: int, lay: Layout, moments: bool = True) -> Block:
    eh = np.frombuffer(row.eh, np.int64)
    x = np.frombuffer(row.x).reshape(-1, 2 * q)
    one = np.ones((len(x), 1))
    w = getattr(row, "w", None)
    return Block(eh, np.frombuffer(row.n).reshape(len(eh), cuts, 2), np.frombuffer(row.owner, np.int32), x[:, 0].astype(int), x[:, 1].astype(int),
                 np.hstack([one, x[:, 2:q + 1]]), np.hstack([one, x[:, q + 1:]]),
                 np.frombuffer(row.m).reshape(len(eh), cuts, 2, lay.size) if moments else None,
                 None if w is None else np.vstack(w).T)


def _part(b: Block, start: int, end: int) -> Block:
    """Entities ``start`` to ``end`` of a block whose rows lie by entity."""
    lo, hi = np.searchsorted(b.owner, [start, end])
    return Block(b.eh[start:end], b.n[start:end], b.owner[lo:hi] - start, b.action[lo:hi], b.idx[lo:hi], b.phi[lo:hi], b.phin[lo:hi],
                 b.m[start:end], None if b.weights is None else b.weights[:, start:end])


@dataclass(frozen=True)
class Pass:
    """Everything a pass over the moment table needs besides coefficients."""

    blocks: DataFrame
    cuts: tuple[int, ...]
    lay: Layout
    rule: FitRule
    rnd: Randomness
    ids: np.ndarray
    ref: np.ndarray | None  # cuts x 2 x 2q
    summed: bool = False  # the table has sums of blocks, not moments of entities

    def __getstate__(self) -> dict:
        """What a task gets: all but the tables."""
        return {**self.__dict__, "blocks": None, "rnd": replace(self.rnd, table=None)}

    def draw_weights(self, b: Block) -> np.ndarray | None:
        """draws x entities of the block, where draws weigh entities or multiply their residuals."""
        if self.rnd.kind == "none":
            return None
        if b.weights is not None:
            return b.weights[self.ids]
        return _entity_weights(self.rnd, self.ids, b.eh)

    def flips(self, b: Block, beta: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(cut, side, rows, draws x rows signs, draws x rows margins) of rows whose greedy action differs from the reference.

        A row cannot flip while its reference margin exceeds the length of its features times the largest move of a
        draw's coefficients; all others are not looked at. The sign is +1 where action 1 becomes greedy.
        """
        q = self.lay.q
        length = np.sqrt((b.phin ** 2).sum(axis=1)) if self.ref is not None else None
        for j, cut in enumerate(self.cuts):
            right = b.idx >= cut
            for s in (0, 1):
                rows = np.flatnonzero(right == (s == 1))
                step = beta[:, j, s, q:] - beta[:, j, s, :q]
                if self.ref is None:
                    was = np.zeros(len(rows), bool)
                else:
                    old = self.ref[j, s, q:] - self.ref[j, s, :q]
                    margin = b.phin[rows] @ old
                    reach = np.sqrt(((step - old) ** 2).sum(axis=1)).max() * (1 + 1e-9) + 1e-12
                    near = np.abs(margin) <= reach * length[rows]
                    rows, was = rows[near], margin[near] > 0
                if not len(rows):
                    continue
                now = step @ b.phin[rows].T
                flipped = (now > 0) != was[None, :]
                some = flipped.any(axis=0)
                if some.any():
                    yield j, s, rows[some], flipped[:, some] * np.where(was[some], -1.0, 1.0)[None, :], np.abs(now[:, some])


def _each_block(p: Pass, columns: Sequence[str], work, moments: bool = True) -> DataFrame:
    """``work(block)`` summed over the blocks of a task: arrays with one row per draw."""
    cuts, lay = len(p.cuts), p.lay
    columns = [*columns, *(["w"] if "w" in p.blocks.columns else [])]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                got = work(read_block(row, cuts, lay.q, lay, moments))
                total = got if total is None else total + got
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype="int32"), "v": list(total)})

    return p.blocks.select(*columns).mapInPandas(task, "i int, v array<double>")


def draw_sums(p: Pass) -> DataFrame:
    """Per draw the weighted sum of the entities' moments (cuts x 2 x [Gram, right-hand side, cross]), one row a draw."""
    lay = p.lay

    def work(b: Block) -> np.ndarray:
        w = p.draw_weights(b)
        flat = (b.m if p.rule.estimator == "balanced" else b.m * b.n[..., None]).reshape(len(b.eh), -1)
        if p.rnd.kind == "weight":
            return w @ flat
        total = np.broadcast_to(flat.sum(axis=0), (len(p.ids), flat.shape[1])).reshape(len(p.ids), -1, lay.size)
        if p.rnd.kind == "none":
            return total.reshape(len(p.ids), -1)
        g, r = lay.gram, 2 * lay.q  # base rewards, then residuals that the draws multiply
        moved = np.einsum("be,ecv->bcv", w, flat.reshape(len(b.eh), -1, lay.size)[..., g + r:g + 2 * r], optimize=True)
        return np.concatenate([total[..., :g], total[..., g:g + r] + moved, total[..., lay.rhs:]], axis=-1).reshape(len(p.ids), -1)

    return materialise(sum_arrays(_each_block(p, ["eh", "n", "owner", "x", "m"], work), ["i"], "v"), "draw-sums")


def _flip_sums(p: Pass, beta: np.ndarray) -> DataFrame:
    """Per draw what the flipped rows move from one cross block to the other: cuts x 2 x 2 actions x q x q."""
    q, c = p.lay.q, len(p.cuts)

    def work(b: Block) -> np.ndarray:
        out = np.zeros((len(p.ids), c, 2, 2, q * q))
        w = p.draw_weights(b) if p.rnd.kind == "weight" else None
        for j, s, rows, sign, _ in p.flips(b, beta):
            v = sign / b.n[b.owner[rows], j, s][None, :] if p.rule.estimator == "balanced" else sign
            if w is not None:
                v = v * w[:, b.owner[rows]]
            outer = (b.phi[rows][:, :, None] * b.phin[rows][:, None, :]).reshape(-1, q * q)
            for a in (0, 1):
                mine = b.action[rows] == a
                if mine.any():
                    out[:, j, s, a] += v[:, mine] @ outer[mine]
        return out.reshape(len(p.ids), -1)

    return _each_block(p, ["eh", "n", "owner", "x"], work, moments=False)


def _system(p: Pass, sums: np.ndarray, moved: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Gram, right-hand side, cross matrix and weight totals of one draw, scaled by its total weight on each side."""
    q, c = p.lay.q, len(p.cuts)
    gram, rhs, cross = Layout(q, 1).split(sums.reshape(c, 2, -1))
    total = gram[..., 0, 0] + gram[..., q, q]
    if moved is not None:
        d = moved.reshape(c, 2, 2, q, q)
        for a in (0, 1):
            rows = slice(a * q, (a + 1) * q)
            cross[..., rows, q:] += d[:, :, a]
            cross[..., rows, :q] -= d[:, :, a]
    if p.rule.estimator == "sums":
        k = np.ones_like(total)
    else:
        k = np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)
    return gram * k[..., None, None], rhs[..., 0, :] * k[..., None], cross * k[..., None, None], total


def _solve(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.solve(a, y[..., None])[..., 0]


def _step(p: Pass, sums: DataFrame, state: dict, number: int, last: bool) -> list:
    """One job: flipped rows, their sums by draw, and every draw's small systems solved where its sums are.

    Returns (i, values) per draw: next coefficients, sizes of the fitted-Q update and whether it was accepted; in the last pass the systems.
    """
    beta, done, rule = state["beta"], state["done"], p.rule

    def solve(i: int, s: np.ndarray, moved: np.ndarray | None) -> np.ndarray:
        gram, rhs, cross, total = _system(p, s, moved)
        if last:
            return np.concatenate([x.ravel() for x in (gram, rhs, cross, total)])
        hess, b = gram + rule.alpha * np.eye(gram.shape[-1]), beta[i]
        update = _solve(hess, rhs + rule.gamma * (cross @ b[..., None])[..., 0])
        size = np.linalg.norm(update - b, axis=-1)
        fresh = ~done[i] & (size <= rule.tolerance)
        jump = rule.solver == "policy" and number <= rule.policy_passes
        target = _solve(hess - rule.gamma * cross, rhs) if jump else update
        new = np.where(done[i][..., None], b, np.where(fresh[..., None], update, target))
        return np.concatenate([new.ravel(), size.ravel(), (fresh | done[i]).astype(float).ravel()])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, s, moved = None, None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.i != i:
                    if i is not None:
                        yield pd.DataFrame({"i": [i], "v": [solve(i, s, moved)]})
                    i, s, moved = r.i, r.v, None  # the sums come first
                else:
                    moved = r.v if moved is None else moved + r.v
        if i is not None:
            yield pd.DataFrame({"i": [i], "v": [solve(i, s, moved)]})

    flips = _flip_sums(p, beta)
    both = sums.select("i", F.lit(0).alias("kind"), "v").unionByName(flips.select("i", F.lit(1).alias("kind"), "v"))
    return both.repartition("i").sortWithinPartitions("i", "kind").mapInPandas(task, "i int, v array<double>").collect()


def _systems(p: Pass, sums: DataFrame, state: dict) -> tuple[np.ndarray, ...]:
    """Gram, right-hand side, cross matrix and weight totals of every draw under the policy of its coefficients."""
    n, c, dim = len(p.ids), len(p.cuts), 2 * p.lay.q
    out = tuple(np.zeros((n, c, 2, *shape)) for shape in ((dim, dim), (dim,), (dim, dim), ()))
    for r in _step(p, sums, state, 0, last=True):
        for x, v in zip(out, np.split(np.asarray(r["v"]), np.cumsum([x[0].size for x in out[:-1]]))):
            x[r["i"]] = v.reshape(x.shape[1:])
    return out


def _score_means(models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean of the entities' scores on each side and the weight totals; from the sums, without another look at the entities.

    Scores weigh entities alike whatever the fit does, so a fit that does not takes its sums once more.
    """
    p, beta = models.extra["pass"], models.beta
    gram, rhs, cross, totals = (models.extra[k] for k in ("gram", "rhs", "cross", "totals"))
    if p.rule.estimator != "balanced":
        p = replace(p, rule=replace(p.rule, estimator="balanced"))
        gram, rhs, cross, totals = _systems(p, draw_sums(p), {"beta": beta, "done": models.converged})
    return rhs - (gram @ beta[..., None])[..., 0] + p.rule.gamma * (cross @ beta[..., None])[..., 0], totals


def _pass(d: Design, rule: FitRule, rnd: Randomness, ids: Sequence[int], ref: np.ndarray | None, summed: bool = False) -> Pass:
    rewards = ("base_reward", "residual") if rnd.kind == "reward" else ("reward",)
    if summed and (rule.estimator != "sums" or rnd.kind != "none"):
        raise ValueError("only plain sums do without the moments of entities")
    key = (rewards, None if ref is None else ref.tobytes(), summed)
    if key not in d.cache:
        d.cache[key] = entity_blocks(d, rewards, ref, summed)
    if rnd.table is not None and (*key, rnd.table) not in d.cache:
        d.cache[*key, rnd.table] = weighted_blocks(d.cache[key], rnd.table)
    return Pass(d.cache[key if rnd.table is None else (*key, rnd.table)], d.cuts, Layout(d.q, len(rewards)), rule, rnd, np.asarray(ids, dtype=int), ref, summed)


def draws_per_block(d: Design) -> int:
    """How many draws go through a pass together: bounds the arrays of a task and the systems on the driver."""
    return max(1, min(256, BLOCK_DOUBLES // (2 * len(d.cuts) * Layout(d.q, 2).size)))


def fit(d: Design, rule: FitRule = FitRule(), rnd: Randomness = Randomness(), draws: Sequence[int] | None = None, start: np.ndarray | None = None,
        summed: bool = False) -> Models:
    """All (draw, cut, side) models of at most a block of draws.

    ``fixed_point`` repeats the fitted-Q update from zero and defines the answer; ``policy`` solves the linear system of the current greedy
    policy in each pass and accepts a solution only when the fitted-Q update leaves it unchanged to the tolerance, falling
    back to plain updates otherwise. ``start`` (cuts x 2 x 2q, such as the observed coefficients) gives draws their first coefficients and the
    policy against which flipped rows are added; without it both are zero. ``summed`` keeps no entity's moments, for a fit by sums
    whose coefficients alone are wanted: it has no contributions.
    """
    ids = list(draws if draws is not None else [0])
    p = _pass(d, rule, rnd, ids, start, summed)
    q, c, n = d.q, len(d.cuts), len(ids)
    lead, dim = (n, c, 2), 2 * d.q
    sums = draw_sums(p)
    state = {"beta": np.zeros((*lead, dim)) if start is None else np.repeat(start[None], n, axis=0), "done": np.zeros(lead, bool)}
    iterations, delta = np.full(lead, rule.max_iterations), np.full(lead, np.inf)
    for number in range(1, rule.max_iterations + 1):
        was = state["done"].copy()
        beta = state["beta"].copy()
        for r in _step(p, sums, state, number, last=False):
            v = np.asarray(r["v"])
            beta[r["i"]] = v[: c * 2 * dim].reshape(c, 2, dim)
            size, done = v[c * 2 * dim:].reshape(2, c, 2)
            delta[r["i"]] = np.where(was[r["i"]], delta[r["i"]], size)
            state["done"][r["i"]] = done > 0
        state["beta"] = beta
        iterations[state["done"] & ~was] = number
        if state["done"].all():
            break
    gram, rhs, cross, totals = _systems(p, sums, state)
    if rnd.kind == "weight" and np.any(totals <= 0):
        raise ValueError("a bootstrap draw has zero total entity weight on a side")
    hess = gram + rule.alpha * np.eye(dim)
    return Models(state["beta"], hess - rule.gamma * cross, hess, state["done"], iterations, delta, totals if rnd.kind == "weight" else None,
                  {"ids": np.asarray(ids), "gram": gram, "rhs": rhs, "cross": cross, "totals": totals, "pass": p})


# ------------------------------------------------------------------------ influences
def _scores(p: Pass, b: Block, beta: np.ndarray) -> np.ndarray:
    """cuts x 2 x entities x 2q x draws: mean score vectors, linear in the entity's moments but for the flipped rows."""
    e, c, q, n, gamma = len(b.eh), len(p.cuts), p.lay.q, len(p.ids), p.rule.gamma
    gram, rhs, cross = p.lay.split(b.m)
    lin = (gamma * cross - gram).transpose(1, 2, 0, 3, 4).reshape(c, 2, e * 2 * q, 2 * q)
    out = np.matmul(lin, beta.transpose(1, 2, 3, 0)).reshape(c, 2, e, 2 * q, n)
    if p.rnd.kind == "reward":
        xi = p.draw_weights(b)
        out += rhs[..., 0, :].transpose(1, 2, 0, 3)[..., None] + rhs[..., 1, :].transpose(1, 2, 0, 3)[..., None] * xi.T[None, None, :, None, :]
    else:
        out += rhs[..., 0, :].transpose(1, 2, 0, 3)[..., None]
    for j, s, rows, sign, margin in p.flips(b, beta):
        v = (gamma * np.abs(sign) * margin / b.n[b.owner[rows], j, s][None, :]).T
        for a in (0, 1):
            mine = b.action[rows] == a
            if mine.any():
                np.add.at(out[j, s], (b.owner[rows[mine]], slice(a * q, (a + 1) * q)), b.phi[rows[mine]][:, :, None] * v[mine][:, None, :])
    return out


def _coefficients(p: Pass, n: np.ndarray, w: np.ndarray | None, scores: np.ndarray, mean: np.ndarray, totals: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """draws x cuts x entities x 2q: signed union of both sides' influences from entity scores (cuts x 2 x entities x 2q x draws)."""
    there = (n > 0).transpose(1, 2, 0)
    total = totals.transpose(1, 2, 0)  # cuts x 2 x draws
    share = np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)[:, :, None, :]
    share = share * (w.T[None, None] if p.rnd.kind == "weight" else 1.0) * there[..., None]
    centred = (scores - mean.transpose(1, 2, 3, 0)[:, :, None]) * share[:, :, :, None, :]
    eta = np.matmul(centred.transpose(4, 0, 1, 2, 3), inverse.transpose(0, 1, 2, 4, 3))
    return eta[:, :, 0] - eta[:, :, 1]


def _entity_scores(p: Pass, beta: np.ndarray, kind: str) -> DataFrame:
    """(entity_id, ehash, n, v): scores of every entity, pieces of split entities added up."""
    c, lay = len(p.cuts), p.lay

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                b = read_block(row, c, lay.q, lay)
                v = _scores(p, b, beta).transpose(2, 0, 1, 3, 4).reshape(len(b.eh), -1)
                w = b.weights.T if b.weights is not None else np.zeros((len(b.eh), 0))
                yield pd.DataFrame({"entity_id": list(row.ids), "ehash": b.eh, "n": list(b.n.reshape(len(b.eh), -1)), "v": list(v), "w": list(w)})

    rows = p.blocks.mapInPandas(task, f"entity_id {kind}, ehash long, n array<double>, v array<double>, w array<double>")
    if p.blocks.where("split").isEmpty():
        return rows
    sums = sum_arrays(rows.select("entity_id", "v"), ["entity_id"], "v", lanes=0)
    return rows.groupBy("entity_id").agg(F.first("ehash").alias("ehash"), F.first("n").alias("n"), F.first("w").alias("w")).join(sums, "entity_id")


def _per_entity(p: Pass, models: Models, kind: str, work, schema: str) -> DataFrame:
    """``work(ids, n, coefficients)`` per block of entities; coefficients are draws x cuts x entities x 2q."""
    c, lay, beta = len(p.cuts), p.lay, models.beta
    if p.summed:
        raise ValueError("a summed fit has no contributions of entities")
    known = (*_score_means(models), np.linalg.inv(models.W))
    some = max(1, 4 * BLOCK_VALUES // (len(p.ids) * c * 4 * lay.q))  # entities whose scores under all draws are held at once

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                whole_block, ids = read_block(row, c, lay.q, lay), list(row.ids)
                for at in range(0, len(ids), some):
                    b = _part(whole_block, at, at + some)
                    coef = _coefficients(p, b.n, p.draw_weights(b), _scores(p, b, beta), *known)
                    yield work(ids[at:at + some], b.n, coef)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), some):
                part = pdf.iloc[at:at + some]
                n = _matrix(part["n"]).reshape(len(part), c, 2)
                b = Block(part["ehash"].to_numpy(np.int64), n, None, None, None, None, None, None, _matrix(part["w"]).T if len(part["w"].iloc[0]) else None)
                scores = _matrix(part["v"]).reshape(len(part), c, 2, 2 * lay.q, -1).transpose(1, 2, 0, 3, 4)
                yield work(part["entity_id"].tolist(), n, _coefficients(p, n, p.draw_weights(b), scores, *known))

    if p.blocks.where("split").isEmpty():
        return p.blocks.mapInPandas(whole, schema)
    return _entity_scores(p, beta, kind).mapInPandas(pieces, schema)


def contributions(d: Design, rule: FitRule, models: Models, z_design: np.ndarray, rnd: Randomness = Randomness()) -> DataFrame:
    """Signed union of left and right influences: ``delta`` is flattened draws x cuts x z per entity."""
    kind = d.rows.schema["entity_id"].dataType.simpleString()

    def work(ids: list, n: np.ndarray, coef: np.ndarray) -> pd.DataFrame:
        delta = (coef @ z_design.T).transpose(2, 0, 1, 3)
        return pd.DataFrame({"entity_id": ids, "active": [x.any(axis=-1) for x in n > 0], "delta": [x.ravel() for x in delta]})

    return _per_entity(models.extra["pass"], models, kind, work, f"entity_id {kind}, active array<boolean>, delta array<double>")


def influence_moments(d: Design, models: Models) -> DataFrame:
    """Per draw the second moments of the entities' influence coefficients (cuts x 2q x 2q), one row a draw.

    The variance at any evaluation point z is a quadratic form in them, so no draw's contributions are ever written.
    """
    kind = d.rows.schema["entity_id"].dataType.simpleString()

    def work(ids: list, n: np.ndarray, coef: np.ndarray) -> pd.DataFrame:
        v = np.matmul(coef.transpose(0, 1, 3, 2), coef)
        return pd.DataFrame({"i": np.arange(len(v), dtype="int32"), "v": list(v.reshape(len(v), -1))})

    return sum_arrays(_per_entity(models.extra["pass"], models, kind, work, "i int, v array<double>"), ["i"], "v")


# ------------------------------------------------------------------------ leave one out
@dataclass(frozen=True)
class _Near:
    """Rows near a policy border of one (cut, side), as arrays."""

    eh: np.ndarray
    action: np.ndarray
    weight: np.ndarray
    was: np.ndarray
    phi: np.ndarray
    phin: np.ndarray


def _near_rows(p: Pass, cover: np.ndarray) -> DataFrame:
    """(j, s, eh, v) of rows whose reference margin is at most ``cover`` (cuts x 2) times the length of their features."""
    c, q = len(p.cuts), p.lay.q

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                b = read_block(row, c, q, p.lay, moments=False)
                length = np.sqrt((b.phin ** 2).sum(axis=1))
                for j, cut in enumerate(p.cuts):
                    for s in (0, 1):
                        margin = b.phin @ (p.ref[j, s, q:] - p.ref[j, s, :q])
                        at = np.flatnonzero(((b.idx >= cut) == (s == 1)) & (np.abs(margin) <= cover[j, s] * length))
                        if len(at):
                            w = 1.0 / b.n[b.owner[at], j, s] if p.rule.estimator == "balanced" else np.ones(len(at))
                            v = np.column_stack([b.action[at], w, margin[at] > 0, b.phi[at], b.phin[at]])
                            yield pd.DataFrame({"j": j, "s": s, "eh": b.eh[b.owner[at]], "v": list(v)})

    return materialise(p.blocks.select("eh", "n", "owner", "x").mapInPandas(task, "j int, s int, eh long, v array<double>"), "near-rows")


def _slices(near: DataFrame, q: int) -> Iterator[tuple[dict, bool]]:
    """The near rows by (cut, side), in slices of a bounded size (nearly always a single one), and whether it is the last."""
    most = BLOCK_DOUBLES // (2 * q + 4)
    count = near.count()
    n = max(1, -(-count // most))
    for k in range(n):
        part = near if n == 1 else near.where(F.pmod(F.xxhash64("eh", "j", "s", "v"), F.lit(n)) == k)
        pdf = part.toPandas()
        out = {}
        for (j, s), g in pdf.groupby(["j", "s"]):
            v = _matrix(g["v"])
            out[int(j), int(s)] = _Near(g["eh"].to_numpy(np.int64), v[:, 0], v[:, 1], v[:, 2] > 0, v[:, 3:3 + q], v[:, 3 + q:])
        yield out, k == n - 1


def leave_one_out(d: Design, rule: FitRule, models: Models, z_design: np.ndarray, passes: int = 40) -> DataFrame:
    """(entity_id, candidate, value): contrasts at ``z_design`` of the models refitted without each entity, NULL where a side is then empty."""
    return by_candidate(leave_one_out_vectors(d, rule, models, z_design, passes), d.cuts, len(z_design))


def by_candidate(vectors: DataFrame, cuts: Sequence[int], n_z: int) -> DataFrame:
    """(entity_id, candidate, value) rows of vectors over cuts x points; NULL where the vector has none for the cut."""
    parts = F.array(*[F.struct(F.lit(int(c)).cast("long").alias("candidate"), F.when(F.get("value", F.lit(j * n_z)).isNotNull(), F.slice("value", j * n_z + 1, n_z)).alias("value"))
                      for j, c in enumerate(cuts)])
    return vectors.select("entity_id", F.explode(parts).alias("p")).select("entity_id", "p.*")


def leave_one_out_vectors(d: Design, rule: FitRule, models: Models, z_design: np.ndarray, passes: int = 40) -> DataFrame:
    """(entity_id, value): the same contrasts as one vector over cuts x points, with NULL elements where a side is then empty.

    An entity's moments are taken out of the observed sums where they lie, and its small systems are solved there. What its removal
    flips in other entities' rows is added from the few rows near a policy border: they are found by the largest move of any
    coefficients, sent to the tasks in slices of a bounded size, and found again if a later move is larger.
    """
    p = _pass(d, rule, Randomness(), [0], models.beta[0])
    c, q, lay, dim = len(p.cuts), p.lay.q, p.lay, 2 * p.lay.q
    gram, rhs, cross, totals = (models.extra[k][0] for k in ("gram", "rhs", "cross", "totals"))
    k = totals if rule.estimator != "sums" else np.ones_like(totals)
    gram, rhs, cross = gram * k[..., None, None], rhs * k[..., None], cross * k[..., None, None]
    ref, eye, kind = p.ref, np.eye(dim), d.rows.schema["entity_id"].dataType.simpleString()

    def systems(eh_n_m: Block) -> tuple[np.ndarray, ...]:
        g, r, x = lay.split(eh_n_m.m)
        w = (eh_n_m.n > 0).astype(float) if rule.estimator == "balanced" else eh_n_m.n
        left = totals[None] - w
        scale = np.ones_like(left) if rule.estimator == "sums" else np.divide(1.0, left, out=np.zeros_like(left), where=left > 1e-9)
        return tuple((a[None] - w[..., *(None,) * (b.ndim - 3)] * b) * scale[..., *(None,) * (b.ndim - 3)] for a, b in (
            (gram, g), (rhs, r[..., 0, :]), (cross, x))) + (scale, left <= 1e-9)

    def moves(near: dict, b: Block, beta: np.ndarray) -> np.ndarray:
        """entities x cuts x 2 x 2 actions x q x q: what flips in rows of others."""
        out = np.zeros((len(b.eh), c, 2, 2, q * q))
        many = max(1, 4 * BLOCK_VALUES // max(len(b.eh), q * q))  # near rows compared with all entities of the block at once
        for (j, s), near_rows in near.items():
            for at in range(0, len(near_rows.eh), many):
                rows = _Near(*[getattr(near_rows, f.name)[at:at + many] for f in fields(_Near)])
                flip = ((beta[:, j, s, q:] - beta[:, j, s, :q]) @ rows.phin.T > 0) != rows.was[None, :]
                flip &= b.eh[:, None] != rows.eh[None, :]
                some = flip.any(axis=0)
                v = flip[:, some] * (np.where(rows.was[some], -1.0, 1.0) * rows.weight[some])[None, :]
                outer = (rows.phi[some][:, :, None] * rows.phin[some][:, None, :]).reshape(-1, q * q)
                for a in (0, 1):
                    mine = rows.action[some] == a
                    out[:, j, s, a] += v[:, mine] @ outer[mine]
        return out

    def step(b: Block, moved: np.ndarray, beta: np.ndarray, done: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        g, r, x, scale, empty = systems(b)
        m = moved.reshape(len(b.eh), c, 2, 2, q, q) * scale[..., None, None, None]
        for a in (0, 1):
            rows = slice(a * q, (a + 1) * q)
            x[..., rows, q:] += m[:, :, :, a]
            x[..., rows, :q] -= m[:, :, :, a]
        hess = g + rule.alpha * eye
        update = _solve(hess, r + rule.gamma * (x @ beta[..., None])[..., 0])
        fresh = ~done & ((np.linalg.norm(update - beta, axis=-1) <= rule.tolerance) | empty)
        target = _solve(hess - rule.gamma * x, r) if number <= rule.policy_passes and rule.solver == "policy" else update
        new = np.where(done[..., None], beta, np.where(fresh[..., None], update, target))
        return new, done | fresh

    def reach(beta: np.ndarray) -> np.ndarray:
        gap = (beta[..., q:] - beta[..., :q]) - (ref[..., q:] - ref[..., :q])[None]
        return np.sqrt((gap ** 2).sum(axis=-1))

    columns = ["ids", "eh", "n", "owner", "x", "m"]
    first = p.blocks.select(*columns) if p.blocks.where("split").isEmpty() else _joined_pieces(p, kind)
    state = first.withColumn("beta", F.lit(None).cast("binary")).withColumn("done", F.lit(None).cast("binary")).withColumn("moved", F.lit(None).cast("binary"))

    def arrays(row) -> tuple[Block, np.ndarray, np.ndarray]:
        b = read_block(row, c, q, lay)
        e = len(b.eh)
        beta = np.repeat(ref[None], e, axis=0) if row.beta is None else np.frombuffer(row.beta).reshape(e, c, 2, dim)
        done = np.zeros((e, c, 2), bool) if row.done is None else np.frombuffer(row.done, bool).reshape(e, c, 2)
        return b, beta, done

    def mapped(df: DataFrame, work) -> DataFrame:
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    b, beta, done = arrays(row)
                    yield pd.DataFrame([{**row._asdict(), **{k: v.tobytes() for k, v in work(row, b, beta, done).items()}}])

        return df.mapInPandas(task, df.schema)

    def advance(near: dict, number: int, whole: bool):
        def work(row, b: Block, beta: np.ndarray, done: np.ndarray) -> dict:
            moved = moves(near, b, beta)
            if row.moved is not None:
                moved += np.frombuffer(row.moved).reshape(moved.shape)
            if not whole:
                return {"moved": moved}
            for i in range(number, number + (passes if row.moved is None else 1)):  # all near rows are here: go on to the end
                beta, done = step(b, moved, beta, done, i)
                if done.all() or row.moved is not None:
                    break
                moved = moves(near, b, beta)
            return {"beta": beta, "done": done, "moved": np.zeros(0)}

        return work

    def summary(df: DataFrame) -> tuple[np.ndarray, bool]:
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top, ready = np.zeros((c, 2)), True
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    _, beta, done = arrays(row)
                    top, ready = np.maximum(top, reach(beta).max(axis=0)), ready and bool(done.all())
            yield pd.DataFrame({"ready": [ready], "top": [top.ravel()]})

        r = df.mapInPandas(task, "ready boolean, top array<double>").agg(
            F.every("ready").alias("ready"), *[F.max(F.col("top")[i]).alias(f"t{i}") for i in range(2 * c)]).first()
        return np.array([r[f"t{i}"] for i in range(2 * c)]).reshape(c, 2), bool(r["ready"])

    def only(row, b: Block, beta: np.ndarray, done: np.ndarray) -> dict:
        return {"beta": step(b, np.zeros((len(b.eh), c, 2, 2, q * q)), beta, done, 1)[0]}

    cover = 2.0 * summary(mapped(state, only))[0] + 1e-9
    number = 1
    while True:
        current = state
        for near, last in _slices(_near_rows(p, cover), q):
            current = materialise(mapped(current, advance(near, number, last)).withColumn("moved", F.lit(None).cast("binary") if last else F.col("moved")), "leave-one-out")
        top, ready = summary(current)
        if (top > cover).any():
            cover = np.maximum(cover, 2.0 * top)  # rows beyond the old cover may have flipped: once more with more of them
            continue
        state, number = current, number + 1
        if ready or number > passes:
            break

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                b, beta, _ = arrays(row)
                w = (b.n > 0).astype(float) if rule.estimator == "balanced" else b.n
                v = (beta[:, :, 0] - beta[:, :, 1]) @ z_design.T
                v[((totals[None] - w) <= 1e-9).any(axis=-1)] = np.nan  # NULL in the table
                yield pd.DataFrame({"entity_id": list(row.ids), "value": list(v.reshape(len(b.eh), -1))})

    return state.mapInPandas(values, f"entity_id {kind}, value array<double>")


def _joined_pieces(p: Pass, kind: str) -> DataFrame:
    """Blocks of one entity each, the pieces of split entities added up; rows stay with the moment table."""
    c, lay = len(p.cuts), p.lay

    def apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                b = read_block(row, c, lay.q, lay)
                yield pd.DataFrame({"entity_id": list(row.ids), "eh": b.eh, "n": [x.tobytes() for x in b.n], "v": list(b.m.reshape(len(b.eh), -1))})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"ids": [[i] for i in pdf["entity_id"]], "eh": [np.int64(h).tobytes() for h in pdf["eh"]], "n": pdf["n"],
                                "owner": b"", "x": b"", "m": [np.asarray(v, dtype=float).tobytes() for v in pdf["v"]]})

    rows = materialise(p.blocks.mapInPandas(apart, f"entity_id {kind}, eh long, n binary, v array<double>"), "pieces")
    sums = sum_arrays(rows.select("entity_id", "v"), ["entity_id"], "v", lanes=0)
    whole = rows.groupBy("entity_id").agg(F.first("eh").alias("eh"), F.first("n").alias("n")).join(sums, "entity_id")
    return whole.mapInPandas(pack, f"ids array<{kind}>, eh binary, n binary, owner binary, x binary, m binary")


def process_table(d: Design, models: Models, contrib: DataFrame, z_design: np.ndarray) -> np.ndarray:
    """Cluster variance at every (draw, cut, z) from the contribution table, with the roundoff clamp."""
    shape = (len(models.beta), len(d.cuts), len(z_design))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sq, top = np.zeros(shape), np.zeros(shape[:2])
        for pdf in batches:
            if len(pdf):
                delta = _matrix(pdf["delta"]).reshape(len(pdf), *shape)
                sq += (delta ** 2).sum(axis=0)
                top = np.maximum(top, np.abs(delta).max(axis=(0, -1)))
        yield pd.DataFrame({"b": np.arange(shape[0]), "sq": list(sq.reshape(shape[0], -1)), "top": list(top)})

    parts = materialise(contrib.mapInPandas(task, "b long, sq array<double>, top array<double>"), "variance-parts")  # read twice
    tops = parts.groupBy("b").agg(*[F.max(F.col("top")[j]).alias(f"t{j}") for j in range(shape[1])]).collect()
    var, top = np.zeros(shape), np.zeros((*shape[:2], 1))
    for r in sum_arrays(parts.select("b", "sq"), ["b"], "sq").collect():
        var[r["b"]] = np.asarray(r["sq"]).reshape(shape[1:])
    for r in tops:
        top[r["b"], :, 0] = [r[f"t{j}"] for j in range(shape[1])]
    live = d.active[None, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        var = np.where(live > 1, live / (live - 1.0) * var, np.nan)
    var[var <= np.finfo(float).eps * np.maximum(1.0, top ** 2)] = 0.0
    return var


def action_design(states: np.ndarray, actions: np.ndarray) -> np.ndarray:
    """Action-block design vectors [(1, s) 1(a=0), (1, s) 1(a=1)]."""
    phi = np.hstack([np.ones((len(states), 1)), states])
    a = np.asarray(actions)[:, None]
    return np.hstack([phi * (a == 0), phi * (a == 1)])
