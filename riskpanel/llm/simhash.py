"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is 1 if more than half of the XXH64 hashes of a text's word shingles have it. Two fingerprints
link if at most ``radius`` bits differ. Equal fingerprints are folded first, so copies never meet as pairs.
Distinct fingerprints are cut into six bit fields; within four bits of each other, two fingerprints agree in at
least two fields, so each pair of fields gives a bucket key and no link is missed (a radius r uses r + 2
fields). Members of a bucket are compared in one task: candidate pairs become lanes, the bits in which they
differ are stored as vertical planes, carry-save counters add the planes for 64 lanes at a time, and a
block of lanes is abandoned as soon as every lane is beyond the radius. Buckets of more than ``BUCKET``
fingerprints are dealt into parts, and every two parts meet in a task of their own, so no task holds a whole hot
bucket. A task returns a spanning forest of the links it finds, not the links themselves; components come from
alternating large-star and small-star rounds over those edges.

Nulls: a null text has no words and fingerprint zero, linked like any other; a null id never is a smallest id
unless its component has no other. Repeated rows get a row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.text import add_struct, free_name
from riskpanel.session import materialise

SHINGLE, RADIUS, BUCKET, SEED = 4, 4, 2048, 42
LANES = 4096  # lanes in one block of the comparison
_CHUNK = 20_000  # shingles whose bits are unpacked at once


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(cols: list[pa.Array]) -> dict[str, pa.Array]:
    values = [fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in cols[0]]
    return {"bits": pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())}


def fields(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 bit fields; within the radius two of them at least agree."""
    edges = np.linspace(0, 64, radius + 3).astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def within(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each lane, whether x and y differ in at most ``radius`` bits."""
    out = np.zeros(len(x), bool)
    for lo in range(0, len(x), LANES):
        differ = x[lo : lo + LANES] ^ y[lo : lo + LANES]
        n = len(differ)
        planes = np.packbits(np.unpackbits(differ.view(np.uint8).reshape(n, 8), axis=1).T, axis=1)
        planes = np.ascontiguousarray(np.pad(planes, ((0, 0), (0, -planes.shape[1] % 8)))).view(np.uint64)
        out[lo : lo + n] = np.unpackbits((~_beyond(planes, radius)).view(np.uint8))[:n].astype(bool)
    return out


def _beyond(planes: np.ndarray, radius: int) -> np.ndarray:
    """Lanes with more than ``radius`` set planes: counters of vertical bits that never fall once past the radius."""
    width = radius.bit_length() + 1
    counter = [np.zeros(planes.shape[1], np.uint64) for _ in range(width)]
    dead = np.zeros(planes.shape[1], np.uint64)
    for p in range(0, len(planes), 4):
        a, b, c, d = planes[p : p + 4]
        half = a ^ b  # carry-save: four planes become a one, two twos and, rarely, a four
        one, two = half ^ c, (a & b) | (half & c)
        carry = one & d
        one, more = one ^ d, two & carry
        two = two ^ carry
        for level, carry in ((0, one), (1, two), (2, more)):
            for k in range(level, width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            dead |= carry
        dead |= _greater(counter, radius)
        if (~dead == 0).all():
            break
    return dead


def _greater(counter: list[np.ndarray], limit: int) -> np.ndarray:
    more, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if limit >> k & 1:
            same &= counter[k]
        else:
            more |= same & counter[k]
            same &= ~counter[k]
    return more


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, for links a-b among n nodes."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _links(group: np.ndarray, part: np.ndarray, bits: np.ndarray, combo: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within runs of equal ``group``; members of the same part of a split bucket meet only in its own task."""
    n = len(bits)
    cuts = fields(radius)
    pairs = list(combinations(range(len(cuts)), 2))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    left, right, rows = [], [], np.arange(n)
    for step in range(1, n):
        rows = rows[rows + step < end[rows]]
        if not len(rows):
            break
        other = rows + step
        hit = within(bits[rows], bits[other], radius)
        if hit.any():
            left.append(rows[hit])
            right.append(other[hit])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    own = part[a] != part[b]
    same = bits[a] ^ bits[b]
    agree = [(same >> np.uint64(s)) & np.uint64((1 << w) - 1) == 0 for s, w in cuts]
    first = np.ones(len(a), bool)
    for p, q in pairs[:combo]:  # a pair is linked in the first bucket that holds both
        first &= ~(agree[p] & agree[q])
    keep = first & (own | (part[a] < 0))
    a, b = a[keep], b[keep]
    root = _forest(n, a, b)
    child = np.flatnonzero(root != np.arange(n))
    return bits[child], bits[root[child]]


def edges(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints (column ``bits``) within the radius."""
    cuts = fields(radius)
    pairs = list(combinations(range(len(cuts)), 2))

    def field(i: int):
        s, w = cuts[i]
        return F.shiftrightunsigned("bits", s).bitwiseAND(F.lit((1 << w) - 1))

    keys = F.array(*[F.struct(F.lit(c).alias("combo"), (F.shiftleft(field(p), cuts[q][1]).bitwiseOR(field(q))).alias("key")) for c, (p, q) in enumerate(pairs)])
    dealt = prints.select("bits", F.explode(keys).alias("k")).select("bits", "k.combo", "k.key")
    crowded = materialise(dealt.groupBy("combo", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
                          .select("combo", "key", F.ceil(F.col("n") / bucket).cast("int").alias("parts")), "simhash-crowded")
    met = dealt.join(crowded, ["combo", "key"], "left")
    mine = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    # part p of a split bucket goes to the tasks (p, q) of all q; alone it is task (p, p)
    tasks = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda q: F.least(mine, q).cast("long") * 2**31 + F.greatest(mine, q)))
    spread = met.select("combo", "key", F.explode(tasks).alias("task"), F.coalesce(mine, F.lit(-1)).alias("part"), "bits")
    group = F.xxhash64("combo", "key", "task")
    ready = spread.withColumn("g", group).repartition("g").sortWithinPartitions("g", "combo", "key", "task")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
            combo, part, task = (t.column(c).to_numpy() for c in ("combo", "part", "task"))
            bits, g = t.column("bits").to_numpy().view(np.uint64), t.column("g").to_numpy()
            alone = np.where(task >> 31 == task % 2**31, -1, part)  # one part with itself, or an unsplit bucket
            alone = np.where(task < 0, -1, alone)
            for c in np.unique(combo).tolist():
                at = combo == c
                a, b = _links(g[at], alone[at], bits[at], c, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            g = t.column("g").to_numpy()
            last = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on
            if last:
                yield from run(t.slice(0, last).combine_chunks())
            rest = t.slice(last).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from run(rest)

    return ready.mapInArrow(compare, "a long, b long")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): every node of the links and the least node it can reach; large-star and small-star in turn."""
    now = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "simhash-links")
    state = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = materialise(small, "simhash-links")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components still changed after {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint bits, component_id (the smallest doc_id reachable) and the component's root of every row."""
    rows, s = add_struct(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), [F.col("text")], _fingerprints, "bits long", keep=["doc_id"])
    rows = materialise(rows.select("doc_id", F.col(s)["bits"].alias("bits")), "simhash-rows")
    prints = materialise(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "simhash-prints")
    roots = components(edges(prints.select("bits"), radius, bucket))
    member = prints.join(roots, prints["bits"] == roots["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(member.join(least, "root").select("bits", "component_id", "root"), "simhash-named")
    return rows.join(named, "bits").select("doc_id", "bits", "component_id", "root")


def report(docs: DataFrame, **options) -> DataFrame:
    found = near_duplicates(docs, **options)
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component, that with the smallest id; of its rows in one component one stays.

    Ids with rows in several components are told apart by fingerprint. Rows without an id are in no component and stay.
    """
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col=id_col, **options)
    torn = found.groupBy("doc_id").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("doc_id")
    torn = materialise(torn, "simhash-torn")
    keeper = found.where("doc_id = component_id")
    flag, place = free_name(docs, "kept_id"), free_name(docs, "kept_root")
    held = docs.join(keeper.select("doc_id").distinct().join(torn, "doc_id", "left_anti").withColumnRenamed("doc_id", flag), F.col(id_col) == F.col(flag), "left_semi")
    rows = [F.col(f"`{c}`") for c in docs.columns]
    first = held.groupBy(F.col(id_col).alias(flag)).agg(F.min_by(F.struct(*rows), F.xxhash64(*rows)).alias("row")).select("row.*")
    apart, s = add_struct(docs.join(torn.withColumnRenamed("doc_id", flag), F.col(id_col) == F.col(flag), "left_semi"), [F.col(options.get("text_col", "text"))], _fingerprints, "bits long")
    apart = apart.select(F.struct(*rows).alias("row"), F.xxhash64(*rows).alias("draw"), F.col(id_col).alias(flag), F.col(s)["bits"].alias("kept_bits"))
    roots = keeper.join(torn, "doc_id", "left_semi").select(F.col("doc_id").alias("kept_doc"), "bits", F.col("root").alias(place)).distinct()
    each = apart.join(roots, (F.col(flag) == F.col("kept_doc")) & (F.col("kept_bits") == F.col("bits")))
    each = each.groupBy(flag, place).agg(F.min_by("row", "draw").alias("row")).select("row.*")
    return first.unionByName(each).unionByName(docs.where(F.col(id_col).isNull()))
