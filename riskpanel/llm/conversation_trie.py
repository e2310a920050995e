"""Prefix trie of rebuilt conversations by ROLLUP over positional turn-id columns.

A turn id is the SHA-256 of role and text with the number of code points behind it. A conversation is rows of ``BLOCK`` turn-id
columns. ``GROUP BY prior, ROLLUP (t0, ...)`` over the first row of every conversation aggregates all prefixes of up to
``BLOCK`` turns together, and ``grouping_id`` tells their depth; the next row of each conversation is keyed by ``prior``, the node at
which its last row ended, and so on. A conversation that is alone in its node leaves this loop: the rest of its path is
written down as it is. Subtrees are added up by a second ROLLUP over the nodes of a block, from the last block to the
first, each block handing its sums to the nodes it hangs from. Node keys are SHA-256 chains, so they need no numbering.

Turns are ordered by turn (null first), then role, then turn id; a null role or text is empty. Rows without a conversation
id are left out. Repeated rows are turns of their own; a conversation may be left without turns. An empty table gives
no rows. A conversation of any length is cut into ranges before its turns are numbered, groups are added up in the tasks
before they are shuffled, and parents with many children are broadcast (``hot``). SHA-256 runs over a node's ending ids in order, so
these are joined into strings of at most ``RUN`` ids and one task at a time streams the strings of a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskpanel.llm.hot import join_by_key
from riskpanel.session import materialise

BLOCK, FAMILY, HEADS = 8, 100, 6
RUN = 4096
T = [f"t{i}" for i in range(BLOCK)]
EMPTY = hashlib.sha256(b"").hexdigest()


def digest(*parts: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered(turns: DataFrame) -> DataFrame:
    """``pos`` of every turn in its conversation from 1, and ``n_own``, without a conversation in one task."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tid")]
    ranges = materialise(turns.repartitionByRange(F.col("conv"), *order, F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "trie-ranges")
    pieces = ranges.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))  # per conversation at most a row a range
    whole = Window.partitionBy("conv")
    pieces = pieces.select("conv", "part", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("ahead"), F.sum("n").over(whole).alias("n_own"))
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    return ranges.withColumn("inside", inside).join(pieces, ["conv", "part"]).select("conv", "tid", (F.col("inside") + F.col("ahead")).alias("pos"), "n_own")


def rebuilt(df: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, tid) of the rebuilt conversations, and (conv, size) of them all."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tid = F.concat(digest(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)), F.unhex(F.lpad(F.hex(F.char_length(text)), 16, "0")))
    turns = materialise(numbered(df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), tid.alias("tid"))), "trie-turns")
    head = (F.crc32(F.col("conv").cast("string")) % heads).cast("long")
    base = F.col("conv") - F.col("conv") % family
    convs = turns.where("pos = 1").select("conv", "n_own", head.alias("h"), base.alias("base"))
    roots = turns.where((F.col("conv") == base) & (F.col("pos") < heads)).select(F.col("conv").alias("base"), "pos", "tid", "n_own")
    found = roots.where("pos = 1").select("base", F.col("n_own").alias("n_base"))
    convs = materialise(convs.join(found, "base", "left").withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0)))).select(
        "conv", "h", "base", "lead", "n_own", (F.col("lead") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("size")), "trie-conversations")
    first = convs.join(roots.drop("n_own"), "base").where("pos <= h").select("conv", "pos", "tid")
    own = join_by_key(turns.where(F.col("pos") > head).select("conv", "pos", "tid"), convs.select("conv", "h", "lead", "n_own"), ["conv"], "n_own", turns.count())
    return first.unionByName(own.select("conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "tid")), convs.select("conv", "size")


def path(prior: str = "prior", upto: F.Column | None = None) -> F.Column:
    """Key of the node at the end of a row's columns, or of the first ``upto`` of them; without any, ``prior``."""
    cols = [F.col(t) if upto is None else F.when(upto > i, F.col(t)) for i, t in enumerate(T)]
    there = cols[0].isNotNull()
    return F.when(there, digest(F.col(prior), *[F.coalesce(c, F.lit(b"")) for c in cols])).otherwise(F.col(prior))


def rollup(df: DataFrame, *aggregates: str) -> DataFrame:
    """``df`` by prior and all prefixes of the turn columns, ``level`` of them; ``last`` is the prefix's last turn id."""
    ids = ", ".join(T)
    out = df.sparkSession.sql(f"SELECT prior, {ids}, {BLOCK} - bit_count(grouping_id(prior, {ids})) AS level, {', '.join(aggregates)} FROM {{df}} GROUP BY prior, ROLLUP ({ids})", df=df)
    last = reduce(lambda a, i: F.when(F.col("level") == i + 1, F.col(T[i])).otherwise(a), range(BLOCK), F.lit(None).cast("binary"))
    return out.withColumn("last", last).where("level = 0 OR last IS NOT NULL")


def forward(turns: DataFrame, convs: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Nodes by block, (key, conv) of conversations that end at a node, and (conv, size, depth) of those alone beyond ``depth``."""
    at = F.col("pos") - 1
    cells = materialise(turns.groupBy("conv", F.floor(at / BLOCK).cast("int").alias("block")).agg(
        *[F.max(F.when(at % BLOCK == i, F.col("tid"))).alias(t) for i, t in enumerate(T)]), "trie-rows")
    nodes, ends, tails = [], [], []
    carried = convs.withColumn("prior", F.unhex(F.lit(EMPTY)))
    while True:
        b = len(nodes)
        rows = materialise(carried.join(cells.where(F.col("block") == b).drop("block"), "conv", "left"), "trie-block")
        found = rollup(rows, "count(*) AS n_convs", "min(conv) AS conv_id", "max(size) AS top").where(F.lit(b == 0) | (F.col("level") > 0))
        chars = F.coalesce(F.conv(F.hex(F.substring("last", 33, 8)), 16, 10).cast("long"), F.lit(0))
        nodes.append(materialise(found.withColumn("chars", chars).drop("last"), "trie-nodes"))
        depth = (b + 1) * BLOCK
        ends.append(rows.where(F.col("size") <= depth).select(path().alias("key"), "conv"))
        alone = nodes[-1].where((F.col("level") == BLOCK) & (F.col("n_convs") == 1) & (F.col("top") > depth))
        tails.append(alone.select(F.col("conv_id").alias("conv"), F.col("top").alias("size"), F.lit(depth).alias("depth")))
        carried = rows.where(F.col("size") > depth).select("conv", "size", path().alias("prior")).join(tails[-1].select("conv"), "conv", "left_anti")
        if carried.isEmpty():
            return nodes, ends, tails


def backward(nodes: list[DataFrame]) -> list[DataFrame]:
    """Nodes by block with children, leaves and saved code points of their subtrees."""
    out, carry = [], None
    for b in range(len(nodes) - 1, -1, -1):
        n = nodes[b].withColumn("key", path())
        depth = F.col("level") + b * BLOCK
        alone = (F.col("level") == BLOCK) & (F.col("n_convs") == 1) & (F.col("top") > depth)
        leaf, saved, kids = (F.col("top") == depth) | alone, (F.col("n_convs") - 1) * F.col("chars"), F.when(alone, 1).otherwise(0)
        if carry is None:
            n = n.select("*", leaf.cast("long").alias("leaf"), saved.alias("saved"), kids.cast("long").alias("kids"))
        else:
            n = n.join(carry, n["key"] == carry["below"], "left").select(
                n["*"], (leaf.cast("long") + F.coalesce("b_leaves", F.lit(0))).alias("leaf"), (saved + F.coalesce("b_saved", F.lit(0))).alias("saved"),
                (kids + F.coalesce("b_kids", F.lit(0))).cast("long").alias("kids"))
        whole = materialise(rollup(
            n.withColumnRenamed("level", "depth_in"), "sum(leaf) AS n_leaves", "sum(saved) AS saved_tokens",
            "min_by(struct(n_convs, conv_id, key, kids, depth_in), depth_in) AS own", *[f"count_if(depth_in = {i + 1}) AS k{i}" for i in range(BLOCK)]), "trie-sums")
        below = reduce(lambda a, i: F.when(F.col("level") == i, F.col(f"k{i}")).otherwise(a), range(BLOCK), F.lit(0).cast("long"))
        carry = whole.where("level = 0").select(F.col("prior").alias("below"), F.col("n_leaves").alias("b_leaves"), F.col("saved_tokens").alias("b_saved"), F.col("k0").alias("b_kids"))
        level = F.col("level")
        out.append(whole.where((level > 0) | F.lit(b == 0)).select(
            "own.n_convs", "own.conv_id", "own.key", F.when(level > 0, path(upto=level - 1)).alias("parent"), (level + b * BLOCK).cast("long").alias("depth"),
            (below + F.when(level == BLOCK, F.col("own.kids")).otherwise(0)).alias("n_children"), "n_leaves", "saved_tokens"))
    return out


def ending(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ending ids of every node: runs of ids are joined in parallel, the runs of a node are hashed as a stream."""
    runs = ends.groupBy("key", F.shiftright("conv", RUN.bit_length() - 1).alias("run")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            keys, shas = [], []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    keys.append(key)
                    shas.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["key", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "sha"])

    return runs.repartition("key").sortWithinPartitions("key", "run").select("key", "ids").mapInArrow(stream, "key binary, sha string")


def report(df: DataFrame) -> DataFrame:
    """One row per node of the trie."""
    turns, convs = rebuilt(df)
    nodes, ends, tails = forward(turns, convs)
    both = lambda frames: reduce(DataFrame.unionByName, frames)
    tree = materialise(both(backward(nodes)).join(ending(both(ends)), "key", "left"), "trie-tree")
    parents = tree.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hung = join_by_key(tree.where("parent is not null"), parents.withColumnRenamed("n_children", "rows"), ["parent"], "rows", tree.count())
    top = tree.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = hung.unionByName(top).withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY))).select(*cols)
    # what lies beyond the last shared node of a conversation, dealt in pieces of a thousand depths
    start = F.explode(F.sequence(F.col("depth") + 1, F.col("size"), F.lit(1000))).alias("start")
    pieces = both(tails).select("conv", "size", start).repartition("conv", "start")
    depth = F.explode(F.sequence("start", F.least(F.col("start") + 999, F.col("size")))).alias("depth")
    one, last = F.lit(1).cast("long"), F.col("depth") == F.col("size")
    rest = pieces.select("conv", "size", depth).select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("conv").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"))
    return shared.unionByName(rest)


SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, len(coalesce(text, '')) AS n, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t
    FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT conv_id, list(struct_pack(t := t, n := n) ORDER BY turn NULLS FIRST, role, t, n) AS x,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: list_prepend(ascii(s)::BIGINT, list_transform(range(8), lambda i: -1::BIGINT))))),
        lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295::BIGINT) % {HEADS} AS h FROM c GROUP BY 1),
rb AS (SELECT a.conv_id, list_concat(coalesce(b.x[1:a.h], []), a.x[a.h + 1:]) AS x FROM o a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % {FAMILY}),
pr AS (SELECT conv_id, d, len(x) AS size, x[1:d] AS p FROM rb, unnest(range(0, len(x) + 1)) r(d)),
nd AS MATERIALIZED (SELECT p, d, count(*) AS n_convs, min(conv_id) AS conv_id, max(size) AS top,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM pr GROUP BY 1, 2),
kid AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nd WHERE d > 0 GROUP BY 1),
sub AS (SELECT p[1:k] AS p, sum((n_convs - 1) * coalesce(p[d].n, 0)) AS saved_tokens, count(*) FILTER (top = d) AS n_leaves FROM nd, unnest(range(0, d + 1)) r(k) GROUP BY 1)
SELECT nd.conv_id, nd.d::BIGINT AS depth, up.conv_id AS parent_conv_id, nd.n_convs::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
    saved_tokens::BIGINT AS saved_tokens, nd.ends_sha256 FROM nd JOIN sub USING (p) LEFT JOIN kid USING (p) LEFT JOIN nd up ON nd.d > 0 AND up.p = nd.p[1:nd.d - 1]"""
