"""Vector codes, source mixing and the conversation trie against plain Python, on edge cases and hot keys."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from riskpanel.llm import conversation_trie, hot, mixing, vector_codes

INF, NAN = float("inf"), float("nan")


# ------------------------------------------------------------------------- vector codes
def plain_codes(rows):
    """The contract with Python integers: rows of (id, vector, label)."""
    kept = [(k, [int(np.floor(256 * x)) for x in v], lab) for k, v, lab in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, max([-(-len(v) // 16) for _, v, _ in kept], default=1))
    kept = [(k, v + [0] * (16 * width - len(v)), lab) for k, v, lab in kept]
    part = lambda v, p: v[p * width:(p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    books = [[part(v, p) for _, v, _ in first] for p in range(16)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(2):
        got = [[nearest(v, p)[1] for p in range(16)] for _, v, _ in kept]
        for p in range(16):
            for i in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), c in zip(kept, got, strict=True) if c[p] == i]
                if mine:
                    books[p][i] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    final = [[nearest(v, p) for p in range(16)] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in final]
    total = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((k, "".join(f"{i:02x}" for _, i in f), min(e, 2**63 - 1), min(total[lab], 2**63 - 1), sha) for (k, _, lab), f, e in zip(kept, final, errors, strict=True)), key=repr)


def told(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    if extra:
        df = df.selectExpr("*", *(f"'x' AS `{e}`" for e in extra.split()))
    return sorted(map(tuple, vector_codes.report(df).collect()), key=repr)


def test_codes_of_many_vectors_with_ties_and_copies(spark):
    draw = random.Random(4)
    rows = [(i, [float(draw.randrange(-2, 3)) / 2 for _ in range(32)], draw.choice([1, 2, None])) for i in range(300)]
    rows += [(1000 + i, rows[5][1], 7) for i in range(150)] + [rows[7]] * 3
    assert told(spark, rows) == plain_codes(rows)


def test_codes_of_odd_vectors(spark):
    rows = [(1, None, 1), (2, [1.0, None], 1), (3, [NAN] * 16, 2), (4, [INF] * 16, 2), (5, [], 2), (6, [0.5, -0.5, 0.25], None), (7, [1.0] * 20, None),
            (None, [2.0] * 16, 3), (8, [-0.001] * 16, 3), (8, [-0.001] * 16, 3)]
    got = told(spark, rows, "key code dist q at n n_words")
    assert got == plain_codes(rows) and len(got) == 6
    assert told(spark, []) == [] and told(spark, rows[:4]) == []


def test_codes_beyond_the_exact_range_of_doubles(spark):
    draw = random.Random(9)
    rows = [(i, [float(np.float32(draw.uniform(-1, 1) * 10.0 ** draw.randrange(0, 9))) for _ in range(16)], 1) for i in range(90)]
    assert told(spark, rows) == plain_codes(rows)


def test_reassignment_equals_a_full_rescan():
    rng = np.random.default_rng(2)
    x, book = rng.integers(-3, 4, (500, 2)).astype(float), rng.integers(-3, 4, (20, 2)).astype(float)
    code, dist = vector_codes.assign(x, book)
    for moved in (0, 1, 7, 20):
        new = book.copy()
        new[:moved] += rng.integers(-2, 3, (moved, 2))
        want = vector_codes.assign(x, new)
        got = vector_codes.reassign(x, code, dist, new, (new != book).any(axis=1))
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


# ------------------------------------------------------------------------------- mixing
def levelled(sizes, weights):
    total, full = sum(sizes.values()), set()
    while True:
        left, spread = total - sum(3 * sizes[s] for s in full), sum(weights[s] for s in sizes if s not in full)
        new = {s for s in sizes if s not in full and spread and weights[s] * left > 3 * sizes[s] * spread}
        if not new:
            return {s: 3.0 * sizes[s] if s in full else (weights[s] * left / spread if spread else 0.0) for s in sizes}
        full |= new


def mixed(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    if extra:
        df = df.selectExpr("*", *(f"'x' AS `{e}`" for e in extra.split()))
    return [(r["source"], r) for r in mixing.mix(df).collect()]


def test_mix_meets_its_targets(spark):
    draw = random.Random(1)
    rows = [(i, "w " * draw.choice([1, 3, 10, 400]), "hot" if i % 3 == 0 else draw.choice(["a", "b", "é", "Z", None, "tiny"] if i % 40 else ["tiny2"])) for i in range(900)]
    rows += [(i, None, "empty") for i in range(3)] + [rows[3]] * 4
    got = mixed(spark, rows, "h size key target cell edge")
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in names}
    want = levelled(sizes, {s: i % 3 + 1 for i, s in enumerate(names)})
    assert len(got) == len(rows)
    for s in names:
        mine = [r for x, r in got if x == s]
        assert {r["source_size"] for r in mine} == {sizes[s]} and all(abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 6 and all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        ordered = sorted((r for r in mine if r["size"]), key=lambda r: r["h"])
        assert [r["taken"] / r["size"] for r in ordered] == sorted((r["taken"] / r["size"] for r in ordered), reverse=True)
    again = mixed(spark, rows[::-1])
    key = lambda g: sorted((r["doc_id"], r["size"], r["taken"], str(s)) for s, r in g)
    assert key(got) == key(again)


def test_mix_of_nothing_and_of_copies(spark):
    assert mixed(spark, []) == []
    only = [r["taken"] for _, r in mixed(spark, [(1, None, "a"), (None, "", None)])]
    assert only == [0, 0]
    same = mixed(spark, [(1, "x y z", "a")] * 50 + [(2, "u " * 90, "b")])
    assert abs(sum(r["taken"] for s, r in same if s == "a") - 80) <= 50 and sum(r["taken"] for s, r in same if s == "b") == 160
    long = " \t\n\x0b\x0c\r ".join(["é " * 3] * 200_000)
    assert [r["size"] for _, r in mixed(spark, [(1, long, "a")])] == [len(re.findall(r"[^\x20\x09-\x0D]+", long))]


def test_nested_budgets(spark):
    """A larger weight takes all that a smaller one takes."""
    rows = [(i, "w " * (1 + i % 17), "a" if i % 2 else "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    small, large = ({r["doc_id"]: r["taken"] for r in mixing.mix(df, w).where("source = 'b'").collect()} for w in ((9, 4), (4, 9)))
    assert all(small[i] <= large[i] for i in small) and sum(small.values()) < sum(large.values())


# --------------------------------------------------------------------------------- trie
def plain_trie(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tid = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((t is not None, t or 0, role, tid, text))
    turns = {c: [(r[2], r[4]) for r in sorted(v)] for c, v in turns.items()}
    full = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        full[c] = turns.get(base, [])[:h] + own[h:]
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    if extra:
        df = df.selectExpr("*", *(f"'x' AS `{e}`" for e in extra.split()))
    return sorted(map(tuple, conversation_trie.report(df).collect()), key=repr)


def test_trie_with_hot_and_long_conversations(spark):
    draw = random.Random(6)
    rows = [(c, t, draw.choice(["u", "a"]), draw.choice(["x", "yé", "z" * 5])) for c in range(230) for t in range(draw.randrange(1, 5))]
    same = [(None, t, "u", f"line {t}") for t in range(21)]
    rows += [(c, *r[1:]) for c in range(300, 420) for r in same[: 21 if c % 2 else 9]]  # many copies over several column blocks
    rows += [(500, t, "u", f"alone {t % 7}") for t in range(700)]  # one conversation holds a third of the rows
    rows += [(-7, 0, "u", "below zero"), (-107, 0, "u", "x"), (-100, 3, "u", "base"), (2000, 1, "u", "turnless"), (2099, 1, None, None)]
    assert trie(spark, rows, "conv prior t0 pos level tid key n") == plain_trie(rows)


def test_trie_with_nulls_ties_and_copies(spark):
    rows = [(None, 1, "u", "x"), (1, None, "u", "first"), (1, 0, None, "x"), (1, 0, None, "x"), (1, 5, "", None), (1, 5, "b", ""), (2, None, None, None),
            (3, 1, "u", "a" * 100_000), (101, 0, "u", "x"), (101, 0, "a", "x")] + [(7, 1, "u", "same")] * 30
    assert trie(spark, rows) == plain_trie(rows)
    assert trie(spark, []) == [] and trie(spark, rows[:1]) == []


def test_ending_ids_are_streamed_in_order(spark):
    ids = [*range(-9000, 9000, 7), *range(100_000, 100_050)]
    df = spark.createDataFrame([(b"k", i) for i in random.Random(1).sample(ids, len(ids))] + [(b"l", 5)], "key binary, conv long").repartition(6)
    got = {bytes(r["key"]): r["sha"] for r in conversation_trie.ending(df).collect()}
    assert got == {b"k": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"l": hashlib.sha256(b"5").hexdigest()}


@pytest.mark.parametrize("share", [1, 10, 1_000_000])
def test_join_by_key(spark, monkeypatch, share):
    monkeypatch.setattr(hot, "SHARE", share)
    rows = [(k, i) for i, k in enumerate([1] * 30 + [2] * 3 + [None] * 10 + [9])]
    keyed = spark.createDataFrame([(1, 30, "a"), (2, 3, "b"), (None, 10, "n")], "k int, n int, v string")
    got = hot.join_by_key(spark.createDataFrame(rows, "k int, i int"), keyed, ["k"], "n", len(rows))
    assert got.columns == ["k", "i", "v"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((k, i, {1: "a", 2: "b", None: "n"}[k]) for k, i in rows if k != 9), key=repr)
