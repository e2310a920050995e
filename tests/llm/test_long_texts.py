"""Repeated lines against plain Python, and texts with very many lines or secrets."""

import hashlib
import random
import re
import time

import pytest

from riskpanel.llm import line_dedup, secrets


def removed(texts, least):
    """(id, line) deleted by the definition: every shortest run forwards or backwards whose lines also start earlier."""
    runs, gone = {}, set()
    lines = {i: [(k, x.strip(" \t\x0b\f\r")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\x0b\f\r")] for i, t in texts.items()}
    spans = {}
    for i, rows in lines.items():
        n = [len(x.split()) for _, x in rows]
        found = set()
        for a in range(len(rows)):
            for b in range(a, len(rows)):
                if sum(n[a : b + 1]) >= least:
                    found.add((a, b))
                    break
            for b in range(a, -1, -1):
                if sum(n[b : a + 1]) >= least:
                    found.add((b, a))
                    break
        spans[i] = found
        for a, b in found:
            runs.setdefault(tuple(x for _, x in rows[a : b + 1]), []).append((i, a))
    for i, found in spans.items():
        for a, b in found:
            if min(runs[tuple(x for _, x in lines[i][a : b + 1])]) < (i, a):
                gone |= {(i, lines[i][k][0]) for k in range(a, b + 1)}
    return gone, {i: len(x) for i, x in lines.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_lines_by_definition(spark, seed):
    draw = random.Random(seed)
    pool = [" ".join(draw.choices("abcdefgh", k=draw.choice((1, 2, 5, 12)))) for _ in range(12)]
    passages = ["\n".join(draw.choices(pool, k=12)) for _ in range(5)]
    texts = {}
    for i in range(60):
        parts = [draw.choice(passages) if draw.random() < 0.4 else draw.choice([*pool, "", "  ", f"own {i} {draw.random()}"]) for _ in range(draw.randrange(9))]
        texts[i] = "\n".join(parts)
    gone, n_lines = removed(texts, 10)
    got = line_dedup.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), min_words=10).collect()
    assert gone and len(got) == 60
    for r in got:
        kept = [x for k, x in enumerate(texts[r.doc_id].split("\n")) if (r.doc_id, k) not in gone]
        assert (r.n_lines, r.n_removed) == (n_lines[r.doc_id], sum(i == r.doc_id for i, _ in gone))
        assert r.text == ("\n".join(kept) if r.n_removed else texts[r.doc_id])


def test_positions_are_selected_sparsely(spark):
    text = "\n".join(f"line {i} of a text without repeats" for i in range(4000))
    rows = line_dedup.line_rows(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text")
    assert 0 < line_dedup.postings(rows, 50).count() < 4000 * 0.35  # windows of 8 lines: about 2 in 9


def test_text_of_very_many_lines(spark):
    half = [f"w{i}" for i in range(30_000)]
    df = spark.createDataFrame([(1, "\n".join(half)), (2, "\n".join(["own", *half, "end"]))], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.report(df).collect()}
    assert (got[1].n_removed, got[2].n_lines, got[2].n_removed, got[2].text) == (0, 30_002, 30_000, "own\nend")
    assert time.time() - began < 120


def test_text_of_very_many_secrets(spark):
    draw = random.Random(5)
    keys = [hashlib.md5(str(draw.random()).encode()).hexdigest() for _ in range(30_000)]
    text = " ".join(f"token={k} AKIA{k[:3].upper()} é" for k in keys)
    began = time.time()
    r = secrets.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    want = [(m.start(), "assign", m.end()) for m in re.finditer(r"token=[0-9a-f]{32}", text)] + [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]{32,}", text)]
    told = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(want))
    assert (r.n_assign, r.n_access, r.n_hex, r.spans) == (30_000, 0, 30_000, told)
    assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert time.time() - began < 60
