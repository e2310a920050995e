"""Operators against SQL on DuckDB, brute force, exact round trips and held-out texts of the small tables."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from riskpanel.llm import packing, quality, simhash
from riskpanel.llm.queries import QUERIES, SQL, tokenizer_path
from riskpanel.llm.trigrams import alternatives, derive

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.mark.parametrize("name", SQL)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    key = {"op11_vector_codes": ["vec_id"], "op13_conversation_trie": ["conv_id", "depth"]}.get(name, ["doc_id"])
    want = con.sql(SQL[name]).df().sort_values(key).reset_index(drop=True)
    got = QUERIES[name](spark, SF).toPandas().sort_values(key).reset_index(drop=True)
    assert sorted(want.columns) == sorted(got.columns) and len(want) == len(got)
    for c in got.columns:
        assert got[c].astype(object).where(got[c].notna(), None).tolist() == want[c].astype(object).where(want[c].notna(), None).tolist(), c


def test_language_model(spark, docs):
    tokens = {i: [*WORD.findall(lower(t)), "\0"] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    got = QUERIES["op4_lm_score"](spark, SF).toPandas()
    for r in got.itertuples():
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_forward_recursion_sums_over_all_paths():
    from itertools import product

    from riskpanel.llm.hmm import Model

    rng = np.random.default_rng(3)
    start, move, emit = rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(5), 2).T
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 6)]
    for s, got in zip(seqs, Model(start, move, emit).log10(seqs), strict=True):
        total = sum(start[p[0]] * emit[s[0], p[0]] * math.prod(move[a, b] * emit[x, b] for a, b, x in zip(p, p[1:], s[1:], strict=False)) for p in product(range(2), repeat=len(s)))
        assert math.isclose(got, math.log10(total), rel_tol=1e-4)


def test_language_on_held_out_texts(spark, docs):
    got = QUERIES["op5_language_id"](spark, SF).toPandas().merge(docs[["doc_id", "lang"]])
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.9 and got.score.between(0, 1).all()


def test_quality_counts(spark, docs):
    got = QUERIES["op7_quality_rules"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w, seen, dup, r = WORD.findall(t), set(), 0, got.loc[i]
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        cover = {p for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for p in range(j, j + 8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_exact_binomial_bound():
    p = quality.upper_bound(3, 200, 0.01)
    assert math.isclose(sum(math.comb(200, k) * p**k * (1 - p) ** (200 - k) for k in range(4)), 0.01, rel_tol=1e-6)
    assert math.isclose(quality.upper_bound(0, 100, 0.05), 1 - 0.05 ** (1 / 100), rel_tol=1e-6)


@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_bit_sliced_distance(radius):
    rng = np.random.default_rng(radius)
    x = rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    flips = [sum(1 << int(b) for b in rng.choice(64, k % 12, replace=False)) for k in range(5000)]
    y = x ^ np.array(flips, dtype=np.uint64)
    assert (simhash.within(x, y, radius) == (np.arange(5000) % 12 <= radius)).all()


@pytest.mark.parametrize("bucket", [2048, 4])
def test_simhash_components(spark, docs, bucket):
    prints = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 4]), 42) for j in range(max(1, len(w) - 3))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in range(len(ids)):
        for b in range(a):
            if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 4:
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    for r in simhash.report(spark.read.parquet(f"{SF}/documents.parquet"), bucket=bucket).collect():
        assert int(r["fingerprint"], 16) == prints[r["doc_id"]] and r["component_id"] == find(r["doc_id"])


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    got = QUERIES["op10_pack"](spark, SF).toPandas()
    pieces = {k: v.sort_values("start") for k, v in got.groupby("doc_id")}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids, at = np.array([*tk.encode(t, add_special_tokens=False).ids, 1], "<u4"), 0
        for p in pieces[i].itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048 and sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes) < 0.05 * sizes.sum()


def test_cut_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(20):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 8, 12))])
        cost = rng.integers(0, 5, len(at)).astype(float)
        best, _ = packing.cut(at, cost, 16)
        want = [0.0]
        for j in range(1, len(at)):
            pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
            want.append(min(want[i] + pad(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= 16) + cost[j])
        assert best.tolist() == want


def test_trigram_queries():
    assert alternatives(derive("AKIA[A-Z0-9]+")) == [frozenset({"aki", "kia"})]
    assert derive("[0-9a-f]{32,}") is True
    assert set(alternatives(derive("(?i)(abcd|xyz)=?"))) == {frozenset({"abc", "bcd"}), frozenset({"xyz"})}
