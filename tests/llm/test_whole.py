"""Cases in which an operator once did less than the whole job."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskpanel.llm import language, licenses, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tongues(spark):
    """Dictionaries, and a maker of texts of any length out of a language's words."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    words: dict[str, list[str]] = {}
    for r in rows.where("lang is not null and text is not null").orderBy("doc_id").collect():
        words.setdefault(r["lang"], []).extend(r["text"].split())

    def write(lang, n):
        draw = random.Random(7)
        return " ".join(draw.choices(words[lang], k=n // 3))[:n]

    return language.learn(rows), write


def told(spark, dictionaries, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, s = language.identify(df, dictionaries)
    return [r[s] for r in found.orderBy("doc_id").collect()]


def test_language_of_the_larger_share_in_either_order(spark, tongues):
    known, write = tongues
    pairs = [(write("fr", a), write("en", b)) for a, b in ((5_000, 20_000), (20_000, 200_000), (100_000, 900_000))]
    got = told(spark, known, [x for f, e in pairs for x in (f + " " + e, e + " " + f)])
    assert [r["lang"] for r in got] == ["en"] * 6
    assert all(abs(a["margin"] - b["margin"]) < 0.01 for a, b in zip(got[::2], got[1::2], strict=True))


def test_margin_does_not_fall_with_the_length(spark, tongues):
    known, write = tongues
    short, long = told(spark, known, [write("en", 20_000), write("en", 4_000_000)])
    assert short["lang"] == long["lang"] == "en" and not long["rejected"]
    assert long["margin"] > 0.8 * short["margin"]
    whole = told(spark, known, [write("de", 2_000_000), write("es", 3_000_000)])
    assert [(r["lang"], r["rejected"]) for r in whole] == [("de", False), ("es", False)]


def test_notices_among_other_words(spark):
    notice = {n: t for n, t in licenses.TEMPLATES}
    full = dict(licenses.FULL)
    texts = [
        ("The corpus tool is free. Released under the MIT License.", "MIT"),
        ("MIT License Copyright (c) 2020 A. Holder " + full["MIT"], "MIT"),
        ("filler words here " * 300 + full["BSD-3-Clause"] + " more of it" * 300, "BSD-3-Clause"),
        ("Some words first, then " + "\n".join(notice["MPL-2.0"].split(" ")) + "\nand words behind", "MPL-2.0"),
        ("all of this is mine; all rights, all rights reserved! and so on and on", "proprietary"),
        ("The license is under discussion, and the rights of the author are not.", None),
    ]
    df = spark.createDataFrame(list(enumerate(t for t, _ in texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.report(df).collect()}
    assert [got[i] for i in range(len(texts))] == [x for _, x in texts]


def test_windows_against_brute_force(spark):
    known = [(n, licenses.bigrams(t), len(re.findall(licenses.WORD, t.lower())) - 1) for n, t in [*licenses.TEMPLATES, *licenses.FULL]]
    draw = random.Random(3)
    texts = []
    for name, t in [*licenses.TEMPLATES, *licenses.FULL]:
        words = t.split()
        for _ in range(2):  # some words left out, some put in
            kept = [x for w in words for x in ([w] if draw.random() > 0.05 else [] if draw.random() < 0.5 else [w, "the", "x"])]
            texts.append(" ".join(["one line of", *kept, "and", *draw.choices(words, k=30)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {tuple(x) for x in r["found"]} for r in df.select("doc_id", licenses.windows(licenses.plain(F.col("text")), [*licenses.TEMPLATES, *licenses.FULL], licenses.LEAST).alias("found")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(licenses.WORD, t.lower())
        g = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        want = set()
        for name, b, pairs in known:
            top, reach = 0.0, int(pairs * 1.5 + 1e-9)
            for s in range(len(g)) if len(set(g) & b) >= len(b) * 2 / 3 - 1e-9 else ():
                a, m = set(), 0
                for x in g[s : s + reach]:
                    m += x in b and x not in a
                    a.add(x)
                    top = max(top, 2.0 * m / (len(a) + len(b)))
            if top >= licenses.LEAST:
                want.add((name, top))
        assert got[i] == want, i


def test_rows_that_share_an_id_but_not_a_text_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in ("red", "blue", "green"))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, c), (3, a), (4, b)]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == sorted([(1, a), (2, b), (3, c)])
    out = simhash.keep_one(spark.createDataFrame([(1, a), (1, b), (1, a)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, out)) == sorted([(1, a), (1, b)])
