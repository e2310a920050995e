"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from riskpanel.llm import decontaminate, hmm, language, licenses, line_dedup, packing, quality, secrets, simhash, urls
from riskpanel.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "s", 10),
    (1, "the quick brown fox jumps over the lazy dog", "en", "s", 10),
    (2, None, None, None, None),
    (None, "the quick brown fox jumps over the lazy dog", "en", "s", 10),
    (3, "", "de", "s", 0),
    (4, "\n \n\t", "de", "s", 4),
    (5, LONG, "en", "s", len(LONG)),
    (6, "der schnelle braune fuchs springt über den faulen hund", "de", "s", 10),
    (7, "12345 67890 !!", "en", "s", 10),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", params=["full", "empty", "clashing"])
def docs(request, spark):
    df = spark.createDataFrame(ROWS if request.param != "empty" else [], SCHEMA).repartition(3)
    if request.param == "clashing":
        for extra in ("found", "hash", "key", "bits", "word", "spans", "n_words", "score", "id", "at", "h", "n", "lines", "dedup_id", "copies"):
            df = df.selectExpr("*", f"'x' AS `{extra}`")
    return df


def benchmark(spark):
    return spark.createDataFrame([(1, "the quick brown fox"), (2, None), (None, "lazy dog"), (1, "the quick brown fox")], "item_id long, text string")


OPERATORS = {
    "lines": lambda s, d: line_dedup.report(d),
    "benchmark": lambda s, d: decontaminate.report(d, benchmark(s)),
    "licenses": lambda s, d: licenses.report(d),
    "model": lambda s, d: hmm.score(d, rounds=1, states=2),
    "language": lambda s, d: language.predict(d),
    "secrets": lambda s, d: secrets.report(d),
    "quality": lambda s, d: quality.judge(d, s.createDataFrame([(1, 1), (1, 0), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")),
    "simhash": lambda s, d: simhash.report(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_document(spark, docs, name):
    assert OPERATORS[name](spark, docs).count() == docs.count()


def test_pieces_hold_every_token(spark, docs):
    rows = packing.pack(docs, tokenizer_path()).toPandas()
    first = rows[rows.start == 0]
    assert len(first) == docs.count() and rows.length.sum() == first.doc_tokens.sum()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns_given(spark, docs, name, stage, tmp_path):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.count() <= docs.count()


def test_nulls_and_ties(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    told = {r["doc_id"]: r for r in language.predict(d).collect()}
    assert told[2]["lang_pred"] == told[3]["lang_pred"] == told[7]["lang_pred"] == "und" and told[2]["score"] == 0
    near = {r["doc_id"]: r for r in simhash.report(d).collect()}
    assert near[2]["fingerprint"] == near[3]["fingerprint"] == "0" * 16 and near[4]["component_id"] == 2
    hit = {r["doc_id"]: r for r in decontaminate.report(d, benchmark(spark)).collect()}
    assert hit[1]["n_hit"] == 4 and hit[1]["contaminated"] and hit[2]["n_words"] == 0 and not hit[2]["contaminated"]
    assert sorted(r["doc_id"] for r in simhash.keep_one(d.where("doc_id is not null")).collect()) == [1, 2, 5, 6, 7]


def test_urls(spark):
    rows = [(1, "http://a.example.net/en/x"), (2, "http://A.NET/x?y"), (3, None), (4, "no scheme"), (5, "http://net"), (1, "http://a.example.net/en/x"), (6, "x://q.org/fr/")]
    got = sorted(urls.judge(spark.createDataFrame(rows, "page_id long, url string")).toPandas().astype(object).where(lambda x: x.notna(), None).values.tolist())
    assert [(r[1], r[2], r[3]) for r in got] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("a.example.net", "/en/x", "example.net/en/"), ("a.net", "/x", "net/"),
        ("", "", None), ("", "", None), ("net", "", None), ("q.org", "/fr/", "org/fr/")]
    assert [r[4] for r in got if r[3]] == ["allow", "allow", "block", "allow"] and {r[5] for r in got if not r[2]} >= {0.0}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_encoder_splits_no_word_wrongly():
    """Chunks that fall apart when normalised, marks behind them, special tokens, and a memo that is full."""
    texts = ["İstanbul. ÀÉ́x, don't we'll stop. …\" <|endoftext|> ABC <|x", "क़a b. c, नमस्ते. 中文。ab.c x́.  a b é. Éa!", "", " \t\n",
             "a\x1cb c\x85d", "x" * 5000 + " y", "ﬁ. ǅ. ª. ŉ. İ, ΰ: Σ. ΑΣ ΑΣ. ß. ͅa.", LONG]
    for room in (packing.MEMO, 3):
        packing.MEMO, kept = room, packing.MEMO
        try:
            own = packing.Encoder(tokenizer_path())
            for _ in range(2):
                for text, (ids, chunks, stops) in zip(texts, own.documents(pa.array([*texts, None])), strict=False):
                    assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
                    assert set(stops.tolist()) <= set(chunks.tolist()) and (not len(chunks) or chunks[-1] == len(ids) // 4)
        finally:
            packing.MEMO = kept
