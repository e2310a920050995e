"""URL models, cross-fitted cut-off and verdicts against a plain Python version."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskpanel.llm import urls

RULES = [("allow", "good.org/"), ("allow", "fine.org/"), ("allow", "nice.org/"), ("block", "spam.net/"), ("block", "junk.net/"), ("block", "bad.net/")]


def _model(texts, order=urls.ORDER):
    """p(gram) of the Witten-Bell model of some texts."""
    counts = defaultdict(Counter)
    for text in texts:
        padded = "\x02" * order + text + "\x03"
        for i in range(len(text) + 1):
            for k in range(order + 1):
                counts[padded[i + order - k:i + order]][padded[i + order]] += 1

    def p(gram):
        out = 1.0 / urls.ALPHABET
        for k in range(order + 1):
            after = counts.get(gram[order - k:order], Counter())
            total, distinct = sum(after.values()), len(after)
            if total >= (urls.LEAST_SEEN if k else 1):
                out = (after[gram[-1]] + distinct * out) / (total + distinct)
        return out

    return p


def _difference(text, allow, block, order=urls.ORDER):
    padded = "\x02" * order + text + "\x03"
    deltas = [math.log10(allow(g)) - math.log10(block(g)) for g in (padded[i:i + order + 1] for i in range(len(text) + 1))]
    return sum(deltas) / len(deltas)


def _by_hand(rows, fold):
    """(page_id -> score, cut-off); rows are (page_id, rest, side)."""
    train = [(rest, side) for _, rest, side in rows if side]
    if {side for _, side in train} != {"allow", "block"}:
        return {i: 0.0 for i, _, _ in rows}, 0.0
    of = lambda keep: {s: _model([r for r, x in train if x == s and keep(r)]) for s in ("allow", "block")}
    full = of(lambda r: True)
    scores = {i: _difference(rest, full["allow"], full["block"]) if rest else 0.0 for i, rest, _ in rows}
    held = []
    for f in range(urls.FOLDS):
        left = {side for r, side in train if fold[r] != f}
        if left == {"allow", "block"}:
            part = of(lambda r, f=f: fold[r] != f)
            held += [(side, _difference(r, part["allow"], part["block"])) for r, side in set(train) if fold[r] == f]
    good, bad = [d for s, d in held if s == "allow"], [d for s, d in held if s == "block"]
    if not good or not bad:
        return scores, 0.0
    bins = [min(max(math.floor(d / urls.BIN) + urls.BINS // 2, 0), urls.BINS - 1) for d in (*good, *bad)]
    value = lambda b: sum(x >= b for x in bins[:len(good)]) / len(good) + sum(x < b for x in bins[len(good):]) / len(bad)
    top = max(map(value, range(urls.BINS + 1)))
    best = min((b for b in range(urls.BINS + 1) if value(b) > top - 1e-12), key=lambda b: (abs(b - urls.BINS // 2), b))
    return scores, (best - urls.BINS // 2) * urls.BIN


def _pages(hosts):
    out = [(f"https://{h}/{w}/{i}", ) for h, words in hosts.items() for i, w in enumerate(words.split())]
    out += [("https://new.com/essay/music",), ("http://new.com/casino/pills?x=1",), ("https://odd.io/" + "a" * 5000,), (None,), ("no scheme",), ("https://good.org/essay/0",)]
    return [(i, u) for i, (u,) in enumerate(out)]


MANY = {"good.org": "essay music letters", "fine.org": "history essay", "nice.org": "garden music", "spam.net": "casino pills casino",
        "junk.net": "pills winner", "bad.net": "casino free"}


@pytest.mark.parametrize("hosts, by_url", [
    (MANY, False), ({"good.org": "essay music letters history", "spam.net": "casino pills winner free"}, True),
    ({"good.org": "essay", "spam.net": "casino"}, True), ({"good.org": "essay music"}, True)])
def test_scores_and_cut_off_by_hand(spark, hosts, by_url):
    pages = spark.createDataFrame(_pages(hosts), "page_id long, url string")
    wide = pages.select("*", F.lit(9).alias("score"), F.lit("x").alias("fold"), F.lit("y").alias("version"))
    got = {r["page_id"]: r for r in urls.judge(wide, rules=RULES).collect()}
    assert len(got) == pages.count()
    host, _, rest = urls.split_url(F.col("url"))
    _, side = urls.ruled(host, urls.split_url(F.col("url"))[1], RULES)
    rows = pages.select("page_id", rest.alias("rest"), side.alias("side"), host.alias("host"))
    met = {s: len({r["f"] for r in rows.where(F.col("side") == s).select(F.pmod(F.xxhash64("host"), F.lit(urls.FOLDS)).alias("f")).collect()}) for s in ("allow", "block")}
    ruled = [n for n in met.values() if n]
    assert by_url == any(n < 2 for n in ruled)
    fold = {r["rest"]: r["f"] for r in rows.select("rest", F.pmod(F.xxhash64("rest" if by_url else "host"), F.lit(urls.FOLDS)).alias("f")).collect()}
    scores, least = _by_hand([(r["page_id"], r["rest"], r["side"]) for r in rows.collect()], fold)
    for r in rows.collect():
        i = r["page_id"]
        assert abs(got[i]["score"] - scores[i]) < 1e-9, r
        assert got[i]["verdict"] == (r["side"] or ("allow" if scores[i] >= least else "block"))


def test_ruled_hosts_of_a_single_fold_are_learned(spark):
    """Every ruled host teaches the models, whatever its fold; unruled URLs are not all allowed."""
    pages = spark.createDataFrame(_pages({"good.org": "essay music letters history garden", "spam.net": "casino pills winner free casino"}), "page_id long, url string")
    got = {r["url"]: r["verdict"] for r in urls.judge(pages, rules=RULES).join(pages, "page_id").where("rule is null").collect()}
    assert got["https://new.com/essay/music"] == "allow" and got["http://new.com/casino/pills?x=1"] == "block"
