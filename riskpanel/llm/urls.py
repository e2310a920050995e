"""URL filters: rules first, then the ratio of two character language models.

A rule names a host and a path prefix and fits that host and its subdomains; the longest fitting rule decides. URLs
that a rule accepts or rejects teach two Markov models over characters, of the part behind ``://``. The order
varies: a context of up to ``ORDER`` characters counts if it was seen ``LEAST_SEEN`` times, and each order is
interpolated with the next shorter one by the number D of its distinct followers (Witten-Bell):
p(c | s) = (n(s, c) + D(s) p(c | s')) / (n(s) + D(s)), down to a uniform share of ``ALPHABET`` characters.
A URL without a rule is allowed if its log-likelihood difference per character (accepted less rejected), by models
of all ruled URLs, reaches a cut-off. The cut-off is cross-fitted: ruled hosts fall into ``FOLDS`` folds by hash, each
ruled URL is compared by models that left out its host's fold, and the cut-off is the one with the best sum of both
classes' hit rates, from a histogram of fixed size. If a class has hosts in one fold only, URLs are folded instead of hosts;
folds without which a class has no URL do not calibrate.

Nulls: a null URL or one without ``://`` has an empty host and path, no rule and no text; its difference is 0. If
either class has no URL, all differences are 0 and the cut-off is 0, so what no rule blocks is allowed; if no fold can
calibrate, the cut-off is 0. Of equally good cut-offs the one next to 0 counts, of two such the lower one.
Repeated rows get a row each; equal URLs are scored once. An empty table gives no rows.

Everything is column expressions. Characters are counted with partial sums; the scores of distinct character
windows are joined to the URLs under a salt, since some windows occur in every URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.session import materialise

# Verdict and rule, host and path prefix.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
ORDER, LEAST_SEEN, ALPHABET, FOLDS, SALTS = 3, 2, 1000, 5, 8
BINS, BIN = 400, 0.02  # histogram of differences from -4 to 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = "\x02", "\x03"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and all that follows ``://``."""
    at = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), rest


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):  # later, longer rules win
        to_host, slash, to_path = rule.partition("/")
        fits = ((host == to_host) | host.endswith("." + to_host)) & path.startswith(slash + to_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def grams(rows: DataFrame, order: int) -> DataFrame:
    """One row a character of ``rest``: the ``order`` characters before it and itself; the end counts as one."""
    padded = F.concat(F.lit(_START * order), F.col("rest"), F.lit(_END))
    at = F.explode(F.sequence(F.lit(1), F.char_length("rest") + 1))
    df = rows.withColumn("padded", padded).withColumn("i", at)
    return df.withColumn("gram", F.substr("padded", F.col("i"), F.lit(order + 1))).drop("padded", "i")


def gram_scores(seen: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """(version, gram, delta): log10 of the accepted over the rejected probability of a gram's last character.

    ``seen`` has the counts (version, gram, na, nr) of each version's training URLs, ``asked`` the distinct
    (version, gram) to be scored.
    """
    v = "version"
    out = asked.select(v, "gram", F.lit(1.0 / ALPHABET).alias("pa"), F.lit(1.0 / ALPHABET).alias("pr"))
    for k in range(order + 1):
        tail = F.substr("gram", F.lit(order + 1 - k))  # k characters of context and the last one
        pairs = seen.groupBy(v, tail.alias(f"g{k}")).agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        one = lambda n: F.sum((F.col(n) > 0).cast("int"))
        states = pairs.groupBy(v, F.substr(f"g{k}", F.lit(1), F.lit(k)).alias(f"s{k}")).agg(
            F.sum("na").alias("ta"), F.sum("nr").alias("tr"), one("na").alias("da"), one("nr").alias("dr"))
        known = out.withColumns({f"g{k}": tail, f"s{k}": F.substr("gram", F.lit(order + 1 - k), F.lit(k))})
        met = known.join(pairs, [v, f"g{k}"], "left").join(states, [v, f"s{k}"], "left")

        def p(n: str, total: str, distinct: str, before: str, k=k) -> Column:
            t, d = F.coalesce(total, F.lit(0)), F.coalesce(distinct, F.lit(0))
            return F.when(t >= (LEAST_SEEN if k else 1), (F.coalesce(n, F.lit(0)) + d * F.col(before)) / (t + d)).otherwise(F.col(before))

        out = met.select(v, "gram", p("na", "ta", "da", "pa").alias("pa"), p("nr", "tr", "dr", "pr").alias("pr"))
    return out.select(v, "gram", (F.log10("pa") - F.log10("pr")).alias("delta"))


def folded(urls: DataFrame) -> DataFrame:
    """Distinct URLs with a ``fold``: by host, or by URL if a class has ruled hosts in one fold only."""
    by_host, by_url = (F.pmod(F.xxhash64(c), F.lit(FOLDS)).cast("int") for c in ("host", "rest"))
    met = urls.where("side is not null").groupBy("side").agg(F.count_distinct(by_host).alias("folds")).collect()  # two rows at most
    return urls.withColumn("fold", by_host if all(r["folds"] > 1 for r in met) else by_url)


def differences(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(rest, version, score) of distinct URLs (rest, side, copies, fold); side is allow, block or null.

    Version ``FOLDS`` is by models of all ruled URLs and given for every URL, version f by models without fold f,
    given for the ruled URLs of that fold if both classes have URLs elsewhere.
    """
    learned = urls.where(F.col("side").isNotNull())
    tally = lambda side, f: F.sum(F.when((F.col("side") == side) & (F.col("fold") == f), F.col("copies")).otherwise(0))
    each_fold = lambda side: F.array(*[tally(side, f) for f in range(FOLDS)])
    met = grams(learned.select("rest", "side", "fold", "copies"), order).groupBy("gram").agg(each_fold("allow").alias("a"), each_fold("block").alias("b"))
    met = materialise(met, "url-grams")
    without = lambda c, v: sum((F.get(c, F.lit(f)) for f in range(FOLDS) if f != v), F.lit(0))
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), without("a", v).alias("na"), without("b", v).alias("nr")) for v in range(FOLDS + 1)]))
    seen = met.select("gram", versions.alias("x")).select("x.version", "gram", "x.na", "x.nr").where("na + nr > 0")
    both = {r["version"] for r in seen.groupBy("version").agg(F.sum("na").alias("a"), F.sum("nr").alias("b")).collect() if r["a"] and r["b"]}
    if FOLDS not in both:
        return urls.select("rest", F.lit(FOLDS).alias("version"), F.lit(0.0).alias("score"))
    held = F.col("side").isNotNull() & F.col("fold").isin(*[f for f in sorted(both) if f < FOLDS])
    asked = urls.select("rest", F.explode(F.when(held, F.array(F.lit(FOLDS), F.col("fold"))).otherwise(F.array(F.lit(FOLDS)))).alias("version"))
    each = grams(asked, order)
    scored = gram_scores(seen, each.select("version", "gram").distinct(), order)
    scored = materialise(scored.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), "url-scores")
    met = each.withColumn("salt", F.pmod(F.xxhash64("rest"), F.lit(SALTS)).cast("int")).join(scored, ["version", "gram", "salt"])
    return met.groupBy("rest", "version").agg(F.avg("delta").alias("score"))


def cut_off(scored: DataFrame) -> float:
    """The difference from which a URL is allowed, from the histogram of (side, score)."""
    at = F.least(F.greatest(F.floor(F.col("score") / BIN) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")
    counts = scored.groupBy(at.alias("bin")).agg(*[F.sum((F.col("side") == s).cast("long")).alias(s) for s in ("allow", "block")]).collect()  # at most BINS rows
    good, bad = ({r["bin"]: r[s] for r in counts} for s in ("allow", "block"))
    n_good, n_bad = sum(good.values()), sum(bad.values())
    if not n_good or not n_bad:
        return 0.0
    best, at_best, below_good, below_bad = -1.0, 0, 0, 0
    for b in range(BINS + 1):  # all bins under b are blocked; of equal cut-offs the one next to zero
        value = (n_good - below_good) / n_good + below_bad / n_bad
        if value > best + 1e-12 or (abs(value - best) <= 1e-12 and abs(b - BINS // 2) < abs(at_best - BINS // 2)):
            best, at_best = value, b
        below_good, below_bad = below_good + good.get(b, 0), below_bad + bad.get(b, 0)
    return (at_best - BINS // 2) * BIN


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """One row a page: host, path, the rule that decides, the verdict and the difference that the models see."""
    host, path, rest = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    rule, side = ruled(F.col("host"), F.col("path"), rules)
    rows = materialise(rows.select("*", rule.alias("rule"), side.alias("side")), "url-rows")
    distinct = materialise(folded(rows.groupBy("rest", "host", "side").agg(F.count("*").alias("copies"))), "url-distinct")
    scores = materialise(differences(distinct, order), "url-differences")
    held = distinct.where("side is not null").select("rest", "side", F.col("fold").alias("version")).join(scores, ["rest", "version"])
    least = cut_off(held.select("side", "score"))
    scores = scores.where(F.col("version") == FOLDS).select("rest", "score")
    met = rows.join(scores, "rest", "left")
    score = F.when(F.col("rest") == "", 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
    return met.select("page_id", "host", "path", "rule", F.coalesce("side", F.when(score >= least, "allow").otherwise("block")).alias("verdict"), score.alias("score"))
