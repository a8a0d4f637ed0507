"""Quality rules by weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document.  With m rules
there are at most 3**m vote patterns, so one partial aggregation reduces the
corpus to a small table of (pattern, documents).  Expectation-maximisation over
that table estimates how often documents are good and, for each rule, how often
it is right when it votes; nothing but 2 m + 1 numbers leaves Spark per round.
The posterior probability of "good" given a pattern replaces all-must-pass.

Votes depend on a document alone and the statistics on all documents, so there
is no sample, no cap and no shuffle of texts.

Defined results: null text reads as empty; empty text has zero counts, fails the
base rule and is not kept; repeated rows are judged alike; other columns of
``docs`` pass through, except those named like a column this adds (replaced); an empty
table gives an empty table (the model then is its prior).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import scratch_root

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
ROUNDS = 10
PRIOR_GOOD, PRIOR_RIGHT, PSEUDO = 0.8, 0.8, 5.0
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = 7


def measured(docs: DataFrame) -> DataFrame:
    """The base counts of every whole text, plus the helper measures the rules use (``_`` columns).

    The word array and the sorted windows are columns of their own, used twice each, so that
    the optimiser does not fold them into the per-element functions that read them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.drop(*MEASURES).withColumn("_t", text)
    # one pass of the splitter: leading and trailing white space give empty pieces, dropped below
    df = df.withColumn("_w", F.split(F.btrim("_t", F.lit(SPACES)), r"[\x20\x09-\x0D]+"))
    df = df.withColumn("_n", F.when((F.size("_w") == 1) & (F.element_at("_w", 1) == ""), 0).otherwise(F.size("_w")))
    windows = F.expr("""CASE WHEN _n >= 3 THEN transform(sequence(0, _n - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))
                        ELSE cast(array() AS array<bigint>) END""")
    df = df.withColumn("_h", windows)
    df = df.withColumn("_hot", F.size(F.array_distinct("_h")) < F.size("_h"))
    # (hash, place) in order: equal windows are neighbours; only texts that have any are sorted
    df = df.withColumn("_s", F.expr("""CASE WHEN _hot THEN sort_array(transform(_h, (h, i) -> struct(h, i)))
                                        ELSE cast(array() AS array<struct<h:bigint,i:int>>) END"""))
    df = df.withColumn("_p", F.expr("""sort_array(transform(filter(_s, (x, k) -> (k > 0 AND _s[k - 1].h = x.h)
                                        OR (k + 1 < size(_s) AND _s[k + 1].h = x.h)), x -> x.i))"""))
    covered = F.expr("""aggregate(_p, struct(-3 AS last, 0L AS n),
                        (a, p) -> struct(p AS last, a.n + CASE WHEN p - a.last >= 3 THEN 3L ELSE cast(p - a.last AS bigint) END), a -> a.n)""")
    full = F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    df = df.withColumn("_lines", full)
    df = (df.withColumn("n_words", F.col("_n").cast("long"))
          .withColumn("word_chars", F.length(F.translate("_t", SPACES, "")).cast("long"))
          .withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"))
          .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
          .withColumn("n_repeat_words", covered)
          .withColumn("_n_lines", F.size("_lines"))
          .withColumn("_upper", F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")))
          .withColumn("_kinds", F.size(F.array_distinct("_w"))))
    return df.drop("_t", "_w", "_h", "_s", "_p", "_n", "_hot", "_lines")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def voted(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    sym, rep, up = F.col("n_symbols") / n, F.col("n_repeat_words") / n, F.col("_upper") / F.greatest("word_chars", F.lit(1))
    dup, size = F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)), F.col("word_chars") / n
    variety = F.col("_kinds") / F.sqrt(n)
    return df.withColumn("votes", F.array(
        _vote(F.col("n_words") >= 80, F.col("n_words") < 50),                       # length
        _vote(sym < 0.05, sym > 0.3),                                               # symbols
        _vote(dup < 0.05, dup > 0.3),                                               # repeated lines
        _vote(rep < 0.1, rep > 0.35),                                               # repeated windows
        _vote(up < 0.1, up > 0.3),                                                  # capitals
        _vote((size >= 3) & (size <= 9), (size < 2) | (size > 14)),                 # word size
        _vote((variety > 4) & (n >= 50), (variety < 2) & (n >= 50)),                # different words
    ))


def _posterior(good: float, right: list[tuple[float, float]]) -> Column:
    """P(good | votes); ``right`` holds each rule's P(right | it votes) on good and on bad documents."""
    weights = ", ".join(f"struct({math.log(a / (1 - b))!r}D AS up, {math.log((1 - a) / b)!r}D AS down)" for a, b in right)
    odds = F.expr(f"""aggregate(zip_with(votes, array({weights}), (v, w) -> CASE v WHEN 1 THEN w.up WHEN -1 THEN w.down ELSE 0D END),
                                {math.log(good / (1 - good))!r}D, (a, x) -> a + x)""")
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """P(good) and each rule's accuracies from the table ``votes array<int>, n`` of vote patterns."""
    good, right = PRIOR_GOOD, [(PRIOR_RIGHT, PRIOR_RIGHT)] * rules
    clip = lambda x: min(max(x, 0.02), 0.98)
    rate = lambda yes, no: clip((yes + PSEUDO * PRIOR_RIGHT) / (yes + no + PSEUDO))
    for _ in range(rounds):
        judged = patterns.withColumn("p", _posterior(good, right))
        every = judged.select("n", "p", F.posexplode(F.concat("votes", F.array(F.lit(1)))).alias("rule", "vote"))  # the last: every document
        sums = every.groupBy("rule", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad"))
        got = {(r.rule, r.vote): (r.good, r.bad) for r in sums.collect()}  # three rows a rule at most
        if not got:
            break
        of = lambda k, v: got.get((k, v), (0.0, 0.0))  # noqa: E731, B023
        well, ill = of(rules, 1)
        good = clip((well + PSEUDO * PRIOR_GOOD) / (well + ill + PSEUDO))
        right = [(rate(of(k, 1)[0], of(k, -1)[0]), rate(of(k, -1)[1], of(k, 1)[1])) for k in range(rules)]
    return good, right


def quality_rules(docs: DataFrame, keep_at: float = 0.5, rounds: int = ROUNDS, keep_text: bool = True) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``p_good`` (posterior) and ``kept``.

    The counts are computed once and written to the shared scratch folder with the row (without the
    text unless ``keep_text``): a filter on ``kept`` must not be pushed into them.
    """
    out = scratch_root(docs.sparkSession, "quality")
    df = voted(measured(docs.drop("base_failed", "p_good", "kept")))
    (df if keep_text else df.drop("text")).write.parquet(out)
    df = docs.sparkSession.read.parquet(out)
    found = df.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** rules rows at most
    patterns = docs.sparkSession.createDataFrame(found, "votes array<int>, n long").coalesce(1)
    good, right = fit(patterns, len(found[0].votes) if found else RULES, rounds)
    out = (df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
           .withColumn("p_good", _posterior(good, right))
           .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at)))
    return out.drop("votes", "_n_lines", "_upper", "_kinds")
