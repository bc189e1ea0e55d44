"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

DataFrame functions only: features in one scan, votes as columns, each EM step one aggregate over
the table of distinct vote patterns (at most 3 ** number of rules rows, whatever the corpus)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, cut

WINDOW = 8
STEPS = 100
#: The prior belief: the share of good documents, how often a rule that votes on a good one says
#: good, and how often it says so on a bad one. Each counts as much as PRIOR documents, of any corpus.
GOOD, SAYS_GOOD, SAYS_BAD, PRIOR = 0.9, 0.95, 0.4, 20.0


def split_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def add_repeats(rows: DataFrame) -> DataFrame:
    """From __w, the words, add __hashes of them and n_repeat_words: words inside WINDOW-word windows that occur twice or
    more in the text. A window's hash is made of those of its halves, and these of theirs. Sorted
    (hash, place) pairs, made only where the hashes are not all distinct, show the repeated places;
    each covers up to the next one. A column at each step, so that no expression is evaluated again
    inside a lambda."""
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = rows.withColumn("__hashes", F.transform("__w", lambda w: F.xxhash64(w)))
    step, width = step.withColumn("__win", F.col("__hashes")), 1
    while width < WINDOW:
        kept = F.greatest(F.size("__win") - width, F.lit(0))
        step = step.withColumn("__win", F.zip_with(F.slice("__win", F.lit(1), kept), F.slice("__win", F.lit(width + 1), kept), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    pairs = F.sort_array(F.transform("__win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.withColumn("__pairs", F.when(F.size(F.array_distinct("__win")) == F.size("__win"), none).otherwise(pairs))
    near = lambda x, k: F.coalesce(F.get(F.col("__pairs"), k)["h"] == x["h"], F.lit(False))
    twice = F.filter("__pairs", lambda x, k: near(x, k + 1) | near(x, k - 1))
    step = step.withColumn("__starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    spans = F.transform("__starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__starts"), k + 1) - p, F.lit(WINDOW))))
    return step.withColumn("n_repeat_words", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features, from one scan of the whole texts."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t"))
    rows = rows.withColumn("__w", split_words(F.col("__t")))
    rows = rows.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(WS)) != ""))
    rows = add_repeats(rows)
    t = F.col("__t")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    found = {
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_repeat_words": F.col("n_repeat_words"),
        "n_upper": count("[A-Z]"),
        "n_marks": count(r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"),
        "n_ends": count(r"[.!?](?![^\x20\x09-\x0D])"),
        "n_bars": (F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))).cast("long"),
        "n_distinct": F.size(F.array_distinct("__hashes")).cast("long"),
    }
    return rows.select("doc_id", *[v.alias(k) for k, v in found.items()])


def votes() -> dict[str, Column]:
    """Rule name -> -1 (bad), 1 (good) or 0 (abstains). Every rule votes either way; between its two
    bounds, or where a text is too short to tell, it abstains."""

    def rule(bad: Column, good: Column, on: Column | None = None) -> Column:
        vote = F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
        return (vote if on is None else F.when(on, vote).otherwise(F.lit(0))).cast("tinyint")

    n, chars, c = F.col("n_words"), F.col("word_chars"), F.col
    return {
        "v_length": rule((chars * 2 > n * 15) | (chars < n * 3), (chars * 2 <= n * 13) & (chars * 2 >= n * 7)),
        "v_symbols": rule(c("n_symbols") * 4 > n, c("n_symbols") * 50 <= n),
        "v_marks": rule(c("n_marks") * 7 > chars, c("n_marks") * 14 <= chars),
        "v_ends": rule((c("n_ends") * 40 < n) | (c("n_ends") * 3 > n), (c("n_ends") * 30 >= n) & (c("n_ends") * 4 <= n), n >= 40),
        "v_upper": rule(c("n_upper") * 2 > chars, c("n_upper") * 6 <= chars),
        "v_lines": rule((c("n_dup_lines") >= 2) & (c("n_dup_lines") * 10 > c("n_lines") * 3), c("n_dup_lines") * 10 <= c("n_lines"), c("n_lines") >= 3),
        "v_repeats": rule(c("n_repeat_words") * 5 > n, c("n_repeat_words") * 20 <= n, n >= 50),
        "v_bars": rule(c("n_bars") * 5 > n, c("n_bars") * 50 <= n),
        "v_variety": rule(c("n_distinct") * c("n_distinct") < 9 * n, c("n_distinct") * c("n_distinct") > 16 * n, n >= 50),
    }


def logit(p: float) -> float:
    return math.log(p) - math.log(1 - p)


def log_odds(model: dict) -> Column:
    """Log odds of good against bad, for a row with the vote columns: the prior's, and for each vote
    the log ratio of its likelihoods in good and bad documents. Who abstains adds nothing."""
    total = F.lit(logit(model["good"]))
    for name, (good, bad) in model["rules"].items():
        total = total + F.when(F.col(name) > 0, F.lit(math.log(good / bad))).when(F.col(name) < 0, F.lit(math.log((1 - good) / (1 - bad)))).otherwise(F.lit(0.0))
    return total


def fit(patterns: DataFrame, names: list[str], steps: int = STEPS) -> dict:
    """Expectation-maximisation over the vote patterns (vote columns and n).

    The model has the share of good documents and, for each rule, how often it votes good on good
    documents and on bad ones, given that it votes; votes count as independent within a class, and
    whether a rule votes as told by neither. The prior belief is worth PRIOR documents in each of
    these, so a corpus of some thousand documents overrules it. An empty table keeps the prior."""
    model: dict = {"good": GOOD, "rules": dict.fromkeys(names, (SAYS_GOOD, SAYS_BAD))}
    q, n = F.col("__q"), F.col("n")
    cells = [F.sum(F.when(F.col(v).isin(*which), n * part)) for v in names for part in (q, 1 - q) for which in ((1,), (-1, 1))]
    for _ in range(steps):
        post = 1 / (1 + F.exp(-log_odds(model)))
        good, all_, *sums = patterns.withColumn("__q", post).agg(F.sum(n * q), F.sum("n"), *cells).first()
        if not all_:
            break
        rate = lambda said, cast, belief: ((said or 0.0) + PRIOR * belief) / ((cast or 0.0) + PRIOR)
        rules = {v: (rate(*sums[4 * i : 4 * i + 2], SAYS_GOOD), rate(*sums[4 * i + 2 : 4 * i + 4], SAYS_BAD)) for i, v in enumerate(names)}
        new = {"good": rate(good, all_, GOOD), "rules": rules}
        moved = max(abs(a - b) for v in names for a, b in zip(new["rules"][v], model["rules"][v]))
        model = new
        if moved < 1e-4:
            break
    return model


def failed() -> Column:
    """The base rule that always rejects: under 20 words, or over 30 % of words in repeats."""
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def voted(rows: DataFrame) -> DataFrame:
    """Features with the votes and base_failed."""
    return rows.select("*", *[v.alias(k) for k, v in votes().items()], failed().alias("base_failed"))


def fit_rows(rows: DataFrame) -> dict:
    """The model of the documents that pass the base rule. rows: votes and base_failed."""
    rules = list(votes())
    return fit(cut(rows.filter("not base_failed").groupBy(*rules).agg(F.count(F.lit(1)).alias("n"))), rules)


def judge(docs: DataFrame) -> DataFrame:
    """Score documents by weighed votes: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, the votes and quality (the posterior), a row per document.

    base_failed (under 20 words, or over 30 % of words in repeated windows) always rejects; else a
    document is kept if its posterior is at least 0.5. Null text counts as empty and fails the
    base; repeated rows are judged alike; other columns are ignored; an empty table gives an empty
    one. Features are written once to the shared folder (a few numbers a document) and read for
    the patterns and for the verdicts."""
    rows = cut(voted(features(docs)))
    rows = rows.withColumn("quality", 1 / (1 + F.exp(-log_odds(fit_rows(rows)))))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), *votes(), "quality")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents `judge` keeps, rows and columns as they came, whatever their names. One scan
    writes rows and votes to the shared folder; the model is fitted on the votes alone, and the
    verdicts filter what was written."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = voted(features(docs.select(whole.alias("doc_id"), "text")))  # the row rides along in place of its id
    seen = cut(rows.select("doc_id", *votes(), "base_failed"))
    return seen.filter(~F.col("base_failed") & (log_odds(fit_rows(seen)) >= 0)).select("doc_id.*")
