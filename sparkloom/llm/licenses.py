"""License scan: keyword-gated signature rules, then priority and interval containment.

DataFrame functions only. Texts become canonical words once; a rule's pattern runs only on texts
with its keyword; overlapping detections are settled by running maxima in a window over a
document's matches, which are all that is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .license_rules import gate_word, rules

#: Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEVELS = 4
#: The two characters beyond A-Z whose lower case has an ASCII letter, and stand-ins without one.
ODD = [("\u0130", "\u0131"), ("\u212a", "\u0138")]


def canonical(text: Column) -> Column:
    """' w1 w2 ... wn ': lower case, words apart by single spaces, one at either end. Other letters
    than A-Z are lower-cased too, which moves no word: none of them becomes an ASCII letter."""
    plain = F.coalesce(text, F.lit(""))
    for odd, other in ODD:
        plain = F.replace(plain, F.lit(odd), F.lit(other))
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(plain), F.lit(" ")), SEPARATOR, " ")


def places(canon: Column, words: Column, phrase: str) -> Column:
    """Word positions at which the phrase stands."""
    first, *rest = phrase.split(" ")
    here = lambda w, i: reduce(lambda a, x: a & (F.get(words, i + x[0] + 1) == x[1]), enumerate(rest), w == first)
    marks = F.transform(words, lambda w, i: F.when(here(w, i), i))
    return F.when(F.contains(canon, F.lit(f" {phrase} ")), F.filter(marks, lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>"))


def opened(c: str, words: str) -> Column:
    """(rule, its matches) of every rule whose keyword is in column c and that matches. Each pattern
    is a literal, so it is compiled once, and tried only on texts with its keyword; that is looked
    for only if its longest word is among `words`. Written as SQL, which is parsed in one go."""
    by: dict[str, list] = {}
    for i, (_, _, keyword, pattern, _) in enumerate(rules()):
        by.setdefault(keyword, []).append(f"named_struct('id', {i}, 'hits', regexp_extract_all({c}, r'(?<= )(?:{pattern})(?= )', 0))")
    there = lambda k: " OR ".join(f"array_contains({words}, '{gate_word(x)}') AND contains({c}, ' {x} ')" for x in k.split("|"))
    groups = ", ".join(f"CASE WHEN {there(k)} THEN array({', '.join(tried)}) END" for k, tried in by.items())
    return F.expr(f"filter(flatten(filter(array({groups}), g -> g IS NOT NULL)), r -> size(r.hits) > 0)")


def matches(docs: DataFrame) -> DataFrame:
    """One scan: doc_id, __rid, n_words, __places (an array for each base phrase) and __hits, every
    match of every opened rule as (rule, first character, one past its last, its first word, words).

    A text is searched for keywords only where it has a word of theirs. A match's place is
    where its text next stands as whole words: patterns look no further than their own ends, so
    there is none before it."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("__rid"), canonical(F.col("text")).alias("__c"))
    c, w = F.col("__c"), F.col("__w")
    rows = rows.withColumn("__w", F.when(F.length(F.btrim(c)) > 0, F.split(F.btrim(c), " ")).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<struct<id:int,hits:array<string>>>")
    gates = F.array(*map(F.lit, sorted({gate_word(k) for r in rules() for k in r[2].split("|")})))
    rows = rows.withColumn("__gates", F.array_intersect(gates, w))
    rows = rows.withColumn("__rules", F.when(F.size("__gates") > 0, opened("__c", "__gates")).otherwise(none))
    spaces_in = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("int")
    empty = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))

    def found(r: Column) -> Column:
        def step(acc, hit):
            at = F.call_function("locate", F.concat(F.lit(" "), hit, F.lit(" ")), c, acc["at"])
            return F.struct((at + F.length(hit) + 1).alias("at"), F.array_append(acc["starts"], at).alias("starts"))

        starts = F.aggregate(r["hits"], empty, step, lambda acc: acc["starts"])
        return F.zip_with(r["hits"], starts, lambda h, s: F.struct(r["id"].alias("id"), s.alias("start"), (s + F.length(h)).alias("end"), (spaces_in(F.substr(c, F.lit(1), s)) - 1).alias("first_word"), (spaces_in(h) + 1).alias("words")))

    rows = rows.withColumn("__hits", F.flatten(F.transform("__rules", found)))
    return rows.select("doc_id", "__rid", F.size(w).cast("long").alias("n_words"), F.array(*[places(c, w, p) for p, _ in BASE]).alias("__places"), "__hits")


def of_rule(id_: str) -> Column:
    """prio, label and weight of the rule in column id_: a literal table."""
    return F.expr("get(array(" + ", ".join(f"named_struct('prio', {p}, 'label', '{label}', 'weight', {w}D)" for p, label, _, _, w in rules()) + f"), {id_})")


def detections(found: DataFrame) -> DataFrame:
    """All matches with their places, and whether they stand: __rid, label, weight, first_word,
    n_words, kept. A match is suppressed by one that contains it with a better priority, or with
    the same priority if that is longer or its rule comes first."""
    hits = found.filter(F.size("__hits") > 0).select("__rid", F.explode("__hits").alias("h")).select("__rid", "h.*")
    hits = hits.withColumn("r", of_rule("id")).select("*", "r.*").drop("r")
    at = hits.repartition("__rid")
    earlier = Window.partitionBy("__rid").orderBy("start", F.desc("end"), "prio", "id").rowsBetween(Window.unboundedPreceding, -1)
    inside = reduce(lambda a, b: a | b, [(F.col("prio") >= p) & (F.coalesce(F.max(F.when(F.col("prio") == p, F.col("end"))).over(earlier), F.lit(-1)) >= F.col("end")) for p in range(1, LEVELS + 1)])
    return at.select("__rid", "id", "label", "weight", "start", "end", F.col("first_word").cast("long").alias("first_word"), F.col("words").cast("long").alias("n_words"), (~inside).alias("kept"))


def scan(docs: DataFrame) -> DataFrame:
    """Find license marks in whole texts.

    Returns doc_id, n_words, n_base (places of base phrases), first_word, last_word (their smallest
    and largest start, else null), base_labels, labels (with those of detections that stand),
    score (the best weight of what was found, 0 if nothing), a row per document. Null text counts
    as empty: no words, no labels. Repeated rows are scanned alike; other columns are ignored; an
    empty table gives an empty one. What the scan finds is written once to the shared folder."""
    found = cut(matches(docs))
    stands = detections(found).filter("kept").groupBy("__rid").agg(F.collect_set("label").alias("__l"), F.max("weight").alias("__s"))  # at most one of each label
    rows = found.drop("__hits").join(stands, "__rid", "left")
    flat = F.flatten("__places")
    base = F.filter(F.array(*[F.when(F.size(F.get("__places", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    labels = F.array_union(base, F.coalesce("__l", F.array().cast("array<string>")))
    score = F.greatest(F.coalesce("__s", F.lit(0.0)), F.when(F.size(flat) > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"), F.array_max(flat).cast("long").alias("last_word"), F.array_join(F.sort_array(base), ",").alias("base_labels"), F.array_join(F.sort_array(labels), ",").alias("labels"), score.alias("score"))
