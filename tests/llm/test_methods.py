"""The methods themselves: planted rules, a plain convolution, whole groups, small chunks, clashing names."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import classifier, line_dedup, mixing, ngram_lm, phrases, quality_rules, sharding

from .conftest import make, words


def test_em_finds_planted_accuracies(spark):
    """Rules that vote right with known chances, one worse than chance and one that often abstains."""
    rng = np.random.default_rng(12)
    chances = {"a": (0.95, 0.9), "b": (0.85, 0.8), "c": (0.9, 0.7), "d": (0.75, 0.75), "e": (0.3, 0.25), "f": (0.9, 0.9)}
    good = rng.random(6000) < 0.7
    votes = {k: np.where(rng.random(6000) < np.where(good, g, b), np.where(good, 1, -1), np.where(good, -1, 1)) for k, (g, b) in chances.items()}
    votes["f"] = np.where(rng.random(6000) < 0.4, 0, votes["f"])
    rows = Counter(zip(*(v.tolist() for v in votes.values())))
    df = spark.createDataFrame([(*k, n) for k, n in rows.items()], ", ".join(f"{k} int" for k in chances) + ", n long")
    model = quality_rules.fit(df, list(chances))
    assert model["good"] == pytest.approx(0.7, abs=0.03)
    for k, (g, b) in chances.items():
        says_good, says_bad = model["rules"][k]
        assert says_good == pytest.approx(g, abs=0.04) and says_bad == pytest.approx(1 - b, abs=0.06)
    assert model["rules"]["e"][0] < model["rules"]["e"][1]  # its word counts against itself
    assert quality_rules.fit(df.limit(0), list(chances))["good"] == quality_rules.GOOD


def test_scores_equal_a_plain_convolution():
    net, rng = classifier.Net(5), np.random.default_rng(3)
    texts = [b"", b"a", b"hello ### world " * 40, bytes(rng.integers(32, 126, 1000, dtype=np.uint8)), b"x" * classifier.CHUNK]
    half = classifier.HALF
    for text, got in zip(texts, net.score(texts)):
        padded = text + b"\0" * (classifier.WIDTH + 1)
        places = len(text) + 1
        r = np.array([sum(net.w[k, padded[i + k]] for k in range(classifier.WIDTH)) for i in range(places)])
        halves = [r[i : i + half].max(0) for i in range(0, places, half)]
        chunks = [np.maximum(a, b) for a, b in zip(halves, [*halves[1:], halves[-1]])]
        z = np.maximum(np.array(chunks) + net.b, 0)
        want = 1 / (1 + math.exp(-float(z.mean(0) @ net.u + z.max(0) @ net.v + net.c[0])))
        assert got == pytest.approx(want, abs=1e-5)


def test_equal_texts_share_a_shard(spark):
    """Copies stay together; only a group larger than a shard's share is cut, and bytes stay level."""
    rows = [(i, f"text {i % 60} " * (3 + i % 5 * (i % 60 == i)), "en", "s") for i in range(600)] + [(1000 + i, "hot " * 50, "en", "s") for i in range(300)] + [(2000, None, None, None), (2001, "", "en", "s")]
    got = sharding.shard(make(spark, rows), 7).collect()
    texts, where, total = {i: t or "" for i, t, *_ in rows}, defaultdict(set), defaultdict(int)
    for r in got:
        where[texts[r["doc_id"]]].add(r["shard"])
        total[r["shard"]] += r["size"]
        assert r["group_parts"] == 1 or texts[r["doc_id"]] == "hot " * 50
    assert all(len(s) == 1 for t, s in where.items() if t != "hot " * 50) and len(where["hot " * 50]) > 1
    assert max(total.values()) - min(total.values()) <= 0.02 * sum(total.values()) / 7 + 20


def test_differencing_is_no_worse_than_greedy():
    rng = np.random.default_rng(6)
    better = 0
    for _ in range(20):
        sizes = [int(x) for x in rng.integers(1, 10_000, 120)]
        bins = [0] * 8
        for s in sorted(sizes, reverse=True):
            bins[bins.index(min(bins))] += s
        load = [0] * 8
        for s, b in zip(sizes, sharding.solve(sizes, 8)):
            load[b] += s
        assert sum(load) == sum(sizes)
        better += max(load) - min(load) <= max(bins) - min(bins)
    assert better >= 19


def test_mix_in_small_chunks(spark, monkeypatch):
    """Several rounds of flights, and the same targets met."""
    monkeypatch.setattr(mixing, "FLIGHT", 16)
    import random

    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(5, 60)), "en", f"s{i % 3}") for i in range(400)]
    docs = make(spark, rows)
    got = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert len(got) == 400 and all(abs(taken[s] - t) <= 60 for s, t in target.items())


@pytest.mark.parametrize("texts", [["one"], ["", None], ["a b c", "a b", "c"], [f"w{i}" for i in range(12)]])
def test_language_model_on_a_handful(spark, texts):
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = ngram_lm.score(make(spark, rows)).collect()
    assert len(got) == len(texts) and all(r["score"] <= 0 and math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)


def test_names_that_clash(spark):
    """Columns with the operators' own names ride along."""
    extra = {c: F.lit(7) for c in ("rid", "rid_", "copies", "copies_", "__w", "__n", "_metadata", "at", "batch", "h", "g", "k", "f", "rep", "node", "comp", "piece", "__bits", "__in", "sig", "rank")}
    rows = [(i, f"a plain text of some words number {i} and {i * 7 % 13} more. " * 4 + "\nthe same line", "en", "s") for i in range(12)]
    docs = make(spark, [*rows, rows[0]]).withColumns(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
    assert line_dedup.line_dedup(docs).filter("n_dropped = 1").count() == 13
    assert line_dedup.strip_lines(docs).columns == [*docs.columns, "n_lines", "dropped"]
    assert phrases.mine(docs, least=5).count() > 0
    assert mixing.mix(docs).count() == 13 and sharding.shard(docs, 3).count() == 13
