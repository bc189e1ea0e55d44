"""Phrase growth and line dedup against brute force, on awkward rows and with small constants."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import common, line_dedup, phrases

from .conftest import make

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WS = " \t\n\x0b\x0c\r"


# 11 phrases


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
        yield [w for w in re.split(r"[\x20\x09]+", piece) if w]


def brute_phrases(rows, longest, least, inside=50, top=2000):
    """lang, rank, phrase, a, l, r, n, score, with whole numbers of Python."""
    f = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for w in pieces(text):
            for m in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        n = sum(k for g, k in c.items() if len(g) == 1)
        often = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        around = Counter()
        for g, a in often.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    around[g[i : i + m]] = max(around[g[i : i + m]], a)
        scored = []
        for g, a in often.items():
            if g in around and 100 * around[g] >= inside * a:
                continue
            score, k = min((1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l_, r, n, -s) for i, (s, a, p, l_, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("longest, least, top", [(2, 2, 2000), (3, 10, 30), (4, 3, 2000)])
def test_phrases(docs, rows, none, longest, least, top):
    got = phrases.mine(docs, longest, least, top=top)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, longest, least, top=top)
    assert phrases.mine(none).count() == 0


AWKWARD = [
    (1, "a b a b a b a b, a b. A B! a\tb\x0bb a", "en", "s"), (2, "a b c d a b c d a b c d", "en", "s"), (3, "É é É é É é É é", "fr", "s"), (4, None, "en", None),
    (5, "", "en", "s"), (6, ".,;:!? \n\t", None, "s"), (7, "x y x y x y", None, "s"), (8, "x y x y", "und", "s"), (2, "a b c d a b c d a b c d", "en", "s"),
    (9, "same same same same same same", "de", "s"), (10, "z" * 3_000_000 + " z " + "z" * 3_000_000, "de", "s"), (11, "p q r s t " * 5, "en", "s"),
]


def test_phrases_awkward(spark, monkeypatch):
    """Hot prefixes split by the next word, full filters, and words that share a hash at first."""
    monkeypatch.setattr(phrases, "PREFIX_ROWS", 0)
    monkeypatch.setattr(phrases, "TASK_ROWS", 2)
    monkeypatch.setattr(phrases, "PARTS", 2)
    monkeypatch.setattr(phrases, "LEAST_BITS", 6)
    monkeypatch.setattr(phrases, "MOST_BITS", 6)
    monkeypatch.setattr(phrases, "_VALUE", np.ones(256, np.uint64))
    monkeypatch.setattr(phrases, "BROADCAST_BYTES", 0)
    got = phrases.mine(make(spark, AWKWARD), 4, 2)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(AWKWARD, 4, 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab .,\n", max_size=40), max_size=6), st.integers(2, 4), st.integers(1, 3))
def test_growth_counts_all(texts, longest, least):
    """The projections of one task, grown, are all frequent phrases."""
    everything = type("All", (), {"value": np.full(1, 2**64 - 1, np.uint64)})
    nothing = type("None_", (), {"value": np.zeros(1, np.uint64)})
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts), pa.string()), pa.array(texts, pa.string())], ["lang", "text"])
    got = [t.to_pydict() for t in phrases._windows(phrases._VALUE, everything, everything, nothing, longest)([batch])]
    want = Counter()
    for t in texts:
        for w in pieces(t):
            for m in range(2, longest + 1):
                want.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    want = sorted((len(g), n) for g, n in want.items() if n >= least)
    if not got:
        assert not want
        return
    grown = phrases._grow(2, longest, least)(pa.table(got[0])).to_pydict()
    size = [sum(grown[f"w{i + 1}"][r] != 0 for i in range(longest)) for r in range(len(grown["f"]))]
    assert sorted(zip(size, grown["f"])) == want


# 12 lines


def key(line):
    return line.strip(WS).translate(LOW)


def brute_lines(rows, least, shortest=1):
    found = Counter()
    for _, text, *_ in rows:
        found.update({key(x) for x in (text or "").split("\n")})
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(key(x)) < max(1, shortest) or found[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return Counter(out)


LINES = [(i, f"Shared line\n  own {i}\n\nSHARED LINE\t\n twice\ntwice", "en", "s") for i in range(6)]
LINES += [(10, None, None, None), (11, "", "en", "s"), (12, "\n\n", "en", "s"), (13, "shared line", "en", "s"), (14, "É\né", "fr", "s"), (15, "é\nÉ", "fr", "s"), (None, "own 3\n" * 4, "en", "s"), (3, LINES[3][1], "en", "s")]
LINES += [(16, "\n".join(f"l{i}" if i % 3 else "shared line" for i in range(30_000)), "en", "s")]


@pytest.mark.parametrize("least, shortest, batches", [(2, 1, 4), (3, 4, 1), (7, 1, 7)])
def test_lines(spark, none, least, shortest, batches):
    got = line_dedup.line_dedup(make(spark, LINES), least, shortest, batches)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute_lines(LINES, least, shortest)
    assert line_dedup.line_dedup(none).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_lines_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    docs = make(spark, LINES)
    assert Counter(tuple(r) for r in line_dedup.line_dedup(docs, 3).collect()) == brute_lines(LINES, 3)
    stripped = line_dedup.strip_lines(docs, 3)
    assert stripped.columns == [*docs.columns, "n_lines", "dropped"]
    texts = {r["doc_id"]: r["text"] for r in stripped.collect()}
    assert texts[2] == "  own 2\n" and texts[13] == "" and texts[10] is None


def test_runs_are_levelled_and_settle_keys(spark, tmp_path):
    runs = line_dedup.Runs(spark, f"file://{tmp_path}", buckets=3, least=3, fanout=2)
    seen, sizes = Counter(), []
    for b in range(5):
        batch = Counter({("often", 0): 1, (f"own{b}", 1): 1, (f"pair{b // 2}", 2): 2})
        settled = {k for k, n in seen.items() if n >= 3}
        seen.update(batch)
        runs.add(spark.createDataFrame([(hash(k[0]) & 0xFFFF, k[1], n) for k, n in batch.items()], "h long, g long, n long"))
        sizes.append([len(level) for level in runs.levels])
        newest = runs.tables()[0] if runs.levels[0] else None
        if newest:  # what was settled before is in no later run
            assert not {hash(k[0]) & 0xFFFF for k in settled} & {r.h for r in spark.table(newest).collect()}
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert {r.h for r in runs.settled().collect()} == {hash(k[0]) & 0xFFFF for k, n in seen.items() if n >= 3}
    plan = spark.table(runs.tables()[-1]).join(spark.table(runs.tables()[0]).hint("merge"), ["h", "g"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
