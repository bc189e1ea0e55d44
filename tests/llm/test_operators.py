"""Each operator against brute force on awkward rows, and on an empty table."""

import hashlib
import json
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import classifier, exact_dedup, licenses, mixing, near_dedup, ngram_lm, packing, pii, quality_rules, sharding
from sparkloom.llm.license_rules import rules as license_rules

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(i, m, k):
    return i is not None and zlib.crc32(str(i).encode()) % m == k


# 1 mixing


def test_mix_meets_targets(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(W.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, total = set(order), {}, 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level >= 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left.remove(s)
        if not left:
            break
    target |= {s: weight[s] * level for s in left}
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        biggest = max(len(W.findall(t or "")) for _, t, _, x in rows if x == s)
        assert abs(taken[s] - target[s]) <= max(60, 0.02 * target[s], biggest if s == "s2" else 0)
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0
    assert mixing.take_mix(docs).columns == docs.columns
    assert mixing.take_mix(docs).count() == sum(r["copies"] for r in got)
    assert mixing.take_mix(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=80), st.floats(0.05, 0.95), st.integers(0, 1 << 60))
def test_flight_keeps_both_sums(sizes, p, seed):
    out = mixing.flight([float(s) for s in sizes], [1.0] * len(sizes), [p] * len(sizes), seed)
    assert sum(1 for x in out if 1e-9 < x < 1 - 1e-9) <= 2 and all(-1e-9 <= x <= 1 + 1e-9 for x in out)
    assert sum(out) == pytest.approx(p * len(sizes), abs=1e-5)
    assert sum(a * b for a, b in zip(sizes, out)) == pytest.approx(p * sum(sizes), abs=1e-3)


def test_flight_keeps_probabilities():
    sizes, n = [float(5 + i * 7 % 31) for i in range(20)], np.zeros(20)
    for seed in range(800):
        n += mixing.flight(sizes, [1.0] * 20, [0.3] * 20, seed * 7919)
    assert np.abs(n / 800 - 0.3).max() < 0.08


# 2 personal data

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


AUTO = pii.automaton()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab.@+-0145 ()%é:/", max_size=60))
def test_pii_base_equals_patterns(text):
    found = pii.find(text, AUTO)
    assert ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in found[k]) == base_spans(text)


def test_pii_table(spark, docs, rows, none):
    texts = ["mail a.b@c.example.com, 1.2.3.4 and 999.1.1.1", "card 4111 1111 1111 1111 +1 (212) 555-0100", 'token = "9f3ab1cd9f3ab1cd" see https://u:p@x.org/a?b. Account number: 12345678', "1." * 500 + "@" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(base_spans(t).encode()).hexdigest()
    assert got[1]["n_card"] == 1 and got[1]["n_phone"] == 1 and "secret:" in got[2]["spans"] and "url:" in got[2]["spans"] and "account:" in got[2]["spans"]
    assert pii.redact(texts[0], pii.find(texts[0], AUTO)) == "mail [email], [ip] and 999.1.1.1"
    assert pii.find_pii(docs).count() == len(rows) and pii.find_pii(none).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty for r in pii.find_pii(docs).filter("doc_id between 200 and 202").collect())


@pytest.mark.parametrize("before, what, after", [("api_key=", "a1" * 300, " end"), ("IBAN: ", "GB82 WEST 1234 5698 7654 32", " is ours"), ("account ", "1234 5678 9012", ", closed"), ("account number: ", "12345678", " 2020 was"), ("iban ", "DE89370400440532013000", "")])
def test_pii_takes_whole_identifiers(before, what, after):
    text = before + what + after
    kind = "secret" if "key" in before else "account"
    assert pii.find(text, AUTO)[kind] == [(len(before), len(before) + len(what))]
    assert what[-4:] not in pii.redact(text, pii.find(text, AUTO))


SECRETS = ["api_key: hunter2hunter", "password: correcthorsebattery", "secret = 'aB3xY9kLm2'", "my Password is abc12345", 'the "api_key": "opensesame",', "Bearer eyJhbGciOiJub25lIn0.e30.x", "token ghp_abcdefghijklmnopqrst", "PASSWORD=Tr0ubadour"]
NO_SECRETS = ["password policy", "token economy", "Token: Something", "the secret: because of", "password is required", "secretary: information", "a token of appreciation", "password: required", "Secret Intelligence", "api key rotation"]


@pytest.mark.parametrize("text", SECRETS)
def test_pii_secrets_by_shape(text):
    found = pii.find(text, AUTO)
    assert len(found["secret"]) == 1
    start, end = found["secret"][0]
    assert text[start:end] not in pii.redact(text, found) and not set(text[start:end]) & set("\"'")


@pytest.mark.parametrize("text", NO_SECRETS)
def test_pii_leaves_words_alone(text):
    assert pii.find(text, AUTO)["secret"] == []


def test_pii_runs_stay_linear():
    text = "token x_" + "token-secret_" * 100_000
    began = time.perf_counter()
    assert pii.find(text, AUTO)["secret"] == []
    assert time.perf_counter() - began < 20


# 3 quality rules


def brute_features(t):
    t = t or ""
    w = W.findall(t)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_quality_rules(spark, docs, rows, none):
    junk = [(1000 + i, " ".join(f"w{i}{j}###" for j in range(60)), "en", "s") for i in range(6)]
    shout = [(1100 + i, " ".join(f"LOUD{i}{j}!!" for j in range(60)), "en", "s") for i in range(6)]
    clean = [(1200 + i, "Plain text of " + " ".join(f"word{(i * 7 + j) % 97}" for j in range(80)) + ".\nAnother line.", "en", "s") for i in range(80)]
    from .conftest import make

    every = rows + junk + shout + clean
    got = quality_rules.judge(make(spark, every)).collect()
    assert len(got) == len(every)
    by = defaultdict(list)
    for i, t, _, _ in every:
        by[i].append(brute_features(t))
    for r in got:
        f = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert f in by[r["doc_id"]]
        assert r["base_failed"] == (f[0] < 20 or 100 * f[4] > 30 * f[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[i] for i, *_ in junk + shout) and all(kept[i] for i, *_ in clean)
    assert quality_rules.judge(none).count() == 0
    stay = quality_rules.keep_good(make(spark, every))
    assert stay.columns == make(spark, []).columns
    assert Counter(r["doc_id"] for r in stay.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert quality_rules.keep_good(none).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=30), min_size=1, max_size=4))
def test_repeats_small_alphabet(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.features(df).collect()}
    assert got == {i: brute_features(" ".join(t))[4] for i, t in enumerate(texts)}


# 4 classifier


def test_gradients_by_differences():
    net, rng = classifier.Net(3), np.random.default_rng(0)
    net.w = net.w.astype(np.float64)
    texts, y = [b"hello world " * 60, b"### !!", b""], np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.score(texts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for param, grad in zip(net.params(), net.gradients(texts, y)):
        order = np.argsort(-np.abs(grad.ravel()))[:3]
        for i in order:
            was, e = param.flat[i], 1e-3
            param.flat[i] = was + e
            up = loss()
            param.flat[i] = was - e
            down = loss()
            param.flat[i] = was
            assert (up - down) / (2 * e) == pytest.approx(grad.flat[i], rel=0.08, abs=2e-4)
    del rng


def test_long_text_scores_alike():
    net = classifier.Net(3)
    text = bytes(np.random.default_rng(1).integers(32, 120, 1_200_001, dtype=np.uint8))
    assert classifier.score_long(net, text)[0] == pytest.approx(net.score([text])[0], abs=1e-5)


def test_classifier_held_out(spark, none, sf):
    d = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = classifier.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert all(held(i, 3, 1) for i in got["doc_id"])
    good, bad = got[got["quality"] == 1]["score"].to_numpy(), got[got["quality"] == 0]["score"].to_numpy()
    assert np.mean(good[:, None] > bad[None]) > 0.93
    texts, marks = classifier.sample(docs, labels, 10)
    assert len(texts) <= 20 and set(marks) == {0, 1}
    assert classifier.classify(none, labels.limit(0)).count() == 0


def test_classifier_scores_everything(spark, docs, rows):
    got = classifier.score(docs, classifier.train([b"good text", b"### ###"] * 4, [1, 0] * 4)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)


# 5 licenses


def test_license_base_and_labels(spark, docs, rows, none):
    texts = ["Licensed under CC BY-NC 4.0. cc by cc by CC-BY", "GNU General Public License, version 3; all rights reserved", "Permission is hereby granted, free of charge, to any person obtaining a copy", "SPDX-License-Identifier: Apache-2.0", "Released under the MIT License.", "nothing", "", None, "accby cc bye", "ＡLL rights reserved All Rights\nReserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w, at, labels = word.findall((t or "").translate(LOW)), [], set()
        for phrase, label in licenses.BASE:
            q = phrase.split()
            here = [k for k in range(len(w)) if w[k : k + len(q)] == q]
            at += here
            labels |= {label} if here else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert "cc-by-nc-4.0" in got[0]["labels"] and "gpl-3.0" in got[1]["labels"] and got[2]["labels"] == "mit" and got[3]["labels"] == "apache-2.0" and got[4]["labels"] == "mit" and got[5]["score"] == 0
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(none).count() == 0


def test_license_containment(spark):
    text = "x licensed under the gnu general public license version 3 y gnu general public license version 3"
    found = licenses.matches(spark.createDataFrame([(1, text)], "doc_id long, text string")).cache()
    rows = licenses.detections(found).collect()
    canon = f" {text} "
    all_ = {(m.start(), m.end(), i, p) for i, (p, _, k, pat, _) in enumerate(license_rules()) if k in canon for m in re.finditer(rf"(?<= )(?:{pat})(?= )", canon)}
    assert {(r["start"], r["end"], r["id"]) for r in rows} == {x[:3] for x in all_}
    for r in rows:
        p = license_rules()[r["id"]][0]
        inside = any(s <= r["start"] and r["end"] <= e and (q < p or (q == p and ((e - s) > r["end"] - r["start"] or i < r["id"]))) for s, e, i, q in all_ if (s, e, i) != (r["start"], r["end"], r["id"]))
        assert r["kept"] == (not inside)
        assert canon[: r["start"]].count(" ") - 1 == r["first_word"]


def test_rules_compile():
    assert len(license_rules()) > 200 and all(re.compile(r[3]) for r in license_rules())


# 6 near duplicates


def brute_components(rows, width):
    sets = {}
    for i, (d, t, *_) in enumerate(rows):
        w = W.findall((t or "").translate(LOW))
        sets[i] = set(zip(*[w[k:] for k in range(width)])) if len(w) >= width else {tuple(w)} if w else set()
    link = list(range(len(rows)))

    def root(x):
        while link[x] != x:
            x = link[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                link[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        low[root(i)].append(d)
    order = lambda d: (d is None, d or 0)
    return [(len(sets[i]), min(low[root(i)], key=order)) for i in range(len(rows))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(docs, rows, none, width):
    got = near_dedup.near_dedup(docs, width).collect()
    want = Counter((r[0], *x) for r, x in zip(rows, brute_components(rows, width)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    groups = defaultdict(int)
    for r in got:
        if r["n_shingles"]:
            groups[r["component_id"]] += r["kept"]
    assert set(groups.values()) == {1}
    stay = near_dedup.drop_near(docs, width)
    assert stay.columns == docs.columns and stay.count() == sum(r["kept"] for r in got)
    assert near_dedup.near_dedup(none, width).count() == 0 and near_dedup.drop_near(none, width).count() == 0


def test_near_dedup_with_small_bounds(docs, rows, monkeypatch):
    """Hot centres split, buckets that send stars for several rounds, and blocks at the end."""
    for name, value in (("CROSSING", 0), ("WHOLE", 0), ("SPLIT", 2), ("BLOCK", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    got = near_dedup.near_dedup(docs, 2).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((r[0], *x) for r, x in zip(rows, brute_components(rows, 2)))


def test_near_dedup_tests_large_mixed_buckets_whole(spark, tmp_path):
    """Versions of one text: 497 heavily edited ones that reach no other, three lightly edited that reach each other."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(500):
        w = [f"base{k}" for k in range(300)]
        for k in rng.choice(np.arange(0, 300, 3), 8 if i % 150 == 149 else 17, replace=False):
            w[k] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = near_dedup.near_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()
    want = Counter((r[0], *x) for r, x in zip(rows, brute_components(rows, 2)))
    assert len({c for _, _, c in want}) == 498
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
    for share in (0.5, 0.8, 0.95):
        n = round(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[:n]], rng.integers(0, 1 << 63, len(a) - n, dtype=np.uint64)]))
        s = near_dedup.sketch([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.12
    one = near_dedup.sketch([a[:1]])
    assert (one == a[0]).all()


# 7 packing


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(4)
    for cap in (10, 64):
        for _ in range(20):
            sizes = sorted((int(x) for x in rng.integers(1, cap + 1, rng.integers(0, 120))), reverse=True)
            bins = []
            for s in sizes:
                fit = [b for b in bins if b[0] >= s]
                if fit:
                    b = min(fit, key=lambda b: b[0])
                    b[0] -= s
                else:
                    bins.append([cap - s])
            steps, n = packing.plan(Counter(sizes), cap)
            assert n == len(bins)
            used = defaultdict(list)
            count = Counter()
            for length, rank, take, f, first, offset in steps:
                assert rank == count[length]
                count[length] += take
                for r in range(take):
                    used[first + r % f].append((offset + length * (r // f), length))
            assert count == Counter(sizes)
            for places in used.values():
                at = 0
                for o, length in sorted(places):
                    assert o == at
                    at += length
                assert at <= cap
            assert sorted(cap - sum(x for _, x in p) for p in used.values()) == sorted(b[0] for b in bins)


def test_packing_round_trip(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs, keep_ids=True).collect()
    want = Counter(tuple([*t.encode(x or "", add_special_tokens=False).ids, 1]) for _, x, *_ in rows)
    by = defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 4096 * r["piece"]
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 4096
    assert sum(r["length"] for r in got) == sum(len(k) * n for k, n in want.items())
    assert Counter(r["ids"] for r in got if r["length"] < 4096 and r["piece"] == 0) == Counter({np.array(k, "<u4").tobytes(): n for k, n in want.items() if len(k) < 4096})
    assert packing.pack(none).count() == 0


def test_words_equal_whole_texts():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t, w = Tokenizer.from_file(path), packing.WordIds(path)
    texts = ["It's a don't, Foo. BAR,, x...", "É é ǅ İstanbul ΣΑΣ straße", "a b c\x01d \x01 .", "<|endoftext|> <|ENDOFTEXT|> End.", "1234,5 a.b. c,", "", "naïve. été, 日本語。"]
    assert w([x.encode() for x in texts]) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


# 8 sharding


def test_difference_beats_greedy_and_places_all():
    rng = np.random.default_rng(2)
    for k in (2, 5, 40):
        sizes = [float(x) for x in rng.integers(1, 1000, 300)]
        parts = sharding.difference([[(s, i)] for i, s in enumerate(sizes)], k)
        members = [sharding.leaves(tree) for _, tree in parts]
        assert sorted(i for m in members for i in m) == list(range(300))
        for (total, _), m in zip(parts, members):
            assert total == pytest.approx(sum(sizes[i] for i in m))
        totals = [p[0] for p in parts]
        assert max(totals) - min(totals) <= 0.05 * sum(sizes) / k + 5
    assert sharding.difference([], 3) == []


def test_sharding(spark, rows, none):
    from .conftest import make

    small = [(i, t, a, s) for i, t, a, s in rows if len(t or "") < 5000]
    got = sharding.shard(make(spark, small), 4).collect()
    assert len(got) == len(small)
    texts = {i: t for i, t, *_ in small}
    slots, totals = defaultdict(list), defaultdict(int)
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 16, zlib.crc32(t), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        totals[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 4
    assert max(totals.values()) - min(totals.values()) <= 0.05 * sum(totals.values()) / 4
    assert sharding.shard(none).count() == 0


# 9 exact dedup


@pytest.mark.parametrize("digest", [True, False])
def test_exact_dedup(docs, rows, none, digest):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows]
    groups = defaultdict(list)
    for i, x in enumerate(norm):
        groups[x].append(i)
    order = lambda i: (-len(rows[i][1] or ""), rows[i][0] is None, rows[i][0] or 0)
    want = Counter()
    for x, members in groups.items():
        best = min(members, key=order)
        for i in members:
            want[rows[i][0], rows[best][0], len(members), hashlib.sha256(x.encode()).hexdigest()] += 1
    got = exact_dedup.exact_dedup(docs, digest).collect()
    sha = (lambda r: r["text_sha256"]) if digest else (lambda r: r["text_sha256"] or "")
    if digest:
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], sha(r)) for r in got) == want
    else:
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == Counter({k: n for k, n in want.items()} and [k[:3] for k in want.elements()])
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(none, digest).count() == 0


def test_drop_copies(docs, rows, none):
    stay = exact_dedup.drop_copies(docs)
    norm = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows}
    assert stay.columns == docs.columns and stay.count() == len(norm)
    assert exact_dedup.drop_copies(none).count() == 0


# 10 language model


def brute_model(train):
    bi, c = Counter(), Counter()
    for t in train:
        c.update(t)
        bi.update(zip([None, *t], t))
    d2, cont = [0, *ngram_lm.discounts(*[sum(v == k for v in bi.values()) for k in (1, 2, 3, 4)])], Counter(y for _, y in bi)
    d1 = [0, *ngram_lm.discounts(*[sum(v == k for v in cont.values()) for k in (1, 2, 3, 4)])]
    spread = sum(d1[min(v, 3)] for v in cont.values()) / len(bi) / (len(c) + 1)
    mass = Counter()
    for (x, _), k in bi.items():
        mass[x] += d2[min(k, 3)]
    low = lambda y: max(cont[y] - d1[min(cont[y], 3)], 0) / len(bi) + spread
    return c, lambda x, y: (max(bi[x, y] - d2[min(bi[x, y], 3)], 0) + mass[x] * low(y)) / c[x] if c[x] else low(y)


def test_language_model(docs, rows, none):
    tokens = [(i, [*W.findall((t or "").translate(LOW)), None]) for i, t, *_ in rows]
    train = [t for i, t in tokens if not held(i, 7, 2)]
    c, p = brute_model(train)
    n, v = sum(c.values()), len(c)
    assert sum(p("the", y) for y in c) + p("the", "unseen word") == pytest.approx(1)
    want = sorted((str(i), held(i, 7, 2), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 5), round(sum(math.log10(p(x, y)) for x, y in zip([None, *t], t)), 5)) for i, t in tokens)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in ngram_lm.score(docs).collect())
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-5)
    assert len(got) == len(want)
    assert ngram_lm.score(none).count() == 0


def test_model_numbers_are_plain(docs):
    uri, meta = ngram_lm.train(docs)
    assert json.loads(meta)["tokens"] > 0 and uri.startswith(("file:", "/"))
