"""Substring dedup and the Jaccard join against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rainspark.llm import jaccard_join, links, queries, substring_dedup, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "doc_id long, text string, window long, item string, component long")


def variants(rng, text, n, p):
    out = []
    for _ in range(n):
        w = text.split(" ")
        out.append(" ".join(x if rng.random() > p else rng.choice(["alpha", "beta", "gamma"]) for x in w))
    return out


@pytest.fixture(scope="module")
def corpus():
    """A family of near copies at all distances, exact copies, shared passages, repetitions and odd texts."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = text(150), text(45)
    texts = [base] * 9 + [v for p in (0.002, 0.005, 0.01, 0.02, 0.04) for v in variants(rng, base, 12, p)]
    texts += [text(rng.randrange(1, 60)) for _ in range(30)] + [text(30) + " " + passage + "\n" + text(20) for _ in range(15)]
    texts += ["ab " * 60, "ab " * 61, "x y " * 25, "", None, "  \n", "one", "ONE", "two words", "two  words", base.upper(), "é " * 30, "\x1c" * 3, text(3000)]
    texts += variants(rng, texts[-1], 4, 0.003)
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute_substring(rows, window):
    seen, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.setdefault(key, i)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings_of_the_table(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_substring_dedup(spark, SF).collect()}
    assert got == brute_substring(rows_of(spark), 20)


@pytest.mark.parametrize("bits", [1 << 20, 1 << 16])
def test_substrings_of_odd_texts(spark, corpus, bits):
    docs = frame(spark, corpus).repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digest(substring_dedup.kept_words(docs, bits=bits)).collect()}
    assert got == brute_substring(corpus, 20)
    assert sum(v[1] for v in got.values()) > 1000


def test_substrings_of_repeated_and_nameless_rows(spark):
    t = " ".join(map(str, range(30)))
    docs = frame(spark, [(1, t), (1, t), (None, t), (2, t), (3, "9 " + t + " 8")])
    got = sorted((tuple(r)[:3] for r in substring_dedup.digest(substring_dedup.kept_words(docs)).collect()), key=str)
    assert got == [(1, 30, 0), (1, 30, 0), (2, 30, 30), (3, 32, 30), (None, 30, 0)]
    assert substring_dedup.kept_words(docs.limit(0)).count() == 0


def test_sliding_min_and_factors():
    rng = np.random.Generator(np.random.PCG64(1))
    v = rng.integers(0, 50, 200).astype(np.uint64)
    for width in range(1, 20):
        assert (substring_dedup.sliding_min(v, width) == [v[i : i + width].min() for i in range(len(v) - width + 1)]).all()
    assert substring_dedup.factors(np.array([0, 1, 2, 9, 30]), 20).tolist() == [[0, 22], [9, 29], [30, 50]]


def brute_sets(rows, n):
    out = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    return out


def brute_components(rows, n, percent):
    sets = brute_sets(rows, n)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    having = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            having[x].append(i)
    pairs = {p for ids in having.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_join_of_the_table(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_jaccard_join(spark, SF).collect()}
    assert got == brute_components(rows_of(spark), 3, 90)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("merge", ["by cost", "never", "always"])
def test_join_of_odd_texts(spark, corpus, monkeypatch, n, percent, merge):
    if merge != "by cost":
        monkeypatch.setattr(jaccard_join, "allocation", lambda *a: frozenset(range(60)) if merge == "always" else frozenset())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(frame(spark, corpus).repartition(5), n, percent).collect()}
    want = brute_components(corpus, n, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_join_of_repeated_and_nameless_rows(spark):
    t = " ".join(map(str, range(30)))
    docs = frame(spark, [(4, t), (4, "other words of it"), (9, "Other words OF it"), (None, t), (7, t + " x"), (8, ""), (8, None)])
    got = sorted((tuple(r) for r in jaccard_join.components(docs, 3, 90).collect()), key=str)
    assert got == [(4, 2, 4), (4, 28, 4), (7, 29, 4), (8, 0, 8), (8, 0, 8), (9, 2, 4), (None, 28, None)]
    assert jaccard_join.components(docs.limit(0), 3, 90).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_bucket(percent):
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = x[rng.random(len(x)) > 0.06]
        y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(x) // 12))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if len(y) and 100 * common >= percent * (len(x) + len(y) - common):
            for merged in (frozenset(), frozenset(range(40))):
                assert np.intersect1d(jaccard_join.signatures(x, percent, merged), jaccard_join.signatures(y, percent, merged)).size


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 40)]
    edges = spark.createDataFrame([*path, *star, (500, 500)], "a long, b long")
    got = dict(map(tuple, links.components(edges).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 40)}
    assert links.components(edges.limit(0)).count() == 0


def test_filter_never_loses_a_value(spark):
    values = [*range(-50, 50), 1 << 62, -(1 << 63), (1 << 63) - 1]
    f = links.filter_of(spark.createDataFrame([(v,) for v in values], "v long"), "v", 1 << 16)
    assert links.may_hold(f, np.array(values), 1 << 16).all()
    assert links.may_hold(f, np.arange(10**6, 10**6 + 1000), 1 << 16).sum() < 20


def test_words_are_those_of_the_pattern():
    rng = random.Random(2)
    texts = [None, "", " ", *("".join(rng.choice(" \t\n\x0b\x0c\r\x1c\x85a　éZ🙂") for _ in range(rng.randrange(30))) for _ in range(300))]
    w = words.words_of(pa.array(texts, pa.string()).slice(1))
    raw = w.data.tobytes()
    for i, t in enumerate(texts[1:]):
        got = [raw[a:b].decode() for a, b in zip(w.starts[w.bounds[i] : w.bounds[i + 1]], w.ends[w.bounds[i] : w.bounds[i + 1]])]
        assert got == WORD.findall(t)
    by_word = defaultdict(set)
    for h, a, b in zip(w.hashes.tolist(), w.starts, w.ends):
        by_word[raw[a:b]].add(h)
    assert all(len(v) == 1 for v in by_word.values()) and len({h for v in by_word.values() for h in v}) == len(by_word)
