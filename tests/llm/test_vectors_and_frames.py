"""Top-k search, vector codes and fill-in-middle against brute-force versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import zstandard

from rainspark.llm import fill_middle, top_k, vector_codes
from rainspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")


def vectors(spark, rows):
    # names that the operators use themselves
    return spark.createDataFrame(
        [(*r, 7, "x", 1.0, "y") for r in rows],
        "vec_id long, embedding array<float>, label int, v int, code string, score double, block string",
    )


def near_ties(n, width, seed):
    r = random.Random(seed)
    return [(i, [r.randint(-3, 3) / 16 for _ in range(width)], r.choice([None, 1, 2])) for i in range(n)]


ODD = [(900, None, 1), (901, [], None), (902, [1.0, None], 1), (903, [NAN, 1.0], 1), (950, [0.0, -INF], 1), (None, [0.5] * 8, 3), (904, [0.25, -0.5], None)]


def brute_top(rows, k=5, scale=256, every=50):
    kept = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(scale * x) for x in v]
            kept[i] = min(kept.get(i, v), v)
    out = set()
    for q in kept:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(kept[q], kept[c])), c) for c in kept if c != q)[:k]
            out |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)}
    return out


@pytest.mark.parametrize("rows", [
    near_ties(400, 8, 1) + ODD + near_ties(3, 8, 2) + [(50, [9.0] * 8, 1), (50, [-9.0] * 8, 1)],
    [(i, [0.5, -0.25], 1) for i in range(120)], [(0, [0.0, 0.0], 1), (1, [1.0, 1.0], 1), (50, [1.0, 0.0], 1)], [(50, [1.0], 1)], ODD[:1], [],
])
def test_top_k(spark, rows):
    found = [tuple(r) for r in top_k.top_k(vectors(spark, rows)).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_top(rows)


def test_top_k_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 16)
    monkeypatch.setattr(top_k, "RUN", 3)
    monkeypatch.setattr(top_k, "GROUP", 2)
    rows = near_ties(600, 6, 3)
    assert {tuple(r) for r in top_k.top_k(vectors(spark, rows)).collect()} == brute_top(rows)


def test_threshold_spares_rows():
    r = np.random.default_rng(5)
    # few dimensions carry the scores, so the bound falls below the best soon
    found = np.floor(256 * r.normal(size=(4000, 4)) * [8, 1, 0.1, 0.1])
    lists = top_k.Lists(np.arange(4000), found, np.argsort(found.T, axis=1, kind="stable"))
    best = top_k.Best(5)
    top_k.search(lists, 0, found[0], best)
    order = sorted(range(1, 4000), key=lambda i: (-(found[i] @ found[0]), i))[:5]
    assert best.ids.tolist() == order and best.scored < 1000


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    size = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[m * size : (m + 1) * size] for _, v, _ in first] for m in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for turn in range(rounds + 1):
        found = [[nearest(v[m * size : (m + 1) * size], books[m]) for m in range(parts)] for _, v, _ in kept]
        if turn < rounds:
            for m in range(parts):
                for k in range(len(books[m])):
                    mine = [v[m * size : (m + 1) * size] for (_, v, _), f in zip(kept, found) if f[m][1] == k]
                    if mine:
                        books[m][k] = [sum(c) // len(mine) for c in zip(*mine)]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], digest) for (i, _, label), f, e in zip(kept, found, errors)), key=str
    )


@pytest.mark.parametrize("rows, entries", [
    (near_ties(300, 8, 1) + ODD + near_ties(5, 8, 1), 20), (near_ties(30, 7, 2), 256), ([(i, [0.5] * 4, None) for i in range(50)], 8), ([(1, [], 1), (2, [], 1)], 4), (ODD[:1], 4), ([], 4),
])
def test_codes(spark, rows, entries):
    found = vector_codes.digest(*vector_codes.codes(vectors(spark, rows), entries=entries))
    assert sorted(map(tuple, found.collect()), key=str) == brute_codes(rows, entries=entries)


def test_bounds_spare_scans_and_lose_nothing():
    r = np.random.default_rng(3)
    x = np.floor(1024 * (r.normal(size=(3000, 8)) * 0.1 + r.integers(0, 4, size=(3000, 1))))
    history, state, counts = [x[:64].copy()], (None, None, None), []
    groups = vector_codes.cells(history[0])
    for _ in range(6):
        best, distance, low, stamp, scanned = vector_codes.nearest(x, history, groups, *state)
        whole = ((x[:, None] - history[-1]) ** 2).sum(2)
        assert (best == whole.argmin(1)).all() and (distance == whole.min(1)).all()
        counts.append(scanned)
        state = best, low, stamp
        book = history[-1].copy()
        for k in set(best):
            book[k] = np.floor(x[best == k].mean(0))
        history.append(book)
    assert counts[0] == 64 * len(x) and counts[-1] < counts[0] / 2
    # the net displacement is never more than the accumulated one
    drifts = sum(vector_codes.displaced(history[: t + 1][-2:], groups)[0] for t in range(1, len(history)))
    assert (vector_codes.displaced(history, groups)[0] <= drifts * (1 + 1e-6)).all()


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "a", "  a  b\n", "ä ö ü x 日本 語 " * 50, "word " * 3000, "x" * 200_000 + " tail", "é" * 90_000, " \n" * 70_000 + "end", "has <M> mark",
    "almost <P mark> <S", "\x1c\x85 odd", "a" * 65_536 + "日" * 30_000 + " z",
]


def brute_fim(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    one, two = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:one], units[one:two], units[two:]))
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    chars = (None, None) if form == "plain" else (len(p), len(m))
    return doc_id, len(units), form, *chars, out


def test_fill_in_middle(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id here"), (3, "a"), (3, "a")]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, form string, n int, frames string")
    made = fill_middle.fill_in_middle(docs)
    want = sorted((brute_fim(*r) for r in rows), key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, fill_middle.texts(made).collect()), key=str) == want
    back = {(r.doc_id, r.digests.restored) for r in fill_middle.digests(made).collect()}
    assert back == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert fill_middle.digests(fill_middle.fill_in_middle(docs.limit(0))).count() == 0


def test_only_cut_frames_are_opened(monkeypatch):
    monkeypatch.setattr(fill_middle, "FRAME_UNITS", 3)
    monkeypatch.setattr(fill_middle, "FRAME_BYTES", 16)
    r = random.Random(4)
    for _ in range(60):
        text = "".join(r.choice(["ab", "é", "日本語日本語日本語", " ", "\n", "  ", "x" * 40]) + r.choice([" ", ""]) for _ in range(r.randint(1, 40)))
        units = UNIT.findall(text)
        n, frames = fill_middle.frames_of(text.encode())
        assert n == len(units) and b"".join(fill_middle.read_frames([f.data for f in frames])).decode() == text
        for _ in range(20):
            one, two = sorted(r.randint(0, n) for _ in range(2))
            opened = []
            real = zstandard.ZstdDecompressor

            class Counting:
                def decompress(self, data):
                    opened.append(data)
                    return real().decompress(data)

            with monkeypatch.context() as m:
                m.setattr(fill_middle.zstandard, "ZstdDecompressor", Counting)
                found, chars = fill_middle.sections(frames, n, one, two)
            assert len(opened) <= 2
            got = {k: b"".join(fill_middle.read_frames(v)).decode() for k, v in found.items()}
            assert got == {"prefix": "".join(units[:one]), "middle": "".join(units[one:two]), "suffix": "".join(units[two:])}
            assert chars == {"prefix": len(got["prefix"]), "middle": len(got["middle"])}


def test_queries_over_whole_tables(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert {tuple(r) for r in QUERIES["op11_top_k"](spark, SF).collect()} == brute_top(table)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op13_fill_in_middle"](spark, SF).collect():
        *head, output = brute_fim(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (*head, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest())
