"""Token counts, secret scans and BPE against the libraries and against plain Python."""

import hashlib
import re
import uuid

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rainspark.llm import bpe, queries, secret_ledger, token_counts

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [
    (1, "plain words here", "x"), (2, None, "x"), (3, "", "y"), (4, "plain words here", None), (4, "plain words here", None),
    (5, "don't  stop\x1c\x85 <|endoftext|> é\n\n ", "y"), (6, "abcdefgh" * 20_000, "z"), (7, "a b " * 30_000, "z"), (None, "null id", None),
]


@pytest.fixture
def odd(spark):
    # names that operators might use themselves
    return spark.createDataFrame([(*r, 0, "n") for r in ODD], "doc_id long, text string, digest string, n_tokens int, blob string")


def texts(spark, name, sf=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_counts_equal_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096) for i, t in texts(spark, "documents").items()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op6_token_counts(spark, SF).collect()}
    assert got == want


def test_cache_encodes_distinct_misses_once(spark, odd):
    model, path = public_tokenizers.path("piece_bpe_32k.model"), queries.new_folder(spark, f"test-{uuid.uuid4().hex}")
    first = sorted(map(tuple, token_counts.token_counts(odd, path, model).collect()), key=str)
    assert len(first) == len(ODD)
    stored = spark.read.schema(token_counts.CACHE).parquet(path).count()
    assert stored == len({t or "" for _, t, _ in ODD})
    more = odd.unionByName(spark.createDataFrame([(9, "something new")], "doc_id long, text string"), allowMissingColumns=True)
    second = sorted(map(tuple, token_counts.token_counts(more, path, model).collect()), key=str)
    assert set(first) < set(second)
    assert spark.read.schema(token_counts.CACHE).parquet(path).count() == stored + 1
    assert token_counts.token_counts(odd.limit(0), path, model).count() == 0


def test_bpe_equals_the_library(spark, odd):
    file = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    want = {}
    for i, t in texts(spark, "documents").items():
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), back)))
    assert {r[0]: tuple(r)[1:] for r in queries.op9_bpe(spark, SF).collect()} == want
    for r in bpe.decode(bpe.encode(odd, file), file).collect():
        t = r.text
        assert r.ids == library.encode(t, add_special_tokens=False).ids
        assert t in {x or "" for _, x, _ in ODD}
    assert bpe.encode(odd, file).count() == len(ODD) and bpe.encode(odd.limit(0), file).count() == 0


def test_a_worker_keeps_no_pieces_after_its_task():
    """It waits beside the work of later stages, whose memory it shares."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words, and others", None]})
    tasks = bpe.encoded(iter([batch]), file)
    assert next(tasks).num_rows == 2 and bpe.vocabulary(file).kept
    assert not list(tasks)
    assert not bpe.vocabulary(file).kept and not bpe.vocabulary(file).older


def test_bpe_on_random_strings():
    import random

    file = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(file), bpe.Bpe(file)
    rng = random.Random(7)
    for _ in range(3000):
        s = "".join("<|endoftext|>" if rng.random() < 0.05 else rng.choice("ab é'sß\x1c\x85   \n\t12²٣中🙂don't ll\x00") for _ in range(rng.randrange(14)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert list(own.encode(s)) == ids and own.decode(own.encode(s)) == library.decode(ids, skip_special_tokens=False), s


def plain_secrets(text, kinds):
    found = []
    for n, (pattern, group, least) in enumerate(kinds):
        found += [(m.start(), n, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(found)


BASE = [
    (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (r"(AKIA[A-Z0-9]+)", 1, 20), (r"([0-9a-f]+)", 1, 24),
]


def test_secrets_against_plain_regex(spark):
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, LARGER).collect()}
    hits = 0
    for i, t in texts(spark, "documents", LARGER).items():
        want = plain_secrets(t, BASE)
        hits += len(want)
        names = [f"{('assign', 'access', 'hex')[n]}:{a}:{b}" for a, n, b in want]
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(n == k for _, n, _ in want) for k in range(3))
        assert got[i].base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(got[i].spans.split(",")) | {""}
    assert hits > 3


def test_secret_ledger_scans_only_unseen_pairs(spark):
    path = queries.new_folder(spark, "test-ledger")
    rows = [
        (1, "é🙂 secret: token:abcdef TOKEN = 'abc.def/12' x" + "0123456789abcdef" * 3), (2, None), (3, ""), (3, ""), (4, "password=short AKIA" + "B" * 16),
        (5, "token=token=abcdefgh AKIAAKIA api-key: no API_KEY:\"valuevalue\""), (6, "-----BEGIN RSA PRIVATE KEY-----"), (7, "password=short AKIA" + "B" * 16),
        (None, "passwd : hunter2hunter2"), (8, "x" * 200_000 + " secret=abcdef " + "y" * 200_000),
    ]
    docs = spark.createDataFrame([(*r, b"", "k") for r in rows], "doc_id long, text string, blob binary, kind string")
    ledger = secret_ledger.Ledger(spark, path)
    got = sorted(((r.doc_id, [tuple(s) for s in r.found if s["kind_no"] < 3]) for r in secret_ledger.secret_findings(docs, ledger).collect()), key=str)
    assert got == sorted(((i, plain_secrets(t or "", BASE)) for i, t in rows), key=str)
    assert ledger.scanned().count() == len({t or "" for _, t in rows})
    before = spark.read.schema(secret_ledger.FOUND).parquet(ledger.found_path).count()
    again = secret_ledger.secret_findings(docs.unionByName(spark.createDataFrame([(10, "secret=abcdefg")], "doc_id long, text string"), allowMissingColumns=True), ledger)
    assert again.count() == len(rows) + 1
    assert spark.read.schema(secret_ledger.FOUND).parquet(ledger.found_path).count() == before + 1
    other = secret_ledger.Ledger(spark, path, secret_ledger.BASE, "base only")
    assert secret_ledger.secret_findings(docs, other).where("size(found) > 0").count() == sum(bool(plain_secrets(t or "", BASE)) for _, t in rows)
    assert secret_ledger.secret_findings(docs.limit(0), other).count() == 0
