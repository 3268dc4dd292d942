"""Quality rules, language identification and HTML text against plain Python and held-out labels."""

import html
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rainspark.llm import html_text, language, quality, queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n", "a b c", "x\n x\nx\n\n\nx", "w " * 25, " ".join(map(str, range(60))) + "\n" + " ".join(map(str, range(8))), "#*$%&|<> é\x85 🙂" * 3, "a" * 100_000, "k l m n\n" * 9000]


def plain_statistics(t):
    w = WORD.findall(t or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark):
    got = {r.doc_id: r for r in queries.op4_quality_rules(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want, own = plain_statistics(r.text), got[r.doc_id]
        assert tuple(own)[1:6] == want
        assert own.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (own.base_failed and own.kept)
    assert [tuple(s[:5]) for s in quality.statistics(pa.array(ODD, pa.string()))] == [plain_statistics(t) for t in ODD]


def test_forest_keeps_good_and_drops_bad_rows(spark):
    docs = queries.op4_quality_rules(spark, LARGER).where("not base_failed").select("doc_id", "kept")
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    judged = [(quality_of[r.doc_id], r.kept) for r in docs.collect() if r.doc_id in quality_of]
    good, bad = [k for q, k in judged if q == 1], [k for q, k in judged if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_forest_isolates_what_stands_apart():
    rng = np.random.Generator(np.random.PCG64(3))
    x = rng.normal(size=(600, 3)) * [1, 0.1, 0]
    box = np.stack([np.minimum(x.min(0), -9), np.maximum(x.max(0), 9)])
    score = quality.Forest.grow(x, box).score(np.concatenate([x, [[8, 0, 0], [0, 8, 0], [0, 0, 8]]]))
    assert score[-3:].min() > np.quantile(score[:-3], 0.99)
    assert quality.mean_path(2) == 1 and quality.mean_path(1) == 0
    good, bad = np.array([0.1, 0.2, 0.3]), np.array([0.25, 0.5])
    assert 0.3 < quality.calibrate(good, bad, price=20) < 0.5 and 0.2 < quality.calibrate(good, bad, price=0.1) < 0.25


def test_sample_is_cut_by_hash_before_it_is_ordered(spark, monkeypatch):
    """The same rows as without the cutoff; only about `sample` of them are ordered."""
    from pyspark.sql import functions as F

    docs = spark.range(0, 4000, 1, 8).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") % k) for k in range(2, 40)]).alias("text"))
    stats = quality.rule_statistics(docs)
    labels = docs.select("doc_id", (F.col("doc_id") % 7 > 0).cast("int").alias("quality"))
    kind = type(docs)
    ordered, taken, order_by, to_pandas = [], [], kind.orderBy, kind.toPandas
    monkeypatch.setattr(kind, "orderBy", lambda df, *c: ordered.append(df.count()) or order_by(df, *c))
    monkeypatch.setattr(kind, "toPandas", lambda df: taken.append(to_pandas(df)) or taken[-1])
    quality.fit(stats, labels, 400)
    want = order_by(stats.join(labels, "doc_id"), F.xxhash64("doc_id")).limit(400).select("quality", *quality.STATISTICS)
    assert 400 <= ordered[0] < 700
    assert [tuple(r) for r in taken[0].itertuples(index=False)] == [tuple(r) for r in want.collect()]


def test_box_and_threshold_come_from_all_labelled_rows(spark):
    """However few rows the trees draw from."""
    stats = quality.rule_statistics(spark.read.parquet(f"{LARGER}/documents.parquet")).cache()
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    model = quality.fit(stats, labels, 60)
    rows = stats.join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    s = rows[list(quality.STATISTICS)].to_numpy()
    open_ = ~quality.base_failed(s)
    x, good = quality.features(s[open_]), rows["quality"].to_numpy()[open_] > 0
    score = model.forest.score(x)
    assert len(x) > 100 and model.threshold == pytest.approx(quality.calibrate(score[good], score[~good]), rel=1e-12)
    assert (quality.feature_box(stats.join(labels.withColumnRenamed("quality", "_quality"), "doc_id")) == [x.min(axis=0), x.max(axis=0)]).all()
    for rows in ([(True, 0.5)], [(True, 0.25), (False, 0.75)], [(False, 0.25), (True, 0.5), (False, 0.5), (True, 0.5001), (False, 0.9)] * 30):
        own = np.array([v for g, v in rows if g]), np.array([v for g, v in rows if not g])
        assert quality.threshold(spark.createDataFrame(rows, "good boolean, score double")) == quality.calibrate(*own)
    stats.unpersist()


def test_threshold_starts_no_workers_for_its_sums(spark, monkeypatch):
    """Rows of a list would be dealt to Python workers of another kind, which wait beside those of the operators."""
    rows = [(True, 0.5), (False, 0.9), (True, 0.5001), (False, 0.25)] * 30
    scores = spark.createDataFrame(rows, "good boolean, score double").localCheckpoint()

    def refuse(*_):
        raise AssertionError("rows of a list")

    monkeypatch.setattr(spark.sparkContext, "parallelize", refuse)
    own = np.array([v for g, v in rows if g]), np.array([v for g, v in rows if not g])
    assert quality.threshold(scores) == quality.calibrate(*own)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(ODD)] + [(None, ODD[6], "s", 1)], "doc_id long, text string, score string, kept int")
    stats = quality.rule_statistics(docs)
    labels = spark.createDataFrame([(6, 1), (6, 1), (5, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(stats, labels)
    verdict = quality.judge(stats, model).collect()
    assert len(verdict) == len(ODD) + 1 and [r.doc_id for r in verdict if r.kept] == [6, None]
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [6, None]
    assert quality.fit(stats, labels.limit(0)).forest is None and quality.keep(docs.limit(0), model).count() == 0
    assert quality.fit(stats.limit(0), labels).threshold == np.inf


def pieces():
    return language.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))


def segmentations(word, known):
    """All ways to cut a word into known pieces or single bytes."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if n == 1 or word[:n] in known:
            for rest in segmentations(word[n:], known):
                yield [word[:n], *rest]


@pytest.mark.parametrize("word", ["the", "über", "z", "ñandú", "中a", "there"])
def test_forward_and_backward_sum_all_segmentations(word):
    own = pieces()
    rng = np.random.Generator(np.random.PCG64(len(word)))
    p = np.concatenate([rng.random((len(own.pieces), 2)) * 0.01, np.full((1, 2), language.UNKNOWN), np.zeros((1, 2))])
    model, number = language.Model(["a", "b"], p), {s: i for i, s in enumerate(own.pieces)}
    values = np.frombuffer(word.encode(), dtype=np.uint8)
    offsets = np.array([0, len(values)])
    cuts = list(segmentations(b" " + word.encode(), number))
    for lang in (0, 1):
        weight = [np.prod([p[number.get(s, len(own.pieces)), lang] for s in c]) for c in cuts]
        assert np.isclose(model.log_probability(own, values, offsets)[0, lang], np.log(sum(weight)))
        want = np.zeros(len(own.pieces))
        for c, w in zip(cuts, weight):
            for s in c:
                if s in number:
                    want[number[s]] += 3 * w / sum(weight)
        assert np.allclose(language.expected_counts(own, model, lang, values, offsets, np.array([3.0])), want)


def test_languages_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op8_language_id(spark, LARGER).collect()
    assert {r.doc_id for r in rows} == set(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 0


def test_languages_of_odd_rows(spark):
    model_file = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "the of and that with", "en"), (2, "der die und nicht", "de"), (2, "der die und nicht", "de"), (3, None, "en"), (4, "12 !?", None), (5, "der", None), (None, "The AND", None), (6, "", "xx"), (7, "und" * 5000 + " und", None), (8, "und der " * 500, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, words int")
    model = language.learn(docs, model_file)
    assert model.languages == ["de", "en"]
    got = sorted((tuple(r)[:2] for r in language.predict(docs, model, model_file).collect()), key=str)
    got.remove(next(r for r in got if r[0] == 7 and r[1] in model.languages))
    assert got == sorted([(1, "en"), (2, "de"), (2, "de"), (3, "und"), (4, "und"), (5, "de"), (None, "en"), (6, "und"), (8, "de")], key=str)
    none = language.learn(docs.limit(0), model_file)
    assert {(r.lang_pred, r.score) for r in language.predict(docs, none, model_file).collect()} == {("und", 0.0)}
    assert language.predict(docs.limit(0), model, model_file).count() == 0


def test_html_of_the_table(spark):
    """The table's articles are plain: a reading by the article tag alone must agree."""
    got = {r.page_id: r for r in queries.op10_html_text(spark, LARGER).collect()}
    for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect():
        body = r.html.split("<article>", 1)[1].split("</article>")[0].split("<footer")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        want = "\n".join(filter(None, blocks))
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


TEXT = "Rain fell over the whole valley for two days and the people of the lower town went up to the church with what they could carry"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("<html><body></body></html>", ""),
        (f"<nav>a menu</nav><article><h1>A &amp; B</h1><p>{TEXT}<p>x&nbsp;y &lt;z&gt; &#233;&eacute</article><footer>f</footer>", f"A & B\n{TEXT}\nx y <z> éé"),
        (f"<article><p>one<br>two<b> bold</b>er</p><script>if (a<b) '</p>'</script><style>p>a{{}}</style><!-- <p>no</p> --><p>three</p></article>", "one two bolder\nthree"),
        (f"<body><div class='top-menu'><p>{TEXT}</p></div><main><p>{TEXT}</p><div id=comments><p>{TEXT}</p></div></main><aside>{TEXT}</aside>", TEXT),
        (f"<article><p>{TEXT}</p><ul><li>a<li>b</ul><form>{TEXT}<input value='>'></form><p>end", f"{TEXT}\na\nb\nend"),
        (f"<article><p>{TEXT}</p><p>cut <a href='x", f"{TEXT}\ncut"),
        (f"<div class=cookie-banner>{TEXT}</div><div><p>{TEXT}</p><p>{TEXT}</p></div><div class='ad'>{TEXT}</div>", f"{TEXT}\n{TEXT}"),
        (f"<article><header><h1>T</h1></header><p title='a > b'>{TEXT}</p><!-- open comment {TEXT}", f"T\n{TEXT}"),
        ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
        ("<article>" + "<p>a < b and \"c" * 3 + "</article>", "\n".join(['a < b and "c'] * 3)),
    ],
)
def test_html_cases(page, want):
    assert html_text.main_text(page or "", html_text.trained()) == want


def test_html_of_odd_rows(spark):
    rows = [(1, "u", "<article>x</article>", 5), (1, "u", "<article>x</article>", 5), (None, None, None, None), (2, "v", "<article>" + "long words " * 50_000 + "</article>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((tuple(r) for r in html_text.extract(pages).collect()), key=str)
    long_ = ("long words " * 50_000).strip()
    assert got == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0), (2, "v", long_, len(long_))], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_tree_fits_the_labelled_table():
    blocks = [html_text.blocks_of(p) for p in html_text.PAGES]
    said = np.concatenate([html_text.trained().main(html_text.describe(b)) for b in blocks])
    assert (said == [b.label for b in itertools.chain(*blocks)]).all()


def test_words_met_before_are_not_summed_again(monkeypatch):
    from rainspark.llm import language

    monkeypatch.setattr(language, "MEMORY", 60)
    rng = np.random.default_rng(2)
    known, asked = language.Known(2), []

    def look(hashes):
        def compute(new):
            asked.append(len(new))
            return np.stack([hashes[new] * 2.0, hashes[new] * 3.0], axis=1)

        return known.look_up(hashes, compute)

    for _ in range(30):
        hashes = np.unique(rng.integers(0, 50, 30)).astype(np.uint64)
        np.testing.assert_array_equal(look(hashes), np.stack([hashes * 2.0, hashes * 3.0], axis=1))
    assert sum(asked) == 50
    for low in range(0, 1000, 40):
        hashes = np.arange(low, low + 70, dtype=np.uint64)
        np.testing.assert_array_equal(look(hashes)[:, 1], hashes * 3.0)
        assert len(known.hashes) <= 60 and (np.diff(known.hashes.astype(np.int64)) > 0).all()
