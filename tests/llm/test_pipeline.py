"""Every stage of the pipeline against a brute-force version on its own input."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_duplicates import brute_components
from test_lines_and_leaks import brute_leaks, brute_similar_lines
from tokenizers import Tokenizer

from rainspark.llm import quality
from rainspark.session import materialise

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = documents, []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), name)
        if name != "bpe":
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in documents.schema]
        seen.append((pairs(docs), out))
        docs = out
    (raw, good), (_, lines), (_, near), (_, clean), (_, ids) = seen

    model = quality.fit(quality.rule_statistics(documents), spark.read.parquet(f"{SF}/labels.parquet"))
    verdict = {r.doc_id: r.kept for r in quality.judge(quality.rule_statistics(documents), model).collect()}
    assert {i for i, _ in pairs(good)} == {i for i, _ in raw if verdict[i]} and 0 < good.count() < len(raw)

    # edit similarity alone decides; the stage removes nothing else, and nine tenths of the lines at least
    before, after = dict(pairs(good)), dict(pairs(lines))
    want, _ = brute_similar_lines(pairs(good))
    count = lambda texts: sum(len((t or "").split("\n")) if t else 0 for t in texts.values())
    assert all(set(want[i].split("\n")) <= {*t.split("\n"), ""} for i, t in after.items())
    assert all(not want[i].strip(" \t\n\r\x0b\x0c") for i in before.keys() - after.keys())
    removed, wanted = count(before) - count(after), count(before) - count(want)
    assert wanted > 50 and removed >= 0.9 * wanted
    assert lines.where(F.length("text") != F.col("n_chars")).count() == 0

    components = brute_components(pairs(lines), 5, 80)
    assert {i for i, _ in pairs(near)} == {i for i, (_, c) in components.items() if i == c}

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {i for i, _ in pairs(clean)} == {i for i, _ in pairs(near)} - {d for d, *_ in brute_leaks(pairs(near), items)}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(pairs(clean))
    rows = ids.collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.text == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)


def test_odd_documents(spark):
    t = " ".join(f"word{i}" for i in range(60))
    rows = [(1, t, "en", "s", 1), (1, t, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (None, t + " more", "en", "s", 1), (4, t.upper(), "en", "s", 1), (5, "w " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, item int, key string, kept boolean")
    for name, stage in corpus_pipeline.STAGES:
        for input_ in (docs, docs.limit(0)):
            out = stage(spark, input_, SF)
            n = out.count()
            assert name == "bpe" or out.columns == docs.columns
            assert n <= input_.count()
            if name == "jaccard_join" and input_ is docs:
                assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 1, 2, 3, 5, None]
            if name == "line_dedup" and input_ is docs:
                assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 1, 2, 3, 5, None]


def test_no_column_is_touched_or_doubled(spark):
    """Columns named like everything that the stages make themselves."""
    names = sorted({
        "_key", "_may", "_bucket", "_place", "_bits", "_lines", "_gone", "_doc_id", "_doc_key", "_later", "n_lines", "n_removed", "row", "doc_key", "gone", "lines", "item",
        "key", "component_id", "n_shingles", "first", "leader", "kept", "score", "n_words", "slot", "bucket", "bits", "a", "b", "n", "odd", "label", "label_table", "low", "text_key",
    })
    t = "\n".join(" ".join(f"w{k}x{i}" for i in range(30)) for k in range(4))
    rows = [(1, t, "en"), (2, t.replace("w1x7 ", "other "), "en"), (3, "quite another text of many words " * 5, "en"), (None, t, None), (4, None, "en")]
    docs = spark.createDataFrame([(*r, *(f"{n}{i}" for n in names)) for i, r in enumerate(rows)], "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names))
    own = {tuple(r) for r in docs.drop("text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("n_chars", F.length("text").cast("long")), SF)
        assert out.columns == [*docs.columns, "n_chars"], name
        assert {tuple(r) for r in out.drop("text", "n_chars").collect()} <= own, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "n_tokens", "ids", "text"]
