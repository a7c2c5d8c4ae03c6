"""The pipeline's stages, written and read again, against plain forms of what they decide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import pii, quality, simjoin

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(8)
    vocabulary = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    base = text(80)
    rows = [text(60 + i) for i in range(30)]
    rows += [base, base + " tail", base.replace("word1 ", "word2 ", 1), base]  # near and exact copies
    rows += ["a b c", None, "", "junk junk junk junk " * 20]  # rejected
    rows += [text(40) + " write to a.b@mail.org or +1 (555) 123-4567"]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(corpus(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near copies", "pii", "packing"]
    good = steps["quality"](spark, docs, folder)
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and kept == {*range(34), 38}
    one = steps["near copies"](spark, good, folder)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == kept - {31, 32, 33}
    masked = steps["pii"](spark, one, folder)
    assert masked.columns == docs.columns
    last = {r["doc_id"]: r for r in masked.collect()}[38]
    assert last["text"].endswith("write to <EMAIL> or <PHONE>") and last["n_chars"] == len(last["text"])
    pieces = steps["packing"](spark, masked, folder).collect()
    assert {r["doc_id"] for r in pieces} == kept - {31, 32, 33}


def test_run_is_its_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = quality.judged(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("kept").select(docs.columns)
    texts = {r["doc_id"]: r["text"] for r in pii.masked(simjoin.one_of_each(good)).collect()}
    by = {}
    for r in got:
        by[r["doc_id"]] = by.get(r["doc_id"], 0) + r["length"]
    assert by.keys() == texts.keys()
    assert all(by[r["doc_id"]] == r["doc_tokens"] for r in got)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_stages_keep_columns_named_like_their_results(spark, folder):
    more = {c: F.lit(f"own {c}") for c in ("score", "kept", "n_words", "_words", "cls", "component_id", "base_spans", "n_shingles")}
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns(more)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert docs.count() == 32 and docs.select(*more).distinct().collect() == [tuple(f"own {c}" for c in more)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0
