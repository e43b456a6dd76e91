"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, awkward, awkward_frame
from trailsift.llm import language_id, licenses, lm_score, minhash, mixing, packing, quality
from trailsift.llm.common import fold
from trailsift.llm.queries import byte_bpe


def identify(docs):
    model = language_id.fit(docs.filter(fold(F.col("doc_id")) != 0), "text", "lang", F.xxhash64("doc_id"))
    return language_id.identify(docs, model, ["doc_id"])


def score(docs):
    part = fold(F.col("doc_id"))
    return lm_score.score_documents(docs, byte_bpe(), part == 1, part != 1)


OPERATORS = {"identify": identify, "near_duplicates": minhash.near_duplicates, "plan_mix": mixing.plan_mix,
             "scan": licenses.scan, "score": score, "judge": quality.judge}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, name):
    rows = OPERATORS[name](awkward_frame(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in awkward())


@pytest.mark.parametrize("name", [*OPERATORS, "mix", "pack"])
def test_empty_table(spark, name):
    run = {**OPERATORS, "mix": mixing.mix, "pack": lambda d: packing.pack(d, byte_bpe())}[name]
    assert run(spark.createDataFrame([], DOCS)).collect() == []


def test_language_of_texts_without_letters(spark):
    found = {r["doc_id"]: r for r in identify(awkward_frame(spark)).filter("doc_id is not null").collect()}
    for i in (40, 41, 42, 43):
        assert found[i]["lang_pred"] == "und" and found[i]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_no_labelled_row(spark):
    docs = spark.createDataFrame([(1, "some text", None, "a", 9)], DOCS)
    assert identify(docs).collect()[0]["lang_pred"] == "und"


def test_base_values_of_empty_texts(spark):
    rows = {r["doc_id"]: r for r in licenses.scan(awkward_frame(spark)).collect() if r["doc_id"] is not None}
    assert rows[40]["n_words"] == 0 and rows[40]["first_word"] is None and rows[40]["labels"] == ""
    judged = {r["doc_id"]: r for r in quality.judge(awkward_frame(spark)).collect() if r["doc_id"] is not None}
    assert judged[40]["base_failed"] and not judged[40]["kept"] and judged[40]["n_words"] == 0
    # One word 30,000 times: all but the last word lie in repeated windows.
    assert judged[45]["n_repeat_words"] == 30000 and judged[45]["base_failed"]


def test_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as pipeline
    docs = awkward_frame(spark)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert tuple(docs.columns) == pipeline.COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), DOCS)
    assert "doc_id" in pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns
    empty = spark.createDataFrame([], DOCS)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
