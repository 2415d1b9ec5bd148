"""The pipeline's stages against plain versions, and on edge cases."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))
import cases  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    cases.frame(spark, cases.edge_rows()).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == pipeline.COLUMNS and out.count() > 0
        docs = out
    assert pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_exact_stage(spark):
    data = cases.rows()
    docs = cases.frame(spark, data)
    kept = {r.doc_id for r in pipeline.drop_equal(spark, docs, "").collect()}
    best = {}
    for i, t, *_ in data:
        key = "".join(cases.words(t))
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
    assert kept == {i for _, i in best.values()}


def test_exact_stage_with_repeated_rows(spark):
    data = [(1, "a b", None, None, None)] * 3 + [(2, "ab", None, None, None), (1, "other", None, None, None), (None, "c", None, None, None), (3, "c", None, None, None)]
    out = pipeline.drop_equal(spark, cases.frame(spark, data), "").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "a b"), (1, "other"), (3, "c")]


def test_near_stage(spark):
    data = cases.rows()
    kept = {r.doc_id for r in pipeline.drop_near(spark, cases.frame(spark, data), "").collect()}
    assert kept == {c for _, c in cases.plain_components(data).values()}


def test_run(spark, small):
    from graphloom.llm import common

    rows = pipeline.run(spark, small).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in common.documents(spark, small).select("doc_id").collect()}
