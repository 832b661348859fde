"""The pipeline: stages keep the columns, take effect, and agree with plain versions on their own input."""

from __future__ import annotations

import corpus_pipeline
import pytest

from sourceloom.llm import packing, quality_classifier, toxicity
from sourceloom.llm.common import settle
from tests.llm.plain import link_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(settle(stage(spark, out[-1], SF)))
    return out


def ids(df) -> set[int]:
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(spark, steps):
    assert len(corpus_pipeline.STAGES) == 5
    columns = steps[0].columns
    assert all(s.columns == columns for s in steps[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_classifier.judged(steps[0], labels)
    assert ids(steps[1]) == ids(scored.where("score >= 0.3"))
    assert ids(steps[2]) == ids(toxicity.judged(steps[1], labels).where("score < 0.7"))
    texts = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    assert ids(steps[3]) == set(link_groups(texts, 5, 80, 100).values())
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in steps[3].collect() if any(t in r["text"] for t in items)}
    assert leaks and ids(steps[4]) == ids(steps[3]) - leaks
    assert ids(steps[5]) == ids(steps[4])
    lengths = {r["doc_id"]: r["n"] for r in packing.pieces(steps[4]).groupBy("doc_id").sum("length").toDF("doc_id", "n").collect()}
    packed = {r["doc_id"]: r["n"] for r in steps[5].groupBy("doc_id").sum("length").toDF("doc_id", "n").collect()}
    assert lengths == packed


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
        assert stage(spark, docs, SF).count() >= 0
