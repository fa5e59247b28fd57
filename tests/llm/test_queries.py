"""The registered queries next to their SQL, and the pipeline's stages on given tables."""

from __future__ import annotations

import pytest
from compare import difference, duck, duck_rows, spark_rows

import corpus_pipeline
from ringsight.llm.common import stored, table
from ringsight.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert difference(spark_rows(QUERIES[name](spark, FOLDER)), duck_rows(duck(FOLDER), ORACLES[name])) is None


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    before = docs.count()
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, FOLDER))
        if place < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert 0 < out.count() <= before, name
            before, docs = out.count(), out
    assert out.select("doc_id").join(docs, "doc_id", "left_anti").isEmpty() and not out.isEmpty()


def test_pipeline_removes_its_steps(spark):
    from pathlib import Path

    from ringsight.session import checkpoint_dir

    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.glob("llm-*")}
    out = corpus_pipeline.run(spark, FOLDER)
    left = {p.name for p in folder.glob("llm-*")} - before
    # The documents before the last stage, and the last stage's own steps.
    assert not out.isEmpty() and 1 <= len(left) <= 6
