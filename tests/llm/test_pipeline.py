"""The pipeline as a whole: each stage's decisions take effect, and the driver's guard works."""

import importlib
import sys

import pytest

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids, left = docs.columns, {r[0] for r in docs.select("doc_id").collect()}, []
    from quadrille.llm.common import materialize

    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids
        if name != "best_fit_packing":
            assert docs.columns == columns and docs.select("doc_id").distinct().count() == docs.count()
        ids = now
        left.append(len(now))
    assert left[0] < 200 and left[1] < left[0] and left[-1] == left[-2]


@pytest.mark.parametrize("gone", ["corpus_pipeline", "quadrille.llm"])
def test_entry_without_the_subpackage(monkeypatch, gone):
    monkeypatch.setitem(sys.modules, gone, None)
    if gone == "quadrille.llm":
        for m in [m for m in sys.modules if m.startswith("quadrille.llm.") or m == "corpus_pipeline"]:
            monkeypatch.delitem(sys.modules, m)
    entry = sys.modules.get("__spark_entry__") or importlib.import_module("__spark_entry__")
    entry = importlib.reload(entry)
    assert "region_customers" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries()) and "pipeline" not in entry.queries()
    monkeypatch.undo()
    importlib.reload(entry)
