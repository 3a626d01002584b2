"""Each stage on its own input, against brute force and the operators' own reports."""

from __future__ import annotations

import corpus_pipeline
from cadenza.llm import decontaminate, language_id, quality_rules
from tests.llm.test_brute import brute_components

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(n)))
        kept = spark.read.parquet(str(tmp_path / str(n)))
        seen.append(name)
        if n == 0:
            assert ids(kept) == sorted(r["doc_id"] for r in quality_rules.assess(docs).collect() if r["kept"])
        elif n == 1:
            told = language_id.identify(docs, language_id.learn(docs)).collect()
            assert ids(kept) == sorted(r["doc_id"] for r in told if r["lang_pred"] != "und" and r["rate"] <= language_id.MAX_RATE)
        elif n == 2:
            parts = brute_components({r["doc_id"]: r["text"] for r in docs.collect()})
            assert ids(kept) == sorted({c for _, c in parts.values()})
        elif n == 3:
            told = decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
            assert ids(kept) == sorted(r["doc_id"] for r in told if not r["contaminated"])
        if n < 4:
            assert kept.columns == columns
        docs = kept
    assert len(seen) == 5
    total = sum(len((r["text"] or "").split()) for r in spark.read.parquet(str(tmp_path / "3")).collect())
    mixed = sum(len((r["text"] or "").split()) for r in docs.collect())
    assert abs(mixed - 1.5 * total) < 0.1 * total


def test_stages_on_awkward_tables(spark, awkward, nothing):
    """Every stage on nulls, repeats and clashing columns, and on an empty table; the very long text is left to the operators' own tests."""
    rows = awkward.filter("doc_id IS NULL OR doc_id <> 8")
    want = {
        "quality rules": [0, 1, 1, 2],
        "n-gram Jaccard join": [0, 1, 3, 4, 5, 6, 9, 10, 11],
        "benchmark decontamination": [0, 0, 1, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11],
    }
    for name, stage in corpus_pipeline.STAGES:
        last = name == corpus_pipeline.STAGES[-1][0]
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns + ["copy"] * last
        kept = sorted(r["doc_id"] or 0 for r in out.collect())
        if name in want:
            assert kept == want[name]
        empty = stage(spark, nothing, SF)
        assert empty.columns == out.columns and empty.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    assert "copy" in out.columns
