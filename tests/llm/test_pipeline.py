"""The pipeline's stages: columns stay, decisions take effect, the whole equals the stages by brute force."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from chronomesh.plans.stage import shared_dir
from tests.llm.test_neardup import slow_kept
from tests.llm.test_operators import NORMAL, lower, slow_lines, slow_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        found.append((name, before, docs))
        if name != "packing":
            assert docs.columns == columns
    _, before, after = found[0]
    assert after.count() >= 0.99 * len(before)
    _, before, after = found[1]
    gone = {d: set(g.split(",")) for d, _, _, g in slow_lines(list(before.items())) if g}
    assert {r.doc_id: r.text for r in after.collect()} == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if str(k) not in gone.get(d, ())) for d, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in after.collect())
    _, before, after = found[2]
    assert {r.doc_id for r in after.collect()} == slow_kept(sorted(before.items()))
    _, before, after = found[3]
    scans = {d: slow_scan(t, items) for d, t in before.items()}
    left = {r.doc_id: r.text for r in after.collect()}
    assert left.keys() == {d for d, s in scans.items() if not s[4]}
    assert all(len(NORMAL.findall(lower(t))) == scans[d][0] - scans[d][1] for d, t in left.items())
    assert {r.doc_id for r in found[4][2].collect()} == left.keys()


def test_run(spark):
    """Rows come out, and of the stages' tables only the last one's input and helpers stay."""
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
    left = {x.rpartition("-")[0] for x in set(os.listdir(folder)) - before if os.listdir(f"{folder}/{x}")}
    assert "benchmark" in left and not left & {"language", "lines", "near_duplicates", "shingles", "classes", "edges", "gone"}


def test_queries(spark):
    import __spark_entry__ as entry

    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted({int(k[2:].split("_")[0]) for k in names}) == list(range(1, 11)) and "pipeline" in entry.queries()
