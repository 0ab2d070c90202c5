"""The pipeline stage by stage against plain versions, and the registered queries against DuckDB."""

from __future__ import annotations

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck
from corpuslab.llm import decontaminate, quality
from corpuslab.llm.common import saved, table
from corpuslab.llm.queries import ORACLES, QUERIES
from test_quality_mixing_benchmark import check_mix
from test_shingles import plain_stay

NAMES = ["quality", "exact dedup", "near dedup", "decontamination", "mixing"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    frames = [table(spark, sf_dir, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(saved(stage(spark, frames[-1], sf_dir)))
    return frames


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    assert all(f.columns == steps[0].columns for f in steps[:-1])
    counts = [f.count() for f in steps]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] >= counts[4] == counts[5] > 0
    assert counts[1] > counts[4]


def test_quality_stage(spark, sf_dir, steps):
    scores = quality.classify(steps[0], quality.fit(steps[0], table(spark, sf_dir, "labels")))
    assert ids(steps[1]) == ids(scores.where("predicted = 1"))


def test_exact_stage(steps):
    best = {}
    for r in steps[1].collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert ids(steps[2]) == Counter(best.values())


def test_near_stage(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[2].collect()]
    assert set(ids(steps[3])) == plain_stay(rows)


def test_benchmark_stage(spark, sf_dir, steps):
    items = [decontaminate.normalise(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    left = {r["doc_id"]: decontaminate.normalise(r["text"]) for r in steps[3].collect()}
    kept = set(ids(steps[4]))
    assert all(not any(i in left[d] for i in items) for d in kept)
    # What went holds an item with few edits: most of its words are there.
    for d in set(left) - kept:
        assert any(sum(w in left[d] for w in i.split()) >= 0.7 * len(i.split()) for i in items)


def test_mixing_stage(steps):
    rows = [(r["doc_id"], r["text"], None, r["source"]) for r in steps[4].collect()]
    check_mix(rows, steps[5].collect(), 1.0)


def test_run_equals_the_stages(spark, sf_dir, steps):
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == Counter(map(tuple, steps[5].collect()))


def test_registered():
    known = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(known)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLES[name]) == []


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_empty_tables_through_the_whole_pipeline(spark, sf_dir, tmp_path, empty):
    from cases import frame, odd_rows

    rows = [] if empty else odd_rows()
    folder = str(tmp_path)
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels = table(spark, sf_dir, "labels")
    (labels.limit(0) if empty else labels).write.parquet(f"{folder}/labels.parquet")
    items = spark.createDataFrame([] if empty else [(1, rows[20][1]), (None, None), (2, "")], "item_id long, text string")
    items.write.parquet(f"{folder}/benchmark.parquet")
    done = corpus_pipeline.run(spark, folder)
    assert done.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = [r["doc_id"] for r in done.collect()]
    assert set(got) <= {r[0] for r in rows} and (not empty or got == [])
    frames = [table(spark, folder, "documents")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(saved(stage(spark, frames[-1], folder)))
        assert frames[-1].columns == frames[0].columns
