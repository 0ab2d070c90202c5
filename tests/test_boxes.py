"""Suppression, overlaps and matching against brute force, crowded images included."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import boxes


def make(n, images=("a",), spread=100.0, seed=3, sizes=(5, 30)):
    r = random.Random(seed)
    out = []
    for i in range(n):
        img = images[min(int(r.random() ** 2 * len(images)), len(images) - 1)]
        x, y = r.uniform(0, spread), r.uniform(0, spread)
        out.append((img, i, x, y, x + r.uniform(*sizes), y + r.uniform(*sizes), round(r.random(), 2), i % 2))
    return out


SCHEMA = "img string, det_idx long, x1 double, y1 double, x2 double, y2 double, score double, cls int"


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    inter = max(w, 0) * max(h, 0)
    return inter / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter)


def brute(rows, limit, by_class=False):
    kept = []
    for row in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(k[0] != row[0] or (by_class and k[7] != row[7]) or iou(k, row) <= limit for k in kept):
            kept.append(row)
    return sorted(r[1] for r in kept)


@pytest.mark.parametrize("cap", [50_000, 60])
@pytest.mark.parametrize("by_class", [False, True])
def test_suppress_equals_brute_force(spark, cap, by_class):
    rows = make(200, images=("a", "b", "c"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = boxes.suppress(df, 0.4, class_aware=by_class, group_cap=cap)
    assert sorted(r["det_idx"] for r in got.collect()) == brute(rows, 0.4, by_class)


def test_crowded_suppression_with_mixed_sizes_and_copies(spark):
    rows = make(120, spread=300, sizes=(1, 80), seed=8)
    rows += [("a", 1000 + i, 10.0, 10.0, 60.0, 60.0, 0.5, 0) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = boxes.suppress(df, 0.5, group_cap=30)
    assert sorted(r["det_idx"] for r in got.collect()) == brute(rows, 0.5)


def test_small_batches_carry_kept_boxes_over(spark):
    rows = make(200, images=("a", "b"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [r["det_idx"] for r in boxes.suppress(spark.createDataFrame(rows, SCHEMA), 0.3).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted(got) == brute(rows, 0.3)


def test_suppress_limit_is_strict_and_top_k(spark):
    # overlap exactly one third
    rows = [("a", 0, 0.0, 0.0, 2.0, 1.0, 0.9, 0), ("a", 1, 1.0, 0.0, 3.0, 1.0, 0.8, 0), ("a", 2, 50.0, 0.0, 51.0, 1.0, 0.7, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert boxes.suppress(df, 1 / 3).count() == 3
    assert boxes.suppress(df, 0.33).count() == 2
    assert sorted(r["det_idx"] for r in boxes.suppress(df, 0.9, top_k=2).collect()) == [0, 1]


def test_merge_is_a_score_weighted_mean(spark):
    rows = [("a", 0, 0.0, 0.0, 10.0, 10.0, 0.9, 0), ("a", 1, 1.0, 0.0, 11.0, 10.0, 0.3, 0), ("a", 2, 50.0, 50.0, 60.0, 60.0, 0.8, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = boxes.suppress(df, 0.5, merge=True).collect()
    assert [(r["det_idx"], pytest.approx(0.25)) for r in got] == [(0, r["x1"]) for r in got]
    assert boxes.suppress(df, 0.5, merge=True, redundant=False).count() == 2


@pytest.mark.parametrize("kind", ["iou", "iof"])
def test_overlap_pairs_equal_brute_force(spark, kind):
    rows = make(120, images=("a", "b"), sizes=(1, 60))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["a_idx"], r["b_idx"]): r["overlap"] for r in boxes.box_overlap(df, df, kind).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and iou(a, b) > 0:
                area = (a[4] - a[2]) * (a[5] - a[3])
                inter = max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)
                want[(a[1], b[1])] = iou(a, b) if kind == "iou" else inter / max(area, 1)
    assert got == pytest.approx(want)


def test_unknown_overlap_kind(spark):
    df = spark.createDataFrame(make(3), SCHEMA)
    with pytest.raises(ValueError):
        boxes.box_overlap(df, df, "dice")


def test_match_priors_against_matrix_form(spark):
    r = random.Random(4)
    truth = [("i", j, *(lambda x, y, s: (x, y, x + s, y + s))(r.random() * 0.7, r.random() * 0.7, r.uniform(0.02, 0.3)), 1 + j % 2) for j in range(9)]
    # an image whose only truth meets no prior well
    truth.append(("far", 0, 3.0, 3.0, 3.1, 3.1, 1))
    df = spark.createDataFrame(truth, "img string, det_idx long, x1 double, y1 double, x2 double, y2 double, label int")
    priors = boxes.prior_grid(spark, 128, 128, [32], [[20, 50]])
    p = np.array([[q[c] for c in ("cx", "cy", "w", "h")] for q in priors.orderBy("prior_id").collect()])
    assert len(p) == 32
    corner = np.hstack([p[:, :2] - p[:, 2:] / 2, p[:, :2] + p[:, 2:] / 2])
    t = np.array([row[2:6] for row in truth if row[0] == "i"])
    span = np.clip(np.minimum(t[:, None, 2:], corner[None, :, 2:]) - np.maximum(t[:, None, :2], corner[None, :, :2]), 0, None)
    inter = span[..., 0] * span[..., 1]
    size = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    m = inter / (size(t)[:, None] + size(corner)[None] - inter)
    owner, best = m.argmax(0), m.max(0)
    best[m.argmax(1)[m.max(1) >= 0.2]] = 2
    for j, k in enumerate(m.argmax(1)):
        owner[k] = j
    labels = np.where(best < 0.35, 0, np.array([row[6] for row in truth if row[0] == "i"])[owner])
    got = boxes.match_priors(df, priors).where("img = 'i'").orderBy("prior_id").collect()
    assert [g["det_idx"] for g in got] == owner.tolist()
    assert [g["label"] for g in got] == labels.tolist()
    assert [g["dx"] for g in got] == pytest.approx((((t[owner][:, 0] + t[owner][:, 2]) / 2 - p[:, 0]) / (0.1 * p[:, 2])).tolist())
    far = boxes.match_priors(df, priors).where("img = 'far'").collect()
    assert len(far) == 32 and all(g["label"] == 0 and g["dx"] == 0 for g in far)


def test_one_box_per_image_ties_go_to_the_first(spark):
    rows = [("a", 1, 0.0, 0.0, 4.0, 4.0, 0.1, 0), ("a", 0, 6.0, 6.0, 10.0, 10.0, 0.1, 0), ("a", 2, 8.0, 8.0, 90.0, 9.0, 0.1, 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "10 AS img_w", "10 AS img_h")
    assert boxes.largest_box(df).collect()[0]["det_idx"] == 0
    assert boxes.center_box(df.where("det_idx < 2")).collect()[0]["det_idx"] == 0
    assert boxes.center_box(df, (0.0, 0.0)).collect()[0]["det_idx"] == 1


def _tables_written(monkeypatch):
    seen, cut = [], boxes.cut_lineage
    monkeypatch.setattr(boxes, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    return seen


def test_suppression_across_tiles_takes_few_rounds(spark, monkeypatch):
    """A chain over many tiles, each box overlapping the next, and a field of boxes around it."""
    seen = _tables_written(monkeypatch)
    chain = [("a", k, 6.0 * k, 0.0, 6.0 * k + 10.0, 10.0, 1 - k / 1000, 0) for k in range(600)]
    field = [(i, 1000 + d, x1, y1 + 40, x2, y2 + 40, s, c) for i, d, x1, y1, x2, y2, s, c in make(800, spread=2000, sizes=(2, 12), seed=3)]
    rows = chain + field
    got = boxes.suppress(spark.createDataFrame(rows, SCHEMA), 0.2, group_cap=10)
    assert sorted(r["det_idx"] for r in got.collect()) == brute(rows, 0.2)
    assert 1 < len(seen) <= 14


def test_tiles_meet_in_small_batches_and_with_huge_boxes(spark):
    rows = make(150, spread=400, sizes=(1, 20), seed=9) + [("a", 900, -1e6, -1e6, 1e6, 1e6, 0.5, 0), ("a", 901, -1e6, -1e6, 1e6, 1e6 + 1, 0.4, 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [r["det_idx"] for r in boxes.suppress(spark.createDataFrame(rows, SCHEMA), 0.3, group_cap=10).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert sorted(got) == brute(rows, 0.3)


def test_a_crowded_cell_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(boxes, "CELL_ROWS", 16)
    rows = [("hot", k, 1.0 + k / 1000, 1.0, 5.0, 5.0, 0.5, 0) for k in range(150)] + [("b", 500 + k, 9.0 * k, 0.0, 9.0 * k + 5, 5.0, 0.5, 0) for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = boxes.box_overlap(df, df)
        tasks = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
        found = {(r["a_idx"], r["b_idx"]) for r in pairs.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {(a, b) for a in range(150) for b in range(150)} | {(k, k) for k in range(500, 560)}
    assert sum(tasks) == 150 * 150 + 60 and len(tasks) > 16 and max(tasks) < 4000


def test_match_priors_deals_pairs_by_their_number(spark, monkeypatch):
    truth = [(f"i{k % 9}", k, 0.1, 0.1, 0.3 + k % 5 / 10, 0.5, 1) for k in range(60)]
    df = spark.createDataFrame(truth, "img string, det_idx long, x1 double, y1 double, x2 double, y2 double, label int")
    priors = boxes.prior_grid(spark, 128, 128, [32], [[20, 50]])
    want = sorted(boxes.match_priors(df, priors).collect())
    asked = []
    real = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: asked.append(a) or real(self, *a))
    monkeypatch.setattr(boxes, "TASK_PAIRS", 10)
    assert sorted(boxes.match_priors(df, priors).collect()) == want
    assert [a[0] > 20 and a[1] == "img" for a in asked if "img" in a] == [True, True]
