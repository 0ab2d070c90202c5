"""Methods for large inputs give what the methods for small ones give; odd values do not change that."""

from __future__ import annotations

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import boxes, joins, pixels, ranking, sampling, scoring
from corpuslab.sources import files, store
from corpuslab.streaming import ingest, logs


@pytest.mark.parametrize("order", [["v", "id"], ["v desc", "id"]])
@pytest.mark.parametrize("partitions", [2, 8])
def test_take_per_group_on_both_sides_of_the_limit(spark, order, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = random.Random(3)
        rows = [(k % 2, None if k % 250 == 0 else rng.randrange(300), k) for k in range(5000)]
        df = spark.createDataFrame(rows, "g int, v int, id int")
        for n in (1000, 1001, 4999):
            got = {(r["g"], r["id"]) for r in ranking.take_per_group(df, ["g"], n, order).collect()}
            want = set()
            for g in (0, 1):
                mine = [r for r in rows if r[0] == g]
                if "desc" in order[0]:
                    mine.sort(key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
                else:
                    mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
                want |= {(g, r[2]) for r in mine[:n]}
            assert got == want
            quota = spark.createDataFrame([(0, n), (1, 3)], "g int, quota long")
            kept = {(r["g"], r["id"]) for r in ranking.take_quota(df, quota, "g", order).collect()}
            assert {x for x in kept if x[0] == 0} == {x for x in want if x[0] == 0} and sum(x[0] == 1 for x in kept) == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_suppress_crowded_equals_calm_on_odd_boxes(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        x, y, w, h = rng.randrange(200), rng.randrange(200), rng.randrange(-10, 60), rng.randrange(5, 60)
        rows.append((k % 2, k, float(rng.randrange(40)), float(x), float(y), None if k % 41 == 0 else float(x + w), float(y + h), 0))
    df = spark.createDataFrame(rows, "img int, det_idx int, score double, x1 double, y1 double, x2 double, y2 double, cls int")
    keys = lambda d: sorted((r["img"], r["det_idx"]) for r in d.collect())
    assert keys(boxes.suppress(df, 0.3)) == keys(boxes.suppress(df, 0.3, group_cap=40))
    with pytest.raises(ValueError):
        boxes.suppress(df, -0.1)


def test_nearest_code_in_blocks_with_repeated_ids(spark):
    rng = random.Random(2)
    vec = lambda: [float(rng.randrange(4)) for _ in range(3)]
    vectors = spark.createDataFrame([(k // 2, vec()) for k in range(60)], "vec_id int, vec array<double>")
    codes = spark.createDataFrame([(k, vec()) for k in range(40)], "code_id int, vec array<double>")
    whole = sorted(map(str, scoring.nearest_code(vectors, codes).collect()))
    assert whole == sorted(map(str, scoring.nearest_code(vectors, codes, max_numbers=9).collect()))
    assert len(whole) == 60


def test_calibration_sample_has_one_schema(spark):
    df = spark.createDataFrame([("a", 3), ("b", 4)], "path string, bytes int")
    real, seeded = sampling.calibration_sample(df, 1), sampling.calibration_sample(df, 1, readable=F.lit(False))
    assert real.dtypes == seeded.dtypes
    assert [r["path"] for r in real.collect()] == ["a"] and len(seeded.collect()) == 10


def test_listing_paths_and_underscored_names(spark, tmp_path):
    root = str(tmp_path / "data")
    inner = f"{root}/train{root}"
    os.makedirs(inner)
    os.makedirs(f"{root}/_sub")
    for name in (f"{inner}/1.png", f"{root}/_2.png", f"{root}/3.PNG", f"{root}/.hidden.png", f"{root}/_sub/4.png"):
        with open(name, "w") as out:
            out.write("" if name.endswith("3.PNG") else "x")
    rows = {r["rel_path"]: (r["category"], r["ext"]) for r in files.read_listing(spark, root, [".png"], recursive=True).collect()}
    assert rows == {f"train{root}/1.png": ("train", ".png"), "_2.png": ("", ".png"), "3.PNG": ("", ".png"), "_sub/4.png": ("_sub", ".png")}
    assert {r["name"] for r in files.read_listing(spark, root + "/", [".png"]).collect()} == {"_2.png", "3.PNG"}


def _rows_scanned(df) -> tuple[int, str]:
    """Rows and files of the store's scan, and the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text, found, todo = plan.toString(), 0, [plan]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet") and "payload" in node.toString():
            found += node.metrics().apply("numOutputRows").value()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found, text


def test_store_lookup_reads_the_buckets_of_the_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.range(2000).select(F.format_string("%05d", "id").alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("payload"))
    store.write_packed(df, path, 50)
    keys = spark.createDataFrame([("00003",), ("01990",)], "key string")
    found = store.read_store(spark, path, keys)
    assert sorted(r["key"] for r in found.collect()) == ["00003", "01990"]
    rows, plan = _rows_scanned(store.read_store(spark, path, keys))
    assert "dynamicpruning" in plan.lower()
    sizes = {r["bucket"]: r["count"] for r in spark.read.parquet(path).groupBy("bucket").count().collect()}
    wanted = {r["b"] for r in keys.select(store.bucket_of(F.col("key"), 50).alias("b")).collect()}
    assert len(wanted) == 2 and rows == sum(sizes[b] for b in wanted) < 200
    assert store.read_store(spark, path, keys.limit(0)).count() == 0
    # More keys than Spark would broadcast: the buckets still prune.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, plan = _rows_scanned(store.read_store(spark, path, keys))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == sum(sizes[b] for b in wanted) and "SortMergeJoin" in plan


def test_store_chooses_its_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BUCKET_ROWS", 10)
    monkeypatch.setattr(store, "MAX_BUCKETS", 8)
    df = spark.range(300).select(F.col("id").cast("string").alias("key"), F.lit(b"x").alias("payload"))
    path = str(tmp_path / "store")
    store.write_packed(df, path)
    stored = spark.read.parquet(path)
    assert stored.select("of_buckets").distinct().collect() == [(8,)] and stored.count() == 300
    assert store.read_store(spark, path, df.select("key")).count() == 300
    store.write_packed(df.limit(0), str(tmp_path / "none"))


def test_windows_keep_their_length(spark):
    frames = spark.createDataFrame([("c", k, f"p{k}") for k in (0, 1, 3)] + [("d", 0, "q")], "clip string, frame_idx int, payload string")
    got = {(r["clip"], r["frame_idx"]): r["window"] for r in ranking.gather_frames(frames, 3, "replicate").collect()}
    assert got[("c", 1)] == ["p0", "p1", None] and got[("c", 3)] == [None, "p3", "p3"]
    short = {(r["clip"], r["frame_idx"]): r["window"] for r in ranking.gather_frames(frames, 5, "reflection").collect()}
    assert all(len(w) == 5 for w in short.values())


def test_ema_leaves_out_nulls(spark):
    df = spark.createDataFrame([("r", k, v) for k, v in enumerate([None, 10.0, 10.0, None, 20.0])], "run string, i int, v double")
    got = {r["i"]: r["ema"] for r in ranking.ema(df, 0.9, ["run"], "i", "v").collect()}
    assert got[0] is None and got[3] is None
    assert [round(got[k], 9) for k in (1, 2, 4)] == [10.0, 10.0, 11.0]


def test_degrade_needs_a_plan_and_takes_null_coins(spark):
    planes = spark.createDataFrame([(1, 0, 4, 4, [5.0] * 16), (2, 0, 4, 4, [5.0] * 16)], "img int, ch int, h int, w int, plane array<double>")
    plan = "img int, kernel string, sigma_x double, sigma_y double, theta double, scale double, noise double, jitter boolean, jitter_0 double, jitter_1 double, jitter_2 double, gray boolean"
    row = lambda i: (i, "iso", 1.0, 1.0, 0.0, 1.0, 0.0, None, 0.0, 0.0, 0.0, None)
    assert sampling.degrade(planes, spark.createDataFrame([row(1), row(2)], plan), 5).count() == 2
    with pytest.raises(Exception, match="no degradation plan"):
        sampling.degrade(planes, spark.createDataFrame([row(1)], plan), 5).count()


def test_stitch_coverage_reports_an_absent_image(spark):
    px = spark.createDataFrame([(1, 0, y, x, 1.0) for y in range(2) for x in range(2)], "img int, ch int, y int, x int, v double")
    images = spark.createDataFrame([(1, 2, 2), (2, 2, 2)], "img int, h int, w int")
    assert [(r["img"], r["ch"], r["distinct"]) for r in pixels.stitch_coverage(px, images).collect()] == [(2, 0, 0)]
    assert {(r["img"], r["ch"]) for r in pixels.stitch_coverage(px, images, channels=[0, 1]).collect()} == {(1, 1), (2, 0), (2, 1)}
    assert pixels.stitch_coverage(px.limit(0), images).count() == 2


def test_every_sample_keeps_a_row(spark):
    samples = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "name string, flip boolean")
    codes = spark.createDataFrame([("a", False, [1]), ("c", False, [2])], "name string, flip boolean, codes array<int>")
    parts = spark.createDataFrame([("a", "nose", 5.0, 5.0, 2.0), ("b", "nose", 5.0, 5.0, 2.0)], "name string, part string, cx double, cy double, half double")
    assert {(r["name"], r["status"]) for r in joins.attach_annotations(samples, codes, parts).collect()} == {("a", "ok"), ("b", "no_codes"), ("c", "no_components")}


def test_score_of_another_type(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abcd")], "id int, text string")
    out = scoring.score(df, lambda: lambda values: [float(len(v)) for v in values], "text", out_type="double")
    assert [(r["id"], r["scored"], r["failed"]) for r in out.orderBy("id").collect()] == [(1, 2.0, False), (2, None, True), (3, 4.0, False)]


def test_log_lines_that_do_not_fit(spark):
    head = "[train..][epoch:  3, iter:   1,234, lr:(5.000e-05,)] [eta: 1 day, 2:03:04, time (data): 52.250 (0.010)] "
    tails = ["l_a: 1.0 l_b: -2e-3", "l_a: 1.0 l_b:", "l_a 1.0", "l_a: nan", "", "l_a: 1.0 text here: 3"]
    df = spark.createDataFrame([(head + t,) for t in tails] + [("iter: 3 eta: none",)], "value string")
    rows = logs.parse_training_log(df).collect()
    assert [(r["iteration"], r["eta"], r["eta_s"], r["losses"]) for r in rows] == [(1234, "1 day, 2:03:04", 93784, {"l_a": 1.0, "l_b": -0.002})]


def test_ingest_with_a_new_checkpoint_and_a_replayed_batch(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    schema = "key string, n int"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(f"k{i}", i) for i in range(6)], schema).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)

    def run(checkpoint, **options):
        ingest.stream_ingest(stream(), out, str(tmp_path / checkpoint), "key", "n", **options).awaitTermination()
        return sorted((r["key"], r["item_id"]) for r in spark.read.parquet(out).collect())

    first = run("a", existing=spark.createDataFrame([("k0", 10)], "key string, item_id long"))
    assert first == [(f"k{i}", 10 + i) for i in range(1, 6)]
    spark.createDataFrame([("k9", 9), ("k2", 2)], schema).coalesce(1).write.mode("append").parquet(src)
    second = run("b")
    assert second == sorted(first + [("k0", 16), ("k9", 17)])
    assert run("b") == second
    # The commit of the last batch is lost: it runs again and replaces its own folder only.
    commits = tmp_path / "b" / "commits"
    newest = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    newest.rename(tmp_path / "lost")
    crc = commits / f".{newest.name}.crc"
    if crc.exists():
        crc.rename(tmp_path / "lost.crc")
    assert run("b") == second
    assert t0


def test_epochs_batches_and_medians_read_their_input_once(spark, sf_dir):
    """The plan that is left reads only what was written from the input."""
    from corpuslab.operators import aggregates

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sample = sampling.epoch_sample(orders, "o_orderkey", 1.5, 4)
    medians = aggregates.exact_median(orders, ["o_orderpriority"], "o_totalprice", "o_orderkey")
    for out in (sample, sampling.batch(sample, 8), medians):
        assert out.inputFiles() and not any("orders.parquet" in f for f in out.inputFiles())


def test_pixel_queries_do_not_join_exploded_planes(spark, sf_dir):
    from corpuslab.plans.catalogue import QUERIES

    for name in ("to_luma", "rescale_planes", "channel_moments", "pair_loss", "gram", "box_fit"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan, name


def test_planes_are_worked_on_in_slices():
    batches = [pd.DataFrame({"v": range(n)}) for n in (0, 5, 256, 600)]
    got = list(sampling.in_slices(iter(batches)))
    assert [len(g) for g in got] == [5, 256, 256, 256, 88] and all(list(g.index) == list(range(len(g))) for g in got)
    assert [v for g in got for v in g["v"]] == [v for b in batches for v in b["v"]]
