"""Planes, tiles, layers and scores on hand-made images."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import metrics, pixels, sampling, scoring

rng = np.random.default_rng(0)
PAIR = "pair int, ch int, h int, w int, a array<double>, b array<double>"


def plane_df(spark, arrays, schema="img long, ch int, h int, w int, plane array<double>"):
    return spark.createDataFrame([(i, c, *a.shape, a.ravel().tolist()) for i, c, a in arrays], schema)


def test_equal_images_have_infinite_psnr_and_unit_ssim(spark):
    a = rng.uniform(0, 255, (13, 12))
    b = a + 1
    df = spark.createDataFrame([(0, 0, 13, 12, a.ravel().tolist(), a.ravel().tolist()), (1, 0, 13, 12, a.ravel().tolist(), b.ravel().tolist())], PAIR)
    got = {r["pair"]: r["psnr"] for r in metrics.psnr(df).collect()}
    assert got[0] == math.inf and got[1] == pytest.approx(20 * math.log10(255))
    assert {r["pair"]: r["ssim"] for r in metrics.ssim(df).collect()}[0] == pytest.approx(1.0)


def test_small_planes_have_no_ssim_and_shapes_must_agree(spark):
    ten = [1.0] * 100
    df = spark.createDataFrame([(0, 0, 10, 10, ten, ten)], PAIR)
    assert metrics.ssim(df).collect()[0]["ssim"] is None
    with pytest.raises(Exception, match="differ in shape"):
        metrics.psnr(spark.createDataFrame([(0, 0, 10, 10, ten, ten[:-1])], PAIR)).collect()


def test_mixed_shapes_in_one_batch(spark):
    arrays = [(i, 0, rng.uniform(0, 255, (3 + i % 4, 5))) for i in range(12)]
    got = {r["img"]: r["sharpness"] for r in pixels.sharpness(plane_df(spark, arrays).coalesce(1)).collect()}
    for i, _, a in arrays:
        p = np.pad(a, 1, mode="reflect")
        lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a
        assert got[i] == pytest.approx(lap.var())


def test_weighted_total_variation(spark):
    a = rng.uniform(0, 255, (4, 5))
    wt = rng.uniform(0.1, 1, (4, 5))
    df = plane_df(spark, [(0, 0, a)]).withColumn("wt", F.lit(wt.ravel().tolist()))
    dy, dx = np.abs(np.diff(a, axis=0)), np.abs(np.diff(a, axis=1))
    want = (dy * wt[:-1]).sum() / wt[:-1].sum() + (dx * wt[:, :-1]).sum() / wt[:, :-1].sum()
    assert pixels.total_variation(df, "wt").collect()[0]["tv"] == pytest.approx(want)


@pytest.mark.parametrize("mode,size,pad", [("fixed", 4, 1), ("overlap", 6, 2), ("fixed", 50, 3)])
def test_tiles_put_back_together(spark, mode, size, pad):
    arrays = [(0, 0, rng.uniform(0, 255, (11, 9))), (1, 0, rng.uniform(0, 255, (3, 14)))]
    planes = plane_df(spark, arrays)
    images = planes.select("img", "h", "w")
    tiles = pixels.cut_tiles(planes, pixels.tile(images, size, pad, mode))
    out = pixels.stitch(tiles)
    assert pixels.stitch_coverage(out, images).count() == 0
    got = {(r["img"], r["y"], r["x"]): r["v"] for r in out.collect()}
    assert got == {(i, y, x): a[y, x] for i, _, a in arrays for y in range(a.shape[0]) for x in range(a.shape[1])}


def test_scaled_tiles_cover_every_output_pixel(spark):
    planes = plane_df(spark, [(0, 0, np.arange(30.0).reshape(5, 6))])
    tiles = pixels.cut_tiles(planes, pixels.tile(planes.select("img", "h", "w"), 3, 1, "fixed"))

    @F.pandas_udf("array<double>")
    def twice(p: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([np.kron(np.reshape(v, (-1, int(k))), np.ones((2, 2))).ravel() for v, k in zip(p, w)])

    out = pixels.stitch(tiles.withColumn("plane", twice("plane", F.expr("x2 - x1"))), 2)
    assert pixels.stitch_coverage(out, planes.select("img", "h", "w"), 2).count() == 0
    assert {(r["y"], r["x"]): r["v"] for r in out.collect()}[(9, 11)] == 29.0


@pytest.mark.parametrize("block", [2, 256])
def test_layer_order_and_blocks(spark, block):
    base = spark.createDataFrame([(0, 0, 0, 0, 100.0)], "img long, ch int, y int, x int, v double")
    layers = [(0, 0, 0, 0, 20.0 * k, k, 0.1 * k) for k in range(1, 8)]
    df = spark.createDataFrame(layers, "img long, ch int, y int, x int, v double, layer int, mask double").repartition(4)
    want = 100.0
    for *_, v, k, m in layers:
        want = m * v + (1 - m) * want
    assert pixels.composite(base, df, block).collect()[0]["v"] == pytest.approx(want)


def test_gray_detection_and_single_channel(spark):
    a = rng.uniform(0, 255, (4, 4))
    df = plane_df(spark, [(0, c, a) for c in range(3)] + [(1, 0, a)] + [(2, c, a * c) for c in range(3)])
    assert {r["img"]: r["is_gray"] for r in pixels.detect_gray(df).collect()} == {0: True, 1: True, 2: False}


def test_degrade_is_independent_of_partitioning(spark):
    planes = plane_df(spark, [(i, c, rng.uniform(0, 255, (16, 16))) for i in range(4) for c in range(3)])
    plan = spark.createDataFrame(
        [(i, "iso" if i % 2 else "aniso", 1.5, 0.5, 0.3, 2.0 + i, 5.0, i == 1, 3.0, 0.0, -3.0, i == 2) for i in range(4)],
        "img long, kernel string, sigma_x double, sigma_y double, theta double, scale double, noise double, jitter boolean, jitter_0 double, jitter_1 double, jitter_2 double, gray boolean",
    )
    one = {(r["img"], r["ch"]): list(r["plane"]) for r in sampling.degrade(planes, plan, 7, 3).collect()}
    two = {(r["img"], r["ch"]): list(r["plane"]) for r in sampling.degrade(planes.repartition(7), plan, 7, 3).collect()}
    assert one == two and len(one) == 12
    assert one[(2, 0)] == one[(2, 2)] and one[(1, 0)] != one[(1, 2)]
    assert all(0 <= v <= 255 and v == round(v) for p in one.values() for v in p)


def test_motion_kernels_take_the_place_of_the_blur(spark):
    """A kernel that moves every pixel one to the left, for the images whose coin is true."""
    a = rng.uniform(0, 255, (6, 8))
    shift = np.array([[0.0, 0.0, 1.0]])
    row = lambda i, motion: (i, "iso", 0.01, 0.01, 0.0, 1.0, 0.0, False, 0.0, 0.0, 0.0, False, motion)
    plan = spark.createDataFrame([row(0, True), row(1, False), row(2, None)], "img long, kernel string, sigma_x double, sigma_y double, theta double, scale double, noise double, jitter boolean, jitter_0 double, jitter_1 double, jitter_2 double, gray boolean, motion boolean")
    planes = plane_df(spark, [(i, 0, a) for i in range(3)])
    got = {r["img"]: np.array(r["plane"]).reshape(6, 8) for r in sampling.degrade(planes, plan, 3, motion_kernels=[shift]).collect()}
    moved = np.hstack([a[:, 1:], a[:, -2:-1]])
    assert (got[0] == np.floor(moved + 0.5)).all() and (got[1] == np.floor(a + 0.5)).all() and (got[2] == got[1]).all()
    still = {r["img"]: r["plane"] for r in sampling.degrade(planes, plan, 3).collect()}
    assert still[0] == still[1]


def test_noise_is_standard_normal(spark):
    z = np.array(spark.range(40).select(F.explode(sampling.normal_noise(F.col("id").cast("string"), F.lit(500), 3))).toPandas()["col"])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs((np.abs(z) < 1).mean() - 0.6827) < 0.015


def test_gray_images_mix_all_channels(spark):
    planes = [(0, c, rng.uniform(0, 255, (6, 6))) for c in range(3)]
    plan = spark.createDataFrame([(0, "iso", 0.01, 0.01, 0.0, 1.0, 0.0, False, 0.0, 0.0, 0.0, True)], "img long, kernel string, sigma_x double, sigma_y double, theta double, scale double, noise double, jitter boolean, jitter_0 double, jitter_1 double, jitter_2 double, gray boolean")
    got = {r["ch"]: r["plane"] for r in sampling.degrade(plane_df(spark, planes), plan, 3).collect()}
    want = np.floor(sum(w * a for w, (_, _, a) in zip(pixels.LUMA_GRAY, planes)) + 0.5).ravel().tolist()
    assert got == {c: pytest.approx(want) for c in range(3)}


def test_planes_of_layers_and_tiles_equal_the_pixel_forms(spark):
    base = plane_df(spark, [(i, 0, rng.uniform(0, 255, (5, 7))) for i in range(2)])
    layers = [(i, 0, k, rng.integers(-4, 6), rng.integers(-4, 8), 3, 4, rng.uniform(0, 255, 12).tolist(), rng.uniform(0, 1, 12).tolist()) for i in (0, 1, 5) for k in range(4)]
    layers = [(i, c, k, int(y), int(x), h, w, p, m) for i, c, k, y, x, h, w, p, m in layers]
    df = spark.createDataFrame(layers, "img long, ch int, layer int, y0 int, x0 int, h int, w int, plane array<double>, mask array<double>").repartition(3)
    flat = df.select("img", "ch", "layer", "y0", "x0", "w", F.posexplode(F.arrays_zip("plane", "mask")).alias("p", "e"))
    flat = flat.select("img", "ch", "layer", (F.col("y0") + F.floor(F.col("p") / F.col("w"))).cast("int").alias("y"), (F.col("x0") + F.col("p") % F.col("w")).alias("x"), F.col("e.plane").alias("v"), F.col("e.mask").alias("mask"))
    pixel = pixels.explode_planes(base).drop("h", "w")
    want = {(r["img"], r["y"], r["x"]): r["v"] for r in pixels.composite(pixel, flat).collect()}
    got = pixels.explode_planes(pixels.composite_planes(base, df)).collect()
    assert {(r["img"], r["y"], r["x"]): r["v"] for r in got} == pytest.approx(want) and len(want) == 70
    assert pixels.composite_planes(base, df.limit(0)).count() == 2


def test_cover_of_tiles_and_its_shuffle(spark):
    images = spark.createDataFrame([(0, 150, 90), (1, 30, 200), (2, 5, 5)], "img long, h int, w int")
    tiles = pixels.tile(images, 40, 4, "fixed").withColumn("ch", F.explode(F.array(F.lit(0), F.lit(1))))
    assert pixels.tile_coverage(tiles, images, 2).count() == 0
    lost = tiles.where("NOT (img = 0 AND ch = 1 AND row = 2 AND col = 1)").where("img < 2")
    again = lost.where("img = 1 AND ch = 0 AND row = 0 AND col = 0").withColumn("x", F.col("x") + 3)
    got = {(r["img"], r["ch"]): (r["distinct"], r["most"]) for r in pixels.tile_coverage(lost.unionByName(again), images).collect()}
    assert got == {(0, 1): (150 * 90 - 40 * 40, 1), (1, 0): (6000, 2), (2, 0): (0, 0), (2, 1): (0, 0)}
    plan = pixels.tile_coverage(lost, images)._jdf.queryExecution().executedPlan().toString()
    assert "plane" not in plan


def test_degrade_without_effect_is_the_rounded_input(spark):
    a = rng.uniform(0, 255, (8, 8))
    plan = spark.createDataFrame([(0, "iso", 0.01, 0.01, 0.0, 1.0, 0.0, False, 0.0, 0.0, 0.0, False)], "img long, kernel string, sigma_x double, sigma_y double, theta double, scale double, noise double, jitter boolean, jitter_0 double, jitter_1 double, jitter_2 double, gray boolean")
    got = sampling.degrade(plane_df(spark, [(0, 0, a)]), plan, 3).collect()[0]["plane"]
    assert got == pytest.approx(np.floor(a.ravel() + 0.5).tolist())


@pytest.mark.parametrize("kernel", ["iso", "aniso"])
def test_degrade_against_plain_loops(spark, kernel):
    a, k, (sx, sy, theta), scale = rng.uniform(0, 255, (10, 12)), 5, (1.2, 0.6, 0.4), 2.0
    if kernel == "iso":
        sy, theta = sx, 0.0
    cov = np.array([[np.cos(theta), -np.sin(theta)], [np.sin(theta), np.cos(theta)]])
    inv = np.linalg.inv(cov @ np.diag([sx**2, sy**2]) @ cov.T)
    taps = np.array([[math.exp(-0.5 * np.array([x, y]) @ inv @ np.array([x, y])) for x in range(-2, 3)] for y in range(-2, 3)])
    taps /= taps.sum()
    p = np.pad(a, 2, mode="reflect")
    blurred = np.array([[(p[y : y + k, x : x + k] * taps).sum() for x in range(12)] for y in range(10)])
    small = blurred.reshape(5, 2, 6, 2).mean(axis=(1, 3))
    want = np.empty((10, 12))
    for y in range(10):
        for x in range(12):
            fy, fx = min(max((y + 0.5) / 2 - 0.5, 0), 4), min(max((x + 0.5) / 2 - 0.5, 0), 5)
            y0, x0 = int(fy), int(fx)
            y1, x1 = min(y0 + 1, 4), min(x0 + 1, 5)
            top = small[y0, x0] * (1 - fx + x0) + small[y0, x1] * (fx - x0)
            low = small[y1, x0] * (1 - fx + x0) + small[y1, x1] * (fx - x0)
            want[y, x] = top * (1 - fy + y0) + low * (fy - y0)
    plan = spark.createDataFrame([(0, kernel, 1.2, 0.6, 0.4, scale, 0.0, False, 0.0, 0.0, 0.0, False)], "img long, kernel string, sigma_x double, sigma_y double, theta double, scale double, noise double, jitter boolean, jitter_0 double, jitter_1 double, jitter_2 double, gray boolean")
    got = sampling.degrade(plane_df(spark, [(0, 0, a)]), plan, k).collect()[0]["plane"]
    assert got == pytest.approx(np.round(want).ravel().tolist())


def test_metric_registry(spark):
    with pytest.raises(KeyError):
        metrics.register_metric("psnr")(metrics.psnr)
    with pytest.raises(KeyError):
        metrics.metric("fid")


def test_nearest_code_ties_and_blocks(spark):
    book = rng.normal(size=(40, 6))
    book[30] = book[4]
    vecs = np.vstack([rng.normal(size=(60, 6)), book[4]])
    codes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(book)], "code_id long, vec array<double>")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, vec array<double>")
    want = {i: int(((v - book) ** 2).sum(1).argmin()) for i, v in enumerate(vecs)}
    assert want[60] == 4
    whole = {r["vec_id"]: r["code_id"] for r in scoring.nearest_code(df, codes).collect()}
    cut = {r["vec_id"]: r["code_id"] for r in scoring.nearest_code(df, codes, max_numbers=50).collect()}
    assert whole == want and cut == want


def test_schedules(spark):
    df = spark.range(31)
    i = F.col("id")
    cols = {
        "m": scoring.schedule_value(i, "multistep", 1.0, milestones=[10, 20, 20], gamma=0.5, restarts=(0, 25), restart_weights=(1, 0.8)),
        "c": scoring.schedule_value(i, "cosine", 1.0, periods=[10, 20], restart_weights=(1, 0.5), eta_min=0.0),
        "w": scoring.schedule_value(i, "constant", 2.0, warmup=4),
    }
    rows = {r["id"]: r for r in df.select("id", *[c.alias(n) for n, c in cols.items()]).collect()}
    assert [rows[k]["m"] for k in (0, 9, 10, 19, 20, 24, 25, 30)] == [1, 1, 0.5, 0.5, 0.125, 0.125, 0.8, 0.8]
    assert rows[10]["c"] == pytest.approx(0.0) and rows[11]["c"] == pytest.approx(0.25 * (1 + math.cos(math.pi / 20)))
    assert [rows[k]["w"] for k in (0, 1, 4, 9)] == [0.0, 0.5, 2.0, 2.0]
    with pytest.raises(ValueError):
        scoring.schedule_value(i, "poly", 1.0)


def test_user_model_passes_failures_through(spark):
    def picky_model():
        def run(values):
            if (values > 7).any():
                raise ValueError("too large")
            return list(values * 10)

        return run

    df = spark.range(10).selectExpr("id", "cast(id as double) as x").coalesce(1)
    rows = {r["id"]: (r["scored"], r["failed"]) for r in scoring.score(df, picky_model, "x", 4).collect()}
    assert rows[3] == (30.0, False) and rows[7] == (70.0, False) and rows[8] == (8.0, True)
    with pytest.raises(Exception, match="too large"):
        scoring.score(df, picky_model, "x", 4, on_error="raise").collect()


def test_a_model_is_built_once_per_worker_and_bad_rows_cost_few_calls(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        open(os.path.join(folder, f"built-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def run(values):
            open(os.path.join(folder, f"call-{uuid.uuid4().hex}"), "w").close()
            if (values == 77).any():
                raise ValueError("bad")
            return list(values * 2)

        return run

    df = spark.range(0, 6400, numPartitions=50).selectExpr("id", "cast(id as double) as x")
    out = scoring.score(df, make, "x", 64).collect()
    assert [r["id"] for r in out if r["failed"]] == [77] and all(r["scored"] == 2 * r["x"] for r in out if not r["failed"])
    names = [p.name for p in tmp_path.iterdir()]
    built = [n.split("-")[1] for n in names if n.startswith("built")]
    assert len(built) == len(set(built)) < 50
    # 100 batches, and one of 64 rows halved six times.
    assert sum(n.startswith("call") for n in names) <= 100 + 2 * 6


def test_a_model_must_return_a_result_per_row(spark):
    df = spark.range(4).selectExpr("cast(id as double) as x").coalesce(1)
    with pytest.raises(Exception, match="returned 1 results"):
        scoring.score(df, lambda: lambda values: [1.0], "x", 4, on_error="raise").collect()


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 100, 1000, 1023])
def test_permutation_is_a_bijection(spark, size):
    from corpuslab.functions.hashing import permuted

    df = spark.range(size).repartition(3)
    one = {r["id"]: r["position"] for r in permuted(df, "id", size, "epoch", 3).collect()}
    assert sorted(one.values()) == list(range(size)) and sorted(one) == list(range(size))
    if size >= 97:
        assert one != {r["id"]: r["position"] for r in permuted(df, "id", size, "epoch", 4).collect()}
        # Far from the identity: the mean step is about a third of the size.
        assert 0.2 * size < np.mean([abs(k - v) for k, v in one.items()]) < 0.47 * size


def test_copies_of_an_epoch_are_not_shuffled(spark):
    sample = sampling.epoch_sample(spark.range(500).withColumnRenamed("id", "k"), "k", 2.5, 3)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


@pytest.mark.parametrize("ratio,replicas", [(1, 1), (2.5, 3), (0.5, 2)])
def test_epoch_positions(spark, ratio, replicas):
    n = 23
    df = spark.range(n).repartition(5)
    rows = sampling.epoch_sample(df, "id", ratio, replicas, epoch=4).collect()
    total = math.ceil(n * ratio / replicas) * replicas
    assert sorted(r["position"] for r in rows) == list(range(total))
    uses = pd.Series([r["id"] for r in rows]).value_counts().reindex(range(n), fill_value=0)
    assert set(uses) <= {total // n, -(-total // n)}
    again = sampling.epoch_sample(df.repartition(64), "id", ratio, replicas, epoch=4, blocks=50).collect()
    assert {r["position"]: r["id"] for r in rows} == {r["position"]: r["id"] for r in again}
    batches = sampling.batch(sampling.epoch_sample(df, "id", ratio, replicas, epoch=4), 4).groupBy("rank", "batch").count()
    assert {r["count"] for r in batches.collect()} <= {4}


def test_epoch_plan_and_seed():
    assert sampling.epoch_plan(101, 5, 4, 2, 1000) == {"iters_per_epoch": 64, "total_epochs": 16}
    assert sampling.worker_seed(2, 1, 4, 10) == 19


def test_seeded_choices_do_not_depend_on_partitioning(spark):
    df = spark.range(300).withColumn("k", F.col("id").cast("string"))
    plans = [sorted(map(str, sampling.degradation_plan(sampling.split(df.repartition(p), "k"), "k").collect())) for p in (1, 7, 64)]
    assert plans[0] == plans[1] == plans[2]


def test_calibration_fallback(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 0)], "path string, ok int")
    assert [r["path"] for r in sampling.calibration_sample(df, 1, readable=F.col("ok") == 1).collect()] == ["a"]
    made = sampling.calibration_sample(df.where("ok = 2"), 5).collect()
    assert len(made) == 10 and all(-1 <= v <= 1 for v in made[3]["values"])
