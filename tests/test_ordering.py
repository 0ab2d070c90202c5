"""Dense positions, medians and recurrences: same result for any partitioning and block count."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import aggregates, ordering, ranking


def rows(n=400, seed=1):
    r = random.Random(seed)
    # one group holds most rows
    return [(("hot" if r.random() < 0.7 else r.choice("abc")), i * 3, r.choice([0.0, 1.5, r.random()])) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "g string, k long, v double").cache()


@pytest.mark.parametrize("parts,blocks", [(1, 1), (7, 5), (64, 200)])
def test_positions_are_dense_per_group(table, parts, blocks):
    placed = ranking.position_by(table.repartition(parts), "k", ["g"], "p", blocks).collect()
    for group in {r["g"] for r in placed}:
        mine = sorted((r["k"], r["p"]) for r in placed if r["g"] == group)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_positions_by_text_key_and_null_group(spark):
    data = [(None if i % 3 else "x", f"path/{i:04d}") for i in range(90)]
    df = spark.createDataFrame(data, "g string, k string").repartition(5)
    placed = ordering.position_by(df, "k", ["g"], "p", 9).collect()
    assert len(placed) == 90
    for group in (None, "x"):
        mine = sorted((r["k"], r["p"]) for r in placed if r["g"] == group)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, k long")
    assert ordering.position_by(df, "k", ["g"]).count() == 0


def test_block_search_matches_counting(spark):
    bounds = [2, 3, 3.5, 10, 11, 40]
    df = spark.range(50).select(F.col("id").cast("double").alias("x"))
    got = df.select("x", ordering.block_by_bounds(F.col("x"), bounds).alias("b")).collect()
    assert all(r["b"] == sum(b <= r["x"] for b in bounds) for r in got)


def test_exact_median(table):
    got = {r["g"]: r["median"] for r in aggregates.exact_median(table, ["g"], "v", "k", 6).collect()}
    want: dict = {}
    for g, _, v in rows():
        want.setdefault(g, []).append(v)
    assert got == pytest.approx({g: statistics.median(v) for g, v in want.items()})


@pytest.mark.parametrize("spread", [0.002, 0.0, 0.4])
def test_median_by_selection(spark, spread):
    """Odd and even groups, ties, a null group, null values, and brackets that miss the middle."""
    r = random.Random(4)
    data = [(g, k, r.choice([r.gauss(0, 9), 5.0, 5.0, None])) for k in range(900) for g in (r.choice([None, 1, 1, 1, 2]),)]
    data += [(3, 0, 1.0), (4, 0, 1.0), (4, 1, 4.0), (5, 0, None)]
    df = spark.createDataFrame(data, "g int, k int, v double").repartition(4)
    got = {row["g"]: row["median"] for row in aggregates.exact_median(df, ["g"], "v", "k", 6, spread).collect()}
    want: dict = {}
    for g, _, v in data:
        if v is not None:
            want.setdefault(g, []).append(v)
    assert got == pytest.approx({g: statistics.median(v) for g, v in want.items()})
    assert aggregates.exact_median(df.limit(0), ["g"], "v", "k").count() == 0


def test_a_missed_bracket_is_ranked(spark, monkeypatch):
    df = spark.range(101).selectExpr("1 AS g", "id AS k", "cast(id as double) AS v")
    brackets = aggregates._bracket_counts
    wrong = lambda present, ends: brackets(present, ends.withColumn("_ends", F.array(F.lit(90.0), F.lit(95.0))))
    monkeypatch.setattr(aggregates, "_bracket_counts", wrong)
    assert [tuple(x) for x in aggregates.exact_median(df, ["g"], "v", "k").collect()] == [(1, 50.0)]


def test_median_sorts_few_values(spark):
    df = spark.range(200_000).selectExpr("id % 2 AS g", "id AS k", "sin(id) AS v")
    cut, seen = aggregates.cut_lineage, []
    aggregates.cut_lineage = lambda x: seen.append(cut(x)) or seen[-1]
    try:
        aggregates.exact_median(df, ["g"], "v", "k").collect()
    finally:
        aggregates.cut_lineage = cut
    # Of the tables written, the third holds what is sorted: the values inside the brackets.
    assert seen[0].count() == 200_000 and 0 < seen[2].count() <= 2000


@pytest.mark.parametrize("first", [("v", "desc"), "expression", "sort"])
def test_large_groups_by_column_keys(table, spark, first):
    order = [(F.col("v"), "desc"), "k"] if first == ("v", "desc") else [F.col("v") * 2, "k"] if first == "expression" else [F.col("v").desc(), "k"]
    want = {(r["g"], r["k"]) for r in ranking.take_per_group(table, ["g"], 20, order).collect()}
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5")
    try:
        assert {(r["g"], r["k"]) for r in ranking.take_per_group(table, ["g"], 20, order, 7).collect()} == want
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_linear_scan_over_tiny_blocks(spark, levels):
    x = [random.Random(5).uniform(-1, 1) * (i % 7) for i in range(300)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "s string, p long, x double").repartition(6)
    got = ranking.linear_scan(df, 0.8, ["s"], "p", "x", "y", block_rows=4, levels=levels)
    want, y = [], 0.0
    for v in x:
        y = 0.8 * y + v
        want.append(y)
    assert [r["y"] for r in got.orderBy("p").collect()] == pytest.approx(want)


def test_ema_single_row_and_start(spark):
    rows = [("a", 5, 4.0), (None, 1, 2.0), (None, 9, 6.0)]
    df = spark.createDataFrame(rows, "s string, i long, v double")
    got = {(r["s"], r["i"]): r["ema"] for r in ranking.ema(df, 0.9, ["s"], "i", "v").collect()}
    assert got == pytest.approx({("a", 5): 4.0, (None, 1): 2.0, (None, 9): 0.9 * 2 + 0.1 * 6})
    long = df.where("s IS NULL").select("s", F.explode(F.sequence(F.lit(0), F.lit(1500))).alias("i")).distinct()
    got = ranking.ema(long.withColumn("v", F.lit(3.0)), 0.5, ["s"], "i", "v").where("i > 1490").collect()
    assert len(got) == 10 and all(r["ema"] == pytest.approx(3.0) for r in got)


def test_take_per_group_trims_before_the_shuffle(table):
    plan = ranking.take_per_group(table, ["g"], 3, ["k"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_take_per_group_above_the_threshold(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id").alias("k"))
    kept = ranking.take_per_group(df, ["g"], 1200, ["k"])
    assert sorted(r["k"] for r in kept.collect()) == list(range(1200))


def test_quota_counts_stored_items(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)] + [("c", 0)], "t string, k long")
    quotas = spark.createDataFrame([("a", 4), ("b", 9)], "t string, quota int")
    stored = spark.createDataFrame([("a", 90), ("a", 91)], "t string, k long")
    got = sorted((r["t"], r["k"]) for r in ranking.take_quota(df, quotas, "t", ["k"], stored).collect())
    assert got == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2)]


@pytest.mark.parametrize("parts", [1, 9])
def test_append_ids_continue_the_highest(spark, parts):
    fresh = spark.createDataFrame([("cat", i) for i in range(20)] + [("dog", 3)], "prefix string, k long").repartition(parts)
    names = spark.createDataFrame([("cat_00041.png",), ("cat_x.png",), ("cat_7.jpg",), ("other_00900.png",)], "name string")
    got = ranking.append_ids(fresh, ranking.existing_max(names, fresh), "k").collect()
    assert sorted(r["item_id"] for r in got if r["prefix"] == "cat") == list(range(42, 62))
    assert [(r["item_id"], r["item_name"]) for r in got if r["prefix"] == "dog"] == [(0, "dog_00000.png")]


def test_dedupe_first_and_last(spark):
    df = spark.createDataFrame([("x", 2), ("x", 1), ("y", 5)], "key string, k int")
    assert sorted(ranking.dedupe(df, ["key"], ["k"]).collect()) == [("x", 1), ("y", 5)]
    assert sorted(ranking.dedupe(df, ["key"], ["k"], "last").collect()) == [("x", 2), ("y", 5)]
    with pytest.raises(ValueError):
        ranking.dedupe(df, ["key"], ["k"], "middle")


def test_checkpoint_names(spark):
    df = spark.createDataFrame(
        [("r", "e/models/net_g_500.pth", 1), ("r", "e/models/net_g_latest.pth", 2), ("r", "e/models/net_g_bad.pth", 4),
         ("r", "e/models/net_g_495.pth", 8), ("r", "e/models/net_d_490.pth", 16), ("r", "e\\states\\12.state", 32)],
        "run string, path string, bytes long",
    )
    parsed = {r["path"]: (r["folder"], r["kind"], r["net"], r["iter"]) for r in ranking.parse_checkpoints(df).collect()}
    assert parsed["e/models/net_g_500.pth"] == ("e/models", "model", "net_g", 500)
    assert parsed["e/models/net_g_latest.pth"][3] is None and parsed["e/models/net_g_bad.pth"][3] is None
    assert parsed["e\\states\\12.state"] == ("e/states", "state", None, 12)
    plan = {r["path"]: r["action"] for r in ranking.retention_plan(df).collect()}
    assert [p for p, a in plan.items() if a == "drop"] == ["e/models/net_d_490.pth"]
    best = ranking.latest_checkpoint(df).collect()[0]
    assert (best["iter"], best["path"]) == (500, "e/models/net_g_500.pth")


def test_frame_paddings(spark):
    one = spark.createDataFrame([(1, i) for i in range(6)], "clip long, frame_idx int")
    want = {"replicate": [0, 0, 0, 1, 2], "reflection": [2, 1, 0, 1, 2], "reflection_circle": [4, 3, 0, 1, 2], "circle": [3, 4, 0, 1, 2]}
    for padding, indices in want.items():
        got = ranking.neighbour_frames(one, 5, padding).where("frame_idx = 0").orderBy("slot").collect()
        assert [r["source_idx"] for r in got] == indices
    with pytest.raises(ValueError):
        ranking.neighbour_frames(one, 4)
    single = spark.createDataFrame([(1, 0, "p")], "clip long, frame_idx int, payload string")
    assert ranking.gather_frames(single, 3, "replicate").collect()[0]["window"] == ["p", "p", "p"]


def test_frames_are_dealt_by_their_number(spark, monkeypatch):
    """Frames of many clips and of a hot one go to tasks of bounded size, however few bytes they are."""
    monkeypatch.setattr(ranking, "TASK_FRAMES", 1000, raising=False)
    clip = F.when(F.col("id") < 4000, F.lit(-1).cast("long")).otherwise(F.floor(F.col("id") / 8))
    index = F.when(F.col("id") < 4000, F.col("id")).otherwise(F.col("id") % 8)
    frames = spark.range(0, 16_000, 1, 8).select(clip.alias("clip"), index.cast("int").alias("frame_idx"))
    got = ranking.neighbour_frames(frames.unionByName(spark.createDataFrame([(None, 0)], "clip long, frame_idx int")), 3, "replicate")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 48_000 and max(sizes) < 3 * 2500
    want = {(c, i, s, min(max(i + s - 1, 0), (4000 if c < 0 else 8) - 1)) for c, i in map(tuple, frames.collect()) for s in range(3)}
    assert {(r["clip"], r["frame_idx"], r["slot"], r["source_idx"]) for r in got.collect()} == want
