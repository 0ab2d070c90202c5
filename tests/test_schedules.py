"""As-of schedules against plain loops, whatever the blocks."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslab.operators import ordering, schedules, scoring


def plain_asof(iters, steps, strict):
    out = []
    for nr, run, x in iters:
        fit = [(s, v) for r, s, v in steps if r == run and s is not None and x is not None and (s < x if strict else s <= x)]
        out.append((nr, run, x, max(fit)[1] if fit else -1))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("block_rows", [100_000, 40, 7])
def test_asof_equals_plain_loops(spark, strict, block_rows):
    rng = random.Random(block_rows)
    runs = [None, 0, 0, 0, 1, 2, 3]
    iters = [(k, rng.choice(runs), rng.choice([None, *range(60)])) for k in range(300)] + [(1000, 9, 5)]
    steps = [(rng.choice([None, 0, 1, 2, 7]), rng.choice([None, *range(10, 55)]), rng.randrange(1000)) for _ in range(60)]
    left = spark.createDataFrame(iters, "nr int, run int, iteration int").repartition(5)
    right = spark.createDataFrame(steps, "run int, from_iter int, value int")
    got = schedules.schedule_asof(left, right, strict=strict, defaults={"value": -1}, block_rows=block_rows)
    assert got.columns == ["nr", "run", "iteration", "value"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_asof(iters, steps, strict)


def test_asof_of_empty_tables_and_clashing_names(spark):
    left = spark.createDataFrame([(1, 5)], "run int, iteration int")
    right = spark.createDataFrame([(1, 2, 0.5)], "run int, from_iter int, value double")
    assert schedules.schedule_asof(left.limit(0), right).collect() == []
    assert [tuple(r) for r in schedules.schedule_asof(left, right.limit(0)).collect()] == [(1, 5, None)]
    # A column of the rows that the steps bring is replaced.
    assert [tuple(r) for r in schedules.schedule_asof(left.withColumn("value", F.lit("x")), right).collect()] == [(1, 5, 0.5)]
    with pytest.raises(ValueError, match="reserved"):
        schedules.schedule_asof(left.withColumn("_step", F.lit(1)), right)


def test_a_hot_run_is_spread_over_blocks(spark):
    """Nine tenths of all rows in one run: no task of the search holds more than a few blocks' rows."""
    left = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("run"), F.col("id").alias("iteration"))
    right = spark.range(0, 20_000, 100).select(F.lit(0).alias("run"), F.col("id").alias("from_iter"), F.col("id").alias("value"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = schedules.schedule_asof(left, right, block_rows=500)
        sizes = got.groupBy(F.spark_partition_id()).agg(F.count("value").alias("n")).agg(F.max("n")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sizes < 3000
    assert got.where("run = 0 and value != iteration - iteration % 100").count() == 0


def test_no_pairs_of_rows_and_steps(spark):
    left = spark.range(100).select(F.lit(0).alias("run"), F.col("id").alias("iteration"))
    right = spark.range(100).select(F.lit(0).alias("run"), F.col("id").alias("from_iter"), F.col("id").alias("value"))
    plan = schedules.schedule_asof(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_step_tables_agree_with_the_column_form(spark):
    configs = spark.createDataFrame(
        [("a", 2.0, 0.5, [40, 80, 80, 120], [0, 100], [1.0, 0.5]), ("b", 1.0, 0.1, [], None, None), ("c", None, 0.1, [5], [], [])],
        "run string, base double, gamma double, milestones array<int>, restarts array<int>, restart_weights array<double>",
    )
    iters = spark.range(160).select(F.explode(F.array(*map(F.lit, "abc"))).alias("run"), F.col("id").alias("iteration"))
    got = schedules.schedule_asof(iters, schedules.multistep_steps(configs))
    want = scoring.schedule_value(F.col("iteration"), "multistep", 2.0, milestones=[40, 80, 80, 120], gamma=0.5, restarts=(0, 100), restart_weights=(1, 0.5))
    assert got.where("run = 'a'").where(F.abs(F.col("value") - want) > 1e-12).count() == 0
    assert {r["value"] for r in got.where("run = 'b'").collect()} == {1.0}
    assert {r["value"] for r in got.where("run = 'c'").collect()} == {None}
    bad = configs.withColumn("restart_weights", F.lit([1.0]))
    with pytest.raises(Exception, match="do not match"):
        schedules.multistep_steps(bad).collect()


def test_cosine_periods_agree_with_the_column_form(spark):
    configs = spark.createDataFrame([("a", 2.0, 0.001, [50, 30, 40], [1.0, 0.5, 0.25])], "run string, base double, eta_min double, periods array<int>, restart_weights array<double>")
    iters = spark.range(130).select(F.lit("a").alias("run"), F.col("id").alias("iteration"))
    rows = schedules.schedule_asof(iters, schedules.cosine_periods(configs), values=("begins", "length", "weight", "base", "eta_min"), strict=True)
    want = scoring.schedule_value(F.col("iteration"), "cosine", 2.0, periods=[50, 30, 40], restart_weights=(1, 0.5, 0.25), eta_min=0.001)
    got = {r["iteration"]: (r["got"], r["want"]) for r in rows.select("iteration", schedules.cosine_rate(F.col("iteration")).alias("got"), want.alias("want")).collect()}
    assert all(math.isclose(*pair) for k, pair in got.items() if k <= 120)
    assert got[121] == (None, None)
    warm = iters.select("iteration", schedules.warmed_up(F.lit(2.0), F.col("iteration"), F.lit(2.0), F.lit(4)).alias("v")).limit(6).collect()
    assert {r["iteration"]: r["v"] for r in warm} == {0: 0.0, 1: 0.5, 2: 1.0, 3: 1.5, 4: 2.0, 5: 2.0}


def test_block_of_a_value_by_binary_search(spark):
    values = [None, float("-inf"), -1.0, 0.0, 0.5, 1.0, 6.0, 7.0, 7.5, 99.0, float("nan")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    for bounds in ([], [0.0], [0.0, 1.0], [float(b) for b in range(7)], [float(b) for b in range(8)], [b / 4 for b in range(33)]):
        got = dict(df.select("k", ordering.block_by_bounds(F.col("v"), bounds).alias("b")).collect())
        assert got == {k: -1 if v is None else sum(b <= v or v != v for b in bounds) for k, v in enumerate(values)}


def test_sketch_of_bounds_does_not_grow_with_the_blocks(spark, monkeypatch):
    asked = []
    real = ordering.F.percentile_approx
    monkeypatch.setattr(ordering.F, "percentile_approx", lambda c, shares, accuracy: asked.append(accuracy) or real(c, shares, accuracy))
    assert len(ordering.order_bounds(spark.range(20_000), "id", 10_000)) > 9_000
    assert ordering.order_bounds(spark.range(100), "id", 4) == [24, 49, 74]
    assert max(asked) <= ordering.MAX_ACCURACY
