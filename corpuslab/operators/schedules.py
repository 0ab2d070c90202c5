"""Schedules kept in tables: what is in force at an iteration, for any number of runs and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import MAX_BLOCKS, block_by_bounds, cut_lineage, order_bounds

#: Rows of both tables that are searched together in one task.
BLOCK_ROWS = 100_000


def schedule_asof(
    iters: DataFrame,
    steps: DataFrame,
    by: tuple[str, ...] = ("run",),
    on: str = "iteration",
    start: str = "from_iter",
    values: tuple[str, ...] = ("value",),
    strict: bool = False,
    defaults: dict | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``iters`` with the ``values`` of the last step of the same run that starts at or before the iteration.

    ``strict`` takes only steps that start before it (a period that is closed on the right). Rows before the
    first step, rows of a run without steps and rows without an iteration get ``defaults``, or null. Of steps
    with one start the greatest values count; steps without a start count for none. Null runs are one run.

    An as-of join of any size: both tables are put in one, cut into blocks along the iteration, and each
    (run, block) finds its last step on its own. What a block hands on to later ones is one row per (run,
    block), so a run that holds most rows is spread over all blocks, and no pair of row and step is formed.
    """
    clash = {f"_{c}" for c in ("key", "x", "side", "row", "step")} & {*iters.columns, *steps.columns}
    if clash:
        raise ValueError(f"reserved columns: {sorted(clash)}")
    group = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)])
    late = F.lit(1 if strict else -1)
    kept = steps.where(F.col(start).isNotNull()).groupBy(group.alias("_by"), F.col(start).cast("double").alias("_x")).agg(F.max(F.struct(*values)).alias("_step"))
    kind = kept.schema["_step"].dataType
    rows = iters.select(group.alias("_by"), F.col(on).cast("double").alias("_x"), F.lit(0).alias("_side"), F.struct(*iters.columns).alias("_row"), F.lit(None).cast(kind).alias("_step"))
    marks = kept.select("_by", "_x", late.alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_step")
    # The bounds read what the join reads, so it is made once.
    both = cut_lineage(rows.unionByName(marks))
    total = both.count()
    bounds = order_bounds(both, "_x", min(max(1, total // block_rows), MAX_BLOCKS)) if total else []
    keyed = both.select("*", F.explode(F.array(F.struct("_by", block_by_bounds(F.col("_x"), bounds).alias("b")))).alias("_key"))

    ends = keyed.groupBy("_key").agg(F.max(F.when(F.col("_step").isNotNull(), F.struct("_x", "_step"))).alias("e"))
    earlier = Window.partitionBy("_key._by").orderBy("_key.b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", F.last(F.col("e._step"), ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy("_key").orderBy("_x", "_side").rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.withColumn("_last", F.last("_step", ignorenulls=True).over(so_far)).where("_row is not null")
    found = local.join(carried, "_key").withColumn("_found", F.when(F.col("_x").isNotNull(), F.coalesce("_last", "_carried")))
    defaults = defaults or {}
    out = [F.when(F.col("_found").isNull(), F.lit(defaults.get(c))).otherwise(F.col(f"_found.{c}")).alias(c) for c in values]
    return found.select(*[F.col("_row")[c].alias(c) for c in iters.columns if c not in values], *out)


def multistep_steps(configs: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Step table ``by..., from_iter, value`` of multi-step schedules, one configuration a row.

    Columns of ``configs``: ``base``, ``gamma``, ``milestones`` (repeats count twice) and optionally
    ``restarts`` with ``restart_weights``. At a restart the rate is ``base`` times its weight, whatever milestone
    stands there too; at a milestone it is multiplied by ``gamma`` once for each time it is listed. The first
    step starts at the lowest iteration there is. Null lists are empty; a null base gives null values.
    """
    none = F.array().cast("array<bigint>")
    marks = F.coalesce(F.col("milestones").cast("array<bigint>"), none)
    with_restarts = {"restarts", "restart_weights"} <= set(configs.columns)
    resets = F.coalesce(F.col("restarts").cast("array<bigint>"), none) if with_restarts else none
    weights = F.coalesce(F.col("restart_weights").cast("array<double>"), F.array().cast("array<double>")) if with_restarts else F.array().cast("array<double>")
    at = F.when(F.size(resets) == F.size(weights), F.array_sort(F.array_distinct(F.concat(marks, resets)))).otherwise(F.raise_error(F.lit("restarts and their weights do not match")))
    fold = F.aggregate(
        at,
        F.struct(F.col("base").cast("double").alias("v"), F.array(F.struct(F.lit(-(2**62)).cast("bigint").alias("from_iter"), F.col("base").cast("double").alias("value"))).alias("steps")),
        lambda s, x: _step(s, x, marks, resets, weights),
    )
    return configs.select(*by, F.inline(fold["steps"]))


def _step(state: Column, at: Column, marks: Column, resets: Column, weights: Column) -> Column:
    nr = F.array_position(resets, at)
    times = F.size(F.filter(marks, lambda m: m == at))
    value = F.when(nr > 0, F.col("base").cast("double") * F.get(weights, (nr - 1).cast("int"))).otherwise(state["v"] * F.pow(F.col("gamma").cast("double"), times.cast("double")))
    return F.struct(value.alias("v"), F.concat(state["steps"], F.array(F.struct(at.alias("from_iter"), value.alias("value")))).alias("steps"))


def cosine_periods(configs: DataFrame, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """Period table ``by..., from_iter, length, weight, base, eta_min`` of cosine schedules with restarts.

    Columns of ``configs``: ``base``, ``eta_min``, ``periods`` and ``restart_weights``. The first period also
    holds at its start, so it begins one iteration early for :func:`schedule_asof` with ``strict``.
    """
    periods, weights = F.col("periods").cast("array<bigint>"), F.col("restart_weights").cast("array<double>")
    zipped = F.when(F.size(periods) == F.size(weights), F.arrays_zip(periods.alias("length"), weights.alias("weight"))).otherwise(F.raise_error(F.lit("periods and their weights do not match")))
    placed = configs.select(*by, "base", "eta_min", periods.alias("_p"), F.posexplode(zipped).alias("_nr", "_z"))
    start = F.aggregate(F.slice("_p", F.lit(1), F.col("_nr")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    begins = F.when(F.col("_nr") == 0, start - 1).otherwise(start)
    return placed.select(*by, begins.alias("from_iter"), start.alias("begins"), F.col("_z.length").alias("length"), F.col("_z.weight").alias("weight"), F.col("base").cast("double").alias("base"), F.col("eta_min").cast("double").alias("eta_min"))


def cosine_rate(iteration: Column) -> Column:
    """Rate at an iteration, from the columns of the period in force; null outside all periods."""
    angle = F.pi() * ((iteration - F.col("begins")) / F.col("length"))
    rate = F.col("eta_min") + F.col("weight") * 0.5 * (F.col("base") - F.col("eta_min")) * (1.0 + F.cos(angle))
    return F.when(iteration <= F.col("begins") + F.col("length"), rate)


def warmed_up(rate: Column, iteration: Column, base: Column, warmup: Column) -> Column:
    """Linear warm-up before the schedule takes over; a null or zero ``warmup`` is none."""
    return F.when(iteration < warmup, base / warmup * iteration).otherwise(rate)
