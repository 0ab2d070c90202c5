"""Dense positions and ranks without a single-task sort, and reliable lineage cuts.

A window without ``partitionBy`` sorts everything in one task, and one with a hot partition key
sorts that whole group in one task. Here each group is cut into blocks that follow the order key;
rows are ranked inside (group, block) and shifted by the number of rows in earlier blocks. The
result is exact wherever the block borders fall: they only decide how even the tasks are.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

#: Rows of a block, and the most blocks; their bounds are literals of a query.
BLOCK_ROWS, MAX_BLOCKS = 1_000_000, 16_384
#: The finest sketch of the bounds: one task merges those of all others, so its size must not follow the blocks.
MAX_ACCURACY = 50_000


def order_columns(order: list) -> list[Column]:
    """Sort columns of ``"name"``, ``"name desc"``, columns, or pairs of a column and ``"asc"`` or ``"desc"``."""

    def sort(o) -> Column:
        if isinstance(o, tuple):
            return o[0].desc() if o[1] == "desc" else o[0].asc()
        if isinstance(o, Column):
            return o
        return F.desc(o[:-5]) if o.endswith(" desc") else F.col(o)

    return [sort(o) for o in order]


def sort_key(first) -> tuple[Column, bool] | None:
    """Value and direction of an order entry; none for a column that is a sort order already, whose value is hidden."""
    if isinstance(first, tuple):
        return first[0], first[1] == "desc"
    if isinstance(first, Column):
        return None if re.search(r"(ASC|DESC) NULLS (FIRST|LAST)'>$", str(first)) else (first, False)
    return F.col(first.removesuffix(" desc")), first.endswith(" desc")


def default_blocks(df: DataFrame) -> int:
    """A block for every ``BLOCK_ROWS`` rows, at least as many as the session shuffles into, within a bound."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, -(-df.count() // BLOCK_ROWS)), MAX_BLOCKS)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the session names for checkpoints."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        # Local runs only; session.local_session names a folder of its own.
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/corpuslab-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()``, which runs the job a second time to save it, the rows are computed once,
    and later readers still prune columns.
    """
    path = f"{shared_folder(df.sparkSession)}/cut"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widen(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """Spread a table that arrives in fewer splits than there are cores, or than ``task_rows`` ask for."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    if task_rows:
        parts = max(parts, -(-df.count() // task_rows))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def order_bounds(df: DataFrame, column: str, blocks: int | None = None) -> list:
    """At most ``blocks - 1`` ascending cut values of a column; the only data brought to the driver."""
    blocks = blocks or default_blocks(df)
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType) or isinstance(kind, (T.DateType, T.TimestampType)):
        shares = [i / blocks for i in range(1, blocks)]
        # Sketches of many tasks are merged, which widens their error: finer than the blocks.
        row = df.agg(F.percentile_approx(column, shares, min(max(10_000, 50 * blocks), MAX_ACCURACY)).alias("cuts")).first()
        return sorted(set(row["cuts"] or []))
    minima = (
        df.select(column)
        .where(F.col(column).isNotNull())
        .repartitionByRange(blocks, column)
        .groupBy(F.spark_partition_id())
        .agg(F.min(column).alias("low"))
    )
    return sorted(row["low"] for row in minima.collect())[1:]


def block_by_bounds(column: Column, bounds: list, descending: bool = False) -> Column:
    """Block number that never decreases along ``column``, by a binary search over a literal array.

    Nulls are before all values, or after them when ``descending``, as Spark sorts them.
    """
    found = _bounds_below(column, bounds) if bounds else F.lit(0)
    placed = F.lit(len(bounds)) - found if descending else found
    return F.when(column.isNull(), F.lit(len(bounds) + 1 if descending else -1)).otherwise(placed)


def _bounds_below(column: Column, bounds: list) -> Column:
    """Number of bounds at or below the value."""
    value = F.coalesce(column, F.lit(bounds[0]))
    table = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    # Beyond the end there is no bound, which is not below.
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))


def dense_position(df: DataFrame, order: list, block: Column, group: list[str] | None = None, out: str = "position") -> DataFrame:
    """0-based rank of each row in its group, for a ``block`` that never decreases along ``order``.

    ``order`` must be unique inside a group, otherwise ties fall in any order.
    """
    group = list(group or [])
    # One struct key serves window, count and join, so the rows are shuffled once; struct equality
    # also treats null groups as equal. Generating it keeps the optimizer from copying the block
    # expression into inferred filters.
    key = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], block.alias("b"))
    keyed = df.select("*", F.explode(F.array(key)).alias("_key"))
    part = [F.col(f"_key.g{i}") for i in range(len(group))] or [F.lit(0)]
    earlier = Window.partitionBy(*part).orderBy("_key.b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_key", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_key").orderBy(*order)
    placed = keyed.withColumn("_local", F.row_number().over(inside)).join(starts, "_key")
    return placed.select(*df.columns, (F.col("_start") + F.col("_local") - 1).cast("bigint").alias(out))


def position_by(df: DataFrame, order: str, group: list[str] | None = None, out: str = "position", blocks: int | None = None) -> DataFrame:
    """:func:`dense_position` for one unique, non-hashed order column."""
    bounds = order_bounds(df, order, blocks)
    return dense_position(df, [order], block_by_bounds(F.col(order), bounds), group, out)


#: Keys that hold more than one part in so many of all rows are hot; there are fewer of them than this.
HOT_PARTS = 1024


def join_facts(rows: DataFrame, facts: DataFrame, on: Sequence[str], size: str, hot_parts: int = HOT_PARTS, task_rows: int | None = None) -> DataFrame:
    """Inner join of many rows to one written fact row per key; ``size`` is how many rows the key holds.

    Spark deals a shuffled key to one task, and does not split it where the other side is an aggregate. So the
    facts of hot keys, fewer than ``hot_parts``, are sent to all tasks and their rows stay where they are; the
    rows of all other keys are joined as Spark sees fit. Null keys meet nothing. ``rows`` are read twice.

    Spark deals out by compressed bytes, which tell little of rows of a few longs; with ``task_rows`` so many rows
    on average go to a task, or all to one.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * hot_parts > total
    named = [F.col(c).alias(f"_hot_{c}") for c in on]
    met = rows.join(F.broadcast(facts.where(hot)), list(on))
    few = F.broadcast(facts.where(hot).select(*named))
    calm = rows.join(few, reduce(and_, (F.col(c) == F.col(f"_hot_{c}") for c in on)), "left_anti")
    tasks = -(-total // task_rows) if task_rows else 1
    sides = [side.repartition(tasks, *on) if tasks > 1 else side for side in (calm, facts.where(~hot))]
    return met.unionByName(sides[0].join(sides[1], list(on)))


def group_limit_threshold(df: DataFrame) -> int:
    """Largest ``row_number() <= n`` that Spark trims before the shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
