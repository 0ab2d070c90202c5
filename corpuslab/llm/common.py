"""Shared pieces: reading tables, written intermediates, small null-safe helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.ordering import join_facts, shared_folder  # noqa: F401

#: The white space of all word definitions here; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read back: computed once, safe against lost executors."""
    path = f"{shared_folder(df.sparkSession)}/saved"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that may be sent to all tasks: tens of megabytes.
FEW_KEYS = 1 << 19


def met(rows: DataFrame, keys: DataFrame, on: Sequence[Column], how: str) -> DataFrame:
    """The semi or anti join ``how`` of wide ``rows`` with written distinct ``keys``; ``on`` has a column of ``rows`` for each of ``keys``.

    Spark sends keys to all tasks by their bytes, and else shuffles the rows, texts and all. Here their number decides:
    rows stay where they are for up to ``FEW_KEYS``, and beyond they are shuffled once. Null keys are equal.
    """
    few = keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS
    equal = reduce(and_, (same(own, keys[name]) for own, name in zip(on, keys.columns, strict=True)))
    return rows.join(F.broadcast(keys) if few else keys, equal, how)


def text_of(column: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
