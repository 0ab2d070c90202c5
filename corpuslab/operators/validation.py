"""Manifest violations and fail-closed gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..schemas import IMAGE_SUFFIXES


def validate_manifest(df: DataFrame, strict: bool = False) -> DataFrame:
    """One row per violation: ``id, violation, row_count``.

    Row rules are checked in one pass; repeated ids come from an aggregate, so a heavily repeated
    id is never gathered. An empty manifest is the violation ``empty_manifest``. ``strict`` raises.
    """
    blank = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0
    bad_suffix = lambda c: ~blank(c) & ~text.suffix(F.trim(c)).isin(*IMAGE_SUFFIXES)
    rules = {
        "blank_id": blank("id"),
        "blank_category": blank("category"),
        "blank_input": blank("input_path"),
        "bad_input_suffix": bad_suffix("input_path"),
        "bad_reference_suffix": bad_suffix("reference_path"),
    }
    named = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda v: v.isNotNull())
    rows = (
        df.select(F.trim("id").alias("id"), F.explode(named).alias("violation"))
        .groupBy("id", "violation")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    repeated = (
        df.where(~blank("id"))
        .groupBy(F.trim("id").alias("id"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .where("row_count > 1")
        .select("id", F.lit("duplicate_id").alias("violation"), "row_count")
    )
    empty = (
        df.agg(F.count(F.lit(1)).alias("row_count"))
        .where("row_count = 0")
        .select(F.lit(None).cast("string").alias("id"), F.lit("empty_manifest").alias("violation"), "row_count")
    )
    found = rows.unionByName(repeated).unionByName(empty)
    if strict:
        first = found.limit(5).collect()
        if first:
            raise ValueError("manifest is not valid: " + ", ".join(f"{r['violation']} ({r['id']})" for r in first))
    return found


def require(df: DataFrame, predicate: Column, message: str) -> DataFrame:
    """Evaluate one aggregate predicate over ``df`` and fail unless it is true; returns ``df``."""
    if df.agg(F.coalesce(predicate, F.lit(False)).alias("ok")).first()["ok"] is not True:
        raise ValueError(message)
    return df


def require_rows(df: DataFrame, minimum: int, message: str) -> DataFrame:
    """Fail unless ``df`` has at least ``minimum`` rows; stops reading once it has counted them."""
    if df.limit(minimum).count() < minimum:
        raise ValueError(message)
    return df


def checked(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Row check that runs inside the job: the first row that breaks it fails the query."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))
