"""Benchmark manifests, holdout lists and text sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..schemas import MANIFEST


def _resolve(path: Column, folder: str) -> Column:
    clean = F.nullif(F.trim(path), F.lit(""))
    return F.when(clean.startswith("/"), clean).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), clean))


def clean_manifest(df: DataFrame, folder: str) -> DataFrame:
    """Trim every field, turn blanks into nulls, resolve relative paths against ``folder``."""
    missing = sorted(set(MANIFEST.fieldNames()) - set(df.columns))
    if missing:
        raise ValueError("manifest is missing columns: " + ", ".join(missing))
    return df.select(
        F.nullif(F.trim("id"), F.lit("")).alias("id"),
        _resolve(F.col("input_path"), folder).alias("input_path"),
        _resolve(F.col("reference_path"), folder).alias("reference_path"),
        F.nullif(F.trim("category"), F.lit("")).alias("category"),
        F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
    )


def read_manifest(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Header CSV whose columns may come in any order and be joined by extra ones."""
    raw = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    return clean_manifest(raw, folder if folder is not None else path.rstrip("/").rsplit("/", 1)[0])


def write_manifest(df: DataFrame, path: str, order: str = "rank", prefix: str = "portrait") -> DataFrame:
    """Write selected items (``key``, ``category``, 1-based ``rank``) as a CSV manifest; returns the rows."""
    ext = text.suffix(F.col("key"))
    sample = F.format_string(f"{prefix}_%04d", F.col(order).cast("bigint"))
    rows = df.select(
        sample.alias("id"),
        F.concat(F.lit("inputs/"), sample, F.lit(".jpg")).alias("input_path"),
        F.concat(F.lit("references/"), sample, ext).alias("reference_path"),
        F.col("category"),
        F.lit("deterministic holdout").alias("notes"),
    )
    rows.write.mode("overwrite").csv(path, header=True)
    return rows


def write_holdout(df: DataFrame, path: str, key: str = "key") -> DataFrame:
    """Write one relative POSIX path per line."""
    lines = df.select(text.to_rel_posix(F.col(key)).alias("value"))
    lines.write.mode("overwrite").text(path)
    return lines


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    """Holdout list as a one-column table; blank lines vanish, a missing list is an error."""
    lines = spark.read.text(path)
    return lines.select(text.to_rel_posix(F.col("value")).alias("path")).where(F.col("path").isNotNull())


# Fixed format: "name.png (h,w,c) level", "name.png 1" or "name.png".
META_PATTERN = r"^(\S+?)(?:\s+\((\d+),\s*(\d+),\s*(\d+)\))?(?:\s+(\d+))?\s*$"


def parse_meta_info(df: DataFrame, line_col: str = "value") -> DataFrame:
    """All three sidecar layouts in one pass; the key is the name without its last suffix."""
    part = lambda i: F.nullif(F.regexp_extract(line_col, META_PATTERN, i), F.lit(""))
    rows = df.where(F.length(F.trim(line_col)) > 0)
    return rows.select(
        part(1).alias("name"),
        text.store_key(part(1)).alias("key"),
        part(2).cast("int").alias("h"),
        part(3).cast("int").alias("w"),
        part(4).cast("int").alias("c"),
        part(5).cast("int").alias("level"),
    )


def read_meta_info(spark: SparkSession, path: str) -> DataFrame:
    return parse_meta_info(spark.read.text(path))


def meta_info_lines(df: DataFrame) -> DataFrame:
    """``name [(h,w,c)] [level]`` lines, ordered by name."""
    shape = F.when(F.col("h").isNotNull(), F.format_string("(%d,%d,%d)", "h", "w", "c"))
    line = F.concat_ws(" ", "name", shape, F.col("level").cast("string"))
    return df.select("name", line.alias("value"))


def write_meta_info(df: DataFrame, path: str) -> None:
    """Range-partitioned and sorted, so the files read in name order form one sorted list."""
    meta_info_lines(df).orderBy("name").select("value").write.mode("overwrite").text(path)
