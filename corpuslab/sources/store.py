"""Packed key-to-bytes store: Parquet in hash buckets, so that a lookup reads the buckets of its keys only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STORE_COLUMNS = ("key", "payload", "h", "w", "c", "level")
#: Rows of a bucket when the store chooses their number, and the most buckets there are.
BUCKET_ROWS, MAX_BUCKETS = 10_000, 4096
#: Partition columns: the number of buckets is part of the path, so a reader needs nothing else.
OF, BUCKET = "of_buckets", "bucket"


def bucket_of(key: Column, buckets: Column | int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def duplicate_keys(df: DataFrame, key: str = "key") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def write_packed(df: DataFrame, path: str, buckets: int | None = None) -> None:
    """Write ``key, payload[, h, w, c, level]``; repeated or null keys are refused before anything is written.

    The number of buckets follows the number of rows if it is not given. Keys of a bucket are sorted, so row
    groups can be skipped inside it; a bucket of more than ``BUCKET_ROWS`` rows is written by several tasks.
    """
    bad = duplicate_keys(df.select("key")).unionByName(
        df.where(F.col("key").isNull()).select("key", F.lit(1).cast("bigint").alias("copies"))
    )
    first = bad.limit(1).collect()
    if first:
        raise ValueError(f"store keys must be unique and not null: {first[0]['key']!r}")
    rows = df.select("key").count()
    buckets = buckets or min(max(1, -(-rows // BUCKET_ROWS)), MAX_BUCKETS)
    parts = max(1, -(-rows // (buckets * BUCKET_ROWS)))
    columns = [F.col(c) if c in df.columns else F.lit(None).cast("int").alias(c) for c in STORE_COLUMNS]
    shaped = df.select(*columns, F.lit(buckets).alias(OF), bucket_of(F.col("key"), buckets).alias(BUCKET))
    # A bucket's rows go to as many tasks as it has parts: the part is a range of another hash.
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("key")), F.lit(parts))
    dealt = shaped.repartition(min(buckets * parts, MAX_BUCKETS), BUCKET, part)
    dealt.sortWithinPartitions(BUCKET, "key").write.mode("overwrite").partitionBy(OF, BUCKET).parquet(path)


def read_store(spark: SparkSession, path: str, keys: DataFrame, key: str = "key") -> DataFrame:
    """Payloads of the given keys; null and unknown keys find nothing, repeated ones count once.

    The buckets of the keys prune the folders that are scanned, at run time: there are ``MAX_BUCKETS`` of them
    at most, so they can always be sent to all tasks, however many keys there are. The keys themselves are
    joined in any size.
    """
    store = spark.read.parquet(path)
    of = store.select(OF).first()
    if of is None:
        return store.select(*STORE_COLUMNS)
    placed = keys.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).select("key", bucket_of(F.col("key"), of[OF]).alias(BUCKET))
    wanted = placed.where(F.col(BUCKET) >= 0).select(BUCKET).distinct()
    met = store.join(F.broadcast(wanted), BUCKET, "left_semi").select(*STORE_COLUMNS)
    return select_keys(met, placed)


def select_keys(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return store.join(keys.select(F.col(key).alias("key")), "key", "left_semi")
