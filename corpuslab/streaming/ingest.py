"""Ingest of an unbounded source: skip stored items, number the rest densely, stop at the limit.

Every batch has folders of its own, named by the query and the batch: its rows, in a ledger one line with
how many they are and the highest id, and a filter of its keys. Totals come from the ledger alone. New keys
are tried against the filters; the key column is read of those batches only whose filter a new key hits, so
a batch of unknown items reads no stored rows, however many there are.

A filter is a set of Bloom filters of 4 kB each, as Spark's bitmap functions build them: a key belongs to one of
them by its hash and sets ``PROBES`` bits there. With 32 bits a key a foreign key hits once in a million.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import skip_existing
from ..operators.ordering import position_by
from ..operators.ranking import dedupe

# Hidden from readers of the rows.
LEDGER, FILTERS = "_ledger", "_filters"
#: Bits of one filter, given by Spark's bitmap functions; keys of one on average, and the bits each sets.
BITS, FILTER_KEYS, PROBES = 32768, 1024, 12
#: New keys that are tried against a filter together.
ASKED_KEYS = 4096
_PLACE = [T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]


def read_stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """What is stored so far; an empty table before the first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def _totals(stored: DataFrame) -> tuple[int, int]:
    """Stored items and the highest id, -1 when there is none."""
    held = stored.agg(F.count(F.lit(1)).alias("n"), F.max("item_id").alias("top")).first()
    return held["n"], -1 if held["top"] is None else held["top"]


def _probes(key: Column) -> Column:
    """The bits a key sets, by double hashing of its two hashes."""
    first, step = F.xxhash64(F.lit("a"), key), F.xxhash64(F.lit("b"), key).bitwiseOR(F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda k: F.pmod(F.pmod(first, F.lit(BITS)) + k * F.pmod(step, F.lit(BITS)), F.lit(BITS)).cast("int"))


def _part(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), parts).cast("int")


def key_filter(rows: DataFrame, key: str, count: int) -> DataFrame:
    """``parts, part, bits``: the filter of ``count`` keys."""
    parts = F.lit(max(1, -(-count // FILTER_KEYS)))
    bits = rows.select(parts.alias("parts"), _part(F.col(key), parts).alias("part"), F.explode(_probes(F.col(key))).alias("bit"))
    return bits.groupBy("parts", "part").agg(F.bitmap_construct_agg("bit").alias("bits"))


@F.pandas_udf(T.BooleanType())
def _any_hit(bits: pd.Series, probes: pd.Series) -> pd.Series:
    out = []
    for held, asked in zip(bits, probes):
        flags = np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little")
        out.append(bool(flags[np.stack(asked)].all(axis=1).any()))
    return pd.Series(out)


def hit_batches(fresh: DataFrame, filters: DataFrame, key: str) -> list[tuple[str, int]]:
    """``run, batch`` of the filters that a key of ``fresh`` hits; batches without such a key are left out for certain.

    Keys meet a filter as rows of some thousand keys of its part, not as pairs of key and batch.
    """
    counts = [r["parts"] for r in filters.select("parts").distinct().collect()]
    if not counts:
        return []
    size = fresh.count()
    # Large batches against small filters: the keys of a part are spread over rows.
    dealt = F.array(*[F.struct(F.lit(n).alias("parts"), F.lit(-(-size // (n * ASKED_KEYS)) or 1).alias("rows")) for n in sorted(counts)])
    sized = fresh.select(F.col(key).alias("key"), F.inline(dealt))
    group = ["parts", _part(F.col("key"), F.col("parts")).alias("part"), F.pmod(F.xxhash64(F.lit("row"), "key"), "rows").alias("row")]
    asked = sized.groupBy(*group).agg(F.collect_list(_probes(F.col("key"))).alias("asked"))
    met = filters.join(asked, ["parts", "part"]).where(_any_hit("bits", "asked"))
    return [(r["run"], r["batch"]) for r in met.select("run", "batch").distinct().collect()]


def ingest_batch(batch: DataFrame, stored: DataFrame, key: str, order: str, limit: int | None, valid: Column | None = None, prefix: str = "item", blocks: int | None = None, totals: tuple[int, int] | None = None) -> DataFrame:
    """New, valid, distinct rows of one batch with ids that continue the stored ones, up to ``limit`` in all.

    ``totals`` are the number and highest id of what is stored, counted in ``stored`` if not given.
    """
    good = batch if valid is None else batch.where(F.coalesce(valid, F.lit(False)))
    good = good.where(F.col(key).isNotNull())
    fresh = skip_existing(dedupe(good, [key], [order]), stored, key)
    held, top = totals or _totals(stored)
    placed = position_by(fresh, order, None, "_pos", blocks)
    if limit is not None:
        placed = placed.where(F.col("_pos") < max(0, limit - held))
    ident = F.lit(top + 1) + F.col("_pos")
    named = placed.withColumn("item_id", ident.cast("bigint"))
    return named.withColumn("item_name", F.format_string(f"{prefix}_%06d.png", "item_id")).drop("_pos")


def stream_ingest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    key: str,
    order: str,
    limit: int | None = None,
    valid: Column | None = None,
    prefix: str = "item",
    existing: DataFrame | None = None,
) -> StreamingQuery:
    """Drain what the source holds now into Parquet under ``path``.

    A batch writes ``run=<query id>/batch=<batch id>`` (rows, ledger line, filter, in this order) and ignores only
    that folder when it looks up what is stored, so a batch that runs again after a failure gives the same rows once, and a query with a new
    checkpoint never touches the folders of another. ``existing`` are items stored elsewhere, with ``key``
    and optionally ``item_id``: they are skipped, count toward the limit, and ids continue after theirs.
    """
    held = 0, -1
    if existing is not None:
        numbered = existing if "item_id" in existing.columns else existing.withColumn("item_id", F.lit(None).cast("bigint"))
        held = _totals(numbered)
    filter_rows = T.StructType([T.StructField("parts", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("bits", T.BinaryType()), *_PLACE])
    lines = T.StructType([T.StructField("n", T.LongType()), T.StructField("top", T.LongType()), *_PLACE])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        folder = f"run={run}/batch={batch_id}"
        other = ~((F.col("run") == run) & (F.col("batch") == batch_id))
        good = batch.where(F.col(key).isNotNull()).select(key)
        hits = hit_batches(good, read_stored(spark, f"{path}/{FILTERS}", filter_rows).where(other), key)
        # Folders are chosen by name: of all other batches nothing is read.
        folders = [f"{path}/run={r}/batch={b}" for r, b in hits]
        stored = spark.read.schema(T.StructType([stream.schema[key]])).parquet(*folders) if folders else good.limit(0)
        if existing is not None:
            stored = stored.unionByName(existing.select(key))
        done = read_stored(spark, f"{path}/{LEDGER}", lines).where(other).agg(F.sum("n").alias("n"), F.max("top").alias("top")).first()
        count, top = held[0] + (done["n"] or 0), max(held[1], -1 if done["top"] is None else done["top"])
        ingest_batch(batch, stored, key, order, limit, valid, prefix, totals=(count, top)).write.mode("overwrite").parquet(f"{path}/{folder}")
        written = spark.read.parquet(f"{path}/{folder}")
        line = written.agg(F.count(F.lit(1)).alias("n"), F.max("item_id").alias("top"))
        line.write.mode("overwrite").parquet(f"{path}/{LEDGER}/{folder}")
        key_filter(written, key, line.first()["n"]).write.mode("overwrite").parquet(f"{path}/{FILTERS}/{folder}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
