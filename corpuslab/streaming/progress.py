"""Progress events ``request, stage, progress, message, ts`` of running requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import micros
from .logs import WATERMARK

# Stages in order; progress of the last one is 1.
STAGES = ("initialization", "background", "detection", "restoration", "blending", "complete")
#: Seconds of event time after which a request that says nothing is forgotten.
SILENCE_S = 3600
#: Batches between two snapshots of the sink.
EVERY = 20
_STATE = "us long, tie long, progress double, stage string, message string, due long"


def latest_progress(events: DataFrame, request: str = "request", tie: str | None = None) -> DataFrame:
    """Latest stage, progress and message per request; works on batch tables and in update-mode streams.

    As a stream it keeps every request for ever; :func:`stream_latest` forgets those that ended.
    """
    order = F.struct("ts", *([tie] if tie else []), "progress")
    best = F.max_by(F.struct("stage", "progress", "message", "ts"), order)
    latest = events.groupBy(request).agg(best.alias("b"))
    return latest.select(request, "b.stage", _shown(F.col("b.stage"), F.col("b.progress")).alias("progress"), "b.message", "b.ts")


def _shown(stage: Column, progress: Column) -> Column:
    return F.when(stage == STAGES[-1], F.lit(1.0)).otherwise(progress)


def stage_durations(events: DataFrame, request: str = "request") -> DataFrame:
    """Seconds from the first event of a stage to the next stage's first event, per request.

    Events shrink to one row per (request, stage) before the window, so its groups hold at most as
    many rows as there are stages.
    """
    starts = events.groupBy(request, "stage").agg(F.min("ts").alias("started"))
    following = F.lead("started").over(Window.partitionBy(request).orderBy("started", "stage"))
    seconds = (micros(following) - micros(F.col("started"))) / F.lit(1e6)
    return starts.withColumn("seconds", seconds)


class _Latest(StatefulProcessor):
    """The latest event of a request, until its last stage or until it has been silent for long."""

    def __init__(self, silence_s: int):
        self.silence_ms = silence_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            found = max(zip(part["us"], part["tie"], part["progress"], part["stage"], part["message"]), key=lambda e: e[:3])
            best = found if best is None or found[:3] > best[:3] else best
        known = self.latest.get() if self.latest.exists() else None
        if known is not None:
            self.handle.deleteTimer(int(known[5]))
            if tuple(known[:3]) >= tuple(best[:3]):
                best = tuple(known[:5])
        us, tie, progress, stage, message = int(best[0]), int(best[1]), float(best[2]), best[3], best[4]
        if stage == STAGES[-1]:
            self.latest.clear()
        else:
            due = us // 1000 + self.silence_ms
            self.latest.update((us, tie, progress, stage, message, due))
            self.handle.registerTimer(due)
        yield pd.DataFrame({"request": [key[0]], "stage": [stage], "progress": [progress], "message": [message], "ts": [pd.Timestamp(us, unit="us")], "tie": [tie]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        yield pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(("request", "stage", "progress", "message", "ts", "tie"), ("object", "object", "float", "object", "datetime64[us]", "int64"))})

    def close(self) -> None:
        pass


def stream_latest(events: DataFrame, request: str = "request", tie: str | None = None, silence_s: int = SILENCE_S, watermark: str = WATERMARK) -> DataFrame:
    """Changes of the latest event per request, in update mode: ``request, stage, progress, message, ts, tie``.

    State is held for running requests only: one is forgotten when it reaches the last stage, or when the
    watermark passes its last event by ``silence_s``. An event that comes after that, but before the watermark
    drops it, starts anew; :func:`read_progress` orders changes by event, so an older one never wins. ``progress``
    is as sent; null progress counts as 0, events without time or request are dropped. Needs the RocksDB state store.
    """
    order = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    slim = events.where(F.col(request).isNotNull() & F.col("ts").isNotNull()).select(
        F.col(request).cast("string").alias("request"), F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("us"), F.coalesce(order, F.lit(0)).alias("tie"),
        F.coalesce(F.col("progress").cast("double"), F.lit(0.0)).alias("progress"), F.col("stage").cast("string").alias("stage"), F.col("message").cast("string").alias("message"),
    )
    return (
        slim.withWatermark("ts", watermark)
        .groupBy("request")
        .transformWithStateInPandas(
            statefulProcessor=_Latest(silence_s),
            outputStructType="request string, stage string, progress double, message string, ts timestamp, tie long",
            outputMode="Update",
            timeMode="EventTime",
        )
    )


def stream_progress(latest: DataFrame, path: str, checkpoint: str, every: int = EVERY) -> StreamingQuery:
    """Write the changes of :func:`stream_latest` below ``path``; a batch that runs again replaces its folder.

    Every ``every`` batches the latest change of each request becomes a snapshot, so a reader needs the last
    snapshot and fewer than ``every`` batches, however long the stream runs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        if batch_id % every == every - 1:
            _merged(batch.sparkSession, path, batch_id).write.mode("overwrite").parquet(f"{path}/snapshot/upto={batch_id}")

    return latest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _snapshot(spark: SparkSession, path: str, below: int | None) -> tuple[DataFrame | None, int]:
    try:
        stored = spark.read.parquet(f"{path}/snapshot")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return None, -1
    # Folder names only.
    upto = stored.where(F.col("upto") < below).agg(F.max("upto")).first()[0] if below is not None else stored.agg(F.max("upto")).first()[0]
    return (None, -1) if upto is None else (stored.where(F.col("upto") == upto).drop("upto"), upto)


def _merged(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """The latest change of each request up to a batch, from the last snapshot before it and the batches since."""
    snapshot, upto = _snapshot(spark, path, batch_id)
    changes = spark.read.parquet(f"{path}/changes").where(F.col("batch") > upto)
    if batch_id is not None:
        changes = changes.where(F.col("batch") <= batch_id)
    rows = changes.drop("batch") if snapshot is None else changes.drop("batch").unionByName(snapshot)
    best = F.max_by(F.struct("stage", "progress", "message", "ts", "tie"), F.struct("ts", "tie", "progress"))
    return rows.groupBy("request").agg(best.alias("b")).select("request", "b.*")


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """``request, stage, progress, message, ts``: the last state of each request that :func:`stream_progress` has written."""
    last = _merged(spark, path)
    return last.select("request", "stage", _shown(F.col("stage"), F.col("progress")).alias("progress"), "message", "ts")
