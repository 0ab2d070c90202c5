"""Training logs.

Streams use the record's own time as event time. The default watermark is ten minutes and later
records are dropped; that policy belongs to this library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import duration_seconds, micros

WATERMARK = "10 minutes"
LIVENESS_TIMEOUT_S = 180
#: Lines that one task parses: a file's split holds millions.
TASK_LINES = 100_000

# Names of the losses shown.
DASHBOARD_LOSSES = ("l_g_pix", "l_g_percep", "l_g_identity")


def parse_training_log(lines: DataFrame, line_col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """``iteration, eta, eta_s, losses`` of every line with a header and a loss tail; others are skipped.

    A line is bracketed groups of ``name: value`` fields, then pairs of a loss name with a colon and a
    number. Values hold commas of their own, but none that a space and a letter follow.
    """
    line = F.col(line_col)
    likely = lines.where(line.contains("iter:") & line.contains("eta:"))
    groups = F.split(line, "]", -1)
    inside = F.transform(F.slice(groups, 1, F.size(groups) - 1), lambda g: F.substring_index(g, "[", -1))
    fields = F.flatten(F.transform(inside, lambda g: F.split(g, ", (?=[a-z])")))
    pairs = F.filter(F.split(F.element_at(groups, -1), " "), lambda word: word != "")
    # generating the parsed row keeps the optimizer from copying its expressions into filters
    parsed = F.struct(_field(fields, "iter").alias("n"), _field(fields, "eta").alias("eta"), pairs.alias("pairs"))
    good = likely.select(*(keep or []), F.inline(F.array(parsed)))
    half = F.sequence(F.lit(0), F.size("pairs") - 2, F.lit(2))
    losses = F.transform(half, lambda k: F.struct(F.rtrim(F.get("pairs", k), F.lit(":")).alias("name"), F.get("pairs", k + 1).try_cast("double").alias("value")))
    even = (F.size("pairs") >= 2) & (F.size("pairs") % 2 == 0)
    good = good.withColumn("pairs", F.when(even & F.forall(F.sequence(F.lit(0), F.size("pairs") - 1), _alternates), losses))
    finite = F.forall("pairs", lambda p: p["value"].isNotNull() & ~F.isnan(p["value"]) & (F.abs(p["value"]) < float("inf")))
    return good.where((F.col("n") != "") & (F.col("eta") != "") & finite).select(
        *(keep or []),
        F.replace("n", F.lit(","), F.lit("")).try_cast("bigint").alias("iteration"),
        "eta",
        duration_seconds(F.col("eta")).alias("eta_s"),
        F.map_from_entries("pairs").alias("losses"),
    )


def _field(fields: Column, name: str) -> Column:
    """Value of the first field with the name, empty when there is none."""
    found = F.get(F.filter(fields, lambda f: F.ltrim(f).startswith(f"{name}:")), F.lit(0))
    return F.coalesce(F.trim(F.substring(F.ltrim(found), len(name) + 2, 2**31 - 1)), F.lit(""))


def _alternates(at: Column) -> Column:
    """Names end with a colon, numbers do not."""
    return F.get(F.col("pairs"), at).endswith(":") == (at % 2 == 0)


def dashboard_losses(parsed: DataFrame, names: tuple[str, ...] = DASHBOARD_LOSSES) -> DataFrame:
    """Fixed loss columns; lines that lack one of them are skipped."""
    others = [c for c in parsed.columns if c != "losses"]
    wide = parsed.select(*others, *[F.try_element_at("losses", F.lit(n)).alias(n) for n in names])
    return wide.dropna(subset=list(names))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_training_log(spark.read.text(path))


def stream_training_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same columns from a folder that keeps receiving log files."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return parse_training_log(reader.load(path))


def run_liveness(records: DataFrame, now, timeout_s: int = LIVENESS_TIMEOUT_S, run: str = "run", ts: str = "ts") -> DataFrame:
    """``running`` or ``paused`` per run against a given clock."""
    last = records.groupBy(run).agg(F.max(ts).alias("last_ts"))
    age = (micros(F.lit(now)) - micros(F.col("last_ts"))) / F.lit(1e6)
    return last.select(run, "last_ts", F.when(age < timeout_s, "running").otherwise("paused").alias("status"))


class _Liveness(StatefulProcessor):
    """Last record time per run, with a timer that reports silence."""

    def __init__(self, timeout_s: int):
        self.timeout_ms = timeout_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(part["ts_ms"].max()) for part in rows)
        known = self.last.get() if self.last.exists() else None
        if known is not None:
            newest = max(newest, int(known[0]))
            self.handle.deleteTimer(int(known[1]))
        due = newest + self.timeout_ms
        self.last.update((newest, due))
        self.handle.registerTimer(due)
        yield self._row(key, newest, "running")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            newest = int(self.last.get()[0])
            self.last.clear()
            yield self._row(key, newest, "paused")

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, ms: int, status: str) -> pd.DataFrame:
        return pd.DataFrame({"run": [key[0]], "last_ts": [pd.Timestamp(ms, unit="ms")], "status": [status]})


def stream_liveness(records: DataFrame, timeout_s: int = LIVENESS_TIMEOUT_S, run: str = "run", ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Status changes per run; needs the RocksDB state store provider.

    Event-time timers fire when the watermark passes ``last record + timeout``.
    """
    slim = records.select(F.col(run).cast("string").alias("run"), F.col(ts).cast("timestamp").alias("ts"), F.floor(micros(F.col(ts)) / 1000).alias("ts_ms"))
    return (
        slim.withWatermark("ts", watermark)
        .groupBy("run")
        .transformWithStateInPandas(
            statefulProcessor=_Liveness(timeout_s),
            outputStructType="run string, last_ts timestamp, status string",
            outputMode="Update",
            timeMode="EventTime",
        )
    )
