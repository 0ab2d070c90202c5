"""Streams drain to the same result as the batch form."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from corpuslab.operators.ordering import widen
from corpuslab.streaming import ingest, logs, progress

LINES = [
    "2026-07-08 INFO: [train..][epoch:  3, iter:   1,234, lr:(5.000e-05,)] [eta: 1 day, 2:03:04, time (data): 52.250 (0.010)] l_g_pix: 9.5400e-02 l_g_percep: 3.1090e-01 l_g_identity: 2.1050e-01 ",
    "INFO: [train..][epoch:  3, iter:   1,235, lr:(5.000e-05,)] [eta: 0:00:09, time (data): 52.250 (0.010)] l_g_pix: 1.0000e+00 l_d_real: -3.0e-01 ",
    "INFO: [train..][epoch:  3, iter:   1,236, lr:(5.000e-05,)] [eta: 0:00:09, time (data): 52.250 (0.010)] ",
    "INFO: Saving models and training states.",
    "",
]


def drain(df, name, mode="append", **options):
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = writer.start()
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None
    return df.sparkSession.table(name)


def test_log_batch_and_stream(spark, tmp_path):
    (tmp_path / "train_1.log").write_text("\n".join(LINES[:2]))
    (tmp_path / "train_2.log").write_text("\n".join(LINES[2:]))
    batch = logs.read_training_log(spark, str(tmp_path)).orderBy("iteration").collect()
    assert [(r["iteration"], r["eta"], r["eta_s"]) for r in batch] == [(1234, "1 day, 2:03:04", 93784), (1235, "0:00:09", 9)]
    assert batch[1]["losses"] == {"l_g_pix": 1.0, "l_d_real": -0.3}
    assert [r["iteration"] for r in logs.dashboard_losses(logs.read_training_log(spark, str(tmp_path))).collect()] == [1234]
    out = drain(logs.stream_training_log(spark, str(tmp_path), max_files=1), "log_stream").orderBy("iteration").collect()
    assert out == batch


def test_progress_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(r, s, p, f"{s} {p}", t0 + dt.timedelta(seconds=k)) for r in (1, 2) for k, (s, p) in enumerate([("detection", 0.2), ("restoration", 0.5), ("complete", 0.9)][: 4 - r])]
    df = spark.createDataFrame(rows, "request long, stage string, progress double, message string, ts timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    batch = sorted(map(tuple, progress.latest_progress(df).collect()))
    assert [(b[0], b[1], b[2]) for b in batch] == [(1, "complete", 1.0), (2, "restoration", 0.5)]
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "e"))
    assert sorted(map(tuple, drain(progress.latest_progress(stream), "progress_stream", "complete").collect())) == batch
    seconds = {(r["request"], r["stage"]): r["seconds"] for r in progress.stage_durations(df).collect()}
    assert seconds[(1, "detection")] == 1.0 and seconds[(1, "complete")] is None


def test_liveness_batch(spark):
    now = dt.datetime(2026, 1, 1, 0, 10)
    df = spark.createDataFrame([("a", now - dt.timedelta(seconds=179)), ("b", now - dt.timedelta(seconds=180)), ("a", now - dt.timedelta(hours=2))], "run string, ts timestamp")
    assert {r["run"]: r["status"] for r in logs.run_liveness(df, now).collect()} == {"a": "running", "b": "paused"}


def test_liveness_stream_reports_silence(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    schema = "run string, ts timestamp"
    parts = [[("a", t0), ("b", t0)], [("a", t0 + dt.timedelta(minutes=30))], [("a", t0 + dt.timedelta(minutes=31))]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    out = drain(logs.stream_liveness(stream, 180), "liveness_stream", "update").collect()
    assert ("b", "paused") in {(r["run"], r["status"]) for r in out}
    assert ("a", "running") in {(r["run"], r["status"]) for r in out}


def test_ingest_drains_in_batches_and_resumes(spark, tmp_path):
    schema = "key string, n long"
    src, out, chk = (str(tmp_path / p) for p in ("src", "out", "chk"))
    spark.createDataFrame([(f"k{i % 7}", i) for i in range(10)], schema).coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    ingest.stream_ingest(read(), out, chk, "key", "n", limit=12, valid=F.col("n") != 3).awaitTermination(120)
    first = sorted((r["item_id"], r["key"]) for r in spark.read.parquet(out).collect())
    assert [i for i, _ in first] == list(range(6)) and "k3" not in {k for _, k in first}
    spark.createDataFrame([(f"k{i}", 100 + i) for i in range(30)], schema).coalesce(1).write.mode("append").parquet(src)
    ingest.stream_ingest(read(), out, chk, "key", "n", limit=12, valid=F.col("n") != 3).awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert sorted(r["item_id"] for r in rows) == list(range(12))
    assert len({r["key"] for r in rows}) == 12
    ingest.stream_ingest(read(), out, chk, "key", "n", limit=12).awaitTermination(120)
    assert spark.read.parquet(out).count() == 12


EVENT = "request long, stage string, progress double, message string, ts timestamp, nr long"


def _events(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_progress_state_is_bounded_and_the_result_equals_batch(spark, tmp_path):
    """Every batch brings 40 requests: 30 end, 5 fall silent, 5 go on for ever. State holds the last ones only."""
    t0, parts, nr = dt.datetime(2026, 1, 1), [], 0
    for k in range(12):
        part = []
        for j in range(40):
            for stage, share in (("detection", 0.3), ("restoration", 0.6)) + ((("complete", 0.9),) if j < 30 else ()):
                nr += 1
                part.append((k * 100 + j, stage, share, f"{stage} {nr}", t0 + dt.timedelta(hours=k, seconds=nr % 50), nr))
        part += [(9000 + j, "blending", 0.1 * j, f"again {k}", t0 + dt.timedelta(hours=k, minutes=1), nr) for j in range(5)]
        parts.append(part)
    stream = _events(spark, tmp_path / "in", parts)
    out = str(tmp_path / "out")
    query = progress.stream_progress(progress.stream_latest(stream, tie="nr", silence_s=1800, watermark="0 seconds"), out, str(tmp_path / "chk"), every=5)
    query.awaitTermination(300)
    assert query.exception() is None
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 12 and max(held) <= 60
    batch = progress.latest_progress(spark.read.schema(EVENT).parquet(str(tmp_path / "in")), tie="nr")
    got = sorted((int(r["request"]), *tuple(r)[1:]) for r in progress.read_progress(spark, out).collect())
    assert got == sorted(map(tuple, batch.collect())) and len(got) == 12 * 40 + 5


def test_progress_reader_needs_the_last_snapshot_only(spark, tmp_path):
    parts = [[(k, "detection", 0.1, f"m{k}", dt.datetime(2026, 1, 1, 0, k), k)] for k in range(7)]
    stream = _events(spark, tmp_path / "in", parts)
    out = str(tmp_path / "out")
    progress.stream_progress(progress.stream_latest(stream, tie="nr"), out, str(tmp_path / "chk"), every=3).awaitTermination(300)
    files = progress.read_progress(spark, out).inputFiles()
    assert {f.split("upto=")[1].split("/")[0] for f in files if "upto=" in f} <= {"2", "5"}
    rows = progress._merged(spark, out)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "(batch#" in plan and "> 5)" in plan and "= 5)" in plan
    assert rows.count() == 7


def test_ingest_reads_stored_keys_only_where_a_filter_hits(spark, tmp_path, monkeypatch):
    schema = "key string, n long"
    src, out, chk = (str(tmp_path / p) for p in ("src", "out", "chk"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    seen, hits = [], ingest.hit_batches
    monkeypatch.setattr(ingest, "hit_batches", lambda *a: seen.append(hits(*a)) or seen[-1])
    for k in range(8):
        rows = [(f"k{k}-{i}", 1000 * k + i) for i in range(300)]
        if k == 6:
            rows += [(f"k2-{i}", 7000 + i) for i in range(5)] + [(f"k4-{i}", 8000 + i) for i in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        ingest.stream_ingest(read(), out, chk, "key", "n").awaitTermination(120)
    assert [sorted(b for _, b in found) for found in seen] == [[], [], [], [], [], [], [2, 4], []]
    stored = spark.read.parquet(out).collect()
    assert len(stored) == len({r["key"] for r in stored}) == 2400 and sorted(r["item_id"] for r in stored) == list(range(2400))


def test_key_filters_miss_no_key_and_hit_few_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    filters = ingest.key_filter(keys, "key", 5000).withColumns({"run": F.lit("r"), "batch": F.lit(1).cast("long")})
    assert filters.count() == 5 and filters.agg(F.max(F.octet_length("bits"))).first()[0] == 4096
    assert ingest.hit_batches(keys.where("key = 'k77'"), filters, "key") == [("r", 1)]
    assert ingest.hit_batches(keys.limit(0), filters, "key") == []
    small = ingest.key_filter(keys.limit(3), "key", 3).withColumns({"run": F.lit("s"), "batch": F.lit(2).cast("long")})
    foreign = spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("key"))
    assert ingest.hit_batches(foreign, filters.unionByName(small), "key") == []
    assert sorted(ingest.hit_batches(keys, filters.unionByName(small), "key")) == [("r", 1), ("s", 2)]


def test_ingest_replays_a_batch_whose_filter_was_not_written(spark, tmp_path):
    """A batch that failed after its rows were written runs again and gives the same rows once."""
    import shutil

    schema = "key string, n long"
    src, out, chk = (str(tmp_path / p) for p in ("src", "out", "chk"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    spark.createDataFrame([(f"k{i}", i) for i in range(20)], schema).coalesce(1).write.parquet(src)
    ingest.stream_ingest(read(), out, chk, "key", "n").awaitTermination(120)
    before = sorted(map(tuple, spark.read.parquet(out).collect()))
    commit = tmp_path / "chk" / "commits" / "0"
    commit.unlink()
    (tmp_path / "chk" / "commits" / ".0.crc").unlink(missing_ok=True)
    for folder in (tmp_path / "out" / "_filters",):
        shutil.move(str(folder), str(tmp_path / "moved"))
    ingest.stream_ingest(read(), out, chk, "key", "n").awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == before
    assert spark.read.parquet(f"{out}/_filters").count() == 1


def test_lines_are_spread_by_their_number(spark):
    few = spark.range(0, 1000, numPartitions=8)
    assert widen(few).rdd.getNumPartitions() == 8
    wide = widen(few, 50)
    assert wide.rdd.getNumPartitions() == 20 and sorted(r["id"] for r in wide.collect()) == list(range(1000))
    assert widen(few, 500).rdd.getNumPartitions() == 8
