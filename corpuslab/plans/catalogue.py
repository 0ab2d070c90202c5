"""Every operator applied to the driver tables: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import geometry, text
from ..functions.hashing import uniform
from ..operators import aggregates, boxes, joins, metrics, pixels, projections, ranking, sampling, schedules, scoring, validation
from ..operators.ordering import cut_lineage, widen
from ..schemas import CLASS_WEIGHTS, PRESETS
from ..sources import files, manifest as manifests, store, web
from ..streaming import ingest, logs, progress
from . import corpus, tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(column: Column | str, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def _known(df: DataFrame, **fill) -> DataFrame:
    """Whole numbers and flags without nulls, so that both sides of a comparison keep their types."""
    return df.fillna(fill)


def exact_avg(column: str) -> Column:
    """Mean of a two-decimal column from whole hundredths: the same double on both sides."""
    return F.sum(F.round(F.col(column) * 100).cast("bigint")) / F.count(column) / F.lit(100.0)


# --- composed -----------------------------------------------------------------


@query
def holdout_report(spark, sf):
    return corpus.holdout_report(t.listing(spark, sf), 50)


@query
def curate(spark, sf):
    base = t.listing(spark, sf)
    labels = t.table(spark, sf, "labels")
    measures = base.select(
        "rel_path",
        (F.col("doc_id") % 4).alias("faces"),
        (F.col("doc_id") % 100 / 100).alias("coverage"),
        (F.col("bytes") % 300).cast("double").alias("sharpness"),
    )
    stored = base.join(labels, "doc_id", "left_semi").select("rel_path")
    return corpus.curate(base, measures, stored, 10).select("rel_path", "category", "reason", "bytes")


@query
def training_plan(spark, sf):
    base = t.listing(spark, sf).select("rel_path", "category")
    holdout = cut_lineage(sampling.select_holdout(base, "rel_path", 50))
    plan = corpus.training_plan(base, holdout, "rel_path", replicas=2, batch_size=8, ratio=1.5, epoch=3)
    return plan.select("rel_path", "rank", "rank_pos", "batch", "flip", "small_kernel", r("large_scale").alias("large_scale"))


# --- sources ------------------------------------------------------------------


@query
def read_first_available(spark, sf):
    df, uri = files.read_first_available(spark, [f"{sf}/absent.parquet", f"{sf}/documents.parquet"])
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("items")).withColumn("used", text.basename(F.lit(uri)))


@query
def extract_payload(spark, sf):
    raw = t.table(spark, sf, "documents").select("doc_id", F.struct(F.encode("text", "UTF-8").alias("bytes"), F.col("lang").alias("path")).alias("image"))
    out = files.extract_payload(raw, files.detect_payload_column(raw))
    return out.select("doc_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))


@query
def parse_posts(spark, sf):
    e = t.table(spark, sf, "events")
    body = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.concat(F.lit('[{"id":'), F.col("event_id").cast("string"), F.lit(',"file_url":"\\/img\\/'), "event_type", F.lit('.png","meta":'), "props", F.lit("},{\"id\":null}]"))
    )
    return web.parse_posts(e.select("user_id", body.alias("json")), "json", ["user_id"])


@query
def clean_manifest(spark, sf):
    return manifests.clean_manifest(t.manifest(spark, sf), "/data/benchmark")


@query
def extract_links(spark, sf):
    return web.extract_links(t.table(spark, sf, "pages"), "html", "page_id", "href").select("page_id", "pos", "link")


@query
def extract_links_limited(spark, sf):
    pages = t.table(spark, sf, "pages").withColumn("host", F.regexp_extract("url", "//([^/]+)/", 1))
    return web.extract_links(pages, "html", "page_id", "href", limit=5, group="host").select("host", "link", "page_id", "pos")


def _sidecar(spark, sf) -> DataFrame:
    n = F.col("doc_id")
    line = (
        F.when(n % 3 == 0, F.format_string("%s (%d,%d,3) %d", "name", "h", "w", n % 10))
        .when(n % 3 == 1, F.concat("name", F.lit(" 1")))
        .otherwise(F.col("name"))
    )
    return t.listing(spark, sf).select(line.alias("value"))


@query
def read_meta_info(spark, sf):
    path = t.scratch(spark, "sidecar")
    _sidecar(spark, sf).write.text(path)
    return _known(manifests.read_meta_info(spark, path), h=-1, w=-1, c=-1, level=-1)


@query
def write_meta_info(spark, sf):
    """Written, and read back as lines."""
    path = t.scratch(spark, "meta")
    manifests.write_meta_info(manifests.parse_meta_info(_sidecar(spark, sf)), path)
    lines = spark.read.text(path)
    return lines.select(F.regexp_extract("value", r"^(\S+)", 1).alias("name"), "value")


def _packed(spark, sf) -> DataFrame:
    return t.listing(spark, sf, text=True).select(
        text.store_key(F.col("name")).alias("key"), F.encode("text", "UTF-8").alias("payload"), "h", "w"
    )


@query
def read_store(spark, sf):
    """Keys of the labelled documents, each twice, and some that the store does not hold."""
    path = t.scratch(spark, "store")
    store.write_packed(_packed(spark, sf), path, 64)
    ids = t.table(spark, sf, "labels").select("doc_id")
    wanted = ids.unionByName(ids).unionByName(ids.select((-F.col("doc_id") - 1).alias("doc_id")))
    found = store.read_store(spark, path, wanted.select(F.col("doc_id").cast("string").alias("key")))
    return found.select("key", F.octet_length("payload").cast("bigint").alias("payload_bytes"), "h", "w")


@query
def write_packed(spark, sf):
    path = t.scratch(spark, "store")
    store.write_packed(_packed(spark, sf), path)
    wanted = t.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("key"))
    return store.read_store(spark, path, wanted).select("key", F.sha2("payload", 256).alias("digest"), "h", "w")


@query
def write_manifest(spark, sf):
    held = _holdout(spark, sf)
    # the holdout has n rows, whatever the corpus size
    ranked = held.select("category", F.col("rel_path").alias("key"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("order_key")).alias("rank"))
    path = t.scratch(spark, "manifest")
    manifests.write_manifest(ranked, path)
    return manifests.read_manifest(spark, path, "/bench")


@query
def write_holdout(spark, sf):
    path = t.scratch(spark, "holdout")
    manifests.write_holdout(_holdout(spark, sf), path, "rel_path")
    return manifests.read_holdout(spark, path)


@query
def read_listing(spark, sf):
    """A tree of one file per document: nested folders, hidden names, names with ``_`` and ``=``, empty files."""
    root = files.qualified(spark, t.scratch(spark, "tree"))
    t.write_tree(t.tree(spark, sf), root)
    listing = files.read_listing(spark, root, [".png", ".txt", ".webp"], recursive=True)
    inside = F.substring("path", len(root) + 2, 2**31 - 1)
    return listing.select(inside.alias("path"), "rel_path", "category", "name", "ext", "bytes", F.col("mtime").isNotNull().alias("timed"))


# --- projections --------------------------------------------------------------


@query
def normalise_url(spark, sf):
    p, n = t.table(spark, sf, "pages"), F.col("page_id") % 5
    bare = F.regexp_replace("url", "^https?://", "")
    raw = (
        F.when(n == 0, F.concat(F.lit("//"), bare)).when(n == 1, F.concat(F.lit("/"), bare)).when(n == 2, bare)
        .when(n == 3, F.replace("url", F.lit("/"), F.lit("\\/"))).otherwise(F.col("url"))
    )
    return p.select("page_id", text.normalise_url(raw, "img.example.org").alias("url"))


@query
def filter_name(spark, sf):
    named = t.listing(spark, sf).withColumn("name", F.when(F.col("doc_id") % 6 == 0, F.upper("name")).when(F.col("doc_id") % 11 == 0, F.concat(F.lit(".h_"), "name")).when(F.col("doc_id") % 13 == 0, F.lit("noext")).otherwise(F.col("name")))
    return projections.filter_name(named, "name", deny_contains=("77",)).select("doc_id", "name")


@query
def filter_size(spark, sf):
    sized = t.listing(spark, sf).withColumn("bytes", F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.col("bytes")))
    return _known(projections.filter_size(sized, 4000, 200_000).select("doc_id", "bytes", "w", "h"), bytes=-1)


@query
def filter_resolution(spark, sf):
    return projections.filter_resolution(t.listing(spark, sf)).select("doc_id", "w", "h")


@query
def filter_coverage(spark, sf):
    out = projections.filter_coverage(t.detections(spark, sf), t.images(spark, sf), 0.05)
    return out.select("img", "det_idx", r("coverage").alias("coverage"))


@query
def filter_detections(spark, sf):
    return projections.filter_detections(t.detections(spark, sf), 0.8, 5.0).select("img", "det_idx", r("score").alias("score"))


@query
def to_rel_posix(spark, sf):
    raw = t.listing(spark, sf).select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" C:\\data\\"), F.replace("rel_path", F.lit("/"), F.lit("\\")), F.lit(" "))).alias("raw"))
    out = raw.select("doc_id", text.to_rel_posix(F.col("raw"), "C:/data").alias("path"))
    return out.where(F.col("path").isNotNull())


@query
def store_key(spark, sf):
    name = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("v1.2 ü_"), "name")).when(F.col("doc_id") % 8 == 1, F.lit("._.png")).otherwise(F.concat(F.lit("dir\\"), "name"))
    raw = t.listing(spark, sf).select("doc_id", name.alias("raw"))
    return raw.select("doc_id", text.store_key(F.col("raw")).alias("key"), text.safe_filename(F.col("raw")).alias("safe_name"))


def _judged(spark, sf) -> DataFrame:
    n = F.col("doc_id")
    seen = t.listing(spark, sf).select(
        "doc_id", "category",
        F.when(n % 23 == 0, F.lit(None)).otherwise(F.col("w")).alias("w"), "h",
        (n % 4).alias("faces"), (n % 100 / 100).alias("coverage"), (F.col("bytes") % 300).cast("double").alias("sharpness"),
    )
    return projections.reject_reason(seen)


@query
def reject_reason(spark, sf):
    return _judged(spark, sf).select("doc_id", "reason")


@query
def box_convert(spark, sf):
    n = F.col("det_idx")
    d = t.detections(spark, sf).select("img", "det_idx", "x1", "y1", "x2", "y2").withColumns(
        {"pcx": (n % 8 * 64 + 32).cast("double"), "pcy": (n % 6 * 64 + 32).cast("double"), "pw": (32 + n % 5 * 16).cast("double"), "ph": (32 + n % 3 * 24).cast("double")}
    )
    out = projections.box_convert(projections.box_convert(d, "xyxy", "offset"), "xyxy", "xywh")
    back = projections.box_convert(out.drop("x1", "y1", "x2", "y2"), "offset", "xyxy")
    return back.select("img", "det_idx", *[r(c).alias(c) for c in ("dx", "dy", "dw", "dh", "cx", "cy", "w", "h", "x1", "y1", "x2", "y2")])


@query
def box_fit(spark, sf):
    corners = ("x1", "y1", "x2", "y2")
    d = t.detections(spark, sf)
    d = d.select("*", *[F.col(c).alias(f"raw_{c}") for c in corners])
    fitted = projections.box_fit(d, net_size=(320, 320)).withColumnsRenamed({c: f"fit_{c}" for c in corners})
    grown = projections.box_fit(fitted.withColumnsRenamed({f"raw_{c}": c for c in corners}), grow=0.15)
    return grown.select("img", "det_idx", *[r(f"fit_{c}").alias(c) for c in corners], *[F.col(c).alias(f"grown_{c}") for c in corners])


@query
def to_luma(spark, sf):
    both = pixels.to_luma(t.planes(spark, sf), ["bt601", "gray"])
    flat = both.select("img", F.posexplode(F.arrays_zip("bt601", "gray")).alias("pos", "v"))
    return flat.select("img", "pos", r("v.bt601").alias("bt601"), r("v.gray").alias("gray"))


@query
def melt_metrics(spark, sf):
    s = t.table(spark, sf, "lineitem").groupBy("l_partkey").agg(*[r(exact_avg(c), 8).alias(n) for c, n in (("l_quantity", "qty"), ("l_discount", "disc"), ("l_tax", "tax"))])
    return projections.melt_metrics(s.withColumnRenamed("l_partkey", "iteration"), ["qty", "disc", "tax"])


@query
def rescale_planes(spark, sf):
    p = pixels.rescale_planes(t.planes(spark, sf), [0.5, 0.4, 0.3], [0.5, 0.25, 0.2], swap=True)
    back = pixels.rescale_planes(p.withColumn("scaled", F.col("plane")), [0.5, 0.4, 0.3], [0.5, 0.25, 0.2], inverse=True)
    flat = back.select("img", "ch", F.posexplode(F.arrays_zip("scaled", "plane")).alias("pos", "z"))
    return flat.select("img", "ch", "pos", r("z.scaled").alias("v"), (F.col("z.plane") + 0.0).alias("back"))


# --- joins --------------------------------------------------------------------


@query
def skip_existing(spark, sf):
    return joins.skip_existing(t.listing(spark, sf).select("doc_id", "rel_path"), t.table(spark, sf, "labels"), "doc_id")


def _holdout(spark, sf) -> DataFrame:
    return sampling.select_holdout(t.listing(spark, sf), "rel_path", 50)


@query
def exclude_holdout(spark, sf):
    train = t.listing(spark, sf).select("doc_id", F.concat(F.lit("C:\\corpus\\"), F.replace("rel_path", F.lit("/"), F.lit("\\"))).alias("path"))
    return joins.exclude_holdout(train, _holdout(spark, sf), "path", "rel_path", root="C:/corpus").select("doc_id")


@query
def exclusion_report(spark, sf):
    return joins.exclusion_report(t.listing(spark, sf), _holdout(spark, sf), "rel_path", "rel_path")


@query
def audit_leakage(spark, sf):
    base = t.listing(spark, sf)
    held = _holdout(spark, sf)
    clean = joins.audit_leakage(joins.exclude_holdout(base, held, "rel_path", "rel_path"), held, "rel_path", "rel_path")
    dirty = joins.audit_leakage(base, held, "rel_path", "rel_path")
    return clean.withColumn("case", F.lit("clean")).unionByName(dirty.withColumn("case", F.lit("dirty")))


@query
def pair_lq_gt(spark, sf):
    base = t.listing(spark, sf)
    gt = base.where("ext <> '.txt'").select(F.concat(F.lit("gt/"), "name").alias("path"))
    lq = base.where("ext <> '.bmp'").select(F.concat(F.lit("lq/"), text.store_key(F.col("name")), F.lit("_x2"), "ext").alias("path"))
    return joins.pair_lq_gt(lq, gt, "{}_x2")


@query
def compare_key_sets(spark, sf):
    docs, labels = t.table(spark, sf, "documents"), t.table(spark, sf, "labels")
    a = docs.select(F.md5("text").alias("key"))
    b = docs.join(labels, "doc_id", "left_semi").select(F.md5(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))).alias("key"))
    return joins.compare_key_sets(a, b, "key")


def _manifest_listing(spark, sf) -> DataFrame:
    n = F.col("doc_id")
    paths = F.array(
        F.when(n % 9 != 0, F.concat(F.lit("/data/inputs/"), n.cast("string"), F.lit(".jpg"))),
        F.when(n % 4 != 0, F.concat(F.lit("/data/references/"), n.cast("string"), F.lit(".PNG"))),
    )
    return t.table(spark, sf, "documents").select(F.explode(paths).alias("path")).where(F.col("path").isNotNull())


@query
def check_files(spark, sf):
    return joins.check_files(manifests.clean_manifest(t.manifest(spark, sf), "/data"), _manifest_listing(spark, sf))


@query
def file_counts(spark, sf):
    return joins.file_counts(manifests.clean_manifest(t.manifest(spark, sf), "/data"), _manifest_listing(spark, sf))


@query
def attach_annotations(spark, sf):
    e = t.table(spark, sf, "embeddings")
    samples = e.select(F.col("vec_id").alias("name"), (F.col("vec_id") % 2 == 1).alias("flip"))
    codes = e.select(
        F.col("vec_id").alias("name"), F.explode(F.array(F.lit(False), F.lit(True))).alias("flip"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.col("label") + i).alias("codes"),
    ).withColumn("codes", F.when(F.col("flip"), F.reverse("codes")).otherwise(F.col("codes")))
    parts = ["left_eye", "right_eye", "nose", "mouth"]
    v = lambda i: F.get("embedding", F.lit(i)).cast("double")
    comps = e.select(
        F.col("vec_id").alias("name"),
        F.explode(F.array(*[
            F.struct(F.lit(p).alias("part"), (256 + 100 * v(3 * i)).alias("cx"), (256 + 100 * v(3 * i + 1)).alias("cy"), (40 + 20 * v(3 * i + 2)).alias("half"))
            for i, p in enumerate(parts)
        ])).alias("c"),
    ).select("name", "c.*")
    out = joins.attach_annotations(samples, codes, comps, 512, 256)
    return out.select("name", "flip", "part", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"), *[r(c).alias(c) for c in ("x1", "y1", "x2", "y2", "in_x1", "in_y1", "in_x2", "in_y2")])


@query
def box_overlap(spark, sf):
    d = t.detections(spark, sf)
    return boxes.box_overlap(d, d).select("img", "a_idx", "b_idx", r("overlap").alias("overlap"))


@query
def box_overlap_iof(spark, sf):
    d = t.detections(spark, sf)
    big = d.withColumns({"x2": F.col("x1") + 150, "y2": F.col("y1") + 150})
    return boxes.box_overlap(d, big, kind="iof", min_overlap=0.5).select("img", "a_idx", "b_idx", r("overlap").alias("overlap"))


@query
def match_priors(spark, sf):
    d = t.detections(spark, sf)
    truth = d.select("img", "det_idx", *[(F.col(c) / 512).alias(c) for c in ("x1", "y1", "x2", "y2")], (1 + F.col("det_idx") % 3).cast("int").alias("label"))
    at = lambda a, b: F.struct((F.col("x1") + (F.col("x2") - F.col("x1")) * a).alias("x"), (F.col("y1") + (F.col("y2") - F.col("y1")) * b).alias("y"))
    truth = truth.withColumn("points", F.array(at(0.25, 0.3), at(0.75, 0.3), at(0.5, 0.5), at(0.3, 0.8), at(0.7, 0.8)))
    priors = boxes.prior_grid(spark, 512, 512, [64, 128], [[48, 80], [120]])
    out = boxes.match_priors(truth, priors)
    point = [r(F.get("points", F.lit(k))[c], 4).alias(f"l{c}{k}") for k in range(5) for c in "xy"]
    return out.select("img", "prior_id", "det_idx", "label", *[r(c).alias(c) for c in ("dx", "dy", "dw", "dh")], *point)


@query
def schedule_value(spark, sf):
    n = F.col("o_orderkey")
    o = t.table(spark, sf, "orders").select(
        n.alias("iteration"),
        r(scoring.schedule_value(n, "multistep", 2e-4 * 1e4, milestones=[4000, 8000, 8000, 12000], gamma=0.5, restarts=(0, 10000), restart_weights=(1, 0.5))).alias("multistep"),
        r(scoring.schedule_value(n, "cosine", 2.0, periods=[5000, 5000, 5000], restart_weights=(1, 0.5, 0.25), eta_min=0.001)).alias("cosine"),
        r(scoring.schedule_value(n, "constant", 2.0, warmup=500)).alias("warmup"),
    )
    return o


def _iterations(spark, sf, runs: str) -> DataFrame:
    """Order lines as iterations of runs; over a third of them belong to run 0."""
    run = F.when(F.col("l_linenumber") <= 2, F.lit(0).cast("bigint")).otherwise(F.expr(runs))
    return t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", run.alias("run"), F.col("l_orderkey").alias("iteration"))


@query
def schedule_asof(spark, sf):
    """Orders as the steps of some hundred runs; equal starts, runs without steps, rows before the first step."""
    steps = t.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 301 - 1).alias("run"), (F.col("o_orderkey") + 5000 - F.col("o_orderkey") % 7).alias("from_iter"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents")
    )
    iters = _iterations(spark, sf, "(l_suppkey * 7 + l_partkey) % 303 - 1")
    return schedules.schedule_asof(iters, steps, values=("cents",), defaults={"cents": -1}, block_rows=5000)


def _run_configs(spark, sf) -> DataFrame:
    """A schedule for each supplier's run."""
    n = F.col("s_suppkey")
    return t.table(spark, sf, "supplier").select(
        n.alias("run"), (n / 100).alias("base"), F.lit(0.5).alias("gamma"), F.lit(0.001).alias("eta_min"), (n % 5 * 300).alias("warmup"),
        F.array(n % 4 * 1000 + 1000, n % 3 * 2000 + 2000, n % 4 * 1000 + 1000, n % 6 * 3000).alias("milestones"),
        F.array(F.lit(0).cast("bigint"), n % 2 * 2000 + 2000).alias("restarts"), F.lit([1.0, 0.75]).alias("restart_weights"),
        F.array(n % 3 * 1000 + 1000, F.lit(3000).cast("bigint"), n * 50 + 1).alias("periods"), F.lit([1.0, 0.5, 0.25]).alias("period_weights"),
    )


@query
def schedule_multistep(spark, sf):
    """Multi-step schedules with restarts, one per run, from a table; warm-up on top."""
    configs = _run_configs(spark, sf)
    steps = schedules.multistep_steps(configs).join(configs.select("run", "base", "warmup"), "run")
    rows = schedules.schedule_asof(_iterations(spark, sf, "l_suppkey"), steps, values=("value", "base", "warmup"))
    rate = schedules.warmed_up(F.col("value"), F.col("iteration"), F.col("base"), F.col("warmup"))
    return rows.select("l_orderkey", "l_linenumber", "run", F.coalesce(r(rate, 9), F.lit(-1.0)).alias("rate"))


@query
def schedule_cosine(spark, sf):
    """Cosine schedules with restarts, one per run, from a table; periods are closed on the right."""
    configs = _run_configs(spark, sf).drop("restart_weights").withColumnRenamed("period_weights", "restart_weights")
    rows = schedules.schedule_asof(
        _iterations(spark, sf, "l_suppkey"), schedules.cosine_periods(configs), values=("begins", "length", "weight", "base", "eta_min"), strict=True
    )
    return rows.select("l_orderkey", "l_linenumber", "run", F.coalesce(r(schedules.cosine_rate(F.col("iteration")), 9), F.lit(-1.0)).alias("rate"))


@query
def nearest_code_blocked(spark, sf):
    """Blocks of about 640 numbers."""
    v = t.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return scoring.nearest_code(v, t.codebook(spark, sf), max_numbers=640).select("vec_id", "code_id", r("distance").alias("distance"))


@query
def nearest_code(spark, sf):
    v = t.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return scoring.nearest_code(v, t.codebook(spark, sf)).select("vec_id", "code_id", r("distance").alias("distance"))


@query
def resolve_presets(spark, sf):
    names = [*PRESETS, "Custom"]
    e = t.table(spark, sf, "events").select(
        "event_id", F.get(F.lit(names), (F.col("event_id") % 4).cast("int")).alias("preset"),
        (F.col("event_id") % 10 / 10).alias("w"), (F.col("event_id") % 7 / 10).alias("skin_grain"),
        *[(F.col("event_id") % k == 0).alias(c) for k, c in ((2, "eye_enhancement"), (3, "color_match"), (5, "enable_eyes"), (7, "enable_lips"), (9, "enable_skin"))],
    )
    return joins.resolve_presets(e)


@query
def sweep(spark, sf):
    return joins.sweep(t.table(spark, sf, "customer").select("c_custkey")).select("c_custkey", "preset", "w", "skin_grain", "enable_eyes")


def _preset_table(spark, sf) -> DataFrame:
    """Nations as presets; some values are not set."""
    n = F.col("n_nationkey")
    return t.table(spark, sf, "nation").select(F.col("n_name").alias("preset"), F.when(n % 3 > 0, n / 10).alias("w"), (n % 2 == 0).alias("enable_eyes"))


@query
def resolve_presets_table(spark, sf):
    """Presets from a table of any size."""
    names = t.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    c = t.table(spark, sf, "customer").join(names, F.col("c_nationkey") == F.col("k")).select(
        "c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("Custom")).otherwise(F.col("n_name")).alias("preset"),
        (F.col("c_custkey") % 10 / 10).alias("w"), (F.col("c_custkey") % 4 == 0).alias("enable_eyes"),
    )
    return joins.resolve_presets(c, _preset_table(spark, sf))


@query
def sweep_table(spark, sf):
    return joins.sweep(t.table(spark, sf, "supplier").select("s_suppkey"), _preset_table(spark, sf)).select("s_suppkey", "preset", F.coalesce("w", F.lit(-1.0)).alias("w"), "enable_eyes")


def _scores(spark, sf) -> DataFrame:
    return (
        t.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("variant"), F.col("l_partkey").alias("sample"))
        .agg(exact_avg("l_extendedprice").alias("value"), exact_avg("l_quantity").alias("latency_s"))
    )


@query
def compare_to_baseline(spark, sf):
    out = joins.compare_to_baseline(_scores(spark, sf), "N")
    return out.select("variant", "samples", "exact", *[r(c).alias(c) for c in ("mean_psnr", "mean_latency_s", "speedup")])


# --- aggregations -------------------------------------------------------------


@query
def composition(spark, sf):
    return aggregates.composition(t.listing(spark, sf), "category", F.col("doc_id") % 2 == 0)


@query
def categories(spark, sf):
    return aggregates.categories(t.listing(spark, sf)).select(F.array_join("categories", ", ").alias("categories"))


@query
def rejection_report(spark, sf):
    return aggregates.rejection_report(_judged(spark, sf))


@query
def directory_rollup(spark, sf):
    return aggregates.directory_rollup(t.listing(spark, sf), 3, 10_000)


@query
def reclaim_plan(spark, sf):
    rules = [
        {"name": "cache", "prefix": "src1"},
        {"name": "installers", "suffix": ".WEBP", "min_bytes": 3000},
        {"name": "large", "min_bytes": 8000},
    ]
    return aggregates.reclaim_plan(t.listing(spark, sf), rules)


@query
def channel_moments(spark, sf):
    both = pixels.channel_moments(t.planes(spark, sf), also={"std_pop": (0, 0.0)})
    return both.select("img", "ch", *[r(c).alias(c) for c in ("mean", "std", "std_pop")])


@query
def transfer_moments(spark, sf):
    p = t.planes(spark, sf)
    style = p.withColumn("img", F.col("img") - 1)
    out = pixels.transfer_moments(p, style, blend=0.7)
    return out.select("img", "ch", F.posexplode("plane").alias("pos", "v")).select("img", "ch", "pos", r("v", 7).alias("v"))


@query
def pair_loss(spark, sf):
    p = t.plane_pairs(spark, sf).withColumn("wt", F.transform("a", lambda v: v / 255.0))
    losses = {"l1": ("l1", None, "mean"), "mse_sum": ("mse", None, "sum"), "charbonnier_weighted": ("charbonnier", "wt", "mean")}
    return pixels.pair_losses(p, losses, ["pair"]).select("pair", *[r(c).alias(c) for c in ("l1", "mse_sum", "charbonnier_weighted")])


@query
def total_variation(spark, sf):
    p = t.planes(spark, sf)
    return pixels.total_variation(p).select("img", "ch", r("tv").alias("tv"))


@query
def gram(spark, sf):
    return pixels.gram(t.planes(spark, sf)).select("img", "c1", "c2", r("value").alias("value"))


@query
def code_usage(spark, sf):
    v = t.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return aggregates.code_usage(scoring.nearest_code(v, t.codebook(spark, sf)), 16).select("code_id", "uses", r("share").alias("share"))


@query
def perplexity(spark, sf):
    usage = aggregates.code_usage(t.table(spark, sf, "embeddings").select(F.col("label").alias("code_id")), 16)
    return aggregates.perplexity(usage).select(r("perplexity").alias("perplexity"))


@query
def reduce_ranks(spark, sf):
    e = t.table(spark, sf, "events").select(F.floor(F.col("event_id") / 4).alias("iteration"), F.col("event_type").alias("metric"), (F.col("value") / 1000).alias("value"))
    return aggregates.reduce_ranks(e).select("iteration", "metric", r("value").alias("value"), "ranks")


@query
def detect_gray(spark, sf):
    out = pixels.detect_gray(t.planes(spark, sf), threshold=500.0)
    # three variances of 64 whole numbers: a multiple of 1/12288, rounded exactly on both sides
    exact = F.round(F.col("difference") * 12288) / 12288
    return out.select("img", "channels", exact.alias("difference"), "is_gray")


@query
def class_areas(spark, sf):
    m = t.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("img"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.transform("embedding", lambda e: F.pmod(F.floor((e.cast("double") + 1) * 9.5), F.lit(19)).cast("int")).alias("mask"),
    )
    return pixels.class_areas(m, CLASS_WEIGHTS, border=1)


def _identity_pairs(spark, sf) -> DataFrame:
    e = t.table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("embedding").alias("b"))
    return e.select("vec_id", "label", F.col("embedding").alias("a")).join(nxt, ["vec_id", "label"])


@query
def identity_distance(spark, sf):
    return metrics.identity_distance(_identity_pairs(spark, sf)).select("vec_id", "label", r("distance").alias("distance"))


@query
def identity_loss(spark, sf):
    return metrics.identity_loss(_identity_pairs(spark, sf), 0.1, ["label"]).select("label", r("identity_loss").alias("identity_loss"))


@query
def summarise_metrics(spark, sf):
    li = t.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    long = projections.melt_metrics(li, ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])
    return aggregates.summarise_metrics(long, ["l_returnflag", "metric"]).select("l_returnflag", "metric", r("mean_value").alias("mean_value"), "samples")


@query
def warm_latency(spark, sf):
    e = t.table(spark, sf, "events")
    return aggregates.warm_latency(e, ["event_type"], "event_id", "value").select("event_type", r("warm_latency_s").alias("warm_latency_s"), "warm_calls")


@query
def acceptance_gate(spark, sf):
    li = t.table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_partkey").alias("sample")).agg(
        exact_avg("l_extendedprice").alias("psnr"), exact_avg("l_discount").alias("ssim"), exact_avg("l_tax").alias("identity")
    )
    s = li.select("l_returnflag", "sample", F.concat(F.lit("cat_"), (F.col("sample") % 4).cast("string")).alias("category"), F.when(F.col("sample") % 10 != 0, F.col("psnr")).alias("psnr"), "ssim", "identity")
    out = aggregates.acceptance_gate(s.where("l_returnflag = 'A'"), s.where("l_returnflag = 'N'"))
    return out.select("category", "samples", "accepted", *[r(c, 8).alias(c) for c in ("cand_psnr_median", "base_psnr_median", "cand_ssim_median", "base_ssim_median", "cand_identity_mean", "base_identity_mean")])


# --- ranking ------------------------------------------------------------------


@query
def take_per_group(spark, sf):
    return ranking.take_per_group(t.listing(spark, sf), ["category"], 7, ["doc_id"]).select("doc_id", "category")


@query
def take_per_group_large(spark, sf):
    e = t.table(spark, sf, "events")
    return ranking.take_per_group(e, ["event_type"], 1500, ["event_id"]).select("event_type", "event_id")


@query
def take_quota(spark, sf):
    base = t.listing(spark, sf)
    quotas = base.groupBy("category").agg((5 + F.count(F.lit(1)) % 7).alias("quota"))
    held = base.join(t.table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")
    fresh = joins.skip_existing(base, held, "doc_id")
    return ranking.take_quota(fresh, quotas, "category", ["doc_id"], held).select("doc_id", "category")


@query
def append_ids(spark, sf):
    base = t.listing(spark, sf).select("doc_id", F.col("category").alias("prefix"))
    labels = t.table(spark, sf, "labels")
    stored = base.join(labels, "doc_id", "left_semi").select(
        F.when(F.col("doc_id") % 5 == 0, F.concat("prefix", F.lit("_bad.png"))).otherwise(F.concat("prefix", F.format_string("_%05d.png", F.col("doc_id") % 50))).alias("name")
    )
    fresh = joins.skip_existing(base, labels, "doc_id")
    maxima = ranking.existing_max(stored, fresh)
    return ranking.append_ids(fresh, maxima, "doc_id").select("doc_id", "item_id", "item_name")


@query
def dedupe(spark, sf):
    keyed = t.listing(spark, sf, text=True).withColumn("key", F.md5("text"))
    first = ranking.dedupe(keyed, ["key"], ["category", "doc_id"]).select("key", F.lit("first").alias("keep"), "doc_id")
    last = ranking.dedupe(keyed, ["key"], ["rel_path"], keep="last").select("key", F.lit("last").alias("keep"), "doc_id")
    return first.unionByName(last)


@query
def merge_sources(spark, sf):
    base = t.listing(spark, sf).select(F.col("rel_path").alias("path"), "doc_id", "category")
    named = base.withColumn("name", F.concat((F.col("doc_id") % 300).cast("string"), F.lit(".png")))
    parts = {s: named.where(F.col("category").endswith(s)) for s in "0123456789"}
    return ranking.merge_sources(parts).select("name", "source", "doc_id")


@query
def largest_box(spark, sf):
    return boxes.largest_box(t.detections(spark, sf)).select("img", "det_idx", r("box_area").alias("box_area"))


@query
def center_box(spark, sf):
    return boxes.center_box(t.detections(spark, sf)).select("img", "det_idx", r("center_dist").alias("center_dist"))


@query
def suppress(spark, sf):
    return boxes.suppress(t.detections(spark, sf), 0.4).select("img", "det_idx", r("score").alias("score"))


@query
def expand_classes(spark, sf):
    d = t.detections(spark, sf).select("img", "det_idx", F.col("score").alias("objectness"), F.array(*[uniform("det_idx", f"class{k}", 3) for k in range(3)]).alias("class_scores"))
    return projections.expand_classes(d, 0.25, classes=[0, 2]).select("img", "det_idx", "cls", r("score").alias("score"))


@query
def suppress_crowded(spark, sf):
    """The method for crowded images, with a few boxes that have no area or lack a corner."""
    d = t.detections(spark, sf).withColumn("x2", F.when(F.col("det_idx") % 50 == 0, F.col("x1") - 5).when(F.col("det_idx") % 50 != 1, F.col("x2")))
    return boxes.suppress(d, 0.4, group_cap=4).select("img", "det_idx", r("score").alias("score"))


@query
def suppress_classes(spark, sf):
    d = projections.filter_detections(t.detections(spark, sf), 0.25, None)
    return boxes.suppress(d, 0.45, class_aware=True, top_k=40, merge=True).select("img", "det_idx", "cls", *[r(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query
def latest_checkpoint(spark, sf):
    return ranking.latest_checkpoint(t.checkpoints(spark, sf))


@query
def newest_run(spark, sf):
    return ranking.newest_run(t.checkpoints(spark, sf))


@query
def retention_plan(spark, sf):
    plan = ranking.retention_plan(t.checkpoints(spark, sf), 5, "run_3")
    return _known(plan.select("o_orderkey", "path", "iter", "action", "bytes"), iter=-1)


@query
def retention_summary(spark, sf):
    return ranking.retention_summary(ranking.retention_plan(t.checkpoints(spark, sf), 5))


@query
def first_available(spark, sf):
    c = t.table(spark, sf, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("path"), F.col("p_size").alias("priority"))
    usable = t.table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_discount > 0.08").select(F.col("l_partkey").alias("path"))
    return ranking.first_available(c, usable)


@query
def neighbour_frames(spark, sf):
    f = t.table(spark, sf, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").cast("int").alias("frame_idx"))
    low = ranking.with_clip(f, F.min("frame_idx").alias("_low"))
    # Read by each padding.
    zero = cut_lineage(low.select("clip", (F.col("frame_idx") - F.col("_low")).alias("frame_idx")))
    parts = [ranking.neighbour_frames(zero, 5, p).withColumn("padding", F.lit(p)) for p in ranking.PADDINGS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def gather_frames(spark, sf):
    f = t.table(spark, sf, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").cast("int").alias("frame_idx"), F.md5("text").alias("payload"))
    return ranking.gather_frames(f, 3, "replicate").select("clip", "frame_idx", F.array_join("window", ",").alias("window"))


@query
def tail(spark, sf):
    return ranking.tail(t.series(spark, sf), 100, ["iteration"]).select("run", "iteration", r("value").alias("value"))


@query
def ema(spark, sf):
    # sevenths have no finite decimal form, so no value sits on a rounding edge
    sevenths = t.series(spark, sf).withColumn("value", F.col("value") / 7)
    return ranking.ema(sevenths, 0.9, ["run"], "iteration", "value").select("run", "iteration", r("ema").alias("ema"))


@query
def eta(spark, sf):
    return ranking.eta(t.series(spark, sf), 200_000).select("run", "iteration", r("sec_per_iter", 4).alias("sec_per_iter"), r("eta_s", 3).alias("eta_s"))


# --- sampling -----------------------------------------------------------------


@query
def select_holdout(spark, sf):
    return _holdout(spark, sf).select("rel_path", "category", "order_key")


@query
def split(spark, sf):
    return sampling.split(t.listing(spark, sf), "rel_path", seed=11).select("rel_path", "split")


@query
def epoch_sample(spark, sf):
    return sampling.epoch_sample(t.table(spark, sf, "documents"), "doc_id", 2.5, 3, epoch=1)


@query
def batch(spark, sf):
    order = sampling.epoch_sample(t.table(spark, sf, "documents"), "doc_id", 1, 4, epoch=2)
    return sampling.batch(order, 7).groupBy("rank", "batch").agg(F.count(F.lit(1)).alias("items"), F.min("doc_id").alias("low"), F.sum("doc_id").alias("total"))


@query
def degradation_plan(spark, sf):
    p = sampling.degradation_plan(t.listing(spark, sf).select("rel_path"), "rel_path", seed=5)
    numbers = [f"{s}_{f}" for s in ("small", "large") for f in ("sigma_x", "sigma_y", "theta", "scale", "noise")]
    return p.select("rel_path", "flip", "motion", "gray", "jitter", "small_kernel", "large_kernel", "small_quality", "large_quality", *[r(c).alias(c) for c in [*numbers, "jitter_0", "jitter_2"]])


@query
def degrade(spark, sf):
    images = t.large_vectors(spark, sf)
    keyed = images.select("img").distinct()
    p = sampling.degradation_plan(keyed, "img", seed=9)
    plan = p.select("img", "gray", "jitter", "jitter_0", "jitter_1", "jitter_2", *[F.col(f"small_{c}").alias(c) for c in ("kernel", "sigma_x", "sigma_y", "theta", "scale", "noise")])
    out = sampling.degrade(images, plan, kernel_size=21, seed=9)
    return out.select("img", "ch", r(F.aggregate("plane", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("plane").alias("pixels"))


@query
def crop_plan(spark, sf):
    n = F.col("doc_id")
    pairs = t.listing(spark, sf).select("rel_path", F.col("h").alias("lq_h"), F.col("w").alias("lq_w"), (F.col("h") * 2 + F.when(n % 17 == 0, 1).otherwise(0)).alias("gt_h"), (F.col("w") * 2).alias("gt_w"))
    plan = sampling.crop_plan(pairs, 256, 2, "rel_path", seed=3).select("rel_path", "status", "top", "left", "top_gt", "left_gt", "hflip", "vflip", "rot90")
    return _known(plan, top=-1, left=-1, top_gt=-1, left_gt=-1, hflip=False, vflip=False, rot90=False)


@query
def mod_crop(spark, sf):
    h, w = sampling.mod_crop(F.col("h"), F.col("w"), 4)
    return t.listing(spark, sf).select("doc_id", h.alias("h"), w.alias("w"))


@query
def tile(spark, sf):
    base = t.listing(spark, sf).select(F.col("doc_id").alias("img"), "h", "w")
    a = pixels.tile(base, 400, 40, "overlap").withColumn("mode", F.lit("overlap"))
    b = pixels.tile(base, 200, 10, "fixed").withColumn("mode", F.lit("fixed"))
    return a.unionByName(b)


@query
def stitch(spark, sf):
    p = t.planes(spark, sf)
    grid = pixels.tile(p.select("img", "h", "w").distinct(), 4, 1, "overlap")
    tiles = pixels.cut_tiles(p, grid)
    return pixels.stitch(tiles.withColumn("plane", F.transform("plane", lambda v: v * 2)))


@query
def stitch_coverage(spark, sf):
    p = t.planes(spark, sf)
    shapes = p.select("img", "h", "w").distinct()
    whole = pixels.stitch(pixels.cut_tiles(p, pixels.tile(shapes, 5, 1, "fixed")))
    holed = whole.where((F.col("img") + F.col("ch") + F.col("x") * F.col("y")) % 97 != 0)
    return pixels.stitch_coverage(holed, shapes).select("img", "ch", "distinct")


@query
def stitch_planes(spark, sf):
    p = t.planes(spark, sf)
    tiles = pixels.cut_tiles(p, pixels.tile(p.select("img", "h", "w").distinct(), 4, 1, "overlap"))
    whole = pixels.stitch_planes(tiles.withColumn("plane", F.transform("plane", lambda v: v * 2)))
    at = whole.select("img", "ch", "w", F.posexplode("plane").alias("p", "v"))
    return at.select("img", "ch", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).alias("x"), "v")


@query
def tile_coverage(spark, sf):
    """Some tiles are lost and some come twice, one pixel to the side."""
    shapes = t.planes(spark, sf).select("img", "ch", "h", "w")
    tiles = pixels.tile(shapes.select("img", "h", "w").distinct(), 5, 1, "fixed").join(shapes.select("img", "ch"), "img")
    mark = (F.col("img") * 3 + F.col("ch") + F.col("row") * 2 + F.col("col")) % 11
    again = tiles.where(mark == 1).withColumn("x", F.greatest(F.col("x") - 1, F.lit(0)))
    found = pixels.tile_coverage(tiles.where(mark > 0).unionByName(again), shapes.select("img", "h", "w").distinct())
    return found.select("img", "ch", "distinct", "most")


@query
def composite_planes(spark, sf):
    """Neighbours as layers: one over the whole base, one moved so that it is cut at two sides."""
    v = t.vectors(spark, sf).select(F.col("vec_id").alias("img"), F.lit(0).alias("ch"), "h", "w", "plane")
    grid = F.sequence(F.lit(0), F.lit(63))
    shade = F.transform(grid, lambda p: (F.floor(p / 8) + p % 8) % 5 / 4)
    one = v.withColumns({"img": F.col("img") - 1, "layer": F.lit(0), "y0": F.lit(0), "x0": F.lit(0), "mask": shade, "parse_mask": F.lit(None).cast("array<double>")})
    two = v.withColumns({"img": F.col("img") - 2, "layer": F.lit(1), "y0": F.lit(-2), "x0": F.lit(3), "mask": F.transform(shade, lambda m: 1 - m), "parse_mask": F.transform(grid, lambda p: p % 8 / 8)})
    whole = pixels.composite_planes(v, one.unionByName(two))
    at = whole.select("img", "ch", "w", F.posexplode("plane").alias("p", "v"))
    return at.select("img", "ch", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).alias("x"), r("v").alias("v"))


@query
def composite(spark, sf):
    v = t.vectors(spark, sf).select(F.col("vec_id").alias("img"), F.lit(0).alias("ch"), "h", "w", "plane")
    base = pixels.explode_planes(v).drop("h", "w")
    shade = (F.col("x") + F.col("y")) % 5 / 4
    one = base.withColumns({"img": F.col("img") - 1, "layer": F.lit(0), "mask": shade, "parse_mask": F.lit(1.0)})
    two = base.withColumns({"img": F.col("img") - 2, "layer": F.lit(1), "mask": 1 - shade, "parse_mask": F.col("x") / 8})
    inside = one.unionByName(two).join(base.select("img").distinct(), "img", "left_semi")
    return pixels.composite(base, inside).select("img", "ch", "y", "x", r("v").alias("v"))


@query
def calibration_sample(spark, sf):
    base = t.listing(spark, sf)
    return sampling.calibration_sample(base, 25, "rel_path", F.col("ext") != ".txt").select("rel_path")


# --- image quality ------------------------------------------------------------


@query
def psnr(spark, sf):
    return metrics.psnr(t.plane_pairs(spark, sf), crop_border=1).select("pair", r("psnr").alias("psnr"))


@query
def psnr_luma(spark, sf):
    return metrics.psnr(t.image_pairs(spark, sf), luma=True).select("pair", r("psnr").alias("psnr"))


@query
def ssim(spark, sf):
    return metrics.ssim(t.large_pairs(spark, sf)).select("pair", r("ssim").alias("ssim"))


@query
def sharpness(spark, sf):
    # the variance of 64 whole numbers is a multiple of 1/4096: exact rounding on both sides
    exact = F.round(F.col("sharpness") * 4096) / 4096
    return pixels.sharpness(t.planes(spark, sf)).select("img", "ch", exact.alias("sharpness"))


@query
def quality_report(spark, sf):
    return metrics.quality_report(t.image_pairs(spark, sf))


@query
def convolve(spark, sf):
    out = pixels.convolve(t.planes(spark, sf), "sobel_x")
    return pixels.explode_planes(out).select("img", "ch", "y", "x", r("v").alias("v"))


@query
def evaluate(spark, sf):
    out = metrics.evaluate(t.large_pairs(spark, sf), {"psnr": {}, "psnr_cropped": {"type": "psnr", "crop_border": 4}})
    return out.select("metric", r("mean_value").alias("mean_value"), "samples")


# --- validation ---------------------------------------------------------------


@query
def validate_manifest(spark, sf):
    return validation.validate_manifest(t.manifest(spark, sf))


@query
def require(spark, sf):
    base = validation.require(t.listing(spark, sf), F.count(F.lit(1)) >= 100, "too few items")
    return validation.checked(base, F.col("bytes") > 0, "empty item").groupBy("ext").agg(F.count(F.lit(1)).alias("items"))


# --- logs and streams, in batch form ------------------------------------------


@query
def read_training_log(spark, sf):
    out = logs.dashboard_losses(logs.parse_training_log(t.log_lines(widen(t.table(spark, sf, "events"), logs.TASK_LINES))))
    return out.select("iteration", "eta", "eta_s", *[r(c, 9).alias(c) for c in logs.DASHBOARD_LOSSES])


@query
def run_liveness(spark, sf):
    e = t.table(spark, sf, "events")
    now = e.agg(F.max("ts")).scalar()
    return logs.run_liveness(e.withColumn("run", F.col("user_id")).select("run", "ts"), now, 36_000)


@query
def latest_progress(spark, sf):
    return progress.latest_progress(t.progress_events(t.table(spark, sf, "events")), tie="event_id")


@query
def stage_durations(spark, sf):
    return progress.stage_durations(t.progress_events(t.table(spark, sf, "events"))).select("request", "stage", r("seconds").alias("seconds"))


@query
def ingest_batch(spark, sf):
    base = t.listing(spark, sf, text=True).select("doc_id", F.md5("text").alias("key"), "bytes")
    stored = t.listing(spark, sf, text=True).join(t.table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")
    held = stored.select(F.md5("text").alias("key"), (F.col("doc_id") % 40).alias("item_id"))
    limit = 500
    return ingest.ingest_batch(base, held, "key", "doc_id", limit, F.col("bytes") > 300).select("doc_id", "key", "item_id", "item_name")


def _drained(query) -> None:
    query.awaitTermination()


@query
def stream_training_log(spark, sf):
    lines = t.log_lines(t.stream(spark, sf, "events"))
    out, chk = t.scratch(spark, "log"), t.scratch(spark, "log-state")
    losses = logs.dashboard_losses(logs.parse_training_log(lines))
    _drained(losses.writeStream.format("parquet").option("checkpointLocation", chk).trigger(availableNow=True).start(out))
    return spark.read.parquet(out).select("iteration", "eta", "eta_s", *[r(c, 9).alias(c) for c in logs.DASHBOARD_LOSSES])


@query
def stream_progress(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    latest = progress.stream_latest(t.progress_events(t.stream(spark, sf, "events")), tie="event_id")
    out, chk = t.scratch(spark, "progress"), t.scratch(spark, "progress-state")
    _drained(progress.stream_progress(latest, out, chk))
    return progress.read_progress(spark, out).withColumn("request", F.col("request").cast("bigint"))


@query
def stream_ingest(spark, sf):
    docs = t.stream(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"), "n_chars")
    out, chk = t.scratch(spark, "ingest"), t.scratch(spark, "ingest-state")
    _drained(ingest.stream_ingest(docs, out, chk, "key", "doc_id", 500, F.col("n_chars") > 300))
    return spark.read.parquet(out).select("doc_id", "key", "item_id", "item_name")


@query
def stream_ingest_again(spark, sf):
    """Items stored elsewhere, and a second query with a checkpoint of its own, which must add to the first."""
    docs = t.stream(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"), "n_chars")
    toxic = t.table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    held = t.table(spark, sf, "documents").join(toxic, "doc_id", "left_semi").select(F.md5("text").alias("key"), (F.col("doc_id") % 40).alias("item_id"))
    out = t.scratch(spark, "ingest")
    _drained(ingest.stream_ingest(docs.where("doc_id % 2 = 0"), out, t.scratch(spark, "first"), "key", "doc_id", None, F.col("n_chars") > 300, existing=held))
    _drained(ingest.stream_ingest(docs, out, t.scratch(spark, "second"), "key", "doc_id", None, F.col("n_chars") > 300, existing=held))
    return spark.read.parquet(out).select("doc_id", "key", "item_id", "item_name")


@query
def stream_liveness(spark, sf):
    """The last status of each run once the stream is drained: those the watermark has left behind are paused."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = t.stream(spark, sf, "events").withColumn("run", F.col("user_id"))
    status = logs.stream_liveness(events.select("run", "ts"), 36_000, watermark="0 seconds")
    out, chk = t.scratch(spark, "liveness"), t.scratch(spark, "liveness-state")
    save = lambda batch, nr: batch.withColumn("nr", F.lit(nr)).write.mode("overwrite").parquet(f"{out}/batch={nr}")
    _drained(status.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", chk).trigger(availableNow=True).start())
    last = spark.read.parquet(out).groupBy("run").agg(F.max_by(F.struct("last_ts", "status"), "nr").alias("s"))
    return last.select(F.col("run").cast("bigint").alias("run"), "s.last_ts", "s.status")


# --- user functions -----------------------------------------------------------


def _doubling_model():
    def run(values: pd.Series) -> list:
        if any(v[0] < 0 for v in values):
            raise ValueError("negative input")
        return [v * 2 for v in values]

    return run


@query
def score(spark, sf):
    e = t.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("plane"))
    out = scoring.score(e, _doubling_model, "plane", batch_size=16)
    return out.select("vec_id", "failed", F.posexplode("scored").alias("pos", "v")).select("vec_id", "failed", "pos", r("v").alias("v"))


@query
def human_bytes(spark, sf):
    o = t.table(spark, sf, "orders")
    size = F.floor(F.col("o_totalprice") * F.pow(F.lit(8.0), (F.col("o_orderkey") % 9).cast("double"))).cast("bigint")
    return o.select("o_orderkey", text.human_bytes(size).alias("size"))


@query
def landmark_offsets(spark, sf):
    n = F.col("det_idx")
    prior = ((n % 8 * 64 + 32).cast("double"), (n % 6 * 64 + 32).cast("double"), (32 + n % 5 * 16).cast("double"), (32 + n % 3 * 24).cast("double"))
    d = t.detections(spark, sf).select("img", "det_idx", "lm", geometry.encode_points(F.col("lm"), prior).alias("enc"))
    flat = d.select("img", "det_idx", F.posexplode("enc").alias("point", "p"))
    return flat.select("img", "det_idx", "point", r("p.x").alias("x"), r("p.y").alias("y"))


@query
def seeded_uniform(spark, sf):
    return t.table(spark, sf, "customer").select("c_custkey", r(uniform("c_custkey", "probe", 42), 9).alias("u"))
