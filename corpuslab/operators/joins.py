"""Key joins: incremental ingest, holdout control, pairing, audits.

No side carries a broadcast hint. Spark broadcasts a side when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffles (with skew splitting) beyond it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..schemas import PRESETS


def skip_existing(new: DataFrame, existing: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows of ``new`` whose source key is not stored yet."""
    keys = [key] if isinstance(key, str) else list(key)
    return new.join(existing.select(*keys), keys, "left_anti")


def _with_key(df: DataFrame, column: str, root: str) -> DataFrame:
    return df.withColumn("_key", text.to_rel_posix(F.col(column), root))


def exclude_holdout(train: DataFrame, holdout: DataFrame | None, train_col: str = "path", holdout_col: str = "path", root: str = "") -> DataFrame:
    """Training rows whose normalised path is not held out; a missing list is an error."""
    if holdout is None:
        raise ValueError("holdout list is missing: refusing to build a training set without it")
    banned = _with_key(holdout, holdout_col, root).select("_key")
    return _with_key(train, train_col, root).join(banned, "_key", "left_anti").drop("_key")


def exclusion_report(train: DataFrame, holdout: DataFrame, train_col: str = "path", holdout_col: str = "path", root: str = "") -> DataFrame:
    """One row: ``total``, ``removed`` and ``kept`` training rows; the training side is not shuffled when the list is small."""
    banned = _with_key(holdout, holdout_col, root).select("_key").distinct().withColumn("_held", F.lit(1))
    marked = _with_key(train, train_col, root).select("_key").join(banned, "_key", "left")
    return marked.agg(
        F.count(F.lit(1)).alias("total"), F.count("_held").alias("removed")
    ).withColumn("kept", F.col("total") - F.col("removed"))


def audit_leakage(train: DataFrame, holdout: DataFrame, train_col: str = "path", holdout_col: str = "path", root: str = "") -> DataFrame:
    """One row: training rows, and how many of them are held out (must be 0)."""
    report = exclusion_report(train, holdout, train_col, holdout_col, root)
    return report.select(F.col("total").alias("train_rows"), F.col("removed").alias("overlap_rows"))


def pair_lq_gt(lq: DataFrame, gt: DataFrame, template: str = "{}", path: str = "path") -> DataFrame:
    """Pair each reference with the input named ``template(base) + suffix``.

    ``status`` is ``paired``, ``missing_lq`` or ``missing_gt``, so one full join gives both the
    pairs and the mismatch report.
    """
    before, _, after = template.partition("{}")
    wanted = F.concat(F.lit(before), text.store_key(F.col(path)), F.lit(after), text.raw_suffix(F.col(path)))
    left = lq.select(text.basename(F.col(path)).alias("lq_name"), F.col(path).alias("lq_path"))
    right = gt.select(wanted.alias("lq_name"), F.col(path).alias("gt_path"))
    status = (
        F.when(F.col("lq_path").isNull(), "missing_lq").when(F.col("gt_path").isNull(), "missing_gt").otherwise("paired")
    )
    return left.join(right, "lq_name", "full_outer").withColumn("status", status)


def assert_paired(pairs: DataFrame) -> DataFrame:
    """Only complete pairs, or an error with the mismatch counts."""
    bad = {r["status"]: r["count"] for r in pairs.where("status <> 'paired'").groupBy("status").count().collect()}
    if bad:
        raise ValueError(f"inputs and references do not match: {bad}")
    return pairs.select("lq_path", "gt_path")


def compare_key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys on one side only, with ``side`` = ``a`` or ``b``; empty when the sets are equal."""
    left = a.select(F.col(key).alias("key"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    right = b.select(F.col(key).alias("key"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    seen = left.unionByName(right).groupBy("key").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    return seen.where("in_a <> in_b").select("key", F.when(F.col("in_a") == 1, "a").otherwise("b").alias("side"))


def manifest_paths(manifest: DataFrame) -> DataFrame:
    """``id, role, path`` for every input and every given reference."""
    return manifest.select(
        "id",
        F.explode(
            F.array(
                F.struct(F.lit("input").alias("role"), F.col("input_path").alias("path")),
                F.struct(F.lit("reference").alias("role"), F.col("reference_path").alias("path")),
            )
        ).alias("p"),
    ).select("id", "p.role", "p.path").where(F.col("path").isNotNull())


def check_files(manifest: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Manifest paths that no file backs: ``id, role, path``."""
    return manifest_paths(manifest).join(listing.select(F.col(path).alias("path")), "path", "left_anti").select("id", "role", "path")


def file_counts(manifest: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Per role: paths asked for, and how many are missing."""
    asked = manifest_paths(manifest).groupBy("role").agg(F.count(F.lit(1)).alias("asked"))
    lost = check_files(manifest, listing, path).groupBy("role").agg(F.count(F.lit(1)).alias("_lost"))
    return asked.join(lost, "role", "left").select("role", "asked", F.coalesce("_lost", F.lit(0)).cast("bigint").alias("missing"))


# Enlargement of each component's half side.
COMPONENT_SCALE = {"left_eye": 1.4, "right_eye": 1.4, "nose": 1.1, "mouth": 1.3}


def component_boxes(components: DataFrame, gt_size: int = 512, in_size: int = 512) -> DataFrame:
    """Boxes of ``name, flip, part, cx, cy, half`` rows; a flip swaps the eyes and mirrors x."""
    mirrored = F.when(F.col("part") == "left_eye", "right_eye").when(F.col("part") == "right_eye", "left_eye")
    part = F.when(F.col("flip"), F.coalesce(mirrored, F.col("part"))).otherwise(F.col("part"))
    cx = F.when(F.col("flip"), F.lit(float(gt_size)) - F.col("cx")).otherwise(F.col("cx"))
    scale = None
    for name, factor in COMPONENT_SCALE.items():
        hit = F.col("_part") == name
        scale = F.when(hit, F.lit(factor)) if scale is None else scale.when(hit, F.lit(factor))
    half = F.col("half") * scale.otherwise(F.lit(1.0))
    ratio = float(gt_size // in_size)
    placed = components.withColumns({"_part": part, "_cx": cx}).withColumn("_half", half)
    box = {
        "x1": F.col("_cx") - F.col("_half") + 1,
        "y1": F.col("cy") - F.col("_half") + 1,
        "x2": F.col("_cx") + F.col("_half"),
        "y2": F.col("cy") + F.col("_half"),
    }
    return placed.select(
        "name", "flip", F.col("_part").alias("part"),
        *[v.alias(k) for k, v in box.items()],
        *[(v / F.lit(ratio)).alias(f"in_{k}") for k, v in box.items()],
    )


def attach_annotations(samples: DataFrame, codes: DataFrame, components: DataFrame, gt_size: int = 512, in_size: int = 512) -> DataFrame:
    """Code map by (name, flip) and component boxes for each sample, one row per component.

    Every sample is returned: ``status`` is ``ok``, ``no_codes`` or ``no_components``, the missing columns null.
    """
    coded = samples.select("name", "flip").join(codes.withColumn("_coded", F.lit(True)), ["name", "flip"], "left")
    flagged = samples.select("name", "flip").join(components.select("name", "part", "cx", "cy", "half"), "name")
    whole = coded.join(component_boxes(flagged, gt_size, in_size).withColumn("_boxed", F.lit(True)), ["name", "flip"], "left")
    status = F.when(F.col("_coded").isNull(), "no_codes").when(F.col("_boxed").isNull(), "no_components").otherwise("ok")
    return whole.withColumn("status", status).drop("_coded", "_boxed")


def _preset_lookup(presets: Mapping[str, Mapping], field: str) -> Column:
    entries = [x for name, values in presets.items() for x in (F.lit(name), F.lit(values[field]))]
    return F.create_map(*entries)


def _unknown_preset(column: str) -> Column:
    return F.raise_error(F.concat(F.lit("unknown preset: "), F.coalesce(F.col(column), F.lit("null"))))


def _resolve_from_table(requests: DataFrame, presets: DataFrame, column: str) -> DataFrame:
    fields = [c for c in presets.columns if c != "preset"]
    again = presets.groupBy("preset").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"preset is listed more than once: {again[0]['preset']!r}")
    named = presets.where(F.col("preset").isNotNull()).select(F.col("preset").alias("_name"), F.struct(*fields).alias("_p"))
    met = requests.join(named, F.col(column) == F.col("_name"), "left")
    # The check lies in the name, which every reader of a value needs.
    known = F.when(F.col("_name").isNotNull() | (F.col(column) == "Custom"), F.col(column)).otherwise(_unknown_preset(column).cast("string"))
    met = met.withColumn(column, known)
    return met.withColumns({f: F.when(F.col("_name").isNull() & F.col(column).isNotNull(), F.col(f)).otherwise(F.coalesce(F.col("_p")[f], F.col(f))) for f in fields}).select(*requests.columns)


def resolve_presets(requests: DataFrame, presets: Mapping[str, Mapping] | DataFrame = PRESETS, column: str = "preset") -> DataFrame:
    """Preset values replace request values; ``Custom`` keeps the request; other names fail the job.

    ``presets`` is a mapping, or a table with ``preset`` and a column per value; a null value there keeps the request's.
    """
    if isinstance(presets, DataFrame):
        return _resolve_from_table(requests, presets, column)
    known = F.col(column).isin(*presets, "Custom")
    name = F.when(known, F.col(column)).otherwise(_unknown_preset(column).cast("string"))
    fields = list(next(iter(presets.values())))
    values = {
        f: F.coalesce(F.try_element_at(_preset_lookup(presets, f), name), F.col(f)) for f in fields
    }
    return requests.withColumns(values)


def sweep(inputs: DataFrame, presets: Mapping[str, Mapping] | DataFrame = PRESETS) -> DataFrame:
    """Every input under every preset, expanded inside the row from the preset list.

    A table of presets is read as one list, so it must be as short as a list of presets is.
    """
    if isinstance(presets, DataFrame):
        listed = presets.agg(F.collect_list(F.struct("preset", *[c for c in presets.columns if c != "preset"]))).scalar()
        return inputs.select("*", F.explode(listed).alias("_p")).select(*inputs.columns, "_p.*")
    fields = list(next(iter(presets.values())))
    options = F.array(
        *[F.struct(F.lit(n).alias("preset"), *[F.lit(v[f]).alias(f) for f in fields]) for n, v in presets.items()]
    )
    return inputs.select("*", F.explode(options).alias("_p")).select(*inputs.columns, "_p.*")


def compare_to_baseline(results: DataFrame, baseline: str, keys: list[str] | None = None, sample: str = "sample") -> DataFrame:
    """Each variant against the baseline on shared samples.

    ``results`` has ``variant``, the ``keys`` of one compared value (sample, and position if any),
    ``value`` and ``latency_s``. PSNR is taken per sample and averaged over samples with a finite
    one; identical samples are counted in ``exact``. Latency covers every row of the variant.
    """
    keys = keys or [sample]
    base = results.where(F.col("variant") == baseline).select(*keys, F.col("value").alias("_base"))
    pairs = results.join(base, keys)
    per_sample = pairs.groupBy("variant", sample).agg(F.avg(F.pow(F.col("value") - F.col("_base"), 2)).alias("_mse"))
    psnr = F.when(F.col("_mse") > 0, 20.0 * F.log10(F.lit(255.0) / F.sqrt("_mse")))
    quality = per_sample.withColumn("_psnr", psnr).groupBy("variant").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum(F.when(F.col("_mse") == 0, 1).otherwise(0)).alias("exact"),
        F.avg("_psnr").alias("mean_psnr"),
    )
    latency = results.groupBy("variant").agg(F.avg("latency_s").alias("mean_latency_s"))
    base_latency = latency.where(F.col("variant") == baseline).select("mean_latency_s").scalar()
    report = latency.join(quality, "variant", "left").withColumn("speedup", F.try_divide(base_latency, F.col("mean_latency_s")))
    return report.select("variant", "samples", "exact", "mean_psnr", "mean_latency_s", "speedup")
