"""Row filters and projections: no shuffle unless two tables meet."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry, text
from ..schemas import IMAGE_SUFFIXES, MIN_COVERAGE, MIN_SHARPNESS, MIN_SIDE


def filter_name(
    df: DataFrame,
    column: str,
    allow_ext: Iterable[str] = IMAGE_SUFFIXES,
    deny_prefix: Iterable[str] = (".",),
    deny_contains: Iterable[str] = (),
) -> DataFrame:
    """Keep allowed suffixes (none counts as ``.jpg``) whose base name has no denied prefix or part."""
    name = F.lower(text.basename(F.col(column)))
    ext = F.coalesce(F.nullif(text.suffix(F.col(column)), F.lit("")), F.lit(".jpg"))
    keep = ext.isin([e.lower() for e in allow_ext])
    for prefix in deny_prefix:
        keep = keep & ~name.startswith(prefix.lower())
    for part in deny_contains:
        keep = keep & ~name.contains(part.lower())
    return df.where(keep)


def filter_size(
    df: DataFrame,
    max_bytes: int | None = None,
    max_pixels: int | None = None,
    null_passes: bool = True,
) -> DataFrame:
    """Drop rows above a cap; a value at the cap stays, an unknown one stays if ``null_passes``."""
    keep = F.lit(True)
    if max_bytes is not None:
        keep = keep & F.coalesce(F.col("bytes") <= max_bytes, F.lit(null_passes))
    if max_pixels is not None:
        pixels = F.col("w").cast("bigint") * F.col("h").cast("bigint")
        keep = keep & F.coalesce(pixels <= max_pixels, F.lit(null_passes))
    return df.where(keep)


def filter_resolution(df: DataFrame, min_side: int = MIN_SIDE) -> DataFrame:
    return df.where((F.col("w") >= min_side) & (F.col("h") >= min_side))


def filter_coverage(boxes: DataFrame, images: DataFrame, min_ratio: float = MIN_COVERAGE) -> DataFrame:
    """Keep boxes that cover at least ``min_ratio`` of their image; adds ``coverage``."""
    sized = boxes.join(images.select("img", F.col("w").alias("_w"), F.col("h").alias("_h")), "img")
    box = geometry.area(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    ratio = F.try_divide(box, F.col("_w").cast("double") * F.col("_h").cast("double"))
    return sized.withColumn("coverage", ratio).where(F.col("coverage") >= min_ratio).drop("_w", "_h")


def filter_detections(df: DataFrame, min_score: float = 0.8, min_eye_dist: float | None = 5.0) -> DataFrame:
    """Keep scores above the limit and, when given, eyes at least ``min_eye_dist`` apart."""
    kept = df.where(F.col("score") > min_score)
    if min_eye_dist is None:
        return kept
    left, right = F.get("lm", F.lit(0)), F.get("lm", F.lit(1))
    gap = F.sqrt(F.pow(left["x"] - right["x"], 2) + F.pow(left["y"] - right["y"], 2))
    return kept.where(gap >= min_eye_dist)


def expand_classes(df: DataFrame, threshold: float, objectness: str = "objectness", scores: str = "class_scores", classes: list[int] | None = None) -> DataFrame:
    """One row per class whose confidence, object score times class score, exceeds ``threshold``: adds ``cls`` and ``score``.

    ``classes`` keeps only those. A null score of either kind gives no row.
    """
    rows = df.select(*[c for c in df.columns if c != scores], F.posexplode(scores).alias("cls", "_s"))
    rows = rows.withColumn("score", F.col(objectness) * F.col("_s")).where(F.col("score") > threshold)
    return (rows if classes is None else rows.where(F.col("cls").isin(classes))).drop("_s")


def curation_rules(
    min_side: int = MIN_SIDE, min_coverage: float = MIN_COVERAGE, min_sharpness: float = MIN_SHARPNESS
) -> list[tuple[str, Column]]:
    """Rejection rules over ``w, h, faces, coverage, sharpness`` in the order they are tried."""
    return [
        ("unreadable", F.col("w").isNull() | F.col("h").isNull()),
        ("low_res", (F.col("w") < min_side) | (F.col("h") < min_side)),
        ("no_face", F.coalesce(F.col("faces"), F.lit(0)) == 0),
        ("small_face", F.col("coverage") < min_coverage),
        ("blurry", F.col("sharpness") < min_sharpness),
    ]


def reject_reason(df: DataFrame, rules: list[tuple[str, Column]] | None = None, out: str = "reason") -> DataFrame:
    """Name of the first rule that fails, else ``ok``; one pass, no shuffle."""
    reason = None
    for name, failed in rules if rules is not None else curation_rules():
        reason = F.when(failed, F.lit(name)) if reason is None else reason.when(failed, F.lit(name))
    return df.withColumn(out, F.lit("ok") if reason is None else reason.otherwise(F.lit("ok")))


def box_convert(df: DataFrame, src: str, dst: str, variances: tuple[float, float] = (0.1, 0.2)) -> DataFrame:
    """Convert boxes between ``xyxy``, ``xywh`` (centre) and ``offset`` (needs ``pcx, pcy, pw, ph``)."""
    names = {"xyxy": ("x1", "y1", "x2", "y2"), "xywh": ("cx", "cy", "w", "h"), "offset": ("dx", "dy", "dw", "dh")}
    if src not in names or dst not in names:
        raise ValueError(f"unknown box form: {src} to {dst}")
    given = tuple(F.col(c) for c in names[src])
    prior = tuple(F.col(c) for c in ("pcx", "pcy", "pw", "ph"))
    if src == "xywh":
        corners = geometry.centre_to_corners(*given)
    elif src == "offset":
        corners = geometry.decode_offsets(given, prior, variances)
    else:
        corners = dict(zip(names["xyxy"], given))
    box = tuple(corners[c] for c in names["xyxy"])
    if dst == "xywh":
        target = geometry.corners_to_centre(*box)
    elif dst == "offset":
        target = geometry.encode_offsets(box, prior, variances)
    else:
        target = corners
    return df.withColumns({c: target[c] for c in names[dst]})


def box_fit(df: DataFrame, net_size: tuple[int, int] | None = None, grow: float | None = None, keep_aspect: bool = True) -> DataFrame:
    """Undo a (height, width) letterbox, then optionally enlarge; boxes stay inside ``img_h, img_w``."""
    corners = ("x1", "y1", "x2", "y2")
    image = (F.col("img_h"), F.col("img_w"))
    if net_size is not None:
        net = (F.lit(float(net_size[0])), F.lit(float(net_size[1])))
        df = df.withColumns(geometry.undo_letterbox(tuple(F.col(c) for c in corners), net, image))
    if grow is not None:
        df = df.withColumns(geometry.grow_box(tuple(F.col(c) for c in corners), grow, image, keep_aspect))
    return df


def melt_metrics(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Wide loss columns to ``(keys..., metric, value)`` rows."""
    return df.unpivot(keys or ["iteration"], columns, "metric", "value")
