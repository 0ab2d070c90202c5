"""Holdout choice, splits, epochs, batches, degradation and crop plans."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text
from ..functions.hashing import choose, order_key, permuted, uniform, uniform_int, uniform_range
from ..schemas import DEGRADATION, IMAGE_SUFFIXES
from .ordering import cut_lineage, position_by
from .pixels import LUMA_GRAY

# Fixed value: seed of the published holdout.
HOLDOUT_SEED = 20260723


def holdout_candidates(df: DataFrame, key: str, folders: Iterable[str] | None = None, suffixes: Iterable[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Items whose suffix is allowed and whose category is one of ``folders``."""
    allowed = df.where(text.suffix(F.col(key)).isin([s.lower() for s in suffixes]))
    return allowed if folders is None else allowed.where(F.col("category").isin(list(folders)))


def select_holdout(df: DataFrame, key: str, n: int, seed: int = HOLDOUT_SEED, folders: Iterable[str] | None = None, check: bool = True) -> DataFrame:
    """First ``n`` candidates in seeded hash order, with ``order_key``; fewer than ``n`` is an error.

    The check reads no more rows than it needs to count to ``n``; the selection is a top-k.
    """
    pool = holdout_candidates(df, key, folders)
    if check:
        found = pool.limit(n).count()
        if found < n:
            raise ValueError(f"need {n} holdout items but found {found}")
    return pool.withColumn("order_key", order_key(key, seed)).orderBy("order_key", key).limit(n)


def split(df: DataFrame, key: str, weights: dict[str, float] | None = None, seed: int = 0, out: str = "split") -> DataFrame:
    """Assign each key to a part by its own hash: no shuffle, stable when rows are added."""
    parts = list((weights or {"train": 90, "val": 5, "test": 5}).items())
    return df.withColumn(out, choose(key, "split", parts, seed))


def epoch_sample(df: DataFrame, key: str, ratio: float = 1, replicas: int = 1, epoch: int = 0, rank: int | None = None, blocks: int | None = None) -> DataFrame:
    """Order of one epoch: ``key, copy_pos, position, rank, rank_pos``.

    ``total = ceil(n ratio / replicas) * replicas`` positions index the items modulo ``n`` and are permuted by a
    bijection keyed by the epoch; every ``replicas``-th goes to a rank. Items are ranked once, by ``key``; the copies
    of an item and their places are arithmetic, so copies are neither sorted nor shuffled.
    """
    keys = cut_lineage(df.select(key))
    total_items = keys.count()
    if total_items == 0:
        raise ValueError("no items to sample")
    total = math.ceil(total_items * ratio / replicas) * replicas
    items = cut_lineage(position_by(keys, key, None, "_idx", blocks))
    copies = F.sequence(F.col("_idx"), F.lit(total - 1).cast("bigint"), F.lit(total_items).cast("bigint"))
    placed = items.where(F.col("_idx") < total).select(key, F.explode(copies).alias("copy_pos"))
    ranked = permuted(placed, "copy_pos", total, "epoch", epoch).withColumns(
        {
            "rank": (F.col("position") % replicas).cast("int"),
            "rank_pos": F.floor(F.col("position") / replicas).cast("bigint"),
        }
    )
    return ranked if rank is None else ranked.where(F.col("rank") == rank)


def batch(sample: DataFrame, size: int, drop_last: bool = True) -> DataFrame:
    """Consecutive batches per rank; a short last batch is dropped unless asked for.

    To know which is short the sample is read twice, so it is written first.
    """
    sample = sample if not drop_last else cut_lineage(sample)
    batched = sample.withColumn("batch", F.floor(F.col("rank_pos") / size).cast("bigint"))
    if not drop_last:
        return batched
    sizes = sample.groupBy("rank").agg(F.floor(F.count(F.lit(1)) / size).alias("_full"))
    return batched.join(sizes, "rank").where(F.col("batch") < F.col("_full")).drop("_full")


def epoch_plan(n_items: int, ratio: float, batch_size: int, replicas: int, total_iters: int) -> dict[str, int]:
    """Iterations per epoch and the number of epochs a run of ``total_iters`` needs."""
    per_epoch = math.ceil(n_items * ratio / (batch_size * replicas))
    return {"iters_per_epoch": per_epoch, "total_epochs": math.ceil(total_iters / per_epoch)}


def worker_seed(rank: int, worker: int, workers_per_rank: int, seed: int) -> int:
    return workers_per_rank * rank + worker + seed


def degradation_plan(df: DataFrame, key: str, config: dict = DEGRADATION, seed: int = 0) -> DataFrame:
    """Seeded degradation parameters per item: one small and one large set, and shared coins."""
    draws: dict[str, Column] = {
        "flip": uniform(key, "flip", seed) < 0.5,
        "motion": uniform(key, "motion", seed) < config["motion_prob"],
        "gray": uniform(key, "gray", seed) < config["gray_prob"],
        "jitter": uniform(key, "jitter", seed) < config["jitter_prob"],
    }
    shift = config["jitter_shift"]
    for c in range(3):
        draws[f"jitter_{c}"] = uniform_range(key, f"jitter{c}", -shift, shift, seed)
    for size in ("small", "large"):
        spec = config[size]
        draws[f"{size}_kernel"] = choose(key, f"{size}:kernel", list(config["kernels"]), seed)
        draws[f"{size}_sigma_x"] = uniform_range(key, f"{size}:sx", *spec["sigma"], seed)
        draws[f"{size}_sigma_y"] = uniform_range(key, f"{size}:sy", *spec["sigma"], seed)
        draws[f"{size}_theta"] = uniform_range(key, f"{size}:theta", -math.pi, math.pi, seed)
        draws[f"{size}_scale"] = uniform_range(key, f"{size}:scale", *spec["scale"], seed)
        draws[f"{size}_noise"] = uniform_range(key, f"{size}:noise", *spec["noise"], seed)
        draws[f"{size}_quality"] = F.floor(uniform_range(key, f"{size}:quality", *spec["quality"], seed)).cast("int")
    return df.withColumns(draws)


def _gauss(size: int, sx: float, sy: float, theta: float) -> np.ndarray:
    axis = np.arange(size) - (size - 1) / 2
    x, y = np.meshgrid(axis, axis)
    c, s = np.cos(theta), np.sin(theta)
    u, v = c * x + s * y, -s * x + c * y
    kernel = np.exp(-0.5 * ((u / sx) ** 2 + (v / sy) ** 2))
    return kernel / kernel.sum()


def _area_matrix(n_in: int, n_out: int) -> np.ndarray:
    """Mean over the source span of each target pixel."""
    edges = np.linspace(0, n_in, n_out + 1)
    cells = np.arange(n_in)
    cover = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    cover = np.clip(cover, 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def _linear_matrix(n_in: int, n_out: int) -> np.ndarray:
    at = np.clip((np.arange(n_out) + 0.5) * n_in / n_out - 0.5, 0, n_in - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, n_in - 1)
    m = np.zeros((n_out, n_in))
    m[np.arange(n_out), low] += 1 - (at - low)
    m[np.arange(n_out), high] += at - low
    return m


def _blur_kernel(row, size: int, motion: list[np.ndarray]) -> np.ndarray:
    if row.motion >= 0:
        return motion[row.motion]
    iso = row.kernel == "iso"
    return _gauss(size, row.sigma_x, row.sigma_x if iso else row.sigma_y, 0.0 if iso else row.theta)


def _blurred(planes: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation of a stack of planes of one shape with one kernel, mirrored at the borders."""
    rows, cols = kernel.shape
    reach = ((0, 0), (rows // 2, rows - 1 - rows // 2), (cols // 2, cols - 1 - cols // 2))
    # a small plane is mirrored as often as the kernel reaches
    padded = np.pad(planes, reach, mode="reflect" if min(planes.shape[1:]) > 1 else "edge")
    out = np.zeros(planes.shape)
    for i in range(rows):
        windows = np.lib.stride_tricks.sliding_window_view(padded[:, i : i + planes.shape[1]], cols, axis=2)
        out += windows @ kernel[i]
    return out


def _degrade_planes(planes: np.ndarray, row, noise: list[np.ndarray], kernel: np.ndarray) -> np.ndarray:
    """The planes of one image in one shape: blur, area reduction, noise, linear enlargement."""
    h, w = planes.shape[1:]
    small = _area_matrix(h, row.small_h) @ _blurred(planes, kernel) @ _area_matrix(w, row.small_w).T
    small = np.clip(small + np.stack(noise).reshape(small.shape) * row.noise, 0, 255)
    return _linear_matrix(row.small_h, h) @ small @ _linear_matrix(row.small_w, w).T


def normal_noise(key: Column, count: Column, seed: int = 0) -> Column:
    """Array of standard normal draws by Box and Muller's rule, the k-th from the uniform draws of ``key:k``."""
    draw = lambda k, tag: uniform(F.concat_ws(":", key, k.cast("string")), tag, seed)
    one = lambda k: F.sqrt(-2.0 * F.log(1.0 - draw(k, "n1"))) * F.cos(2.0 * math.pi * draw(k, "n2"))
    return F.transform(F.sequence(F.lit(0), count - 1), one)


#: Planes that a worker holds results of at a time.
SLICE_PLANES = 256


def in_slices(batches: Iterable[pd.DataFrame], rows: int = SLICE_PLANES) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in frames of at most ``rows``, each numbered from zero."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows].reset_index(drop=True)


def degrade(planes: DataFrame, plan: DataFrame, kernel_size: int = 41, seed: int = 0, motion_kernels: list[np.ndarray] | None = None) -> DataFrame:
    """Apply blur, down- and up-scaling, noise, jitter and gray of a plan to planes in [0, 255].

    ``plan``: ``img, kernel, sigma_x, sigma_y, theta, scale, noise, jitter, jitter_0..2, gray`` and optionally
    ``motion``. Where that is true and ``motion_kernels`` (a short list) are given, one of them, drawn by the image,
    takes the place of the blur kernel. Noise depends on (seed, image, channel, pixel) alone. Planes of one image and
    shape are worked on as a stack. The JPEG step of a plan is not applied. A null coin is false; a plane whose
    image has no plan row ends the job.
    """
    motion_list = [np.asarray(k, dtype=float) for k in motion_kernels or []]
    joined = planes.join(plan, "img", "left")
    joined = joined.withColumn("kernel", F.coalesce("kernel", F.raise_error(F.lit("an image has no degradation plan"))))
    joined = joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("gray", "jitter")})
    drawn = uniform_int(F.col("img"), "motion:kernel", 0, max(0, len(motion_list) - 1), seed).cast("int")
    moving = F.coalesce(F.col("motion"), F.lit(False)) if motion_list and "motion" in plan.columns else F.lit(False)
    reduced = lambda side: F.greatest(F.lit(1), F.floor(F.col(side) / F.col("scale"))).cast("int")
    joined = joined.withColumns({"motion": F.when(moving, drawn).otherwise(-1), "small_h": reduced("h"), "small_w": reduced("w")})
    key = F.concat_ws(":", F.col("img").cast("string"), F.col("ch").cast("string"))
    joined = joined.withColumn("_noise", normal_noise(key, F.col("small_h") * F.col("small_w"), seed))
    fields = [c for c in joined.columns if c not in ("plane", "_noise")]

    def run(batches):
        for rows in in_slices(batches):
            out = [None] * len(rows)
            stacks: dict = {}
            for nr, row in enumerate(rows.itertuples(index=False)):
                stacks.setdefault((row.img, row.h, row.w), []).append((nr, row))
            for (_, h, w), stack in stacks.items():
                first = stack[0][1]
                planes = np.stack([np.asarray(row.plane, dtype=float).reshape(h, w) for _, row in stack])
                done = _degrade_planes(planes, first, [np.asarray(rows["_noise"].iat[nr]) for nr, _ in stack], _blur_kernel(first, kernel_size, motion_list))
                for (nr, _), plane in zip(stack, done):
                    out[nr] = plane.ravel()
            yield rows[fields].assign(plane=out)

    schema = joined.select(*fields, F.col("plane").cast("array<double>").alias("plane")).schema
    shift = F.when(F.col("jitter"), F.coalesce(F.get(F.array("jitter_0", "jitter_1", "jitter_2"), F.col("ch")), F.lit(0.0))).otherwise(F.lit(0.0))
    limit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))

    def jittered(rows: DataFrame) -> DataFrame:
        moved = rows.mapInPandas(run, schema).withColumn("_s", shift)
        return moved.withColumn("plane", F.transform("plane", lambda v: limit(v + F.col("_s"))))

    final = lambda p: F.transform(p, lambda v: limit(F.round(v)))
    # Written once; colour and gray images part afterwards.
    moved = cut_lineage(jittered(joined).select("img", "ch", "h", "w", "gray", "plane"))
    colour = moved.where(~F.col("gray")).select("img", "ch", "h", "w", final(F.col("plane")).alias("plane"))
    weight = F.coalesce(F.get(F.lit(list(LUMA_GRAY)), F.col("ch")), F.lit(0.0))
    grays = moved.where("gray").select("img", "ch", "h", "w", weight.alias("_w"), "plane")
    stacked = grays.groupBy("img").agg(
        F.collect_list(F.struct("ch", "h", "w")).alias("c"),
        F.sort_array(F.collect_list(F.struct("ch", F.transform("plane", lambda v: v * F.col("_w")).alias("p")))).alias("s"),
    )
    # Not a length of 2^31 - 1: added to the start it would run over, and the slice be empty.
    mixed = F.aggregate(
        F.slice("s", F.lit(2), F.size("s")), F.get("s", F.lit(0))["p"], lambda acc, s: F.zip_with(acc, s["p"], lambda a, b: a + b)
    )
    gray = stacked.select("img", F.explode("c").alias("c"), mixed.alias("plane")).select(
        "img", "c.ch", "c.h", "c.w", final(F.col("plane")).alias("plane")
    )
    return colour.unionByName(gray)


def crop_plan(pairs: DataFrame, size: int, scale: int, key: str = "key", seed: int = 0) -> DataFrame:
    """One random window shared by input and reference, with flip and rotation coins.

    Rows whose sizes do not match keep ``status`` = ``scale_mismatch`` or ``too_small`` and no window.
    """
    patch = size // scale
    status = (
        F.when((F.col("gt_h") != F.col("lq_h") * scale) | (F.col("gt_w") != F.col("lq_w") * scale), "scale_mismatch")
        .when((F.col("lq_h") < patch) | (F.col("lq_w") < patch), "too_small")
        .otherwise("ok")
    )
    judged = pairs.withColumn("status", status)
    ok = F.col("status") == "ok"
    pick = lambda tag, side: F.when(ok, uniform_int(key, tag, 0, F.col(side) - patch, seed).cast("int"))
    coin = lambda tag: F.when(ok, uniform(key, tag, seed) < 0.5)
    return judged.withColumns({"top": pick("top", "lq_h"), "left": pick("left", "lq_w")}).withColumns(
        {
            "top_gt": F.col("top") * scale,
            "left_gt": F.col("left") * scale,
            "hflip": coin("hflip"),
            "vflip": coin("vflip"),
            "rot90": coin("rot90"),
        }
    )


def mod_crop(h: Column, w: Column, scale: int) -> tuple[Column, Column]:
    """Largest height and width that ``scale`` divides."""
    return h - h % scale, w - w % scale


def calibration_sample(df: DataFrame, n: int, order: str = "path", readable: Column | None = None, fallback: int = 10, seed: int = 42, size: int = 8) -> DataFrame:
    """First ``n`` readable items in ``order``; if there are none, ``fallback`` seeded uniform rows in [-1, 1].

    The columns are those of ``df`` and ``values``, which only the seeded rows have; those have no others but ``order``.
    """
    pool = df if readable is None else df.where(readable)
    drawn = pool.orderBy(order).limit(n).withColumn("values", F.lit(None).cast("array<double>"))
    if not drawn.isEmpty():
        return drawn
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: uniform(F.col("id"), F.concat(F.lit("calib:"), i.cast("string")), seed) * 2.0 - 1.0,
    )
    seeded = df.sparkSession.range(fallback).select(F.format_string("synthetic_%02d", "id").alias(order), cells.alias("values"))
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields if f.name != order]
    return seeded.select("*", *absent).select(*df.columns, "values")
