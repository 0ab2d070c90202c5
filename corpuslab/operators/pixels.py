"""Plane tables. A plane is one channel of one image: ``img, ch, h, w, plane array<double>``.

Statistics explode the array and aggregate in the same stage, so only partial sums are shuffled.
Stencils need neighbours: they run as Arrow batches on whole planes, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

# Luma weights in B, G, R order.
LUMA_BT601 = (24.966, 128.553, 65.481)
LUMA_GRAY = (0.1140, 0.5870, 0.2989)


def explode_planes(planes: DataFrame, column: str = "plane", out: str = "v") -> DataFrame:
    """Long pixel table: the other columns plus ``y, x, v``."""
    others = [c for c in planes.columns if c != column]
    flat = planes.select(*others, F.posexplode(column).alias("_p", out))
    return flat.select(*others, F.floor(F.col("_p") / F.col("w")).cast("int").alias("y"), (F.col("_p") % F.col("w")).cast("int").alias("x"), out)


def channels_wide(planes: DataFrame) -> DataFrame:
    """One row per image with its first three planes as ``p0, p1, p2`` and the channel count."""
    picks = [F.max(F.when(F.col("ch") == c, F.struct("h", "w", "plane"))).alias(f"_{c}") for c in range(3)]
    wide = planes.groupBy("img").agg(F.count(F.lit(1)).alias("channels"), *picks)
    shape = F.coalesce("_0", "_1", "_2")
    return wide.select("img", "channels", shape["h"].alias("h"), shape["w"].alias("w"), *[F.col(f"_{c}.plane").alias(f"p{c}") for c in range(3)])


def to_luma(planes: DataFrame, mode: str | list[str] = "bt601") -> DataFrame:
    """Luma plane of each image from its B, G, R planes in [0, 255]; null when a channel is missing.

    Several modes give a column each, named by the mode, from one pass.
    """
    modes = [mode] if isinstance(mode, str) else mode
    if not set(modes) <= {"bt601", "gray"}:
        raise ValueError(f"unknown luma mode: {mode}")

    def mix(mode: str) -> Column:
        weights, scale, base = (LUMA_BT601, 255.0, 16.0) if mode == "bt601" else (LUMA_GRAY, 1.0, 0.0)
        return F.transform(
            F.arrays_zip("p0", "p1", "p2"),
            lambda p: p["p0"] / scale * weights[0] + p["p1"] / scale * weights[1] + p["p2"] / scale * weights[2] + base,
        )

    return channels_wide(planes).select("img", "h", "w", *[mix(m).alias("plane" if isinstance(mode, str) else m) for m in modes])


def rescale_planes(planes: DataFrame, mean: list[float], std: list[float], inverse: bool = False, swap: bool = False) -> DataFrame:
    """``(v/255 - mean)/std`` per channel; inverse clips to [0, 1], times 255, rounded.

    ``swap`` turns B, G, R order into R, G, B (and back) by renumbering channels.
    """
    ch = F.when(F.col("ch") < 3, 2 - F.col("ch")).otherwise(F.col("ch")) if swap else F.col("ch")
    moved = planes.withColumn("ch", ch.cast("int"))
    m, s = F.get(F.lit(mean), F.col("ch")), F.get(F.lit(std), F.col("ch"))
    if inverse:
        back = lambda v: F.round(F.least(F.greatest(v * s + m, F.lit(0.0)), F.lit(1.0)) * 255.0)
        return moved.withColumn("plane", F.transform("plane", back))
    return moved.withColumn("plane", F.transform("plane", lambda v: (v / 255.0 - m) / s))


def channel_moments(planes: DataFrame, ddof: int = 1, eps: float = 1e-5, also: dict[str, tuple[int, float]] | None = None) -> DataFrame:
    """Mean and ``sqrt(variance + eps)`` of each channel of each image; ``also`` names further (ddof, eps) columns."""
    spread = lambda ddof, eps: F.sqrt((F.var_samp("v") if ddof == 1 else F.var_pop("v")) + F.lit(eps))
    return (
        planes.select("img", "ch", F.explode("plane").alias("v"))
        .groupBy("img", "ch")
        .agg(F.avg("v").alias("mean"), spread(ddof, eps).alias("std"), *[spread(*v).alias(k) for k, v in (also or {}).items()])
    )


def transfer_moments(content: DataFrame, style: DataFrame, blend: float = 1.0, floor: float = 1e-5) -> DataFrame:
    """Give each content channel the style channel's mean and deviation, clip to [0, 255], blend."""
    def moments(df: DataFrame, tag: str) -> DataFrame:
        m = channel_moments(df, ddof=0, eps=0.0)
        return m.select("img", "ch", F.col("mean").alias(f"_m{tag}"), F.col("std").alias(f"_s{tag}"))

    joined = content.join(moments(content, "c"), ["img", "ch"]).join(moments(style, "s"), ["img", "ch"])
    gain = F.col("_ss") / F.greatest(F.col("_sc"), F.lit(floor))

    def move(v: Column) -> Column:
        matched = F.least(F.greatest((v - F.col("_mc")) * gain + F.col("_ms"), F.lit(0.0)), F.lit(255.0))
        return v * (1.0 - blend) + matched * blend

    return joined.withColumn("plane", F.transform("plane", move)).select(*content.columns)


def pair_pixels(pairs: DataFrame, keys: list[str], border: int = 0, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pixels of plane pairs ``a, b``; arrays of different length fail, a border may be cut."""
    same = F.when(F.size("a") == F.size("b"), F.arrays_zip("a", "b", *extra)).otherwise(
        F.raise_error(F.lit("planes of a pair differ in shape"))
    )
    flat = pairs.select(*keys, "h", "w", F.posexplode(same).alias("_p", "z"))
    if border:
        y, x = F.floor(F.col("_p") / F.col("w")), F.col("_p") % F.col("w")
        flat = flat.where(
            (y >= border) & (y < F.col("h") - border) & (x >= border) & (x < F.col("w") - border)
        )
    return flat.select(*keys, "z.*")


LOSSES: dict[str, Callable[[Column], Column]] = {
    "l1": lambda d: F.abs(d),
    "mse": lambda d: d * d,
    "charbonnier": lambda d: F.sqrt(d * d + F.lit(1e-12)),
}


def pair_loss(pairs: DataFrame, kind: str, keys: list[str], weight: str | None = None, reduction: str = "mean") -> DataFrame:
    """Loss of each group of plane pairs; a weighted mean divides by the sum of weights."""
    return pair_losses(pairs, {"loss": (kind, weight, reduction)}, keys)


def pair_losses(pairs: DataFrame, losses: dict[str, tuple[str, str | None, str]], keys: list[str]) -> DataFrame:
    """Several losses, name -> (kind, weight column or none, reduction), from one pass over the pixels."""
    for kind, _, reduction in losses.values():
        if kind not in LOSSES or reduction not in ("mean", "sum"):
            raise ValueError(f"unknown loss or reduction: {kind}, {reduction}")
    weights = dict.fromkeys(weight for _, weight, _ in losses.values() if weight)
    pixels = pair_pixels(pairs, keys, extra=tuple(weights))

    def total(kind: str, weight: str | None, reduction: str) -> Column:
        loss = LOSSES[kind](F.col("a") - F.col("b"))
        if weight is None:
            return F.avg(loss) if reduction == "mean" else F.sum(loss)
        weighted = F.sum(loss * F.col(weight))
        return F.try_divide(weighted, F.sum(weight)) if reduction == "mean" else weighted

    return pixels.groupBy(*keys).agg(*[total(*spec).alias(name) for name, spec in losses.items()])


def gram(features: DataFrame) -> DataFrame:
    """``F F^T / (c h w)`` per image as rows ``img, c1, c2, value``.

    The planes of an image, which must be of one size, meet as arrays and are multiplied in Arrow batches.
    """
    stacked = features.groupBy("img").agg(F.sort_array(F.collect_list(F.struct("ch", "plane"))).alias("f"))
    whole = F.size(F.array_distinct(F.transform("f", lambda p: F.size(p["plane"])))) == 1
    checked = stacked.withColumn("f", F.when(whole, F.col("f")).otherwise(F.raise_error(F.lit("planes of an image differ in size"))))
    rows = checked.select("img", F.col("f.ch").alias("ch"), F.col("f.plane").alias("planes"))

    def multiply(frames):
        for frame in frames:
            out = []
            for img, ch, planes in zip(frame["img"], frame["ch"], frame["planes"]):
                f = np.stack([np.asarray(p, dtype=float) for p in planes])
                value = f @ f.T / f.size
                out += [(img, a, b, value[i, j]) for i, a in enumerate(ch) for j, b in enumerate(ch)]
            yield pd.DataFrame(out, columns=["img", "c1", "c2", "value"])

    kind = {f.name: f.dataType for f in features.schema.fields}
    schema = T.StructType([T.StructField("img", kind["img"]), T.StructField("c1", kind["ch"]), T.StructField("c2", kind["ch"]), T.StructField("value", T.DoubleType())])
    return rows.mapInPandas(multiply, schema)


def detect_gray(planes: DataFrame, threshold: float = 10.0) -> DataFrame:
    """``is_gray`` per image: mean population variance of the channel differences, or one channel."""
    wide = channels_wide(planes)
    pixels = wide.select("img", "channels", F.explode_outer(F.arrays_zip("p0", "p1", "p2")).alias("z"))
    gaps = [F.col(f"z.p{a}") - F.col(f"z.p{b}") for a, b in ((0, 1), (1, 2), (2, 0))]
    score = sum((F.var_pop(g) for g in gaps[1:]), F.var_pop(gaps[0])) / 3
    measured = pixels.groupBy("img", "channels").agg(score.alias("difference"))
    return measured.select(
        "img", "channels", "difference", ((F.col("channels") == 1) | (F.col("difference") <= threshold)).alias("is_gray")
    )


def class_areas(masks: DataFrame, weights: tuple[int, ...], border: int = 10) -> DataFrame:
    """Pixels and summed blend weight of each class per image; weight is 0 within ``border`` of an edge."""
    pixels = explode_planes(masks.select("img", "h", "w", "mask"), "mask", "cls")
    inside = (
        (F.col("y") >= border) & (F.col("y") < F.col("h") - border) & (F.col("x") >= border) & (F.col("x") < F.col("w") - border)
    )
    weight = F.when(inside, F.coalesce(F.get(F.lit(list(weights)), F.col("cls")), F.lit(0))).otherwise(F.lit(0))
    return pixels.groupBy("img", "cls").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum(weight).cast("bigint").alias("weight_sum")
    )


# ---------------------------------------------------------------------------
# stencils on whole planes


def by_shape(planes: pd.Series, h: pd.Series, w: pd.Series, fn: Callable[[np.ndarray], np.ndarray]) -> list:
    """Apply ``fn`` to stacks (n, h, w) of equally shaped planes of a batch; keeps row order."""
    results: list = [None] * len(planes)
    for (height, width), rows in pd.DataFrame({"h": h.to_numpy(), "w": w.to_numpy()}).groupby(["h", "w"]).groups.items():
        stack = np.stack([np.asarray(planes.iloc[i], dtype=float) for i in rows]).reshape(-1, int(height), int(width))
        for i, value in zip(rows, fn(stack)):
            results[i] = value
    return results


def _laplacian_variance(stack: np.ndarray) -> np.ndarray:
    # reflect-101 border; a side of length 1 has no neighbour to mirror
    pad = [(0, 0)] + [(1, 1)] * 2
    p = np.pad(stack, pad, mode="reflect" if min(stack.shape[1:]) > 1 else "edge")
    lap = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * stack
    return lap.reshape(len(stack), -1).var(axis=1)


def sharpness_of(plane: str = "plane") -> Column:
    """Variance of the Laplacian of a plane, as a column."""

    @F.pandas_udf("double")
    def measure(p: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(by_shape(p, h, w, _laplacian_variance), dtype=float)

    return measure(F.col(plane), F.col("h"), F.col("w"))


def sharpness(planes: DataFrame, plane: str = "plane") -> DataFrame:
    return planes.withColumn("sharpness", sharpness_of(plane)).drop(plane)


def total_variation(planes: DataFrame, weight: str | None = None, scale: float = 1.0) -> DataFrame:
    """Mean absolute step along x plus along y, optionally with a pixel weight plane."""

    def _tv(stack: np.ndarray, wt: np.ndarray | None) -> np.ndarray:
        dy, dx = np.abs(np.diff(stack, axis=1)), np.abs(np.diff(stack, axis=2))
        if wt is None:
            return dy.mean(axis=(1, 2)) + dx.mean(axis=(1, 2))
        wy, wx = wt[:, :-1, :], wt[:, :, :-1]
        return (dy * wy).sum(axis=(1, 2)) / wy.sum(axis=(1, 2)) + (dx * wx).sum(axis=(1, 2)) / wx.sum(axis=(1, 2))

    if weight is None:

        @F.pandas_udf("double")
        def measure(p: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
            return pd.Series(by_shape(p, h, w, lambda s: _tv(s, None)), dtype=float)

        value = measure("plane", "h", "w")
    else:

        @F.pandas_udf("double")
        def weighted(p: pd.Series, q: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
            both = pd.Series([np.concatenate([a, b]) for a, b in zip(p, q)], dtype=object)
            halves = lambda s: _tv(s[:, : s.shape[1] // 2], s[:, s.shape[1] // 2 :])
            return pd.Series(by_shape(both, h * 2, w, halves), dtype=float)

        value = weighted("plane", weight, "h", "w")
    return planes.withColumn("tv", value * F.lit(scale)).drop(*(["plane", weight] if weight else ["plane"]))


# The filters in use.
KERNELS = {
    "laplacian": ((0, 1, 0), (1, -4, 1), (0, 1, 0)),
    "sobel_x": ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1)),
    "sobel_y": ((-1, -2, -1), (0, 0, 0), (1, 2, 1)),
    "box3": ((1 / 9,) * 3,) * 3,
}


def gaussian_kernel(size: int, sigma: float) -> tuple[tuple[float, ...], ...]:
    axis = np.arange(size) - (size - 1) / 2
    line = np.exp(-(axis**2) / (2 * sigma**2))
    line /= line.sum()
    return tuple(tuple(row) for row in np.outer(line, line))


def _correlate(stack: np.ndarray, kernel: np.ndarray, border: str) -> np.ndarray:
    ky, kx = kernel.shape[0] // 2, kernel.shape[1] // 2
    mode = {"reflect101": "reflect", "zero": "constant", "replicate": "edge"}[border]
    p = np.pad(stack, [(0, 0), (ky, ky), (kx, kx)], mode=mode)
    h, w = stack.shape[1:]
    out = np.zeros_like(stack)
    for i, j in zip(*np.nonzero(kernel)):
        out += kernel[i, j] * p[:, i : i + h, j : j + w]
    return out


def convolve(planes: DataFrame, kernel, border: str = "reflect101") -> DataFrame:
    """Correlate every plane with one small kernel (a name from ``KERNELS`` or rows of numbers)."""
    if border not in ("reflect101", "zero", "replicate"):
        raise ValueError(f"unknown border: {border}")
    taps = np.array(KERNELS[kernel] if isinstance(kernel, str) else kernel, dtype=float)

    @F.pandas_udf("array<double>")
    def run(p: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(by_shape(p, h, w, lambda s: list(_correlate(s, taps, border).reshape(len(s), -1))), dtype=object)

    return planes.withColumn("plane", run("plane", "h", "w"))


# ---------------------------------------------------------------------------
# tiles and layers


def tile(images: DataFrame, size: int = 400, pad: int = 40, mode: str = "overlap") -> DataFrame:
    """Tile grid of each ``img, h, w``: core ``x, y, core_w, core_h`` and padded ``x1..y2``.

    ``fixed`` steps by ``size`` and pads around the core; ``overlap`` steps by ``size - 2 pad`` so
    the padded tile is ``size`` wide. An image that fits in one tile is not cut.
    """
    if mode not in ("fixed", "overlap"):
        raise ValueError(f"unknown tile mode: {mode}")
    step = size if mode == "fixed" else size - 2 * pad
    if step <= 0:
        raise ValueError("padding leaves no tile core")
    fits = (F.col("h") <= size) & (F.col("w") <= size)
    starts = lambda side: F.when(fits, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(side) - 1, F.lit(step)))
    grid = images.select("img", "h", "w", fits.alias("_fits"), F.posexplode(starts("h")).alias("row", "y")).select(
        "*", F.posexplode(starts("w")).alias("col", "x")
    )
    whole = lambda full, cut: F.when(F.col("_fits"), full).otherwise(cut).cast("int")
    return grid.select(
        "img", "h", "w", "row", "col", "x", "y",
        whole(F.col("w"), F.least(F.lit(step), F.col("w") - F.col("x"))).alias("core_w"),
        whole(F.col("h"), F.least(F.lit(step), F.col("h") - F.col("y"))).alias("core_h"),
        whole(F.lit(0), F.greatest(F.col("x") - pad, F.lit(0))).alias("x1"),
        whole(F.lit(0), F.greatest(F.col("y") - pad, F.lit(0))).alias("y1"),
        whole(F.col("w"), F.least(F.col("x") + step + pad, F.col("w"))).alias("x2"),
        whole(F.col("h"), F.least(F.col("y") + step + pad, F.col("h"))).alias("y2"),
    )


def cut_tiles(planes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Padded tile planes ``..., plane`` of width ``x2-x1``."""
    joined = tiles.join(planes.select("img", "ch", "plane"), "img")
    width = F.col("x2") - F.col("x1")
    rows = F.transform(
        F.sequence(F.col("y1"), F.col("y2") - 1),
        lambda y: F.slice("plane", y * F.col("w") + F.col("x1") + 1, width),
    )
    return joined.withColumn("plane", F.flatten(rows))


def stitch(tiles: DataFrame, scale: int = 1) -> DataFrame:
    """Pixels ``img, ch, y, x, v`` of the full image from (scaled) tile planes, halo dropped."""
    width = (F.col("x2") - F.col("x1")) * scale
    flat = tiles.select("img", "ch", "x", "y", "core_w", "core_h", "x1", "y1", width.alias("_tw"), F.posexplode("plane").alias("_p", "v"))
    ty, tx = F.floor(F.col("_p") / F.col("_tw")), F.col("_p") % F.col("_tw")
    oy = ty + F.col("y1") * scale
    ox = tx + F.col("x1") * scale
    core = (
        (oy >= F.col("y") * scale) & (oy < (F.col("y") + F.col("core_h")) * scale)
        & (ox >= F.col("x") * scale) & (ox < (F.col("x") + F.col("core_w")) * scale)
    )
    return flat.where(core).select("img", "ch", oy.cast("int").alias("y"), ox.cast("int").alias("x"), "v")


def stitch_coverage(pixels: DataFrame, images: DataFrame, scale: int = 1, channels: list[int] | None = None) -> DataFrame:
    """Images whose stitched pixels are missing or doubled: empty when every pixel is covered once.

    Every image is expected in every one of ``channels``, by default those seen anywhere in ``pixels``
    (or channel 0), so an image or channel without any pixel is reported too.
    """
    if channels is None:
        channels = sorted(row["ch"] for row in pixels.select("ch").distinct().collect()) or [0]
    per_pixel = pixels.groupBy("img", "ch", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    seen = per_pixel.groupBy("img", "ch").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("most"))
    want = F.col("h").cast("bigint") * F.col("w") * scale * scale
    due = images.select("img", "h", "w", F.explode(F.lit(channels)).alias("ch"))
    found = due.join(seen, ["img", "ch"], "left").fillna(0, ["distinct", "most"])
    return found.select("img", "ch", "distinct", "most", "h", "w").where((F.col("distinct") != want) | (F.col("most") > 1))


def stitch_planes(tiles: DataFrame, scale: int = 1) -> DataFrame:
    """Planes ``img, ch, h, w, plane`` of the full images from (scaled) tile planes that cover them once, halo dropped.

    What is shuffled are the rows of tile cores as arrays, never single pixels.
    """
    width = (F.col("x2") - F.col("x1")) * scale
    start = lambda k: (k + (F.col("y") - F.col("y1")) * scale) * width + (F.col("x") - F.col("x1")) * scale + 1
    lines = F.transform(F.sequence(F.lit(0), F.col("core_h") * scale - 1), lambda k: F.struct((F.col("y") * scale + k).alias("y"), (F.col("x") * scale).alias("x"), F.slice("plane", start(k), F.col("core_w") * scale).alias("v")))
    rows = tiles.select("img", "ch", F.inline(lines))
    whole = rows.groupBy("img", "ch").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("s"), F.countDistinct("y").cast("int").alias("h"))
    plane = F.flatten(F.transform("s", lambda e: e["v"]))
    return whole.select("img", "ch", "h", F.floor(F.size(plane) / F.col("h")).cast("int").alias("w"), plane.alias("plane"))


#: Rows of an image whose cover is counted together.
BAND = 64


def _cover(scale: int):
    """Covered pixels of a band and the most tiles on one, from the corners of its rectangles."""

    def run(key, table):
        img, ch, band = (k.as_py() for k in key)
        x, y, w, h = (np.asarray(table.column(c)).astype(np.int64) * scale for c in ("x", "y", "core_w", "core_h"))
        low, high = np.clip(y - band * BAND, 0, BAND), np.clip(y + h - band * BAND, 0, BAND)
        left = x.min()
        # Each rectangle is four steps; summed along both axes they are the counts.
        steps = np.zeros((BAND + 1, int((x + w).max() - left) + 1), np.int32)
        for rows, columns, sign in ((low, x, 1), (low, x + w, -1), (high, x, -1), (high, x + w, 1)):
            np.add.at(steps, (rows, columns - left), sign)
        counts = steps.cumsum(axis=0).cumsum(axis=1)
        found = [pa.array([v], table.schema.field(c).type) for c, v in (("img", img), ("ch", ch))]
        return pa.table([*found, pa.array([int((counts > 0).sum())]), pa.array([int(counts.max())])], names=["img", "ch", "distinct", "most"])

    return run


def tile_coverage(tiles: DataFrame, images: DataFrame, scale: int = 1, channels: list[int] | None = None) -> DataFrame:
    """:func:`stitch_coverage` of tiles that are not stitched yet: ``img, ch, distinct, most, h, w`` of images not covered once.

    Cores count as rectangles ``x, y, core_w, core_h`` in bands of rows, so no pixel becomes a row. Tiles of images
    that are not listed are not looked at.
    """
    if channels is None:
        channels = sorted(row["ch"] for row in tiles.select("ch").distinct().collect()) or [0]
    solid = tiles.where("core_w > 0 AND core_h > 0").select("img", "ch", "x", "y", "core_w", "core_h")
    bands = F.sequence(F.floor(F.col("y") * scale / BAND), F.floor(((F.col("y") + F.col("core_h")) * scale - 1) / BAND))
    schema = T.StructType([solid.schema["img"], solid.schema["ch"], T.StructField("distinct", T.LongType()), T.StructField("most", T.LongType())])
    cover = solid.withColumn("band", F.explode(bands)).groupBy("img", "ch", "band").applyInArrow(_cover(scale), schema)
    seen = cover.groupBy("img", "ch").agg(F.sum("distinct").alias("distinct"), F.max("most").alias("most"))
    want = F.col("h").cast("bigint") * F.col("w") * scale * scale
    due = images.select("img", "h", "w", F.explode(F.lit(channels)).alias("ch"))
    found = due.join(seen, ["img", "ch"], "left").fillna(0, ["distinct", "most"])
    return found.select("img", "ch", "distinct", "most", "h", "w").where((F.col("distinct") != want) | (F.col("most") > 1))


def composite_planes(base: DataFrame, layers: DataFrame) -> DataFrame:
    """Ordered blend of layer planes over base planes ``img, ch, h, w, plane``, clipped to [0, 255]; the same columns.

    ``layers``: ``img, ch, layer, y0, x0, h, w, plane, mask`` and optionally ``parse_mask``, used where it is smaller;
    ``mask`` has a weight for each pixel of the layer. What lies outside the base is cut off, a layer without a
    base is dropped. Rows of planes are shuffled as arrays, and the layers that touch a row are folded over it.
    """
    rows = lambda column: F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: F.slice(column, k * F.col("w") + 1, F.col("w")))
    none = F.array().cast("array<double>")
    bottom = base.select("img", "ch", "w", F.posexplode(rows("plane")).alias("y", "q")).select(
        "img", "ch", "y", F.lit(None).cast("bigint").alias("layer"), F.lit(0).alias("x"), none.alias("p"), F.col("q").cast("array<double>").alias("q")
    )
    mask = F.col("mask").cast("array<double>")
    if "parse_mask" in layers.columns:
        mask = F.when(F.col("parse_mask").isNull(), mask).otherwise(F.zip_with(mask, F.col("parse_mask").cast("array<double>"), lambda a, b: F.least(a, b)))
    maps = layers.withColumn("_m", mask).withColumns({
        "_p": F.transform("_m", lambda m: 1.0 - m), "_q": F.zip_with("_m", F.col("plane").cast("array<double>"), lambda m, v: m * v),
    })
    lines = F.arrays_zip(rows("_p").alias("p"), rows("_q").alias("q"))
    spread = maps.where("h > 0 AND w > 0").select("img", "ch", "layer", "x0", "y0", F.posexplode(lines).alias("k", "e"))
    cut = F.greatest(-F.col("x0"), F.lit(0))
    keep = lambda c: F.slice(F.col(f"e.{c}"), cut + 1, F.greatest(F.size(F.col(f"e.{c}")) - cut, F.lit(0))).alias(c)
    spread = spread.select("img", "ch", (F.col("y0") + F.col("k")).alias("y"), F.col("layer").cast("bigint"), F.greatest("x0", F.lit(0)).alias("x"), keep("p"), keep("q"))

    def blend(acc: Column, e: Column) -> Column:
        size = F.greatest(F.least(F.size(e["p"]), F.size(acc) - e["x"]), F.lit(0))
        mixed = F.zip_with(F.slice(acc, e["x"] + 1, size), F.arrays_zip(F.slice(e["p"], F.lit(1), size).alias("p"), F.slice(e["q"], F.lit(1), size).alias("q")), lambda b, m: b * m["p"] + m["q"])
        return F.concat(F.slice(acc, F.lit(1), e["x"]), mixed, F.slice(acc, e["x"] + size + 1, F.greatest(F.size(acc) - e["x"] - size, F.lit(0))))

    # The base has no layer number, so it comes first.
    stacks = bottom.unionByName(spread).groupBy("img", "ch", "y").agg(F.sort_array(F.collect_list(F.struct("layer", "x", "p", "q"))).alias("s"))
    folded = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.get("s", F.lit(0))["q"], blend)
    clipped = F.transform(folded, lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)))
    done = stacks.where(F.get("s", F.lit(0))["layer"].isNull()).select("img", "ch", "y", clipped.alias("v"))
    whole = done.groupBy("img", "ch").agg(F.sort_array(F.collect_list(F.struct("y", "v"))).alias("s"))
    return whole.select("img", "ch", F.size("s").alias("h"), F.size(F.get("s", F.lit(0))["v"]).alias("w"), F.flatten(F.transform("s", lambda e: e["v"])).alias("plane"))


def composite(base: DataFrame, layers: DataFrame, block: int = 256) -> DataFrame:
    """Ordered blend ``m f + (1-m) b`` of pixel layers over a base, clipped to [0, 255].

    ``base``: ``img, ch, y, x, v``; ``layers``: the same plus ``layer, mask`` and optional
    ``parse_mask``, used where it is smaller. A layer maps ``b`` to ``p b + q``; such maps compose,
    so a tall stack is folded in blocks of ``block`` layers first.
    """
    mask = F.col("mask")
    if "parse_mask" in layers.columns:
        mask = F.least(F.col("mask"), F.coalesce("parse_mask", "mask"))
    bottom = base.select("img", "ch", "y", "x", F.lit(-1).cast("bigint").alias("layer"), F.lit(0.0).alias("p"), F.col("v").cast("double").alias("q"))
    maps = layers.select("img", "ch", "y", "x", F.col("layer").cast("bigint"), (1.0 - mask).alias("p"), (mask * F.col("v")).alias("q"))
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("q"))
    merge = lambda acc, s: F.struct((acc["p"] * s["p"]).alias("p"), (acc["q"] * s["p"] + s["q"]).alias("q"))

    def fold(order: str) -> Column:
        return F.aggregate(F.sort_array(F.collect_list(F.struct(order, "p", "q"))), start, merge)

    pixel = ["img", "ch", "y", "x"]
    blocks = (
        bottom.unionByName(maps)
        .withColumn("_blk", F.floor(F.col("layer") / block))
        .groupBy(*pixel, "_blk")
        .agg(fold("layer").alias("m"))
        .select(*pixel, "_blk", "m.p", "m.q")
    )
    folded = blocks.groupBy(*pixel).agg(fold("_blk").alias("m"))
    covered = folded.where(F.col("m.p") == 0.0)
    return covered.select(*pixel, F.least(F.greatest(F.col("m.q"), F.lit(0.0)), F.lit(255.0)).alias("v"))
