"""Image-quality scores of plane pairs ``pair, ch, h, w, a, b``, and user-registered metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .pixels import LUMA_BT601, by_shape, pair_pixels, sharpness_of

SSIM_WINDOW, SSIM_SIGMA = 11, 1.5
SSIM_C1, SSIM_C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def pair_luma(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """Replace the B, G, R planes of each pair by its luma plane."""
    picks = [F.max(F.when(F.col("ch") == c, F.struct("h", "w", "a", "b"))).alias(f"_{c}") for c in range(3)]
    wide = pairs.groupBy(key).agg(*picks)

    named = wide.select(key, F.lit(0).alias("ch"), "_0.h", "_0.w", *[F.col(f"_{c}.{s}").alias(f"{s}{c}") for c in range(3) for s in "ab"])

    def luma(side: str) -> Column:
        zipped = F.arrays_zip(*[f"{side}{c}" for c in range(3)])
        w = LUMA_BT601
        return F.transform(
            zipped, lambda p: p[f"{side}0"] / 255 * w[0] + p[f"{side}1"] / 255 * w[1] + p[f"{side}2"] / 255 * w[2] + 16.0
        )

    return named.select(key, "ch", "h", "w", luma("a").alias("a"), luma("b").alias("b"))


def psnr(pairs: DataFrame, crop_border: int = 0, luma: bool = False, key: str = "pair") -> DataFrame:
    """``20 log10(255 / rmse)`` per pair over all channels; infinite for equal images."""
    source = pair_luma(pairs, key) if luma else pairs
    mse = pair_pixels(source, [key], crop_border).groupBy(key).agg(F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2))).alias("mse"))
    value = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(20.0 * F.log10(F.lit(255.0) / F.sqrt("mse")))
    return mse.select(key, value.alias("psnr"))


def _ssim_stack(stack: np.ndarray, border: int) -> np.ndarray:
    """Mean SSIM of stacked pairs: rows hold plane a above plane b."""
    h = stack.shape[1] // 2
    a, b = stack[:, :h], stack[:, h:]
    if border:
        a, b = a[:, border:-border, border:-border], b[:, border:-border, border:-border]
    if min(a.shape[1:]) < SSIM_WINDOW:
        return np.full(len(stack), np.nan)
    axis = np.arange(SSIM_WINDOW) - SSIM_WINDOW // 2
    line = np.exp(-(axis**2) / (2 * SSIM_SIGMA**2))
    line /= line.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        rows, cols = x.shape[1] - SSIM_WINDOW + 1, x.shape[2] - SSIM_WINDOW + 1
        down = sum(k * x[:, i : i + rows] for i, k in enumerate(line))
        return sum(k * down[:, :, i : i + cols] for i, k in enumerate(line))

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    score = ((2 * ma * mb + SSIM_C1) * (2 * cov + SSIM_C2)) / ((ma**2 + mb**2 + SSIM_C1) * (va + vb + SSIM_C2))
    return score.mean(axis=(1, 2))


def ssim(pairs: DataFrame, crop_border: int = 0, luma: bool = False, key: str = "pair") -> DataFrame:
    """Structural similarity per pair, mean over channels; null when a plane is smaller than the window."""

    @F.pandas_udf("double")
    def measure(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        both = pd.Series([np.concatenate([x, y]) for x, y in zip(a, b)], dtype=object)
        return pd.Series(by_shape(both, h * 2, w, lambda s: _ssim_stack(s, crop_border)), dtype=float)

    source = pair_luma(pairs, key) if luma else pairs
    scored = source.select(key, F.nanvl(measure("a", "b", "h", "w"), F.lit(None)).alias("_s"))
    return scored.groupBy(key).agg(F.avg("_s").alias("ssim"))


def quality_report(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """Sharpness before and after, gain and tone fidelity of ``orig, enhanced`` image pairs.

    ``pairs`` holds one row per channel (0 is luma, the others chroma) with planes ``a`` (original)
    and ``b`` (enhanced).
    """
    luma = pairs.where("ch = 0").select(key, sharpness_of("a").alias("so"), sharpness_of("b").alias("se"))
    drift = (
        pair_pixels(pairs.where("ch > 0"), [key]).groupBy(key).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("drift"))
    )
    gain = (F.col("se") - F.col("so")) / F.greatest(F.col("so"), F.lit(1e-5)) * 100.0
    clip = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    return luma.join(drift, key, "left").select(
        key,
        F.bround("so", 1).alias("orig_sharpness"),
        F.bround("se", 1).alias("enh_sharpness"),
        F.bround(clip(gain, 0.0, 1000.0), 1).alias("sharpness_gain_pct"),
        F.bround(clip(100.0 - F.col("drift") * 1.5, 70.0, 99.9), 1).alias("tone_fidelity_pct"),
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos`` of two vectors; null when one has no direction."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )
    return 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def identity_distance(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``distance`` = ``1 - cos`` of two feature vectors."""
    return pairs.withColumn("distance", cosine_distance(F.col(a), F.col(b)))


def identity_loss(pairs: DataFrame, weight: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Mean distance times ``weight``."""
    return identity_distance(pairs).groupBy(*(by or [])).agg((F.avg("distance") * weight).alias("identity_loss"))


# ---------------------------------------------------------------------------
# registry

Metric = Callable[..., DataFrame]
_METRICS: dict[str, Metric] = {}


def register_metric(name: str) -> Callable[[Metric], Metric]:
    """Register ``fn(pairs, **options) -> DataFrame(pair, <value>)``; a taken name is an error."""

    def add(fn: Metric) -> Metric:
        if name in _METRICS:
            raise KeyError(f"metric {name!r} is already registered")
        _METRICS[name] = fn
        return fn

    return add


def metric(name: str) -> Metric:
    if name not in _METRICS:
        raise KeyError(f"metric {name!r} is not registered; known: {sorted(_METRICS)}")
    return _METRICS[name]


def evaluate(pairs: DataFrame, metrics: dict[str, dict], key: str = "pair") -> DataFrame:
    """Mean of each named metric over all pairs: ``metric, mean_value, samples``."""
    parts = None
    for label, options in metrics.items():
        options = dict(options)
        fn = metric(options.pop("type", label))
        scored = fn(pairs, key=key, **options)
        value = next(c for c in scored.columns if c != key)
        part = scored.agg(F.avg(value).alias("mean_value"), F.count(value).alias("samples")).select(
            F.lit(label).alias("metric"), "mean_value", "samples"
        )
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("no metrics given")
    return parts


register_metric("psnr")(psnr)
register_metric("ssim")(ssim)
