"""Fixed schemas. Everything not listed here is inspected from the data."""

from __future__ import annotations

from pyspark.sql import types as T

MANIFEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("input_path", T.StringType()),
        T.StructField("reference_path", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)

POSTS = T.ArrayType(
    T.StructType([T.StructField("id", T.LongType()), T.StructField("file_url", T.StringType())])
)

LISTING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
    ]
)

# Image suffixes accepted by manifests, ingest and holdout selection.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")

# Size limits of the ingest and upload guards.
MAX_DOWNLOAD_BYTES = 5 * 1024 * 1024
MAX_UPLOAD_BYTES = 15 * 1024 * 1024
MAX_PIXELS = 16_000_000

# Curation thresholds.
MIN_SIDE = 128
MIN_COVERAGE = 0.15
MIN_SHARPNESS = 80.0

# The three request presets.
PRESETS = {
    "Modern Portrait": dict(w=0.6, skin_grain=0.15, eye_enhancement=True, color_match=True,
                            enable_eyes=True, enable_lips=True, enable_skin=True),
    "Old Photo Restoration": dict(w=0.85, skin_grain=0.05, eye_enhancement=True, color_match=True,
                                  enable_eyes=True, enable_lips=True, enable_skin=True),
    "Game / Anime Character": dict(w=0.3, skin_grain=0.0, eye_enhancement=False, color_match=False,
                                   enable_eyes=False, enable_lips=False, enable_skin=False),
}

# Blend weight of each of the 19 segmentation classes.
CLASS_WEIGHTS = (0, 255, 255, 255, 255, 255, 255, 255, 255, 255, 255, 255, 255, 255, 0, 255, 0, 0, 0)

# Degradation ranges of the small and the large training set.
DEGRADATION = {
    "kernels": (("iso", 0.5), ("aniso", 0.5)),
    "motion_prob": 0.15,
    "small": dict(sigma=(0.1, 10.0), scale=(1.0, 20.0), noise=(0.0, 30.0), quality=(10, 70)),
    "large": dict(sigma=(1.0, 15.0), scale=(4.0, 30.0), noise=(0.0, 30.0), quality=(5, 50)),
    "gray_prob": 0.01,
    "jitter_prob": 0.3,
    "jitter_shift": 20.0,
}
