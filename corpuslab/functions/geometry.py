"""Box arithmetic on columns. A box is a struct or a set of columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Shared area of two corner boxes, zero when they are apart."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def overlap_ratio(a: tuple[Column, ...], b: tuple[Column, ...], kind: str = "iou") -> Column:
    """Shared area over the union (``iou``) or over the first box, floored at 1 (``iof``)."""
    shared = intersection(a, b)
    if kind == "iou":
        return F.try_divide(shared, area(*a) + area(*b) - shared)
    if kind == "iof":
        return shared / F.greatest(area(*a), F.lit(1.0))
    raise ValueError(f"unknown overlap kind: {kind}")


def corners_to_centre(x1: Column, y1: Column, x2: Column, y2: Column) -> dict[str, Column]:
    return {"cx": (x1 + x2) / 2, "cy": (y1 + y2) / 2, "w": x2 - x1, "h": y2 - y1}


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def encode_offsets(box: tuple[Column, ...], prior: tuple[Column, ...], variances=(0.1, 0.2)) -> dict[str, Column]:
    """Offsets of a corner box against a centre-size prior."""
    centre = corners_to_centre(*box)
    pcx, pcy, pw, ph = prior
    v0, v1 = variances
    return {
        "dx": (centre["cx"] - pcx) / (v0 * pw),
        "dy": (centre["cy"] - pcy) / (v0 * ph),
        "dw": F.log(centre["w"] / pw) / v1,
        "dh": F.log(centre["h"] / ph) / v1,
    }


def decode_offsets(loc: tuple[Column, ...], prior: tuple[Column, ...], variances=(0.1, 0.2)) -> dict[str, Column]:
    """Inverse of :func:`encode_offsets`."""
    dx, dy, dw, dh = loc
    pcx, pcy, pw, ph = prior
    v0, v1 = variances
    return centre_to_corners(pcx + dx * v0 * pw, pcy + dy * v0 * ph, pw * F.exp(dw * v1), ph * F.exp(dh * v1))


def encode_points(points: Column, prior: tuple[Column, ...], variances=(0.1, 0.2)) -> Column:
    """Landmark array of ``struct<x,y>`` as offsets against a centre-size prior."""
    pcx, pcy, pw, ph = prior
    v0 = variances[0]
    return F.transform(
        points,
        lambda p: F.struct(((p["x"] - pcx) / (v0 * pw)).alias("x"), ((p["y"] - pcy) / (v0 * ph)).alias("y")),
    )


def decode_points(points: Column, prior: tuple[Column, ...], variances=(0.1, 0.2)) -> Column:
    pcx, pcy, pw, ph = prior
    v0 = variances[0]
    return F.transform(
        points, lambda p: F.struct((pcx + p["x"] * v0 * pw).alias("x"), (pcy + p["y"] * v0 * ph).alias("y"))
    )


def undo_letterbox(box: tuple[Column, ...], net: tuple[Column, Column], image: tuple[Column, Column]) -> dict[str, Column]:
    """Map a box on the padded (height, width) canvas back to the image, then clip."""
    (nh, nw), (ih, iw) = net, image
    gain = F.least(nh / ih, nw / iw)
    pad_x, pad_y = (nw - iw * gain) / 2, (nh - ih * gain) / 2
    x1, y1, x2, y2 = box
    moved = ((x1 - pad_x) / gain, (y1 - pad_y) / gain, (x2 - pad_x) / gain, (y2 - pad_y) / gain)
    return clip_box(moved, image)


def clip_box(box: tuple[Column, ...], image: tuple[Column, Column]) -> dict[str, Column]:
    height, width = image
    zero = F.lit(0.0)
    x1, y1, x2, y2 = box
    return {
        "x1": F.least(F.greatest(x1, zero), width.cast("double")),
        "y1": F.least(F.greatest(y1, zero), height.cast("double")),
        "x2": F.least(F.greatest(x2, zero), width.cast("double")),
        "y2": F.least(F.greatest(y2, zero), height.cast("double")),
    }


def grow_box(box: tuple[Column, ...], ratio: float, image: tuple[Column, Column], keep_aspect: bool = True) -> dict[str, Column]:
    """Enlarge by ``ratio`` per side, truncate to whole pixels, then clip to the image.

    With ``keep_aspect`` the short side grows until the enlarged box is square.
    """
    x1, y1, x2, y2 = box
    width, height = x2 - x1, y2 - y1
    grow_w = grow_h = F.lit(float(ratio))
    if keep_aspect:
        reach = 1 + 2 * ratio
        grow_w = F.greatest(F.lit(float(ratio)), (reach * height - width) / (2 * width))
        grow_h = F.greatest(F.lit(float(ratio)), (reach * width - height) / (2 * height))
    img_h, img_w = image
    return {
        "x1": F.greatest((x1 - grow_w * width).cast("int"), F.lit(0)),
        "y1": F.greatest((y1 - grow_h * height).cast("int"), F.lit(0)),
        "x2": F.least((x2 + grow_w * width).cast("int"), img_w.cast("int")),
        "y2": F.least((y2 + grow_h * height).cast("int"), img_h.cast("int")),
    }
