"""Detection tables: overlaps, matching to priors, suppression, one box per image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions import geometry
from .ordering import cut_lineage, join_facts
from .ranking import take_per_group

CORNERS = ("x1", "y1", "x2", "y2")

# A prior table up to this many rows (a few MB) may be broadcast.
MAX_BROADCAST_PRIORS = 100_000
#: Pairs of truth and prior, each with its truth, that one task holds.
TASK_PAIRS = 250_000

#: Boxes of one side of a cell that are compared in one task.
CELL_ROWS = 2048


def _cell_size(*tables: DataFrame) -> tuple[Column, Column]:
    """Grid cell = the larger root mean square box side of the tables, read in one aggregate.

    By Cauchy-Schwarz a table then covers at most four cells per box on average, whatever the spread
    of box sizes.
    """
    sides = None
    for i, df in enumerate(tables):
        part = df.select(F.lit(i).alias("t"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
        sides = part if sides is None else sides.unionByName(part)
    found = sides.groupBy("t").agg(F.avg(F.col("w") * F.col("w")).alias("w"), F.avg(F.col("h") * F.col("h")).alias("h")).collect()
    largest = lambda c: max([1e-6, *(r[c] ** 0.5 for r in found if r[c] is not None)])
    return F.lit(largest("w")), F.lit(largest("h"))


def _spread(df: DataFrame, corners: tuple[str, ...], cell_w: Column, cell_h: Column) -> DataFrame:
    """One row per grid cell a box touches."""
    x1, y1, x2, y2 = (F.col(c) for c in corners)
    xs = F.sequence(F.floor(x1 / cell_w), F.floor(F.greatest(x1, x2) / cell_w))
    ys = F.sequence(F.floor(y1 / cell_h), F.floor(F.greatest(y1, y2) / cell_h))
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def box_overlap(a: DataFrame, b: DataFrame, kind: str = "iou", on: tuple[str, ...] = ("img",), idx: str = "det_idx", min_overlap: float = 0.0) -> DataFrame:
    """Overlapping pairs of two box tables: ``on..., a_idx, b_idx, overlap``.

    A pair meets in the grid cells both boxes touch and is counted in one of them (the cell of its
    upper left shared corner), so a crowded image is split by place and pairs that are apart are
    never formed. Pairs that do not overlap are not returned: their overlap is 0.
    """
    left = a.select(*on, F.col(idx).alias("a_idx"), *[F.col(c).cast("double").alias(f"a_{c}") for c in CORNERS])
    right = b.select(*on, F.col(idx).alias("b_idx"), *[F.col(c).cast("double").alias(f"b_{c}") for c in CORNERS])
    scored = _met_pairs(left, right, on, kind, _cell_size(a, b))
    return scored.where(F.col("overlap") > min_overlap).select(*on, "a_idx", "b_idx", "overlap")


def _met_pairs(left: DataFrame, right: DataFrame, on: tuple[str, ...], kind: str, cell: tuple[Column, Column], wrap=None) -> DataFrame:
    """Pairs of ``a_`` and ``b_`` boxes that share area, each once, with ``overlap``.

    Boxes meet in cells. A crowded cell is dealt in parts of ``CELL_ROWS`` boxes of either side, and every part of
    one side meets every part of the other as a key of its own, so its pairs are formed in many tasks.
    """
    abox = tuple(F.col(f"a_{c}") for c in CORNERS)
    bbox = tuple(F.col(f"b_{c}") for c in CORNERS)
    left = _spread(left, tuple(f"a_{c}" for c in CORNERS), *cell)
    right = _spread(right, tuple(f"b_{c}" for c in CORNERS), *cell)
    here = (F.col("_cx") == F.floor(F.greatest(abox[0], bbox[0]) / cell[0])) & (
        F.col("_cy") == F.floor(F.greatest(abox[1], bbox[1]) / cell[1])
    )
    keys = [*on, "_cx", "_cy"]
    if wrap is None:
        left, right, parts = _dealt(left, right, keys)
        met = left.join(right, [*keys, *parts])
    else:
        met = left.join(wrap(right), keys)
    met = met.where(here & (geometry.intersection(abox, bbox) > 0))
    return met.withColumn("overlap", geometry.overlap_ratio(abox, bbox, kind))


def _dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the parts of their cells, where a cell is crowded; cells of one side only are dropped then."""
    side = lambda df, a, b: df.select(*keys, F.lit(a).alias("a"), F.lit(b).alias("b"))
    cells = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cells = cut_lineage(cells.where("a > 0 AND b > 0"))
    if (cells.agg(F.max(F.greatest("a", "b"))).first()[0] or 0) <= CELL_ROWS:
        return left, right, []
    parts = cells.select(*keys, *[F.ceil(F.col(c) / CELL_ROWS).cast("int").alias(f"_p{c}") for c in "ab"], *[F.col(c).alias(f"_n{c}") for c in "ab"])

    def deal(df: DataFrame, own: str, other: str) -> DataFrame:
        placed = join_facts(df, parts, keys, f"_n{own}")
        # A part by the box itself: any even spread will do.
        mine = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if df.schema[c].dataType.typeName() not in ("struct", "array", "map")]), F.col(f"_p{own}")).alias(f"_part_{own}")
        theirs = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"_p{other}").cast("bigint") - 1)).alias(f"_part_{other}")
        return placed.select(*df.columns, mine, theirs)

    return deal(left, "a", "b"), deal(right, "b", "a"), ["_part_a", "_part_b"]


def prior_grid(spark, image_h: int, image_w: int, steps: list[int], min_sizes: list[list[int]]) -> DataFrame:
    """Centre-size priors of a detector, relative to the image, numbered by level, row, column, size."""
    levels = [(k, step, -(-image_h // step), -(-image_w // step), sizes) for k, (step, sizes) in enumerate(zip(steps, min_sizes))]
    table = spark.createDataFrame(levels, "level int, step int, rows int, cols int, sizes array<int>")
    cells = (
        table.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
        .select("*", F.posexplode("sizes").alias("s", "size"))
    )
    start, base = None, 0
    for k, _, rows, cols, sizes in levels:
        hit = F.col("level") == k
        start = F.when(hit, F.lit(base)) if start is None else start.when(hit, F.lit(base))
        base += rows * cols * len(sizes)
    number = start + (F.col("i") * F.col("cols") + F.col("j")) * F.size("sizes") + F.col("s")
    return cells.select(
        number.cast("bigint").alias("prior_id"),
        ((F.col("j") + 0.5) * F.col("step") / image_w).alias("cx"),
        ((F.col("i") + 0.5) * F.col("step") / image_h).alias("cy"),
        (F.col("size") / F.lit(image_w)).alias("w"),
        (F.col("size") / F.lit(image_h)).alias("h"),
    )


def match_priors(truth: DataFrame, priors: DataFrame, threshold: float = 0.35, min_best: float = 0.2, variances=(0.1, 0.2)) -> DataFrame:
    """Label, encoded box and encoded landmarks of every prior in every image that has truths.

    ``truth``: ``img, det_idx, x1..y2, label`` and optionally ``points``, an array of ``struct<x, y>``;
    ``priors``: ``prior_id`` 0..n-1 and ``cx, cy, w, h``. Images where no truth reaches ``min_best`` get
    label 0 and zero offsets throughout. Only pairs that share area are shuffled; a truth travels with
    its pairs, and the priors of an image are made from its one row at the end.
    """
    size = priors.agg(F.count(F.lit(1)).alias("n"), F.max("prior_id").alias("last")).first()
    if not size["n"]:
        raise ValueError("no priors given")
    # a checked size: a detector's priors are broadcast, a larger table is joined by shuffle
    few = size["n"] <= MAX_BROADCAST_PRIORS
    small = F.broadcast if few else (lambda df: df)
    corners = priors.select(
        F.col("prior_id").alias("det_idx"),
        *[v.alias(k) for k, v in geometry.centre_to_corners(*[F.col(c) for c in ("cx", "cy", "w", "h")]).items()],
    )
    carried = ["label", *CORNERS, *(["points"] if "points" in truth.columns else [])]
    whole = truth.select("img", "det_idx", *CORNERS, F.struct("det_idx", *carried).alias("_t"))
    # priors are the same for every image, so pairs meet on the grid cell alone
    side = lambda df, tag: df.select(*[F.col(c).cast("double").alias(f"{tag}_{c}") for c in CORNERS], *[c for c in df.columns if c not in CORNERS])
    met = _met_pairs(side(whole, "a"), side(corners.withColumnRenamed("det_idx", "prior_id"), "b"), (), "iou", _cell_size(truth, corners), small if few else None)
    # Both aggregates below read the pairs.
    pairs = cut_lineage(met.select("img", "det_idx", "prior_id", "overlap", "_t"))
    # Pairs carry a truth each, so as many tasks as their number asks for; all that follows keeps to the image.
    parts = max(int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // TASK_PAIRS))

    # best prior per truth; a truth that meets none falls to the first prior with overlap 0
    none = F.struct(F.lit(0.0).alias("overlap"), F.lit(0).cast("bigint").alias("neg"))
    found = F.struct("overlap", (-F.col("prior_id")).alias("neg"))
    truths = (
        pairs.select("img", "det_idx", found.alias("m"), "_t")
        .unionByName(whole.select("img", "det_idx", none.alias("m"), "_t"))
        .repartition(parts, "img")
        .groupBy("img", "det_idx")
        .agg(F.max("m").alias("m"), F.first("_t").alias("_t"))
        .select("img", (-F.col("m.neg")).alias("prior_id"), (F.col("m.overlap") >= min_best).alias("_good"), "_t")
    )
    # a prior with pairs or claims: its last claim, or else its best truth
    claim = F.struct(F.lit(1).alias("claims"), F.lit(0.0).alias("overlap"), F.col("_t.det_idx").alias("turn"))
    pair = F.struct(F.lit(0).alias("claims"), "overlap", (-F.col("det_idx")).alias("turn"))
    matched = (
        pairs.select("img", "prior_id", pair.alias("_rank"), "overlap", F.lit(False).alias("_good"), "_t")
        .unionByName(truths.select("img", "prior_id", claim.alias("_rank"), F.lit(0.0).alias("overlap"), "_good", "_t"))
        .repartition(parts, "img")
        .groupBy("img", "prior_id")
        .agg(F.max_by("_t", "_rank").alias("t"), F.max("overlap").alias("overlap"), F.max("_good").alias("lifted"))
    )
    matched = matched.select("img", F.struct("prior_id", F.when(F.col("lifted"), 2.0).otherwise(F.col("overlap")).alias("overlap"), "t").alias("m"))
    # the row of an image: what its priors have, and the first truth for all others
    default = truths.groupBy("img").agg(F.min_by("_t", "_t.det_idx").alias("_first"), F.max("_good").alias("_valid"))
    images = matched.groupBy("img").agg(F.collect_list("m").alias("ms")).join(default, "img")
    ids = F.sequence(F.lit(0).cast("bigint"), F.lit(size["last"]).cast("bigint"))
    others = F.array_except(ids, F.transform("ms", lambda m: m["prior_id"]))
    blank = F.transform(others, lambda k: F.struct(k.alias("prior_id"), F.lit(0.0).alias("overlap"), F.col("_first").alias("t")))
    chosen = images.select("img", "_valid", F.inline(F.concat("ms", blank))).join(
        small(priors.select("prior_id", *[F.col(c).alias(f"_p{c}") for c in ("cx", "cy", "w", "h")])), "prior_id"
    )
    prior = tuple(F.col(f"_p{c}") for c in ("cx", "cy", "w", "h"))
    loc = geometry.encode_offsets(tuple(F.col(f"t.{c}") for c in CORNERS), prior, variances)
    if "points" in carried:
        zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        points = F.when(F.col("_valid"), geometry.encode_points(F.col("t.points"), prior, variances)).otherwise(F.transform("t.points", lambda _: zero))
    label = F.when(F.col("_valid") & (F.col("overlap") >= threshold), F.col("t.label")).otherwise(F.lit(0))
    return chosen.select(
        "img", "prior_id", F.col("t.det_idx").alias("det_idx"), label.cast("int").alias("label"),
        *[F.when(F.col("_valid"), v).otherwise(F.lit(0.0)).alias(k) for k, v in loc.items()],
        *([points.alias("points")] if "points" in carried else []),
    )


def largest_box(boxes: DataFrame, image_w: str = "img_w", image_h: str = "img_h") -> DataFrame:
    """Box with the largest area inside its image; ties go to the lowest index."""
    inside = geometry.clip_box(tuple(F.col(c) for c in CORNERS), (F.col(image_h), F.col(image_w)))
    size = geometry.area(*[inside[c] for c in CORNERS])
    return _one_per_image(boxes.withColumn("box_area", size), F.col("box_area"))


def center_box(boxes: DataFrame, center: tuple[float, float] | None = None, image_w: str = "img_w", image_h: str = "img_h") -> DataFrame:
    """Box whose centre is nearest to ``center`` (the image centre by default); ties go to the lowest index."""
    cx, cy = (F.col(image_w) / 2, F.col(image_h) / 2) if center is None else (F.lit(center[0]), F.lit(center[1]))
    gap = F.sqrt(F.pow((F.col("x1") + F.col("x2")) / 2 - cx, 2) + F.pow((F.col("y1") + F.col("y2")) / 2 - cy, 2))
    return _one_per_image(boxes.withColumn("center_dist", gap), -F.col("center_dist"))


def _one_per_image(boxes: DataFrame, preference: Column) -> DataFrame:
    """Highest preference per image as an aggregate: a crowded image is reduced before the shuffle."""
    others = [c for c in boxes.columns if c != "img"]
    best = F.max_by(F.struct(*others), F.struct(preference, -F.col("det_idx")))
    return boxes.groupBy("img").agg(best.alias("b")).select("img", "b.*")


_SLIM = ("img", "det_idx", "score", "_x1", "_y1", "_x2", "_y2")


def _hits(box: np.ndarray, kept: np.ndarray, limit: float) -> np.ndarray:
    """Which rows of ``box`` overlap any of ``kept`` by more than ``limit``."""
    span = np.minimum(box[:, None, 2:], kept[None, :, 2:]) - np.maximum(box[:, None, :2], kept[None, :, :2])
    shared = np.prod(np.clip(span, 0, None), axis=2)
    size = lambda b: (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return (shared / (size(box)[:, None] + size(kept)[None, :] - shared) > limit).any(axis=1)


def _keep_run(box: np.ndarray, earlier: np.ndarray, limit: float, chunk: int = 512) -> list[int]:
    """Greedy choice along boxes of one image in rank order, after the kept boxes ``earlier``."""
    kept: list[int] = []
    alive = np.ones(len(box), dtype=bool)
    for start in range(0, len(earlier), chunk):
        left = np.flatnonzero(alive)
        alive[left] = ~_hits(box[left], earlier[start : start + chunk], limit)
    left = np.flatnonzero(alive)
    while len(left):
        kept.append(int(left[0]))
        rest = left[1:]
        left = rest[~_hits(box[rest], box[left[:1]], limit)]
    return kept


def _keep_sorted(slim: DataFrame, limit: float) -> DataFrame:
    """Kept ``img, det_idx``. Rows arrive per image by rank, so only the kept boxes are held."""

    def run(batches):
        image, held = None, np.empty((0, 4))
        for rows in batches:
            out = []
            ids = rows["img"].to_numpy()
            box = rows[["_x1", "_y1", "_x2", "_y2"]].to_numpy(dtype=float)
            cuts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            for first, last in zip([0, *cuts], [*cuts, len(ids)]):
                if first == last:
                    continue
                if image is None or ids[first] != image:
                    image, held = ids[first], np.empty((0, 4))
                chosen = [first + k for k in _keep_run(box[first:last], held, limit)]
                held = np.concatenate([held, box[chosen]])
                out += chosen
            yield rows.iloc[out][["img", "det_idx"]]

    ranked = slim.repartition("img").sortWithinPartitions("img", F.desc("score"), "det_idx")
    return ranked.mapInPandas(run, slim.select("img", "det_idx").schema)


KEPT, GONE = 1, 2
#: Side of the first tiles in box sides (root mean square).
TILE_SIDES = 8


def _decide(box: np.ndarray, inside: np.ndarray, known: np.ndarray, limit: float) -> np.ndarray:
    """What is certain about the boxes of a tile, in rank order: KEPT, GONE or 0.

    All boxes that overlap one which lies ``inside`` the tile are here, so it is kept if nothing before it that
    may be kept overlaps it. Boxes that reach beyond the tile are in doubt, and so are those they overlap.
    """
    code, doubt, left = np.zeros(len(box), np.int8), np.zeros(len(box), bool), np.arange(len(box))
    while len(left):
        first, rest = left[0], left[1:]
        hit = _hits(box[rest], box[first : first + 1], limit)
        if known[first] or (inside[first] and not doubt[first]):
            code[first], code[rest[hit]] = KEPT, GONE
            left = rest[~hit]
        else:
            doubt[rest[hit]] = True
            left = rest
    return code


def _decide_tiles(limit: float):
    """Rows arrive per (img, tile) by rank; a tile that goes on in the next batch waits for it."""

    def run(batches):
        waiting = None
        for rows in batches:
            rows = rows if waiting is None else pd.concat([waiting, rows], ignore_index=True)
            if not len(rows):
                continue
            key = rows[["img", "_tx", "_ty"]]
            cuts = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
            waiting = rows.iloc[cuts[-1] :]
            yield decided(rows.iloc[: cuts[-1]], cuts[:-1])
        if waiting is not None:
            yield decided(waiting, np.zeros(1, int))

    def decided(rows, cuts):
        box = rows[["_x1", "_y1", "_x2", "_y2"]].to_numpy(dtype=float)
        inside, known = rows["_in"].to_numpy(dtype=bool), rows["_known"].to_numpy(dtype=bool)
        ends = [*cuts[1:], len(rows)]
        codes = [_decide(box[a:b], inside[a:b], known[a:b], limit) for a, b in zip(cuts, ends)]
        out = rows.drop(columns=["_tx", "_ty", "_in"]).assign(_code=np.concatenate([np.empty(0, np.int8), *codes]).astype(int))
        return out[~known]

    return run


def _suppress_crowded(boxes: DataFrame, limit: float) -> DataFrame:
    """The same result for groups of any size, in rounds over tiles.

    Every tile decides what it can of the boxes that touch it. What stays in doubt meets in the next round, with
    the boxes kept in this one, in tiles moved by half a side, then in larger ones. So a round leaves the boxes
    near tile borders only, and the number of rounds is bounded by the logarithm of the extent. Two shuffles
    and one written table a round. A box without area, or with a null corner, overlaps none, so it is kept at once.
    """
    corners = _SLIM[3:]
    solid = F.coalesce((F.col("_x2") > F.col("_x1")) & (F.col("_y2") > F.col("_y1")), F.lit(False))
    kept = boxes.where(~solid).select("img", "det_idx")
    left = boxes.where(solid).select(*_SLIM, F.lit(False).alias("_known"))
    cell_w, cell_h = _cell_size(left.select(*[F.col(f"_{c}").alias(c) for c in CORNERS]))
    x1, y1, x2, y2 = (F.col(c) for c in corners)
    turn = 0
    while True:
        sides = [c * float(TILE_SIDES * 2 ** (turn // 2)) for c in (cell_w, cell_h)]
        shift = F.lit(0.5 if turn % 2 else 0.0)
        low, high = ([F.floor(v / side + shift) for v, side in zip(point, sides)] for point in ((x1, y1), (x2, y2)))
        tiled = left.withColumn("_in", (low[0] == high[0]) & (low[1] == high[1]))
        tiled = tiled.withColumn("_tx", F.explode(F.sequence(low[0], high[0]))).withColumn("_ty", F.explode(F.sequence(low[1], high[1])))
        tiled = tiled.repartition("img", "_tx", "_ty").sortWithinPartitions("img", "_tx", "_ty", F.desc("score"), "det_idx")
        schema = T.StructType([*left.schema.fields, T.StructField("_code", T.IntegerType())])
        found = tiled.select(*left.columns, "_tx", "_ty", "_in").mapInPandas(_decide_tiles(limit), schema)
        best = found.groupBy("img", "det_idx").agg(F.max("_code").alias("_code"), *[F.first(c).alias(c) for c in _SLIM[2:]])
        best = cut_lineage(best)
        kept = kept.unionByName(best.where(F.col("_code") == KEPT).select("img", "det_idx"))
        if best.where("_code = 0").isEmpty():
            return kept
        left = best.where(F.col("_code") != GONE).select(*_SLIM, (F.col("_code") == KEPT).alias("_known"))
        turn += 1


def suppress(
    boxes: DataFrame,
    iou: float = 0.4,
    class_aware: bool = False,
    top_k: int | None = None,
    merge: bool = False,
    redundant: bool = True,
    group_cap: int = 50_000,
) -> DataFrame:
    """Greedy non-maximum suppression per image.

    Boxes of an image are read in rank order against the ones kept so far; images with more than
    ``group_cap`` boxes go through an exact distributed method instead, with the same result. ``merge``
    replaces each kept box by the score-weighted mean of the boxes it overlaps, and with ``redundant``
    drops kept boxes that overlap no other.
    """
    if iou < 0:
        raise ValueError("iou must not be negative")
    pool = boxes if top_k is None else take_per_group(boxes, ["img"], top_k, ["score desc", "det_idx"])
    # Fixed value: class offset that keeps boxes of different classes apart.
    offset = F.col("cls").cast("double") * 4096.0 if class_aware else F.lit(0.0)
    moved = pool.withColumns({f"_{c}": F.col(c).cast("double") + offset for c in CORNERS})
    slim = moved.select(*_SLIM)
    crowded = slim.groupBy("img").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group_cap).select("img")
    if crowded.limit(1).collect():
        calm, dense = slim.join(crowded, "img", "left_anti"), slim.join(crowded, "img", "left_semi")
        chosen = _keep_sorted(calm.select(*_SLIM), iou).unionByName(_suppress_crowded(dense, iou))
    else:
        chosen = _keep_sorted(slim, iou)
    kept = moved.join(chosen, ["img", "det_idx"], "left_semi")
    if not merge:
        return kept.select(*boxes.columns)
    # a kept box belongs to the pool, so cells sized by the pool bound the spread of both sides
    pairs = _met_pairs(
        kept.select("img", *[F.col(f"_{c}").alias(f"a_{c}") for c in CORNERS], F.struct(*boxes.columns).alias("row")),
        moved.select("img", *[F.col(f"_{c}").alias(f"b_{c}") for c in CORNERS], F.struct("score", *CORNERS).alias("near")),
        ("img",), "iou", _cell_size(moved.select(*[F.col(f"_{c}").alias(c) for c in CORNERS])),
    ).where(F.col("overlap") > iou)
    weight = F.sum("near.score")
    merged = pairs.groupBy("img", F.col("row.det_idx").alias("det_idx")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.first("row").alias("row"),
        *[F.try_divide(F.sum(F.col("near.score") * F.col(f"near.{c}")), weight).alias(f"_m{c}") for c in CORNERS],
    )
    if redundant:
        merged = merged.where(F.col("_n") > 1)
    return merged.select(*[F.col(f"_m{c}").alias(c) if c in CORNERS else F.col(f"row.{c}").alias(c) for c in boxes.columns])
