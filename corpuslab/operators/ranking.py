"""First-n, quotas, dense ids, checkpoints, frame windows and running series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from .ordering import block_by_bounds, cut_lineage, dense_position, group_limit_threshold, join_facts, order_bounds, order_columns, position_by, sort_key


def take_per_group(df: DataFrame, group: list[str], n: int, order: list, blocks: int | None = None) -> DataFrame:
    """First ``n`` rows of each group, in Spark's order: nulls first, or last in a descending key.

    ``order`` holds ``"name"``, ``"name desc"``, columns, or pairs like ``(column, "desc")``. Small ``n``: ``row_number() <= n``, which Spark
    trims on the map side, so a hot group ships at most ``n`` rows per task. Larger ``n``: block positions
    along the first key; only a column that is a sort order already (``col.desc()``) leaves a group in one task.
    The rows are the same either way.
    """
    if n > group_limit_threshold(df) and sort_key(order[0]):
        placed = _positions_with_ties(df, group, order, blocks)
        return placed.where(F.col("_pos") < n).drop("_pos")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order_columns(order)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def _positions_with_ties(df: DataFrame, group: list[str], order: list, blocks: int | None) -> DataFrame:
    head, descending = sort_key(order[0])
    headed = df.withColumn("_head", head)
    bounds = order_bounds(headed, "_head", blocks)
    return dense_position(headed, order_columns(order), block_by_bounds(F.col("_head"), bounds, descending), group, "_pos").drop("_head")


def take_quota(
    df: DataFrame,
    quotas: DataFrame,
    tag: str,
    order: list,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Rows of each tag up to ``quota``; stored items of the tag count toward it.

    Tags without a quota give no rows. The largest quota is read first (one number), so the rank
    filter has a constant bound and is trimmed before the shuffle.
    """
    largest = quotas.agg(F.max("quota").alias("q")).first()["q"] or 0
    left = quotas.select(tag, F.col("quota").cast("bigint").alias("_left"))
    if existing is not None:
        held = existing.groupBy(tag).agg(F.count(F.lit(1)).alias("_held"))
        left = left.join(held, tag, "left").select(tag, (F.col("_left") - F.coalesce("_held", F.lit(0))).alias("_left"))
    if largest > group_limit_threshold(df) and sort_key(order[0]):
        ranked = _positions_with_ties(df, [tag], order, None).withColumn("_rank", F.col("_pos") + 1).drop("_pos")
    else:
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(tag).orderBy(*order_columns(order))))
    ranked = ranked.where(F.col("_rank") <= int(largest))
    return ranked.join(left, tag).where(F.col("_rank") <= F.col("_left")).drop("_rank", "_left")


def existing_max(names: DataFrame, prefixes: DataFrame, name: str = "name", prefix: str = "prefix") -> DataFrame:
    """Highest parsed id per prefix among stored names (``-1`` when none); unparsable names are ignored."""
    stem = F.regexp_extract(F.col(name), r"^(.*)_(\d{1,18})\.png$", 1)
    number = F.regexp_extract(F.col(name), r"^(.*)_(\d{1,18})\.png$", 2)
    parsed = names.select(stem.alias(prefix), F.nullif(number, F.lit("")).cast("bigint").alias("_id"))
    best = parsed.where(F.col("_id").isNotNull()).groupBy(prefix).agg(F.max("_id").alias("_id"))
    return prefixes.select(prefix).distinct().join(best, prefix, "left").select(prefix, F.coalesce("_id", F.lit(-1)).alias("max_id"))


def append_ids(df: DataFrame, maxima: DataFrame, order: str, prefix: str = "prefix", blocks: int | None = None) -> DataFrame:
    """Dense ids from ``max_id + 1`` in ``order`` within each prefix; adds ``item_id`` and ``item_name``."""
    placed = position_by(df, order, [prefix], "_pos", blocks)
    numbered = placed.join(maxima.select(prefix, "max_id"), prefix, "left")
    ident = F.coalesce(F.col("max_id"), F.lit(-1)) + 1 + F.col("_pos")
    named = numbered.withColumn("item_id", ident)
    return named.withColumn("item_name", F.concat(F.col(prefix), F.format_string("_%05d.png", "item_id"))).drop("_pos", "max_id")


def dedupe(df: DataFrame, key: list[str], order: list[Column | str], keep: str = "first") -> DataFrame:
    """One row per key: first or last in ``order``. Copies of a hot key are dropped before the shuffle."""
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first or last, not {keep!r}")
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    if keep == "last":
        columns = [c.desc() for c in columns]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*columns))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge_sources(sources: Mapping[str, DataFrame], name: str = "name") -> DataFrame:
    """Union of sources in priority order; a base name taken by an earlier source wins."""
    merged = None
    for priority, (source, df) in enumerate(sources.items()):
        tagged = df.withColumns({"source": F.lit(source), "_priority": F.lit(priority)})
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return dedupe(merged, [name], ["_priority", "path"]).drop("_priority")


def parse_checkpoints(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``folder, kind, net, iter, is_latest``; ``iter`` is null for names that do not parse."""
    state = F.regexp_extract(path, r"(?:^|[/\\])(\d{1,18})\.state$", 1)
    model = F.regexp_extract(path, r"_(\d{1,18})\.pth$", 1)
    latest = F.col(path).rlike(r"latest[^/\\]*$")
    return files.withColumns(
        {
            "folder": text.folder(F.col(path)),
            "kind": F.when(F.endswith(path, F.lit(".state")), "state").when(F.endswith(path, F.lit(".pth")), "model"),
            "net": F.nullif(F.regexp_extract(path, r"([^/\\]*)_[^/\\_]*\.pth$", 1), F.lit("")),
            "is_latest": latest,
            "iter": F.when(~latest, F.concat(state, model).try_cast("bigint")),
        }
    )


def latest_checkpoint(files: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """Per run, the file with the highest iteration; names that do not parse are ignored."""
    parsed = parse_checkpoints(files, path).where(F.col("iter").isNotNull())
    best = F.max_by(F.struct("iter", F.col(path).alias("path")), F.struct("iter", F.col(path)))
    return parsed.groupBy(run).agg(best.alias("best")).select(run, "best.iter", "best.path")


def newest_run(files: DataFrame, run: str = "run", mtime: str = "mtime") -> DataFrame:
    """The run that owns the most recently written file."""
    last = files.groupBy(run).agg(F.max(mtime).alias(mtime))
    return last.orderBy(F.desc(mtime), F.col(run)).limit(1)


def retention_plan(files: DataFrame, keep_offset: int = 5, active_run: str | None = None, run: str = "run", path: str = "path") -> DataFrame:
    """``action`` = keep or drop for each checkpoint; nothing is deleted.

    Kept: ``latest`` files, the highest iteration of the folder and the one ``keep_offset`` before
    it, names that do not parse. With ``active_run`` every file of other runs is dropped.
    """
    parsed = parse_checkpoints(files, path)
    top = parsed.groupBy("folder", "kind").agg(F.max("iter").alias("_top"))
    judged = parsed.join(
        top.withColumnsRenamed({"folder": "_folder", "kind": "_kind"}),
        F.col("folder").eqNullSafe(F.col("_folder")) & F.col("kind").eqNullSafe(F.col("_kind")),
        "left",
    )
    stale = F.col("iter").isNotNull() & ~F.col("iter").isin(F.col("_top"), F.col("_top") - keep_offset)
    if active_run is not None:
        stale = (F.col(run) != active_run) | stale
    return judged.withColumn("action", F.when(stale, "drop").otherwise("keep")).drop("_folder", "_kind", "_top")


def retention_summary(plan: DataFrame, run: str = "run", size: str = "bytes") -> DataFrame:
    """Files and bytes per run and action."""
    return plan.groupBy(run, "action").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))


def first_available(candidates: DataFrame, usable: DataFrame, by: str = "model", path: str = "path", priority: str = "priority") -> DataFrame:
    """Usable artefact with the lowest priority number for each model."""
    live = candidates.join(usable.select(path), path, "left_semi")
    return live.groupBy(by).agg(F.min_by(path, F.struct(priority, path)).alias(path), F.min(priority).alias(priority))


PADDINGS = ("replicate", "reflection", "reflection_circle", "circle")


def frame_indices(index: Column, length: Column, k: int, padding: str = "reflection") -> Column:
    """Array of the ``k`` frame numbers centred on ``index`` of a clip with ``length`` frames."""
    if k % 2 != 1:
        raise ValueError("k must be odd")
    if padding not in PADDINGS:
        raise ValueError(f"unknown padding: {padding}")
    reach, last = k // 2, length - 1
    low = {
        "replicate": lambda i: F.lit(0),
        "reflection": lambda i: -i,
        "reflection_circle": lambda i: index + reach - i,
        "circle": lambda i: i + k,
    }[padding]
    high = {
        "replicate": lambda i: last,
        "reflection": lambda i: last * 2 - i,
        "reflection_circle": lambda i: index - reach - (i - last),
        "circle": lambda i: i - k,
    }[padding]
    return F.transform(
        F.sequence(index - reach, index + reach),
        lambda i: F.when(i < 0, low(i)).when(i > last, high(i)).otherwise(i).cast("int"),
    )


#: Frames that a task joins with the facts of their clips, on average.
TASK_FRAMES = 250_000


def with_clip(frames: DataFrame, fact: Column, clip: str = "clip") -> DataFrame:
    """``frames`` with an aggregate of their clip beside each; clips of any number of frames, tasks of ``TASK_FRAMES``."""
    facts = cut_lineage(frames.groupBy(clip).agg(fact, F.count(F.lit(1)).alias("_n")))
    return join_facts(frames, facts, [clip], "_n", task_rows=TASK_FRAMES).drop("_n")


def neighbour_frames(frames: DataFrame, k: int, padding: str = "reflection", clip: str = "clip", index: str = "frame_idx") -> DataFrame:
    """One row per frame and slot: ``slot`` 0..k-1 and the frame number read for it."""
    known = with_clip(frames.select(clip, index), (F.max(index) + 1).alias("_len"), clip)
    slots = F.posexplode(frame_indices(F.col(index), F.col("_len"), k, padding)).alias("slot", "source_idx")
    return known.select(clip, index, slots)


def gather_frames(frames: DataFrame, k: int, padding: str = "reflection", clip: str = "clip", index: str = "frame_idx", payload: str = "payload") -> DataFrame:
    """The ``k`` payloads of each frame in slot order, by one join on (clip, frame); an absent frame is a null."""
    slots = neighbour_frames(frames, k, padding, clip, index)
    source = frames.select(clip, F.col(index).alias("source_idx"), F.col(payload).alias("_payload"))
    joined = slots.join(source, [clip, "source_idx"], "left")
    window = F.sort_array(F.collect_list(F.struct("slot", "_payload")))
    return joined.groupBy(clip, index).agg(F.transform(window, lambda s: s["_payload"]).alias("window"))


def tail(log: DataFrame, n: int = 100, order: list | None = None) -> DataFrame:
    """Last ``n`` records: a top-k, never a full sort."""
    keys = [F.col(c) for c in (order or ["iteration"])]
    return log.orderBy(*[c.desc() for c in keys]).limit(n)


def linear_scan(df: DataFrame, factor: float, series: list[str], position: str, value: str, out: str, block_rows: int = 512, levels: int = 1, carry: tuple[str, ...] = (), materialise: bool = True) -> DataFrame:
    """``y_p = factor * y_{p-1} + x_p`` with ``y_{-1} = 0``, for dense 0-based positions per series.

    Blocks of ``block_rows`` consecutive rows are folded from zero on their own; the value that
    enters a block obeys the same recurrence over block ends with ``factor ** block_rows``, so it
    is found by the same scan one level up. No task ever holds a whole series. ``carry`` columns
    travel along. The folded blocks are read twice, so they are written once, not computed twice.
    """
    extra = F.struct(F.lit(0).alias("_"), *carry).alias("_c")
    blocked = df.select(*series, F.col(position).alias("_p"), F.col(value).alias("_x"), extra).withColumn("_blk", F.floor(F.col("_p") / block_rows))
    packed = blocked.groupBy(*series, "_blk").agg(F.sort_array(F.collect_list(F.struct("_p", "_x", "_c"))).alias("items"))
    previous = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))
    step = lambda acc, s: F.array_append(acc, F.lit(factor) * previous(acc) + s["_x"])
    folded = packed.withColumn("local", F.aggregate("items", F.array().cast("array<double>"), step))
    if materialise:
        folded = cut_lineage(folded)
    ends = folded.select(*series, "_blk", F.element_at("local", -1).alias("_end"))
    power = factor**block_rows
    if levels > 0:
        carried = linear_scan(ends, power, series, "_blk", "_end", "_carry", block_rows, levels - 1, materialise=False)
    else:
        chain = ends.groupBy(*series).agg(F.sort_array(F.collect_list(F.struct("_blk", "_end"))).alias("chain"))
        fold = lambda acc, s: F.array_append(acc, F.lit(power) * previous(acc) + s["_end"])
        carried = chain.select(
            *series, F.posexplode(F.aggregate("chain", F.array().cast("array<double>"), fold)).alias("_blk", "_carry")
        )
    entering = carried.select(*series, (F.col("_blk") + 1).cast("bigint").alias("_blk"), "_carry")
    joined = folded.join(entering, [*series, "_blk"], "left")
    rows = joined.select(*series, F.coalesce("_carry", F.lit(0.0)).alias("_carry"), F.posexplode(F.arrays_zip("items", "local")).alias("_k", "z"))
    return rows.select(
        *series,
        F.col("z.items._p").alias(position),
        *[F.col(f"z.items._c.{c}").alias(c) for c in carry],
        (F.col("z.local") + F.pow(F.lit(factor), F.col("_k") + 1) * F.col("_carry")).alias(out),
    )


def ema(df: DataFrame, decay: float, series: list[str], order: str, value: str, blocks: int | None = None, out: str = "ema") -> DataFrame:
    """``e_t = d e_{t-1} + (1-d) x_t`` with ``e_0 = x_0``, in ``order`` (unique per series).

    A null value is no term of its series: its row gets null and the next row follows the last value.
    """
    # the series key is packed into one struct, so that null keys join as equal
    every = df.select(F.struct(*series).alias("_s"), order, value)
    keyed = every.where(F.col(value).isNotNull())
    placed = position_by(keyed, order, ["_s"], "_pos", blocks)
    term = F.when(F.col("_pos") == 0, F.col(value).cast("double")).otherwise(F.lit(1.0 - decay) * F.col(value))
    scanned = linear_scan(placed.withColumn("_term", term), decay, ["_s"], "_pos", "_term", out, carry=(order, value))
    absent = every.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    whole = scanned.select("_s", order, value, out).unionByName(absent)
    return whole.select(*[F.col(f"_s.{c}").alias(c) for c in series], order, value, out)


def eta(df: DataFrame, total: int, run: str = "run", iteration: str = "iteration", ts: str = "ts") -> DataFrame:
    """Mean seconds per iteration since the run's first record, times the iterations left.

    The running mean telescopes to (now - start) / (iterations so far), so one small aggregate per
    run replaces a running window.
    """
    start = df.groupBy(run).agg(F.min(iteration).alias("_i0"), F.min_by(ts, iteration).alias("_t0"))
    timed = df.join(start, run)
    elapsed = (text.micros(F.col(ts)) - text.micros(F.col("_t0"))) / F.lit(1e6)
    mean = elapsed / (F.col(iteration) - F.col("_i0") + 1)
    return timed.withColumns(
        {"sec_per_iter": mean, "eta_s": mean * (F.lit(total) - F.col(iteration) - 1)}
    ).drop("_i0", "_t0")
