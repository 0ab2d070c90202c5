"""Corpus reports, clean-up plans, loss summaries and the acceptance gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text
from .ordering import block_by_bounds, cut_lineage, dense_position, join_facts, order_bounds

#: Share of a group on either side of its middle that the bracket of a median holds, and the sketch's accuracy.
SPREAD, SKETCH = 0.002, 10_000


def composition(df: DataFrame, by: str = "category", is_new: Column | None = None) -> DataFrame:
    """Items and new items per category, with a grand total row (``by`` null, ``is_total`` true)."""
    fresh = F.lit(0) if is_new is None else F.when(is_new, 1).otherwise(0)
    return df.withColumn("_new", fresh).rollup(by).agg(
        (F.grouping(by) == 1).alias("is_total"),
        F.count(F.lit(1)).alias("items"),
        F.sum("_new").cast("bigint").alias("new_items"),
    )


def categories(df: DataFrame, by: str = "category") -> DataFrame:
    """Sorted distinct categories as one array row."""
    return df.agg(F.sort_array(F.collect_set(by)).alias("categories"))


def rejection_report(df: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows per rejection reason, plus their total (``reason`` = ``total``)."""
    counted = df.rollup(reason).agg(F.grouping(reason).alias("_g"), F.count(F.lit(1)).alias("items"))
    return counted.select(F.when(F.col("_g") == 1, "total").otherwise(F.col(reason)).alias("reason"), "items")


def directory_rollup(listing: DataFrame, max_depth: int = 4, min_bytes: int = 512 * 1024 * 1024, path: str = "rel_path") -> DataFrame:
    """Total bytes and files below every folder down to ``max_depth``, above ``min_bytes``."""
    parts = F.split(F.col(path), "/")
    depth = F.least(F.size(parts) - 1, F.lit(max_depth))
    levels = F.transform(
        F.when(depth > 0, F.sequence(F.lit(1), depth)),
        lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("folder")),
    )
    return (
        listing.select("bytes", F.explode(levels).alias("l"))
        .groupBy("l.folder", "l.depth")
        .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
        .where(F.col("bytes") > min_bytes)
        .withColumn("size", text.human_bytes(F.col("bytes")))
    )


def reclaim_plan(listing: DataFrame, rules: list[dict], path: str = "rel_path") -> DataFrame:
    """Files and bytes each clean-up rule would free, first rule wins. A plan only: nothing is deleted.

    A rule is ``{name, prefix?, suffix?, min_bytes?}``; the size must exceed ``min_bytes``.
    """
    matched = None
    for rule in rules:
        hit = F.lit(True)
        if rule.get("prefix"):
            hit = hit & F.col(path).startswith(rule["prefix"])
        if rule.get("suffix"):
            hit = hit & F.lower(F.col(path)).endswith(rule["suffix"].lower())
        if rule.get("min_bytes") is not None:
            hit = hit & (F.col("bytes") > rule["min_bytes"])
        name = F.lit(rule["name"])
        matched = F.when(hit, name) if matched is None else matched.when(hit, name)
    ruled = listing.select(matched.alias("rule"), "bytes").where(F.col("rule").isNotNull())
    return ruled.groupBy("rule").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def reduce_ranks(losses: DataFrame, keys: tuple[str, ...] = ("iteration", "metric"), value: str = "value") -> DataFrame:
    """Mean of each loss over the ranks that report it."""
    return losses.groupBy(*keys).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("ranks"))


def code_usage(assigned: DataFrame, n_codes: int, code: str = "code_id") -> DataFrame:
    """Uses and share of each of ``n_codes`` codes; codes never used get 0."""
    counts = assigned.groupBy(F.col(code).cast("bigint").alias("code_id")).agg(F.count(F.lit(1)).alias("uses"))
    total = counts.agg(F.sum("uses")).scalar()
    codes = assigned.sparkSession.range(n_codes).withColumnRenamed("id", "code_id")
    filled = codes.join(counts, "code_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return filled.withColumn("share", F.coalesce(F.try_divide(F.col("uses"), total), F.lit(0.0)))


def perplexity(usage: DataFrame) -> DataFrame:
    """``exp(-sum p ln(p + 1e-10))`` over a :func:`code_usage` table."""
    p = F.col("share")
    return usage.agg(F.exp(-F.sum(p * F.log(p + F.lit(1e-10)))).alias("perplexity"))


def summarise_metrics(scores: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean of each metric and the number of samples behind it."""
    return scores.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.count(value).alias("samples"))


def warm_latency(calls: DataFrame, by: list[str], order: str, latency: str = "latency_s") -> DataFrame:
    """Mean latency per group without its first call, as one aggregate."""
    first = F.min_by(latency, order)
    n = F.count(latency)
    return calls.groupBy(*by).agg(
        F.try_divide(F.sum(latency) - first, (n - 1).cast("double")).alias("warm_latency_s"),
        F.greatest(n - 1, F.lit(0)).alias("warm_calls"),
    )


def exact_median(df: DataFrame, group: list[str], value: str, tie: str, blocks: int | None = None, spread: float = SPREAD) -> DataFrame:
    """Median per group by selection: ``group..., median``; null values count for nothing, a null group is a group.

    ``median()`` merges all values of a group in one task, and ranking shuffles them all. Here a mergeable sketch
    brackets the middle of each group, one aggregate counts what lies below the bracket and how often each value
    inside it occurs, and only these counts are sorted. Were a sketch ever so far off that a middle row lies
    outside its bracket, the group is ranked in full; the result is exact either way. The values are read more
    than once, so they are written first.
    """
    keyed = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)]).alias("_g")
    present = cut_lineage(df.where(F.col(value).isNotNull()).select(keyed, F.col(value).alias("_v"), F.col(tie).alias("_t")))
    ends = F.percentile_approx("_v", [0.5 - spread, 0.5 + spread], SKETCH)
    brackets = cut_lineage(present.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"), ends.alias("_ends")))
    named = _group_columns(group)
    if not brackets.limit(1).count():
        return present.select(*named, F.col("_v").cast("double").alias("median"))
    counted = cut_lineage(_bracket_counts(present, brackets))
    so_far = Window.partitionBy("_g").orderBy(F.col("_v").asc_nulls_first())
    reach = F.sum("_c").over(so_far)
    lower, upper = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    held = counted.select("_g", "_v", "_n", (reach - F.col("_c")).alias("_from"), reach.alias("_upto")).where("_v IS NOT NULL")
    has = lambda place: (F.col("_from") <= place) & (place < F.col("_upto"))
    middle = held.groupBy("_g").agg(F.max(F.when(has(lower), F.col("_v"))).alias("_lo"), F.max(F.when(has(upper), F.col("_v"))).alias("_hi"))
    middle = cut_lineage(middle.where("_lo IS NOT NULL AND _hi IS NOT NULL"))
    found = middle.select(*named, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((F.col("_lo") + F.col("_hi")) / 2).cast("double").alias("median"))
    missed = cut_lineage(brackets.join(middle, "_g", "left_anti").select("_g"))
    if not missed.limit(1).count():
        return found
    ranked = _ranked_median(present.join(missed, "_g", "left_semi"), blocks)
    return found.unionByName(ranked.select(*named, "median"))


def _group_columns(group: list[str]) -> list[Column]:
    return [F.col("_g")[f"g{i}"].alias(c) for i, c in enumerate(group)]


def _bracket_counts(present: DataFrame, brackets: DataFrame) -> DataFrame:
    """``_g, _v, _c, _n``: how often each value inside a bracket occurs; a null value counts all that lies below."""
    low, high = F.col("_ends")[0], F.col("_ends")[1]
    met = join_facts(present.select("_g", "_v"), brackets, ["_g"], "_n").where(F.col("_v") <= high)
    return met.groupBy("_g", F.when(F.col("_v") >= low, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))


def _ranked_median(present: DataFrame, blocks: int | None) -> DataFrame:
    bounds = order_bounds(present, "_v", blocks)
    placed = dense_position(present, ["_v", "_t"], block_by_bounds(F.col("_v"), bounds), ["_g"], "_pos")
    sizes = present.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    middle = placed.join(sizes, "_g").where((F.col("_pos") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_pos") == F.ceil((F.col("_n") - 1) / 2)))
    return middle.groupBy("_g").agg(F.avg("_v").alias("median"))


def acceptance_gate(candidate: DataFrame, baseline: DataFrame, sample: str = "sample") -> DataFrame:
    """Verdict per category and for all samples (``category`` = ``(all)``).

    On samples both sides scored: median PSNR and SSIM must not fall where a reference gave them,
    and the mean identity distance must not rise.
    """
    metrics = ("psnr", "ssim", "identity")
    base = baseline.select(sample, *[F.col(m).alias(f"base_{m}") for m in metrics])
    paired = candidate.select(sample, "category", *[F.col(m).alias(f"cand_{m}") for m in metrics]).join(base, sample)
    scoped = paired.withColumn("category", F.explode(F.array(F.col("category"), F.lit("(all)"))))
    tidy = cut_lineage(scoped.where(F.col("category").isNotNull()))
    values = [
        F.struct(F.lit(f"{side}_{m}").alias("kind"), F.when(F.col(f"cand_{m}").isNotNull() & F.col(f"base_{m}").isNotNull(), F.col(f"{side}_{m}")).cast("double").alias("value"))
        for m in ("psnr", "ssim")
        for side in ("cand", "base")
    ]
    long = tidy.select("category", sample, F.explode(F.array(*values)).alias("v")).select("category", sample, "v.*")
    medians = exact_median(long, ["category", "kind"], "value", sample)
    wide = medians.groupBy("category").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("median"))).alias(f"{k}_median") for k in ("cand_psnr", "base_psnr", "cand_ssim", "base_ssim")]
    )
    means = tidy.groupBy("category").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.when(F.col("base_identity").isNotNull(), F.col("cand_identity"))).alias("cand_identity_mean"),
        F.avg(F.when(F.col("cand_identity").isNotNull(), F.col("base_identity"))).alias("base_identity_mean"),
    )
    ok = lambda c: F.coalesce(c, F.lit(True))
    verdict = (
        ok(F.col("cand_psnr_median") >= F.col("base_psnr_median"))
        & ok(F.col("cand_ssim_median") >= F.col("base_ssim_median"))
        & ok(F.col("cand_identity_mean") <= F.col("base_identity_mean"))
    )
    return means.join(wide, "category", "left").withColumn("accepted", verdict)
