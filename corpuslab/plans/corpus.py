"""Jobs put together from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import aggregates, joins, projections, ranking, sampling
from ..schemas import IMAGE_SUFFIXES


def holdout_report(listing: DataFrame, n: int = 50, seed: int = sampling.HOLDOUT_SEED, key: str = "rel_path") -> DataFrame:
    """Which items go to the benchmark, and is the training set clean?

    Composition of the training set per category and in total, with the number of held-out items
    and of those still found in training (0 when the exclusion holds).
    """
    holdout = sampling.select_holdout(listing, key, n, seed)
    train = joins.exclude_holdout(listing, holdout, key, key)
    leaked = joins.audit_leakage(train, holdout, key, key).select("overlap_rows").scalar()
    rows = aggregates.composition(train)
    return rows.select("category", "is_total", F.col("items").alias("train_items"), leaked.alias("overlap_items"))


def curate(listing: DataFrame, measures: DataFrame, existing: DataFrame, quota: int, key: str = "rel_path") -> DataFrame:
    """Listing to accepted new items: cheap checks, then measured ones, then dedupe and quota.

    ``measures``: ``rel_path, faces, coverage, sharpness``. Rejected items keep their ``reason`` and
    no number; accepted ones carry ``item_id`` per category.
    """
    named = projections.filter_name(listing, key, IMAGE_SUFFIXES)
    fresh = joins.skip_existing(named, existing, key)
    judged = projections.reject_reason(fresh.join(measures, key, "left"))
    good = ranking.dedupe(judged.where("reason = 'ok'"), ["category", "name"], [key])
    return ranking.take_per_group(good, ["category"], quota, [key])


def training_plan(listing: DataFrame, holdout: DataFrame, key: str, replicas: int, batch_size: int, ratio: float, epoch: int, valid: Column | None = None) -> DataFrame:
    """Batches of one epoch over the items that are not held out, with their degradation parameters."""
    train = joins.exclude_holdout(listing if valid is None else listing.where(valid), holdout, key, key)
    order = sampling.batch(sampling.epoch_sample(train, key, ratio, replicas, epoch), batch_size)
    return sampling.degradation_plan(order, "copy_pos", seed=epoch)
