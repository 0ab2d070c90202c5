"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document should be taken target / source size times. The whole part is taken outright; the rest, a
fraction of a copy, is a mass of words between nothing and the document. In a fold over a bounded slot
of documents, the two open masses at hand trade words at random until one is nothing or whole, with
odds that leave every expectation as it was and the sum exact. One open document is left per slot;
these meet in the slots of the next level, and so on up a tree of shuffles until one is left for each
source. That one is taken in part, its first words, so the sum of a source misses its target by less
than a word. Slots are dealt by hash, so a source that holds a third of all rows is spread like any.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, saved, text_of

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
#: Documents of one fold, and folds whose open documents meet in the next.
SLOT = 128

_ITEM = "struct<h: bigint, doc_id: bigint, nr: bigint, size: bigint, base: bigint, m: double>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    The sources by code point, null last, have ``weights`` in turn. ``share`` of all words is dealt by
    weight; what lies above ``cap`` times a source's size is dealt anew among the others until nothing
    does. Only totals reach the driver. One row per source is ranked in one task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (rank % len(weights)).cast("int"))
    totals = saved(totals.withColumn("weight", weight.cast("long")))
    full = F.lit(False)
    whole = totals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, before = 0.0, -1
    while True:
        row = totals.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == before or not row["weight"]:
            break
        before = row["n"]
        level = (whole - cap * row["full"]) / row["weight"]
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * cap
    capped = (F.col("source_size") * cap).cast("double")
    return totals.select("source", "source_size", F.least(capped, F.col("weight") * F.lit(level)).alias("target"))


def _fold(seed: int) -> Column:
    """``done, open`` of the array ``items``: pivotal steps from left to right."""
    step = f"""
    named_struct('a', a, 'x', x,
      'up', least(a.open.size - a.open.m, x.m), 'down', least(a.open.m, x.size - x.m),
      'u', pmod(xxhash64({seed}, a.open.h, a.open.doc_id, a.open.nr, x.h, x.doc_id, x.nr), 9007199254740992L) / 9007199254740992.0D)"""
    # Words move to the open document, or from it; whichever of the two is whole or empty is settled.
    moved = """
    if(s.up + s.down > 0 and s.u * (s.up + s.down) < s.down,
       named_struct('o', if(s.up = s.a.open.size - s.a.open.m, s.a.open.size, s.a.open.m + s.up), 'n', if(s.up = s.x.m, 0D, s.x.m - s.up)),
       named_struct('o', if(s.down = s.a.open.m, 0D, s.a.open.m - s.down), 'n', if(s.down = s.x.size - s.x.m, s.x.size, s.x.m + s.down)))"""
    with_mass = lambda item, m: f"named_struct('h', {item}.h, 'doc_id', {item}.doc_id, 'nr', {item}.nr, 'size', {item}.size, 'base', {item}.base, 'm', cast({m} as double))"
    old, new = with_mass("s.a.open", "r.o"), with_mass("s.x", "r.n")
    settled = "r.o = 0 or r.o = s.a.open.size"
    merge = f"""
    transform(array({step}), s -> transform(array({moved}), r -> named_struct(
      'done', array_append(s.a.done, if({settled}, {old}, {new})),
      'open', if({settled}, {new}, {old})))[0])[0]"""
    return F.expr(
        f"aggregate(slice(items, 2, size(items)), named_struct('done', cast(array() as array<{_ITEM}>), 'open', items[0]), (a, x) -> {merge})"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, slot: int = SLOT) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row.

    ``size`` counts words, a null text has none; a null source is a source. ``taken`` is a whole number of
    copies, at most ``CAP``, but for one document of each source whose last copy is cut to its first
    words. Rows that agree in id, source and size are numbered, so repeated rows are rounded one by one
    and rerun alike; the result depends on nothing but the rows. An empty table gives an empty result.
    """
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size"))
    sizes = saved(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = saved(source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size"))))
    # The join key is a struct: null is a source like any other.
    key = F.struct("source").alias("key")
    rows = sizes.select(key, "doc_id", "size", F.explode(F.expr("sequence(1L, n)")).alias("nr"))
    rows = rows.join(sources.select(key, "source_size", "target"), "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("copies", F.floor(rate).cast("long")).withColumn("m", (rate - F.col("copies")) * F.col("size"))
    fixed = ["key", "doc_id", "size", "source_size", "target"]
    part = saved(rows.select(*fixed, "nr", (F.col("copies") * F.col("size")).alias("base"), "m"))
    whole = part.where("m <= 0").select(*fixed, F.col("base").alias("taken"))
    return _settle(part.where("m > 0"), whole, sources, key, seed, slot)


def _settle(part: DataFrame, whole: DataFrame, sources: DataFrame, key: Column, seed: int, slot: int) -> DataFrame:
    counts = saved(part.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / slot).cast("long").alias("k")))
    top = counts.agg(F.max("k")).first()[0] or 0
    levels = 1 + max(0, math.ceil(math.log(max(top, 1), slot) - 1e-9))
    h = F.xxhash64(F.lit(seed), "doc_id", "nr", "size")
    item = F.struct(h.alias("h"), "doc_id", "nr", "size", "base", "m").alias("item")
    open_ = part.join(counts, "key").select("key", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "nr", "size"), F.col("k")).alias("slot"), item)
    done = None
    for level in range(levels):
        if level:
            open_ = open_.withColumn("slot", F.floor(F.col("slot") / slot).cast("long"))
        folds = open_.groupBy("key", "slot").agg(F.array_sort(F.collect_list("item")).alias("items"))
        folds = saved(folds.select("key", "slot", _fold(seed).alias("f")))
        settled = folds.select("key", F.explode("f.done").alias("item"))
        done = settled if done is None else done.unionByName(settled)
        open_ = folds.select("key", "slot", F.col("f.open").alias("item"))
    done = done.unionByName(open_.select("key", "item"))
    taken = (F.col("item.base") + F.round(F.col("item.m")).cast("long")).alias("taken")
    done = done.join(sources.select(key, "source_size", "target"), "key")
    done = done.select("key", F.col("item.doc_id").alias("doc_id"), F.col("item.size").alias("size"), "source_size", "target", taken)
    return whole.unionByName(done).select("doc_id", "size", "source_size", "target", "taken")
