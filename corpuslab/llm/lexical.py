"""Ranked lexical search by presence masks.

One pass over the documents counts the terms of a block of items in each; the counts are written, with the
document's length, and the corpus statistics come from them. A second pass reads the counts in blocks of
documents. For each term a block has a bitmap of the documents that hold it; the bitmaps of an item's terms,
turned round, give every document its mask of matched terms. Documents of one mask are a group, whose best
possible score is the sum of its terms' highest contributions in the block. Groups are scored from the highest
bound down until the bound is below the item's last kept score. A task keeps an item's best documents from block
to block, so later blocks score few groups; what tasks keep is ranked once more, a few rows per item and task.

Scores are whole numbers, so partial ranks merge without rounding.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import saved, text_of

TOP = 20
#: Characters of item text that one pass looks for.
BLOCK_CHARS = 1 << 20
#: Documents whose masks are grouped together.
BLOCK_DOCS = 8192
#: A term is a run of bytes that are ASCII digits, letters (A-Z as a-z), or part of a wider character.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with their terms, a block of about ``block_chars`` characters at a time; only one is on the driver."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // block_chars)
    for k in range(count):
        block: dict[int | None, Counter] = {}
        for row in rows.where(F.pmod(F.xxhash64("id"), F.lit(count)) == k).toLocalIterator():
            block.setdefault(row["id"], Counter()).update(terms(row["text"]))
        yield sorted(((key, found) for key, found in block.items() if found), key=lambda x: (x[0] is None, x[0] or 0))


def _counted(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, seen, times, ends = [], [], [], [0]
            for text in batch.column("text"):
                found = terms(text.as_py())
                counts = Counter(map(vocabulary.get, found))
                counts.pop(None, None)
                sizes.append(len(found))
                seen.extend(counts)
                times.extend(counts.values())
                ends.append(len(seen))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (seen, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return run


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def parts(times: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What an occurrence count adds for each unit of weight, in documents of ``n`` terms."""
    m = 75 + (25 * n * documents) // length
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


class Block:
    """Postings of some documents: per term the documents that hold it and what they add for a unit of weight."""

    def __init__(self, size: int, doc: np.ndarray, term: np.ndarray, part: np.ndarray):
        self.size = size
        order = np.argsort(term, kind="stable")
        self.doc, self.part = doc[order], part[order]
        self.known, starts = np.unique(term[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self.bits: dict[int, np.ndarray] = {}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        k = int(np.searchsorted(self.known, term))
        if k == len(self.known) or self.known[k] != term:
            return self.doc[:0], self.part[:0]
        at = slice(self.starts[k], self.starts[k + 1])
        return self.doc[at], self.part[at]

    def bitmap(self, term: int) -> np.ndarray:
        """A bit per document, packed."""
        if term not in self.bits:
            held = np.zeros(self.size, bool)
            held[self.postings(term)[0]] = True
            self.bits[term] = np.packbits(held)
        return self.bits[term]

    def masks(self, wanted: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(distinct masks, terms) as bits, and the number of its mask for every document."""
        held = np.unpackbits(np.stack([self.bitmap(t) for t in wanted]), axis=1, count=self.size)
        packed = np.packbits(held, axis=0)
        packed = np.pad(packed, ((0, -len(packed) % 8), (0, 0))).T.copy()
        words = packed.view(np.uint64)
        if words.shape[1] == 1:
            distinct, group = np.unique(words[:, 0], return_inverse=True)
        else:
            distinct, group = np.unique(words, axis=0, return_inverse=True)
        rows = np.unpackbits(distinct.reshape(len(distinct), -1).view(np.uint8), axis=1, count=len(wanted))
        return rows.astype(np.int64), group.reshape(-1)

    def score(self, docs: np.ndarray, wanted: list[int], weights: list[int]) -> np.ndarray:
        """Scores of some documents, which ascend."""
        out = np.zeros(len(docs), np.int64)
        for term, w in zip(wanted, weights):
            held, part = self.postings(term)
            if len(held):
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                hit = held[at] == docs
                out[hit] += w * part[at[hit]]
        return out

    def best(self, wanted: list[int], weights: list[int], top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that hold all of the ``top`` best of ``least`` or more, ties at the last place included."""
        rows, group = self.masks(wanted)
        highest = np.array([w * int(p.max()) if len(p := self.postings(t)[1]) else 0 for t, w in zip(wanted, weights)], np.int64)
        bounds = rows @ highest
        order = np.argsort(-bounds, kind="stable")
        sizes = np.bincount(group, minlength=len(rows))[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[group]
        members = np.argsort(place, kind="stable")
        ends = np.cumsum(sizes)
        docs, scores, done, reach = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, top
        while done < len(order) and bounds[order[done]] >= max(least, 1):
            # Groups in hand: enough for ``reach`` documents, none below the bound reached so far.
            stop = min(int(np.searchsorted(ends, reach)) + 1, int(np.searchsorted(-bounds[order], -max(least, 1), "right")))
            stop = max(stop, done + 1)
            chosen = np.sort(members[(ends[done - 1] if done else 0) : ends[stop - 1]])
            docs.append(chosen)
            scores.append(self.score(chosen, wanted, weights))
            done, reach = stop, 2 * int(ends[stop - 1])
            found = np.concatenate(scores)
            if len(found) >= top:
                least = max(least, int(np.partition(found, len(found) - top)[len(found) - top]))
        docs_, scores_ = np.concatenate(docs), np.concatenate(scores)
        keep = scores_ >= max(least, 1)
        return docs_[keep], scores_[keep]


def _ranked(items: list[tuple[list[int], list[int]]], documents: int, length: int, top: int, block_docs: int):
    """Per task: the ``top`` best documents of every item, by score and then id, null ids last."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k in range(0, batch.num_rows, block_docs):
                held.append(batch.slice(k, block_docs))
                if sum(b.num_rows for b in held) >= block_docs:
                    yield pa.Table.from_batches(held)
                    held = []
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty((0, 3), np.int64) for _ in items]
        for table in blocks(batches):
            table = table.combine_chunks()
            ids = table.column("doc_id")
            unnamed = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0)).astype(np.int64)
            n = np.asarray(table.column("n"))
            lists = table.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(n)), np.asarray(lists.value_lengths()))
            times = np.asarray(table.column("times").combine_chunks().flatten()).astype(np.int64)
            block = Block(len(n), doc, np.asarray(lists.flatten()), parts(times, n[doc], documents, length))
            for k, (wanted, weights) in enumerate(items):
                least = int(kept[k][-1, 0]) if len(kept[k]) >= top else 1
                docs, scores = block.best(wanted, weights, top, least)
                if len(docs):
                    rows = np.concatenate((kept[k], np.stack((scores, unnamed[docs], ids[docs]), axis=1)))
                    kept[k] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:top]]
        nr = np.repeat(np.arange(len(items)), [len(rows) for rows in kept])
        rows = np.concatenate(kept) if kept else np.empty((0, 3), np.int64)
        arrays = [pa.array(nr), pa.array(rows[:, 2], mask=rows[:, 1].astype(bool)), pa.array(rows[:, 0])]
        yield pa.RecordBatch.from_arrays(arrays, names=["nr", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", top: int = TOP, block_chars: int = BLOCK_CHARS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` best documents with a score above 0.

    Equal scores rank by ascending id, a null id last; rows that share an id are documents of their own. Null
    and empty texts have no terms: such documents are never found and such items find nothing. Rows of ``items``
    that share an id are one item with the terms of all its distinct texts; a null id is an id. A term counts as
    often as it stands in the item. No documents or no items give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = []
    for block in item_blocks(items, item_id_col, text_col, block_chars):
        vocabulary = {t: k for k, t in enumerate(sorted({t for _, counts in block for t in counts}))}
        counted = saved(rows.mapInArrow(_counted(vocabulary), "doc_id long, n long, terms array<int>, times array<int>"))
        totals = counted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
        # A row per term of the block, which the vocabulary bounds.
        holding = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
        if not holding:
            continue
        weights = {k: weight(totals["documents"], n) for k, n in holding.items()}
        plans = []
        for _, counts in block:
            used = sorted((vocabulary[t], q) for t, q in counts.items() if weights.get(vocabulary[t]))
            plans.append(([t for t, _ in used], [q * weights[t] for t, q in used]))
        wanted = [k for k, (used, _) in enumerate(plans) if used]
        names = spark.createDataFrame([(k, block[nr][0]) for k, nr in enumerate(wanted)], "nr long, item_id long")
        scored = counted.where(F.size("terms") > 0).mapInArrow(_ranked([plans[nr] for nr in wanted], totals["documents"], totals["length"], top, block_docs), "nr long, doc_id long, score long")
        place = F.row_number().over(Window.partitionBy("nr").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        best = scored.withColumn("rank", place).where(F.col("rank") <= top)
        found.append(saved(best.join(F.broadcast(names), "nr").select("item_id", "rank", "doc_id", "score")))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_TERMS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH words AS (SELECT doc_id, {_TERMS.format(t='text')} AS w FROM documents WHERE text IS NOT NULL),
held AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words WHERE len(w) > 0),
counts AS (SELECT doc_id, term, any_value(n) AS n, count(*) AS tf FROM held GROUP BY ALL),
totals AS (SELECT count(*) AS nn, sum(len(w))::BIGINT AS ll FROM words WHERE len(w) > 0),
asked AS (SELECT item_id, unnest({_TERMS.format(t='text')}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
query AS (SELECT item_id, term, count(*) AS q FROM asked GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term),
scores AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM query JOIN counts USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
