"""Benchmark decontamination by pigeonhole edit matching.

An item may occur with a share of its characters edited. It is cut into one piece more than the errors
allowed, so at least one piece of any such occurrence is unedited. One Aho-Corasick automaton over the
pieces of a block of items finds every exact piece in one pass over a whole text; around each hit the
smallest edit distance of the item to any substring is computed with Myers' bit-parallel recurrence.

The benchmark is the query set: it is read in blocks of bounded size, each a pass over all documents whose
hits are written before the next block is read, so one block at a time is on the driver and in the tasks.
Documents are not shuffled to find hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import saved, text_of

#: Edits allowed per character of an item.
BUDGET = 0.08
#: Characters of benchmark text that one pass looks for.
BLOCK_CHARS = 1 << 20
HITS = "array<struct<item_id: long, distance: int, match_end: long>>"


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: float = BUDGET) -> list[tuple[int, str]]:
    """(offset, piece): one more than the errors allowed, of nearly equal length."""
    count = int(len(item) * budget) + 1
    cuts = [len(item) * k // count for k in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def peq(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for k, letter in enumerate(item):
        masks[letter] |= 1 << k
    return dict(masks)


def myers(masks: dict[str, int], m: int, text: str, start: int, stop: int, limit: int) -> tuple[int, int] | None:
    """Smallest edit distance of the item to a substring of ``text[start:stop]`` and its first end, if within ``limit``."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for at in range(start, stop):
        eq = masks.get(text[at], 0)
        x = eq | minus
        d0 = (((eq & plus) + plus) ^ plus) | x
        up, down = minus | (full & ~(d0 | plus)), plus & d0
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        # A match may start anywhere: the row above the item costs nothing.
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(d0 | up)), up & d0
        if score <= limit and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """Finds the items of one block in a text."""

    def __init__(self, items: list[tuple[int, str]], budget: float = BUDGET):
        self.items = [(key, text, int(len(text) * budget)) for key, text in items if text]
        self.masks: dict[int, dict[str, int]] = {}
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text, _) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                at[piece].append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, end of the match in the normalised text) of each item that occurs, its best match."""
        text = normalise(text)
        if not self.items or not text:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                starts[k].add(end + 1 - size - offset)
        out = []
        for k in sorted(starts):
            found = starts[k]
            key, item, limit = self.items[k]
            if k not in self.masks:
                self.masks[k] = peq(item)
            best = None
            for low, high in _spans(sorted(found), len(item), limit):
                got = myers(self.masks[k], len(item), text, max(0, low), min(len(text), high), limit)
                if got and (best is None or got[0] < best[0]):
                    best = got
            if best:
                out.append((key, *best))
        return out


def _spans(starts: list[int], length: int, limit: int) -> list[tuple[int, int]]:
    """Stretches of text in which an occurrence that begins within ``limit`` of a start lies; overlapping ones are one."""
    spans: list[list[int]] = []
    for start in starts:
        low, high = start - limit, start + length + limit
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    return [(a, b) for a, b in spans]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The distinct items, normalised, in blocks of about ``block_chars`` characters, one after another."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // block_chars)
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).collect()
        yield sorted(((r["id"], normalise(r["text"])) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def hits_column(items: list[tuple[int, str]], text: Column, budget: float = BUDGET) -> Column:
    """The items of one block that occur in the text."""
    built: list[Matcher] = []

    @F.pandas_udf(HITS)
    def find(texts: pd.Series) -> pd.Series:
        if not built:
            built.append(Matcher(items, budget))
        return pd.Series([[dict(zip(("item_id", "distance", "match_end"), hit)) for hit in built[0].find(t)] for t in texts])

    return find(text)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, match_end``: a row for each document and item that occurs in it.

    ``distance`` is the smallest number of inserted, deleted or replaced characters between the normalised
    item and any substring of the normalised text, at most ``budget`` of the item's length, rounded down.
    Empty or null items match nothing, empty or null texts hold nothing. Repeated documents give repeated
    rows; repeated items count once; items that share an id give a row each.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    found = lambda hits: rows.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", "hit.*")
    parts = [saved(found(hits_column(block, F.col("_text"), budget))) for block in item_blocks(benchmark, block_chars=block_chars)]
    return reduce(DataFrame.unionByName, parts) if parts else found(F.from_json(F.lit("[]"), HITS))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item occurs, all columns kept.

    Null and empty texts hold nothing and stay, as do all documents where the benchmark is empty; repeated rows stay
    or go together. With a block or less of items the test is one filter; with more, the SHA-256 of texts with a
    hit is written block by block, and these few leave by an anti-join.
    """
    blocks = item_blocks(benchmark, block_chars=block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return docs if first is None else docs.where(F.size(hits_column(first, F.col(text_col), budget)) == 0)
    digest = F.unhex(F.sha2(text_of(text_col), 256))
    gone = []
    while first is not None:
        hit = docs.where(F.size(hits_column(first, F.col(text_col), budget)) > 0)
        gone.append(saved(hit.select(digest.alias("_gone")).distinct()))
        first, second = second, next(blocks, None) if second is not None else None
    left = reduce(DataFrame.unionByName, gone).distinct()
    return docs.join(left, digest == F.col("_gone"), "left_anti")
