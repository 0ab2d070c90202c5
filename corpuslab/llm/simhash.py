"""SimHash near-dedup: exact comparison of all fingerprints, tile against tile.

A fingerprint is made per document in Arrow batches. Equal fingerprints are one node, so exact copies
never meet. Distinct fingerprints are tiled by the population counts of their four 16-bit parts; the
counts of two fingerprints differ by at most as many as their bits do, so only tiles whose counts
differ by no more than the radius in all are compared, with numpy exclusive-or and bit counts. A cell
of equal counts that holds many fingerprints is cut into tiles of bounded size. What a batch of tile
pairs finds is reduced to a spanning forest before it leaves the task, so a large group of near copies
gives a link per member, not per pair, and every component stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import join_facts, same, saved, text_of
from .components import connected

BITS, PARTS, SEED = 64, 4, 42
#: Population counts of one fingerprint take at most this many values: 17 for each of four 16-bit parts.
MAX_CELLS = 17**PARTS
#: Comparisons held in memory at once.
BLOCK = 1 << 18

_SHIFTS = np.arange(8, dtype=np.uint64)
_LANES = np.uint64(0x0101010101010101)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the shingles of ``width`` words, none for a text without words.

    A-Z are lower-cased, a word is a run of bytes other than 0x20 and 0x09-0x0D, shingles come as often
    as they occur, and a text of fewer words is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned SimHash of :func:`shingles`; 0 for a text without words."""
    return print_of(shingles(text, width))


def print_of(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    if len(hashes) < 2:
        return int(hashes.sum())
    # Eight bytes of a word count eight bits at a time; a byte holds 255 rows.
    lanes = (hashes[:, None] >> _SHIFTS) & _LANES
    sums = np.add.reduceat(lanes, np.arange(0, len(hashes), 255), axis=0)
    counts = sums.view(np.uint8).reshape(-1, 8, 8).sum(axis=0, dtype=np.int64)
    on = (counts.T.reshape(BITS) * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    return make(text)


def _cell(fp: Column) -> Column:
    """Population counts of the four parts, each in five bits and raised by four, so that adding an offset never carries."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))) + 4 for i in range(PARTS)]
    return sum((c * F.lit(32**i) for i, c in enumerate(counts)), F.lit(0)).cast("int")


def _offsets(radius: int) -> list[int]:
    """Half of the count differences within the radius, itself included: each pair of cells once."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    return sorted({c for d in steps if (c := sum(x * 32**i for i, x in enumerate(d))) >= 0})


def forest(links: np.ndarray) -> np.ndarray:
    """Star edges (node, smallest node) with the components of ``links``."""
    nodes, at = np.unique(links, return_inverse=True)
    at = at.reshape(links.shape)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        np.minimum.at(new, at[:, 0], low)
        np.minimum.at(new, at[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack((nodes[moved], nodes[label[moved]]), axis=1)


def _near(own: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    found = []
    step = max(1, BLOCK // max(1, len(own)))
    for k in range(0, len(others), step):
        part = others[k : k + step]
        i, j = np.nonzero(np.bitwise_count((own[:, None] ^ part[None, :]).view(np.uint64)) <= radius)
        links = np.stack((own[i], part[j]), axis=1)
        links = links[links[:, 0] != links[:, 1]]
        if len(links):
            found.append(forest(links))
    return np.concatenate(found) if found else np.empty((0, 2), np.int64)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("own"), batch.column("others")
            by_tile: dict[int, list[int]] = {}
            for k, tile in enumerate(batch.column("tile").to_pylist()):
                by_tile.setdefault(tile, []).append(k)
            values = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (left, right)]
            cut = lambda s, k: values[s][0][values[s][1][k] : values[s][1][k + 1]]
            found = [_near(cut(0, ks[0]), np.concatenate([cut(1, k) for k in ks]), radius) for ks in by_tile.values()]
            links = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            if len(links):
                links = forest(links)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = 3, tile_rows: int = 1024) -> DataFrame:
    """``a, b``: links that join the distinct fingerprints ``fp`` of ``prints`` into the components of all pairs within ``radius`` bits."""
    celled = prints.select("fp", _cell(F.col("fp")).alias("cell"))
    cells = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("k"))
    cells = saved(cells.coalesce(1))  # at most MAX_CELLS rows
    tile = (F.col("cell").cast("long") * (1 << 31) + F.pmod(F.xxhash64("fp"), F.col("k"))).alias("tile")
    tiles = saved(celled.join(F.broadcast(cells), "cell").select("fp", tile).groupBy("tile").agg(F.collect_list("fp").alias("fps")))
    near = cells.select(F.col("cell").alias("c"), F.col("k").alias("kc"), F.explode(F.array(*[F.lit(o) for o in _offsets(radius)])).alias("o"))
    near = near.join(F.broadcast(cells), F.col("cell") == F.col("c") + F.col("o"))
    pairs = near.select(F.expr("explode(transform(sequence(0, kc - 1), i -> c * 2147483648L + i))").alias("tile"), "cell", "k").select(
        "tile", F.expr("explode(transform(sequence(0, k - 1), i -> cell * 2147483648L + i))").alias("other")
    )
    pairs = pairs.where("(tile >> 31) <> (other >> 31) or tile <= other")
    tiled = pairs.join(tiles.select(F.col("tile").alias("other"), F.col("fps").alias("others")), "other")
    tiled = tiled.join(tiles.select("tile", F.col("fps").alias("own")), "tile").select("tile", "own", "others")
    return tiled.mapInArrow(_compare(radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Rows link when their fingerprints differ in ``radius`` bits or fewer; the component is named by its
    smallest id. A null or empty text has fingerprint 0 and links like any other. A null id never names
    a component unless all its ids are null. Repeated rows are returned as often as they come; no rows
    give no rows. Only the id and the text are read.
    """
    prints = saved(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(text_of(text_col), width).alias("fp")))
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    roots = connected(near_links(nodes, radius), "a", "b")
    # A root is no node of its own star; it gets one here.
    members = roots.union(roots.select("root", "root").distinct()).join(nodes, F.col("node") == F.col("fp"))
    names = members.groupBy("root").agg(F.min("first_id").alias("name"))
    named = members.join(names, "root").select("fp", "name")
    nodes = saved(nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("name", "first_id").alias("component_id")))
    return join_facts(prints, nodes, ["fp"], "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """The documents whose id names their component; rows that share an id are one document."""
    groups = near_groups(docs, id_col, text_col, width, radius)
    stay = groups.where(same(F.col("doc_id"), F.col("component_id"))).select(F.col("doc_id").alias("_stays"))
    return docs.join(stay, same(docs[id_col], stay["_stays"]), "left_semi")
