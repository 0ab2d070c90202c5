"""Near-dedup of documents by the Jaccard similarity of their five-word shingles.

Candidates come from SimHash tiles (:func:`.simhash.near_links` on fingerprints of the shingle sets) and, as a
similarity of 0.8 leaves about ten bits different, from bands of a MinHash signature: at 0.8 a band of five agrees
with probability 0.33, so all of 24 bands differ once in 13,000 pairs, and the more alike, the less often.

Candidates that hang together are a cluster, whose members are dealt to tiles of bounded size. A task compares two
tiles: exclusive-or and bit counts of the fingerprints first, then the shingle sets themselves. What it finds
leaves it as a spanning forest, never as pairs. A cluster of many tiles is not compared all against all: every
tile meets itself and the first one; what this joins most widely stays together, and only members left outside
of it meet all tiles. So a cluster that coheres costs comparisons in proportion to its size, and no link is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import simhash
from .common import join_facts, met, same, saved, text_of
from .components import connected

WIDTH, SIMILARITY = 5, 0.8
BANDS, BAND = 24, 5
#: Bits in which fingerprints of similar sets may differ; 0.8 gives ten on average, 24 are exceeded once in 10,000.
RADIUS = 24
#: Members and shingles of a tile on average.
TILE_ROWS, TILE_SHINGLES = 256, 1 << 18
#: Shingles hashed or compared at once; bounds a task's memory whatever the length of a text.
AT_ONCE = 4096
DIGEST = ("d1", "d2")

_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * BAND, np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles in order; all texts without words hold the same one."""
    found = simhash.shingles(text, width)
    return np.unique(found) if len(found) else np.zeros(1, np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed long per band of the MinHash signature."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), AT_ONCE):
        least = np.minimum(least, (hashes[None, k : k + AT_ONCE] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1))
    digests = [xxhash.xxh64_intdigest(least[b * BAND : (b + 1) * BAND].tobytes(), b) for b in range(BANDS)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def _prints(text: Column, width: int) -> Column:
    @F.pandas_udf("fp long, size int, keys array<long>")
    def make(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in texts]
        prints = np.array([simhash.print_of(s) for s in sets], np.uint64).view(np.int64)
        return pd.DataFrame({"fp": prints, "size": [len(s) for s in sets], "keys": [band_keys(s) for s in sets]})

    return make(text)


def _sets(text: Column, width: int) -> Column:
    @F.pandas_udf("array<long>")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).view(np.int64) for t in texts])

    return make(text)


def common_counts(own: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """(own, others) numbers of shared elements of sets, by products of 0-1 blocks over the shared elements."""
    left, right = np.concatenate(own), np.concatenate(others)
    shared = np.intersect1d(np.unique(left), np.unique(right), assume_unique=True)
    out = np.zeros((len(own), len(others)), np.float32)
    if not len(shared):
        return out

    def placed(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return row[hit][order], at[hit][order]

    sides = placed(own, left), placed(others, right)
    for k in range(0, len(shared), AT_ONCE):
        blocks = []
        for (row, at), sets in zip(sides, (own, others)):
            a, b = np.searchsorted(at, (k, k + AT_ONCE))
            block = np.zeros((len(sets), AT_ONCE), np.float32)
            block[row[a:b], at[a:b] - k] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    return out


def verified(own: tuple, others: tuple, similarity: float, radius: int = RADIUS) -> np.ndarray:
    """Links (node, node) between similar members of two tiles, as a spanning forest.

    A tile is (nodes, fingerprints, labels, sets); members that share a label are joined already.
    """
    empty = np.empty((0, 2), np.int64)
    if not len(own[0]) or not len(others[0]):
        return empty
    near = np.bitwise_count(own[1][:, None] ^ others[1][None, :]) <= radius
    near &= own[2][:, None] != others[2][None, :]
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return empty
    left, right = [own[3][k] for k in rows], [others[3][k] for k in columns]
    shared = common_counts(left, right)
    total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - shared
    i, j = np.nonzero((shared >= similarity * total - 1e-6) & near[np.ix_(rows, columns)])
    links = np.stack((own[0][rows[i]], others[0][columns[j]]), axis=1)
    return simhash.forest(links) if len(links) else empty


def _compare(similarity: float):
    """For rows ``first, node, fp, label, set`` of one pair of tiles; ``first`` is null in a tile that meets itself."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first = table.column("first").to_pylist()
        nodes, labels = (np.asarray(table.column(c)).astype(np.int64) for c in ("node", "label"))
        prints = np.asarray(table.column("fp")).astype(np.int64).view(np.uint64)
        lists = table.column("set").combine_chunks()
        flat, ends = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths()))))
        side = lambda keep: (nodes[keep], prints[keep], labels[keep], [flat[ends[k] : ends[k + 1]] for k in keep])
        whole = side(np.arange(len(nodes))) if None in first else None
        left, right = (whole, whole) if whole else (side(np.flatnonzero(first)), side(np.flatnonzero(~np.array(first, bool))))
        links = verified(left, right, similarity)
        return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})

    return run


def _links(dealt: DataFrame, similarity: float) -> DataFrame:
    return saved(dealt.groupBy("root", "x", "y").applyInArrow(_compare(similarity), "a long, b long"))


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the smallest node that links join each to, as ``label``."""
    roots = connected(links, "a", "b").withColumnsRenamed({"node": "_n", "root": "_l"})
    return members.join(roots, F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("_l", "node")).drop("_n", "_l")


def cluster_links(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: links that join ``root, tile, tiles, node, fp, set`` into the components of all similar pairs of a cluster."""
    wide = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda y: F.struct(F.lit(0).alias("x"), y.alias("y"), F.when(y > 0, F.lit(True)).alias("first")))
    slim = F.array(F.struct(F.lit(0).alias("x"), F.col("tile").alias("y"), F.lit(False).alias("first")), F.struct(F.col("tile").alias("x"), F.col("tile").alias("y"), F.lit(None).cast("boolean").alias("first")))
    begun = members.select("root", F.inline(F.when(F.col("tile") == 0, wide).otherwise(slim)), "node", "fp", F.col("node").alias("label"), "set")
    begun = _links(begun, similarity)
    split = members.where("tiles > 1")
    if not split.limit(1).count():
        return begun
    split = saved(_labelled(split, begun))
    sizes = split.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("m"))
    split = saved(join_facts(split, saved(main), ["root"], "m"))
    # Members outside the widest group of their cluster meet every tile of it.
    rest = split.where("label <> main")
    facts = saved(rest.groupBy("root").agg(_tiles_of(F.count(F.lit(1)), F.sum(F.size("set"))).alias("others"), F.max("m").alias("m")))
    asked = join_facts(rest.drop("m"), facts, ["root"], "m")
    asked = asked.select("root", F.pmod(F.xxhash64("node", F.lit(1)), F.col("others")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("y"), F.lit(True).alias("first"), "node", "fp", "label", "set")
    others = join_facts(split.drop("m"), facts, ["root"], "m")
    others = others.select("root", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("x"), F.col("tile").alias("y"), F.lit(False).alias("first"), "node", "fp", "label", "set")
    return begun.unionByName(_links(asked.unionByName(others), similarity))


def _tiles_of(rows: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(rows / TILE_ROWS, shingles / TILE_SHINGLES)).cast("int")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` for every row.

    Rows link when the Jaccard similarity of their sets of shingles is ``similarity`` or more; the component is
    named by its smallest id. A null text is an empty one; texts without words are alike. A null id never names
    a component unless all its ids are null. Repeated rows are returned as often as they come; no rows give no
    rows. Only the id and the text are read.
    """
    text = text_of(text_col)
    digest = [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("2"), text).alias("d2")]
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), *digest, _prints(text, width).alias("p")).select("doc_id", *DIGEST, "p.*"))
    nodes = rows.groupBy(*DIGEST).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = saved(nodes.select("*", F.monotonically_increasing_id().alias("node")))

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    keys = saved(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where("n > 1"))
    shared = join_facts(keyed, keys, ["key"], "n").select("node", "head")
    prints = saved(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")))
    ends = prints.select("fp", "head")
    near = simhash.near_links(prints, 3).join(ends.toDF("a", "node"), "a").join(ends.toDF("b", "head"), "b").select("node", "head")
    alike = join_facts(nodes.select("fp", "node"), prints, ["fp"], "n").select("node", "head")
    clusters = connected(shared.unionByName(near).unionByName(alike), "node", "head")

    members = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    members = saved(members.join(nodes.select("node", "n", "fp", "size", *DIGEST), "node"))
    facts = saved(members.groupBy("root").agg(F.count(F.lit(1)).alias("c"), _tiles_of(F.count(F.lit(1)), F.sum("size")).alias("tiles")))
    members = join_facts(members, facts, ["root"], "c").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    members = saved(members.select("root", "tile", "tiles", "node", "fp", "n", *DIGEST))
    # Texts of others leave before anything is joined; two longs a member are sent to all tasks as long as they are few.
    texts = docs.select(*digest, text.alias("text"))
    texts = met(texts, members.select(*DIGEST), [texts[c] for c in DIGEST], "left_semi")
    texts = join_facts(texts, members, DIGEST, "n")
    members = saved(texts.dropDuplicates(["node"]).select("root", "tile", "tiles", "node", "fp", _sets(F.col("text"), width).alias("set")))

    named = _labelled(nodes.select("node", "first_id", "n", *DIGEST), cluster_links(members, similarity))
    names = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = saved(join_facts(saved(named), saved(names), ["label"], "m").select(*DIGEST, "n", "component_id"))
    return join_facts(rows.select("doc_id", *DIGEST), named, DIGEST, "n").select("doc_id", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The documents whose id names their component, all columns kept; rows that share an id are one document.

    Null ids and texts are those of :func:`near_groups`; no rows give no rows.
    """
    groups = near_groups(docs, id_col, text_col, width, similarity)
    names = F.max(same(F.col("doc_id"), F.col("component_id")))
    # The few that go, not the many that stay, meet the documents: as long as they are few no text is shuffled.
    gone = saved(groups.groupBy("doc_id").agg(names.alias("names")).where("NOT names").select(F.col("doc_id").alias("_gone")))
    return met(docs, gone, [docs[id_col]], "left_anti")
