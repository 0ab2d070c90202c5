"""Merkle manifest of a dataset, with a witness for every row.

Rows are leaves; the leaves of a group ascend by id and are folded two by two, a last one alone, until one
node remains; the nodes of the groups are folded likewise. Leaves lie in aligned blocks of ``2 ** LEVELS``, one
row of a written table each. Inside a block leaves are appended one after another: complete subtrees stay
open, and when a sibling subtree completes, the witnesses of both sides are extended by the other's root
(:class:`Appender`). Block roots are appends to blocks of the level above, until a group is one node.
Witnesses then come down again: a block's own witness extends those of its leaves, so every block is read
twice and no leaf is shuffled after its block is made.

A witness is a run of steps of 33 bytes, from the leaf upwards: the side on which the sibling stands, and the
sibling. A step without a sibling still hashes.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..operators.ordering import block_by_bounds, dense_position, order_bounds
from .common import same, saved

#: A block has 2 ** LEVELS leaves: about 30 kB of hashes, and 150 kB of witnesses.
LEVELS = 8
#: Rows ranked in one task, and the most tasks that rank.
RANK_ROWS, RANK_BLOCKS = 4096, 4096
ALONE, LEFT, RIGHT = b"\0", b"\1", b"\2"
STEP = 33


def fold(*nodes: bytes) -> bytes:
    """SHA-256 of the nodes as hex text, one after another."""
    return sha256(b"".join(n.hex().encode() for n in nodes)).digest()


class Appender:
    """A block that grows leaf by leaf. Open subtrees get smaller from left to right, as the bits of a counter."""

    def __init__(self) -> None:
        self.open: list[tuple[int, bytes, int, int]] = []
        self.witness: list[bytearray] = []

    def append(self, leaf: bytes) -> None:
        at = len(self.witness)
        self.witness.append(bytearray())
        node = (0, leaf, at, at + 1)
        while self.open and self.open[-1][0] == node[0]:
            node = self._joined(self.open.pop(), node)
        self.open.append(node)

    def close(self, height: int) -> bytes:
        """The root ``height`` levels above the leaves; subtrees left open rise, alone where no sibling stands."""
        node = self.open.pop()
        while node[0] < height or self.open:
            if self.open and self.open[-1][0] == node[0]:
                node = self._joined(self.open.pop(), node)
            else:
                self._extend(node, ALONE + bytes(32))
                node = (node[0] + 1, fold(node[1]), *node[2:])
        return node[1]

    def _joined(self, left: tuple, right: tuple) -> tuple:
        self._extend(left, RIGHT + right[1])
        self._extend(right, LEFT + left[1])
        return (left[0] + 1, fold(left[1], right[1]), left[2], right[3])

    def _extend(self, node: tuple, step: bytes) -> None:
        for k in range(node[2], node[3]):
            self.witness[k] += step


def height(nodes: int) -> int:
    """Levels that a block rises when its level has ``nodes`` in all."""
    return min(LEVELS, (int(nodes) - 1).bit_length())


def steps(witness: bytes) -> list[tuple[bytes, bytes]]:
    return [(witness[k : k + 1], witness[k + 1 : k + STEP]) for k in range(0, len(witness), STEP)]


def climb(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for side, sibling in steps(witness):
        leaf = fold(leaf) if side == ALONE else fold(sibling, leaf) if side == LEFT else fold(leaf, sibling)
    return leaf


def proof_digest(witness: bytes) -> bytes:
    """SHA-256 of the siblings from the leaf upwards, as hex text."""
    return fold(*(sibling for side, sibling in steps(witness) if side != ALONE))


@F.pandas_udf(T.BinaryType())
def _root(leaves: pd.Series, nodes: pd.Series) -> pd.Series:
    out = []
    for block, n in zip(leaves, nodes):
        tree = Appender()
        for leaf in block:
            tree.append(leaf)
        out.append(tree.close(height(n)))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _witnesses(leaves: pd.Series, nodes: pd.Series, above: pd.Series) -> pd.Series:
    out = []
    for block, n, rest in zip(leaves, nodes, above):
        tree = Appender()
        for leaf in block:
            tree.append(leaf)
        tree.close(height(n))
        out.append([bytes(w + rest) for w in tree.witness])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def climb_column(leaf: pd.Series, witness: pd.Series) -> pd.Series:
    return pd.Series([climb(a, w) for a, w in zip(leaf, witness)], dtype=object)


@F.pandas_udf(T.BinaryType())
def proof_column(witness: pd.Series) -> pd.Series:
    return pd.Series([proof_digest(w) for w in witness], dtype=object)


def leaf_column(*columns: Column) -> Column:
    """SHA-256 as bytes over the columns: ``-`` for null, else byte count, colon, value."""

    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def _tree(level: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Written blocks of every level above ``grp, at, nodes, hash`` (and ``row``), and the last ``grp, hash``.

    ``at`` counts from 0 in each group, ``nodes`` is the number of nodes that the group has there.
    """
    levels = []
    while True:
        carried = [c for c in ("at", "hash", "row") if c in level.columns]
        blocks = level.groupBy("grp", F.shiftright("at", LEVELS).alias("block")).agg(F.max("nodes").alias("nodes"), F.sort_array(F.collect_list(F.struct(*carried))).alias("leaves"))
        # Only ``at`` decides: it is unique in a block.
        levels.append(saved(blocks.select("*", _root(F.col("leaves.hash"), F.col("nodes")).alias("root"))))
        level = levels[-1].select("grp", F.col("block").alias("at"), F.ceil(F.col("nodes") / (1 << LEVELS)).cast("bigint").alias("nodes"), F.col("root").alias("hash"))
        if (level.agg(F.max("nodes")).first()[0] or 0) <= 1:
            return levels, level.select("grp", "hash")


def _down(levels: list[DataFrame], tops: DataFrame, *named: str) -> DataFrame:
    """Leaves with their witnesses, from the one node of each group: ``grp, witness`` and ``named`` columns."""
    above = tops.select("grp", F.lit(0).cast("bigint").alias("block"), "witness", *named)
    for blocks in reversed(levels):
        above = above.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), F.col("witness").alias("_w"), *named)
        met = blocks.drop("root").join(above, same(F.col("grp"), F.col("_g")) & (F.col("block") == F.col("_b")))
        paired = F.arrays_zip("leaves", _witnesses(F.col("leaves.hash"), F.col("nodes"), F.col("_w")).alias("witness"))
        met = met.select("grp", F.explode(paired).alias("pair"), *named)
        leaf = [F.col(f"pair.leaves.{c}").alias("block" if c == "at" else c) for c in blocks.schema["leaves"].dataType.elementType.names]
        above = met.select("grp", *leaf, F.col("pair.witness").alias("witness"), *named)
    return above


def witnesses(rows: DataFrame) -> DataFrame:
    """``grp, id, leaf, row, witness, subroot, root`` for every row of ``grp, id, leaf, row``.

    ``leaf`` is 32 bytes, ``row`` any struct to be carried. In a group leaves ascend by id, null first, equal
    ids by leaf; groups ascend by UTF-8 bytes, null first. A hot group is ranked in as many tasks as its rows
    need. Repeated rows are leaves of their own; no rows give no rows.
    """
    rows = saved(rows)
    sizes = saved(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("nodes")))
    total = sizes.agg(F.sum("nodes")).first()[0] or 0
    bounds = order_bounds(rows, "id", min(max(1, total // RANK_ROWS), RANK_BLOCKS)) if total else []
    order = [F.col("id").asc_nulls_first(), F.col("leaf")]
    placed = dense_position(rows, order, block_by_bounds(F.col("id"), bounds), ["grp"], "at")
    sized = placed.join(sizes.withColumnRenamed("grp", "_g"), same(F.col("grp"), F.col("_g")))
    row = F.struct("id", F.col("row").alias("carried"))
    levels, subroots = _tree(sized.select("grp", "at", "nodes", F.col("leaf").alias("hash"), row.alias("row")))

    # One row per group from here on; the tree of groups has one group itself.
    named = subroots.select(F.col("grp").alias("name"), "hash")
    count = named.count()
    bounds = order_bounds(named, "name", min(max(1, count // RANK_ROWS), RANK_BLOCKS)) if count else []
    ranked = dense_position(named, [F.col("name").asc_nulls_first()], block_by_bounds(F.col("name"), bounds), out="at")
    top = ranked.select(F.lit(0).alias("grp"), "at", F.lit(count).cast("bigint").alias("nodes"), "hash", F.struct("name").alias("row"))
    upper, root = _tree(top)
    root = root.select("grp", F.lit(b"").alias("witness"), F.col("hash").alias("root"))
    tops = saved(_down(upper, root, "root").select(F.col("row.name").alias("grp"), F.col("hash").alias("subroot"), "witness", "root"))
    down = _down(levels, tops, "subroot", "root")
    return down.select("grp", F.col("row.id").alias("id"), F.col("hash").alias("leaf"), F.col("row.carried").alias("row"), "witness", "subroot", "root")


def tampered(id_col: Column) -> Column:
    """Rows picked to be changed by :func:`audit`; a null id is never picked."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def audit(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every document.

    Documents are grouped by language. ``folded_root`` is what a document leads to with its own witness, after
    one has been added to ``n_chars`` of the :func:`tampered` ones (null stays null), so ``verified`` is false
    for these. Nulls in any column are values of their own, an empty text has zero bytes; documents that share
    an id follow each other by leaf; other columns are not read; no documents give no rows.
    """
    fields = [F.col(c) for c in (id_col, source_col, lang_col, size_col, text_col)]
    grown = [*fields[:3], (fields[3].cast("decimal(20,0)") + 1).cast("decimal(20,0)"), fields[4]]
    changed = F.when(tampered(fields[0]), leaf_column(*grown))
    rows = docs.select(F.col(lang_col).alias("grp"), F.col(id_col).alias("id"), leaf_column(*fields).alias("leaf"), F.struct(changed.alias("changed")).alias("row"))
    found = witnesses(rows)
    reached = climb_column(F.coalesce("row.changed", "leaf"), F.col("witness"))
    found = found.select("id", "leaf", "subroot", "root", proof_column("witness").alias("proof"), reached.alias("reached"))
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias("doc_id"),
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        text("proof").alias("proof_sha256"),
        text("reached").alias("folded_root"),
        (F.col("reached") == F.col("root")).alias("verified"),
    )


_FIELDS = " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "{n}", "text")
)

#: CRC-32 bit by bit, and one level of the tree per step of a recursive query.
ORACLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, sha256({_FIELDS.format(n='n_chars')}) AS leaf, sha256({_FIELDS.format(n='(n_chars + 1)')}) AS changed,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 7 = 0 AS picked
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS nodes FROM docs),
below(lang, level, pos, nodes, hash) AS (
  SELECT lang, 0, pos, nodes, leaf FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (any_value(nodes) + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM below WHERE nodes > 1 GROUP BY lang, level, pos // 2),
subroots AS (SELECT lang, hash AS subroot, level AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS groups FROM below WHERE nodes = 1),
upper(level, pos, nodes, hash) AS (
  SELECT 0, place, groups, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (any_value(nodes) + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM upper WHERE nodes > 1 GROUP BY level, pos // 2),
top AS (SELECT hash AS root, level AS height FROM upper WHERE nodes = 1),
path AS (
  SELECT p.doc_id, p.leaf, s.lang, p.pos AS start, b.level, b.hash AS sibling, b.pos < (p.pos >> b.level) AS before
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang JOIN below b ON b.lang IS NOT DISTINCT FROM p.lang AND b.level < s.depth AND b.pos = xor(p.pos >> b.level, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, s.lang, p.pos, s.depth + u.level, u.hash, u.pos < (s.place >> u.level)
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang, top t, upper u WHERE u.level < t.height AND u.pos = xor(s.place >> u.level, 1)),
proofs AS (SELECT lang, start, sha256(string_agg(sibling, '' ORDER BY level)) AS proof FROM path GROUP BY lang, start),
climb(lang, start, level, last, hash) AS (
  SELECT p.lang, p.pos, 0, s.depth + t.height, CASE WHEN p.picked THEN p.changed ELSE p.leaf END FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang, top t
  UNION ALL
  SELECT c.lang, c.start, c.level + 1, c.last, sha256(CASE WHEN p.sibling IS NULL THEN c.hash WHEN p.before THEN p.sibling || c.hash ELSE c.hash || p.sibling END)
  FROM climb c LEFT JOIN path p ON p.lang IS NOT DISTINCT FROM c.lang AND p.start = c.start AND p.level = c.level WHERE c.level < c.last)
SELECT p.doc_id, p.leaf, s.subroot, t.root, coalesce(f.proof, sha256('')) AS proof_sha256, c.hash AS folded_root, c.hash = t.root AS verified
FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
LEFT JOIN proofs f ON f.lang IS NOT DISTINCT FROM p.lang AND f.start = p.pos
JOIN climb c ON c.lang IS NOT DISTINCT FROM p.lang AND c.start = p.pos AND c.level = c.last, top t
"""
