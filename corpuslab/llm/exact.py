"""Exact dedup by distributed most-significant-digit radix partitioning.

Documents are split by successive runs of bytes until a group has one member or its texts have ended.
A digit is 64 bytes at first and eight times as long in each round, so the number of rounds is the
logarithm of the longest text. A round groups by (group so far, next bytes, text ends here): the count
is an aggregate with partial sums before the shuffle. The join that carries it back meets one row per
group; the few groups that hold many rows are sent to all tasks, and their rows are not shuffled, so a
group of a third of all rows stays spread. Equality is decided by the bytes themselves. Settled rows leave; only the rest of the bytes of unsettled ones goes on.
The other columns of a document take no part: what goes is told from the rows themselves, by id and digest.

SHA-256 serves two purposes, neither of them equality: it is an output column, and beside the id it
names a group (two groups can only share a name if one id stands for two texts of equal digest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import join_facts, met, same, saved, text_of

FIRST_DIGIT = 64
GROWTH = 8
HOT_BYTES = 1 << 16


def _round(rows: DataFrame, digit: int) -> DataFrame:
    """One split: ``member, sha, best, n, settled, rest, digit, at`` for every row."""
    keyed = rows.withColumn("key", F.struct("best", F.substring("rest", 1, digit).alias("digit"), (F.length("rest") <= digit).alias("ended")))
    groups = saved(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("member.id", "sha")).alias("_best")))
    settled = (F.col("n") == 1) | F.col("key.ended")
    # The longer the digit, the fewer keys are sent to all tasks: 64 kB of digits, or four.
    return join_facts(keyed, groups, ["key"], "n", max(4, HOT_BYTES // digit)).select(
        "member",
        "sha",
        F.col("_best").alias("best"),
        "n",
        settled.alias("settled"),
        F.when(~settled, F.expr(f"substring(rest, {digit + 1})")).alias("rest"),
        F.lit(digit).alias("digit"),
        F.monotonically_increasing_id().alias("at"),
    )


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(text_of(text_col), 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Every row with its group: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes are; a null text is empty. The row with the largest id stays;
    a null id is below all others. Of rows repeated with that id one stays. ``carry`` returns the
    columns of ``docs`` as struct ``row`` beside these; the texts then travel with every round.
    An empty table gives an empty result. Other columns of ``docs`` may have any names.
    """
    member = [F.col(id_col).alias("id")] + ([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else [])
    rows = docs.select(
        F.struct(*member).alias("member"),
        _digest(text_col).alias("sha"),
        F.lit(None).cast("long").alias("best"),
        text_of(text_col).cast("binary").alias("rest"),
    )
    digit, done = FIRST_DIGIT, None
    while True:
        level = saved(_round(rows, digit))
        part = level.where("settled").drop("rest", "settled")
        done = part if done is None else done.unionByName(part)
        rows = level.where("not settled").select("member", "sha", "best", "rest")
        if rows.isEmpty():
            break
        digit *= GROWTH
    return _decide(done, carry)


def _decide(done: DataFrame, carry: bool) -> DataFrame:
    """Marks the row that stays in each settled group; its round and ``at`` tell repeated rows apart."""
    lone = done.where("n = 1").withColumn("kept", F.lit(True))
    many = done.where("n > 1").withColumn("at", F.struct("digit", "at"))
    winner = same(F.col("member.id"), F.col("best.id")) & (F.col("sha") == F.col("best.sha"))
    stays = saved(many.where(winner).groupBy("best").agg(F.min("at").alias("_at"), F.max("n").alias("_n")))
    many = join_facts(many, stays, ["best"], "_n").withColumn("kept", F.col("at") == F.col("_at"))
    columns = [F.col("member.id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256")]
    columns += [F.col("member.row").alias("row")] if carry else []
    return lone.select(*columns).unionByName(many.select(*columns))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``; nulls, empty texts and repeated rows are those of :func:`exact_groups`."""
    copies = exact_groups(docs, id_col, text_col).where("group_size > 1")
    rows = copies.groupBy(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"))
    rows = saved(rows.agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")).where("not _kept or _n > 1"))
    of = [docs[id_col], F.unhex(F.sha2(text_of(docs[text_col]), 256))]
    left = met(docs, rows.select("_id", "_sha"), of, "left_anti")
    again = rows.where("_kept").select("_id", "_sha")
    if again.isEmpty():
        return left
    # Rows that repeat the id and the text of the one that stays: one of them comes back.
    repeated = met(docs, again, of, "left_semi")
    named = repeated.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), _digest(text_col).alias("sha"))
    return left.unionByName(named.groupBy("id", "sha").agg(F.first("row").alias("row")).select("row.*"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same_text AS keep_id, count(*) OVER same_text AS group_size,
       doc_id = max(doc_id) OVER same_text AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same_text AS (PARTITION BY coalesce(text, ''))
"""
