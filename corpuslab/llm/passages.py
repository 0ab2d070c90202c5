"""Substring dedup by line or paragraph hashing.

Units are cut and normalised in Arrow batches and reduced to 16-byte digests with their offsets. One
aggregate per digest finds the earliest occurrence, with partial results before the shuffle; the digests that
hold many units are few and are sent to all tasks, so a unit that stands in a third of all documents is
marked where it lies. The marks of a document meet its text once, at the end.

A passage that documents share rarely begins and ends at a line break, so the unit of the query is a line cut at
sentence ends. Short sentences also repeat by chance: a repeated unit of few words goes only beside a longer one
that goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import join_facts, saved, text_of

LINE, PARAGRAPH = r"\n", r"\n[\x20\t]*\n+"
#: A line break, or the blanks after a sentence end.
SENTENCE = r"\n|(?<=[.!?])[\x20\t]+"
#: Words from which on a repeated unit goes by itself.
MIN_WORDS = 4
_UNITS = "rank struct<no_id: boolean, id: long, text: long, at: long, nr: int>, digest: binary"


def units(text: str, separator: str = LINE) -> list[tuple[int, int, int]]:
    """(start, end, end with separator) of the stretches between separators, in code points, empty ones included."""
    cuts = [m.span() for m in re.finditer(separator, text)]
    return list(zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)], [*(b for _, b in cuts), len(text)]))


def normalise(unit: str) -> bytes:
    """A-Z in lower case, runs of 0x20 and 0x09-0x0D as one space, none at the ends."""
    return b" ".join(unit.encode("utf-8", "surrogatepass").lower().split())


def filled(text: str, separator: str) -> list[tuple[int, int, int, bytes]]:
    """The units that are not blank, each with its normalised bytes."""
    return [(*u, unit) for u in units(text, separator) if (unit := normalise(text[u[0] : u[1]]))]


def _cut(separator: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for at, key, mark, text in zip(frame["at"].tolist(), frame["id"].tolist(), frame["mark"].tolist(), frame["text"]):
                key = None if key is None else int(key)
                for nr, (*_, unit) in enumerate(filled(text, separator)):
                    rows.append(((key is None, key, mark, at, nr), blake2b(unit, digest_size=16).digest()))
            yield pd.DataFrame(rows, columns=["rank", "digest"])

    return run


def removed(text: str, repeats: set[int], separator: str, min_words: int) -> list[tuple[int, int, int]]:
    """Of the repeated units of a document, by number, those of ``min_words`` words or more and their direct neighbours."""
    found = filled(text, separator)
    long = {nr for nr in repeats if found[nr][3].count(b" ") + 1 >= min_words}
    return [found[nr][:3] for nr in sorted(repeats) if nr in long or nr - 1 in long or nr + 1 in long]


def _apply(separator: str, min_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, repeats in zip(frame["text"], frame["cut"]):
                spans = removed(text, set(map(int, repeats)), separator, min_words) if repeats is not None else []
                kept, done = [], 0
                for lo, _, upto in spans:
                    kept.append(text[done:lo])
                    # The separator after a removed unit goes with it.
                    done = upto
                kept.append(text[done:])
                out.append(("".join(kept), sum(hi - lo for lo, hi, _ in spans), len(spans), ",".join(f"{lo}:{hi}" for lo, hi, _ in spans)))
            done = pd.DataFrame(out, columns=["kept_text", "n_removed", "n_spans", "spans"])
            yield pd.concat([frame[["id", "n_chars"]].reset_index(drop=True), done], axis=1)

    return run


def drop_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = SENTENCE, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, n_chars, n_removed, n_spans, spans, kept_text`` for every row.

    Units are what stands between matches of ``separator``. A unit is repeated where units with equal normalised
    bytes stand before it, by id, then place in the text, also within one document. A repeated unit goes if it has
    ``min_words`` words, or if the unit before or after it, blank ones not counted, is one that does. Blank units
    stay and are no repeats. ``spans`` are the removed units as start:end in code points of the original text; the
    separator after one goes with it. Null ids come last; rows that share an id are ordered by a hash of the
    text, so of repeated rows one keeps its units. A null text is empty; no rows give no rows.
    """
    numbered = saved(docs.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).cast("long").cast("string").alias("id"), text_of(text_col).alias("text")))
    cut = saved(numbered.withColumn("mark", F.xxhash64("text")).mapInPandas(_cut(separator), _UNITS))
    first = saved(cut.groupBy("digest").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "n", "first.at", "first.nr").toDF("digest", "n", "first_at", "first_nr"))
    # Only the number of a unit goes on; its place is found again in the text.
    places = cut.select("digest", F.col("rank.at").alias("at"), F.col("rank.nr").alias("nr"))
    later = join_facts(places, first, ["digest"], "n").where((F.col("at") != F.col("first_at")) | (F.col("nr") != F.col("first_nr")))
    cuts = later.groupBy("at").agg(F.collect_list("nr").alias("cut"))
    joined = numbered.join(cuts, "at", "left").select("id", F.length("text").cast("long").alias("n_chars"), "text", "cut")
    done = joined.mapInPandas(_apply(separator, min_words), "id string, n_chars long, kept_text string, n_removed long, n_spans long, spans string")
    return done.select(F.col("id").cast("long").alias("doc_id"), "n_chars", "n_removed", "n_spans", "spans", "kept_text")


def digests(docs: DataFrame, separator: str = SENTENCE, min_words: int = MIN_WORDS) -> DataFrame:
    """:func:`drop_repeated_units` with a digest in place of the kept text; rows and odd cases are the same."""
    done = drop_repeated_units(docs, separator=separator, min_words=min_words)
    return done.select("doc_id", "n_chars", "n_removed", "n_spans", "spans", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The units as DuckDB sees them, each with its separator; two rows with one id and one text do not occur in the given tables.
ORACLE = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]*?(?:[.!?][\x20\t]+|\n|\z)') AS parts FROM documents
), lens AS (
  SELECT doc_id, unnest(parts) AS whole, unnest(generate_series(1, len(parts))) AS nr FROM cut
), placed AS (
  SELECT doc_id, nr, whole, length(regexp_replace(whole, '(?:([.!?])[\x20\t]+|\n)\z', '\1')) AS n,
         sum(length(whole)) OVER (PARTITION BY doc_id ORDER BY nr) - length(whole) AS lo,
         trim(regexp_replace(translate(whole, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM lens
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, nr) > 1 AS again, len(string_split(norm, ' ')) >= MIN_WORDS AS long FROM placed WHERE norm <> ''
), beside AS (
  SELECT doc_id, nr, again AND (long OR coalesce(lag(again AND long) OVER w, false) OR coalesce(lead(again AND long) OVER w, false)) AS gone
  FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY nr)
), done AS (SELECT p.*, coalesce(gone, false) AS gone FROM placed p LEFT JOIN beside USING (doc_id, nr))
SELECT d.doc_id, any_value(length(coalesce(text, '')))::BIGINT AS n_chars, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed, count(*) FILTER (gone) AS n_spans,
       coalesce(string_agg(lo || ':' || (lo + n), ',' ORDER BY nr) FILTER (gone), '') AS spans,
       sha256(coalesce(string_agg(whole, '' ORDER BY nr) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id) GROUP BY d.doc_id
""".replace("MIN_WORDS", str(MIN_WORDS))
