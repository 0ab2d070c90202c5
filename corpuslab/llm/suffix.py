"""Suffix-array dedup with run-length indexes: long byte strings that also start in an earlier document go.

Two places that share a string of 50 bytes share the smallest-hashed 12 bytes in it. So the windows of a
text are cut into strings, one for each stretch of windows with the same such seed, and dealt to buckets
by the seed: all windows of equal bytes meet in one bucket, whatever surrounds them. Buckets are sized
by the text, a document's strings are spread over all of them, and seeds that take an outsized part of
all strings (a passage in a third of all documents) are ranked behind all others, so that only windows
within such a passage still go by them; those are equal strings and collapse before the shuffle.

In a bucket, strings that no other document's string can meet are set aside by the 31 bytes to either
side of the seed, and equal strings are one. Strings that can be the earlier one are indexed (:mod:`run_index`), the others are streamed
against the index, and where a match reaches 50 bytes the least document among the indexed suffixes
with those 50 bytes decides. Marks go back to their documents, whose texts are shuffled once, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from .common import text_of
from .run_index import RunIndex

MATCH, SEED = 50, 12
#: Seeds of one window, longest string of one seed, and bytes that a seed has on one side at least.
SEEDS = MATCH - SEED + 1
WIDTH = 2 * MATCH - SEED
SIDE = (MATCH - SEED) // 2
#: Text worked on at once, strings packed at once, and bytes of strings in a bucket.
PIECE, FLUSH, BUCKET = 1 << 18, 250_000, 96 << 20
#: Strings of a bucket that are worked on at a time: it is taken in as many parts, by the seed, as that needs.
PART_STRINGS = 200_000
#: Buckets of a small table.
FEWEST = 16
#: Bytes of strings in one index, unless one seed has more.
INDEX = 1 << 20
#: Seeds fall in so many classes; a class with more than this part of all strings is ranked last.
CLASSES, OUTSIZED = 1 << 16, 1 / 1024

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_MIX = _U(0xBF58476D1CE4E5B9)
_WORDS = np.random.default_rng(50).integers(1, 1 << 63, WIDTH // 8, dtype=np.uint64) * _U(2) + _U(1)


def seed_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes from each place on."""
    with np.errstate(over="ignore"):
        one = raw.astype(np.uint64)
        two = one[:-1] * _ODD + one[1:]
        four = two[:-2] * (_ODD * _ODD) + two[2:]
        eight = four[:-4] * (_ODD**_U(4)) + four[4:]
        out = eight[: len(raw) - SEED + 1] * (_ODD**_U(4)) + four[8:]
        out = (out ^ (out >> _U(31))) * _MIX
    return out ^ (out >> _U(29))


def seed_class(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(8)).astype(np.int64) & (CLASSES - 1)


def cut(raw: np.ndarray, doc: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, length, place of the seed and its hash of all strings of ``raw``; ``doc`` is the document of each byte, ``late`` flags outsized classes."""
    n = len(raw) - MATCH + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    hashes = seed_hashes(raw)
    # The leftmost smallest: the hash above, the place below.
    key = (hashes >> _U(33) << _U(32)) | (late[seed_class(hashes)].astype(np.uint64) << _U(63)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    low = key
    while size * 2 <= SEEDS:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[SEEDS - size : SEEDS - size + n])
    seed = (low & _U(0xFFFFFFFF)).astype(np.int64)
    whole = doc[:n] == doc[MATCH - 1 : MATCH - 1 + n]
    new = np.concatenate(([True], (seed[1:] != seed[:-1]) | (whole[1:] != whole[:-1])))
    start = np.flatnonzero(new)
    windows = np.diff(np.concatenate((start, [n])))
    start, windows = start[whole[start]], windows[whole[start]]
    return start, windows + MATCH - 1, seed[start] - start, hashes[seed[start]]


def padded(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(n, WIDTH) bytes of the strings, zero beyond their lengths."""
    out = sliding_window_view(np.concatenate((raw, np.zeros(WIDTH, np.uint8))), WIDTH)[start]
    out[np.arange(WIDTH)[None, :] >= length[:, None]] = 0
    return out


def distinct(strings: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal strings together, and the number of its group for each string in that order."""
    with np.errstate(over="ignore"):
        code = length.astype(np.uint64) * _MIX
        for k, word in enumerate(strings.view(np.uint64).T):
            code = (code ^ word) * _WORDS[k]
            code ^= code >> _U(32)
    order = np.argsort(code)
    code, placed = code[order], strings[order]
    new = (code[1:] != code[:-1]) | (placed[1:] != placed[:-1]).any(axis=1) | (length[order][1:] != length[order][:-1])
    return order, np.cumsum(np.concatenate(([0], new)))[: len(order)]


# --- from texts to buckets ------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, document of each byte, and rank, tag, first place of each document, for about PIECE bytes at a time.

    A longer text comes in pieces that overlap by MATCH - 1 bytes: each window is in one of them.
    """
    held: list[tuple[bytes, int, int, int]] = []
    size = 0

    def joined():
        parts = [np.frombuffer(x[0], np.uint8) for x in held]
        doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        return np.concatenate(parts), doc, np.array([x[1] for x in held]), np.array([x[2] for x in held]), np.array([x[3] for x in held])

    for batch in batches:
        for text, rank, tag in zip(batch.column("text"), batch.column("rank").to_pylist(), batch.column("tag").to_pylist()):
            raw = text.as_py()
            for at in range(0, max(1, len(raw) - MATCH + 1), PIECE):
                part = raw[at : at + PIECE + MATCH - 1]
                if len(part) < MATCH:
                    continue
                held.append((part, rank, tag, at))
                size += len(part)
                if size >= PIECE:
                    yield joined()
                    held.clear()
                    size = 0
    if held:
        yield joined()


def _classes(late: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES, np.int64)
        for raw, doc, *_ in _pieces(batches):
            counts += np.bincount(seed_class(cut(raw, doc, late)[3]), minlength=CLASSES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["class", "n"])

    return run


class _Strings:
    """Strings of several pieces until they are packed."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.n = self.docs = 0

    def add(self, raw, doc, rank, tag, at, late) -> None:
        start, length, seed, code = cut(raw, doc, late)
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        owner = doc[start]
        self.parts.append((padded(raw, start, length), length.astype(np.uint8), seed.astype(np.uint8), code, owner + self.docs, start - first[owner] + at[owner], rank, tag))
        self.n += len(start)
        self.docs += len(rank)

    def packed(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        if not self.n:
            return
        strings, length, seed, code, owner, place, rank, tag = (np.concatenate(x) for x in zip(*self.parts))
        self.__init__()
        bucket = ((code >> _U(20)) % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=5)
        for b in range(buckets):
            at = order[edges[b] : edges[b + 1]]
            if len(at):
                yield b, squeeze.compress(_pack(strings[at], length[at], seed[at], owner[at], place[at], rank, tag))


def _pack(strings, length, seed, owner, place, rank, tag) -> bytes:
    """Each distinct string once, with its occurrences; those in a document after its first in this batch are marks already."""
    docs, owner = np.unique(owner, return_inverse=True)
    rank, tag = rank[docs], tag[docs]
    order, group = distinct(strings, length)
    heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    # In the order of their first places, where neighbours compress well.
    least = np.minimum.reduceat(rank[owner[order]], heads)
    first = np.minimum.reduceat(order, heads)
    turn = np.argsort(first)
    number = np.empty(len(turn), np.int64)
    number[turn] = np.arange(len(turn))
    which = np.empty(len(order), np.int64)
    which[order] = number[group]
    least, first = least[turn], first[turn]
    later = rank[owner] > least[which]
    open_ = np.flatnonzero(~later)
    marks = np.flatnonzero(later)
    kept, size = strings[first], length[first]
    flat = kept[np.arange(WIDTH)[None, :] < size[:, None]]
    step = np.diff(which[open_], prepend=0)
    arrays = [rank, tag, size, seed[first], flat, step.astype(np.int32), owner[open_].astype(np.int32), place[open_].astype(np.int64), owner[marks].astype(np.int32), place[marks].astype(np.int64), length[marks]]
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64).tobytes()
    return head + b"".join(x.tobytes() for x in arrays)


_TYPES = (np.int64, np.int64, np.uint8, np.uint8, np.uint8, np.int32, np.int32, np.int64, np.int32, np.int64, np.uint8)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, count, 8)
    ends = 8 + 8 * count + np.cumsum(sizes)
    return [np.frombuffer(raw[e - s : e], t) for e, s, t in zip(ends.tolist(), sizes.tolist(), _TYPES)]


def _strings(buckets: int, late: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Strings()

        def flush() -> Iterator[pa.RecordBatch]:
            for b, blob in held.packed(buckets):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], names=["bucket", "blob"])

        for piece in _pieces(batches):
            held.add(*piece, late)
            if held.n >= FLUSH:
                yield from flush()
        yield from flush()

    return run


# --- in a bucket ----------------------------------------------------------------


def _sides(strings: np.ndarray, seed: np.ndarray, length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which strings, hash of the seed with SIDE bytes to its left, or right). Every window of a string has one of the two."""
    span = SEED + SIDE
    views = sliding_window_view(strings, span, axis=1)
    out = []
    for begin in (seed.astype(np.int64) - SIDE, seed.astype(np.int64)):
        which = np.flatnonzero((begin >= 0) & (begin + span <= length))
        part = views[which, begin[which]]
        with np.errstate(over="ignore"):
            code = np.zeros(len(which), np.uint64)
            for k in range(span):
                code = code * _ODD + part[:, k]
            code = (code ^ (code >> _U(31))) * _MIX
        out.append((which, code))
    return out


def _met(sides: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each string, is there a later, an earlier document with the same bytes on one side?"""
    has_later, has_earlier = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    for which, code in sides:
        if not len(which):
            continue
        order = np.argsort(code)
        heads = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
        own = rank[which[order]]
        sizes = np.diff(np.concatenate((heads, [len(order)])))
        high = np.repeat(np.maximum.reduceat(own, heads), sizes)
        low = np.repeat(np.minimum.reduceat(own, heads), sizes)
        has_later[which[order]] |= own < high
        has_earlier[which[order]] |= own > low
    return has_later, has_earlier


def _unflat(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros((len(size), WIDTH), np.uint8)
    out[np.arange(WIDTH)[None, :] < size[:, None]] = flat
    return out


def search(strings: np.ndarray, length: np.ndarray, seed: np.ndarray, rank: np.ndarray, source: np.ndarray, query: np.ndarray) -> np.ndarray:
    """(n, windows) flags: does the window also start in a string of a smaller rank? The strings are distinct.

    Strings with one seed are in one index; an index has about INDEX bytes.
    """
    covered = np.zeros((len(strings), WIDTH - MATCH + 1), bool)
    if not len(strings):
        return covered
    views = sliding_window_view(strings, SEED, axis=1)[np.arange(len(strings)), seed]
    order = np.lexsort(np.ascontiguousarray(views).view(np.uint32).T)
    new = np.concatenate(([True], (views[order][1:] != views[order][:-1]).any(axis=1)))
    heads = np.flatnonzero(new)
    block = (np.cumsum(length[order].astype(np.int64)) // INDEX)[heads]
    for part in np.split(order, heads[1:][block[1:] != block[:-1]]):
        covered[part] = _search(strings[part], length[part], rank[part], source[part], query[part])
    return covered


def _search(strings: np.ndarray, length: np.ndarray, rank: np.ndarray, source: np.ndarray, query: np.ndarray) -> np.ndarray:
    covered = np.zeros((len(strings), WIDTH - MATCH + 1), bool)
    if not source.any() or not query.any():
        return covered
    index = RunIndex(strings[source], length[source].astype(np.int64), MATCH)
    least = index.long_groups(rank[source])
    asked = np.flatnonzero(query)
    for k in range(0, len(asked), 1 << 15):
        part = asked[k : k + (1 << 15)]
        size, place = index.statistics(strings[part], length[part].astype(np.int64))
        size, place = size[:, : covered.shape[1]], place[:, : covered.shape[1]]
        covered[part] = (size >= MATCH) & (least[place] < rank[part][:, None])
    return covered


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last + 1) of the stretches of set flags in each row."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, low, high


def _bucket(table: pa.Table) -> pa.Table:
    """Marks of one bucket: a row per document with its spans. A part of the strings is at work at a time."""
    blobs = [x.as_py() for x in table.column("blob")]
    found, strings = [], 0
    for blob in blobs:
        marks, count = _marks(blob)
        found.append(marks)
        strings += count
    parts = max(1, -(-strings // PART_STRINGS))
    for part in range(parts):
        found += _part_marks(*_part(blobs, part, parts))
    rank, tag, low, high = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((low, tag, rank))
    rank, tag = rank[order], tag[order]
    spans = np.stack((low[order], high[order]), axis=1).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (rank[1:] != rank[:-1]) | (tag[1:] != tag[:-1]))))[: len(rank)]
    ends = np.concatenate((new[1:], [len(rank)]))
    pieces = [_delta(spans[a:b]) for a, b in zip(new.tolist(), ends.tolist()[: len(new)])]
    return pa.table({"rank": pa.array(rank[new], pa.int64()), "tag": pa.array(tag[new], pa.int64()), "spans": pa.array(pieces, pa.binary())})


def _marks(blob: bytes) -> tuple[tuple[np.ndarray, ...], int]:
    """rank, tag, start and end of what was decided before the shuffle, and the number of strings."""
    rank, tag, strings, *_, owner, place, size = _unpack(blob)
    return (rank[owner], tag[owner], place, place + size), len(strings)


def _part(blobs: list[bytes], part: int, count: int) -> tuple:
    """Strings, lengths and seeds of one of ``count`` parts, and the string, rank, tag and place of each occurrence."""
    parts, base = [], 0
    for blob in blobs:
        rank, tag, size, seed, flat, step, owner, place, *_ = _unpack(blob)
        starts = np.cumsum(size, dtype=np.int64) - size + seed
        code = np.zeros(len(size), np.uint64)
        for k in range(SEED):
            code = code * _ODD + flat[starts + k]
        mine = ((code ^ (code >> _U(29))) * _MIX >> _U(40)) % _U(count) == part
        which = np.cumsum(step)
        seen = mine[which]
        number = np.cumsum(mine) - 1 + base
        owner = owner[seen]
        parts.append((_unflat(flat[np.repeat(mine, size)], size[mine]), size[mine], seed[mine], number[which[seen]], rank[owner], tag[owner], place[seen]))
        base += int(mine.sum())
    return tuple(np.concatenate(x) for x in zip(*parts))


def _part_marks(strings, length, seed, which, rank, tag, place) -> list[tuple[np.ndarray, ...]]:
    """rank, tag, start and end of the marks of the occurrences."""
    if not len(strings):
        return []
    least = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(least, which, rank)
    keep = np.logical_or(*_met(_sides(strings, seed, length), least))
    at = np.flatnonzero(keep)
    if not len(at):
        return []
    order, group = distinct(strings[at], length[at])
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    one = at[order[start]]
    least = np.minimum.reduceat(least[at][order], start)
    number = np.full(len(strings), -1, np.int64)
    number[at[order]] = group
    strings, length, seed = strings[one], length[one], seed[one]
    # A string that only meets copies of itself is decided by its first document.
    later, earlier = _met(_sides(strings, seed, length), least)
    covered = np.zeros((len(one), WIDTH - MATCH + 1), bool)
    shared = np.flatnonzero(later | earlier)
    covered[shared] = search(strings[shared], length[shared], seed[shared], least[shared], later[shared], earlier[shared])
    row, low, high = _runs(covered)
    edges = np.searchsorted(row, np.arange(len(one) + 1))
    of = number[which]
    hit = np.flatnonzero(of >= 0)
    whole = hit[rank[hit] > least[of[hit]]]
    part = hit[rank[hit] == least[of[hit]]]
    times = edges[of[part] + 1] - edges[of[part]]
    again = np.repeat(part, times)
    span = np.repeat(edges[of[part]] - np.cumsum(times) + times, times) + np.arange(len(again))
    return [
        (rank[whole], tag[whole], place[whole], place[whole] + length[of[whole]]),
        (rank[again], tag[again], place[again] + low[span], place[again] + high[span] + MATCH - 1),
    ]


def _delta(spans: np.ndarray) -> bytes:
    """Spans of at most 255 bytes: the starts as 32-bit steps when they fit, and the sizes."""
    step = np.diff(spans[:, 0], prepend=0)
    wide = bool(len(step)) and int(step.max()) >= 1 << 32
    return bytes([wide]) + step.astype(np.uint64 if wide else np.uint32).tobytes() + (spans[:, 1] - spans[:, 0]).astype(np.uint8).tobytes()


def _undelta(blob: bytes) -> np.ndarray:
    kind = np.dtype(np.uint64 if blob[0] else np.uint32)
    n = (len(blob) - 1) // (kind.itemsize + 1)
    low = np.cumsum(np.frombuffer(blob, kind, n, 1).astype(np.int64))
    return np.stack((low, low + np.frombuffer(blob, np.uint8, n, 1 + n * kind.itemsize)), axis=1)


# --- back to the documents --------------------------------------------------------


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = pa.array([squeeze.compress(x.as_py()) for x in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rank"), batch.column("tag"), texts], names=["id", "rank", "tag", "text"])


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal stretches covered by spans."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.stack((spans[new, 0], reach[np.concatenate((new[1:] - 1, [len(spans) - 1]))]), axis=1)


def _apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    grow = zstandard.ZstdDecompressor()
    for frame in frames:
        rows = []
        for key, blob, marks in zip(frame["id"].tolist(), frame["text"], frame["marks"]):
            raw = grow.decompress(blob)
            spans = merged(np.concatenate([_undelta(m) for m in marks])) if marks is not None and len(marks) else np.empty((0, 2), np.int64)
            kept, done = [], 0
            for low, high in spans.tolist():
                kept.append(raw[done:low])
                done = high
            kept.append(raw[done:])
            rows.append((key, len(raw), b"".join(kept), [{"lo": a, "hi": b} for a, b in spans.tolist()]))
        yield pd.DataFrame(rows, columns=["id", "n_bytes", "kept", "spans"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET, outsized: float = OUTSIZED) -> DataFrame:
    """``doc_id, n_bytes, kept, spans`` for every row: the remaining bytes and the maximal removed stretches.

    A byte goes when it lies in a string of MATCH bytes that also starts in a document with a smaller id,
    judged on the input. A null text is empty. A null id is above all ids; rows of one id are not
    earlier than each other, so rows repeated with their id are treated alike. No rows give no rows.
    """
    text = text_of(text_col)
    # Rows of equal id and text have one fate, so id and a hash of the text name a row.
    keyed = docs.select(
        F.col(id_col).cast("long").cast("string").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("rank"),
        F.xxhash64(text).alias("tag"),
        text.cast("binary").alias("text"),
    )
    total = keyed.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    # A string has about 68 bytes for 20 bytes of text.
    buckets = max(FEWEST, -(-total * 7 // 2 // bucket_bytes))
    late = np.zeros(CLASSES, bool)
    texts = keyed.select("rank", "tag", "text")
    counts = texts.mapInArrow(_classes(late), "class long, n long").groupBy("class").agg(F.sum("n").alias("n"))
    # At most CLASSES rows.
    rows = counts.collect()
    strings = sum(r["n"] for r in rows)
    late[[r["class"] for r in rows if r["n"] > outsized * strings]] = True
    dealt = texts.mapInArrow(_strings(buckets, late), "bucket int, blob binary")
    marks = dealt.groupBy("bucket").applyInArrow(_bucket, "rank long, tag long, spans binary")
    marks = marks.groupBy("rank", "tag").agg(F.collect_list("spans").alias("marks"))
    squeezed = keyed.mapInArrow(_squeezed, "id string, rank long, tag long, text binary")
    joined = squeezed.join(marks, ["rank", "tag"], "left").select("id", "text", "marks")
    done = joined.mapInPandas(_apply, "id string, n_bytes long, kept binary, spans array<struct<lo: long, hi: long>>")
    return done.select(F.col("id").cast("long").alias("doc_id"), "n_bytes", "kept", "spans")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of :func:`drop_repeats`."""
    done = drop_repeats(docs)
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All windows of all texts, as hexadecimal strings; for tables of a few megabytes.
ORACLE = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)
), first AS (
  SELECT s, min(doc_id) AS first_id FROM w GROUP BY s
), late AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM w JOIN first USING (s) WHERE first_id < doc_id
), spans AS (
  SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM late) GROUP BY doc_id, k
), pieces AS (
  SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM (
    SELECT doc_id, lo, hi FROM spans UNION ALL SELECT doc_id, n, n FROM d)
), kept AS (
  SELECT doc_id, coalesce(string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo, since), '') AS k FROM pieces JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, n - length(k) // 2 AS n_removed, count(lo) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id) GROUP BY doc_id, n, k
"""
