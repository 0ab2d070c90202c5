from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cases import frame, odd_rows, words
from corpuslab.llm import suffix
from corpuslab.llm.common import table
from corpuslab.llm.run_index import RunIndex, suffix_order
from corpuslab.llm.suffix import MATCH


def plain(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same by a dictionary of all strings."""
    first: dict[bytes, int] = {}
    order = lambda key: (1 << 63) - 1 if key is None else key
    texts = [(order(key), key, (text or "").encode()) for key, text in rows]
    for rank, _, raw in texts:
        for k in range(len(raw) - MATCH + 1):
            window = raw[k : k + MATCH]
            first[window] = min(rank, first.get(window, rank))
    out = []
    for rank, key, raw in texts:
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - MATCH + 1):
            if first[raw[k : k + MATCH]] < rank:
                gone[k : k + MATCH] = True
        kept = np.frombuffer(raw, np.uint8)[~gone[:-1]].tobytes()
        spans = int((gone[1:] < gone[:-1]).sum())
        out.append((key, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(docs, **options):
    done = suffix.drop_repeats(docs, **options)
    out = Counter()
    for r in done.collect():
        assert r["n_bytes"] - len(r["kept"]) == sum(s["hi"] - s["lo"] for s in r["spans"])
        out[(r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest())] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 1 << 16}, {"outsized": 0.0}])
def test_odd_rows(spark, options):
    rows = odd_rows(3)
    assert result(frame(spark, rows), **options) == Counter(plain([(r[0], r[1]) for r in rows]))


def test_repetitive_corpus(spark):
    """Shared passages at random places, runs of one character, periods, edits, edges of texts."""
    rng = random.Random(8)
    passages = [words(rng, rng.randint(8, 40)) for _ in range(6)] + ["ab" * 60, "z" * 130, "é" * 40]
    rows = []
    for doc in range(160):
        text = ""
        for _ in range(rng.randint(0, 4)):
            piece = rng.choice(passages) if rng.random() < 0.7 else words(rng, rng.randint(1, 20))
            a = rng.randrange(len(piece))
            piece = piece[a // 2 :] if rng.random() < 0.5 else piece
            if rng.random() < 0.3:
                k = rng.randrange(len(piece) + 1)
                piece = piece[:k] + "#" + piece[k:]
            text += piece
        rows.append((doc // 2 if doc > 150 else doc, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == Counter(plain(rows))
    assert result(docs.repartition(13), bucket_bytes=1 << 14, outsized=1e-4) == Counter(plain(rows))


def test_texts_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(2)
    long = words(rng, 3000)
    rows = [(5, long), (3, long[7000:7400] + words(rng, 50)), (9, words(rng, 20) + long[100:9000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffix, "PIECE", 257)
    assert result(docs) == Counter(plain(rows))
    pieces = list(suffix._pieces(_batches(rows)))
    assert len(pieces) > 50


def _batches(rows):
    import pyarrow as pa

    yield pa.RecordBatch.from_arrays([pa.array([r[1].encode() for r in rows]), pa.array([r[0] for r in rows]), pa.array([0] * len(rows))], names=["text", "rank", "tag"])


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert result(docs) == Counter(plain(rows))


def test_no_rows(spark):
    assert suffix.digests(frame(spark, [])).count() == 0


def _array(strings, width):
    out = np.zeros((len(strings), width), np.uint8)
    for k, s in enumerate(strings):
        out[k, : len(s)] = np.frombuffer(s, np.uint8)
    return out, np.array([len(s) for s in strings])


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(150):
        letters = rng.choice([b"ab", b"abc", bytes([0, 255]), b"thern "])
        width = rng.choice([8, 20, 40])
        draw = lambda more=b"": bytes(rng.choice(letters + more) for _ in range(rng.randint(1, width)))
        held = [draw() for _ in range(rng.randint(1, 12))]
        asked = [draw(b"z") for _ in range(8)] + held[:1]
        match = rng.choice([7, 10, 16, 30])
        index = RunIndex(*_array(held, width), match)
        order, _ = suffix_order(index.text)
        assert list(order) == sorted(range(len(index.text)), key=lambda i: list(index.text[i:]))
        size, place = index.statistics(*_array(asked, width))
        value = np.array([rng.randint(0, 99) for _ in held])
        least = index.long_groups(value)
        for k, q in enumerate(asked):
            for i in range(len(q)):
                n = size[k, i]
                longest = max(m for m in range(len(q) - i + 1) if any(q[i : i + m] in s for s in held))
                assert n == longest
                at = place[k, i]
                assert bytes((index.text[at : at + n] - 1).astype(np.uint8)) == q[i : i + n]
                if n >= match:
                    assert least[at] == min(v for v, s in zip(value, held) if q[i : i + match] in s)
