"""Language ID against plain loops and held-out accuracy; manifest and search against plain versions."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from cases import frame, odd_rows, words
from pyspark.sql import functions as F

from corpuslab.llm import language, lexical, merkle
from corpuslab.llm.common import table

# ---- language ----


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return language.fit(table(spark, sf_dir, "documents"))


def logistic(x):
    return 1 / (1 + np.exp(-x))


def plain_states(p, way, data):
    h, out = np.zeros(language.HIDDEN), []
    size = language.HIDDEN
    for byte in data if way == 0 else data[::-1]:
        a, g = p["bytes"][way][:, byte], p["back"][way] @ h
        z = logistic(2 * (a[:size] + g[:size]))
        r = logistic(2 * (a[size : 2 * size] + g[size : 2 * size]))
        new = np.tanh(a[2 * size :] + r * g[2 * size :])
        h = z * h + (1 - z) * new
        out.append(h)
    return np.array(out if way == 0 else out[::-1])


def plain_probabilities(p, text):
    raw = text.encode()
    if not raw:
        return np.zeros(len(p["bias"]))
    total = np.zeros(len(p["bias"]))
    for k in range(0, len(raw), language.CHUNK):
        data = list(raw[k : k + language.CHUNK])
        full = data + [0] * (language.CHUNK - len(data))
        logits = plain_states(p, 0, full) @ p["out"][0].T + plain_states(p, 1, full) @ p["out"][1].T + p["bias"][:, 0]
        each = np.exp(logits - logits.max(axis=1, keepdims=True))
        total += (each / each.sum(axis=1, keepdims=True))[: len(data)].sum(axis=0)
    return total / len(raw)


def test_forward_pass_matches_plain_loops(model):
    _, p = model
    rng = random.Random(4)
    texts = ["", "a", "x" * 64, "y" * 65, words(rng, 40), "ß" * 200, words(rng, 900), None]
    got = language.probabilities(p, texts)
    for text, row in zip(texts, got):
        assert np.allclose(row, plain_probabilities(p, text or ""), atol=1e-4)


def test_texts_in_one_batch_do_not_touch(model):
    _, p = model
    rng = random.Random(5)
    texts = [words(rng, n) for n in (5, 3000, 1, 400, 20_000, 7)]
    together = language.probabilities(p, texts)
    assert np.allclose(together, np.concatenate([language.probabilities(p, [t]) for t in texts]), atol=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    p = language.initial(3, dtype=np.float64)
    chunks = rng.integers(97, 103, (5, language.CHUNK)).astype(np.uint8)
    sizes, labels = np.array([64, 3, 64, 40, 64]), np.array([0, 1, 2, 1, 0])
    _, g = language.gradients(p, chunks, sizes, labels)
    for name, value in p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "bytes":
                at = (*at[:2], int(rng.integers(97, 103)))
            old, step = value[at], 1e-6
            value[at] = old + step
            high, _ = language.gradients(p, chunks, sizes, labels)
            value[at] = old - step
            low, _ = language.gradients(p, chunks, sizes, labels)
            value[at] = old
            assert math.isclose(g[name][at], (high - low) / (2 * step), rel_tol=1e-4, abs_tol=1e-7)


def test_held_out_accuracy(spark, sf_dir, model):
    docs = table(spark, sf_dir, "documents")
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_fit_reads_neither_held_out_rows_nor_other_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = language.fit(docs), language.fit(other.repartition(7))
    assert a[0] == b[0] and all((a[1][k] == b[1][k]).all() for k in a[1])


def test_language_odd_rows(spark, model):
    rows = odd_rows()
    got = language.identify(frame(spark, rows), model).collect()
    assert len(got) == len(rows)
    texts = Counter((r[0], None if r[1] is None or not any(map(str.isalpha, r[1])) else "text") for r in rows)
    assert Counter((r["doc_id"], None if r["lang_pred"] == "und" else "text") for r in got) == texts
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert language.identify(frame(spark, []), model).collect() == []


def test_language_without_labels(spark):
    docs = frame(spark, [(k, "some text", None, None, None, *[None] * 6) for k in range(3)])
    none = language.fit(docs)
    assert none[0] == []
    assert [r["lang_pred"] for r in language.identify(docs, none).collect()] == ["und"] * 3
    # A language of few, repeated rows is learned as well.
    few = frame(spark, [(1, "aaaa bbbb", "p", *[None] * 8), (1, "aaaa bbbb", "p", *[None] * 8), (3, "cccc", "q", *[None] * 8), (None, "z", "r", *[None] * 8), (4, None, "s", *[None] * 8)])
    assert language.fit(few)[0] == ["p", "q"]


def test_language_spans(spark, model):
    languages, p = model
    rng = random.Random(2)
    text = words(rng, 30)
    runs = language.runs(model, text)
    assert runs[0][0] == 0 and runs[-1][1] == len(text.encode())
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(runs, runs[1:]))
    assert language.runs(model, None) == []
    out = frame(spark, [(1, text, *[None] * 9), (2, None, *[None] * 9)]).select("doc_id", language.spans_column(model, F.col("text")).alias("s")).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["s"]] for r in out} == {1: runs, 2: []}


# ---- manifest ----


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    leaf = lambda r, more=0: digest(field(r[0]), field(r[3]), field(r[2]), field(None if r[4] is None else r[4] + more), field(r[1]))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), leaf(r, 1)))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: levels([x[2] for x in sorted(groups[n])]) for n in names}
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for place, n in enumerate(names):
        for at, (known, key, good, bad) in enumerate(sorted(groups[n])):
            path = []
            for tree, k in ((trees[n], at), (top, place)):
                for level in tree[:-1]:
                    other = k ^ 1
                    path.append((other < k, level[other]) if other < len(level) else None)
                    k //= 2
            changed = known and zlib.crc32(str(key).encode()) % 7 == 0
            node = bad if changed else good
            for step in path:
                node = digest(node) if step is None else digest(step[1], node) if step[0] else digest(node, step[1])
            proof = digest(*(s[1] for s in path if s))
            out.append((key if known else None, good, trees[n][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def got_manifest(spark, rows):
    return [tuple(r) for r in merkle.audit(frame(spark, rows)).collect()]


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (5, 8, 1), (9, 16, 17, 4, 2)])
def test_manifest_of_small_trees(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "RANK_ROWS", 5)
    rng = random.Random(sum(sizes))
    ids = rng.sample(range(10_000), sum(sizes))
    langs = [f"l{k}" if k else None for k, n in enumerate(sizes) for _ in range(n)]
    rows = [(i, words(rng, 4), lang, None if i % 3 else "s", i % 5 or None, *[None] * 6) for i, lang in zip(ids, langs)]
    rng.shuffle(rows)
    assert order(got_manifest(spark, rows)) == order(plain_manifest(rows))


def test_manifest_odd_rows(spark):
    rows = odd_rows() + [(2**62, "z", "de", None, 2**63 - 1, *[None] * 6), (-4, "z", "ß", "ß", -1, *[None] * 6), (0, "", "", "", 0, *[None] * 6)]
    found = got_manifest(spark, rows)
    assert order(found) == order(plain_manifest(rows))
    assert not all(r[-1] for r in found) and any(r[-1] for r in found)
    assert got_manifest(spark, []) == []


def test_manifest_of_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    assert order([tuple(r) for r in merkle.audit(docs.repartition(9)).collect()]) == order(plain_manifest(rows))


def test_witness_leads_to_the_root():
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 8, 13):
        leaves = [sha256(bytes([rng.randrange(256)])).digest() for _ in range(n)]
        tree = merkle.Appender()
        for leaf in leaves:
            tree.append(leaf)
        root = tree.close(merkle.height(n))
        assert root.hex() == levels([x.hex() for x in leaves])[-1][0]
        assert all(merkle.climb(leaf, bytes(w)) == root for leaf, w in zip(leaves, tree.witness))


# ---- search ----


def plain_terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]


def plain_search(docs, items, top=20):
    held = [(key, Counter(plain_terms(text))) for key, text in docs]
    held = [(key, c, sum(c.values())) for key, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    holding = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for key, text in set(items):
        asked.setdefault(key, Counter()).update(plain_terms(text))
    out = set()
    for key, terms in asked.items():
        scores = []
        for doc, counts, n in held:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t, q in terms.items() if t in counts
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, unnamed, doc) in enumerate(sorted(scores)[:top], 1):
            out.add((key, rank, None if unnamed else doc, -score))
    return out


def found_by_search(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def item_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string, rank int, score long")


def test_search_on_the_table(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = plain_search([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert found_by_search(lexical.search(docs, items)) == want
    # Small blocks of documents and items, spread otherwise.
    assert found_by_search(lexical.search(docs.repartition(5), items, block_chars=900, block_docs=16)) == want


def test_search_odd_rows(spark):
    rows = odd_rows()
    rng = random.Random(3)
    base = [r[1] for r in rows if r[1]]
    items = [(k, " ".join(rng.sample(t.split() or [""], min(9, len(t.split()))))) for k, t in enumerate(base[:30])]
    items += [(None, base[20]), (7, None), (8, ""), (9, "!!!"), (10, "É é 🙂 K ſ"), (11, base[22] + " " + base[22]), (12, "th th th"), (12, "er"), (12, "er"), (13, words(rng, 150))]
    got = lexical.search(frame(spark, rows), item_frame(spark, [(*i, "x", 1, 1) for i in items]), block_docs=7)
    assert found_by_search(got) == plain_search([(r[0], r[1]) for r in rows], items)


def test_search_of_empty_tables(spark):
    docs, items = frame(spark, odd_rows()), item_frame(spark, [(1, "th er", None, None, None)])
    for pair in ((docs, items.limit(0)), (frame(spark, []), items), (frame(spark, [(1, "...", *[None] * 9)]), items)):
        out = lexical.search(*pair)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []


def test_search_skips_groups_below_the_bound():
    """Few documents are scored when the first groups hold the best ones, none that could still win is missed."""
    rng = np.random.default_rng(1)
    doc, term = np.nonzero(rng.random((4000, 12)) < np.linspace(0.9, 0.01, 12))
    part = rng.integers(1, 1000, len(doc))
    block, weights = lexical.Block(4000, doc, term, part), [int(10 * 1.6**k) for k in range(12)]
    seen = []
    score = block.score
    block.score = lambda docs, *rest: seen.append(len(docs)) or score(docs, *rest)
    docs, scores = block.best(list(range(12)), weights, 20, 1)
    full = np.zeros(4000, np.int64)
    np.add.at(full, doc, np.array(weights)[term] * part)
    least = np.sort(full)[-20]
    assert set(docs) == set(np.flatnonzero(full >= least)) and (full[docs] == scores).all()
    assert sum(seen) < 1000
