from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import frame, odd_rows, words
from corpuslab.llm import decontaminate, mixing, quality
from corpuslab.llm.common import table

# --- decontamination ------------------------------------------------------------


def edit_distance_within(item, text):
    """Smallest edit distance to a substring, and its first end, by the full table."""
    row = list(range(len(item) + 1))
    best = (len(item), 0)
    for at, letter in enumerate(text):
        new = [0]
        for k in range(1, len(item) + 1):
            new.append(min(row[k] + 1, new[k - 1] + 1, row[k - 1] + (item[k - 1] != letter)))
        row = new
        best = min(best, (row[-1], at + 1))
    return best


def plain_hits(rows, items, budget):
    out = Counter()
    for doc, text in rows:
        text = decontaminate.normalise(text)
        for key, item in set(items):
            item = decontaminate.normalise(item)
            if item and text:
                distance, end = edit_distance_within(item, text)
                if distance <= int(len(item) * budget):
                    out[(doc, key, distance, end)] += 1
    return out


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        k = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[k] = rng.choice("xyz")
        elif kind == 1:
            text.insert(k, rng.choice("xyz"))
        elif len(text) > 1:
            del text[k]
    return "".join(text)


@pytest.mark.parametrize("budget,block", [(0.05, 1 << 20), (0.2, 40)])
def test_decontamination(spark, budget, block):
    rng = random.Random(6)
    items = [(k, words(rng, rng.choice([1, 5, 12]))) for k in range(8)] + [(8, None), (9, ""), (10, "A"), (None, "null id item of some length"), (3, "second text of an id"), (0, "  Spaced\n\tOUT  item here ")]
    rows = []
    for k in range(60):
        text = words(rng, rng.randint(0, 20))
        if k % 2:
            item = rng.choice([t for _, t in items if t])
            text = text[: len(text) // 2] + edited(rng, item.upper(), rng.randint(0, 1 + len(item) // 8)) + text[len(text) // 2 :]
        rows.append((k if k % 11 else None, text))
    rows += [(70, None), (71, ""), rows[1], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hit", F.lit(1))
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string").withColumn("doc_id", F.lit(2))
    want = plain_hits(rows, items, budget)
    assert Counter(map(tuple, decontaminate.matches(docs, bench, budget=budget, block_chars=block).collect())) == want
    bad = {d for d, *_ in want} - {None}
    kept = decontaminate.drop_contaminated(docs, bench, budget=budget, block_chars=block)
    assert kept.columns == docs.columns
    texts = [t for d, t in rows if not plain_hits([(d, t)], items, budget)]
    assert Counter(r["text"] for r in kept.collect()) == Counter(texts)
    assert bad


def test_decontamination_of_nothing(spark):
    docs, bench = frame(spark, odd_rows()), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(docs, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count()
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.matches(frame(spark, []), some).count() == 0


def test_benchmark_passages_of_documents(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert {(d["doc_id"], k) for d in docs.collect() for k, t in items if t in (d["text"] or "")} <= got


# --- mixing -----------------------------------------------------------------------


def plain_targets(sizes):
    sources = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    left, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in sources if s not in full]
        total = sum(weight[s] for s in free)
        target = {s: 2.0 * sizes[s] for s in full} | {s: (left - 2 * sum(sizes[f] for f in full)) * weight[s] / total for s in free}
        over = {s for s in free if target[s] >= 2 * sizes[s]}
        if not over:
            return target
        full |= over
        if len(full) == len(sources):
            return {s: 2.0 * sizes[s] for s in sources}


def check_mix(rows, got, slack):
    count = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += count(r[1])
    target = plain_targets(sizes)
    assert Counter((g["doc_id"], g["size"], g["source_size"]) for g in got) == Counter((r[0], count(r[1]), sizes[r[3]]) for r in rows)
    taken = defaultdict(int)
    for g in got:
        assert 0 <= g["taken"] <= 2 * g["size"]
        taken[round(g["target"], 6)] += g["taken"]
    want = defaultdict(float)
    for s in sizes:
        want[round(target[s], 6)] += target[s]
    assert set(taken) == set(want)
    for t in want:
        assert abs(taken[t] - want[t]) <= slack * sum(round(x, 6) == t for x in target.values())


@pytest.mark.parametrize("slot", [3, 128])
def test_mix(spark, slot):
    rng = random.Random(9)
    rows = [(k, words(rng, rng.randint(0, 60)), None, None if k % 19 == 0 else "hot" if k % 3 else f"s{k % 8}") for k in range(700)]
    rows += [rows[5]] * 40 + [(None, "one two three", None, "s1")] * 20 + [(7, None, None, "empty only"), (8, "", None, "empty only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(docs, slot=slot).collect()
    check_mix(rows, got, 1.0)
    again = mixing.mix(docs.repartition(7), slot=slot).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_of_odd_rows_and_none(spark):
    rows = odd_rows()
    check_mix(rows, mixing.mix(frame(spark, rows)).collect(), 1.0)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mix_is_fair(spark):
    """Over many seeds a document is taken as often as its source's rate says."""
    rows = [(k, "w " * (1 + k % 7), None, "b" if k < 30 else "a") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    seeds = 40
    total = defaultdict(float)
    for seed in range(seeds):
        for r in mixing.mix(docs, seed=seed, slot=8).collect():
            total[r["doc_id"]] += r["taken"] / r["size"] / (r["target"] / r["source_size"])
    ratios = np.array([t / seeds for t in total.values()])
    assert abs(ratios.mean() - 1) < 0.05 and abs(ratios - 1).max() < 0.5


# --- quality ------------------------------------------------------------------------


def test_echoes_against_a_loop():
    rng = random.Random(3)
    raw = np.frombuffer(("".join(rng.choice("ab ") for _ in range(300)) + "word word word " * 5).encode(), np.uint8)
    want = [any(k + 1 >= quality.ECHO + lag and bytes(raw[k - 7 : k + 1]) == bytes(raw[k - 7 - lag : k + 1 - lag]) for lag in range(1, quality.LAGS + 1)) for k in range(len(raw))]
    assert quality.echoes(raw).tolist() == want


def test_chunks_cover_the_text():
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 960, 961, 5000):
        raw = bytes(1 + k % 250 for k in range(n)).decode("latin-1").encode("latin-1")
        chunks, _ = quality.chunked(raw.decode("latin-1"))
        data = np.frombuffer(raw.decode("latin-1").encode(), np.uint8)
        step = quality.CHUNK - quality.OVERLAP
        rebuilt = np.concatenate([chunks[0], *[c[quality.OVERLAP :] for c in chunks[1:]]])
        assert (rebuilt[: len(data)] == data).all() and not rebuilt[len(data) :].any()
        assert len(rebuilt) - len(data) < step or len(chunks) == 1


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in quality.train([], seed=3).items()}
    p["w_top"], p["w_mean"] = rng.normal(size=quality.FILTERS), rng.normal(size=quality.FILTERS)
    batch = [(*quality.chunked("the theory of " * 50), 1), (*quality.chunked("zz!! "), 0)]

    def loss():
        total = 0.0
        for text, y in (("the theory of " * 50, 1), ("zz!! ", 0)):
            s = quality.evidence(p, text)
            total += np.log1p(np.exp(-s)) if y else np.log1p(np.exp(s))
        return total / 2

    grads = quality._gradients(p, batch)
    for name, at in (("filters", (5, 3)), ("w_top", (2,)), ("w_mean", (4,)), ("c", (0,)), ("table", (ord("t"), 1)), ("bias", (6,))):
        old, step = p[name][at], 1e-3
        p[name][at] = old + step
        up = loss()
        p[name][at] = old - step
        down = loss()
        p[name][at] = old
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3 + 0.05 * abs(grads[name][at]), name


def test_batches_do_not_change_scores():
    p = quality.train([], seed=5)
    texts = [None, "", "a", "word " * 30, "x" * 300_000, "long " * 2000]
    one = [1 / (1 + np.exp(-quality.evidence(p, t))) for t in texts]
    assert np.allclose(quality.probability(p, texts), one, atol=1e-5)


def plain_score(p, text):
    """The network as loops over chunks, windows and filters."""
    raw = text.encode()
    step, total, chunks = quality.CHUNK - quality.OVERLAP, 0.0, 0
    echo = [any(k + 1 >= quality.ECHO + lag and raw[k - 7 : k + 1] == raw[k - 7 - lag : k + 1 - lag] for lag in range(1, quality.LAGS + 1)) for k in range(len(raw))]
    start = 0
    while True:
        data = raw[start : start + quality.CHUNK]
        inputs = np.zeros((quality.CHUNK, quality.EMBED + 1))
        inputs[:, : quality.EMBED] = p["table"][0]
        for k, byte in enumerate(data):
            inputs[k] = [*p["table"][byte], echo[start + k]]
        outs = []
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            if at < max(1, len(data)):
                outs.append(np.maximum(inputs[at : at + quality.WIDTH].ravel() @ p["filters"] + p["bias"], 0))
        total += np.max(outs, axis=0) @ p["w_top"] + np.mean(outs, axis=0) @ p["w_mean"] + p["c"][0]
        chunks += 1
        start += step
        if start + quality.OVERLAP >= len(raw):
            break
    return 1 / (1 + np.exp(-total / chunks))


def test_scores_against_plain_loops(spark, sf_dir):
    p = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rng = random.Random(4)
    texts = ["", "a", "The the the. " * 30, words(rng, 300), "é" * 600, words(rng, 40) + "\n" + words(rng, 700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, p).collect()}
    assert all(abs(got[k] - plain_score(p, t)) < 1e-4 for k, t in enumerate(texts))


def test_training_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(9)
    rows = [(k % 20, words(rng, 30) if k % 2 else "spam " * rng.randint(5, 30)) for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality long")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = quality.fit(docs, labels), quality.fit(docs.orderBy(F.desc("text")).repartition(7), labels.repartition(3))
    assert all((a[k] == b[k]).all() for k in a)


def test_held_out_documents(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    parameters = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.classify(docs, parameters).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    known = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"] and r["quality"] is not None]
    assert np.mean([p == y for p, y in known]) >= 0.9
    kept = quality.keep_good(docs, parameters)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["predicted"]}


def test_labels_of_the_held_out_fifth_change_nothing(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert all((a[k] == b[k]).all() for k in a)


def test_quality_of_odd_rows(spark):
    docs = frame(spark, odd_rows())
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality long")
    parameters = quality.fit(docs, none)
    assert quality.classify(docs, parameters).count() == docs.count()
    assert quality.classify(docs.limit(0), parameters).count() == 0
