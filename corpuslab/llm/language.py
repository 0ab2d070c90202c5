"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text is read in chunks of 64 bytes. One recurrent pass goes forward and one backward through each chunk; at
every byte both states give the probabilities of the languages, and a document's probabilities are the mean
over all its bytes. The network is trained by backpropagation through time on chunks of a bounded sample.
Features come first and chunks last in every array, so that a step works on long contiguous rows.
Only bytes are read: no language, source or id enters a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK, HIDDEN = 64, 8
#: Chunks worked on at once; bounds a task's memory whatever the length of a text.
AT_ONCE = 1024
#: Bound of the training sample: labelled documents of each language.
SAMPLE_DOCS = 250
STEPS, BATCH, RATE = 260, 128, 2e-2
UNDETERMINED = "und"

Parameters = dict[str, np.ndarray]


def chunks_of(text: str | None) -> tuple[np.ndarray, int]:
    """(n, CHUNK) bytes, the last row filled up with zeros, and the number of bytes."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    full = np.zeros(-(-len(raw) // CHUNK) * CHUNK, np.uint8)
    full[: len(raw)] = raw
    return full.reshape(-1, CHUNK), len(raw)


def used(chunks: int, size: int) -> np.ndarray:
    """Bytes of text in each chunk."""
    out = np.full(chunks, CHUNK)
    if chunks:
        out[-1] = size - CHUNK * (chunks - 1)
    return out


def initial(classes: int, seed: int = 7, dtype=np.float32) -> Parameters:
    """``bytes``: what a byte adds to update, reset and candidate, forward and backward; ``back``: what the state adds."""
    rng = np.random.default_rng(seed)
    return {
        "bytes": rng.normal(0, 0.3, (2, 3 * HIDDEN, 256)).astype(dtype),
        "back": rng.normal(0, HIDDEN**-0.5, (2, 3 * HIDDEN, HIDDEN)).astype(dtype),
        "out": rng.normal(0, 0.3, (2, classes, HIDDEN)).astype(dtype),
        "bias": np.zeros((classes, 1), dtype),
    }


def states(p: Parameters, chunks: np.ndarray, trace: list | None = None) -> np.ndarray:
    """(2, CHUNK, HIDDEN, n) states after each byte, forward and backward; ``trace`` receives what training needs."""
    n, kind = len(chunks), p["bytes"].dtype
    out = np.empty((2, CHUNK, HIDDEN, n), kind)
    h, a, g = np.zeros((2, HIDDEN, n), kind), np.empty((2, 3 * HIDDEN, n), kind), np.empty((2, 3 * HIDDEN, n), kind)
    columns = np.ascontiguousarray(chunks.T)
    for t in range(CHUNK):
        at = (t, CHUNK - 1 - t)
        for way in (0, 1):
            np.take(p["bytes"][way], columns[at[way]], axis=1, out=a[way], mode="clip")
            np.matmul(p["back"][way], h[way], out=g[way])
        gates = a[:, : 2 * HIDDEN]
        gates += g[:, : 2 * HIDDEN]
        # tanh of half the sum is a logistic but for scale and shift; the half lies in the weights.
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r, x = a[:, :HIDDEN], a[:, HIDDEN : 2 * HIDDEN], a[:, 2 * HIDDEN :]
        gn = g[:, 2 * HIDDEN :]
        if trace is not None:
            gn = gn.copy()
            x += r * gn
        else:
            gn *= r
            x += gn
        np.tanh(x, out=x)
        before = h
        h = before - x
        h *= z
        h += x
        if trace is not None:
            trace.append((before, z.copy(), r.copy(), x.copy(), gn))
        out[0, at[0]], out[1, at[1]] = h[0], h[1]
    return out


def position_probabilities(p: Parameters, chunks: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """(CHUNK, classes, n) probabilities at every byte."""
    h = states(p, chunks) if h is None else h
    logits = np.matmul(p["out"][0], h[0])
    logits += np.matmul(p["out"][1], h[1])
    logits += p["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def pooled(p: Parameters, chunks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(n, classes) sums of the probabilities over the bytes of each chunk."""
    found = position_probabilities(p, chunks)
    for k in np.flatnonzero(sizes < CHUNK):
        found[sizes[k] :, :, k] = 0
    return found.sum(axis=0, dtype=np.float64).T


def probabilities(p: Parameters, texts: list[str | None]) -> np.ndarray:
    """(texts, classes); zeros for a text without bytes."""
    sums, bytes_in = np.zeros((len(texts), p["bias"].shape[0])), np.zeros(len(texts))
    pending: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if pending:
            whose = np.repeat([k for k, *_ in pending], [len(c) for _, c, _ in pending])
            found = pooled(p, np.concatenate([c for _, c, _ in pending]), np.concatenate([s for *_, s in pending]))
            np.add.at(sums, whose, found)
            pending.clear()

    room = AT_ONCE
    for k, text in enumerate(texts):
        chunks, size = chunks_of(text)
        bytes_in[k], sizes = size, used(len(chunks), size)
        while len(chunks):
            pending.append((k, chunks[:room], sizes[:room]))
            chunks, sizes = chunks[room:], sizes[room:]
            room -= len(pending[-1][1])
            if not room:
                flush()
                room = AT_ONCE
    flush()
    return sums / np.maximum(bytes_in, 1)[:, None]


def gradients(p: Parameters, chunks: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, Parameters]:
    """Mean cross entropy over all bytes, and its gradients, by backpropagation through time."""
    trace: list = []
    h = states(p, chunks, trace)
    found = position_probabilities(p, chunks, h)
    inside = (np.arange(CHUNK)[:, None] < sizes[None, :]).astype(found.dtype)
    total = inside.sum()
    n, at = len(chunks), np.arange(len(chunks))
    loss = -(np.log(np.maximum(found[:, labels, at], 1e-30)) * inside).sum() / total
    d = found
    d[:, labels, at] -= 1
    d *= (inside / total)[:, None, :]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["bias"][:, 0] = d.sum(axis=(0, 2))
    dh = np.zeros((2, HIDDEN, n), found.dtype)
    da = np.empty((2, CHUNK, 3 * HIDDEN, n), found.dtype)
    for way in (0, 1):
        g["out"][way] = np.matmul(d, h[way].transpose(0, 2, 1)).sum(axis=0)
    below = np.stack([np.matmul(p["out"][way].T, d) for way in (0, 1)])
    for t in reversed(range(CHUNK)):
        before, z, r, x, gn = trace[t]
        for way, at_byte in ((0, t), (1, CHUNK - 1 - t)):
            dh[way] += below[way, at_byte]
        dx = dh * (1 - z) * (1 - x * x)
        step = np.concatenate((dh * (before - x) * 2 * z * (1 - z), dx * gn * 2 * r * (1 - r), dx), axis=1)
        for way, at_byte in ((0, t), (1, CHUNK - 1 - t)):
            da[way, at_byte] = step[way]
        step[:, 2 * HIDDEN :] *= r
        dh = dh * z
        for way in (0, 1):
            g["back"][way] += step[way] @ before[way].T
            dh[way] += p["back"][way].T @ step[way]
    columns = chunks.T.ravel()
    for way in (0, 1):
        for k in range(3 * HIDDEN):
            g["bytes"][way, k] = np.bincount(columns, da[way, :, k].ravel(), 256)
    return float(loss), g


def train(samples: list[tuple[str, str]], seed: int = 7) -> tuple[list[str], Parameters]:
    """Languages and parameters from (text, language) samples; every language gives as many chunks (Adam)."""
    languages = sorted({lang for text, lang in samples if text})
    p = initial(len(languages), seed)
    if not languages:
        return languages, p
    rng = np.random.default_rng(seed)
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in languages]
    for text, lang in samples:
        if text:
            chunks, size = chunks_of(text)
            parts[languages.index(lang)].append((chunks, used(len(chunks), size)))
    stock = [(np.concatenate([c for c, _ in x]), np.concatenate([s for _, s in x])) for x in parts]
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in "mv")
    for step in range(1, STEPS + 1):
        labels = rng.permutation(np.arange(BATCH) % len(languages)) if len(languages) <= BATCH else rng.integers(0, len(languages), BATCH)
        picks = [rng.integers(0, len(stock[k][1])) for k in labels]
        chunks = np.stack([stock[k][0][i] for k, i in zip(labels, picks)])
        sizes = np.array([stock[k][1][i] for k, i in zip(labels, picks)])
        _, g = gradients(p, chunks, sizes, labels)
        scale = min(1.0, 1.0 / max(1e-9, float(np.sqrt(sum((x * x).sum() for x in g.values())))))
        rate = RATE * (1 - (step - 1) / STEPS) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        for name, x in g.items():
            m[name] = 0.9 * m[name] + 0.1 * scale * x
            v[name] = 0.999 * v[name] + 0.001 * (scale * x) ** 2
            p[name] -= (rate * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return languages, p


def held_out(id_col: Column) -> Column:
    """A quarter of the ids; a null id is not held out, and not learned from either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], Parameters]:
    """Trains on at most ``sample_docs`` whole documents of each language outside the held-out quarter.

    The sample is the ids with the smallest hash; of rows that share id and language the text with the smallest
    hash counts. Null ids, languages and texts are not used. The sample alone reaches the driver.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    keys = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    # Ids and languages only: a partial limit per task comes before the shuffle, repeated ids count once.
    wanted = keys.groupBy("id", "lang").agg(F.lit(1).alias("one")).withColumn("nr", rank).where(F.col("nr") <= sample_docs).select("id", "lang")
    rows = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    found = rows.join(F.broadcast(wanted), ["id", "lang"]).groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = sorted((r["lang"], r["id"], r["text"]) for r in found.collect())
    return train([(text, lang) for lang, _, text in sample])


def prediction_column(model: tuple[list[str], Parameters], text: Column) -> Column:
    """Struct of ``lang`` and ``score``, null without learned languages or bytes."""
    languages, p = model

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = probabilities(p, texts.tolist())
        best = found.argmax(axis=1) if languages else np.zeros(len(texts), int)
        return pd.DataFrame({"lang": [languages[k] for k in best] if languages else [None] * len(texts), "score": found.max(axis=1) if languages else np.zeros(len(texts))})

    return predict(text)


def identify(docs: DataFrame, model: tuple[list[str], Parameters], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    A null text, one without a letter (Unicode category L), and every text when no language was learned are
    ``und`` with score 0. Repeated rows and null ids are rows like others; no rows give no rows.
    """
    text, learned = F.col(text_col), bool(model[0])
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)) & F.lit(learned)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), known.alias("known"), prediction_column(model, F.when(known, text)).alias("p"))
    lang = F.when(F.col("known"), F.col("p.lang")).otherwise(UNDETERMINED)
    return rows.select("doc_id", "held_out", lang.alias("lang_pred"), F.when(F.col("known"), F.least(F.col("p.score"), F.lit(1.0))).otherwise(0.0).alias("score"))


def runs(model: tuple[list[str], Parameters], text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, language) of the byte runs that share the likeliest label."""
    languages, p = model
    chunks, size = chunks_of(text)
    out: list[tuple[int, int, str]] = []
    for k in range(0, len(chunks), AT_ONCE):
        best = position_probabilities(p, chunks[k : k + AT_ONCE]).argmax(axis=1).T.ravel()[: size - k * CHUNK]
        cuts = [0, *(np.flatnonzero(best[1:] != best[:-1]) + 1).tolist(), len(best)]
        for a, b in zip(cuts, cuts[1:]):
            lang, start = languages[best[a]], k * CHUNK + a
            if out and out[-1][2] == lang:
                out[-1] = (out[-1][0], k * CHUNK + b, lang)
            else:
                out.append((start, k * CHUNK + b, lang))
    return out


def spans_column(model: tuple[list[str], Parameters], text: Column) -> Column:
    """Array of (start, end, lang): byte runs of one language; empty for a null or empty text."""

    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[dict(zip(("start", "end", "lang"), run)) for run in runs(model, t)] if model[0] else [] for t in batch])

    return F.pandas_udf(spans, "array<struct<start: int, end: int, lang: string>>")(text)
