"""Quality classifier: a byte-level convolutional network in numpy.

Chunks of 512 bytes that overlap by 64 cover the whole document. A byte enters as a learned vector and
a flag that says whether the eight bytes up to it also stand at most 48 bytes earlier; learned filters
over 12 bytes at every fourth byte are max-pooled and mean-pooled in each chunk, a chunk's pools give
its evidence, and the mean evidence of the chunks passes through a logistic to one probability.
Only bytes are read: no label, language, source or id enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE = 12, 4
EMBED, FILTERS = 6, 24
ECHO, LAGS = 8, 48
SLOTS = (CHUNK - WIDTH) // STRIDE + 1
#: Chunks worked on at once; bounds a task's memory whatever the length of a text.
AT_ONCE = 512
#: Bounds of the training sample: labelled documents, and evenly spaced chunks of each.
SAMPLE_DOCS, SAMPLE_CHUNKS = 2000, 8
STEPS, BATCH_DOCS, RATE = 320, 32, 5e-3


def chunked(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n, CHUNK) bytes padded with zeros, (n, CHUNK) echo flags; at least one chunk."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(raw) - OVERLAP) // (CHUNK - OVERLAP)))
    full = np.zeros((n - 1) * (CHUNK - OVERLAP) + CHUNK, np.uint8)
    full[: len(raw)] = raw
    echo = np.zeros(len(full), bool)
    echo[: len(raw)] = echoes(raw)
    view = lambda x: as_strided(x, (n, CHUNK), (CHUNK - OVERLAP, 1))
    return view(full), view(echo)


def echoes(raw: np.ndarray) -> np.ndarray:
    """Does the run of ECHO bytes that ends here also end 1 to LAGS bytes earlier?"""
    out = np.zeros(len(raw), bool)
    for lag in range(1, min(LAGS, len(raw) - ECHO) + 1):
        run = raw[lag:] == raw[:-lag]
        for half in (1, 2, 4):
            run = run[half:] & run[:-half]
        out[lag + ECHO - 1 :] |= run
    return out


def lengths(text_bytes: int) -> int:
    return max(1, -(-(text_bytes - OVERLAP) // (CHUNK - OVERLAP)))


def windows(chunks: np.ndarray, echo: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(n, SLOTS, WIDTH * (EMBED + 1)) inputs of the filters."""
    x = np.empty((len(chunks), CHUNK, EMBED + 1), np.float32)
    x[..., :EMBED] = table[chunks]
    x[..., EMBED] = echo
    row = (EMBED + 1) * 4
    view = as_strided(x, (len(x), SLOTS, WIDTH * (EMBED + 1)), (CHUNK * row, STRIDE * row, 4))
    return np.ascontiguousarray(view)


def used_slots(chunks: np.ndarray) -> np.ndarray:
    """Windows of a chunk that start inside its text, at least one; padding beyond is no evidence."""
    filled = CHUNK - (chunks[:, ::-1] != 0).argmax(axis=1)
    filled[~(chunks != 0).any(axis=1)] = 0
    return np.clip(-(-filled // STRIDE), 1, SLOTS)


def pools(p: dict[str, np.ndarray], chunks: np.ndarray, echo: np.ndarray) -> tuple:
    x = windows(chunks, echo, p["table"])
    a = x.reshape(-1, x.shape[-1]) @ p["filters"]
    a += p["bias"]
    np.maximum(a, 0, out=a)
    a = a.reshape(len(chunks), SLOTS, FILTERS)
    n = used_slots(chunks)
    a *= (np.arange(SLOTS)[None, :] < n[:, None])[..., None]
    best = a.argmax(axis=1)
    top = np.take_along_axis(a, best[:, None, :], axis=1)[:, 0]
    return x, a, n, best, top, a.sum(axis=1) / n[:, None]


def evidence(p: dict[str, np.ndarray], text: str | None) -> float:
    chunks, echo = chunked(text)
    total = 0.0
    for k in range(0, len(chunks), AT_ONCE):
        *_, top, mean = pools(p, chunks[k : k + AT_ONCE], echo[k : k + AT_ONCE])
        total += float((top @ p["w_top"] + mean @ p["w_mean"] + p["c"]).sum())
    return total / len(chunks)


def probability(p: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """One probability per text; several short texts share a matrix product."""
    out, pending, held = np.zeros(len(texts)), [], 0

    def flush() -> None:
        if not pending:
            return
        chunks, echo = (np.concatenate([x[i] for _, x in pending]) for i in (0, 1))
        *_, top, mean = pools(p, chunks, echo)
        each = top @ p["w_top"] + mean @ p["w_mean"] + p["c"]
        counts = np.array([len(x[0]) for _, x in pending])
        out[[k for k, _ in pending]] = np.add.reduceat(each, np.cumsum(counts) - counts) / counts
        pending.clear()

    for k, text in enumerate(texts):
        if lengths(4 * len(text or "")) > AT_ONCE:
            out[k] = evidence(p, text)
            continue
        pending.append((k, chunked(text)))
        held += len(pending[-1][1][0])
        if held >= AT_ONCE // 2:
            flush()
            held = 0
    flush()
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters from (chunks, echo, label) samples, by gradient descent through the pools (Adam)."""
    rng = np.random.default_rng(seed)
    fan = WIDTH * (EMBED + 1)
    p = {
        "table": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": rng.normal(0, fan**-0.5, (fan, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "w_top": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "w_mean": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "c": np.zeros(1, np.float32),
    }
    if not samples:
        return p
    share = np.clip(np.mean([y for *_, y in samples]), 0.02, 0.98)
    p["c"][0] = np.log(share / (1 - share))
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    order = np.empty(0, np.int64)
    for step in range(1, STEPS + 1):
        if len(order) < BATCH_DOCS:
            order = np.concatenate((order, rng.permutation(len(samples))))
        batch, order = order[:BATCH_DOCS], order[BATCH_DOCS:]
        grads = _gradients(p, [samples[i] for i in batch])
        rate = RATE * (1 - (step - 1) / STEPS) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        for name, g in grads.items():
            m[name] = 0.9 * m[name] + 0.1 * g
            v[name] = 0.999 * v[name] + 0.001 * g * g
            p[name] -= (rate * m[name] / (np.sqrt(v[name]) + 1e-8)).astype(np.float32)
    return p


def _gradients(p: dict[str, np.ndarray], batch: list) -> dict[str, np.ndarray]:
    chunks, echo = (np.concatenate([s[i] for s in batch]) for i in (0, 1))
    counts = np.array([len(s[0]) for s in batch])
    x, a, n, best, top, mean = pools(p, chunks, echo)
    each = top @ p["w_top"] + mean @ p["w_mean"] + p["c"]
    score = np.add.reduceat(each, np.cumsum(counts) - counts) / counts
    error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - np.array([s[2] for s in batch])) / len(batch)
    d = np.repeat(error / counts, counts).astype(np.float32)
    da = (d / n)[:, None, None] * p["w_mean"] * (a > 0)
    rows = np.arange(len(chunks))[:, None]
    da[rows, best, np.arange(FILTERS)] += d[:, None] * p["w_top"] * (top > 0)
    flat = da.reshape(-1, FILTERS).astype(np.float32)
    dx = (flat @ p["filters"].T).reshape(len(chunks), SLOTS, WIDTH, EMBED + 1)[..., :EMBED]
    at = np.arange(SLOTS)[:, None] * STRIDE + np.arange(WIDTH)
    seen = chunks[:, at].ravel()
    table = np.stack([np.bincount(seen, dx[..., e].ravel(), 256) for e in range(EMBED)], axis=1)
    return {
        "table": table.astype(np.float32),
        "filters": x.reshape(-1, x.shape[-1]).T @ flat,
        "bias": flat.sum(axis=0),
        "w_top": d @ top,
        "w_mean": d @ mean,
        "c": d.sum(keepdims=True),
    }


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict[str, np.ndarray]:
    """Trains on at most SAMPLE_DOCS labelled documents outside the held-out fifth.

    The sample is the labelled ids with the smallest hash; SAMPLE_CHUNKS chunks at even distances over the whole
    text stand for a longer one. Null labels and ids are not used, of repeated labels the largest is, of rows
    that share an id the text with the smallest hash, and without any label the untrained network is returned.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    wanted = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_DOCS)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    # The wanted ids are SAMPLE_DOCS rows at most.
    found = texts.join(F.broadcast(wanted), "_id").groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    found = found.mapInPandas(_sampled, "id long, bytes binary, echo binary, label int")
    rows = sorted(found.collect(), key=lambda r: (r["id"], bytes(r["bytes"])))
    return train([(np.frombuffer(r["bytes"], np.uint8).reshape(-1, CHUNK), np.frombuffer(r["echo"], bool).reshape(-1, CHUNK), r["label"]) for r in rows])


def _sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for key, text, label in zip(frame["_id"], frame["_text"], frame["_label"]):
            chunks, echo = chunked(text)
            at = np.unique(np.linspace(0, len(chunks) - 1, SAMPLE_CHUNKS).round().astype(int))
            rows.append((key, chunks[at].tobytes(), echo[at].tobytes(), label))
        yield pd.DataFrame(rows, columns=["id", "bytes", "echo", "label"])


def score_column(parameters: dict[str, np.ndarray], text: Column) -> Column:
    """Probability of label 1; a null or empty text is scored as one chunk of padding."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(probability(parameters, texts.tolist()))

    return score(text_of(text))


def classify(docs: DataFrame, parameters: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; repeated rows and null ids are rows like others."""
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score_column(parameters, F.col(text_col)).alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, parameters: dict[str, np.ndarray], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches ``threshold``, all columns kept; null and empty texts are scored like others, no rows give no rows."""
    return docs.where(score_column(parameters, F.col(text_col)) >= threshold)
