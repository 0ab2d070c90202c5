"""Small tables with every odd case, and plain versions of the operators."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names the operators use inside.
        T.StructField("key", T.StringType()),
        T.StructField("rest", T.LongType()),
        T.StructField("fp", T.LongType()),
        T.StructField("at", T.StringType()),
        T.StructField("_stays", T.LongType()),
        T.StructField("row", T.StringType()),
    ]
)

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and very long texts, exact and near copies, repeated rows, odd characters."""
    rng = random.Random(seed)
    base = [words(rng, rng.choice([1, 2, 3, 10, 60, 200])) + "\n" + words(rng, 30) for _ in range(30)]
    texts = [None, "", "", " ", "\n\n", None, "ÄÖÜ ß İ K ſ", "a", "a b", "a b c", "é" * 700, "x" * 70_000, "x" * 70_000 + "y", "🙂 " * 300]
    texts += base + base[:5] + [base[0] + " tail", base[3].upper(), base[7].replace(" ", "  ")]
    long = words(rng, 9000)
    texts += [long, long, long + " end", long[:-4] + "zzzz"]
    texts += [base[9] + "\n" + base[10], base[10] + "\n" + base[11] + "\n" + base[11]]
    near = base[4].split(" ")
    for _ in range(8):
        copy = list(near)
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    rows = []
    for k, text in enumerate(texts):
        doc = k if k % 17 else None
        source = None if k % 7 == 0 else f"src{k % 4}"
        rows.append((doc, text, None, source, None if text is None else len(text), f"k{k}", k, k, "a", k, "r"))
    return rows + [rows[20], rows[20], rows[1], rows[16], (3, "another text for one id", "en", "src1", 5, None, None, None, None, None, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
