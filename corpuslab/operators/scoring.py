"""User models, nearest codes and learning-rate schedules."""

from __future__ import annotations

import sys
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .ordering import cut_lineage

# Models a Python worker holds; the least recently used one goes first.
MODELS_HELD = 2
HOLDER = "_corpuslab_models"


def held_model(name: str, make_model: Callable[[], Callable]) -> Callable:
    """The model of this Python worker, built by the first task that needs it.

    Spark gives a worker one task after another, so a model is built once per worker and not once per task. Functions
    come to a worker anew with every task, their globals too; what stays are the modules, so one of them holds the models.
    """
    models = sys.modules.setdefault(HOLDER, ModuleType(HOLDER)).__dict__.setdefault("models", OrderedDict())
    if name in models:
        models.move_to_end(name)
    else:
        while len(models) >= MODELS_HELD:
            models.popitem(last=False)
        models[name] = make_model()
    return models[name]


# Numbers of a codebook block (32 MB of doubles) that is copied to every worker.
MAX_CODEBOOK_NUMBERS = 4_000_000


def score(
    df: DataFrame,
    make_model: Callable[[], Callable[[pd.Series], list]],
    column: str,
    batch_size: int = 64,
    on_error: str = "passthrough",
    out: str = "scored",
    out_type: T.DataType | str | None = None,
) -> DataFrame:
    """Run a user model over ``column``; adds ``out`` and ``failed``.

    ``make_model`` runs once per Python worker and returns a function from a batch to its results, which must
    not depend on earlier calls. A batch that fails is tried again in halves, down to single rows, so ``k`` bad rows
    of ``n`` cost some ``k log n`` calls; a row that fails gets its input back and ``failed`` = true, or ends the
    job with ``on_error="raise"``. Results have the type of the input, or
    ``out_type``; with a type of its own, a row that fails gets null.
    """
    if on_error not in ("passthrough", "raise"):
        raise ValueError(f"unknown on_error: {on_error}")
    names = df.columns
    model_name = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held_model(model_name, make_model)
        for rows in batches:
            for start in range(0, len(rows), batch_size):
                part = rows.iloc[start : start + batch_size]
                values, failed = _run_batch(model, part[column], on_error)
                if out_type is not None:
                    values = [None if bad else v for v, bad in zip(values, failed)]
                yield part[names].assign(**{out: pd.Series(values, index=part.index, dtype=object), "failed": failed})

    kind = df.schema[column].dataType if out_type is None else T._parse_datatype_string(out_type) if isinstance(out_type, str) else out_type
    schema = T.StructType(df.schema.fields + [T.StructField(out, kind), T.StructField("failed", T.BooleanType())])
    return df.mapInPandas(run, schema)


def _run_batch(model: Callable, values: pd.Series, on_error: str) -> tuple[list, list[bool]]:
    try:
        results = list(model(values))
        if len(results) != len(values):
            raise ValueError(f"the model returned {len(results)} results for {len(values)} rows")
        return results, [False] * len(values)
    except Exception:
        if on_error == "raise":
            raise
    if len(values) == 1:
        return [values.iloc[0]], [True]
    half = len(values) // 2
    parts = [_run_batch(model, part, on_error) for part in (values.iloc[:half], values.iloc[half:])]
    return parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]


def _nearest(block: np.ndarray, ids: np.ndarray, norms: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closest code and squared distance of each row of ``x``; ties go to the lowest id.

    The expanded square finds codes within rounding error of the best; those few are summed directly.
    """
    rough = norms[None, :] - 2.0 * (x @ block.T)
    best = rough.min(axis=1, keepdims=True)
    slack = 1e-9 * (1.0 + np.abs(best) + (x * x).sum(axis=1, keepdims=True) + norms.max())
    near = rough <= best + slack
    first = near.argmax(axis=1)
    codes, dist = ids[first].copy(), ((x - block[first]) ** 2).sum(axis=1)
    for i in np.flatnonzero(near.sum(axis=1) > 1):
        close = np.flatnonzero(near[i])
        exact = ((x[i] - block[close]) ** 2).sum(axis=1)
        k = np.lexsort((ids[close], exact))[0]
        codes[i], dist[i] = ids[close[k]], exact[k]
    return codes, dist


def nearest_code(vectors: DataFrame, codebook: DataFrame, vec: str = "vec", max_numbers: int = MAX_CODEBOOK_NUMBERS) -> DataFrame:
    """Adds the ``code_id`` of the nearest code by squared distance, and ``distance``; ties go to the lowest id.

    The codebook is cut into blocks of about ``max_numbers`` numbers. Each is copied to the workers and all
    vectors stream past it, unshuffled, carrying the best code so far; between two blocks they are written.
    """
    size = codebook.agg(F.sum(F.size("vec").cast("bigint"))).first()[0] or 0
    if size == 0:
        raise ValueError("codebook is empty")
    count = -(-size // max_numbers)
    columns = vectors.columns
    best = vectors.withColumn("_best", F.lit(None).cast("struct<distance: double, code_id: bigint>"))
    for nr in range(count):
        rows = codebook.where(F.pmod(F.xxhash64("code_id"), F.lit(count)) == nr).select("code_id", "vec").orderBy("code_id").collect()
        if rows:
            found = _block_search(np.array([r["code_id"] for r in rows], dtype=np.int64), np.array([r["vec"] for r in rows], dtype=float))
            best = best.withColumn("_new", found(vec)).withColumn("_best", F.least("_best", "_new")).drop("_new")
            if nr < count - 1:
                best = cut_lineage(best)
    return best.select(*columns, "_best.code_id", "_best.distance")


def _block_search(ids: np.ndarray, block: np.ndarray) -> Callable:
    norms = (block * block).sum(axis=1)

    @F.pandas_udf("struct<distance: double, code_id: bigint>")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in batches:
            codes, dist = _nearest(block, ids, norms, np.stack([np.asarray(a, dtype=float) for a in v]))
            yield pd.DataFrame({"distance": dist, "code_id": codes})

    return assign


def schedule_value(iteration: Column, kind: str, base: float, warmup: int = 0, **spec) -> Column:
    """Learning rate in force at an iteration, from the short step lists of the configuration.

    ``multistep``: ``milestones`` (repeats count twice), ``gamma``, ``restarts``, ``restart_weights``;
    ``cosine``: ``periods``, ``restart_weights``, ``eta_min``; ``constant``. Before ``warmup`` the
    rate is ``base * iteration / warmup``.
    """
    if kind == "multistep":
        value = _multistep(iteration, base, **spec)
    elif kind == "cosine":
        value = _cosine(iteration, base, **spec)
    elif kind == "constant":
        value = F.lit(float(base))
    else:
        raise ValueError(f"unknown schedule: {kind}")
    if warmup > 0:
        value = F.when(iteration < warmup, F.lit(float(base)) / warmup * iteration).otherwise(value)
    return value


def _step_lookup(iteration: Column, steps: list[tuple[int, float]]) -> Column:
    """Value of the last step whose start is at or before the iteration."""
    steps = sorted(steps)
    count = F.size(F.filter(F.lit([s for s, _ in steps]), lambda s: s <= iteration))
    return F.get(F.lit([float(v) for _, v in steps]), count - 1)


def _multistep(iteration: Column, base: float, milestones, gamma: float = 0.1, restarts=(0,), restart_weights=(1,)) -> Column:
    if len(restarts) != len(restart_weights):
        raise ValueError("restarts and their weights do not match")
    reset = dict(zip(restarts, restart_weights))
    value, steps = float(base), [(-(2**62), float(base))]
    for at in sorted(set(milestones) | set(restarts)):
        value = base * reset[at] if at in reset else value * gamma ** list(milestones).count(at)
        steps.append((at, value))
    return _step_lookup(iteration, steps)


def _cosine(iteration: Column, base: float, periods, restart_weights=(1,), eta_min: float = 0.0) -> Column:
    if len(periods) != len(restart_weights):
        raise ValueError("periods and restart weights do not match")
    ends = np.cumsum(periods).tolist()
    index = F.size(F.filter(F.lit(ends), lambda e: e < iteration))
    start = F.get(F.lit([0, *ends[:-1]]), index)
    length = F.get(F.lit(list(periods)), index)
    weight = F.get(F.lit([float(w) for w in restart_weights]), index)
    angle = F.pi() * ((iteration - start) / length)
    return F.lit(float(eta_min)) + weight * 0.5 * (base - eta_min) * (1.0 + F.cos(angle))
