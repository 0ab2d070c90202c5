"""Seeded randomness as a pure function of the row.

A draw depends only on (seed, key, tag), so it is the same for every partitioning, retry and
re-execution, which ``rand(seed)`` is not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Rounds of the keyed permutation.
ROUNDS = 4


def _col(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def uniform(key: Column | str, tag: str | Column, seed: int = 0) -> Column:
    """Uniform in [0, 1): the first 32 bits of sha256("seed:key:tag") over 2^32."""
    tag = tag if isinstance(tag, Column) else F.lit(tag)
    text = F.concat_ws(":", F.lit(str(seed)), _col(key).cast("string"), tag)
    head = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def uniform_range(key: Column | str, tag: str, low: float, high: float, seed: int = 0) -> Column:
    return F.lit(float(low)) + uniform(key, tag, seed) * F.lit(float(high) - float(low))


def uniform_int(key: Column | str, tag: str, low: Column | int, high: Column | int, seed: int = 0) -> Column:
    """Integer in [low, high], both ends included."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return (low + F.floor(uniform(key, tag, seed) * (high - low + 1))).cast("bigint")


def choose(key: Column | str, tag: str, weighted: list[tuple[str, float]], seed: int = 0) -> Column:
    """Pick a label by cumulative weight."""
    draw = uniform(key, tag, seed)
    total = float(sum(weight for _, weight in weighted))
    edge, picked = 0.0, None
    for label, weight in weighted[:-1]:
        edge += weight / total
        test = draw < F.lit(edge)
        picked = F.when(test, F.lit(label)) if picked is None else picked.when(test, F.lit(label))
    last = F.lit(weighted[-1][0])
    return last if picked is None else picked.otherwise(last)


def order_key(key: Column | str, seed: int) -> Column:
    """Hex sha256 of "seed:key"; ordering by it is a reproducible shuffle."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")), 256)


def whole(key: Column | str, tag: str, seed: int = 0) -> Column:
    """Whole number below 2^60: the first 60 bits of sha256("seed:key:tag")."""
    text = F.concat_ws(":", F.lit(str(seed)), _col(key).cast("string"), F.lit(tag))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def permuted(df: DataFrame, index: str, size: int, tag: str, seed: int = 0, out: str = "position") -> DataFrame:
    """Adds the place of ``index`` (0 to ``size - 1``) in a seeded permutation of as many places.

    A place is arithmetic on its index alone, so nothing is sorted or shuffled. The index is a pair of digits in
    bases ``a`` and ``b``, both about the square root of ``size``; a round adds a hash of one digit to the other,
    which can be undone, so the pairs are permuted. There are fewer than ``a`` pairs beyond ``size``; an index that
    lands on one goes on from there until it is inside, after ``a`` steps at most.
    """
    a = max(1, math.isqrt(max(0, size - 1)) + 1)
    b = max(1, -(-size // a))
    div = lambda x: F.floor((x - F.pmod(x, F.lit(b))) / b).cast("bigint")
    high, low, place = (f"_{out}_{c}" for c in ("high", "low", "place"))
    first = df.withColumns({high: div(F.col(index)), low: F.pmod(F.col(index), F.lit(b)).cast("bigint")})
    for k in range(ROUNDS):
        one, other, base = (high, low, a) if k % 2 == 0 else (low, high, b)
        first = first.withColumn(one, F.pmod(F.col(one) + whole(other, f"{tag}{k}", seed), F.lit(base)))

    def again(x: Column) -> Column:
        digits = [div(x), F.pmod(x, F.lit(b))]
        for k in range(ROUNDS):
            digits[k % 2] = F.pmod(digits[k % 2] + whole(digits[1 - k % 2], f"{tag}{k}", seed), F.lit((a, b)[k % 2]))
        return digits[0] * b + digits[1]

    first = first.withColumn(place, F.col(high) * b + F.col(low))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(a)), F.col(place), lambda x, _: F.when(x < size, x).otherwise(again(x)))
    return first.withColumn(out, F.when(F.col(place) < size, F.col(place)).otherwise(walk)).drop(high, low, place)
