"""Estimates from the bit counts of filters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits that both filters must have for a comparison to mean anything.
LEAST_BITS = 5
#: Decimals of scores that are ranked and returned.
DECIMALS = 6


def rounded_size(bits: int) -> int:
    """``bits`` up to a multiple of 32."""
    return -(-bits // 32) * 32


def optimal_size(items: Column | float, rate: float = 0.01) -> Column | int:
    """Bits for ``items`` entries at a false-positive ``rate``, up to a multiple of 32."""
    per_item = -math.log(rate) / math.log(2) ** 2
    if isinstance(items, Column):
        return (F.ceil(F.ceil(items * per_item) / 32) * 32).cast("bigint")
    return rounded_size(math.ceil(items * per_item))


def optimal_hashes(bits: Column | float, items: Column | float) -> Column | int:
    """Hash functions for ``items`` entries in ``bits``, at least one."""
    if isinstance(bits, Column) or isinstance(items, Column):
        return F.greatest(F.lit(1), F.floor(F.lit(1.0) * bits / items * math.log(2) + 0.5)).cast("bigint")
    return max(1, math.floor(bits / items * math.log(2) + 0.5))


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def intersection(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n)


def cardinality(bits_set: Column, m: Column, k: Column) -> Column:
    """The number of entries behind ``bits_set`` of ``m`` bits; infinite for a full filter."""
    t, m, k = bits_set.cast("double"), m.cast("double"), k.cast("double")
    return F.when(t <= 0, F.lit(0.0)).when(t >= m, F.lit(math.inf)).otherwise(-(m / k) * F.ln(1 - t / m))


def jaccard(a: Column, b: Column, both: Column, m: Column, k: Column) -> Column:
    """The estimated set overlap of two filters with ``a`` and ``b`` bits set and ``both`` in common."""
    union = a + b - both
    n = cardinality(union, m, k)
    share = (cardinality(a, m, k) + cardinality(b, m, k) - n) / n
    return (
        F.when(F.least(a, b) < LEAST_BITS, F.lit(0.0))
        .when((union >= m) | (union <= 0), F.lit(0.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
    )


def false_positive_rate(items: Column, m: Column, k: Column) -> Column:
    return F.pow(1 - F.exp(-k * items / m), k)


def contains(words: Column, bits: Column) -> Column:
    """All ``bits`` are set in the filter."""
    return F.forall(bits, lambda b: F.get(words, F.floor(b / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (b % 64).cast("int"))) != 0)


def memory_bytes(m: Column) -> Column:
    return m / 8
