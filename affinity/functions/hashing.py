"""String hashes over UTF-16 units, as columns and over whole Arrow arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF


def code_units(x: Column) -> Column:
    """The UTF-16 units of a string; a character beyond the first plane gives two."""
    codes = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    high = lambda c: F.shiftright(c - 0x10000, 10) + 0xD800
    low = lambda c: (c - 0x10000).bitwiseAND(0x3FF) + 0xDC00
    wide = F.flatten(F.transform(codes, lambda c: F.when(c > 0xFFFF, F.array(high(c), low(c))).otherwise(F.array(c))))
    return F.when(F.exists(codes, lambda c: c > 0xFFFF), wide).otherwise(codes)


def fnv1a(units: Column) -> Column:
    return F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(MASK))


def djb2(units: Column) -> Column:
    return F.aggregate(units, F.lit(5381).cast("bigint"), lambda h, c: (h * 33 + c).bitwiseAND(MASK))


def sdbm(units: Column) -> Column:
    return F.aggregate(units, F.lit(0).cast("bigint"), lambda h, c: (c + h * 65599).bitwiseAND(MASK))


def hashes(x: Column, k: int) -> Column:
    """The first ``k`` hashes of a string; those after the third come from the first two."""
    units = code_units(x)
    first = [fnv1a(units), djb2(units), sdbm(units)]
    more = [(first[0] + i * first[1]).bitwiseAND(MASK) for i in range(3, k)]
    return F.array(*(first + more)[:k])


def seeded(seed: int, *parts: Column) -> Column:
    """A repeatable order in place of a random one."""
    return fnv1a(code_units(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])))


def hash_matrix(terms: list[str], k: int) -> np.ndarray:
    """The first ``k`` hashes of each term, as rows. All terms advance together, a unit at a time."""
    encoded = [t.encode("utf-16-le", "surrogatepass") for t in terms]
    lengths = np.array([len(e) // 2 for e in encoded], np.int64)
    units = np.frombuffer(b"".join(encoded), np.uint16).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")  # those still running come first
    at, left = starts[order], lengths[order]
    h = np.empty((3, len(terms)), np.uint64)
    h[0], h[1], h[2] = 2166136261, 5381, 0
    mask = np.uint64(MASK)
    running = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    for j, n in enumerate(running.tolist()):
        c = units[at[:n] + j]
        h[0, :n] = ((h[0, :n] ^ c) * np.uint64(16777619)) & mask
        h[1, :n] = (h[1, :n] * np.uint64(33) + c) & mask
        h[2, :n] = (c + h[2, :n] * np.uint64(65599)) & mask
    out = np.empty((k, len(terms)), np.uint64)
    for i in range(k):
        out[i, order] = h[i] if i < 3 else (h[0] + np.uint64(i) * h[1]) & mask
    return out.T
