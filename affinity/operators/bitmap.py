"""Building filters from terms.

A document's terms lie in one row, so its filter is made there: all terms of a batch are hashed
together and the bits are set in one matrix. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.functions.hashing import hash_matrix, hashes

SCHEMA = "doc_id bigint, m int, k int, words array<bigint>, popcount int, n_items int"
#: Terms that are hashed together.
TERMS = 200_000


def _filters(m: int, k: int) -> Callable:
    def rows(ids: list[int], lists: list[list[str]]) -> pa.RecordBatch:
        flat = [t for own in lists for t in own]
        owner = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
        bits = np.zeros((len(lists), m), np.uint8)
        if flat:
            at = (hash_matrix(flat, k) % np.uint64(m)).astype(np.int64)
            bits[np.repeat(owner, k), at.ravel()] = 1
        words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
        offsets = np.arange(len(lists) + 1, dtype=np.int32) * (m // 64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(np.full(len(ids), m, np.int32)),
                pa.array(np.full(len(ids), k, np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel())),
                pa.array(bits.sum(axis=1, dtype=np.int32)),
                pa.array([len(set(own)) for own in lists], pa.int32()),
            ],
            ["doc_id", "m", "k", "words", "popcount", "n_items"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, size = [], [], 0
            for i, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                lists.append(own or [])
                size += len(lists[-1])
                if size > TERMS or len(ids) == 1000:
                    yield rows(ids, lists)
                    ids, lists, size = [], [], 0
            if ids:
                yield rows(ids, lists)

    return run


def build_filters(terms: DataFrame, m: int, k: int) -> DataFrame:
    """One filter of ``m`` bits (a multiple of 64) for each row of ``terms`` (doc_id, terms)."""
    if m % 64:
        raise ValueError("the number of bits must be a multiple of 64")
    return terms.select("doc_id", "terms").mapInArrow(_filters(m, k), SCHEMA)


def term_bits(terms: DataFrame, m: int, k: int) -> DataFrame:
    """(doc_id, bit): the bits that each document sets, in rows. Each distinct term is hashed once."""
    pairs = terms.select("doc_id", F.explode_outer("terms").alias("term"))
    hashed = pairs.select("term").distinct().select("term", F.transform(hashes(F.col("term"), k), lambda h: h % m).alias("bits"))
    return pairs.join(hashed, "term").select("doc_id", F.explode("bits").alias("bit")).distinct()


def bit_words(bits: DataFrame) -> DataFrame:
    """(doc_id, word_idx, word): the words of 64 bits that are not zero, combined before the shuffle."""
    value = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))
    return bits.groupBy("doc_id", F.floor(F.col("bit") / 64).alias("word_idx")).agg(F.bit_or(value).alias("word"))
