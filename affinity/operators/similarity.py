"""Scores between filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.functions.bloom import DECIMALS, LEAST_BITS, intersection, jaccard

#: Queries whose filters a task holds at once.
QUERY_BLOCK = 2048
#: Blocks that one scan of the filters is held against, one after another; at 8192 bits they are 32 MB.
SCAN_BLOCKS = 16


def score(a: str, b: str) -> Column:
    """The rounded score of two filter rows; filters of different sizes have none in common."""
    both = intersection(F.col(f"{a}.words"), F.col(f"{b}.words"))
    value = jaccard(F.col(f"{a}.popcount"), F.col(f"{b}.popcount"), both, F.col(f"{a}.m"), F.col(f"{a}.k"))
    return F.round(F.when(F.col(f"{a}.m") == F.col(f"{b}.m"), value).otherwise(F.lit(0.0)), DECIMALS)


def pair_scores(filters: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity) of each pair (id_a, id_b), once for either order; 0 where a document is missing."""
    wanted = pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
    rows = (
        wanted.alias("p")
        .join(filters.alias("a"), F.col("p.id_a") == F.col("a.doc_id"), "left")
        .join(filters.alias("b"), F.col("p.id_b") == F.col("b.doc_id"), "left")
    )
    return rows.select("p.id_a", "p.id_b", F.coalesce(score("a", "b"), F.lit(0.0)).alias("similarity"))


def _query(filters: DataFrame, query: int):
    return filters.where(F.col("doc_id") == query).select("m", "k", "words", "popcount").first()


def intersections(filters: DataFrame, query: int) -> DataFrame:
    """(doc_id, common_bits): the bits each other document has in common with the query; none for other sizes."""
    row = _query(filters, query)
    others = filters.where(F.col("doc_id") != query)
    if row is None:
        return others.limit(0).select("doc_id", F.lit(0).alias("common_bits"))
    words = F.array(*[F.lit(w) for w in row.words])
    common = F.when(F.col("m") == row.m, intersection(F.col("words"), words)).otherwise(F.lit(0))
    return others.select("doc_id", common.alias("common_bits"))


def scores_to_one(filters: DataFrame, query: int) -> DataFrame:
    """(doc_id, similarity) of every other document with the query, whose filter is a constant of the plan."""
    row = _query(filters, query)
    others = filters.where(F.col("doc_id") != query)
    if row is None:
        return others.limit(0).select("doc_id", F.lit(0.0).alias("similarity"))
    words = F.array(*[F.lit(w) for w in row.words])
    value = jaccard(F.col("popcount"), F.lit(row.popcount), intersection(F.col("words"), words), F.col("m"), F.col("k"))
    # the cheap guards come first, so that most small filters are never compared
    value = F.when((F.col("m") != row.m) | (F.col("popcount") < LEAST_BITS), F.lit(0.0)).otherwise(value)
    return others.select("doc_id", F.round(value, DECIMALS).alias("similarity"))


def similar_to_one(
    filters: DataFrame, query: int, most: int = 10, *, threshold: float | None = None, candidates: DataFrame | None = None
) -> DataFrame:
    """(doc_id, similarity): the best ``most`` documents with a score above 0, or of at least ``threshold``.

    Only ``candidates`` (doc_id) are compared if they are given, even if there are none. Equal scores go by id.
    """
    pool = filters
    if candidates is not None:
        pool = filters.join(candidates.select("doc_id").unionByName(filters.select("doc_id").where(F.col("doc_id") == query)), "doc_id", "left_semi")
    scores = scores_to_one(pool, query)
    scores = scores.where(F.col("similarity") > 0 if threshold is None else F.col("similarity") >= threshold)
    return scores.orderBy(F.desc("similarity"), "doc_id").limit(most)


def estimates(a: np.ndarray, b: np.ndarray, both: np.ndarray, m: int, k: int) -> np.ndarray:
    """``jaccard`` over arrays."""
    def entries(t: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(t <= 0, 0.0, -(m / k) * np.log(1 - np.minimum(t, m) / m))

    union = a + b - both
    n = entries(union)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = (entries(a) + entries(b) - n) / n
    share = np.clip(share, 0.0, 1.0)
    share[(np.minimum(a, b) < LEAST_BITS) | (union >= m) | (union <= 0)] = 0.0
    return share


def _bits(words: pa.Array, m: int) -> np.ndarray:
    flat = np.asarray(words.flatten()).astype(np.int64)
    return np.unpackbits(flat.view(np.uint8).reshape(-1, m // 8), axis=1, bitorder="little")


def _scan(ids: np.ndarray, queries: np.ndarray, m: int, k: int, most: int, block: int) -> Callable:
    """Holds batches of filters against the queries, ``block`` of these at a time, and keeps the best of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                batch = batch.filter(pa.array(np.asarray(batch["m"]) == m))
                if not batch.num_rows:
                    continue
                docs = np.asarray(batch["doc_id"])
                bits = _bits(batch["words"], m).astype(np.float32)
                sizes = bits.sum(axis=1, dtype=np.float64)
                by_id = np.argsort(docs, kind="stable")
                for first in range(0, len(ids), block):
                    own = ids[first : first + block]
                    left = np.unpackbits(queries[first : first + block].view(np.uint8), axis=1, bitorder="little").astype(np.float32)
                    # 0/1 matrices: the product counts common bits exactly
                    both = (left @ bits.T).astype(np.float64)
                    value = np.round(estimates(left.sum(axis=1, dtype=np.float64)[:, None], sizes[None, :], both, m, k), DECIMALS)
                    value[own[:, None] == docs[None, :]] = 0.0
                    best = by_id[np.argsort(-value[:, by_id], axis=1, kind="stable")[:, :most]]
                    score = np.take_along_axis(value, best, axis=1)
                    kept = score > 0
                    out = [np.repeat(own, best.shape[1]).reshape(best.shape)[kept], docs[best][kept], score[kept]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "doc_id", "similarity"])

    return run


def similar_to_many(filters: DataFrame, asked: DataFrame, most: int = 10, *, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, similarity, rank): the best ``most`` of ``filters`` for each of the filters ``asked``.

    The queries go to all tasks in blocks of ``block`` filters, ``SCAN_BLOCKS`` of them with one scan. A task keeps
    the best of each batch, so what is shuffled grows with queries and batches and not with their product with the documents.
    """
    spark = filters.sparkSession
    schema = "query_id bigint, doc_id bigint, similarity double"
    count = asked.count()
    scans = max(1, -(-count // (block * SCAN_BLOCKS)))
    found = spark.createDataFrame([], schema)
    for b in range(scans if count else 0):
        part = asked if scans == 1 else asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(scans)) == b)
        rows = part.select("doc_id", "m", "k", "words").collect()
        for m, k in sorted({(r.m, r.k) for r in rows}):
            own = [r for r in rows if (r.m, r.k) == (m, k)]
            run = _scan(np.array([r.doc_id for r in own], np.int64), np.array([r.words for r in own], np.int64), m, k, most, block)
            found = found.unionByName(filters.select("doc_id", "m", "words").mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def exact_jaccard(terms: DataFrame, query: int) -> DataFrame:
    """(doc_id, jaccard): the true overlap of each document's terms with the query's."""
    row = terms.where(F.col("doc_id") == query).select("terms").first()
    others = terms.where(F.col("doc_id") != query)
    if row is None:
        return others.limit(0).select("doc_id", F.lit(0.0).alias("jaccard"))
    own = F.array(*[F.lit(t) for t in row.terms]) if row.terms else F.array().cast("array<string>")
    common, union = F.size(F.array_intersect("terms", own)), F.size(F.array_union("terms", own))
    return others.select("doc_id", F.round(F.coalesce(F.try_divide(common, union), F.lit(0.0)), DECIMALS).alias("jaccard"))


def _exact_block(ids: list[int], lists: list[list[str]], most: int) -> Callable:
    """Holds each document's terms against a block of queries' terms, through the queries' inverted lists."""
    vocabulary = sorted({t for own in lists for t in own})
    place = {t: i for i, t in enumerate(vocabulary)}
    held = sorted((place[t], q) for q, own in enumerate(lists) for t in own)
    of_term = np.array([q for _, q in held], np.int64)
    starts = np.searchsorted(np.array([p for p, _ in held], np.int64), np.arange(len(vocabulary) + 1))
    sizes = np.array([len(own) for own in lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = np.array(ids), pa.array(vocabulary, pa.string())
        step = max(1, 2_000_000 // len(ids))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                docs, lists_here = np.asarray(batch["doc_id"]), batch["terms"]
                codes = pc.index_in(lists_here.flatten(), value_set=known)
                rows = np.asarray(pc.list_parent_indices(lists_here)).astype(np.int64)
                there = np.asarray(codes.is_valid())
                codes, rows = np.asarray(codes.drop_null()).astype(np.int64), rows[there]
                count = starts[codes + 1] - starts[codes]
                query = of_term[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[codes], count)]
                both = np.bincount(query * len(docs) + np.repeat(rows, count), minlength=len(own) * len(docs)).reshape(len(own), len(docs))
                lengths = np.asarray(lists_here.value_lengths().fill_null(0)).astype(np.int64)
                value = np.round(both / np.maximum(sizes[:, None] + lengths[None, :] - both, 1), DECIMALS)
                value[own[:, None] == docs[None, :]] = 0.0
                by_id = np.argsort(docs, kind="stable")
                best = by_id[np.argsort(-value[:, by_id], axis=1, kind="stable")[:, :most]]
                score = np.take_along_axis(value, best, axis=1)
                kept = score > 0
                out = [np.repeat(own, best.shape[1]).reshape(best.shape)[kept], docs[best][kept], score[kept]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["query_id", "doc_id", "jaccard"])

    return run


def exact_to_many(terms: DataFrame, asked: DataFrame, most: int = 10, *, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, jaccard, rank): the ``most`` documents with the greatest true overlap for each of ``asked`` (doc_id, terms).

    The queries go to all tasks in blocks. Documents without a term in common are left out; equal overlaps go by id.
    """
    spark = terms.sparkSession
    schema = "query_id bigint, doc_id bigint, jaccard double"
    blocks = max(1, -(-asked.count() // block))
    found = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b).select("doc_id", "terms").collect()
        rows = [r for r in rows if r.terms]
        if rows:
            run = _exact_block([r.doc_id for r in rows], [r.terms for r in rows], most)
            found = found.unionByName(terms.select("doc_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms")).mapInArrow(run, schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("jaccard"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def common_terms(terms: DataFrame, pairs: DataFrame, most: int = 10) -> DataFrame:
    """(id_a, id_b, terms): the first ``most`` terms of the first document that the second has too."""
    a = terms.select(F.col("doc_id").alias("id_a"), F.col("terms").alias("terms_a"))
    b = terms.select(F.col("doc_id").alias("id_b"), F.col("terms").alias("terms_b"))
    both = pairs.select("id_a", "id_b").join(a, "id_a").join(b, "id_b")
    return both.select("id_a", "id_b", F.slice(F.array_intersect("terms_a", "terms_b"), 1, most).alias("terms"))
