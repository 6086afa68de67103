"""Documents worth comparing with a query, in corpora too large to compare all."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from math import ceil, floor, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.functions.hashing import seeded
from affinity.operators.postings import fast_candidates
from affinity.operators.similarity import intersections

RECENT_DAYS = 30


def sample_size(most: int) -> int:
    """How many of the query's words are looked up for ``most`` candidates."""
    return min(8, max(2, floor(sqrt(most / 10))))


def sampled_documents(documents: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """(doc_id): ``count`` documents in a repeatable random order."""
    return documents.select("doc_id", seeded(seed, F.col("doc_id")).alias("h")).orderBy("h", "doc_id").limit(count).select("doc_id")


def bitmap_candidates(filters: DataFrame, query: int, most: int) -> DataFrame:
    """(doc_id, common_bits): the documents with most bits in common with the query."""
    found = intersections(filters, query).where(F.col("common_bits") > 0)
    return found.orderBy(F.desc("common_bits"), "doc_id").limit(min(ceil(most * 0.7), 700))


def recent_candidates(corpus: DataFrame, indexed: DataFrame, query: int, most: int, now: datetime) -> DataFrame:
    """(doc_id): of the first documents changed within 30 days, those that are indexed and not the query."""
    since = F.lit(now) - F.expr(f"INTERVAL {RECENT_DAYS} DAYS")
    first = corpus.where(F.col("mtime") > since).select("doc_id").orderBy("doc_id").limit(ceil(most * 0.2))
    return first.where(F.col("doc_id") != query).join(indexed.select("doc_id"), "doc_id", "left_semi")


def _in_turn(branches: list[DataFrame], most: int) -> DataFrame:
    """(doc_id, branch): the first ``most`` of the branches (doc_id, place), one after another, each document once."""
    rows = reduce(DataFrame.unionByName, [b.select("doc_id", F.lit(i).alias("branch"), "place") for i, b in enumerate(branches)])
    first = rows.groupBy("doc_id").agg(F.min(F.struct("branch", "place")).alias("first"))
    return first.orderBy("first", "doc_id").limit(most).select("doc_id", "first.branch")


def _placed(df: DataFrame, *order) -> DataFrame:
    """Numbers a branch, which has at most as many rows as candidates are asked for."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def smart_candidates_by_word(index: DataFrame, corpus: DataFrame, filters: DataFrame, query: int, most: int, now: datetime, seed: int = 0) -> DataFrame:
    """(doc_id, branch): documents that share sampled words (0), then recent ones (1)."""
    words = fast_candidates(index, query, ceil(most * 0.8), sample_size(most), seed)
    recent = recent_candidates(corpus, filters, query, most, now)
    return _in_turn([_placed(words, F.desc("matches"), F.asc("doc_id")), _placed(recent, F.asc("doc_id"))], most)


def smart_candidates_by_bitmap(corpus: DataFrame, filters: DataFrame, query: int, most: int, now: datetime, seed: int = 0) -> DataFrame:
    """(doc_id, branch): documents with common bits (0), then recent ones (1), then some of the rest (2)."""
    near = bitmap_candidates(filters, query, most)
    recent = recent_candidates(corpus, filters, query, most, now)
    known = near.select("doc_id").unionByName(recent.select("doc_id"))
    rest = filters.select("doc_id").where(F.col("doc_id") != query).join(known, "doc_id", "left_anti")
    drawn = rest.withColumn("h", seeded(seed, F.lit(query), F.col("doc_id"))).orderBy("h", "doc_id").limit(min(ceil(most * 0.1), 100))
    present = filters.where(F.col("doc_id") == query).select(F.lit(1).alias("_present"))
    found = _in_turn(
        [_placed(near, F.desc("common_bits"), F.asc("doc_id")), _placed(recent, F.asc("doc_id")), _placed(drawn, F.asc("h"), F.asc("doc_id"))], most
    )
    return found.join(F.broadcast(present.limit(1))).drop("_present")  # nothing for a query that is not indexed
