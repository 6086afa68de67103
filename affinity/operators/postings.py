"""The inverted word index and look-ups in it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinity.functions.hashing import seeded

#: Share of documents beyond which a word is too common, and fewest documents of a word in a corpus of over 100.
TOO_COMMON, LEAST_DOCUMENTS = 0.7, 2


def indexable(w: Column) -> Column:
    """A word of 3 to 20 characters, not mostly special ones, and no short number."""
    special = F.regexp_count(w, F.lit("[^a-z0-9]"))
    return F.length(w).between(3, 20) & (special <= F.length(w) * 0.3) & ~(w.rlike(r"^\d+$") & (F.length(w) < 4))


def document_words(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, word): the distinct words of each document that can be indexed, with their first place."""
    words = F.array_distinct(F.filter(F.transform("tokens", F.lower), indexable))
    rows = tokens.select("doc_id", F.posexplode_outer(words).alias("pos", "word"))
    return rows.where(F.col("word").isNotNull())


def word_index(words: DataFrame, documents: int) -> DataFrame:
    """(doc_id, pos, word) after the document-frequency filter, which holds from ten documents on.

    A document of which no word would be left keeps all its words.
    """
    if documents < 10:
        return words
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    least = LEAST_DOCUMENTS if documents > 100 else 1
    admitted = df.where((F.col("df") / documents <= TOO_COMMON) & (F.col("df") >= least)).select("word")
    kept = words.join(admitted, "word", "left_semi")
    bare = words.join(kept.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.select("doc_id", "pos", "word").unionByName(bare.select("doc_id", "pos", "word"))


def sequential_word_index(words: DataFrame, numbered: DataFrame) -> DataFrame:
    """(doc_id, pos, word) as an index gives it that admits words one document after another.

    ``numbered`` has each document's number ``seq`` in order of arrival, from 1. A word is held
    against the share of the documents before that it was admitted for, so each word is a
    fold of its own. The rule that a document keeps all words if none is left is not applied.
    """
    rows = words.join(numbered.select("doc_id", "seq"), "doc_id")
    return rows.repartition("word").sortWithinPartitions("word", "seq").mapInPandas(_admit, "doc_id bigint, pos int, word string")


def _admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds the sorted rows of each word; a word may run over several batches, of which one is held."""
    word, held = None, 0
    for rows in batches:
        keep = []
        for w, seq in zip(rows["word"], rows["seq"]):
            if w != word:
                word, held = w, 0
            before = seq - 1
            ok = before < 10 or (held / before <= TOO_COMMON and not (before > 100 and held < LEAST_DOCUMENTS))
            held += ok
            keep.append(ok)
        yield rows.loc[keep, ["doc_id", "pos", "word"]]


def remove_documents(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the documents of ``gone`` (doc_id)."""
    return index.join(gone.select("doc_id"), "doc_id", "left_anti")


def documents_with_word(index: DataFrame, word: str) -> DataFrame:
    """(doc_id) of the documents that hold the word in any case."""
    return index.where(F.col("word") == word.lower()).select("doc_id")


def documents_with_any(index: DataFrame, words: list[str], query: int | None = None, most: int = 100) -> DataFrame:
    """(doc_id): the first ``most`` documents of the words' lists, one list after another, without the query."""
    order = {w: i for i, w in reversed(list(enumerate(words)))}
    if not order:
        return index.select("doc_id").limit(0)
    place = F.create_map(*[F.lit(x) for item in order.items() for x in item])
    found = index.where(F.col("word").isin(list(order)))
    if query is not None:
        found = found.where(F.col("doc_id") != query)
    first = found.groupBy("doc_id").agg(F.min(place[F.col("word")]).alias("place"))
    return first.orderBy("place", "doc_id").limit(most).select("doc_id")


def most_common_words(index: DataFrame, most: int = 50) -> DataFrame:
    """(word, df) of the words with most documents; equal ones by first document and place."""
    stats = index.groupBy("word").agg(F.count("*").alias("df"), F.min(F.struct("doc_id", "pos")).alias("first"))
    return stats.orderBy(F.desc("df"), F.asc("first")).limit(most).select("word", "df")


def sampled_words(index: DataFrame, query: int, count: int, seed: int = 0) -> DataFrame:
    """(word, place): ``count`` words of the query document in a repeatable random order."""
    own = index.where(F.col("doc_id") == query).select("word", seeded(seed, F.lit(query), F.col("word")).alias("h"))
    return own.orderBy("h", "word").limit(count)


def fast_candidates(index: DataFrame, query: int, most: int = 100, count: int = 4, seed: int = 0) -> DataFrame:
    """(doc_id, matches): the documents that share most of the query's sampled words."""
    # at most ``count`` words are broadcast
    sample = F.broadcast(sampled_words(index, query, count, seed).select("word"))
    hits = index.where(F.col("doc_id") != query).join(sample, "word")
    return hits.groupBy("doc_id").agg(F.count("*").alias("matches")).orderBy(F.desc("matches"), "doc_id").limit(most)


def fast_candidates_of_many(index: DataFrame, queries: DataFrame, most: int = 100, count: int = 4, seed: int = 0) -> DataFrame:
    """(query_id, doc_id, matches, rank): ``fast_candidates`` of every document of ``queries`` (doc_id)."""
    own = index.join(queries.select("doc_id").distinct(), "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy(seeded(seed, F.col("doc_id"), F.col("word")), "word")
    sample = own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count).select(F.col("doc_id").alias("query_id"), "word")
    hits = index.join(sample, "word").where(F.col("doc_id") != F.col("query_id"))
    found = hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("matches"))
    best = Window.partitionBy("query_id").orderBy(F.desc("matches"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def index_stats(index: DataFrame, documents: int) -> DataFrame:
    """One row of totals and averages of the word index."""
    totals = index.groupBy("word").agg(F.count("*").alias("df")).agg(
        F.count("*").alias("unique_words"), F.coalesce(F.sum("df"), F.lit(0)).alias("occurrences")
    )
    return totals.select(
        F.lit(documents).cast("bigint").alias("documents"), "unique_words", "occurrences",
        F.round(F.coalesce(F.try_divide("occurrences", F.lit(documents)), F.lit(0.0)), 6).alias("words_per_document"),
        F.round(F.coalesce(F.try_divide("occurrences", "unique_words"), F.lit(0.0)), 6).alias("documents_per_word"),
    )
