"""Words so common in a corpus that they say nothing about a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinity.config import EngineConfig


def word_rows(tokens: DataFrame, min_length: int = 2) -> DataFrame:
    """(doc_id, pos, word): every lower-case token longer than ``min_length``."""
    rows = tokens.select("doc_id", F.posexplode_outer(F.transform("tokens", F.lower)).alias("pos", "word"))
    return rows.where(F.length("word") > min_length)


def term_frequency(tokens: DataFrame, min_length: int = 2) -> DataFrame:
    """(word, tf, df): occurrences and documents of each word. Counted per document first."""
    per_doc = word_rows(tokens, min_length).groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("word").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def first_documents(corpus: DataFrame, count: int) -> DataFrame:
    """The first ``count`` documents by id."""
    return corpus.orderBy("doc_id").limit(count)


def adaptive_stopwords(tokens: DataFrame, documents: int, config: EngineConfig) -> DataFrame:
    """(word, df, coverage, rank): the words in at least the threshold's share of ``documents``, and in any
    case the ``max_stopwords`` most common ones, of those in at least ``stopword_min_df`` documents.

    Equal coverages rank by where the word comes first. The ranking is over one row a word and
    is cut to what can be taken, so no task orders the whole vocabulary.
    """
    rows = word_rows(tokens, config.min_word_length)
    per_doc = rows.groupBy("word", "doc_id").agg(F.min("pos").alias("pos"))
    stats = per_doc.groupBy("word").agg(F.count("*").alias("df"), F.min(F.struct("doc_id", "pos")).alias("first"))
    stats = stats.where(F.col("df") >= config.stopword_min_df).withColumn("coverage", F.col("df") / F.lit(documents))
    share = F.col("coverage") >= config.common_words_threshold
    order = [F.desc("df"), F.asc("first")]
    # Texts are bounded, so the words above the threshold are few; of the others only the first can be taken.
    taken = stats.where(share).unionByName(stats.where(~share).orderBy(*order).limit(config.max_stopwords))
    ranked = taken.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.where((F.col("coverage") >= config.common_words_threshold) | (F.col("rank") <= config.max_stopwords)).select(
        "word", "df", "coverage", "rank"
    )


def learned_stopwords(tokens: DataFrame, corpus: DataFrame, documents: int, config: EngineConfig) -> tuple[list[str], int | None]:
    """The common words and the id from which documents are filtered by them.

    In the mode ``first`` the statistics come from the first documents, and the last of these is the
    first that is filtered; a smaller corpus is not filtered at all. In the mode ``corpus``
    they come from all documents, and all are filtered.
    """
    if not config.adaptive_stopwords:
        return [], None
    if config.stopword_mode == "corpus":
        return [r.word for r in adaptive_stopwords(tokens, documents, config).collect()], None
    count = config.stopword_documents
    if documents < count:
        return [], None
    first = [r.doc_id for r in first_documents(corpus.select("doc_id"), count).collect()]
    own = tokens.where(F.col("doc_id").isin(first))
    return [r.word for r in adaptive_stopwords(own, count, config).collect()], first[-1]
