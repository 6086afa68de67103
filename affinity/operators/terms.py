"""From texts to the terms that enter filters and the word index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.config import EngineConfig
from affinity.functions.text import CJK, all_terms, meaningful, term_array, truncated, with_tokens, word_pairs


def bounded(corpus: DataFrame, config: EngineConfig, limit: int | None) -> DataFrame:
    """The corpus, without texts that are too large and cut to ``limit`` characters if these are given; a null text is empty."""
    rows = corpus.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows if config.max_text is None else rows.where(F.length("text") <= config.max_text)
    return rows if limit is None else rows.withColumn("text", truncated(F.col("text"), limit))


def tokenized(corpus: DataFrame) -> DataFrame:
    """(doc_id, tokens)."""
    return with_tokens(corpus, "text", "tokens").select("doc_id", "tokens")


def preprocessed(tokens: DataFrame, config: EngineConfig, common: list[str] | None = None, since: int | None = None) -> DataFrame:
    """(doc_id, text): the tokens that count, joined again.

    ``common`` words are left out of the documents from ``since`` on, or of all without it.
    """
    keep_cjk = not config.compat_cjk
    plain = meaningful(F.col("tokens"), config.min_word_length, None, keep_cjk)
    if common:
        without = meaningful(F.col("tokens"), config.min_word_length, common, keep_cjk)
        plain = without if since is None else F.when(F.col("doc_id") >= since, without).otherwise(plain)
    return tokens.select("doc_id", F.array_join(plain, " ").alias("text"))


def document_terms(texts: DataFrame, capped: bool = False) -> DataFrame:
    """(doc_id, terms) of preprocessed ``texts``, which are tokenized once more: the words and all adjacent pairs, or the first ones."""
    words = with_tokens(texts, "text", "words", compose=False)
    terms = term_array(F.col("words"), F.col("text").rlike(CJK)) if capped else all_terms(F.col("words"))
    return words.select("doc_id", terms.alias("terms"))


def legacy_terms(tokens: DataFrame, config: EngineConfig, common: list[str] | None = None, since: int | None = None) -> DataFrame:
    """(doc_id, terms) of the older provider: the words of one tokenization that count and their first 300 pairs."""
    texts = preprocessed(tokens, config, common, since)
    words = F.filter(F.split("text", " ", -1), lambda w: w != "")
    return texts.select("doc_id", F.array_distinct(F.concat(words, word_pairs(words, 300))).alias("terms"))
