"""One-row summaries of an index and recommended parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.config import EngineConfig
from affinity.functions.bloom import DECIMALS, false_positive_rate, optimal_hashes


def filter_stats(filters: DataFrame) -> DataFrame:
    """(doc_id, bits, hashes, n_items, memory_bytes, saturation) of each filter; saturation is the false-positive rate."""
    rate = false_positive_rate(F.col("n_items"), F.col("m"), F.col("k"))
    return filters.select(
        "doc_id", F.col("m").alias("bits"), F.col("k").alias("hashes"), "n_items", (F.col("m") / 8).alias("memory_bytes"),
        F.round(rate, DECIMALS).alias("saturation"),
    )


def corpus_stats(corpus: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: documents and the average, least and greatest length and vocabulary."""
    both = corpus.select("doc_id", F.length("text").alias("length")).join(terms.select("doc_id", F.size("terms").alias("vocabulary")), "doc_id")
    return both.agg(
        F.count("*").alias("documents"),
        F.round(F.avg("length"), DECIMALS).alias("avg_length"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
        F.round(F.avg("vocabulary"), DECIMALS).alias("avg_vocabulary"), F.min("vocabulary").alias("min_vocabulary"), F.max("vocabulary").alias("max_vocabulary"),
    )


def provider_stats(filters: DataFrame, stopwords: int, config: EngineConfig) -> DataFrame:
    """One row: parameters, counts and memory of the index."""
    return filters.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.max("m"), F.lit(0)).alias("bits"),
        F.coalesce(F.max("k"), F.lit(0)).alias("hashes"),
        F.lit(stopwords).cast("bigint").alias("stopwords"),
        F.lit(config.common_words_threshold).alias("stopword_threshold"),
        F.lit(config.max_stopwords).cast("bigint").alias("max_stopwords"),
        F.coalesce(F.sum(F.col("m") / 8), F.lit(0.0)).alias("memory_bytes"),
    )


def legacy_stats(terms: DataFrame, bits: int) -> DataFrame:
    """One row: documents, terms in all and on average, and memory."""
    return terms.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("total_terms"),
        F.round(F.coalesce(F.avg(F.size("terms")), F.lit(0.0)), DECIMALS).alias("avg_terms"),
        (F.count("*") * bits / 8).alias("memory_bytes"),
        (F.count("*") * bits / 8 / 1024).alias("memory_kb"),
        (F.count("*") * bits / 8 / 1024 / 1024).alias("memory_mb"),
    )


def recommended_parameters(stats: DataFrame, config: EngineConfig, ngram: int = 3) -> DataFrame:
    """One row of parameters for a corpus with ``stats`` (documents, avg_vocabulary)."""
    bits = F.when(F.col("documents") > config.large_corpus, 4096).otherwise(8192)
    items = F.ceil(F.col("avg_vocabulary") * 1.5 ** (ngram - 1))
    return stats.select(
        F.lit(ngram).alias("ngram"), bits.alias("bits"), optimal_hashes(bits, items).alias("hashes"), F.lit(0.15).alias("similarity_threshold")
    )


def debug_info(stats: DataFrame, settings: EngineConfig) -> DataFrame:
    """One row with a JSON text of the settings and ``stats``; it has no content of documents."""
    own = F.struct(*[F.lit(v).alias(n) for n, v in sorted(vars(settings).items()) if v is not None])
    return stats.select(F.to_json(F.struct(own.alias("settings"), F.struct(*stats.columns).alias("index"))).alias("json"))
