"""Queries on text, terms and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.config import COMPAT, LEGACY_COMPAT
from affinity.functions import text as fn
from affinity.functions.hashing import code_units, djb2, fnv1a, hashes, sdbm
from affinity.operators import stats
from affinity.operators.order import running_averages
from affinity.operators.stopwords import adaptive_stopwords, term_frequency, word_rows
from affinity.queries.base import COMPAT_PARTS, LEGACY_COMPAT_PARTS, engine, hash_sql, kept_sql, legacy_engine, sql, stem_sql, token_parts, url_sql
from affinity.sources.corpus import document_corpus, note_corpus
from affinity.sources.tables import table


def _rows(df: DataFrame, tokens: str = "tokens", term: str = "term", key: str = "doc_id") -> DataFrame:
    return df.select(key, F.posexplode_outer(tokens).alias("pos", term))


def title_text(spark: SparkSession, folder: str) -> DataFrame:
    return document_corpus(spark, folder).select("doc_id", "title", F.length("text").alias("n"))


def markdown_notes(spark: SparkSession, folder: str) -> DataFrame:
    return note_corpus(spark, folder).select("doc_id", "path")


def paths(spark: SparkSession, folder: str) -> DataFrame:
    notes = table(spark, folder, "notes").select("path").distinct()
    return notes.select("path", fn.file_name(F.col("path")).alias("file"), fn.normal_path(F.concat(F.lit("/"), F.replace("path", F.lit("/"), F.lit("//")))).alias("normal"))


def tokenize_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(engine(spark, folder).tokens)


def tokenize_notes(spark: SparkSession, folder: str) -> DataFrame:
    notes = table(spark, folder, "notes").select("note_id", "text").distinct()
    return _rows(fn.with_tokens(notes, "text", "tokens"), key="note_id")


def tokenize_urls(spark: SparkSession, folder: str) -> DataFrame:
    notes = table(spark, folder, "notes").select("note_id", F.concat("path", F.lit(" https://host/"), F.replace("path", F.lit(" "), F.lit("+"))).alias("text")).distinct()
    return _rows(fn.with_tokens(notes, "text", "tokens"), key="note_id")


def url_predicate(spark: SparkSession, folder: str) -> DataFrame:
    notes = table(spark, folder, "notes")
    runs = notes.select(F.explode(F.split(F.concat_ws(" ", "path", "extension", "text"), fn.SPACE + "+", -1)).alias("run"))
    return runs.where("run <> ''").distinct().select("run", fn.is_url(F.col("run")).alias("is_url"))


def stem_words(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    words = docs.select(F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\w\s\-_]", " "), r"\s+", -1)).alias("word")).where("word <> ''").distinct()
    return words.select("word", fn.stem(F.col("word")).alias("stem"))


def truncate_text(spark: SparkSession, folder: str) -> DataFrame:
    docs = document_corpus(spark, folder)
    return docs.select("doc_id", fn.kept_length(F.col("text"), 1000).alias("kept_1000"), F.length(fn.truncated(F.col("text"), 300)).alias("kept_300"))


def double_tokenize(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(fn.with_tokens(engine(spark, folder).filtered, "text", "words", compose=False), "words", "word")


def all_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's distinct words and adjacent pairs."""
    return engine(spark, folder).terms.select("doc_id", F.explode_outer("terms").alias("term"))


def bigrams_capped(spark: SparkSession, folder: str) -> DataFrame:
    """The terms under the limits of the original provider, of which the first pairs only are one."""
    return engine(spark, folder, COMPAT).terms.select("doc_id", F.explode_outer("terms").alias("term"))


def legacy_terms(spark: SparkSession, folder: str) -> DataFrame:
    return legacy_engine(spark, folder).terms.select("doc_id", F.explode_outer("terms").alias("term"))


def char_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "eval_items").select("item_id", fn.composed(F.col("text")).alias("text"))
    return items.select("item_id", F.explode(fn.char_ngrams(F.col("text"), 3)).alias("gram")).distinct()


def hash_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = all_terms(spark, folder).select("term").distinct().withColumn("u", code_units(F.col("term")))
    return terms.select("term", fnv1a(F.col("u")).alias("h0"), djb2(F.col("u")).alias("h1"), sdbm(F.col("u")).alias("h2"), hashes(F.col("term"), 4)[3].alias("h3"))


def term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return term_frequency(engine(spark, folder).tokens).select("word", "tf")


def doc_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return term_frequency(engine(spark, folder).tokens).select("word", "df")


def stopwords(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    return adaptive_stopwords(own.tokens, own.documents, own.config)


def stopwords_first(spark: SparkSession, folder: str) -> DataFrame:
    """Stopwords as the original provider learns them, from the first 30 documents."""
    own = engine(spark, folder, COMPAT)
    first = own.corpus.select("doc_id").orderBy("doc_id").limit(30)
    return adaptive_stopwords(own.tokens.join(first, "doc_id", "left_semi"), 30, own.config)


def legacy_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    own = legacy_engine(spark, folder)
    return adaptive_stopwords(own.tokens, own.documents, own.config)


def legacy_stopwords_first(spark: SparkSession, folder: str) -> DataFrame:
    """Stopwords as the older provider learns them, from the first 100 documents."""
    own = legacy_engine(spark, folder, LEGACY_COMPAT)
    first = own.corpus.select("doc_id").orderBy("doc_id").limit(100)
    return adaptive_stopwords(own.tokens.join(first, "doc_id", "left_semi"), 100, own.config)


def filtered_terms(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder).filtered


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    return stats.corpus_stats(own.corpus, own.terms)


def running_corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    docs = document_corpus(spark, folder).select("doc_id", F.length("text").alias("length"))
    return running_averages(docs, "doc_id", ["length"]).select("doc_id", "n", F.round("avg_length", 6).alias("avg_length"))


def recommend_params(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    return stats.recommended_parameters(stats.corpus_stats(own.corpus, own.terms), own.config)


def words_per_document(spark: SparkSession, folder: str) -> DataFrame:
    return word_rows(engine(spark, folder).tokens).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("word").alias("distinct_n"))


QUERIES = {
    "title_text": title_text, "markdown_notes": markdown_notes, "paths": paths, "tokenize_terms": tokenize_terms, "tokenize_notes": tokenize_notes,
    "tokenize_urls": tokenize_urls, "url_predicate": url_predicate, "stem_words": stem_words, "truncate_text": truncate_text,
    "double_tokenize": double_tokenize, "all_terms": all_terms, "bigrams_capped": bigrams_capped, "legacy_terms": legacy_terms, "char_ngrams": char_ngrams,
    "hash_terms": hash_terms, "term_frequency": term_frequencies, "doc_frequency": doc_frequencies, "adaptive_stopwords": stopwords,
    "stopwords_first": stopwords_first, "legacy_stopwords": legacy_stopwords, "legacy_stopwords_first": legacy_stopwords_first, "filtered_terms": filtered_terms, "corpus_stats": corpus_stats,
    "running_corpus_stats": running_corpus_stats, "recommend_params": recommend_params, "words_per_document": words_per_document,
}

_POSITIONS = "SELECT {key}, unnest(range(len(tokens))) AS pos, unnest(tokens) AS {term} FROM {source}"
_COUNTED = "SELECT word, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, lower(unnest(tokens)) AS word FROM toks) WHERE length(word) > 2 GROUP BY word"
_SPACE = fn.SPACE
_STATS = """SELECT count(*) AS documents, round(avg(length), 6) AS avg_length, min(length) AS min_length, max(length) AS max_length,
    round(avg(v), 6) AS avg_vocabulary, min(v) AS min_vocabulary, max(v) AS max_vocabulary
    FROM (SELECT doc_id, length(text) AS length FROM docs) JOIN (SELECT doc_id, count(*) AS v FROM term_rows GROUP BY doc_id) USING (doc_id)"""
_H = hash_sql("term")

SQL = {
    "title_text": sql("SELECT doc_id, title, length(text) AS n FROM docs"),
    "markdown_notes": "SELECT DISTINCT note_id AS doc_id, path FROM notes WHERE lower(extension) = 'md' AND note_id IS NOT NULL",
    "paths": r"SELECT DISTINCT path, string_split(path, '/')[-1] AS file, trim(regexp_replace('/' || path, '[\\/]+', '/', 'g'), '/') AS normal FROM notes",
    "tokenize_terms": sql(_POSITIONS.format(key="doc_id", term="term", source="toks")),
    "tokenize_notes": sql(
        _POSITIONS.format(key="note_id", term="term", source="note_toks"),
        **token_parts("note_toks", "(SELECT DISTINCT note_id, text FROM notes)", "note_id", "text"),
    ),
    "tokenize_urls": sql(
        _POSITIONS.format(key="note_id", term="term", source="url_toks"),
        **token_parts("url_toks", "(SELECT DISTINCT note_id, path || ' https://host/' || replace(path, ' ', '+') AS text FROM notes)", "note_id", "text"),
    ),
    "url_predicate": f"""SELECT run, {url_sql('run')} AS is_url FROM (
        SELECT DISTINCT unnest(string_split_regex(concat_ws(' ', path, extension, text), '{_SPACE}+')) AS run FROM notes) WHERE run <> ''""",
    "stem_words": rf"""SELECT word, {stem_sql('word')} AS stem FROM (
        SELECT DISTINCT unnest(string_split_regex(regexp_replace(lower(text), '[^\w\s\-_]', ' ', 'g'), '\s+')) AS word FROM documents) WHERE word <> ''""",
    "truncate_text": sql(f"SELECT doc_id, {kept_sql('text', '1000')} AS kept_1000, {kept_sql('text', '300')} AS kept_300 FROM docs"),
    "double_tokenize": sql(_POSITIONS.format(key="doc_id", term="word", source="words")),
    "all_terms": sql("SELECT doc_id, term FROM term_rows"),
    "bigrams_capped": sql("SELECT doc_id, term FROM term_rows", **COMPAT_PARTS),
    "legacy_terms": sql("SELECT doc_id, term FROM old_rows"),
    "char_ngrams": f"""SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: t[i:i + 2])) AS gram
        FROM (SELECT item_id, regexp_replace(lower(nfc_normalize(text)), '{_SPACE}+', ' ', 'g') AS t FROM eval_items) WHERE length(t) >= 3""",
    "hash_terms": sql(f"SELECT term, h0, h1, h2, (h0 + 3 * h1) & 4294967295 AS h3 FROM (SELECT term, {_H[0]} AS h0, {_H[1]} AS h1, {_H[2]} AS h2 FROM (SELECT DISTINCT term FROM term_rows))"),
    "term_frequency": sql(f"SELECT word, tf FROM ({_COUNTED})"),
    "doc_frequency": sql(f"SELECT word, df FROM ({_COUNTED})"),
    "adaptive_stopwords": sql("SELECT word, df, coverage, rank FROM stop"),
    "stopwords_first": sql("SELECT word, df, coverage, rank FROM stop", **COMPAT_PARTS),
    "legacy_stopwords": sql("SELECT word, df, coverage, rank FROM old_stop"),
    "legacy_stopwords_first": sql("SELECT word, df, coverage, rank FROM old_stop", **LEGACY_COMPAT_PARTS),
    "filtered_terms": sql("SELECT doc_id, text FROM filtered"),
    "corpus_stats": sql(_STATS),
    "running_corpus_stats": sql("SELECT doc_id, count(*) OVER w AS n, round(avg(length(text)) OVER w, 6) AS avg_length FROM docs WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)"),
    "recommend_params": sql(f"""SELECT 3 AS ngram, m AS bits, greatest(1, floor(m::DOUBLE / ceil(avg_vocabulary * 2.25) * ln(2) + 0.5))::BIGINT AS hashes, 0.15::DOUBLE AS similarity_threshold FROM ({_STATS}), (SELECT CASE WHEN count(*) > 5000 THEN 4096 ELSE 8192 END AS m FROM docs)"""),
    "words_per_document": sql("SELECT doc_id, count(*) AS n, count(DISTINCT word) AS distinct_n FROM (SELECT doc_id, lower(unnest(tokens)) AS word FROM toks) WHERE length(word) > 2 GROUP BY doc_id"),
}
