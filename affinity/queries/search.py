"""Queries on filters, scores, the word index and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.config import COMPAT, DEFAULT
from affinity.functions import bloom
from affinity.functions.hashing import hashes
from affinity.operators import candidates as pick
from affinity.operators import postings, similarity, stats
from affinity.operators.bitmap import bit_words, build_filters, term_bits
from affinity.operators.order import with_sequence
from affinity.operators.terms import document_terms, preprocessed, tokenized
from affinity.plans.related import RelatedEngine
from affinity.queries.base import COMPAT_PARTS, NOW, QUERY, engine, filter_parts, hash_sql, legacy_engine, score_sql, seeded_sql, sql, token_parts
from affinity.session import cut
from affinity.sources.tables import table

PROBES = ["review", "budget sheet", "archive", "nothingatall"]
LOOKUPS = ["glossary", "zettel", "schedule", "archive"]
CANDIDATES = 100


def bloom_bits(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    return term_bits(own.terms, own.bits, 3)


def bloom_words(spark: SparkSession, folder: str) -> DataFrame:
    return bit_words(bloom_bits(spark, folder))


def bloom_popcount(spark: SparkSession, folder: str) -> DataFrame:
    filters = engine(spark, folder).filters
    entries = bloom.cardinality(F.col("popcount"), F.col("m"), F.col("k"))
    return filters.select("doc_id", bloom.popcount(F.col("words")).alias("popcount"), F.round(entries, 6).alias("entries"), bloom.memory_bytes(F.col("m")).alias("memory"))


def bloom_contains(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    probes = spark.createDataFrame([(t,) for t in PROBES], "term string")
    probes = probes.select("term", F.transform(hashes(F.col("term"), 3), lambda h: h % own.bits).alias("bits"))
    hit = bloom.contains(F.col("words"), F.col("bits"))
    return own.filters.select("doc_id", "words").join(F.broadcast(probes)).select("doc_id", "term", hit.alias("hit"))


def bloom_fpr(spark: SparkSession, folder: str) -> DataFrame:
    return stats.filter_stats(engine(spark, folder).filters)


def optimal_params(spark: SparkSession, folder: str) -> DataFrame:
    sizes = engine(spark, folder).terms.select("doc_id", F.size("terms").alias("n"))
    bits = bloom.optimal_size(F.col("n"))
    return sizes.select("doc_id", bits.alias("bits"), bloom.optimal_hashes(bits, F.col("n")).alias("hashes"))


def intersection_count(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.intersections(engine(spark, folder).filters, QUERY)


def pair_similarity(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    pairs = own.corpus.select(F.col("doc_id").alias("id_a"), (F.col("doc_id") + 1).alias("id_b"))
    both = pairs.unionByName(pairs.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    return own.scores(both)


def similar_to_one(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: the documents most related to one."""
    return similarity.similar_to_one(engine(spark, folder).filters, QUERY, 10)


def similar_compat(spark: SparkSession, folder: str) -> DataFrame:
    """The same under the limits of the original provider."""
    return similarity.similar_to_one(engine(spark, folder, COMPAT).filters, QUERY, 10)


def scores_to_one(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.scores_to_one(engine(spark, folder).filters, QUERY)


def _hundredths(own: RelatedEngine) -> DataFrame:
    return own.corpus.select("doc_id").where(F.col("doc_id") % 100 == 0)


def similar_many(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    return own.related_to_all(_hundredths(own))


def all_pairs_topk(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    return own.related_to_all(_hundredths(own), 20)


def legacy_similar(spark: SparkSession, folder: str) -> DataFrame:
    own = legacy_engine(spark, folder)
    return similarity.similar_to_one(own.filters, QUERY, 10, threshold=own.config.similarity_threshold)


def items_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """For each evaluation item, the three documents most like it."""
    own = engine(spark, folder)
    items = table(spark, folder, "eval_items").select((-F.col("item_id")).alias("doc_id"), F.col("text").alias("text")).distinct()
    asked = build_filters(document_terms(preprocessed(tokenized(items), own.config)), own.bits, own.config.hashes)
    found = similarity.similar_to_many(own.filters, cut(asked), 3)
    return found.select((-F.col("query_id")).alias("item_id"), "doc_id", "similarity", F.col("rank").alias("place"))


def exact_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.exact_jaccard(engine(spark, folder).terms, QUERY)


def exact_many(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of greatest true overlap for every hundredth document."""
    terms = cut(engine(spark, folder).terms)
    return similarity.exact_to_many(terms, terms.where(F.col("doc_id") % 100 == 0))


def legacy_many(spark: SparkSession, folder: str) -> DataFrame:
    own = legacy_engine(spark, folder)
    return own.related_to_all(_hundredths(own), 10)


def candidates_many(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that share most of the sampled words of every hundredth document."""
    own = engine(spark, folder)
    return postings.fast_candidates_of_many(own.words, _hundredths(own))


def estimate_error(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    both = similarity.scores_to_one(own.filters, QUERY).join(similarity.exact_jaccard(own.terms, QUERY), "doc_id")
    return both.select("doc_id", F.round(F.abs(F.col("similarity") - F.col("jaccard")), 6).alias("error"))


def common_terms(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    pairs = own.corpus.select(F.col("doc_id").alias("id_a"), (F.col("doc_id") + 1).alias("id_b"))
    found = similarity.common_terms(own.terms, pairs)
    return found.select("id_a", "id_b", F.array_join("terms", "|").alias("terms"))


def word_index(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder).words.select("doc_id", "word")


def word_index_sequential(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    numbered = with_sequence(own.corpus.select("doc_id"), "doc_id")
    return postings.sequential_word_index(postings.document_words(own.tokens), numbered)


def docs_with_word(spark: SparkSession, folder: str) -> DataFrame:
    return postings.documents_with_word(engine(spark, folder).words, "Glossary")


def docs_with_any_word(spark: SparkSession, folder: str) -> DataFrame:
    return postings.documents_with_any(engine(spark, folder).words, LOOKUPS, QUERY)


def most_common_words(spark: SparkSession, folder: str) -> DataFrame:
    return postings.most_common_words(engine(spark, folder).words)


def indexed_documents(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    known = own.words.select("doc_id").distinct().withColumn("indexed", F.lit(True))
    return own.corpus.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("indexed", F.lit(False)).alias("indexed"))


def sampled_words(spark: SparkSession, folder: str) -> DataFrame:
    return postings.sampled_words(engine(spark, folder).words, QUERY, 8).select("word")


def fast_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return postings.fast_candidates(engine(spark, folder).words, QUERY)


def recent_candidates(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    return pick.recent_candidates(own.corpus, own.filters, QUERY, CANDIDATES, NOW)


def bitmap_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return pick.bitmap_candidates(engine(spark, folder).filters, QUERY, CANDIDATES)


def smart_candidates_word(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    return pick.smart_candidates_by_word(own.words, own.corpus, own.filters, QUERY, CANDIDATES, NOW)


def smart_candidates_bitmap(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    return pick.smart_candidates_by_bitmap(own.corpus, own.filters, QUERY, CANDIDATES, NOW)


def sampled_documents(spark: SparkSession, folder: str) -> DataFrame:
    return pick.sampled_documents(engine(spark, folder).corpus, 50)


def related_documents(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder).related(QUERY)


def word_index_stats(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    return postings.index_stats(own.words, own.documents)


def provider_stats(spark: SparkSession, folder: str) -> DataFrame:
    return engine(spark, folder).stats()


def legacy_stats(spark: SparkSession, folder: str) -> DataFrame:
    own = legacy_engine(spark, folder)
    return stats.legacy_stats(own.terms, own.bits)


QUERIES = {
    f.__name__: f
    for f in (
        similar_to_one, similar_compat, scores_to_one, similar_many, all_pairs_topk, legacy_similar, items_overlap, pair_similarity, intersection_count, exact_jaccard, exact_many, legacy_many, candidates_many,
        estimate_error, common_terms, bloom_bits, bloom_words, bloom_popcount, bloom_contains, bloom_fpr, optimal_params, word_index,
        word_index_sequential, docs_with_word, docs_with_any_word, most_common_words, indexed_documents, sampled_words, fast_candidates,
        recent_candidates, bitmap_candidates, smart_candidates_word, smart_candidates_bitmap, sampled_documents, related_documents,
        word_index_stats, provider_stats, legacy_stats,
    )
}

_MANY = f"""SELECT query_id, doc_id, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM (
        SELECT p.query_id, p.doc_id, {score_sql('a.n', 'b.n', 'p.c', 'm', '3')} AS similarity
        FROM (SELECT a.doc_id AS query_id, b.doc_id, count(*) AS c FROM bits a JOIN bits b ON a.bit = b.bit AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0 GROUP BY ALL) p
        JOIN pops a ON a.doc_id = p.query_id JOIN pops b ON b.doc_id = p.doc_id, conf
    ) WHERE similarity > 0) WHERE rank <= {{most}}"""
_NEXT = f"""SELECT x.doc_id AS id_a, x.doc_id + 1 AS id_b, coalesce({score_sql('a.n', 'b.n', 'coalesce(p.c, 0)', 'm', '3')}, 0) AS similarity
    FROM docs x LEFT JOIN pops a ON a.doc_id = x.doc_id LEFT JOIN pops b ON b.doc_id = x.doc_id + 1
    LEFT JOIN (SELECT a.doc_id AS id_a, count(*) AS c FROM bits a JOIN bits b ON a.bit = b.bit AND b.doc_id = a.doc_id + 1 GROUP BY 1) p ON p.id_a = x.doc_id, conf"""
_JACCARD = f"""SELECT doc_id, round(c / (n + (SELECT count(*) FROM term_rows WHERE doc_id = {QUERY}) - c), 6) AS jaccard FROM (
    SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE term IN (SELECT term FROM term_rows WHERE doc_id = {QUERY})) AS c
    FROM term_rows WHERE doc_id <> {QUERY} GROUP BY doc_id)"""
_WORD = "CASE WHEN bit % 64 = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (bit % 64) END"
_H = hash_sql("term")
_ITEMS = token_parts("item_toks", "eval_items", "item_id", "text") | {
    "item_kept": r"""SELECT DISTINCT -item_id AS doc_id, array_to_string(list_filter(list_transform(tokens, lambda w: lower(w)), lambda w: length(w) > 2), ' ') AS text FROM item_toks"""
} | token_parts("item_words", "item_kept", "doc_id", "text") | {
    "item_rows": """SELECT DISTINCT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
        FROM (SELECT doc_id, tokens AS w FROM item_words)"""
} | filter_parts("item_", "item_rows", "m")
_RECENT = f"""SELECT doc_id FROM (SELECT doc_id FROM docs WHERE mtime > TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}' - INTERVAL 30 DAYS ORDER BY doc_id LIMIT 20)
    WHERE doc_id <> {QUERY} AND doc_id IN (SELECT doc_id FROM pops)"""
_SAMPLE = f"SELECT word, {seeded_sql(str(QUERY), 'word')} AS h FROM windex WHERE doc_id = {QUERY} ORDER BY h, word LIMIT {{count}}"
_FAST = f"""SELECT doc_id, count(*) AS matches FROM windex WHERE doc_id <> {QUERY} AND word IN (SELECT word FROM sample) GROUP BY doc_id
    ORDER BY matches DESC, doc_id LIMIT {{most}}"""
_NEAR = "SELECT doc_id, c AS common_bits FROM overlap ORDER BY c DESC, doc_id LIMIT 70"
_TURN = """SELECT doc_id, branch FROM (SELECT doc_id, branch, place, row_number() OVER (PARTITION BY doc_id ORDER BY branch, place) AS k FROM branches)
    WHERE k = 1 ORDER BY branch, place, doc_id LIMIT 100"""

SQL = {
    "similar_to_one": sql("SELECT doc_id, similarity FROM scores WHERE similarity > 0 ORDER BY similarity DESC, doc_id LIMIT 10"),
    "similar_compat": sql("SELECT doc_id, similarity FROM scores WHERE similarity > 0 ORDER BY similarity DESC, doc_id LIMIT 10", **COMPAT_PARTS),
    "scores_to_one": sql("SELECT doc_id, similarity FROM scores"),
    "similar_many": sql(_MANY.format(most=5)),
    "all_pairs_topk": sql(_MANY.format(most=20)),
    "legacy_similar": sql(
        f"""SELECT p.doc_id, {score_sql('q.n', 'p.n', 'coalesce(o.c, 0)', '256', '3')} AS similarity
        FROM old_pops p JOIN old_pops q ON q.doc_id = {QUERY} AND p.doc_id <> {QUERY} LEFT JOIN old_overlap o ON o.doc_id = p.doc_id
        WHERE similarity >= 0.1 ORDER BY similarity DESC, p.doc_id LIMIT 10""",
        old_overlap=f"SELECT b.doc_id, count(*) AS c FROM old_bits a JOIN old_bits b ON a.bit = b.bit AND b.doc_id <> a.doc_id WHERE a.doc_id = {QUERY} GROUP BY b.doc_id",
    ),
    "items_overlap": sql(
        f"""SELECT -query_id AS item_id, doc_id, similarity, place FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS place FROM (
                SELECT p.query_id, p.doc_id, {score_sql('a.n', 'b.n', 'p.c', 'm', '3')} AS similarity
                FROM (SELECT a.doc_id AS query_id, b.doc_id, count(*) AS c FROM item_bits a JOIN bits b ON a.bit = b.bit GROUP BY ALL) p
                JOIN item_pops a ON a.doc_id = p.query_id JOIN pops b ON b.doc_id = p.doc_id, conf
            ) WHERE similarity > 0) WHERE place <= 3""",
        **_ITEMS,
    ),
    "pair_similarity": sql(_NEXT),
    "intersection_count": sql(f"SELECT p.doc_id, coalesce(o.c, 0) AS common_bits FROM pops p LEFT JOIN overlap o ON o.doc_id = p.doc_id WHERE p.doc_id <> {QUERY}"),
    "exact_jaccard": sql(_JACCARD),
    "exact_many": sql("""SELECT query_id, doc_id, jaccard, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, doc_id) AS rank FROM (
            SELECT query_id, doc_id, round(c / (q.n + d.n - c), 6) AS jaccard
            FROM (SELECT a.doc_id AS query_id, b.doc_id, count(*) AS c FROM term_rows a JOIN term_rows b ON a.term = b.term AND a.doc_id <> b.doc_id
                WHERE a.doc_id % 100 = 0 GROUP BY ALL) JOIN held q ON q.id = query_id JOIN held d ON d.id = doc_id
        )) WHERE rank <= 10""", held="SELECT doc_id AS id, count(*) AS n FROM term_rows GROUP BY doc_id"),
    "legacy_many": sql(_MANY.format(most=10).replace("FROM bits", "FROM old_bits").replace("JOIN bits", "JOIN old_bits").replace("pops", "old_pops").replace("'m'", "256")
        .replace(", conf", ", (SELECT 256 AS m)")),
    "candidates_many": sql("""SELECT query_id, doc_id, matches, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, doc_id) AS rank FROM (
            SELECT s.query_id, w.doc_id, count(*) AS matches FROM samples s JOIN windex w ON w.word = s.word AND w.doc_id <> s.query_id GROUP BY ALL
        )) WHERE rank <= 100""",
        samples=f"SELECT query_id, word FROM (SELECT doc_id AS query_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY {seeded_sql('doc_id', 'word')}, word) AS n FROM windex WHERE doc_id % 100 = 0) WHERE n <= 4"),
    "estimate_error": sql(f"SELECT doc_id, round(abs(similarity - jaccard), 6) AS error FROM scores JOIN ({_JACCARD}) USING (doc_id)"),
    "common_terms": sql("""SELECT id_a, id_b, array_to_string(list_sort_terms[1:10], '|') AS terms FROM (
        SELECT a.doc_id AS id_a, b.doc_id AS id_b, coalesce(list(a.term ORDER BY a.place) FILTER (WHERE t.term IS NOT NULL), []) AS list_sort_terms
        FROM placed a JOIN (SELECT doc_id FROM docs) b ON b.doc_id = a.doc_id + 1 LEFT JOIN term_rows t ON t.doc_id = b.doc_id AND t.term = a.term
        GROUP BY a.doc_id, b.doc_id)""",
        placed="""SELECT doc_id, term, min(place) AS place FROM (
            SELECT doc_id, unnest(list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))) AS term,
                unnest(range(2 * len(tokens) - 1)) AS place FROM words) JOIN term_rows USING (doc_id, term) GROUP BY doc_id, term""",
    ),
    "bloom_bits": sql("SELECT doc_id, bit FROM bits"),
    "bloom_words": sql(f"SELECT doc_id, bit // 64 AS word_idx, bit_or({_WORD}) AS word FROM bits GROUP BY doc_id, bit // 64"),
    "bloom_popcount": sql("SELECT doc_id, p.n AS popcount, round(-(m / 3.0::DOUBLE) * ln(1 - p.n / m::DOUBLE), 6) AS entries, m / 8::DOUBLE AS memory FROM pops p, conf"),
    "bloom_contains": sql(f"""SELECT doc_id, term, count(b.bit) = count(*) AS hit FROM (SELECT p.doc_id, term, q.bit FROM pops p, probes q) LEFT JOIN bits b USING (doc_id, bit) GROUP BY doc_id, term""",
        probes=f"SELECT DISTINCT term, unnest([{_H[0]} % m, {_H[1]} % m, {_H[2]} % m]) AS bit FROM (SELECT unnest([{', '.join(repr(p) for p in PROBES)}]) AS term), conf",
    ),
    "bloom_fpr": sql("SELECT doc_id, m AS bits, 3 AS hashes, n_items, m / 8::DOUBLE AS memory_bytes, round(pow(1 - exp(-3 * n_items / m::DOUBLE), 3), 6) AS saturation FROM (SELECT doc_id, count(*) AS n_items FROM term_rows GROUP BY doc_id), conf"),
    "optimal_params": sql("""SELECT doc_id, bits, greatest(1, floor(bits::DOUBLE / n * ln(2) + 0.5))::BIGINT AS hashes FROM (
        SELECT doc_id, count(*) AS n, (ceil(ceil(count(*) * (-ln(0.01) / pow(ln(2), 2))) / 32) * 32)::BIGINT AS bits FROM term_rows GROUP BY doc_id)"""),
    "word_index": sql("SELECT doc_id, word FROM windex"),
    "docs_with_word": sql("SELECT doc_id FROM windex WHERE word = 'glossary'"),
    "docs_with_any_word": sql(f"""SELECT doc_id FROM windex WHERE list_contains({LOOKUPS!r}, word) AND doc_id <> {QUERY} GROUP BY doc_id
        ORDER BY min(list_position({LOOKUPS!r}, word)), doc_id LIMIT 100"""),
    "most_common_words": sql("""SELECT word, df FROM (SELECT word, count(*) AS df, min(doc_id) AS d, arg_min(pos, doc_id) AS p FROM windex GROUP BY word)
        ORDER BY df DESC, d, p LIMIT 50"""),
    "indexed_documents": sql("SELECT doc_id, doc_id IN (SELECT doc_id FROM windex) AS indexed FROM docs"),
    "sampled_words": sql(f"SELECT word FROM ({_SAMPLE.format(count=8)})"),
    "fast_candidates": sql(_FAST.format(most=100), sample=_SAMPLE.format(count=4)),
    "recent_candidates": sql(_RECENT),
    "bitmap_candidates": sql(_NEAR),
    "smart_candidates_word": sql(
        _TURN,
        sample=_SAMPLE.format(count=3),
        fast=_FAST.format(most=80),
        recent=_RECENT,
        branches="""SELECT doc_id, 0 AS branch, row_number() OVER (ORDER BY matches DESC, doc_id) AS place FROM fast
            UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY doc_id) FROM recent""",
    ),
    "smart_candidates_bitmap": sql(
        _TURN,
        near=_NEAR,
        recent=_RECENT,
        drawn=f"""SELECT doc_id, {seeded_sql(str(QUERY), 'doc_id')} AS h FROM pops
            WHERE doc_id <> {QUERY} AND doc_id NOT IN (SELECT doc_id FROM near) AND doc_id NOT IN (SELECT doc_id FROM recent) ORDER BY h, doc_id LIMIT 10""",
        branches="""SELECT doc_id, 0 AS branch, row_number() OVER (ORDER BY common_bits DESC, doc_id) AS place FROM near
            UNION ALL SELECT doc_id, 1, row_number() OVER (ORDER BY doc_id) FROM recent
            UNION ALL SELECT doc_id, 2, row_number() OVER (ORDER BY h, doc_id) FROM drawn""",
    ),
    "sampled_documents": sql(f"SELECT doc_id FROM (SELECT doc_id, {seeded_sql('doc_id')} AS h FROM docs ORDER BY h, doc_id LIMIT 50)"),
    "related_documents": sql("SELECT doc_id, path, similarity FROM (SELECT doc_id, similarity FROM scores WHERE similarity > 0 ORDER BY similarity DESC, doc_id LIMIT 5) JOIN docs USING (doc_id)"),
    "word_index_stats": sql("""SELECT n AS documents, count(*) AS unique_words, sum(df)::BIGINT AS occurrences, round(sum(df) / n, 6) AS words_per_document, round(sum(df) / count(*), 6) AS documents_per_word
        FROM (SELECT word, count(*) AS df FROM windex GROUP BY word), conf GROUP BY n"""),
    "provider_stats": sql(f"""SELECT (SELECT count(*) FROM pops) AS documents, m AS bits, 3 AS hashes, (SELECT count(*) FROM stop) AS stopwords,
        {DEFAULT.common_words_threshold}::DOUBLE AS stopword_threshold, {DEFAULT.max_stopwords}::BIGINT AS max_stopwords, (SELECT count(*) FROM pops) * m / 8::DOUBLE AS memory_bytes FROM conf"""),
    "legacy_stats": sql("""SELECT documents, total_terms, round(total_terms / documents, 6) AS avg_terms, documents * 256 / 8::DOUBLE AS memory_bytes,
        documents * 256 / 8::DOUBLE / 1024 AS memory_kb, documents * 256 / 8::DOUBLE / 1024 / 1024 AS memory_mb
        FROM (SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM old_rows) AS total_terms)"""),
}
