"""The queries of this subpackage over the table folders, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.llm.language import held_languages, label_code, labelled_sample, languages, train
from affinity.llm.leakage import PASSAGE, leaked_items
from affinity.llm.lookalikes import SHAPES, consistent_text, look_alike_pairs
from affinity.llm.markup import clean_text
from affinity.llm.mixture import Mixture
from affinity.llm.set_join import folded, similar_pairs
from affinity.llm.term_counts import marked_terms, term_counts
from affinity.llm.top_n import best_scores, top_n_without
from affinity.session import spread
from affinity.sources.tables import table

#: Vault settings are broadcast up to this number of rows.
SETTINGS_LIMIT = 100_000


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "notes").select("note_id", "basename", "text"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "source", "lang", "text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """All strongly overlapping pairs of cached term lists and of cached signatures."""
    vectors = similar_pairs(
        table(spark, folder, "file_vectors"), "vec_id", "terms", 0.6, min_values=5, normalize=folded
    )
    signatures = similar_pairs(table(spark, folder, "signatures"), "sig_id", "signature", 0.5, min_values=5)
    return vectors.select(F.lit("fileVectors").alias("field"), "id_a", "id_b").unionByName(
        signatures.select(F.lit("signatures").alias("field"), "id_a", "id_b")
    )


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every note's text without markup, with the kinds of markup it held."""
    notes = clean_text(_notes(spark, folder), "note_id", "text", "basename").distinct()
    return notes.select(F.col("id").alias("note_id"), "text", F.array_join("kinds", ",").alias("kinds"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The notes whose text holds markup, by family."""
    notes = clean_text(_notes(spark, folder), "note_id", "text", "basename")
    return notes.select(F.col("id").alias("note_id"), F.explode("kinds").alias("markup")).distinct()


def p3_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """Every note's text in the consistent form."""
    notes = consistent_text(_notes(spark, folder), "note_id", "text")
    return notes.select(F.col("id").alias("note_id"), "text").distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of notes whose texts differ as strings and look the same."""
    pairs = look_alike_pairs(_notes(spark, folder), "note_id", "text")
    return pairs.select(F.col("id_a").alias("note_a"), F.col("id_b").alias("note_b"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The best files of every query note, as many as its vault allows."""
    settings = table(spark, folder, "vault_settings").groupBy("vault").agg(F.max("max_suggestions").alias("n"))
    sizes = settings.agg(
        F.count("*").alias("rows"), F.max("n").alias("most"), F.max(F.when(F.col("vault") == "*", F.col("n"))).alias("usual")
    ).first()
    settings = settings.where(F.col("vault").isNotNull())
    if sizes["rows"] <= SETTINGS_LIMIT:
        settings = F.broadcast(settings)
    limit = F.coalesce(F.col("n"), F.lit(sizes["usual"]), F.lit(0))
    scored = table(spark, folder, "related_notes").join(settings, "vault", "left")
    best = best_scores(scored, "query_id", "file", "similarity", keep={"limit": limit})
    own = table(spark, folder, "notes").select(F.col("note_id").alias("group"), F.col("path").alias("item"))
    top = top_n_without(best, max(sizes["most"] or 0, 0), own, limit="limit")
    return top.select(F.col("group").alias("query_id"), F.col("item").alias("file"))


def p6_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    vectors = table(spark, folder, "file_vectors")
    common = table(spark, folder, "vault_settings").where(F.col("vault") == "*").agg(F.max("common_words_threshold")).first()[0]
    records = vectors.agg(F.countDistinct("vec_id")).first()[0]
    return marked_terms(term_counts(vectors, "vec_id", "terms", folded), records, 1.0 if common is None else common)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The terms that are too rare or too common to be useful."""
    return p6_terms(spark, folder).where(F.col("mark").isNotNull()).select("term", "mark")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that hold test items wholly, partly or changed, with the place, the longest run and the similarity."""
    leaks = leaked_items(_documents(spark, folder), table(spark, folder, "eval_items"))
    return leaks.withColumn("similarity", F.round("similarity", 6))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that repeat passages of test items."""
    return p7_report(spark, folder).where(F.col("run") >= PASSAGE).select("doc_id", "item_id")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The uses of documents that make up the mixture, with their order."""
    return Mixture(_documents(spark, folder), table(spark, folder, "mix_targets")).rows()


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source reached."""
    return Mixture(_documents(spark, folder), table(spark, folder, "mix_targets")).shares()


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """(id, segments, label) of all documents."""
    documents = _documents(spark, folder)
    judge = train(labelled_sample(documents, "text", "lang"))
    return languages(documents, "doc_id", "text", judge, keep=["lang"])


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    rows = _judged(spark, folder).select("id", F.posexplode("segments").alias("segment", "s"))
    return rows.select(F.col("id").alias("doc_id"), "segment", "s.start", "s.end", "s.lang", "s.confidence").distinct()


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the languages it holds, the main one first, and the confidence in each."""
    held = held_languages(_judged(spark, folder))
    return held.select(F.col("id").alias("doc_id"), F.posexplode_outer("held").alias("place", "h")).select(
        "doc_id", "place", "h.lang", "h.confidence"
    ).distinct()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of the documents whose label is missing or wrong, and of those in several languages."""
    held = held_languages(_judged(spark, folder))
    single = F.size("held") == 1
    right = F.col("held")[0]["lang"].eqNullSafe(label_code(F.col("lang")))
    return (
        held.where((F.size("held") > 0) & ~(single & right))
        .select(F.col("id").alias("doc_id"), F.explode("held.lang").alias("lang")).distinct()
    )


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_clean": p2_clean,
    "p3_found": p3_found,
    "p3_consistent": p3_consistent,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p6_terms": p6_terms,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_documents": p9_documents,
    "p9_segments": p9_segments,
}

_PAIRS_SQL = """
    SELECT '{field}' AS field, a.id AS id_a, b.id AS id_b
    FROM sized_{field} a JOIN sized_{field} b ON a.v = b.v AND a.id < b.id
    GROUP BY a.id, b.id, a.n, b.n
    HAVING count(*) * {q} >= {p} * (a.n + b.n - count(*))
"""
_SIZED_SQL = """
    values_{field} AS (
        SELECT DISTINCT id, {fold} AS v FROM (SELECT {key} AS id, unnest({list}) AS x FROM {table}) WHERE x IS NOT NULL
    ),
    sized_{field} AS (
        SELECT * FROM (SELECT id, v, count(*) OVER (PARTITION BY id) AS n FROM values_{field}) WHERE n >= 5
    )
"""
_P1 = (
    {"field": "fileVectors", "fold": r"trim(lower(x), E' \t\n\r\x0b\x0c' || chr(160) || chr(12288))", "key": "vec_id", "list": "terms", "table": "file_vectors", "p": 3, "q": 5},
    {"field": "signatures", "fold": "x", "key": "sig_id", "list": "signature", "table": "signatures", "p": 1, "q": 2},
)

_P6 = r"""
    WITH terms AS (
        SELECT id, trim(lower(x), E' \t\n\r\x0b\x0c' || chr(160) || chr(12288)) AS term
        FROM (SELECT id, unnest(terms) AS x FROM (SELECT DISTINCT vec_id AS id, terms FROM file_vectors WHERE vec_id IS NOT NULL))
        WHERE x IS NOT NULL
    ),
    counted AS (
        SELECT term, count(*) AS occurrences, count(DISTINCT id) AS records FROM terms GROUP BY term
    ),
    sizes AS (
        SELECT (SELECT count(DISTINCT vec_id) FROM file_vectors) AS n,
               (SELECT max(common_words_threshold) FROM vault_settings WHERE vault = '*') AS common
    )
"""

# Letters of one shape that the documents use, as in lookalikes.SHAPES, for DuckDB's translate().
_SHAPED = [group for group in SHAPES if len(group) > 1]
_FROM, _TO = "".join(group[1:] for group in _SHAPED), "".join(group[0] * (len(group) - 1) for group in _SHAPED)
_WORDS_SQL = r"""
    {name}_words AS (
        SELECT id, regexp_extract_all(lower(nfc_normalize(translate(
            regexp_replace(regexp_replace(regexp_replace(text, '</?(br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr)\b[^<>]*>', ' ', 'gi'),
                '</?[A-Za-z][^<>]*>', '', 'g'), '[\x{{ad}}\x{{200b}}-\x{{200f}}\x{{2060}}\x{{feff}}]', '', 'g'),
            '{a}', '{b}'))), '[\p{{L}}\p{{N}}]+') AS w
        FROM (SELECT {id} AS id, text FROM {table})
    ),
    {name}_runs AS (
        SELECT DISTINCT id, array_to_string(w[i : i + 12], ' ') AS run
        FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS i FROM {name}_words)
    )
"""

SQL = {
    "p7_found": "WITH " + ", ".join(
        _WORDS_SQL.format(name=n, id=i, table=t, a=_FROM, b=_TO) for n, i, t in (("d", "doc_id", "documents"), ("e", "item_id", "eval_items"))
    ) + " SELECT DISTINCT d.id AS doc_id, e.id AS item_id FROM d_runs d JOIN e_runs e USING (run)",
    "p1_found": "WITH " + ", ".join(_SIZED_SQL.format(**x) for x in _P1) + " UNION ALL ".join(_PAIRS_SQL.format(**x) for x in _P1),
    "p4_found": """
        WITH settings AS (SELECT vault, max(max_suggestions) AS n FROM vault_settings GROUP BY vault),
        best AS (
            SELECT r.query_id, r.file, max(r.similarity) AS score,
                   max(coalesce(s.n, (SELECT n FROM settings WHERE vault = '*'), 0)) AS n
            FROM related_notes r LEFT JOIN settings s ON s.vault = r.vault
            WHERE r.similarity > 0 AND r.similarity <= 1 AND NOT isnan(r.similarity)
              AND r.query_id IS NOT NULL AND r.file IS NOT NULL
              AND NOT EXISTS (SELECT 1 FROM notes o WHERE o.note_id = r.query_id AND o.path = r.file)
            GROUP BY r.query_id, r.file
        )
        SELECT query_id, file FROM (
            SELECT query_id, file, n, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file) AS place FROM best
        ) WHERE place <= n
    """,
    "p6_terms": _P6 + """
        SELECT term, occurrences, records, CASE
            WHEN records / n >= common THEN 'common'
            WHEN records < 3 AND NOT regexp_matches(term, '\\s') THEN 'rare' END AS mark
        FROM counted, sizes
    """,
    "p6_found": _P6 + """
        SELECT term, CASE WHEN records / n >= common THEN 'common' ELSE 'rare' END AS mark
        FROM counted, sizes WHERE records / n >= common OR records < 3 AND NOT regexp_matches(term, '\\s')
    """,
}
