"""Queries on links, saving and loading, and keeping an index up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.config import DEFAULT
from affinity.functions.text import base_name
from affinity.operators.links import has_link, link_edges, with_link
from affinity.operators.stats import debug_info
from affinity.plans.related import RelatedEngine
from affinity.queries.base import QUERY, engine, sql
from affinity.session import cut, shared_dir
from affinity.sources import store
from affinity.sources.corpus import note_corpus
from affinity.sources.tables import table
from affinity.streaming.updates import CHANGES, LiveIndex


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/affinity-{uuid.uuid4().hex}"


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a target each, to which about half of them link in one of three ways."""
    docs = table(spark, folder, "documents").select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    base = base_name(F.col("path"))
    link = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit(" [["), F.upper(base), F.lit("|x]]")))
        .when(F.col("doc_id") % 6 == 1, F.concat(F.lit(" [y]("), base, F.lit(".md)")))
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit(" [["), F.col("path"), F.lit("]]")))
        .when(F.col("doc_id") % 6 == 3, F.lit("\n## Related Notes\n- [[other]]\nrest"))
        .otherwise(F.lit(""))
    )
    return docs.select("doc_id", "path", base.alias("base"), F.concat("text", link).alias("text"))


def link_exists(spark: SparkSession, folder: str) -> DataFrame:
    return _linked(spark, folder).select("doc_id", has_link(F.col("text"), F.col("base"), F.col("path")).alias("linked"))


def add_link(spark: SparkSession, folder: str) -> DataFrame:
    new = with_link(F.col("text"), F.col("base"), F.col("path"), DEFAULT.custom_title)
    return _linked(spark, folder).select("doc_id", F.md5(F.encode(new, "utf-8")).alias("new_text"))


def note_links(spark: SparkSession, folder: str) -> DataFrame:
    """Who links to whom among the notes, by the titles and paths found between the brackets.

    Every note gets two links besides its own: to the title of the note after it and to the path of the fifth after it.
    """
    notes = note_corpus(spark, folder)
    title = notes.select((F.col("doc_id") - 1).alias("doc_id"), F.col("title").alias("next_title"))
    path = notes.select((F.col("doc_id") - 5).alias("doc_id"), F.regexp_replace("path", r"(?i)\.md$", "").alias("next_path"))
    linked = notes.join(title, "doc_id", "left").join(path, "doc_id", "left")
    new = F.concat_ws(" ", "text", F.concat(F.lit("[["), F.upper("next_title"), F.lit("|x]]")), F.concat(F.lit("[y]("), F.col("next_path"), F.lit(".md)")))
    return link_edges(linked.select("doc_id", "path", "title", new.alias("text")))


def debug_info_json(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    parsed = F.from_json("json", "settings struct<max_suggestions int, custom_title string>, index struct<documents bigint, bits int>")
    return debug_info(own.stats(), own.config).select(parsed.alias("j")).select("j.settings.max_suggestions", "j.settings.custom_title", "j.index.documents", "j.index.bits")


def index_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    place = store.IndexStore(spark, _place(spark))
    own.save(place)
    saved = place.load(bits=own.bits, hashes=own.config.hashes)
    return saved.filters.select("doc_id", "popcount")


def restart(spark: SparkSession, folder: str) -> DataFrame:
    """The documents most related to one, by an engine that starts from a saved index over a corpus without texts."""
    own = engine(spark, folder)
    place = store.IndexStore(spark, _place(spark))
    own.initialize(place)
    again = RelatedEngine(own.corpus.withColumn("text", F.lit(None).cast("string")), own.config, now=own.now)
    if not again.initialize(place):
        raise OSError("the saved index was not taken")
    return again.related(QUERY, 20).select("doc_id", "similarity")


def filter_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    own = engine(spark, folder)
    again = store.from_json(store.to_json(own.filters), own.bits, 3)
    return again.select("doc_id", F.posexplode_outer("words").alias("word_idx", "word")).where("word <> 0")


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    """A feed that adds all documents, edits every third of them and deletes every seventh."""
    docs = engine(spark, folder).corpus.select("doc_id", "text")
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    later = F.timestamp_seconds(F.lit(1_700_000_600))
    first = docs.select("doc_id", F.lit("create").alias("op"), F.when(F.col("doc_id") % 3 == 0, F.lit("an early draft")).otherwise(F.col("text")).alias("text"), start.alias("ts"))
    second = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("modify").alias("op"), "text", later.alias("ts"))
    gone = docs.where("doc_id % 7 = 0").select("doc_id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("text"), later.alias("ts"))
    return first.unionByName(second).unionByName(gone)


def _live(spark: SparkSession, folder: str) -> tuple[LiveIndex, DataFrame]:
    own = engine(spark, folder)
    return LiveIndex(spark, _place(spark), own.bits, own.config, documents=own.documents), cut(_changes(spark, folder))


def incremental_upsert(spark: SparkSession, folder: str) -> DataFrame:
    live, changes = _live(spark, folder)
    live.apply(changes.where("op = 'create'"), 0)
    live.apply(changes.where("op = 'modify'"), 1)
    live.apply(changes.where("op = 'modify'"), 1)  # tried again
    return live.current().select("doc_id", "popcount")


def incremental_delete(spark: SparkSession, folder: str) -> DataFrame:
    live, changes = _live(spark, folder)
    live.apply(changes.where("op = 'create'"), 0)
    live.apply(changes.where("op <> 'create'"), 1)
    live.compact()
    return live.current().select("doc_id", "popcount")


def stream_index(spark: SparkSession, folder: str) -> DataFrame:
    live, changes = _live(spark, folder)
    feed, checkpoint = _place(spark), _place(spark)
    names = [c.split()[0] for c in CHANGES.split(", ")]
    changes.select(names).where("op = 'create'").repartition(3).write.parquet(feed)
    live.follow(feed, checkpoint, files_per_batch=1).awaitTermination()
    # a later run goes on from the checkpoint, with the files that came in since
    changes.select(names).where("op <> 'create'").coalesce(1).write.mode("append").parquet(feed)
    live.follow(feed, checkpoint, files_per_batch=1).awaitTermination()
    return live.current().select("doc_id", "popcount")


QUERIES = {
    f.__name__: f
    for f in (link_exists, add_link, note_links, debug_info_json, index_roundtrip, restart, filter_roundtrip, incremental_upsert, incremental_delete, stream_index)
}

_LINKED = r"""SELECT doc_id, path, base, text || CASE doc_id % 6
        WHEN 0 THEN ' [[' || upper(base) || '|x]]' WHEN 1 THEN ' [y](' || base || '.md)' WHEN 2 THEN ' [[' || path || ']]'
        WHEN 3 THEN E'\n## Related Notes\n- [[other]]\nrest' ELSE '' END AS text
    FROM (SELECT doc_id, path, coalesce(text, '') AS text, regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') AS base FROM documents)"""
_HAS = r"""(contains(lower(text), '[[' || lower(base) || ']]') OR contains(lower(text), '[[' || lower(base) || '|') OR contains(lower(text), '](' || lower(base) || '.md)')
    OR contains(lower(text), '[[' || lower(path) || ']]') OR contains(lower(text), '[[' || lower(path) || '|'))"""
_WORD = "CASE WHEN bit % 64 = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (bit % 64) END"
#: Live indexes filter by length alone, since no stopwords were learned for them.
_PLAIN = {"since": "SELECT NULL::BIGINT AS since, []::VARCHAR[] AS common"}

SQL = {
    "link_exists": sql(f"SELECT doc_id, {_HAS} AS linked FROM linked", linked=_LINKED),
    "add_link": sql(
        rf"""SELECT doc_id, md5(CASE WHEN {_HAS} THEN text
            WHEN contains(text, E'\n## Related Notes\n') THEN regexp_replace(text, '\n## Related Notes\n((?:- \[\[[^\]]+\]\]\n)*)', E'\n## Related Notes\n\\1- [[' || base || E']]\n')
            ELSE text || E'\n\n## Related Notes\n- [[' || base || E']]\n' END) AS new_text FROM linked""",
        linked=_LINKED,
    ),
    "note_links": r"""
        WITH notes_md AS (SELECT DISTINCT note_id AS id, path, basename, mtime, coalesce(text, '') AS text FROM notes WHERE lower(extension) = 'md' AND note_id IS NOT NULL),
        own AS (
            SELECT o.id, o.path, o.basename, o.text || coalesce(' [[' || upper(t.basename) || '|x]]', '') || coalesce(' [y](' || regexp_replace(p.path, '(?i)\.md$', '') || '.md)', '') AS text
            FROM notes_md o LEFT JOIN notes_md t ON t.id = o.id + 1 LEFT JOIN notes_md p ON p.id = o.id + 5
        ),
        targets AS (SELECT DISTINCT id, lower(unnest(list_concat(regexp_extract_all(text, '\[\[([^\[\]|\n#]+)', 1), regexp_extract_all(text, '\]\(([^()\n]+)\.md\)', 1)))) AS target FROM own),
        names AS (SELECT DISTINCT id, unnest([lower(basename), lower(path), lower(regexp_replace(path, '(?i)\.md$', ''))]) AS target FROM own)
        SELECT DISTINCT t.id AS src_id, n.id AS dst_id FROM targets t JOIN names n USING (target) WHERE t.id <> n.id
    """,
    "debug_info_json": sql("SELECT 5 AS max_suggestions, 'Related Notes' AS custom_title, (SELECT count(*) FROM pops) AS documents, m AS bits FROM conf"),
    "index_roundtrip": sql("SELECT doc_id, n AS popcount FROM pops"),
    "restart": sql("SELECT doc_id, similarity FROM scores WHERE similarity > 0 ORDER BY similarity DESC, doc_id LIMIT 20"),
    "filter_roundtrip": sql(f"SELECT doc_id, bit // 64 AS word_idx, bit_or({_WORD}) AS word FROM bits GROUP BY doc_id, bit // 64"),
    "incremental_upsert": sql("SELECT doc_id, n AS popcount FROM pops", **_PLAIN),
    "incremental_delete": sql("SELECT doc_id, n AS popcount FROM pops WHERE doc_id % 7 <> 0", **_PLAIN),
    "stream_index": sql("SELECT doc_id, n AS popcount FROM pops WHERE doc_id % 7 <> 0", **_PLAIN),
}
