"""The corpus that an index is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinity.functions.text import base_name, titled
from affinity.session import spread
from affinity.sources.tables import table

#: doc_id orders the corpus: it breaks ties and says which documents come first.
COLUMNS = ["doc_id", "path", "title", "text", "mtime"]


def document_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, title, text, mtime) of the documents table, each text behind its title."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "path", "text", "mtime"))
    title = base_name(F.col("path"))
    return docs.select("doc_id", "path", title.alias("title"), titled(title, F.col("text")).alias("text"), "mtime")


def is_markdown(extension: Column) -> Column:
    return F.lower(extension) == "md"


def note_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The Markdown notes of the notes table; their texts have the title in front already."""
    notes = table(spark, folder, "notes").where(is_markdown(F.col("extension")) & F.col("note_id").isNotNull())
    return notes.select(
        F.col("note_id").alias("doc_id"), "path", F.col("basename").alias("title"), F.coalesce("text", F.lit("")).alias("text"), "mtime"
    ).distinct()


def folder_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The Markdown files below a folder. A file is a record; its id is a hash of its path.

    Unreadable files are skipped when ``spark.sql.files.ignoreCorruptFiles`` is on; failed reads
    are retried with their task.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(folder)
    )
    title = base_name(F.col("path"))
    text = F.col("content").cast("string")
    return files.select(
        F.xxhash64("path").alias("doc_id"), "path", title.alias("title"), titled(title, text).alias("text"), F.col("modificationTime").alias("mtime")
    )
