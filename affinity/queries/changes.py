"""Queries on new or changed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from affinity.operators.incremental import changes_by_run
from affinity.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """For each successful run of the indexer, the files that are new or changed."""
    return changes_by_run(
        table(spark, folder, "file_metadata"), table(spark, folder, "cache_runs"),
        key="file_id", version=["mtime", "size"], seen="seen_at", tie="meta_id",
    )


QUERIES = {"p5_found": p5_found}

SQL = {
    "p5_found": """
        WITH ok AS (
            SELECT run_id, started_at, lag(run_id) OVER (ORDER BY started_at, run_id) AS before
            FROM (SELECT DISTINCT * FROM cache_runs) WHERE status = 'ok' AND started_at IS NOT NULL
        ),
        state AS (
            SELECT run_id, file_id, mtime, size FROM (
                SELECT r.run_id, m.file_id, m.mtime, m.size,
                       row_number() OVER (PARTITION BY r.run_id, m.file_id ORDER BY m.seen_at DESC, m.meta_id DESC) AS n
                FROM ok r JOIN file_metadata m ON m.seen_at <= r.started_at AND m.file_id IS NOT NULL
            ) WHERE n = 1
        )
        SELECT s.run_id, s.file_id
        FROM state s JOIN ok r ON r.run_id = s.run_id LEFT JOIN state p ON p.run_id = r.before AND p.file_id = s.file_id
        WHERE p.file_id IS NULL OR s.mtime IS DISTINCT FROM p.mtime OR s.size IS DISTINCT FROM p.size
    """,
}
