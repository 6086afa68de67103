"""The N best items of every group, with a fixed rule for ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_scores(df: DataFrame, group: str, item: str, score: str, *, low: float = 0.0, high: float = 1.0, keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per group and item with the item's best valid score, above ``low`` and at most ``high``.

    NaN and null scores are not valid; rows with a null group or item are dropped. ``keep``
    names further columns, of which the greatest value stays. Scores are reduced before and
    after the shuffle, which is on group and item, so that a group with very many rows is spread.
    """
    valid = (F.col(score) > low) & (F.col(score) <= high) & ~F.isnan(score)
    rows = df.where(valid & F.col(group).isNotNull() & F.col(item).isNotNull())
    extra = keep or {}
    rows = rows.select(
        F.col(group).alias("group"), F.col(item).alias("item"), F.col(score).alias("score"), *[c.alias(n) for n, c in extra.items()]
    )
    return rows.groupBy("group", "item").agg(F.max("score").alias("score"), *[F.max(n).alias(n) for n in extra])


def top_n(df: DataFrame, most: int, *, limit: str | None = None) -> DataFrame:
    """The first ``most`` items of each group of (group, item, score) by score, equal scores by item in code point order.

    Adds ``rank``. ``limit`` names a column with the row's own number, which must not exceed
    ``most``; a null or non-positive number keeps nothing. The rank filter is a
    constant, so the optimiser keeps at most ``most`` rows of a group per task before the
    shuffle, and a group never meets in one task as a whole.
    """
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.asc("item"))
    ranked = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked if limit is None else ranked.where(F.col("rank") <= F.col(limit))


def top_n_without(df: DataFrame, most: int, excluded: DataFrame, *, limit: str | None = None) -> DataFrame:
    """``top_n`` of the rows that are not among ``excluded`` (group, item).

    A group is first cut to ``most`` items and as many more as any group excludes; the exact
    exclusion and ranking then run over these few rows.
    """
    excluded = excluded.where(F.col("group").isNotNull() & F.col("item").isNotNull()).distinct()
    spare = excluded.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    first = top_n(df, most + spare).drop("rank")
    return top_n(first.join(excluded, ["group", "item"], "left_anti"), most, limit=limit)
