"""Turning links between classes of equal records into pairs of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.session import cut

EXPAND_LIMIT = 1000


def class_members(members: DataFrame) -> DataFrame:
    """``members`` (key, side, id), with the size ``c`` of each class and its smallest id of either side, ``rep_0`` and ``rep_1``.

    Rows repeated in full count once. Written once, since several joins read it.
    """
    members = members.distinct()
    classes = members.groupBy("key").agg(
        F.count("*").alias("c"), *[F.min(F.when(F.col("side") == s, F.col("id"))).alias(f"rep_{s}") for s in (0, 1)]
    )
    return cut(members.join(classes, "key"))


def own_rep() -> Column:
    """The representative of a member's class on its own side."""
    return F.when(F.col("side") == 0, F.col("rep_0")).otherwise(F.col("rep_1"))


def listed(members: DataFrame, limit: int) -> DataFrame:
    """The members of a class that stand in pairs with other classes: all of them up to ``limit``, else a representative of either side."""
    return members.where((F.col("c") <= limit) | (F.col("id") == own_rep()))


def _ordered(a: str, b: str, between: bool) -> list[Column]:
    if between:
        left = F.when(F.col(f"side_{a}") == 0, F.col(f"id_{a}")).otherwise(F.col(f"id_{b}"))
        right = F.when(F.col(f"side_{a}") == 0, F.col(f"id_{b}")).otherwise(F.col(f"id_{a}"))
        return [left.alias("id_a"), right.alias("id_b")]
    return [
        F.least(f"id_{a}", f"id_{b}").alias("id_a"),
        F.greatest(f"id_{a}", f"id_{b}").alias("id_b"),
    ]


def _wanted(a: str, b: str, between: bool) -> Column:
    if between:
        return F.col(f"side_{a}") != F.col(f"side_{b}")
    return F.col(f"id_{a}") != F.col(f"id_{b}")


def _as(members: DataFrame, name: str) -> DataFrame:
    return members.select(
        F.col("key").alias(f"key_{name}"),
        F.col("side").alias(f"side_{name}"),
        F.col("id").alias(f"id_{name}"),
    )


def cross_pairs(links: DataFrame, members: DataFrame, limit: int, between: bool = False) -> DataFrame:
    """Pairs of records from ``links`` (key_a, key_b) between different classes."""
    shown = listed(members, limit)
    return (
        links.join(_as(shown, "a"), "key_a")
        .join(_as(shown, "b"), "key_b")
        .where(_wanted("a", "b", between))
        .select(*_ordered("a", "b", between))
        .distinct()
    )


def copy_pairs(members: DataFrame, limit: int, between: bool = False) -> DataFrame:
    """Pairs of equal records.

    A class of up to ``limit`` members gives all its pairs. A larger one gives the pair of
    each member and the representative, between two tables that of the other side, from which the rest
    follows, so that no class makes more rows than ``limit`` times its members.
    """
    shown = members.where((F.col("c") > 1) & (F.col("c") <= limit))
    small = (
        _as(shown, "a")
        .join(_as(shown, "b"), F.col("key_a") == F.col("key_b"))
        .where(_wanted("a", "b", between))
        .where(F.struct("side_a", "id_a") < F.struct("side_b", "id_b"))
    )
    other = F.when(F.col("side") == 0, F.col("rep_1")).otherwise(F.col("rep_0")) if between else F.col("rep_0")
    large = members.where(F.col("c") > limit).select(
        F.col("side").alias("side_a"), F.col("id").alias("id_a"),
        (F.lit(1) - F.col("side") if between else F.col("side")).alias("side_b"), other.alias("id_b"),
    ).where(F.col("id_b").isNotNull())
    return (
        small.select(*_ordered("a", "b", between))
        .unionByName(large.where(_wanted("a", "b", between)).select(*_ordered("a", "b", between)))
        .distinct()
    )
