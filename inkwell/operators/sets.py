"""Sets as tables: what one has and the other lacks, and groups filtered by a set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of b that a lacks (in this order of the arguments)."""
    return b.distinct().join(a.distinct(), b.columns, "left_anti")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_semi")


def filter_groups(groups: DataFrame, allowed: DataFrame, group: str, item: str) -> DataFrame:
    """group, items: how many distinct items of each group are allowed; groups left empty stay with 0."""
    kept = groups.select(group, item).distinct().join(allowed.select(item).distinct().withColumn("ok", F.lit(1)), item, "left")
    return kept.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("ok").alias("items"))


def subset_violations(groups: DataFrame, allowed: DataFrame, item: str) -> DataFrame:
    """items of groups that are not allowed; empty if groups are a subset."""
    return groups.select(item).where(F.col(item).isNotNull()).distinct().join(allowed.select(item), item, "left_anti")


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among those done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
